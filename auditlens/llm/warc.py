"""Web archives: pages to WARC records and back, and one globally ordered index of captures.

*Writing.* Each page becomes a record of WARC/1.1. Of pages with equal payloads the one of largest
page_id is a ``response`` with the payload, the others are ``revisit`` records that refer to it and
hold no payload. Payloads are equal if their SHA-256 and SHA-1 are. Records are text that Spark's own
writer puts into gzip files, so tasks may fail and be repeated, and any file system will do.

*Reading.* A file is read from its start to its end by one task. Spark gives the pieces between
empty lines; they are put together again as a stream of bytes, and lengths alone tell where a
record ends, whatever its payload holds. A task holds one record at a time. Digests are computed
anew from the payload; a difference from the header is an error.

*Index.* Every RUN_ROWS captures of an archive are sorted in memory by URL key and time: a run. Runs
are written, cut at common bounds into ranges (a range of keys of about RANGE_ROWS captures; a URL
of very many captures goes over several), and a loser tree merges the pieces of all runs within a
range. Ranges follow one another, so the merged rows have one order over all archives; a count per
range turns it into positions and numbers of captures of a URL.

The URL key is the host in reverse order with commas, without scheme, ``www.`` and port, then ``)``
and the path and query in lower case without fragment; a null URL has the empty key. Time is the column
``captured`` of the pages if there is one; else, or if null, page_id seconds after EPOCH, within
the years 1970 to 9999.

A null html is an empty payload. Rows with one page_id and equal payloads are all responses if no
larger page_id holds that payload. A null page_id is never referred to by a number: it revisits a
page that has one, or is a response. An empty table gives empty archives. Line ends within a URL
are written as %0D and %0A. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.sources.staging import stage, staging_root

END = "\r\n"
BLANK = END + END
#: The start of 2020 and the end of 9999 in seconds since 1970.
EPOCH, LAST_SECOND = 1_577_836_800, 253_402_300_799
#: Captures that are sorted in memory, and those that one merging task gets (about 300 bytes each).
RUN_ROWS, RANGE_ROWS = 50_000, 200_000
#: Merged captures of one output batch.
BATCH_ROWS = 10_000


# --- digests and records -------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: forty bits, eight digits, at a time."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(text: Column) -> Column:
    """A name-based id: the same page and payload always have the same one."""
    return F.regexp_replace(F.substring(F.sha2(text, 256), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)) for name, value in fields])


def records(pages: DataFrame) -> DataFrame:
    """One text per page: the record without the empty line that ends it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    seconds = F.coalesce(F.col("page_id").cast("long"), F.lit(0)) + EPOCH
    if "captured" in pages.columns:
        seconds = F.coalesce(F.unix_timestamp(F.col("captured").cast("timestamp")), seconds)
    seconds = F.least(F.greatest(seconds, F.lit(0)), F.lit(LAST_SECOND))
    time = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"), payload.alias("payload"),
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.concat(F.translate(time.cast("string"), " ", "T"), F.lit("Z")).alias("time"),
    ).withColumns({"sha1": base32_sha1(F.col("payload")), "sha256": F.sha2("payload", 256)})
    # Digests alone are grouped; the payloads are moved once, to the side of their response's id.
    largest = stage(given.groupBy("sha256").agg(
        F.max("page_id").alias("kept_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "payloads")
    # The hash table holds ids only; the side with payloads is neither sorted nor built.
    met = given.join(largest.hint("shuffle_hash"), "sha256", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("kept_id")) & F.col("kept_id").isNotNull(), F.lit(False))

    def name(page: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws(":", F.coalesce(F.col(page).cast("string"), F.lit("-")), "sha256")), F.lit(">"))

    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "),
                    size.cast("string"), F.lit(BLANK))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    return met.withColumn("revisit", revisit).withColumn("block", block).select(F.concat(
        F.lit("WARC/1.1" + END),
        _lines(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", name("page_id")),
            ("WARC-Date", F.col("time")),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(F.col("revisit"), name("kept_id"))),
            ("X-Page-ID", F.col("page_id")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block")),
        ), F.lit(END), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of all pages as gzip files in the folder ``path``."""
    records(pages).write.option("lineSep", BLANK).option("compression", "gzip").text(path)


# --- reading -------------------------------------------------------------------------------------


class Stream:
    """Bytes of one archive, fed piece by piece; gives the whole records among them."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0
        self.need = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.parts.append(piece + BLANK.encode())
        self.size += len(piece) + len(BLANK)
        while self.size >= self.need:
            data = b"".join(self.parts)
            head = data.find(BLANK.encode())
            if head < 0:
                self.parts, self.need = [data], self.size + 1
                return
            version, *lines = data[:head].decode("utf-8", "surrogateescape").split(END)
            if not version.startswith("WARC/"):
                raise ValueError(f"No WARC record where one should start: {version[:60]!r}")
            fields = dict(line.split(": ", 1) for line in lines)
            begin = head + len(BLANK)
            end = begin + int(fields["Content-Length"])
            if len(data) < end + len(BLANK):
                self.parts, self.need = [data], end + len(BLANK)
                return
            yield fields, data[begin:end]
            data = data[end + len(BLANK):]
            self.parts, self.size, self.need = [data] if data else [], len(data), 1

    def close(self, name: str | None) -> None:
        if self.size:
            raise ValueError(f"{name} ends within a record")


def url_key(url: str | None) -> str:
    """Sort key of a URL, see the module."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.split("#", 1)[0])
    host, path = re.match(r"([^/?]*)(.*)", rest, re.DOTALL).groups()
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d*$", "", host.rpartition("@")[2].lower()))
    return ",".join(reversed(host.split("."))) + ")" + (path.lower() or "/")


CAPTURE = ("url_key string, captured string, page_id long, record_id string, record_type string, refers_to_record string, "
           "payload_bytes long, payload_digest string")
_FIELDS = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_id", pa.string()),
                     ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string())])
_RUN = _FIELDS.append(pa.field("run", pa.string())).append(pa.field("place", pa.int64()))


def _capture(fields: dict[str, str], block: bytes) -> tuple:
    payload = block.split(BLANK.encode(), 1)[1]
    size, digest = len(payload), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        size = digest = None  # those of the record that it refers to
    elif base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"Payload of {fields['WARC-Record-ID']} differs from its digest")
    page_id = fields.get("X-Page-ID")
    return (url_key(fields.get("WARC-Target-URI")), fields["WARC-Date"], None if page_id is None else int(page_id),
            fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), size, digest)


def _order(row: tuple) -> tuple:
    """Key, time, page (null first), record: bytes compare as code points do."""
    return row[0].encode("utf-8", "surrogateescape"), row[1], row[2] is not None, row[2] or 0, row[3]


def _sorted_run(rows: list[tuple], run: str) -> pa.RecordBatch:
    rows.sort(key=_order)
    columns = [*zip(*rows, strict=True)]
    arrays = [pa.array([x if x is None else x.encode("utf-8", "surrogateescape") for x in column], pa.binary())
              if pa.types.is_string(field.type) else pa.array(column, field.type)
              for column, field in zip(columns, _FIELDS, strict=True)]
    arrays += [pa.array([run] * len(rows), pa.binary()), pa.array(range(len(rows)), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, _RUN.names)


def _runs(run_rows: int):
    """Task: captures of archives, in sorted runs."""

    def run(batches):
        stream, name, rows, count = Stream(), None, [], 0
        for batch in batches:
            for file, piece in zip(batch["file"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if file != name:
                    if rows:
                        yield _sorted_run(rows, f"{name}#{count}".encode())
                    stream.close(name)
                    stream, name, rows, count = Stream(), file, [], 0
                for fields, block in stream.feed(piece):
                    rows.append(_capture(fields, block))
                    if len(rows) >= run_rows:
                        yield _sorted_run(rows, f"{name}#{count}".encode())
                        rows, count = [], count + 1
        stream.close(name)
        if rows:
            yield _sorted_run(rows, f"{name}#{count}".encode())

    return run


def read_runs(spark: SparkSession, path: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Sorted runs of the captures in all archives of a folder: the fields of CAPTURE, run, place.
    Revisits have no size and digest yet."""
    pieces = spark.read.option("lineSep", BLANK).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("piece"))
    texts = [f.name for f in _RUN if pa.types.is_string(f.type)]
    raw = ", ".join(f"{f.name} {'binary' if f.name in texts else 'long'}" for f in _RUN)
    return pieces.mapInArrow(_runs(run_rows), raw).select(
        *[F.col(f.name).cast("string").alias(f.name) if f.name in texts else F.col(f.name) for f in _RUN])


def resolved(runs: DataFrame) -> DataFrame:
    """Revisits with size, digest and page of the record they refer to; a missing one is an error."""
    answers = runs.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    revisits = runs.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(
        stage(answers, "answers"), "refers_to_record", "left")
    missing = F.raise_error(F.concat(F.lit("No record for the revisit "), "record_id"))
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("bytes").isNull(), missing.cast("long")).otherwise(F.col("bytes")))
    return revisits.withColumnRenamed("digest", "payload_digest").drop("bytes").unionByName(
        runs.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")))


# --- merging -------------------------------------------------------------------------------------


class LoserTree:
    """k-way merge: ``keys`` give the next key of each source, None at its end. Inner nodes hold the
    loser of the match below, so a new key meets one opponent per level."""

    def __init__(self, keys: list[Callable[[], object]]):
        self.next_key = keys
        self.leaves = 1 << max(len(keys) - 1, 0).bit_length()
        self.key = [k() for k in keys] + [None] * (self.leaves - len(keys))
        self.loser = [0] * self.leaves
        winner = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winner[1] if self.leaves > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.key[a], self.key[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[int]:
        """The source of each row in merged order."""
        while self.key[self.top] is not None:
            source = self.top
            yield source
            self.key[source] = self.next_key[source]()
            node, winner = (source + self.leaves) >> 1, source
            while node:
                if not self._before(winner, self.loser[node]):
                    winner, self.loser[node] = self.loser[node], winner
                node >>= 1
            self.top = winner


def _merged(batches):
    """Task: a range as pieces of runs, one after the other; merged rows with their place in it."""
    pieces = [b for b in batches if b.num_rows]
    if not pieces:
        return
    table = pa.Table.from_batches(pieces).combine_chunks()
    run = table["run"].to_numpy()
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    columns = [table[c].to_pylist() for c in ("url_key", "captured", "page_id", "record_id")]
    keys = [_order(row) for row in zip(*columns, strict=True)]
    ends = [*starts[1:].tolist(), len(keys)]
    tree = LoserTree([(lambda rows=iter(keys[a:b]): next(rows, None)) for a, b in zip(starts.tolist(), ends, strict=True)])
    at, order, numbers, seen, last = starts.tolist(), [], [], 0, None
    for source in tree:
        row = at[source]
        at[source] += 1
        seen = seen + 1 if keys[row][0] == last else 1
        last = keys[row][0]
        order.append(row)
        numbers.append(seen)
    for begin in range(0, len(order), BATCH_ROWS):
        some = order[begin:begin + BATCH_ROWS]
        out = table.take(pa.array(some)).drop_columns(["run", "place"])
        out = out.append_column("place", pa.array(range(begin, begin + len(some)), pa.int64()))
        yield from out.append_column("number", pa.array(numbers[begin:begin + len(some)], pa.int64())).combine_chunks().to_batches()


def merged(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with ``position`` (from 1, over all archives, in the order of URL key, time and
    page) and ``capture_no`` (from 1, within the URL key)."""
    captures = stage(captures, "captures")
    ranges = max(1, -(-captures.count() // range_rows))
    bounds = ["url_key", "captured", "page_id", "record_id", "run", "place"]
    pieces = captures.repartitionByRange(ranges, *bounds).sortWithinPartitions("run", "place")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema if f.name not in ("run", "place"))
    rows = stage(pieces.mapInArrow(_merged, f"{schema}, place long, number long").withColumn("range", F.spark_partition_id()), "merged")
    # One row per range: how many rows lie before it, and how many captures of its first key.
    each = rows.groupBy("range").agg(
        F.count("*").alias("rows"), F.min_by("url_key", "place").alias("first_key"), F.max_by("url_key", "place").alias("last_key"),
        F.max_by("number", "place").alias("last_number"))
    line = Window.orderBy("range")
    same_end = Window.partitionBy("last_key").orderBy("range")
    each = each.withColumn("upto", F.sum("last_number").over(same_end)).select(
        "range", "first_key", (F.sum("rows").over(line) - F.col("rows")).alias("before"),
        F.when(F.lag("last_key").over(line) == F.col("first_key"), F.lag("upto").over(line)).otherwise(0).alias("carried"))
    number = F.col("number") + F.when(F.col("url_key") == F.col("first_key"), F.col("carried")).otherwise(0)
    return rows.join(each, "range").select(
        *[c for c in rows.columns if c not in ("place", "number", "range")],
        (F.col("before") + F.col("place") + 1).alias("position"), number.alias("capture_no"))


def histories(pages: DataFrame, path: str | None = None, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the archives of all pages (to ``path``, or a staged folder), read them back and merge
    their index: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured,
    record_id, position, capture_no."""
    spark = pages.sparkSession
    path = path or f"{staging_root(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    runs = stage(read_runs(spark, path, run_rows), "runs")
    return merged(resolved(runs), range_rows).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "record_id",
        "position", "capture_no")
