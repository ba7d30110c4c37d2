"""Secret scans in DataFrame functions only: patterns, and entropy of candidate strings.

Three fixed patterns (assignments, access keys, long hex numbers) give the base spans. Beyond
them, maximal strings of 20 or more of A-Z a-z 0-9 + / _ = - that hold a digit are candidates.
The narrowest character class that holds a candidate sets its threshold. A window of ``WINDOW``
characters slides over it: entering and leaving characters change the counts, and with them the
sum of c * log2(c) from which the Shannon entropy follows, so no window is counted anew. The span
reaches from the first to the last window above the threshold. Allow-listed candidates (UUIDs,
dates and numbers, placeholders) and those that touch a base span are left out.

Positions are code points, ends exclusive. A null or empty text has no spans. Rows are judged one
by one, without a shuffle; repeated rows give repeated results. The time for a candidate grows with
its length, that for its text with its length and with the number of base spans times candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_token")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LIKELY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Windows of one chunk of a candidate; the chunk is longer by a window less one.
CHUNK = 4096
#: Matches that are placed by one running sum.
BLOCK = 256
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class of a candidate, pattern of the whole string, least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("entropy_base64", r"^[A-Za-z0-9+/]+=*$", 3.7),
    ("entropy_token", r"^", 3.7),
)
#: Strings that look random but are no secrets.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[0-9_=+/-]+$",
    r"(?i:example|sample|placeholder|dummy|changeme|your[_-])",
    r"(?i:0123456789|abcdefghij|xxxxxx)",
)
MASK = "[SECRET]"


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, no: Column, good=None, group: int = 0) -> Column:
    """All matches of the pattern that are good by their group: array of (start, no, end, found).

    ``split`` and ``regexp_extract_all`` walk the same matches, so the lengths of the pieces
    between them give their places: by running sums within blocks and then over the blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.arrays_zip(found.alias("found"), value.alias("value"), F.split(text, pattern, -1).alias("before"))
    kind = "array<struct<start:int,no:int,end:int,found:string>>"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["found"])
        item = F.struct(start.alias("start"), no.alias("no"), end.alias("end"), pair["found"].alias("found"))
        keep = pair["found"].isNotNull() & (good(pair["value"]) if good is not None else F.lit(True))
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"),
            F.when(keep, F.concat(state["spans"], F.array(item))).otherwise(state["spans"]).alias("spans"))

    def block(of: Column) -> Column:
        return F.aggregate(of, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), step)

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            (s["start"] + by).alias("start"), s["no"].alias("no"), (s["end"] + by).alias("end"), s["found"].alias("found")))

    def follow(state: Column, part: Column) -> Column:
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(
            state["spans"], F.array(moved(part["spans"], state["at"]))).alias("spans"))

    def blocks(all_pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(all_pairs), F.lit(BLOCK)), lambda i: block(F.slice(all_pairs, i, BLOCK)))

    return F.aggregate(_bound(pairs, blocks), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("spans")),
                       follow, lambda s: F.flatten(s["spans"]))


def _f(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _with(counts: Column, letter: Column, count: Column) -> Column:
    return F.concat(F.slice(counts, F.lit(1), letter - 1), F.array(count), F.slice(counts, letter + 1, F.lit(len(ALPHABET))))


def _hot_ends(letters: Column, least: Column) -> Column:
    """(first, last): ends of the first and the last window of at least that entropy, of the
    letters (places in ALPHABET) of one chunk."""
    moves = F.transform(letters, lambda letter, i: F.struct(
        (i + 1).alias("at"), letter.alias("enter"),
        F.when(i >= WINDOW, F.get(letters, i - WINDOW)).otherwise(F.lit(0)).alias("leave")))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(state: Column, move: Column) -> Column:
        enter, leave = move["enter"], move["leave"]
        had = F.element_at(state["counts"], enter)
        lost = F.element_at(state["counts"], F.greatest(leave, F.lit(1)))
        entered = _with(state["counts"], enter, had + 1)
        total = state["sum"] + _f(had + 1) - _f(had)
        # The same character may enter and leave: then nothing changes.
        changed = F.when(enter == leave, F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"))).when(
            leave == 0, F.struct(entered.alias("counts"), total.alias("sum"))).otherwise(F.struct(
                _with(entered, leave, lost - 1).alias("counts"), (total + _f(lost - 1) - _f(lost)).alias("sum")))

        def judged(new: Column) -> Column:
            hot = (move["at"] >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - new["sum"] / WINDOW >= least)
            return F.struct(
                new["counts"].alias("counts"), new["sum"].alias("sum"),
                F.when((state["first"] == 0) & hot, move["at"]).otherwise(state["first"]).alias("first"),
                F.when(hot, move["at"]).otherwise(state["last"]).alias("last"))

        return _bound(changed, judged)

    return F.aggregate(moves, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _hot_windows(word: Column, least: Column) -> Column:
    """(first, last): ends of the first and the last window of the word of at least that entropy.

    The word is read in chunks that overlap by a window less one, so the cost is linear.
    """
    chunks = F.regexp_extract_all(word, F.lit(f"(?=(.{{1,{CHUNK + WINDOW - 1}}})).{{1,{CHUNK}}}"), F.lit(1))

    def ends(chunk: Column, number: Column) -> Column:
        letters = F.transform(F.split(chunk, ""), lambda letter: F.instr(F.lit(ALPHABET), letter))
        return _bound(letters, lambda x: _bound(_hot_ends(x, least), lambda e: F.when(e["first"] > 0, F.struct(
            (e["first"] + number * CHUNK).alias("first"), (e["last"] + number * CHUNK).alias("last")))))

    return _bound(F.transform(chunks, ends), lambda found: F.struct(
        F.coalesce(F.array_min(F.transform(found, lambda e: e["first"])), F.lit(0)).alias("first"),
        F.coalesce(F.array_max(F.transform(found, lambda e: e["last"])), F.lit(0)).alias("last")))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``found``: array of (start, no, end), sorted; no is a place in KINDS.

    ``docs`` has the column ``text``, and none named found.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,no:int,end:int,found:string>>")

    def kind(name: str) -> Column:
        return F.lit(KINDS.index(name)).cast("int")

    base = docs.select("*", F.concat(
        F.when(F.rlike(text, F.lit(ASSIGN_LIKELY)), _spans(text, ASSIGN, kind("assign"), lambda v: F.length(v) >= 6, 1)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, kind("access"))).otherwise(none),
        F.when(F.rlike(text, F.lit(HEX)), _spans(text, HEX, kind("hex"))).otherwise(none),
    ).alias("__base"), F.when(F.rlike(text, F.lit(CANDIDATE)), _spans(
        text, CANDIDATE, F.lit(0), lambda v: F.rlike(v, F.lit("[0-9]")))).otherwise(none).alias("__more"))

    def free(span: Column) -> Column:
        touched = F.exists("__base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | F.rlike(span["found"], F.lit(pattern))
        return ~touched & ~allowed

    def scored(span: Column) -> Column:
        number, least = kind(CLASSES[-1][0]), F.lit(CLASSES[-1][2])
        for name, pattern, bits in CLASSES[-2::-1]:
            fits = F.rlike(span["found"], F.lit(pattern))
            number = F.when(fits, kind(name)).otherwise(number)
            least = F.when(fits, F.lit(bits)).otherwise(least)
        hot = _hot_windows(span["found"], least)
        return F.struct(span["start"].alias("start"), number.alias("no"), hot.alias("hot"))

    more = base.withColumn("__more", F.transform(F.filter("__more", free), scored))
    extra = F.transform(F.filter("__more", lambda s: s["hot"]["first"] > 0), lambda s: F.struct(
        (s["start"] + s["hot"]["first"] - WINDOW).alias("start"), s["no"].alias("no"),
        (s["start"] + s["hot"]["last"]).alias("end")))
    plain = F.transform("__base", lambda s: F.struct(s["start"], s["no"], s["end"]))
    return more.withColumn("found", F.array_sort(F.concat(plain, extra))).drop("__base", "__more")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["no"] + 1), s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["no"] < 3)


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["no"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by MASK."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), F.lit(MASK))
        return F.struct(
            F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))).otherwise(text)
