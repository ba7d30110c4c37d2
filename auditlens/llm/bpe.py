"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decode.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours are: if
merging the bytes of both alone gives these two tokens again. That is a condition on neighbours,
so a nondeterministic finite-state transducer can guess the tokens: its states are (token before,
node of the vocabulary trie that the bytes of the next token have reached). At a trie node of a
token that fits the one before it may emit the token and start the next one. A guess of which no
longer token can fit is dropped, and the token before is forgotten once every one would fit.

``Transducer`` determinises it by subset construction while it reads: a deterministic state is
the set of guesses that are still alive, each with the tokens on which it differs from the rest.
Tokens are emitted as soon as all guesses agree, after a lookahead of at most about one longest
token. Steps are kept once computed; the table is emptied when it has ``MAX_STEPS`` of them, which
changes no result. Memory does not depend on the texts.

The vocabulary file is read in each Python worker, from its path there. A worker keeps the tables
from task to task, until it gets a task of another operator.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.arrays import held, slices

MAX_STEPS, MAX_PIECES, MAX_PAIRS, BLOCK = 250_000, 250_000, 200_000, 8192
FEW_TOKENS, LONG_TEXT = 12, 1 << 20
#: Instead of the token before: there is none, any token may follow, no longer token fits.
START, ANY, NONE = -1, -2, -3
#: The version of marshal that writes equal values as equal bytes.
PLAIN = 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes one piece of text at a time; states and steps are shared by all pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at = [-1]  # by node
        nodes = 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = nodes
                    nodes += 1
                    self.token_at.append(-1)
            self.token_at[node] = rank
        # The tokens that are longer than a node, for nodes with few of them.
        self.longer: list[list[int] | None] = [[] for _ in range(nodes)]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                tokens = self.longer[node]
                if tokens is not None:
                    tokens.append(rank)
                    if len(tokens) > FEW_TOKENS:
                        self.longer[node] = None
                node = self.child[node << 8 | byte]
        # Most nodes have none: they share one list.
        none: list[int] = []
        self.longer = [none if tokens == [] else tokens for tokens in self.longer]
        self.hopes: dict[int, int] = {}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.bytes_of}
        self.pairs: dict[int, bool] = {}
        self.wholes: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self._forget()

    def _forget(self) -> None:
        # A guess is (token before, trie node, tokens not yet emitted).
        # States are kept as bytes, which are smaller than tuples of tuples.
        start = marshal.dumps(((START, 0, ()),), PLAIN)
        self.numbers = {start: 0}
        self.states = [start]
        self.steps: dict[int, tuple[int, bytes]] = {}

    def merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain BPE of a few bytes by ranks under ``below``: the neighbours of least rank first,
        the left ones of equals."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts of a token at its right or left end, from the token down to one byte, each
        with its own rank and that of the part it is merged into."""
        spine, above = [], 1 << 60
        data, rank = self.bytes_of[token], token
        while True:
            spine.append((data, rank if len(data) > 1 else -1, above))
            if len(data) == 1:
                return spine
            parts, above = self.merged(data, rank), rank
            data = parts[-1] if right else parts[0]
            rank = self.ranks[data]

    def fits(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both tokens gives both tokens again.

        It does unless an end part of the first and a start part of the second one, both there
        at one time, are merged before either is merged into the rest of its token.
        """
        if before <= START:
            return before == ANY or self.whole(token)
        found = self.pairs.get(before << 20 | token)
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            found = self.whole(token)
            if found:
                ends, starts = self.spines[0].get(before), self.spines[1].get(token)
                if ends is None:
                    ends = self.spines[0][before] = self._spine(before, True)
                if starts is None:
                    starts = self.spines[1][token] = self._spine(token, False)
                for x, x_rank, x_above in ends:
                    for y, y_rank, y_above in starts:
                        if x_rank < y_above and y_rank < x_above:
                            rank = self.ranks.get(x + y)
                            if rank is not None and rank < x_above and rank <= y_above:
                                found = False
            self.pairs[before << 20 | token] = found
        return found

    def hope(self, before: int, node: int) -> int:
        """The token before, ANY if every longer token fits it, NONE if none does."""
        tokens = self.longer[node]
        if tokens is None:
            return before
        found = self.hopes.get(before << 20 | node)
        if found is None:
            if len(self.hopes) > MAX_PAIRS:
                self.hopes.clear()
            good = sum(self.fits(before, token) for token in tokens)
            found = NONE if not good else ANY if good == len(tokens) else before
            self.hopes[before << 20 | node] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether merging the bytes of a token gives the token."""
        found = self.wholes.get(token)
        if found is None:
            data = self.bytes_of[token]
            found = self.wholes[token] = self.merged(data) == [data]
        return found

    def _step(self, number: int, byte: int) -> tuple[int, bytes]:
        """The next state, and the tokens on which all of its guesses agree."""
        alive, child, token_at, pairs, longer = [], self.child, self.token_at, self.pairs, self.longer
        for before, node, tokens in marshal.loads(self.states[number]):
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0:
                good = pairs.get(before << 20 | token)
                if self.fits(before, token) if good is None else good:
                    alive.append((token, 0, (*tokens, token)))
            hope = before if before == ANY and longer[node] != [] else self.hope(before, node)
            if hope != NONE:
                alive.append((hope, node, tokens))
        first, agreed = alive[0][2], b""
        while first:
            token = first[0]
            for _, _, t in alive:
                if not t or t[0] != token:
                    break
            else:
                agreed += self.packed[token]
                alive = [(before, node, t[1:]) for before, node, t in alive]
                first = alive[0][2]
                continue
            break
        state = marshal.dumps(tuple(alive), PLAIN)
        following = self.numbers.get(state)
        if following is None:
            following = self.numbers[state] = len(self.states)
            self.states.append(state)
        result = self.steps[number << 8 | byte] = following, agreed
        return result

    def encode(self, piece: bytes) -> bytes:
        """The ids of a piece as little-endian 32-bit numbers."""
        if len(self.steps) > MAX_STEPS:
            self._forget()
        out, number, steps = [], 0, self.steps
        for count, byte in enumerate(piece):
            found = steps.get(number << 8 | byte)
            if found is None:
                if count & 0xFFFF == 0xFFFF and len(steps) > MAX_STEPS:
                    state = self.states[number]
                    self._forget()
                    steps, number = self.steps, self.numbers.setdefault(state, len(self.states))
                    if number == len(self.states):
                        self.states.append(state)
                found = self._step(number, byte)
            number, agreed = found
            if agreed:
                out.append(agreed)
        # At the end of the piece the guess that has just finished a token is the right one.
        for _, node, tokens in marshal.loads(self.states[number]):
            if node == 0:
                out.extend([self.packed[t] for t in tokens])
                break
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cuts, gives the characters that are complete."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        # A character may be open at the end: its first byte and the number of bytes it needs.
        end = len(data)
        for back in range(1, min(4, end) + 1):
            byte = data[end - back]
            if byte & 0xC0 != 0x80:
                needs = 1 if byte < 0x80 else 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4
                if needs > back:
                    end -= back
                break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Tokenizer:
    """Splits by a pattern, encodes each match; decodes ids in blocks."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        size = max(self.machine.bytes_of) + 1
        self.table = [self.machine.bytes_of.get(i, b"") for i in range(size)]

    def _ids(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.machine.encode(piece.encode())
            if len(piece) <= 64:
                if len(self.known) >= MAX_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers."""
        known, ids = self.known, self._ids
        if len(text) <= LONG_TEXT:
            return b"".join([known.get(p) or ids(p) for p in self.pattern.findall(text)])
        # The matches of a long text are not all held at once.
        matches, parts = self.pattern.finditer(text), []
        while block := [m[0] for m in islice(matches, BLOCK)]:
            parts.append(b"".join([known.get(p) or ids(p) for p in block]))
        return b"".join(parts)

    def decode(self, ids: bytes):
        """Blocks of (bytes, characters) of an encoded text."""
        numbers, stream, table = np.frombuffer(ids, "<u4"), Utf8Stream(), self.table
        for at in range(0, len(numbers), BLOCK):
            data = b"".join(map(table.__getitem__, numbers[at:at + BLOCK].tolist()))
            yield data, stream.feed(data)
        yield b"", stream.finish()


def _encoded(path: str, pattern: str, names: list[str]):
    key = "tokenizer", path, pattern

    def run(batches):
        own = held(key, lambda: Tokenizer(path, pattern))
        for batch, _, rows in slices(batches, keep=key):
            cells: list[tuple] = []
            for text in rows:
                ids = own.encode(text.decode("utf-8", "replace"))
                digest, parts = hashlib.sha256(), []
                for data, characters in own.decode(ids):
                    digest.update(data)
                    parts.append(characters)
                cells.append((ids, "".join(parts), len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest()))
            made = {"ids": pa.binary(), "decoded": pa.string(), "n_tokens": pa.int64(),
                    "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            columns = dict(zip(made, map(list, zip(*cells, strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(columns[n], made[n]) for n in names]], ["doc_id", *names])

    return run


TYPES = {"ids": "binary", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """doc_id and the named columns for each row: ids (little-endian 32-bit numbers), decoded
    (the text that the ids give), n_tokens and digests. A null text counts as empty and has no
    tokens. Map-side only; rows are not compared, so repeated ids and rows stay as they are."""
    shown = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = shown.select("doc_id").schema
    for name in columns:
        schema = schema.add(name, TYPES[name])
    return shown.mapInArrow(_encoded(path, pattern, list(columns)), schema)
