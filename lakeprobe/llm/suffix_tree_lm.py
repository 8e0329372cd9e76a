"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are lower-cased words, then one end for each text. A sequence of tokens is known
by a 64-bit hash. The tree's contexts are sequences of any length that the corpus
supports, up to DEPTH tokens (a text's beginning is a token of its own).

The tree grows from the root, whose distribution is the add-one one of single tokens.
At each length the sequences are counted whose parts matter: the context before the last
token is itself a sequence that was kept, so contexts grow along sequences that say more
than their parts; the ending without the first token occurs LEAST times at least, and is
not predicted so well yet that a longer context could not keep it. Then, with Spark joins over the table of sequences (context, ending, count):
* a token is kept after a context if its weighted divergence from what the longest
  shorter context in the tree predicts, n * log(p / shorter), is LEAST_ENTRY nats;
* a context stays if the kept tokens gain LEAST_GAIN nats more than the others lose;
* its distribution is its counts, smoothed with the shorter context's.
The bounds are absolute, whatever the size of the corpus: the tree grows with it, and
contexts get longer for as long as any of them may pay for itself.

Counts are summed up by tasks, go through Spark as one row for each range of keys (its
distinct keys and their counts as arrays), and are summed up again range by range.

A token is scored in its longest suffix state. Counts cover all training texts. Tables
of at most BOUND rows (frequent words, sequences that may matter, the tree) are broadcast
as sorted arrays, their size being checked. Of larger ones a sieve of bits is broadcast:
the sequences that pass are counted, and meet the table itself once they are known to be
frequent; in scoring, chunks of texts ask for the distinct sequences that pass, a task for
each range of keys answers from its slice of the tree, and the answers meet the chunk's
texts as a sorted array. Chunks go through this in ROUNDS turns, so that asks and answers
take little disk at a time; shuffled files are deleted once a table is written. Results
are the same.

Defined results:
* null text is the empty text: one token, the end;
* null ids are never held out; repeated rows get equal scores; other columns do not
  matter; an empty table gives an empty result;
* without any training text each token has the probability 1, and N and V are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm import common
from lakeprobe.llm.common import bounded_batches, discard, join_groups, partitions, release, text_of, tidied

#: Tokens of a context at most.
DEPTH = 6
#: Occurrences of a context, and of a token after it, at least, in a corpus of any size.
LEAST = 5
#: Weighted divergence (nats) that keeps a token after a context, and that keeps a context.
LEAST_ENTRY, LEAST_GAIN = 4.0, 10.0
#: Weight of the shorter context's distribution in the smoothing.
SMOOTHING = 4.0
#: Rows of a table that is broadcast at most (some 30 bytes each).
BOUND = 1_500_000
#: Turns in which sequences are counted that pass sieves, each for its part of the keys.
TURNS = 2
#: Rows of a slice of a larger table, about; tokens of a chunk of texts that asks for its rows at once; turns of the chunks at most, and tokens of a turn at least.
SLICED, CHUNK, ROUNDS, ROUND = 500_000, 6_000_000, 4, 30_000_000
#: Bits of a sieve at least and at most, and of a part of one, as powers of two.
SIEVE, PART = (24, 28), 20
#: Tokens held by a task before their counts are handed on.
FLUSH = 2_000_000
#: Bytes of texts that are split into words side by side; longest word, in bytes, that is hashed beside others.
SPLIT, LONG = 4_000_000, 128
#: Texts that are looked at side by side.
SLICE = 200
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
#: What undoes a multiplication by FACTOR and by MIX; the bytes of a word's last piece, by their number.
INVERSE, UNMIX = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (FACTOR, MIX))
PIECE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The hashes of a text's beginning and end.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """common.written(), after which Spark deletes the shuffled files that only this table needed: else they stay until the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return common.written(df, name, compression)
    finally:
        conf.set(key, before)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def joined(context: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """The hash of a sequence, from those of the sequence without its last token and without its first."""
    x = context * FACTOR + ending
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def ending_of(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The hash of the sequence without its first token, from joined(context, ending) and the context."""
    x = (key ^ (key >> np.uint64(29)) ^ (key >> np.uint64(58))) * UNMIX
    return (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) - context * FACTOR


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts in UTF-8, A to Z lower-cased, and the place of each text's first word among them, with one more for the end.

    Bytes split at ASCII white space only, and know no other cases. A word's length is
    mixed with its pieces of 8 bytes, all words at a time.
    """
    import xxhash

    data = (b" " + b" ".join(texts) + b" " * 8).lower()
    letters = np.frombuffer(data, np.uint8)
    space = (letters == 32) | (letters - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    pieces = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = joined(size.astype(np.uint64), pieces[start] & PIECE[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    for k in range(8, LONG, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        h[more] = joined(h[more], pieces[start[more] + k] & PIECE[np.minimum(size[more] - k, 8)])
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return h, np.searchsorted(start, np.cumsum([1, *(len(x) + 1 for x in texts)]))


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as the hashes of its words, 8 bytes each."""
    for b in batches:
        texts = b.column("text").to_pylist()
        group = np.cumsum([0, *map(len, texts)])[:-1] // SPLIT
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for i, j in pairwise(edges):
            h, first = hashed(texts[i:j])
            words = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(h)])
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), words], ["doc_id", "held_out", "words"])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as coded() gives them, with the number of the task's chunk of some CHUNK tokens that they are in."""
    total = 0
    for b in coded(batches):
        if b.num_rows:
            ends = total + np.cumsum(pc.binary_length(b.column("words")).to_numpy().astype(np.int64) // 8 + 1)
            total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends // CHUNK)], [*b.schema.names, "chunk"])


class Texts:
    """The token hashes of several texts in a row: a beginning, the words and an end for each."""

    def __init__(self, blobs: list[bytes]):
        words = [np.frombuffer(b, np.uint64) for b in blobs]
        size = np.array([len(w) + 2 for w in words], np.int64)
        start = np.cumsum(size) - size
        h = np.empty(int(size.sum()), np.uint64)
        h[start] = BEGIN
        h[start + size - 1] = END
        for w, a in zip(words, start.tolist(), strict=True):
            h[a + 1 : a + 1 + len(w)] = w
        self.start, self.size = start, size
        #: Tokens before each one in its text, the beginning included.
        self.place = np.arange(len(h)) - np.repeat(start, size)
        self._level = [h]

    @cached_property
    def _kinds(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self._level[0], return_inverse=True)

    @property
    def kinds(self) -> np.ndarray:
        """The distinct tokens."""
        return self._kinds[0]

    @property
    def kind(self) -> np.ndarray:
        """The place of each token among the distinct ones."""
        return self._kinds[1]

    def endings(self, length: int) -> np.ndarray:
        """At each position the hash of the sequence of so many tokens that ends there; where fewer stand before it in the text, nothing of use."""
        while len(self._level) < length:
            q = self._level[-1]
            self._level.append(joined(np.concatenate([q[:1], q[:-1]]), q))
        return self._level[length - 1]


class Table:
    """Values by key: sorted arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]
        self._part: dict[int, tuple[Table, np.ndarray]] = {}
        self._first: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_part": {}, "_first": None}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them are there. The upper bits of a key, some more than tell the table's keys apart, give the few places where it may be."""
        at, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not len(self.keys):
            return at, there
        bits = len(self.keys).bit_length() + 1
        shift = np.uint64(64 - bits)
        if self._first is None:
            self._first = np.zeros((1 << bits) + 1, np.int32)
            np.cumsum(np.bincount((self.keys >> shift).astype(np.int64), minlength=1 << bits), out=self._first[1:])
        part = (keys >> shift).astype(np.int64)
        spot, end = self._first[part], self._first[part + 1]
        maybe = np.flatnonzero(spot < end)
        spot, end = spot[maybe], end[maybe]
        while len(maybe):
            hit = self.keys[spot] == keys[maybe]
            at[maybe[hit]], there[maybe[hit]] = spot[hit], True
            more = ~hit & (spot + 1 < end)
            maybe, spot, end = maybe[more], spot[more] + 1, end[more]
        return at, there

    def where(self, column: int) -> tuple[Table, np.ndarray]:
        """The rows with a positive value in a column, as a smaller table, and their places in this one; made once."""
        if column not in self._part:
            index = np.flatnonzero(self.values[column] > 0)
            self._part[column] = (Table(self.keys[index]), index)
        return self._part[column]


PACKED = "part int, keys binary, times binary"
PACKED_PAIRS = f"{PACKED}, contexts binary"


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values between each two edges as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def packed(parts: int) -> Callable[[list[list[np.ndarray]]], Iterator[pa.RecordBatch]]:
    """A function that gives one row (part, keys, times) for each of so many ranges of the keys: its distinct keys in order, mixed by FACTOR, and the number of each; if contexts are held beside the keys, they are the fourth column."""
    ranges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, *more = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        key *= FACTOR
        if more:
            order = np.argsort(key)
            key = key[order]
        else:
            key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.append(at, len(key))).astype(np.int32), key[at]
        more = [c[order[at]] for c in more]
        edges = np.concatenate([[0], np.searchsorted(key, ranges), [len(key)]])
        names = ["part", "keys", "times", "contexts"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *(binaries(v, edges) for v in (key, n, *more))], names[: 3 + len(more)])

    return run


def totals(rows: DataFrame, parts: int, enough: int, shape: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """shape(keys, n), or shape(keys, n, contexts), of the keys in packed rows that occur often enough, each range of keys being summed up in a task of its own."""
    kinds = {"keys": np.uint64, "times": np.int32} | ({"contexts": np.uint64} if "contexts" in rows.columns else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.frombuffer(x, kind) for x in b.column(c).to_pylist()] for b in batches for c, kind in kinds.items()]
        if not sum(map(len, (x for c in held for x in c))):
            return
        key, n, *more = (np.concatenate([x for c in held[i :: len(kinds)] for x in c]) for i in range(len(kinds)))
        del held
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, at, dtype=np.int64)
        often = n >= enough
        at, n = at[often], n[often]
        key, more = key[at] * INVERSE, [c[order[at]] for c in more]
        for i in range(0, len(key), 500_000):
            yield shape(*(c[i : i + 500_000] for c in (key, n, *more)))

    return rows.repartitionById(parts, F.col("part")).mapInArrow(tidied(run), schema)


def as_counts(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (key, n)."""
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def as_pairs(key: np.ndarray, n: np.ndarray, context: np.ndarray) -> pa.RecordBatch:
    """Rows (key, context, ending, n)."""
    return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, context, ending_of(key, context))), pa.array(n)], ["key", "context", "ending", "n"])


def counted(make: Callable[[Texts, pa.RecordBatch], list[np.ndarray]], hand: Callable[[list[list[np.ndarray]]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that hands the key columns that make(texts, batch) gives over a task to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                held.append(make(Texts(part.column("words").to_pylist()), part))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield from hand(held)
                    held, size = [], 0
        if held:
            yield from hand(held)

    return run


class Sieve:
    """Which keys a larger table may hold, for tasks: a bit for each upper part of a key and for each lower part, made part by part. It lets all keys of the table pass, and few others."""

    def __init__(self, keys: DataFrame, rows: int):
        self.bits = bits = min(max(rows.bit_length() + 4, SIEVE[0]), SIEVE[1])

        def marked(group: pa.Table) -> pa.Table:
            bit = np.zeros(1 << PART, bool)
            bit[group.column("bit").to_numpy() & ((1 << PART) - 1)] = True
            return pa.table({"part": group.column("part").slice(0, 1), "bits": [np.packbits(bit, bitorder="little").tobytes()]})

        both = keys.select(F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1))).alias("bit"))
        parts = both.select(F.shiftright("bit", PART).alias("part"), "bit").groupBy("part").applyInArrow(marked, "part long, bits binary")
        whole = np.zeros((1 << bits) // 8, np.uint8)
        for r in parts.toLocalIterator():
            at = r["part"] << PART - 3
            whole[at : at + (1 << PART - 3)] = np.frombuffer(r["bits"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(whole)

    def may(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the table."""
        whole = self.shared.value
        look = lambda bit: (whole[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        out = look(keys >> np.uint64(64 - self.bits))
        some = np.flatnonzero(out)
        out[some] = look(keys[some] & np.uint64((1 << self.bits) - 1))
        return out

    def forget(self) -> None:
        """Take the bits back; nothing may read them any more."""
        self.shared.destroy()


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """The ranges of rows in which no column changes."""
    new = [c[1:] != c[:-1] for c in columns]
    return pairwise([0, *(np.flatnonzero(np.logical_or.reduce(new)) + 1).tolist(), len(columns[0])])


class Lookup:
    """A table (key, values) for tasks: broadcast if it has at most BOUND rows, else asked by chunks of texts for what passes its sieves."""

    def __init__(self, table: DataFrame, names: list[str]):
        self.table, self.names = table, names
        self.rows = table.count()
        self.small = self.rows <= BOUND
        if self.small:
            rows = table.select("key", *names).toArrow()
            local = Table(rows.column("key").to_numpy().view(np.uint64), *(rows.column(c).to_numpy() for c in names))
            del rows
            self.shared = table.sparkSession.sparkContext.broadcast(local)
            del local
            release()

    def forget(self) -> None:
        """Take the broadcast table back; nothing may read it any more."""
        if self.small:
            self.shared.destroy()

    def __getstate__(self):
        return self.__dict__ | {"table": None, "slices": None}

    @cached_property
    def slices(self) -> DataFrame:
        """Written rows (part, keys, values...) of a larger table: a row for each range of its keys."""
        bits, names = max(4, (self.rows // SLICED).bit_length()), self.names

        def sliced(group: pa.Table) -> pa.Table:
            order = np.argsort(group.column("key").to_numpy().view(np.uint64))
            return pa.table({"part": group.column("part").slice(0, 1)} | {c: [group.column(c).to_numpy()[order].tobytes()] for c in ("key", *names)})

        rows = self.table.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("part"), "key", *(F.col(c).cast("double").alias(c) for c in names))
        self.parts = 1 << bits
        return written(rows.groupBy("part").applyInArrow(sliced, f"part int, key binary, {', '.join(f'{c} binary' for c in names)}"), "slices")

    def found(self, texts: DataFrame, wanted: Callable[[Texts], list[np.ndarray]]) -> DataFrame:
        """Rows (chunk, key, values...), each column as bytes: what a larger table has of the keys that wanted() gives for the texts (chunk, words) of a chunk, a row for each range of keys."""
        slices, parts, names = self.slices, self.parts, self.names
        ranges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, size = None, [], 0

            def hand() -> Iterator[pa.RecordBatch]:
                key = np.unique(np.concatenate(held))
                edges = np.concatenate([[0], np.searchsorted(key, ranges), [len(key)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, now)), binaries(key, edges)], ["part", "chunk", "key"])

            for b in batches:
                for start in range(0, b.num_rows, SLICE):
                    some = b.slice(start, SLICE)
                    chunk = some.column("chunk").to_numpy()
                    for i, j in runs(chunk):
                        if held and chunk[i] != now:
                            yield from hand()
                            held, size = [], 0
                        now = chunk[i]
                        held.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *wanted(Texts(some.column("words").slice(i, j - i).to_pylist()))])))
                        size += len(held[-1])
                        if size > FLUSH:  # texts have many sequences in common
                            held = [np.unique(np.concatenate(held))]
                            size = len(held[0]) // 2
            if held:
                yield from hand()

        def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, part = None, None
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if r["chunk"] is None:
                        table, part = Table(np.frombuffer(r["key"], np.uint64), *(np.frombuffer(r[c]) for c in names)), r["part"]
                    elif r["part"] == part and r["key"]:
                        key = np.frombuffer(r["key"], np.uint64)
                        at, there = table.find(key)
                        if there.any():
                            out.append((r["chunk"], key[there].tobytes(), *(v[at[there]].tobytes() for v in table.values)))
                columns = list(zip(*out, strict=True)) or [()] * (2 + len(names))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["chunk", "key", *names])

        asks = texts.select("chunk", "words").mapInArrow(tidied(asked), "part int, chunk long, key binary")
        both = slices.select("part", F.lit(None).cast("long").alias("chunk"), "key", *names).unionByName(asks, allowMissingColumns=True)
        both = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("chunk").asc_nulls_first())
        return both.mapInArrow(tidied(answered), f"chunk long, key binary, {', '.join(f'{c} binary' for c in names)}")

    def beside(self, texts: DataFrame, wanted: Callable[[Texts], list[np.ndarray]]) -> DataFrame:
        """Texts with what their chunk has found, before them, for tables()."""
        found = self.found(texts, wanted).withColumn("kind", F.lit(0))
        both = texts.withColumn("kind", F.lit(1)).unionByName(found, allowMissingColumns=True)
        return both.repartition(partitions(texts.sparkSession), "chunk").sortWithinPartitions("chunk", "kind")

    def tables(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Table]]:
        """Batches of texts, and the table for each."""
        if self.small:
            for b in batches:
                yield b, self.shared.value
            return
        now, held, table = None, [], None
        for b in batches:
            chunk, kind = b.column("chunk").to_numpy(), b.column("kind").to_numpy()
            for i, j in runs(chunk, kind) if b.num_rows else ():
                if chunk[i] != now:
                    now, held, table = chunk[i], [], None
                some = b.slice(i, j - i)
                if kind[i] == 0:
                    held.append([b"".join(some.column(c).to_pylist()) for c in ("key", *self.names)])
                    continue
                if table is None:
                    keys, *values = (b"".join(x) for x in zip(*held, strict=True)) if held else [b""] * (1 + len(self.names))
                    held = []
                    table = Table(*unrepeated(np.frombuffer(keys, np.uint64), *map(np.frombuffer, values)))
                    del keys, values
                yield some, table

    def attach(self, docs: DataFrame, lengths: range) -> DataFrame:
        """docs (row, words), with the rows of a larger table that the sequences of each have."""
        sieve, names = Sieve(self.table.select("key"), self.rows), self.names

        def wanted(t: Texts) -> list[np.ndarray]:
            every = np.concatenate([t.endings(m)[t.place >= m - 1] for m in lengths])
            return [every[sieve.may(every)]]

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    key = np.frombuffer(r["key"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), r["chunk"])), pa.array(key), *(pa.array(np.frombuffer(r[c])) for c in names)], ["row", "key", *names])

        found = self.found(docs.select(F.col("row").alias("chunk"), "words"), wanted)
        found = found.mapInArrow(opened, f"row long, key long, {', '.join(f'{c} double' for c in names)}")
        return docs.join(found.groupBy("row").agg(F.collect_list(F.struct("key", *names)).alias("known")), "row", "left")


def unrepeated(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Rows by key, each key once: a chunk that two tasks read has asked twice."""
    keys, first = np.unique(keys, return_index=True)
    return [keys, *(v[first] for v in values)]


def words_of(t: Texts, batch: pa.RecordBatch) -> list[np.ndarray]:
    """The words and ends of texts."""
    return [t.endings(1)[t.place > 0]]


def sequences(alive: Lookup, length: int) -> Callable[[Texts, pa.RecordBatch], list[np.ndarray]]:
    """The sequences of so many tokens whose context is kept and whose ending has room: the rows of both in the table, which is broadcast, as one number."""

    def make(t: Texts, batch: pa.RecordBatch) -> list[np.ndarray]:
        known, q = alive.shared.value, t.endings(length - 1)
        contexts, index = known.where(KEPT)
        at = np.flatnonzero(t.place >= length - 1)
        if length == 2:  # words: each kind is looked up once
            before, there = contexts.find(t.kinds)
            at = at[there[t.kind[at - 1]]]
            context = index[before[t.kind[at - 1]]] if len(index) else at[:0]
            spot, there = known.find(t.kinds)
            ending, there = spot[t.kind[at]], there[t.kind[at]]
        else:
            before, there = contexts.find(q[at - 1])
            at, context = at[there], index[before[there]] if len(index) else at[:0]
            ending, there = known.find(q[at])
        context, ending = context[there], ending[there]
        room = known.values[ROOM][ending] > 0 if len(known.keys) else there[:0]
        return [(context[room].astype(np.uint64) << np.uint64(32)) | ending[room].astype(np.uint64)]

    return make


def sieved(contexts: Sieve, endings: Sieve, length: int, turn: int) -> Callable[[Texts, pa.RecordBatch], list[np.ndarray]]:
    """A turn's sequences of so many tokens whose context and ending may be in larger tables: the hashes of the sequence and of the context."""

    def make(t: Texts, batch: pa.RecordBatch) -> list[np.ndarray]:
        q = t.endings(length - 1)
        at = np.flatnonzero(t.place >= length - 1)
        at = at[contexts.may(q[at - 1])]
        key = joined(q[at - 1], q[at])
        own = key % np.uint64(TURNS) == turn
        at, key = at[own], key[own]
        there = endings.may(q[at])
        return [key[there], q[at - 1][there]]

    return make


#: Of the sequences of a level: count, prediction, whether they are kept (and so contexts of the next level), and whether they are endings of it.
ALIVE = ["n", "p", "kept", "room"]
KEPT, ROOM = 2, 3
ENTRIES = "key long, ending long, context long, n long, total double, shorter double"


def counted_sequences(training: DataFrame, level: DataFrame, alive: Lookup, length: int, total: int) -> DataFrame:
    """Written rows (key, ending, context, n, total, shorter) of the sequences of so many tokens that occur often enough in a corpus of total tokens: total is the context's count, shorter what the tree predicts after the ending's context."""
    parts = max(partitions(training.sparkSession), total // FLUSH)
    if alive.small:

        def read(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            table = alive.shared.value
            a, e = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
            columns = (joined(table.keys[a], table.keys[e]).view(np.int64), table.keys[e].view(np.int64), table.keys[a].view(np.int64), n, table.values[0][a].astype(np.float64), table.values[1][e])
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["key", "ending", "context", "n", "total", "shorter"])

        counts = training.mapInArrow(tidied(counted(sequences(alive, length), packed(parts))), PACKED)
        out = written(totals(counts, parts, LEAST, read, ENTRIES), f"sequences-{length}")
        alive.forget()
        return out

    # what the sieves let pass in error ends at the joins
    contexts, endings = level.filter("kept"), level.filter("room")
    both = Sieve(contexts.select("key"), alive.rows), Sieve(endings.select("key"), alive.rows)
    turns = []
    for turn in range(TURNS):  # what is shuffled is there for one turn only
        rows = training.mapInArrow(tidied(counted(sieved(*both, length, turn), packed(parts))), PACKED_PAIRS)
        turns.append(written(totals(rows, parts, LEAST, as_pairs, "key long, context long, ending long, n long"), f"pairs-{length}"))
    pairs = reduce(DataFrame.unionByName, turns)
    pairs = pairs.join(contexts.select(F.col("key").alias("context"), F.col("n").cast("double").alias("total")), "context")
    pairs = pairs.join(endings.select(F.col("key").alias("ending"), F.col("p").cast("double").alias("shorter")), "ending")
    out = written(pairs.select("key", "ending", "context", "n", "total", "shorter"), f"sequences-{length}")
    for sieve in both:
        sieve.forget()
    for gone in turns:
        discard(gone)
    return out


def kept() -> Column:
    """Whether a token's weighted divergence from what the tree predicts so far is large enough."""
    return F.col("n") * F.log(F.col("n") / F.col("total") / F.col("shorter")) >= LEAST_ENTRY


def grow(entries: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """One length of the tree: written entries (key, ending, n) with p, what the tree predicts now, and own, p if the entry is kept; and written contexts (context, back) that stay.

    A context with many entries is summed up where they are, and its join is one that Spark can split.
    """
    own = F.col("n") / (F.col("total") + SMOOTHING) + F.col("back") * F.col("shorter")
    chosen = entries.filter(kept())
    mass = chosen.groupBy("context").agg(F.first("total").alias("all"), F.sum("n").alias("mass"), F.count(F.lit(1)).alias("kept"))
    mass = written(mass.withColumn("back", 1 - F.col("mass") / (F.col("all") + SMOOTHING)), f"mass-{length}")
    # contexts with many entries meet their sums by broadcast, so the gain is summed up where the entries are
    tried = join_groups(chosen, mass, "context", "kept", entries.count())
    gain = tried.groupBy("context").agg(
        F.sum(F.col("n") * F.log(own / F.col("shorter"))).alias("gain"), F.first("back").alias("back"), F.first((F.col("all") - F.col("mass")) * F.log("back")).alias("loss")
    )
    stays = written(gain.filter(F.col("gain") + F.col("loss") >= LEAST_GAIN).select("context", "back"), f"contexts-{length}")
    discard(mass)
    out = entries.join(stays, "context", "left").withColumn("own", F.when(F.col("back").isNotNull() & kept(), own))
    p = F.coalesce("own", F.col("shorter") * F.coalesce("back", F.lit(1.0)))
    return written(out.select("key", "ending", "n", p.alias("p"), "own"), f"length-{length}"), stays


def tree(training: DataFrame, words: DataFrame, total: int, distinct: int, texts: int) -> tuple[DataFrame, int]:
    """Written rows (key, own, back) of the tree, and the length of its longest context.

    own is the log10 probability of a kept sequence's last token in its context; back,
    for the contexts and what they end with, the log10 factor that the shorter
    context's probabilities get. Both are NaN where there is none.
    """
    spark = training.sparkSession
    begin, end = (int(x.view(np.int64)) for x in (BEGIN, END))
    level = words.filter(F.col("n") >= LEAST).select("key", "n", ((F.col("n") + 1) / float(total + distinct + 1)).alias("p"))
    # the beginning is a context, but no next token
    if texts >= LEAST:
        level = level.unionByName(spark.range(1).select(F.lit(begin).alias("key"), F.lit(texts).cast("long").alias("n"), F.lit(1.0).alias("p")))
    owns, backs, endings, done = [], [], [], []
    for length in range(2, DEPTH + 2):
        room = F.col("n") * -F.log("p") >= LEAST_ENTRY
        kept_before = F.col("own").isNotNull() if length > 2 else F.col("key") != end
        level = level.select("key", "n", "p", kept_before.alias("kept"), room.alias("room"))
        alive = Lookup(level.select("key", F.col("n").cast("float").alias("n"), F.col("p").cast("double").alias("p"), F.col("kept").cast("byte").alias("kept"), F.col("room").cast("byte").alias("room")), ALIVE)
        entries = counted_sequences(training, level, alive, length, total)
        done.append(entries)
        if entries.isEmpty():
            break
        level, contexts = grow(entries, length)
        discard(done.pop())
        done += [level, contexts]
        owns.append(level.filter("own IS NOT NULL").select("key", F.log10("own").alias("own")))
        backs.append(contexts.select(F.col("context").alias("key"), F.log10("back").alias("back")))
        endings.append(level.select("key", "ending"))
    while backs and backs[-1].isEmpty():
        backs.pop()
    if not backs:
        for gone in done:
            discard(gone)
        return written(spark.createDataFrame([], "key long, own double, back double"), "tree"), 0
    # what a context ends with is a state on the way to it
    nodes = every = backs[-1]
    for i in range(len(backs) - 2, -1, -1):
        shorter = nodes.join(endings[i], "key").select(F.col("ending").alias("key")).distinct()
        nodes = backs[i].join(shorter, "key", "full").select("key", F.coalesce("back", F.lit(0.0)).alias("back"))
        every = every.unionByName(nodes)
    own = owns[0]
    for more in owns[1:]:
        own = own.unionByName(more)
    nan = F.lit(float("nan"))
    out = written(own.join(every, "key", "full").select("key", F.coalesce("own", nan).alias("own"), F.coalesce("back", nan).alias("back")), "tree")
    for gone in done:
        discard(gone)
    return out, len(backs)


def states(t: Texts, table: Table, depth: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token in its longest suffix state, and whether the root's is part of it.

    root: log10 probabilities of the tokens at the root.
    """
    out, rooted = root.copy(), np.ones(len(root), bool)
    at = np.flatnonzero(t.place > 0)
    for length in range(1, depth + 1):
        at = at[t.place[at] >= length]
        if length == 1:
            spot, there = table.find(t.kinds)
            back = np.where(there, table.values[1][spot] if len(table.keys) else np.nan, np.nan)[t.kind[at - 1]]
        else:
            spot, there = table.find(t.endings(length)[at - 1])
            back = np.where(there, table.values[1][spot] if len(table.keys) else np.nan, np.nan)
        inside = ~np.isnan(back)
        at, back = at[inside], back[inside]
        if not len(at):
            break
        spot, there = table.find(t.endings(length + 1)[at])
        own = np.where(there, table.values[0][spot], np.nan)
        hit = ~np.isnan(own)
        out[at] = np.where(hit, own, out[at] + back)
        rooted[at] &= ~hit
    return out, rooted


def needed(owns: Sieve, backs: Sieve, depth: int) -> Callable[[Texts], list[np.ndarray]]:
    """What states() may look up in a larger tree: the keys that pass the sieves of its entries and of its contexts."""

    def wanted(t: Texts) -> list[np.ndarray]:
        keys = []
        at = np.flatnonzero(t.place > 0)
        for length in range(1, depth + 1):
            at = at[t.place[at] >= length]
            context = t.endings(length)[at - 1]
            if length == 1:
                inside = backs.may(t.kinds)[t.kind[at - 1]]
            else:
                inside = backs.may(context)
            at, context = at[inside], context[inside]
            own = t.endings(length + 1)[at]
            keys += [context, own[owns.may(own)]]
        return keys

    return wanted


OUT = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, others array<long>, times array<long>, rooted array<long>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its token counts, base score and the tree's log10 probability."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"), held_out(id_col).alias("held_out"))
    rows = rows.mapInArrow(tidied(chunked), "doc_id long, held_out boolean, words binary, chunk long").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("chunk", F.spark_partition_id().cast("long") * (1 << 32) + F.col("chunk")), "coded", "zstd")
    training = rows.filter(~F.col("held_out"))
    parts = partitions(spark)
    words = written(totals(training.mapInArrow(tidied(counted(words_of, packed(parts))), PACKED), parts, 1, as_counts, "key long, n long"), "words")
    total, distinct, texts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key") == int(END.view(np.int64)), F.col("n"))), F.lit(0))).first()
    found, depth = tree(training, words, total, distinct, texts)
    known = Lookup(found, ["own", "back"])
    # the most frequent words, at most BOUND, are broadcast; the others of each text are joined with the table of words
    bounds = [LEAST << k for k in range(50)]
    sizes = words.agg(*(F.count_if(F.col("n") >= n).alias(f"n{n}") for n in bounds)).first()
    frequent = words.filter(F.col("n") >= next(n for n, size in zip(bounds, sizes, strict=True) if size <= BOUND))
    counts = Lookup(frequent.select("key", F.log10(F.col("n") + 1).alias("log")), ["log"])
    unit = math.log10(total + distinct + 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores without the counts of the words that were not broadcast, and those words: how often in all, and where the root's probability counts."""
        frequent = counts.shared.value
        for whole, table in known.tables(batches):
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                t = Texts(b.column("words").to_pylist())
                spot, there = frequent.find(t.kinds)
                log = np.where(there, frequent.values[0][spot] if there.any() else 0.0, 0.0)[t.kind]
                hot = there[t.kind]
                root = log - unit
                each, rooted = states(t, table, depth, root)
                inner = t.place > 0
                sums = [np.add.reduceat(np.where(inner, v, 0), t.start) for v in (hot, root, each)]
                rest = np.flatnonzero(inner & ~hot)
                doc = np.repeat(np.arange(len(t.start)), t.size)[rest]
                order = np.lexsort((t.kind[rest], doc))
                rest, doc = rest[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (t.kind[rest][1:] != t.kind[rest][:-1])])) if len(rest) else rest
                times = np.diff(np.append(new, len(rest)))
                at_root = np.add.reduceat(rooted[rest].astype(np.int64), new) if len(rest) else times
                ends = np.searchsorted(doc[new], np.arange(len(t.start) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (t.endings(1)[rest[new]].view(np.int64), times.astype(np.int64), at_root)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(t.size - 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *lists],
                    names=OUT.replace(",", " ").split()[::2],
                )

    if known.small:
        done = written(rows.mapInArrow(tidied(parts), OUT), "scored")
    else:
        sieves = [Sieve(found.filter(~F.isnan(c)).select("key"), known.rows) for c in ("own", "back")]
        size, last = rows.agg(F.sum(F.length("words")) / 8, F.max(F.shiftright("chunk", 32))).first()
        turns = max(1, min(ROUNDS, int(size // ROUND), last + 1))
        edges = [(last + 1) * k // turns for k in range(turns + 1)]
        scored = []
        for a, b in pairwise(edges):
            turn = rows.filter((F.col("chunk") >= a << 32) & (F.col("chunk") < b << 32))
            scored.append(written(known.beside(turn, needed(*sieves, depth)).mapInArrow(tidied(parts), OUT), "scored"))
        done = reduce(DataFrame.unionByName, scored)
        for sieve in sieves:
            sieve.forget()
        discard(known.slices)
    known.forget()
    counts.forget()
    for gone in (rows, found):
        discard(gone)
    others = done.select("row", F.explode(F.arrays_zip("others", "times", "rooted")).alias("x")).select("row", F.col("x.others").alias("key"), F.col("x.times").alias("k"), F.col("x.rooted").alias("r"))
    # a word without a training count has the factor 1: its row is not needed
    more = others.join(words, "key").groupBy("row").agg(
        F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("base_more"), F.sum(F.col("r") * F.log10(F.col("n") + 1)).alias("score_more")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return done.drop("others", "times", "rooted").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"), (F.col("score") + zero("score_more")).alias("score"),
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of all documents."""
    return score(docs)
