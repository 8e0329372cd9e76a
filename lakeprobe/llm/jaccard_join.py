"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; two are linked when the Jaccard similarity
of their sets is at least 0.8. Equal sets are one class from the start, so copies are
compared once.

Each run follows, for every set, one path of tokens sampled by minimum hashing: sets
that choose the same token fall into the same bucket; a bucket with more than LIMIT
sets is split on the next token of its run, and so on for DEPTH tokens; a bucket that
is still large then is dense, and is not split further. Small buckets are compared by
brute force on sketches (one byte of every sampled token); pairs that may be linked,
and the members of dense buckets, are put into one cluster. Runs are repeated until
a linked pair has met in a bucket with at least the target recall even where all of
its buckets are split DEPTH times. Half of the pairs that the recall lets go may be
lost so, half by the sketches: the runs, the number of sampled tokens (each run has
its own) and the least agreement of sketches follow from the threshold and the recall.

Clusters only say what is to be compared: inside each, the sets themselves are
compared exactly, in blocks of BLOCK sets if the cluster is larger, and each set's
links are counted where they are found; no pair is ever written out. Linked sets form
the classes (connected components).

Defined results:
* null text is the empty text; words are runs of other characters than ASCII white
  space; a text of fewer than five words is one shingle; texts without words are copies
  of one another, linked to nothing else; texts of any length are read whole;
* n_links counts the other rows with a similarity of at least the threshold, copies
  and repeated rows included; class_id is the smallest id of the class, rep_id that of
  the equal sets (null only where all of them are null);
* an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import components, field, join_groups, packed, text_of, unpacked, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Tokens of a path at most; sets compared by brute force at most.
DEPTH, LIMIT = 4, 512
#: Sets compared exactly in one task, and distinct words whose hashes a task remembers.
BLOCK, REMEMBERED = 1024, 2_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX = np.uint64(0x94D049BB133111EB)


def runs(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold, split at so many tokens, has met with the probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)) if threshold < 1 else 1


def least_agreement(tokens: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The largest number of tokens in which a pair at the threshold agrees with the probability `recall`."""
    missed = 0.0
    for k in range(tokens + 1):
        missed += math.comb(tokens, k) * threshold**k * (1 - threshold) ** (tokens - k)
        if missed > 1 - recall:
            return k
    return tokens


def effort(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Runs, sampled tokens of a set, and bytes in which two sketches must agree."""
    half = 1 - (1 - recall) / 2
    n_runs = runs(threshold, half)
    return n_runs, n_runs * DEPTH, least_agreement(n_runs * DEPTH, threshold, half)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of 64-bit shingle hashes; remembers the hashes of words it has seen."""

    def __init__(self, words: int = WORDS):
        self.n, self.known = words, {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(words)], dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = WORD.findall(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        for w in words:
            if w not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:  # the memory was cleared half way
            h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
        n = min(self.n, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = _mix(s + h[i : len(h) - n + 1 + i] * self.factors[i])
        return np.unique(s)


def multipliers(n_tokens: int) -> np.ndarray:
    """The factors of the hash functions that sample tokens."""
    return _mix(np.arange(1, n_tokens + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


def sampled(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The shingle with the smallest hash under each hash function, as that hash's upper half."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        z = shingles[None, i : i + 4096] * factors[:, None]
        out = np.minimum(out, _mix(z).min(axis=1))
    return (out >> np.uint64(32)).astype("<u4")


def describe(n_tokens: int):
    """Per document: a digest of its set, the set's size and the sampled tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, factors = Shingler(), multipliers(n_tokens)
        for b in batches:
            sig, size, tokens = [], [], []
            for t in b.column("text"):
                s = shingler(t.as_py())
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                size.append(len(s))
                tokens.append(sampled(s, factors).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sig, pa.binary()), pa.array(size, pa.int32()), pa.array(tokens, pa.binary())], ["doc_id", "key", "sig", "size", "tokens"])

    return run


def paths(n_runs: int, n_tokens: int):
    """Per set and run: the keys of the buckets on its path, one per depth, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), "<u4").reshape(n, n_tokens)
            sketch = tokens.astype(np.uint8)
            blobs = [x.tobytes() for x in sketch]
            for r in range(n_runs):
                key, keys = np.full(n, r + 1, np.uint64), []
                for d in range(DEPTH):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + tokens[:, r * DEPTH + d].astype(np.uint64))
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(blobs, pa.binary()), *map(pa.array, keys)], ["rep", "sketch", *(f"k{d}" for d in range(DEPTH))])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows sorted by keys."""
    current, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    """The smallest index of each index's connected component."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def near(n_tokens: int, least: int):
    """Edges that tie together the sets of a small bucket whose sketches agree in `least` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for _, rows in _grouped(batches, ["key"]):
            if len(rows) < 2:
                continue
            reps = [r["rep"] for r in rows]
            s = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), n_tokens)
            agree = np.zeros((len(rows), len(rows)), np.uint8 if n_tokens < 256 else np.uint16)
            for i in range(n_tokens):
                agree += s[:, i, None] == s[None, :, i]
            pairs = np.argwhere(np.triu(agree >= least, 1))
            for i, r in enumerate(_roots(len(rows), pairs)):
                if i != r:
                    u.append(reps[i])
                    v.append(reps[r])
            if len(u) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections."""
    n = len(sets)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(start, len(token)))
    out = np.zeros((n, n), np.int64)
    few = np.repeat((count > 1) & (count <= 8), count)
    t, o = token[few], owner[few]
    for gap in range(1, 8):
        same = t[gap:] == t[:-gap]
        out += np.bincount(o[:-gap][same] * n + o[gap:][same], minlength=n * n).reshape(n, n)
    out += out.T
    many = np.flatnonzero(count > 8)
    for i in range(0, len(many), 2048):
        block = many[i : i + 2048]
        dense = np.zeros((n, len(block)), np.float32)
        for j, k in enumerate(block):
            dense[owner[start[k] : start[k] + count[k]], j] = 1
        out += (dense @ dense.T).astype(np.int64)
    return out


def verify(threshold: float):
    """Count exact links inside each pair of blocks of a cluster, and give edges that span the linked sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for (_, a, b), rows in _grouped(batches, ["cluster", "a", "b"]):
            sets = [shingler(r["text"]) for r in rows]
            size = np.array([len(s) for s in sets])
            block = np.array([r["block"] for r in rows])
            copies = np.array([r["copies"] for r in rows])
            both = common_shingles(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if a != b:
                linked &= block[:, None] != block[None, :]
            reps = [r["rep"] for r in rows]
            roots = _roots(len(rows), np.argwhere(np.triu(linked)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array([reps[i] for i in roots], pa.int64()), pa.array(linked @ copies, pa.int64())], ["rep", "root", "links"]
            )

    return run


def clusters(reps: DataFrame, n_runs: int, n_tokens: int, least: int) -> DataFrame:
    """Rows (node, root): sets that must be compared have the same root; sets without a possible partner are left out."""
    total = reps.count() * n_runs
    left = reps.mapInArrow(paths(n_runs, n_tokens), "rep long, sketch binary, " + ", ".join(f"k{d} long" for d in range(DEPTH)))
    edges = None
    for d in range(DEPTH):
        at = written(left.withColumn("key", F.col(f"k{d}")), f"paths-{d}") if d else left.withColumn("key", F.col("k0"))
        sizes = at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # sets that chose a very frequent token meet its count by broadcast
        sized = written(join_groups(at, sizes, "key", "n", total), f"buckets-{d}")
        small = sized.filter(F.col("n") <= LIMIT).select("key", "rep", "sketch").repartition("key").sortWithinPartitions("key")
        found = small.mapInArrow(near(n_tokens, least), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        left = sized.filter(F.col("n") > LIMIT).drop("key", "n")
        if left.isEmpty():
            break
    else:  # dense buckets: tied to their smallest member, compared in blocks later
        dense = sized.filter(F.col("n") > LIMIT)
        first = dense.groupBy("key").agg(F.min("rep").alias("v"))
        edges = edges.unionByName(dense.join(first, "key").select(F.col("rep").alias("u"), "v"))
    return components(edges, "clusters")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, key): ids may be null or repeated, so rows are told apart by a hash of id and text."""
    key = F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), key.alias("key"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, key, sig), and a row for each distinct set: sig, rep_id, root (of its class), n_links, copies."""
    n_runs, n_tokens, least = effort(threshold, recall)
    source = _keyed(docs, id_col, text_col)
    rows = written(source.mapInArrow(describe(n_tokens), "doc_id long, key long, sig binary, size int, tokens binary"), "sets")
    reps = written(
        rows.groupBy("sig").agg(
            F.min("key").alias("rep"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("tokens").alias("tokens")
        ),
        "reps",
    )
    compared = reps.filter("size > 0")
    cluster = clusters(compared.select("rep", "tokens"), n_runs, n_tokens, least)
    members = compared.select("rep", "copies").join(cluster, F.col("rep") == F.col("node")).select("rep", "copies", F.col("root").alias("cluster"))
    counted = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    members = members.join(counted, "cluster").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = source.join(members, source["key"] == members["rep"]).drop("doc_id", "key")
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():  # repeated rows: one of them is enough
        texts = texts.dropDuplicates(["rep"])
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "rep", "block", "copies", "text")
    ordered = dealt.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "rep")
    found = written(ordered.mapInArrow(verify(threshold), "rep long, root long, links long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "classes")
    groups = (
        reps.select("sig", "rep", "rep_id", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("sig", "rep_id", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies")
    )
    return rows.select("doc_id", "key", "sig"), written(groups, "groups")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row (doc_id, rep_id, class_id, n_links) for each row of docs."""
    rows, groups = linked(docs, id_col, text_col, threshold, recall)
    smallest = groups.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    out = join_groups(rows, groups.join(smallest, "root"), "sig", "copies", rows.count())
    return out.select("doc_id", "rep_id", "class_id", "n_links")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class the row with the smallest id (of rows without any, one), with the columns of docs."""
    rows, groups = linked(docs, id_col, text_col)
    # each set's first row, then each class's: both sums of few bytes, made where the rows are
    firsts = rows.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    stay = firsts.join(groups.select("sig", "root"), "sig").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    marked = packed(docs).withColumn("key", F.xxhash64(F.col(field(docs, id_col)).cast("long"), text_of(field(docs, text_col))))
    kept = marked.join(stay, "key", "left_semi")
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return unpacked(kept, docs)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Class and number of links of every document."""
    return join(docs)
