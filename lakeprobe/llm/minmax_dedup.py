"""MinHash near-dedup with min-max hashing.

Documents are sets of lower-cased five-word shingles; two are linked where 100 times
their intersection is at least 85 times their union. Every permutation gives two values,
the smallest and the largest hash of the set: each agrees between two sets with the
probability of their Jaccard similarity, so PERMUTATIONS evaluations of the hash give
2 * PERMUTATIONS unbiased values, and since a set's minimum and maximum draw apart their
mean varies less than that of as many permutations' minima alone. ROWS values make a
band; two sets at the threshold share none of the BANDS bands with a probability below
1e-6 (`missed()`).

Equal sets are one from the start. Sets that share a band meet in its bucket: small
buckets compare sketches (a byte of every value) and tie together what may be linked,
members of large ones are tied to the smallest. So tied sets form clusters, which say
what has to be compared; links are found on the full sets only:

1. a cluster that fits in a block is compared in full; in a larger one, sets are dealt to
   blocks by size class (linked sets are of the same class or of neighbours) and hash, and
   every block is compared in full;
2. of every component so found in a cluster of several blocks, one set is compared with
   those of the others: a large group of near copies is one component now;
3. sets outside their cluster's largest component are compared with all sets of the
   cluster that are of another component. Nothing is left out, and a group whose members
   are linked to one another is never compared pair by pair.

Defined results:
* null text is the empty text; words are runs of other characters than ASCII white space;
  a text of fewer than five words is one shingle; a text without words is the empty set,
  linked with nothing, not even with its copies; texts are read whole;
* component_id is the smallest id of the component (null only where all of its ids are
  null), and a document is kept where its id is that id: rows with equal ids and equal
  texts share the decision; dedup() returns one of them;
* an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import bounded_batches, components, discard, field, join_groups, packed, text_of, tidied, unpacked, written
from lakeprobe.llm.jaccard_join import Shingler, _grouped, _mix, _roots, common_shingles, multipliers, near

#: Words of a shingle; hundredths of the union that an intersection needs; the bands.
WORDS, PERCENT, PERMUTATIONS, ROWS = 5, 85, 60, 5
#: Sets of a bucket that are compared by sketches; sets, and shingles, of a block that is compared in one task.
LIMIT, BLOCK, BLOCK_SHINGLES = 512, 256, 2_000_000


def bands(permutations: int = PERMUTATIONS, rows: int = ROWS) -> int:
    """Bands of a signature: every permutation gives two values."""
    return 2 * permutations // rows


def missed(percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS) -> float:
    """Probability that two sets at the threshold share no band."""
    return (1 - (percent / 100) ** rows) ** bands(permutations, rows)


def least_agreement(percent: int, values: int, lost: float = 1e-7) -> int:
    """The most values in which two sets at the threshold agree but for the probability `lost`."""
    j, below = percent / 100, 0.0
    for k in range(values + 1):
        below += math.comb(values, k) * j**k * (1 - j) ** (values - k)
        if below > lost:
            return k
    return values


def lowered(text: str = "text") -> Column:
    """The text with A-Z in lower case, and nothing else changed."""
    return F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def min_max(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest and the largest hash of a set under every permutation, in turn."""
    low, high = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(factors), np.uint64)
    for i in range(0, len(shingles), 4096):
        hashes = _mix(shingles[None, i : i + 4096] * factors[:, None])
        low, high = np.minimum(low, hashes.min(axis=1)), np.maximum(high, hashes.max(axis=1))
    return np.stack([low, high], axis=1).ravel()


def describe(words: int, permutations: int, rows: int):
    """Per document: a digest of its set, the set's size, the hash of every band and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, factors = Shingler(words), multipliers(permutations)
        n = bands(permutations, rows)
        places = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        for b in batches:
            sig, size, hashes, sketch = [], [], [], []
            for t in b.column("text"):
                s = shingler(t.as_py())
                values = min_max(s, factors)
                of_bands = _mix((_mix(values[: n * rows].reshape(n, rows)) * places).sum(axis=1) + np.arange(n, dtype=np.uint64))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                size.append(len(s))
                hashes.append(of_bands.astype("<u8").tobytes())
                sketch.append((values >> np.uint64(40)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(sig, pa.binary()), pa.array(size, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sketch, pa.binary())],
                ["doc_id", "key", "sig", "size", "bands", "sketch"],
            )

    return run


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (rep, key) for every band of a set."""
    for b in batches:
        found = [np.frombuffer(x, "<i8") for x in b.column("bands").to_pylist()]
        if found:
            reps = np.repeat(b.column("rep").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(found))], ["rep", "key"])


def linked_in(percent: int, keys: list[str], words: int = WORDS):
    """Edges (u, v) that span the linked sets of every group of rows; with a column `comp`, sets of one component aren't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for _, rows in _grouped(batches, keys):
            if len(rows) < 2:
                continue
            sets = [shingler(r["text"]) for r in rows]
            size = np.array([len(s) for s in sets])
            both = common_shingles(sets)
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            if "comp" in rows[0]:
                comp = np.array([r["comp"] for r in rows])
                linked &= comp[:, None] != comp[None, :]
            reps = [r["rep"] for r in rows]
            roots = [(i, r) for i, r in enumerate(_roots(len(rows), np.argwhere(np.triu(linked, 1)))) if i != r]
            yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in roots], pa.int64()), pa.array([reps[r] for _, r in roots], pa.int64())], ["u", "v"])

    return run


def clusters(reps: DataFrame, percent: int, permutations: int, rows: int) -> DataFrame:
    """Rows (node, root): sets that have to be compared have the same root."""
    values = 2 * permutations
    total = reps.count() * bands(permutations, rows)
    at = written(reps.select("rep", "bands").mapInArrow(tidied(buckets), "rep long, key long"), "bands")
    sizes = written(at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).filter("n > 1"), "buckets")
    shared = written(join_groups(at, sizes, "key", "n", total), "shared")
    discard(at)
    small = shared.filter(F.col("n") <= LIMIT).select("key", "rep").join(reps.select("rep", "sketch"), "rep")
    edges = small.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(near(values, least_agreement(percent, values))), "u long, v long")
    return components(edges.unionByName(shared.filter((F.col("n") > LIMIT) & (F.col("rep") != F.col("first"))).select(F.col("rep").alias("u"), F.col("first").alias("v"))), "clusters")


def _rooted(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with the root of `key` in `comp`: found has at most one edge (u, v) for each u, whose v is a root itself."""
    return rows.join(found.withColumnRenamed("v", "root"), F.col(key) == F.col("u"), "left").withColumn("comp", F.coalesce("root", key)).drop("u", "root")


def _blocks(members: DataFrame, keys: list[str], total: int) -> DataFrame:
    """members with a column `block`: groups by keys in blocks of bounded numbers of sets and shingles."""
    sized = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    sized = sized.withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    return join_groups(members, sized, keys, "members", total).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("members", "shingles")


def _compared(texts: DataFrame, dealt: DataFrame, keys: list[str], percent: int, words: int, name: str) -> DataFrame:
    rows = texts.join(dealt, "rep").repartition(*keys).sortWithinPartitions(*keys, "rep")
    return written(rows.mapInArrow(tidied(linked_in(percent, keys, words)), "u long, v long"), name)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, key): rows are told apart by a hash of id and text, since ids may be null or repeated."""
    key = F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered(text_col).alias("text"), key.alias("key"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, permutations: int = PERMUTATIONS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, key, sig, size), and a row for each distinct set that isn't empty: sig, rep, rep_id, copies, comp."""
    bounded_batches(docs.sparkSession)
    source = _keyed(docs, id_col, text_col)
    described = written(source.mapInArrow(tidied(describe(words, permutations, rows)), "doc_id long, key long, sig binary, size long, bands binary, sketch binary"), "described")
    reps = described.filter("size > 0").groupBy("sig").agg(
        F.min("key").alias("rep"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")
    )
    reps = written(reps, "distinct")
    total = reps.count()
    cluster = clusters(reps, percent, permutations, rows)
    members = reps.select("rep", "size").join(cluster.withColumnRenamed("root", "cluster"), F.col("rep") == F.col("node")).drop("node")
    # linked sets' sizes differ by less than the width of a class
    width = max(-math.log(percent / 100) * (1 + 1e-6), 1e-6)
    members = written(_blocks(members, ["cluster"], total), "members-clusters")
    members = members.withColumn("class", F.when(F.col("blocks") == 1, 0).otherwise(F.floor(F.log(F.col("size").cast("double")) / width).cast("int"))).drop("block", "blocks")
    members = written(_blocks(members, ["cluster", "class"], total), "members")
    texts = source.select("key", "text").join(members.select("rep"), source["key"] == members["rep"]).select("rep", "text")
    if not described.groupBy("key").count().filter("count > 1").isEmpty():  # repeated rows: one of them is enough
        texts = texts.dropDuplicates(["rep"])
    texts = written(texts, "texts", "zstd")

    found = _compared(texts, members.select("rep", "cluster", "class", "block"), ["cluster", "class", "block"], percent, words, "links-blocks")
    several = members.groupBy("cluster").agg(F.countDistinct("class", "block").alias("blocks"), F.count(F.lit(1)).alias("members")).filter("blocks > 1")
    if not several.isEmpty():
        several = written(several.select("cluster", "members"), "several")
        # a set is in one block, and a component's head again: the roots found there are the components so far
        large = written(_rooted(join_groups(members.drop("block", "blocks"), several, "cluster", "members", total).drop("members"), found, "rep"), "parts")
        heads = _blocks(large.filter("rep = comp"), ["cluster"], total)
        joined = _compared(texts, heads.select("rep", "cluster", "block"), ["cluster", "block"], percent, words, "links-heads")
        large = written(_rooted(large.withColumnRenamed("comp", "head"), joined, "head").drop("head"), "joined")
        found = found.unionByName(joined)
        sizes = large.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("largest"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        largest = written(largest.select("cluster", F.col("largest.comp").alias("main"), "members"), "largest")
        if not largest.isEmpty():
            split = written(join_groups(large, largest, "cluster", "members", total).drop("members"), "split")
            minor = _blocks(split.filter("comp <> main"), ["cluster", "class"], total).select("rep", "size", "cluster", "class", "comp", "block", "blocks")
            minor = written(minor, "minor")
            # every set meets the blocks of minor sets of its class and of the two beside it
            held = minor.groupBy("cluster", "class").agg(F.max("blocks").alias("n_blocks"), F.count(F.lit(1)).alias("minors"))
            near_by = held.select("cluster", F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1)))).alias("class"), F.col("class").alias("with_class"), "n_blocks")
            every = split.select("rep", "size", "cluster", "class", "comp")
            every = _blocks(every, ["cluster", "class"], total).select("rep", "cluster", "class", "comp", F.col("block").alias("other"))
            near_by = near_by.groupBy("cluster", "class").agg(F.collect_list(F.struct("with_class", "n_blocks")).alias("beside"))
            per = every.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"), F.max("other").alias("others"))
            met = written(per.join(near_by, ["cluster", "class"]), "beside")
            dealt = join_groups(every, met, ["cluster", "class"], "n", total).withColumn("beside", F.explode("beside"))
            dealt = dealt.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("beside.n_blocks") - 1))).select(
                "rep", "comp", "cluster", F.col("beside.with_class").alias("minor_class"), "a", F.col("class").alias("other_class"), "other"
            )
            # the minor sets themselves go to every block of the classes beside theirs
            to_met = met.select("cluster", F.col("class").alias("other_class"), "others", F.explode("beside").alias("beside"))
            to_met = to_met.groupBy("cluster", F.col("beside.with_class").alias("class")).agg(F.collect_list(F.struct("other_class", "others")).alias("to"))
            to_met = written(to_met.join(held.select("cluster", "class", "minors"), ["cluster", "class"]), "towards")
            own = join_groups(minor, to_met, ["cluster", "class"], "minors", total).withColumn("to", F.explode("to"))
            own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to.others")))).select(
                "rep", "comp", "cluster", F.col("class").alias("minor_class"), F.col("block").alias("a"), F.col("to.other_class").alias("other_class"), "other"
            )
            keys = ["cluster", "minor_class", "a", "other_class", "other"]
            rest = _compared(texts, dealt.unionByName(own).dropDuplicates(["rep", *keys]), keys, percent, words, "links-rest")
            found = found.unionByName(rest)
    comps = components(found, "components")
    out = reps.select("sig", "rep", "rep_id", "copies").join(comps, F.col("rep") == F.col("node"), "left").select("sig", "rep", "rep_id", "copies", F.coalesce("root", "rep").alias("comp"))
    return described.select("doc_id", "key", "sig", "size"), written(out, "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """A row (doc_id, n_shingles, component_id, kept) for every row of docs."""
    described, groups = grouped(docs, id_col, text_col, percent, words, permutations, rows)
    smallest = groups.groupBy("comp").agg(F.min("rep_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = written(join_groups(groups, smallest, "comp", "sets", groups.count()).select("sig", "copies", "component_id"), "named")
    met = join_groups(described.filter("size > 0"), named, "sig", "copies", described.count()).select("doc_id", "size", "component_id")
    out = met.unionByName(described.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the row with the smallest id (of rows without any, one); every text without words stays."""
    described, groups = grouped(docs, id_col, text_col, **options)
    firsts = described.filter("size > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    stay = firsts.join(groups.select("sig", "comp"), "sig").groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    rows = packed(docs).withColumn("key", F.xxhash64(F.col(field(docs, id_col)).cast("long"), text_of(field(docs, text_col))))
    wordless = ~text_of(field(docs, text_col)).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.filter(~wordless).join(stay, "key", "left_semi")
    if not described.filter("size > 0").groupBy("key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return unpacked(kept.unionByName(rows.filter(wordless)), docs)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Component and decision of every document."""
    return near_duplicates(docs)


#: All pairs of documents with a shingle in common: for small tables.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS shingle FROM worded WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles AS a JOIN shingles AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes AS s ON s.doc_id = x JOIN sizes AS t ON t.doc_id = y WHERE 100 * shared >= 85 * (s.n + t.n - shared)
), reached AS (
  SELECT doc_id, doc_id AS other FROM worded
  UNION
  SELECT doc_id, y FROM reached JOIN links ON x = other
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM components LEFT JOIN sizes USING (doc_id)
"""
