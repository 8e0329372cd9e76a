"""Phrase collocations mined as relations of occurrences (SETM).

The relation of length 1 holds every occurrence of a frequent word: its place and the
number of the word. Places count words and piece ends of a document, so that two places
follow one another exactly where the words stand side by side in one piece. The relation
of length k is the merge-join of the relation of length k - 1 with itself at places p and
p + 1: both run in order of place, so a shift of one finds all pairs. The pairs (head,
tail) are group-counted, groups that occur at least LEAST times are numbered, and a
semi-join keeps their occurrences, which are written in order for the next length.

A relation is kept as rows of blocks (whole documents of at least BLOCK words): the gaps
between the places and the numbers of the groups, packed. Where the table of frequent
groups has at most BOUND rows, tasks get it by broadcast and merge it with their sorted
keys; beyond, occurrences are unpacked into rows, meet the groups in a Spark join and are
packed again by block. Both give the same relation.

A group of k words knows its head (the first k - 1 words) and its tail (the last k - 1).
So the counts of all first and last parts come from the level before, and whatever holds
a phrase inside has a group of one more word whose head or tail it is: each occurrence of
a longer phrase is one of that group, which therefore occurs at least as often.

Defined results:
* null text is the empty text and has no words; null lang is `und`; texts are read whole;
* rows count as they come: repeated rows, and rows without an id, count again;
* an empty table gives an empty result; other columns do not matter;
* ties are put in order by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeprobe.llm.common import bounded_batches, discard, join_groups, partitions, text_of, tidied, written

#: Words of a phrase at most, occurrences at least, phrases told of each language, share (in hundredths) of a phrase that a longer one takes over.
WORDS, LEAST, FIRST, COVERED = 4, 30, 2000, 80
#: Frequent groups that are broadcast at most; words of a block at least; blocks that are joined at once; keys and distinct words that a task holds before it passes their counts on.
BOUND, BLOCK, SLICE, HELD, HELD_WORDS = 1_000_000, 4096, 32, 1 << 21, 200_000
#: Piece ends become full stops, tabs blanks; full stops are piece ends themselves, so no word is one.
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
RELATION = "block long, gaps binary, ids binary"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with a full stop wherever a piece ends."""
    return text.lower().translate(PIECES).replace(b".", b" . ").split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task by language; a null word holds the number of all words."""
    counts: dict[str, Counter] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            del words[b"."]
            names, numbers = [*words, None], [*words.values(), words.total()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array(names, pa.binary()), pa.array(numbers, pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from emit()
    yield from emit()


def _row(block: int, places: np.ndarray, ids: np.ndarray) -> tuple[int, bytes, bytes]:
    gaps = np.diff(places, prepend=places[0] - 2 if len(places) else 0)  # a block's first place follows no other
    return block, gaps.astype("<i4").tobytes(), ids.astype("<i8").tobytes()


def _relation(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["block", "gaps", "ids"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, list[bytes]]]]]:
    """The words of whole documents, by blocks of at least BLOCK words; blocks are numbered through all tasks."""
    number, size, held = TaskContext.get().partitionId() << 32, 0, []
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(text)
            words.append(b".")
            held.append((lang, words))
            size += len(words)
            if size >= BLOCK:
                yield number, held
                number, size, held = number + 1, 0, []
    if held:
        yield number, held


def word_relation(known):
    """The relation of length 1, by a broadcast table {lang: {word: number}}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for number, texts in blocks(batches):
            ids = np.concatenate([np.fromiter(map(known.value.get(lang, {}).get, words, repeat(-1)), np.int64, len(words)) for lang, words in texts])
            places = np.flatnonzero(ids >= 0)
            rows.append(_row(number, places, ids[places]))
            if len(rows) >= 64:
                yield _relation(rows)
                rows = []
        if rows:
            yield _relation(rows)

    return run


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence of a word as a row (block, place, lang, word)."""
    for number, texts in blocks(batches):
        place = 0
        for lang, words in texts:
            at = [i for i, w in enumerate(words) if w != b"."]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(at), pa.int64()), pa.array([place + i for i in at], pa.int32()), pa.array([lang] * len(at), pa.string()), pa.array([words[i] for i in at], pa.binary())],
                ["block", "place", "lang", "word"],
            )
            place += len(words)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE blocks: what numpy makes of a batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _pairs(b: pa.RecordBatch, groups: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a batch of blocks with itself at the next place: blocks, bounds of their rows, places (counted through the batch) and keys of the pairs."""
    gaps = np.frombuffer(b"".join(b.column("gaps").to_pylist()), "<i4")
    ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), "<i8")
    places = np.cumsum(gaps, dtype=np.int64)
    left = np.flatnonzero(gaps[1:] == 1)
    ends = np.cumsum([len(x) // 8 for x in b.column("ids").to_pylist()])
    return b.column("block").to_pylist(), np.searchsorted(left, ends), places[left], ids[left] * groups + ids[left + 1]


def count_pairs(groups: int):
    """Counts of the pairs of groups of a task: head * groups + tail."""

    def emit(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in sliced(batches):
            held.append(_pairs(b, groups)[3])
            size += len(held[-1])
            if size > HELD:
                yield emit(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if size:
            yield emit(*np.unique(np.concatenate(held), return_counts=True))

    return run


def pair_relation(groups: int, frequent):
    """The relation of the next length: the semi-join of the pairs with the broadcast sorted keys of the frequent groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = frequent.value
        for b in sliced(batches):
            names, ends, places, found = _pairs(b, groups)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == found)
            ends = np.searchsorted(hit, ends)
            places, ids = places[hit], at[hit]
            yield _relation([_row(name, places[i:j], ids[i:j]) for name, i, j in zip(names, [0, *ends[:-1]], ends, strict=True) if j > i])

    return run


def pair_rows(groups: int):
    """Every pair as a row (block, place, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            names, ends, places, keys = _pairs(b, groups)
            block = np.repeat(np.array(names, np.int64), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(places), pa.array(keys)], ["block", "place", "key"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, found in zip(b.column("block").to_pylist(), b.column("found"), strict=True):
            yield _relation([_row(block, found.values.field("place").to_numpy().astype(np.int64), found.values.field("id").to_numpy())])


def packed_by_block(rows: DataFrame) -> DataFrame:
    """Rows (block, place, id) as a relation: a block's occurrences fit in a row."""
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("found")).mapInArrow(tidied(_pack), RELATION)


def numbered(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """rows, sorted by key, with a number from 0 without gaps in `id`; and how many there are. Offsets are a row per partition."""
    at = written(rows.orderBy(key).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    parts = at.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("size")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = written(at.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part").withColumn("id", F.col("before") + inside).drop("at", "part", "before"), name)
    discard(at)
    return out, out.count()


def _parts(level: DataFrame, which: str) -> DataFrame:
    return level.select(F.col("id").alias(which), *(F.col(c).alias(f"{which}_{c}") for c in ("lang", "phrase", "last", "firsts", "lasts")))


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST, bound: int = BOUND) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1 to `words` words, a written table for each length, and rows (lang, n) with the number of words of each language.

    A phrase has its lang, id, head and tail (ids of the length before), f (its
    occurrences), firsts and lasts (occurrences of its first and last 1, 2... words, itself last).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))
    counts = written(source.mapInArrow(tidied(count_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counts.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    single, groups = numbered(counts.filter("word IS NOT NULL").withColumn("key", F.struct("lang", "word")), "key", "phrases-1")
    text = F.col("word").cast("string")
    levels = [single.select("lang", "id", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"), "f", text.alias("phrase"), text.alias("last"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))]
    if not groups:
        return levels, totals
    total = int(totals.agg(F.sum("n")).first()[0])
    if groups <= bound:
        known: dict[str, dict[bytes, int]] = {}
        for x in single.select("lang", "word", "id").toArrow().to_pylist():
            known.setdefault(x["lang"], {})[x["word"]] = x["id"]
        relation = source.mapInArrow(tidied(word_relation(spark.sparkContext.broadcast(known))), RELATION)
    else:
        occurrences = source.mapInArrow(tidied(word_rows), "block long, place int, lang string, word binary")
        relation = packed_by_block(join_groups(occurrences, single.select("lang", "word", "id", "f"), ["lang", "word"], "f", total))
    relation = written(relation, "occurrences-1", "zstd")
    for k in range(2, words + 1):
        pairs = relation.mapInArrow(tidied(count_pairs(groups)), "key long, n long").groupBy("key").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found, n = numbered(pairs, "key", f"pairs-{k}")
        level = found.select("id", "key", "f", F.expr(f"key DIV {groups}L").alias("head"), (F.col("key") % groups).alias("tail"))
        level = level.join(_parts(levels[-1], "head"), "head").join(_parts(levels[-1], "tail"), "tail")
        level = level.select(
            F.col("head_lang").alias("lang"), "id", "head", "tail", "f", F.concat_ws(" ", "head_phrase", "tail_last").alias("phrase"), F.col("tail_last").alias("last"),
            F.concat("head_firsts", F.array("f")).alias("firsts"), F.concat("tail_lasts", F.array("f")).alias("lasts"),
        )
        levels.append(written(level, f"phrases-{k}"))
        if not n or k == words:
            break
        if n <= bound:
            keys = np.sort(found.select("key").toArrow().column("key").to_numpy())
            following = relation.mapInArrow(tidied(pair_relation(groups, spark.sparkContext.broadcast(keys))), RELATION)
        else:
            occurrences = relation.mapInArrow(tidied(pair_rows(groups)), "block long, place long, key long")
            following = packed_by_block(join_groups(occurrences, found.select("key", "id", "f"), "key", "f", total))
        following = written(following, f"occurrences-{k}", "zstd")
        discard(relation)
        relation, groups = following, n
    discard(relation)
    return levels, totals


def _exact(column: str) -> str:
    return f"CAST({column} AS DECIMAL(19, 0))"


def weakest_cut(words: int) -> Column:
    """The cut with the lowest score of a phrase, of equal ones the first: score, k, l, r. Products are decimals, so they stay exact."""
    cuts = []
    for k in range(1, words):
        first, rest = f"firsts[{k - 1}]", f"lasts[{words - k - 1}]"
        score = F.expr(f"CAST(2000000 AS DECIMAL(7, 0)) * {_exact('f')} DIV ({_exact(first)} + {_exact(rest)})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(first).alias("l"), F.expr(rest).alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST, first: int = FIRST, bound: int = BOUND) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    levels, totals = mined(docs, text_col, lang_col, words, least, bound)
    found = None
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("head", "tail")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            level = level.join(longer, "id", "left").filter(F.expr(f"longer IS NULL OR 100 * {_exact('longer')} < {COVERED} * {_exact('f')}"))
        level = level.withColumn("cut", weakest_cut(k)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        found = level if found is None else found.unionByName(level)
    if found is None:
        return totals.select("lang", F.col("n").alias("rank"), F.col("lang").alias("phrase"), *(F.col("n").alias(c) for c in ("a", "l", "r", "n", "score"))).limit(0)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))
    # the first of each share of a language first: no task sorts all phrases of a language
    found = found.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= first)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return found.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations(docs)


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, w[i : i + k - 1] AS g FROM worded, range(1, {WORDS + 1}) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)
), counted AS (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL
), frequent AS (
  SELECT * FROM counted WHERE a >= {LEAST}
), cuts AS (
  SELECT c.lang, c.k, c.g, c.a, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score, j
  FROM frequent AS c, range(1, {WORDS}) AS t(j), frequent AS x, frequent AS y
  WHERE c.k > j AND x.lang = c.lang AND x.k = j AND x.g = c.g[1 : j] AND y.lang = c.lang AND y.k = c.k - j AND y.g = c.g[j + 1 :]
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, k AS whole, size, g[i : i + size - 1] AS g, a AS longer FROM frequent, range(2, {WORDS}) AS t(size), unnest(range(1, k - size + 2)) AS u(i) WHERE k > size
), kept AS (
  SELECT * FROM weakest AS w WHERE NOT EXISTS (SELECT 1 FROM inner_parts AS p WHERE p.lang = w.lang AND p.g = w.g AND 100 * p.longer::HUGEINT >= {COVERED} * w.a::HUGEINT)
), placed AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM placed JOIN (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang) USING (lang)
WHERE rank <= {FIRST}
"""
