"""Catalog search: filters, weighted relevance, topical boosts and host bridges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a hit in a field is worth.
WEIGHTS = {"name": 5, "category": 4, "description": 3, "why_useful": 2, "ideas": 2}
FREE_TYPES = ("free_forever", "free_tier", "open_data")
STALE_DAYS = 180
#: Fixed value: the word that tells a permission of commercial use.
ALLOWED = "разреш"


def relevance(query: str) -> Column:
    """Sum of the weights of the fields that contain the query; 1 for an empty query."""
    q = query.strip().lower()
    hits = [F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q)), w).otherwise(0) for c, w in WEIGHTS.items()]
    return sum(hits[1:], hits[0]) if q else F.lit(1)


#: What a topic of the query adds for a record of its categories, and for one that describes them.
TOPIC, DESCRIBED = 4, 1


def _substring(text: str, n: int):
    return lambda i: F.substring(text, i, n)


def contained(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Rows (text, word) of the distinct texts that contain a word as it stands: texts meet words by the words' first three characters, and are looked through then."""
    words = words.select(F.col(word).alias("word")).filter("word <> ''").distinct().withColumn("key", F.substring("word", 1, 3))
    texts = texts.select(F.col(text).alias("text")).filter("text <> ''").distinct()
    lengths = (1, 2, 3) if not words.filter("length(word) < 3").isEmpty() else (3,)
    starts = F.sequence(F.lit(1), F.length("text"))
    grams = [F.transform(starts, _substring("text", n)) for n in lengths]
    return texts.withColumn("key", F.explode(F.array_distinct(F.concat(*grams)))).join(words, "key").filter(F.contains("text", F.col("word"))).select("text", "word").distinct()


def boost(records: DataFrame, query: str, stems: DataFrame) -> DataFrame:
    """records with `boost`: for every word of the query and every stem (stem, category) of which one begins with the other, TOPIC where the category is the record's, DESCRIBED where its description names one of the stem's categories.

    Whatever the number of stems and categories: pairs of word and stem are summed up by
    category, and by the descriptions that name one, before records are joined.
    """
    words = F.lit(sorted(re.findall(r"\w+", query.lower()))).cast("array<string>")
    pairs = stems.select(F.lower("stem").alias("stem"), F.lower("category").alias("topic")).distinct().withColumn("word", F.explode(F.array_distinct(words)))
    alike = pairs.filter(F.startswith("word", F.col("stem")) | F.startswith("stem", F.col("word"))).select("word", "stem", "topic")
    of_category = alike.groupBy(F.col("topic").alias("own_topic")).agg(F.count(F.lit(1)).alias("own"))
    described = records.select(F.lower("description").alias("text"))
    named = contained(described, "text", alike, "topic").withColumnRenamed("word", "topic").join(alike, "topic")
    of_text = named.select("text", "word", "stem").distinct().groupBy("text").agg(F.count(F.lit(1)).alias("told")).withColumnRenamed("text", "told_text")
    out = records.join(of_category, F.lower("category") == F.col("own_topic"), "left").join(of_text, F.lower("description") == F.col("told_text"), "left")
    score = TOPIC * F.coalesce("own", F.lit(0)) + DESCRIBED * F.coalesce("told", F.lit(0))
    return out.withColumn("boost", score.cast("int")).drop("own_topic", "own", "told_text", "told")


def filtered(records: DataFrame, category: str | None = None, no_key: bool | None = None, free_type: str | None = None, cors: bool | None = None, has_sdk: bool | None = None, commercial: bool = False) -> DataFrame:
    """The records that every given filter lets through; commercial wants a permission in commercial_use."""
    c, keep = F.col, F.lit(True)
    if category:
        keep = keep & (F.lower("category") == category.lower())
    if no_key is not None:
        keep = keep & ((c("auth") == "none") == no_key)
    if free_type:
        keep = keep & (c("free_type") == free_type)
    for name, want in (("cors", cors), ("sdk", has_sdk)):
        if want is not None:
            keep = keep & (F.coalesce(c(name), F.lit(False)) == want)
    if commercial:
        keep = keep & F.contains(F.lower(F.coalesce("commercial_use", F.lit(""))), F.lit(ALLOWED))
    return records.filter(keep)


def effective_status(today: Column) -> Column:
    """availability_checked where a probe succeeded, stale where the check of the documents is old, else the status itself."""
    return F.when(F.coalesce("probe_ok", F.lit(False)), "availability_checked").when((F.col("status") == "docs_verified") & is_stale(today), "stale").otherwise(F.col("status"))


def merged(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """The free records of several sources; of those with one key that of the first source stays."""
    every = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_number", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    least = every.groupBy(F.col(key).alias("first_key")).agg(F.min("source_number").alias("first_number"))
    kept = every.join(least, (F.col(key) == F.col("first_key")) & (F.col("source_number") == F.col("first_number")))
    return kept.filter(is_free()).drop("source_number", "first_key", "first_number").dropDuplicates([key])


def of_topics(records: DataFrame, topics: list[str]) -> DataFrame:
    """The records of the named categories, whatever their case."""
    return records.filter(F.lower("category").isin(*[t.lower() for t in topics]))


def is_free() -> Column:
    return (F.col("auth") == "none") | F.col("free_type").isin(*FREE_TYPES)


def is_stale(today: Column) -> Column:
    return F.col("docs_verified").isNotNull() & (F.datediff(today, "docs_verified") > STALE_DAYS) | F.col("docs_verified").isNull()


def search(records: DataFrame, query: str, limit: int) -> DataFrame:
    """The best matches: score, then name, both descending."""
    return records.withColumn("score", relevance(query)).filter("score > 0").orderBy(F.desc("score"), F.desc("name")).limit(limit)


def bridge(candidates: DataFrame, records: DataFrame, host: str = "host") -> DataFrame:
    """Each candidate with the smallest id of the records that have its host in verify_url or docs_url."""
    of = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    hosts = records.select("id", F.explode(F.array_distinct(F.array(of("verify_url"), of("docs_url")))).alias(host)).filter(F.col(host) != "").groupBy(host).agg(F.min("id").alias("record_id"))
    return candidates.join(hosts, host, "left")
