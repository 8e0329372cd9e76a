"""JSON text as rows: projection, keys, summaries, and drift of fields from page to page."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Records whose keys are looked at where no fields are named.
KEY_RECORDS = 200


def project(df: DataFrame, json_col: str, fields: list[str]) -> DataFrame:
    """df with a text column for each field of a JSON object; '' where it is missing or null."""
    return df.select("*", *[F.coalesce(F.get_json_object(json_col, f"$.{f}"), F.lit("")).alias(f) for f in fields])


def keys(df: DataFrame, json_col: str) -> DataFrame:
    """Rows (key, records): how many records have each key."""
    return df.select(F.explode(F.json_object_keys(json_col)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("records"))


def key_union(df: DataFrame, json_col: str, order: str, records: int = KEY_RECORDS) -> list[str]:
    """The keys of the first records, in the order in which they are first seen; at most `records` small rows are looked at."""
    first = df.orderBy(order).limit(records).select(F.col(order).alias("at"), F.posexplode(F.json_object_keys(json_col)).alias("pos", "key"))
    rows = first.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first")).orderBy("first").collect()
    return [r["key"] for r in rows]


def project_all(df: DataFrame, json_col: str, order: str) -> DataFrame:
    """df with a text column for each key of its first records."""
    return project(df, json_col, key_union(df, json_col, order))


def stringify(c: Column, limit: int = 500) -> Column:
    """A value of JSON text as a cell: null as nothing, objects and lists as JSON of at most `limit` characters, texts without quotes."""
    v = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    return F.when(c.isNull() | (F.trim(c) == "null"), "").when(F.trim(c).rlike(r"^[\[{]"), F.substring(v, 1, limit)).otherwise(F.coalesce(v, F.lit("")))


def _largest(texts: pd.Series) -> pd.Series:
    def walk(text: str | None) -> str | None:
        try:
            todo = [json.loads(text or "null")]
        except ValueError:
            return None
        best: list = []
        while todo:
            o = todo.pop()
            if isinstance(o, list):
                records = [x for x in o if isinstance(x, dict)]
                best = records if len(records) > len(best) else best
            todo.extend(reversed(o if isinstance(o, list) else list(o.values()) if isinstance(o, dict) else []))
        return json.dumps(best, ensure_ascii=False)

    return texts.map(walk)


def largest_records(c: Column) -> Column:
    """JSON text of the longest list of objects anywhere in a value (the first of equals); null for text that is no JSON. Nesting has no bound, so no path expression finds it."""
    return F.pandas_udf(_largest, StringType())(c)


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else: the parser reads the first value of a text, so it must also be the only one of a list and the value of a member."""
    alone = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull(), F.lit(False))


def shape(c: Column) -> Column:
    """object, array, scalar or invalid."""
    return F.when(~is_json(c), "invalid").when(F.json_array_length(c).isNotNull(), "array").when(F.json_object_keys(c).isNotNull(), "object").otherwise("scalar")


def value_kind(c: Column) -> Column:
    """empty, url, number, date or text."""
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty").when(c.rlike("(?i)^https?://"), "url").when(F.trim(c).rlike(r"^-?\d[\d\s.,]*$"), "number")
        .when(c.rlike(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}"), "date").otherwise("text")
    )


def field_drift(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: the share of records that have it, the kind most have, and whether kinds are mixed."""
    long = rows.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "value").withColumn("kind", value_kind(F.col("value")))
    counts = long.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("kind") != "empty", F.struct("n", "kind"))
    got = counts.groupBy("field").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("kind") != "empty", F.col("n")).otherwise(0)).alias("present"), F.max(full).alias("top"), F.count_if(F.col("kind") != "empty").alias("kinds"))
    return got.select("field", F.round(F.col("present") * 100 / F.col("total"), 1).alias("present_pct"), F.coalesce("top.kind", F.lit("empty")).alias("dominant"), (F.col("kinds") > 1).alias("mixed"))
