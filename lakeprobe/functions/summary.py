"""What a body has to offer, told from the body alone: JSON shapes, probes of addresses, pages in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprobe.functions import net
from lakeprobe.functions.json_ops import is_json
from lakeprobe.operators import markup

#: Keys that are told of a value, of a probed body, and lines of JSON lines that are looked at.
KEYS, PROBE_KEYS, LINES = 30, 20, 200


def json_summary(body: Column, keys: int = KEYS) -> Column:
    """struct<valid, shape, items, keys>: of a list its length and the keys of its first item, of an object its keys; other values are scalars, null bodies invalid."""
    valid = is_json(body)
    items = F.when(valid, F.json_array_length(body))
    first = F.json_object_keys(F.get_json_object(body, "$[0]"))
    own = F.when(valid, F.json_object_keys(body))
    shape = F.when(~valid, "invalid").when(items.isNotNull(), "array").when(own.isNotNull(), "object").otherwise("scalar")
    named = F.when(items.isNotNull(), first).otherwise(own)
    return F.struct(valid.alias("valid"), shape.alias("shape"), items.alias("items"), F.slice(named, 1, keys).alias("keys"))


def probe(status: Column, content_type: Column, body: Column) -> Column:
    """struct<ok, json, shape, items, keys, ready_for_dataset> of a response: json is null where its type tells none, and a list of objects is ready for a dataset."""
    told = F.lower(F.coalesce(content_type, F.lit(""))).contains("json")
    s = json_summary(body, PROBE_KEYS)
    known = told & s["valid"]
    return F.struct(
        F.coalesce(status.between(200, 399), F.lit(False)).alias("ok"), F.when(told, s["valid"]).alias("json"), F.when(known & (s["shape"] != "scalar"), s["shape"]).alias("shape"), F.when(known, s["items"]).alias("items"),
        F.when(known, s["keys"]).alias("keys"), F.coalesce(known & (s["shape"] == "array") & s["keys"].isNotNull(), F.lit(False)).alias("ready_for_dataset"),
    )


def inputs(rows: DataFrame, body: str, content_type: str | None = None) -> DataFrame:
    """rows with kind, source and a summary of the JSON among them (of JSON lines, of the list of the first LINES)."""
    text = F.col(body)
    kind = net.input_kind(text)
    source = net.source_kind(F.col(content_type) if content_type else F.lit(None).cast("string"), text)
    lines = F.concat(F.lit("["), F.array_join(F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, LINES), ","), F.lit("]"))
    as_json = F.when(source == "jsonl", lines).when(source == "json", text)
    return rows.withColumn("kind", kind).withColumn("source", source).withColumn("summary", F.when(as_json.isNotNull(), json_summary(as_json)))


#: What is counted of a page, by tag.
COUNTED = {"tables": ("table",), "links": ("a",), "images": ("img",), "headings": ("h1", "h2", "h3", "h4", "h5", "h6"), "forms": ("form",)}


def page_counts(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Per page: how many tables, links with an address, images with a source, headings, forms and repeated groups it has; pages without elements are left out."""
    has = {n: F.col("tag").isin(*tags) for n, tags in COUNTED.items()}
    has["links"] = has["links"] & (markup.attribute(F.col("token"), "href") != "")
    has["images"] = has["images"] & (markup.attribute(F.col("token"), "src") != "")
    counts = nodes.groupBy(markup.PAGE).agg(*(F.count_if(c).alias(n) for n, c in has.items()))
    groups = entities.groupBy(markup.PAGE).agg(F.count(F.lit(1)).alias("groups"))
    return counts.join(groups, markup.PAGE, "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
