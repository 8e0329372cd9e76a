"""What a page has to offer as a dataset: repeated elements, structured data in scripts, addresses of interfaces.

All of it is groupings over pages as rows (operators/markup.py): like siblings are a
group-by of parent and look, the fields of a group's items are minima over the elements
inside each item, and a field belongs to the group if half of the items have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprobe.functions import urls
from lakeprobe.functions.json_ops import is_json
from lakeprobe.operators import crawl, markup
from lakeprobe.operators.markup import PAGE
from lakeprobe.session import saved

#: Bounds of groups, and weights of confidences.
MEMBERS, DEPTH, GROUPS, ITEMS, FULL_TEXT, SURE = 3, 40, 5, 200, 200, 6
CONTAINERS = ("ul", "ol", "div", "section", "main", "table", "tbody", "article", "nav")
WEIGHT = {"high": 3, "medium": 2, "low": 1}
LIMITS = {"title": 200, "alt": 200, "date": 60, "text": 400}


def _best(groups: DataFrame, first: int) -> DataFrame:
    """The groups of a page with the highest scores, each look once, numbered from 1: of equal scores the first in the page."""
    order = [F.desc("score"), F.asc_nulls_first("parent"), F.asc("first")]
    once = groups.withColumn("again", F.row_number().over(Window.partitionBy(PAGE, "signature").orderBy(*order))).filter("again = 1").drop("again")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(PAGE).orderBy(*order))).filter(F.col("place") <= first)


def siblings(nodes: DataFrame) -> DataFrame:
    """Groups of like siblings: (page_id, parent, parent_depth, signature, members, avg_text, spread, first)."""
    return nodes.groupBy(PAGE, "parent", (F.col("depth") - 1).alias("parent_depth"), "signature").agg(
        F.count(F.lit(1)).alias("members"), (F.sum("text_len") / F.count(F.lit(1))).alias("avg_text"), F.sum(F.col("text_len").cast("long") * F.col("text_len")).alias("squares"), F.min("pre").alias("first"), F.first("tag").alias("tag")
    )


def repeated(nodes: DataFrame, first: int = GROUPS) -> DataFrame:
    """The repeated groups of each page: three members at least, not deeper than 40 steps, with text; many and long ones first."""
    groups = siblings(nodes).filter((F.col("members") >= MEMBERS) & (F.col("parent_depth") <= DEPTH) & (F.col("avg_text") >= 1))
    scored = groups.withColumn("score", F.col("members") * F.least("avg_text", F.lit(float(FULL_TEXT))) / FULL_TEXT)
    return _best(scored, first).select(PAGE, "place", "parent", "signature", "members", "avg_text", "score", "first")


def entity_groups(nodes: DataFrame, first: int = GROUPS) -> DataFrame:
    """Groups that look like lists of cards: siblings in a container, with text, even ones preferred."""
    up = nodes.select(PAGE, F.col("pre").alias("parent"), F.col("tag").alias("container_tag"), F.col("signature").alias("container"))
    groups = siblings(nodes).filter((F.col("members") >= MEMBERS) & (F.col("avg_text") > 0) & ~F.col("tag").isin(*markup.VOID)).join(up, [PAGE, "parent"], "left")
    groups = groups.filter(F.col("parent").isNull() | F.col("container_tag").isin(*CONTAINERS))
    variance = F.greatest(F.col("squares") / F.col("members") - F.col("avg_text") * F.col("avg_text"), F.lit(0.0))
    even = 1 / (1 + F.sqrt(variance) / (F.col("avg_text") + 1))
    scored = groups.withColumn("score", F.col("members") * F.least("avg_text", F.lit(float(FULL_TEXT))) / FULL_TEXT * even)
    return _best(scored, first).select(PAGE, "place", "parent", F.coalesce("container", F.lit("#root")).alias("container"), "signature", "members", "avg_text", "score", "first")


def members(nodes: DataFrame, groups: DataFrame, most: int | None = None) -> DataFrame:
    """The elements of groups, numbered from 0 in each: (page_id, place, item, pre, post, token, text_len)."""
    wanted = groups.select(PAGE, "signature", "place", F.col("parent").alias("above"))
    found = nodes.join(wanted, [PAGE, "signature"]).filter(F.col("parent").eqNullSafe(F.col("above"))).select(PAGE, "place", "pre", "post", "token", "text_len")
    found = found.withColumn("item", F.row_number().over(Window.partitionBy(PAGE, "place").orderBy("pre")) - 1)
    return found if most is None else found.filter(F.col("item") < most)


def joined_text(rows: DataFrame, spans: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The text inside each span, in order, with single spaces: (keys, span_pre, text)."""
    found = markup.inside(rows, "pos", spans, keys)
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return found.groupBy(*keys, "span_pre").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), " "), 1, most).alias("text"))


def items(pages: DataFrame, nodes: DataFrame, groups: DataFrame, most: int = ITEMS) -> DataFrame:
    """The items of groups as rows: page_id, place, item, title, link, image, alt, date, text; null where an item has no such field.

    title is the first heading or link with text, link the first with an address, image
    the first with a source (and its alt), date the first time element. Items without
    title and text are left out.
    """
    keys = [PAGE, "place"]
    cards = members(nodes, groups, most).select(PAGE, "place", "item", "pre", "post", "text_len")
    rows = markup.texts(markup.stream(pages)).select(PAGE, "pos", "text")
    below = markup.inside(nodes.select(PAGE, "pre", "post", "tag", "token", "text_len"), "pre", cards.select(*keys, "pre", "post", "item"), keys)
    address, source = markup.attribute(F.col("token"), "href"), markup.attribute(F.col("token"), "src")
    heading = F.col("tag").isin("h1", "h2", "h3", "h4", "h5") | ((F.col("tag") == "a") & (address != ""))
    at = lambda what, condition: F.min(F.when(condition, F.struct("pre", *what)))
    found = below.groupBy(*keys, "span_item").agg(
        at([F.col("post")], heading & (F.col("text_len") > 0)).alias("title"), at([address.alias("href")], (F.col("tag") == "a") & (address != "")).alias("link"),
        at([source.alias("src"), markup.attribute(F.col("token"), "alt").alias("alt")], (F.col("tag") == "img") & (source != "")).alias("image"),
        at([F.col("post"), markup.attribute(F.col("token"), "datetime").alias("value")], F.col("tag") == "time").alias("date"),
    ).withColumnRenamed("span_item", "item")
    spans = lambda c: found.filter(F.col(c).isNotNull()).select(*keys, F.col(f"{c}.pre").alias("pre"), F.col(f"{c}.post").alias("post"))
    of_cards = joined_text(rows, cards.select(*keys, "pre", "post"), keys, LIMITS["text"])
    titles = joined_text(rows, spans("title"), keys, LIMITS["title"]).select(*keys, F.col("span_pre").alias("title_pre"), F.col("text").alias("title_text"))
    dates = joined_text(rows, spans("date"), keys, LIMITS["date"]).select(*keys, F.col("span_pre").alias("date_pre"), F.col("text").alias("date_text"))
    base = pages.select(PAGE, F.col("url"))
    out = cards.select(*keys, "item", F.col("pre").alias("span_pre")).join(of_cards, [*keys, "span_pre"], "left").join(found, [*keys, "item"], "left").join(base, PAGE)
    out = out.withColumn("title_pre", F.col("title.pre")).join(titles, [*keys, "title_pre"], "left").withColumn("date_pre", F.col("date.pre")).join(dates, [*keys, "date_pre"], "left")
    filled = lambda c: F.when(c != "", c)
    date = F.when(F.col("date").isNotNull(), F.substring(F.coalesce(filled(F.col("date.value")), F.col("date_text"), F.lit("")), 1, LIMITS["date"]))
    return out.select(
        *keys, "item", F.col("title_text").alias("title"), urls.resolve(F.col("url"), F.col("link.href")).alias("link"), urls.resolve(F.col("url"), F.col("image.src")).alias("image"),
        filled(F.substring("image.alt", 1, LIMITS["alt"])).alias("alt"), date.alias("date"), "text",
    ).filter("title IS NOT NULL OR text IS NOT NULL")


FIELDS = ("title", "link", "image", "alt", "date", "text")


def entities(nodes: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups with at least three items: page_id, place, signature, container, items, fields (what half of the items have), confidence."""
    counts = rows.groupBy(PAGE, "place").agg(F.count(F.lit(1)).alias("items"), *(F.count(c).alias(c) for c in FIELDS))
    common = F.sort_array(F.filter(F.array(*(F.when(2 * F.col(c) >= F.col("items"), F.lit(c)) for c in FIELDS)), lambda x: x.isNotNull()))
    found = groups.join(counts.filter(F.col("items") >= MEMBERS).withColumn("fields", common).select(PAGE, "place", "items", "fields"), [PAGE, "place"])
    return found.select(PAGE, "place", "signature", "container", "items", "fields", F.round(F.least(F.col("score") / 20, F.lit(1.0)), 2).alias("confidence"))


def dataset(rows: DataFrame, found: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The items of the entities found as rows (page_id, place, item, field, value): the fields asked for or, by default, those that half of the items have."""
    long = rows.join(found.select(PAGE, "place", "fields"), [PAGE, "place"]).unpivot([PAGE, "place", "item", "fields"], list(FIELDS), "field", "value")
    wanted = F.col("field").isin(*fields) if fields else F.array_contains("fields", F.col("field"))
    return long.filter(wanted).select(PAGE, "place", "item", "field", F.coalesce("value", F.lit("")).alias("value"))


def proposed_fields(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """What the first item of each group offers, in order: (page_id, place, fields as array of name, selector, source, transform)."""
    keys = [PAGE, "place"]
    first = members(nodes, groups, 1).select(*keys, "pre", "post")
    found = markup.inside(nodes.select(PAGE, "pre", "tag", "token"), "pre", first, keys, own=True)
    tag, classes = F.col("tag"), markup.attribute(F.col("token"), "class")
    has = {f"h{i}": tag == f"h{i}" for i in range(1, 7)} | {"a": tag == "a", "href": (tag == "a") & F.col("token").rlike(r"(?i)\shref[\s=/>]"), "img": tag == "img", "price": classes.contains("price")}
    flags = found.groupBy(*keys).agg(*(F.bool_or(c).alias(name) for name, c in has.items()))
    spec = lambda name, selector, source, transform: F.struct(F.lit(name).alias("name"), F.lit(selector).alias("selector"), F.lit(source).alias("source"), F.lit(transform).alias("transform"))
    title = F.coalesce(*(F.when(F.col(t), spec("title", t, "text", "normalize_ws")) for t in ("h1", "h2", "h3", "h4", "h5", "h6", "a")))
    wanted = F.array(title, F.when(F.col("href"), spec("link", "a", "url", "none")), F.when(F.col("img"), spec("image", "img", "image", "none")), F.when(F.col("price"), spec("price", "[class*=price]", "text", "number")))
    wanted = F.filter(wanted, lambda x: x.isNotNull())
    return flags.select(*keys, F.when(F.size(wanted) > 0, wanted).otherwise(F.array(spec("text", "", "text", "normalize_ws"))).alias("fields"))


def stable_ids(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Whether one of the first six items of each group has an id, or a data attribute with an id in its name."""
    bare = F.regexp_replace("token", "\"[^\"]*\"|'[^']*'", '""')
    named = bare.rlike(r"(?i)\s(id|data-[^\s=/>]*id[^\s=/>]*)[\s=/>]")
    return members(nodes, groups, 6).groupBy(PAGE, "place").agg(F.bool_or(named).alias("stable_ids"))


def scripts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, script, linked_data, body): the scripts of pages that may hold JSON."""
    each = F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>"), 0))
    rows = pages.select(PAGE, each.alias("script", "tag"))
    body = F.regexp_replace("tag", r"(?is)^<script\b[^>]*>\s*|\s*</script\s*>$", "")
    rows = rows.select(PAGE, "script", F.col("tag").rlike(r"(?is)^<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json").alias("linked_data"), body.alias("body"))
    return rows.filter(F.col("body").rlike(r"^[{\[]"))


def record_arrays(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """The longest list of objects anywhere in the JSON text of rows, the first of equals: (keys, records as array of JSON texts, is_object). Texts that are no JSON are left out.

    Values are opened level by level with variant_explode until nothing is left to open;
    each level is a projection of the one before.
    """
    start = rows.filter(is_json(F.col(body))).select(*keys, F.try_parse_json(body).alias("v"))
    level = start.select(*keys, "v", F.array().cast("array<int>").alias("path"))
    kind = F.schema_of_variant("v")
    found = None
    while True:
        nested = level.withColumn("kind", kind).filter(F.col("kind").rlike("^(ARRAY|OBJECT)"))
        inner = saved(rows.sparkSession.sql("SELECT l.* EXCEPT (v, kind, path), array_append(path, e.pos) AS path, e.value AS v, l.kind AS up FROM {l} l, LATERAL variant_explode(l.v) e", l=nested), "json-level")
        objects = inner.filter(F.col("up").startswith("ARRAY") & F.schema_of_variant("v").startswith("OBJECT"))
        of = objects.withColumn("list", F.slice("path", 1, F.size("path") - 1)).groupBy(*keys, "list").agg(F.sort_array(F.collect_list(F.struct(F.element_at("path", -1).alias("pos"), F.to_json("v").alias("record")))).alias("records"))
        found = of if found is None else found.unionByName(of)
        level = inner.drop("up")
        if level.filter(F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)")).isEmpty():
            break
    order = Window.partitionBy(*keys).orderBy(F.desc(F.size("records")), "list")
    best = found.withColumn("place", F.row_number().over(order)).filter("place = 1").select(*keys, F.transform("records", lambda r: r["record"]).alias("records"))
    tops = start.select(*keys, F.schema_of_variant("v").startswith("OBJECT").alias("is_object"), F.to_json("v").alias("whole"))
    return tops.join(best, keys, "left")


def json_records(pages: DataFrame) -> DataFrame:
    """Rows (page_id, kind, record, json): the records of linked data (of each block the longest list, else the block itself) and of the script with the longest list."""
    keys = [PAGE, "script", "linked_data"]
    arrays = record_arrays(scripts(pages), keys, "body")
    linked = arrays.filter("linked_data").select(PAGE, "script", F.when(F.size("records") > 0, F.col("records")).when(F.col("is_object"), F.array("whole")).alias("records"))
    linked = linked.select(PAGE, F.lit("json_ld").alias("kind"), "script", F.posexplode("records").alias("pos", "json"))
    embedded = arrays.filter("NOT linked_data AND size(records) > 0").withColumn("place", F.row_number().over(Window.partitionBy(PAGE).orderBy(F.desc(F.size("records")), "script")))
    embedded = embedded.filter("place = 1").select(PAGE, F.lit("embedded_json").alias("kind"), "script", F.posexplode("records").alias("pos", "json"))
    both = linked.unionByName(embedded)
    return both.select(PAGE, "kind", (F.row_number().over(Window.partitionBy(PAGE, "kind").orderBy("script", "pos")) - 1).alias("record"), "json")


def json_sources(records: DataFrame) -> DataFrame:
    """Per page and kind: the number of records, the keys of the first 200 in the order they come, whether one of them is an id."""
    keys = records.filter("record < 200").select(PAGE, "kind", "record", F.posexplode(F.json_object_keys("json")).alias("pos", "name"))
    keys = keys.groupBy(PAGE, "kind", "name").agg(F.min(F.struct("record", "pos")).alias("at")).groupBy(PAGE, "kind").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("keys"))
    keys = keys.select(PAGE, "kind", F.transform("keys", lambda k: k["name"]).alias("keys"))
    counts = records.groupBy(PAGE, "kind").agg(F.count(F.lit(1)).alias("records")).join(keys, [PAGE, "kind"], "left")
    named = F.when(F.col("kind") == "json_ld", F.exists("keys", lambda k: F.lower(k).isin("@id", "id", "sku"))).otherwise(F.exists("keys", lambda k: F.lower(k).contains("id")))
    return counts.filter((F.col("kind") == "json_ld") | (F.col("records") >= MEMBERS)).select(PAGE, "kind", "records", F.slice("keys", 1, 20).alias("fields"), F.coalesce(named, F.lit(False)).alias("stable_ids"))


def _weight(confidence: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in WEIGHT.items() for x in pair)), confidence)


def recommended(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every source of each page (page_id, url, html), best first: page_id, rank, kind, location, records, fields, stable_ids, confidence, selected, evidence.

    Sources whose records are counted come first, by confidence and number of records; the
    first of them is selected. Addresses of interfaces, three at most, can't be counted
    without a request and stand behind as alternatives.
    """
    groups = repeated(nodes, 1)
    cards = groups.join(proposed_fields(nodes, groups), [PAGE, "place"]).join(stable_ids(nodes, groups), [PAGE, "place"])
    cards = cards.select(
        PAGE, F.lit("repeated_dom").alias("kind"), F.lit(1).alias("turn"), F.col("signature").alias("location"), F.col("members").alias("records"), F.transform("fields", lambda f: f["name"]).alias("fields"), "stable_ids",
        F.when(F.col("members") >= SURE, "high").otherwise("medium").alias("confidence"),
    )
    data = json_sources(json_records(pages))
    data = data.select(
        PAGE, "kind", F.when(F.col("kind") == "json_ld", 2).otherwise(3).alias("turn"), F.when(F.col("kind") == "json_ld", "script[type=application/ld+json]").otherwise("script").alias("location"), "records", "fields", "stable_ids",
        F.when((F.col("kind") == "json_ld") & (F.col("records") < MEMBERS), "medium").otherwise("high").alias("confidence"),
    )
    addresses = crawl.candidates(pages)
    order = Window.partitionBy(PAGE).orderBy(F.desc(_weight(F.col("confidence"))), "candidate")
    addresses = addresses.withColumn("turn", F.row_number().over(order) + 3).filter("turn <= 6").select(
        PAGE, F.lit("api").alias("kind"), "turn", F.col("candidate").alias("location"), F.lit(None).cast("long").alias("records"), F.array().cast("array<string>").alias("fields"), F.lit(False).alias("stable_ids"), "confidence"
    )
    every = cards.unionByName(data).unionByName(addresses)
    counted = F.col("records").isNotNull()
    place = F.row_number().over(Window.partitionBy(PAGE).orderBy(F.desc(counted), F.when(counted, -_weight(F.col("confidence"))).otherwise(0), F.desc("records"), "turn"))
    evidence = F.when(counted, F.concat_ws(" ", F.col("records").cast("string"), F.lit("records with"), F.concat_ws(", ", F.slice("fields", 1, 8)))).otherwise(F.concat(F.lit("not requested yet, confidence "), "confidence"))
    out = every.withColumn("rank", place)
    return out.select(PAGE, "rank", "kind", "location", "records", "fields", "stable_ids", "confidence", (counted & (F.col("rank") == 1)).alias("selected"), evidence.alias("evidence"))
