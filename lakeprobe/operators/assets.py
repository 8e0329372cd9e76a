"""What a page links to, shows and declares, as rows: links, images, headings, forms, metadata, canonical address, feeds, alternates, scripts.

All of it comes from the page's tags in order (operators/markup.py); texts of links and
headings are what lies between their tags.

Defined results:
* addresses are seen from the page's own; links without an address, images without a
  source, metadata without name or content, and headings without text are left out;
* a field belongs to the last form that began before it, and to none where there is none;
* null pages have no rows; of several canonical addresses the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprobe.functions import urls
from lakeprobe.operators import markup
from lakeprobe.operators.markup import PAGE
from lakeprobe.session import saved

#: Characters kept of a link's text, a heading, a script; elements whose content is left out here.
LINK_TEXT, HEADING_TEXT, SCRIPT_TEXT = 200, 300, 20_000
SKIPPED = ("script", "style", "noscript", "template", "svg")
HEADINGS = tuple(f"h{i}" for i in range(1, 7))


def _row(kind: str, url: Column | None = None, label: Column | None = None, extra: Column | None = None) -> Column:
    given = lambda c, name: (F.lit(None) if c is None else c).cast("string").alias(name)
    return F.struct(F.lit(kind).alias("kind"), given(url, "url"), given(label, "label"), given(extra, "extra"))


def _texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, text, token, tag) of links, headings and titles with their text."""
    nodes = saved(markup.elements(pages, skipped=SKIPPED).filter(F.col("tag").isin("a", "title", *HEADINGS)).select(PAGE, "pre", "post", "token", "tag"), "named")
    rows = markup.texts(markup.stream(pages, skipped=SKIPPED))
    # links may stand in headings: the two are looked at apart
    keyed = lambda df: df.withColumn("of", F.col("tag") == "a")
    found = markup.inside(rows, "pos", keyed(nodes).select(PAGE, "of", "pre", "post"), [PAGE, "of"])
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    found = found.groupBy(PAGE, "span_pre").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    out = nodes.join(found.withColumnRenamed("span_pre", "pre"), [PAGE, "pre"], "left")
    return out.select(PAGE, F.col("pre").alias("pos"), "tag", "token", F.coalesce("text", F.lit("")).alias("text"))


def assets(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, kind, url, label, extra) of pages (page_id, url, html), in the order of the page.

    link: address, text, rel; image: source, alt, title; heading: text in label, level in
    extra; meta: content in label, name in extra; canonical, feed (title, type) and
    alternate_json (type): address; form: action, method in extra; field: name in label,
    type in extra, the form's pos in url; script: text in label; title and lang in label.
    """
    base = pages.select(PAGE, F.col("url").alias("base"))
    # attributes are read into one column before anything asks for them: expressions stay small
    read = lambda rows: rows.withColumn("attributes", markup.attributes(F.col("token")))
    at, c = (lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))), F.col
    some = lambda c: F.nullif(c, F.lit(""))
    named = read(_texts(pages).join(base, PAGE)).withColumn("seen", urls.resolve(c("base"), at("href")))
    named = named.withColumn("row", F.when((c("tag") == "a") & (at("href") != ""), _row("link", c("seen"), F.substring("text", 1, LINK_TEXT), some(at("rel")))).when(
        c("tag").isin(*HEADINGS) & (c("text") != ""), _row("heading", None, F.substring("text", 1, HEADING_TEXT), c("tag"))
    ).when(c("tag") == "title", _row("title", None, c("text"))))

    tags = markup.tokens(pages, skipped=SKIPPED).filter(c("name").isin("img", "html", "meta", "link", "form", "input", "select", "textarea", "script") & ~c("token").startswith("</")).join(base, PAGE)
    tags = read(tags)
    tags = tags.withColumn("seen", urls.resolve(c("base"), F.when(c("name") == "img", at("src")).when(c("name") == "form", at("action")).otherwise(at("href"))))
    order = Window.partitionBy(PAGE).orderBy("pos")
    tags = tags.withColumn("form", F.last(F.when(c("name") == "form", c("pos")), ignorenulls=True).over(order))
    tags = tags.withColumn("rel", F.lower(at("rel"))).withColumn("type", F.lower(at("type")))
    linked = (c("name") == "link") & (at("href") != "")
    alternate = linked & c("rel").contains("alternate")
    name = F.lower(F.coalesce(some(at("name")), some(at("property"))))
    body = F.trim(F.regexp_replace("token", r"(?is)^<script\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*>|</script\s*>$", ""))
    tags = tags.withColumn("body", F.when(c("name") == "script", body))
    tags = tags.withColumn("row", (
        F.when((c("name") == "img") & (at("src") != ""), _row("image", c("seen"), at("alt"), some(at("title"))))
        .when((c("name") == "html") & (at("lang") != ""), _row("lang", None, at("lang")))
        .when((c("name") == "meta") & name.isNotNull() & (at("content") != ""), _row("meta", None, at("content"), name))
        .when(linked & c("rel").contains("canonical"), _row("canonical", c("seen")))
        .when(alternate & (c("type").contains("rss") | c("type").contains("atom")), _row("feed", c("seen"), at("title"), c("type")))
        .when(alternate & c("type").contains("json"), _row("alternate_json", c("seen"), None, c("type")))
        .when(c("name") == "form", _row("form", c("seen"), None, F.lower(F.coalesce(some(at("method")), F.lit("get")))))
        .when(c("name").isin("input", "select", "textarea") & c("form").isNotNull(), _row("field", c("form"), some(at("name")), F.coalesce(some(at("type")), c("name"))))
        .when((c("type") != "application/ld+json") & (c("body") != ""), _row("script", None, F.substring("body", 1, SCRIPT_TEXT)))
    ))
    last = F.max(F.when(c("row.kind") == "canonical", c("pos"))).over(Window.partitionBy(PAGE))
    tags = tags.withColumn("last", last).filter((c("row.kind") != "canonical") | (c("pos") == c("last")))
    both = named.select(PAGE, "pos", "row").unionByName(tags.select(PAGE, "pos", "row"))
    return both.filter("row IS NOT NULL").select(PAGE, "pos", "row.*")


def internal(found: DataFrame, pages: DataFrame) -> DataFrame:
    """The links among assets with whether they stay on the page's host and port."""
    place = lambda c: F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return found.filter("kind = 'link'").join(pages.select(PAGE, F.col("url").alias("base")), PAGE).withColumn("internal", place(F.col("url")) == place(F.col("base"))).drop("base")
