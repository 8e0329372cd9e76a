"""Pages as rows: elements with interval labels, made from the stream of tags by running sums.

A page is cut into tags and texts (markup, in order of place). Start and end tags of one
name nest among themselves, so a running sum per name says at which level each stands,
and the next end tag of a level closes its element. From the pairs, a running sum over the
page gives the depth; sums of lengths give the text below every element. No tree is built:
what lies in an element lies between its `pre` and its `post`.

Defined results:
* an end tag closes the nearest open element of its name; one without an open element is
  skipped; an element without an end tag has nothing inside, like void ones;
* comments, declarations, and what lies in script, style, noscript, template, svg and head
  are left out; text is read with its character references and single spaces;
* a tag with more than QUOTED quoted values, or without an end, is read as text;
* null pages and pages without tags have no elements; pages of the same id are not told apart.

A page is one row of the input, and its tags meet in one task: the windows are over pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without content, and those whose content is left out.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SKIPPED = ("script", "style", "noscript", "template", "svg", "head")
#: Quoted values of a tag at most: the pattern engine recurses for each.
QUOTED = 500
_ATTRIBUTES = rf"""[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+){{0,{QUOTED}}}+"""
#: The character references that are read by name; the ampersand comes last.
REFERENCES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€", "&pound;": "£", "&times;": "×", "&deg;": "°", "&amp;": "&",
}
PAGE = "page_id"


def _token(skipped: tuple[str, ...]) -> str:
    """The pattern of a token: a comment, an element that is skipped with its content, a tag, a declaration, or text."""
    return rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(skipped)})\b{_ATTRIBUTES}>.*?(?:</\1\s*+>|\z)|</?[a-z]{_ATTRIBUTES}>|<[!?][^>]*+>|[^<]++|<"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(pattern: str, digits: int, *starts: str):
    """Reads the references by number that a pattern finds."""

    def char(n: Column) -> Column:
        code = F.conv(n, digits, 10).cast("long")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.conv(n, digits, 16), 8, "0")), "UTF-32")).otherwise("\N{REPLACEMENT CHARACTER}")

    def read(done: Column, n: Column) -> Column:
        return reduce(lambda t, start: F.replace(t, F.concat(F.lit(start), n, F.lit(";")), char(n)), starts, done)

    return lambda text: F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), text, read)


def unescaped(text: Column) -> Column:
    """Text with its character references read: those by number, and the named ones of REFERENCES."""
    pairs = F.lit([list(x) for x in REFERENCES.items()])
    named = lambda t: F.aggregate(pairs, t, lambda done, x: F.replace(done, F.get(x, F.lit(0)), F.get(x, F.lit(1))))
    numbered = lambda t: _let(_numbered(r"&#([0-9]{1,7});", 10, "&#")(t), _numbered(r"&#[xX]([0-9A-Fa-f]{1,6});", 16, "&#x", "&#X"))
    return _let(text, lambda t: F.when(t.contains("&#"), named(numbered(t))).when(t.contains("&"), named(t)).otherwise(t))


ATTRIBUTE = r"""[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def _value(text: Column) -> Column:
    """The value of `name=value`, without quotes and with its references read; empty where there is none."""
    value = F.regexp_extract(text, r"(?s)^[^=]*=\s*(.*)$", 1)
    return _let(value, lambda v: unescaped(F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, the first of equal names; empty where it has none."""
    each = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0)
    own = F.get(F.filter(each, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name), F.lit(0))
    return _value(F.coalesce(own, F.lit("")))


def attributes(tag: Column) -> Column:
    """All attributes of a tag as a map from lower-case names, the first of equal names."""
    each = F.slice(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0), 2, 1 << 30)
    named = F.transform(each, lambda a: F.struct(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("key"), _value(a).alias("value")))
    once = lambda pairs: F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(_let(named, once))


def tokens(pages: DataFrame, html_col: str = "html", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Rows (page_id, pos, token, name): the tags, texts and skipped elements of pages (page_id, html); the name of texts is empty."""
    rows = pages.select(PAGE, F.posexplode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_token(skipped)), 0)).alias("pos", "token"))
    return rows.withColumn("name", F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1))).filter(~F.col("token").rlike("^<[!?]"))


def stream(pages: DataFrame, html_col: str = "html", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Rows (page_id, pos, token, name, kind): the tags and texts of pages (page_id, html). kind is 1 for a start tag, -1 for an end tag, 0 for an element without content, null for text."""
    rows = tokens(pages, html_col, skipped).filter(~F.col("name").isin(*skipped))
    leaf = F.col("name").isin(*VOID) | F.col("token").endswith("/>")
    return rows.withColumn("kind", F.when(F.col("name") == "", None).when(F.col("token").startswith("</"), F.when(F.col("name").isin(*VOID), None).otherwise(-1)).when(leaf, 0).otherwise(1))


def texts(rows: DataFrame) -> DataFrame:
    """Rows (page_id, pos, text) of a stream: texts that aren't blank."""
    text = F.trim(F.regexp_replace(unescaped(F.col("token")), r"[\s ]+", " "))
    return rows.filter("name = ''").select(PAGE, "pos", text.alias("text")).filter("text <> ''")


def elements(pages: DataFrame, html_col: str = "html", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Rows (page_id, pre, post, depth, parent, tag, signature, token, text_len) of every element; depth is 1 and parent null at the top.

    One shuffle by page carries all windows.
    """
    rows = stream(pages, html_col, skipped).repartition(PAGE)
    text = F.trim(F.regexp_replace(unescaped(F.col("token")), r"[\s ]+", " "))
    rows = rows.withColumn("size", F.when(F.col("name") == "", F.length(text)).otherwise(0))
    here = Window.partitionBy(PAGE).orderBy("pos")
    rows = rows.withColumn("sizes", F.sum("size").over(here)).withColumn("parts", F.sum((F.col("size") > 0).cast("int")).over(here))
    rows = rows.filter("kind IS NOT NULL").drop("size")
    # levels among tags of one name; sums that fall below what they had been stand for end tags that close nothing
    named = Window.partitionBy(PAGE, "name").orderBy("pos")
    rows = rows.withColumn("sum", F.sum("kind").over(named)).withColumn("level", F.col("sum") - F.least(F.min("sum").over(named), F.lit(0)))
    before = F.coalesce(F.lag("level").over(named), F.lit(0))
    rows = rows.withColumn("pair", F.when(F.col("kind") == 1, F.col("level")).when((F.col("kind") == -1) & (before > 0), before)).filter("kind = 0 OR pair IS NOT NULL")
    paired = Window.partitionBy(PAGE, "name", "pair").orderBy("pos")
    follows = F.lead(F.struct("kind", "pos", "sizes", "parts")).over(paired)
    rows = rows.withColumn("end", F.when((F.col("kind") == 1) & (follows["kind"] == -1), follows))
    opened = F.when(F.col("end").isNotNull(), 1).when(F.col("kind") == -1, -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(opened).over(here) - opened + 1).filter("kind >= 0")
    classes = F.array_sort(F.filter(F.split(attribute(F.col("token"), "class"), r"\s+"), lambda c: c != ""))
    length = F.coalesce(F.col("end.sizes") - F.col("sizes") + F.greatest(F.col("end.parts") - F.col("parts") - 1, F.lit(0)), F.lit(0))
    rows = rows.select(
        PAGE, F.col("pos").alias("pre"), F.coalesce("end.pos", "pos").alias("post"), F.col("depth").cast("int").alias("depth"), F.col("name").alias("tag"),
        F.concat_ws(".", "name", classes).alias("signature"), "token", length.cast("int").alias("text_len"),
    )
    # the parent is the last element one step up: every element stands once among its like and once among those below it
    both = rows.withColumn("key", F.explode(F.array("depth", F.col("depth") + 1)))
    last = F.last(F.when(F.col("key") > F.col("depth"), F.col("pre")), ignorenulls=True).over(Window.partitionBy(PAGE, "key").orderBy("pre"))
    return both.withColumn("parent", last).filter("key = depth").drop("key")


def inside(rows: DataFrame, place: str, spans: DataFrame, keys: list[str], own: bool = False) -> DataFrame:
    """Rows (page_id, `place`, ...) joined with the span (keys, pre, post, ...) that holds them; spans of equal keys don't overlap, and page_id is one of the keys.

    Rows and spans of a page are merged in order of place, so no row meets all spans. own:
    the place at which a span begins counts as inside.
    """
    groups = spans.select(*keys).distinct()
    named = rows.select(PAGE, F.col(place).alias("at"), F.struct(*rows.columns).alias("row")).join(groups, PAGE)
    spans = spans.select(*keys, F.col("pre").alias("at"), F.struct(*[c for c in spans.columns if c not in keys]).alias("span"))
    merged = named.unionByName(spans, allowMissingColumns=True)
    # at equal places the span comes first where its own place counts, else last
    order = F.col("row").isNotNull().cast("int") if own else F.col("span").isNotNull().cast("int")
    held = F.last("span", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at", order))
    found = merged.withColumn("span", held).filter("row IS NOT NULL AND span.post >= at")
    return found.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rows.columns if c not in keys], *[F.col(f"span.{c}").alias(f"span_{c}") for c in spans.schema["span"].dataType.names])
