"""Queries over pages as rows: elements, repeated groups, entities, fields, datasets, JSON records, recommended sources.

The pages are the table's own. What few of them have (cards, structured data, declared
interfaces) is planted at their ends, from their numbers; both sides plant the same.
The SQL finds what lies in an element by comparing places, not by merging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import summary
from lakeprobe.operators import assets, markup, sources
from lakeprobe.session import saved, table

#: Planted text; `i` counts from 1, both dialects read it.
CARD = (
    """'<div class="card big" data-id="' || i || '"><h2>Item ' || i || ' of ' || page_id || '</h2><a href="../item/' || i || '">more &amp; more</a>' || CASE WHEN i % 2 = 0 THEN '<img alt="pic ' || i || '" src="i' || i || '.png">' ELSE '' END"""
    """ || CASE WHEN i % 3 = 0 THEN '<time datetime="2024-01-0' || i || '">day</time>' ELSE '' END || '<span class="the price">' || i * 3 || ' &euro;</span></div>'"""
)
LINKED = """'{"@id":"a' || i || '","name":"n"}'"""
STATE = """'{"itemId":' || i || ',"tags":[{"t":1}]}'"""


def _planted(each) -> str:
    """What is planted at the end of a page; each(text, number) repeats a text so many times."""
    return f"""'<section class="list">' || {each(CARD, "page_id % 9", "")} || '</section>'
      || CASE page_id % 3 WHEN 0 THEN '<script type="application/ld+json">[' || {each(LINKED, "page_id % 5", ",")} || ']</script>' WHEN 1 THEN '<script type="application/ld+json"> {{"@type":"Thing","sku":5}} </script>' ELSE '' END
      || CASE WHEN page_id % 20 = 1 THEN '<script>{{"state": oops</script>' WHEN page_id % 4 = 1 THEN '<script>{{"other":[1,2],"state":{{"items":[' || {each(STATE, "page_id % 7", ",")} || ']}}}}</script>' ELSE '' END
      || CASE WHEN page_id % 6 = 0 THEN '<link rel="alternate" type="application/json" href="/api/v1/p/' || page_id || '">' ELSE '' END"""


def _spark_each(text: str, number: str, between: str) -> str:
    return f"array_join(transform(slice(sequence(1, 9), 1, CAST({number} AS INT)), i -> {text}), '{between}')"


def _duck_each(text: str, number: str, between: str) -> str:
    return f"coalesce(array_to_string(list_transform(range(1, {number} + 1), lambda i: {text}), '{between}'), '')"


def planted(spark: SparkSession, d: str) -> DataFrame:
    """The pages with what is planted at their ends."""
    return table(spark, d, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.expr(_planted(_spark_each))).alias("html"))


def nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = planted(spark, d)
    return pages, saved(markup.elements(pages), "elements")


def repeated(spark: SparkSession, d: str) -> DataFrame:
    found = sources.repeated(nodes(spark, d)[1])
    return found.select("page_id", "place", "signature", "members", F.round("avg_text", 4).alias("avg_text"), F.round("score", 4).alias("score"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    pages, found = nodes(spark, d)
    groups = saved(sources.entity_groups(found), "groups")
    return sources.entities(found, groups, sources.items(pages, found, groups)).select("page_id", "place", "signature", "container", "items", "fields", "confidence")


def dataset(spark: SparkSession, d: str) -> DataFrame:
    pages, found = nodes(spark, d)
    groups = saved(sources.entity_groups(found), "groups")
    rows = saved(sources.items(pages, found, groups), "items")
    return sources.dataset(rows, sources.entities(found, groups, rows))


def proposed(spark: SparkSession, d: str) -> DataFrame:
    found = nodes(spark, d)[1]
    groups = sources.repeated(found)
    return sources.proposed_fields(found, groups).select("page_id", "place", F.posexplode("fields").alias("pos", "f")).select("page_id", "place", "pos", "f.*")


def recommended(spark: SparkSession, d: str) -> DataFrame:
    return sources.recommended(*nodes(spark, d)).withColumn("fields", F.concat_ws(",", "fields"))


#: Planted at the ends of pages, by number: declarations, forms, images.
DECLARED = (
    """'<link rel="canonical" href="/c/' || page_id || '"><link rel="Canonical x" href="/d"><link rel=alternate type="application/rss+xml" href="feed.xml" title="Feed"><link rel="alternate" type="application/activity+json" href="//o.example/j">'""",
    """'<meta name="Description" content="d ' || page_id || '"><meta property="og:title" content="t"><meta name="x"><form action="/send" method="POST"><input name="q" type="search"><select name=s></select><textarea></textarea></form>'""",
    """'<img src="../i.png" alt="an &amp; image"><img alt="none"><form><input></form><h2>Second <i>' || page_id || '</i></h2><h3> </h3><a href="http://other.example:80/x" rel="nofollow">out</a><a>none</a>'""",
)


def declaring(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE page_id % 3 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(DECLARED)) + " END")
    return table(spark, d, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), text).alias("html"))


def shown(spark: SparkSession, d: str) -> DataFrame:
    return assets.assets(declaring(spark, d)).select("page_id", "kind", F.when(F.col("kind") != "field", F.col("url")).alias("url"), "label", "extra")


def inner_links(spark: SparkSession, d: str) -> DataFrame:
    pages = declaring(spark, d)
    return assets.internal(assets.assets(pages), pages).groupBy("page_id").agg(F.count_if("internal").alias("inside"), F.count_if(~F.col("internal")).alias("outside"))


def counted(spark: SparkSession, d: str) -> DataFrame:
    found = nodes(spark, d)[1]
    return summary.page_counts(found, sources.entity_groups(found))


QUERIES = {
    "page_assets": shown,
    "page_links_inside": inner_links,
    "page_counts_by_tag": counted,
    "page_elements": lambda s, d: markup.elements(table(s, d, "pages")).drop("token"),
    "page_repeated_groups": repeated,
    "page_entities": entities,
    "page_entity_dataset": dataset,
    "page_field_proposals": proposed,
    "page_json_records": lambda s, d: sources.json_records(planted(s, d)).withColumn("json", F.expr("to_json(parse_json(json))")),
    "page_sources": recommended,
}

_SKIP = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in markup.SKIPPED)
_TAGS = rf"(?is)<!--.*?-->|{_SKIP}|</?[a-z](?:\"[^\"]*\"|''[^'']*''|[^''\">])*>|<[!?][^>]*>|[^<]+|<".replace('\\"', '"')
_VOID = ", ".join(f"'{t}'" for t in markup.VOID)


def _plain(text: str) -> str:
    """Text with the character references that the table's pages have."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&euro;", "€"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return rf"trim(regexp_replace({text}, '[\s ]+', ' ', 'g'))"


def _attribute(name: str) -> str:
    return f"regexp_extract(token, '\\s{name}=\"([^\"]*)\"', 1)"


def elements_sql(html: str) -> str:
    """CTEs up to `e`, the elements of pages, and `x`, their texts."""
    return rf"""
source AS (SELECT page_id, url, {html} AS html FROM pages),
cut AS (SELECT page_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{_TAGS}') AS l FROM source)),
named AS (SELECT *, lower(regexp_extract(token, '^</?([A-Za-z][^\s/>]*)', 1)) AS name FROM cut WHERE NOT regexp_matches(token, '^<[!?]')),
kinds AS (
  SELECT *, CASE WHEN name = '' THEN {_plain("token")} ELSE '' END AS text, CASE WHEN name = '' THEN NULL WHEN token LIKE '</%' THEN CASE WHEN name IN ({_VOID}) THEN NULL ELSE -1 END WHEN name IN ({_VOID}) OR token LIKE '%/>' THEN 0 ELSE 1 END AS kind
  FROM named WHERE name NOT IN {markup.SKIPPED}),
x AS (SELECT page_id, pos, text FROM kinds WHERE text <> ''),
run AS (SELECT *, sum(kind) OVER w AS s FROM kinds WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY page_id, name ORDER BY pos)),
leveled AS (SELECT *, s - least(min(s) OVER w, 0) AS level FROM run WINDOW w AS (PARTITION BY page_id, name ORDER BY pos)),
tagged AS (SELECT *, CASE kind WHEN 1 THEN level WHEN -1 THEN coalesce(lag(level) OVER w, 0) END AS pair FROM leveled WINDOW w AS (PARTITION BY page_id, name ORDER BY pos)),
closed AS (SELECT *, CASE WHEN kind = 1 AND lead(kind) OVER w = -1 THEN lead(pos) OVER w END AS fin FROM tagged WHERE kind = 0 OR pair > 0 WINDOW w AS (PARTITION BY page_id, name, pair ORDER BY pos)),
deep AS (SELECT *, coalesce(sum(CASE WHEN fin IS NOT NULL THEN 1 WHEN kind = -1 THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS depth FROM closed),
starts AS (SELECT page_id, pos AS pre, coalesce(fin, pos) AS post, depth::INT AS depth, name AS tag, token,
  array_to_string(list_concat([name], list_sort(list_filter(string_split({_attribute("class")}, ' '), lambda c: c <> ''))), '.') AS signature FROM deep WHERE kind >= 0),
sized AS (SELECT s.*, coalesce((SELECT sum(length(text)) + count(*) - 1 FROM x WHERE x.page_id = s.page_id AND x.pos BETWEEN s.pre AND s.post), 0)::INT AS text_len FROM starts AS s),
e AS (SELECT s.*, (SELECT max(p.pre) FROM starts AS p WHERE p.page_id = s.page_id AND p.depth = s.depth - 1 AND p.pre < s.pre) AS parent FROM sized AS s)"""


_PLANTED = f"coalesce(html, '') || {_planted(_duck_each)}"
_GROUPS = """
sib AS (SELECT page_id, parent, depth - 1 AS up, signature, any_value(tag) AS tag, count(*) AS members, sum(text_len) / count(*) AS avg_text, sum(text_len::BIGINT * text_len) AS squares, min(pre) AS first FROM e GROUP BY ALL)"""


def _ranked(rows: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, parent NULLS FIRST, first) AS place
  FROM (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY page_id, signature ORDER BY score DESC, parent NULLS FIRST, first) = 1) QUALIFY place <= 5)"""


_REPEATED = _GROUPS + ", g AS " + _ranked("SELECT *, members * least(avg_text, 200) / 200 AS score FROM sib WHERE members >= 3 AND up <= 40 AND avg_text >= 1")
_ENTITY = _GROUPS + ", g AS " + _ranked(
    f"""SELECT sib.*, coalesce(c.signature, '#root') AS container, members * least(avg_text, 200) / 200 * (1 / (1 + sqrt(greatest(squares / members - avg_text * avg_text, 0)) / (avg_text + 1))) AS score
    FROM sib LEFT JOIN e AS c ON c.page_id = sib.page_id AND c.pre = sib.parent WHERE members >= 3 AND avg_text > 0 AND sib.tag NOT IN ({_VOID}) AND (sib.parent IS NULL OR c.tag IN {sources.CONTAINERS})"""
)


def _text(inside: str, most: int) -> str:
    return f"(SELECT substring(string_agg(x.text, ' ' ORDER BY x.pos), 1, {most}) FROM x WHERE x.page_id = m.page_id AND x.pos BETWEEN {inside}.pre AND {inside}.post)"


def _first(what: str, condition: str) -> str:
    return f"(SELECT {what} FROM e AS n WHERE n.page_id = m.page_id AND n.pre > m.pre AND n.pre <= m.post AND {condition} ORDER BY n.pre LIMIT 1)"


def _resolved(href: str) -> str:
    """The table's links start with a slash; the planted ones with `../` or a file's name."""
    base = "regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)"
    folder = r"regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/[^/]*$', '')"
    return f"CASE WHEN {href} LIKE '/%' THEN {base} || {href} WHEN {href} LIKE '../%' THEN {base} || regexp_replace({folder}, '/[^/]*$', '') || {href}[3:] WHEN {href} IS NOT NULL THEN {base} || {folder} || '/' || {href} END"


_ITEMS = (
    _ENTITY
    + f""",
m AS (SELECT g.place, e.*, row_number() OVER (PARTITION BY e.page_id, g.place ORDER BY e.pre) AS nth FROM e JOIN g ON e.page_id = g.page_id AND e.signature = g.signature AND e.parent IS NOT DISTINCT FROM g.parent),
raw AS (SELECT m.page_id, m.place, m.nth - 1 AS item, {_text("m", 400)} AS text,
  {_first("[n.pre, n.post]", f"(n.tag IN ('h1', 'h2', 'h3', 'h4', 'h5') OR (n.tag = 'a' AND {_attribute('href').replace('token', 'n.token')} <> '')) AND n.text_len > 0")} AS t,
  {_first(_attribute("href").replace("token", "n.token"), "n.tag = 'a' AND " + _attribute("href").replace("token", "n.token") + " <> ''")} AS href,
  {_first(_attribute("src").replace("token", "n.token"), "n.tag = 'img'")} AS src, {_first(_attribute("alt").replace("token", "n.token"), "n.tag = 'img'")} AS alt, {_first(_attribute("datetime").replace("token", "n.token"), "n.tag = 'time'")} AS date
  FROM m WHERE m.nth <= 200),
item AS (SELECT page_id, place, item, (SELECT substring(string_agg(x.text, ' ' ORDER BY x.pos), 1, 200) FROM x WHERE x.page_id = raw.page_id AND x.pos BETWEEN raw.t[1] AND raw.t[2]) AS title,
  {_resolved("href")} AS link, {_resolved("src")} AS image, alt, date, text FROM raw JOIN source USING (page_id) WHERE t IS NOT NULL OR text IS NOT NULL),
found AS (SELECT page_id, place, count(*) AS items, list_sort(list_filter([CASE WHEN 2 * count(title) >= count(*) THEN 'title' END, CASE WHEN 2 * count(link) >= count(*) THEN 'link' END, CASE WHEN 2 * count(image) >= count(*) THEN 'image' END,
  CASE WHEN 2 * count(alt) >= count(*) THEN 'alt' END, CASE WHEN 2 * count(date) >= count(*) THEN 'date' END, CASE WHEN 2 * count(text) >= count(*) THEN 'text' END], lambda f: f IS NOT NULL)) AS fields FROM item GROUP BY ALL HAVING count(*) >= 3)"""
)
_PROPOSED = f""",
one AS (SELECT g.page_id, g.place, e.pre, e.post FROM g JOIN e ON e.page_id = g.page_id AND e.pre = g.first),
flag AS (SELECT o.page_id, o.place, min(CASE WHEN regexp_matches(n.tag, '^h[1-6]$') THEN n.tag END) AS h, bool_or(n.tag = 'a') AS a, bool_or(n.tag = 'a' AND n.token LIKE '% href=%') AS href, bool_or(n.tag = 'img') AS img, bool_or(contains({_attribute("class").replace("token", "n.token")}, 'price')) AS price
  FROM one AS o JOIN e AS n ON n.page_id = o.page_id AND n.pre BETWEEN o.pre AND o.post GROUP BY ALL),
offer AS (SELECT page_id, place, CASE WHEN len(f) > 0 THEN f ELSE [['text', '', 'text', 'normalize_ws']] END AS f FROM (SELECT *, list_filter([CASE WHEN h IS NOT NULL THEN ['title', h, 'text', 'normalize_ws'] WHEN a THEN ['title', 'a', 'text', 'normalize_ws'] END,
  CASE WHEN href THEN ['link', 'a', 'url', 'none'] END, CASE WHEN img THEN ['image', 'img', 'image', 'none'] END, CASE WHEN price THEN ['price', '[class*=price]', 'text', 'number'] END], lambda y: y IS NOT NULL) AS f FROM flag))"""
#: What is planted as JSON, by page number.
_JSON = """
j AS (SELECT page_id, 'json_ld' AS kind, unnest(range(page_id % 5)) AS record, '{"@id":"a' || (record + 1) || '","name":"n"}' AS json FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 'json_ld', 0, '{"@type":"Thing","sku":5}' FROM pages WHERE page_id % 3 = 1
  UNION ALL SELECT page_id, 'embedded_json', unnest(range(page_id % 7)) AS r, '{"itemId":' || (r + 1) || ',"tags":[{"t":1}]}' FROM pages WHERE page_id % 4 = 1 AND page_id % 20 <> 1)"""
_ORIGIN = "regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)"
_LINKED = r"""k AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)"""
ORACLES = {
    "page_assets": rf"""WITH {_LINKED}
        SELECT page_id, 'link' AS kind, {_ORIGIN} || replace(href, '&amp;', '&') AS url, trim(regexp_replace(replace(label, '&amp;', '&'), '\s+', ' ', 'g')) AS label, NULL::VARCHAR AS extra FROM k
        UNION ALL SELECT page_id, 'link', 'http://other.example:80/x', 'out', 'nofollow' FROM pages WHERE page_id % 3 = 2
        UNION ALL SELECT page_id, 'image', {_ORIGIN} || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/[^/]*$', ''), '/[^/]*$', '') || '/i.png', 'an & image', NULL FROM pages WHERE page_id % 3 = 2
        UNION ALL SELECT page_id, 'heading', NULL, substring({_plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, 1, 300), 'h1' FROM pages
        UNION ALL SELECT page_id, 'heading', NULL, 'Second ' || page_id, 'h2' FROM pages WHERE page_id % 3 = 2
        UNION ALL SELECT page_id, 'title', NULL, substring({_plain("regexp_extract(html, '<title>(.*?)</title>', 1)")}, 1, 1000), NULL FROM pages
        UNION ALL SELECT page_id, 'lang', NULL, regexp_extract(html, '<html lang="([^"]*)"', 1), NULL FROM pages
        UNION ALL SELECT page_id, 'meta', NULL, 'd ' || page_id, 'description' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'meta', NULL, 't', 'og:title' FROM pages WHERE page_id % 3 = 1
        UNION ALL SELECT page_id, 'canonical', {_ORIGIN} || '/d', NULL, NULL FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 'feed', {_ORIGIN} || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/[^/]*$', '') || '/feed.xml', 'Feed', 'application/rss+xml' FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 'alternate_json', split_part(url, ':', 1) || '://o.example/j', NULL, 'application/activity+json' FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 'form', {_ORIGIN} || '/send', NULL, 'post' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'form', url, NULL, 'get' FROM pages WHERE page_id % 3 = 2
        UNION ALL SELECT page_id, 'field', NULL, unnest(['q', 's', NULL]), unnest(['search', 'select', 'textarea']) FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'field', NULL, NULL, 'input' FROM pages WHERE page_id % 3 = 2
        UNION ALL SELECT page_id, 'script', NULL, regexp_extract(html, '(?s)<script>(.*?)</script>', 1), NULL FROM pages""",
    "page_links_inside": f"WITH {_LINKED} SELECT page_id, count(href) AS inside, any_value(CASE WHEN page_id % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS outside FROM pages LEFT JOIN k USING (page_id) GROUP BY 1 HAVING inside + outside > 0",
    "page_counts_by_tag": f"""WITH {elements_sql(_PLANTED)}, {_ENTITY}, n AS (SELECT page_id, count(*) FILTER (tag = 'table') AS tables, count(*) FILTER (tag = 'a' AND token LIKE '% href="_%') AS links, count(*) FILTER (tag = 'img' AND token LIKE '% src="_%') AS images,
        count(*) FILTER (regexp_matches(tag, '^h[1-6]$')) AS headings, count(*) FILTER (tag = 'form') AS forms FROM e GROUP BY 1) SELECT n.*, (SELECT count(*) FROM g WHERE g.page_id = n.page_id) AS groups FROM n""",
    "page_elements": f"WITH {elements_sql("coalesce(html, '')")} SELECT page_id, pre::INT AS pre, post::INT AS post, depth, tag, signature, text_len, parent::INT AS parent FROM e",
    "page_repeated_groups": f"WITH {elements_sql(_PLANTED)}, {_REPEATED} SELECT page_id, place::INT AS place, signature, members, round(avg_text, 4) AS avg_text, round(score, 4) AS score FROM g",
    "page_entities": f"WITH {elements_sql(_PLANTED)}, {_ITEMS} SELECT page_id, place::INT AS place, signature, container, items, fields, round(least(1.0, score / 20), 2) AS confidence FROM g JOIN found USING (page_id, place)",
    "page_entity_dataset": f"""WITH {elements_sql(_PLANTED)}, {_ITEMS}, cells AS (SELECT page_id, place, item, unnest(['title', 'link', 'image', 'alt', 'date', 'text']) AS field, unnest([title, link, image, alt, date, text]) AS value FROM item)
        SELECT page_id, place::INT AS place, item::INT AS item, field, coalesce(value, '') AS value FROM cells JOIN found USING (page_id, place) WHERE list_contains(fields, field)""",
    "page_field_proposals": f"WITH {elements_sql(_PLANTED)}, {_REPEATED} {_PROPOSED}, o AS (SELECT page_id, place, unnest(range(len(f))) AS pos, unnest(f) AS f FROM offer) SELECT page_id, place::INT AS place, pos::INT AS pos, f[1] AS name, f[2] AS selector, f[3] AS source, f[4] AS transform FROM o",
    "page_json_records": f"WITH {_JSON} SELECT page_id, kind, record::INT AS record, json FROM j",
    "page_sources": f"""WITH {elements_sql(_PLANTED)}, {_REPEATED} {_PROPOSED}, {_JSON},
        ids AS (SELECT g.page_id, bool_or(e.token LIKE '% id=%' OR e.token LIKE '% data-id=%') AS stable FROM g JOIN e ON e.page_id = g.page_id AND e.signature = g.signature AND e.parent IS NOT DISTINCT FROM g.parent
          WHERE g.place = 1 AND (SELECT count(*) FROM e AS b WHERE b.page_id = e.page_id AND b.signature = e.signature AND b.parent IS NOT DISTINCT FROM e.parent AND b.pre < e.pre) < 6 GROUP BY ALL),
        c AS (SELECT g.page_id, 'repeated_dom' AS kind, 1 AS turn, g.signature AS location, members AS records, list_transform(f, lambda y: y[1]) AS fields, stable AS stable_ids, CASE WHEN members >= 6 THEN 'high' ELSE 'medium' END AS confidence
            FROM g JOIN offer USING (page_id, place) JOIN ids ON ids.page_id = g.page_id WHERE place = 1
          UNION ALL SELECT page_id, kind, 2, 'script[type=application/ld+json]', count(*), CASE WHEN page_id % 3 = 0 THEN ['@id', 'name'] ELSE ['@type', 'sku'] END, true, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END FROM j WHERE kind = 'json_ld' GROUP BY ALL
          UNION ALL SELECT page_id, kind, 3, 'script', count(*), ['itemId', 'tags'], true, 'high' FROM j WHERE kind = 'embedded_json' GROUP BY ALL HAVING count(*) >= 3
          UNION ALL SELECT page_id, 'api', 4, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/api/v1/p/' || page_id, NULL, [], false, 'high' FROM pages WHERE page_id % 6 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY records IS NULL, CASE WHEN records IS NULL THEN 0 ELSE -map {{'high': 3, 'medium': 2, 'low': 1}}[confidence] END, records DESC, turn) AS rank FROM c)
        SELECT page_id, rank::INT AS rank, kind, location, records, array_to_string(fields, ',') AS fields, stable_ids, confidence, records IS NOT NULL AND rank = 1 AS selected,
          CASE WHEN records IS NULL THEN 'not requested yet, confidence ' || confidence ELSE records || ' records with ' || array_to_string(fields[:8], ', ') END AS evidence FROM r""",
}
