"""Page, URL, crawl and security queries over pages, each with its SQL where SQL can express it.

The links, addresses and texts are the pages' own. What a crawl would add to them
(headers, statuses) is planted, and the SQL states the rules over the same planted values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import net, page, urls
from lakeprobe.operators import crawl
from lakeprobe.session import table

def U():
    """The address column; columns can't be made before there is a session."""
    return F.col("url")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
BARE = f"regexp_replace({HOST}, '^www\\.', '')"
LINK = r"""(?i)<a\s[^>]*href="([^"]*)\""""


#: Planted links with dot segments.
DOTTED = ("/a/../b", "../../../../../../z", "x/./y/..", "/..", ".", "a//b/../c?q=/../x", "/a//b/./c#d/../e", "../../../../../../../../../over", "./", "..")


def dotted(spark: SparkSession, d: str) -> DataFrame:
    """The planted links as seen from a deep page of each page's site."""
    base = F.concat(F.regexp_extract(U(), "^([A-Za-z]+://[^/?#]+)", 1), F.lit("/1/2/3/4/5/6/7/"), F.col("page_id").cast("string"))
    rows = table(spark, d, "pages").select("page_id", base.alias("base"), F.explode(F.array(*map(F.lit, DOTTED))).alias("href"))
    return rows.select("page_id", "href", urls.resolve(F.col("base"), F.col("href")).alias("target"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    external = F.col("href").rlike("(?i)^https?://") & (F.lower(urls.part(F.col("href"), urls.HOST)) != F.lower(urls.part(U(), urls.HOST)))
    return links(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(external).alias("external"), F.count_distinct("href").alias("targets"))


def secret_urls(spark: SparkSession, d: str) -> DataFrame:
    tail = F.concat(F.when(U().contains("?"), "&").otherwise("?"), F.lit("token=t"), F.col("page_id").cast("string"), F.lit("&x=1"))
    return pages(spark, d).select("page_id", F.concat(F.regexp_replace(U(), "#.*$", ""), tail).alias("url"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Links from page n to pages 2n+1, 2n+2 and back to n/3, where they exist."""
    p = pages(spark, d).select(F.col("page_id").alias("src"))
    out = p.select("src", F.explode(F.array(F.col("src") * 2 + 1, F.col("src") * 2 + 2, F.floor(F.col("src") / 3))).alias("dst"))
    return out.join(p.select(F.col("src").alias("dst")), "dst", "left_semi")


def tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of pages at whose end tables of three kinds are planted by turns: with header cells, with a first row of words, with one of numbers."""
    k = F.col("page_id").cast("string")
    row = lambda tag, *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
    kinds = [row("th", F.lit("a"), F.lit(" b  c ")), row("td", F.lit("name"), F.lit("n")), row("td", F.lit("1"), F.lit("2,5"))]
    first = F.get(F.array(*kinds), (F.col("page_id") % 3).cast("int"))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("<table>"), first, row("td", F.concat(F.lit("p"), k)), row("td", k, F.lit("x"), F.lit("<b>y</b>")), F.lit("</table>"))
    return page.parsed(pages(spark, d).select("page_id", "url", html.alias("html"))).select("page_id", F.posexplode("tables").alias("nth", "t")).select("page_id", "nth", "t.header", F.size("t.rows").alias("rows"), F.element_at("t.rows", -1).alias("last"))


def masked_keys(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with a query key each, secret or not by a part of its name."""
    keys = ["refresh_token", "client_secret", "passwd", "pwd2", "x-api-key", "page", "authority", "sig", "design", "monkey"]
    key = F.element_at(F.lit(keys), (F.col("page_id") % len(keys) + 1).cast("int"))
    url = F.concat(F.regexp_extract(U(), "^(https?://[^/?#]+)", 1), F.lit("/a?q=1&"), key, F.lit("=v%20"), F.col("page_id").cast("string"), F.lit("&z=2"))
    return pages(spark, d).select("page_id", urls.mask(url).alias("url"))


def planted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a declared interface, a link to one and two addresses in a script, by turns."""
    k = F.col("page_id")
    extra = (
        F.when(k % 4 == 0, F.concat(F.lit('<link rel="alternate" type="application/json" href="/p/'), k.cast("string"), F.lit('.json">')))
        .when(k % 4 == 1, F.lit('<a class="x" href="/api/v1/items">items</a><a href="/static/api/x.png">no</a>'))
        .when(k % 4 == 2, F.lit('<script>fetch("https://api.example/v2/list"); load("/rest/app.js")</script>')).otherwise("")
    )
    return pages(spark, d).select("page_id", "url", F.concat(F.lit("<html>"), extra, F.lit("</html>")).alias("html"))


def guessed(spark: SparkSession, d: str) -> DataFrame:
    roots = pages(spark, d).select(F.regexp_extract(U(), "^(https?://[^/?#]+)", 1).alias("root")).distinct()
    return roots.select("root", F.explode(F.lit(list(urls.WELL_KNOWN))).alias("path")).select(F.concat("root", "path").alias("candidate"))


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Responses (type, body) of every kind, by turns; every seventh is the page itself."""
    k = F.col("page_id")
    variants = [(t, b) for t, b, _ in BODIES]
    at = (k % 11 + 1).cast("int")
    body = F.when(k % 11 == 10, F.col("html")).otherwise(F.get(F.lit([b for _, b in variants]), (k % 11).cast("int")))
    return pages(spark, d).select("page_id", "url", F.element_at(F.lit([t for t, _ in variants] + ["text/html"]), at).alias("type"), body.alias("body"))


#: Planted responses: content type, body, and what they are.
BODIES = (
    ("application/json", '{"a": 1}', "json"), ("text/plain", '{"a":1}\n{"b":2}', "jsonl"), ("text/csv", "a;b\n1;2\n3;4", "csv"), ("text/plain", "just words", "text"), ("", "", "unknown"), ("image/png", "x", "binary"),
    ("text/html", "<?xml version='1.0'?><r/>", "xml"), ("", "<rss><a/></rss>", "xml"), ("", "  <div>x</div>", "html"), ("application/ld+json", "words", "html"),
)
PASTED = (
    ("curl -X GET https://x.example", "curl"), ("  https://x.example/a?b=1 ", "url"), ("https://x.example two words", "unknown"), ('[{"a": 1}]', "json"), ('{"a": oops}', "unknown"), ("<p>text</p>", "html"), ("", "unknown"), ("curling", "unknown"),
)


def pasted(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.get(F.lit([p for p, _ in PASTED]), (F.col("page_id") % len(PASTED)).cast("int")).alias("raw"))


def next_links(spark: SparkSession, d: str) -> DataFrame:
    """The next page of responses that tell it in five ways, by turns."""
    k = F.col("page_id")
    header = F.when(k % 6 == 0, F.lit('<https://o.example/l?p=1>; rel="prev", </list?p=3>; rel="next"'))
    json = F.when(k % 6 == 1, F.lit('{"links": {"next": "/j?after=9"}, "next": ""}')).when(k % 6 == 2, F.lit('{"next_url": "https://n.example/2", "meta": {"next": "/no"}}'))
    body = F.coalesce(json, F.when(k % 6 == 3, F.lit("<html><link rel='next' href='?p=8'></html>")).otherwise(F.lit("<p>no more</p>")))
    url = F.when(k % 6 == 4, F.concat(F.regexp_extract(U(), "^(https?://[^/?#]+)", 1), F.lit("/s?offset=40&limit=20"))).otherwise(F.concat(F.regexp_extract(U(), "^(https?://[^/?#]+)", 1), F.lit("/dir/s")))
    kind = F.when((k % 6).isin(1, 2), "json").otherwise("html")
    got = pages(spark, d).select("page_id", urls.next_link(url, header, body, kind).alias("n"))
    return got.select("page_id", "n.kind", "n.url")


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a page holds, counted by its markup."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("int")
    images = F.regexp_extract_all("html", F.lit("(?i)<img [^>]*>"), 0)
    hrefs = F.regexp_extract_all("html", F.lit(LINK), 1)
    outside = F.filter(hrefs, lambda h: h.rlike("(?i)^https?://") & (F.lower(urls.part(h, urls.HOST)) != F.lower(urls.part(U(), urls.HOST))))
    return pages(spark, d).withColumn("html", F.coalesce("html", F.lit(""))).select(
        "page_id", F.size(hrefs).alias("links"), F.size(outside).alias("external"), (F.size(hrefs) - F.size(outside)).alias("internal"), F.size(images).alias("images"),
        F.size(F.filter(images, lambda t: ~t.rlike("(?i)[ ]alt=[\"'][^\"']"))).alias("without_alt"), n("(?i)<h[1-6][ >]").alias("headings"), n("(?i)<table[ >]").alias("tables"), n("(?i)<form[ >]").alias("forms"),
        n("(?i)<script[ >]").alias("scripts"),
    )


QUERIES = {
    "page_titles": lambda s, d: pages(s, d).select("page_id", F.substring(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), 1, 200).alias("title")),
    "page_links_regex": lambda s, d: links(s, d).select("page_id", "href"),
    "page_link_counts": link_counts,
    "page_hosts": lambda s, d: pages(s, d).groupBy(urls.bare_host(U()).alias("host")).agg(F.count(F.lit(1)).alias("pages")),
    "url_normalize": lambda s, d: pages(s, d).select("page_id", urls.normalize(F.concat(F.upper(F.substring(U(), 1, 4)), F.expr("substring(url, 5)"))).alias("url")),
    "url_http_form": lambda s, d: pages(s, d).select("page_id", urls.http_form(F.concat(F.regexp_replace(U(), "#.*$", ""), F.lit("%20a b/é#x"))).alias("url")),
    "url_dot_segments": dotted,
    "url_resolve": lambda s, d: links(s, d).select("page_id", "href", urls.resolve(U(), F.col("href")).alias("target")),
    "url_mask_keys": masked_keys,
    "api_candidates": lambda s, d: crawl.candidates(planted_pages(s, d)),
    "api_unknown": lambda s, d: crawl.unknown(crawl.candidates(planted_pages(s, d)).select("candidate"), guessed(s, d), pages(s, d).select(U().alias("candidate"))),
    "next_link": next_links,
    "page_counts": page_counts,
    "source_kind": lambda s, d: bodies(s, d).select("page_id", net.source_kind(F.col("type"), F.col("body")).alias("kind")),
    "input_kind": lambda s, d: pasted(s, d).select("page_id", net.input_kind(F.col("raw")).alias("kind")),
    "charset_header": lambda s, d: pages(s, d).select("page_id", net.charset(F.when(F.col("page_id") % 3 == 0, "text/html; charset=Windows-1251"), F.col("html")).alias("charset")),
    "url_origin": lambda s, d: pages(s, d).select("page_id", urls.origin(U()).alias("origin")),
    "url_mask": lambda s, d: secret_urls(s, d).select("page_id", urls.mask(U()).alias("url")),
    "url_scope_filter": lambda s, d: pages(s, d).filter(urls.in_scope(U(), F.lit("https://ththan.example.net/"))).select("page_id", "url"),
    "url_safety": lambda s, d: secret_urls(s, d).select("page_id", urls.is_safe(F.when(F.col("page_id") % 5 == 0, F.replace(U(), F.lit("://"), F.lit("://me@"))).when(F.col("page_id") % 5 == 1, F.lit("http://127.0.0.1/x")).otherwise(U())).alias("safe")),
    "url_next_page": lambda s, d: pages(s, d).select("page_id", urls.next_page(U()).alias("next_url")).filter("next_url IS NOT NULL"),
    "well_known_candidates": lambda s, d: pages(s, d).select(urls.origin(U()).alias("origin")).distinct().select("origin", F.explode(F.lit(list(urls.WELL_KNOWN))).alias("path")),
    "charset_detect": lambda s, d: pages(s, d).select("page_id", F.lower(F.coalesce(F.nullif(F.regexp_extract(F.substring("html", 1, 2048), r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1), F.lit("")), F.lit("utf-8"))).alias("charset")),
    "source_type": lambda s, d: pages(s, d).select("page_id", F.when(F.col("html").rlike(r"(?is)^\s*(<!doctype html|<html)"), "html").when(F.col("html").rlike(r"(?s)^\s*[\[{]"), "json").when(F.col("html").rlike(r"(?s)^\s*<\?xml"), "xml").otherwise("text").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("pages")),
    "crawl_bfs": lambda s, d: crawl.bfs(tree(s, d), 0, 5),
    "page_parse": lambda s, d: page.parsed(pages(s, d)).select("page_id", "title", "lang", "words", F.size("links").alias("links"), F.size("headings").alias("headings"), F.size("images").alias("images"), F.size("tables").alias("tables"), F.size("forms").alias("forms")),
    "page_links": lambda s, d: page.parsed(pages(s, d)).select("page_id", F.explode("links").alias("l")).select("page_id", "l.href", "l.text", "l.internal"),
    "page_headings": lambda s, d: page.parsed(pages(s, d)).select("page_id", F.explode("headings").alias("h")).select("page_id", "h.level", "h.text"),
    "page_tables": tables,
    "page_text": lambda s, d: page.parsed(pages(s, d)).select("page_id", "text", "words"),
}


def _plain(x: str) -> str:
    """SQL: entities of the pages turned into characters, white space into single spaces."""
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{ch}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


SEEN = _plain("regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title>.*?</title>|<[^>]*>', ' ', 'g')")
ORACLES = {
    "page_links": f"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t FROM pages)
        SELECT page_id, root || {_plain("h")} AS href, {_plain("t")} AS text, true AS internal FROM l""",
    "page_headings": f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h([1-6])>(.*?)</h[1-6]>', 1)) AS n, unnest(regexp_extract_all(html, '(?s)<h([1-6])>(.*?)</h[1-6]>', 2)) AS t FROM pages)
        SELECT page_id, n::INT AS level, substr({_plain("t")}, 1, 300) AS text FROM l""",
    "page_text": f"WITH t AS (SELECT page_id, {SEEN} AS text FROM pages) SELECT page_id, text, len(regexp_extract_all(text, '[\\pL\\pN_]+'))::INT AS words FROM t",
    "page_parse": f"""WITH t AS (SELECT page_id, html, substr({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, 1, 200) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {SEEN} AS text FROM pages)
        SELECT page_id, title, lang, len(regexp_extract_all(text, '[\\pL\\pN_]+'))::INT AS words, len(regexp_extract_all(html, '<a href="'))::INT AS links, len(regexp_extract_all(html, '<h[1-6]>'))::INT AS headings, len(regexp_extract_all(html, '<img '))::INT AS images,
          len(regexp_extract_all(html, '<table'))::INT AS tables, len(regexp_extract_all(html, '<form'))::INT AS forms FROM t""",
    "page_tables": """SELECT page_id, 0 AS nth, CASE page_id % 3 WHEN 0 THEN ['a', 'b c', ''] WHEN 1 THEN ['name', 'n', ''] ELSE ['column_1', 'column_2', 'column_3'] END AS header, CASE WHEN page_id % 3 = 2 THEN 3 ELSE 2 END AS rows, [page_id::VARCHAR, 'x', 'y'] AS "last" FROM pages""",
    "page_titles": r"SELECT page_id, substr(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 1, 200) AS title FROM pages",
    "page_links_regex": f"SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages",
    "page_link_counts": f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages)
        SELECT page_id, count(*) AS links, count(*) FILTER (href ILIKE 'http%://%' AND lower(regexp_extract(href, '^[A-Za-z]+://([^/?#:]*)', 1)) <> {HOST}) AS external, count(DISTINCT href) AS targets FROM l GROUP BY 1""",
    "page_hosts": f"SELECT {BARE} AS host, count(*) AS pages FROM pages GROUP BY 1",
    "url_normalize": r"""SELECT page_id, regexp_replace(CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+$') THEN url || '/' ELSE url END, '#.*$', '') AS url FROM pages""",
    "url_origin": f"SELECT page_id, CASE WHEN url ILIKE 'https:%' THEN 'https|' || {HOST} || '|443' ELSE 'http|' || {HOST} || '|80' END AS origin FROM pages",
    "url_mask": "SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') OR contains(url, '?') THEN '&' ELSE '?' END || 'token=***&x=1' AS url FROM pages",
    "url_scope_filter": f"SELECT page_id, url FROM pages WHERE url LIKE 'https://%' AND ({HOST} = 'ththan.example.net' OR {HOST} LIKE '%.ththan.example.net')",
    "url_safety": "SELECT page_id, page_id % 5 > 1 AS safe FROM pages",
    "url_next_page": r"""SELECT page_id, regexp_extract(url, '^(.*[?&]page=)(\d+)(.*)$', 1) || (regexp_extract(url, '[?&]page=(\d+)', 1)::BIGINT + 1) || regexp_extract(url, '^(.*[?&]page=)(\d+)(.*)$', 3) AS next_url FROM pages WHERE regexp_matches(url, '[?&]page=\d+')""",
    "url_http_form": r"""SELECT page_id, replace(replace(regexp_replace(CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+(#.*)?$') THEN regexp_replace(url, '#.*$', '') || '/' ELSE url END, '#.*$', ''), ' ', '%20'), 'é', '%C3%A9') || '%20a%20b/%C3%A9' AS url FROM pages""",
    "url_dot_segments": f"""WITH h AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS root, unnest({list(DOTTED)}) AS href FROM pages),
        p AS (SELECT *, regexp_extract(href, '^[^?#]*', 0) AS path, regexp_extract(href, '^[^?#]*(.*)$', 1) AS rest FROM h),
        s AS (SELECT *, CASE WHEN path LIKE '/%' THEN string_split(path[2:], '/') ELSE list_concat(['1', '2', '3', '4', '5', '6', '7'], list_filter(string_split(path, '/'), lambda x, i: x <> '' OR i = len(string_split(path, '/')))) END AS parts FROM p),
        f AS (SELECT *, list_reduce(list_concat([''], parts), lambda done, x: CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END) AS folded FROM s)
        SELECT page_id, href, root || folded || CASE WHEN parts[-1] IN ('.', '..') THEN '/' ELSE '' END || rest AS target FROM f""",
    "url_resolve": f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages), r AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*/)[^/?#]*', 1) AS folder FROM l)
        SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN split_part(url, ':', 1) || ':' || href WHEN href LIKE '/%' THEN root || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href
          WHEN href LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || href WHEN href = '' THEN url ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS target FROM r""",
    "url_mask_keys": r"""WITH k AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, ['refresh_token', 'client_secret', 'passwd', 'pwd2', 'x-api-key', 'page', 'authority', 'sig', 'design', 'monkey'][page_id % 10 + 1] AS key FROM pages)
        SELECT page_id, root || '/a?q=1&' || key || '=' || CASE WHEN page_id % 10 IN (0, 1, 2, 3, 4, 7, 8) THEN '***' ELSE 'v%20' || page_id END || '&z=2' AS url FROM k""",
    "api_candidates": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages)
        SELECT page_id, root || '/p/' || page_id || '.json' AS candidate, 'link_alternate_json' AS source, 'high' AS confidence FROM p WHERE page_id % 4 = 0
        UNION ALL SELECT page_id, root || '/api/v1/items', 'html', 'high' FROM p WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'https://api.example/v2/list', 'inline_script', 'low' FROM p WHERE page_id % 4 = 2""",
    "api_unknown": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages), w AS (SELECT unnest(['/openapi.json', '/swagger.json', '/swagger/v1/swagger.json', '/api/openapi.json', '/api/schema', '/api/docs', '/docs/openapi.json',
          '/.well-known/openapi.json', '/graphql', '/api', '/api/v1', '/rest/api', '/sitemap.xml', '/feed', '/rss']) AS path),
        c AS (SELECT root || '/p/' || page_id || '.json' AS candidate FROM p WHERE page_id % 4 = 0 UNION SELECT root || '/api/v1/items' FROM p WHERE page_id % 4 = 1 UNION SELECT 'https://api.example/v2/list' FROM p WHERE page_id % 4 = 2 UNION SELECT root || path FROM p, w)
        SELECT candidate FROM c WHERE candidate NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)""",
    "next_link": r"""WITH p AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages)
        SELECT page_id, ['link_header', 'json_next', 'json_next', 'rel_next', 'offset_limit', NULL][k + 1] AS kind, CASE k WHEN 0 THEN root || '/list?p=3' WHEN 1 THEN root || '/j?after=9' WHEN 2 THEN 'https://n.example/2' WHEN 3 THEN root || '/dir/s?p=8' WHEN 4 THEN root || '/s?offset=60&limit=20' END AS url FROM p""",
    "page_counts": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, {HOST} AS host FROM pages), x AS (SELECT *, regexp_extract_all(html, '{LINK}', 1) AS hrefs, regexp_extract_all(html, '(?i)<img [^>]*>') AS imgs FROM p),
        y AS (SELECT *, len(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)^https?://') AND lower(regexp_extract(h, '^[A-Za-z]+://([^/?#:]*)', 1)) <> host))::INT AS outside FROM x)
        SELECT page_id, len(hrefs)::INT AS links, outside AS external, len(hrefs)::INT - outside AS internal, len(imgs)::INT AS images, len(list_filter(imgs, lambda t: NOT regexp_matches(t, '(?i)[ ]alt=["''][^"'']')))::INT AS without_alt,
          len(regexp_extract_all(html, '(?i)<h[1-6][ >]'))::INT AS headings, len(regexp_extract_all(html, '(?i)<table[ >]'))::INT AS tables, len(regexp_extract_all(html, '(?i)<form[ >]'))::INT AS forms, len(regexp_extract_all(html, '(?i)<script[ >]'))::INT AS scripts FROM y""",
    "source_kind": "SELECT page_id, ['json', 'jsonl', 'csv', 'text', 'unknown', 'binary', 'xml', 'xml', 'html', 'html', 'html'][page_id % 11 + 1] AS kind FROM pages",
    "input_kind": "SELECT page_id, ['curl', 'url', 'unknown', 'json', 'unknown', 'html', 'unknown', 'unknown'][page_id % 8 + 1] AS kind FROM pages",
    "charset_header": r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'windows-1251' ELSE lower(coalesce(nullif(regexp_extract(substr(html, 1, 2048), '(?i)<meta[^>]+charset=["'']?([\w-]+)', 1), ''), 'utf-8')) END AS charset FROM pages""".replace("\\\\", "\\"),
    "well_known_candidates": f"""WITH o AS (SELECT DISTINCT CASE WHEN url ILIKE 'https:%' THEN 'https|' || {HOST} || '|443' ELSE 'http|' || {HOST} || '|80' END AS origin FROM pages)
        SELECT origin, unnest(['/openapi.json', '/swagger.json', '/swagger/v1/swagger.json', '/api/openapi.json', '/api/schema', '/api/docs', '/docs/openapi.json', '/.well-known/openapi.json', '/graphql', '/api', '/api/v1', '/rest/api',
          '/sitemap.xml', '/feed', '/rss']) AS path FROM o""",
    "charset_detect": r"""SELECT page_id, lower(coalesce(nullif(regexp_extract(substr(html, 1, 2048), '(?i)<meta[^>]+charset=["'']?([\w-]+)', 1), ''), 'utf-8')) AS charset FROM pages""",
    "source_type": r"""SELECT CASE WHEN regexp_matches(html, '(?is)^\s*(<!doctype html|<html)') THEN 'html' WHEN regexp_matches(html, '(?s)^\s*[\[{]') THEN 'json' WHEN regexp_matches(html, '(?s)^\s*<\?xml') THEN 'xml' ELSE 'text' END AS kind, count(*) AS pages FROM pages GROUP BY 1""",
    "crawl_bfs": """WITH RECURSIVE e AS (SELECT page_id AS src, unnest([page_id * 2 + 1, page_id * 2 + 2, page_id // 3]) AS dst FROM pages), v AS (SELECT e.src, e.dst FROM e JOIN pages ON page_id = e.dst),
        w AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT v.dst, w.depth + 1 FROM w JOIN v ON v.src = w.node WHERE w.depth < 5) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""",
}
