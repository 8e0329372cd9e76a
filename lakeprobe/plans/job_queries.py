"""Extraction, file and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import dom, urls
from lakeprobe.plans import web_queries
from lakeprobe.sources import files
from lakeprobe.streaming import jobs
from lakeprobe.session import table


def extracted(spark: SparkSession, d: str) -> DataFrame:
    fields = [dom.Field("label", "a"), dom.Field("href", "a", "@href"), dom.Field("url", "a[href]", "url")]
    return dom.extract(table(spark, d, "pages"), "nav > ul > li", fields)


def inspected(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    start = F.when(k % 6 == 0, "FFD8FFE0").when(k % 6 == 1, "89504E470D0A1A0A").when(k % 6 == 2, "25504446").when(k % 6 == 3, "504B0304").when(k % 6 == 4, "524946460000000057454250").otherwise("00")
    inner = F.when(k % 12 == 3, "word/document.xml").when(k % 12 == 9, "xl/workbook.xml").otherwise("")
    size = F.when(k % 6 == 1, F.unhex(F.lit("0000000D4948445200000140000000F0"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.unhex(start), size, inner.cast("binary"), F.coalesce("html", F.lit("")).cast("binary"))
    got = files.inspected(table(spark, d, "pages").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), content.alias("content")))
    return got.select("path", "format", "mime", "size", "sha256", F.col("dimensions.width").alias("width"), F.col("dimensions.height").alias("height"))


def stream_links(spark: SparkSession, d: str) -> DataFrame:
    pages = jobs.stream(spark, d, "pages")
    return jobs.collect(pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(web_queries.LINK), 1)).alias("href")), "links")


def stream_hosts(spark: SparkSession, d: str) -> DataFrame:
    pages = jobs.stream(spark, d, "pages")
    return jobs.accumulate(pages.select(urls.bare_host(F.col("url")).alias("host")), ["host"], "hosts").withColumnRenamed("n", "pages")


#: Planted at the ends of pages: what a page must not keep.
ACTIVE = (
    """<IFRAME src="x">in</iframe ><p onclick="a()" class=k ONLOAD=b>t</p>""", """<object data=o></object><embed src=e><a href="javascript:alert(1)">j</a>""", """<noscript><p>n</p></noscript><template>t</template><base href="//b">""",
    """<form action=f><input></form><img src=javascript:x onerror='y > z'>""", """<style>a</style><script async>b</script><form>left open""",
)


def active(spark: SparkSession, d: str) -> DataFrame:
    """Pages with active elements, sanitized; told by length and digest."""
    pages = table(spark, d, "pages")
    text = F.get(F.array(*map(F.lit, ACTIVE)), (F.col("page_id") % len(ACTIVE)).cast("int"))
    clean = dom.sanitized(pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), text).alias("html")))
    return clean.select("page_id", F.length("html").alias("length"), F.md5("html").alias("digest"))


_TAGS = ("script", "style", "iframe", "object", "embed", "noscript", "template", "base", "form")


def _sanitized_sql(html: str) -> str:
    whole = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in _TAGS)
    for pattern in (f"(?is){whole}", rf"(?is)<({'|'.join(_TAGS)})\b[^>]*>", r"""(?is)\s+on[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)""", r"""(?is)(href|src)\s*=\s*["'']?\s*javascript:[^"''\s>]*["'']?"""):
        html = f"regexp_replace({html}, '{pattern}', '', 'g')"
    return html


QUERIES = {
    "page_sanitize_active": active,
    "extract_schema": extracted,
    "page_sanitize": lambda s, d: dom.sanitized(table(s, d, "pages")).select("page_id", F.length("html").alias("length"), F.regexp_like("html", F.lit("(?i)<script")).alias("active")),
    "file_inspect": inspected,
    "stream_collect_append": stream_links,
    "stream_page_hosts": stream_hosts,
}
ORACLES = {
    "page_sanitize_active": f"""WITH a AS (SELECT page_id, coalesce(html, '') || [{", ".join("'" + t.replace("'", "''") + "'" for t in ACTIVE)}][page_id % {len(ACTIVE)} + 1] AS html FROM pages), c AS (SELECT page_id, {_sanitized_sql("html")} AS html FROM a)
        SELECT page_id, length(html)::INT AS length, md5(html) AS digest FROM c""",
    "page_sanitize": r"SELECT page_id, length(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'))::INT AS length, false AS active FROM pages",
    "extract_schema": r"""WITH n AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM pages),
        r AS (SELECT page_id, root, unnest(h) AS href, unnest(t) AS label, unnest(range(len(h))) AS nth FROM n)
        SELECT page_id, nth::INT AS nth, array_to_string(list_filter(string_split(replace(label, '&amp;', '&'), ' '), lambda x: x <> ''), ' ') AS label, replace(href, '&amp;', '&') AS href, root || replace(href, '&amp;', '&') AS url FROM r""",
    "file_inspect": """WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' WHEN 3 THEN CASE page_id % 12 WHEN 3 THEN 'docx' ELSE 'xlsx' END WHEN 4 THEN 'webp' ELSE 'unknown' END AS format,
        unhex(CASE page_id % 6 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '25504446' WHEN 3 THEN '504B0304' WHEN 4 THEN '524946460000000057454250' ELSE '00' END || CASE WHEN page_id % 6 = 1 THEN '0000000D4948445200000140000000F0' ELSE '' END)
          || encode(CASE page_id % 12 WHEN 3 THEN 'word/document.xml' WHEN 9 THEN 'xl/workbook.xml' ELSE '' END || coalesce(html, '')) AS body FROM pages)
        SELECT 'p' || page_id AS path, format, CASE format WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'pdf' THEN 'application/pdf' WHEN 'webp' THEN 'image/webp' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
          WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END AS mime, octet_length(body)::BIGINT AS size, sha256(body) AS sha256, CASE WHEN format = 'png' THEN 320 END AS width, CASE WHEN format = 'png' THEN 240 END AS height FROM f""",
    "stream_collect_append": web_queries.ORACLES["page_links_regex"],
    "stream_page_hosts": web_queries.ORACLES["page_hosts"],
}
