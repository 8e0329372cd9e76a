"""Breadth-first crawl over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprobe.session import saved


def bfs(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """Rows (node, depth): every node within so many links of the start, each once, at its least depth.

    One level at a time: the links of the frontier, without what was seen before (an
    anti-join). Each level is written down, so the plan of the next one does not contain
    it; only node ids move, and the number of levels is the caller's bound.
    """
    seen = edges.sparkSession.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = saved(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)), f"level-{level}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def statuses(fetched: DataFrame) -> DataFrame:
    """Per status of rows (status, redirected, error): pages, and whether they are broken, redirected or failed."""
    s = F.col("status")
    return fetched.groupBy("status").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(s >= 400).alias("broken"), F.count_if(F.col("redirected")).alias("redirects"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


#: Fixed value: the pattern of an address that is written in a script, in quotes.
QUOTED_ADDRESS = r"[\"'`](https?://[^\s\"'`]+|/[A-Za-z0-9_\-./]*)[\"'`]"


def candidates(pages: DataFrame) -> DataFrame:
    """Rows (page_id, candidate, source, confidence): addresses of interfaces that pages (page_id, url, html) link to, name in scripts or declare, each once per page."""
    from lakeprobe.functions import urls

    html, every = F.col("html"), lambda p, i: F.regexp_extract_all("html", F.lit(p), i)
    marked = lambda c, source: F.transform(c, lambda x: F.struct(x.alias("href"), F.lit(source).alias("source")))
    declared = F.transform(F.filter(every(r"(?is)<link\b[^>]*>", 0), lambda t: t.rlike(r"(?i)application/(json|[a-z.+-]*\+json)")), lambda t: F.regexp_extract(t, r"(?i)href\s*=\s*[\"']([^\"']+)", 1))
    scripts = F.array_join(every(r"(?is)<script\b[^>]*>(.*?)</script>", 1), "\n")
    in_scripts = F.regexp_extract_all(scripts, F.lit(QUOTED_ADDRESS), 1)
    linked = every(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)", 1)
    found = pages.withColumn("html", F.coalesce(html, F.lit(""))).select("page_id", "url", F.explode(F.concat(marked(declared, "link_alternate_json"), marked(linked, "html"), marked(in_scripts, "inline_script"))).alias("x"))
    full = found.select("page_id", urls.resolve(F.col("url"), F.col("x.href")).alias("candidate"), F.col("x.source").alias("source"))
    kept = full.filter(F.when(F.col("source") == "link_alternate_json", F.lower("candidate").rlike("^https?://")).otherwise(urls.is_api(F.col("candidate"))))
    order = F.array_position(F.lit(["link_alternate_json", "html", "inline_script"]), F.col("source"))
    first = kept.groupBy("page_id", "candidate").agg(F.min_by("source", order).alias("source"))
    return first.withColumn("confidence", urls.api_confidence(F.col("candidate"), F.col("source")))


def unknown(found: DataFrame, guessed: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses (candidate) found or guessed that are not known yet, each once."""
    return found.select("candidate").union(guessed.select("candidate")).distinct().join(known.select("candidate"), "candidate", "left_anti")
