"""Export, comparison and selection queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import text, urls
from lakeprobe.plans import data_queries, text_queries
from lakeprobe.session import table


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of the collected records that is an address."""
    rows = data_queries.records(spark, d).select("id", "name", "verify_url", "docs_url")
    return rows.unpivot(["id"], ["name", "verify_url", "docs_url"], "field", "url").filter(F.startswith("url", F.lit("http")))


def surprise(spark: SparkSession, d: str) -> DataFrame:
    """Three records drawn by the hash of their id and a seed."""
    return data_queries.records(spark, d).orderBy(F.md5(F.concat(F.lit("seed-7:"), F.col("id").cast("string"))), "id").limit(3).select("id", "name")


def verdict(spark: SparkSession, d: str) -> DataFrame:
    """Why two texts differ: not at all, by composition, by characters that cleaning removes, or by content."""
    a, b = F.col("plain"), F.col("text")
    same = F.when(a == b, "equal").when(text.nfc(a) == text.nfc(b), "equal_after_nfc").when(text.nfc(text.spaced(a)) == text.nfc(text.spaced(b)), "equal_after_clean").otherwise("different")
    planted = text_queries.planted(spark, d).withColumn("text", F.when(F.col("doc_id") % 16 == 9, F.col("plain")).when(F.col("doc_id") % 16 == 10, F.concat(F.lit("​"), "plain")).otherwise(F.col("text")))
    return planted.select("doc_id", same.alias("verdict"))


def internal_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages per host by depth of their path."""
    depth = F.size(F.filter(F.split(urls.part(F.col("url"), urls.PATH), "/"), lambda x: x != ""))
    return table(spark, d, "pages").groupBy(urls.bare_host(F.col("url")).alias("host"), depth.alias("depth")).agg(F.count(F.lit(1)).alias("pages"))


def role_drift(spark: SparkSession, d: str) -> DataFrame:
    """Turns, texts and mean lengths of each role of the conversations."""
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("avg_length"), F.max("turn").alias("last_turn"))


def overlap(spark: SparkSession, d: str) -> DataFrame:
    """Ids of labels and documents: in both, in one of them."""
    a = table(spark, d, "documents").select("doc_id").distinct().withColumn("a", F.lit(True))
    b = table(spark, d, "labels").select("doc_id").distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "documents").otherwise("labels")
    return a.join(b, "doc_id", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("ids"))


QUERIES = {
    "export_manifest": manifest,
    "catalog_surprise": surprise,
    "unicode_verdict": verdict,
    "page_depths": internal_links,
    "conversation_roles": role_drift,
    "key_overlap": overlap,
    "synth_pagination_shrinking": data_queries.paged("shrinking"),
}
CLEAN = text_queries.SQL_CLEAN
_P = CLEAN.replace("text", "plain")
ORACLES = {
    "export_manifest": """SELECT p_partkey AS id, 'verify_url' AS field, 'https://www.h' || (p_partkey % 40) || '.example/x' AS url FROM part UNION ALL SELECT p_partkey, 'docs_url', 'http://h' || (p_partkey % 60) || '.example/docs' FROM part""",
    "catalog_surprise": f"WITH {data_queries.RECORDS} SELECT id, name FROM r ORDER BY md5('seed-7:' || id), id LIMIT 3",
    "unicode_verdict": f"""WITH {text_queries.PLANTED}, q AS (SELECT doc_id, plain, CASE doc_id % 16 WHEN 9 THEN plain WHEN 10 THEN chr(8203) || plain ELSE text END AS text FROM planted)
        SELECT doc_id, CASE WHEN plain = text THEN 'equal' WHEN nfc_normalize(plain) = nfc_normalize(text) THEN 'equal_after_nfc' WHEN nfc_normalize({_P}) = nfc_normalize({CLEAN}) THEN 'equal_after_clean' ELSE 'different' END AS verdict FROM q""",
    "page_depths": r"""SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, len(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))::INT AS depth, count(*) AS pages FROM pages GROUP BY ALL""",
    "conversation_roles": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS avg_length, max(turn) AS last_turn FROM conversations GROUP BY 1",
    "key_overlap": """WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels) SELECT CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'documents' ELSE 'labels' END AS side, count(*) AS ids FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""",
    "synth_pagination_shrinking": "SELECT c_custkey // 25 + 1 AS page, c_custkey AS item FROM customer WHERE c_custkey % 25 < 25 - c_custkey // 25",
}
