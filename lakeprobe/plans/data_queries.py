"""JSON, catalog and generator queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions import json_ops, summary
from lakeprobe.operators import catalog, paging
from lakeprobe.session import table


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def pages_of_events(spark: SparkSession, d: str) -> DataFrame:
    """Collected pages of records: a price that turns from number to text on later pages, links and days."""
    k = F.col("event_id")
    late = k % 10 >= 7
    return events(spark, d).select(
        (k % 10).alias("page"), F.when(late, F.concat(F.lit("from "), F.col("value").cast("int").cast("string"))).otherwise(F.col("value").cast("int").cast("string")).alias("price"),
        F.concat(F.lit("https://x.example/"), k.cast("string")).alias("link"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(k % 3 > 0, F.col("event_type")).otherwise("").alias("label"),
    )


PAGED = """
e AS (SELECT event_id % 10 AS page, CASE WHEN event_id % 10 >= 7 THEN 'text' ELSE 'number' END AS price, CASE WHEN event_id % 3 > 0 THEN 'text' ELSE 'empty' END AS label FROM events),
k AS (SELECT page, 'price' AS field, price AS kind FROM e UNION ALL SELECT page, 'link', 'url' FROM e UNION ALL SELECT page, 'day', 'date' FROM e UNION ALL SELECT page, 'label', label FROM e),
c AS (SELECT field, kind, count(*) AS n FROM k GROUP BY ALL)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalog records."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.col("p_type").alias("category"), F.concat(F.lit("brand "), "p_brand").alias("description"),
        F.when(k % 4 == 0, F.col("p_type")).alias("why_useful"), F.when(k % 6 == 0, F.col("p_brand")).alias("ideas"), F.when(k % 5 == 0, "none").otherwise("key").alias("auth"),
        F.when(k % 3 == 0, "free_tier").when(k % 3 == 1, "paid").alias("free_type"), F.when(k % 7 > 0, F.date_sub(F.lit("2024-06-30").cast("date"), (k % 400).cast("int"))).alias("docs_verified"),
        F.concat(F.lit("https://www.h"), (k % 40).cast("string"), F.lit(".example/x")).alias("verify_url"), F.concat(F.lit("http://h"), (k % 60).cast("string"), F.lit(".example/docs")).alias("docs_url"),
    )


RECORDS = """
r AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, p_type AS category, 'brand ' || p_brand AS description, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS why_useful, CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS ideas,
    CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE 'key' END AS auth, CASE p_partkey % 3 WHEN 0 THEN 'free_tier' WHEN 1 THEN 'paid' END AS free_type, CASE WHEN p_partkey % 7 > 0 THEN DATE '2024-06-30' - (p_partkey % 400)::INT END AS docs_verified FROM part)"""
SCORE = """
s AS (SELECT *, 5 * contains(lower(name), '{q}')::INT + 4 * contains(lower(category), '{q}')::INT + 3 * contains(lower(description), '{q}')::INT + 2 * coalesce(contains(lower(why_useful), '{q}'), false)::INT + 2 * coalesce(contains(lower(ideas), '{q}'), false)::INT AS score FROM r)"""


def bridged(spark: SparkSession, d: str) -> DataFrame:
    candidates = table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate"), F.concat(F.lit("h"), (F.col("s_suppkey") % 70).cast("string"), F.lit(".example")).alias("host"))
    return catalog.bridge(candidates, records(spark, d))


def boosted(spark: SparkSession, d: str) -> DataFrame:
    stems = records(spark, d).select("category", F.explode(F.split(F.lower("category"), r"[^a-z0-9]+")).alias("stem")).filter("length(stem) >= 3").distinct()
    return catalog.boost(records(spark, d), "standard type1 promo", stems).groupBy("category", "boost").agg(F.count(F.lit(1)).alias("records"))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"))


def paged(fault: str):
    return lambda spark, d: paging.windows(numbered(spark, d), "k", 25, fault)


def paging_audit(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with three faulty paginations of customer."""
    expected = numbered(spark, d).select(F.col("k").alias("item"))
    parts = [paging.audit(paging.windows(numbered(spark, d), "k", 25, f), expected).withColumn("fault", F.lit(f)) for f in ("duplicates", "missing", "off_by_one")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Records at different depths of JSON text, by turns."""
    k = F.col("event_id")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('{"meta": {"tags": [{"x": 1}]}, "data": {"rows": [{"id": '), k.cast("string"), F.lit('}, {"id": 2}]}}'))).when(k % 4 == 1, F.lit('[[1, 2], [{"a": null}]]'))
        .when(k % 4 == 2, F.lit("oops")).otherwise(F.lit('"text"'))
    )
    return events(spark, d).select("event_id", json_ops.largest_records(text).alias("records"))


def cells_of_json(spark: SparkSession, d: str) -> DataFrame:
    values = ["null", "12", '"a b"', "[1,2]", '{"k":"v"}', "true", "1.50"]
    return events(spark, d).select("event_id", json_ops.stringify(F.get(F.lit(values), (F.col("event_id") % len(values)).cast("int"))).alias("cell"))


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    """Records with permissions, probes and checks, for the filters and states."""
    k = F.col("id")
    return records(spark, d).withColumn("cors", k % 2 == 0).withColumn("sdk", F.when(k % 3 > 0, k % 4 == 0)).withColumn("commercial_use", F.when(k % 5 < 3, "Разрешено с оговорками").otherwise("нет")).withColumn("probe_ok", k % 9 == 0).withColumn("status", F.when(k % 2 == 0, "docs_verified").otherwise("candidate"))


def source_union(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of records with some ids in both: the first one's stay, free ones only."""
    first = records(spark, d).filter("id % 2 = 0").select("id", "auth", "free_type", F.lit("first").alias("origin"))
    second = records(spark, d).filter("id % 3 = 0").select("id", F.lit("none").alias("auth"), "free_type", F.lit("second").alias("origin"))
    return catalog.merged([first, second]).select("id", "origin")


def described_boost(spark: SparkSession, d: str) -> DataFrame:
    """Records whose descriptions name categories, searched by stems of which there is one for every part: the words of the query begin some, or are begun by some."""
    rows = records(spark, d).withColumn("description", F.concat(F.lit("Like "), F.when(F.col("id") % 3 == 0, F.col("category")).otherwise(F.col("name"))))
    stems = rows.select(F.concat(F.substring(F.lower("category"), 1, 4), F.col("id").cast("string")).alias("stem"), "category").unionByName(rows.select(F.substring(F.lower("category"), 1, 3).alias("stem"), "category").distinct())
    return catalog.boost(rows, "Promos econ1 stan", stems).select("id", "boost")


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Responses made of events: objects, lists, lines, broken and other texts, by turns."""
    k, props = F.col("event_id"), F.col("props")
    body = (
        F.when(k % 7 == 0, F.concat(F.lit("["), props, F.lit(","), props, F.lit("]"))).when(k % 7 == 1, props).when(k % 7 == 2, F.concat(F.lit("{oops "), k.cast("string"))).when(k % 7 == 3, F.lit("[1, 2, 3]"))
        .when(k % 7 == 4, F.concat(props, F.lit("\n"), props, F.lit("\n"), props)).when(k % 7 == 5, F.concat(F.lit("<html><p>"), k.cast("string"), F.lit("</p></html>"))).otherwise(F.concat(F.lit("text "), k.cast("string")))
    )
    status = F.when(k % 5 == 0, 404).when(k % 5 == 1, 301).when(k % 5 < 4, 200)
    return events(spark, d).select("event_id", status.alias("status"), F.when(k % 3 > 0, "application/json; charset=utf-8").otherwise("text/plain").alias("content_type"), body.alias("body"))


def probed(spark: SparkSession, d: str) -> DataFrame:
    p = summary.probe(F.col("status"), F.col("content_type"), F.col("body"))
    return bodies(spark, d).select("event_id", p.alias("p")).select("event_id", "p.ok", "p.json", "p.shape", "p.items", F.concat_ws(",", "p.keys").alias("keys"), "p.ready_for_dataset")


def inspected(spark: SparkSession, d: str) -> DataFrame:
    return summary.inputs(bodies(spark, d), "body").select("event_id", "kind", "source", "summary.valid", "summary.shape", "summary.items", F.concat_ws(",", "summary.keys").alias("keys"))


CUST = "SELECT c_custkey AS k FROM customer"
QUERIES = {
    "json_project": lambda s, d: json_ops.project(events(s, d).select("event_id", "props"), "props", ["k", "none"]).drop("props"),
    "json_keys": lambda s, d: json_ops.keys(events(s, d), "props"),
    "json_summary": lambda s, d: events(s, d).select(json_ops.shape(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 4 == 1, F.lit("{oops")).when(F.col("event_id") % 4 == 2, F.lit("12")).otherwise(F.col("props"))).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("records")),
    "field_drift_by_page": lambda s, d: json_ops.field_drift(pages_of_events(s, d), ["price", "link", "day", "label"]),
    "catalog_search": lambda s, d: catalog.search(records(s, d), "promo", 20).select("id", "name", "score"),
    "catalog_filters": lambda s, d: records(s, d).filter(catalog.is_free() & F.col("category").contains("PROMO")).select("id", "name"),
    "catalog_categories": lambda s, d: records(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("records")),
    "catalog_stale": lambda s, d: records(s, d).select("id", catalog.is_stale(F.lit("2024-06-30").cast("date")).alias("stale")),
    "catalog_bridge": bridged,
    "catalog_topic_boost": boosted,
    "catalog_described_boost": described_boost,
    "probe_shapes": probed,
    "input_summary": inspected,
    "synth_pagination_duplicates": paged("duplicates"), "synth_pagination_missing": paged("missing"), "synth_pagination_off_by_one": paged("off_by_one"), "synth_pagination_clean": paged(""),
    "paging_audit": paging_audit,
    "json_largest_records": nested,
    "json_stringify": cells_of_json,
    "catalog_all_filters": lambda s, d: catalog.filtered(catalog_rows(s, d), no_key=False, free_type="paid", cors=True, has_sdk=True, commercial=True).select("id", "name"),
    "catalog_status": lambda s, d: catalog_rows(s, d).select("id", catalog.effective_status(F.lit("2024-06-30").cast("date")).alias("status")),
    "catalog_sources": source_union,
    "catalog_explore": lambda s, d: catalog.of_topics(records(s, d), ["Promo Type1", "PROMO", "standard"]).groupBy("category").agg(F.count(F.lit(1)).alias("records")),
}
ORACLES = {
    "json_project": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), '') AS \"none\" FROM events",
    "json_keys": "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS records FROM k GROUP BY 1",
    "json_summary": "SELECT CASE event_id % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'invalid' WHEN 2 THEN 'scalar' ELSE 'object' END AS shape, count(*) AS records FROM events GROUP BY 1",
    "field_drift_by_page": f"""WITH {PAGED} SELECT field, round(sum(n) FILTER (kind <> 'empty') * 100 / sum(n), 1) AS present_pct, max_by(kind, n) FILTER (kind <> 'empty') AS dominant, count(*) FILTER (kind <> 'empty') > 1 AS mixed FROM c GROUP BY 1""",
    "catalog_search": f"WITH {RECORDS}, {SCORE.format(q='promo')} SELECT id, name, score::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, name DESC LIMIT 20",
    "catalog_filters": f"WITH {RECORDS} SELECT id, name FROM r WHERE (auth = 'none' OR free_type IN ('free_forever', 'free_tier', 'open_data')) AND contains(category, 'PROMO')",
    "catalog_categories": "SELECT p_type AS category, count(*) AS records FROM part GROUP BY 1",
    "catalog_stale": f"WITH {RECORDS} SELECT id, docs_verified IS NULL OR DATE '2024-06-30' - docs_verified > 180 AS stale FROM r",
    "catalog_bridge": """WITH h AS (SELECT 'h' || (p_partkey % 40) || '.example' AS host, p_partkey AS id FROM part UNION ALL SELECT 'h' || (p_partkey % 60) || '.example', p_partkey FROM part), g AS (SELECT host, min(id) AS record_id FROM h GROUP BY 1),
        c AS (SELECT s_suppkey AS candidate, 'h' || (s_suppkey % 70) || '.example' AS host FROM supplier) SELECT host, candidate, record_id FROM c LEFT JOIN g USING (host)""",
    "catalog_topic_boost": """WITH t AS (SELECT DISTINCT lower(p_type) AS topic, unnest(string_split_regex(lower(p_type), '[^a-z0-9]+')) AS stem FROM part), w AS (SELECT unnest(['standard', 'type1', 'promo']) AS word),
        m AS (SELECT word, stem, list(DISTINCT topic) AS topics FROM t JOIN w ON starts_with(word, stem) OR starts_with(stem, word) WHERE length(stem) >= 3 GROUP BY ALL),
        r AS (SELECT p_partkey AS id, p_type AS category, 'brand ' || p_brand AS description FROM part),
        s AS (SELECT id, category, coalesce(sum(4 * list_contains(topics, lower(category))::INT + (len(list_filter(topics, lambda c: contains(lower(description), c))) > 0)::INT), 0)::INT AS boost FROM r LEFT JOIN m ON true GROUP BY ALL)
        SELECT category, boost, count(*) AS records FROM s GROUP BY ALL""",
    "catalog_described_boost": """WITH r AS (SELECT p_partkey AS id, lower(p_type) AS category, lower('Like ' || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name || ' ' || p_partkey END) AS text FROM part),
        t AS (SELECT DISTINCT category[1:4] || id AS stem, category AS topic FROM r UNION SELECT DISTINCT category[1:3], category FROM r), w AS (SELECT unnest(['promos', 'econ1', 'stan']) AS word),
        m AS (SELECT DISTINCT word, stem, topic FROM t JOIN w ON starts_with(word, stem) OR starts_with(stem, word)),
        own AS (SELECT topic, count(*) AS n FROM m GROUP BY 1), told AS (SELECT text, count(DISTINCT word || '|' || stem) AS n FROM (SELECT DISTINCT text FROM r) JOIN m ON contains(text, topic) GROUP BY 1)
        SELECT id, (4 * coalesce(own.n, 0) + coalesce(told.n, 0))::INT AS boost FROM r LEFT JOIN own ON topic = category LEFT JOIN told USING (text)""",
    "probe_shapes": """SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 5 < 4 THEN true END, false) AS ok, CASE WHEN event_id % 3 > 0 THEN event_id % 7 IN (0, 1, 3) END AS json,
        CASE WHEN event_id % 3 > 0 THEN CASE event_id % 7 WHEN 0 THEN 'array' WHEN 1 THEN 'object' WHEN 3 THEN 'array' END END AS shape, CASE WHEN event_id % 3 > 0 THEN CASE event_id % 7 WHEN 0 THEN 2 WHEN 3 THEN 3 END END AS items,
        CASE WHEN event_id % 3 > 0 AND event_id % 7 IN (0, 1) THEN array_to_string(json_keys(props), ',') ELSE '' END AS keys, event_id % 3 > 0 AND event_id % 7 = 0 AS ready_for_dataset FROM events""",
    "input_summary": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 3 THEN 'json' WHEN 5 THEN 'html' ELSE 'unknown' END AS kind, CASE event_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 4 THEN 'jsonl' WHEN 5 THEN 'html' ELSE 'text' END AS source,
        CASE WHEN event_id % 7 < 5 THEN event_id % 7 <> 2 END AS valid, CASE event_id % 7 WHEN 1 THEN 'object' WHEN 2 THEN 'invalid' WHEN 0 THEN 'array' WHEN 3 THEN 'array' WHEN 4 THEN 'array' END AS shape, CASE event_id % 7 WHEN 0 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 END AS items,
        CASE WHEN event_id % 7 IN (0, 1, 4) THEN array_to_string(json_keys(props), ',') ELSE '' END AS keys FROM events""",
    "paging_audit": """WITH c AS (SELECT c_custkey AS k FROM customer), e AS (SELECT max(k) AS top, count(*) AS n FROM c),
        d AS (SELECT count(*) FILTER (k % 25 = 24) AS d24, count(*) FILTER (k = 0) AS zero FROM c), p AS (SELECT 'duplicates' AS fault, k // 25 + 1 AS page, k FROM c UNION ALL SELECT 'duplicates', k // 25 + 2, k FROM c WHERE k % 25 = 24
          UNION ALL SELECT 'missing', k // 25 + 1, k FROM c WHERE k % 25 <> 24 UNION ALL SELECT 'off_by_one', (k - 1) // 25 + 1, k FROM c WHERE k >= 1),
        z AS (SELECT fault, page, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT fault, max(n) AS most, max(page) AS last FROM z GROUP BY 1), s AS (SELECT fault, count(*) FILTER (n < most AND page < last) AS short FROM z JOIN q USING (fault) GROUP BY 1),
        f AS (SELECT unnest(['duplicates', 'missing', 'off_by_one']) AS fault), r AS (SELECT fault, k, count(*) AS times FROM p GROUP BY ALL)
        SELECT 'repeated' AS problem, count(*) FILTER (times > 1) AS n, fault FROM r GROUP BY fault UNION ALL SELECT 'lost', (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM r WHERE r.fault = f.fault)), fault FROM f
        UNION ALL SELECT 'foreign', 0, fault FROM f UNION ALL SELECT 'short', short, fault FROM s""",
    "json_largest_records": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[{"id": ' || event_id || '}, {"id": 2}]' WHEN 1 THEN '[{"a": null}]' WHEN 3 THEN '[]' END AS records FROM events""",
    "json_stringify": """SELECT event_id, ['', '12', 'a b', '[1,2]', '{"k":"v"}', 'true', '1.5'][event_id % 7 + 1] AS cell FROM events""",
    "catalog_all_filters": f"WITH {RECORDS} SELECT id, name FROM r WHERE auth <> 'none' AND free_type = 'paid' AND id % 2 = 0 AND id % 3 > 0 AND id % 4 = 0 AND id % 5 < 3",
    "catalog_status": f"WITH {RECORDS} SELECT id, CASE WHEN id % 9 = 0 THEN 'availability_checked' WHEN id % 2 = 0 AND (docs_verified IS NULL OR DATE '2024-06-30' - docs_verified > 180) THEN 'stale' WHEN id % 2 = 0 THEN 'docs_verified' ELSE 'candidate' END AS status FROM r",
    "catalog_sources": f"WITH {RECORDS} SELECT id, CASE WHEN id % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM r WHERE id % 2 = 0 AND (auth = 'none' OR free_type = 'free_tier') OR id % 2 = 1 AND id % 3 = 0",
    "catalog_explore": "SELECT p_type AS category, count(*) AS records FROM part WHERE lower(p_type) IN ('promo type1', 'promo', 'standard') GROUP BY 1",
    "synth_pagination_clean": f"SELECT k // 25 + 1 AS page, k AS item FROM ({CUST})",
    "synth_pagination_duplicates": f"SELECT k // 25 + 1 AS page, k AS item FROM ({CUST}) UNION ALL SELECT k // 25 + 2, k FROM ({CUST}) WHERE k % 25 = 24",
    "synth_pagination_missing": f"SELECT k // 25 + 1 AS page, k AS item FROM ({CUST}) WHERE k % 25 <> 24",
    "synth_pagination_off_by_one": f"SELECT (k - 1) // 25 + 1 AS page, k AS item FROM ({CUST}) WHERE k >= 1",
}
