"""Collection under limits, job states, results with broken lines and exports, each with its SQL.

The pages of a job are the orders of a customer, its rows their line items; commands of
jobs are the orders themselves. What is planted (pages without rows, links, broken lines,
stale cursors) follows from keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeprobe.session import shared_dir, table
from lakeprobe.sources import exports, results
from lakeprobe.streaming import collecting, jobs, store

FIELDS = ["part", "flag", "day", "note"]
LIMITS = collecting.Limits(pages=6, rows=20, bytes=1200)


def collected(spark: SparkSession, d: str) -> collecting.Collection:
    """Line items streamed as the rows of customers' pages; every ninth page has none."""
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("job"))
    items = jobs.stream(spark, d, "lineitem").join(owner, "l_orderkey")
    n, full = F.col("l_linenumber"), F.col("l_orderkey") % 9 != 0
    note = F.when(n % 3 == 1, F.concat(F.lit("https://h.example/"), F.col("l_partkey").cast("string"))).when(n % 3 == 2, n.cast("string"))
    made = {"part": F.col("l_partkey"), "flag": F.col("l_returnflag"), "day": F.date_format("l_shipdate", "yyyy-MM-dd"), "note": note}
    rows = items.select("job", F.col("l_orderkey").alias("page"), n.alias("pos"), *(F.when(full, c).alias(f) for f, c in made.items()))
    return collecting.Collection(rows, FIELDS, LIMITS).run()


def commands(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a customer as commands of a job: the first starts it, the others step, end or cancel it; some hold a cursor that isn't the job's."""
    k = F.col("o_orderkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    op = F.when(F.col("nth") == 1, "start").when(k % 13 == 11, "cancel").when(k % 13 == 12, "fail").otherwise("advance")
    told = F.to_json(F.struct((k % 100 / 100).alias("progress"), (k % 13 == 10).alias("done"), F.struct(k.alias("order")).alias("partial"), F.struct(k.alias("last")).alias("internal")))
    payload = F.when(op == "start", F.to_json(F.struct(F.lit("orders").alias("kind"), F.struct(F.col("o_custkey").alias("customer")).alias("params")))).when(op == "fail", F.concat(F.lit("order "), k.cast("string"))).when(op == "advance", told)
    rows = table(spark, d, "orders").withColumn("nth", nth)
    return rows.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("job_id"), k.cast("double").alias("at"), op.alias("op"), F.when((F.col("nth") > 1) & (k % 7 == 3), "not a cursor").alias("cursor"), payload.alias("payload")
    )


def states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every job after all its commands, folded by a stateful stream."""
    written = commands(spark, d)
    base = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    written.write.parquet(f"{base}/commands")
    stream = spark.readStream.schema(written.schema).parquet(f"{base}/commands")
    job = store.states(stream).writeStream.format("parquet").option("path", f"{base}/states").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    found = store.latest(spark.read.schema(store.STATE).parquet(f"{base}/states"))
    return found.select("job_id", "version", "status", "kind", F.round("progress", 4).alias("progress"), F.col("cursor").isNotNull().alias("open"), "partial", F.concat_ws(";", "errors").alias("errors"), "created", "updated")


def lines(spark: SparkSession, d: str) -> str:
    """A written result: an event a line, some lines broken, no objects, or blank."""
    k = F.col("event_id")
    good = F.to_json(F.struct(k.alias("id"), F.col("event_type").alias("type"), F.when(k % 4 == 0, F.col("user_id")).alias("user")))
    line = F.when(k % 17 == 3, F.substring(good, 1, 9)).when(k % 17 == 5, "").when(k % 17 == 7, F.concat(F.lit("["), good, F.lit("]"))).when(k % 17 == 9, F.concat(F.lit("  "), good)).otherwise(good)
    path = f"{shared_dir(spark)}/result-{uuid.uuid4().hex}"
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return path


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same result read as a stream and collected."""
    return jobs.collect(results.stream(spark, lines(spark, d), "id long, type string, user long"), "results")


def exported(kind: str, bom: bool = False):
    """The lines of an export of customers with odd texts, read back from its parts; reading takes the mark away."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        c = table(spark, d, "customer")
        odd = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("c_name"), F.lit(', "x"'))).when(F.col("c_custkey") % 5 != 1, F.col("c_name"))
        rows = c.select(F.col("c_custkey").alias("id"), odd.alias("name, of"), F.col("c_mktsegment").alias("segment"))
        path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
        exports.write(rows, path, ["id"], kind, bom)
        return spark.read.text(path).select(F.col("value").alias("line"))

    return query


QUERIES = {
    "collect_totals": lambda s, d: collected(s, d).totals(),
    "collect_rows": lambda s, d: collected(s, d).kept(),
    "collect_drift": lambda s, d: collecting.drift(collected(s, d).counts()),
    "job_states": states,
    "result_records": lambda s, d: results.read(s, lines(s, d), "id long, type string, user long"),
    "result_quality": lambda s, d: results.quality(s, lines(s, d)),
    "result_keys": lambda s, d: results.keys(results.read(s, lines(s, d))),
    "result_stream": streamed,
    "export_csv": exported("csv", True),
    "export_json_array": exported("json"),
    "export_assets": lambda s, d: exports.assets(table(s, d, "pages").select("page_id", "url", F.concat(F.lit("see "), F.col("url")).alias("text")), "page_id"),
}
_COLLECTED = f"""
i AS (SELECT 'c' || o_custkey AS job, l_orderkey AS page, l_linenumber AS pos, l_orderkey % 9 <> 0 AS kept, l_partkey AS part, l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS day,
  CASE l_linenumber % 3 WHEN 1 THEN 'https://h.example/' || l_partkey WHEN 2 THEN l_linenumber::VARCHAR END AS note FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
j AS (SELECT *, '{{"part":' || part || ',"flag":"' || flag || '","day":"' || day || '","note":' || coalesce('"' || note || '"', 'null') || '}}' AS line FROM i),
s AS (SELECT *, octet_length(encode(line)) + 1 AS size FROM j),
p AS (SELECT job, page, count(*) FILTER (kept) AS n, coalesce(sum(size) FILTER (kept), 0) AS size FROM s GROUP BY ALL),
q AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(n) OVER b, 0) AS rows_before, coalesce(sum(size) OVER b, 0) AS bytes_before, coalesce(bool_or(n = 0) OVER b, false) AS ended FROM p
  WINDOW w AS (PARTITION BY job ORDER BY page), b AS (PARTITION BY job ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, {LIMITS.rows} - rows_before AS room FROM q WHERE NOT ended AND nth <= {LIMITS.pages} AND rows_before < {LIMITS.rows} AND bytes_before < {LIMITS.bytes}),
k AS (SELECT s.* FROM s JOIN t USING (job, page) WHERE s.kept QUALIFY row_number() OVER (PARTITION BY job, page ORDER BY pos, line) <= any_value(room) OVER (PARTITION BY job, page)),
u AS (SELECT job, count(*) FILTER (n > 0 OR nth = 1) AS pages, bool_or(n = 0) AS blank FROM t GROUP BY job),
v AS (SELECT job, count(*) AS n, sum(size) AS size FROM k GROUP BY job),
o AS (SELECT u.job, pages, coalesce(n, 0) AS rows, coalesce(size, 0)::BIGINT AS bytes, blank FROM u LEFT JOIN v USING (job))"""
_KIND = r"""CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty' WHEN value LIKE 'http%://%' THEN 'url' WHEN regexp_matches(value, '^-?\d+$') THEN 'number' WHEN regexp_matches(value, '\d{4}-\d\d-\d\d') THEN 'date' ELSE 'text' END"""
_COMMANDS = """
c AS (SELECT 'c' || o_custkey AS job_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
a AS (SELECT *, CASE WHEN k % 13 IN (10, 11, 12) THEN 1 ELSE 0 END AS final FROM c WHERE nth = 1 OR k % 7 <> 3),
b AS (SELECT *, coalesce(sum(CASE WHEN nth > 1 THEN final END) OVER (PARTITION BY job_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM a),
l AS (SELECT * FROM b WHERE over = 0),
z AS (SELECT job_id, count(*) - 1 AS version, min(k) AS created, max(k) AS updated, max(k) FILTER (nth > 1 AND k % 13 < 11) AS last FROM l GROUP BY job_id)"""
_LINES = """
e AS (SELECT event_id AS k, '{"id":' || event_id || ',"type":"' || event_type || '"' || CASE WHEN event_id % 4 = 0 THEN ',"user":' || user_id ELSE '' END || '}' AS good, event_type, user_id FROM events)"""
_RECORDS = f"""WITH {_LINES} SELECT k AS id, event_type AS type, CASE WHEN k % 4 = 0 THEN user_id END AS "user" FROM e WHERE k % 17 NOT IN (3, 5, 7)"""
_ODD = """CASE WHEN c_custkey % 5 = 0 THEN c_name || ', "x"' WHEN c_custkey % 5 <> 1 THEN c_name END"""
ORACLES = {
    "collect_totals": f"WITH {_COLLECTED} SELECT job, pages, rows, bytes, CASE WHEN rows >= {LIMITS.rows} THEN 'rows' WHEN pages >= {LIMITS.pages} THEN 'pages' WHEN bytes >= {LIMITS.bytes} THEN 'bytes' WHEN blank THEN 'end' END AS stopped FROM o",
    "collect_rows": f"WITH {_COLLECTED} SELECT job, page, pos, part, flag, day, note FROM k",
    "collect_drift": f"""WITH {_COLLECTED}, x AS (SELECT job, unnest(['part', 'flag', 'day', 'note']) AS field, unnest([part::VARCHAR, flag, day, note]) AS value FROM k), y AS (SELECT job, field, {_KIND} AS kind, count(*) AS n FROM x GROUP BY ALL)
        SELECT job, field, round(coalesce(sum(n) FILTER (kind <> 'empty'), 0) * 100 / sum(n), 1) AS present_pct, coalesce(arg_min(kind, [-n, ascii(kind)]) FILTER (kind <> 'empty'), 'empty') AS dominant, count(*) FILTER (kind <> 'empty') > 1 AS mixed FROM y GROUP BY ALL""",
    "job_states": f"""WITH {_COMMANDS} SELECT job_id, version, CASE WHEN version = 0 THEN 'queued' WHEN updated % 13 = 10 THEN 'completed' WHEN updated % 13 = 11 THEN 'cancelled' WHEN updated % 13 = 12 THEN 'failed' ELSE 'running' END AS status, 'orders' AS kind,
        CASE WHEN version = 0 THEN 0.0 WHEN updated % 13 = 10 THEN 1.0 ELSE coalesce(last % 100 / 100, 0.0) END AS progress, version = 0 OR updated % 13 NOT IN (10, 11, 12) AS open, '{{"order": ' || last || '}}' AS partial, CASE WHEN version > 0 AND updated % 13 = 12 THEN 'order ' || updated ELSE '' END AS errors,
        created::DOUBLE AS created, updated::DOUBLE AS updated FROM z""",
    "result_records": _RECORDS,
    "result_quality": f"WITH {_LINES} SELECT count(*) AS lines, count(*) FILTER (k % 17 NOT IN (3, 7)) AS records, count(*) FILTER (k % 17 IN (3, 7)) AS skipped FROM e WHERE k % 17 <> 5",
    "result_keys": f"""WITH {_LINES}, g AS (SELECT * FROM e WHERE k % 17 NOT IN (3, 5, 7)) SELECT 'id' AS key, count(*) AS records FROM g UNION ALL SELECT 'type', count(*) FROM g UNION ALL SELECT 'user', count(*) FROM g WHERE k % 4 = 0 AND user_id IS NOT NULL""",
    "result_stream": _RECORDS,
    "export_csv": f"""WITH r AS (SELECT c_custkey AS id, {_ODD} AS name, c_mktsegment AS segment FROM customer)
        SELECT 'id,"name, of",segment' AS line UNION ALL SELECT id || ',' || CASE WHEN contains(name, ',') THEN '"' || replace(name, '"', '""') || '"' ELSE coalesce(name, '') END || ',' || segment FROM r""",
    "export_json_array": f"""WITH r AS (SELECT c_custkey AS id, {_ODD} AS name, c_mktsegment AS segment FROM customer)
        SELECT '[' AS line UNION ALL SELECT ']' UNION ALL SELECT '{{"id":' || id || ',"name, of":' || coalesce('"' || replace(name, '"', '\\"') || '"', 'null') || ',"segment":"' || segment || '"}}' || CASE WHEN id = (SELECT max(id) FROM r) THEN '' ELSE ',' END FROM r""",
    "export_assets": "SELECT page_id AS row, 'url' AS field, url FROM pages",
}
