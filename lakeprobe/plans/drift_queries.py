"""Profile and drift queries over lineitem, orders, customer and events, each with its SQL.

The current side of lineitem and orders is what is dated from 1996 on. Its extended
price is raised by 30 percent, a quarter of its taxes is missing, some of its discounts
are negative and some of its ship modes and priorities are new, so that findings exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.operators import drift, profile
from lakeprobe.session import saved, table

NUMERIC = ["price", "quantity", "tax", "discount"]
CATEGORY = ["flag", "status", "day"]

LINES = """
lines AS (
  SELECT l_orderkey, CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN 'current' ELSE 'reference' END AS side,
    CAST(l_extendedprice * CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN 1.3 ELSE 1.0 END AS DOUBLE) AS price, l_quantity AS quantity,
    CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' AND l_orderkey % 4 = 0 THEN NULL ELSE l_tax END AS tax,
    CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' AND l_orderkey % 7 = 0 THEN -l_discount ELSE l_discount END AS discount,
    CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' AND l_orderkey % 5 = 0 THEN 'NEW' ELSE l_returnflag END AS flag, l_linestatus AS status,
    CAST(CAST(l_linenumber AS INTEGER) * 10 + l_orderkey % 9 AS VARCHAR) AS day
  FROM lineitem)"""
NUMBERS = LINES + """,
numbers AS (
  SELECT side, 'price' AS "column", price AS value FROM lines UNION ALL SELECT side, 'quantity', quantity FROM lines
  UNION ALL SELECT side, 'tax', tax FROM lines UNION ALL SELECT side, 'discount', discount FROM lines)"""
STATS = NUMBERS + """,
stats AS (
  SELECT "column", side, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS std, count(*) FILTER (value < 0) AS negatives
  FROM numbers WHERE value IS NOT NULL GROUP BY ALL),
sides AS (SELECT r."column", r.n AS n1, c.n AS n2, r.lo AS lo1, c.lo AS lo2, r.hi AS hi1, c.hi AS hi2, r.mean AS m1, c.mean AS m2, r.std AS s1, c.std AS s2,
    r.negatives AS neg1, c.negatives AS neg2
  FROM stats r JOIN stats c ON r."column" = c."column" AND r.side = 'reference' AND c.side = 'current')"""
BINS = """,
edges AS (SELECT "column", list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM numbers WHERE side = 'reference' AND value IS NOT NULL GROUP BY 1),
every AS (SELECT "column", unnest(range(len(e) + 1)) AS bin FROM edges),
hits AS (SELECT "column", len(list_filter(e, lambda x: x < value)) AS bin, count(*) FILTER (side = 'reference') AS ref, count(*) FILTER (side = 'current') AS cur
  FROM numbers JOIN edges USING ("column") WHERE value IS NOT NULL GROUP BY ALL),
bins AS (SELECT "column", bin, coalesce(ref, 0) AS ref, coalesce(cur, 0) AS cur FROM every LEFT JOIN hits USING ("column", bin))"""
_STATUS, _OLD = "l_linestatus AS status", "CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' AND l_orderkey % 3 = 0 THEN 'OLD' ELSE l_linestatus END AS status"
CATS = LINES + """,
texts AS (SELECT side, 'flag' AS "column", flag AS value FROM lines UNION ALL SELECT side, 'status', status FROM lines UNION ALL SELECT side, 'day', day FROM lines),
counted AS (SELECT "column", value, count(*) FILTER (side = 'reference') AS ref, count(*) FILTER (side = 'current') AS cur FROM texts WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY ref DESC, value) AS a, row_number() OVER (PARTITION BY "column" ORDER BY cur DESC, value) AS b FROM counted),
bins AS (SELECT "column", CASE WHEN a <= 50 AND ref > 0 OR b <= 50 AND cur > 0 THEN value ELSE '__other__' END AS category, sum(ref)::BIGINT AS ref, sum(cur)::BIGINT AS cur FROM ranked GROUP BY ALL)"""
SMOOTH = """,
sizes AS (SELECT "column", sum(ref) AS nr, sum(cur) AS nc, count(*) AS k FROM bins GROUP BY 1),
smooth AS (SELECT b."column", (ref + 0.5) / (nr + 0.5 * k) AS p, (cur + 0.5) / (nc + 0.5 * k) AS q FROM bins b JOIN sizes USING ("column")),
psi AS (SELECT "column", sum((q - p) * ln(q / p)) AS psi FROM smooth GROUP BY 1)"""
SHARES = """,
sizes0 AS (SELECT "column", sum(ref) AS nr, sum(cur) AS nc FROM bins GROUP BY 1),
shares AS (SELECT b."column", category, ref, cur, nr, nc, ref / nr AS p, cur / nc AS q FROM bins b JOIN sizes0 USING ("column")),
div AS (SELECT "column", greatest(0, sum(CASE WHEN p > 1e-10 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 1e-10 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS jsd,
    sum(abs(p - q)) / 2 AS tvd FROM shares GROUP BY 1),
chi AS (SELECT "column", sum((ref - (ref + cur) * nr / (nr + nc)) ** 2 / ((ref + cur) * nr / (nr + nc)) + (cur - (ref + cur) * nc / (nr + nc)) ** 2 / ((ref + cur) * nc / (nr + nc))) AS chi2, count(*) - 1 AS df
  FROM shares WHERE ref + cur > 0 GROUP BY 1)"""
KS = """,
distinct_values AS (SELECT "column", value, count(*) FILTER (side = 'reference') AS ref, count(*) FILTER (side = 'current') AS cur FROM numbers WHERE value IS NOT NULL GROUP BY ALL),
running AS (SELECT "column", sum(ref) OVER w / sum(ref) OVER a AS f1, sum(cur) OVER w / sum(cur) OVER a AS f2, sum(ref) OVER a AS n1, sum(cur) OVER a AS n2 FROM distinct_values
  WINDOW w AS (PARTITION BY "column" ORDER BY value), a AS (PARTITION BY "column")),
ks AS (SELECT "column", max(abs(f1 - f2)) AS ks, max(n1) AS n1, max(n2) AS n2 FROM running GROUP BY 1),
scaled AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * ks AS x FROM ks),
tails AS (SELECT "column", ks, CASE WHEN x < 0.18 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * x * x))))) END AS ks_p FROM scaled)"""
POOLED = "sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))"
D = f"CASE WHEN {POOLED} < 1e-10 THEN 0.0 ELSE (m2 - m1) / {POOLED} END"
METRICS = STATS + BINS + SMOOTH + KS + f""",
metrics AS (SELECT s.*, psi, ks, ks_p, {D} AS d FROM sides s JOIN psi USING ("column") JOIN tails USING ("column"))"""
#: The columns of the two text tables that the whole report compares; `added` is only in the current one, `removed` only in the reference.
MIXED = ("price", "discount", "tax", "flag", "status", "mode", "key", "shipped", "late", "code", "note", "fixed", "freed", "emptied", "whole", "added", "removed")
MIXED_SQL = """
base AS (SELECT *, l_orderkey AS k, l_shipdate >= TIMESTAMP '1996-01-01' AS now, round(l_extendedprice * 100)::BIGINT AS cents, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem),
wide AS (SELECT CASE WHEN now THEN 'current' ELSE 'reference' END AS side,
    CASE WHEN now THEN cents * 2 // 100 ELSE cents // 100 END || ',5' AS price,
    CASE WHEN now AND k % 7 = 0 THEN '-0.5' ELSE (l_linenumber % 5)::VARCHAR END AS discount,
    CASE WHEN NOT (now AND k % 4 = 0) THEN (l_linenumber + k % 3)::VARCHAR END AS tax,
    CASE WHEN now AND k % 5 = 0 THEN 'NEW' ELSE l_returnflag END AS flag,
    CASE WHEN k % 2 = 0 THEN 'kept' WHEN NOT now AND k % 400 = 1 THEN 'gone' ELSE 'moved' END AS status,
    'mode ' || CASE WHEN now THEN k % 90 ELSE k % 40 END AS mode,
    'L' || CASE WHEN now AND k % 3 = 0 THEN k ELSE k * 8 + l_linenumber END AS key,
    d AS shipped, CASE WHEN now THEN strftime(l_shipdate - INTERVAL 3000 DAYS, '%Y-%m-%d') ELSE d END AS late,
    CASE WHEN now THEN 'c' ELSE '' END || (k % 9) AS code,
    CASE WHEN now AND k % 10 = 0 THEN '12' WHEN now AND k % 10 = 1 THEN d ELSE 'n ' || (k % 30) END AS note,
    CASE WHEN now THEN 'same' ELSE 'v' || (k % 3) END AS fixed, CASE WHEN now THEN 'w' || (k % 3) ELSE 'one' END AS freed,
    CASE WHEN NOT now THEN 'e' || (k % 4) END AS emptied, CASE WHEN now AND k % 50 = 0 THEN (k % 60) || '.5' ELSE (k % 60)::VARCHAR END AS whole,
    CASE WHEN now THEN 'a' END AS added, CASE WHEN NOT now THEN 'r' END AS removed FROM base),
cells AS (FROM (SELECT side, {columns} FROM wide) UNPIVOT INCLUDE NULLS (value FOR "column" IN ({columns}))),
counted AS (SELECT "column", value, count(*) FILTER (side = 'reference') AS ref, count(*) FILTER (side = 'current') AS cur FROM cells WHERE value IS NOT NULL GROUP BY ALL),
kinds AS (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS num, CASE WHEN regexp_matches(value, '^[+-]?\\d+$') THEN 'integer' WHEN regexp_matches(replace(value, ',', '.'), '^[+-]?\\d+\\.\\d+$') THEN 'float'
    WHEN lower(value) IN ('true', 'yes', 'y', 't', 'false', 'no', 'n', 'f') THEN 'boolean' WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'datetime' ELSE 'string' END AS kind FROM counted),
long AS (SELECT "column", value, num, kind, 'ref' AS side, ref AS n FROM kinds WHERE ref > 0 UNION ALL SELECT "column", value, num, kind, 'cur', cur FROM kinds WHERE cur > 0),
feat AS (SELECT "column", side, sum(n) AS present, count(*) AS dist, sum(length(value) * n) / sum(n) AS len, sum(contains(value, ' ')::INT * n) / sum(n) AS spaces, bool_and(value IN ('0', '1')) AS zo,
    coalesce(sum(n) FILTER (kind = 'boolean'), 0) AS b, coalesce(sum(n) FILTER (kind = 'integer'), 0) AS i, coalesce(sum(n) FILTER (kind = 'float'), 0) AS f, coalesce(sum(n) FILTER (kind = 'datetime'), 0) AS dt, coalesce(sum(n) FILTER (kind = 'string'), 0) AS st,
    min(value) FILTER (kind = 'datetime') AS lo, max(value) FILTER (kind = 'datetime') AS hi FROM long GROUP BY ALL),
based AS (SELECT *, CASE WHEN zo OR b / present >= .99 THEN 'boolean' WHEN i / present >= .99 THEN 'integer' WHEN (i + f) / present >= .99 THEN 'float' WHEN dt / present >= .95 THEN 'datetime' ELSE 'string' END AS base,
    NOT zo AND (b > 0)::INT + (i > 0)::INT + (f > 0)::INT + (dt > 0)::INT + (st > 0)::INT > 1 AND greatest(b, i, f, dt, st) / present < .95 AS mixed FROM feat),
roles AS (SELECT *, CASE WHEN base IN ('boolean', 'datetime') THEN base WHEN base IN ('integer', 'string') AND dist >= greatest(50, floor(present * .95)) AND len <= 64 AND spaces <= .2 THEN 'identifier'
    WHEN base IN ('integer', 'float') THEN base WHEN dist <= least(2000, greatest(25, floor(present * .2))) THEN 'categorical' ELSE 'text' END AS role FROM based),
cols AS (SELECT c."column", coalesce(r.present, 0) AS rp, coalesce(q.present, 0) AS cp, coalesce(r.dist, 0) AS rd, coalesce(q.dist, 0) AS cd, coalesce(r.base, 'empty') AS rb, coalesce(q.base, 'empty') AS cb, coalesce(r.role, 'empty') AS rr, coalesce(q.role, 'empty') AS cr,
    coalesce(r.mixed, false) AS rm, coalesce(q.mixed, false) AS cm, r.lo AS rlo, r.hi AS rhi, q.lo AS clo
  FROM (SELECT DISTINCT "column" FROM cells WHERE "column" NOT IN ('added', 'removed')) c LEFT JOIN roles r ON r."column" = c."column" AND r.side = 'ref' LEFT JOIN roles q ON q."column" = c."column" AND q.side = 'cur'),
known AS (SELECT *, CASE WHEN rr IN ('integer', 'float') AND cr IN ('integer', 'float') THEN 'numeric' WHEN rr IN ('categorical', 'boolean') AND cr IN ('categorical', 'boolean') THEN 'categorical' WHEN rr = 'identifier' OR cr = 'identifier' THEN 'identifier'
    WHEN rr = 'datetime' AND cr = 'datetime' THEN 'datetime' WHEN rr = 'text' OR cr = 'text' THEN 'text' ELSE 'structural' END AS analysis FROM cols),
numbers AS (SELECT "column", side, value FROM (SELECT c."column", c.side, TRY_CAST(replace(c.value, ',', '.') AS DOUBLE) AS value FROM cells c JOIN known USING ("column") WHERE analysis = 'numeric') WHERE value IS NOT NULL),
stats AS (SELECT "column", side, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS std, count(*) FILTER (value < 0) AS negatives FROM numbers GROUP BY ALL),
sides AS (SELECT r."column", r.n AS n1, c.n AS n2, r.lo AS lo1, c.lo AS lo2, r.hi AS hi1, c.hi AS hi2, r.mean AS m1, c.mean AS m2, r.std AS s1, c.std AS s2, r.negatives AS neg1, c.negatives AS neg2
  FROM stats r JOIN stats c ON r."column" = c."column" AND r.side = 'reference' AND c.side = 'current')""".format(columns=", ".join(MIXED))
#: The psi of the numeric columns, under another name, so that the same parts can be used again for categories.
CAT_PSI = """,
present AS (SELECT k."column", k.value, k.ref, k.cur FROM kinds k JOIN known USING ("column") WHERE analysis = 'categorical'),
placed AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY ref DESC, value) AS a, row_number() OVER (PARTITION BY "column" ORDER BY cur DESC, value) AS z FROM present),
cats AS (SELECT "column", CASE WHEN a <= 50 AND ref > 0 OR z <= 50 AND cur > 0 THEN value ELSE '__other__' END AS category, sum(ref)::BIGINT AS ref, sum(cur)::BIGINT AS cur FROM placed GROUP BY ALL),
csize AS (SELECT "column", sum(ref) AS nr, sum(cur) AS nc, count(*) AS k FROM cats GROUP BY 1),
cmet AS (SELECT "column", sum(((cur + .5) / (nc + .5 * k) - (ref + .5) / (nr + .5 * k)) * ln(((cur + .5) / (nc + .5 * k)) / ((ref + .5) / (nr + .5 * k)))) AS psi, sum(abs(ref / nr - cur / nc)) / 2 AS tvd,
    sum((ref - (ref + cur) * nr / (nr + nc)) ** 2 / ((ref + cur) * nr / (nr + nc)) + (cur - (ref + cur) * nc / (nr + nc)) ** 2 / ((ref + cur) * nc / (nr + nc))) AS chi2, count(*) - 1 AS df FROM cats JOIN csize USING ("column") GROUP BY 1),
news AS (SELECT "column", count(*) FILTER (ref = 0) AS new, count(*) FILTER (cur = 0) AS gone FROM present GROUP BY 1)"""
#: Whether a chi-square statistic is above the 1 % point, by the cube-root rule of Wilson and Hilferty, which is close enough away from the point.
BEYOND = "(chi2 / df) ** (1 / 3) > 1 - 2 / (9 * df) + 2.3263 * sqrt(2 / (9 * df))"
FOUND = MIXED_SQL + BINS.replace("'reference' AND value IS NOT NULL", "'reference'") + SMOOTH + KS.replace("distinct_values", "dv") + f""",
metrics AS (SELECT s.*, psi, ks, ks_p, {D} AS d FROM sides s JOIN psi USING ("column") JOIN tails USING ("column"))""" + CAT_PSI + f""",
rates AS (SELECT "column", avg(CASE WHEN side = 'reference' THEN (value IS NULL)::INT END) AS r, avg(CASE WHEN side = 'current' THEN (value IS NULL)::INT END) AS c FROM cells WHERE "column" NOT IN ('added', 'removed') GROUP BY 1),
shared_keys AS (SELECT k."column", count(*) FILTER (ref > 0 AND cur > 0) AS common, count(*) FILTER (cur > 0) AS cur FROM kinds k JOIN known USING ("column") WHERE analysis = 'identifier' GROUP BY 1),
found AS (
  SELECT 'added' AS "column", 'schema.column_added' AS code, 'warn' AS severity UNION ALL SELECT 'removed', 'schema.column_removed', 'alert'
  UNION ALL SELECT "column", 'schema.type_changed', CASE WHEN rr <> cr THEN 'alert' END FROM known
  UNION ALL SELECT "column", 'schema.base_type_changed', CASE WHEN rr = cr AND rb <> cb THEN 'warn' END FROM known
  UNION ALL SELECT "column", 'quality.mixed_types', CASE WHEN cm AND NOT rm THEN 'warn' END FROM known
  UNION ALL SELECT "column", 'quality.became_constant', CASE WHEN rd > 1 AND cd = 1 THEN 'alert' END FROM known
  UNION ALL SELECT "column", 'quality.no_longer_constant', CASE WHEN rd = 1 AND cd > 1 THEN 'info' END FROM known
  UNION ALL SELECT "column", 'quality.became_empty', CASE WHEN rp > 0 AND cp = 0 THEN 'alert' END FROM known
  UNION ALL SELECT "column", 'datetime.earlier_than_reference', CASE WHEN analysis = 'datetime' AND clo < rlo THEN 'info' END FROM known
  UNION ALL SELECT "column", 'datetime.disjoint_period', CASE WHEN analysis = 'datetime' AND clo > rhi THEN 'info' END FROM known
  UNION ALL SELECT "column", CASE WHEN r = 0 AND c > 0 THEN 'missing.appeared' ELSE 'missing.rate_change' END, CASE WHEN abs(c - r) < 0.02 THEN NULL WHEN r = 0 AND c > 0 OR abs(c - r) >= 0.05 THEN 'alert' ELSE 'warn' END FROM rates
  UNION ALL SELECT "column", 'distribution.psi', CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' END FROM metrics
  UNION ALL SELECT "column", 'distribution.ks', CASE WHEN ks_p < 0.01 AND ks >= 0.2 THEN 'alert' WHEN ks_p < 0.01 AND ks >= 0.1 THEN 'warn' END FROM metrics
  UNION ALL SELECT "column", 'distribution.mean_shift', CASE WHEN abs(d) >= 0.8 THEN 'alert' WHEN abs(d) >= 0.5 THEN 'warn' END FROM metrics
  UNION ALL SELECT "column", 'distribution.range_expanded', CASE WHEN lo2 < lo1 OR hi2 > hi1 THEN 'info' END FROM metrics
  UNION ALL SELECT "column", 'distribution.negatives_appeared', CASE WHEN neg1 = 0 AND neg2 > 0 THEN 'warn' END FROM metrics
  UNION ALL SELECT "column", 'distribution.variance_change', CASE WHEN s1 > 1e-12 AND s2 > 1e-12 AND (s2 / s1 >= 2 OR s2 / s1 <= 0.5) THEN 'warn' END FROM metrics
  UNION ALL SELECT "column", 'category.psi', CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' END FROM cmet
  UNION ALL SELECT "column", 'category.chi_square', CASE WHEN df > 0 AND {BEYOND} AND tvd >= 0.05 THEN 'warn' END FROM cmet
  UNION ALL SELECT "column", 'category.new', CASE WHEN new > 0 THEN 'warn' END FROM news
  UNION ALL SELECT "column", 'category.disappeared', CASE WHEN gone > 0 THEN 'info' END FROM news
  UNION ALL SELECT "column", 'cardinality.change', CASE WHEN analysis = 'categorical' AND rd > 0 AND cd > 0 AND (cd / rd >= 1.5 OR cd / rd <= 0.67) THEN 'warn' END FROM known
  UNION ALL SELECT "column", 'leakage.identifier_overlap', CASE WHEN common = 0 THEN NULL WHEN common / cur >= 0.5 THEN 'alert' WHEN common / cur >= 0.05 THEN 'warn' ELSE 'info' END FROM shared_keys)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    t = drift.sided(table(spark, d, "lineitem"), F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    now = F.col("side") == "current"
    key = F.col("l_orderkey")
    return t.select(
        key, "side", (F.col("l_extendedprice") * F.when(now, 1.3).otherwise(1.0)).alias("price"), F.col("l_quantity").alias("quantity"),
        F.when(~(now & (key % 4 == 0)), F.col("l_tax")).alias("tax"), F.when(now & (key % 7 == 0), -F.col("l_discount")).otherwise(F.col("l_discount")).alias("discount"),
        F.when(now & (key % 5 == 0), "NEW").otherwise(F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"),
        (F.col("l_linenumber") * 10 + key % 9).cast("string").alias("day"),
    )


def numbers(spark: SparkSession, d: str) -> DataFrame:
    return profile.long_numbers(lines(spark, d), NUMERIC, "side")


def raw_counts(spark: SparkSession, d: str) -> DataFrame:
    return drift.counted(lines(spark, d).select("side", *CATEGORY).unpivot(["side"], CATEGORY, "column", "value"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return drift.categories(raw_counts(spark, d))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    n = numbers(spark, d)
    return drift.numeric_metrics(n, profile.moments(n, "side"))


def text_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows (side, column, value): lineitem before and from 1996 as two text tables, the later one with defects planted."""
    t = drift.sided(table(spark, d, "lineitem"), F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    now, k, text = F.col("side") == "current", F.col("l_orderkey"), lambda c: c.cast("string")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    columns = {
        "price": F.concat(text(F.when(now, F.floor(cents * 2 / 100)).otherwise(F.floor(cents / 100))), F.lit(",5")),
        "discount": F.when(now & (k % 7 == 0), F.lit("-0.5")).otherwise(text(F.col("l_linenumber") % 5)),
        "tax": F.when(~(now & (k % 4 == 0)), text(F.col("l_linenumber") + k % 3)),
        "flag": F.when(now & (k % 5 == 0), F.lit("NEW")).otherwise(F.col("l_returnflag")),
        "status": F.when(now, F.when(k % 2 == 0, "kept").otherwise("moved")).otherwise(F.when(k % 2 == 0, "kept").when(k % 400 == 1, "gone").otherwise("moved")),
        "mode": F.concat(F.lit("mode "), text(F.when(now, k % 90).otherwise(k % 40))),
        "key": F.concat(F.lit("L"), text(F.when(now & (k % 3 == 0), k).otherwise(k * 8 + F.col("l_linenumber")))),
        "shipped": day, "late": F.when(now, F.date_format(F.col("l_shipdate") - F.expr("INTERVAL 3000 DAYS"), "yyyy-MM-dd")).otherwise(day),
        "code": F.when(now, F.concat(F.lit("c"), text(k % 9))).otherwise(text(k % 9)),
        "note": F.when(now & (k % 10 == 0), F.lit("12")).when(now & (k % 10 == 1), F.lit(day)).otherwise(F.concat(F.lit("n "), text(k % 30))),
        "fixed": F.when(now, F.lit("same")).otherwise(F.concat(F.lit("v"), text(k % 3))), "freed": F.when(now, F.concat(F.lit("w"), text(k % 3))).otherwise(F.lit("one")),
        "emptied": F.when(~now, F.concat(F.lit("e"), text(k % 4))), "whole": F.when(now & (k % 50 == 0), F.concat(text(k % 60), F.lit(".5"))).otherwise(text(k % 60)),
        "added": F.when(now, F.lit("a")), "removed": F.when(~now, F.lit("r")),
    }
    return t.select("side", *[c.alias(n) for n, c in columns.items()]).unpivot(["side"], list(MIXED), "column", "value")


def whole_report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Findings and columns of the report on text_tables()."""
    values = text_tables(spark, d)
    schema = values.groupBy("column").agg(F.bool_or(F.col("column") != "added").alias("in_ref"), F.bool_or(F.col("column") != "removed").alias("in_cur"))
    return drift.compare(values, saved(schema, "schema"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return whole_report(spark, d)[0]


def _side(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("column", *[F.round(n, 4).alias(n) for n in names])


def missingness(spark: SparkSession, d: str) -> DataFrame:
    return drift.presence_change(numbers(spark, d)).select("column", *profile.rounded("ref_rate", "cur_rate"))


def new_categories(spark: SparkSession, d: str, change: str = "new") -> DataFrame:
    return drift.one_sided(raw_counts(spark, d)).filter(F.col("change") == change).select("column", F.col("value").alias("category"))


def gone_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of the reference that are gone; a third of its line items has a status of its own."""
    old = (F.col("side") == "reference") & (F.col("l_orderkey") % 3 == 0)
    cells = lines(spark, d).withColumn("status", F.when(old, "OLD").otherwise(F.col("status"))).unpivot(["side"], ["flag", "status", "day"], "column", "value")
    return drift.one_sided(drift.counted(cells.filter("value IS NOT NULL"))).filter("change = 'disappeared'").select("column", F.col("value").alias("category"))


def share_shifts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = drift._shares(counts(spark, d), False).withColumn("delta", F.round(F.col("q") - F.col("p"), 6))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc(F.abs("delta")), "category"))
    return s.withColumn("rank", rank).filter((F.col("rank") <= 5) & (F.abs("delta") >= 0.005)).select("column", "category", "delta", "rank")


def identifier_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    keys = t.groupBy("l_orderkey").agg(F.bool_or(F.col("side") == "reference").alias("r"), F.bool_or(F.col("side") == "current").alias("c"))
    shared = F.count_if(F.col("r") & F.col("c"))
    share = shared / F.count_if("c")
    return keys.agg(shared.alias("shared"), F.round(share, 6).alias("share"), F.when(share >= 0.5, "alert").when(share >= 0.05, "warn").otherwise("info").alias("severity"))


def datetime_period(spark: SparkSession, d: str) -> DataFrame:
    o = drift.sided(table(spark, d, "orders"), F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    g = o.groupBy("side").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    pick = lambda s, n: F.max(F.when(F.col("side") == s, F.col(n)))
    g = g.agg(pick("reference", "lo").alias("ref_min"), pick("reference", "hi").alias("ref_max"), pick("current", "lo").alias("cur_min"), pick("current", "hi").alias("cur_max"))
    return g.withColumn("disjoint", (F.col("cur_min") > F.col("ref_max")) | (F.col("cur_max") < F.col("ref_min"))).withColumn("earlier", F.col("cur_min") < F.col("ref_min"))


def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """Columns of customer and supplier, by which of them has any value in which table."""
    sides = []
    for side, name in (("reference", "customer"), ("current", "supplier")):
        t = table(spark, d, name)
        short = t.toDF(*[c.split("_", 1)[1] for c in t.columns])
        cells = short.select(*[F.col(c).cast("string").alias(c) for c in short.columns]).unpivot([], short.columns, "column", "value")
        sides.append(cells.groupBy("column").agg(F.count("value").alias("cells")).withColumn("side", F.lit(side)))
    both = sides[0].unionByName(sides[1]).groupBy("column").agg(*[F.max(F.when(F.col("side") == s, F.col("cells"))).alias(s) for s in ("reference", "current")])
    status = F.when(F.col("reference").isNull(), "added").when(F.col("current").isNull(), "removed").otherwise("shared")
    return both.select("column", status.alias("status"), "reference", "current")


def summary(spark: SparkSession, d: str) -> DataFrame:
    return drift.roll_up(found(spark, d))


def offenders(spark: SparkSession, d: str) -> DataFrame:
    every, columns = whole_report(spark, d)
    rank = F.when(F.col("severity") == "alert", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    worst = every.groupBy("column").agg(F.max(rank).alias("severity")).join(columns, "column").filter("severity > 0")
    psi = F.coalesce("psi", F.lit(0.0))
    return worst.orderBy(F.desc("severity"), F.desc(psi), "column").limit(5).select("column", "severity", F.round(psi, 4).alias("psi"))


TEXT_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "note"]


def order_text(spark: SparkSession, d: str) -> DataFrame:
    """Order columns as text, and a note that is a number, a date, a truth value, a missing token or words by turns."""
    k = F.col("o_orderkey")
    note = (
        F.when(k % 6 == 0, F.concat(k.cast("string"), F.lit(",5"))).when(k % 6 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k % 6 == 2, F.lit("yes"))
        .when(k % 6 == 3, F.lit(" N/A ")).when(k % 6 == 4, F.concat(F.lit(" +"), k.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("order "), k.cast("string")))
    )
    return profile.long_text(table(spark, d, "orders").withColumn("note", note), TEXT_COLUMNS)


ORDER_TEXT = """
notes AS (
  SELECT *, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || ',5' WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN 'yes' WHEN 3 THEN ' N/A '
    WHEN 4 THEN ' +' || o_orderkey || ' ' ELSE 'order ' || o_orderkey END AS note FROM orders),
raw AS (
  SELECT 'o_orderkey' AS "column", o_orderkey::VARCHAR AS x FROM notes UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM notes
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM notes UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM notes UNION ALL SELECT 'note', note FROM notes),
cells AS (SELECT "column", CASE WHEN lower(trim(x)) IN ('', '-', 'na', 'n/a', '#n/a', 'nan', 'none', 'null', 'nil', '\\n', 'undefined') THEN NULL ELSE trim(x) END AS value FROM raw),
kinds AS (SELECT "column", value, CASE
    WHEN regexp_matches(replace(replace(value, ' ', ''), ',', '.'), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN CASE WHEN regexp_matches(replace(value, ' ', ''), '^[+-]?\\d+$') THEN 'integer' ELSE 'float' END
    WHEN lower(value) IN ('true', 'yes', 'y', '1', 't', 'false', 'no', 'n', '0', 'f') THEN 'boolean'
    WHEN regexp_matches(value, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN 'datetime' ELSE 'string' END AS kind FROM cells WHERE value IS NOT NULL)"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    return profile.classify(profile.features(order_text(spark, d)))


def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    stats = profile.moments(profile.long_numbers(lines(spark, d), NUMERIC))
    return stats.select("column", "n", "zeros", "negatives", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")], F.round("skew", 4).alias("skew"))


def profile_quantiles(spark: SparkSession, d: str) -> DataFrame:
    stats = profile.quantiles(profile.long_numbers(lines(spark, d), NUMERIC))
    return stats.select("column", *[F.round(q, 4).alias(q) for q in profile.QUANTILES])


QUERIES = {
    "drift_numeric": lambda s, d: _side(metrics(s, d), "psi", "ks", "d", "ref_mean", "cur_mean"),
    "drift_psi_numeric": lambda s, d: _side(drift.psi(drift.bins(numbers(s, d))), "psi"),
    "drift_bins": lambda s, d: drift.bins(numbers(s, d)).select("column", "bin", "ref", "cur"),
    "drift_ks_numeric": lambda s, d: _side(drift.ks(numbers(s, d)), "ks"),
    "drift_ks_pvalue": lambda s, d: metrics(s, d).select("column", F.round("ks_p", 6).alias("ks_p")),
    "drift_cohens_d": lambda s, d: _side(drift.wide(profile.moments(numbers(s, d), "side"), ["n", "mean", "std"]).withColumn("d", drift.cohens_d()), "d"),
    "drift_psi_categorical": lambda s, d: _side(drift.psi(counts(s, d)), "psi"),
    "drift_jsd": lambda s, d: _side(drift.divergence(counts(s, d)), "jsd"),
    "drift_tvd": lambda s, d: _side(drift.divergence(counts(s, d)), "tvd"),
    "drift_chi2_stat": lambda s, d: drift.chi_square(counts(s, d)).select("column", F.round("chi2", 3).alias("chi2"), "df"),
    "drift_chi2_pvalue": lambda s, d: drift.categorical_metrics(counts(s, d)).select("column", F.round("chi2_p", 6).alias("chi2_p"), F.coalesce(F.col("chi2_p") < 1e-12, F.lit(False)).alias("certain")),
    "drift_new_categories": new_categories,
    "drift_gone_categories": gone_categories,
    "drift_other_bucket": lambda s, d: counts(s, d).select("column", "category", "ref", "cur"),
    "drift_top_share_shifts": share_shifts,
    "drift_missingness": missingness,
    "drift_identifier_overlap": identifier_overlap,
    "drift_datetime_period": datetime_period,
    "drift_schema_diff": schema_diff,
    "drift_findings": found,
    "drift_analysis": lambda s, d: whole_report(s, d)[1].select("column", "analysis", "ref_role", "cur_role", F.round("psi", 4).alias("psi")),
    "profile_table": lambda s, d: profile.table(order_text(s, d)).select("column", "total", "missing", "distinct", "base", "role", "mixed", "numbers", F.round("mean", 4).alias("mean"), F.round("p50", 4).alias("p50")),
    "drift_summary": summary,
    "drift_top_offenders": offenders,
    "profile_numeric": profile_numeric,
    "profile_quantiles": profile_quantiles,
    "profile_missing": lambda s, d: profile.presence(order_text(s, d)),
    "profile_kinds": lambda s, d: profile.kinds(order_text(s, d)),
    "profile_distinct": lambda s, d: profile.features(order_text(s, d)).select("column", "distinct"),
    "profile_classify": lambda s, d: classified(s, d).select("column", "base", "role"),
    "profile_mixed": lambda s, d: classified(s, d).select("column", "mixed"),
    "profile_top_values": lambda s, d: profile.top_values(order_text(s, d), 3).select("column", "value", "cells", "rank"),
    "profile_lengths": lambda s, d: profile.lengths(order_text(s, d)),
}
_R = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)
_FEATURES = ORDER_TEXT + """,
f AS (SELECT c."column", count(c.value) AS n, count(DISTINCT c.value) AS u, avg(length(c.value)) AS al, avg(contains(c.value, ' ')::INT) AS sp, bool_and(c.value IN ('0', '1')) AS z FROM cells c GROUP BY 1),
k AS (SELECT "column", count(*) FILTER (kind = 'boolean') AS b, count(*) FILTER (kind = 'integer') AS i, count(*) FILTER (kind = 'float') AS fl, count(*) FILTER (kind = 'datetime') AS dt, count(*) FILTER (kind = 'string') AS st FROM kinds GROUP BY 1),
g AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN z OR b / n >= .99 THEN 'boolean' WHEN i / n >= .99 THEN 'integer' WHEN (i + fl) / n >= .99 THEN 'float' WHEN dt / n >= .95 THEN 'datetime' ELSE 'string' END AS base FROM f JOIN k USING ("column"))"""
ORACLES = {
    "profile_table": f"""WITH {_FEATURES}, r AS (SELECT *, CASE WHEN base IN ('empty', 'boolean', 'datetime') THEN base WHEN base IN ('integer', 'string') AND u >= greatest(50, floor(n * .95)) AND al <= 64 AND sp <= .2 THEN 'identifier'
            WHEN base IN ('integer', 'float') THEN base WHEN u <= least(2000, greatest(25, floor(n * .2))) THEN 'categorical' ELSE 'text' END AS role, NOT z AND (b > 0)::INT + (i > 0)::INT + (fl > 0)::INT + (dt > 0)::INT + (st > 0)::INT > 1 AND greatest(b, i, fl, dt, st) / n < .95 AS mixed FROM g),
        v AS (SELECT "column", replace(replace(value, ' ', ''), ',', '.') AS t FROM cells), w AS (SELECT "column", CASE WHEN regexp_matches(t, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN t::DOUBLE END AS x FROM v),
        m AS (SELECT "column", count(x) AS numbers, avg(x) AS mean, quantile_cont(x, .5) AS p50 FROM w WHERE x IS NOT NULL GROUP BY 1), c AS (SELECT "column", count(*) AS total, count(*) - count(value) AS missing FROM cells GROUP BY 1)
        SELECT c."column", total, missing, u AS "distinct", base, role, mixed, numbers, round(mean, 4) AS mean, round(p50, 4) AS p50 FROM c JOIN r USING ("column") LEFT JOIN m USING ("column")""",
    "drift_numeric": f'WITH {METRICS} SELECT "column", {_R("psi", "ks", "d")}, round(m1, 4) AS ref_mean, round(m2, 4) AS cur_mean FROM metrics',
    "drift_psi_numeric": f'WITH {NUMBERS}{BINS}{SMOOTH} SELECT "column", {_R("psi")} FROM psi',
    "drift_bins": f'WITH {NUMBERS}{BINS} SELECT "column", bin::INT AS bin, ref, cur FROM bins',
    "drift_ks_numeric": f'WITH {NUMBERS}{KS} SELECT "column", {_R("ks")} FROM ks',
    "drift_ks_pvalue": f'WITH {NUMBERS}{KS} SELECT "column", round(ks_p, 6) AS ks_p FROM tails',
    "drift_cohens_d": f'WITH {STATS} SELECT "column", round({D}, 4) AS d FROM sides',
    "drift_psi_categorical": f'WITH {CATS}{SMOOTH} SELECT "column", {_R("psi")} FROM psi',
    "drift_jsd": f'WITH {CATS}{SHARES} SELECT "column", {_R("jsd")} FROM div',
    "drift_tvd": f'WITH {CATS}{SHARES} SELECT "column", {_R("tvd")} FROM div',
    "drift_chi2_stat": f'WITH {CATS}{SHARES} SELECT "column", round(chi2, 3) AS chi2, df FROM chi',
    "drift_new_categories": f'WITH {CATS} SELECT "column", value AS category FROM counted WHERE cur > 0 AND ref = 0',
    "drift_gone_categories": f'WITH {CATS.replace(_STATUS, _OLD)} SELECT "column", value AS category FROM counted WHERE ref > 0 AND cur = 0',
    "drift_other_bucket": f'WITH {CATS} SELECT "column", category, ref, cur FROM bins',
    "drift_top_share_shifts": f"""WITH {CATS}{SHARES}, r AS (SELECT "column", category, round(q - p, 6) AS delta FROM shares),
        k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY abs(delta) DESC, category)::INT AS rank FROM r)
        SELECT "column", category, delta, rank FROM k WHERE rank <= 5 AND abs(delta) >= 0.005""",
    "drift_missingness": f"""WITH {NUMBERS} SELECT "column", round(avg(CASE WHEN side = 'reference' THEN (value IS NULL)::INT END), 6) AS ref_rate,
        round(avg(CASE WHEN side = 'current' THEN (value IS NULL)::INT END), 6) AS cur_rate FROM numbers GROUP BY 1""",
    "drift_identifier_overlap": f"""WITH {LINES}, k AS (SELECT l_orderkey, bool_or(side = 'reference') AS r, bool_or(side = 'current') AS c FROM lines GROUP BY 1),
        s AS (SELECT count(*) FILTER (r AND c) AS shared, count(*) FILTER (r AND c) / count(*) FILTER (c) AS share FROM k)
        SELECT shared, round(share, 6) AS share, CASE WHEN share >= .5 THEN 'alert' WHEN share >= .05 THEN 'warn' ELSE 'info' END AS severity FROM s""",
    "drift_datetime_period": """WITH t AS (SELECT o_orderdate >= TIMESTAMP '1996-01-01' AS c, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders),
        g AS (SELECT min(x) FILTER (NOT c) AS ref_min, max(x) FILTER (NOT c) AS ref_max, min(x) FILTER (c) AS cur_min, max(x) FILTER (c) AS cur_max FROM t)
        SELECT *, cur_min > ref_max OR cur_max < ref_min AS disjoint, cur_min < ref_min AS earlier FROM g""",
    "drift_schema_diff": """WITH a AS (SELECT count(c_custkey) AS custkey, count(c_name) AS name, count(c_nationkey) AS nationkey, count(c_acctbal) AS acctbal, count(c_mktsegment) AS mktsegment FROM customer),
        b AS (SELECT count(s_suppkey) AS suppkey, count(s_name) AS name, count(s_nationkey) AS nationkey, count(s_acctbal) AS acctbal FROM supplier),
        x AS (UNPIVOT a ON COLUMNS(*) INTO NAME n VALUE c), y AS (UNPIVOT b ON COLUMNS(*) INTO NAME n VALUE c)
        SELECT coalesce(x.n, y.n) AS "column", CASE WHEN x.n IS NULL THEN 'added' WHEN y.n IS NULL THEN 'removed' ELSE 'shared' END AS status, x.c AS reference, y.c AS current FROM x FULL JOIN y ON x.n = y.n""",
    "drift_findings": f'WITH {FOUND} SELECT "column", code, severity FROM found WHERE severity IS NOT NULL',
    "drift_summary": f"""WITH {FOUND}, f AS (SELECT * FROM found WHERE severity IS NOT NULL)
        SELECT count(*) FILTER (severity = 'alert') AS alerts, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(DISTINCT "column") AS columns_with_findings,
          CASE WHEN count(*) FILTER (severity = 'alert') > 0 THEN 'alert' WHEN count(*) FILTER (severity = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS status FROM f""",
    "drift_top_offenders": f"""WITH {FOUND}, w AS (SELECT "column", max(CASE severity WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END)::INT AS severity FROM found WHERE severity IS NOT NULL GROUP BY 1),
        p AS (SELECT "column", psi FROM metrics UNION ALL SELECT "column", psi FROM cmet)
        SELECT w."column", severity, round(coalesce(psi, 0), 4) AS psi FROM w JOIN known USING ("column") LEFT JOIN p USING ("column") WHERE severity > 0 ORDER BY severity DESC, coalesce(psi, 0) DESC, "column" LIMIT 5""",
    "drift_analysis": f"""WITH {FOUND}, p AS (SELECT "column", psi FROM metrics UNION ALL SELECT "column", psi FROM cmet)
        SELECT "column", analysis, rr AS ref_role, cr AS cur_role, round(psi, 4) AS psi FROM known LEFT JOIN p USING ("column")""",
    # the tail of an even number of degrees is a finite sum; of an odd one the first is erfc's, bounded here by its leading term
    "drift_chi2_pvalue": f"""WITH {CATS}{SHARES}, h AS (SELECT *, chi2 / 2 AS x, df // 2 AS m FROM chi),
        e AS (SELECT "column", df, chi2, CASE WHEN df % 2 = 0 THEN list_sum(list_transform(range(m), lambda i: exp(-x + i * ln(x) - lgamma(i + 1))))
            ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(20000), lambda i: exp(-((sqrt(x) + i * 0.001 + 0.0005) ** 2)) * 0.001)) + coalesce(list_sum(list_transform(range(m), lambda i: exp(-x + (i + 0.5) * ln(x) - lgamma(i + 1.5)))), 0) END AS p FROM h)
        SELECT "column", round(least(1, p), 6) AS chi2_p, p < 1e-12 AS certain FROM e""",
    "profile_numeric": f"""WITH {NUMBERS}, m AS (SELECT "column", avg(value) AS a FROM numbers GROUP BY 1),
        t AS (SELECT "column", value, value - a AS e FROM numbers JOIN m USING ("column") WHERE value IS NOT NULL)
        SELECT "column", count(*) AS n, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value < 0) AS negatives, round(min(value), 4) AS min, round(max(value), 4) AS max,
          round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(avg(e ** 3) / avg(e ** 2) ** 1.5, 4) AS skew FROM t GROUP BY 1""",
    "profile_quantiles": f"""WITH {NUMBERS}, t AS (SELECT "column", quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM numbers WHERE value IS NOT NULL GROUP BY 1)
        SELECT "column", round(q[1], 4) AS p01, round(q[2], 4) AS p05, round(q[3], 4) AS p25, round(q[4], 4) AS p50, round(q[5], 4) AS p75, round(q[6], 4) AS p95, round(q[7], 4) AS p99 FROM t""",
    "profile_missing": f'WITH {ORDER_TEXT} SELECT "column", count(*) AS total, count(value) AS present, count(*) - count(value) AS missing, round((count(*) - count(value)) / count(*), 6) AS missing_rate FROM cells GROUP BY 1',
    "profile_kinds": f'WITH {ORDER_TEXT} SELECT "column", kind, count(*) AS cells FROM kinds GROUP BY ALL',
    "profile_distinct": f'WITH {ORDER_TEXT} SELECT "column", count(DISTINCT value) AS "distinct" FROM cells GROUP BY 1',
    "profile_classify": f"""WITH {_FEATURES} SELECT "column", base, CASE WHEN base IN ('empty', 'boolean', 'datetime') THEN base
        WHEN base IN ('integer', 'string') AND u >= greatest(50, floor(n * .95)) AND al <= 64 AND sp <= .2 THEN 'identifier' WHEN base IN ('integer', 'float') THEN base
        WHEN u <= least(2000, greatest(25, floor(n * .2))) THEN 'categorical' ELSE 'text' END AS role FROM g""",
    "profile_mixed": f"""WITH {_FEATURES} SELECT "column", NOT z AND (b > 0)::INT + (i > 0)::INT + (fl > 0)::INT + (dt > 0)::INT + (st > 0)::INT > 1 AND greatest(b, i, fl, dt, st) / n < .95 AS mixed FROM g""",
    "profile_top_values": f"""WITH {ORDER_TEXT}, c AS (SELECT "column", value, count(*) AS cells FROM cells WHERE value IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cells DESC, value)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 3""",
    "profile_lengths": f"""WITH {ORDER_TEXT} SELECT "column", min(length(value))::INT AS shortest, max(length(value))::INT AS longest, round(avg(length(value)), 6) AS avg_len,
        round(avg(contains(value, ' ')::INT), 6) AS space_share FROM cells WHERE value IS NOT NULL GROUP BY 1""",
}
