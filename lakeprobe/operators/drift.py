"""Comparing two versions of a dataset: metrics of numeric and categorical drift, and graded findings.

Rows carry a `side`, 'reference' or 'current'. Data is aggregated once; what follows
works on rows per column and bin, category or statistic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprobe.functions import cells
from lakeprobe.operators import ordering, profile
from lakeprobe.session import saved

EPS = 1e-10
TENTHS = [i / 10 for i in range(1, 10)]
#: Categories compared by name; the others are one.
ALPHABET = 50


def sided(df: DataFrame, is_current: Column) -> DataFrame:
    return df.withColumn("side", F.when(is_current, "current").otherwise("reference"))


def counted(values: DataFrame) -> DataFrame:
    """Rows (column, value, ref, cur): how often each value, null too, occurs on either side."""
    return values.groupBy("column", "value").agg(F.count_if(F.col("side") == "reference").alias("ref"), F.count_if(F.col("side") == "current").alias("cur"))


def ranked(counts: DataFrame) -> DataFrame:
    """Counts of numbers with before_ref, before_cur, all_ref and all_cur: what stands below each value, and in all."""
    return ordering.running(counts.filter("value IS NOT NULL"), ["column"], "value", ["ref", "cur"])


def edges(order: DataFrame) -> DataFrame:
    """Rows (column, edges): the distinct inner deciles of the reference, from ranked()."""
    c = F.col
    each = [ordering.quantile(q, c("value"), c("ref"), c("before_ref"), c("all_ref")) for q in TENTHS]
    return order.filter("all_ref > 0").groupBy("column").agg(F.array_distinct(F.array(*each)).alias("edges"))


def binned(order: DataFrame) -> DataFrame:
    """Rows (column, bin, ref, cur): counts in every bin between the edges, empty bins too, from ranked()."""
    of = edges(order)
    at = F.size(F.filter("edges", lambda e: e < F.col("value")))
    counts = order.join(F.broadcast(of), "column").groupBy("column", at.alias("bin")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    every = of.select("column", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    return every.join(counts, ["column", "bin"], "left").fillna(0, ["ref", "cur"])


def bins(values: DataFrame) -> DataFrame:
    """Rows (column, bin, ref, cur) of numbers."""
    return binned(saved(ranked(counted(values)), "ranked"))


def first(counts: DataFrame, by: str, k: int) -> DataFrame:
    """The k values of each column that occur most often on a side, ties by value. The filter on the rank lets every partition keep only its own first k."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc(by), "value"))
    return counts.filter(F.col(by) > 0).withColumn("place", rank).filter(F.col("place") <= k).select("column", "value")


def categories(counts: DataFrame, k: int = ALPHABET) -> DataFrame:
    """Rows (column, category, ref, cur) of counted(): the k most frequent categories of either side, and '__other__' for the rest."""
    present = counts.filter("value IS NOT NULL")
    names = first(present, "ref", k).union(first(present, "cur", k)).distinct().withColumn("named", F.lit(True))
    category = F.when(F.col("named"), F.col("value")).otherwise("__other__").alias("category")
    # at most 2 * k names for each column
    return present.join(F.broadcast(names), ["column", "value"], "left").groupBy("column", category).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def one_sided(counts: DataFrame) -> DataFrame:
    """Rows (column, value, change) of values, of any rank, that only one side has: new or disappeared."""
    return counts.filter("value IS NOT NULL").filter((F.col("ref") == 0) | (F.col("cur") == 0)).select("column", "value", F.when(F.col("ref") == 0, "new").otherwise("disappeared").alias("change"))


def _shares(rows: DataFrame, smoothed: bool) -> DataFrame:
    by = Window.partitionBy("column")
    n, k = (lambda c: F.sum(c).over(by)), F.count(F.lit(1)).over(by)
    share = lambda c: (F.col(c) + 0.5) / (n(c) + 0.5 * k) if smoothed else F.col(c) / n(c)
    return rows.withColumn("p", share("ref")).withColumn("q", share("cur"))


def psi(rows: DataFrame) -> DataFrame:
    """Population stability index of counts (column, ref, cur) in bins or categories."""
    p, q = F.greatest("p", F.lit(EPS)), F.greatest("q", F.lit(EPS))
    return _shares(rows, True).groupBy("column").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def divergence(rows: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits and total variation distance of counts (column, ref, cur)."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when((F.col(c) > EPS) & (m > EPS), F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return _shares(rows, False).groupBy("column").agg(
        F.greatest(F.lit(0.0), F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("jsd"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tvd")
    )


def chi_square(rows: DataFrame) -> DataFrame:
    """Statistic and degrees of freedom of the two-sample homogeneity test."""
    by = Window.partitionBy("column")
    kept = rows.filter(F.col("ref") + F.col("cur") > 0)
    total = F.col("ref") + F.col("cur")
    part = lambda c: F.pow(F.col(c) - total * F.col("n_" + c) / (F.col("n_ref") + F.col("n_cur")), F.lit(2)) / (total * F.col("n_" + c) / (F.col("n_ref") + F.col("n_cur")))
    sized = kept.withColumn("n_ref", F.sum("ref").over(by)).withColumn("n_cur", F.sum("cur").over(by)).filter("n_ref > 0 AND n_cur > 0")
    return sized.groupBy("column").agg(F.sum(part("ref") + part("cur")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def _ln_gamma(df: Column) -> Column:
    """ln gamma of df / 2 by Stirling's series, after shifting the argument above 8."""
    a = df / 2.0
    shifted = a + 8
    product = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.log(a + i))
    series = 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, F.lit(3))) + 1 / (1260 * F.pow(shifted, F.lit(5))) - 1 / (1680 * F.pow(shifted, F.lit(7)))
    return (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * F.log(F.lit(2 * math.pi)) + series - product


def chi_square_tail(chi2: Column, df: Column, terms: int = 1000) -> Column:
    """Probability of a larger statistic: the regularised upper gamma function.

    Below df / 2 + 1 it is 1 minus the power series of the lower one; beyond, where that
    would cancel, the continued fraction of the upper one (Lentz), in which nothing
    underflows before the result itself does.
    """
    a, x = df / 2.0, chi2 / 2.0
    tiny = 1e-300
    steps = F.sequence(F.lit(1), F.lit(terms))
    scale = F.exp(a * F.log(x) - x - _ln_gamma(df))
    state = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    lower = F.aggregate(steps, state(t=1 / a, s=1 / a), lambda acc, i: state(t=acc["t"] * x / (a + i), s=acc["s"] + acc["t"] * x / (a + i)), lambda acc: acc["s"])

    def turn(acc: Column, i: Column) -> Column:
        an, b = -i * (i - a), x + 1 - a + 2 * i
        held = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
        d, c = 1 / held(an * acc["d"] + b), held(b + an / acc["c"])
        return state(c=c, d=d, h=acc["h"] * c * d)

    start = 1 / (x + 1 - a)
    upper = F.aggregate(steps, state(c=F.lit(1 / tiny), d=start, h=start), turn, lambda acc: acc["h"])
    p = F.when(x < a + 1, 1 - scale * lower).otherwise(scale * upper)
    return F.when((df <= 0) | (chi2 <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def ks_of(order: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column, from ranked()."""
    c = F.col
    gap = F.abs((c("before_ref") + c("ref")) / c("all_ref") - (c("before_cur") + c("cur")) / c("all_cur"))
    return order.groupBy("column").agg(F.max(gap).alias("ks"), F.max("all_ref").alias("n1"), F.max("all_cur").alias("n2"))


def ks(values: DataFrame) -> DataFrame:
    """The distance for rows (side, column, value) of numbers."""
    return ks_of(ranked(counted(values)))


def ks_tail(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic probability of a larger distance: the Kolmogorov series of 100 terms."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x)) * 2
    return F.when(x < 0.18, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def wide(stats: DataFrame, names: list[str]) -> DataFrame:
    """One row per column from numeric statistics per (side, column): ref_* and cur_*."""
    pick = lambda side, n: F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{side[:3]}_{n}")
    return stats.groupBy("column").agg(*[pick(s, n) for s in ("reference", "current") for n in names])


def cohens_d() -> Column:
    """Standardised difference of means over the columns of wide()."""
    n, s = (lambda side: F.col(f"{side}_n")), (lambda side: F.pow(F.col(f"{side}_std"), F.lit(2)))
    pooled = F.sqrt(((n("ref") - 1) * s("ref") + (n("cur") - 1) * s("cur")) / (n("ref") + n("cur") - 2))
    return F.when((n("ref") < 2) | (n("cur") < 2) | (pooled < EPS), 0.0).otherwise((F.col("cur_mean") - F.col("ref_mean")) / pooled)


def graded(value: Column, warn: float, alert: float) -> Column:
    return F.when(value >= alert, "alert").when(value >= warn, "warn")


def numeric_metrics(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Every numeric drift metric, a row per column."""
    order = saved(ranked(counted(values)), "ranked")
    got = wide(stats, ["n", "min", "max", "mean", "std", "negatives"]).join(psi(binned(order)), "column").join(ks_of(order), "column")
    return got.withColumn("d", cohens_d()).withColumn("ks_p", ks_tail(F.col("ks"), F.col("n1"), F.col("n2"))).drop("n1", "n2")


def numeric_findings(metrics: DataFrame) -> DataFrame:
    """Rows (column, code, severity) by the thresholds of the report."""
    c = F.col
    ratio = c("cur_std") / c("ref_std")
    both = (c("ref_std") > 1e-12) & (c("cur_std") > 1e-12)
    found = {
        "distribution.psi": graded(c("psi"), 0.10, 0.25),
        "distribution.ks": F.when((c("ks_p") < 0.01) & (c("ks") >= 0.1), F.when(c("ks") >= 0.2, "alert").otherwise("warn")),
        "distribution.mean_shift": graded(F.abs("d"), 0.5, 0.8),
        "distribution.range_expanded": F.when((c("cur_min") < c("ref_min")) | (c("cur_max") > c("ref_max")), "info"),
        "distribution.negatives_appeared": F.when((c("ref_negatives") == 0) & (c("cur_negatives") > 0), "warn"),
        "distribution.variance_change": F.when(both & ((ratio >= 2) | (ratio <= 0.5)), "warn"),
    }
    return findings(metrics, found)


def findings(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
    """Rows (column, code, severity) for each severity that is not null."""
    each = F.array(*[F.struct(F.lit(code).alias("code"), severity.alias("severity")) for code, severity in found.items()])
    return rows.select("column", F.explode(F.filter(each, lambda f: f["severity"].isNotNull())).alias("f")).select("column", "f.code", "f.severity")


def categorical_metrics(counts: DataFrame) -> DataFrame:
    """Every categorical drift metric, a row per column."""
    got = psi(counts).join(divergence(counts), "column").join(chi_square(counts), "column", "left")
    return got.withColumn("chi2_p", F.coalesce(chi_square_tail(F.col("chi2"), F.col("df")), F.lit(1.0)))


def presence_change(values: DataFrame) -> DataFrame:
    """Missing rates of both sides, a row per column."""
    rate = lambda side: F.avg(F.when(F.col("side") == side, F.col("value").isNull().cast("double")))
    return values.groupBy("column").agg(rate("reference").alias("ref_rate"), rate("current").alias("cur_rate"))


def presence_findings(rates: DataFrame) -> DataFrame:
    """missing.appeared and missing.rate_change."""
    delta, c = F.abs(F.col("cur_rate") - F.col("ref_rate")), F.col
    appeared = (delta >= 0.02) & (c("ref_rate") == 0) & (c("cur_rate") > 0)
    return findings(rates, {
        "missing.appeared": F.when(appeared, "alert"),
        "missing.rate_change": F.when(~appeared & (delta >= 0.02), F.when(delta >= 0.05, "alert").otherwise("warn")),
    })


def categorical_findings(metrics: DataFrame) -> DataFrame:
    """category.* and cardinality.change, from categorical_metrics() with the counts of one-sided values and the cardinalities."""
    c = F.col
    ratio = c("cur_distinct") / c("ref_distinct")
    return findings(metrics, {
        "category.psi": graded(c("psi"), 0.10, 0.25),
        "category.chi_square": F.when((c("chi2_p") < 0.01) & (c("tvd") >= 0.05), "warn"),
        "category.new": F.when(c("new") > 0, "warn"),
        "category.disappeared": F.when(c("disappeared") > 0, "info"),
        "cardinality.change": F.when((c("ref_distinct") > 0) & (c("cur_distinct") > 0) & ((ratio >= 1.5) | (ratio <= 0.67)), "warn"),
    })


def profiles(valued: DataFrame) -> DataFrame:
    """A row per column of rows (column, value, kind, moment, ref, cur): what both sides are, as ref_* and cur_*; a column that a side lacks has present 0 there."""
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(n).alias("n")) for name, n in (("reference", "ref"), ("current", "cur"))])
    each = valued.select("column", "value", "kind", "moment", F.explode(sides).alias("x")).select("column", "value", "kind", "moment", "x.*").filter("n > 0")
    known = profile.classify(profile.features_of(each, "side")).join(each.groupBy("side", "column").agg(F.min("moment").alias("first"), F.max("moment").alias("last")), ["side", "column"])
    return wide(known, ["present", "distinct", "base", "role", "mixed", "first", "last"])


def analysis(ref: Column, cur: Column) -> Column:
    """How a column is compared, from its roles on both sides."""
    both = lambda *names: ref.isin(*names) & cur.isin(*names)
    either = lambda name: (ref == name) | (cur == name)
    return (
        F.when(both("integer", "float"), "numeric").when(both("categorical", "boolean"), "categorical").when(either("identifier"), "identifier")
        .when(both("datetime"), "datetime").when(either("text"), "text").otherwise("structural")
    )


def structural_findings(columns: DataFrame) -> DataFrame:
    """schema.*, quality.* and datetime.* of columns that both sides have, from profiles() with the missing cells and analysis()."""
    c = F.col
    retyped = c("ref_role") != c("cur_role")
    dated = c("analysis") == "datetime"
    return findings(columns, {
        "schema.type_changed": F.when(retyped, "alert"),
        "schema.base_type_changed": F.when(~retyped & (c("ref_base") != c("cur_base")), "warn"),
        "quality.mixed_types": F.when(c("cur_mixed") & ~c("ref_mixed"), "warn"),
        "quality.became_constant": F.when((c("ref_distinct") > 1) & (c("cur_distinct") == 1), "alert"),
        "quality.no_longer_constant": F.when((c("ref_distinct") == 1) & (c("cur_distinct") > 1), "info"),
        "quality.became_empty": F.when((c("ref_present") > 0) & (c("cur_present") == 0), "alert"),
        "datetime.earlier_than_reference": F.when(dated & (c("cur_first") < c("ref_first")), "info"),
        "datetime.disjoint_period": F.when(dated & (c("cur_first") > c("ref_last")), "info"),
    })


def compare(values: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole report on two untyped tables: findings (column, code, severity), and a row per column with how it was compared and its psi.

    values: rows (side, column, value) of the cells of both, as normalised text; schema:
    rows (column, in_ref, in_cur). Cells are counted once by value; kinds, roles,
    numbers, dates and every metric come from the distinct values.
    """
    if schema.filter("in_ref AND in_cur").isEmpty():
        raise ValueError("the two tables have no column in common")
    counts = saved(counted(values), "counts")
    v = F.col("value")
    valued = saved(cells.kinded(counts.filter("value IS NOT NULL")), "valued")
    shared = schema.filter("in_ref AND in_cur").select("column")
    known = shared.join(profiles(valued), "column", "left").fillna(0, [f"{s}_{n}" for s in ("ref", "cur") for n in ("present", "distinct")])
    known = known.fillna("empty", [f"{s}_{n}" for s in ("ref", "cur") for n in ("base", "role")]).fillna(False, ["ref_mixed", "cur_mixed"])
    known = saved(known.withColumn("analysis", analysis(F.col("ref_role"), F.col("cur_role"))), "columns")
    of = lambda kind: F.broadcast(known.filter(F.col("analysis") == kind).select("column"))

    numbers = valued.join(of("numeric"), "column").filter("number IS NOT NULL").groupBy("column", F.col("number").alias("value")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    order = saved(ranked(numbers), "ranked")
    metrics = numeric_of(order)
    chosen = valued.join(of("categorical"), "column")
    classes = saved(categories(chosen.select("column", "value", "ref", "cur")), "categories")
    changes = one_sided(chosen).groupBy("column").agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "disappeared").alias("disappeared"))
    by_class = categorical_metrics(classes).join(changes, "column", "left").fillna(0, ["new", "disappeared"]).join(known.select("column", "ref_distinct", "cur_distinct"), "column")
    overlap = valued.join(of("identifier"), "column").groupBy("column").agg(F.count_if((F.col("ref") > 0) & (F.col("cur") > 0)).alias("both"), F.count_if(F.col("cur") > 0).alias("cur"))
    leaked = F.col("both") / F.col("cur")
    rates = counts.join(shared, "column").groupBy("column").agg(
        (F.sum(F.when(v.isNull(), F.col("ref")).otherwise(0)) / F.sum("ref")).alias("ref_rate"), (F.sum(F.when(v.isNull(), F.col("cur")).otherwise(0)) / F.sum("cur")).alias("cur_rate")
    )
    found = findings(schema, {"schema.column_added": F.when(~F.col("in_ref"), "warn"), "schema.column_removed": F.when(~F.col("in_cur"), "alert")})
    for part in (
        structural_findings(known), presence_findings(rates), numeric_findings(metrics), categorical_findings(by_class),
        findings(overlap, {"leakage.identifier_overlap": F.when(F.col("both") > 0, F.when(leaked >= 0.5, "alert").when(leaked >= 0.05, "warn").otherwise("info"))}),
    ):
        found = found.unionByName(part)
    scores = metrics.select("column", "psi").unionByName(by_class.select("column", "psi"))
    return saved(found, "findings"), known.select("column", "analysis", "ref_role", "cur_role").join(scores, "column", "left")


def numeric_of(order: DataFrame) -> DataFrame:
    """numeric_metrics() from ranked() counts of numbers alone: moments are sums over distinct values, deviations around the mean."""
    c = F.col
    side = lambda n, p: [F.sum(n).alias(f"{p}_n"), (F.sum(c("value") * c(n)) / F.sum(n)).alias(f"{p}_mean"), F.min(F.when(c(n) > 0, c("value"))).alias(f"{p}_min"), F.max(F.when(c(n) > 0, c("value"))).alias(f"{p}_max"), F.sum(F.when(c("value") < 0, c(n)).otherwise(0)).alias(f"{p}_negatives")]
    means = order.groupBy("column").agg(*side("ref", "ref"), *side("cur", "cur"))
    spread = lambda p: F.coalesce(F.sqrt(F.sum(F.pow(c("value") - c(f"{p}_mean"), F.lit(2)) * c(p)) / F.nullif(F.first(f"{p}_n") - 1, F.lit(0))), F.lit(0.0)).alias(f"{p}_std")
    stds = order.join(F.broadcast(means), "column").groupBy("column").agg(spread("ref"), spread("cur"))
    got = means.join(stds, "column").join(psi(binned(order)), "column").join(ks_of(order), "column")
    return got.withColumn("d", cohens_d()).withColumn("ks_p", ks_tail(c("ks"), c("n1"), c("n2"))).drop("n1", "n2")


def roll_up(found: DataFrame) -> DataFrame:
    """Counts of each severity and the worst one."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(
        n("alert").alias("alerts"), n("warn").alias("warnings"), n("info").alias("infos"), F.count_distinct("column").alias("columns_with_findings"),
        F.when(n("alert") > 0, "alert").when(n("warn") > 0, "warn").otherwise("ok").alias("status"),
    )
