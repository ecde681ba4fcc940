"""Grading of predictions: errors, rank correlation, calibration, breakdowns and confusion matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.lookup import one_row
from tallybrook.operators.ranks import average_ranks, percentiles


def spearman(df: DataFrame, a: str, b: str, name: str = "spearman") -> DataFrame:
    """One row: rank correlation of two columns, ties averaged, over rows where both are there."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_"))
    pairs = both.groupBy("a_", "b_").agg(F.count(F.lit(1)).alias("w"))
    ra, rb = (average_ranks(both, c).select(F.col("value").alias(c), F.col("rank").alias(r)) for c, r in (("a_", "ra"), ("b_", "rb")))
    m = pairs.join(ra, "a_").join(rb, "b_").agg(F.sum("w").cast("double").alias("n"), *(F.sum(F.col("w") * x).alias(k) for k, x in {"sa": F.col("ra"), "sb": F.col("rb"), "saa": F.col("ra") ** 2, "sbb": F.col("rb") ** 2, "sab": F.col("ra") * F.col("rb")}.items()))
    va, vb = (F.col("n") * F.col(f"s{x}{x}") - F.col(f"s{x}") ** 2 for x in "ab")
    return m.select(F.when((va > 0) & (vb > 0), (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)).alias(name))


def correlation(a: Column, b: Column) -> Column:
    """Correlation of two columns over rows where both are there; null where one is constant, which F.corr takes as an error."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def errors(df: DataFrame, pred: str, actual: str, by: list[str] | None = None, median: bool = True) -> DataFrame:
    """n, mae, median_ae (if wanted), rmse, mape (actual over 1000), totals and their ratio, overall or by group."""
    p, a = F.col(pred).cast("double"), F.col(actual).cast("double")
    gap = F.abs(p - a)
    some = df.where(p.isNotNull() & a.isNotNull()).withColumn("gap_", gap)
    out = some.groupBy(*by or ()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.avg(F.when(a > 1000, gap / F.when(a > 1000, a))) * 100).alias("mape"), F.sum(p).alias("pred_total"), F.sum(a).alias("actual_total"), F.try_divide(F.sum(p), F.sum(a)).alias("ratio"),
    )
    if not median:
        return out
    middle = percentiles(some, "gap_", {"median_ae": 0.5}, by)
    met = [F.col(b).eqNullSafe(F.col(f"{b}_m_")) for b in by or ()]
    joined = out.join(middle.withColumnsRenamed({b: f"{b}_m_" for b in by}), met) if by else one_row(out, middle)
    return joined.select(*by or (), "n", "mae", "median_ae", "rmse", "mape", "pred_total", "actual_total", "ratio")


def page_rates(df: DataFrame, page: list[str], pred: str, actual: str) -> DataFrame:
    """One row over pages with an actual total: median ratio and shares of pages within 10, 25 and 50 percent."""
    t = df.groupBy(*page).agg(F.sum(pred).cast("double").alias("p"), F.sum(actual).cast("double").alias("a")).where("a > 0").withColumn("r", F.col("p") / F.col("a"))
    within = lambda x: F.avg(F.when(F.abs(F.col("r") - 1) <= x, 1.0).otherwise(0.0))
    return one_row(t.agg(F.count(F.lit(1)).alias("n_pages"), *(within(x / 100).alias(f"within_{x}pct") for x in (10, 25, 50))), percentiles(t, "r", {"median_ratio": 0.5}))


def calibration(df: DataFrame, pred: str, actual: str, edges: list[float], least: int = 10) -> DataFrame:
    """Predictions in bins (edge, next edge]; predictions at or below the first edge are dropped, small bins too."""
    p, a = F.col(pred).cast("double"), F.col(actual).cast("double")
    bin_ = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        bin_ = F.when((p > edges[k]) & (p <= edges[k + 1]), k).otherwise(bin_)
    near = F.when(F.abs(p - a) <= 0.25 * a, 1.0).otherwise(0.0)
    out = df.withColumn("bin", bin_).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(a).alias("actual_mean"), F.median(a).alias("actual_median"), F.avg(F.abs(p - a)).alias("mae"), F.avg(near).alias("within_25pct"))
    return out.where(F.col("n") >= least)


def quantile_bins(df: DataFrame, score: str, value: str, q: int = 5) -> DataFrame:
    """bin, n, mean of value by quantile bins of a score; equal scores share a bin."""
    cuts = percentiles(df, score, {f"c{k}_": k / q for k in range(1, q)}).select(F.array(*(f"c{k}_" for k in range(1, q))).alias("cuts_"))
    bin_ = F.aggregate("cuts_", F.lit(0), lambda n, c: n + (F.col(score) > c).cast("int"))
    return one_row(df, cuts).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))


def coverage(df: DataFrame, low: str, high: str, actual: str) -> DataFrame:
    """One row: share of actual values within their interval, and its mean and median width."""
    w = F.col(high) - F.col(low)
    shares = df.agg(F.avg(F.when((F.col(actual) >= F.col(low)) & (F.col(actual) <= F.col(high)), 1.0).otherwise(0.0)).alias("coverage"), F.avg(w).alias("mean_width"))
    return one_row(shares, percentiles(df.withColumn("width_", w), "width_", {"median_width": 0.5}))


def confusion(df: DataFrame, predicted: Column, truth: Column, size: Column) -> DataFrame:
    """One row: counts and bytes of true and false positives and negatives; precision, recall and F1."""
    cells = {"tp": predicted & truth, "fp": predicted & ~truth, "fn": ~predicted & truth, "tn": ~predicted & ~truth}
    m = df.agg(*(F.count_if(c).alias(k) for k, c in cells.items()), *(F.coalesce(F.sum(F.when(c, size)), F.lit(0)).alias(f"{k}_bytes") for k, c in cells.items()))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return m.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def contribution(df: DataFrame, by: list[str], pred: str, actual: str) -> DataFrame:
    """By group: totals, bias in percent, and shares of the actual total and of the whole bias."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(pred).cast("double").alias("p"), F.sum(actual).cast("double").alias("a"))
    t = g.agg(F.sum("a").alias("ta"), F.sum("p").alias("tp"))
    return one_row(g, t).select(*by, "n", F.col("p").alias("pred_total"), F.col("a").alias("actual_total"), (F.try_divide(F.col("p") - F.col("a"), "a") * 100).alias("bias_pct"), F.try_divide("a", "ta").alias("share"), (F.try_divide(F.col("p") - F.col("a"), "ta") * 100).alias("contribution_pct"))


def cdf(df: DataFrame, c: str) -> DataFrame:
    """value, n and cum_share of each different value."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(df, c)
    total = counts.agg(F.sum("n").alias("t"))
    return one_row(counts.join(ranks.withColumnRenamed("value", "v_"), F.col("value").cast("double") == F.col("v_")), total).select("value", "n", ((F.col("rank") + (F.col("n") - 1) / 2.0) / F.col("t")).alias("cum_share"))


def leave_one_out(pages: DataFrame, num: str, den: str) -> DataFrame:
    """pages plus the ratio of the totals, the ratio without each page, and how far that shifts it."""
    t = pages.agg(F.sum(num).cast("double").alias("tn"), F.sum(den).cast("double").alias("td"))
    out = one_row(pages, t).withColumns({"ratio": F.try_divide("tn", "td"), "ratio_without": F.try_divide(F.col("tn") - F.col(num), F.col("td") - F.col(den))})
    return out.withColumn("shift", F.abs(F.col("ratio_without") - F.col("ratio"))).drop("tn", "td")


def key_drift(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys in both, in a alone, in b alone, and the share of b's rows whose key a holds."""
    ka = a.groupBy(*key).agg(F.count(F.lit(1)).alias("na"))
    kb = b.groupBy(*key).agg(F.count(F.lit(1)).alias("nb"))
    m = ka.join(kb, key, "full")
    return m.agg(F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("shared"), F.count_if(F.col("nb").isNull()).alias("gone"), F.count_if(F.col("na").isNull()).alias("new"), (F.sum(F.when(F.col("na").isNotNull(), F.col("nb")).otherwise(0)) / F.sum("nb")).alias("row_coverage"))


def gradeable(df: DataFrame, by: list[str], pred: str, actual: str, least_share: float = 0.02, least_rows: int = 200, most_se_pct: float = 15.0) -> DataFrame:
    """Groups with enough of the actual total, enough rows and a small enough standard error of their total to be graded."""
    gap = (F.col(pred) - F.col(actual)).cast("double")
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(pred).cast("double").alias("p"), F.sum(actual).cast("double").alias("a"), F.stddev_samp(gap).alias("sd"))
    out = one_row(g, g.agg(F.sum("a").alias("ta"))).select(*by, "n", F.try_divide("a", "ta").alias("share"), (F.try_divide(F.col("p") - F.col("a"), "a") * 100).alias("bias_pct"), (F.try_divide(F.col("sd") * F.sqrt("n"), "a") * 100).alias("se_pct"))
    return out.where((F.col("share") >= least_share) & (F.col("n") >= least_rows) & (F.col("se_pct") <= most_se_pct))
