"""Pooling of repeated measurements, drift correction and dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.lookup import one_row


def clean_everywhere(rows: DataFrame) -> DataFrame:
    """page_idx of pages that are clean ('ok...' in both arms) in every repetition."""
    ok = F.col("outcome_normal").startswith("ok") & F.col("outcome_private").startswith("ok")
    reps = rows.agg(F.count_distinct("rep").alias("reps_"))
    return one_row(rows.groupBy("page_idx").agg(F.count_if(ok).alias("n_")), reps).where("n_ = reps_").select("page_idx")


def pool_pages(rows: DataFrame, summed: list[str], averaged: list[str] | None = None) -> DataFrame:
    """One row for each page: sums, means (two digits), repetitions and the share of bytes saved."""
    out = rows.groupBy("page_idx").agg(F.count(F.lit(1)).alias("n_reps"), *(F.sum(c).alias(c) for c in summed), *(F.round(F.avg(c), 2).alias(c) for c in averaged or ()))
    return out.withColumn("pct_bytes_saved", F.when(F.col("transfer_bytes_normal") != 0, F.round(100.0 * F.col("bytes_saved") / F.col("transfer_bytes_normal"), 2)))


def instability(rows: DataFrame, delta: str = "bytes_saved", size: str = "transfer_bytes_normal") -> DataFrame:
    """page_idx, instability: sample deviation of the repetitions' deltas over the mean size, for two repetitions and more."""
    out = rows.groupBy("page_idx").agg(F.count(F.lit(1)).alias("n_"), F.stddev_samp(F.col(delta).cast("double")).alias("sd_"), F.avg(size).alias("size_"))
    return out.where("n_ >= 2 and size_ > 0").select("page_idx", (F.col("sd_") / F.col("size_")).alias("instability"))


def measure(pages: DataFrame, widths: dict[str, str]) -> DataFrame:
    """One row of drift-corrected savings: touched pages' sum minus the untouched pages' mean for each touched page.

    widths: result name to delta column; also {name}_raw and the numbers of touched and untouched pages.
    """
    touched = F.col("n_blocked_tracking") > 0
    n = F.count_if(touched)
    out = [n.alias("n_pages_with_blocks"), F.count_if(~touched).alias("n_pages_without_blocks")]
    for name, c in widths.items():
        total = F.coalesce(F.sum(F.when(touched, F.col(c))), F.lit(0)).cast("double")
        drift = F.coalesce(F.avg(F.when(~touched, F.col(c))), F.lit(0.0))
        out += [(total - drift * n).alias(name), total.alias(f"{name}_raw"), drift.alias(f"{name}_drift")]
    return pages.agg(*out)


def churn_se_pct(pages: DataFrame, delta: str) -> DataFrame:
    """One row: the churn of untouched pages, scaled to the touched ones, in percent of their delta; infinite if not gradeable."""
    touched = F.col("n_blocked_tracking") > 0
    a = pages.agg(F.sum(F.when(touched, F.col(delta))).cast("double").alias("d"), F.count_if(touched).alias("n"), F.count_if(~touched).alias("q"), F.stddev_samp(F.when(~touched, F.col(delta)).cast("double")).alias("sd"))
    bad = (F.coalesce("d", F.lit(0.0)) <= 0) | (F.col("q") < 2) | (F.col("n") == 0)
    return a.select(F.when(bad, float("inf")).otherwise(100.0 * F.col("sd") * F.sqrt("n") / F.when(bad, 1.0).otherwise(F.col("d"))).alias("churn_se_pct"))


def dispersion(rows: DataFrame, delta: str) -> DataFrame:
    """One row: mean, deviation and pooled error of the repetitions' totals over ever-touched pages, and the churn proxy."""
    touched = rows.where("n_blocked_tracking > 0").select("page_idx").distinct().withColumn("t_", F.lit(True))
    marked = rows.join(touched, "page_idx", "left").withColumn("t_", F.coalesce("t_", F.lit(False)))
    per_rep = marked.groupBy("rep").agg(F.sum(F.when(F.col("t_"), F.col(delta)).otherwise(0)).cast("double").alias("total"), F.stddev_samp(F.when(~F.col("t_"), F.col(delta)).cast("double")).alias("quiet_sd"), F.count_if("t_").alias("n_t"))
    n_touched = touched.agg(F.count(F.lit(1)).alias("touched"))
    a = one_row(per_rep, n_touched).agg(F.count(F.lit(1)).alias("n_reps"), F.first("touched").alias("n_pages_touched"), F.avg("total").alias("m"), F.stddev_samp("total").alias("sd"), F.avg(F.col("quiet_sd") * F.sqrt("touched")).alias("churn"))
    pct = lambda x: F.when(F.col("m") != 0, F.round(100.0 * x / F.abs("m"), 2))
    se = F.col("sd") / F.sqrt("n_reps")
    return a.select("n_reps", "n_pages_touched", F.round("m", 1).alias("per_rep_mean"), F.round("sd", 1).alias("per_rep_sd"), F.round(se, 1).alias("pooled_se"), pct(se).alias("pooled_se_pct"), pct(F.col("sd")).alias("single_rep_sd_pct"), pct(F.col("churn")).alias("churn_proxy_se_pct"))
