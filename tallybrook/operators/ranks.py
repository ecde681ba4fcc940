"""Exact ranks and percentiles of whole columns or by key, with no task that sees all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.sources.storage import cut

MANY = 1_000_000  # different values of a key that one task holds


def cumulative(df: DataFrame, c: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, value, n, upto and total: of each different value of a column its rows, the rows up to it, and all rows that have
    one; with a weight column the rows' weights.
    """
    by = by or []
    own = df.select(*by, F.col(c).alias("c_"), (F.col(weight) if weight else F.lit(1)).alias("n"))
    return running(own, "c_", by, ["n"]).select(*by, "value", "n", F.col("upto_n").alias("upto"), F.col("total_n").alias("total"))


def running(df: DataFrame, c: str, by: list[str], weights: list[str]) -> DataFrame:
    """by, value, and of each weight column its sum over the value's rows, over those up to it (upto_) and over all (total_).

    The running sums are taken within ranges of values plus the ranges' totals; a group may lie in many ranges.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("value")).agg(*(F.sum(w).alias(w) for w in weights))
    parts = counts.repartitionByRange(*by, "value").withColumn("part_", F.spark_partition_id())
    inside, group = Window.partitionBy("part_", *by).orderBy("value"), Window.partitionBy(*by)
    own = parts.withColumns({f"own_{w}": F.sum(w).over(inside) for w in weights})
    totals = parts.groupBy("part_", *by).agg(*(F.sum(w).alias(w) for w in weights))  # a row for each range, and one more for each group that begins in it
    sums = ((F.sum(w).over(group.orderBy("part_")) - F.col(w)).alias(f"ahead_{w}") for w in weights), (F.sum(w).over(group).alias(f"total_{w}") for w in weights)
    ahead = totals.select(F.col("part_").alias("p_"), *(F.col(b).alias(f"{b}_g_") for b in by), *sums[0], *sums[1])
    met = F.col("part_") == F.col("p_")
    for b in by:
        met = met & F.col(b).eqNullSafe(F.col(f"{b}_g_"))
    upto = ((F.col(f"ahead_{w}") + F.col(f"own_{w}")).alias(f"upto_{w}") for w in weights)
    return own.join(ahead if by else F.broadcast(ahead), met).select(*by, "value", *weights, *upto, *(f"total_{w}" for w in weights))


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """Value and average rank of each different value of a column."""
    return cumulative(df, c).select("value", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def percentiles(df: DataFrame, c: str, wanted: dict[str, float], by: list[str] | None = None, *more: Column, weight: str | None = None) -> DataFrame:
    """The wanted percentiles (name: share) of a column, interpolated between neighbouring values; one row, or one for each group.

    more: further aggregates over the columns of ``cumulative``.
    """
    ranked = cumulative(df, c, by, weight)
    place = {k: F.lit(q) * (F.col("total") - 1) for k, q in wanted.items()}
    value = lambda at: F.min(F.when(F.col("upto") > at, F.col("value")))
    found = ranked.groupBy(*by or ()).agg(
        *(value(F.floor(p)).alias(f"{k}_low_") for k, p in place.items()), *(value(F.ceil(p)).alias(f"{k}_high_") for k, p in place.items()), *(F.max(p - F.floor(p)).alias(f"{k}_part_") for k, p in place.items()), *more
    )
    mix = lambda k: F.col(f"{k}_low_") * (1 - F.col(f"{k}_part_")) + F.col(f"{k}_high_") * F.col(f"{k}_part_")
    inner = {f"{k}_{x}_" for k in wanted for x in ("low", "high", "part")}
    return found.select(*(c for c in found.columns if c not in inner), *(mix(k).alias(k) for k in wanted))


def counted(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """by, value and n: the rows of each different value of a column (not null) by key, in one pass over df, at hand for several uses.

    Rows are dealt out by key and value, so a key of a third of all rows is no task of its own.
    """
    return cut(df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def key_percentiles(counts: DataFrame, wanted: dict[str, float], by: list[str], *more: Column) -> DataFrame:
    """The wanted percentiles of each key of counted values (by, value, n; values of a key may repeat).

    Keys of up to MANY rows are aggregated as one map each; the values of larger ones are ranked by ranges.
    """
    held = lambda rows: rows.groupBy(*by).agg(*more, *(F.expr(f"percentile(value, {q}D, n)").alias(k) for k, q in wanted.items()))
    if counts.limit(MANY + 1).count() <= MANY:
        return held(counts)
    large = cut(counts.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_")).where(F.col("rows_") > MANY).select(*(F.col(b).alias(f"{b}_h_") for b in by)))
    if large.isEmpty():
        return held(counts)
    met = F.lit(True)
    for b in by:
        met = met & F.col(b).eqNullSafe(F.col(f"{b}_h_"))
    ranked = percentiles(counts.join(large, met, "left_semi"), "value", wanted, by, *more, weight="n")
    return held(counts.join(large, met, "left_anti")).unionByName(ranked)
