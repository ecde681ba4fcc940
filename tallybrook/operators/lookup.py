"""Look-up-table predictors: medians and means by key with fall-backs, smoothing and hybrids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.ranks import counted, key_percentiles, percentiles
from tallybrook.sources.storage import cut

SMALL = 100_000  # keys of a level's table that is sent to all tasks


def met(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows plus the columns of a table with one row for each of their keys, null keys too; few keys are sent to all tasks."""
    small = table.limit(SMALL + 1).count() <= SMALL
    other = table.select(*(F.col(k).alias(f"{k}_m_") for k in keys), *(c for c in table.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_m_")) for k in keys]
    return rows.join(F.broadcast(other) if small else other, on, how).drop(*(f"{k}_m_" for k in keys))


def one_row(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(totals))


def level(counts: DataFrame, keys: list[str], name: str, how: str = "median") -> DataFrame:
    """The median or mean of counted values (value, n) by keys, with its count; one row without keys."""
    n = F.sum("n").alias(f"{name}_n")
    if how == "mean":
        return counts.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias(name), n)
    return key_percentiles(counts, {name: 0.5}, keys, n) if keys else percentiles(counts, "value", {name: 0.5}, None, n, weight="n")


def table(train: DataFrame, keys: list[str], target: str, name: str, how: str = "median") -> DataFrame:
    """The target's median or mean by keys, with its count."""
    return level(counted(train, target, keys), keys, name, how)


def fall_back(test: DataFrame, train: DataFrame, levels: list[list[str]], target: str, name: str = "pred", how: str = "median") -> DataFrame:
    """test plus the value of the first of several key levels that the training rows hold, then the global value.

    Also ``{name}_level``: the number of the level that answered, the number of levels for the global value.  The training
    rows are read once, into counts by all keys and value, from which each level is taken.
    """
    out, found, answered = test, [], F.lit(len(levels))
    counts = counted(train, target, list(dict.fromkeys(k for keys in levels for k in keys)))
    for k, keys in enumerate(levels):
        own = cut(level(counts, keys, f"v{k}_", how))
        small = own.limit(SMALL + 1).count() <= SMALL  # else the rows meet a large table by their keys
        out = out.join(F.broadcast(own) if small else own, keys, "left")
        found.append(F.col(f"v{k}_"))
    for k in reversed(range(len(levels))):
        answered = F.when(F.col(f"v{k}_").isNotNull(), k).otherwise(answered)
    out = one_row(out, level(counts, [], "global_", how))
    return out.select(*test.columns, F.coalesce(*found, F.col("global_")).alias(name), answered.cast("int").alias(f"{name}_level"))


def smoothed(test: DataFrame, train: DataFrame, keys: list[str], target: str, k: float, fallback: list[str], name: str = "pred") -> DataFrame:
    """Mean of the keys shrunk to the global mean by weight k; keys unseen in training take the fallback keys' mean."""
    counts = counted(train, target, list(dict.fromkeys([*keys, *fallback])))
    out = one_row(test.join(level(counts, keys, "mean_", "mean"), keys, "left").join(level(counts, fallback, "second_", "mean"), fallback, "left"), level(counts, [], "global_", "mean"))
    value = (F.col("mean__n") * F.col("mean_") + k * F.col("global_")) / (F.col("mean__n") + k)
    return out.select(*test.columns, F.coalesce(value, F.col("second_"), F.col("global_")).alias(name))


def coverage(test: DataFrame, train: DataFrame, keys: list[str], name: str = "hit") -> DataFrame:
    """test plus whether the training rows hold its keys."""
    return test.join(train.select(*keys).distinct().withColumn("hit_", F.lit(True)), keys, "left").select(*test.columns, F.coalesce("hit_", F.lit(False)).alias(name))


def hybrid(hit: Column, looked_up: Column, other: Column) -> Column:
    return F.when(hit, looked_up).otherwise(other)


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, domain: str, value: str, default: str) -> DataFrame:
    """rows plus a dimension's value of the key, or of it without a leading 'www.', or the default."""
    dim = dimension.groupBy(F.lower(domain).alias("dim_")).agg(F.min(value).alias("value_"))
    bare = dim.withColumnsRenamed({"dim_": "bare_", "value_": "value_bare_"})
    whole = F.lower(F.col(key))
    out = rows.join(dim, whole == F.col("dim_"), "left").join(bare, F.regexp_replace(whole, r"^www\.", "") == F.col("bare_"), "left")
    return out.select(*rows.columns, F.coalesce("value_", "value_bare_", F.lit(default)).alias(value))
