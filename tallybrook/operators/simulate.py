"""Resampling with repeatable draws: hashes of (seed, trial, slot) choose rows, so draws are equal on any cluster."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.operators.lookup import one_row
from tallybrook.operators.ranks import running
from tallybrook.sources.fixtures import hash_number
from tallybrook.sources.storage import cut


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """df plus gapless numbers from 0 by the hash of the order columns, then by these.

    Ranges of the hash are ranked apart, 64 or as many as the cluster shuffles into, so that no task sorts all rows; the
    numbers don't depend on how many there are.
    """
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = df.withColumn("h_", hash_number(*order)).withColumn("b_", F.shiftright("h_", 60 - (parts - 1).bit_length()))
    sizes = own.groupBy("b_").agg(F.count(F.lit(1)).alias("n_"))  # a row for each range
    ahead = sizes.withColumn("a_", F.sum("n_").over(Window.orderBy("b_")) - F.col("n_")).drop("n_")
    ranked = own.withColumn("r_", F.row_number().over(Window.partitionBy("b_").orderBy("h_", *order)) - 1)
    return ranked.join(F.broadcast(ahead), "b_").withColumn(name, (F.col("r_") + F.col("a_")).cast("long")).drop("b_", "r_", "a_", "h_")


def slots(spark: SparkSession, trials: int, draws: int) -> DataFrame:
    return spark.range(trials * draws).select((F.col("id") / draws).cast("long").alias("trial"), (F.col("id") % draws).alias("slot"))


def drawn(slots_: DataFrame, items: DataFrame, seed: str, name: str = "i") -> DataFrame:
    """slots plus a drawn item each, with replacement; items are numbered from 0."""
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    return one_row(slots_, n).withColumn(name, F.pmod(hash_number(F.lit(seed), "trial", "slot"), F.col("n_items"))).drop("n_items").join(items, name)


def error_stats(trials: DataFrame, inclusive: bool = False) -> DataFrame:
    """One row over trials (pred, actual): errors in percent and shares within 10, 25 and 5 percent; actual 0 is skipped."""
    e = trials.where("actual <> 0").withColumn("signed", (F.col("pred") - F.col("actual")) / F.col("actual") * 100.0).withColumn("err", F.abs("signed"))
    near = lambda x: F.avg(F.when((F.col("err") <= x) if inclusive else (F.col("err") < x), 1.0).otherwise(0.0))
    p = lambda q: F.percentile("err", q)
    return e.agg(F.count(F.lit(1)).alias("n"), F.median("err").alias("median_pct"), p(0.25).alias("p25_pct"), p(0.75).alias("p75_pct"), p(0.9).alias("p90_pct"), near(5).alias("within_5pct"), near(10).alias("within_10pct"), near(25).alias("within_25pct"), F.median("signed").alias("signed_median_pct"))


def totals(draws: DataFrame, pred: str, actual: str) -> DataFrame:
    return draws.groupBy("trial").agg(F.sum(pred).cast("double").alias("pred"), F.sum(actual).cast("double").alias("actual"))


def uniform(rows: DataFrame, order: list[str], pred: str, actual: str, draws: int, trials: int, seed: str) -> DataFrame:
    """Totals of trials of uniform draws with replacement."""
    return totals(drawn(slots(rows.sparkSession, trials, draws), numbered(rows.select(*order, pred, actual), order), seed), pred, actual)


def journeys(rows: DataFrame, page: str, pred: str, actual: str, visits: int, trials: int, seed: str) -> DataFrame:
    """Totals of journeys: page visits with replacement, each with all its page's requests; pages are summed first."""
    pages = rows.groupBy(page).agg(F.sum(pred).alias(pred), F.sum(actual).alias(actual))
    return totals(drawn(slots(rows.sparkSession, trials, visits), numbered(pages, [page]), seed), pred, actual)


def zipf_journeys(rows: DataFrame, page: str, pred: str, actual: str, visits: int, trials: int, seed: str, exponent: float = 1.0) -> DataFrame:
    """Journeys whose pages are drawn by Zipf weights of their hash rank: a draw falls on the cumulative weight.

    Weights are summed within blocks of ranks, plus the blocks' offsets.  The whole weight is cut into as many cells as there
    are pages; a page is in each cell that it overlaps, and a draw looks only at the pages of its cell.
    """
    pages = numbered(rows.groupBy(page).agg(F.sum(pred).alias(pred), F.sum(actual).alias(actual)), [page])
    w = pages.withColumn("w_", 1.0 / F.pow(F.col("i") + 1, F.lit(exponent))).withColumn("b_", F.floor(F.col("i") / 4096))
    own = Window.partitionBy("b_").orderBy("i")
    sums = w.withColumn("to_", F.sum("w_").over(own)).withColumn("from_", F.coalesce(F.lag("to_").over(own), F.lit(0.0)))
    blocks = sums.groupBy("b_").agg(F.max("to_").alias("t_")).withColumn("t_", F.sum("t_").over(Window.orderBy("b_")))  # a row for 4,096 pages
    ahead = blocks.withColumn("a_", F.coalesce(F.lag("t_").over(Window.orderBy("b_")), F.lit(0.0))).drop("t_")
    whole = one_row(blocks.agg(F.max("t_").alias("t_")), pages.agg(F.count(F.lit(1)).alias("n_")))
    cell = lambda x: F.least(F.floor(x / F.col("t_") * F.col("n_")), F.col("n_") - 1)
    begin, end = F.col("from_") + F.col("a_"), F.col("to_") + F.col("a_")
    spans = one_row(sums.join(ahead, "b_"), whole).select(pred, actual, begin.alias("from_"), end.alias("to_"), F.explode(F.sequence(cell(begin), cell(end))).alias("cell_"))
    share = F.shiftright(hash_number(F.lit(seed), "trial", "slot"), 8) / F.lit(float(1 << 52))  # of a 60-bit hash, below 1
    draws = one_row(slots(rows.sparkSession, trials, visits), whole).withColumn("x_", share * F.col("t_")).select("trial", "slot", "x_", cell(F.col("x_")).alias("cell_"))
    return totals(draws.join(spans, "cell_").where("x_ >= from_ and x_ < to_"), pred, actual)


def clustered(rows: DataFrame, cluster: str, order: list[str], pred: str, actual: str, clusters: int, draws: int, trials: int, seed: str) -> DataFrame:
    """Totals of trials that draw clusters with replacement and then rows of these without, all if there are too few.

    A cluster drawn twice has its rows twice.  Only a cluster's share of the wanted draws can matter, so each drawn cluster
    offers its rows of least hash, ``draws`` at most, before the trial takes its own least ones.
    """
    items = numbered(rows.select(cluster).distinct(), [cluster])
    chosen = drawn(slots(rows.sparkSession, trials, clusters), items, seed)
    met = chosen.join(rows.select(cluster, *order, pred, actual), cluster).withColumn("h_", hash_number(F.lit(seed), "trial", "slot", *order))
    near = met.withColumn("r_", F.row_number().over(Window.partitionBy("trial", "slot").orderBy("h_", *order))).where(F.col("r_") <= draws)
    took = near.withColumn("r_", F.row_number().over(Window.partitionBy("trial").orderBy("h_", "slot", *order))).where(F.col("r_") <= draws)
    return totals(took, pred, actual)


def bootstrap_ratio(pages: DataFrame, order: list[str], num: str, den: str, trials: int, seed: str) -> DataFrame:
    """One row: ratio of sums over pages with a percentile interval from page resamples (Poisson weights by hash)."""
    weights = pages.select(*order, F.col(num).cast("double").alias("x"), F.col(den).cast("double").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    weighted = weights.withColumn("w", poisson(hash_number(F.lit(seed), "trial", *order)))
    per = weighted.groupBy("trial").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("y"))).alias("r"))
    full = pages.agg(F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")).alias("ratio"))
    return one_row(per.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high")), full).select("ratio", "low", "high")


def poisson(h: Column) -> Column:
    """A Poisson(1) weight from a 60-bit hash: how many cumulative probabilities its upper 52 bits exceed.

    Beyond 17 no probability is left that these bits could tell.
    """
    u = F.shiftright(h, 8) / F.lit(float(1 << 52))
    total = term = math.exp(-1)
    out = F.when(u < total, 0)
    for k in range(1, 17):
        term /= k
        total += term
        out = out.when(u < total, k)
    return out.otherwise(17)


def bootstrap_mean(rows: DataFrame, order: list[str], value: str, trials: int, seed: str) -> DataFrame:
    """One row: mean of a value with a percentile interval of row resamples (Poisson weights, summed map-side by trial)."""
    return bootstrap_ratio(rows.withColumn("one_", F.lit(1)), order, value, "one_", trials, seed).withColumnRenamed("ratio", "mean")


def win_rate(pages: DataFrame, order: list[str], a: str, b: str, truth: str, draws: int, trials: int, seed: str) -> DataFrame:
    """One row: how often model a, both levelled to the true total, has the smaller summed page error in page resamples."""
    t = pages.agg(*(F.sum(c).cast("double").alias(f"t_{k}") for k, c in (("a", a), ("b", b), ("y", truth))))
    level = one_row(pages, t).select(*order, *(F.abs(F.col(c) * F.try_divide("t_y", f"t_{k}") - F.col(truth)).alias(f"e_{k}") for k, c in (("a", a), ("b", b))))
    per = drawn(slots(pages.sparkSession, trials, draws), numbered(level, order), seed).groupBy("trial").agg(F.sum("e_a").alias("a"), F.sum("e_b").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("a") < F.col("b"), 1.0).otherwise(0.0)).alias("win_rate"))


def category_win_rate(cells: DataFrame, page: list[str], category: str, a: str, b: str, truth: str, draws: int, trials: int, seed: str) -> DataFrame:
    """One row: how often model a, both levelled to the true total, has the smaller summed error of category totals.

    cells: one row for each page and category.
    """
    t = cells.agg(*(F.sum(c).cast("double").alias(f"t_{k}") for k, c in (("a", a), ("b", b), ("y", truth))))
    level = one_row(cells, t).select(*page, category, *((F.col(c) * F.try_divide("t_y", f"t_{k}") - F.col(truth)).alias(f"e_{k}") for k, c in (("a", a), ("b", b))))
    met = drawn(slots(cells.sparkSession, trials, draws), numbered(cells.select(*page).distinct(), page), seed).join(level, page)
    per = met.groupBy("trial", category).agg(F.abs(F.sum("e_a")).alias("a"), F.abs(F.sum("e_b")).alias("b")).groupBy("trial").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("a") < F.col("b"), 1.0).otherwise(0.0)).alias("win_rate"))


def least_hashed(rows: DataFrame, by: list[str], order: list[str], wanted: Column, seed: str) -> DataFrame:
    """Of each group of rows the wanted number of least hash, ties by the order columns; all if there are fewer.

    Rows are counted by group and range of the hash; whole ranges are taken or left, and only the range that the number
    falls into is ranked, so that no task sorts a group.  wanted may use the group's columns and its size, size_.
    """
    parts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = rows.withColumn("h_", hash_number(F.lit(seed), *by, *order)).withColumn("b_", F.shiftright("h_", 60 - (parts - 1).bit_length()))
    sizes = own.groupBy(*by, "b_").agg(F.count(F.lit(1)).alias("n_"))  # a row for each range of each group
    group = Window.partitionBy(*by)
    ahead = sizes.withColumns({"upto_": F.sum("n_").over(group.orderBy("b_")), "size_": F.sum("n_").over(group)}).withColumn("left_", wanted - (F.col("upto_") - F.col("n_"))).where("left_ > 0")
    met = own.join(ahead.select(*by, "b_", "n_", "left_"), [*by, "b_"])
    ranked = met.where("left_ < n_").withColumn("r_", F.row_number().over(Window.partitionBy(*by, "b_").orderBy("h_", *order))).where("r_ <= left_")
    return met.where("left_ >= n_").select(*rows.columns).unionByName(ranked.select(*rows.columns))


def subsets(pages: DataFrame, page: str, share: float, n: int, num: str, den: str, seed: str) -> DataFrame:
    """subset, n_pages, ratio of n random subsets of exactly this share of the pages (rounded to even halves, 1 at least)."""
    asked = pages.select(page, num, den, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("subset"))
    kept = least_hashed(asked, ["subset"], [page], F.greatest(F.lit(1), F.bround(F.col("size_") * share)).cast("long"), seed)
    return kept.groupBy("subset").agg(F.count(F.lit(1)).alias("n_pages"), F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")).alias("ratio"))


def page_correlated(rows: DataFrame, page: str, order: list[str], pred: str, actual: str, pages: int, draws: int, trials: int, seed: str) -> DataFrame:
    """Totals of trials that visit pages of two rows and more with replacement and take all their rows, visit by visit.

    A trial that has met more than twice the wanted rows keeps the wanted number of them, without replacement.
    """
    sums = rows.groupBy(page).agg(F.count(F.lit(1)).alias("rows_")).where("rows_ >= 2")
    chosen = drawn(slots(rows.sparkSession, trials, pages), numbered(sums, [page]), seed).select("trial", "slot", page)
    met = chosen.join(rows.select(page, *order, pred, actual), page).select("trial", "slot", *order, pred, actual)
    wanted = F.when(F.col("size_") > 2 * draws, draws).otherwise(F.col("size_"))
    return totals(least_hashed(met, ["trial"], ["slot", *order], wanted, seed), pred, actual)


BLOCK = 32  # trials whose weights are columns of one pass


def rank_metrics(rows: DataFrame, by: list[str], order: list[str], pred: str, actual: str, trials: int, seed: str) -> DataFrame:
    """by, metric, value, low, high: mean and median absolute error and rank correlation, with intervals of row resamples.

    Each row has a Poisson weight in each trial, and 1 in trial 0, which gives the value.  The median is the least error
    up to which half of the weight lies; ranks of equal values are averaged over their weight.  A row carries the weights
    of a block of trials side by side, so rows aren't multiplied: weights of equal pairs of values are added up where the
    rows are, and running sums are taken over ranges, so no task sees a trial's rows.
    """
    p, a = (F.col(c).cast("double") for c in (pred, actual))
    own = rows.select(*by, *order, p.alias("p_"), a.alias("a_")).where("p_ is not null and a_ is not null")
    blocks = [range(k, min(k + BLOCK, trials + 1)) for k in range(0, trials + 1, BLOCK)]
    own = cut(own) if len(blocks) > 1 else own
    long = reduce(DataFrame.unionByName, (trial_metrics(own, by, order, block, seed) for block in blocks))
    later = F.when(F.col("trial") > 0, F.col("v"))  # trials values at most
    return long.groupBy(*by, "metric").agg(F.max(F.when(F.col("trial") == 0, F.col("v"))).alias("value"), F.percentile(later, 0.025).alias("low"), F.percentile(later, 0.975).alias("high"))


def trial_metrics(rows: DataFrame, by: list[str], order: list[str], trials: range, seed: str) -> DataFrame:
    """by, trial, metric and v of the trials' weights of rows (by, order, p_, a_)."""
    w = {t: f"w_{t}" for t in trials}
    weight = lambda t: F.sum(poisson(hash_number(F.lit(seed), F.lit(t), *order)) if t else F.lit(1))
    pairs = cut(rows.groupBy(*by, "p_", "a_").agg(*(weight(t).alias(c) for t, c in w.items())).withColumn("gap_", F.abs(F.col("p_") - F.col("a_"))))
    total = lambda name, x: [F.sum(x(t)).cast("double").alias(f"{name}_{t}") for t in trials]
    rank = lambda t: F.col(f"upto_{w[t]}") - (F.col(w[t]) - 1) / 2.0
    ranks = {c: running(pairs, c, by, list(w.values())).select(*by, F.col("value").alias(c), *w.values(), *(rank(t).alias(f"r_{t}") for t in trials)) for c in ("p_", "a_")}
    half = lambda t: (F.col(w[t]) > 0) & (F.col(f"upto_{w[t]}") * 2 >= F.col(f"total_{w[t]}"))
    middle = running(pairs, "gap_", by, list(w.values())).groupBy(*by).agg(*(F.min(F.when(half(t), F.col("value"))).alias(f"med_{t}") for t in trials))
    sums = pairs.groupBy(*by).agg(*total("n", lambda t: F.col(w[t])), *total("gap", lambda t: F.col(w[t]) * F.col("gap_")))
    squares = [df.groupBy(*by).agg(*total(f"s{c}", lambda t: F.col(w[t]) * F.col(f"r_{t}")), *total(f"s{c}{c}", lambda t: F.col(w[t]) * F.col(f"r_{t}") * F.col(f"r_{t}"))) for c, df in (("p", ranks["p_"]), ("a", ranks["a_"]))]
    across = met(pairs, ranks["a_"].drop(*w.values()), by, "a_").groupBy(*by, "p_").agg(*total("x", lambda t: F.col(w[t]) * F.col(f"r_{t}")))
    cross = met(across, ranks["p_"].drop(*w.values()), by, "p_").groupBy(*by).agg(*total("spa", lambda t: F.col(f"x_{t}") * F.col(f"r_{t}")))
    parts = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (sums, middle, *squares, cross))
    m = parts.groupBy(*by).agg(*(F.max(c).alias(c) for c in parts.columns if c not in by))

    def metrics(t: int) -> list[Column]:
        n, sp, sa, spp, saa, spa = (F.col(f"{c}_{t}") for c in ("n", "sp", "sa", "spp", "saa", "spa"))
        vp, va = n * spp - sp * sp, n * saa - sa * sa
        rho = F.when((vp > 0) & (va > 0), (n * spa - sp * sa) / F.sqrt(vp * va))
        found = {"mae": F.try_divide(f"gap_{t}", n), "median_ae": F.col(f"med_{t}"), "spearman": rho}
        return [F.struct(F.lit(t).alias("trial"), F.lit(k).alias("metric"), v.alias("v")) for k, v in found.items()]

    return m.select(*by, F.explode(F.array(*(x for t in trials for x in metrics(t)))).alias("x_")).select(*by, "x_.*")


def met(df: DataFrame, ranks: DataFrame, by: list[str], value: str) -> DataFrame:
    """df plus its values' ranks; null groups meet each other.  Both grow with the different values, so neither is broadcast."""
    named = ranks.withColumnsRenamed({c: f"{c}g_" for c in (*by, value)})
    same = F.col(value) == F.col(f"{value}g_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}g_"))
    return df.join(named.hint("merge"), same).drop(*(f"{c}g_" for c in (*by, value)))
