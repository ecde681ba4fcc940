"""Cascade fitting: Gram matrices by aggregation, non-negative least squares, host scales and small grouped fits."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.urls import PUBLIC_SUFFIXES, is_opaque, registrable, suffix_chain
from tallybrook.operators.lookup import one_row
from tallybrook.sources.storage import cut

MOST_COLUMNS = 4_000  # of a Gram matrix that is solved on the driver (128 MB); beyond it the fit stays a table


def gram(cells: DataFrame, row: list[str], column: str, value: str, target: DataFrame, y: str) -> tuple[DataFrame, DataFrame]:
    """(column a, column b, x: sum of products) and (column, xy) of a sparse design; target: row and y.

    Only columns that meet in a row make a product; both sides are summed before anything leaves the executors.
    """
    a = cells.select(*row, F.col(column).alias("a"), F.col(value).cast("double").alias("va"))
    b = cells.select(*row, F.col(column).alias("b"), F.col(value).cast("double").alias("vb"))
    # cells and targets are as many as the rows, however small their files are, so they aren't broadcast
    products = a.join(b.hint("merge"), row).where("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("x"))
    return products, a.join(target.hint("merge"), row).groupBy("a").agg(F.sum(F.col("va") * F.col(y)).alias("xy"))


def nnls(gram_: np.ndarray, xy: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Non-negative least squares from normal equations, by coordinate descent."""
    out, g = np.zeros(len(xy)), -xy.astype(float)
    diagonal = np.diag(gram_)
    for _ in range(rounds):
        most = 0.0
        for k in range(len(xy)):
            if diagonal[k] <= 0:
                continue
            step = max(out[k] - g[k] / diagonal[k], 0.0) - out[k]
            if step:
                out[k] += step
                g += step * gram_[:, k]
                most = max(most, abs(step))
        if most <= 1e-9 * max(1.0, float(np.abs(out).max(initial=0))):
            break
    return out


def fit_nnls(cells: DataFrame, row: list[str], column: str, value: str, target: DataFrame, y: str, most: int = MOST_COLUMNS, tolerance: float = 1e-7) -> DataFrame:
    """column and coef: the non-negative fit of y on the columns' values; columns that are all zero have 0.

    Up to so many columns the driver solves the normal equations; with more the fit is iterated over the cells.
    """
    spark = cells.sparkSession
    if len(cells.select(column).distinct().limit(most + 1).collect()) > most:
        return iterated_nnls(cells, row, column, value, target, y, tolerance=tolerance)
    g, xy = gram(cells, row, column, value, target, y)
    right = xy.orderBy("a").collect()  # a row for each column
    names = [r["a"] for r in right]
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in g.collect():  # most squared at most
        if r["a"] in at and r["b"] in at:
            m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["x"]
    coef = nnls(m, np.array([r["xy"] for r in right]))
    return spark.createDataFrame([(n, float(c)) for n, c in zip(names, coef, strict=True)], f"{column} string, coef double")


def iterated_nnls(cells: DataFrame, row: list[str], column: str, value: str, target: DataFrame, y: str, rounds: int = 2000, tolerance: float = 1e-7) -> DataFrame:
    """column and coef of any number of columns: accelerated projected gradients, with both products as joins.

    Columns are scaled to length 1.  A round joins the cells with the coefficients by column and with the residuals by
    row; only sums over all coefficients reach the driver.  It ends when no coefficient of the projected step moves by
    more than the tolerance, as a share of the largest, which bounds how far the optimality conditions are missed.
    """
    c = cells.select(*row, F.col(column).alias("c_"), F.col(value).cast("double").alias("v_")).groupBy(*row, "c_").agg(F.sum("v_").alias("v_")).where("v_ <> 0")
    scale = cut(c.groupBy("c_").agg(F.sqrt(F.sum(F.col("v_") * F.col("v_"))).alias("s_")))
    c = cut(c.join(scale, "c_").select(*row, "c_", (F.col("v_") / F.col("s_")).alias("v_")).repartition(*row))
    right = cut(target.groupBy(*row).agg(F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("y_")))

    def product(z: DataFrame, less: DataFrame | None) -> DataFrame:
        """c_ and g_: the cells' products with (their products with z, less the right side)."""
        p = c.join(z, "c_").groupBy(*row).agg(F.sum(F.col("v_") * F.col("z_")).alias("p_"))
        if less is not None:
            p = p.join(less, row, "left").withColumn("p_", F.col("p_") - F.coalesce("y_", F.lit(0.0)))
        return c.join(p, row).groupBy("c_").agg(F.sum(F.col("v_") * F.col("p_")).alias("g_"))

    z, length = scale.select("c_", F.lit(1.0).alias("z_")), 1.0
    for _ in range(12):  # power rounds towards the largest eigenvalue
        z = cut(product(z, None).withColumnRenamed("g_", "z_"))
        length = z.agg(F.sqrt(F.sum(F.col("z_") * F.col("z_")))).first()[0] or 0.0
        if not length:
            break
        z = z.withColumn("z_", F.col("z_") / length)
    length = 1.1 * length or 1.0
    state = scale.select("c_", F.lit(0.0).alias("w_"), F.lit(0.0).alias("z_"))
    t = 1.0
    for _ in range(rounds):
        onward = (1 + np.sqrt(1 + 4 * t * t)) / 2
        stepped = state.join(product(state.select("c_", "z_"), right), "c_", "left").withColumn("new_", F.greatest(F.lit(0.0), F.col("z_") - F.coalesce("g_", F.lit(0.0)) / length))
        back, moved = F.col("z_") - F.col("new_"), F.col("new_") - F.col("w_")
        told = cut(stepped.select("c_", F.col("new_").alias("w_"), (F.col("new_") + (t - 1) / onward * moved).alias("z_"), (back * moved).alias("turn_"), F.abs(back).alias("gap_")))
        m = told.agg(F.sum("turn_").alias("turn"), F.max("gap_").alias("gap"), F.max("w_").alias("top")).first()
        if m["gap"] is None or m["gap"] <= tolerance * max(m["top"], 1e-300):
            state = told
            break
        restart = m["turn"] > 0  # the step went against the momentum
        state, t = told.select("c_", "w_", (F.col("w_") if restart else F.col("z_")).alias("z_")), 1.0 if restart else onward
    else:
        raise ValueError(f"the fit hasn't settled within {rounds} rounds")
    zero = cells.select(F.col(column).alias("c_")).distinct()
    fitted = state.join(scale, "c_").select("c_", (F.col("w_") / F.col("s_")).alias("coef"))
    return zero.join(fitted, "c_", "left").select(F.col("c_").alias(column), F.coalesce("coef", F.lit(0.0)).alias("coef"))


def demeaned(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """df with the columns' group means taken off."""
    means = df.groupBy(group).agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    out = df.join(means, group)
    return out.withColumns({c: F.col(c) - F.col(f"m_{c}") for c in columns}).drop(*(f"m_{c}" for c in columns))


def page_lines(steps: DataFrame, page: str, x: str, y: str) -> DataFrame:
    """page, intercept, slope and n of y on x over steps with x >= 1."""
    return steps.where(F.col(x) >= 1).groupBy(page).agg(F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"), F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.count(F.lit(1)).alias("n"))


def host_scales(cells: DataFrame, host: str, value: str, min_obs: int = 2, keep: float = 0.25) -> DataFrame:
    """key, scale, kind: suffix means over the grand mean, and hosts that differ from their suffix by more than keep."""
    obs = cells.withColumn("h_", F.lower(F.col(host))).withColumn("s_", registrable(F.col("h_")))
    grand = obs.agg(F.avg(value).alias("grand"))
    by = lambda c: one_row(obs.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m")), grand).where(F.col("n") >= min_obs).select("key", (F.col("m") / F.col("grand")).alias("scale"))
    suffixes = by("s_").where(F.col("key").contains(".") & ~F.col("key").isin(*PUBLIC_SUFFIXES))
    exact = by("h_").where(~is_opaque(F.col("key"))).join(suffixes.select("key"), "key", "left_anti").withColumn("s_", registrable(F.col("key")))
    exact = exact.join(suffixes.select(F.col("key").alias("s_"), F.col("scale").alias("base")), "s_", "left").where(F.col("base").isNull() | (F.abs(F.col("scale") - F.col("base")) > keep))
    return suffixes.withColumn("kind", F.lit("suffix")).unionByName(exact.select("key", "scale", F.lit("exact").alias("kind")))


def levelling_weights(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """key and weight: the rows of hosts (host) by the entry that their suffix chain meets first."""
    own = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    chain = own.select("host", "n", F.posexplode(suffix_chain(F.lower("host"), 2)).alias("depth", "key"))
    return chain.join(entries.select("key"), "key").groupBy("host").agg(F.min_by("key", "depth").alias("key"), F.first("n").alias("n")).groupBy("key").agg(F.sum("n").alias("weight"))


def level(scales: dict[str, float], weights: dict[str, int], low: float = 0.1, high: float = 4.0, rounds: int = 80) -> dict[str, float]:
    """Scales divided by their weighted mean and clamped, again and again until the mean is 1; a small table."""
    for _ in range(rounds):
        total = sum(weights.get(k, 0) for k in scales)
        if not total:
            break
        mean = sum(v * weights.get(k, 0) for k, v in scales.items()) / total
        scales = {k: min(max(v / mean, low), high) for k, v in scales.items()}
        if abs(mean - 1) < 1e-9:
            break
    return scales


def shrunk_factors(groups: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean, se, weight, factor: group means shrunk to the grand mean by between-group against sampling variance."""
    g = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.var_samp(value) / F.count(F.lit(1))).alias("v"))
    t = g.agg(F.avg("mean").alias("grand"), F.greatest(F.var_samp("mean") - F.avg("v"), F.lit(0.0)).alias("between"))
    w = F.try_divide("between", F.col("between") + F.coalesce("v", F.lit(0.0)))
    return one_row(g, t).select(group, "n", "mean", F.sqrt("v").alias("se"), F.coalesce(w, F.lit(0.0)).alias("weight"), F.try_divide(F.col("grand") + F.coalesce(w, F.lit(0.0)) * (F.col("mean") - F.col("grand")), "grand").alias("factor"))


def host_units(blocks: DataFrame, page: list[str], repeat_weight: float = 0.0) -> DataFrame:
    """By page: cascading requests, distinct hosts, and units that count a host's further requests by repeat_weight."""
    per = blocks.groupBy(*page, "host").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(*page).agg(F.sum("k").alias("n_requests"), F.count(F.lit(1)).alias("n_hosts"), F.sum(1 + repeat_weight * (F.col("k") - 1)).alias("units"))


def saturation(panel: DataFrame, count: str, value: str) -> DataFrame:
    """By bucket of the number of cascading requests: pages, requests, and value for each request."""
    c = F.col(count)
    bucket = F.when(c == 1, "1").when(c <= 3, "2-3").when(c <= 7, "4-7").when(c <= 15, "8-15").otherwise("16+")
    return panel.where(c >= 1).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(count).alias("n_requests"), (F.sum(value).cast("double") / F.sum(count)).alias("per_request"))


#: Sums of products that a fit of y on two columns takes.
PRODUCTS = {"s11": (0, 0), "s22": (1, 1), "s12": (0, 1), "t1": (0, 2), "t2": (1, 2)}


def two_terms(rows: DataFrame, x1: str, x2: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n, b1 and b2 by group: the non-negative fit of y on two columns, in closed form from one aggregate of products.

    If a free coefficient is negative or the columns are dependent, the better of the two one-column fits is the solution.
    """
    c = [F.col(n).cast("double") for n in (x1, x2, y)]
    return solved(rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c[a] * c[b]).alias(k) for k, (a, b) in PRODUCTS.items())), by)


def solved(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """two_terms() from its sums of products."""
    s11, s22, s12, t1, t2 = (F.col(k) for k in PRODUCTS)
    det = s11 * s22 - s12 * s12
    free1, free2 = F.try_divide(s22 * t1 - s12 * t2, det), F.try_divide(s11 * t2 - s12 * t1, det)
    one1, one2 = (F.coalesce(F.greatest(F.try_divide(t, s), F.lit(0.0)), F.lit(0.0)) for t, s in ((t1, s11), (t2, s22)))
    inside, first = (det > 1e-9 * s11 * s22) & (free1 >= 0) & (free2 >= 0), one1 * t1 >= one2 * t2
    return sums.select(*(by or []), "n", F.when(inside, free1).when(first, one1).otherwise(0.0).alias("b1"), F.when(inside, free2).when(first, 0.0).otherwise(one2).alias("b2"))


def two_term_forms(rows: DataFrame, forms: dict[str, tuple[str, str]], y: str, group: str, within: tuple[str, ...] = ()) -> DataFrame:
    """form, n, b1 and b2: two_terms() of several pairs of columns, from one pass over rows; those named in within less their group's means.

    Products are added up by group, about its means where a form asks for that, and only the groups' sums are kept.
    """
    sums = [F.count(F.lit(1)).alias("n")]
    for form, xs in forms.items():
        c = [F.col(n).cast("double") for n in (*xs, y)]
        sums += [(F.regr_sxy(c[a], c[b]) if form in within else F.sum(c[a] * c[b])).alias(f"{form}_{k}") for k, (a, b) in PRODUCTS.items()]
    groups = cut(rows.groupBy(group).agg(*sums))
    each = reduce(DataFrame.unionByName, (groups.select(F.lit(form).alias("form"), "n", *(F.col(f"{form}_{k}").alias(k) for k in PRODUCTS)) for form in forms))
    return solved(each.groupBy("form").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in PRODUCTS)), ["form"])


def presence(page_hosts: DataFrame, page: str, host: str, value: str, min_pages: int) -> DataFrame:
    """page, column and value of a sparse design: 1 for each host of at least min_pages pages, and the other hosts' summed
    value in the column '(other)'."""
    pages = page_hosts.groupBy(host).agg(F.count(F.lit(1)).alias("pages_")).where(F.col("pages_") >= min_pages).select(host, F.lit(True).alias("common_"))
    common = F.coalesce("common_", F.lit(False))
    cells = page_hosts.join(pages, host, "left").select(page, F.when(common, F.col(host)).otherwise("(other)").alias("column"), F.when(common, 1.0).otherwise(F.col(value).cast("double")).alias("value"))
    return cells.groupBy(page, "column").agg(F.sum("value").alias("value"))


def implied_factors(panel: DataFrame, saving: dict[str, str], saved: DataFrame) -> DataFrame:
    """form, saved, factor and per_request: what is saved beyond the direct bytes, for each cascading byte and request.

    panel: touched pages with direct, casc_n and casc_bytes; saved: one row with the columns that saving names by form.
    """
    t = one_row(panel.agg(*(F.sum(c).cast("double").alias(c) for c in ("direct", "casc_n", "casc_bytes"))), saved)
    forms = t.selectExpr("direct", "casc_n", "casc_bytes", f"stack({len(saving)}, " + ", ".join(f"'{k}', {c}" for k, c in saving.items()) + ") as (form, saved)")
    beyond = F.col("saved") - F.col("direct")
    return forms.select("form", "saved", F.try_divide(beyond, "casc_bytes").alias("factor"), F.try_divide(beyond, "casc_n").alias("per_request"))
