"""Boosted trees against a plain loop over rows, and the properties of their losses."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallybrook.operators import boosting as B
from tallybrook.operators import tuning as N


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 400
    x = np.stack([rng.integers(0, 2, n), rng.integers(0, 9, n), np.round(rng.normal(size=n), 1)], 1).astype(float)
    y = np.round(np.exp(1 + x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) * 0.4), 3)
    return x, np.stack([y, np.round(x[:, 2] * 3 + rng.normal(size=n), 3)], 1)


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, x array<double>, y array<double>").repartition(3).cache()


def grown(t, x, y, edges, n_trees, depth, rate, shrink=1.0, least=1.0):
    """One model's margins by the same rules, a node at a time."""
    bins = np.stack([[sum(e < v for e in edges[f]) for v in x[:, f]] for f in range(x.shape[1])], 1)
    start = np.quantile(y, t.level) if t.loss == "quantile" else math.log(y.mean()) if t.loss == "tweedie" else y.mean()
    margin = np.full(len(y), float(start))
    for _ in range(n_trees):
        g, h = B.gradients(t, y, margin)
        leaves, step = [np.arange(len(y))], np.zeros(len(y))
        for _ in range(depth):
            nxt = []
            for rows in leaves:
                best, part = None, lambda r: g[r].sum() ** 2 / (h[r].sum() + shrink)
                for f in range(x.shape[1]):
                    for b in range(len(edges[f])):
                        left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                        if h[left].sum() >= least and h[right].sum() >= least and len(left) and len(right):
                            gain = part(left) + part(right) - part(rows)
                            key = (round(math.log(gain), 7), -f, -b) if gain > 1e-9 else None
                            if key and (best is None or key > best[0]):
                                best = key, left, right
                nxt += [best[1], best[2]] if best else []
                if not best:
                    step[rows] = value_of(t, rows, y, margin, g, h, shrink) * rate
            leaves = nxt
        for rows in leaves:
            step[rows] = value_of(t, rows, y, margin, g, h, shrink) * rate
        margin = margin + step
    return np.exp(margin) if t.loss == "tweedie" else margin


def value_of(t, rows, y, margin, g, h, shrink):
    return np.quantile(y[rows] - margin[rows], t.level) if t.loss == "quantile" else -g[rows].sum() / (h[rows].sum() + shrink)


TARGETS = [B.Target("low", 0, "tweedie", 1.2), B.Target("high", 0, "tweedie", 1.8), B.Target("q10", 1, "quantile", 0.1), B.Target("mean", 1, "squared")]


@pytest.fixture(scope="module")
def models(frame):
    return B.fit(frame, "x", "y", TARGETS, 7, 3, 0.3)


def test_trees_are_those_of_a_plain_loop(frame, models, data):
    x, y = data
    found = {r["id"]: r["predictions"] for r in B.predict(frame.drop("y"), "x", models).collect()}
    got = np.array([found[i] for i in range(len(x))])
    for k, t in enumerate(TARGETS):
        assert np.allclose(got[:, k], grown(t, x, y[:, t.y], models.edges, 7, 3, 0.3), rtol=1e-6), t


def test_losses_fall(frame, models, data):
    x, y = data
    got = {r["id"]: r["predictions"] for r in B.predict(frame, "x", models).collect()}
    mean = np.array([got[i] for i in range(len(x))])
    assert np.abs(mean[:, 0] - y[:, 0]).mean() < 0.7 * np.abs(y[:, 0].mean() - y[:, 0]).mean()
    assert abs((y[:, 1] < mean[:, 2]).mean() - 0.1) < 0.05
    assert ((mean[:, 3] - y[:, 1]) ** 2).mean() < 0.5 * y[:, 1].var()


def test_missing_values_and_empty_tables(spark, frame):
    rows = [(1, [None, 2.0], [5.0]), (2, [1.0, float("nan")], [7.0]), (3, [1.0, 3.0], [None]), (4, [0.0, 3.0], [float("nan")]), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>")
    m = B.fit(df.where("x is not null"), "x", "y", [B.Target("t", 0, "squared")], 3, 2, least=0.5)
    out = {r["id"]: r["predictions"] for r in B.predict(df, "x", m).collect()}
    assert out[5] is None and all(math.isfinite(v) for k in (1, 2, 3, 4) for v in out[k])
    none = B.fit(df.limit(0), "x", "y", [B.Target("t", 0, "squared")], 3, 2)
    assert none.start.tolist() == [0.0] and not none.feature
    assert B.predict(df.limit(0), "x", m).count() == 0
    one = B.fit(frame.withColumn("y", F.array(F.lit(4.0))), "x", "y", [B.Target("t", 0, "tweedie", 1.5), B.Target("q", 0, "quantile", 0.5)], 2, 2)
    assert np.allclose([r["predictions"] for r in B.predict(frame, "x", one).collect()], 4.0)


def test_halving_is_repeatable(frame):
    """The same trials, errors and survivors whatever the partitions; each rung keeps the better half."""
    rows = frame.select("x", F.col("y")[0].alias("label"), (F.col("id") % 3).alias("fold"))
    one = N.halving(rows, "x", "label", "fold", 3, 5, (1, 2), 3)
    other = N.halving(rows.repartition(5), "x", "label", "fold", 3, 5, (1, 2), 3)
    told = lambda found: [(t["trial"], t["depth"], t["rung"], round(t["cv_mae"], 6), t["kept"]) for t in found]
    assert told(one) == told(other)
    first = sorted((t for t in one if t["rung"] == 0), key=lambda t: t["cv_mae"])
    assert [t["kept"] for t in first] == [True, True, False, False, False]
    assert {t["trial"] for t in one if t["rung"] == 1} == {t["trial"] for t in first[:2]} and sum(t["kept"] for t in one if t["rung"] == 1) == 1


def test_held_out_rows_are_not_seen(frame):
    """A fold's error is that of a model fitted on the other folds alone."""
    rows = frame.select("id", "x", F.col("y")[0].alias("label"), (F.col("id") % 2).alias("fold"))
    t = [{"trial": 0, "depth": 2, "rate": 0.5, "shrink": 2.0}]
    got, gaps = N.fold_errors(rows, "x", "label", "fold", 2, t, 2)[0], []
    edges = rows.withColumn("y", F.array("label"))
    for f in (0, 1):
        m = B.fit(edges.withColumn("y", F.array(F.when(F.col("fold") != f, F.col("label")))), "x", "y", [B.Target("t", 0, "squared")], 2, 2, 0.5, 2.0)
        gaps += [abs(max(r["predictions"][0], 0.0) - r["label"]) for r in B.predict(rows.where(F.col("fold") == f), "x", m).collect()]
    assert got == pytest.approx(np.mean(gaps), rel=1e-9)


def alike_rows(spark, n=600):
    """Rows of few different features, and one row for each of those with their number and mean target."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 2, n), rng.integers(0, 5, n), rng.integers(0, 7, n)], 1).astype(float)
    y = np.round(np.exp(1 + x[:, 0] + 0.3 * x[:, 1] - 0.2 * x[:, 2] + rng.normal(size=n) * 0.6), 3)
    rows = spark.createDataFrame([(i, a.tolist(), float(v), i % 3) for i, (a, v) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, label double, fold int").repartition(3).cache()
    return rows, rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("label"))


def test_alike_rows_grow_the_same_trees(spark):
    """rows of equal features by their number and mean target give the models that the rows give."""
    rows, alike = alike_rows(spark)
    targets = [B.Target("t", 0, "tweedie", 1.5), B.Target("s", 0, "squared"), B.Target("h", 0, "squared", depth=2, rate=0.5, shrink=3.0)]
    one = B.fit(rows.withColumn("y", F.array("label")), "x", "y", targets, 4, 3, 0.3, least=2.0)
    other = B.fit(alike.withColumn("y", F.array("label")), "x", "y", targets, 4, 3, 0.3, least=2.0, weight="n")
    assert all(np.array_equal(a, b) for a, b in zip(one.edges, other.edges, strict=True)) and np.allclose(one.start, other.start, rtol=1e-12)
    assert all(np.array_equal(a, b) for a, b in zip(one.feature, other.feature, strict=True)) and all(np.allclose(a, b, rtol=1e-9) for a, b in zip(one.value, other.value, strict=True))
    with pytest.raises(ValueError):
        B.fit(alike.withColumn("y", F.array("label")), "x", "y", [B.Target("q", 0, "quantile", 0.5)], 1, 2, weight="n")


def test_a_search_over_alike_rows_is_that_over_all(spark):
    """trials learn from sums of alike rows and are judged by every row; a key may be null."""
    rows, alike = alike_rows(spark)
    key = F.when(F.col("x")[1] > 0, F.col("x")[1])
    by = {"a": F.col("x")[0], "b": key, "c": F.col("x")[2]}
    one = N.halving(rows, "x", "label", "fold", 3, 4, (1, 3), 3)
    other = N.halving(rows.withColumns(by).drop("x"), "x", "label", "fold", 3, 4, (1, 3), 3, alike=alike.select("x").withColumns(by), by=[*by])
    told = lambda found: [(t["trial"], t["rung"], t["kept"]) for t in found]
    assert told(one) == told(other) and np.allclose([t["cv_mae"] for t in one], [t["cv_mae"] for t in other], rtol=1e-9)


def test_weighted_means_grow_the_trees_of_their_rows(spark):
    """F5 to F8: the trees of the squared loss are the same over rows and over means of alike rows by their number."""
    from tallybrook.plans.models import trees

    rows, alike = alike_rows(spark)
    fits = [trees("v", 3, 3).fit(df.withColumn("v", array_to_vector("x"))) for df in (rows.withColumn("n", F.lit(1)), alike)]
    assert np.allclose(*([r["prediction"] for r in f.transform(alike.withColumn("v", array_to_vector("x"))).orderBy("x").collect()] for f in fits), rtol=1e-9)
