"""Small fits against brute force and optimality conditions."""

import numpy as np
import pytest

from tallybrook.operators import evaluate as V
from tallybrook.operators import fitting as G


@pytest.mark.parametrize("seed", range(4))
def test_nnls_is_optimal(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.random((60, 6)), rng.random(60) - 0.5 * rng.random(60)
    gram, xy = x.T @ x, x.T @ y
    b = G.nnls(gram, xy)
    slope = gram @ b - xy
    assert (b >= 0).all() and (slope >= -1e-6).all() and abs(slope @ b) < 1e-6


def test_two_terms_match_nnls(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g, (a, b) in enumerate([(2.0, 3.0), (-2.0, 3.0), (2.0, -3.0), (-1.0, -1.0)]):
        x = rng.random((40, 2))
        y = x @ [a, b] + rng.normal(0, 0.1, 40)
        rows += [(g, float(p), float(q), float(v)) for (p, q), v in zip(x, y, strict=True)]
        want[g] = G.nnls(x.T @ x, x.T @ y)
    rows += [(9, 1.0, 2.0, 4.0), (9, 2.0, 4.0, 8.0)]  # dependent columns: either alone is a solution
    got = {r["g"]: r for r in G.two_terms(spark.createDataFrame(rows, "g int, p double, q double, y double"), "p", "q", "y", ["g"]).collect()}
    for g, b in want.items():
        assert np.allclose([got[g]["b1"], got[g]["b2"]], b, atol=1e-6)
    assert got[9]["b1"] + 2 * got[9]["b2"] == pytest.approx(4.0)


def test_forms_meet_the_rows_once(spark):
    """several fits, within groups too, are those of each by itself, from one pass over the rows."""
    rng = np.random.default_rng(8)
    rows = [(int(g), *(float(v) for v in rng.random(3) * [3, 5, 9] + 1000 * g)) for g in rng.integers(0, 4, 90)]
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    plain = spark.createDataFrame(rows, "g int, p double, q double, y double").cache()
    got = {r["form"]: r for r in G.two_term_forms(plain.mapInArrow(told, plain.schema), {"a": ("p", "q"), "b": ("q", "p"), "own": ("p", "q")}, "y", "g", ("own",)).collect()}
    assert seen.value == len(rows)
    own = G.demeaned(plain, "g", ["p", "q", "y"])
    for form, df, x1, x2 in (("a", plain, "p", "q"), ("b", plain, "q", "p"), ("own", own, "p", "q")):
        want = G.two_terms(df, x1, x2, "y").first()
        assert got[form]["n"] == want["n"] == len(rows) and np.allclose([got[form]["b1"], got[form]["b2"]], [want["b1"], want["b2"]], rtol=1e-6)


def test_presence_keeps_the_remainder(spark):
    cells = spark.createDataFrame([(1, "a", 5.0), (1, "r", 2.0), (1, "s", 3.0), (2, "a", 7.0)], "page int, host string, kb double")
    got = {(r["page"], r["column"]): r["value"] for r in G.presence(cells, "page", "host", "kb", 2).collect()}
    assert got == {(1, "a"): 1.0, (1, "(other)"): 5.0, (2, "a"): 1.0}


def test_products_meet_without_broadcast(spark):
    """cells and targets of a Gram matrix are as many as the pages, so neither is broadcast."""
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 5.0)], "page int, name string, v double")
    g, xy = G.gram(cells, ["page"], "name", "v", spark.createDataFrame([(1, 10.0), (2, 1.0)], "page int, y double"), "y")
    assert {tuple(r) for r in g.collect()} == {("a", "a", 29.0), ("a", "b", 6.0), ("b", "b", 9.0)} and {tuple(r) for r in xy.collect()} == {("a", 25.0), ("b", 30.0)}
    assert all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in (g, xy))


def test_gradeable_bounds(spark):
    rows = [("big", 10.0, 10.0)] * 300 + [("few", 10.0, 10.0)] * 150 + [("light", 0.0, 0.01)] * 300 + [("loud", 0.0, 1.0), ("loud", 20.0, 1.0)] * 150
    df = spark.createDataFrame(rows, "g string, p double, a double")
    assert [r["g"] for r in V.gradeable(df, ["g"], "p", "a").collect()] == ["big"]
    assert {r["g"] for r in V.gradeable(df, ["g"], "p", "a", most_se_pct=1000.0).collect()} == {"big", "loud"}


def sparse_design(n_rows, n_columns, seed):
    rng = np.random.default_rng(seed)
    cells = {(i, int(j)): round(float(v), 3) for i in range(n_rows) for j, v in zip(rng.choice(n_columns, 3, replace=False), rng.random(3) * [1, 5, 50] + 0.1, strict=True)}
    cells |= {(i, n_columns): 1.0 for i in range(n_rows)}  # one column that every row has
    y = rng.random(n_rows) * 20 - 4
    return cells, y


@pytest.mark.parametrize(("n_rows", "n_columns"), [(60, 12), (12_000, 10_000)])
def test_iterated_nnls_is_optimal(spark, n_rows, n_columns):
    """The optimality conditions, on columns of very different size; and on few columns the driver's own solution."""
    cells, y = sparse_design(n_rows, n_columns, 5)
    rows = spark.createDataFrame([(i, f"c{j}", v) for (i, j), v in cells.items()], "row int, name string, v double").cache()
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row int, y double")
    coef = {r["name"]: r["coef"] for r in G.fit_nnls(rows, ["row"], "name", "v", target, "y", most=4 if n_columns < 100 else G.MOST_COLUMNS, tolerance=1e-5).collect()}
    present = {j for _, j in cells}
    assert len(coef) == len(present) and min(coef.values()) >= 0
    rest, slope, size = y.copy(), np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    for (i, j), v in cells.items():
        rest[i] -= v * coef[f"c{j}"]
    for (i, j), v in cells.items():
        slope[j] -= v * rest[i]
        size[j] += v * v
    far = slope / np.sqrt(np.maximum(size, 1e-12))
    top = max(coef[f"c{j}"] * np.sqrt(size[j]) for j in present)
    assert all(far[j] >= -1e-3 * top and (coef[f"c{j}"] == 0 or abs(far[j]) <= 1e-3 * top) for j in present)
    if n_columns < 100:
        direct = {r["name"]: r["coef"] for r in G.fit_nnls(rows, ["row"], "name", "v", target, "y").collect()}
        assert all(coef[k] == pytest.approx(v, abs=1e-3 * max(direct.values())) for k, v in direct.items())
