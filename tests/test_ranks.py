"""Percentiles of whole columns against NumPy."""

import numpy as np

from tallybrook.operators import ranks
from tallybrook.operators.ranks import percentiles


def test_percentiles(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in (("a", 400), ("b", 1), (None, 37)) for v in np.concatenate([rng.integers(0, 9, n // 2), rng.normal(size=n - n // 2)])]
    df = spark.createDataFrame([*rows, ("a", None), ("none", None)], "g string, x double").repartition(5)
    wanted = {"low": 0.0, "some": 0.37, "mid": 0.5, "top": 1.0}
    by = lambda xs: list(np.quantile(xs, list(wanted.values())))
    found = {r["g"]: list(r)[1:] for r in percentiles(df, "x", wanted, ["g"]).collect()}
    assert set(found) == {"a", "b", None}
    assert all(np.allclose(v, by([x for h, x in rows if h == g])) for g, v in found.items())
    assert np.allclose(list(percentiles(df, "x", wanted).collect()[0]), by([x for _, x in rows]))
    assert list(percentiles(df.limit(0), "x", {"mid": 0.5}).collect()[0]) == [None]


def test_key_percentiles_of_large_keys(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g, n in (("hot", 600), ("b", 1), (None, 37), ("c", 5)) for v in rng.integers(0, 40, n)]
    df = spark.createDataFrame([*rows, ("b", None), ("none", None)], "g string, x double").repartition(5)
    wanted, counts = {"low": 0.1, "mid": 0.5, "top": 1.0}, ranks.counted(df, "x", ["g"])
    want = {g: np.quantile([x for h, x in rows if h == g], list(wanted.values())) for g in ("hot", "b", None, "c")}
    for many in (1_000_000, 20, 0):
        monkeypatch.setattr(ranks, "MANY", many)
        found = {r["g"]: r for r in ranks.key_percentiles(counts, wanted, ["g"], ranks.F.sum("n").alias("n")).collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose([found[g][k] for k in wanted], want[g]) and found[g]["n"] == sum(h == g for h, _ in rows) for g in want)
    assert ranks.key_percentiles(counts.limit(0), wanted, ["g"]).count() == 0
