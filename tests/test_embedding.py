"""Text features against numpy, and the model queries' shapes."""

import math
from collections import Counter

import numpy as np
from tallybrook import plans
from tallybrook.operators import embedding as E

from .conftest import SF

PATHS = ["/gtag/js", "/gtag/js", "/collect/pixelOne", "/collect/pixel2024", "/ads/js/gtag", None, "", "/x/%25/_a", "/collect/js"]


def test_terms(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", E.terms("path").alias("t")).collect()
    got = {r["path"]: r["t"] for r in rows}
    assert got["/ads/js/gtag"] == ["ads", "js", "gtag", "ads js", "js gtag"]
    assert got["/collect/pixelOne"] == ["collect", "pixel", "one", "collect pixel", "pixel one"]
    assert got["/collect/pixel2024"] == ["collect", "pixel", "2024", "collect pixel", "pixel 2024"]
    assert got["/x/%25/_a"] == ["25"] and got[None] == got[""] == []


def test_embedding_equals_numpy(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    own = [r["t"] for r in df.select(E.terms("path").alias("t")).collect()]
    words = E.vocabulary(df, "path", min_df=2, most=6)
    names = [r["term"] for r in words.orderBy("at").collect()]
    df_of = {t: sum(t in o for o in own) for o in own for t in o}
    total = Counter(t for o in own for t in o)
    assert names == sorted((t for t in total if df_of[t] >= 2), key=lambda t: (-total[t], t))[:6]
    x = np.zeros((len(own), len(names)))
    for i, o in enumerate(own):
        for t, n in Counter(o).items():
            if t in names:
                x[i, names.index(t)] = (1 + math.log(n)) * (math.log((1 + len(own)) / (1 + df_of[t])) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, s, vt = np.linalg.svd(x)
    along = E.directions(df, "path", words, k=2)
    v = np.array([r["direction"] for r in along.join(words, "term").orderBy("at").collect()])
    assert s[1] - s[2] > 1e-3
    assert np.allclose(np.abs(v.T @ vt[:2].T), np.eye(2), atol=1e-6)
    got = {r["path"]: r["embedding"] for r in E.embed(df, "path", words, along).collect()}
    for i, p in enumerate(PATHS):
        if x[i].any():
            assert np.allclose(got[p], x[i] @ v, atol=1e-9)
        else:
            assert p not in got


def test_directions_equal_numpy_on_many_terms(spark):
    """More terms than directions, in many partitions: the same subspace, and the same singular values."""
    rng = np.random.default_rng(2)
    paths = ["/" + "/".join(f"w{int(v)}x" for v in np.minimum(rng.zipf(1.4, 6), 150)) for _ in range(600)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)
    words = E.vocabulary(df, "path", min_df=2).cache()
    rows = E.tfidf(df, "path", words).collect()
    n, x = words.count(), {}
    for r in rows:
        x.setdefault(r["path"], np.zeros(n))[r["at"]] = r["weight"]
    m = np.stack([x[p] for p in paths if p in x])
    _, s, vt = np.linalg.svd(m)
    k = 5
    v = np.array([r["direction"] for r in E.directions(df, "path", words, k).join(words, "term").orderBy("at").collect()])
    assert n > k + E.SPARE and v.shape == (n, k)
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-9)
    assert np.allclose(np.linalg.norm(m @ v, axis=0), s[:k], rtol=1e-7)
    assert np.linalg.norm(v - vt[:k].T @ (vt[:k] @ v)) < 1e-4


def test_no_terms(spark):
    none = spark.createDataFrame([(None,), ("",)], "path string")
    words = E.vocabulary(none, "path")
    along = E.directions(none, "path", words)
    assert words.count() == 0 and E.embed(none, "path", words, along).count() == 0


def test_model_queries(spark):
    shares = {r["feature_group"]: r["share"] for r in plans.QUERIES["grouped_importance"](spark, SF).collect()}
    assert set(shares) == {"identity", "structure", "patterns", "request", "text"} and abs(sum(shares.values()) - 1) < 1e-9
    counts = plans.QUERIES["tree_count_ablation"](spark, SF).orderBy("n_trees").collect()
    assert [r["n_trees"] for r in counts] == list(range(1, 11)) and counts[-1]["pct_worse_than_all"] == 0
    assert {r["features"] for r in plans.QUERIES["feature_ablation"](spark, SF).collect()} == {"all", "no_text", "no_patterns"}
