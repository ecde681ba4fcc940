"""Draws against their expected shares."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tallybrook.operators import simulate


def test_zipf_shares(spark):
    """Of 10,000 pages those behind rank 400 have 33 % of the weight, and each visit draws one page."""
    pages = simulate.numbered(spark.range(10_000).withColumnRenamed("id", "page"), ["page"])
    rows = pages.select("page", F.when(F.col("i") >= 400, 1).otherwise(0).alias("behind"), F.lit(1).alias("one"), F.col("i")).cache()
    found = simulate.zipf_journeys(rows.drop("i"), "page", "behind", "one", 500, 40, "z").collect()
    assert len(found) == 40 and all(r["actual"] == 500 for r in found)
    weight = [1 / k for k in range(1, 10_001)]
    assert abs(sum(r["pred"] for r in found) / 20_000 - sum(weight[400:]) / sum(weight)) < 0.02
    first = simulate.zipf_journeys(rows.select("page", (F.col("i") == 0).cast("int").alias("first"), "one"), "page", "first", "one", 500, 40, "z").collect()
    assert abs(sum(r["pred"] for r in first) / 20_000 - 1 / sum(weight)) < 0.01


def test_rank_metrics(spark, monkeypatch):
    """Against plain Python, with null groups, ties, nulls and trials in several blocks; rows aren't multiplied by trials."""
    rows = [(g, i, float(i * 7 % 5), float(i * 11 % 13)) for g, n in (("a", 60), (None, 25), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", 900, None, 1.0), ("a", 901, 2.0, None)], "g string, i long, p double, a double").repartition(3)
    cuts = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(17)]

    def weight(t, i):
        u = (int(hashlib.md5(f"s|{t}|{i}".encode()).hexdigest()[:15], 16) >> 8) / 2.0**52
        return sum(u >= c for c in cuts) if t else 1

    def metrics(g, t):
        some = [(p, a) for h, i, p, a in rows if h == g for _ in range(weight(t, i))]
        if not some:
            return {"mae": None, "median_ae": None, "spearman": None}
        gaps = sorted(abs(p - a) for p, a in some)
        ranks = [[sum(y < x for y in c) + sum(y == x for y in c) / 2 for x in c] for c in zip(*some, strict=True)]
        varied = all(len(set(r)) > 1 for r in ranks)
        return {"mae": sum(gaps) / len(gaps), "median_ae": gaps[(len(gaps) + 1) // 2 - 1], "spearman": np.corrcoef(*ranks)[0, 1] if varied else None}

    want = {(g, k): [metrics(g, t)[k] for t in range(7)] for g in ("a", None, "one") for k in ("mae", "median_ae", "spearman")}
    stored, cut = [], simulate.cut
    monkeypatch.setattr(simulate, "cut", lambda df: stored.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    for block in (32, 3):
        monkeypatch.setattr(simulate, "BLOCK", block)
        found = {(r["g"], r["metric"]): r for r in simulate.rank_metrics(df, ["g"], ["i"], "p", "a", 6, "s").collect()}
        assert found.keys() == want.keys()
        for key, (value, *later) in want.items():
            there = [v for v in later if v is not None]
            wanted = [value, *(np.quantile(there, q) if there else None for q in (0.025, 0.975))]
            assert all(x is None and y is None or abs(x - y) < 1e-9 for x, y in zip([found[key][c] for c in ("value", "low", "high")], wanted, strict=True))
    assert stored and not any("Generate" in plan for plan in stored)
