"""Boosted trees by histograms: Tweedie deviance, pinball and squared loss, several models grown side by side.

Rows hold binned features, targets and each model's margin.  For each level of a tree every task sums gradients and
hessians by (model, node, feature, bin) in one pass; a shuffle adds the tasks' sums up, running sums over a feature's bins
give every split's gain, and the driver gets one row for each open node.  Margins follow from the trees grown since they
were last written, which is every few trees.  Leaves of the pinball loss take the exact quantile of their residuals.

A row may stand for several of equal features, with their number and mean target: the other losses' gradients are linear in
the target, so all sums are those of the rows by themselves.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.operators.ranks import cumulative, percentiles
from tallybrook.sources.storage import cut, workers_import

BINS = 64
SKETCH = 0.001  # relative rank error of the bins' edges; none for features of few values


class Target(NamedTuple):
    """A model to grow: a name, the target's place in y, the loss, and the Tweedie power or the quantile.

    Depth, rate and shrink are those of the fit unless the model has its own; no depth goes beyond the fit's.
    """

    name: str
    y: int
    loss: str
    level: float = 0.0
    depth: int | None = None
    rate: float | None = None
    shrink: float | None = None


class Trees(NamedTuple):
    """Grown models: by tree arrays of (model, node) with the node's feature (-1: a leaf), bin and value."""

    targets: list[Target]
    edges: list[np.ndarray]
    start: np.ndarray
    feature: list[np.ndarray]
    bin: list[np.ndarray]
    value: list[np.ndarray]


def gradients(t: Target, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margin; the Tweedie margin is the logarithm of the mean."""
    if t.loss == "tweedie":
        a, b = y * np.exp((1 - t.level) * margin), np.exp((2 - t.level) * margin)
        return b - a, (2 - t.level) * b - (1 - t.level) * a
    if t.loss == "quantile":
        return np.where(y > margin, -t.level, 1 - t.level), np.ones(len(y))
    return margin - y, np.ones(len(y))


def bin_edges(df: DataFrame, x: str, n: int, bins: int = BINS, weight: str | None = None) -> list[np.ndarray]:
    """For each place of an array of features the values between its bins, from one pass of quantile sketches.

    With a weight column they are the exact quantiles of the rows that the weights count.
    """
    if weight and n:
        each = df.select(F.col(weight).alias("w_"), F.posexplode(x).alias("f_", "v_")).where("v_ is not null and not isnan(v_)")
        upto = cumulative(each, "v_", ["f_"], "w_")
        asked = (F.min(F.when(F.col("upto") >= F.col("total") * (k / bins), F.col("value"))) for k in range(bins))
        found = {r["f_"]: r["edges"] for r in upto.groupBy("f_").agg(F.array(*asked).alias("edges")).collect()}  # a row for each feature
        return [np.unique(np.array(found.get(k, []), float)) for k in range(n)]
    some = df.select(*(F.when(~F.isnan(F.col(x)[k]), F.col(x)[k]).alias(f"f{k}") for k in range(n)))
    found = some.approxQuantile(some.columns, [k / bins for k in range(bins)], SKETCH) if n else []
    return [np.unique(np.array(v, float)) for v in found]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """How many edges lie below each value; a missing value is below all."""
    out = np.zeros(x.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.searchsorted(e, np.where(np.isnan(x[:, k]), -np.inf, x[:, k]), "left")
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix; nulls are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, width)


def walked(bins: np.ndarray, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The node that each row comes to in a tree whose nodes' children are 2i + 1 and 2i + 2."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        go = f >= 0
        if not go.any():
            return node
        node[go] = 2 * node[go] + 1 + (bins[rows[go], f[go]] > at[node[go]])


def applied(trees: Trees, bins: np.ndarray, margin: np.ndarray, first: int = 0) -> np.ndarray:
    """Margins with the trees from a number on added."""
    for feature, at, value in zip(trees.feature[first:], trees.bin[first:], trees.value[first:], strict=True):
        for k in range(len(trees.targets)):
            margin[:, k] += value[k][walked(bins, feature[k], at[k])]
    return margin


ROWS = "bins binary, y array<double>, margin array<double>, w double"


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if x.size else pa.array([[]] * len(x), pa.list_(pa.float64()))


def histograms(rows: DataFrame, trees: Trees, since: int, level: int) -> DataFrame:
    """model, node, feature, bin and the sums g, h and n of the rows there, for one level of the tree being grown (the last)."""
    n_models, n_features, first = len(trees.targets), len(trees.edges), 2**level - 1
    done = trees._replace(feature=trees.feature[:-1], bin=trees.bin[:-1], value=trees.value[:-1])

    def add(batches):
        sums = np.zeros((3, n_models, 2**level, n_features, BINS + 1))
        for b in batches:
            bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
            y, margin = matrix(b.column(1), len(b.column(1)[0])), applied(done, bins, matrix(b.column(2), n_models), since)
            w = b.column(3).to_numpy()
            for k, t in enumerate(trees.targets):
                node = walked(bins, trees.feature[-1][k], trees.bin[-1][k]) - first
                use = (node >= 0) & ~np.isnan(y[:, t.y])  # rows of nodes that weren't split stay above
                g, h = (w[use] * d for d in gradients(t, y[use, t.y], margin[use, k]))
                place = node[use] * (BINS + 1)
                for f in range(n_features):
                    code = place + bins[use, f]
                    for s, v in enumerate((g, h, None)):
                        sums[s, k, :, f] += np.bincount(code, v, 2**level * (BINS + 1)).reshape(-1, BINS + 1)
        at = np.nonzero(sums[2])
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in at), *(pa.array(s[at]) for s in sums)], ["model", "node", "feature", "bin", "g", "h", "n"])

    sums = rows.mapInArrow(add, "model int, node int, feature int, bin int, g double, h double, n double")
    return sums.groupBy("model", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))


def best_splits(sums: DataFrame, shrinks: list[float], least: float) -> list:
    """For each model and node its sums and its split of most gain: ties go to the first feature and the lowest bin."""
    own = Window.partitionBy("model", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = sums.select("*", *(F.sum(x).over(upto).alias(f"{x}_left") for x in "gh"), *(F.sum(x).over(own).alias(f"{x}_all") for x in "gh"))
    shrink = F.get(F.array(*(F.lit(float(x)) for x in shrinks)), F.col("model"))
    part = lambda g, h: g * g / (h + shrink)
    g, h, gl, hl = (F.col(x) for x in ("g_all", "h_all", "g_left", "h_left"))
    gain = part(gl, hl) + part(g - gl, h - hl) - part(g, h)
    fits = (hl >= least) & (h - hl >= least) & (gain > 1e-9)
    told = F.when(fits, F.struct(F.round(F.log(gain), 7).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), gl.alias("gl"), hl.alias("hl")))
    return c.groupBy("model", "node").agg(F.max(told).alias("best"), F.min_by(F.struct("g_all", "h_all"), "feature").alias("all")).collect()  # a row for each open node


def leaf_quantiles(rows: DataFrame, trees: Trees, since: int) -> dict[tuple[int, int], float]:
    """The quantile of what is left in each leaf of the last tree, by model and node."""
    n_models, n_features = len(trees.targets), len(trees.edges)
    done = trees._replace(feature=trees.feature[:-1], bin=trees.bin[:-1], value=trees.value[:-1])

    def left(batches):
        for b in batches:
            bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, n_features)
            y, margin = matrix(b.column(1), len(b.column(1)[0])), applied(done, bins, matrix(b.column(2), n_models), since)
            for k, t in enumerate(trees.targets):
                use = ~np.isnan(y[:, t.y])
                if t.loss == "quantile" and use.any():
                    node = walked(bins, trees.feature[-1][k], trees.bin[-1][k])[use]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), k, np.int32)), pa.array(node.astype(np.int32)), pa.array(y[use, t.y] - margin[use, k])], ["model", "node", "rest"])

    levels = sorted({t.level for t in trees.targets if t.loss == "quantile"})
    found = percentiles(rows.mapInArrow(left, "model int, node int, rest double"), "rest", {f"q{i}": q for i, q in enumerate(levels)}, ["model", "node"])
    return {(r["model"], r["node"]): r[f"q{levels.index(trees.targets[r['model']].level)}"] for r in found.collect()}  # a row for each leaf


def fit(rows: DataFrame, x: str, y: str, targets: list[Target], n_trees: int, depth: int, rate: float = 0.1, shrink: float = 1.0, least: float = 1.0, every: int = 5, weight: str | None = None) -> Trees:
    """Grow the models on rows with an array of features and an array of targets (null or NaN: the row is not used for it).

    depth is that of the trees, shrink and least the penalty and the least sum of hessians of a leaf.  Tweedie targets must
    be positive.  Without rows the models are their start alone, 0.  weight: a column with the number of rows that a row
    stands for, with their mean targets; not for the pinball loss, which needs each target.
    """
    if weight and any(t.loss == "quantile" for t in targets):
        raise ValueError("the pinball loss has no weights")
    workers_import(rows.sparkSession)
    sizes = rows.select(F.size(x).alias("x"), F.size(y).alias("y")).first()
    n_features = sizes["x"] if sizes else 0
    edges = bin_edges(rows, x, n_features, weight=weight)
    start = np.array([starting(rows, y, t, weight) for t in targets])
    trees = Trees(targets, edges, start, [], [], [])

    def prepare(batches):
        for b in batches:
            bins = binned(matrix(b.column(0), n_features), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column(1), lists(np.tile(start, (len(b), 1))), b.column(2)], ["bins", "y", "margin", "w"])

    if not sizes:
        return trees
    own = lambda name, value: [value if (x := getattr(t, name)) is None else x for t in targets]
    depths, rates, shrinks = own("depth", depth), own("rate", rate), own("shrink", shrink)
    base, since, nodes = cut(rows.select(x, y, (F.col(weight) if weight else F.lit(1)).cast("double").alias("w")).mapInArrow(prepare, ROWS)), 0, 2 ** (depth + 1) - 1
    for _ in range(n_trees):
        grown = [np.full((len(targets), nodes), -1, np.int64), np.zeros((len(targets), nodes), np.int64), np.zeros((len(targets), nodes))]
        trees = trees._replace(feature=[*trees.feature, grown[0]], bin=[*trees.bin, grown[1]], value=[*trees.value, grown[2]])
        feature, at, value = grown
        for level in range(depth):
            found = best_splits(histograms(base, trees, since, level), shrinks, least)
            for r in found:
                k, i, (g, h), best = r["model"], r["node"] + 2**level - 1, r["all"], r["best"]
                worth = lambda g, h, k=k: -g / (h + shrinks[k]) * rates[k]
                value[k, i] = worth(g, h)
                if best and level < depths[k]:
                    feature[k, i], at[k, i] = -best["f"], -best["b"]
                    value[k, 2 * i + 1], value[k, 2 * i + 2] = worth(best["gl"], best["hl"]), worth(g - best["gl"], h - best["hl"])
            if not any(r["best"] for r in found):
                break
        if any(t.loss == "quantile" for t in targets):
            for (k, i), q in leaf_quantiles(base, trees, since).items():
                value[k, i] = q * rates[k]
        if len(trees.feature) - since >= every:
            base, since = cut(base.mapInArrow(settled(trees, since), ROWS)), len(trees.feature)
    return trees


def settled(trees: Trees, since: int):
    """Rows with the trees from a number on in their margins."""

    def write(batches):
        for b in batches:
            bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, len(trees.edges))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(applied(trees, bins, matrix(b.column(2), len(trees.targets)), since)), b.column(3)], ["bins", "y", "margin", "w"])

    return write


def starting(rows: DataFrame, y: str, t: Target, weight: str | None = None) -> float:
    """The best constant: the quantile, the mean, or the mean's logarithm; 0 without rows."""
    value = F.col(y)[t.y]
    own = rows.select(F.when(~F.isnan(value), value).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    mean = F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))))
    found = (percentiles(own, "v", {"v": t.level}) if t.loss == "quantile" else own.agg(mean.alias("v"))).first()
    v = found["v"] if found and found["v"] is not None else None
    return 0.0 if v is None else float(np.log(v)) if t.loss == "tweedie" else float(v)


def predict(df: DataFrame, x: str, trees: Trees, name: str = "predictions") -> DataFrame:
    """df plus an array of each model's predictions; a row without features has none."""
    workers_import(df.sparkSession)
    n_models, n_features, kept = len(trees.targets), len(trees.edges), [c for c in df.columns if c != name]
    links = np.array([t.loss == "tweedie" for t in trees.targets])

    def score(batches):
        for b in batches:
            bins = binned(matrix(b.column(len(kept)), n_features), trees.edges)
            margin = applied(trees, bins, np.tile(trees.start, (len(b), 1)))
            margin[:, links] = np.exp(margin[:, links])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists(margin)], [*kept, name])

    rows = df.select(*kept, F.col(x).alias("features__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    there = F.size("features__") == n_features if n_features else F.lit(False)
    scored = rows.where(there).mapInArrow(score, f"{schema}, `{name}` array<double>")
    return scored.unionByName(rows.where(~F.coalesce(there, F.lit(False))).drop("features__"), allowMissingColumns=True)
