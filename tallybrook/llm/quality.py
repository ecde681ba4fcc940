"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted on one feature at a time, in turns, so that each feature's trees add up to a look-up table
over its bins; then the feature pairs that explain most of what is left get tables of their own.  A text's score is the
logistic of the sum of its bins' entries.  Features are counts over the whole text, taken on the executors; the model is
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import _bytes
from tallybrook.llm._common import aside, cut, prepare, restored

FIT_ROWS = 20_000  # labelled rows that the model is fitted on: those of least hash
BINS = 24
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, RIDGE = 120, 40, 6, 0.15, 3, 4.0
THRESHOLD = 0.7
FEATURES = ("log_words", "upper", "digit", "mark", "symbol", "bar", "stop", "space", "line", "foreign", "word_length", "distinct", "repeated", "short", "common", "capital")

_CLASS = np.zeros(256, np.int64)  # byte classes of the text features
for _i, _chars in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b"!?", b"#$%&*+/=@\\^_~<>", b"|", b".,;:", b" \t", b"\n\r", range(0x80, 0x100), range(0x61, 0x7B)), 1):
    _CLASS[list(_chars)] = _i


def text_features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all 0 for texts without bytes."""
    data, off = _bytes.utf8(column)
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    hashes, first = _bytes.words(data, off)
    for d in range(n):
        text, own = data[off[d] : off[d + 1]], hashes[first[d] : first[d + 1]]
        if not len(text):
            continue
        kind = np.bincount(np.take(_CLASS, text), minlength=11) / len(text)
        words = len(own)
        capital = np.count_nonzero((text[1:] >= 0x41) & (text[1:] <= 0x5A) & (text[:-1] <= 0x20)) if len(text) > 1 else 0
        if words:
            different, often = np.unique(own, return_counts=True)
            rest = (kind[2] + kind[1] + kind[9] + kind[10]) * len(text) / words, len(different) / words ** 0.8, np.count_nonzero(own[1:] == own[:-1]) / words, np.count_nonzero(often == 1) / words, often.max() / words, capital / words
        else:
            rest = (0.0,) * 6
        out[d] = (np.log1p(words), *kind[1:10], *rest)
    return out


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted as quality 1, with all their columns, whatever their names.

    Null texts are judged as empty ones; rows with null or repeated doc_ids are judged by their texts like any other.
    """
    some, back = aside(docs, "doc_id")
    return restored(scores(some, labels, *back, text=next(k for k, c in back.items() if c == "text")).where("predicted = 1"), back)


def features(docs: DataFrame, *kept: str, text: str = "text") -> DataFrame:
    """The kept columns and x, the features of every text (null: empty)."""
    prepare(docs.sparkSession)
    columns = [*kept, *[text] * (text not in kept)]  # the text goes to the workers once
    at = columns.index(text)

    def measure(batches):
        for b in _bytes.smaller(batches, at):
            x = text_features(b.column(at).cast(pa.large_string()))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], rows], [*kept, "x"])

    some = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[: len(kept)])
    return some.mapInArrow(measure, f"{schema}, x array<double>")


class Additive:
    """Look-up tables over binned features and over pairs of them."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            total += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            total += t[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of neighbouring bins with gradient sums g and weights h."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax()) if len(gain) else -1
    return (float(gain[k]), k + 1) if k >= 0 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A shallow tree's value for each bin."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        gain, at, k = max((*best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(leaves))
        if gain <= 1e-9:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree over a pair: a cut of one feature, then one of the other on either side."""
    best, value = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        a, b = gg.cumsum(0), hh.cumsum(0)
        for at in range(max(1, len(gg) // 12), len(gg), max(1, len(gg) // 12)):
            sides, gain = [], -(g.sum() ** 2) / (h.sum() + RIDGE)
            for lo, hi, gs, hs in ((0, at, a[at - 1], b[at - 1]), (at, len(gg), a[-1] - a[at - 1], b[-1] - b[at - 1])):
                more, k = best_cut(gs, hs)
                gain += more + gs.sum() ** 2 / (hs.sum() + RIDGE)
                sides.append((lo, hi, k, gs, hs))
            if gain > best:
                best, v = gain, np.zeros_like(gg)
                for lo, hi, k, gs, hs in sides:
                    for x, y in ((0, k), (k, len(gs))):
                        if y > x:
                            v[lo:hi, x:y] = gs[x:y].sum() / (hs[x:y].sum() + RIDGE)
                value = v.T if flip else v
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost per-feature tables in turns, then those of the pairs that gain most."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(edges, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    bins, raw = model.bins(x), np.full(len(x), model.base)

    def slope():
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slope()
            step = RATE * tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)))
            table += step
            raw += step[bins[:, j]]

    def sums(i, j, g, h):
        shape = len(model.tables[i]), len(model.tables[j])
        at = bins[:, i] * shape[1] + bins[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    gains = sorted(((quadrants(*sums(i, j, g, h))[0], i, j) for i in range(len(FEATURES)) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 1]
    for i, j in chosen:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slope()
            step = RATE * quadrants(*sums(i, j, g, h))[1]
            model.pairs[i, j] += step
            raw += step[bins[:, i], bins[:, j]]
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """Fit on the labelled rows that aren't held out; of more than fit_rows, on those of least hash.

    measured: doc_id and x.  Labels other than 0 and 1, and rows with a null doc_id, teach nothing; a doc_id with both
    labels counts as its mean, rounded up; repeated rows count once.  The driver gets little more than fit_rows rows, as
    the hash is cut off by the number of labelled rows before they are sorted.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    rows = measured.where(~held_out()).select("doc_id", "x").join(known, "doc_id").select(F.xxhash64("doc_id", "x").alias("h"), "doc_id", "x", "quality").distinct()
    n = rows.count()
    if n > fit_rows:  # the expected number below the bound is above fit_rows by ten of its deviations
        share = (fit_rows + 10 * fit_rows**0.5) / n
        rows = rows.where(F.col("h") <= int(2**63 * (2 * share - 1))) if share < 1 else rows
    rows = rows.orderBy("h", "doc_id", "x").limit(fit_rows).collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in rows], float))


def scores(docs: DataFrame, labels: DataFrame, *kept: str, text: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the kept columns, which have names that aside() gave, held_out, score and predicted."""
    measured = cut(features(docs, "doc_id", *kept, text=text))
    sent = docs.sparkSession.sparkContext.broadcast(train(measured, labels, fit_rows))

    def scored(batches):
        model = sent.value
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(len(b), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], [*b.schema.names[:-1], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields[:-1])
    rows = measured.mapInArrow(scored, f"{schema}, score double")
    return rows.select("doc_id", *kept, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *kept: str, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the kept columns, held_out, score and predicted of every document.

    Null texts are empty; empty texts get a score like any other; without labels of both kinds every score is the prior.
    Repeated rows stay repeated.  No other column than the text enters a score.  A kept column may have any name but those
    of the results, which is an error.
    """
    kept = tuple(c for c in dict.fromkeys(kept) if c != "doc_id")
    if clash := {"held_out", "score", "predicted"} & set(kept):
        raise ValueError(f"kept columns have names of results: {sorted(clash)}")
    some, back = aside(docs.select("doc_id", "text", *(f"`{c}`" for c in kept if c != "text")), "doc_id", "text")
    names = {c: k for k, c in back.items()}
    rows = scores(some, labels, *(names[c] for c in kept), fit_rows=fit_rows, threshold=threshold)
    return rows.select("doc_id", *(F.col(names[c]).alias(c) for c in kept), "held_out", "score", "predicted")
