"""Text features of URLs: TF-IDF weights of words and word pairs, and their truncated singular value decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions.urls import url_tokens
from tallybrook.operators.lookup import one_row
from tallybrook.sources.storage import cut, workers_import

MIN_DF, MOST_TERMS, DIMENSIONS = 5, 50_000, 50  # the tables broadcast below have MOST_TERMS rows at most
SPARE, ROUNDS, STRIPE = 10, 30, 1024  # directions beyond the wanted ones, rounds at most, terms of a stripe


def terms(text: Column) -> Column:
    """Words of two word characters and more, and pairs of neighbours, in their order; null has none."""
    words = F.regexp_extract_all(F.array_join(url_tokens(F.coalesce(text, F.lit(""))), " "), F.lit(r"(?U)\w\w+"), 0)
    return F.concat(words, F.transform(F.slice(words, 2, F.size(words)), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))


def _counted(texts: DataFrame, *kept: str) -> DataFrame:
    """kept, term and tf: the terms of each row, counted within the row."""
    own = texts.withColumn("terms_", terms(F.col("text")))
    each = F.transform(F.array_distinct("terms_"), lambda t: F.struct(t.alias("term"), F.size(F.filter(F.col("terms_"), lambda u: u == t)).alias("tf")))
    return own.select(*kept, F.inline(each))


def of_rows(weight: str | None) -> Column:
    """The number of rows; where a row stands for several, a column has their number."""
    return F.sum(weight) if weight else F.count(F.lit(1))


def vocabulary(train: DataFrame, text: str, min_df: int = MIN_DF, most: int = MOST_TERMS, weight: str | None = None) -> DataFrame:
    """term, at (from 0) and idf of the most frequent terms that min_df rows hold; each row of train counts, as often as its weight says."""
    own = train.groupBy(F.col(text).alias("text")).agg(of_rows(weight).alias("rows"))
    found = _counted(own, "rows").groupBy("term").agg(F.sum("rows").alias("df"), F.sum(F.col("rows") * F.col("tf")).alias("total"))
    kept = one_row(found.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(most), own.agg(F.sum("rows").alias("n")))
    numbered = kept.withColumn("at", F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1)  # over most rows at most
    return numbered.select("term", "at", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(texts: DataFrame, text: str, terms_: DataFrame) -> DataFrame:
    """text, at, term and weight: (1 + ln tf) idf, of unit length for each different text."""
    held = _counted(texts.select(F.col(text).alias("text")).distinct(), "text").join(F.broadcast(terms_), "term")
    raw = held.select("text", "at", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    listed = raw.groupBy("text").agg(F.collect_list(F.struct("at", "term", "raw")).alias("all"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))  # the terms of one text
    return listed.select("text", "length", F.inline("all")).select(F.col("text").alias(text), "at", "term", (F.col("raw") / F.col("length")).alias("weight"))


def directions(train: DataFrame, text: str, terms_: DataFrame, k: int = DIMENSIONS, weight: str | None = None) -> DataFrame:
    """term and direction: the k first right singular vectors of the TF-IDF matrix of train's rows, each with its
    largest entry positive; fewer where there are fewer terms, or no more variance.

    A randomised range finder: a few more directions than wanted are multiplied by the matrix and its transpose, over
    blocks of rows in Arrow, and made orthonormal, until the wanted ones settle.  The directions are MOST_TERMS times
    k + SPARE numbers (24 MB) at most, which the driver sends out and gets back as sums by stripes of terms.
    """
    spark = train.sparkSession
    workers_import(spark)
    schema = "term string, direction array<double>"
    size = terms_.count()
    if not size:
        return spark.createDataFrame([], schema)
    rows = train.groupBy(text).agg(of_rows(weight).alias("rows"))
    scaled = tfidf(train, text, terms_).join(rows, text).select(text, "at", (F.col("weight") * F.sqrt("rows")).alias("w"))  # a text weighs as much as its rows together
    held = scaled.groupBy(text).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("all"))
    matrix = cut(held.select(F.col("all.at").cast("array<int>").alias("at"), F.col("all.w").alias("w")))
    wide = min(size, k + SPARE)
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(size, wide)))[0]
    before = None
    for _ in range(ROUNDS):
        y = gram_product(matrix, q)
        values, turn = np.linalg.eigh(q.T @ y)
        order = np.argsort(values)[::-1]
        values, v = np.maximum(values[order], 0.0), q @ turn[:, order]
        kept = min(k, int((np.sqrt(values) > 1e-9 * np.sqrt(values[0])).sum())) if values[0] > 0 else 0
        v = v[:, :kept]
        if wide == size or (before is not None and before.shape == v.shape and np.abs(np.abs((before * v).sum(0)) - 1).max(initial=0) < 1e-12):
            break
        before, q = v, np.linalg.qr(y)[0]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    placed = spark.createDataFrame(pa.table({"at": pa.array(np.arange(size)), "direction": lists(v)}))
    return terms_.select("term", F.col("at").cast("long").alias("at")).join(F.broadcast(placed), "at").select("term", "direction")  # MOST_TERMS rows at most


def lists(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.list_(pa.float64()))


def gram_product(matrix: DataFrame, q: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times q: rows are sparse (at, w), sums meet by stripes of terms."""
    spark, (size, wide) = matrix.sparkSession, q.shape
    sent = spark.sparkContext.broadcast(q)

    def multiply(batches):
        out = np.zeros((size, wide))
        for b in batches:
            at, w = b.column(0), b.column(1)
            n = np.diff(at.offsets.to_numpy())
            row, at, w = np.repeat(np.arange(len(n)), n), at.flatten().to_numpy(), w.flatten().to_numpy()
            begins = np.cumsum(n) - n
            along = np.add.reduceat(np.vstack([sent.value[at] * w[:, None], np.zeros((1, wide))]), np.minimum(begins, len(at)), axis=0)
            along[n == 0] = 0.0
            for a in range(0, wide, 16):  # a few columns at a time
                some = along[row, a : a + 16] * w[:, None]
                for c in range(some.shape[1]):
                    out[:, a + c] += np.bincount(at, some[:, c], size)
        stripes = range(0, size, STRIPE)
        yield pa.RecordBatch.from_pydict({"stripe": pa.array(stripes, pa.int32()), "sums": pa.array([out[a : a + STRIPE].tobytes() for a in stripes], pa.binary())})

    def add(batches):
        held = {}
        for b in batches:
            for stripe, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[stripe] = held.get(stripe, 0.0) + np.frombuffer(sums)
        for stripe, sums in held.items():
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    form = "stripe int, sums binary"
    parts = matrix.mapInArrow(multiply, form).repartition("stripe").mapInArrow(add, form).collect()  # the sums of all terms
    sent.destroy()
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(parts, key=lambda r: r["stripe"])]).reshape(size, wide)


def width(along: DataFrame) -> int:
    """The number of directions."""
    first = along.first()
    return len(first["direction"]) if first else 0


def embed(texts: DataFrame, text: str, terms_: DataFrame, along: DataFrame) -> DataFrame:
    """text and embedding (array of doubles) of each different text that holds a known term."""
    placed = tfidf(texts, text, terms_).join(F.broadcast(along), "term")
    sums = [F.sum(F.col("weight") * F.col("direction")[i]) for i in range(width(along))]
    return placed.groupBy(text).agg(F.array(*sums).cast("array<double>").alias("embedding"))
