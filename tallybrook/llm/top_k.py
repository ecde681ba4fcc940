"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Candidates are dealt into blocks.  A block holds, for each dimension, its candidates sorted by that component.  A query
reads all lists from its favourable end (large values first where its own component is positive, small ones first where
it is negative), slice after slice.  What has been read of a candidate gives a lower bound of its score, with the least
value of every unread list, and an upper bound, with the value at which that list's reading stands.  Reading stops when
no candidate outside the best k by lower bound can exceed the k-th; the scores of those in question are then resolved,
and the blocks' best are merged.  All sums are integers; queries that read the same slice share its vector operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm._common import cut, prepare

BLOCK_ROWS = 8192  # candidates of a block
QUERY_BYTES = 64 << 20  # queries that are broadcast at once; more are taken in turns
QUERY_ROWS = 128  # queries that share vector operations
START, GROWTH = 64, 4  # the first slice is one part in so many of a list, and depths grow so many times
LONG = 2**63


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x, the components floor(scale * x); vectors that are null or hold null or non-finite values are left out.

    So are vectors with a component that is no long.
    """
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= float(LONG)))
    return vectors.where(fine).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("x"))


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def clamped(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond a long are the nearest one."""
    return (np.clip(scores, -LONG, LONG - 1) if scores.dtype == object else scores).astype(np.int64)


def block_top(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, lists: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of the k best of a block for each query, and the list entries that each query read."""
    order, ordered = lists
    n, dims = x.shape
    most = dims * largest(x) * largest(q)  # no sum of products is larger, nor four times as large a difference of two
    kind = np.dtype(np.float64 if most < 2**50 else np.int64 if most < LONG // 4 else object)  # doubles hold these integers; Python's have no end
    x, q, ordered = x.astype(kind), q.astype(kind), ordered.astype(kind)
    out, open_, read = [], np.arange(len(q)), np.zeros(len(q), np.int64)
    seen = np.zeros((n, len(q)), kind)  # sums of what was read of each candidate
    before, depth = 0, min(n, max(k + 1, n // START))
    while len(open_):
        part = seen if len(open_) == len(q) else seen[:, open_]
        if depth == n:  # the rest of every list is read: all products
            part = x @ q[open_].T
            read[open_] += (n - before) * (q[open_] != 0).sum(1)
        high, low = np.zeros(part.shape, kind), np.zeros(part.shape, kind)  # of the lists in which a candidate was read: where they stand, their least values
        top, floor = np.zeros(len(open_), kind), np.zeros(len(open_), kind)  # the same of all lists
        for d in range(dims) if depth < n else ():
            for reads, new, old in ((q[open_, d] > 0, order[n - depth : n - before, d], order[n - before :, d]), (q[open_, d] < 0, order[before:depth, d], order[:before, d])):
                if not reads.any():
                    continue
                own = np.where(reads, q[open_, d], 0)
                part[new] += np.outer(x[new, d], own)
                read[open_[reads]] += len(new)
                stand, worst = (ordered[n - depth, d], ordered[0, d]) if own.max() > 0 else (ordered[depth - 1, d], ordered[-1, d])
                top += stand * own
                floor += worst * own
                for some in (new, old):
                    high[some] += stand * own
                    low[some] += worst * own
        if part is not seen and depth < n:
            seen[:, open_] = part
        low, high = part + floor - low, part + top - high
        low, high = clamped(low), clamped(high)  # from here on the scores as they are ranked
        alien = ids[:, None] != q_ids[open_][None, :]
        if depth < n:
            kth = np.partition(np.where(alien, low, -LONG), n - k, 0)[n - k]
            question = (high >= kth[None, :]) & alien
            done = question.sum(0) <= 4 * k
        else:
            question, done = alien, np.ones(len(open_), bool)
        at = np.flatnonzero(done)
        if depth < n:
            c, j = np.nonzero(question[:, at])
            score = clamped((x[c] * q[open_[at[j]]]).sum(1))  # resolve final scores
        elif n > k and len(at):  # everything is read: scores are known
            known = np.where(alien[:, at], low[:, at], -LONG)
            kth = np.partition(known, n - k, 0)[n - k]
            c, j = np.nonzero((known >= kth[None, :]) & alien[:, at])
            score = known[c, j]
        else:
            c, j = np.nonzero(question[:, at])
            score = low[c, at[j]]
        best = np.lexsort((ids[c], ~score, j))  # ~score falls as score rises, without leaving 64 bits
        c, j, score = c[best], j[best], score[best]
        keep = np.arange(len(j)) - np.searchsorted(j, j) < k
        out.append((open_[at[j[keep]]], c[keep], score[keep]))
        idle = depth >= n // START * GROWTH and depth < n and (question.sum(0) > n // 2).mean() > 0.5
        open_ = open_[~done]
        before, depth = depth, n if idle else min(n, depth * GROWTH)  # bounds that exclude little by then: the rest is read at once
    return *(np.concatenate([o[i] for o in out]) for i in range(3)), read


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the candidates in ascending order of the component, and the components so sorted."""
    order = np.argsort(x, 0, kind="stable")
    return order, np.take_along_axis(x, order, 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query by inner product, ties to smaller vec_id.

    vectors and queries: vec_id and x (array of long), as integer_vectors gives them.  A candidate with the query's own
    vec_id takes no part; with fewer than k candidates all are returned.  Scores are exact; one beyond a long counts, and is
    ranked, as the nearest long.  Vectors of different length meet in their common dimensions.  Rows with a null vec_id are
    never a query; as candidates they come last among ties.  Equal query rows are one query; different vectors under one
    vec_id are queries of their own, each with its k rows under that query_id.  Repeated candidate rows count one by one.
    Empty tables give no rows.  With ``report``, entries says how many list entries the query read in all blocks.
    """
    spark = vectors.sparkSession
    prepare(spark)
    queries = cut(queries.where("vec_id is not null").select("vec_id", "x").distinct())
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("x"))).collect()[0]
    kind = "asked long, query_id long, vec_id long, score long, entries long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long" + ", entries long" * report)
    turns = -(-n * 8 * max(1, dims) // query_bytes)
    found = None
    for turn in range(turns):
        some = queries if turns == 1 else queries.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(turns)) == turn)
        rows = some.collect()  # some query_bytes
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), matrix([r[1] for r in rows], dims)))

        def best(batches, sent=sent, first=turn << 40):
            q_ids, q = sent.value

            def block(held):
                ids = pa.chunked_array([h.column(0) for h in held])
                null = ids.is_null().to_numpy()
                raw = ids.fill_null(2**63 - 1).to_numpy().astype(np.int64)
                x = matrix([v for h in held for v in h.column(1).to_pylist()], dims)
                lists = sorted_lists(x)
                for at in range(0, len(q), QUERY_ROWS):
                    i, c, s, read = block_top(x, raw, q[at : at + QUERY_ROWS], q_ids[at : at + QUERY_ROWS], min(k, len(raw)), lists)
                    once = np.zeros(len(i), bool)
                    once[np.unique(i, return_index=True)[1]] = True
                    yield pa.RecordBatch.from_arrays([pa.array(first + at + i), pa.array(q_ids[at + i]), pa.array(raw[c], mask=null[c]), pa.array(s), pa.array(np.where(once, read[i], 0))], ["asked", "query_id", "vec_id", "score", "entries"])

            held, n = [], 0
            for b in batches:
                while len(b):
                    held.append(b.slice(0, block_rows - n))
                    n, b = n + len(held[-1]), b.slice(len(held[-1]))
                    if n == block_rows:
                        yield from block(held)
                        held, n = [], 0
            if n:
                yield from block(held)

        part = vectors.select("vec_id", "x").mapInArrow(best, kind)
        part = ranked(part, k, report)
        if turns > 1:  # one turn at a time, so that one broadcast is held
            part = cut(part)
            sent.destroy()
        found = part if found is None else found.unionAll(part)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *["entries"] * report)


def ranked(found: DataFrame, k: int, report: bool) -> DataFrame:
    """The k best rows of each query, with their rank; with ``report`` also the entries that were read for it."""
    own = Window.partitionBy("asked")
    found = found.withColumn("entries", F.sum("entries").over(own)) if report else found.drop("entries")
    return found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("rank") <= k)


def matrix(rows: list, dims: int) -> np.ndarray:
    """Rows of longs, cut or filled with zeros to dims."""
    if all(len(r) == dims for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : min(dims, len(r))] = r[:dims]
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
