"""Connected components of an edge table: stars within tasks first, then large-star and small-star rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm._common import delete_path, fresh_path, written


SALTS = 32  # parts into which the rows of one key may be dealt
HELD_EDGES = 1 << 20  # edges that a task solves at a time (16 MB); a table of no more is solved in one task


def attached(rows: DataFrame, key: str, by: str, sums: dict[str, F.Column]) -> DataFrame:
    """rows with aggregates over all rows of the same key (not null) as further columns.

    The rows of a key are dealt out by a hash of the column ``by``, and the key's aggregates go to each part that has rows,
    so that a key of a third of all rows is no task of its own.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    salted = rows.withColumn("salt_", salt)
    least = salted.groupBy(key).agg(*(c.alias(k) for k, c in sums.items()), F.expr("bit_or(shiftleft(1L, salt_))").alias("salts_"))
    held = least.withColumn("salt_", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts_", i) == 1))).drop("salts_")
    return salted.join(held.hint("merge"), [key, "salt_"]).drop("salt_")  # many small broadcasts would fill the driver


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: those above it; small: those below it) to its least neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = attached(both, "u", "v", {"m": F.least(F.min("v"), F.first("u"))})
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(met.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges in ascending order, and the least node that each is connected with by these edges.

    Roots hook to the least root next to them; a component takes part in a merge at least every other round.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, root = root, root.copy()
        least = np.minimum(before[a], before[b])
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _stars(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """The edges of each task as stars, of ``most`` edges at a time; roots: each root with itself as well."""

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
        node, least = least_nodes(u, v)
        kept = slice(None) if roots else node != least
        return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(least[kept])], ["u", "v"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if held and n + b.num_rows > most:
                yield solved(held)
                held, n = [], 0
            held.append(b)
            n += b.num_rows
        if n:
            yield solved(held)

    return edges.mapInArrow(told, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of an edge table (u, v: longs); loops, nulls and repeats don't matter.

    Tasks turn the edges they read into stars, so a written table has few repeats and short paths.  As soon as it has
    HELD_EDGES rows or fewer, one task solves it; before that, star rounds shorten the paths between the tasks.  Each star
    is written as a table, of which nothing but its files is known to the next plan, and its predecessor deleted.
    """
    spark, made, before, most = edges.sparkSession, [], None, HELD_EDGES

    def step(df: DataFrame) -> DataFrame:
        made.append(fresh_path(spark, "edges"))
        out = written(df, made[-1])
        for old in made[:-1]:
            delete_path(spark, old)
        del made[:-1]
        return out

    edges = step(_stars(edges.where("u <> v").select("u", "v"), most))
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state[0] <= most:
            return step(_stars(edges.coalesce(1), most, roots=True).select(F.col("u").alias("node"), F.col("v").alias("component")))
        if state == before:
            break
        before = state
        edges = step(_star(step(_star(edges, True)), False))
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return step(roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
