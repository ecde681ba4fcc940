"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

The capacity is small, so pieces and open bins fall into at most ``capacity`` sizes.  Best-fit decreasing is run
over the histogram of piece lengths: a segment tree over remaining capacities finds the tightest open bins in
logarithmic time, and all equal pieces that fit there are placed in one step.  The steps, a table of ranges of
(length, rank) to ranges of bins, give every piece its sequence through its rank among the pieces of its length, so
the packing equals document-at-a-time best-fit decreasing over the whole corpus, while no task sees more than its own
pieces.  The plan's size follows the number of different lengths, not the corpus: a step either ends a length, which adds
two queue entries at most, or fills a whole entry, which lowers its room by the length; as lengths only fall, an entry of
4096 is filled by fewer than 91 different ones.  So there are at most two rows for each of (1 + 3 x 91) x 4096 steps.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm import _bytes, _tokens
from tallybrook.llm._common import cut, prepare

CAPACITY = 4096
RANKED = 1_000  # pieces of one length that are ranked in a task
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Queues of equal open bins by remaining capacity, under a segment tree that holds which are not empty."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)
        self.bins: list[deque] = [deque() for _ in range(capacity + 1)]

    def mark(self, room: int) -> None:
        at = room + self.size
        self.some[at] = bool(self.bins[room])
        while at > 1:
            at >>= 1
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of any open bin that holds length, or None."""
        at = length + self.size
        if self.some[at]:
            return length
        while at > 1:
            if not at & 1 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, sequences, offset): from that rank on, pieces go round so many sequences, each
    round behind the last one."""
    open_bins, made, steps = OpenBins(capacity), 0, array("q")
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:  # as many new bins as these pieces fill
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                first, n = open_bins.bins[room].popleft()
                open_bins.mark(room)
            # a bin that still holds such a piece is the tightest one, so each is filled before the next
            per = room // length
            full, rest = min(n, left // per), 0
            if full < n:
                rest = left - full * per  # fewer than per
            if full:
                steps.extend((length, rank, first, full, capacity - room))
            if rest:
                steps.extend((length, rank + full * per, first + full, 1, capacity - room))
            used = full + bool(rest)
            for kept, at, count in ((room - per * length, first, full), (room - rest * length, first + full, bool(rest)), (room, first + used, n - used)):
                if kept and count:
                    (open_bins.bins[kept].appendleft if kept == room else open_bins.bins[kept].append)((at, int(count)))
                    open_bins.mark(kept)
            rank, left = rank + full * per + rest, left - full * per - rest
    return np.frombuffer(steps, np.int64).reshape(-1, 5) if steps else np.zeros((0, 5), np.int64)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document: only documents longer than a sequence are cut."""
    prepare(docs.sparkSession)

    def cut_up(batches):
        _bytes.give_back()  # what tasks of other stages left in this worker
        enc, end = _tokens.encoder(vocabulary, None, ids=True), int(end_id).to_bytes(4, "little")
        for b in batches:
            own: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                ids = enc.of(text.as_buffer().to_pybytes()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(own, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        _bytes.give_back()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut_up, PIECES)


def place(rows: DataFrame, capacity: int = CAPACITY, most: int = RANKED) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity.

    Ranks among equal lengths are counted in buckets, as many as the length's rows need, so that a length of a third of all
    pieces is spread.
    """
    spark = rows.sparkSession
    held = cut(rows)
    histogram = dict(held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())  # at most capacity rows
    if not histogram:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    parts = spark.createDataFrame([(length, -(-n // most)) for length, n in histogram.items()], "length long, parts int")
    salted = held.join(F.broadcast(parts), "length").withColumn("bucket_", F.pmod(F.xxhash64(*rows.columns), "parts").cast("int")).drop("parts")
    sizes = salted.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.withColumn("ahead_", F.sum("n").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("n")).drop("n")
    ranked = salted.withColumn("rank_", F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(ahead, ["length", "bucket_"]).select(*rows.columns, (F.col("rank_") + F.col("ahead_")).alias("rank_"))
    sent = spark.sparkContext.broadcast(plan(histogram, capacity))

    def assign(batches):
        _tokens.forget()  # all is encoded by now
        _bytes.give_back()
        shift, table = 1 << 44, sent.value
        keys = table[:, 0] * -shift + table[:, 1] + capacity * shift  # in the plan's order
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank_").to_numpy()
            step = table[np.searchsorted(keys, (capacity - length) * shift + rank, "right") - 1]
            turn, at = np.divmod(rank - step[:, 1], step[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(step[:, 2] + at), pa.array(step[:, 4] + turn * length)], [*b.schema.names[:-1], "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(assign, f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is one piece that holds the end id alone.  Rows with a null or repeated doc_id are packed like
    any other.  An empty table gives an empty packing.  Other columns are not read.
    """
    return place(pieces(docs, vocabulary, end_id, capacity), capacity)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids as little-endian bytes, for documents of distinct doc_id."""

    def ids_of(batches):
        enc, end = _tokens.encoder(vocabulary, None, ids=True), int(end_id).to_bytes(4, "little")
        for b in batches:
            docs_, starts, out = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.of(text.encode()) + end
                for at in range(0, len(ids), 4 * capacity):
                    docs_.append(doc), starts.append(at // 4), out.append(ids[at : at + 4 * capacity])
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "start", "ids"])

    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(ids_of, "doc_id long, start long, ids binary")
    joined = packed.select("doc_id", "start", "sequence_id", "offset").join(ids, ["doc_id", "start"])
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most capacity parts
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
