"""Token counts by a map-side two-tier lookup.

First tier: a compact hash table of frequent pre-tokens and their lengths in tokens, fitted on a bounded sample of rows
and broadcast (at most ``table_size`` entries of at most ``table_bytes`` together, so its size does not follow the
data).  Second tier: each worker encodes what the table lacks once and keeps it in a bounded cache.  The table and
the caches only save work: every text is counted whole, whatever they hold, and no pre-token is ever shuffled
beyond the bounded sample.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import _bytes, _tokens
from tallybrook.llm._common import prepare

SAMPLE_ROWS = 2_000  # rows that the frequent table is fitted on
TABLE_SIZE = 50_000
TABLE_BYTES = 2 << 20


def frequent_parts(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE, table_bytes: int = TABLE_BYTES) -> list[bytes]:
    """The most frequent pre-tokens of a bounded sample of rows, most frequent first; ties by their bytes."""
    n = docs.count()
    if not n:
        return []
    some = docs.select(F.encode(F.lower(F.coalesce("text", F.lit(""))), "utf-8").cast("binary").alias("text"))
    some = some.sample(min(1.0, sample_rows / n), seed=11)

    def count(batches):
        for b in batches:
            seen: dict[bytes, int] = {}
            for x in b.column(0).to_pylist():
                for y in _tokens.parts(x):
                    if len(y) <= 64:
                        seen[y] = seen.get(y, 0) + 1
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = some.mapInArrow(count, "part binary, n long").groupBy("part").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "part").limit(table_size).collect()
    out, room = [], table_bytes
    for r in rows:
        room -= len(r[0])
        if room < 0:
            break
        out.append(bytes(r[0]))
    return out


def count_tokens(docs: DataFrame, vocabulary: str, frequent: list[bytes] | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    Null and empty texts count 0 tokens of 0 bytes; repeated rows stay repeated; a null doc_id is kept; texts of any
    length are counted whole; other columns are not read.
    """
    prepare(docs.sparkSession)
    if frequent is None:
        frequent = frequent_parts(docs)
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, _tokens.Encoder(vocabulary, None, ids=False).encoded(frequent), strict=True)))
    tag = uuid.uuid4().hex  # a worker's cache belongs to one table

    def lengths(batches):
        enc = _tokens.encoder(vocabulary, sent.value, ids=False, tag=tag)
        for b in batches:
            _, off = _bytes.utf8(b.column(1))
            n = [enc.of(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(off[1:] - off[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
