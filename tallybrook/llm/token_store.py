"""Token-id shards with a minimal perfect hash index.

A store is a Parquet folder, so that Spark's writers commit it and any file system can hold it.  It is divided by ``part``,
a range of doc_ids, so that keyed access reads no more parts than hold wanted keys.  Each row is a shard:

- ``payload``: raw ids, little-endian unsigned 32-bit, of documents in ascending doc_id order;
- ``keys``: the doc_ids (signed 64-bit) and ``nulls``: how many leading ones are null, for scans;
- ``bits``, ``levels``, ``slots``: the index.  ``bits`` is a cascade of collision-free bit arrays whose sizes are
  ``levels``; a key's slot is the number of set bits before its own, which makes the hash minimal and perfect.  A slot
  holds a 32-bit fingerprint, the payload offset and the length of its document.

Finding a document takes one hash per level (1.6 on average), whatever the size of the shard.  Repeated doc_ids get
the ordinals 0, 1, ... among themselves, in the order of their texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm import _bytes, _tokens
from tallybrook.llm._common import cut, prepare

PREFIX = 32  # characters of a text that tell the rows of one doc_id apart when parts are cut
SHARD_BYTES = 8 << 20  # payload of a shard; a longer document has a shard of its own
SHARD = "part int, seq int, first_doc long, last_doc long, n_docs long, n_ids long, nulls long, keys binary, ordinals binary, levels binary, bits binary, slots binary, payload binary"
SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def hashed(doc_id: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    return _bytes.mix(doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ordinal.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def level_place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_bytes.mix(keys + np.uint64((level + 1) * 0xA0761D6478BD642F % 2**64)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over different 64-bit keys: level after level, keys that share a place go on."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        self.begin = np.concatenate([[0], np.cumsum(levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, bits, left = [], [], keys
        while len(left):
            size = max(8, 2 * len(left))
            place = level_place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            left = left[~alone[place]]
        return cls(np.array(levels, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 for keys that end nowhere; other strangers get the slot of some key."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.levels.tolist()):
            place = self.begin[level] + level_place(keys[open_], level, size)
            here = self.bits[place]
            out[open_[here]] = self.rank[place[here]]
            open_ = open_[~here]
        return out


def pack_shard(part: int, seq: int, docs: list, ordinals: list[int], texts: list[bytes]) -> dict:
    doc = np.array([0 if x is None else x for x in docs], np.int64)
    order, length = np.array(ordinals, np.int64), np.array([len(x) // 4 for x in texts], np.int64)
    nulls = sum(x is None for x in docs)
    keys = hashed(doc, order)
    keys[:nulls] = hashed(np.full(nulls, -1), order[:nulls] + (1 << 40))
    index = PerfectHash.build(keys)
    slots = np.zeros(len(docs), SLOT)
    at = index.slots(keys)
    slots["fingerprint"][at] = (keys >> np.uint64(32)).astype("<u4")
    slots["offset"][at] = np.concatenate([[0], np.cumsum(length)[:-1]])
    slots["length"][at] = length
    there = doc[nulls:]
    return {"part": part, "seq": seq, "first_doc": int(there[0]) if len(there) else None, "last_doc": int(there[-1]) if len(there) else None, "n_docs": len(docs), "n_ids": int(length.sum()), "nulls": nulls, "keys": doc.astype("<i8").tobytes(), "ordinals": order.astype("<i8").tobytes(), "levels": index.levels.astype("<i8").tobytes(), "bits": np.packbits(index.bits).tobytes(), "slots": slots.tobytes(), "payload": b"".join(texts)}


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *((x, pa.int64()) for x in ("first_doc", "last_doc", "n_docs", "n_ids", "nulls")), *((x, pa.binary()) for x in ("keys", "ordinals", "levels", "bits", "slots", "payload"))])


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append end_id, and write the shards in ascending order of doc_id (nulls first) and text.

    The parts are ranges of doc_id and a prefix of the text, so that a repeated or null doc_id of many rows is dealt out.
    """
    prepare(docs.sparkSession)

    def shards(batches):
        part, seq = TaskContext.get().partitionId(), 0
        enc, end = _tokens.encoder(vocabulary, None, ids=True), int(end_id).to_bytes(4, "little")
        own_docs, own_order, own_ids, held, last, ordinal = [], [], [], 0, object(), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                ordinal = ordinal + 1 if doc == last else 0
                last = doc
                ids = enc.of(text.as_buffer().to_pybytes()) + end
                if held and held + len(ids) > shard_bytes:
                    yield pa.RecordBatch.from_pylist([pack_shard(part, seq, own_docs, own_order, own_ids)], _ARROW)
                    own_docs, own_order, own_ids, held, seq = [], [], [], 0, seq + 1
                own_docs.append(doc), own_order.append(ordinal), own_ids.append(ids)
                held += len(ids)
        if own_docs:
            yield pa.RecordBatch.from_pylist([pack_shard(part, seq, own_docs, own_order, own_ids)], _ARROW)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = texts.repartitionByRange("doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(shards, SHARD).write.partitionBy("part").option("compression", "zstd").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows; an empty one has no parts."""
    return spark.read.schema(SHARD).parquet(path)


class Shard:
    """One shard that was read back."""

    def __init__(self, r: dict):
        self.ids, self.n, self.nulls = np.frombuffer(r["payload"], "<u4"), r["n_docs"], r["nulls"]
        levels = np.frombuffer(r["levels"], "<i8")
        self.index = PerfectHash(levels, np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(levels.sum())).astype(bool))
        self.slots = np.frombuffer(r["slots"], SLOT)
        self.keys, self.ordinals = np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["ordinals"], "<i8")

    def find(self, doc_id: np.ndarray, ordinal: np.ndarray, null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) by the index: a slot whose fingerprint differs holds another document."""
        keys = hashed(doc_id, ordinal)
        if null is not None:
            keys[null] = hashed(np.full(int(null.sum()), -1), ordinal[null] + (1 << 40))
        at = self.index.slots(keys)
        own = self.slots[np.maximum(at, 0)]
        found = (at >= 0) & (own["fingerprint"] == (keys >> np.uint64(32)).astype(np.uint32))
        return found, own["offset"].astype(np.int64), own["length"].astype(np.int64)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a store, in file order; each is found by its key.

    start counts the ids of all documents before it, in all shards.
    """
    prepare(spark)
    store = opened(spark, path)

    def scan(batches):
        for b in batches:
            for r in b.to_pylist():
                s = Shard(r)
                null = np.arange(s.n) < s.nulls
                found, offset, length = s.find(s.keys, s.ordinals, null)
                if not found.all():
                    raise ValueError("the index doesn't hold all keys of its shard")
                raw = memoryview(r["payload"])
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(s.n, r["part"], np.int32)), pa.array(np.full(s.n, r["seq"], np.int32)), pa.array(s.keys, mask=null), pa.array(offset), pa.array(length), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = store.select(*(x.split()[0] for x in SHARD.split(", "))).mapInArrow(scan, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    total, ahead = 0, []
    for part, n in sorted(store.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row for each of the writer's tasks
        ahead.append((part, total))
        total += n
    parts = spark.createDataFrame(ahead, "part int, ahead long")
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    before = store.select("part", "seq", "n_ids").withColumn("own", own).join(parts, "part").select("part", "seq", (F.col("own") + F.col("ahead")).alias("before"))
    return rows.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian bytes) of the wanted doc_ids that the store holds, by keyed access.

    Keys are routed to the parts, and then the shards, whose doc_id range holds them; only those parts are read, and of
    their payloads only the wanted documents' ids are returned.  Null keys find nothing; repeated documents give a row for
    each of them.
    """
    spark = keys.sparkSession
    prepare(spark)
    store = opened(spark, path)
    bounds = store.select("part", "seq", "first_doc", "last_doc").where("first_doc is not null")
    ranges = sorted(bounds.groupBy("part").agg(F.min("first_doc"), F.max("last_doc")).collect())  # a row for each of the writer's tasks
    sent = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in ranges], np.int64) for i in range(3)))

    def route(batches):
        part, first, last = sent.value
        for b in batches:
            doc = b.column(0).to_numpy()
            lo, hi = np.searchsorted(last, doc), np.searchsorted(first, doc, "right")  # parts are in order, and meet in a repeated doc_id at most
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(np.repeat(doc, n))], ["part", "doc_id"])

    wanted = cut(keys.select("doc_id").where("doc_id is not null").distinct().mapInArrow(route, "part int, doc_id long"))
    some = [r[0] for r in wanted.select("part").distinct().collect()]
    own = bounds.where(F.col("part").isin(some)).join(wanted, "part").where("doc_id between first_doc and last_doc")
    routed = own.groupBy("part", "seq").agg(F.collect_list("doc_id").alias("wanted"))  # keys of one shard

    def fetch(batches):
        for b in batches:
            for r in b.to_pylist():
                s, ordinal, left = Shard(r), 0, np.array(r["wanted"], np.int64)
                docs, out = [], []
                starts = {int(d): int(o) for d, o in zip(s.keys[s.nulls :][::-1], s.ordinals[s.nulls :][::-1], strict=True)} if s.n and s.ordinals.any() else {}
                first = np.array([starts.get(int(d), 0) for d in left], np.int64)
                while len(left):
                    found, offset, length = s.find(left, first + ordinal)
                    for d, a, n in zip(left[found].tolist(), offset[found].tolist(), length[found].tolist(), strict=True):
                        docs.append(d), out.append(s.ids[a : a + n].tobytes())
                    left, first, ordinal = left[found], first[found], ordinal + 1
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return store.where(F.col("part").isin(some)).join(routed, ["part", "seq"]).mapInArrow(fetch, "doc_id long, ids binary")
