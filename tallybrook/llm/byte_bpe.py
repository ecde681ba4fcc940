"""Byte-level BPE by overlapping chunks, and its decoding.

Short texts are encoded where they are, without a shuffle.  Longer ones are cut into chunks that overlap, which go to the
tasks by hash:

1. every chunk is pre-tokenised from its own first character, right or wrong;
2. two neighbours are stitched at the first place of their overlap where both have a pre-token boundary: a pre-token
   depends only on the text from its start on, so from there both go on alike;
3. every chunk encodes its text from its own stitch to the next one; the pieces' ids are put together by text.

A boundary counts in a chunk's tail only if two more characters of the chunk follow, as the pattern looks that far ahead
at most.  Where an overlap holds no common boundary (one pre-token is longer than it), the rest of the text is one piece.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm import _bytes
from tallybrook.llm._common import cut, prepare

CHUNK, OVERLAP = 1 << 16, 1 << 12  # characters
SPACES = 100_000  # a run of white space from which the library's own pattern is not asked (it fails at a million)
_encodings: dict = {}


def encoding(path: str, pattern: str):
    """The library's encoding of a rank file, once a worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def boundaries(text: str, pattern: str, at: int = 0) -> list[int]:
    """Where the pre-tokens of a text end, as if it began at this place and ended here."""
    import regex

    return [m.end() for m in regex.finditer(pattern, text, pos=at)]


def encoded(text: str, path: str, pattern: str) -> list[int]:
    """The ids of a whole text."""
    if len(text) >= SPACES and any(x.isspace() for x in text[:: SPACES // 2]):
        return encoded_part(text, 0, len(text), path, pattern)
    return encoding(path, pattern).encode_ordinary(text)


def encoded_part(text: str, at: int, until: int, path: str, pattern: str) -> list[int]:
    """The ids of the pre-tokens between two boundaries of a text, each encoded by itself.

    The text behind is needed: how white space at the end is divided depends on what follows.
    """
    enc, known, ids = encoding(path, pattern), {}, []
    for end in boundaries(text, pattern, at):
        if end > until:
            break
        piece, at = text[at:end], end
        if (own := known.get(piece)) is None:
            own = known[piece] = enc._encode_single_piece(piece)
        ids += own
    return ids


def chunks_of(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks of a text; each but the last goes on into the next one by the overlap."""
    n = max(1, -(-max(0, len(text) - overlap) // chunk))
    return [text[k * chunk : (k + 1) * chunk + overlap if k < n - 1 else len(text)] for k in range(n)]


def edges(text: str, last: bool, chunk: int, overlap: int, pattern: str) -> tuple[list[int], list[int]]:
    """A chunk's boundaries in the overlaps with its predecessor and its successor, counted from where those begin."""
    ends = [0, *boundaries(text, pattern)]
    safe = len(text) if last else len(text) - 2
    return [e for e in ends if e < min(overlap, safe + 1)], [e - chunk for e in ends if chunk <= e <= safe]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, as binary) of every document.

    Null and empty texts have no ids; repeated rows and null doc_ids stay; equal long texts are encoded once; texts of any
    length are encoded whole; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    far = F.length("text") > chunk + overlap

    def whole(batches):
        for b in _bytes.smaller(batches, 1):
            ids = [packed(encoded(x, ranks, pattern)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    short = rows.where(~far).mapInArrow(whole, "doc_id long, ids binary")

    def split(batches):
        for b in _bytes.smaller(batches, 1):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = chunks_of(text, chunk, overlap)
                for at in range(0, len(own), 64):
                    some = own[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array(range(at, at + len(some)), pa.int32()), pa.array([at + i == len(own) - 1 for i in range(len(some))]), pa.array(some)], ["key", "k", "last", "part"])

    long = rows.where(far).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    parts = cut(long.select("key", "text").mapInArrow(split, "key string, k int, last boolean, part string").dropDuplicates(["key", "k"]))

    def look(batches):
        for b in _bytes.smaller(batches, 3):
            found = [edges(t, last, chunk, overlap, pattern) for last, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["key", "k", "head", "tail"])

    seen = cut(parts.mapInArrow(look, "key string, k int, head array<int>, tail array<int>"))
    before = seen.select("key", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    stitch = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before")))
    stitched = seen.join(before, ["key", "k"], "left").select("key", "k", stitch.alias("at"))
    order = Window.partitionBy("key").orderBy("k")  # numbers of one text's chunks
    broken = F.min(F.when(F.col("at").isNull(), F.col("k"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = stitched.withColumn("piece", F.coalesce(broken - 1, F.col("k")))
    ahead = placed.where("piece = k").select("key", (F.col("k") - 1).alias("k"), (F.col("at") + chunk).alias("until"))
    placed = placed.join(ahead, ["key", "k"], "left")
    pieces = parts.drop("last").join(placed, ["key", "k"]).groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("k", "at", "until", "part"))).alias("own"))  # one chunk, or the unstitched rest of a text

    def encode_pieces(batches):
        for b in batches:
            for key, piece, own in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                text = "".join(x["part"][:chunk] for x in own[:-1]) + own[-1]["part"]
                until = own[-1]["until"]
                ids = encoded_part(text, own[0]["at"], len(text) if until is None else (len(own) - 1) * chunk + until, ranks, pattern)
                yield pa.RecordBatch.from_pydict({"key": [key], "piece": pa.array([piece], pa.int32()), "ids": [packed(ids)]})
        _bytes.give_back()

    done = pieces.mapInArrow(encode_pieces, "key string, piece int, ids binary").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("own"))  # of one text

    def join(batches):
        for b in batches:
            for key, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"key": [key], "ids": [b"".join(x["ids"] for x in own)]})

    ids = done.mapInArrow(join, "key string, ids binary")
    return short.unionByName(long.select("doc_id", "key").join(ids, "key", "left").select("doc_id", "ids"))


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded: the bytes of all ids, one after another.  Null ids are none; an unknown id is an error."""
    prepare(tokens.sparkSession)

    def spell(batches):
        for b in _bytes.smaller(batches, 1):
            enc = encoding(ranks, pattern)
            out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(spell, "doc_id long, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of decoded documents."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
