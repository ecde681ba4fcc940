"""Alignment of two tokenizers over the same text: covering tokens, groups and links.

Tokens are byte ranges.  ``pandas.merge_asof``, keyed by document, finds for each token start the other side's covering
token; the union of both directions is all overlapping pairs, and places where both sides end cut the tokens into groups.

Texts are tokenised once and kept as ids, as a token's length follows from its id.  They are encoded by units, cut before
a space behind other than white space: the first tokenizer's pattern always ends a pre-token there, and no piece of the
second's vocabulary (this is checked) holds a space behind anything else.  Workers cache the ids of units.

Counts of linked id pairs are summed over the corpus by a shuffle.  The most frequent pairs, of a fixed number, are
broadcast to the links; if there are more, the links of the others are joined by pair and summed by text.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import _bytes, _tokens, byte_bpe
from tallybrook.llm._common import cut, prepare

BATCH = 1 << 22  # bytes of ids that are aligned at a time, or one text's
FREQUENT = 1 << 18  # pairs that are broadcast, 4 MB of keys and counts
MOST = 250_000  # units that a worker keeps
UNIT = re.compile(r"(?<=\S) (?= *[^ ])")
WHITE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]  # fixed values
WHITE_SPACE = [x + " " for x in WHITE]
COLUMNS = ["doc_id", "tk", "a", "b", "n_a", "n_b"]
_sides: dict = {}


class Sides:
    """Both tokenizers, and the bytes of each side's ids.

    With its pattern given, a first side whose merges stand in the order of their ids is asked by ranks, which gives the
    same ids several times faster: at a rank's turn all lower merges are done, so a pair that spells a token is its merge.
    """

    def __init__(self, a_path: str, b_path: str, pattern: str | None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {chr(c): b for b, c in [*((x, x) for x in _tokens._PLAIN), *_tokens.BYTES.items()]}
        self.a_bytes = [bytes(back[c] for c in x) if x and all(c in back for c in x) else (x or "").encode() for x in (self.a.id_to_token(i) for i in range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(pieces)]
        self.by_unit = not any("\u2581" in x.lstrip("\u2581") for x in pieces)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}
        self.ranked = pattern and self.by_ranks(json.loads(self.a.to_str()), pattern)

    def by_ranks(self, spec: dict, pattern: str):
        """The rank encoder of the first side's vocabulary; None if its form or the order of its merges is another."""
        vocabulary, plain = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in spec["model"]["merges"]]
        ordered = all(vocabulary.get(x) == 256 + k for k, x in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        if not ordered or spec["normalizer"] or plain.get("type") != "ByteLevel" or plain.get("add_prefix_space") or not plain.get("use_regex"):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={self.a_bytes[i]: i for i in vocabulary.values()}, special_tokens={})

    def units(self, text: str) -> list[str]:
        """A text's units, each without the space before it; white space at the ends stays with its neighbour."""
        if not self.by_unit:
            return [text]
        if text[0] == " " or text[-1] == " " or any(x in text for x in WHITE_SPACE):
            return UNIT.split(text)
        return text.split(" ")

    def first(self, units: list[str]) -> list[list[int]]:
        if self.ranked and max(map(len, units)) < byte_bpe.SPACES:
            return [self.ranked.encode_ordinary(" " + x) for x in units]
        return [e.ids for e in self.a.encode_batch_fast([" " + x for x in units], add_special_tokens=False)]

    def learn(self, units: list[str]) -> None:
        """Keep the ids of units; None if one side's bytes are other than the text's."""
        for at in range(0, len(units), 4096):
            some = units[at : at + 4096]
            for x, a, b in zip(some, self.first(some), self.b.encode(some, num_threads=1), strict=True):
                text = (" " + x).encode("utf-8")
                good = b"".join([self.b_bytes[i] for i in b]) == text and b"".join([self.a_bytes[i] for i in a]) == text
                self.cache[x] = (array("I", a).tobytes(), array("I", b).tobytes()) if good else None

    def of(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of a space and each text; none if there is no text or one side spells it otherwise."""
        own = [self.units(x) if x and "\u2581" not in x else [] for x in texts]
        known = self.cache
        self.learn(list(dict.fromkeys(x for y in own for x in y if x not in known)))
        out = []
        for units in own:
            got = list(map(known.get, units))
            out.append(tuple(map(b"".join, zip(*got, strict=True))) if got and None not in got else (b"", b""))
        if len(known) > MOST:
            self.cache = {x: y for x, y in islice(known.items(), MOST // 2) if len(x) <= 64}  # common units came early
        return out


def sides(*key) -> Sides:
    """This worker's tokenizers; their cache outlives the task."""
    if key not in _sides:
        _sides.clear()
        _sides[key] = Sides(*key)
    return _sides[key]


def tokens(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, tk (SHA-256 of the text), and a and b: both sides' ids (little-endian unsigned 32-bit, compressed), or null."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    pack = lambda x: pa.compress(x, codec="zstd", asbytes=True) if x else None

    def encode(batches):
        for b in _bytes.smaller(batches, 2):
            got = sides(a_path, b_path, pattern).of(b.column(2).to_pylist())
            sizes = [[len(x) // 4 for x in y] for y in zip(*got, strict=True)]
            columns = [pa.array([pack(x) for x in y], pa.binary()) for y in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, *(pa.array(x, pa.int64()) for x in sizes)], ["doc_id", "tk", "a", "b", "n_a", "n_b"])

    return rows.mapInArrow(encode, "doc_id long, tk string, a binary, b binary, n_a long, n_b long")


def ids_of(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """All ids of a column, one text after another."""
    return np.frombuffer(b"".join(pa.decompress(x.as_buffer(), 4 * n, codec="zstd", asbytes=True) for x, n in zip(column, sizes.tolist(), strict=True) if n), "<u4")


def starts(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where tokens of these sizes begin, each in its own document of n tokens."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ends[:-1] - np.repeat(ends[np.cumsum(n) - n], n)


class Aligned:
    """The tokens of a batch of documents against each other."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        docs = np.arange(len(n_a))
        self.a_doc, self.b_doc = np.repeat(docs, n_a), np.repeat(docs, n_b)
        a_at, b_at = starts(a_size[a], n_a), starts(b_size[b], n_b)
        left = pd.DataFrame({"at": self.a_doc << 40 | a_at, "i": np.arange(len(a))})
        right = pd.DataFrame({"at": self.b_doc << 40 | b_at, "j": np.arange(len(b))})
        over = pd.merge_asof(left, right[["at", "j"]].assign(start=b_at), on="at")  # the token of b that covers each start of a
        under = pd.merge_asof(right, left[["at", "i"]].assign(start=a_at), on="at")
        a_new, b_new = over["start"].to_numpy() == a_at, under["start"].to_numpy() == b_at  # both sides start here
        self.i = np.concatenate([left["i"].to_numpy(), under["i"].to_numpy()[~b_new]])  # equal starts are in the first direction
        self.j = np.concatenate([over["j"].to_numpy(), right["j"].to_numpy()[~b_new]])
        self.a_cut, self.b_cut = (np.append(x[1:], True) if len(x) else x for x in (a_new, b_new))  # an end is the next start

    def pairs(self) -> np.ndarray:
        """The linked ids as one number each."""
        return self.a[self.i].astype(np.int64) << 32 | self.b[self.j].astype(np.int64)

    def link_docs(self) -> np.ndarray:
        return self.a_doc[self.i]

    def groups(self, a_words: pa.Array, b_words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """How many groups each document has, and their spelling.

        The words are the decimal ids: first those with a comma behind, then those with a group's mark.
        """
        a_group = np.cumsum(self.a_cut) - self.a_cut
        b_group = np.cumsum(self.b_cut) - self.b_cut
        n = int(self.a_cut.sum())
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=n))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n))])
        word = np.empty(len(self.a) + len(self.b), np.int64)
        half_a, half_b = len(a_words) // 2, len(b_words) // 2
        word[np.arange(len(self.a)) + b_before[a_group]] = self.a + half_a * self.a_cut
        word[np.arange(len(self.b)) + a_before[b_group + 1]] = 2 * half_a + self.b + half_b * self.b_cut
        data, off = _bytes.utf8(pa.concat_arrays([a_words, b_words]).take(pa.array(word)))
        ends = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        whole = data.tobytes()
        places = off[ends].tolist()
        spelled = [whole[x : y - 1] if y > x else b"" for x, y in zip(places[:-1], places[1:], strict=True)]
        return np.bincount(self.a_doc[self.a_cut], minlength=len(self.n_a)), spelled


def aligned_batches(batches, columns: list[str], a_size: np.ndarray, b_size: np.ndarray):
    """(batch, Aligned) of token rows, so many that their ids take bounded memory; texts without tokens have none."""
    for b in batches:
        n_a, n_b = (b.column(columns.index(c)).to_numpy() for c in ("n_a", "n_b"))
        ends, at = np.cumsum(4 * (n_a + n_b)), 0
        while at < len(b):
            base = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + BATCH, "right")))
            part = b.slice(at, end - at)
            sizes = n_a[at:end], n_b[at:end]
            yield part, Aligned(*(ids_of(part.column(columns.index(c)), n) for c, n in zip("ab", sizes, strict=True)), *sizes, a_size, b_size)
            at = end
    _bytes.give_back()


def lengths(spark, a_path: str, b_path: str):
    """Bytes of each id of both sides, and the ids spelled in decimal; as large as the vocabularies, broadcast."""
    both = Sides(a_path, b_path, None)
    sizes = [np.array([len(x) for x in y], np.int64) for y in (both.a_bytes, both.b_bytes)]
    words = [[f"{i}{mark}".encode() for mark in marks for i in range(len(y))] for y, marks in ((both.a_bytes, ",|"), (both.b_bytes, ",;"))]
    return spark.sparkContext.broadcast((*sizes, *words))


def pair_counts(rows: DataFrame, sent) -> DataFrame:
    """pair (a's id times 2**32 and b's id), n: links that hold it linked, best: whether no pair of this b has more."""

    def count(batches):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, x in aligned_batches(batches, COLUMNS, *sent.value[:2]):
            pair, n = np.unique(x.pairs(), return_counts=True)
            pair, back = np.unique(np.concatenate([held[0], pair]), return_inverse=True)
            held = pair, np.bincount(back, np.concatenate([held[1], n])).astype(np.int64)
            if len(held[0]) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["pair", "n"])
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(held[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in held], ["pair", "n"])

    counts = cut(rows.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of b
    return cut(counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def rest_sums(rows: DataFrame, counts: DataFrame, known, sent) -> DataFrame:
    """tk, more_best, more_sum: what the links of pairs that are not broadcast add to each text."""

    def rest(batches):
        seen = set()
        for part, x in aligned_batches(batches, COLUMNS, *sent.value[:2]):
            tk = part.column(1).to_pylist()
            fresh = np.array([t not in seen and not seen.add(t) for t in tk], bool)  # of copies in a task one
            doc, pair = x.link_docs(), x.pairs()
            keep = fresh[doc] & ~found(known.value[0], pair)[1]
            order = np.lexsort((pair[keep], doc[keep]))
            doc, pair = doc[keep][order], pair[keep][order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))[: len(doc)])
            times = np.diff(np.append(first, len(doc)))
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(doc[first])), pa.array(pair[first]), pa.array(times)], ["tk", "pair", "times"])

    links = rows.mapInArrow(rest, "tk string, pair long, times long").groupBy("tk", "pair").agg(F.max("times").alias("times"))
    met = links.join(counts, "pair")
    return met.groupBy("tk").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))


def found(pairs: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair stands in a sorted list, and whether it does."""
    at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
    return at, pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups: "a1,a2|b1;a3|b2,b3" by ids, in order.

    n_best counts the links whose pair is its b's most frequent in the corpus, ties included; count_sum adds up the pairs'
    counts over the links.  Null and empty texts, and those that a side spells otherwise, have no tokens: zeros and ''.
    Repeated rows count each; null doc_ids stay; texts of any length are aligned whole; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = lengths(spark, a_path, b_path)
    rows = cut(tokens(docs, a_path, b_path, pattern))
    counts = pair_counts(rows, sent)
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((*(top.column(c).to_numpy() for c in ("pair", "n")), top.column("best").to_numpy(zero_copy_only=False)))
    if top.num_rows < frequent:
        rows = rows.withColumns({"more_best": F.lit(0).cast("long"), "more_sum": F.lit(0).cast("long")})
    else:
        rows = rows.join(rest_sums(rows, counts, known, sent), "tk", "left").select(*COLUMNS, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("more_best", "more_sum")))

    def measure(batches):
        a_size, b_size, a_words, b_words = sent.value
        words = pa.array(a_words, pa.binary()), pa.array(b_words, pa.binary())
        pairs, n, best = known.value
        for part, x in aligned_batches(batches, COLUMNS, a_size, b_size):
            size, doc, pair = len(part), x.link_docs(), x.pairs()
            at, hit = found(pairs, pair)
            edges = np.arange(size + 1)
            order = np.argsort(doc, kind="stable")
            place = np.searchsorted(doc[order], edges)
            total = lambda v: np.diff(np.append(0, np.cumsum(v[order]))[place])
            n_best = total(hit & best[at]) if len(pairs) else np.zeros(size, np.int64)
            count_sum = total(np.where(hit, n[at], 0)) if len(pairs) else np.zeros(size, np.int64)
            groups, spelled = x.groups(*words)
            numbers = [x.n_a, x.n_b, groups, np.diff(place), n_best + part.column(6).to_numpy(), count_sum + part.column(7).to_numpy()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v.astype(np.int64)) for v in numbers), pa.array(spelled, pa.binary()).cast(pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return rows.mapInArrow(measure, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def digest(aligned: DataFrame) -> DataFrame:
    """The aligned documents with groups_sha256, '' without tokens, instead of their groups."""
    told = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", told).drop("groups")
