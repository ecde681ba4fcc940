"""Benchmark decontamination by a distributed positional inverted index.

Test words and words of the training texts are told by fingerprints and then compared by their bytes.  The training texts are dealt into blocks.  For each block the index holds, for every word that occurs in the test
items, the sorted positions (postings) of that word in the block's word stream; it is written to the shared folder.
Occurrences of the test words over all blocks give their rarity.  A test window is then looked up in a block by
intersecting the offset-adjusted lists of its words from the rarest on, which leaves its exact occurrences; proximity
matches need every word of a window within a given span of an occurrence of its rarest word.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import _bytes
from tallybrook.llm._common import aside, cut, fresh_path, prepare, restored, written

WINDOW = 10
BLOCK_BYTES = 8 << 20  # of text that one block of the index covers
TEST_BYTES = 16 << 20  # test texts up to this size are broadcast; beyond it they are searched for in slices
PIECE_WORDS = 50_000  # longer items are taken in pieces that overlap by a window less one word
BROADCAST_ROWS = 200_000  # contaminated texts up to which their digests are broadcast (some 20 MB)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class Terms:
    """The different words of the test items, sorted by their fingerprints."""

    def __init__(self, texts: list[str]):
        data, offsets = _bytes.utf8(pa.array(texts, pa.large_string()))
        hashes, start, size, self.places = _bytes.word_spans(data, offsets)
        low = _bytes.LOWER[data]
        number = _bytes.word_numbers(low, hashes, start, size)
        one = np.unique(number, return_index=True)[1]
        order = np.argsort(hashes[one], kind="stable")
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        self.of_text = rank[number] if len(one) else number
        one = one[order]
        self.hashes, self.sizes = hashes[one], size[one]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        self.low = np.concatenate([low[a : a + n] for a, n in zip(start[one].tolist(), self.sizes.tolist(), strict=True)] or [np.zeros(0, np.uint8)])

    def __len__(self) -> int:
        return len(self.hashes)

    def sent(self) -> tuple:
        return self.hashes, self.starts, self.sizes, self.low


def occurrences(terms: tuple, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, place) of all words of a batch that are terms, sorted by both."""
    known, starts, sizes, text = terms
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    place = np.flatnonzero(known[at] == hashes)
    at, low, numbers, places = at[place], _bytes.LOWER[data], [at[:0]], [place[:0]]
    while len(place):  # more than once only if several terms share a fingerprint
        same = size[place] == sizes[at]
        check = np.flatnonzero(same & (size[place] > 8))
        same[check] = _bytes.same_words(low, start[place[check]], text, starts[at[check]], sizes[at[check]])
        numbers.append(at[same])
        places.append(place[same])
        place, at = place[~same], at[~same] + 1
        more = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes[place])
        place, at = place[more], at[more]
    number, place = np.concatenate(numbers), np.concatenate(places)
    order = np.lexsort((place, number))
    return number[order], place[order]


class Windows:
    """Every different window of the items as a row of word numbers (-1 behind the words of a short item), with the items that hold it."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        texts = [" ".join(WORD.findall((t or "").translate(_LOWER))) for _, t in items]
        self.terms = Terms(texts)
        self.items = sorted({i for i, _ in items}, key=lambda i: "null" if i is None else str(i))
        item_number = {i: k for k, i in enumerate(self.items)}
        own, first = self.terms.of_text, self.terms.places
        count = np.diff(first)
        count = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        text = np.repeat(np.arange(len(texts)), count)
        start = first[:-1][text] + np.arange(len(text)) - (np.cumsum(count) - count)[text]
        padded = np.concatenate([own, np.full(window, -1)])
        rows = np.stack([np.where(start + k < first[1:][text], padded[start + k], -1) for k in range(window)], 1).astype(np.int32) if len(text) else np.zeros((0, window), np.int32)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.array([item_number[items[k][0]] for k in text.tolist()], np.int64)], 1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))

    def by_rarity(self, often: np.ndarray) -> dict:
        """What is broadcast: the windows whose words all occur, sorted by their rarest word, with the order of their words."""
        held = np.where(self.rows >= 0, often[np.maximum(self.rows, 0)] if len(often) else 0, np.iinfo(np.int64).max)
        keep = np.flatnonzero((held > 0).all(1))
        order = np.argsort(held[keep], 1, kind="stable").astype(np.int8)
        rarest = self.rows[keep, order[:, 0]] if len(keep) else np.zeros(0, np.int32)
        at = np.argsort(rarest, kind="stable")
        return {"rows": self.rows[keep][at], "order": order[at], "rarest": rarest[at], "number": keep[at], "item": self.item, "item_from": self.item_from, "items": ["null" if i is None else str(i) for i in self.items]}


def build_index(docs: DataFrame, terms: Terms, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the postings of the given words over all texts; a row for each block of documents."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms.sent())

    def index(batches):
        for b in batches:
            column = b.column(1).cast(pa.large_string())
            _, all_off = _bytes.utf8(column)
            at = 0
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(all_off, all_off[at] + block_bytes, "right")) - 1)
                data, off = _bytes.utf8(column.slice(at, end - at))
                *words, first = _bytes.word_spans(data, off)
                number, place = occurrences(sent.value, data, *words)
                held, counts = np.unique(number, return_counts=True)
                ids = pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), pa.concat_arrays([b.column(0).slice(at, end - at)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([first.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (held.astype("<i4").tobytes(), counts.astype("<i8").tobytes(), place.astype("<i4").tobytes()))], ["doc_id", "first", "terms", "lengths", "postings"])
                at = end
        _bytes.give_back()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(index, f"doc_id array<{kind}>, first array<long>, terms binary, lengths binary, postings binary")
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def rarity(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each test word over all blocks."""

    def counts(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(t, "<i4")] += np.frombuffer(n, "<i8")
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    rows = index.select("terms", "lengths").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each test word
    out = np.zeros(n_terms, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


class Postings:
    """One block of the index."""

    def __init__(self, terms: bytes, lengths: bytes, postings: bytes):
        self.ends = np.cumsum(np.frombuffer(lengths, "<i8"))
        self.at = {t: i for i, t in enumerate(np.frombuffer(terms, "<i4").tolist())}
        self.all = np.frombuffer(postings, "<i4").astype(np.int64)

    def of(self, term: int) -> np.ndarray | None:
        i = self.at.get(term)
        return None if i is None else self.all[(self.ends[i - 1] if i else 0) : self.ends[i]]


def member(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def phrase(block: Postings, window: tuple[int, ...], order: list[int], first: np.ndarray) -> np.ndarray:
    """First positions of a window's occurrences, within one document each; order: its offsets, rarest word first."""
    starts = block.of(window[order[0]])
    if starts is None:
        return np.zeros(0, np.int64)
    starts = starts - order[0]
    for k in order[1:]:
        other = block.of(window[k])
        if other is None or not len(starts):
            return np.zeros(0, np.int64)
        starts = starts[member(starts + k, other)]
    starts = starts[starts >= 0]
    doc = np.searchsorted(first, starts, "right") - 1
    return starts[starts + len(window) <= first[doc + 1]]


def near(block: Postings, window: tuple[int, ...], order: list[int], first: np.ndarray, span: int) -> np.ndarray:
    """Positions of the rarest word around which every other word of the window occurs within span words, in one document."""
    at = block.of(window[order[0]])
    if at is None:
        return np.zeros(0, np.int64)
    doc = np.searchsorted(first, at, "right") - 1
    low, high = np.maximum(at - span, first[doc]), np.minimum(at + span, first[doc + 1] - 1)
    keep = np.ones(len(at), bool)
    for term in {window[k] for k in order[1:]} - {window[order[0]]}:
        other = block.of(term)
        if other is None:
            return np.zeros(0, np.int64)
        keep &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
    return at[keep]


def pieces_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id and text of the different items; of long ones, pieces that hold the same windows."""

    def split(batches):
        step = PIECE_WORDS - window + 1
        for b in batches:
            ids, texts = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                words = WORD.findall(text) if text and len(text) > PIECE_WORDS else ()
                own = [" ".join(words[at : at + PIECE_WORDS]) for at in range(0, len(words) - window + 1, step)] if len(words) > PIECE_WORDS else [text]
                ids += [k] * len(own)
                texts += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.string())], ["item_id", "text"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(split, f"item_id {kind}, text string").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, proximity: int | None = None, test_bytes: int = TEST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items of every document.

    hits: the [first, last] word ranges inside occurrences of test windows, merged.  With ``proximity`` set, a window
    also matches where all its words lie within so many words of an occurrence of its rarest word; the matched word is
    then what counts as hit.  Null and empty texts hold no words; an item of fewer words than a window is one window, an
    item of none never matches; items with a null id mark their words, and are listed as 'null'.  Repeated documents
    give repeated rows, and repeated items count once.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    bench = cut(pieces_of(benchmark, window))
    total = bench.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    slices = -(-total // test_bytes) or 1
    return in_slices(docs, bench, window, proximity, slices) if slices > 1 else searched(docs, bench, window, proximity)


def searched(docs: DataFrame, bench: DataFrame, window: int, proximity: int | None) -> DataFrame:
    """decontaminate() for test items that may be broadcast."""
    spark = docs.sparkSession
    windows = Windows([(r["item_id"], r["text"]) for r in bench.collect()], window)
    index = build_index(docs, windows.terms, fresh_path(spark, "postings"))
    sent = spark.sparkContext.broadcast(windows.by_rarity(rarity(index, len(windows.terms))))

    def search(batches):
        empty, q = hashlib.sha256(b"").hexdigest(), sent.value
        for b in batches:
            for k, (first, t, n, p) in enumerate(zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                block, first = Postings(t, n, p), np.array(first, np.int64)
                hit = np.zeros(int(first[-1]) + 1, np.int64)
                items_of: dict[int, set] = {}
                held = np.frombuffer(t, "<i4")
                lo, hi = np.searchsorted(q["rarest"], held), np.searchsorted(q["rarest"], held, "right")
                for i in np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True) if y > x] or [np.zeros(0, np.int64)]).tolist():
                    w = [x for x in q["rows"][i].tolist() if x >= 0]
                    order = q["order"][i, : len(w)].tolist()
                    at = phrase(block, w, order, first)
                    if len(at):
                        np.add.at(hit, at, 1)
                        np.add.at(hit, at + len(w), -1)
                    if proximity is not None:
                        close = near(block, w, order, first, proximity)
                        np.add.at(hit, close, 1)
                        np.add.at(hit, close + 1, -1)
                        at = np.concatenate([at, close])
                    if len(at):
                        own = [q["items"][x] for x in q["item"][q["item_from"][q["number"][i]] : q["item_from"][q["number"][i] + 1]].tolist()]
                        for d in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                            items_of.setdefault(d, set()).update(own)
                inside = np.cumsum(hit)[:-1] > 0
                done = np.concatenate([[0], np.cumsum(inside)])
                n_hit, n_docs = done[first[1:]] - done[first[:-1]], len(first) - 1
                sha, ranges = [empty] * n_docs, [[] for _ in range(n_docs)]
                for d, own in items_of.items():
                    sha[d] = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside[first[d] : first[d + 1]].astype(np.int8), [0]])))
                    ranges[d] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(k, 1).flatten(), pa.array(first[1:] - first[:-1]), pa.array(n_hit),
                    pa.array([len(items_of.get(d, ())) for d in range(n_docs)], pa.int64()), pa.array(sha), pa.array(n_hit > 0),
                    pa.array(ranges, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([sorted(items_of.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
                ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(search, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<first: long, last: long>>, items array<string>")


def in_slices(docs: DataFrame, bench: DataFrame, window: int, proximity: int | None, slices: int) -> DataFrame:
    """The same for test sets beyond what may be broadcast: slice by slice, over documents numbered in a table of their own."""
    keyed = written(docs.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id()), fresh_path(docs.sparkSession, "numbered"))
    ids = keyed.select(F.col("key").alias("doc_id"), "text")
    found = None
    for k in range(slices):
        part = searched(ids, bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k), window, proximity)
        found = part if found is None else found.unionByName(part)
    spans = found.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    n_hit = F.aggregate("h", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(x["first"] - 1, a["end"]))).alias("n"), F.greatest(a["end"], x["last"]).alias("end")))["n"]
    done = spans.select(F.col("doc_id").alias("key"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.col("h").alias("hits"), "items")
    return keyed.select("doc_id", "key").join(done, "key").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "hits", "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of any item; null and empty texts hold none.

    Contaminated texts are told by their SHA-256 digest, so no doc_id is read; all columns are kept, whatever their names.
    """
    prepare(docs.sparkSession)
    some, back = aside(docs, "text")
    digest = F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256))
    found = decontaminate(some.select(digest.alias("doc_id"), "text"), benchmark)
    bad = cut(found.where("contaminated").select("doc_id").distinct())
    near = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return restored(some.withColumn("doc_id", digest).join(near, "doc_id", "left_anti"), back)
