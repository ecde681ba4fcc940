"""N-gram Jaccard similarity join with Bayesian candidate pruning.

Texts of equal words, told by a 128-bit digest, are one class.  MinHash bands of a class's word n-grams link classes that
may be similar; the candidate groups so found are dealt out in blocks of signatures.  Within a pair of blocks, MinHash
values are compared a few at a time, and a pair is dropped as soon as the posterior probability that its similarity reaches
the threshold falls below a tolerance (uniform prior, binomial likelihood).  Only texts with a pair left are moved: they
are dealt out in the smaller groups that are left, in blocks of bounded bytes, and verified on the n-grams themselves, told
by the bytes of their words.  A block pair gives each class's number of links and a spanning forest of them, never its
list of pairs, so large groups of near copies cost no quadratic output.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import _bytes
from tallybrook.llm._common import aside, delete_path, fresh_path, prepare, restored, written
from tallybrook.llm.components import attached, components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at the threshold is missed with a probability of 3e-6, at 0.85 with 1e-8
STEP = 16  # MinHash values that are compared at a time
TOLERANCE = 1e-9
BLOCK = 1024  # classes of a block
BLOCK_BYTES = 4 << 20  # of text in a block that is verified; a longer text is a block of its own
BROADCAST_ROWS = 200_000  # wanted texts up to which their digests are broadcast (some 30 MB)
_SEED = np.random.default_rng(77)
_A = _SEED.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _SEED.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_GRAM = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(16)], np.uint64)


def grams(hashes: np.ndarray, first: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams of each text and where they begin; fewer words than n are one n-gram, none none."""
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    places = np.concatenate([[0], np.cumsum(count)])
    if not len(hashes):
        return np.zeros(0, np.uint64), places
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    every = sum((padded[i : i + len(hashes)] * _GRAM[i] for i in range(n)), np.zeros(len(hashes), np.uint64))
    start = np.arange(places[-1]) + np.repeat(first[:-1] - places[:-1], count)
    out = every[start]
    for d in np.flatnonzero((words > 0) & (words < n)):
        own = hashes[first[d] : first[d + 1]]
        out[places[d]] = (own * _GRAM[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return _bytes.mix(out), places


def signatures(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each text; the texts must have n-grams."""
    out = np.empty((len(places) - 1, len(_A)), np.uint32)
    at = 0
    while at < len(places) - 1:
        end = max(at + 1, int(np.searchsorted(places, places[at] + (1 << 15), "right")) - 1)
        part, cuts = h[places[at] : places[end]], places[at:end] - places[at]
        for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
            out[at:end, i] = np.minimum.reduceat(((part * a + b) >> np.uint64(32)).astype(np.uint32), cuts)
        at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band."""
    own = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return _bytes.mix((own * _GRAM[1 : ROWS + 1]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest matches at which a pair stays.

    With m of n values equal the posterior of the similarity s is Beta(m + 1, n - m + 1), so
    P(s >= threshold) = P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, len(_A) + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def pruned(sig_a: np.ndarray, sig_b: np.ndarray, same: bool, threshold: float, likely: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks whose similarity may reach the threshold; same: i < j within one block; likely: the pairs to look at."""
    i, j = likely or (np.triu_indices(len(sig_a), 1) if same else (x.ravel() for x in np.indices((len(sig_a), len(sig_b)))))
    matched = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        if not len(i):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        for at in range(0, len(i), 1 << 16):
            some = slice(at, at + (1 << 16))
            matched[some] += (sig_a[i[some], part] == sig_b[j[some], part]).sum(1)
        keep = matched >= least
        i, j, matched = i[keep], j[keep], matched[keep]
    return i, j


def exact_sets(low: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, n: int = N) -> list[np.ndarray]:
    """For each text the sorted numbers of its different n-grams; a number is the same for the same words only.

    Texts of fewer than n words have no n-gram in common with texts of other words and are left empty.
    """
    number = own = _bytes.word_numbers(low, hashes, start, size)
    for k in range(1, n):  # an n-gram's number from that of its first words and its last word
        if len(number) < 2:
            break
        number = np.unique(number[:-1].astype(np.uint64) << np.uint64(32) | own[k:].astype(np.uint64), return_inverse=True)[1]
    return [np.unique(number[a : max(a, b - n + 1)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def intersections(sets_a: list, sets_b: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets (sorted arrays)."""
    if len(i) < 200:
        return np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows_a, rows_b = np.unique(i), np.unique(j)
    grams_a = np.concatenate([sets_a[x] for x in rows_a])
    grams_b = np.concatenate([sets_b[x] for x in rows_b])
    shared = np.intersect1d(grams_a, grams_b)
    total = np.zeros((len(rows_a), len(rows_b)), np.float32)
    own = []
    for rows, sets, flat in ((rows_a, sets_a, grams_a), (rows_b, sets_b, grams_b)):
        row = np.repeat(np.arange(len(rows)), [len(sets[x]) for x in rows])
        col = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[col] == flat if len(shared) else np.zeros(len(flat), bool)
        row, col = row[hit], col[hit]
        order = np.argsort(col, kind="stable")
        own.append((row[order], col[order]))
    for at in range(0, len(shared), 4096):  # products of 0/1 matrices, some n-grams at a time
        parts = []
        for (row, col), n in zip(own, total.shape, strict=True):
            lo, hi = np.searchsorted(col, [at, at + 4096])
            m = np.zeros((n, min(4096, len(shared) - at)), np.float32)
            m[row[lo:hi], col[lo:hi] - at] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return np.rint(total[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)]).astype(np.int64)


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given links."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def fingerprints(docs: DataFrame, *kept: str, text: str = "text", sketch: bool = True) -> DataFrame:
    """The kept columns, w (the digest of the words of the column ``text``; null without words) and, if wanted, the signature (binary)."""
    columns = [*kept, *[text] * (text not in kept)]  # the text goes to the workers once
    at = columns.index(text)

    def told(batches):
        for b in _bytes.smaller(batches, at):
            data, off = _bytes.utf8(b.column(at).cast(pa.large_string()))
            more = []
            if sketch:
                hashes, first = _bytes.words(data, off)
                h, places = grams(hashes, first)
                sig, some = np.zeros((len(b), len(_A)), "<u4"), np.flatnonzero(np.diff(first))
                if len(some):
                    sig[some] = signatures(h, np.concatenate([places[some], places[-1:]]))
                more = [binary(sig)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(_bytes.word_digests(data, off), pa.binary()), *more], [*kept, "w", *["sig"] * sketch])

    some = docs.select(*columns)
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[: len(kept)]), "w binary", *["sig binary"] * sketch]
    return some.mapInArrow(told, ", ".join(fields))


def matrix_of(column) -> np.ndarray:
    """Signatures of an Arrow column."""
    return _bytes.utf8(column)[0].view("<u4").reshape(-1, len(_A))


GROUP = "u long, v long, links long"


def bands_of(classes: DataFrame) -> DataFrame:
    """node and bands, the band keys of each class."""

    def keys(batches):
        for b in batches:
            found = band_keys(matrix_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), BANDS).cast(pa.list_(pa.int64()))], ["node", "bands"])

    return classes.select("node", "sig").mapInArrow(keys, "node long, bands array<long>")


def in_blocks(groups: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """node, component, own, g, x, y: the members of each component, once for each pair (x, y) of its blocks that they take part in.

    A component whose sizes (node, size) need several blocks of ``most`` each is dealt out by itself, g being its name;
    smaller ones share a bundle g of that size, with x = y = -1.
    """
    members = groups.join(sizes, "node")
    bundles = max(1, (members.agg(F.sum("size")).collect()[0][0] or 0) // most)
    alone, parts = F.col("parts") > 1, F.ceil(F.col("whole") / most).cast("int")
    dealt = attached(members, "component", "node", {"whole": F.sum("size")}).withColumn("parts", parts)
    dealt = dealt.withColumn("own", F.when(alone, F.pmod(F.xxhash64("node", F.lit(3)), "parts")).otherwise(0).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = lambda n: F.when(alone, n("own", "other")).otherwise(-1)
    g = F.when(alone, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bundles)))
    return spread.select("node", "component", "own", g.alias("g"), block(F.least).alias("x"), block(F.greatest).alias("y"))


def sides(table: pa.Table):
    """The row numbers of both blocks, component by component."""
    comp, own = table.column("component").to_numpy(), table.column("own").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    order = np.argsort(comp, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        a, b = (part, part) if x == y else (part[own[part] == x], part[own[part] == y])
        if len(a) and len(b):
            yield a, b


def ends_table(ids: np.ndarray, links: np.ndarray, edges: list) -> pa.Table:
    some, ends = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
    none = np.arange(len(some) + len(ends)) < len(some)
    return pa.table({"u": pa.array(np.concatenate([ids[some], ids[ends[:, 0]]])), "v": pa.array(np.concatenate([ids[some], ids[ends[:, 1]]]), mask=none), "links": pa.array(np.concatenate([links[some], np.zeros(len(ends), np.int64)]))})


def linked(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links among the classes (node, w, copies, least, bytes, sig): rows (u, v) of a spanning forest of each block pair, and
    rows (u, null, links) whose sum over u is the number of documents of other classes that are similar to u's."""
    keys = bands_of(classes).select("node", F.explode("bands").alias("key"))
    shared = attached(keys, "key", "node", {"v": F.min("node")})
    candidates = components(shared.where("node <> v").select(F.col("node").alias("u"), "v"))

    def prune(table: pa.Table) -> pa.Table:
        sig, edges = matrix_of(table.column("sig")), []
        for a, b in sides(table):
            i, j = pruned(sig[a], sig[b], a is b, threshold)
            edges += forest(a[i], b[j])
        return ends_table(table.column("node").to_numpy(), np.zeros(table.num_rows, np.int64), edges)

    spread = in_blocks(candidates, classes.select("node", F.lit(1).alias("size")), block).join(classes.select("node", "sig"), "node")
    groups = components(spread.groupBy("g", "x", "y").applyInArrow(prune, GROUP).select("u", "v"))

    wanted = groups.select("node").join(classes.select("node", "copies", "least", F.col("w").alias("wanted_w")), "node")
    told = fingerprints(docs, "doc_id", "text", sketch=False)
    near = F.broadcast(wanted) if groups.count() <= BROADCAST_ROWS else wanted
    texts = told.join(near, (F.col("w") == F.col("wanted_w")) & F.col("doc_id").eqNullSafe(F.col("least")))
    texts = texts.groupBy("node", "copies").agg(F.min("text").alias("text"))  # repeated rows give one

    def verify(table: pa.Table) -> pa.Table:
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        data, off = _bytes.utf8(table.column("text").cast(pa.large_string()))
        hashes, start, size, first = _bytes.word_spans(data, off)
        h, places = grams(hashes, first)
        sig = np.zeros((len(ids), len(_A)), np.uint32)
        some = np.flatnonzero(np.diff(places))
        if len(some):
            sig[some] = signatures(h, np.concatenate([places[some], places[-1:]]))
        sets = exact_sets(_bytes.LOWER[data], hashes, start, size, first)
        n = np.array([len(x) for x in sets], np.int64)
        links, edges = np.zeros(len(ids), np.int64), []
        for a, b in sides(table):
            i, j = np.triu_indices(len(a), 1) if a is b else (x.ravel() for x in np.indices((len(a), len(b))))
            keep = np.minimum(n[a][i], n[b][j]) >= np.maximum(threshold * np.maximum(n[a][i], n[b][j]) - 1e-9, 1)
            i, j = pruned(sig[a], sig[b], a is b, threshold, (i[keep], j[keep]))
            both = intersections([sets[k] for k in a.tolist()], [sets[k] for k in b.tolist()], i, j)
            keep = both >= threshold * (n[a][i] + n[b][j] - both) - 1e-9
            i, j = a[i[keep]], b[j[keep]]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += forest(i, j)
        return ends_table(ids, links, edges)

    sizes = classes.select("node", F.greatest("bytes", F.lit(block_bytes // block)).alias("size"))
    spread = in_blocks(groups, sizes, block_bytes).join(texts, "node")
    return written(spread.groupBy("g", "x", "y").applyInArrow(verify, GROUP), fresh_path(docs.sparkSession, "near-links"))


def classes_of(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id and w of every document; w, class_id, n_links, chosen, least of every class of equal words)."""
    spark = docs.sparkSession
    prepare(spark)
    paths = [fresh_path(spark, f"near-{x}") for x in ("rows", "signatures", "classes")]
    sketched = written(fingerprints(docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes")), "doc_id", "bytes"), paths[1])
    classes = sketched.where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("bytes").alias("bytes"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), paths[2])
    rows = written(sketched.select("doc_id", "w"), paths[0])
    delete_path(spark, paths[1])
    found = linked(docs, classes, threshold)
    groups = components(found.where("v is not null").select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    owned = classes.select("w", "node", "copies", "least").join(groups, "node", "left").join(links, F.col("node") == F.col("u"), "left")
    owned = written(owned.select("w", "node", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), fresh_path(spark, "near-owned"))
    delete_path(spark, paths[2])
    named = attached(owned, "component", "node", {"class_id": F.min("least"), "first_node": F.min_by("node", F.struct(F.col("least").isNull(), "least", "w"))})
    return rows, named.select("w", "class_id", "n_links", (F.col("first_node") == F.col("node")).alias("chosen"), "least")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    class_id: the least doc_id of the documents that are connected by links; n_links: the number of other documents
    whose word 5-grams have a Jaccard similarity of at least the threshold, copies included.  Words are runs of digits,
    letters and non-ASCII characters, A-Z lower-cased; a text of fewer than five words is one n-gram.  Texts without words
    (null, empty) have no links and are classes of their own, whose id is their own doc_id.  Repeated rows are copies of
    each other; a class whose members' doc_ids are all null has a null id.  Other columns are not read.
    """
    rows, classes = classes_of(docs, threshold)
    out = rows.join(classes, "w", "left")
    return out.select("doc_id", F.when(F.col("w").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row of least doc_id; texts without words all stay."""
    _, classes = classes_of(docs, threshold)
    chosen = classes.where("chosen").select("w", "least")
    some, back = aside(docs, "doc_id")
    rows = fingerprints(some, "doc_id", *back, text=next(k for k, c in back.items() if c == "text"), sketch=False)
    kept = rows.join(chosen, "w").where(F.col("doc_id").eqNullSafe(F.col("least")))
    return restored(kept.dropDuplicates(["w"]).select(*back).unionByName(rows.where("w is null").select(*back)), back)
