"""The training-data operators against brute force, over tables with every odd case."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm._common import cut
from tallybrook.llm import _bytes, decontamination, near_duplicates, packing, quality, queries, sharding, suffix_dedup, token_counts, token_store, top_k, url_filter

SCHEMA = "doc_id long, text string, lang string, x int, tk long, n long, w long, z string, spans string, block int, bucket int"
RX, LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}


def words(text):
    return RX.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(150), make(60)
    near = base.split()
    near[70] = "other"
    texts = [None, "", "!!", "one two", "One, two!", base, base, base.upper(), " ".join(near), make(90) + " " + passage + ". " + make(30), passage + "\n" + make(50), "ab " * 400, make(9000), make(40) + "<|endoftext|>x", "x" * 150, "y" * 500, "日本語 テキスト " * 40]
    texts += [make(rng.randint(1, 200)) for _ in range(25)]
    out = [(k, t) for k, t in enumerate(texts)]
    return [*out, (5, base), (None, make(30)), (None, passage), (-7, "Tiny.")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, "z", "s", 5, 6) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def multiset(found):
    return collections.Counter(map(tuple, found))


def test_sharding(docs, none, rows):
    found = sharding.shard_rows(docs, 4).collect()
    assert len(found) == len(rows) and sharding.shard_rows(none, 4).count() == 0
    sizes = collections.Counter()
    for i, t in rows:
        sizes[hashlib.md5((t or "").encode()).digest()] += len((t or "").encode()) + 1
    order = [sizes[k] for k in sorted(sizes)]

    def fits(capacity):
        parts, held = 1, 0
        for s in order:
            if s > capacity:
                return False
            parts, held = (parts, held + s) if held + s <= capacity else (parts + 1, s)
        return parts <= 4

    best = bisect.bisect_left(range(sum(order) + 1), True, key=fits)
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    assert max(sum(r["size"] for r in own) for own in by.values()) == best
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    shard_of = collections.defaultdict(set)
    for r in found:
        shard_of[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())


def small_sizes(rng, n, total):
    cut = sorted(rng.sample(range(1, total), n - 1))
    return [b - a for a, b in zip([0, *cut], [*cut, total], strict=True)]


@pytest.mark.parametrize("large,small", [([0.33], 400), ([0.2, 0.15, 0.1], 300), ([], "equal"), ([0.5], 3)])
def test_sharding_with_large_groups(spark, large, small):
    """Groups above the mean are alone, the others are spread over all shards left, and none is empty while groups last."""
    rng, shards, total = random.Random(5), 16, 60_000
    sizes = [50] * 100 if small == "equal" else small_sizes(rng, small, int(total * (1 - sum(large))))
    texts = [f"{k:05d}".ljust(max(5, s - 1), "x") for k, s in enumerate(sizes)]
    texts += [t for k, part in enumerate(large) for t in ["L" * 99 + str(k)] * int(total * part / 101)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sharding.shard_rows(df, shards).collect()
    assert len(found) == len(texts)
    group = collections.Counter()
    for t in texts:
        group[hashlib.md5(t.encode()).digest()] += len(t) + 1
    order = [group[k] for k in sorted(group)]

    def parts(capacity):
        n, held = 0, None
        for s in order:
            if s > capacity:
                n, held = n + 1, None
            else:
                n, held = (n, held + s) if held is not None and held + s <= capacity else (n + 1, s)
        return n

    best = next(c for c in range(sum(order) + 1) if parts(c) <= shards)
    got = collections.Counter()
    for r in found:
        got[r["shard"]] += r["size"]
    assert set(got) == set(range(min(shards, len(order))))
    assert max(got.values()) == max(best, max(order))
    assert sorted(x for x in got.values() if x > best) == sorted(s for s in order if s > best)
    if len(large) < 2 and len(order) > 50:  # a short stretch between two large groups is a small shard
        assert min(got.values()) > 0.6 * best


def test_token_counts(docs, none, rows, tokenizer):
    want = collections.Counter()
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert multiset(token_counts.count_tokens(docs, queries.vocabulary()).collect()) == want
    assert token_counts.count_tokens(none, queries.vocabulary()).count() == 0


def test_token_store(spark, docs, none, rows, tokenizer, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, queries.vocabulary(), shard_bytes=4000)
    found = token_store.documents_of(spark, path).collect()
    want, at = collections.Counter(), 0
    ids_of = collections.defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want[i, at, len(ids) // 4, zlib.crc32(ids)] += 1
        ids_of[i].append(ids)
        at += len(ids) // 4
    assert multiset(found) == want
    asked = spark.createDataFrame([(5,), (12,), (-7,), (10**12,), (None,), (5,)], "doc_id long")
    got = collections.defaultdict(list)
    for r in token_store.lookup(asked, path).collect():
        got[r["doc_id"]].append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(ids_of[k]) for k in (5, 12, -7)}
    token_store.write_store(none, f"{path}-none", queries.vocabulary())
    assert token_store.documents_of(spark, f"{path}-none").count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    index = token_store.PerfectHash.build(np.unique(keys))
    assert sorted(index.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def test_packing(docs, none, rows, tokenizer):
    found = packing.pack(docs, queries.vocabulary(), capacity=512).collect()
    assert packing.pack(none, queries.vocabulary()).count() == 0
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    want = collections.Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == want
    rooms = []
    for length in sorted((r["length"] for r in found), reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else 512
        bisect.insort(rooms, room - length)
    assert len(bins) == len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    histogram = {length: rng.randint(1, 40) for length in rng.sample(range(1, 101), 30)}
    steps, rooms = packing.plan(histogram, 100), []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect.bisect_left(rooms, length)
            room = rooms.pop(k) if k < len(rooms) else 100
            bisect.insort(rooms, room - length)
    used = collections.Counter()
    for n, (length, rank, first, bins, offset) in enumerate(steps.tolist()):
        end = steps[n + 1][1] if n + 1 < len(steps) and steps[n + 1][0] == length else histogram[length]
        for b in range(end - rank):
            assert used[first + b % bins] == offset + b // bins * length
            used[first + b % bins] += length
    assert sorted(100 - u for u in used.values()) == rooms


def overlap(rows, threshold=0.8):
    grams = []
    for _, t in rows:
        w = words(t)
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [[bool(a and b) and len(a & b) / len(a | b) >= threshold for b in grams] for a in grams]


def near_classes(rows):
    links = overlap(rows)
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            root[a] = min([root[a], *(root[b] for b in range(len(rows)) if links[a][b])])
    want = collections.Counter()
    for a, (i, t) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None]
        want[i, (min(ids) if ids else None) if words(t) else i, sum(links[a]) - 1 if words(t) else 0] += 1
    return want, root


def test_near_duplicates(docs, none, rows):
    want, root = near_classes(rows)
    assert multiset(near_duplicates.near_duplicates(docs).collect()) == want
    assert near_duplicates.near_duplicates(none).count() == 0
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root[a] for a, (_, t) in enumerate(rows) if words(t)}) + sum(not words(t) for _, t in rows)


def classes_by_hand(docs):
    marked = near_duplicates.fingerprints(docs, "doc_id")
    grouped = marked.groupBy("w").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    return cut(grouped.withColumns({"bytes": F.lit(300).cast("long"), "node": F.monotonically_increasing_id()}))


def test_near_duplicate_blocks(spark, rows):
    """A group that is dealt out in many blocks gives the same links."""
    base = [f"w{k}" for k in range(60)]
    many = [(k, " ".join(base[:k % 50] + [f"q{k}"] + base[k % 50 + 1 :])) for k in range(40)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    classes, links = classes_by_hand(docs), overlap(many)
    found = near_duplicates.linked(docs, classes, block=7, block_bytes=2100).where("v is null").groupBy("u").agg(F.sum("links").alias("n"))
    found = found.join(classes.select(F.col("node").alias("u"), F.col("least").alias("doc_id")), "u")
    assert {r["doc_id"]: r["n"] for r in found.collect()} == {k: sum(links[k]) - 1 for k in range(40) if sum(links[k]) > 1}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Null ids and repeated rows: one class by its words, whatever the ids; wanted texts by a shuffle give the same."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k % 50] + [f"q{k}"] + base[k % 50 + 1 :]) for k in range(30)]
    docs = spark.createDataFrame([(None, t) for t in texts] * 3, "doc_id long, text string")
    links = overlap([(None, t) for t in texts])
    want = collections.Counter((None, None, 3 * sum(links[k]) - 1) for k in range(30) for _ in range(3))
    assert multiset(near_duplicates.near_duplicates(docs).collect()) == want
    assert near_duplicates.one_of_each(docs).count() == 1
    before, near_duplicates.BROADCAST_ROWS = near_duplicates.BROADCAST_ROWS, 0
    try:
        assert multiset(near_duplicates.near_duplicates(docs).collect()) == want
    finally:
        near_duplicates.BROADCAST_ROWS = before


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_of_structure_are_told_apart(n):
    data, offsets = _bytes.utf8(pa.array(thue_morse(n)))
    assert len(set(_bytes.words(data, offsets)[0].tolist())) == 2 and len(set(_bytes.word_digests(data, offsets))) == 2


@pytest.mark.parametrize("n", [64, 256, 1024, 4096, 1 << 14])
def test_ranges_of_structure_are_told_apart(n):
    one, other = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
    ends = np.array([0]), np.array([n])
    assert _bytes.Prefix(one).ranges(*ends) != _bytes.Prefix(other).ranges(*ends)


def morse_blocks(period, n=64):
    """Two texts of blocks that share a sampled tuple and differ by a letter in Thue-Morse order, complemented in the second."""
    rng = random.Random(period)
    some = ["".join(rng.choice("abcdefghij") for _ in range(50)) for _ in range(20_000)]
    h = _bytes.Prefix(np.frombuffer("".join(some).encode(), np.uint8)).windows(50)[::50]
    tuple_ = some[int(np.argmin(h))]  # of least fingerprint, so that every window samples it
    dots, word = "." * min(7, (period - 51) // 3), thue_morse(n)[0]
    own = ["".join(rng.choice("klmnopqrst") for _ in range(period - 51 - 2 * len(dots))) for _ in range(n)]
    mark = lambda o, x: "".join(x if k % 60 == 59 else c for k, c in enumerate(o))  # noqa: E731  every window holds the letter
    letter = lambda w, flip: "XY"[(w == "b") ^ flip]
    text = lambda flip: "".join(tuple_ + dots + letter(w, flip) + dots + mark(o, letter(w, flip)) for w, o in zip(word, own, strict=True))
    return text(False), text(True)


@pytest.mark.parametrize("hot", [4096, 1])
def test_structured_texts_keep_what_repeats_nowhere(spark, monkeypatch, hot):
    """Fingerprints of these windows and runs collide; their bytes don't.  Also with all windows dealt out."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [t for p in (64, 104, 128, 256) for t in morse_blocks(p)]
    texts += [texts[4][:1000] + "!" * 90 + texts[1][300:900], *(w * 20 for w in thue_morse(64))]
    rows = list(enumerate(texts))
    found = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: sum(mask) for i, (_, mask) in enumerate(removed(rows))}
    assert {r["doc_id"]: r["n_removed"] for r in found} == want
    assert sum(not n for n in want.values()) > 4 and want[8] > 1000
    few = suffix_dedup.digest(spark.createDataFrame(rows[:8], "doc_id long, text string")).collect()
    assert {r["n_removed"] for r in few} == {0}


def test_windows_of_one_fingerprint_are_told_by_bytes(monkeypatch):
    """With a fingerprint that tells nothing, equal windows of a name are found, and no others."""
    monkeypatch.setattr(_bytes.Prefix, "windows", lambda self, k: np.zeros(max(0, len(self.sums) + 7 - k), np.uint64))
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[1500:1800] = raw[200:500]
    place = np.arange(0, len(raw) - 199)
    name = np.zeros(len(place), np.int64)
    got = suffix_dedup.repeated_bytes(raw, place, name)
    times = collections.Counter(raw[p : p + 200].tobytes() for p in place)
    assert got.tolist() == [times[raw[p : p + 200].tobytes()] > 1 for p in place] and got.sum() >= 202


def test_structured_words_in_operators(spark):
    one, other = thue_morse(1024)
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"x {one} y"), (4, f"x {other} y z v w")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontamination.decontaminate(docs, bench).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    assert {tuple(r) for r in near_duplicates.near_duplicates(docs).collect()} == {(k, k, 0) for k in (1, 2, 3, 4)}


def test_equal_fingerprints_are_compared_by_bytes(monkeypatch):
    """Words whose fingerprints collide are told apart by their bytes."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["longer-than-eight", "alsolongerthaneight", "anotherlongword", "x" * 70, "y" * 70]).replace("-", "") for _ in range(30)) for _ in range(6)]
    data, off = _bytes.utf8(pa.array(texts))
    _, start, size, first = _bytes.word_spans(data, off)
    sets = near_duplicates.exact_sets(_bytes.LOWER[data], np.zeros(len(start), np.uint64), start, size, first)
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words, texts)]
    assert [[len(np.intersect1d(a, b)) for b in sets] for a in sets] == [[len(a & b) for b in grams] for a in grams]


def hits(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = collections.Counter()
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        names = sorted("null" if x is None else str(x) for x in own)
        out[i, len(w), len(hit), len(own), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination(spark, docs, none, rows):
    texts = [t for _, t in rows if t and len(words(t)) > 60]
    items = [(1, " ".join(words(texts[0])[20:45])), (2, "one two"), (3, None), (4, ""), (None, "Tiny"), (5, " ".join(words(texts[1])[5:14])), (5, " ".join(words(texts[1])[5:14])), (6, "no such words here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits(rows, items)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert multiset(decontamination.decontaminate(docs, bench).select(*columns).collect()) == want
    assert multiset(decontamination.decontaminate(docs, bench, test_bytes=60).select(*columns).collect()) == want
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.clean(docs, bench).count() == sum(n for k, n in want.items() if not k[5])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta " + "z " * 30 + "alpha"), (3, "alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = decontamination.decontaminate(docs, bench, proximity=5)
    assert {r["doc_id"]: r["contaminated"] for r in found.collect()} == {1: True, 2: False, 3: True}


def test_top_k(spark):
    rng = random.Random(8)
    data = [(k, [rng.gauss(0, 0.2) for _ in range(6)]) for k in range(120)]
    data += [(500, data[3][1]), (501, None), (502, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (550, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, score string")
    ok = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in data if v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    vectors = top_k.integer_vectors(df)
    asked = vectors.where("vec_id % 50 = 0")
    assert sorted(map(tuple, top_k.top_k(vectors, asked).collect())) == sorted(want)
    assert sorted(map(tuple, top_k.top_k(vectors.repartition(5), asked, block_rows=7, query_bytes=100).collect())) == sorted(want)
    assert top_k.top_k(vectors.limit(0), asked.limit(0)).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(2)
    texts = [(k, (" ".join(rng.choice("the of and thing other word".split()) + rng.choice(["", "s", "ed"]) for _ in range(80))) if k % 3 else "SPAM!! " * 60) for k in range(240)]
    some = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality.classify(some, labels).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)
    odd = quality.classify(docs, labels, "lang").collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep(docs, labels).columns == docs.columns


def removed(rows, n=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[k : k + n] for b in texts for k in range(len(b) - n + 1))
    for b in texts:
        mask = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                mask[k : k + n] = b"\1" * n
        yield b, bytes(mask)


def test_suffix_dedup(docs, none, rows):
    want = collections.Counter()
    for (i, _), (b, mask) in zip(rows, removed(rows), strict=True):
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        want[i, len(b), sum(mask), len(re.findall(b"\1+", mask)), hashlib.sha256(kept).hexdigest()] += 1
    assert multiset(suffix_dedup.digest(docs).collect()) == want
    assert suffix_dedup.digest(none).count() == 0
    plain = suffix_dedup.without_repeats(docs)
    assert plain.columns == docs.columns and plain.count() == len(rows)


def test_suffix_dedup_fuzz(spark, monkeypatch):
    """Shared passages, periodic runs, hot groups dealt out by fingerprint, and texts beyond a block."""
    from tallybrook.llm import _bytes

    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(260)
    rows = [(k, noise(rng.randint(0, 300)) + shared[rng.randint(0, 40) :] + noise(rng.randint(0, 300))) for k in range(40)]
    rows += [(100, "abc" * 300), (101, noise(50) + "abc" * 90), (102, noise(3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.digest(docs).collect()}
    for (i, _), (b, mask) in zip(rows, removed(rows), strict=True):
        assert found[i] == (sum(mask), hashlib.sha256(bytes(c for c, m in zip(b, mask, strict=True) if not m)).hexdigest())
    data, offsets = _bytes.utf8(__import__("pyarrow").array([t for _, t in rows]))
    assert sum(len(p) for p, *_ in suffix_dedup.slices(data, offsets, block=1000)) >= len(data)


def test_url_filter(spark):
    day = __import__("datetime").date
    entries = spark.createDataFrame([("Bad.example", "add", "spam", day(2024, 1, 10)), ("bad.example", "remove", "spam", day(2024, 2, 1)), ("bad.example", "add", "adult", day(2024, 3, 1)), ("ads.bad.example", "add", "ads", day(2024, 1, 1)), ("same.example", "add", "a", day(2024, 1, 1)), ("same.example", "remove", "a", day(2024, 1, 1)), (None, "add", "x", day(2024, 1, 1)), ("null.example", "add", "x", None)], "pattern string, action string, category string, entry_date date")
    asked = [("https://bad.example/", day(2024, 1, 9), None), ("https://bad.example/", day(2024, 1, 10), "spam"), ("https://x.bad.example:80/a", day(2024, 1, 31), "spam"), ("https://bad.example/", day(2024, 2, 1), None), ("https://BAD.example", day(2025, 1, 1), "adult"), ("https://ads.bad.example/", day(2024, 2, 10), "ads"), ("https://verybad.example/", day(2024, 1, 15), None), (None, day(2024, 1, 15), None), ("", day(2024, 1, 15), None), ("https://bad.example/", None, None), ("https://same.example", day(2024, 1, 2), None), ("https://null.example", day(2024, 1, 2), None)]
    captures = spark.createDataFrame([(k, u, d, "clash") for k, (u, d, _) in enumerate(asked)], "capture_id long, url string, fetch_date date, pattern string")
    found = {r["capture_id"]: r["category"] for r in url_filter.evaluate(captures, url_filter.intervals(entries)).collect()}
    assert found == {k: c for k, (_, _, c) in enumerate(asked)}
    assert url_filter.evaluate(captures.limit(0), url_filter.intervals(entries.limit(0))).count() == 0


def test_top_k_of_repeated_queries(spark):
    """Equal query rows are asked once; another vector under the same vec_id has its own rows."""
    rng = random.Random(8)
    vectors = [(k, [rng.randint(-50, 50) for _ in range(4)]) for k in range(60)]
    asked = [vectors[3], vectors[3], vectors[3], vectors[7], (7, [9, -9, 1, 0])]
    want = collections.Counter()
    for q, x in {(q, tuple(x)) for q, x in asked}:
        near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), k) for k, y in vectors if k != q)[:5]
        want.update((q, rank, k, -s) for rank, (s, k) in enumerate(near, 1))
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, x array<long>")
    assert multiset(top_k.top_k(frame(vectors), frame(asked)).collect()) == want
    assert multiset(top_k.top_k(frame(vectors).repartition(3), frame(asked), block_rows=7, query_bytes=50).collect()) == want


def test_packing_in_buckets(spark):
    """Lengths of many rows are ranked in several buckets; every sequence is gapless and the count is that of best fit."""
    rng = random.Random(4)
    rows = [(k if k % 50 else None, 0, 0, rng.choice([3, 7, rng.randint(1, 100)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, packing.PIECES).repartition(3)
    held, rooms = collections.defaultdict(list), []
    for r in packing.place(df, 100, 40).collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, held.values())) == len(rows)
    for own in held.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 100
    for length in sorted((r[3] for r in rows), reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else 100
        bisect.insort(rooms, room - length)
    assert len(held) == len(rooms)


def clamp(x):
    return max(-(2**63), min(2**63 - 1, x))


@pytest.mark.parametrize("size", [2**26, 2**28, 2**31, 2**62])
def test_top_k_of_large_components(spark, size):
    """Scores are exact beyond the integers that doubles hold; those beyond a long count as the nearest long."""
    rng = random.Random(size)
    vectors = [(k, [rng.randint(-size, size) for _ in range(5)]) for k in range(80)] + [(90, [size] * 3), (91, [-size] * 7)]
    asked = [vectors[2], vectors[7], vectors[81]]
    want = collections.Counter()
    for q, x in asked:
        near = sorted((-clamp(sum(a * b for a, b in zip(x, y))), k) for k, y in vectors if k != q)[:5]  # noqa: B905
        want.update((q, rank, k, -s) for rank, (s, k) in enumerate(near, 1))
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, x array<long>")
    assert multiset(top_k.top_k(frame(vectors), frame(asked)).collect()) == want
    assert multiset(top_k.top_k(frame(vectors).repartition(3), frame(asked), block_rows=30, query_bytes=60).collect()) == want


def test_top_k_reads_lists_and_stops(spark):
    """Where a few candidates stand out, reading stops early; where all are alike, every entry is read."""
    rng = np.random.default_rng(4)
    n, dims = 2000, 4
    for steep in (True, False):
        x = (np.exp(rng.normal(0, 2, (n, 1))) * 1000 * rng.uniform(0.9, 1, (n, dims))).astype(np.int64) if steep else rng.integers(-5, 6, (n, dims))
        q = rng.integers(1, 9, (3, dims))
        i, c, score, read = top_k.block_top(x, np.arange(n), q, np.array([-1, -2, -3]), 5, top_k.sorted_lists(x))
        for j in range(3):
            best = sorted((-int(s), k) for k, s in enumerate(x @ q[j]))[:5]
            assert [(-int(s), int(k)) for s, k in zip(score[i == j], c[i == j], strict=True)] == best
        assert (read < n * dims / 4).all() if steep else (read <= n * dims).all()
    df = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "vec_id long, x array<long>")
    found = top_k.top_k(df, df.where("vec_id in (0, 1)"), report=True).collect()
    assert {r["query_id"] for r in found if 0 < r["entries"] <= n * dims} == {0, 1}
