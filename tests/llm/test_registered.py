"""The registered queries without SQL, and the pipeline, against brute force over the smallest tables."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallybrook.llm import quality, queries

from ..conftest import SF
from .test_operators import hits, multiset, near_classes, removed, tokenizer, words  # noqa: F401


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return table(spark, "documents", "doc_id", "text")


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def digests(rows):
    for (i, _), (b, mask) in zip(rows, removed(rows), strict=True):
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        yield i, kept, (i, len(b), sum(mask), len(re.findall(b"\1+", mask)), hashlib.sha256(kept).hexdigest())


def encoded(tokenizer, text):  # noqa: F811
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pieces(tokenizer, rows):  # noqa: F811
    for i, t in rows:
        ids = encoded(tokenizer, t)
        for k, at in enumerate(range(0, len(ids), 4096)):
            yield i, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])


def same_packing(found, want):
    """The same pieces, gapless within sequences of 4096, in as many sequences as best-fit decreasing needs."""
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    used = collections.Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    rooms = []
    for length in sorted((r["length"] for r in found), reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else 4096
        bisect.insort(rooms, room - length)
    assert max(used.values()) <= 4096 and len(used) == len(rooms)


def test_sharding_query(spark, texts):
    found = run(spark, "op2_sharding")
    rows = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == rows
    group = collections.Counter()
    for _, t in texts:
        group[hashlib.md5((t or "").encode()).digest()] += len((t or "").encode()) + 1
    order = [group[k] for k in sorted(group)]

    def parts(capacity):
        n, held = 0, None
        for s in order:
            n, held = (n, held + s) if held is not None and held + s <= capacity else (n + 1, s)
            held = held if s <= capacity else None
        return n

    least = bisect.bisect_left(range(sum(order)), True, key=lambda c: parts(c) <= 16)
    shard, slots = collections.Counter(), collections.defaultdict(list)
    for r in found:
        shard[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(shard.values()) == max(least, max(order)) and set(shard) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}


def test_token_queries(spark, texts, tokenizer):  # noqa: F811
    counts, store, at = collections.Counter(), collections.Counter(), 0
    for i, t in sorted(texts):
        ids = encoded(tokenizer, t)
        counts[i, len((t or "").encode()), len(ids) - 1, len(ids) - 1 > 2048] += 1
        store[i, at, len(ids), crc(ids)] += 1
        at += len(ids)
    assert multiset(run(spark, "op3_token_counts")) == counts
    assert multiset(run(spark, "op6_token_store")) == store
    same_packing(run(spark, "op9_best_fit_packing"), collections.Counter(pieces(tokenizer, texts)))


def test_text_queries(spark, texts):
    assert multiset(run(spark, "op4_ngram_jaccard_join")) == near_classes(texts)[0]
    assert multiset(run(spark, "op5_benchmark_decontamination")) == hits(texts, table(spark, "benchmark", "item_id", "text"))
    assert multiset(run(spark, "op10_suffix_array_dedup")) == collections.Counter(d for *_, d in digests(texts))


def plain_features(text):
    b, w = text.encode(), words(text)
    if not b:
        return [0.0] * len(quality.FEATURES)
    share = lambda chars: sum(c in set(chars) for c in b) / len(b)
    kinds = [range(65, 91), range(48, 58), b"!?", b"#$%&*+/=@\\^_~<>", b"|", b".,;:", b" \t", b"\n\r", range(128, 256)]
    letters = sum(c in range(48, 58) or c in range(65, 91) or c in range(97, 123) or c >= 128 for c in b)
    count = collections.Counter(w)
    capital = sum(y in range(65, 91) and x <= 32 for x, y in zip(b, b[1:]))
    rest = [letters / len(w), len(count) / len(w) ** 0.8, sum(x == y for x, y in zip(w, w[1:])) / len(w), sum(n == 1 for n in count.values()) / len(w), max(count.values()) / len(w), capital / len(w)] if w else [0.0] * 6
    return [math.log1p(len(w)), *(share(k) for k in kinds), *rest]


def test_quality_query(spark, texts):
    """Features by hand, the fit's splits against all splits, scores as sums of table entries, labels of held-out rows unseen."""
    found = {r["doc_id"]: r for r in run(spark, "op8_quality_classifier")}
    assert len(found) == len(texts)
    x = np.array([plain_features(t or "") for _, t in texts])
    assert np.allclose(x, quality.text_features(pa.array([t or "" for _, t in texts], pa.large_string())))
    labels = {i: q for i, q in table(spark, "labels", "doc_id", "quality") if q in (0, 1)}
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in texts]
    known = [k for k, (i, _) in enumerate(texts) if i in labels and not held[k]]
    model = quality.fit(x[known], np.array([labels[texts[k][0]] for k in known], float))
    for k, (i, _) in enumerate(texts):
        at = [int(sum(e <= v for e in edges)) for edges, v in zip(model.edges, x[k], strict=True)]
        raw = model.base + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[a], at[b]] for (a, b), t in model.pairs.items())
        r = found[i]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-raw)), abs_tol=1e-6)
        assert r["held_out"] == held[k] and r["predicted"] == int(r["score"] >= 0.7)
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=12), rng.random(12)
    part = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
    every = [part(slice(0, k)) + part(slice(k, 12)) - part(slice(0, 12)) for k in range(1, 12)]
    gain, at = quality.best_cut(g, h)
    assert math.isclose(gain, max(every)) and every[at - 1] == max(every)


def test_pipeline_by_hand(spark, texts, tokenizer):  # noqa: F811
    """The pipeline's rows: of the documents that the classifier keeps, all later stages by brute force."""
    good = {r["doc_id"] for r in run(spark, "op8_quality_classifier") if r["predicted"]}
    rows = sorted((i, t) for i, t in texts if i in good)
    classes = collections.Counter()
    for i, c, _ in near_classes(rows)[0]:
        classes[c] += 1
    rows = [(i, t) for i, t in rows if i in classes]
    rows = [(i, kept.decode("utf-8", "ignore") if t is not None else None) for (i, t), (_, kept, _) in zip(rows, digests(rows), strict=True)]
    hit = {i for i, *_, contaminated in hits(rows, table(spark, "benchmark", "item_id", "text")) if contaminated}
    rows = [(i, t) for i, t in rows if i not in hit]
    assert rows and hit and len(classes) < len(good)
    same_packing(corpus_pipeline.run(spark, SF).collect(), collections.Counter(pieces(tokenizer, rows)))
