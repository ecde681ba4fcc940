"""Byte-level BPE by chunks, the alignment of two tokenizers and the prefix trie, against brute force."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybrook.llm import alignment, byte_bpe, prefix_trie, queries

from ..conftest import SF

RANKS, PATTERN = queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern()
SIDES = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "\n", "'", "s", "re", "ll", "1", "!", "\u00e9", "\u65e5", " ", "'ll", "x" * 30, " " * 40, "\t", "\u00a0", "<|endoftext|>", "<s>", "word "]
CLASHING = "tk key k last part head tail piece ids decoded a b n_a n_b groups pair n best times more_sum pos digest words place first shift h taken source own start end name least depth".split()


def made(rng, most):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [None, "", " ", "ab", "word " * 300, "x" * 3000 + " end", "it's  \n" * 90, " " * 900 + "q", "\u2581a", "a\x00b", "\u2581"]
    texts += [made(rng, 300) for _ in range(25)]
    return [*enumerate(texts), (None, "word " * 300), (4, "word " * 300), (-3, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHING)).cache()


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.encoding(RANKS, PATTERN)._mergeable_ranks, special_tokens={})


def ids_of(text):
    return np.array(library().encode_ordinary(text or ""), "<u4").tobytes()


def test_stitched_chunks_are_the_library(rows):
    """Chunks of few characters, so that boundaries fall everywhere; what can't be stitched is one piece."""
    rng, lib, through = random.Random(1), library(), 0
    for _ in range(3000):
        text, chunk, overlap = made(rng, 60), 16, rng.choice([3, 5, 12])
        own, places = byte_bpe.chunks_of(text, chunk, overlap), [0]
        seen = [byte_bpe.edges(t, k == len(own) - 1, chunk, overlap, PATTERN) for k, t in enumerate(own)]
        for (_, tail), (head, _) in zip(seen[:-1], seen[1:], strict=True):
            if not (common := set(tail) & set(head)):
                break
            places.append(min(common))
        ids = []
        for k, at in enumerate(places):
            last = k == len(places) - 1
            part = "".join(x[:chunk] for x in own[k:-1]) + own[-1] if last else own[k]
            ids += byte_bpe.encoded_part(part, at, len(part) if last else chunk + places[k + 1], RANKS, PATTERN)
        assert ids == lib.encode_ordinary(text)
        through += len(places) == len(own) > 2
    assert through > 20


@pytest.mark.parametrize("chunk", [64, byte_bpe.CHUNK])
def test_byte_bpe(docs, rows, chunk):
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN, chunk, 16), RANKS, PATTERN)
    assert Counter((i, bytes(x), bytes(y)) for i, x, y in out.collect()) == Counter((i, ids_of(t), (t or "").encode()) for i, t in rows)
    told = byte_bpe.digest(out)
    assert Counter(map(tuple, told.collect())) == Counter((i, len(ids_of(t)) // 4, hashlib.sha256(ids_of(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert byte_bpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_very_long_texts(spark):
    """Millions of characters: words, one pre-token, and white space that the library's own pattern fails at."""
    texts = ["many words, " * 200_000, "a" * 1_200_000 + " b", " " * 1_500_000 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert {i: bytes(y).decode() for i, _, y in out} == dict(enumerate(texts))
    found = {i: bytes(x) for i, x, _ in out}
    assert found[0] == ids_of(texts[0]) and found[1] == ids_of(texts[1])
    assert len(found[2]) // 4 == 1_500_000  # the spaces before the last one, singly, and " x"
    aligned = {r["doc_id"]: r for r in alignment.align(docs.where("doc_id < 2"), *SIDES, PATTERN).collect()}
    assert [aligned[i]["n_a"] for i in (0, 1)] == [len(ids_of(" " + t)) // 4 for t in texts[:2]]


def spelled(both, text):
    """Both sides' ids and token bytes by the libraries, or nothing."""
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    return (a, b, x, y) if text and b"".join(x) == b"".join(y) == (" " + text).encode() else ([], [], [], [])


def alignments(rows):
    both, out, counts = alignment.Sides(*SIDES, None), [], Counter()
    for i, t in rows:
        a, b, x, y = spelled(both, t or "")
        x, y = ([0, *np.cumsum([len(v) for v in z]).tolist()] for z in (x, y))
        links, q = [], 0
        for p in range(len(a)):
            while y[q + 1] <= x[p]:
                q += 1
            r = q
            while r < len(b) and y[r] < x[p + 1]:
                links.append((a[p], b[r]))
                r += 1
        cuts, at, groups = sorted(set(x[1:]) & set(y[1:])), [0, 0], []
        for c in cuts:
            ends = bisect.bisect_left(x, c), bisect.bisect_left(y, c)
            groups.append(",".join(map(str, a[at[0] : ends[0]])) + "|" + ",".join(map(str, b[at[1] : ends[1]])))
            at = ends
        counts.update(links)
        out.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter((i, a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), text) for i, a, b, g, x, text in out)


@pytest.mark.parametrize(("frequent", "pattern"), [(1 << 18, PATTERN), (40, None), (0, PATTERN)])
def test_alignment(docs, rows, frequent, pattern):
    """All pairs broadcast, some, and none: the rest is joined."""
    out = alignment.align(docs, *SIDES, pattern, frequent)
    want = alignments(rows)
    assert Counter(map(tuple, out.collect())) == want
    digested = {(r["doc_id"], r["groups_sha256"]) for r in alignment.digest(out).collect()}
    assert digested == {(x[0], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in want}


def test_alignment_of_nothing(docs):
    assert alignment.align(docs.limit(0), *SIDES, PATTERN).count() == 0


def test_tokenizers_by_unit():
    """Units, ranks and caches give the libraries' ids."""
    both, rng = alignment.Sides(*SIDES, PATTERN), random.Random(2)
    assert both.ranked and both.by_unit
    texts = [made(rng, 30) for _ in range(4000)]
    got = both.of(texts)
    for text, (a, b) in zip(texts, got, strict=True):
        want = spelled(both, text)
        assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == want[:2]


def nodes(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(v)] for c, v in own.items()}
    whole = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
            leaves[p[:d]] += not kids[p]
    told = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], told(ends[p])) for p, m in members.items())


TURNS = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("block", [2, 8])
def test_trie(spark, block):
    """Shared and diverging turns, chains of 70 turns, null and tied turns, repeated rows, turnless conversations."""
    rng, rows = random.Random(4), [(None, 1, "u", "q"), (200, 0, "u", "q"), (200, 0, "u", "q"), (7, 0, None, None), (3, 0, "u", "alone")]
    for c in range(0, 70):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 20, 70])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["u", "u", None]), rng.choice(["a b", "a b", "a b", None, "", "c\x1cd e\u3000f"]) if rng.random() < 0.97 else "z"))
    rows += [(c, t, "u", str(t) if t < c % 7 + 2 else "x y") for c in range(101, 160) for t in range(c % 13)]
    df = spark.createDataFrame(rows, TURNS).repartition(5).select("*", *(F.lit(c).alias(c) for c in CLASHING))
    assert Counter(map(tuple, prefix_trie.family_trie(df, block).collect())) == nodes(rows)


def test_small_tries(spark):
    assert prefix_trie.family_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = [(1, 0, "u", "x")]  # its only turn gives way to those of an absent conversation, or stays
    assert Counter(map(tuple, prefix_trie.family_trie(spark.createDataFrame(one, TURNS)).collect())) == nodes(one)
    many = [(c, t, "u", "same words") for c in range(0, 4000, 20) for t in range(3)]
    assert Counter(map(tuple, prefix_trie.family_trie(spark.createDataFrame(many, TURNS)).collect())) == nodes(many)


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_registered(spark):
    """The three queries on the smallest tables."""
    run = lambda name: Counter(tuple(r) for r in queries.QUERIES[name](spark, SF).collect())
    texts = rows_of(spark, "documents", "doc_id", "text")
    assert run("op11_byte_level_bpe") == Counter((i, len(ids_of(t)) // 4, hashlib.sha256(ids_of(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert run("op13_prefix_trie") == nodes(rows_of(spark, "conversations", "conv_id", "turn", "role", "text"))
    some = Counter((*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in alignments(texts).elements())
    assert run("op12_tokenizer_alignment") == some
