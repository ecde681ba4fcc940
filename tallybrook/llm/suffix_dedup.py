"""Removal of all bytes under long strings that occur more than once: a truncated, distributed difference-cover sort.

Difference-cover suffix sorting sorts a sample of suffixes such that any two positions have sampled positions at one
common distance, names them, and merges the remaining suffixes by (bytes up to the sampled position, its name).  Here
the cover follows the content, so that equal strings have their samples at equal places: of the 50-byte tuples in each
window of 200 bytes the one of least fingerprint is sampled (1.3 % of all positions instead of two thirds).

1. Sampled tuples are named by their fingerprints; neighbouring windows that share a sample form a run.
2. Names that occur once are final: no window of theirs repeats.  Runs of other names are told by 128 bits of BLAKE2 of
   all their bytes; runs that occur again repeat as a whole.
3. The remaining suffixes, the windows of runs that share a sampled tuple but not all bytes, are merged: per tuple name
   they are sorted by fingerprint, and adjacent ones repeat if their bytes are equal.  The windows of a name with very many
   runs are dealt out instead, and told by 128 bits of BLAKE2.

Fingerprints that can be made to collide only say what is compared.

All occurrences of a string take part in step 1, so copies in any number of documents, or within one, are found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import _bytes
from tallybrook.llm._common import aside, cut, prepare, restored

LENGTH, TUPLE = 200, 50
HOT = 4096  # different runs of one tuple beyond which their windows are dealt out by fingerprint
MERGE_BYTES = 1 << 20  # of runs whose windows are merged at a time; a window takes some 100 bytes
SIZE = (1 << 31) - 1  # the bits of n that are the text's size
RUN = ["name", "piece", "more", "tk", "n", "doc_id", "span"]  # longs: piece and more are the run's digest, span is (x, windows, again)
AGAIN, WINDOWS = 1, 31  # bits of span
SPANS = "tk long, n long, start long, stop long"


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = TUPLE) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with a common sample: (text, first window, windows, name, again, first byte in data).

    again: the sampled tuple may occur more than once within the run.
    """
    w = length - k + 1  # tuples of a window
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = _bytes.Prefix(data)
    h = prefix.windows(k)
    least = _bytes.sliding_min(h, w)
    edge = np.zeros(len(data) + 1, np.int32)  # windows that would cross the end of a text
    np.add.at(edge, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(edge, offsets[1:], -1)
    fine = np.cumsum(edge)[:n] == 0
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | (fine[1:] != fine[:-1])
    start = np.flatnonzero(change)
    stop = np.append(start[1:], n)
    start, stop = start[fine[start]], stop[fine[start]]
    owner = np.searchsorted(offsets, start, "right") - 1
    pad = np.zeros(w - 1, np.uint64)
    sampled = np.flatnonzero(h == _bytes.sliding_min(np.concatenate([pad, np.where(fine, least, np.uint64(0)), pad]), w, largest=True))
    same = np.concatenate([[0], np.cumsum(h[sampled[1:]] == h[sampled[:-1]])]) if len(sampled) else np.zeros(1, np.int64)
    lo, hi = np.searchsorted(sampled, start), np.searchsorted(sampled, stop + w - 1) - 1
    again = (hi > lo) & (same[np.maximum(hi, 0)] > same[np.minimum(lo, len(same) - 1)])
    return owner, start - offsets[owner], stop - start, least[start].view(np.int64), again, start


def run_digests(data: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """128 bits of BLAKE2 of each run's bytes, as two numbers."""
    raw = memoryview(np.ascontiguousarray(data))
    out = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def slices(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, block: int = _bytes.BLOCK):
    """(bytes, offsets, numbers of the texts, where each begins in its text): whole texts, long ones in overlapping parts."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        size = int(offsets[end] - offsets[at])
        if end == at + 1 and size > block:
            for s in range(0, size - length + 1, block - length + 1):
                part = data[offsets[at] + s : min(offsets[at] + s + block, offsets[end])]
                yield part, np.array([0, len(part)]), np.array([at]), np.array([s])
        else:
            yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], np.arange(at, end), np.zeros(end - at, np.int64)
        at = end


def keyed(docs: DataFrame, *kept: str) -> DataFrame:
    """text (null: empty), its key (tk, n) and the kept columns; the key is the text's size and 96 bits of its SHA-256."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text, 256)
    number = lambda at, digits: F.conv(F.substring(sha, at, digits), 16, -10).cast("long")
    return docs.select(*kept, text.alias("text_"), number(1, 16).alias("tk"), F.shiftleft(number(17, 8), 31).bitwiseOR(F.octet_length(text).cast("long")).alias("n"))


def long_texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.octet_length("text") >= LENGTH)


def all_runs(docs: DataFrame) -> DataFrame:
    """The runs of all texts; of copies that meet in a task two suffice, as only once or more often matters."""

    def find(batches):
        seen: dict[tuple, int] = {}
        for b in _bytes.smaller(batches, 1):
            data, off = _bytes.utf8(b.column(1).cast(pa.large_string()))
            tk, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            ids = b.column(0)
            use = np.zeros(len(b), bool)
            for i, key in enumerate(zip(tk.tolist(), n.tolist(), strict=True)):
                if (times := seen.get(key, 0)) < 2:
                    seen[key], use[i] = times + 1, True
            for part, offsets, texts, begin in slices(data, off):
                owner, x, windows, name, again, start = runs_of(part, offsets)
                keep = use[texts[owner]]
                owner, x, windows, name, again, start = (v[keep] for v in (owner, x, windows, name, again, start))
                if len(owner):
                    at, told = texts[owner], run_digests(part, start, windows)
                    span = (x + begin[owner]) << 32 | windows << AGAIN | again
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(told[:, 0]), pa.array(told[:, 1]), pa.array(tk[at]), pa.array(n[at]), ids.take(pa.array(at)), pa.array(span)], RUN)

    return keyed(long_texts(docs), "doc_id").mapInArrow(find, ", ".join(f"{c} long" for c in RUN))


def packed_texts(docs: DataFrame, *kept: str) -> DataFrame:
    """keyed() with texts compressed for the shuffle to come."""

    def shrink(batches):
        for b in batches:
            z = [pa.compress(x.as_buffer(), codec="zstd", asbytes=True) for x in b.column(b.num_columns - 3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[: -3], pa.array(z, pa.binary()), *b.columns[-2:]], [*b.schema.names[:-3], "z", "tk", "n"])

    rows = keyed(docs, *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-3])
    return rows.mapInArrow(shrink, f"{schema + ', ' if kept else ''}z binary, tk long, n long")


def unpack(z: bytes, n: int) -> bytes:
    return pa.decompress(z, n & SIZE, codec="zstd", asbytes=True) if n & SIZE else b""


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(tk, n, start, stop): byte ranges of each text that repeated windows cover; they may overlap."""
    runs = all_runs(docs)
    again = F.col("span").bitwiseAND(1) == 1
    names = runs.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.max(again).alias("again")).where("times > 1 or again").select("name")
    members = cut(runs.join(names, "name", "left_semi"))
    placed = [F.shiftright("span", 32).alias("x"), F.shiftright("span", AGAIN).bitwiseAND((1 << WINDOWS) - 1).alias("windows")]
    own = ["name", "piece", "more"]
    pieces = cut(members.groupBy(*own).agg(F.count(F.lit(1)).alias("times"), F.max(again).alias("again"), F.first(F.struct("tk", "n", "doc_id", *placed)).alias("one")))
    whole = members.join(pieces.where("times > 1").select(*own), own, "left_semi").select("tk", "n", *placed)
    spans = whole.select("tk", "n", F.col("x").alias("start"), (F.col("x") + F.col("windows") + LENGTH - 1).alias("stop"))
    kinds = pieces.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("times") == 1).alias("single"), F.max("again").alias("again")).where("single > 0 and (kinds > 1 or again)")
    needed = pieces.select("name", "one.*", (F.col("times") == 1).alias("single")).join(kinds.select("name", F.ceil(F.col("kinds") / HOT).cast("int").alias("deal")), "name")
    lists = needed.groupBy("tk", "n", "doc_id").agg(F.collect_list(F.struct("name", "x", "windows", "single", "deal")).alias("wanted"))  # runs of one text
    texts = packed_texts(long_texts(docs), "doc_id")
    met = texts.join(lists.withColumnRenamed("tk", "tk2").withColumnRenamed("n", "n2").withColumnRenamed("doc_id", "d2"), (F.col("tk") == F.col("tk2")) & (F.col("n") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("d2"))).select("tk", "n", "z", "wanted")

    def windows(batches):
        seen = set()
        for b in _bytes.smaller(batches, 2):
            for r in b.to_pylist():
                if (key := (r["tk"], r["n"])) in seen:  # the same row once more
                    continue
                seen.add(key)
                data = np.frombuffer(unpack(r["z"], r["n"]), np.uint8)
                out = []
                for q in r["wanted"]:
                    for at in range(q["x"], q["x"] + q["windows"], _bytes.BLOCK // 2):
                        m = min(_bytes.BLOCK // 2, q["x"] + q["windows"] - at)
                        raw = data[at : at + m + LENGTH - 1].tobytes()
                        row = {"name": q["name"], "part": 0, "tk": r["tk"], "n": r["n"], "single": q["single"], "x": at, "raw": raw}
                        out += [row] if q["deal"] == 1 else dealt(row, q["deal"])
                if out:
                    yield pa.RecordBatch.from_pylist(out, MERGE)

    rest = met.mapInArrow(windows, "name long, part int, tk long, n long, single boolean, x long, raw binary, at binary, told binary").repartition("name", "part")

    def merge(batches):
        held, size = None, 0
        for b in batches:
            held, size = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]), size + b.nbytes
            if size > MERGE_BYTES:  # all but the last (name, part), which may go on
                name, part = held.column("name").to_numpy(), held.column("part").to_numpy()
                whole = int(np.flatnonzero((name != name[-1]) | (part != part[-1]))[-1:].sum()) + 1 if (name[0], part[0]) != (name[-1], part[-1]) else 0
                if whole:
                    yield from merged_windows(held.slice(0, whole))
                    held = held.slice(whole)
                size = 0
        if held is not None:
            yield from merged_windows(held)

    return spans.unionAll(rest.sortWithinPartitions("name", "part").mapInArrow(merge, SPANS))


MERGE = pa.schema([("name", pa.int64()), ("part", pa.int32()), ("tk", pa.int64()), ("n", pa.int64()), ("single", pa.bool_()), ("x", pa.int64()), ("raw", pa.binary()), ("at", pa.binary()), ("told", pa.binary())])


def dealt(row: dict, deal: int) -> list[dict]:
    """A run's windows by their digest's remainder: places and digests instead of the bytes."""
    raw = memoryview(row["raw"])
    told = np.frombuffer(b"".join([hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in range(len(raw) - LENGTH + 1)]), np.uint64).reshape(-1, 2)
    parts = told[:, 0] % np.uint64(deal)
    return [row | {"part": int(p), "raw": None, "at": np.flatnonzero(parts == p).astype("<u4").tobytes(), "told": told[parts == p].tobytes()} for p in np.unique(parts).tolist()]


def merged_windows(t: pa.Table):
    """Spans of the single runs' windows that occur again, from whole groups of (name, part)."""
    names, single = t.column("name").to_numpy(), t.column("single").to_numpy()
    raw, off = _bytes.utf8(t.column("raw"))
    size = np.diff(off)
    held = size > 0
    m = np.where(held, size - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(m)), m)
    at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    place = off[:-1][row] + at  # where each window begins in raw
    dup = repeated_bytes(raw, place, names[row])
    told, told_off = _bytes.utf8(t.column("told"))
    places, _ = _bytes.utf8(t.column("at"))
    k = np.diff(told_off) // 16
    own, spots, told = np.repeat(np.arange(len(k)), k), places.view("<u4").astype(np.int64), told.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((told[:, 1], told[:, 0], names[own]))
    same = (told[order[1:]] == told[order[:-1]]).all(1) & (names[own[order[1:]]] == names[own[order[:-1]]])
    more = np.zeros(len(own), bool)
    more[order[1:][same]] = more[order[:-1][same]] = True
    row, at, dup = np.concatenate([row, own]), np.concatenate([at, spots]), np.concatenate([dup, more])
    dup &= single[row]
    row, at = row[dup], at[dup]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        own = row[first]
        x = t.column("x").to_numpy()[own]
        yield pa.RecordBatch.from_arrays([pa.array(t.column("tk").to_numpy()[own]), pa.array(t.column("n").to_numpy()[own]), pa.array(x + at[first]), pa.array(x + at[last] + LENGTH)], ["tk", "n", "start", "stop"])


def repeated_bytes(raw: np.ndarray, place: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether the window at each place has the bytes of another one of its name; fingerprints only bring them together."""
    out = np.zeros(len(place), bool)
    if len(place) < 2:
        return out
    h = np.concatenate([_bytes.Prefix(raw[a : a + _bytes.BLOCK + LENGTH - 1]).windows(LENGTH) for a in range(0, len(raw) - LENGTH + 1, _bytes.BLOCK)])[place]
    order = np.lexsort((h, name))
    meet = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (name[order[1:]] == name[order[:-1]]))
    every = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    equal = np.zeros(len(meet), bool)
    for a in range(0, len(meet), 1 << 14):
        some = meet[a : a + (1 << 14)]
        equal[a : a + (1 << 14)] = (every[place[order[some]]] == every[place[order[some + 1]]]).all(1)
    good = meet[equal]
    out[order[good]] = out[order[good + 1]] = True
    if not equal.all():  # windows of one fingerprint and other bytes: tell them by their bytes
        group = np.zeros(len(order), np.int64)
        group[1:] = np.cumsum((h[order[1:]] != h[order[:-1]]) | (name[order[1:]] != name[order[:-1]]))
        odd = np.isin(group, group[meet[~equal]])
        seen: dict[tuple[int, bytes], int] = {}
        for g, i in zip(group[odd].tolist(), order[odd].tolist(), strict=True):
            other = seen.setdefault((g, raw[place[i] : place[i] + LENGTH].tobytes()), i)
            if other != i:
                out[i] = out[other] = True
    return out


def covered(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns, z (the compressed text), n, and cuts: the merged [start, stop) byte ranges to remove."""
    prepare(docs.sparkSession)
    spans = repeated_spans(docs).groupBy("tk", "n").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))  # ranges of one text
    short = packed_texts(docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) < LENGTH), *kept)  # nothing to look for
    return packed_texts(long_texts(docs), *kept).join(spans, ["tk", "n"], "left").unionByName(short, allowMissingColumns=True)


def merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def kept_bytes(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Texts are UTF-8 bytes, null ones empty; texts under 200 bytes lose nothing.  A text that occurs twice, repeated rows
    included, is removed whole if it has 200 bytes.  Windows are compared by their bytes, and runs, texts and the windows of
    very frequent tuples by 96 bits or more of a cryptographic hash.  Null doc_ids are kept; other columns are not read.
    """

    def sum_up(batches):
        for b in _bytes.smaller(batches, 1):
            out = []
            for doc, z, n, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "z", "n", "spans")), strict=True):
                cuts = merged(spans)
                removed = sum(y - x for x, y in cuts)
                kept = b"" if removed == n & SIZE else kept_bytes(unpack(z, n), cuts)
                out.append((doc, n & SIZE, removed, len(cuts), hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return covered(docs, "doc_id").select("doc_id", "z", "n", "spans").mapInArrow(sum_up, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated strings removed from text; characters that a cut splits go, null texts stay null.

    Rows with null or repeated doc_ids are treated by their texts; all columns are kept, whatever their names.
    """
    some, back = aside(docs, "doc_id", "text")
    kept = [k for k, c in back.items() if c != "text"]
    some = some.select("doc_id", "text", *kept, F.col("text").isNull().alias("null"))

    def rewrite(batches):
        for b in _bytes.smaller(batches, len(kept) + 1):
            texts = []
            for z, n, spans, null in zip(*(b.column(c).to_pylist() for c in ("z", "n", "spans", "null")), strict=True):
                texts.append(None if null else kept_bytes(unpack(z, n), merged(spans)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    rows = covered(some, *kept, "null").select(*kept, "null", "z", "n", "spans")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(kept)])
    return restored(rows.mapInArrow(rewrite, f"{schema}text string"), {k if c != "text" else "text": c for k, c in back.items()})
