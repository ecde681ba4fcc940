"""Minimax contiguous sharding, with DataFrame functions only.

Groups of equal texts are atomic and ordered by a 128-bit digest of the text.  The smallest capacity under which a
greedy scan cuts that order into the wanted number of shards, a group above it being a shard of its own, is found by
testing many capacities at once: each greedy step of all of them is one look-up in a table of running sums, of which only
the blocks at stake are read.  The stretches between such groups are then cut evenly.  The cuts are digests, so a
document's shard follows from its own text and no join is needed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm._common import delete_path, fresh_path

BLOCKS = 4096  # of running sums; three hexadecimal digits of the digest
TRIES = 256  # capacities that are tested at once
NEAR = 32  # a greedy scan is kept if no shard falls short of the capacity by more than one part in so many


def running_sums(rows: DataFrame) -> DataFrame:
    """digest, size, block, in_block (size of the block's groups up to this one) of every group of equal texts."""
    groups = rows.groupBy("block", "digest").agg(F.sum("size").alias("size"))
    return groups.withColumn("in_block", F.sum("size").over(Window.partitionBy("block").orderBy("digest")))


def cuts(rows: DataFrame, shards: int) -> tuple[list[bytes], int]:
    """The last digest of each shard but the last, and the capacity of all shards but those of one larger group; rows: digest, block, size."""
    spark = rows.sparkSession
    path = fresh_path(spark, "sharding")
    try:
        running_sums(rows).repartitionByRange("block").sortWithinPartitions("block", "digest").write.parquet(path)
        sums = spark.read.parquet(path)
        blocks = sorted(sums.groupBy("block").agg(F.sum("size").alias("size")).collect())  # BLOCKS rows at most
        if not blocks:
            return [], 0
        ids, ends, total = [], [], 0
        for block, size in blocks:
            total += size
            ids.append(block)
            ends.append(total)
        begins = [0, *ends[:-1]]

        def reach(wanted: list[int]) -> list[tuple]:
            """For each wanted sum: the largest running sum up to it and the smallest beyond, each followed by its group's digest."""
            ask, out = [], []
            for k, x in enumerate(wanted):
                b = bisect_right(ends, x)  # first block that ends beyond x
                if b < len(ids):
                    ask.append((k, b, x - begins[b]))
                out.append((ends[b - 1], ids[b - 1], total, ids[-1]) if b else (0, None, total, ids[-1]))
            if ask:
                asked = spark.sql("select * from values " + ", ".join(f"({k}, {ids[b]}, {x}L)" for k, b, x in ask) + " as t(k, block, room)")
                met = sums.where(F.col("block").isin(sorted({ids[b] for _, b, _ in ask}))).join(F.broadcast(asked), "block")
                own, near = F.struct("in_block", "digest"), F.col("in_block") <= F.col("room")
                found = {r["k"]: r for r in met.groupBy("k").agg(F.max(F.when(near, own)).alias("to"), F.min(F.when(~near, own)).alias("next")).collect()}
                for k, b, _ in ask:
                    to, after = found[k]["to"], found[k]["next"]
                    here = (begins[b] + to["in_block"], bytes(to["digest"])) if to else out[k][:2]
                    out[k] = (*here, begins[b] + after["in_block"], bytes(after["digest"]))
            return out

        def scan(tries: list[int]) -> list[list | None]:
            """For each capacity the shards' ends (sum, and digest, or block if it ends one), or None if shards are too few."""
            at, ways = [0] * len(tries), [[] for _ in tries]
            for _ in range(shards):
                found = reach([min(total, a + c) for a, c in zip(at, tries, strict=True)])
                for i, (x, digest, after, after_digest) in enumerate(found):
                    if at[i] < total:
                        ways[i].append((x, digest) if x > at[i] else (after, after_digest))  # a group above the capacity is alone
                        at[i] = ways[i][-1][0]
                if at[0] >= total:
                    break
            return [way if a >= total else None for way, a in zip(ways, at, strict=True)]

        # The groups above the capacity are alone, and the others have at least their mean over the shards left.
        top = [r["size"] for r in sums.orderBy(F.desc("size")).limit(shards).select("size").collect()]
        alone = next(h for h in range(shards) if h >= len(top) or top[h] * (shards - h) <= total - sum(top[:h]) or h == shards - 1)
        low, high = -(-(total - sum(top[:alone])) // (shards - alone)), -(-total // shards) + top[0]
        scans: dict[int, list] = {}  # of capacities that were tested and fit
        while low < high:
            step = max(1, (high - low) // TRIES)
            tries = list(range(low, high, step))[: TRIES + 1]
            ways = scan(tries)
            scans |= {c: way for c, way in zip(tries, ways, strict=True) if way}
            fit = [c for c, way in zip(tries, ways, strict=True) if way]
            high = fit[0] if fit else high
            below = [c for c in tries if c < high and c not in fit]
            low = below[-1] + 1 if below else high
        way = level(scans.get(low) or scan([low])[0], shards, low, reach)[:-1]
        ended = {x for _, x in way if not isinstance(x, bytes)}  # shards that end with a whole block
        last_of = {r["block"]: bytes(r["digest"]) for r in sums.where(F.col("block").isin(sorted(ended))).groupBy("block").agg(F.max("digest").alias("digest")).collect()} if ended else {}
        return [last_of.get(x, x) for _, x in way], low
    finally:
        delete_path(spark, path)


def level(way: list[tuple], shards: int, capacity: int, reach: Callable) -> list[tuple]:
    """The ends of a greedy scan, moved so that each stretch between groups above the capacity is cut evenly and no shard is left over.

    A cut goes to the boundary nearest to an even share of what is left of its stretch, but not before the place from which
    the rest fits the stretch's other shards.  way is kept where all shards but those of one large group are near the capacity.
    """
    fixed, stretches, at = [], [], 0  # ends of large groups; [begin, end, digest of the end, shards]
    smallest = capacity
    for x, digest in way:
        if x - at > capacity:
            fixed.append((x, digest))
        else:
            smallest = min(smallest, x - at)
            if stretches and stretches[-1][1] == at:
                stretches[-1][1:] = [x, digest, stretches[-1][3] + 1]
            else:
                stretches.append([at, x, digest, 1])
        at = x
    if not stretches or (len(way) == shards and smallest * NEAR >= capacity * (NEAR - 1)):
        return way
    for _ in range(shards - len(way)):
        max(stretches, key=lambda s: (s[1] - s[0]) / s[3])[3] += 1
    most = max(k for *_, k in stretches)
    least = [{k: (end, digest)} for _, end, digest, k in stretches]  # the earliest place of each cut
    for back in range(1, most):
        own = [(i, begin, k - back) for i, (begin, _, _, k) in enumerate(stretches) if k > back]
        wanted = [max(begin - 1, least[i][j + 1][0] - capacity - 1) for i, begin, j in own]
        for (i, begin, j), x, (_, _, after, digest) in zip(own, wanted, reach([max(0, x) for x in wanted]), strict=True):
            least[i][j] = (begin, None) if x < begin else (after, digest)
    cut, reached = [], [(begin, None) for begin, *_ in stretches]
    for j in range(1, most):
        own = [(i, end, k) for i, (_, end, _, k) in enumerate(stretches) if k > j and reached[i][0] < end]
        wanted = [reached[i][0] + (end - reached[i][0]) // (k - j + 1) for i, end, k in own]
        for (i, end, _), x, (to, to_digest, after, after_digest) in zip(own, wanted, reach(wanted), strict=True):
            here = reached[i][0]
            further = to <= here or (after - x < x - to and after - here <= capacity)
            reached[i] = max((after, after_digest) if further else (to, to_digest), least[i][j], key=lambda e: e[0])
            if reached[i][0] < end:
                cut.append(reached[i])
    out = sorted([*fixed, *cut, *((end, digest) for _, end, digest, _ in stretches)], key=lambda e: e[0])
    single = set()  # ends of shards that are one group
    while len(out) < shards:  # a stretch had fewer groups than shards: halve the largest shard that can be cut
        sizes = [(x - begin, begin, x) for begin, (x, _) in zip([0, *(x for x, _ in out)], out, strict=False) if x not in single]
        if not sizes:
            break
        size, begin, end = max(sizes)
        ((to, to_digest, after, after_digest),) = reach([begin + size // 2])
        halves = [e for e in ((to, to_digest), (after, after_digest)) if begin < e[0] < end]
        if halves:
            out = sorted([*out, min(halves, key=lambda e: abs(2 * e[0] - begin - end))], key=lambda e: e[0])
        else:
            single.add(end)
    return out


def shard_rows(docs: DataFrame, shards: int = 16, numbered: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, under the law of near-equal bytes.

    Size: UTF-8 bytes of the text plus 1; a null text has size 1, crc32 0, and is in the group of the
    empty texts.  Rows with repeated or null doc_id are placed like any other; an empty table gives no rows.  The largest
    shard is as small as a contiguous cut of the digest order allows, and so is the largest of the shards that aren't one
    group above it.  No shard is empty if there are as many groups as shards.  A stretch of the order between two such groups
    has whole shards, so its shards can be smaller than those of another stretch.  Slots are numbered in parts of some
    ``numbered`` rows.
    """
    rows = docs.select("doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).alias("digest"),
    )
    rows = rows.withColumn("block", F.conv(F.rpad(F.substring(F.hex("digest"), 1, 3), 3, "0"), 16, 10).cast("int"))
    ends, _ = cuts(rows.select("digest", "block", "size"), shards)
    shard = F.lit(0)
    for d in ends:
        shard = shard + (F.col("digest") > F.lit(d)).cast("int")
    buckets = max(64, docs.count() // (shards * numbered))
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int").alias("bucket"))
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.withColumn("ahead", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = placed.withColumn("own", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    return ranked.join(ahead, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("own") - 1 + F.col("ahead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
