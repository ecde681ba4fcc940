"""The prefix trie of conversations, by fixed-length blocks of turns.

1. Turns are numbered along their conversations by ranges, so a conversation of any length is spread over tasks.
2. BLOCK turns make a block, BLOCK blocks a block of the next level, and so on.  Going down again, each block gets the
   digest of all that comes before it (its start) from its parent's start and the digests of its elder siblings.  All
   groups hold at most BLOCK rows, and the number of levels is a logarithm of the longest conversation.
3. Conversations are grouped by (start, block digest).  Where blocks of one start and one first turn differ, their turns
   are grouped one by one (the refinement); every other block's turns have its members, and need no grouping.
4. Sums over subtrees are sums over members: a node is its least member's; a conversation stands in others' nodes up to
   the depth where its own begin, and ends in a leaf of its own or not.  Both numbers are added up along steps 3.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm._common import cut, prepare, shuffle_width

BLOCK = 8
SALTS = 16  # tasks that the blocks of one start and first turn are dealt to
CHUNK = 1 << 16  # conversation ids that are written into one string at a time
ROOT = "root"
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def told(*parts) -> F.Column:
    """128 bits of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and words of every turn, in the order of turn (null first), then of role and text.

    Null roles and texts are empty ones.  Rows without conv_id belong to no conversation.
    """
    spark = conversations.sparkSession
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = told(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    spread = rows.repartitionByRange(shuffle_width(spark), *order[:2]).sortWithinPartitions(*order)  # the driver samples numbers, no texts
    placed = cut(spread.select("conv_id", digest.alias("digest"), words.alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    pieces = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    offsets = pieces.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first: (turns, conversations with their length).

    Of conversation c, h = crc32(c) % most turns come from conversation c - c % family, all if it has fewer, none if it is
    absent; c's own turns after its first h follow.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", (F.col("own") + 1).alias("own"))
    source = F.col("conv_id") - F.col("conv_id") % family
    convs = convs.withColumns({"source": source, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    sizes = convs.select(F.col("conv_id").alias("source"), F.col("own").alias("there"))
    convs = cut(convs.join(sizes, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    lent = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "source")
    first = convs.join(lent, "source").where("pos < taken").select("conv_id", "pos", "digest", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return first.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))


def started(turns: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """Blocks of turns: conv_id, b, turns (digest and words in order), and start and end, digests of the prefixes there.

    words_before is the sum of words before the block.  end is null where the block isn't full.
    """
    up = lambda df, below: df.groupBy("conv_id", F.floor(F.col(below) / block).cast("long").alias("b"))
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    blocks = up(turns, "pos").agg(ordered("pos", "digest", "words").alias("kids"))  # at most block turns
    summed = {"digest": told(F.lit("b"), F.concat_ws("", F.col("kids.digest"))), "words": F.aggregate("kids.words", F.lit(0).cast("long"), lambda a, x: a + x)}
    levels = [cut(blocks.withColumns(summed))]
    reach = block
    while reach < longest:
        levels.append(up(levels[-1], "b").agg(ordered("b", "digest", "words").alias("kids")).withColumns(summed))
        reach *= block
    known = levels[-1].select("conv_id", "b", "kids", F.lit(ROOT).alias("start"), F.lit(None).cast("string").alias("end"), F.lit(0).cast("long").alias("words_before"))
    for below in levels[-2::-1]:
        step = F.aggregate("kids", F.array(F.struct(F.col("start").alias("at"), F.col("words_before").alias("w"))), lambda a, x: F.concat(a, F.array(F.struct(told(F.lit("p"), F.element_at(a, -1)["at"], x["digest"]).alias("at"), (F.element_at(a, -1)["w"] + x["words"]).alias("w")))))
        each = known.withColumn("steps", step).select("conv_id", F.col("b").alias("over"), F.col("end").alias("over_end"), "steps", F.posexplode("kids"))
        i = F.col("pos")
        end = F.when((i == block - 1) & F.col("over_end").isNotNull(), F.col("over_end")).otherwise(F.get("steps", i + 1)["at"])
        each = each.select("conv_id", F.col("col")["b"].alias("b"), F.get("steps", i)["at"].alias("start"), end.alias("end"), F.get("steps", i)["w"].alias("words_before"))
        known = below.select("conv_id", "b", "kids").join(each, ["conv_id", "b"])
    top = len(levels) == 1  # one block each: full ones end where a chain of one block ends
    full = F.size("kids") == block
    end = F.when(full, told(F.lit("p"), F.col("start"), told(F.lit("b"), F.concat_ws("", F.col("kids.digest")))) if top else F.col("end"))
    return known.select("conv_id", "b", "start", end.alias("end"), "words_before", F.transform("kids", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def chained(blocks: DataFrame) -> DataFrame:
    """The nodes of each block, in order: name, words of the turn and before it.  A full block's last node is its end."""
    grow = F.aggregate("turns", F.array(F.struct(F.col("start").alias("name"), F.lit(0).cast("long").alias("words"), F.col("words_before").alias("before"))), lambda a, x: F.concat(a, F.array(F.struct(told(F.lit("t"), F.element_at(a, -1)["name"], x["digest"]).alias("name"), x["words"].alias("words"), (F.element_at(a, -1)["before"] + F.element_at(a, -1)["words"]).alias("before")))))
    nodes = F.transform(F.slice(F.col("grown"), 2, F.size("turns")), lambda x, i: F.struct(F.when(F.col("end").isNotNull() & (i == F.size("turns") - 1), F.col("end")).otherwise(x["name"]).alias("name"), x["words"].alias("words"), x["before"].alias("before")))
    return blocks.withColumn("grown", grow).withColumn("nodes", nodes).drop("grown")


def nodes_of(blocks: DataFrame, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Nodes below the root: name, parent, depth, words, before, n, least (the least member and its own columns), length
    (of the longest member), and the sums over members.

    Blocks are grouped whole; only those that share start and first turn with a different block are refined by turn.
    """
    digest = told(F.concat_ws("", F.col("turns.digest")))
    totals = [F.sum(c).alias(c) for c in sums]
    whole = blocks.groupBy("start", digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("least"), F.max("length").alias("length"), *totals, F.any_value(F.struct("b", "end", "words_before", "turns")).alias("one"))
    whole = cut(whole.select("start", "digest", F.col("one.turns")[0]["digest"].alias("opening"), "n", "least", "length", *sums, "one.b", "one.end", "one.words_before", "one.turns"))
    split = whole.groupBy("start", "opening").agg((F.min("digest") != F.max("digest")).alias("split")).where("split")  # siblings that diverge inside the block
    salt = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a first turn may open a third of all
    marked = chained(whole.withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALTS))).join(salt, ["start", "opening", "salt"], "left"))
    each = marked.select("start", "split", "b", "n", "least", "length", *sums, "nodes", F.posexplode("nodes"))
    each = each.select("split", (F.col("b") * block + F.col("pos") + 1).alias("depth"), F.col("col.name").alias("name"), F.when(F.col("pos") == 0, F.col("start")).otherwise(F.get("nodes", F.col("pos") - 1)["name"]).alias("parent"), F.col("col.words").alias("words"), F.col("col.before").alias("before"), "n", "least", "length", *sums)
    plain = each.where("split is null").drop("split")
    refined = each.where("split").groupBy("name").agg(*(F.any_value(c).alias(c) for c in ("parent", "depth", "words", "before")), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("length").alias("length"), *totals)
    return plain.unionByName(refined)


def ends_of(ended: DataFrame) -> DataFrame:
    """name and ends_sha256: the digest of the ids of a node's conversations, ascending, with commas.

    Ids are written into strings by ranges of (name, id); a node's strings then pass one task as a stream, never together.
    """
    spark = ended.sparkSession
    width = shuffle_width(spark)

    def write(batches):
        name, ids = None, []
        row = lambda: pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([ids[0]], pa.int64()), "text": [",".join(map(str, ids))]})
        for b in batches:
            for x, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (x != name or len(ids) >= CHUNK):
                    yield row()
                    ids = []
                name = x
                ids.append(i)
        if ids:
            yield row()

    def digest(batches):
        name, sha = None, None
        row = lambda: pa.RecordBatch.from_pydict({"name": [name], "ends_sha256": [sha.hexdigest()]})
        for b in batches:
            for x, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x != name:
                    if sha:
                        yield row()
                    name, sha = x, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
        if sha:
            yield row()

    strings = ended.repartitionByRange(width, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(write, "name string, first long, text string")
    return strings.repartition(width, "name").sortWithinPartitions("name", "first").select("name", "text").mapInArrow(digest, "name string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the prefix trie of conversations (turns: conv_id, pos, digest, words; convs: conv_id, length).

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Equal
    conversations share all nodes; turnless ones are members of the root alone; without conversations there is no node.
    """
    prepare(turns.sparkSession)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    least, n, longest = root.first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n:
        return turns.sparkSession.createDataFrame([], schema)
    blocks = cut(started(turns, longest, block).join(convs, "conv_id"))
    first = cut(nodes_of(blocks.withColumn("own", F.struct("conv_id")), {}, block).select(F.col("least.conv_id").alias("conv_id"), "depth", "before", (F.col("length") == F.col("depth")).alias("leaf")))
    # a conversation's nodes begin where `before` words precede; up to there it shares others' nodes
    reps = first.groupBy("conv_id").agg(F.min("before").alias("shared"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    words = blocks.groupBy("conv_id").agg(F.max(F.col("words_before") + F.aggregate("turns.words", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all"))
    members = cut(convs.join(words, "conv_id", "left").join(reps, "conv_id", "left").select("conv_id", "length", F.coalesce("shared", "all", F.lit(0)).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    told_blocks = blocks.join(members.select("conv_id", "shared", "leaf"), "conv_id").withColumn("own", F.struct("conv_id", "shared"))
    nodes = nodes_of(told_blocks, {"shared": "", "leaf": ""}, block)
    nodes = cut(nodes.select("name", "parent", "depth", F.col("least.conv_id").alias("conv_id"), "n", F.col("leaf").alias("n_leaves"), (F.col("shared") - F.col("least.shared") - (F.col("n") - 1) * F.col("before")).alias("saved")))
    top = members.agg(F.sum("leaf").alias("leaf"), F.sum("shared").alias("shared"), F.max("length").alias("longest")).first()
    only = members.sparkSession.createDataFrame([(ROOT, None, 0, least, n, top["leaf"] if top["longest"] else 1, top["shared"])], "name string, parent string, depth long, conv_id long, n long, n_leaves long, saved long")
    every = nodes.unionByName(only)
    kids = nodes.select(F.col("parent").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    last = F.struct("b", "end", "turns", "start", "words_before")
    tails = chained(blocks.where(F.floor((F.col("length") - 1) / block) == F.col("b")).select("conv_id", last.alias("x")).select("conv_id", "x.*"))
    ended = tails.select(F.element_at("nodes", -1)["name"].alias("name"), "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("name"), "conv_id"))
    out = every.join(kids, "name", "left").join(ends_of(cut(ended)), "name", "left")
    deep = out.where("depth > 1").join(parents, "parent", "left")  # the root's children, however many, need no join
    flat = out.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)))
    cast = lambda c, name: F.col(c).cast("long").alias(name)
    return deep.unionByName(flat, allowMissingColumns=True).select(
        "conv_id", cast("depth", "depth"), cast("parent_conv_id", "parent_conv_id"), cast("n", "n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        cast("n_leaves", "n_leaves"), cast("saved", "saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"),
    )


def family_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations rebuilt within their families; other columns are not read.  See trie() and rebuilt()."""
    turns, convs = rebuilt(numbered_turns(conversations))
    return trie(cut(turns), cut(convs), block)
