"""Decisions with patterns of all kinds against brute force, and the drift's parts."""

import itertools
import random
import re

from pyspark.sql import functions as F

from tallybrook.operators import decide as D
from tallybrook.operators import simulate as M
from tallybrook.sources import readers as X
from tallybrook.sources.storage import scratch

PATTERNS = ["*://*.one.example/*", "*://*/tag/*", "*track*", "*://*/*.js?v=*", "*", "*a*", "*://cdn.one.example/x/*", "*/PIXEL.gif", "https://*/é*", "*://*/a*/lib/*", "*?id=7"]


def test_patterns_by_key_equal_all_patterns(spark):
    rng = random.Random(2)
    hosts, paths = ["cdn.one.example", "one.example", "two.example", "x.two.example:8080"], ["/tag/js", "/x/track1", "/lib/a.js?v=2", "/pixel.gif", "/é/x", "/ab/lib/q", "/", "", "/x?id=7", "/x?ID=7", "/tagged/"]
    urls = [f"https://{h}{p}" for h, p in itertools.product(hosts, paths)] + ["", "no url"]
    for n in (3, len(PATTERNS)):
        own = rng.sample(PATTERNS, n)
        exceptions = spark.createDataFrame([(k, p, None, f"c{k}") for k, p in enumerate(own)], "exception_id int, url_pattern string, top_pattern string, category string")
        requests = spark.createDataFrame([(u, "https://page.example/") for u in [*urls, *urls[:3]]], "url string, page_url string")
        listed = spark.createDataFrame([("one.example",), ("two.example",)], "listed string")
        none = spark.createDataFrame([], "resource string, property string")
        found = D.decide(requests, listed, none, exceptions, spark.createDataFrame([], "pattern string")).collect()
        assert len(found) == len(urls) + 3
        for r in found:
            hit = [k for k, p in enumerate(own) if re.fullmatch(".*".join(map(re.escape, p.split("*"))), r["url"], re.IGNORECASE | re.DOTALL)]
            if r["reason"] not in ("not-listed", "first-party"):
                assert r["reason"] == (f"exception:c{hit[0]}" if hit else "blocked"), (r, own)


def test_every_pattern_with_literals_has_a_key(spark):
    exceptions = spark.createDataFrame([(k, p) for k, p in enumerate(PATTERNS)], "exception_id int, url_pattern string")
    urls = spark.createDataFrame([("https://two.example/tag/lib?id=7",), ("https://two.example/x",)], "url string")
    keys = {r["url_pattern"]: r["key_"] for r in D.indexed(exceptions, urls)[0].collect()}
    assert {p for p, k in keys.items() if k == "*"} == {"*", "*a*"}
    assert keys["*://*.one.example/*"] == "h:one.example" and keys["*://*/tag/*"] == "t:tag" and keys["*track*"][:2] == "g:"


def test_drift_parts_add_up(spark):
    pages = spark.createDataFrame([(10, True), (30, True), (4, False), (6, False), (-1, False)], "delta long, touched boolean")
    r = D.drift(pages, "delta", "touched").first()
    assert (r["measured_delta"], r["drift_per_page"], r["blocked_part"], r["drift_part"]) == (49, 3.0, 34.0, 15.0)
    none = D.drift(pages.where("touched"), "delta", "touched").first()
    assert none["blocked_part"] == 40 and none["drift_part"] == 0


def test_blocks_that_are_not_chosen_are_not_read(spark):
    path = scratch(spark, "blocks")
    X.write_blocks(spark.range(5000).withColumn("x", F.col("id") % 7), path, "id", blocks=16)
    some = X.block_sample(spark, path, 4, "s")
    files = {r[0] for r in some.select("_metadata.file_path").distinct().collect()}
    blocks = {f.split("block=")[1].split("/")[0] for f in files}
    assert 0 < len(blocks) < 16 and some.count() == spark.read.parquet(path).where(F.col("block").isin(*map(int, blocks))).count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(pmod" in plan


def test_subsets_have_exactly_their_size(spark):
    rows = spark.range(1003).select(F.col("id").alias("page"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert {(r["n_pages"], r["ratio"]) for r in M.subsets(rows, "page", 0.25, 5, "x", "y", "s").collect()} == {(251, 0.5)}
    kept = M.least_hashed(rows, [], ["page"], F.lit(10), "s").collect()
    hashed = sorted((r["h"], r["page"]) for r in rows.select("page", M.hash_number(F.lit("s"), "page").alias("h")).collect())
    assert {r["page"] for r in kept} == {p for _, p in hashed[:10]}


def test_requests_are_not_shuffled_for_literal_hosts(spark):
    """Exceptions of literal hosts, entities, skips and nulls: no exchange of the requests, and the reasons of each."""
    rows = [("https://a.one.example/tag/x", "https://p.example/"), ("https://a.one.example/y", "https://p.example/"), ("https://one.example/tag/", "https://sub.one.example/"), ("https://two.example/", "https://own.example/x"), ("https://s.two.example/", "https://p.example/"), ("https://three.example/", "https://p.example/"), (None, "https://p.example/"), ("https://one.example/", None)]
    requests = spark.createDataFrame(rows, "url string, page_url string")
    listed = spark.createDataFrame([("one.example",), ("two.example",)], "listed string")
    entities = spark.createDataFrame([("two.example", "own.example")], "resource string, property string")
    exceptions = spark.createDataFrame([(2, "*://*.one.example/tag/*", None, "late"), (1, "*://a.one.example/tag/*", "*://p.example/*", "early")], "exception_id int, url_pattern string, top_pattern string, category string")
    found = D.decide(requests, listed, entities, exceptions, spark.createDataFrame([("s.two.example",)], "pattern string"))
    assert [r["reason"] for r in found.collect()] == ["exception:early", "blocked", "first-party", "same-entity", "skip-url", "not-listed", None, None]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(url" not in plan
