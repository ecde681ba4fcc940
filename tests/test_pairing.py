"""Plans of the paired crawl at sizes where a table of pages fits no task, and quick forms against the steps they spare."""

import random

from pyspark.sql import functions as F

from tallybrook import plans
from tallybrook.functions import urls as U
from tallybrook.operators import pairing as P
from tallybrook.plans import paired as PP
from tallybrook.sources import fixtures as S

from .conftest import SF


def test_pages_are_not_broadcast(spark):
    plan = PP.paired(spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and not any("page_idx" in line for line in joins)


def test_orders_are_not_broadcast(spark, monkeypatch):
    """F2-F4, F8: the log's derivation meets orders by the shuffle that numbers their items."""
    built = []
    monkeypatch.setattr(S, "_once", lambda spark, sf, name, build: built.append(build()) or built[0])
    plan = S.requests(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_cells_are_derived_once(spark):
    """totals, hosts and cells come from stored cells."""
    for name in ("leave_one_out_table", "host_scales"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "transfer_bytes" not in plan and "page_idx" not in plan
    met = plans.QUERIES["leave_one_out_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in met and "BuildLeft" not in met  # hosts go to the cells, not cells to the hosts


def test_bytes_saved_equal_those_of_pairs(spark):
    """the quick sums, without a URL in their plan."""
    ours, theirs = PP.saved(spark, SF), PP.paired(spark, SF).select(*P.PAGE, "bytes_saved")
    assert ours.count() and not ours.exceptAll(theirs).count() and not theirs.exceptAll(ours).count()
    whole = P.bytes_saved(S.control(spark, SF), S.control(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "url" not in whole and whole.count("Exchange hashpartitioning") == 1


def test_delta_by_reason_needs_no_join_of_rows(spark):
    """arms and decisions meet in one shuffle by page."""
    plan = plans.QUERIES["delta_by_reason"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(page_idx") == 1


def test_private_arm_equals_its_sql(spark):
    ours = S.private(spark, SF)
    theirs = S._derive(spark, S.PRIVATE, control_obs=S.control(spark, SF), blocked=S.blocked(spark, SF)).select(ours.columns)
    assert ours.count() and not ours.exceptAll(theirs).count() and not theirs.exceptAll(ours).count()


def test_ends_of_urls_equal_those_by_expression(spark):
    rng, words = random.Random(1), ["https", "://", "/", "?", "#", "a", "é", " ", "\t", "\n", "\r", "\u00a0", "x.y"]
    urls = ["".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(2000)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert not df.where(~U.trimmed(F.col("url")).eqNullSafe(F.regexp_replace("url", r"^[ \t\n\r]+|[ \t\n\r]+$", ""))).collect()


def test_plain_hosts_equal_those_of_the_long_way(spark):
    rng, words = random.Random(4), ["https", "://", "/", "?", "#", "@", ":", "443", ".", "[", "]", "a", "B-c", "é", " ", "\n", "x.y", "//"]
    urls = ["".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(3000)] + [f"https://{h}{t}" for h in ("a.b", "a.b:80", "a.b.", "a.b:", "u@a.b", "A_b.c:8") for t in ("", "/x", "?q", "#f", "\n", " ")]
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string")
    same = df.select(U.url_host(F.col("url")).alias("quick"), U.any_host(F.col("url")).alias("long"))
    assert same.where("quick is not null").count() > 100 and not same.where("not (quick <=> long)").collect()
    plan = same.select("quick").groupBy("quick").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "_common_expr" not in plan  # nothing of the long way runs for plain URLs


def test_touched_pages(spark):
    """equal to the same columns of the pairs, from one shuffle of sums by page load, without matches or pages."""
    ours = PP.touched(spark, SF)
    theirs = PP.paired(spark, SF).select(*ours.columns)
    assert ours.count() and not ours.exceptAll(theirs).count() and not theirs.exceptAll(ours).count()
    plan = plans.QUERIES["measured_saving"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning(rep") == 1
