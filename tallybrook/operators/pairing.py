"""Pairing of a control crawl with a blocking crawl of the same pages, and matching of bags of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions.requests import protection_of
from tallybrook.functions.urls import is_third_party, net_host, strip_query
from tallybrook.operators.classify import is_tracker
from tallybrook.sources.storage import cut

PAGE = ["rep", "page_idx"]


def nth(df: DataFrame, keys: list[str], order: str = "pos", name: str = "k") -> DataFrame:
    """df plus its rows' numbers among those of equal keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def bag_match(blocked: DataFrame, control: DataFrame) -> DataFrame:
    """blocked plus observed_bytes and match_kind (exact, path, unmatched).

    The k-th blocked row of a URL claims the k-th observation of that URL.  A row that is left may claim an observation by
    its URL without query, if the control page saw exactly one such request and nobody has claimed it.
    """
    more = [c for c in blocked.columns if c not in (*PAGE, "pos", "url")]
    asked = blocked.select(*PAGE, "pos", "url", *more, F.lit(True).alias("asked_"), F.lit(None).cast("long").alias("size_"))
    size = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0)).cast("long")
    seen = control.select(*PAGE, "pos", "url", *(F.lit(None).cast(blocked.schema[c].dataType).alias(c) for c in more), F.lit(False).alias("asked_"), size.alias("size_"))
    both = asked.unionByName(seen).repartition(*PAGE).withColumn("path_", strip_query(F.col("url")))  # the only shuffle: a page load is in one place
    same, alike = Window.partitionBy(*PAGE, "url", "k"), Window.partitionBy(*PAGE, "path_")
    both = nth(both, [*PAGE, "url", "asked_"]).withColumns({"both_": (F.count(F.lit(1)).over(same) == 2) & F.col("url").isNotNull(), "exact_": F.max("size_").over(same)})
    left = F.col("asked_") & ~F.col("both_")
    both = both.withColumns({
        "seen_": F.count_if(~F.col("asked_")).over(alike), "taken_": F.count_if(~F.col("asked_") & F.col("both_")).over(alike),
        "alone_": F.max("size_").over(alike), "first_": F.min(F.when(left, F.col("pos"))).over(alike),
    })
    loose = F.when(left & F.col("path_").isNotNull() & (F.col("seen_") == 1) & (F.col("taken_") == 0) & (F.col("pos") == F.col("first_")), F.col("alone_"))
    kind = F.when(F.col("both_"), "exact").when(loose.isNotNull(), "path").otherwise("unmatched")
    return both.where("asked_").select(*blocked.columns, F.when(F.col("both_"), F.col("exact_")).otherwise(loose).alias("observed_bytes"), kind.alias("match_kind"))


def bag_difference(control: DataFrame, other: DataFrame) -> DataFrame:
    """Observations of the control arm beyond those of equal page and URL in the other arm."""
    return nth(control, [*PAGE, "url"]).join(nth(other, [*PAGE, "url"]).select(*PAGE, "url", "k"), [*PAGE, "url", "k"], "left_anti").drop("k")


def arm_cells(obs: DataFrame, rules: DataFrame, arm: str) -> DataFrame:
    """page, arm, size, whether the list names the request, and the hosts of those it doesn't name: all that totals need."""
    size = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0))
    own = is_tracker(obs.select(*PAGE, "url", size.alias("size_")), rules)
    return own.select(*PAGE, F.lit(arm).alias("arm_"), "size_", "is_tracker", F.when(~F.col("is_tracker"), net_host(F.col("url"))).alias("host_"))


def arm_totals(arms: dict[str, DataFrame], pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests, bytes, tracker bytes and unlisted third-party bytes of the page loads that all arms saw; pages: page_idx, page_url.

    The arms' requests meet the pages by a shuffle on the page, behind which a page load's totals need no other one.  The
    pages are as many as the log's, however small their files are, so they aren't broadcast.
    """
    cells = reduce(DataFrame.unionByName, (arm_cells(obs, rules, arm) for arm, obs in arms.items()))
    sized = cells.join(pages.select("page_idx", net_host(F.col("page_url")).alias("page_host_")).hint("merge"), "page_idx")
    third, size = is_third_party(F.col("host_"), F.col("page_host_")), F.col("size_")
    sums = []
    for arm in arms:
        own = F.col("arm_") == arm
        sums += [
            F.count_if(own).alias(f"n_requests_{arm}"), F.sum(F.when(own, size)).alias(f"transfer_bytes_{arm}"),
            F.sum(F.when(own, F.when(F.col("is_tracker"), size).otherwise(0))).alias(f"tracker_bytes_{arm}"),
            F.sum(F.when(own, F.when(~F.col("is_tracker") & third, size).otherwise(0))).alias(f"unlisted_tp_bytes_{arm}"),
        ]
    return sized.groupBy(*PAGE).agg(*sums).where(" and ".join(f"n_requests_{arm} > 0" for arm in arms))


def bytes_saved(control: DataFrame, private: DataFrame) -> DataFrame:
    """The same column of paired_pages by itself: one shuffle of sums by page load, no URL is parsed."""
    size = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0))
    none = F.lit(None).cast("long")
    sides = control.select(*PAGE, size.cast("long").alias("x_"), none.alias("y_")).unionByName(private.select(*PAGE, none.alias("x_"), size.cast("long").alias("y_")))
    return sides.groupBy(*PAGE).agg(F.sum("x_").alias("x_"), F.sum("y_").alias("y_")).where("x_ is not null and y_ is not null").select(*PAGE, (F.col("x_") - F.col("y_")).alias("bytes_saved"))


def touched_pages(control: DataFrame, private: DataFrame, blocked: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns of paired_pages that need neither a page's host nor a match of requests: requests, bytes, tracker bytes, their
    differences, and blocked requests.

    Requests of both arms and blocked ones are added up by page load where they are; only the sums are shuffled.
    """
    size = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0)).cast("long")
    cells = [is_tracker(obs.select(*PAGE, "url", size.alias("size_")), rules).select(*PAGE, F.lit(arm).alias("arm_"), "size_", F.col("is_tracker").alias("flag_")) for arm, obs in (("normal", control), ("private", private))]
    cells.append(blocked.select(*PAGE, F.lit("blocked").alias("arm_"), F.lit(None).cast("long").alias("size_"), (protection_of(F.col("failure")) == "tracking").alias("flag_")))
    sums, arm, flag = [], F.col("arm_"), F.col("flag_")
    for name in ("normal", "private"):
        sums += [F.count_if(arm == name).alias(f"n_requests_{name}"), F.sum(F.when(arm == name, F.col("size_"))).alias(f"transfer_bytes_{name}"), F.sum(F.when(arm == name, F.when(flag, F.col("size_")).otherwise(0))).alias(f"tracker_bytes_{name}")]
    sums += [F.count_if((arm == "blocked") & flag).alias("n_blocked_tracking"), F.count_if((arm == "blocked") & ~flag).alias("n_blocked_other")]
    both = reduce(DataFrame.unionByName, cells).groupBy(*PAGE).agg(*sums).where("n_requests_normal > 0 and n_requests_private > 0")
    return both.withColumns({name: F.col(f"{width}_normal") - F.col(f"{width}_private") for width, name in (("n_requests", "n_requests_delta"), ("transfer_bytes", "bytes_saved"), ("tracker_bytes", "bytes_saved_tracking"))})


def paired_pages(control: DataFrame, private: DataFrame, blocked: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each page and repetition that both arms saw: both totals, their differences and the blocked requests."""
    matched = bag_match(blocked, control).withColumn("protection", protection_of(F.col("failure")))
    per_page = matched.groupBy(*PAGE).agg(
        F.count_if(F.col("protection") == "tracking").alias("n_blocked_tracking"), F.count_if(F.col("protection") != "tracking").alias("n_blocked_other"),
        F.coalesce(F.sum("observed_bytes"), F.lit(0)).alias("blocked_observed_bytes"), F.count("observed_bytes").alias("blocked_matched"),
        F.count_if(F.col("match_kind") == "unmatched").alias("blocked_unmatched"),
    )
    both = arm_totals({"normal": control, "private": private}, pages, rules).join(per_page.hint("merge"), PAGE, "left").na.fill(0)
    for width, name in (("n_requests", "n_requests_delta"), ("transfer_bytes", "bytes_saved"), ("tracker_bytes", "bytes_saved_tracking"), ("unlisted_tp_bytes", "bytes_saved_unlisted_tp")):
        both = both.withColumn(name, F.col(f"{width}_normal") - F.col(f"{width}_private"))
    return both.withColumn("pct_bytes_saved", F.when(F.col("transfer_bytes_normal") != 0, F.round(100.0 * F.col("bytes_saved") / F.col("transfer_bytes_normal"), 2)))


def redirects(entries: DataFrame, pages: DataFrame, hops: int = 10) -> DataFrame:
    """pages (page_idx, url) plus final_url: redirects followed within the page, hops at most; the first redirect of a URL counts."""
    step = cut(entries.where("redirect_url is not null and redirect_url <> ''").groupBy("page_idx", F.col("url").alias("final_url")).agg(F.min_by("redirect_url", "pos").alias("next_")))
    done, open_ = None, pages.withColumn("final_url", F.col("url"))
    for hop in range(hops):
        met = open_.join(step, ["page_idx", "final_url"], "left")
        ended = met.where("next_ is null").select(*pages.columns, "final_url")
        open_ = cut(met.where("next_ is not null").select(*pages.columns, F.col("next_").alias("final_url")))
        done = ended if done is None else done.unionByName(ended)
        if open_.isEmpty():  # no page has gone on
            return done
    return done.unionByName(open_) if done is not None else open_


def graded(asked: DataFrame, blocked_keys: DataFrame, seen_keys: DataFrame, key: list[str]) -> DataFrame:
    """asked plus truth: true where the private arm blocked the key, false where it loaded it; others are dropped."""
    out = asked.join(blocked_keys.select(*key).distinct().withColumn("b_", F.lit(True)), key, "left").join(seen_keys.select(*key).distinct().withColumn("s_", F.lit(True)), key, "left")
    return out.where("b_ or s_").select(*asked.columns, F.coalesce("b_", F.lit(False)).alias("truth"))


def unpivoted(cells: DataFrame, kept: list[str], widths: tuple[str, ...] = ("page", "third_party", "listed")) -> DataFrame:
    """Ablation rows by width: control, ablated, own and diff = control - ablated - own bytes."""
    stacked = ", ".join(f"'{w}', control_{w}, ablated_{w}, own_{w}" for w in widths)
    return cells.selectExpr(*kept, f"stack({len(widths)}, {stacked}) as (width, control_bytes, ablated_bytes, own_bytes)").withColumn("diff_bytes", F.col("control_bytes") - F.col("ablated_bytes") - F.col("own_bytes"))


def by_width(obs: DataFrame, listed: Column, page_url: Column, size: Column) -> DataFrame:
    """Bytes by page of all, third-party and listed requests."""
    third = is_third_party(net_host(F.col("url")), net_host(page_url))
    return obs.groupBy(*PAGE).agg(F.sum(size).alias("page"), F.sum(F.when(third, size).otherwise(0)).alias("third_party"), F.sum(F.when(listed, size).otherwise(0)).alias("listed"))


def candidate_hosts(asked: DataFrame, ever_blocked: DataFrame, page: list[str], size: Column, most: int) -> DataFrame:
    """page, host, bytes and rank: hosts worth a page's follow-up loads, by their bytes on it.

    asked: requests with host and qualifies (listed, third-party and of a cascading type); ever_blocked: host.
    """
    hosts = asked.groupBy(*page, "host").agg(F.sum(size).alias("bytes"), F.max("qualifies").alias("qualifies")).where("qualifies")
    known = hosts.join(ever_blocked.select("host").distinct(), "host", "left_semi")
    best = Window.partitionBy(*page).orderBy(F.desc("bytes"), "host")
    return known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(*page, "host", "bytes", "rank")


def joint_ratio(cells: DataFrame, by: list[str], kind: str, value: str) -> DataFrame:
    """By page: the number of single cells, and the joint cells' value over the sum of the singles'; pages of two singles or more."""
    of = lambda k: F.sum(F.when(F.col(kind) == k, F.col(value)))
    g = cells.groupBy(*by).agg(F.count_if(F.col(kind) == "single").alias("n_singles"), of("joint").cast("double").alias("joint"), of("single").alias("singles"))
    return g.where("n_singles >= 2 and joint is not null").select(*by, "n_singles", F.try_divide("joint", "singles").alias("ratio"))
