"""URL classification against a rule list.

The verdict follows from a URL's host and path.  A list of checked size is broadcast and met by each row where it is, one
look-up for each number of labels that a rule's host has; a larger one is joined with the suffix chains of distinct URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions.urls import rule_path, suffix_chain, url_host

#: Which of several categories of a pattern is its primary one, first to last.
PRIORITY = ("Advertising", "Analytics", "Social", "Cryptomining", "FingerprintingInvasive", "Content", "EmailAggressive", "Email", "Anti-fraud", "ConsentManagers", "FingerprintingGeneral")
NOT_BY_DEFAULT = "Content"
SMALL_RULES = 200_000  # merged rules up to this number are broadcast (some 40 MB); more are joined by a shuffle


def priority(category: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), category)
    return F.when(rank > 0, rank - 1).otherwise(len(PRIORITY))


def merge_rules(rules: DataFrame) -> DataFrame:
    """One row for each pattern: host, rule_path (null for host rules), categories, primary category, owner, order.

    rules: entry_id, pattern, category, organization, organization_url.
    """
    rank = F.struct(priority(F.col("category")), F.col("entry_id"))
    low = F.lower("pattern")
    out = rules.groupBy(low.alias("pattern")).agg(
        F.min("entry_id").alias("entry_id"),
        F.transform(F.array_sort(F.collect_set(F.struct(priority(F.col("category")).alias("p"), "category"))), lambda x: x["category"]).alias("categories"),
        F.min_by("category", rank).alias("category"),
        F.min_by("organization", rank).alias("organization"),
        F.min_by("organization_url", rank).alias("organization_url"),
    )
    path = F.when(F.col("pattern").contains("/"), F.substring(F.col("pattern"), F.instr("pattern", "/"), F.length("pattern")))
    return out.select("*", F.substring_index("pattern", "/", 1).alias("rule_host"), path.alias("rule_path"))


def wanted_categories(rules: DataFrame, names: str) -> list[str]:
    """Category names of a comma-separated filter, as the list spells them; unknown or no names are an error."""
    known = {r[0].lower(): r[0] for r in rules.select("category").distinct().collect()}
    asked = [x.strip() for x in names.split(",") if x.strip()]
    if not asked:
        raise ValueError(f"category filter {names!r} does not name any category")
    for x in asked:
        if x.lower() not in known:
            raise ValueError(f"unknown category {x!r}; the list has {', '.join(sorted(known.values()))}")
    return [known[x.lower()] for x in asked]


def allowed(merged: DataFrame, categories: list[str] | None) -> DataFrame:
    """Rules that a filter leaves.  None: all but those that are of the Content category alone."""
    if categories is None:
        return merged.where(F.exists("categories", lambda c: c != NOT_BY_DEFAULT))
    return merged.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))


def _sized(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(SMALL_RULES + 1).count() <= SMALL_RULES else rules


MOST_LABELS = 8  # of a rule's host, for the look-ups of a broadcast list
BEST = ("entry_id", "pattern", "category", "categories", "organization", "organization_url")


def matched(df: DataFrame, rules: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df (with url) plus the struct of the best rule, null where none names the URL; rules: merged and filtered rules.

    ``by``: a column of df with a comma-separated category filter for each row.
    """
    n, labels = rules.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("rule_host", r"\.")))).collect()[0]
    if n > SMALL_RULES or max(labels, default=0) > MOST_LABELS:
        found = match(df, rules, by).withColumnRenamed("match", name)
        return df.join(found, ["url"] + ([by] if by else []), "left").select(*df.columns, name)
    own = rules.groupBy("rule_host").agg(F.sort_array(F.collect_list(F.struct(F.col("rule_path").isNull().alias("last"), "entry_id", "rule_path", F.struct(*BEST).alias("best")))).alias("own"))
    out, found = df.withColumns({"rule_of_host_": F.lower(url_host(F.col("url"))), "rule_of_path_": F.lower(rule_path(F.col("url")))}), []
    for k in sorted(labels, reverse=True):  # the longest suffix first; a host of fewer labels stands for itself
        held = F.broadcast(own.select(F.col("rule_host").alias(f"rule_host_{k}_"), F.col("own").alias(f"rules_{k}_")))
        out = out.join(held, F.substring_index("rule_of_host_", ".", -k) == F.col(f"rule_host_{k}_"), "left")
        found.append(f"rules_{k}_")
    names = F.transform(F.split(F.col(by), ","), lambda x: F.lower(F.trim(x))) if by else None

    def fits(r: Column) -> Column:
        here = r["rule_path"].isNull() | F.startswith(F.col("rule_of_path_"), r["rule_path"])
        return here & F.arrays_overlap(F.transform(r["best"]["categories"], F.lower), names) if by else here

    best = [F.get(F.filter(F.col(c), fits), F.lit(0))["best"] for c in found]
    return out.select(*df.columns, (F.coalesce(*best) if best else F.lit(None)).alias(name))


def match(urls: DataFrame, rules: DataFrame, by: str | None = None) -> DataFrame:
    """url and match (a struct of the best rule) of every different non-null URL that some rule names.

    rules: merged and filtered rules.  The most specific host level wins; at a level a path rule goes before the host
    rule, and path rules go in list order.  ``by``: a column of urls with a comma-separated category filter for each row,
    which then is part of the key.
    """
    keys = ["url"] + ([by] if by else [])
    own = urls.where(F.col("url").isNotNull()).select(*keys).distinct()
    asked = own.select(*keys, F.lower(rule_path(F.col("url"))).alias("path_"), F.posexplode(suffix_chain(F.lower(url_host(F.col("url"))))).alias("depth_", "rule_host"))
    met = asked.join(_sized(rules), "rule_host").where(F.col("rule_path").isNull() | F.expr("startswith(path_, rule_path)"))
    if by:
        names = F.transform(F.split(F.col(by), ","), lambda x: F.lower(F.trim(x)))
        met = met.where(F.arrays_overlap(F.transform("categories", F.lower), names))
    best = F.min_by(F.struct("entry_id", "pattern", "category", "categories", "organization", "organization_url"), F.struct("depth_", F.col("rule_path").isNull(), "entry_id"))
    return met.groupBy(*keys).agg(best.alias("match"))


def with_match(df: DataFrame, rules: DataFrame, name: str = "match", categories: list[str] | None = None, every: bool = False) -> DataFrame:
    """df (with url) plus the best rule's struct, null where no rule names the URL.  every: no category filter at all."""
    merged = merge_rules(rules)
    return matched(df, merged if every else allowed(merged, categories), name)


def is_tracker(df: DataFrame, rules: DataFrame, categories: str | None = None) -> DataFrame:
    """df plus is_tracker: by default categories, or by those of a filter; null for a null URL."""
    wanted = wanted_categories(rules, categories) if categories is not None else None
    flag = F.when(F.col("url").isNotNull(), F.col("match_").isNotNull())
    own = allowed(merge_rules(rules), wanted)
    quick = named(df, own)
    return quick if quick is not None else matched(df, own, "match_").withColumn("is_tracker", flag).drop("match_")


def named(df: DataFrame, rules: DataFrame) -> DataFrame | None:
    """df plus is_tracker, where the list is broadcast: a host's rows carry whether a host rule names it, and its path rules.

    Which rule is best doesn't matter, so none of its columns are carried, and a path is parsed only for hosts of path rules.
    None for a list that is too large.
    """
    n, labels = rules.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("rule_host", r"\.")))).collect()[0]
    if n > SMALL_RULES or max(labels, default=0) > MOST_LABELS:
        return None
    own = rules.groupBy("rule_host").agg(F.bool_or(F.col("rule_path").isNull()).alias("whole"), F.collect_list("rule_path").alias("paths"))
    out, whole, paths = df.withColumn("rule_of_host_", F.lower(url_host(F.col("url")))), F.lit(False), []
    for k in sorted(labels):
        held = F.broadcast(own.select(F.col("rule_host").alias(f"rule_host_{k}_"), F.col("whole").alias(f"whole_{k}_"), F.when(~F.col("whole"), F.col("paths")).alias(f"paths_{k}_")))
        out = out.join(held, F.substring_index("rule_of_host_", ".", -k) == F.col(f"rule_host_{k}_"), "left")
        whole, paths = whole | F.coalesce(f"whole_{k}_", F.lit(False)), [*paths, f"paths_{k}_"]
    out = out.withColumn("whole_", whole)
    if not paths:
        return out.select(*df.columns, F.when(F.col("url").isNotNull(), False).alias("is_tracker"))
    asked = ~F.col("whole_") & F.coalesce(*paths).isNotNull()
    out = out.withColumn("rule_of_path_", F.when(asked, F.lower(rule_path(F.col("url")))))
    under = F.lit(False)
    for c in paths:
        under = under | F.coalesce(F.exists(c, lambda r: F.startswith(F.col("rule_of_path_"), r)), F.lit(False))
    return out.select(*df.columns, F.when(F.col("url").isNotNull(), F.col("whole_") | (asked & under)).alias("is_tracker"))


def is_tracker_by_row(df: DataFrame, rules: DataFrame, filter_column: str) -> DataFrame:
    """The same with a category filter in each row; null where URL or filter is null."""
    flag = F.when(F.col("url").isNotNull() & F.col(filter_column).isNotNull(), F.col("match_").isNotNull())
    return matched(df, merge_rules(rules), "match_", filter_column).withColumn("is_tracker", flag).drop("match_")


def describe(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df plus tracker_category, tracker_categories, tracker_owner, tracker_owner_url, tracker_pattern, tracker_index over
    all categories."""
    m = with_match(df, rules, "match_", every=True)
    return m.select(*df.columns, F.col("match_.category").alias("tracker_category"), F.col("match_.categories").alias("tracker_categories"), F.col("match_.organization").alias("tracker_owner"), F.col("match_.organization_url").alias("tracker_owner_url"), F.col("match_.pattern").alias("tracker_pattern"), F.col("match_.entry_id").alias("tracker_index"))


def keep_matched(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose host, taken as a bare URL, is a tracker."""
    bare = df.select(F.struct("*").alias("row_"), url_host(F.col("url")).alias("url"))
    return matched(bare, allowed(merge_rules(rules), None), "match_").where("match_ is not null").select("row_.*")


def list_info(rules: DataFrame, source: str) -> DataFrame:
    """One row: source, hosts, rules (path rules), categories, organizations."""
    return rules.agg(
        F.lit(source).alias("source"),
        F.count_distinct(F.when(~F.col("pattern").contains("/"), F.lower("pattern"))).alias("hosts"),
        F.count_distinct(F.when(F.col("pattern").contains("/"), F.lower("pattern"))).alias("rules"),
        F.count_distinct("category").alias("categories"),
        F.count_distinct("organization").alias("organizations"),
    )


def domains_by_owner(rules: DataFrame) -> DataFrame:
    """Each organisation's domains."""
    return rules.groupBy("organization").agg(F.array_sort(F.collect_set(F.substring_index(F.lower("pattern"), "/", 1))).alias("domains"))


def same_owner(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """pairs (url, page_url) plus same_owner: the tracker's organisation has a domain that is the page's host or its parent."""
    owned = describe(pairs, rules)
    owner_domains = rules.select("organization", F.substring_index(F.lower("pattern"), "/", 1).alias("domain_")).distinct()
    page = owned.select("tracker_owner", "page_url").distinct().where("tracker_owner is not null")
    asked = page.select("tracker_owner", "page_url", F.explode(suffix_chain(F.lower(url_host(F.col("page_url"))))).alias("domain_"))
    hit = asked.join(_sized(owner_domains), (F.col("tracker_owner") == F.col("organization")) & (asked["domain_"] == owner_domains["domain_"]), "left_semi").select("tracker_owner", "page_url").distinct().withColumn("hit_", F.lit(True))
    return owned.join(hit, ["tracker_owner", "page_url"], "left").select(*pairs.columns, F.coalesce("hit_", F.lit(False)).alias("same_owner"))


def entries_by_pattern(rules: DataFrame, order: list[str]) -> DataFrame:
    """The list's entries without repeats, with their position in an order; a list has some thousand entries."""
    return rules.dropDuplicates(["pattern", "category", "organization"]).withColumn("position", F.row_number().over(Window.orderBy(*order)))
