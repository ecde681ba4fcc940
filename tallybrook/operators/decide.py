"""Would a blocker have refused a request: list, party, entity and exception tests in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.urls import is_third_party, suffix_chain, url_host
from tallybrook.operators.classify import MOST_LABELS, SMALL_RULES, _sized
from tallybrook.sources.storage import cut

BASE_CATEGORIES = ("Advertising", "Analytics", "Social")  # what the browser blocks by default; strict mode adds Content


RELEASE = 1000  # stage of a version without a letter: behind all letters


def version_key(v: Column) -> Column:
    """Sortable key of a browser version: major, minor, stage and the stage's number; 142.0a1 < 142.0b3 < 142.0."""
    words = F.split(F.trim(v), r"\.")
    minor = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    leading = lambda c: F.coalesce(F.regexp_extract(c, r"^\d+", 0).try_cast("int"), F.lit(0))
    tail = F.regexp_replace(minor, r"^\d+", "")
    stage = F.when(tail == "", RELEASE).otherwise(F.ascii(tail))
    return F.array(leading(F.get(words, F.lit(0))), leading(minor), stage, leading(F.substring(tail, 2, 9)))


def applies(expression: Column, version: str) -> Column:
    """All version comparisons that a filter expression joins by && hold; other clauses are ignored; null or empty applies.

    A comparison reads ``env.version|versionCompare("140.0") >= 0``: the sign of the order of both versions against 0.
    """
    ours = version_key(F.lit(version))

    def holds(clause: Column) -> Column:
        theirs = version_key(F.get(F.split(clause, '"'), F.lit(1)))
        sign = F.when(ours < theirs, -1).when(ours > theirs, 1).otherwise(0)
        operator = F.regexp_replace(F.element_at(F.split(clause, r"\)"), -1), r"[\s0]", "")
        told = F.when(operator == "<", sign < 0).when(operator == "<=", sign <= 0).when(operator == ">", sign > 0).when(operator == ">=", sign >= 0).when(operator == "==", sign == 0).when(operator == "!=", sign != 0)
        return F.when(F.contains(clause, F.lit("versionCompare(")), F.coalesce(told, F.lit(True))).otherwise(True)

    return F.coalesce(F.forall(F.split(expression, "&&"), holds), F.lit(True))


def glob_regex(pattern: Column) -> Column:
    """A pattern in which only '*' is a wildcard, as a regular expression."""
    return F.concat(F.lit("(?i)^"), F.regexp_replace(F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*", ".*"), F.lit("$"))


def literal_suffix(pattern: Column) -> Column:
    """The host part of a URL pattern behind its last wildcard label, if it has two labels or more: a join key."""
    host = F.regexp_extract(F.lower(pattern), r"^[^/]*://([^/]*)", 1)
    tail = F.regexp_replace(host, r"^.*\*\.?", "")
    return F.when(tail.contains("."), tail)


def url_keys(url: Column, grams: bool) -> Column:
    """What patterns without a literal host are looked up by: a URL's words ("t:"), and its runs of three characters ("g:")."""
    low = F.lower(url)
    words = F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0), lambda t: F.concat(F.lit("t:"), t))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.concat(F.lit("g:"), F.substring(low, i, F.lit(3))))
    return F.array_distinct(F.concat(words, runs) if grams else words)


def pattern_keys(pattern: Column) -> Column:
    """Keys that every URL of a pattern has: its whole words, or without one all runs of three of its literal characters."""
    low = F.lower(pattern)
    words = F.transform(F.regexp_extract_all(low, F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), 0), lambda t: F.concat(F.lit("t:"), t))
    parts = F.filter(F.split(low, r"\*"), lambda p: F.length(p) >= 3)
    runs = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.concat(F.lit("g:"), F.substring(p, i, F.lit(3))))))
    return F.array_distinct(F.when(F.size(words) > 0, words).otherwise(runs))


def indexed(exceptions: DataFrame, urls: DataFrame) -> tuple[DataFrame, bool]:
    """exceptions plus key_, and whether runs of characters are among the keys.

    A literal host's suffix is the key ("h:"); else, of the keys that the pattern's URLs must have, the one that fewest of
    the asked URLs have.  Only patterns of no three literal characters in a row have none, and meet every URL ("*").
    """
    host = literal_suffix(F.col("url_pattern"))
    loose = exceptions.where(host.isNull()).select("exception_id", F.explode(pattern_keys(F.col("url_pattern"))).alias("key_"))
    grams = bool(loose.where(F.col("key_").startswith("g:")).limit(1).collect())
    wanted = loose.select("key_").distinct()
    held = urls.select("url").distinct().select(F.explode(url_keys(F.col("url"), grams)).alias("key_")).join(_sized(wanted), "key_", "left_semi").groupBy("key_").agg(F.count(F.lit(1)).alias("n_"))
    best = loose.join(held, "key_", "left").groupBy("exception_id").agg(F.min(F.struct(F.coalesce("n_", F.lit(0)).alias("n_"), "key_"))["key_"].alias("rare_"))
    return exceptions.join(best, "exception_id", "left").withColumn("key_", F.coalesce(F.concat(F.lit("h:"), host), "rare_", F.lit("*"))).drop("rare_"), grams


def listed_hosts(rules: DataFrame, strict: bool = False) -> DataFrame:
    """Hosts that the categories in force name; path-scoped entries never match a host."""
    wanted = (*BASE_CATEGORIES, "Content") if strict else BASE_CATEGORIES
    return rules.where(F.col("category").isin(*wanted) & ~F.col("pattern").contains("/")).select(F.lower("pattern").alias("listed")).distinct()


def active_exceptions(exceptions: DataFrame, version: str, private_browsing: bool = True, categories: tuple[str, ...] = ("baseline", "convenience")) -> DataFrame:
    """Exceptions in force: by version, private browsing and tier."""
    return exceptions.where(applies(F.col("filter_expression"), version) & F.coalesce(F.col("category"), F.lit("baseline")).isin(*categories) & (F.lit(private_browsing) | ~F.coalesce(F.col("private_only"), F.lit(False))))


def decide(requests: DataFrame, listed: DataFrame, entities: DataFrame, exceptions: DataFrame, skip_hosts: DataFrame) -> DataFrame:
    """requests (url, page_url) plus would_block and reason.

    listed: listed; entities: resource, property; exceptions: url_pattern, top_pattern, category (in force); skip_hosts:
    pattern.  List, party, entity and skip tests are made once for each pair of hosts, on host suffixes; the pairs are
    broadcast after a check of their number.  Exceptions of a literal host are then looked up by each request that is left,
    for each number of labels of such a host; only those without one, or too many, are met by pairs of URL and page.
    """
    columns = requests.columns
    rows = requests.withColumns({"host_": F.lower(url_host(F.col("url"))), "page_": F.lower(url_host(F.col("page_url")))})
    pairs = rows.groupBy("host_", "page_").agg(F.lit(1).alias("one_")).drop("one_")
    base = host_reasons(cut(pairs), listed, entities, skip_hosts).withColumnsRenamed({"host_": "host_b_", "page_": "page_b_"})
    met = F.col("host_").eqNullSafe(F.col("host_b_")) & F.col("page_").eqNullSafe(F.col("page_b_"))
    out = rows.join(_sized(cut(base)), met, "left").drop("host_b_", "page_b_")
    shown = exceptions.withColumns({"url_re_": glob_regex(F.col("url_pattern")), "top_re_": F.when(F.col("top_pattern").isNotNull(), glob_regex(F.col("top_pattern"))), "of_": literal_suffix(F.col("url_pattern"))})
    plain = shown.where(F.col("of_").isNotNull() & (F.size(F.split("of_", r"\.")) <= MOST_LABELS))
    n, labels = plain.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("of_", r"\.")))).collect()[0]
    if n > SMALL_RULES:
        plain, labels = plain.limit(0), []
    found = []
    own = plain.groupBy("of_").agg(F.collect_list(F.struct("exception_id", "category", "url_re_", "top_re_")).alias("held_"))
    for k in sorted(labels):
        held = F.broadcast(own.select(F.col("of_").alias(f"of_{k}_"), F.col("held_").alias(f"held_{k}_")))
        out = out.join(held, (F.substring_index("host_", ".", -k) == F.col(f"of_{k}_")) & F.col("open_"), "left")
        fits = lambda e: F.rlike(F.col("url"), e["url_re_"]) & (e["top_re_"].isNull() | F.rlike(F.col("page_url"), e["top_re_"]))
        found.append(F.transform(F.filter(f"held_{k}_", fits), lambda e: F.struct(e["exception_id"], e["category"])))
    loose = exceptions if n > SMALL_RULES else shown.where(F.col("of_").isNull() | (F.size(F.split("of_", r"\.")) > MOST_LABELS)).select(*exceptions.columns)
    if not loose.isEmpty():
        out = out.join(loosely_excepted(out.where("open_").select("url", "page_url", "host_").distinct(), loose), ["url", "page_url"], "left")
        found.append(F.when(F.col("loose_").isNotNull(), F.array("loose_")))
    if found:
        all_ = F.concat(*(F.coalesce(c, F.array().cast("array<struct<exception_id: bigint, category: string>>")) for c in (f.cast("array<struct<exception_id: bigint, category: string>>") for f in found)))
        out = out.withColumn("exception_", F.array_min(all_)["category"])
        excepted = F.when(F.col("exception_").isNotNull(), F.concat(F.lit("exception:"), "exception_"))
    else:
        excepted = F.lit(None).cast("string")
    known = F.col("url").isNotNull() & F.col("page_url").isNotNull()
    reason = F.when(known, F.when(F.col("open_"), F.coalesce(excepted, F.lit("blocked"))).otherwise(F.col("base_")))
    return out.withColumn("reason", reason).select(*columns, "reason").withColumn("would_block", F.col("reason") == "blocked")


def host_reasons(pairs: DataFrame, listed: DataFrame, entities: DataFrame, skip_hosts: DataFrame) -> DataFrame:
    """Pairs of hosts (host_, page_) plus base_, the reason that hosts alone give, and open_ where none of them does."""
    hosts = pairs.select("host_").distinct().where("host_ is not null")
    chain = hosts.select("host_", F.explode(suffix_chain(F.col("host_"), 2)).alias("suffix_"))
    on_list = chain.join(_sized(listed), F.col("suffix_") == F.col("listed"), "left_semi").select("host_").distinct().withColumn("listed_", F.lit(True))
    skipped = chain.join(_sized(skip_hosts), F.col("suffix_") == F.lower(F.col("pattern")), "left_semi").select("host_").distinct().withColumn("skip_", F.lit(True))
    own = chain.join(_sized(entities), F.col("suffix_") == F.lower("resource")).select("host_", F.lower("property").alias("property_")).distinct()
    pages = pairs.select("page_").distinct().where("page_ is not null").select("page_", F.explode(suffix_chain(F.col("page_"))).alias("property_"))
    entity_pages = pairs.join(pages, "page_").join(own, ["host_", "property_"], "left_semi").select("host_", "page_").distinct().withColumn("entity_", F.lit(True))
    all_ = pairs.join(on_list, "host_", "left").join(skipped, "host_", "left").join(entity_pages, ["host_", "page_"], "left")
    base = (
        F.when(F.col("listed_").isNull(), "not-listed").when(~is_third_party(F.col("host_"), F.col("page_")), "first-party").when(F.col("entity_").isNotNull(), "same-entity")
        .when(F.col("skip_").isNotNull(), "skip-url")
    )
    return all_.select("host_", "page_", base.alias("base_"), base.isNull().alias("open_"))


def loosely_excepted(pairs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """url, page_url and loose_ (exception_id, category) of the pairs (url, page_url, host_) that an exception meets by its key."""
    keyed, grams = indexed(exceptions, pairs)
    keyed = keyed.withColumns({"url_re_": glob_regex(F.col("url_pattern")), "top_re_": F.when(F.col("top_pattern").isNotNull(), glob_regex(F.col("top_pattern")))})
    suffixes = F.transform(suffix_chain(F.coalesce("host_", F.lit("")), 1), lambda h: F.concat(F.lit("h:"), h))
    asked = pairs.select("url", "page_url", F.explode(F.concat(suffixes, F.coalesce(url_keys(F.col("url"), grams), F.array().cast("array<string>")), F.array(F.lit("*")))).alias("key_"))
    fit = F.expr("url rlike url_re_") & (F.col("top_re_").isNull() | F.expr("page_url rlike top_re_"))
    return asked.join(_sized(keyed), "key_").where(fit).groupBy("url", "page_url").agg(F.min_by(F.struct("exception_id", "category"), "exception_id").alias("loose_"))


def drift(pages: DataFrame, delta: str, touched: str) -> DataFrame:
    """One row: page loads' deltas where something was blocked and where not, the latter's mean as drift of every page, and
    the whole delta in a blocked and a drift part."""
    t, d = F.col(touched), F.col(delta)
    total = lambda where: F.coalesce(F.sum(F.when(where, d)), F.lit(0)).cast("long")
    m = pages.agg(F.count_if(t).alias("n_pages_with_blocks"), F.count_if(~t).alias("n_pages_without_blocks"), F.coalesce(F.sum(d), F.lit(0)).cast("long").alias("measured_delta"), total(t).alias("delta_with_blocks"), total(~t).alias("delta_without_blocks"))
    m = m.withColumn("drift_per_page", F.coalesce(F.try_divide("delta_without_blocks", "n_pages_without_blocks"), F.lit(0.0)))
    moved = F.col("drift_per_page") * F.col("n_pages_with_blocks")
    return m.withColumns({"blocked_part": F.col("delta_with_blocks") - moved, "drift_part": moved + F.col("delta_without_blocks")})
