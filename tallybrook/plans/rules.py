"""Queries over the classifier and the blocking decision."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybrook.functions import requests as R
from tallybrook.functions import urls as U
from tallybrook.operators import classify as C
from tallybrook.operators import decide as D
from tallybrook.operators import evaluate as V
from tallybrook.operators import pairing as P
from tallybrook.operators.lookup import one_row
from tallybrook.plans.features import LHOST, PATH, rounded
from tallybrook.plans.registry import query
from tallybrook.sources import fixtures as S

#: Best entry of each URL in SQL: candidates by suffix and path prefix, ranked by host depth, path rules first, entry.
_RANK = "CASE category WHEN 'Advertising' THEN 0 WHEN 'Analytics' THEN 1 WHEN 'Social' THEN 2 WHEN 'FingerprintingInvasive' THEN 4 WHEN 'Content' THEN 5 ELSE 10 END"
MERGED = f"""merged AS (SELECT pattern, min(entry_id) AS entry_id, list_sort(list(DISTINCT category)) AS categories, arg_min(category, {_RANK}) AS category, arg_min(organization, {_RANK}) AS organization,
  arg_min(organization_url, {_RANK}) AS organization_url, split_part(pattern, '/', 1) AS rule_host, CASE WHEN contains(pattern, '/') THEN substr(pattern, instr(pattern, '/')) END AS rule_path FROM rules GROUP BY pattern)"""


def matched(where: str, name: str = "best") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT u.url, m.*, row_number() OVER (PARTITION BY u.url ORDER BY length(u.host) - length(m.rule_host), m.rule_path IS NULL, m.entry_id) AS rn
  FROM (SELECT DISTINCT url, {LHOST} AS host, lower({PATH}) AS path FROM requests) u JOIN merged m ON (u.host = m.rule_host OR ends_with(u.host, '.' || m.rule_host)) AND (m.rule_path IS NULL OR starts_with(u.path, m.rule_path)) WHERE {where}) WHERE rn = 1)"""


DEFAULT = "NOT (len(m.categories) = 1 AND m.categories[1] = 'Content')"
WITH_BEST = f"{S.WITH_REQUESTS}, {S.WITH_RULES}, {MERGED}, {matched(DEFAULT)}"
WITH_ALL = f"{S.WITH_REQUESTS}, {S.WITH_RULES}, {MERGED}, {matched('true')}"


@query(f"WITH {WITH_BEST} SELECT coalesce(b.category, 'none') AS category, count(*) AS n, coalesce(sum(transfer_bytes), 0)::BIGINT AS bytes FROM requests r LEFT JOIN best b ON r.url = b.url GROUP BY 1")
def tracker_bytes_by_category(spark, sf):
    """CLS1, AGG14: requests and bytes by the default verdict's category; the flagship query."""
    found = C.with_match(S.requests(spark, sf), S.rules(spark))
    return found.groupBy(F.coalesce("match.category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("bytes"))


@query(f"WITH {WITH_BEST} SELECT r.page_idx, r.pos, b.pattern IS NOT NULL AS is_tracker FROM requests r LEFT JOIN best b ON r.url = b.url")
def is_tracker(spark, sf):
    """CLS1, CLS10: the verdict of every request."""
    return C.is_tracker(S.requests(spark, sf), S.rules(spark)).select("page_idx", "pos", "is_tracker")


def _by(names: str) -> str:
    cond = " OR ".join(f"list_contains(m.categories, '{c}')" for c in names.split(","))
    return f"WITH {S.WITH_REQUESTS}, {S.WITH_RULES}, {MERGED}, {matched(cond)} SELECT r.page_idx, r.pos, b.pattern IS NOT NULL AS is_tracker FROM requests r LEFT JOIN best b ON r.url = b.url"


@query(_by("Social,FingerprintingGeneral"))
def is_tracker_in_categories(spark, sf):
    """CLS2: the verdict within named categories, with fall-through to parents."""
    return C.is_tracker(S.requests(spark, sf), S.rules(spark), " social , FingerprintingGeneral").select("page_idx", "pos", "is_tracker")


@query(f"""WITH {S.WITH_REQUESTS}, {S.WITH_RULES}, {MERGED}, f AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'Content' WHEN 1 THEN 'Advertising,Social' WHEN 2 THEN 'Analytics' END AS wanted FROM requests)
 SELECT page_idx, pos, CASE WHEN wanted IS NOT NULL THEN EXISTS (SELECT 1 FROM merged m WHERE ({LHOST} = m.rule_host OR ends_with({LHOST}, '.' || m.rule_host)) AND (m.rule_path IS NULL OR starts_with(lower({PATH}), m.rule_path)) AND list_has_any(m.categories, string_split(f.wanted, ','))) END AS is_tracker FROM f""")
def is_tracker_by_row(spark, sf):
    """CLS3: a category filter in each row."""
    wanted = F.when(F.col("pos") % 4 == 0, "Content").when(F.col("pos") % 4 == 1, "Advertising,Social").when(F.col("pos") % 4 == 2, "Analytics")
    return C.is_tracker_by_row(S.requests(spark, sf).withColumn("wanted", wanted), S.rules(spark), "wanted").select("page_idx", "pos", "is_tracker")


@query(f"WITH {WITH_ALL} SELECT DISTINCT r.url, b.category AS tracker_category, array_to_string(list_sort(b.categories), '+') AS tracker_categories, b.organization AS tracker_owner, b.organization_url AS tracker_owner_url, b.pattern AS tracker_pattern, b.entry_id AS tracker_index FROM requests r LEFT JOIN best b ON r.url = b.url")
def tracker_descriptions(spark, sf):
    """CLS4-9: category, categories, owner, pattern and entry of each different URL."""
    found = C.describe(S.requests(spark, sf).select("url").distinct(), S.rules(spark))
    return found.withColumn("tracker_categories", F.array_join(F.array_sort("tracker_categories"), "+"))


@query(f"WITH {WITH_ALL} SELECT c.category, count(b.url) AS n FROM (SELECT DISTINCT category FROM rules) c LEFT JOIN (SELECT r.url, b.category FROM requests r JOIN best b ON r.url = b.url) b ON b.category = c.category GROUP BY 1")
def list_categories(spark, sf):
    """CLS11: the categories of the list, each with the requests that it describes; the list is a parameter."""
    own = C.with_match(S.requests(spark, sf), S.rules(spark), every=True).where("match is not null").groupBy(F.col("match.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return S.rules(spark).select("category").distinct().join(own, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {WITH_ALL} SELECT 'invented' AS source, count(DISTINCT CASE WHEN NOT contains(pattern, '/') THEN pattern END) AS hosts, count(DISTINCT CASE WHEN contains(pattern, '/') THEN pattern END) AS rules, count(DISTINCT category) AS categories, count(DISTINCT organization) AS organizations, (SELECT count(DISTINCT pattern) FROM best) AS patterns_met FROM rules")
def list_info(spark, sf):
    """SRC17: one row about the list, with the number of patterns that the log meets."""
    met = C.describe(S.requests(spark, sf).select("url").distinct(), S.rules(spark)).agg(F.count_distinct("tracker_pattern").alias("patterns_met"))
    return one_row(C.list_info(S.rules(spark), "invented"), met)


@query(f"WITH {WITH_BEST} SELECT {LHOST} AS host, count(*) AS n FROM requests r WHERE EXISTS (SELECT 1 FROM merged m WHERE {DEFAULT} AND m.rule_path IS NULL AND ({LHOST} = m.rule_host OR ends_with({LHOST}, '.' || m.rule_host))) GROUP BY 1")
def matched_log(spark, sf):
    """CLS12: the log of matched hosts, classified once for each host."""
    return C.keep_matched(S.requests(spark, sf), S.rules(spark)).groupBy(U.net_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WITH_ALL}, d AS (SELECT DISTINCT organization, split_part(pattern, '/', 1) AS domain FROM rules), n AS (SELECT b.organization, count(*) AS n FROM requests r JOIN best b ON r.url = b.url GROUP BY 1) SELECT organization, string_agg(domain, ',' ORDER BY domain) AS domains, coalesce(any_value(n.n), 0) AS n FROM d LEFT JOIN n USING (organization) GROUP BY organization")
def owner_domains(spark, sf):
    """CLS13: each owner's domains and the requests that go to them."""
    n = C.with_match(S.requests(spark, sf), S.rules(spark), every=True).where("match is not null").groupBy(F.col("match.organization").alias("organization")).agg(F.count(F.lit(1)).alias("n"))
    return C.domains_by_owner(S.rules(spark)).join(n, "organization", "left").select("organization", F.array_join("domains", ",").alias("domains"), F.coalesce("n", F.lit(0)).alias("n"))


_PAGES = "CASE page_idx % 7 WHEN 0 THEN 'https://www.social.example/home' WHEN 1 THEN 'https://guard.example/' ELSE 'https://' || page_domain || '/' END"


def _paged(spark, sf):
    page = F.when(F.col("page_idx") % 7 == 0, "https://www.social.example/home").when(F.col("page_idx") % 7 == 1, "https://guard.example/").otherwise(F.concat(F.lit("https://"), "page_domain", F.lit("/")))
    return S.requests(spark, sf).withColumn("page_url", page)


@query(f"""WITH {WITH_ALL}, p AS (SELECT *, {_PAGES} AS page_url FROM requests), o AS (SELECT DISTINCT organization, split_part(pattern, '/', 1) AS domain FROM rules),
 k AS (SELECT p.url, p.page_url, b.organization, regexp_extract(p.page_url, '^https://([^/]*)', 1) AS ph FROM p LEFT JOIN best b ON p.url = b.url)
 SELECT page_url, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o WHERE o.organization = k.organization AND (k.ph = o.domain OR ends_with(k.ph, '.' || o.domain)))) AS same_owner, count(*) AS n FROM k GROUP BY page_url""")
def same_owner(spark, sf):
    """CLS14: requests whose tracker's owner has the page."""
    return C.same_owner(_paged(spark, sf).select("url", "page_url"), S.rules(spark)).groupBy("page_url").agg(F.count_if("same_owner").alias("same_owner"), F.count(F.lit(1)).alias("n"))


#: The invented lists of the decision: entities, exceptions and hosts that are never blocked.
_ENTITIES = "SELECT * FROM (VALUES ('social.example', 'social.example'), ('metrics.example', 'site3.example'), ('adnet.example', 'site5.example')) AS t(resource, property)"
_EXCEPTIONS = """SELECT * FROM (VALUES (1, '*://*.adnet.example/tag/*', CAST(NULL AS VARCHAR(60)), 'baseline', false, 'env.version|versionCompare("140.0a1") >= 0'), (2, '*://px.metrics.example/*', '*://www.site7.example/*', 'convenience', false, CAST(NULL AS VARCHAR(60))),
 (3, '*://tag.adnet.example/*', CAST(NULL AS VARCHAR(60)), 'baseline', false, 'env.version|versionCompare("150.0") >= 0'), (4, '*://cdn.metrics.example/*', CAST(NULL AS VARCHAR(60)), 'baseline', true, CAST(NULL AS VARCHAR(60)))) AS t(exception_id, url_pattern, top_pattern, category, private_only, filter_expression)"""
_SKIP = "SELECT * FROM (VALUES ('cdn.metrics.example')) AS t(pattern)"


def decided(spark, sf):
    asked = _paged(spark, sf)
    exceptions = D.active_exceptions(spark.sql(_EXCEPTIONS), "142.0", private_browsing=False)
    return D.decide(asked, D.listed_hosts(S.rules(spark)), spark.sql(_ENTITIES), exceptions, spark.sql(_SKIP))


_L = "(h = 'adnet.example' OR ends_with(h, '.adnet.example') OR h = 'metrics.example' OR ends_with(h, '.metrics.example') OR h = 'social.example' OR ends_with(h, '.social.example'))"
DECIDED = f"""{S.WITH_REQUESTS}, dp AS (SELECT *, {_PAGES} AS page_url, {LHOST} AS h FROM requests), dq AS (SELECT *, regexp_extract(page_url, '^https://([^/]*)', 1) AS ph FROM dp),
 decided AS (SELECT *, CASE WHEN NOT {_L} THEN 'not-listed' WHEN h = ph OR ends_with(h, '.' || ph) OR ends_with(ph, '.' || h) THEN 'first-party'
  WHEN (ends_with(h, 'social.example') AND ends_with(ph, 'social.example')) OR (ends_with(h, 'metrics.example') AND ends_with(ph, '.site3.example')) OR (ends_with(h, 'adnet.example') AND ends_with(ph, '.site5.example')) THEN 'same-entity'
  WHEN h = 'cdn.metrics.example' THEN 'skip-url' WHEN regexp_matches(lower(url), '^[^/]*://.*\\.adnet\\.example/tag/.*$') THEN 'exception:baseline' WHEN regexp_matches(url, '^.*://px\\.metrics\\.example/.*$') AND ph = 'www.site7.example' THEN 'exception:convenience' ELSE 'blocked' END AS reason FROM dq)"""


@query(f"WITH {DECIDED} SELECT reason, count(*) AS n, count(*) FILTER (WHERE reason = 'blocked') AS n_blocked FROM decided GROUP BY reason")
def decision_reasons(spark, sf):
    """CLS15-20, AGG25: which test decided, over all requests."""
    return decided(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("would_block").alias("n_blocked"))


@query(f"""WITH {DECIDED}, t AS (SELECT *, (page_idx % 3 <> 0 AND ({LHOST} LIKE '%adnet.example' OR h LIKE '%metrics.example')) AS truth FROM decided),
 c AS (SELECT count(*) FILTER (WHERE reason = 'blocked' AND truth) AS tp, count(*) FILTER (WHERE reason = 'blocked' AND NOT truth) AS fp, count(*) FILTER (WHERE reason <> 'blocked' AND truth) AS fn, count(*) FILTER (WHERE reason <> 'blocked' AND NOT truth) AS tn,
  coalesce(sum(coalesce(transfer_bytes, 0)) FILTER (WHERE reason = 'blocked' AND truth), 0)::BIGINT AS tp_bytes, coalesce(sum(coalesce(transfer_bytes, 0)) FILTER (WHERE reason = 'blocked' AND NOT truth), 0)::BIGINT AS fp_bytes, coalesce(sum(coalesce(transfer_bytes, 0)) FILTER (WHERE reason <> 'blocked' AND truth), 0)::BIGINT AS fn_bytes, coalesce(sum(coalesce(transfer_bytes, 0)) FILTER (WHERE reason <> 'blocked' AND NOT truth), 0)::BIGINT AS tn_bytes FROM t)
 SELECT *, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def decision_scores(spark, sf):
    """AGG24, PAIR5: precision and recall of the decision against what was blocked."""
    truth = (F.col("page_idx") % 3 != 0) & (U.net_host(F.col("url")).endswith("adnet.example") | U.net_host(F.col("url")).endswith("metrics.example"))
    return rounded(V.confusion(decided(spark, sf), F.col("would_block"), truth, F.coalesce("transfer_bytes", F.lit(0))))


@query(f"""WITH {DECIDED} SELECT h AS host, sum(coalesce(transfer_bytes, 0))::BIGINT AS fp_bytes FROM decided WHERE reason = 'blocked' AND page_idx % 3 = 0 GROUP BY 1 ORDER BY fp_bytes DESC, host LIMIT 15""")
def false_positive_hosts(spark, sf):
    """TOP3: hosts of most bytes that would be blocked in vain."""
    fp = decided(spark, sf).where("would_block and page_idx % 3 = 0")
    return fp.groupBy(U.net_host(F.col("url")).alias("host")).agg(F.sum(F.coalesce("transfer_bytes", F.lit(0))).alias("fp_bytes")).orderBy(F.desc("fp_bytes"), "host").limit(15)


@query(f"""WITH {WITH_ALL}, c AS (SELECT r.url, CASE b.category WHEN 'Advertising' THEN 'ad' WHEN 'Analytics' THEN 'analytics' WHEN 'Social' THEN 'social' WHEN 'Content' THEN 'content' WHEN 'FingerprintingInvasive' THEN 'fingerprinting' ELSE 'other' END || '-' || CASE r.resource_type WHEN 'script' THEN 'script' WHEN 'html' THEN 'frame' WHEN 'image' THEN 'pixel' ELSE 'beacon' END AS role, transfer_bytes FROM requests r LEFT JOIN best b ON r.url = b.url)
 SELECT role, count(*) AS n, coalesce(sum(transfer_bytes), 0)::BIGINT AS bytes FROM c GROUP BY role""")
def tracker_roles(spark, sf):
    """REQ10: requests by family and kind."""
    found = C.with_match(S.requests(spark, sf), S.rules(spark), every=True)
    return found.groupBy(R.tracker_role(F.col("match.category"), R.context_name(F.col("resource_type"))).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("bytes"))


@query(f"""WITH {WITH_BEST}, t AS (SELECT r.page_domain, {LHOST.replace('url', 'r.url')} AS host, coalesce(transfer_bytes, 0) AS y, b.pattern IS NOT NULL AS tr, r.resource_type FROM requests r LEFT JOIN best b ON r.url = b.url)
 SELECT page_domain, sum(y)::BIGINT AS total, sum(CASE WHEN tr THEN y ELSE 0 END)::BIGINT AS tracker, sum(CASE WHEN NOT tr THEN y ELSE 0 END)::BIGINT AS other_third_party, count(DISTINCT CASE WHEN tr THEN host END) AS tracker_hosts FROM t GROUP BY page_domain""")
def page_mass(spark, sf):
    """AGG13, AGG23: a page's bytes by party."""
    found = C.is_tracker(S.requests(spark, sf), S.rules(spark))
    y, third = F.coalesce("transfer_bytes", F.lit(0)), U.is_third_party(U.net_host(F.col("url")), F.col("page_domain"))
    return found.groupBy("page_domain").agg(F.sum(y).alias("total"), F.sum(F.when(F.col("is_tracker"), y).otherwise(0)).alias("tracker"), F.sum(F.when(~F.col("is_tracker") & third, y).otherwise(0)).alias("other_third_party"), F.count_distinct(F.when(F.col("is_tracker"), U.net_host(F.col("url")))).alias("tracker_hosts"))


@query(f"""WITH {S.WITH_PAIRED}, a AS (SELECT DISTINCT rep, page_idx, url FROM control_obs), b AS (SELECT DISTINCT rep, page_idx, url FROM blocked), p AS (SELECT DISTINCT rep, page_idx, url FROM private_obs)
 SELECT a.rep, count(*) FILTER (WHERE b.url IS NOT NULL) AS n_true, count(*) FILTER (WHERE b.url IS NULL) AS n_false FROM a LEFT JOIN b USING (rep, page_idx, url) LEFT JOIN p USING (rep, page_idx, url) WHERE b.url IS NOT NULL OR p.url IS NOT NULL GROUP BY a.rep""")
def graded_requests(spark, sf):
    """JN12: what the private arm blocked, loaded, or never saw."""
    key = ["rep", "page_idx", "url"]
    asked = P.graded(S.control(spark, sf).select(*key).distinct(), S.blocked(spark, sf), S.private(spark, sf), key)
    return asked.groupBy("rep").agg(F.count_if("truth").alias("n_true"), F.count_if(~F.col("truth")).alias("n_false"))


_REASONED = f"{S.WITH_PAIRED}, {DECIDED[len(S.WITH_REQUESTS) + 2 :]}"


@query(f"""WITH {_REASONED}, o AS (SELECT c.rep, c.page_idx, d.reason, greatest(coalesce(c.transfer_size, 0), 0) AS had, greatest(coalesce(p.transfer_size, 0), 0) AS has, p.pos IS NULL AS gone FROM control_obs c JOIN decided d USING (page_idx, pos) LEFT JOIN private_obs p USING (rep, page_idx, pos)),
 t AS (SELECT DISTINCT rep, page_idx, true AS touched FROM blocked WHERE failure LIKE '%TRACKING%') SELECT coalesce(touched, false) AS touched, reason, count(*) AS n, count(*) FILTER (WHERE gone) AS n_gone, coalesce(sum(had) FILTER (WHERE gone), 0)::BIGINT AS gone_bytes, coalesce(sum(had - has) FILTER (WHERE NOT gone), 0)::BIGINT AS changed_bytes FROM o LEFT JOIN t USING (rep, page_idx) GROUP BY 1, 2""")
def delta_by_reason(spark, sf):
    """PAIR5: what the pages saved, on touched and untouched page loads, by the reason of the decision: bytes of requests
    that are gone, and changes of those that stayed; all cells add up to the measured delta."""
    sized = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0)).cast("long")
    key, none = ["page_idx", "rep", "pos"], F.lit(None)
    told = decided(spark, sf).select("page_idx", "pos", F.lit(True).alias("told"), "reason")
    reps = S.control(spark, sf).select("rep").distinct()
    told = told.crossJoin(F.broadcast(reps)).select(*key, none.cast("long").alias("had"), none.cast("long").alias("has"), "told", "reason", F.lit(False).alias("touch"))  # reps: a row for each pass
    row = lambda df, had, has, touch: df.select(*key, had.cast("long").alias("had"), has.cast("long").alias("has"), none.cast("boolean").alias("told"), none.cast("string").alias("reason"), F.lit(touch).alias("touch"))
    all_ = told.unionByName(row(S.control(spark, sf), sized, none, False)).unionByName(row(S.private(spark, sf), none, sized, False)).unionByName(row(S.blocked(spark, sf).where("failure like '%TRACKING%'"), none, none, True))
    o = all_.repartition("page_idx").groupBy(*key).agg(F.max("had").alias("had"), F.max("has").alias("has"), F.max("told").alias("told"), F.max("reason").alias("reason"), F.max("touch").alias("touch"))  # the only shuffle
    o = o.withColumn("touched", F.max("touch").over(Window.partitionBy("page_idx", "rep"))).where("told and had is not null")
    gone = F.col("has").isNull()
    total = lambda c, where: F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("long")
    return o.groupBy("touched", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("n_gone"), total(F.col("had"), gone).alias("gone_bytes"), total(F.col("had") - F.col("has"), ~gone).alias("changed_bytes"))


def _parts_sql(cells: str) -> str:
    return f"""WITH {_REASONED}, pg AS (SELECT rep, page_idx, sum(greatest(coalesce(c.transfer_size, 0), 0)) - coalesce(any_value(p.y), 0) AS delta FROM control_obs c LEFT JOIN (SELECT rep, page_idx, sum(greatest(coalesce(transfer_size, 0), 0)) AS y FROM private_obs GROUP BY 1, 2) p USING (rep, page_idx) GROUP BY 1, 2),
 t AS (SELECT DISTINCT rep, page_idx FROM blocked WHERE failure LIKE '%TRACKING%'), m AS (SELECT count(t.rep) AS n1, count(*) - count(t.rep) AS n0, coalesce(sum(delta) FILTER (WHERE t.rep IS NOT NULL), 0)::BIGINT AS d1, coalesce(sum(delta) FILTER (WHERE t.rep IS NULL), 0)::BIGINT AS d0 FROM pg LEFT JOIN t ON pg.rep = t.rep AND pg.page_idx = t.page_idx) {cells}"""


@query(_parts_sql("SELECT n1 AS n_pages_with_blocks, n0 AS n_pages_without_blocks, d1 + d0 AS measured_delta, d1 AS delta_with_blocks, d0 AS delta_without_blocks, round(coalesce(d0::DOUBLE / nullif(n0, 0), 0), 6) AS drift_per_page, round(d1 - coalesce(d0::DOUBLE / nullif(n0, 0), 0) * n1, 4) AS blocked_part, round(coalesce(d0::DOUBLE / nullif(n0, 0), 0) * n1 + d0, 4) AS drift_part FROM m"))
def drift_parts(spark, sf):
    """PAIR5: the measured delta in what blocking took and what drifted, by the drift of page loads without blocks."""
    sized = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0))
    page = ["rep", "page_idx"]
    total = lambda df, name: df.groupBy(*page).agg(F.sum(sized).alias(name))
    own = total(S.control(spark, sf), "x").join(total(S.private(spark, sf), "y"), page, "left").withColumn("delta", F.col("x") - F.coalesce("y", F.lit(0)))
    touched = S.blocked(spark, sf).where("failure like '%TRACKING%'").select(*page).distinct().withColumn("t", F.lit(True))
    m = D.drift(own.join(touched, page, "left").select("delta", F.coalesce("t", F.lit(False)).alias("touched")), "delta", "touched")
    return m.select(*(F.round(c, 6 if c == "drift_per_page" else 4).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))
