"""Queries over page panels: caches by host, cascade fits of few terms, candidate hosts, and scoring by a link function."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tallybrook.functions import requests as R
from tallybrook.functions import urls as U
from tallybrook.operators import boosting as B
from tallybrook.operators import classify as C
from tallybrook.operators import evaluate as V
from tallybrook.operators import fitting as G
from tallybrook.operators import lookup as L
from tallybrook.operators import pairing as P
from tallybrook.operators import pooling as O
from tallybrook.operators import simulate as M
from tallybrook.operators.size_table import cpu_ms, exp_link, followups
from tallybrook.plans import paired as PP
from tallybrook.plans import rules as RR
from tallybrook.plans import simulated as SP
from tallybrook.plans import tables as TT
from tallybrook.plans.features import LHOST, PATH, rounded
from tallybrook.plans.registry import query
from tallybrook.sources import fixtures as S
from tallybrook.sources.storage import kept

_RHOST = LHOST.replace("url", "r.url")
_SIZE = "greatest(coalesce(transfer_bytes, 0), 0)"
CASCADING = ("script", "html")


def size_of(c: str = "transfer_bytes") -> F.Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def listed_hosts(spark, sf, page: str):
    """Bytes and requests of each page's tracker hosts."""
    found = C.is_tracker(S.requests(spark, sf), S.rules(spark)).where("is_tracker")
    return found.groupBy(page, U.net_host(F.col("url")).alias("host")).agg(F.sum(size_of()).alias("bytes"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {RR.WITH_BEST} SELECT page_domain, {_RHOST} AS host, sum({_SIZE})::BIGINT AS bytes, count(*) AS n FROM requests r JOIN best b ON r.url = b.url GROUP BY 1, 2")
def page_host_mass(spark, sf):
    """AGG12: bytes and requests of each page's tracker hosts."""
    return listed_hosts(spark, sf, "page_domain")


@query(f"""WITH {RR.WITH_BEST}, a AS (SELECT page_idx, sum({_SIZE}) AS listed, count(DISTINCT {_RHOST}) AS hosts FROM requests r JOIN best b ON r.url = b.url GROUP BY 1), o AS (SELECT page_idx, sum({_SIZE}) AS other FROM requests r WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.url = r.url) GROUP BY 1)
 SELECT a.page_idx, a.listed::BIGINT AS listed, a.hosts, coalesce(o.other, 0)::BIGINT AS other FROM a LEFT JOIN o USING (page_idx)""")
def page_caches(spark, sf):
    """JN14: two caches of a page joined; what the second lacks is 0."""
    a = listed_hosts(spark, sf, "page_idx").groupBy("page_idx").agg(F.sum("bytes").alias("listed"), F.count(F.lit(1)).alias("hosts"))
    other = C.is_tracker(S.requests(spark, sf), S.rules(spark)).where("not is_tracker").groupBy("page_idx").agg(F.sum(size_of()).alias("other"))
    return a.join(other, "page_idx", "left").withColumn("other", F.coalesce("other", F.lit(0)))


@query(f"""WITH {S.WITH_REQUESTS}, {S.WITH_RULES}, {RR.MERGED}, log AS (SELECT *, {LHOST} AS host, coalesce(nullif({PATH}, ''), '/') AS path FROM requests WHERE transfer_bytes IS NOT NULL),
 m AS (SELECT h.host, arg_max(m.pattern, length(m.rule_host)) AS entry FROM (SELECT DISTINCT host FROM log) h JOIN merged m ON (h.host = m.rule_host OR ends_with(h.host, '.' || m.rule_host)) AND m.rule_path IS NULL GROUP BY 1)
 SELECT entry, host, count(*) AS n, sum(greatest(transfer_bytes, 0))::BIGINT AS bytes, sum(greatest(length(url) - length(host) - length(path) - 8, 0))::BIGINT AS query_length FROM log JOIN m USING (host) GROUP BY 1, 2""")
def matched_frame(spark, sf):
    """JN3: the log joined by host with a frame of matched hosts and their entries."""
    parts = U.url_parts(F.col("url"))
    log = S.requests(spark, sf).where("transfer_bytes is not null").withColumns({"host": parts["host"], "path": parts["path"]})
    hosts = C.describe(log.select("host").distinct().withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/"))), S.rules(spark))
    frame = hosts.where("tracker_pattern is not null").select("host", F.col("tracker_pattern").alias("entry"))
    left = U.query_length_left(F.length("url"), F.col("host"), F.col("path"))
    return log.join(C._sized(frame), "host").groupBy("entry", "host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("transfer_bytes", F.lit(0))).alias("bytes"), F.sum(left).cast("long").alias("query_length"))


@query(f"""WITH {S.WITH_PAIRED}, {S.WITH_RULES}, {RR.MERGED}, {RR.matched(RR.DEFAULT)}, e AS (SELECT DISTINCT {LHOST} AS host FROM blocked WHERE failure LIKE '%TRACKING_URI'),
 q AS (SELECT r.page_idx, {_RHOST} AS host, {_SIZE} AS y, b.url IS NOT NULL AND resource_type IN ('script', 'html') AND NOT ({_RHOST} = page_domain OR ends_with({_RHOST}, '.' || page_domain) OR ends_with(page_domain, '.' || {_RHOST})) AS ok FROM requests r LEFT JOIN best b ON r.url = b.url),
 h AS (SELECT page_idx, host, sum(y)::BIGINT AS bytes FROM q WHERE host IN (SELECT host FROM e) GROUP BY 1, 2 HAVING bool_or(ok))
 SELECT page_idx, host, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_idx ORDER BY bytes DESC, host) AS rank FROM h) WHERE rank <= 2""")
def candidate_hosts(spark, sf):
    """TOP6: a page's listed third-party hosts of cascading requests that were ever blocked, the two of most bytes."""
    found = C.is_tracker(S.requests(spark, sf), S.rules(spark)).withColumn("host", U.net_host(F.col("url")))
    ok = F.col("is_tracker") & F.col("resource_type").isin(*CASCADING) & U.is_third_party(F.col("host"), F.col("page_domain"))
    ever = S.blocked(spark, sf).where(R.protection_of(F.col("failure")) == "tracking").select(U.net_host(F.col("url")).alias("host"))
    return P.candidate_hosts(found.withColumn("qualifies", F.coalesce(ok, F.lit(False))), ever, ["page_idx"], size_of(), 2)


@query(f"""WITH {TT._chain('mean')}, g AS (SELECT host, count(*) AS n, sum(pred) AS p, sum(transfer_bytes)::DOUBLE AS a, stddev_samp(pred - transfer_bytes) AS sd FROM pred GROUP BY 1), t AS (SELECT sum(a) AS ta FROM g)
 SELECT host, n, round(a / ta, 6) AS share, round((p - a) / a * 100, 6) AS bias_pct, round(sd * sqrt(n) / a * 100, 6) AS se_pct FROM g, t WHERE a / ta >= 0.02 AND n >= 200 AND sd * sqrt(n) / a * 100 <= 15""")
def gradeable_hosts(spark, sf):
    """FLT17: hosts of 2 % of the bytes, 200 requests and a standard error of 15 % at most."""
    return rounded(V.gradeable(TT.predicted(spark, sf, "mean"), ["host"], "pred", "transfer_bytes"))


_HOSTS_OF_BAG = f"{PP.PAIRED}, bh AS (SELECT rep, page_idx, {LHOST} AS host, sum(coalesce(observed_bytes, 0)) AS own FROM bag GROUP BY 1, 2, 3)"


@query(f"""WITH {_HOSTS_OF_BAG}, s AS (SELECT page_idx, count(*) AS n_singles, sum(own)::DOUBLE AS singles FROM bh GROUP BY 1 HAVING count(*) >= 2), j AS (SELECT page_idx, sum(bytes_saved)::DOUBLE AS joint FROM paired GROUP BY 1)
 SELECT page_idx, n_singles, round(CASE WHEN singles <> 0 THEN joint / singles END, 6) AS ratio FROM s JOIN j USING (page_idx)""")
def joint_and_singles(spark, sf):
    """AGG42: what a page saves in all over the sum of what its hosts' own requests weigh."""
    single = PP.matched(spark, sf).groupBy("rep", "page_idx", U.net_host(F.col("url")).alias("host")).agg(F.sum(F.coalesce("observed_bytes", F.lit(0))).alias("v")).select("page_idx", F.lit("single").alias("kind"), "v")
    joint = PP.saved(spark, sf).select("page_idx", F.lit("joint").alias("kind"), F.col("bytes_saved").alias("v"))
    return rounded(P.joint_ratio(single.union(joint), ["page_idx"], "kind", "v"))


@query(f"""WITH {_HOSTS_OF_BAG}, o AS (SELECT rep, page_idx, sum(own)::BIGINT AS own_bytes FROM bh GROUP BY 1, 2)
 SELECT rep, page_idx, transfer_bytes_normal AS base_bytes, transfer_bytes_private AS variant_bytes, own_bytes, transfer_bytes_normal - transfer_bytes_private - own_bytes AS cascade_bytes FROM paired JOIN o USING (rep, page_idx)""")
def two_load_cascade(spark, sf):
    """PAIR9: the cascade of two loads: base less variant less the blocked requests' own bytes in the base load."""
    own = PP.matched(spark, sf).groupBy(*P.PAGE).agg(F.sum(F.coalesce("observed_bytes", F.lit(0))).alias("own_bytes"))
    j = PP.touched(spark, sf).join(own, P.PAGE)
    return j.select(*P.PAGE, F.col("transfer_bytes_normal").alias("base_bytes"), F.col("transfer_bytes_private").alias("variant_bytes"), "own_bytes", (F.col("transfer_bytes_normal") - F.col("transfer_bytes_private") - F.col("own_bytes")).alias("cascade_bytes"))


#: The panel in SQL: direct bytes and cascading requests of each touched page.
_PANEL = f"""{PP.PAIRED}, pn AS (SELECT rep, page_idx, sum(coalesce(observed_bytes, 0))::DOUBLE AS direct, count(*) FILTER (WHERE resource_type IN ('script', 'html'))::DOUBLE AS casc_n, coalesce(sum(observed_bytes) FILTER (WHERE resource_type IN ('script', 'html')), 0)::DOUBLE AS casc_bytes,
 count(*) FILTER (WHERE resource_type IN ('script', 'html') AND coalesce(observed_bytes, 0) < 30000)::DOUBLE AS small_n, count(*) FILTER (WHERE resource_type IN ('script', 'html') AND coalesce(observed_bytes, 0) >= 30000)::DOUBLE AS large_n FROM bag JOIN (SELECT rep, page_idx, pos, resource_type FROM blocked) USING (rep, page_idx, pos) GROUP BY 1, 2),
 panel AS (SELECT * FROM paired JOIN pn USING (rep, page_idx) WHERE n_blocked_tracking > 0)"""


def panel(spark, sf):
    """ML20: touched pages with direct bytes, cascading requests and bytes, and their numbers by size."""
    casc, size = F.col("resource_type").isin(*CASCADING), F.coalesce("observed_bytes", F.lit(0))
    pn = PP.matched(spark, sf).groupBy(*P.PAGE).agg(F.sum(size).alias("direct"), F.count_if(casc).alias("casc_n"), F.sum(F.when(casc, size).otherwise(0)).alias("casc_bytes"), F.count_if(casc & (size < 30000)).alias("small_n"), F.count_if(casc & (size >= 30000)).alias("large_n"))
    return PP.touched(spark, sf).join(pn, P.PAGE).where("n_blocked_tracking > 0")


@query(f"""WITH {_PANEL}, t AS (SELECT sum(direct) AS d, sum(casc_n) AS cn, sum(casc_bytes) AS cb, sum(bytes_saved)::DOUBLE AS w, sum(bytes_saved_tracking)::DOUBLE AS l, count(*) AS n FROM panel), q AS (SELECT avg(bytes_saved) AS dw, avg(bytes_saved_tracking) AS dl FROM paired WHERE n_blocked_tracking = 0),
 v AS (SELECT unnest(['whole', 'whole_raw', 'listed', 'listed_raw']) AS form, unnest([w - dw * n, w, l - dl * n, l]) AS saved, d, cn, cb FROM t, q) SELECT form, round(saved, 2) AS saved, round((saved - d) / cb, 6) AS factor, round((saved - d) / cn, 4) AS per_request FROM v""")
def implied_factors(spark, sf):
    """ML20-21: the factor and the bytes for each request that page savings imply, corrected for drift and raw."""
    saved = O.measure(PP.touched(spark, sf), {"whole": "bytes_saved", "listed": "bytes_saved_tracking"})
    f = G.implied_factors(panel(spark, sf), {k: k for k in ("whole", "whole_raw", "listed", "listed_raw")}, saved)
    return f.select("form", F.round("saved", 2).alias("saved"), F.round("factor", 6).alias("factor"), F.round("per_request", 4).alias("per_request"))


def _two(form: str, x1: str, x2: str, y: str, rows: str) -> str:
    return f"SELECT '{form}' AS form, count(*) AS n, sum(({x1}) * ({x1})) AS s11, sum(({x2}) * ({x2})) AS s22, sum(({x1}) * ({x2})) AS s12, sum(({x1}) * ({y})) AS t1, sum(({x2}) * ({y})) AS t2 FROM {rows}"


@query(f"""WITH {_PANEL}, kb AS (SELECT page_idx % 7 AS g, 1.0::DOUBLE AS one, casc_n, small_n, large_n, direct / 1024 AS direct, bytes_saved_tracking / 1024.0::DOUBLE AS y FROM panel), dm AS (SELECT casc_n - avg(casc_n) OVER (PARTITION BY g) AS casc_n, direct - avg(direct) OVER (PARTITION BY g) AS direct, y - avg(y) OVER (PARTITION BY g) AS y FROM kb),
 u AS ({_two('intercept', 'one', 'casc_n', 'y', 'kb')} UNION ALL {_two('joint', 'direct', 'casc_n', 'y', 'kb')} UNION ALL {_two('by_size', 'small_n', 'large_n', 'y', 'kb')} UNION ALL {_two('demeaned', 'direct', 'casc_n', 'y', 'dm')}),
 f AS (SELECT form, n, s11 * s22 - s12 * s12 > 1e-9 * s11 * s22 AS ok, (s22 * t1 - s12 * t2) / nullif(s11 * s22 - s12 * s12, 0) AS f1, (s11 * t2 - s12 * t1) / nullif(s11 * s22 - s12 * s12, 0) AS f2, greatest(coalesce(t1 / nullif(s11, 0), 0), 0) AS o1, greatest(coalesce(t2 / nullif(s22, 0), 0), 0) AS o2, t1, t2 FROM u)
 SELECT form, n, round(CASE WHEN ok AND f1 >= 0 AND f2 >= 0 THEN f1 WHEN o1 * t1 >= o2 * t2 THEN o1 ELSE 0 END, 4) AS b1, round(CASE WHEN ok AND f1 >= 0 AND f2 >= 0 THEN f2 WHEN o1 * t1 >= o2 * t2 THEN 0 ELSE o2 END, 4) AS b2 FROM f""")
def two_term_fits(spark, sf):
    """ML15, ML17: savings by an intercept and a count, by direct bytes and a count, by two sizes, and within groups."""
    kb = panel(spark, sf).select((F.col("page_idx") % 7).alias("g"), F.lit(1.0).alias("one"), *(F.col(c).cast("double").alias(c) for c in ("casc_n", "small_n", "large_n")), (F.col("direct") / 1024).alias("direct"), (F.col("bytes_saved_tracking") / 1024).alias("y"))
    forms = {"intercept": ("one", "casc_n"), "joint": ("direct", "casc_n"), "by_size": ("small_n", "large_n"), "demeaned": ("direct", "casc_n")}
    return rounded(G.two_term_forms(kb, forms, "y", "g", ("demeaned",)).select("form", "n", "b1", "b2"), 4)


_KEY = f"{_RHOST} || {PATH.replace('url', 'r.url')}"


def _keyed(spark, sf):
    """Kilobytes and requests of each page's tracker hosts and paths."""
    found = C.is_tracker(S.requests(spark, sf), S.rules(spark)).where("is_tracker")
    return found.groupBy("page_idx", F.concat(U.net_host(F.col("url")), U.rule_path(F.col("url"))).alias("key")).agg((F.sum(size_of()) / 1024).alias("kb"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RR.WITH_BEST}, k AS (SELECT page_idx, {_KEY} AS key, sum({_SIZE}) / 1024.0::DOUBLE AS kb FROM requests r JOIN best b ON r.url = b.url GROUP BY 1, 2), w AS (SELECT key FROM k GROUP BY 1 HAVING count(*) >= 30),
 c AS (SELECT page_idx, CASE WHEN w.key IS NULL THEN '(other)' ELSE k.key END AS col, sum(CASE WHEN w.key IS NULL THEN kb ELSE 1 END) AS v FROM k LEFT JOIN w USING (key) GROUP BY 1, 2) SELECT a.col AS a, b.col AS b, round(sum(a.v * b.v), 3) AS x FROM c a JOIN c b USING (page_idx) WHERE a.col <= b.col GROUP BY 1, 2""")
def presence_gram(spark, sf):
    """ML14: products of the columns of page presence, with the rare keys' remainder."""
    cells = kept(G.presence(kept(_keyed(spark, sf)), "page_idx", "key", "kb", 30))  # the products pass over them twice
    return rounded(G.gram(cells, ["page_idx"], "column", "value", cells.select("page_idx", F.lit(0.0).alias("y")).distinct(), "y")[0], 3)


@query()
def host_split_fit(spark, sf):
    """ML14-15: bytes that a tracker's presence brings, on listed hosts beyond its own and on unlisted ones.

    Both fits share the presence columns and the remainder; the unlisted one has an intercept by page as well.
    """
    keyed = kept(_keyed(spark, sf))
    cells = kept(G.presence(keyed, "page_idx", "key", "kb", 30))  # both fits pass over them several times
    listed = keyed.groupBy("page_idx").agg(F.sum("kb").alias("y"))
    other = C.is_tracker(S.requests(spark, sf), S.rules(spark)).where("not is_tracker").groupBy("page_idx").agg((F.sum(size_of()) / 1024).alias("y_"))
    unlisted = listed.select("page_idx").join(other, "page_idx", "left").select("page_idx", F.coalesce("y_", F.lit(0.0)).alias("y"))
    ones = listed.select("page_idx", F.lit("(page)").alias("column"), F.lit(1.0).alias("value"))
    a = G.fit_nnls(cells, ["page_idx"], "column", "value", listed, "y").withColumnRenamed("coef", "b_listed")
    b = G.fit_nnls(cells.unionByName(ones), ["page_idx"], "column", "value", unlisted, "y").withColumnRenamed("coef", "b_unlisted")
    own = keyed.groupBy(F.col("key").alias("column")).agg(F.avg("kb").alias("own"), F.avg("n").alias("reqs"))
    beyond = F.greatest(F.col("b_listed") - F.col("own"), F.lit(0.0))
    return rounded(a.join(b, "column").join(own, "column").select(F.col("column").alias("key"), beyond.alias("listed_kb"), F.col("b_unlisted").alias("unlisted_kb"), (beyond / F.greatest("reqs", F.lit(1.0))).alias("listed_kb_per_request"), (F.col("b_unlisted") / F.greatest("reqs", F.lit(1.0))).alias("unlisted_kb_per_request")), 3)


@query(f"""WITH {S.WITH_PAIRED}, t AS (SELECT page_idx, rep, sum(greatest(coalesce(transfer_size, 0), 0)) AS b FROM control_obs GROUP BY 1, 2) SELECT page_idx, count(*) AS n, round(avg(b), 4) AS mean, round(stddev_samp(b), 4) AS sd FROM t GROUP BY 1 HAVING count(*) >= 2""")
def control_spread(spark, sf):
    """AGG40: deviation of a page's repeated control loads."""
    t = S.control(spark, sf).groupBy("page_idx", "rep").agg(F.sum(size_of("transfer_size")).alias("b"))
    return rounded(t.groupBy("page_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("mean"), F.stddev_samp(F.col("b").cast("double")).alias("sd")).where("n >= 2"), 4)


@query(f"""WITH {PP.PAIRED} SELECT rep, count(*) AS n_pages, sum(transfer_bytes_normal)::BIGINT AS bytes_normal, sum(transfer_bytes_private)::BIGINT AS bytes_private, sum(bytes_saved)::BIGINT AS bytes_saved, round(median(bytes_saved), 2) AS median_saved, round(median(n_requests_delta), 2) AS median_requests,
 count(*) FILTER (WHERE bytes_saved < 0) AS n_negative, sum(blocked_matched)::BIGINT AS n_matched, sum(blocked_unmatched)::BIGINT AS n_unmatched FROM paired GROUP BY rep""")
def pair_summary(spark, sf):
    """PAIR2: totals, medians, pages of negative saving and matched blocks of every pass."""
    g = PP.paired(spark, sf).groupBy("rep").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("transfer_bytes_normal").alias("bytes_normal"), F.sum("transfer_bytes_private").alias("bytes_private"), F.sum("bytes_saved").alias("bytes_saved"), F.median("bytes_saved").alias("median_saved"), F.median("n_requests_delta").alias("median_requests"), F.count_if(F.col("bytes_saved") < 0).alias("n_negative"), F.sum("blocked_matched").alias("n_matched"), F.sum("blocked_unmatched").alias("n_unmatched"))
    return rounded(g, 2)


@query(f"""WITH {S.WITH_REQUESTS}, {S.WITH_RULES}, {RR.MERGED}, {RR.matched(RR.DEFAULT)}, p AS (SELECT *, {RR._PAGES} AS page_url FROM requests), q AS (SELECT p.page_idx, {LHOST.replace('url', 'p.url')} AS host, regexp_extract(page_url, '^https://([^/]*)', 1) AS ph, {_SIZE} AS y, b.url IS NOT NULL AS listed FROM p LEFT JOIN best b ON p.url = b.url)
 SELECT page_idx, sum(y)::BIGINT AS page, sum(CASE WHEN NOT (host = ph OR ends_with(host, '.' || ph) OR ends_with(ph, '.' || host)) THEN y ELSE 0 END)::BIGINT AS third_party, sum(CASE WHEN listed THEN y ELSE 0 END)::BIGINT AS listed FROM q GROUP BY page_idx""")
def bytes_by_width(spark, sf):
    """PAIR8: bytes of a page, of its third parties and of listed hosts, from its bag of requests."""
    found = C.is_tracker(RR._paged(spark, sf), S.rules(spark)).withColumn("rep", F.lit(1))
    return P.by_width(found, F.col("is_tracker"), F.col("page_url"), size_of()).drop("rep")


_X = "CASE WHEN resource_type = 'other' AND url LIKE '%/v1/collect%' THEN 'json' WHEN resource_type IN ('script', 'image', 'html') THEN resource_type ELSE 'other' END"


@query(f"""WITH {TT._SPLIT}, a AS (SELECT {_X} AS context, length(url)::DOUBLE AS x, ln(1 + transfer_bytes) AS y FROM tr), f AS (SELECT context, coalesce(regr_slope(y, x), 0) AS s, coalesce(regr_intercept(y, x), avg(y)) AS i FROM a GROUP BY 1), g AS (SELECT {_X} AS context, length(url) AS x, transfer_bytes AS y FROM te),
 p AS (SELECT context, y, greatest(round(exp(s * x + i) - 1 + 1e-6), 0) AS p FROM g JOIN f USING (context)) SELECT context, count(*) AS n, sum(p)::BIGINT AS pred_total, sum(y)::BIGINT AS actual_total, round(sum(0.15::DOUBLE + p / 1024 * CASE context WHEN 'script' THEN 2.0::DOUBLE WHEN 'html' THEN 0.3 ELSE 0.1 END), 3) AS cpu_ms FROM p GROUP BY 1""")
def exp_link_scores(spark, sf):
    """EST13: scores of a log-linear model by context, a JSON context besides the eleven, and CPU time."""
    train, test = TT.split(spark, sf)
    context = F.when((F.col("resource_type") == "other") & F.col("url").contains("/v1/collect"), "json").otherwise(R.context_name(F.col("resource_type")))
    a = train.select(context.alias("context"), F.length("url").cast("double").alias("x"), F.log1p("transfer_bytes").alias("y"))
    fit = a.groupBy("context").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("y", "x"), F.avg("y")).alias("start"))
    p = test.withColumn("context", context).join(F.broadcast(fit), "context")  # a row for each context, twelve at most
    own = p.withColumn("p", exp_link(F.col("slope") * F.length("url") + F.col("start")))
    return own.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("pred_total"), F.sum("transfer_bytes").alias("actual_total"), F.round(F.sum(cpu_ms(F.col("p"), F.col("context"))), 3).alias("cpu_ms"))


@query(f"""WITH {TT.SCORED}, {S.WITH_RULES}, {RR.MERGED}, {RR.matched('true')}, o AS (SELECT DISTINCT organization, split_part(pattern, '/', 1) AS domain FROM rules), q AS (SELECT s.est_bytes AS p, coalesce(s.transfer_bytes, 0) AS a, s.host, b.organization, regexp_extract(s.page_url, '^https://([^/]*)', 1) AS ph FROM (SELECT *, {RR._PAGES} AS page_url FROM scored) s JOIN best b ON s.url = b.url),
 t AS (SELECT *, EXISTS (SELECT 1 FROM o WHERE o.organization = q.organization AND (q.ph = o.domain OR ends_with(q.ph, '.' || o.domain))) AS same FROM q WHERE NOT (host = ph OR ends_with(host, '.' || ph) OR ends_with(ph, '.' || host))),
 u AS (SELECT 'third_party' AS question, p, a FROM t UNION ALL SELECT 'cross_entity', p, a FROM t WHERE NOT same) SELECT question, count(*) AS n, sum(p)::BIGINT AS pred_total, sum(a)::BIGINT AS actual_total, round(sum(p)::DOUBLE / sum(a), 6) AS ratio FROM u GROUP BY question""")
def estimate_questions_by_party(spark, sf):
    """PAIR4: estimates against observations for listed third-party requests, and for those of another owner than the page's."""
    page = F.when(F.col("page_idx") % 7 == 0, "https://www.social.example/home").when(F.col("page_idx") % 7 == 1, "https://guard.example/").otherwise(F.concat(F.lit("https://"), "page_domain", F.lit("/")))
    kinds = S.requests(spark, sf).groupBy(U.plain_query(F.col("url")).alias("url"), "resource_type", "http_method", page.alias("page_url"))
    alike = kinds.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("transfer_bytes", F.lit(0))).alias("a"))  # requests of equal estimate, verdict and page
    s = C.describe(TT.scorer(spark, sf)(alike), S.rules(spark)).where("tracker_pattern is not null")
    t = s.where(U.is_third_party(F.col("host"), U.net_host(F.col("page_url"))))
    owners = C.same_owner(t.select("url", "page_url").distinct(), S.rules(spark))
    questions = F.when(F.col("same_owner"), F.array(F.lit("third_party"))).otherwise(F.array(F.lit("third_party"), F.lit("cross_entity")))
    rows = t.join(owners, ["url", "page_url"]).select(F.explode(questions).alias("question"), "n", (F.col("est_bytes") * F.col("n")).alias("p"), "a")
    return rounded(rows.groupBy("question").agg(F.sum("n").alias("n"), F.sum("p").alias("pred_total"), F.sum("a").alias("actual_total"), (F.sum("p").cast("double") / F.sum("a")).alias("ratio")))


_LEVELLED = f"WITH {TT._chain('mean')}, c AS (SELECT page_domain, resource_type AS t, sum(pred) AS p, count(*)::DOUBLE AS k, sum(transfer_bytes)::DOUBLE AS a FROM pred GROUP BY 1, 2), lv AS (SELECT page_domain, t, p * (SELECT sum(a) / sum(p) FROM c) - a AS ga, k * (SELECT sum(a) / sum(k) FROM c) - a AS gb FROM c)"


@query(f"""{_LEVELLED}, nb AS (SELECT page_domain, row_number() OVER (ORDER BY {S.HASH.format('page_domain')}, page_domain) - 1 AS i FROM (SELECT DISTINCT page_domain FROM lv)), {SP._DRAW.format('dr', 'v', 50, 20)}, g AS (SELECT trial, t, abs(sum(ga)) AS a, abs(sum(gb)) AS b FROM dr JOIN nb ON dr.h % (SELECT count(*) FROM nb) = nb.i JOIN lv USING (page_domain) GROUP BY 1, 2),
 tt AS (SELECT trial, sum(a) AS a, sum(b) AS b FROM g GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN a < b THEN 1.0 ELSE 0 END), 6) AS win_rate FROM tt""")
def category_win_rate(spark, sf):
    """SIM3: how often a table beats a count on totals by type, at equal totals, in page resamples."""
    c = SP.graded(spark, sf).groupBy("page_domain", F.col("resource_type").alias("t")).agg(F.sum("pred").alias("p"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("transfer_bytes").cast("double").alias("a"))
    return rounded(M.category_win_rate(c, ["page_domain"], "t", "p", "k", "a", 20, 50, "v"))


@query()
def forest_importances(spark, sf):
    """ML4, TOP5: a random forest's fifteen features of most importance, and its error on later rows."""
    train, test = SP.features(spark, sf)
    model = RandomForestRegressor(numTrees=10, maxDepth=5, seed=5).fit(train)
    mae = V.errors(model.transform(test).withColumn("p", F.greatest("prediction", F.lit(0.0))), "p", "label", median=False).select("mae")
    names = [a["name"] for kind in train.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(kind, key=lambda a: a["idx"])]
    top = sorted(zip(names, model.featureImportances.toArray(), strict=True), key=lambda x: (-x[1], x[0]))[:15]
    return L.one_row(spark.createDataFrame([(k + 1, n, float(v)) for k, (n, v) in enumerate(top)], "rank int, feature string, importance double"), mae)


POWERS, QUANTILES = (1.2, 1.5, 1.8), (0.1, 0.5, 0.9)
TREES, DEPTH, RATE = 5, 3, 0.4


def arrays(df, *targets):
    """Features as an array, and the targets with one added where a Tweedie loss is to meet zeros."""
    return df.withColumns({"x": vector_to_array("features"), "y": F.array(*targets)})


@query()
def tweedie_sweep(spark, sf):
    """ML5: boosted Tweedie trees of three powers on two targets, one added before the fit and taken off after it; the six
    models grow in the same passes.  Beside them the log-linear Tweedie model of each."""
    train, test = SP.features(spark, sf, F.length("url").cast("double").alias("url_length"))
    kinds = [(target, power) for target in ("label", "url_length") for power in POWERS]
    models = [B.Target(f"{t}_{p}", k // len(POWERS), "tweedie", p) for k, (t, p) in enumerate(kinds)]
    grown = B.fit(arrays(train, F.col("label") + 1, F.col("url_length") + 1), "x", "y", models, TREES, DEPTH, RATE)
    scored = kept(B.predict(arrays(test).drop("y", "features"), "x", grown).select("label", "url_length", "predictions"))
    out = []
    for k, (target, power) in enumerate(kinds):
        line = GeneralizedLinearRegression(labelCol="y", family="tweedie", variancePower=power, linkPower=0.0, maxIter=8, regParam=0.1).fit(train.withColumn("y", F.col(target) + 1))
        for name, p in (("trees", scored.withColumn("p", F.col("predictions")[k])), ("log_linear", line.transform(test).withColumn("p", F.col("prediction")))):
            e = V.errors(p.withColumn("p", F.greatest(F.col("p") - 1, F.lit(0.0))), "p", target, median=False)
            out.append(e.select(F.lit(name).alias("model"), F.lit(target).alias("target"), F.lit(power).alias("power"), "n", "mae", "ratio"))
    return S.union_all(*out)


def quantile_scores(spark, sf):
    """Later rows with the quantile models' low, middle and high: of crossing predictions the lower one is the lower bound."""
    train, test = SP.features(spark, sf)
    grown = B.fit(arrays(train, "label"), "x", "y", [B.Target(f"q{q}", 0, "quantile", q) for q in QUANTILES], TREES, DEPTH, RATE)
    scored = B.predict(arrays(test).drop("y", "features"), "x", grown).withColumn("own", F.array_sort("predictions"))
    return scored.select("page_idx", "pos", "resource_type", "label", *(F.col("own")[k].alias(n) for k, n in enumerate(("low", "middle", "high"))))


@query()
def quantile_models(spark, sf):
    """ML7: boosted quantile models of 0.1, 0.5 and 0.9, and how often and how wide their interval holds on later rows."""
    rows = quantile_scores(spark, sf)
    return L.one_row(V.coverage(rows, "low", "high", "label"), V.errors(rows, "middle", "label").select("n", "mae", "median_ae"))


@query()
def type_probabilities(spark, sf):
    """ML12-13: class probabilities as features of a regression, and how the odds of a later period go with its errors.

    The correlation is null where the odds are the same for all later rows: the forest merges leaves of one guess.
    """
    train, test = SP.features(spark, sf)
    kinds = RandomForestClassifier(labelCol="kind", probabilityCol="odds", predictionCol="guess", rawPredictionCol="votes", numTrees=5, maxDepth=4, seed=3).fit(train.withColumn("kind", R.context_of(F.col("resource_type")).cast("double")))
    both = VectorAssembler(inputCols=["features", "odds"], outputCol="more")
    a, b = (both.transform(kinds.transform(df)) for df in (train, test))
    late = RandomForestClassifier(labelCol="late", probabilityCol="when", predictionCol="guess_", rawPredictionCol="votes_", numTrees=5, maxDepth=3, seed=4).fit(a.withColumn("late", F.lit(0.0)).unionByName(b.withColumn("late", F.lit(1.0))))
    out = []
    for name, column in (("plain", "features"), ("with_probabilities", "more")):
        p = late.transform(LinearRegression(featuresCol=column, regParam=1.0).fit(a).transform(b)).withColumn("gap", F.abs(F.greatest("prediction", F.lit(0.0)) - F.col("label")))
        out.append(p.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mae"), V.correlation(vector_to_array("when")[1], F.col("gap")).alias("error_correlation")))
    return S.union_all(*out)


#: Predictions and measured savings of each page load in SQL: blocked requests' estimates with their follow-ups.
_WHOLE = "CASE WHEN est_bytes <= 0 OR match_level = 'bodyless' OR context NOT IN ('script', 'html') THEN 0 ELSE CAST(round(47000 * " + TT._SCALE + ") AS BIGINT) END"


@query(f"""WITH {PP.PAIRED}, sc AS (WITH {TT.SCORED} SELECT page_idx, pos, est_bytes, match_level, context FROM scored), e AS (SELECT b.rep, b.page_idx, sum(s.est_bytes) AS direct, sum({_WHOLE}) AS followup FROM blocked b JOIN sc s USING (page_idx, pos) GROUP BY 1, 2)
 SELECT rep, count(*) AS n_pages, sum(direct)::BIGINT AS direct, sum(followup)::BIGINT AS followup, sum(bytes_saved)::BIGINT AS saved, round(sum(direct + followup)::DOUBLE / sum(bytes_saved), 6) AS ratio FROM e JOIN paired USING (rep, page_idx) GROUP BY rep""")
def estimate_end_to_end(spark, sf):
    """PAIR4: estimates of the blocked requests and their follow-ups against what the page loads saved."""
    priced = followups(TT.scored(spark, sf).withColumn("host_scale", F.lit(1.0)), F.lit("UNKNOWN")).select("page_idx", "pos", "est_bytes", "followup_bytes")
    e = S.blocked(spark, sf).select(*P.PAGE, "pos").join(priced, ["page_idx", "pos"]).groupBy(*P.PAGE).agg(F.sum("est_bytes").alias("direct"), F.sum("followup_bytes").alias("followup"))
    j = e.join(PP.touched(spark, sf), P.PAGE).groupBy("rep")
    return rounded(j.agg(F.count(F.lit(1)).alias("n_pages"), F.sum("direct").alias("direct"), F.sum("followup").alias("followup"), F.sum("bytes_saved").alias("saved"), (F.sum(F.col("direct") + F.col("followup")).cast("double") / F.sum("bytes_saved")).alias("ratio")))


@query(f"""WITH {S.WITH_REQUESTS}, r AS (SELECT page_idx, {LHOST} AS host, transfer_bytes AS y FROM requests) SELECT n, pages, round(mean_bytes, 4) AS mean_bytes, wasted FROM (SELECT regexp_extract(host, '([^.]+)[.]example$', 1) AS entity, count(*) AS n, count(DISTINCT page_idx) AS pages, avg(y) AS mean_bytes, coalesce(sum(y) FILTER (WHERE y > 50000), 0)::BIGINT AS wasted FROM r GROUP BY 1)""")
def nested_items(spark, sf):
    """AGG1-2: items nested in a page's JSON payload, exploded and grouped by an entity that isn't selected."""
    item = F.struct(U.net_host(F.col("url")).alias("host"), F.col("transfer_bytes").alias("bytes"))
    payload = S.requests(spark, sf).groupBy("page_idx").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    items = payload.select("page_idx", F.explode(F.from_json("payload", "items array<struct<host: string, bytes: bigint>>")["items"]).alias("item")).select("page_idx", "item.*")
    g = items.groupBy(F.regexp_extract("host", r"([^.]+)[.]example$", 1).alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_idx").alias("pages"), F.avg("bytes").alias("mean_bytes"), F.coalesce(F.sum(F.when(F.col("bytes") > 50000, F.col("bytes"))), F.lit(0)).alias("wasted"))
    return rounded(g.drop("entity"), 4)


@query("""SELECT regexp_extract(url, '^https?://[^/?#]*(/[^/?#]*)', 1) AS section, count(*) AS n, count(DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))) AS hosts, sum(length(html))::BIGINT AS characters FROM pages WHERE page_id % 2 = 0 GROUP BY 1""")
def page_table(spark, sf):
    """SRC2: a scan of the page table behind a predicate."""
    u = F.col("url")
    p = S.read(spark, sf, "pages").where("page_id % 2 = 0")
    return p.groupBy(F.regexp_extract(u, r"^https?://[^/?#]*(/[^/?#]*)", 1).alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(U.net_host(u)).alias("hosts"), F.sum(F.length("html")).alias("characters"))
