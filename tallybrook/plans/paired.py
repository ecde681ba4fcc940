"""Queries over paired crawls: matching, pairing, pooling and dispersion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybrook.functions import urls as U
from tallybrook.operators import fitting as G
from tallybrook.operators import pairing as P
from tallybrook.operators import pooling as O
from tallybrook.plans.features import LHOST, rounded
from tallybrook.plans.registry import query
from tallybrook.plans.rules import DEFAULT, MERGED
from tallybrook.sources import fixtures as S
from tallybrook.sources.storage import kept

#: The paired crawl in SQL: bag matches, arm totals by page and repetition, and their differences.
_SIZED = "greatest(coalesce(transfer_size, 0), 0)"
MATCHED = f"""{S.WITH_PAIRED}, c1 AS (SELECT *, {_SIZED} AS size, regexp_replace(url, '[?#].*', '') AS path, row_number() OVER (PARTITION BY rep, page_idx, url ORDER BY pos) AS k FROM control_obs),
 b1 AS (SELECT *, regexp_replace(url, '[?#].*', '') AS path, row_number() OVER (PARTITION BY rep, page_idx, url ORDER BY pos) AS k FROM blocked),
 ex AS (SELECT b1.*, c1.size AS exact_size, c1.pos AS cpos FROM b1 LEFT JOIN c1 USING (rep, page_idx, url, k)),
 al AS (SELECT rep, page_idx, path, min(pos) AS cpos, min(size) AS loose FROM c1 GROUP BY 1, 2, 3 HAVING count(*) = 1), fr AS (SELECT al.* FROM al WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.rep = al.rep AND ex.page_idx = al.page_idx AND ex.cpos = al.cpos)),
 lf AS (SELECT rep, page_idx, path, min(pos) AS pos FROM ex WHERE cpos IS NULL GROUP BY 1, 2, 3), lo AS (SELECT lf.rep, lf.page_idx, lf.pos, fr.loose FROM lf JOIN fr USING (rep, page_idx, path)),
 bag AS (SELECT ex.rep, ex.page_idx, ex.pos, ex.url, ex.failure, coalesce(ex.exact_size, lo.loose) AS observed_bytes, CASE WHEN ex.cpos IS NOT NULL THEN 'exact' WHEN lo.loose IS NOT NULL THEN 'path' ELSE 'unmatched' END AS match_kind FROM ex LEFT JOIN lo USING (rep, page_idx, pos))"""


def _arm(table: str, arm: str) -> str:
    return f"""arm_{arm} AS (SELECT o.rep, o.page_idx, count(*) AS n_requests_{arm}, sum({_SIZED})::BIGINT AS transfer_bytes_{arm}, sum(CASE WHEN tk.url IS NOT NULL THEN {_SIZED} ELSE 0 END)::BIGINT AS tracker_bytes_{arm},
  sum(CASE WHEN tk.url IS NULL THEN {_SIZED} ELSE 0 END)::BIGINT AS unlisted_tp_bytes_{arm} FROM {table} o LEFT JOIN tk ON o.url = tk.url GROUP BY 1, 2)"""


PAIRED = f"""{MATCHED}, {S.WITH_RULES}, {MERGED}, tk AS (SELECT DISTINCT u.url FROM (SELECT DISTINCT url, {LHOST} AS host, lower(regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1)) AS path FROM control_obs) u JOIN merged m ON (u.host = m.rule_host OR ends_with(u.host, '.' || m.rule_host)) AND (m.rule_path IS NULL OR starts_with(u.path, m.rule_path)) WHERE {DEFAULT}),
 {_arm('control_obs', 'normal')}, {_arm('private_obs', 'private')}, bl AS (SELECT rep, page_idx, count(*) FILTER (WHERE failure LIKE '%TRACKING%') AS n_blocked_tracking, count(*) FILTER (WHERE failure NOT LIKE '%TRACKING%') AS n_blocked_other, coalesce(sum(observed_bytes), 0)::BIGINT AS blocked_observed_bytes, count(observed_bytes) AS blocked_matched, count(*) FILTER (WHERE match_kind = 'unmatched') AS blocked_unmatched FROM bag GROUP BY 1, 2),
 paired AS (SELECT n.*, p.* EXCLUDE (rep, page_idx), coalesce(n_blocked_tracking, 0) AS n_blocked_tracking, coalesce(n_blocked_other, 0) AS n_blocked_other, coalesce(blocked_observed_bytes, 0) AS blocked_observed_bytes, coalesce(blocked_matched, 0) AS blocked_matched, coalesce(blocked_unmatched, 0) AS blocked_unmatched,
  n_requests_normal - n_requests_private AS n_requests_delta, transfer_bytes_normal - transfer_bytes_private AS bytes_saved, tracker_bytes_normal - tracker_bytes_private AS bytes_saved_tracking, unlisted_tp_bytes_normal - unlisted_tp_bytes_private AS bytes_saved_unlisted_tp
  FROM arm_normal n JOIN arm_private p USING (rep, page_idx) LEFT JOIN bl USING (rep, page_idx))"""


def matched(spark, sf):
    return P.bag_match(S.blocked(spark, sf), S.control(spark, sf))


def pages(spark, sf):
    return S.requests(spark, sf).select("page_idx", F.concat(F.lit("https://"), "page_domain", F.lit("/")).alias("page_url")).distinct()


def saved(spark, sf):
    """bytes_saved of page loads alone, for queries that need nothing of lists or blocked requests."""
    return P.bytes_saved(S.control(spark, sf), S.private(spark, sf))


def paired(spark, sf):
    return P.paired_pages(S.control(spark, sf), S.private(spark, sf), S.blocked(spark, sf), pages(spark, sf), S.rules(spark))


def touched(spark, sf):
    """paired for queries that need no third-party bytes and no matches: sums by page load alone are shuffled."""
    return P.touched_pages(S.control(spark, sf), S.private(spark, sf), S.blocked(spark, sf), S.rules(spark))


@query(f"WITH {MATCHED} SELECT rep, page_idx, pos, observed_bytes, match_kind FROM bag")
def bag_matches(spark, sf):
    """JN9-10, WIN3: each blocked request's observation in the control arm."""
    return matched(spark, sf).select("rep", "page_idx", "pos", "observed_bytes", "match_kind")


@query(f"WITH {MATCHED} SELECT rep, match_kind, count(*) AS n, coalesce(sum(observed_bytes), 0)::BIGINT AS bytes FROM bag GROUP BY 1, 2")
def match_kinds(spark, sf):
    """PAIR2, PAIR11: match kinds of every pass."""
    return matched(spark, sf).groupBy("rep", "match_kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("observed_bytes"), F.lit(0)).alias("bytes"))


@query(f"""WITH {S.WITH_PAIRED}, a AS (SELECT rep, page_idx, url, pos, row_number() OVER (PARTITION BY rep, page_idx, url ORDER BY pos) AS k FROM control_obs), b AS (SELECT rep, page_idx, url, row_number() OVER (PARTITION BY rep, page_idx, url ORDER BY pos) AS k FROM private_obs)
 SELECT a.rep, a.page_idx, a.pos FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rep = a.rep AND b.page_idx = a.page_idx AND b.url = a.url AND b.k = a.k)""")
def bag_difference(spark, sf):
    """JN11, SET6: observations beyond those of the other arm."""
    return P.bag_difference(S.control(spark, sf), S.private(spark, sf)).select("rep", "page_idx", "pos")


@query(f"WITH {PAIRED} SELECT *, CASE WHEN transfer_bytes_normal <> 0 THEN round(100.0 * bytes_saved / transfer_bytes_normal + 1e-9, 2) + 0.0 END AS pct_bytes_saved FROM paired")
def paired_pages(spark, sf):
    """JN8, PAIR1, AGG23: both arms of every page and repetition."""
    return paired(spark, sf).withColumn("pct_bytes_saved", F.when(F.col("transfer_bytes_normal") != 0, F.round(100.0 * F.col("bytes_saved") / F.col("transfer_bytes_normal") + 1e-9, 2) + 0.0))


@query(f"WITH {PAIRED} SELECT page_idx, count(*) AS n_reps, sum(transfer_bytes_normal)::BIGINT AS transfer_bytes_normal, sum(bytes_saved)::BIGINT AS bytes_saved, round(avg(n_requests_delta), 2) AS n_requests_delta FROM paired WHERE page_idx % 11 <> 0 GROUP BY page_idx")
def pooled_pages(spark, sf):
    """FLT10-11, AGG18, PAIR3, SET5: pages that are clean in every repetition, pooled."""
    rows = touched(spark, sf).withColumns({"outcome_normal": F.lit("ok"), "outcome_private": F.when((F.col("page_idx") % 11 == 0) & (F.col("rep") == 2), "timeout").otherwise("ok")})
    clean = rows.join(O.clean_everywhere(rows), "page_idx", "left_semi")
    return O.pool_pages(clean, ["transfer_bytes_normal", "bytes_saved"], ["n_requests_delta"]).drop("pct_bytes_saved")


@query(f"""WITH {PAIRED}, q AS (SELECT avg(bytes_saved) AS d, avg(bytes_saved_tracking) AS dt FROM paired WHERE n_blocked_tracking = 0), m AS (SELECT count(*) FILTER (WHERE n_blocked_tracking > 0) AS n, count(*) FILTER (WHERE n_blocked_tracking = 0) AS u, sum(CASE WHEN n_blocked_tracking > 0 THEN bytes_saved END) AS b, sum(CASE WHEN n_blocked_tracking > 0 THEN bytes_saved_tracking END) AS bt FROM paired)
 SELECT n AS n_pages_with_blocks, u AS n_pages_without_blocks, round(b - d * n, 2) AS whole, round(b, 2) AS whole_raw, round(d, 6) AS whole_drift, round(bt - dt * n, 2) AS tracking, round(bt, 2) AS tracking_raw, round(dt, 6) AS tracking_drift FROM m, q""")
def measured_saving(spark, sf):
    """AGG21: savings corrected by the drift of untouched pages."""
    m = O.measure(touched(spark, sf), {"whole": "bytes_saved", "tracking": "bytes_saved_tracking"})
    return m.select(*(F.round(c, 6 if c.endswith("drift") else 2).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


@query(f"""WITH {PAIRED} SELECT round(100.0 * (SELECT stddev_samp(bytes_saved_tracking) FROM paired WHERE n_blocked_tracking = 0) * sqrt(count(*)) / sum(bytes_saved_tracking), 6) AS churn_se_pct FROM paired WHERE n_blocked_tracking > 0""")
def churn_error(spark, sf):
    """AGG22: churn as a standard error in percent."""
    return rounded(O.churn_se_pct(touched(spark, sf), "bytes_saved_tracking"))


@query(f"""WITH {PAIRED}, t AS (SELECT DISTINCT page_idx FROM paired WHERE n_blocked_tracking > 0), r AS (SELECT rep, sum(CASE WHEN t.page_idx IS NOT NULL THEN bytes_saved ELSE 0 END)::DOUBLE AS total, stddev_samp(CASE WHEN t.page_idx IS NULL THEN bytes_saved END) AS q FROM paired p LEFT JOIN t USING (page_idx) GROUP BY rep),
 a AS (SELECT count(*) AS n_reps, (SELECT count(*) FROM t) AS nt, avg(total) AS m, stddev_samp(total) AS sd, avg(q * sqrt((SELECT count(*) FROM t))) AS churn FROM r)
 SELECT n_reps, nt AS n_pages_touched, round(m, 1) AS per_rep_mean, round(sd, 1) AS per_rep_sd, round(sd / sqrt(n_reps), 1) AS pooled_se, round(100.0 * sd / sqrt(n_reps) / abs(m), 2) AS pooled_se_pct, round(100.0 * sd / abs(m), 2) AS single_rep_sd_pct, round(100.0 * churn / abs(m), 2) AS churn_proxy_se_pct FROM a""")
def rep_dispersion(spark, sf):
    """AGG20: dispersion over repetitions, and the churn proxy."""
    return O.dispersion(touched(spark, sf), "bytes_saved")


@query(f"""WITH {PAIRED}, i AS (SELECT page_idx, stddev_samp(bytes_saved) / avg(transfer_bytes_normal) AS instability FROM paired GROUP BY 1 HAVING count(*) >= 2 AND avg(transfer_bytes_normal) > 0) SELECT page_idx, round(instability, 8) AS instability FROM i WHERE instability <= 1.0""")
def page_instability(spark, sf):
    """AGG19, FLT15, AGG40-41: deviation of a page's repetitions over its size; unstable pages are left out."""
    return rounded(O.instability(touched(spark, sf)).where("instability <= 1.0"), 8)


@query(f"""WITH {PAIRED}, t AS (SELECT sum(bytes_saved_tracking)::DOUBLE AS tn, sum(transfer_bytes_normal)::DOUBLE AS td FROM paired) SELECT rep, page_idx, round(tn / td, 9) AS ratio, round((tn - bytes_saved_tracking) / (td - transfer_bytes_normal), 9) AS ratio_without FROM paired, t""")
def leave_one_page_out(spark, sf):
    """AGG50: the ratio without each page, from one set of totals."""
    from tallybrook.operators.evaluate import leave_one_out

    return rounded(leave_one_out(touched(spark, sf), "bytes_saved_tracking", "transfer_bytes_normal").select("rep", "page_idx", "ratio", "ratio_without"), 9)


@query(f"""WITH {S.WITH_PAIRED} SELECT rep, page_idx, sum({_SIZED})::BIGINT AS bytes, count(*) AS n, count(*) FILTER (WHERE transfer_size IS NULL OR transfer_size <= 0) AS n_no_size, sum(CASE WHEN resource_type = 'script' THEN {_SIZED} ELSE 0 END)::BIGINT AS script_bytes, count(DISTINCT resource_type) AS n_types FROM control_obs GROUP BY 1, 2""")
def har_rollup(spark, sf):
    """SRC8, AGG16: a page's requests, bytes by type as a map, and requests without a size."""
    obs = S.control(spark, sf).withColumn("size", F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0)))
    by_type = obs.groupBy("rep", "page_idx", "resource_type").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("transfer_size", F.lit(0)) <= 0).alias("no_size"))
    page = by_type.groupBy("rep", "page_idx").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.sum("no_size").alias("n_no_size"), F.map_from_entries(F.collect_list(F.struct("resource_type", "bytes"))).alias("bytes_by_type"))
    return page.select("rep", "page_idx", "bytes", "n", "n_no_size", F.coalesce(F.col("bytes_by_type")["script"], F.lit(0)).alias("script_bytes"), F.size("bytes_by_type").alias("n_types"))


@query(f"""WITH {S.WITH_PAIRED} SELECT rep, url, page_idx, arg_min(resource_type, pos) AS resource_type, arg_min({_SIZED}, pos)::BIGINT AS size, count(*) AS n FROM control_obs GROUP BY 1, 2, 3""")
def first_of_url(spark, sf):
    """SRC11, PAIR10: the first occurrence of a URL on a page wins."""
    size = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0))
    return S.control(spark, sf).groupBy("rep", "url", "page_idx").agg(F.min_by("resource_type", "pos").alias("resource_type"), F.min_by(size, "pos").alias("size"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.WITH_PAIRED} SELECT rep, outcome, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT rep, page_idx, CASE WHEN page_idx % 13 = 0 THEN 'timeout' ELSE 'ok' END AS outcome, sum({_SIZED}) AS bytes FROM control_obs GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def arm_outcomes(spark, sf):
    """AGG17, SRT2: pages and bytes by outcome."""
    size = F.greatest(F.coalesce("transfer_size", F.lit(0)), F.lit(0))
    pages = S.control(spark, sf).groupBy("rep", "page_idx", F.when(F.col("page_idx") % 13 == 0, "timeout").otherwise("ok").alias("outcome")).agg(F.sum(size).alias("bytes"))
    return pages.groupBy("rep", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).orderBy("rep", "outcome")


#: Redirects: every seventh observation of a page redirects to the page's next one.
@query(f"""WITH RECURSIVE {S.WITH_REQUESTS}, e AS (SELECT page_idx, pos, url, CASE WHEN pos % 3 <> 0 THEN lead(url) OVER (PARTITION BY page_idx ORDER BY pos) END AS nxt FROM requests), st AS (SELECT page_idx, url, arg_min(nxt, pos) AS nxt FROM e WHERE nxt IS NOT NULL GROUP BY 1, 2),
 w AS (SELECT page_idx, url, url AS cur, 0 AS hop FROM requests WHERE pos = 1 UNION ALL SELECT w.page_idx, w.url, st.nxt, hop + 1 FROM w JOIN st ON st.page_idx = w.page_idx AND st.url = w.cur WHERE hop < 10) SELECT page_idx, url, arg_max(cur, hop) AS final_url FROM w GROUP BY 1, 2""")
def redirect_ends(spark, sf):
    """JN13: where a page's redirects end, ten hops at most."""
    log = S.requests(spark, sf)
    nxt = F.when(F.col("pos") % 3 != 0, F.lead("url").over(Window.partitionBy("page_idx").orderBy("pos")))
    return P.redirects(log.select("page_idx", "pos", "url", nxt.alias("redirect_url")), log.where("pos = 1").select("page_idx", "url"))


#: Ablation cells: a page's arms by width, with a third of the difference as the host's own bytes.
_CELLS = f"""{PAIRED}, cells AS (SELECT p.page_idx, p.rep, u.width, u.c AS control_bytes, u.a AS ablated_bytes, floor((u.c - u.a) / 3.0)::BIGINT AS own_bytes, u.c - u.a - floor((u.c - u.a) / 3.0)::BIGINT AS diff_bytes, p.n_blocked_tracking AS n_aborted, 'site' || (p.page_idx % 9)::VARCHAR || '.' || CASE WHEN p.page_idx % 2 = 0 THEN 'adnet.example' ELSE 'metrics.example' END AS host
 FROM paired p, LATERAL (SELECT unnest(['page', 'third_party', 'listed']) AS width, unnest([transfer_bytes_normal, tracker_bytes_normal + unlisted_tp_bytes_normal, tracker_bytes_normal]) AS c, unnest([transfer_bytes_private, tracker_bytes_private + unlisted_tp_bytes_private, tracker_bytes_private]) AS a) u WHERE p.n_blocked_tracking > 0)"""


def cells(spark, sf):
    p = paired(spark, sf).where("n_blocked_tracking > 0")
    widths = {"page": (F.col("transfer_bytes_normal"), F.col("transfer_bytes_private")), "third_party": (F.col("tracker_bytes_normal") + F.col("unlisted_tp_bytes_normal"), F.col("tracker_bytes_private") + F.col("unlisted_tp_bytes_private")), "listed": (F.col("tracker_bytes_normal"), F.col("tracker_bytes_private"))}
    for w, (c, a) in widths.items():
        p = p.withColumns({f"control_{w}": c, f"ablated_{w}": a, f"own_{w}": F.floor((c - a) / 3.0)})
    host = F.concat(F.lit("site"), (F.col("page_idx") % 9).cast("string"), F.lit("."), F.when(F.col("page_idx") % 2 == 0, "adnet.example").otherwise("metrics.example"))
    return P.unpivoted(p.withColumns({"n_aborted": F.col("n_blocked_tracking"), "host": host}), ["page_idx", "rep", "n_aborted", "host"])


@query(f"WITH {_CELLS} SELECT page_idx, rep, width, control_bytes, ablated_bytes, own_bytes, diff_bytes FROM cells")
def ablation_cells(spark, sf):
    """PAIR6, PAIR9, SRC12: differences by width, unpivoted."""
    return cells(spark, sf).select("page_idx", "rep", "width", "control_bytes", "ablated_bytes", "own_bytes", "diff_bytes")


@query(f"WITH {_CELLS} SELECT width, round(sum(diff_bytes)::DOUBLE / sum(n_aborted), 6) AS per_request, count(*) AS n, round(avg(diff_bytes), 4) AS mean, round(stddev_samp(diff_bytes), 3) AS sd FROM cells GROUP BY width")
def cascade_per_request(spark, sf):
    """AGG39, AGG41: cascade for each aborted request by width."""
    g = cells(spark, sf).groupBy("width").agg((F.sum("diff_bytes").cast("double") / F.sum("n_aborted")).alias("per_request"), F.count(F.lit(1)).alias("n"), F.avg("diff_bytes").alias("mean"), F.stddev_samp(F.col("diff_bytes").cast("double")).alias("sd"))
    return g.select("width", F.round("per_request", 6).alias("per_request"), "n", F.round("mean", 4).alias("mean"), F.round("sd", 3).alias("sd"))


@query(f"WITH {_CELLS} SELECT page_idx, rep, sum(CASE width WHEN 'third_party' THEN diff_bytes WHEN 'listed' THEN -diff_bytes ELSE 0 END)::BIGINT AS unlisted, round(sum(CASE WHEN width = 'page' THEN diff_bytes END)::DOUBLE / nullif(sum(CASE WHEN width = 'listed' THEN diff_bytes END), 0), 6) AS page_to_listed FROM cells GROUP BY 1, 2")
def width_differences(spark, sf):
    """AGG43, PAIR8: the unlisted part, and ratios between widths, by pivoted sums."""
    of = lambda w: F.sum(F.when(F.col("width") == w, F.col("diff_bytes")))
    g = cells(spark, sf).groupBy("page_idx", "rep").agg((of("third_party") - of("listed")).alias("unlisted"), F.try_divide(of("page").cast("double"), of("listed")).alias("page_to_listed"))
    return g.select("page_idx", "rep", "unlisted", F.round("page_to_listed", 6).alias("page_to_listed"))


@query(f"""WITH {_CELLS}, o AS (SELECT lower(host) AS h, array_to_string(list_slice(string_split(lower(host), '.'), -2, -1), '.') AS s, diff_bytes::DOUBLE / n_aborted AS v FROM cells WHERE width = 'listed'), g AS (SELECT avg(v) AS g FROM o),
 sf AS (SELECT s AS key, avg(v) / (SELECT g FROM g) AS scale FROM o GROUP BY 1 HAVING count(*) >= 2), xh AS (SELECT h AS key, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS s, avg(v) / (SELECT g FROM g) AS scale FROM o GROUP BY 1 HAVING count(*) >= 2)
 SELECT key, round(scale, 8) AS scale, 'suffix' AS kind FROM sf UNION ALL SELECT xh.key, round(xh.scale, 8), 'exact' FROM xh LEFT JOIN sf ON xh.s = sf.key WHERE sf.key IS NULL OR abs(xh.scale - sf.scale) > 0.05""")
def host_scales(spark, sf):
    """AGG44: suffix scales, and hosts that differ from theirs."""
    own = kept(cells(spark, sf).where("width = 'listed'").select("host", (F.col("diff_bytes").cast("double") / F.col("n_aborted")).alias("v")))  # read five times
    return rounded(G.host_scales(own, "host", "v", keep=0.05), 8)


@query(f"WITH {S.WITH_PAIRED}, h AS (SELECT rep, page_idx, {LHOST} AS host, count(*) AS k FROM blocked WHERE resource_type IN ('script', 'html') GROUP BY 1, 2, 3) SELECT rep, page_idx, sum(k)::BIGINT AS n_requests, count(*) AS n_hosts, round(sum(1 + 0.25 * (k - 1)), 6) AS units FROM h GROUP BY 1, 2")
def host_units(spark, sf):
    """AGG47: cascading hosts of a page, and units that discount repeats."""
    b = S.blocked(spark, sf).where("resource_type in ('script', 'html')").withColumn("host", U.net_host(F.col("url")))
    return rounded(G.host_units(b, ["rep", "page_idx"], 0.25))


@query(f"""WITH {PAIRED}, n AS (SELECT rep, page_idx, count(*) AS k FROM blocked WHERE resource_type IN ('script', 'html') GROUP BY 1, 2), j AS (SELECT k, bytes_saved FROM n JOIN paired USING (rep, page_idx))
 SELECT CASE WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 7 THEN '4-7' WHEN k <= 15 THEN '8-15' ELSE '16+' END AS bucket, count(*) AS n_pages, sum(k)::BIGINT AS n_requests, round(sum(bytes_saved)::DOUBLE / sum(k), 6) AS per_request FROM j GROUP BY 1""")
def saturation(spark, sf):
    """AGG48, ML20: saving for each cascading request by their number on the page."""
    n = S.blocked(spark, sf).where("resource_type in ('script', 'html')").groupBy("rep", "page_idx").agg(F.count(F.lit(1)).alias("k"))
    return rounded(G.saturation(n.join(touched(spark, sf), ["rep", "page_idx"]), "k", "bytes_saved"))


@query(f"""WITH {PAIRED}, s AS (SELECT page_idx, rep AS k, sum(bytes_saved)::BIGINT AS saved FROM paired GROUP BY 1, 2) SELECT page_idx, k, saved - lag(saved) OVER (PARTITION BY page_idx ORDER BY k) AS marginal FROM s""")
def marginal_steps(spark, sf):
    """JN18, WIN4, SRC13: a step's saving over the step before it."""
    s = touched(spark, sf).select("page_idx", F.col("rep").alias("k"), F.col("bytes_saved").alias("saved"))
    w = Window.partitionBy("page_idx").orderBy("k")
    return s.select("page_idx", "k", F.when(F.lag("k").over(w) == F.col("k") - 1, F.col("saved") - F.lag("saved").over(w)).alias("marginal"))


@query(f"""WITH {S.WITH_PAIRED}, n AS (SELECT page_idx, (page_idx % 7)::BIGINT AS category, count(*) AS n_blocked FROM blocked GROUP BY 1, 2 HAVING count(*) >= 3) SELECT category, page_idx, n_blocked FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_blocked DESC, page_idx) AS r FROM n) WHERE r <= 25""")
def pages_to_follow(spark, sf):
    """PAIR7, SRT1: the most blocked pages of each category."""
    n = S.blocked(spark, sf).groupBy("page_idx", (F.col("page_idx") % 7).alias("category")).agg(F.count(F.lit(1)).alias("n_blocked")).where("n_blocked >= 3")
    return n.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n_blocked"), "page_idx"))).where("r <= 25").drop("r").orderBy("category", "page_idx")
