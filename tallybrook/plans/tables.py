"""Queries over look-up tables, the size table, scoring and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybrook.functions import requests as R
from tallybrook.functions import urls as U
from tallybrook.operators import evaluate as V
from tallybrook.operators import lookup as L
from tallybrook.operators import size_table as T
from tallybrook.operators.ranks import counted, key_percentiles, percentiles
from tallybrook.plans.features import LHOST, PATH, QUERY, rounded
from tallybrook.plans.registry import query
from tallybrook.sources import fixtures as S

#: Early pages train and late ones test: a split by month that both engines read off the date.
_SPLIT = f"""{S.WITH_REQUESTS}, log AS (SELECT *, {LHOST} AS host, {PATH} AS path, date < DATE '1996-07-01' AS train FROM requests WHERE transfer_bytes IS NOT NULL),
 tr AS (SELECT * FROM log WHERE train), te AS (SELECT * FROM log WHERE NOT train)"""


def split(spark, sf):
    u = F.col("url")
    log = S.requests(spark, sf).where("transfer_bytes is not null").withColumns({"host": U.net_host(u), "path": U.rule_path(u)})
    return log.where("date < date'1996-07-01'"), log.where("date >= date'1996-07-01'")


def _chain(agg: str) -> str:
    f = {"median": "median", "mean": "avg"}[agg]
    return f"""{_SPLIT}, lp AS (SELECT host, path, {f}(transfer_bytes) AS v FROM tr GROUP BY 1, 2), lt AS (SELECT host, resource_type, {f}(transfer_bytes) AS v FROM tr GROUP BY 1, 2), lh AS (SELECT host, {f}(transfer_bytes) AS v FROM tr GROUP BY 1), lg AS (SELECT {f}(transfer_bytes) AS v FROM tr),
 pred AS (SELECT te.*, coalesce(lp.v, lt.v, lh.v, lg.v) AS pred, CASE WHEN lp.v IS NOT NULL THEN 0 WHEN lt.v IS NOT NULL THEN 1 WHEN lh.v IS NOT NULL THEN 2 ELSE 3 END AS pred_level FROM te LEFT JOIN lp ON te.host = lp.host AND te.path = lp.path LEFT JOIN lt ON te.host = lt.host AND te.resource_type = lt.resource_type LEFT JOIN lh ON te.host = lh.host CROSS JOIN lg)"""


LEVELS = [["host", "path"], ["host", "resource_type"], ["host"]]


def predicted(spark, sf, how="median"):
    train, test = split(spark, sf)
    return L.fall_back(test, train, LEVELS, "transfer_bytes", "pred", how)


@query(f"WITH {_chain('median')} SELECT pred_level, count(*) AS n, round(avg(abs(pred - transfer_bytes)), 4) AS mae, round(median(abs(pred - transfer_bytes)), 4) AS median_ae FROM pred GROUP BY 1")
def path_table_median(spark, sf):
    """AGG4, JN5, EST7: path, host and type, host, global medians in turn."""
    gaps = predicted(spark, sf).withColumn("gap", F.abs(F.col("pred") - F.col("transfer_bytes")))
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    return rounded(percentiles(gaps, "gap", {"median_ae": 0.5}, ["pred_level"], F.sum("n").alias("n"), mean.alias("mae")).select("pred_level", "n", "mae", "median_ae"), 4)


@query(f"WITH {_chain('mean')} SELECT resource_type, count(*) AS n, round(avg(abs(pred - transfer_bytes)), 4) AS mae, round(sum(pred) / sum(transfer_bytes), 6) AS ratio FROM pred GROUP BY 1")
def path_table_mean(spark, sf):
    """AGG5, AGG33: the same with means, by resource type."""
    return predicted(spark, sf, "mean").groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("transfer_bytes"))), 4).alias("mae"), F.round(F.sum("pred") / F.sum("transfer_bytes"), 6).alias("ratio"))


@query(f"""WITH {_SPLIT}, m AS (SELECT host, path, avg(transfer_bytes) AS v, count(*) AS n FROM tr GROUP BY 1, 2), f AS (SELECT host, resource_type, avg(transfer_bytes) AS v FROM tr GROUP BY 1, 2), g AS (SELECT avg(transfer_bytes) AS v FROM tr),
 pred AS (SELECT k.k, transfer_bytes AS y, coalesce((m.n * m.v + k.k * g.v) / (m.n + k.k), f.v, g.v) AS p FROM te CROSS JOIN g CROSS JOIN (SELECT 5 AS k UNION ALL SELECT 20) k LEFT JOIN m ON te.host = m.host AND te.path = m.path LEFT JOIN f ON te.host = f.host AND te.resource_type = f.resource_type)
 SELECT k, round(avg(abs(p - y)), 4) AS mae FROM pred GROUP BY k""")
def smoothed_path_table(spark, sf):
    """AGG6: smoothed path means for two weights."""
    train, test = split(spark, sf)
    rows = [L.smoothed(test, train, ["host", "path"], "transfer_bytes", k, ["host", "resource_type"]).agg(F.lit(k).alias("k"), F.round(F.avg(F.abs(F.col("pred") - F.col("transfer_bytes"))), 4).alias("mae")) for k in (5, 20)]
    return S.union_all(*rows)


@query(f"""WITH {_chain('median')}, e AS (SELECT pred AS p, transfer_bytes AS a, abs(pred - transfer_bytes) AS g FROM pred)
 SELECT count(*) AS n, round(avg(g), 4) AS mae, round(median(g), 4) AS median_ae, round(sqrt(avg(g * g)), 4) AS rmse, round(avg(CASE WHEN a > 1000 THEN g / a END) * 100, 6) AS mape, round(sum(p), 2) AS pred_total, round(sum(a), 2) AS actual_total, round(sum(p) / sum(a), 6) AS ratio FROM e""")
def evaluation(spark, sf):
    """AGG26-27: the error figures of a prediction."""
    e = V.errors(predicted(spark, sf), "pred", "transfer_bytes")
    return e.select("n", *(F.round(c, 4).alias(c) for c in ("mae", "median_ae", "rmse")), F.round("mape", 6).alias("mape"), *(F.round(c, 2).alias(c) for c in ("pred_total", "actual_total")), F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_chain('median')}, r AS (SELECT rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS a, rank() OVER (ORDER BY transfer_bytes) + (count(*) OVER (PARTITION BY transfer_bytes) - 1) / 2.0 AS b FROM pred) SELECT round(corr(a, b), 8) AS spearman FROM r""")
def rank_correlation(spark, sf):
    """AGG28: Spearman correlation with averaged ties."""
    return rounded(V.spearman(predicted(spark, sf), "pred", "transfer_bytes"), 8)


@query(f"""WITH {_chain('mean')}, t AS (SELECT page_idx, sum(pred) / sum(transfer_bytes) AS r FROM pred GROUP BY 1 HAVING sum(transfer_bytes) > 0)
 SELECT count(*) AS n_pages, round(median(r), 6) AS median_ratio, round(avg(CASE WHEN abs(r - 1) <= 0.1 THEN 1.0 ELSE 0 END), 6) AS within_10pct, round(avg(CASE WHEN abs(r - 1) <= 0.25 THEN 1.0 ELSE 0 END), 6) AS within_25pct, round(avg(CASE WHEN abs(r - 1) <= 0.5 THEN 1.0 ELSE 0 END), 6) AS within_50pct FROM t""")
def page_rates(spark, sf):
    """AGG29: pages within a share of their actual total."""
    return rounded(V.page_rates(predicted(spark, sf, "mean"), ["page_idx"], "pred", "transfer_bytes"))


_EDGES = [0, 1000, 10000, 20000, 30000, 40000, 50000, 75000, 100000, 1e12]


@query(f"""WITH {_chain('mean')}, b AS (SELECT {' + '.join(f'(pred > {e})::INTEGER' for e in _EDGES[1:-1])} AS bin, pred AS p, transfer_bytes AS a FROM pred WHERE pred > 0)
 SELECT bin, count(*) AS n, round(avg(p), 4) AS pred_mean, round(avg(a), 4) AS actual_mean, round(median(a), 4) AS actual_median, round(avg(abs(p - a)), 4) AS mae, round(avg(CASE WHEN abs(p - a) <= 0.25 * a THEN 1.0 ELSE 0 END), 6) AS within_25pct FROM b GROUP BY bin HAVING count(*) >= 10""")
def calibration(spark, sf):
    """AGG31: calibration in bins of the prediction."""
    c = V.calibration(predicted(spark, sf, "mean"), "pred", "transfer_bytes", _EDGES)
    return c.select("bin", "n", *(F.round(x, 4).alias(x) for x in ("pred_mean", "actual_mean", "actual_median", "mae")), F.round("within_25pct", 6).alias("within_25pct"))


@query(f"""WITH {_chain('mean')}, c AS (SELECT quantile_cont(pred, 0.2) AS a, quantile_cont(pred, 0.4) AS b, quantile_cont(pred, 0.6) AS c, quantile_cont(pred, 0.8) AS d FROM pred)
 SELECT (pred > a)::INTEGER + (pred > b)::INTEGER + (pred > c)::INTEGER + (pred > d)::INTEGER AS bin, count(*) AS n, round(avg(transfer_bytes), 4) AS mean_value FROM pred, c GROUP BY 1""")
def score_quintiles(spark, sf):
    """AGG32: quintile bins in which equal scores share a bin."""
    return rounded(V.quantile_bins(predicted(spark, sf, "mean"), "pred", "transfer_bytes"), 4)


@query(f"""WITH {_SPLIT}, q AS (SELECT host, quantile_cont(transfer_bytes, 0.1) AS lo, quantile_cont(transfer_bytes, 0.9) AS hi FROM tr GROUP BY 1) SELECT round(avg(CASE WHEN transfer_bytes BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 4) AS mean_width, round(median(hi - lo), 4) AS median_width FROM te JOIN q ON te.host = q.host""")
def interval_coverage(spark, sf):
    """AGG30, ML7: quantile intervals by host, and how often they hold."""
    train, test = split(spark, sf)
    q = key_percentiles(counted(train, "transfer_bytes", ["host"]), {"lo": 0.1, "hi": 0.9}, ["host"])
    c = V.coverage(test.join(q, "host"), "lo", "hi", "transfer_bytes")
    return c.select(F.round("coverage", 6).alias("coverage"), F.round("mean_width", 4).alias("mean_width"), F.round("median_width", 4).alias("median_width"))


@query(f"""WITH {_chain('mean')}, g AS (SELECT resource_type, count(*) AS n, sum(pred) AS p, sum(transfer_bytes) AS a FROM pred GROUP BY 1), t AS (SELECT sum(a) AS ta FROM g)
 SELECT resource_type, n, round(p, 2) AS pred_total, round(a, 2) AS actual_total, round((p - a) / a * 100, 6) AS bias_pct, round(a / ta, 6) AS share, round((p - a) / ta * 100, 6) AS contribution_pct FROM g, t""")
def bias_by_type(spark, sf):
    """AGG34, FLT17: bias and contribution by group."""
    c = V.contribution(predicted(spark, sf, "mean"), ["resource_type"], "pred", "transfer_bytes")
    return c.select("resource_type", "n", *(F.round(x, 2).alias(x) for x in ("pred_total", "actual_total")), *(F.round(x, 6).alias(x) for x in ("bias_pct", "share", "contribution_pct")))


@query(f"""WITH {_SPLIT}, a AS (SELECT url, count(*) AS na FROM tr GROUP BY 1), b AS (SELECT url, count(*) AS nb FROM te GROUP BY 1), m AS (SELECT * FROM a FULL JOIN b USING (url))
 SELECT count(*) FILTER (WHERE na IS NOT NULL AND nb IS NOT NULL) AS shared, count(*) FILTER (WHERE nb IS NULL) AS gone, count(*) FILTER (WHERE na IS NULL) AS new, round(sum(CASE WHEN na IS NOT NULL THEN nb ELSE 0 END) * 1.0 / sum(nb), 6) AS row_coverage FROM m""")
def key_drift(spark, sf):
    """AGG35, SET3-4: keys of both periods, and how many rows the old ones cover."""
    train, test = split(spark, sf)
    return rounded(V.key_drift(train, test, ["url"]))


@query(f"""WITH {_chain('median')}, k AS (SELECT DISTINCT url FROM tr), h AS (SELECT pred.*, k.url IS NOT NULL AS hit FROM pred LEFT JOIN k ON pred.url = k.url)
 SELECT hit, count(*) AS n, round(avg(abs(CASE WHEN hit THEN pred ELSE 25000 END - transfer_bytes)), 4) AS mae FROM h GROUP BY hit""")
def hybrid_errors(spark, sf):
    """JN15-16, SIM13: the table where it knows the URL, another predictor elsewhere."""
    train, _ = split(spark, sf)
    h = L.coverage(predicted(spark, sf), train, ["url"])
    value = L.hybrid(F.col("hit"), F.col("pred"), F.lit(25000.0))
    return h.groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(value - F.col("transfer_bytes"))), 4).alias("mae"))


@query(f"""WITH {_chain('mean')}, s AS (SELECT unnest(['as_is', 'zero', 'tenfold', 'tenth']) AS control, unnest([1.0, 0.0, 10.0, 0.1]) AS f) SELECT control, round(avg(abs(pred * f - transfer_bytes)), 3) AS mae FROM pred, s GROUP BY control""")
def negative_controls(spark, sf):
    """EST8: wrong predictors must grade worse."""
    own = predicted(spark, sf, "mean")
    cases = {"as_is": 1.0, "zero": 0.0, "tenfold": 10.0, "tenth": 0.1}
    m = own.agg(*(F.round(F.avg(F.abs(F.col("pred") * f - F.col("transfer_bytes"))), 3).alias(k) for k, f in cases.items()))
    return m.selectExpr("stack(4, " + ", ".join(f"'{k}', {k}" for k in cases) + ") as (control, mae)")


@query(f"""WITH {_chain('mean')}, g AS (SELECT resource_type, sum(pred) AS p FROM pred GROUP BY 1), m AS (SELECT 0.2 * p AS moved FROM g WHERE resource_type = 'script')
 SELECT resource_type, round(CASE resource_type WHEN 'script' THEN p - moved WHEN 'image' THEN p + moved ELSE p END, 2) AS skewed FROM g, m""")
def composition_skew(spark, sf):
    """EST10: a fifth of one group's prediction moved to another, the total kept."""
    g = predicted(spark, sf, "mean").groupBy("resource_type").agg(F.sum("pred").alias("p"))
    t = F.col("resource_type")
    return L.one_row(g, g.where(t == "script").agg((0.2 * F.sum("p")).alias("moved"))).select("resource_type", F.round(F.when(t == "script", F.col("p") - F.col("moved")).when(t == "image", F.col("p") + F.col("moved")).otherwise(F.col("p")), 2).alias("skewed"))


@query(f"""WITH {_SPLIT}, d AS (SELECT 'size' AS target, host, transfer_bytes AS y FROM tr UNION ALL SELECT 'depth', host, len(string_split(path, '/')) FROM tr) SELECT target, host, round(median(y), 4) AS med FROM d GROUP BY 1, 2""")
def targets(spark, sf):
    """EST12: the same table for several targets."""
    train, _ = split(spark, sf)
    rows = [L.table(train.withColumn("y_", y), ["host"], "y_", "med").select(F.lit(n).alias("target"), "host", F.round("med", 4).alias("med")) for n, y in (("size", F.col("transfer_bytes")), ("depth", F.size(F.split("path", "/"))))]
    return S.union_all(*rows)


def _fit_sql(shrink: float) -> str:
    group = "CASE resource_type WHEN 'script' THEN 'code' WHEN 'image' THEN 'media' WHEN 'html' THEN 'doc' ELSE 'other' END"
    keys = {
        "context": "'context|' || CASE WHEN resource_type IN ('script', 'image', 'html') THEN resource_type ELSE 'other' END",
        "ext": "'ext|' || g || '|' || ext", "ext_query": "'ext_query|' || g || '|' || ext || '|' || qb", "host_template": "'host_template|' || g || '|' || replace(host, 'a1b2c3d4e5f6', '#')",
        "host": "'host|' || g || '|' || host", "prefix": "'prefix|' || g || '|' || ext || '|' || host || array_to_string(list_slice(string_split(tpl, '/'), 1, 3), '/')",
        "template": "'template|' || g || '|' || host || tpl", "path": "'path|' || g || '|' || host || path",
    }
    sql = f"""{S.WITH_REQUESTS}, f0 AS (SELECT *, {LHOST} AS host, coalesce(nullif({PATH}, ''), '/') AS path, {group} AS g, CASE WHEN {PATH} LIKE '%.js' THEN 'js' ELSE '' END AS ext, CAST(least(floor(log2(length({QUERY}) + 1)), 12)::INTEGER AS VARCHAR) AS qb FROM requests WHERE transfer_bytes IS NOT NULL AND http_method NOT IN ('HEAD', 'OPTIONS')),
 f1 AS (SELECT *, regexp_replace(path, 'm202401([0-9]+)', '#') AS tpl FROM f0), c0 AS (SELECT transfer_bytes::DOUBLE AS y, (SELECT avg(transfer_bytes) FROM f1) AS parent, {', '.join(f'{e} AS k_{k}' for k, e in keys.items())} FROM f1)"""
    for n, k in enumerate(keys):
        sql += f""", s{n} AS (SELECT '{k}' AS level, k_{k} AS key, count(*) AS n, avg(y) AS mean, avg(parent) AS parent, (count(*) * avg(y) + {shrink} * avg(parent)) / (count(*) + {shrink}) AS est FROM c{n} GROUP BY k_{k}),
 c{n + 1} AS (SELECT c.* EXCLUDE (parent), coalesce(s.est, c.parent) AS parent FROM c{n} c LEFT JOIN s{n} s ON c.k_{k} = s.key)"""
    return sql + ", fitted AS (" + " UNION ALL ".join(f"SELECT *, n * abs(est - parent) AS gain FROM s{n}" for n in range(len(keys))) + ")"


def fitted(spark, sf, shrink=0.0):
    body, _ = T.split_bodyless(S.requests(spark, sf))
    return T.fit_levels(T.features(T.alike(body)), shrink)


@query(f"WITH {_fit_sql(2.0)} SELECT level, key, n, round(mean + 1e-7, 4) AS mean, round(parent + 1e-7, 4) AS parent, round(est + 1e-7, 4) AS est, round(gain + 1e-5, 2) AS gain FROM fitted")
def size_table(spark, sf):
    """AGG7, URL12-16, EST6: the hierarchical fit, every key of every level."""
    f = fitted(spark, sf, 2.0)
    return f.select("level", "key", "n", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mean", "parent", "est")), F.round(F.col("gain") + 1e-5, 2).alias("gain"))  # off the halves, where engines' last bits differ


@query(f"WITH {_fit_sql(0.0)} SELECT level, key, n, round(est + 1e-7, 4) AS est FROM fitted WHERE level <> 'context' ORDER BY round(gain, 3) DESC, level, key LIMIT 500")
def size_table_choice(spark, sf):
    """TOP2: the budget's entries of most gain."""
    rough = fitted(spark, sf).withColumn("gain", F.round("gain", 3))  # so that equal gains tie in any engine
    return T.choose(rough, 500).select("level", "key", "n", F.round(F.col("est") + 1e-7, 4).alias("est"))


@query(f"""WITH {S.WITH_REQUESTS}, m AS (SELECT CASE WHEN resource_type IN ('script', 'image', 'html') THEN resource_type ELSE 'other' END AS context, avg(transfer_bytes) AS v FROM requests WHERE transfer_bytes IS NOT NULL AND http_method NOT IN ('HEAD', 'OPTIONS') GROUP BY 1),
 c AS (SELECT unnest(['script', 'image', 'video', 'other', 'audio', 'css', 'font', 'html', 'text', 'wasm', 'xml']) AS context) SELECT c.context, round(coalesce(m.v, (SELECT avg(transfer_bytes) FROM requests WHERE transfer_bytes IS NOT NULL AND http_method NOT IN ('HEAD', 'OPTIONS'))), 4) AS fallback,
 round((SELECT avg(transfer_bytes) FROM requests WHERE transfer_bytes IS NOT NULL AND http_method IN ('HEAD', 'OPTIONS')), 4) AS bodyless FROM c LEFT JOIN m ON c.context = m.context""")
def context_fallbacks(spark, sf):
    """AGG8-9, REQ5: fall-backs by context and the bodyless mean."""
    body, quiet = T.split_bodyless(S.requests(spark, sf))
    f = T.context_fallback(T.fit_levels(T.features(T.alike(body))), body)
    return rounded(L.one_row(f, T.bodyless_mean(quiet, 300.0)), 4)


_RATE = "CASE context WHEN 'script' THEN 2.0 WHEN 'html' THEN 0.3 ELSE 0.1 END"
_SCALE = "CASE match_level WHEN 'path' THEN 1.07 WHEN 'template' THEN 0.95 WHEN 'prefix' THEN 1.05 WHEN 'host' THEN 1.07 WHEN 'host_template' THEN 0.94 WHEN 'ext_query' THEN 1.09 WHEN 'bodyless' THEN 1.0 ELSE 1.07 END"
_HOST_SCALES = "SELECT * FROM (VALUES ('adnet.example', 1.2), ('tag.adnet.example', 0.7), ('metrics.example', 1.5)) AS t(key, scale)"
#: Scoring in SQL: chosen entries by level, and the most specific one for each request.
SCORED = f"""{_fit_sql(0.0)}, chosen AS (SELECT level, key, est FROM fitted WHERE level <> 'context' ORDER BY round(gain, 3) DESC, level, key LIMIT 500),
 r0 AS (SELECT *, {LHOST} AS host, coalesce(nullif({PATH}, ''), '/') AS path, CASE WHEN resource_type IN ('script', 'image', 'html') THEN resource_type ELSE 'other' END AS context, CASE resource_type WHEN 'script' THEN 'code' WHEN 'image' THEN 'media' WHEN 'html' THEN 'doc' ELSE 'other' END AS g,
  CASE WHEN {PATH} LIKE '%.js' THEN 'js' ELSE '' END AS ext, CAST(least(floor(log2(length({QUERY}) + 1)), 12)::INTEGER AS VARCHAR) AS qb FROM requests), r1 AS (SELECT *, regexp_replace(path, 'm202401([0-9]+)', '#') AS tpl FROM r0),
 e AS (SELECT r.*, k1.est AS e1, k2.est AS e2, k3.est AS e3, k4.est AS e4, k5.est AS e5, k6.est AS e6, k7.est AS e7 FROM r1 r LEFT JOIN chosen k1 ON k1.key = 'path|' || g || '|' || host || path LEFT JOIN chosen k2 ON k2.key = 'template|' || g || '|' || host || tpl
  LEFT JOIN chosen k3 ON k3.key = 'prefix|' || g || '|' || ext || '|' || host || array_to_string(list_slice(string_split(tpl, '/'), 1, 3), '/') LEFT JOIN chosen k4 ON k4.key = 'host|' || g || '|' || host LEFT JOIN chosen k5 ON k5.key = 'host_template|' || g || '|' || replace(host, 'a1b2c3d4e5f6', '#')
  LEFT JOIN chosen k6 ON k6.key = 'ext_query|' || g || '|' || ext || '|' || qb LEFT JOIN chosen k7 ON k7.key = 'ext|' || g || '|' || ext),
 v AS (SELECT e.*, http_method IN ('HEAD', 'OPTIONS') AS quiet, CASE WHEN http_method IN ('HEAD', 'OPTIONS') THEN 'bodyless' WHEN e1 IS NOT NULL THEN 'path' WHEN e2 IS NOT NULL THEN 'template' WHEN e3 IS NOT NULL THEN 'prefix' WHEN e4 IS NOT NULL THEN 'host' WHEN e5 IS NOT NULL THEN 'host_template' WHEN e6 IS NOT NULL THEN 'ext_query' WHEN e7 IS NOT NULL THEN 'ext' ELSE 'context' END AS match_level,
  coalesce(e1, e2, e3, e4, e5, e6, e7, (SELECT f.est FROM fitted f WHERE f.level = 'context' AND f.key = 'context|' || e.context)) AS value FROM e),
 scored AS (SELECT v.*, CAST(round(CASE WHEN quiet THEN (SELECT avg(transfer_bytes) FROM requests WHERE transfer_bytes IS NOT NULL AND http_method IN ('HEAD', 'OPTIONS')) ELSE value END) AS BIGINT) AS est_bytes FROM v)"""


def scorer(spark, sf):
    """A pricing of request tables with a 500-entry table that is fitted on the log."""
    body, quiet = T.split_bodyless(S.requests(spark, sf))
    f = fitted(spark, sf).withColumn("gain", F.round("gain", 3))
    chosen, fallback, mean = T.choose(f, 500), T.context_fallback(f, body), T.bodyless_mean(quiet, 300.0)
    return lambda log: T.score(log, chosen, fallback, mean)


def scored(spark, sf):
    """Requests priced with a table that is fitted on the same log."""
    return scorer(spark, sf)(S.requests(spark, sf))


@query(f"WITH {SCORED} SELECT page_idx, pos, match_level, est_bytes, round(0.15 + est_bytes / 1024.0 * {_RATE}, 6) AS cpu_ms FROM scored")
def scored_requests(spark, sf):
    """JN6, EST1-3: every request's estimate, the level that answered, and its CPU time."""
    return scored(spark, sf).select("page_idx", "pos", "match_level", "est_bytes", F.round("cpu_ms", 6).alias("cpu_ms"))


@query(f"""WITH {SCORED}, hs AS (SELECT *, CASE WHEN ends_with(host, 'tag.adnet.example') THEN 0.7 WHEN ends_with(host, 'adnet.example') THEN 1.2 WHEN ends_with(host, 'metrics.example') THEN 1.5 ELSE 1.0 END AS host_scale FROM scored),
 fl AS (SELECT *, CASE WHEN context NOT IN ('script', 'html') OR pos <= min(CASE WHEN context IN ('script', 'html') THEN pos END) OVER (PARTITION BY page_idx, host) THEN 'FIRST' ELSE 'REPEAT' END AS root FROM hs),
 fu AS (SELECT *, CASE WHEN est_bytes <= 0 OR match_level = 'bodyless' OR root = 'REPEAT' OR context NOT IN ('script', 'html') THEN 0 ELSE CAST(round(59900 * {_SCALE} * host_scale) AS BIGINT) END AS followup_bytes FROM fl)
 SELECT page_domain, sum(est_bytes)::BIGINT AS direct, sum(followup_bytes)::BIGINT AS followup, count(*) FILTER (WHERE root = 'FIRST' AND context IN ('script', 'html')) AS n_first, round(sum(followup_bytes / 1024.0 * 0.9), 4) AS followup_cpu_ms FROM fu GROUP BY page_domain""")
def page_estimates(spark, sf):
    """JN7, EST4-5, EST9, WIN5: page totals with follow-up transfer, charged once for each host of a page load."""
    own = T.root_flags(T.host_scale(scored(spark, sf), spark.sql(_HOST_SCALES).withColumn("scale", F.col("scale").cast("double"))), ["page_idx"])
    priced = T.followups(own, F.col("root"))
    first = (F.col("root") == "FIRST") & F.col("context").isin("script", "html")
    return priced.groupBy("page_domain").agg(F.sum("est_bytes").alias("direct"), F.sum("followup_bytes").alias("followup"), F.count_if(first).alias("n_first"), F.round(F.sum("followup_cpu_ms"), 4).alias("followup_cpu_ms"))


@query(f"""WITH {SCORED}, s AS (SELECT 'full' AS stage, est_bytes AS p, transfer_bytes AS a FROM scored UNION ALL SELECT 'context_only', CAST(round((SELECT f.est FROM fitted f WHERE f.level = 'context' AND f.key = 'context|' || scored.context)) AS BIGINT), transfer_bytes FROM scored) SELECT stage, round(avg(abs(p - a)), 4) AS mae FROM s WHERE a IS NOT NULL GROUP BY stage""")
def interface_stages(spark, sf):
    """SIM14: what is lost when inputs are dropped."""
    own = scored(spark, sf).where("transfer_bytes is not null")
    body, _ = T.split_bodyless(S.requests(spark, sf))
    alone = own.join(F.broadcast(T.context_fallback(fitted(spark, sf), body)), "context").withColumn("p", F.round("fallback").cast("long"))
    mae = lambda c, n: F.round(F.avg(F.abs(F.col(c) - F.col("transfer_bytes"))), 4).alias(n)
    return own.agg(F.lit("full").alias("stage"), mae("est_bytes", "mae")).union(alone.agg(F.lit("context_only"), mae("p", "mae")))


@query(f"""WITH {SCORED}, hs AS (SELECT *, CASE WHEN ends_with(host, 'tag.adnet.example') THEN 0.7 WHEN ends_with(host, 'adnet.example') THEN 1.2 WHEN ends_with(host, 'metrics.example') THEN 1.5 ELSE 1.0 END AS host_scale FROM scored),
 fu AS (SELECT CASE WHEN est_bytes <= 0 OR match_level = 'bodyless' OR context NOT IN ('script', 'html') THEN 0 ELSE CAST(round(47000 * {_SCALE} * host_scale) AS BIGINT) END AS f FROM hs) SELECT count(*) FILTER (WHERE f > 0) AS n_cascading, sum(f)::BIGINT AS cascade, round(47000.0 * count(*) FILTER (WHERE f > 0) / sum(f), 6) AS correction FROM fu""")
def measured_correction(spark, sf):
    """AGG52: a flat price for each cascading request over the modulated prices' total."""
    own = T.host_scale(scored(spark, sf), spark.sql(_HOST_SCALES).withColumn("scale", F.col("scale").cast("double")))
    return rounded(T.measured_correction(T.followups(own, F.lit("UNKNOWN"))))


@query(f"""WITH {_fit_sql(0.0)} SELECT level, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM fitted WHERE level IN ('host', 'ext', 'context') GROUP BY level""")
def previous_levels(spark, sf):
    """EST11: a table of fewer levels."""
    body, _ = T.split_bodyless(S.requests(spark, sf))
    return T.fit_levels(T.features(T.alike(body)), levels=("host", "ext", "context")).groupBy("level").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))
