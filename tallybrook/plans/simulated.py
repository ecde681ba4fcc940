"""Queries over resampling, small fits, models and streams."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from tallybrook.functions import requests as R
from tallybrook.functions import urls as U
from tallybrook.operators import evaluate as V
from tallybrook.operators import fitting as G
from tallybrook.operators import lookup as L
from tallybrook.operators import simulate as M
from tallybrook.plans import paired as PP
from tallybrook.plans import tables as TT
from tallybrook.plans.features import rounded
from tallybrook.plans.registry import query
from tallybrook.sources import fixtures as S
from tallybrook.sources.storage import kept as stored
from tallybrook.streaming import totals as ST

_PAGES = f"{TT._chain('mean')}, pg AS (SELECT page_domain, sum(pred) AS p, sum(transfer_bytes)::DOUBLE AS a FROM pred GROUP BY 1)"
_NUMBERED = f"{_PAGES}, nb AS (SELECT *, row_number() OVER (ORDER BY {S.HASH.format('page_domain')}, page_domain) - 1 AS i FROM pg)"
_DRAW = "{} AS (SELECT t.range AS trial, s.range AS slot, CAST(('0x' || substr(md5('{}|' || t.range::VARCHAR || '|' || s.range::VARCHAR), 1, 15)) AS BIGINT) AS h FROM range({}) t, range({}) s)"


#: The Poisson weight of a 60-bit hash in SQL: how many cumulative probabilities its upper 52 bits exceed.
def _poisson_sql(h: str) -> str:
    total, term, parts = 0.0, math.exp(-1), []
    for k in range(1, 18):
        total += term
        parts.append(f"((({h}) >> 8) / 4503599627370496.0::DOUBLE >= {total!r}::DOUBLE)::INTEGER")
        term /= k
    return "(" + " + ".join(parts) + ")"


def _weight(seed: str, *key: str) -> str:
    text = " || '|' || ".join(f"{k}::VARCHAR" for k in key)
    return _poisson_sql(f"CAST(('0x' || substr(md5('{seed}|' || {text}), 1, 15)) AS BIGINT)")


def graded(spark, sf):
    return TT.predicted(spark, sf, "mean")


@query(f"""WITH {_NUMBERED}, {_DRAW.format('dr', 'j', 200, 20)}, tt AS (SELECT trial, sum(p) AS p, sum(a) AS a FROM dr JOIN nb ON dr.h % (SELECT count(*) FROM nb) = nb.i GROUP BY 1), e AS (SELECT abs(p - a) / a * 100 AS err, (p - a) / a * 100 AS sg FROM tt WHERE a <> 0)
 SELECT count(*) AS n, round(median(err), 6) AS median_pct, round(quantile_cont(err, 0.25), 6) AS p25_pct, round(quantile_cont(err, 0.75), 6) AS p75_pct, round(quantile_cont(err, 0.9), 6) AS p90_pct, round(avg(CASE WHEN err <= 5 THEN 1.0 ELSE 0 END), 6) AS within_5pct, round(avg(CASE WHEN err <= 10 THEN 1.0 ELSE 0 END), 6) AS within_10pct, round(avg(CASE WHEN err <= 25 THEN 1.0 ELSE 0 END), 6) AS within_25pct, round(median(sg), 6) AS signed_median_pct FROM e""")
def journey_errors(spark, sf):
    """SIM8-9: errors of journey totals; pages are summed first and drawn with replacement."""
    return rounded(M.error_stats(M.journeys(graded(spark, sf), "page_domain", "pred", "transfer_bytes", 20, 200, "j"), inclusive=True))


@query(f"""WITH {TT._chain('mean')}, k AS (SELECT pred AS p, transfer_bytes AS a, CAST(page_idx AS VARCHAR) || '|' || CAST(pos AS VARCHAR) AS key, page_idx, pos FROM pred), nb AS (SELECT p, a, row_number() OVER (ORDER BY {S.HASH.format('key')}, page_idx, pos) - 1 AS i FROM k), {_DRAW.format('dr', 'u', 100, 50)},
 tt AS (SELECT trial, sum(p) AS p, sum(a) AS a FROM dr JOIN nb ON dr.h % (SELECT count(*) FROM nb) = nb.i GROUP BY 1) SELECT count(*) AS n, round(median(abs(p - a) / a * 100), 6) AS median_pct, round(avg(CASE WHEN abs(p - a) / a * 100 < 10 THEN 1.0 ELSE 0 END), 6) AS within_10pct FROM tt WHERE a <> 0""")
def uniform_totals(spark, sf):
    """SIM5, SIM16: errors of totals of uniform draws."""
    t = M.uniform(graded(spark, sf), ["page_idx", "pos"], "pred", "transfer_bytes", 50, 100, "u")
    return rounded(M.error_stats(t).select("n", "median_pct", "within_10pct"))


_ERRORS = """SELECT count(*) AS n, round(median(err), 6) AS median_pct, round(quantile_cont(err, 0.25), 6) AS p25_pct, round(quantile_cont(err, 0.75), 6) AS p75_pct, round(quantile_cont(err, 0.9), 6) AS p90_pct, round(avg(CASE WHEN err < 5 THEN 1.0 ELSE 0 END), 6) AS within_5pct, round(avg(CASE WHEN err < 10 THEN 1.0 ELSE 0 END), 6) AS within_10pct, round(avg(CASE WHEN err < 25 THEN 1.0 ELSE 0 END), 6) AS within_25pct, round(median(sg), 6) AS signed_median_pct
 FROM (SELECT abs(p - a) / a * 100 AS err, (p - a) / a * 100 AS sg FROM tt WHERE a <> 0)"""


@query(f"""WITH {_NUMBERED}, w AS (SELECT p, a, i, 1.0::DOUBLE / (i + 1) AS w FROM nb), c AS (SELECT p, a, sum(w) OVER (ORDER BY i) AS upto, w, sum(w) OVER () AS whole FROM w), {_DRAW.format('dr', 'z', 100, 20)},
 x AS (SELECT trial, (h >> 8) / 4503599627370496.0::DOUBLE * (SELECT max(whole) FROM c) AS x FROM dr), tt AS (SELECT trial, sum(p) AS p, sum(a) AS a FROM x JOIN c ON x >= upto - w AND x < upto GROUP BY 1) {_ERRORS}""")
def zipf_journey_errors(spark, sf):
    """SIM8: journeys by Zipf weights."""
    return rounded(M.error_stats(M.zipf_journeys(graded(spark, sf), "page_domain", "pred", "transfer_bytes", 20, 100, "z")))


@query(f"""WITH {TT._chain('mean')}, it AS (SELECT page_domain, row_number() OVER (ORDER BY {S.HASH.format('page_domain')}, page_domain) - 1 AS i FROM (SELECT DISTINCT page_domain FROM pred)), {_DRAW.format('dr', 'c', 20, 5)},
 met AS (SELECT trial, slot, page_idx, pos, pred AS p, transfer_bytes AS a, CAST(('0x' || substr(md5('c|' || trial::VARCHAR || '|' || slot::VARCHAR || '|' || page_idx::VARCHAR || '|' || pos::VARCHAR), 1, 15)) AS BIGINT) AS hr FROM dr JOIN it ON dr.h % (SELECT count(*) FROM it) = it.i JOIN pred USING (page_domain)),
 near AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY hr, slot, page_idx, pos) AS r FROM met), tt AS (SELECT trial, sum(p) AS p, sum(a)::DOUBLE AS a FROM near WHERE r <= 50 GROUP BY 1) {_ERRORS}""")
def clustered_totals(spark, sf):
    """SIM6-7: domain-correlated draws."""
    log = graded(spark, sf).withColumn("host", U.net_host(F.col("url")))
    return rounded(M.error_stats(M.clustered(log, "page_domain", ["page_idx", "pos"], "pred", "transfer_bytes", 5, 50, 20, "c")))


def _ratio_sql(metric: str, rows: str, key: str, num: str, den: str, trials: int, seed: str) -> str:
    per = f"SELECT trial, sum(w * {num}) / sum(w * {den}) AS r FROM (SELECT *, {_weight(seed, 'trial', key)} AS w FROM {rows}, (SELECT range AS trial FROM range(1, {trials + 1}))) GROUP BY 1"
    return f"SELECT '{metric}' AS metric, round((SELECT sum({num}) / sum({den}) FROM {rows}), 6) AS value, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM ({per})"


@query(f"""WITH {_PAGES}, gp AS (SELECT page_idx, sum(abs(pred - transfer_bytes)) AS gap, count(*)::DOUBLE AS n FROM pred GROUP BY 1) {_ratio_sql('ratio', 'pg', 'page_domain', 'p', 'a', 200, 'b')} UNION ALL {_ratio_sql('mae', 'gp', 'page_idx', 'gap', 'n', 50, 'm')}""")
def bootstrap_intervals(spark, sf):
    """SIM1-2: intervals of a ratio of page sums and of a mean error, by Poisson weights."""
    g = graded(spark, sf)
    pages = g.groupBy("page_domain").agg(F.sum("pred").alias("p"), F.sum("transfer_bytes").alias("a"))
    ratio = M.bootstrap_ratio(pages, ["page_domain"], "p", "a", 200, "b").select(F.lit("ratio").alias("metric"), F.col("ratio").alias("value"), "low", "high")
    gap = g.withColumn("gap", F.abs(F.col("pred") - F.col("transfer_bytes"))).groupBy("page_idx").agg(F.sum("gap").alias("gap"), F.count(F.lit(1)).alias("n"))
    return rounded(ratio.unionByName(M.bootstrap_ratio(gap, ["page_idx"], "gap", "n", 50, "m").select(F.lit("mae").alias("metric"), F.col("ratio").alias("value"), "low", "high")))


def _subsets_sql(name: str, share: float, seed: str) -> str:
    h = "CAST(('0x' || substr(md5('" + seed + "|' || subset::VARCHAR || '|' || page_domain), 1, 15)) AS BIGINT)"
    return f"""SELECT '{name}' AS size, subset, count(*) AS n_pages, round(sum(p) / sum(a), 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY {h}, page_domain) AS r, count(*) OVER (PARTITION BY subset) AS n FROM x) WHERE r <= greatest(1, round_even(n * {share}::DOUBLE, 0)) GROUP BY subset"""


@query(f"""WITH {_PAGES}, x AS (SELECT page_domain, p, a, unnest(range(1, 21)) AS subset FROM pg) {_subsets_sql('half', 0.5, 'h')} UNION ALL {_subsets_sql('quarter', 0.25, 'q')}""")
def page_halves(spark, sf):
    """SIM10: the ratio over random subsets of exactly half, and a quarter, of the pages."""
    pages = graded(spark, sf).groupBy("page_domain").agg(F.sum("pred").alias("p"), F.sum("transfer_bytes").alias("a"))
    some = (M.subsets(pages, "page_domain", share, 20, "p", "a", seed).withColumn("size", F.lit(name)) for name, share, seed in (("half", 0.5, "h"), ("quarter", 0.25, "q")))
    return rounded(S.union_all(*some))


@query(f"""WITH {TT._chain('mean')}, it AS (SELECT page_domain, row_number() OVER (ORDER BY {S.HASH.format('page_domain')}, page_domain) - 1 AS i FROM pred GROUP BY 1 HAVING count(*) >= 2), {_DRAW.format('dr', 'p', 30, 6)},
 met AS (SELECT trial, slot, page_idx, pos, pred AS p, transfer_bytes AS a, CAST(('0x' || substr(md5('p|' || trial::VARCHAR || '|' || slot::VARCHAR || '|' || page_idx::VARCHAR || '|' || pos::VARCHAR), 1, 15)) AS BIGINT) AS hr FROM dr JOIN it ON dr.h % (SELECT count(*) FROM it) = it.i JOIN pred USING (page_domain)),
 near AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY hr, slot, page_idx, pos) AS r, count(*) OVER (PARTITION BY trial) AS n FROM met), tt AS (SELECT trial, sum(p) AS p, sum(a)::DOUBLE AS a FROM near WHERE n <= 2 * 150 OR r <= 150 GROUP BY 1) {_ERRORS}""")
def page_correlated_totals(spark, sf):
    """SIM7: page-correlated draws: whole pages, thinned where they hold more than twice the wanted rows."""
    return rounded(M.error_stats(M.page_correlated(graded(spark, sf), "page_domain", ["page_idx", "pos"], "pred", "transfer_bytes", 6, 150, 30, "p")))


_HIT = f"{TT._chain('median')}, k AS (SELECT DISTINCT host, path FROM tr), mh AS (SELECT host, avg(transfer_bytes) AS v FROM tr GROUP BY 1), hit AS (SELECT pred.page_idx, pred.pos, pred.pred, pred.transfer_bytes AS y, k.host IS NOT NULL AS seen FROM pred LEFT JOIN k ON pred.host = k.host AND pred.path = k.path)"
_TRIALS = 20


@query(f"""WITH {_HIT}, x AS (SELECT seen, pred AS p, y::DOUBLE AS a, abs(pred - y) AS g, trial, CASE WHEN trial = 0 THEN 1 ELSE {_weight('r', 'trial', 'page_idx', 'pos')} END AS w FROM hit, (SELECT range AS trial FROM range({_TRIALS + 1}))), z AS (SELECT * FROM x WHERE w > 0),
 o AS (SELECT *, sum(w) OVER (PARTITION BY seen, trial ORDER BY g) AS upto, sum(w) OVER (PARTITION BY seen, trial) AS total, sum(w) OVER (PARTITION BY seen, trial ORDER BY p) - (sum(w) OVER (PARTITION BY seen, trial, p) - 1) / 2.0::DOUBLE AS rp, sum(w) OVER (PARTITION BY seen, trial ORDER BY a) - (sum(w) OVER (PARTITION BY seen, trial, a) - 1) / 2.0::DOUBLE AS ra FROM z),
 s AS (SELECT seen, trial, sum(w)::DOUBLE AS n, sum(w * g) AS gap, min(g) FILTER (WHERE upto * 2 >= total) AS med, sum(w * rp) AS sp, sum(w * ra) AS sa, sum(w * rp * rp) AS spp, sum(w * ra * ra) AS saa, sum(w * rp * ra) AS spa FROM o GROUP BY 1, 2),
 m AS (SELECT seen, trial, gap / n AS mae, med, CASE WHEN n * spp - sp * sp > 0 AND n * saa - sa * sa > 0 THEN (n * spa - sp * sa) / sqrt((n * spp - sp * sp) * (n * saa - sa * sa)) END AS rho FROM s),
 l AS (SELECT seen, trial, 'mae' AS metric, mae AS v FROM m UNION ALL SELECT seen, trial, 'median_ae', med FROM m UNION ALL SELECT seen, trial, 'spearman', rho FROM m)
 SELECT seen, metric, round(max(v) FILTER (WHERE trial = 0), 4) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE trial > 0), 4) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE trial > 0), 4) AS high FROM l GROUP BY 1, 2""")
def seen_unseen_intervals(spark, sf):
    """SIM1, SIM13: mean and median error and rank correlation on seen and unseen paths, with intervals of row resamples."""
    rows = TT.predicted(spark, sf).withColumn("seen", F.col("pred_level") == 0)  # the first level's keys are the paths that training rows hold
    return rounded(M.rank_metrics(rows, ["seen"], ["page_idx", "pos"], "pred", "transfer_bytes", _TRIALS, "r"), 4)


@query(f"""WITH {TT._chain('mean')}, pg AS (SELECT page_domain, sum(pred) AS p, count(*)::DOUBLE AS c, sum(transfer_bytes)::DOUBLE AS a FROM pred GROUP BY 1), lv AS (SELECT page_domain, abs(p * (SELECT sum(a) / sum(p) FROM pg) - a) AS ea, abs(c * (SELECT sum(a) / sum(c) FROM pg) - a) AS eb FROM pg),
 nb AS (SELECT *, row_number() OVER (ORDER BY {S.HASH.format('page_domain')}, page_domain) - 1 AS i FROM lv), {_DRAW.format('dr', 'w', 100, 40)}, tt AS (SELECT trial, sum(ea) AS a, sum(eb) AS b FROM dr JOIN nb ON dr.h % (SELECT count(*) FROM nb) = nb.i GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN a < b THEN 1.0 ELSE 0 END), 6) AS win_rate FROM tt""")
def model_win_rate(spark, sf):
    """SIM3: how often a table beats a count at equal totals."""
    pages = graded(spark, sf).groupBy("page_domain").agg(F.sum("pred").alias("p"), F.count(F.lit(1)).alias("c"), F.sum("transfer_bytes").alias("a"))
    return rounded(M.win_rate(pages, ["page_domain"], "p", "c", "a", 40, 100, "w"))


@query(f"""WITH {PP._CELLS}, o AS (SELECT host, diff_bytes::DOUBLE AS v FROM cells WHERE width = 'listed'), t AS (SELECT count(*) AS n, sum(v) AS s FROM o), h AS (SELECT host, count(*) AS hn, sum(v) AS hs FROM o GROUP BY 1) SELECT round(avg(abs(v - (s - v) / (n - 1))), 4) AS grand_mae, round(avg(abs(v - CASE WHEN hn > 1 THEN (hs - v) / (hn - 1) ELSE (s - v) / (n - 1) END)), 4) AS host_mae FROM o JOIN h USING (host), t""")
def leave_one_out_table(spark, sf):
    """SIM11: would a table by host help, each cell judged by the others."""
    o = stored(PP.cells(spark, sf).where("width = 'listed'").select("host", F.col("diff_bytes").cast("double").alias("v")))  # read three times
    h = o.groupBy("host").agg(F.count(F.lit(1)).alias("hn"), F.sum("v").alias("hs"))
    few = h.limit(L.SMALL + 1).count() <= L.SMALL  # told here, as the cells' file is small enough for them to be broadcast
    j = L.one_row(o.join(F.broadcast(h) if few else h.hint("merge"), "host"), o.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")))
    grand = (F.col("s") - F.col("v")) / (F.col("n") - 1)
    own = F.when(F.col("hn") > 1, (F.col("hs") - F.col("v")) / F.when(F.col("hn") > 1, F.col("hn") - 1)).otherwise(grand)
    return rounded(j.agg(F.avg(F.abs(F.col("v") - grand)).alias("grand_mae"), F.avg(F.abs(F.col("v") - own)).alias("host_mae")), 4)


@query(f"""WITH {S.WITH_REQUESTS}, c AS (SELECT page_idx, resource_type AS t, count(*)::DOUBLE AS k FROM requests GROUP BY 1, 2) SELECT a.t AS a, b.t AS b, round(sum(a.k * b.k), 4) AS x FROM c a JOIN c b USING (page_idx) WHERE a.t <= b.t GROUP BY 1, 2""")
def gram_matrix(spark, sf):
    """ML16: sums of products of a page's counts by type."""
    log = S.requests(spark, sf)
    cells = log.groupBy("page_idx", F.col("resource_type").alias("t")).agg(F.count(F.lit(1)).alias("k"))
    return G.gram(cells, ["page_idx"], "t", "k", log.groupBy("page_idx").agg(F.sum("transfer_bytes").alias("y")), "y")[0]


@query()
def nnls_by_type(spark, sf):
    """ML16: non-negative bytes for each request by type."""
    log = S.requests(spark, sf)
    cells = log.groupBy("page_idx", F.col("resource_type").alias("t")).agg(F.count(F.lit(1)).alias("k"))
    return rounded(G.fit_nnls(cells, ["page_idx"], "t", "k", log.groupBy("page_idx").agg(F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("y")), "y"), 4)


@query(f"""WITH {S.WITH_REQUESTS}, s AS (SELECT page_domain, pos::DOUBLE AS x, transfer_bytes::DOUBLE AS y FROM requests WHERE pos >= 1 AND transfer_bytes IS NOT NULL) SELECT page_domain, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, count(*) AS n FROM s GROUP BY 1""")
def page_lines(spark, sf):
    """ML18: a line through each page's steps."""
    return rounded(G.page_lines(S.requests(spark, sf).where("transfer_bytes is not null"), "page_domain", "pos", "transfer_bytes"), 4)


@query(f"""WITH {S.WITH_REQUESTS}, g AS (SELECT resource_type, count(*) AS n, avg(transfer_bytes) AS m, var_samp(transfer_bytes) / count(*) AS v FROM requests WHERE transfer_bytes IS NOT NULL GROUP BY 1), t AS (SELECT avg(m) AS grand, greatest(var_samp(m) - avg(v), 0) AS b FROM g)
 SELECT resource_type, n, round(m, 4) AS mean, round(sqrt(v), 4) AS se, round(b / (b + v), 6) AS weight, round((grand + b / (b + v) * (m - grand)) / grand, 6) AS factor FROM g, t""")
def shrunk_factors(spark, sf):
    """ML19: group factors shrunk by their sampling error."""
    f = G.shrunk_factors(S.requests(spark, sf).where("transfer_bytes is not null").withColumn("y", F.col("transfer_bytes").cast("double")), "resource_type", "y")
    return f.select("resource_type", "n", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"), F.round("weight", 6).alias("weight"), F.round("factor", 6).alias("factor"))


def one_hots():
    return {**R.one_hot(F.col("resource_type"), R.RESOURCE_TYPES, "rt"), **R.one_hot(F.col("initiator_type"), R.INITIATORS, "init")}


def flags():
    return {k: v.cast("int") for k, v in U.content_flags(F.col("url"), False).items()}


def counts():
    return {"depth": U.path_depth(F.col("url")), "length": F.length("url"), "params": U.num_query_params(F.col("url"))}


def encoded(df, train, target):
    """df plus the training rows' median by host, and by host and type."""
    return L.fall_back(L.fall_back(df, train, [["host"]], target, "host_median"), train, [["host", "resource_type"], ["host"]], target, "type_median")


def features(spark, sf, *kept):
    """ML1, REQ7: target-encoded and one-hot features of training and test rows, encoded on training rows only."""
    train, test = TT.split(spark, sf)
    own = lambda df: encoded(df, train, "transfer_bytes")
    cols = {**one_hots(), **flags(), **counts(), "label": F.col("transfer_bytes").cast("double")}
    assembler = VectorAssembler(inputCols=[*(c for c in cols if c != "label"), "host_median", "type_median"], outputCol="features")
    return (stored(assembler.transform(own(df).withColumns(cols)).select("page_idx", "pos", "resource_type", "features", "label", *kept)) for df in (train, test))


def told_apart(spark, sf, *kept, text=False):
    """The same features for fits that take alike requests together: rows, alike and the columns they meet by.

    rows: each sized request's side of the split (early), label, what its features come from and the columns kept, stored
    once.  alike: each different early and origin of features with the number n of its rows, their mean label, and the
    features.  There are as many as there are different hosts, types, counts and flags (and paths, with text).
    """
    by = ["early", "host", "resource_type", "initiator_type", "flags", *counts(), *(["path"] if text else [])]
    bits = sum((F.when(c == 1, 2**k).otherwise(0) for k, c in enumerate(flags().values())), F.lit(0))
    log = S.union_all(*(df.withColumn("early", F.lit(side)) for df, side in zip(TT.split(spark, sf), (True, False), strict=True)))
    rows = stored(log.withColumns({"flags": bits, **counts()}).select(*by, F.col("transfer_bytes").cast("double").alias("label"), *kept))
    groups = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("label")))
    set_ = {name: F.shiftright("flags", k).bitwiseAND(F.lit(1)) for k, name in enumerate(flags())}
    names = [*one_hots(), *set_, *counts(), "host_median", "type_median"]
    alike = encoded(groups, rows.where("early"), "label").withColumns({**one_hots(), **set_})
    return rows, stored(VectorAssembler(inputCols=names, outputCol="features").transform(alike).select(*by, "n", "label", "features")), by


@query()
def regressors(spark, sf):
    """ML4-6: ridge, Tweedie and a two-stage tree model, graded on later rows."""
    train, test = features(spark, sf)
    models = {"ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "tweedie": GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, maxIter=10, regParam=0.1)}
    out = []
    for name, m in models.items():
        fit = m.fit(train.withColumn("label", F.col("label") + 1) if name == "tweedie" else train)
        p = F.greatest(F.col("prediction") - (1 if name == "tweedie" else 0), F.lit(0.0))
        out.append(V.errors(fit.transform(test).withColumn("p", p), "p", "label", median=False).select(F.lit(name).alias("model"), "n", "mae", "ratio"))
    some = GBTClassifier(labelCol="some", maxIter=5, maxDepth=3).fit(train.withColumn("some", (F.col("label") > 0).cast("double")))
    size = GBTRegressor(maxIter=5, maxDepth=3).fit(train.where("label > 0"))
    two = size.transform(some.transform(test).withColumn("share", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability"))
    out.append(V.errors(two.withColumn("p", F.greatest(F.col("share") * F.col("prediction"), F.lit(0.0))), "p", "label", median=False).select(F.lit("two_stage").alias("model"), "n", "mae", "ratio"))
    return S.union_all(*out)


@query()
def shift_classifier(spark, sf):
    """ML12-13: can a model tell the periods apart; and multi-class probabilities of the type."""
    train, test = features(spark, sf)
    both = train.withColumn("late", F.lit(0.0)).unionByName(test.withColumn("late", F.lit(1.0))).withColumn("w", F.pmod(S.hash_number("page_idx", "pos"), F.lit(10)))
    model = GBTClassifier(labelCol="late", maxIter=3, maxDepth=2).fit(both.where("w < 7"))
    auc = BinaryClassificationEvaluator(labelCol="late").evaluate(model.transform(both.where("w >= 7")))
    kind = RandomForestClassifier(labelCol="kind", numTrees=5, maxDepth=4, seed=3).fit(both.where("w < 7").withColumn("kind", R.context_of(F.col("resource_type")).cast("double")))
    right = kind.transform(both.where("w >= 7")).agg(F.avg((F.col("prediction") == R.context_of(F.col("resource_type"))).cast("double")).alias("type_accuracy"))
    return right.select(F.lit(float(auc)).alias("auc"), "type_accuracy")


@query()
def hashed_tokens(spark, sf):
    """ML3: hashed path tokens, in 64 unit-length features."""
    urls = S.requests(spark, sf).select("url").distinct().withColumn("tokens", U.path_tokens(U.rule_path(F.col("url"))))
    hashed = Normalizer(inputCol="raw", outputCol="unit").transform(HashingTF(numFeatures=64, inputCol="tokens", outputCol="raw").transform(urls))
    return hashed.select("url", vector_to_array("unit").alias("features"))


@query("""SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def weekly_totals(spark, sf):
    """STR1: weekly totals by user, through a stream that is run to its end."""
    return ST.run_to_end(spark, f"{sf}/events.parquet", ST.weekly, "complete").select("user_id", "week", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {TT.SCORED} SELECT page_domain, time_bucket(INTERVAL 7 DAY, date::TIMESTAMP, TIMESTAMP '1970-01-01') AS week, count(*) AS n, sum(est_bytes)::BIGINT AS est_bytes FROM scored GROUP BY 1, 2""")
def weekly_estimates(spark, sf):
    """STR1: requests priced by the fitted table as they arrive on a stream, in weekly totals of each page."""
    from tallybrook.sources.storage import scratch

    path = scratch(spark, "request-stream")
    S.requests(spark, sf).withColumn("ts", F.col("date").cast("timestamp_ntz")).write.parquet(path)
    return ST.run_to_end(spark, path, lambda stream: ST.weekly_scored(stream, TT.scorer(spark, sf)), "complete")


@query("""SELECT user_id, event_type, 1 AS firsts FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def first_flags(spark, sf):
    """STR2: the first event of each key on a stream."""
    return ST.run_to_end(spark, f"{sf}/events.parquet", ST.firsts, "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("firsts"))


@query(f"WITH {S.WITH_REQUESTS} SELECT page_idx, pos, url, transfer_bytes FROM requests WHERE resource_type = 'image'")
def written_and_read(spark, sf):
    """SRC4, SNK1-3: a table written with zstd, committed as a whole, and read again."""
    from tallybrook.sources.storage import cached, scratch

    path = scratch(spark, "images")
    return cached(spark, path, lambda: S.requests(spark, sf).where("resource_type = 'image'").select("page_idx", "pos", "url", "transfer_bytes"))
