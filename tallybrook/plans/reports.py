"""Reports that combine operators: levelling, external ratios, temporal holdout and end-to-end comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybrook.functions import urls as U
from tallybrook.operators import classify as C
from tallybrook.operators import evaluate as V
from tallybrook.operators import fitting as G
from tallybrook.operators import lookup as L
from tallybrook.operators import pairing as P
from tallybrook.operators import simulate as M
from tallybrook.plans import paired as PP
from tallybrook.plans import rules as RR
from tallybrook.plans import tables as TT
from tallybrook.plans.features import LHOST, rounded
from tallybrook.plans.registry import query
from tallybrook.sources import fixtures as S
from tallybrook.sources.storage import cached, scratch

_ENTRIES = "SELECT * FROM (VALUES ('adnet.example', 1.2), ('tag.adnet.example', 0.7), ('metrics.example', 1.5)) AS t(key, scale)"


@query(f"""WITH {S.WITH_PAIRED} SELECT CASE WHEN ends_with({LHOST}, 'tag.adnet.example') THEN 'tag.adnet.example' WHEN ends_with({LHOST}, 'adnet.example') THEN 'adnet.example' ELSE 'metrics.example' END AS key, count(*) AS weight FROM blocked WHERE resource_type IN ('script', 'html') GROUP BY 1""")
def levelling_weights(spark, sf):
    """AGG46: cascading blocks by the entry that their host resolves to."""
    hosts = S.blocked(spark, sf).where("resource_type in ('script', 'html')").select(U.net_host(F.col("url")).alias("host"))
    return G.levelling_weights(hosts, spark.sql(_ENTRIES))


_WEIGHTS = f"""{S.WITH_PAIRED}, wt AS (SELECT CASE WHEN ends_with({LHOST}, 'tag.adnet.example') THEN 'tag.adnet.example' WHEN ends_with({LHOST}, 'adnet.example') THEN 'adnet.example' ELSE 'metrics.example' END AS key, count(*) AS weight FROM blocked WHERE resource_type IN ('script', 'html') GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_WEIGHTS}, e AS (SELECT key, scale::DOUBLE AS scale, coalesce(weight, 0)::DOUBLE AS w FROM ({_ENTRIES}) LEFT JOIN wt USING (key)),
 r AS (SELECT 0 AS step, list(key ORDER BY key) AS ks, list(scale ORDER BY key) AS v, list(w ORDER BY key) AS ws, NULL::DOUBLE AS mean FROM e
  UNION ALL SELECT step + 1, ks, list_transform(v, lambda x: least(greatest(x / m, 0.1::DOUBLE), 4.0::DOUBLE)), ws, m FROM (SELECT *, list_inner_product(v, ws) / list_sum(ws) AS m FROM r) WHERE step < 80 AND list_sum(ws) > 0 AND (mean IS NULL OR abs(mean - 1) >= 1e-9))
 SELECT unnest(ks) AS key, round(unnest(v), 9) AS scale FROM (SELECT ks, v FROM r ORDER BY step DESC LIMIT 1)""")
def levelled_scales(spark, sf):
    """AGG45: the entries' scales, levelled to a weighted mean of one."""
    weights = {r["key"]: r["weight"] for r in levelling_weights(spark, sf).collect()}  # a row for each entry
    scales = G.level({r["key"]: float(r["scale"]) for r in spark.sql(_ENTRIES).collect()}, weights)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in scales.items()], "key string, scale double"), 9)


@query(f"""WITH {TT._chain('mean')}, a AS (SELECT page_domain, sum(pred) / 2 AS p FROM pred GROUP BY 1), b AS (SELECT page_domain, sum(transfer_bytes)::DOUBLE AS y FROM tr GROUP BY 1) SELECT count(*) AS n_domains, round(sum(p) / sum(y), 6) AS ratio FROM a JOIN b USING (page_domain)""")
def external_ratio(spark, sf):
    """AGG49: predictions of each pass against another crawl's bytes on shared domains."""
    train, _ = TT.split(spark, sf)
    a = TT.predicted(spark, sf, "mean").groupBy("page_domain").agg((F.sum("pred") / 2).alias("p"))
    b = train.groupBy("page_domain").agg(F.sum("transfer_bytes").cast("double").alias("y"))
    return rounded(a.join(b, "page_domain").agg(F.count(F.lit(1)).alias("n_domains"), (F.sum("p") / F.sum("y")).alias("ratio")))


@query(f"""WITH {TT._SPLIT}, m AS (SELECT host, median(transfer_bytes) AS v FROM tr GROUP BY 1), e AS (SELECT 'same' AS period, avg(abs(v - transfer_bytes)) AS mae FROM tr JOIN m USING (host) UNION ALL SELECT 'later', avg(abs(v - transfer_bytes)) FROM te JOIN m USING (host)) SELECT period, round(mae, 4) AS mae, round((mae / (SELECT mae FROM e WHERE period = 'same') - 1) * 100, 6) AS degradation_pct FROM e""")
def temporal_holdout(spark, sf):
    """SIM12: a table of one period on its own rows and on later ones."""
    train, test = TT.split(spark, sf)
    m = L.table(train, ["host"], "transfer_bytes", "v").select("host", "v")
    mae = lambda df, n: df.join(m, "host").agg(F.lit(n).alias("period"), F.avg(F.abs(F.col("v") - F.col("transfer_bytes"))).alias("mae"))
    e = mae(train, "same").union(mae(test, "later"))
    base = e.where("period = 'same'").select(F.col("mae").alias("base"))
    return L.one_row(e, base).select("period", F.round("mae", 4).alias("mae"), F.round((F.col("mae") / F.col("base") - 1) * 100, 6).alias("degradation_pct"))


def _journeys(column: str, seed: int) -> str:
    return f"""SELECT '{column}' AS estimator, {seed} AS seed, round(median(abs(p - a) / a * 100), 6) AS median_pct FROM (SELECT t.range AS trial, sum({column})::DOUBLE AS p, sum(a)::DOUBLE AS a
  FROM range(50) t, range(20) s JOIN nb ON CAST(('0x' || substr(md5('s{seed}|' || t.range::VARCHAR || '|' || s.range::VARCHAR), 1, 15)) AS BIGINT) % (SELECT count(*) FROM nb) = nb.i GROUP BY 1) WHERE a <> 0"""


@query(f"""WITH {TT._chain('mean')}, pg AS (SELECT page_domain, sum(pred) AS pred, sum(30000.0::DOUBLE) AS flat, sum(transfer_bytes)::DOUBLE AS a FROM pred GROUP BY 1), nb AS (SELECT *, row_number() OVER (ORDER BY {S.HASH.format('page_domain')}, page_domain) - 1 AS i FROM pg),
 e AS ({' UNION ALL '.join(_journeys(c, k) for c in ('pred', 'flat') for k in (1, 2))}) SELECT estimator, max(median_pct) AS worst_pct, arg_max(seed, (median_pct, seed)) AS worst_seed FROM e GROUP BY estimator""")
def estimator_comparison(spark, sf):
    """SIM15: two estimators over seeds; the worst seed of each is reported."""
    g = TT.predicted(spark, sf, "mean").withColumn("flat", F.lit(30000.0))
    rows = [M.error_stats(M.journeys(g, "page_domain", c, "transfer_bytes", 20, 50, f"s{k}")).select(F.lit(c).alias("estimator"), F.lit(k).alias("seed"), F.round("median_pct", 6).alias("median_pct")) for c in ("pred", "flat") for k in (1, 2)]
    return S.union_all(*rows).groupBy("estimator").agg(F.max("median_pct").alias("worst_pct"), F.max_by("seed", F.struct("median_pct", "seed")).alias("worst_seed"))


_BLOCK_KEY = "rep::VARCHAR || '|' || page_idx::VARCHAR || '|' || pos::VARCHAR"


@query(f"""WITH {S.WITH_PAIRED}, k AS (SELECT rep, page_idx, pos, {LHOST} AS host, {_BLOCK_KEY} AS key FROM blocked), b AS (SELECT *, row_number() OVER (ORDER BY {S.HASH.format('key')}, rep, page_idx, pos) - 1 AS i FROM k),
 d AS (SELECT x.rep, x.page_idx, y.host FROM (SELECT rep, page_idx, {S.HASH.format("'perm|' || key")} % (SELECT count(*) FROM b) AS i FROM b) x JOIN b y USING (i))
 SELECT (SELECT round(avg(h), 6) FROM (SELECT count(DISTINCT host) AS h FROM b GROUP BY rep, page_idx)) AS hosts, (SELECT round(avg(h), 6) FROM (SELECT count(DISTINCT host) AS h FROM d GROUP BY rep, page_idx)) AS hosts_permuted""")
def permuted_hosts(spark, sf):
    """SIM4: distinct hosts of a page when each block draws its host from the pool of all blocks."""
    b = M.numbered(S.blocked(spark, sf).select("rep", "page_idx", "pos", U.net_host(F.col("url")).alias("host")), ["rep", "page_idx", "pos"])
    n = b.agg(F.count(F.lit(1)).alias("n_items"))
    drawn = L.one_row(b.drop("host", "i"), n).withColumn("i", F.pmod(S.hash_number(F.lit("perm"), "rep", "page_idx", "pos"), F.col("n_items"))).join(b.select("i", "host"), "i")
    real, shuffled = (df.groupBy("rep", "page_idx").agg(F.count_distinct("host").alias("h")).agg(F.avg("h").alias(name)) for df, name in ((b, "hosts"), (drawn, "hosts_permuted")))
    return rounded(L.one_row(real, shuffled))


_QUESTIONS = f"""{TT.SCORED}, {S.WITH_RULES}, {RR.MERGED}, {RR.matched(RR.DEFAULT)}, q AS (SELECT s.page_idx, s.est_bytes AS p, coalesce(s.transfer_bytes, 0) AS a, s.page_idx % 3 <> 0 AND (s.host LIKE '%adnet.example' OR s.host LIKE '%metrics.example') AS blocked FROM scored s JOIN best b ON s.url = b.url),
 u AS (SELECT 'listed' AS question, p, a FROM q UNION ALL SELECT 'blocked', p, a FROM q WHERE blocked)"""


@query(f"WITH {_QUESTIONS} SELECT question, count(*) AS n, sum(p)::BIGINT AS pred_total, sum(a)::BIGINT AS actual_total, round(sum(p)::DOUBLE / sum(a), 6) AS ratio FROM u GROUP BY question")
def estimate_questions(spark, sf):
    """PAIR4: estimates against observations for listed and for blocked requests."""
    kinds = S.requests(spark, sf).groupBy(U.plain_query(F.col("url")).alias("url"), "resource_type", "http_method", (F.col("page_idx") % 3 != 0).alias("asked"))
    alike = kinds.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("transfer_bytes", F.lit(0))).alias("a"))  # requests of equal estimate and verdict
    s = C.is_tracker(TT.scorer(spark, sf)(alike), S.rules(spark)).where("is_tracker")
    hit = F.col("asked") & (F.col("host").endswith("adnet.example") | F.col("host").endswith("metrics.example"))
    questions = F.when(hit, F.array(F.lit("listed"), F.lit("blocked"))).otherwise(F.array(F.lit("listed")))
    both = s.select(F.explode(questions).alias("question"), "n", (F.col("est_bytes") * F.col("n")).alias("p"), "a")
    return rounded(both.groupBy("question").agg(F.sum("n").alias("n"), F.sum("p").alias("pred_total"), F.sum("a").alias("actual_total"), (F.sum("p").cast("double") / F.sum("a")).alias("ratio")))


@query(f"""WITH {PP._CELLS}, b AS (SELECT width, n_aborted, diff_bytes FROM cells WHERE NOT (host LIKE '%site3.adnet.example' OR host LIKE '%site4.adnet.example')) SELECT width, count(*) AS n, round(sum(diff_bytes)::DOUBLE / sum(n_aborted), 6) AS per_request FROM b GROUP BY width""")
def cascade_without_consent(spark, sf):
    """FLT16, AGG39: the cascade for each request, hosts of consent managers left out."""
    g = PP.cells(spark, sf).where(~U.under_any(F.col("host"), ("site3.adnet.example", "site4.adnet.example"))).groupBy("width").agg(F.count(F.lit(1)).alias("n"), (F.sum("diff_bytes").cast("double") / F.sum("n_aborted")).alias("per_request"))
    return rounded(g)


@query(f"""WITH {PP.MATCHED}, e AS (SELECT coalesce(observed_bytes, 0) AS a, 25000 AS p, rep FROM bag) SELECT rep, count(*) AS n, round(avg(abs(p - a)), 4) AS mae, round(sum(p)::DOUBLE / sum(a), 6) AS ratio FROM e GROUP BY rep""")
def blocked_price_errors(spark, sf):
    """AGG26, SNK6: a flat price for blocked requests against what was observed."""
    e = V.errors(P.bag_match(S.blocked(spark, sf), S.control(spark, sf)).select("rep", F.coalesce("observed_bytes", F.lit(0)).alias("a"), F.lit(25000).alias("p")), "p", "a", ["rep"])
    return e.select("rep", "n", F.round("mae", 4).alias("mae"), F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {PP.MATCHED}, sc AS (WITH {TT.SCORED} SELECT page_idx, pos, est_bytes, match_level FROM scored) SELECT rep, page_idx, pos, url, est_bytes AS predicted, observed_bytes AS observed, match_kind, match_level, est_bytes - observed_bytes AS error FROM bag JOIN sc USING (page_idx, pos)""")
def score_rows(spark, sf):
    """SNK6: blocked requests' predicted and observed bytes side by side, written as a table and read again."""
    priced = TT.scored(spark, sf).select("page_idx", "pos", "est_bytes", "match_level")
    rows = PP.matched(spark, sf).join(priced, ["page_idx", "pos"]).select("rep", "page_idx", "pos", "url", F.col("est_bytes").alias("predicted"), F.col("observed_bytes").alias("observed"), "match_kind", "match_level", (F.col("est_bytes") - F.col("observed_bytes")).alias("error"))
    return cached(spark, scratch(spark, "score-rows"), lambda: rows)
