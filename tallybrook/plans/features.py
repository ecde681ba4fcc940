"""Queries over URL and request features and the extraction set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions import requests as R
from tallybrook.functions import urls as U
from tallybrook.operators import lookup as L
from tallybrook.operators.classify import _sized as sized
from tallybrook.operators.ranks import percentiles
from tallybrook.plans.registry import query
from tallybrook.sources import fixtures as S

HOST = "regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), ':[0-9]+$', '')"
LHOST = f"lower({HOST})"
PATH = "regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1)"
QUERY = "regexp_extract(url, '(\\?[^#]*)', 1)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {S.WITH_REQUESTS} SELECT page_idx, pos, {HOST} AS url_host, {LHOST} AS net_host, {PATH} AS rule_path, nullif({PATH}, '') AS url_path,
  len(string_split(coalesce(nullif({PATH}, ''), '/'), '/')) - 1 AS path_depth, CASE WHEN {PATH} <> '' THEN len(string_split({PATH}, '/')) - 1 END AS path_depth_or_null,
  nullif(lower(regexp_extract(url, '\\.([a-zA-Z0-9]+)(?:\\?|#|$)', 1)), '') AS file_extension, contains(url, '?') AS has_query, length(url) AS url_length,
  len(string_split(substr({QUERY}, 2), '&')) AS num_query_params, regexp_replace(url, '[?#].*', '') AS stripped, regexp_replace(lower(url), '[?#].*', '') AS stripped_lower FROM requests""")
def url_features(spark, sf):
    """URL1-3, URL5-11: hosts, paths, extension, query and length."""
    u = F.col("url")
    return S.requests(spark, sf).select("page_idx", "pos", U.url_host(u).alias("url_host"), U.net_host(u).alias("net_host"), U.rule_path(u).alias("rule_path"), U.url_path(u).alias("url_path"), U.path_depth(u).alias("path_depth"), U.path_depth_or_null(u).alias("path_depth_or_null"), U.file_extension(u).alias("file_extension"), U.has_query(u).alias("has_query"), U.url_length(u).alias("url_length"), U.num_query_params(u).alias("num_query_params"), U.strip_query(u).alias("stripped"), U.strip_query(u, True).alias("stripped_lower"))


@query(f"""WITH {S.WITH_REQUESTS}, p AS (SELECT page_idx, pos, url, {LHOST} AS host, coalesce(nullif({PATH}, ''), '/') AS path, length({QUERY}) AS query_length FROM requests),
 t AS (SELECT *, regexp_replace(path, 'm202401([0-9]+)', '#') AS template FROM p)
 SELECT page_idx, pos, host, path, query_length, CASE WHEN path LIKE '%.js' THEN 'js' ELSE '' END AS extension, template, replace(host, 'a1b2c3d4e5f6', '#') AS host_template,
  array_to_string(list_slice(string_split(template, '/'), 1, 3), '/') AS prefix, least(floor(log2(query_length + 1)), 12)::INTEGER AS bucket,
  greatest(length(url) - length(host) - length(path) - 8, 0) AS query_left FROM t""")
def estimator_features(spark, sf):
    """URL4, URL12-17: the estimator's URL split, templates and buckets."""
    p = F.col("p")
    df = S.requests(spark, sf).withColumn("p", U.url_parts(F.col("url"))).withColumn("template", U.path_template(p["path"]))
    return df.select("page_idx", "pos", "p.*", U.estimator_extension(p["path"]).alias("extension"), "template", U.host_template(p["host"]).alias("host_template"), U.path_prefix(F.col("template")).alias("prefix"), U.query_bucket(p["query_length"]).alias("bucket"), U.query_length_left(F.length("url"), p["host"], p["path"]).alias("query_left"))


@query(f"""WITH {S.WITH_REQUESTS}, t AS (SELECT DISTINCT url, unnest(string_split(lower(regexp_replace(regexp_replace(regexp_replace(url, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), ' ')) AS part FROM requests),
 s AS (SELECT url, unnest(regexp_split_to_array(part, '[/?&=.\\-_]+')) AS token FROM t) SELECT token, count(*) AS n FROM s WHERE length(token) >= 2 GROUP BY token""")
def url_token_counts(spark, sf):
    """URL18: tokens of the different URLs."""
    urls = S.requests(spark, sf).select("url").distinct()
    return urls.select(F.explode(U.url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.WITH_REQUESTS}, t AS (SELECT DISTINCT {PATH} AS path FROM requests), s AS (SELECT unnest(regexp_split_to_array(lower(path), '[/\\-_.]+')) AS token FROM t)
 SELECT token, count(*) AS n FROM s WHERE length(token) > 0 AND length(token) < 20 GROUP BY token""")
def path_token_counts(spark, sf):
    """URL19: short path tokens of the different paths."""
    paths = S.requests(spark, sf).select(U.rule_path(F.col("url")).alias("path")).distinct()
    return paths.select(F.explode(U.path_tokens(F.col("path"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _flags_sql(prefix: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE regexp_matches(url, '{prefix}{p}')) AS {n}" for n, p in U.CONTENT_PATTERNS.items())


@query(f"WITH {S.WITH_REQUESTS} SELECT resource_type, {_flags_sql('(?i)')} FROM requests GROUP BY resource_type")
def content_flags(spark, sf):
    """URL20: content flags, case ignored."""
    return S.requests(spark, sf).groupBy("resource_type").agg(*(F.count_if(c).alias(n) for n, c in U.content_flags(F.col("url")).items()))


@query(f"WITH {S.WITH_REQUESTS} SELECT resource_type, {_flags_sql('')} FROM requests GROUP BY resource_type")
def content_flags_case(spark, sf):
    """URL20: content flags, case kept."""
    return S.requests(spark, sf).groupBy("resource_type").agg(*(F.count_if(c).alias(n) for n, c in U.content_flags(F.col("url"), False).items()))


@query(f"""WITH {S.WITH_REQUESTS}, h AS (SELECT DISTINCT {LHOST} AS host FROM requests), l AS (SELECT host, string_split(host, '.') AS labels FROM h),
 s AS (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS i FROM l) SELECT host, i AS depth, array_to_string(list_slice(labels, i, len(labels)), '.') AS suffix, i <= len(labels) - 1 AS not_tld FROM s""")
def host_suffixes(spark, sf):
    """URL21: the suffix chain of each host."""
    hosts = S.requests(spark, sf).select(U.net_host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", F.posexplode(U.suffix_chain(F.col("host"))).alias("depth", "suffix")).select("host", (F.col("depth") + 1).alias("depth"), "suffix", F.contains("suffix", F.lit(".")).alias("not_tld"))


@query(f"""WITH {S.WITH_REQUESTS}, h AS (SELECT DISTINCT {LHOST} AS host, page_domain FROM requests) SELECT host, page_domain, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS registrable,
  regexp_matches(host, '^[0-9a-f]{{16,}}\\.') AS opaque, replace(page_domain, 'www.', '') AS page_key, NOT (host = page_domain OR ends_with(host, '.' || page_domain) OR ends_with(page_domain, '.' || host)) AS third_party FROM h""")
def host_keys(spark, sf):
    """URL22-25: registrable suffix, opaque hosts, www-insensitive keys and third parties."""
    hosts = S.requests(spark, sf).select(U.net_host(F.col("url")).alias("host"), "page_domain").distinct()
    return hosts.select("host", "page_domain", U.registrable(F.col("host")).alias("registrable"), U.is_opaque(F.col("host")).alias("opaque"), U.without_www(F.col("page_domain")).alias("page_key"), U.is_third_party(F.col("host"), F.col("page_domain")).alias("third_party"))


@query(f"""WITH {S.WITH_REQUESTS}, f AS (SELECT DISTINCT url, {LHOST} AS host, coalesce(nullif({PATH}, ''), '/') AS path, len(string_split(substr({QUERY}, 2), '&')) AS params FROM requests),
 q AS (SELECT *, greatest(length(url) - length(host) - length(path) - 8, 0) AS n FROM f) SELECT url, length('https://' || host || path) + n AS rebuilt_length, CASE WHEN n > 0 THEN least(params, n) ELSE 1 END AS rebuilt_params FROM q""")
def rebuilt_urls(spark, sf):
    """URL26: rebuilt URLs have the logged length and number of parameters."""
    u = F.col("url")
    urls = S.requests(spark, sf).select("url").distinct().select("url", U.rebuilt_url(U.net_host(u), U.url_path(u), F.length(u), U.num_query_params(u)).alias("rebuilt"))
    return urls.select("url", F.length("rebuilt").alias("rebuilt_length"), U.num_query_params(F.col("rebuilt")).cast("long").alias("rebuilt_params"))


@query("""SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS with_k, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sum_k FROM events GROUP BY event_type""")
def payload_fields(spark, sf):
    """REQ1: a number out of a JSON payload; what isn't one is null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return S.events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


@query(f"""WITH {S.WITH_REQUESTS} SELECT resource_type, http_method, CASE resource_type WHEN 'script' THEN 0 WHEN 'image' THEN 1 WHEN 'html' THEN 7 ELSE 3 END AS context,
  CASE resource_type WHEN 'script' THEN 'code' WHEN 'image' THEN 'media' WHEN 'html' THEN 'doc' ELSE 'other' END AS key_group, http_method IN ('HEAD', 'OPTIONS') AS bodyless,
  CASE resource_type WHEN 'script' THEN 'script' WHEN 'image' THEN 'image' ELSE 'other' END AS browser_context, 1 AS priority, count(*) AS n, sum(CASE WHEN resource_type = 'script' THEN 1 ELSE 0 END)::BIGINT AS rt_script,
  round(sum(ln(1 + greatest(coalesce(transfer_bytes, 0), 0))), 4) AS log_bytes FROM requests GROUP BY resource_type, http_method""")
def request_features(spark, sf):
    """REQ2-5, REQ7-8, REQ11: contexts, groups, bodyless methods, one-hot and priority."""
    t = F.col("resource_type")
    df = S.requests(spark, sf).withColumns({"context": R.context_of(t), "key_group": R.key_group(R.context_name(t)), "bodyless": R.is_bodyless(F.col("http_method")), "browser_context": R.browser_context(t), "priority": R.priority_of(F.lit("Unknown")), **R.one_hot(t, ("script",), "rt")})
    return df.groupBy("resource_type", "http_method", "context", "key_group", "bodyless", "browser_context", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("rt_script").alias("rt_script"), F.round(F.sum(F.log1p(F.greatest(F.coalesce("transfer_bytes", F.lit(0)), F.lit(0)))), 4).alias("log_bytes"))


@query(f"""WITH {S.WITH_PAIRED} SELECT failure, CASE WHEN failure LIKE '%TRACKING_URI' THEN 'tracking' ELSE 'cryptomining_fingerprinting' END AS protection, count(*) AS n FROM blocked GROUP BY failure""")
def protection_classes(spark, sf):
    """REQ6: what a block was for."""
    return S.blocked(spark, sf).groupBy("failure", R.protection_of(F.col("failure")).alias("protection")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.WITH_REQUESTS}, {S.WITH_RULES}, d AS (SELECT DISTINCT split_part(pattern, '/', 1) AS domain FROM rules WHERE category IN ('Advertising', 'Analytics', 'Social'))
 SELECT page_idx, pos, {LHOST} AS host, transfer_bytes, date FROM requests WHERE {LHOST} IN (SELECT domain FROM d) AND date >= DATE '1995-01-01'""")
def extract_semi_join(spark, sf):
    """SRC1, SRC3, FLT1, JN1: requests of listed hosts, by a left-semi join behind a date predicate."""
    domains = S.rules(spark).where(F.col("category").isin("Advertising", "Analytics", "Social")).select(F.substring_index("pattern", "/", 1).alias("host")).distinct()
    log = S.requests(spark, sf).where("date >= date'1995-01-01'").withColumn("host", U.net_host(F.col("url")))
    return log.join(sized(domains), "host", "left_semi").select("page_idx", "pos", "host", "transfer_bytes", "date")


@query(f"""WITH {S.WITH_REQUESTS}, s AS (SELECT {LHOST} AS host, count(*) AS n, count(DISTINCT page_domain) AS pages, quantile_cont(transfer_bytes, 0.5) AS p50, quantile_cont(transfer_bytes, 0.9) AS p90 FROM requests GROUP BY 1 HAVING count(*) >= 10)
 SELECT host, n, pages, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM s""")
def host_stats(spark, sf):
    """AGG3 (exact form), FLT2: requests, pages and quantiles by host."""
    log = S.requests(spark, sf).withColumn("host", U.net_host(F.col("url")))
    return rounded(log.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_domain").alias("pages"), F.percentile("transfer_bytes", 0.5).alias("p50"), F.percentile("transfer_bytes", 0.9).alias("p90")).where("n >= 10"))


@query()
def host_stats_approx(spark, sf):
    """AGG3: approximate quantiles by host."""
    log = S.requests(spark, sf).withColumn("host", U.net_host(F.col("url")))
    return log.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("transfer_bytes", 0.5, 10000).alias("p50"), F.percentile_approx("transfer_bytes", 0.9, 10000).alias("p90")).where("n >= 10")


@query(f"""WITH {S.WITH_REQUESTS}, s AS (SELECT {LHOST} AS host, count(DISTINCT page_domain) AS pages, quantile_cont(transfer_bytes, 0.5) AS p50, quantile_cont(transfer_bytes, 0.9) AS p90 FROM requests GROUP BY 1),
 v AS (SELECT host FROM (SELECT host FROM s WHERE p50 > 0 AND p90 / p50 > 1.2 ORDER BY p90 / p50 DESC, host LIMIT 200)), b AS (SELECT host FROM (SELECT host FROM s ORDER BY pages DESC, host LIMIT 5)),
 d AS (SELECT host FROM v UNION SELECT host FROM b) SELECT page_domain, {LHOST} AS host, count(*) AS n FROM requests WHERE {LHOST} IN (SELECT host FROM d) GROUP BY 1, 2""")
def selected_hosts(spark, sf):
    """TOP1, SET1, JN2: variable and wide-spread hosts, and the requests of either."""
    log = S.requests(spark, sf).withColumn("host", U.net_host(F.col("url")))
    s = log.groupBy("host").agg(F.count_distinct("page_domain").alias("pages"), F.percentile("transfer_bytes", 0.5).alias("p50"), F.percentile("transfer_bytes", 0.9).alias("p90"))
    ratio = F.try_divide("p90", "p50")
    d = s.where((F.col("p50") > 0) & (ratio > 1.2)).orderBy(ratio.desc(), "host").limit(200).select("host").union(s.orderBy(F.desc("pages"), "host").limit(5).select("host")).distinct()
    return log.join(F.broadcast(d), "host", "left_semi").groupBy("page_domain", "host").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.WITH_REQUESTS} SELECT count(*) FILTER (WHERE {S.HASH.format('url')} % 100 < 5) AS url_5pct, count(*) FILTER (WHERE {S.HASH.format("page_domain || '|' || url")} % 100 < 10) AS page_url_10pct,
  count(*) FILTER (WHERE {S.HASH.format('page_domain')} % 4 = 0) AS pages_quarter, count(DISTINCT page_domain) FILTER (WHERE {S.HASH.format('page_domain')} % 4 = 0) AS whole_pages, count(*) FILTER (WHERE {S.HASH.format('page_domain')} % 8 = 0) AS pages_eighth FROM requests""")
def hash_samples(spark, sf):
    """FLT4-5, FLT7-8: repeatable samples by URL, page and URL, and whole pages with nested moduli."""
    url, both, page = (F.pmod(S.hash_number(*c), F.lit(m)) for c, m in ((("url",), 100), (("page_domain", "url"), 100), (("page_domain",), 8)))
    return S.requests(spark, sf).agg(F.count_if(url < 5).alias("url_5pct"), F.count_if(both < 10).alias("page_url_10pct"), F.count_if(page % 4 == 0).alias("pages_quarter"), F.count_distinct(F.when(page % 4 == 0, F.col("page_domain"))).alias("whole_pages"), F.count_if(page == 0).alias("pages_eighth"))


_TYPES = {"script": ("application/javascript", "text/javascript; charset=utf-8", "application/x-javascript"), "image": ("image/gif", "IMAGE/WEBP", "image/svg+xml"), "html": ("text/html; charset=UTF-8", "text/html", "text/plain"), "other": ("application/json", "font/woff2", "video/mp4")}
_TYPE_SQL = "CASE resource_type " + " ".join(f"WHEN '{k}' THEN CASE pos % 4 WHEN 0 THEN NULL WHEN 1 THEN '{a}' WHEN 2 THEN '{b}' ELSE '{c}' END" for k, (a, b, c) in _TYPES.items()) + " END"


@query(f"""WITH {S.WITH_REQUESTS}, t AS (SELECT transfer_bytes, trim(split_part(lower({_TYPE_SQL}), ';', 1)) AS ct FROM requests), g AS (SELECT transfer_bytes AS y, CASE WHEN ct LIKE '%javascript' THEN 'javascript' WHEN ct LIKE 'image/%' THEN 'image' WHEN ct = 'text/html' THEN 'html' WHEN ct = 'text/plain' THEN 'text' WHEN ct = 'application/json' THEN 'json' WHEN ct = 'video/mp4' THEN 'video' ELSE 'other' END AS content_group FROM t)
 SELECT content_group, count(*) AS n, round(avg(y), 4) AS mean_bytes, round(median(y), 4) AS median_bytes FROM g GROUP BY 1""")
def content_groups(spark, sf):
    """REQ9: sizes by group of the content type; parameters and case of the type don't count, unknown types are other."""
    log = S.requests(spark, sf).withColumn("content_type", F.expr(_TYPE_SQL)).withColumn("content_group", R.content_group(F.trim(F.split_part(F.lower("content_type"), F.lit(";"), F.lit(1)))))
    counts = log.groupBy("content_group").agg(F.count(F.lit(1)).alias("n"), F.avg("transfer_bytes").alias("mean_bytes"))
    return rounded(counts.join(percentiles(log, "transfer_bytes", {"median_bytes": 0.5}, ["content_group"]), "content_group"), 4)


@query()
def block_sample(spark, sf):
    """FLT6: a block sample; random by nature, so rows only."""
    return S.requests(spark, sf).sample(0.1, seed=7).select("page_idx", "pos", "url")


@query(f"""WITH {S.WITH_REQUESTS} SELECT page_idx, pos, url FROM requests ORDER BY md5('7|' || page_idx::VARCHAR || '|' || pos::VARCHAR), page_idx, pos LIMIT 100""")
def random_rows(spark, sf):
    """FLT9: a hundred rows of least hash."""
    return S.requests(spark, sf).orderBy(F.md5(F.concat_ws("|", F.lit("7"), "page_idx", "pos")), "page_idx", "pos").limit(100).select("page_idx", "pos", "url")


def split_of(*cols: str) -> F.Column:
    b = F.pmod(S.hash_number(*cols), F.lit(100))
    return F.when(b < 70, "train").when(b < 85, "val").otherwise("test")


@query(f"""WITH {S.WITH_REQUESTS}, b AS (SELECT transfer_bytes, {S.HASH.format("page_idx::VARCHAR || '|' || pos::VARCHAR")} % 100 AS r, {S.HASH.format('page_domain')} % 100 AS p FROM requests),
 u AS (SELECT 'row' AS kind, r AS x, transfer_bytes FROM b UNION ALL SELECT 'page', p, transfer_bytes FROM b) SELECT kind, CASE WHEN x < 70 THEN 'train' WHEN x < 85 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(transfer_bytes)::BIGINT AS bytes FROM u GROUP BY 1, 2""")
def splits(spark, sf):
    """FLT12-13: row and page-disjoint splits by hash."""
    log = S.requests(spark, sf)
    a, b = (log.select(F.lit(k).alias("kind"), split_of(*c).alias("split"), "transfer_bytes") for k, c in (("row", ("page_idx", "pos")), ("page", ("page_domain",))))
    return a.union(b).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("transfer_bytes").alias("bytes"))


@query(f"""WITH {S.WITH_REQUESTS}, c AS (SELECT quantile_cont(transfer_bytes, 0.9) AS cap FROM requests) SELECT resource_type, round(sum(least(transfer_bytes, cap)), 2) AS capped, count(*) AS n FROM requests, c WHERE transfer_bytes IS NOT NULL AND transfer_bytes >= 0 GROUP BY resource_type""")
def winsorised(spark, sf):
    """FLT3, FLT14: sizes capped at a quantile."""
    log = S.requests(spark, sf).where("transfer_bytes is not null and transfer_bytes >= 0")
    return L.one_row(log, percentiles(log, "transfer_bytes", {"cap": 0.9})).groupBy("resource_type").agg(F.round(F.sum(F.least("transfer_bytes", "cap")), 2).alias("capped"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.WITH_REQUESTS}, a AS (SELECT 'script' AS block, {LHOST} AS host, count(*) AS n, count(DISTINCT page_domain) AS pages, avg(transfer_bytes) AS mean_bytes, NULL::BIGINT AS wasted FROM requests WHERE resource_type = 'script' GROUP BY 2),
 b AS (SELECT 'image', {LHOST}, count(*), count(DISTINCT page_domain), NULL, sum(transfer_bytes)::BIGINT FROM requests WHERE resource_type = 'image' GROUP BY 2)
 SELECT block, host, n, pages, round(mean_bytes, 4) AS mean_bytes, wasted FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def audit_blocks(spark, sf):
    """AGG1-2, SET2: two blocks of host statistics under one another, missing columns null."""
    log = S.requests(spark, sf).withColumn("host", U.net_host(F.col("url")))
    base = lambda t: log.where(F.col("resource_type") == t).groupBy("host")
    a = base("script").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_domain").alias("pages"), F.round(F.avg("transfer_bytes"), 4).alias("mean_bytes")).withColumn("block", F.lit("script"))
    b = base("image").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_domain").alias("pages"), F.sum("transfer_bytes").alias("wasted")).withColumn("block", F.lit("image"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH {S.WITH_REQUESTS}, g AS (SELECT resource_type, sum(transfer_bytes) AS b FROM requests WHERE initiator_type = 'script' GROUP BY 1) SELECT resource_type, b::BIGINT AS bytes, round(b * 1.0 / (SELECT sum(b) FROM g), 6) AS share FROM g""")
def type_shares(spark, sf):
    """WIN1: shares of the total, by a one-row join."""
    g = S.requests(spark, sf).where("initiator_type = 'script'").groupBy("resource_type").agg(F.sum("transfer_bytes").alias("bytes"))
    return L.one_row(g, g.agg(F.sum("bytes").alias("t"))).select("resource_type", "bytes", F.round(F.col("bytes") * 1.0 / F.col("t"), 6).alias("share"))


@query(f"""WITH {S.WITH_REQUESTS}, t AS (SELECT sum(CASE WHEN initiator_type = 'parser' THEN transfer_bytes ELSE 0 END) AS root, sum(CASE WHEN initiator_type = 'script' THEN transfer_bytes ELSE 0 END) AS descendant,
  count(DISTINCT page_domain) AS pages, count(*) FILTER (WHERE initiator_type = 'parser' AND resource_type IN ('script', 'html')) AS casc_root_n FROM requests WHERE transfer_bytes IS NOT NULL)
 SELECT root::BIGINT AS root, descendant::BIGINT AS descendant, pages, casc_root_n, round(descendant * 1.0 / root, 6) AS factor, round(descendant * 1.0 / casc_root_n, 4) AS per_root FROM t""")
def tree_shape(spark, sf):
    """AGG10: roots and descendants by initiator."""
    log = S.requests(spark, sf).where("transfer_bytes is not null")
    size = lambda i: F.sum(F.when(F.col("initiator_type") == i, F.col("transfer_bytes")).otherwise(0))
    t = log.agg(size("parser").alias("root"), size("script").alias("descendant"), F.count_distinct("page_domain").alias("pages"), F.count_if((F.col("initiator_type") == "parser") & F.col("resource_type").isin("script", "html")).alias("casc_root_n"))
    return t.select("*", F.round(F.col("descendant") * 1.0 / F.col("root"), 6).alias("factor"), F.round(F.col("descendant") * 1.0 / F.col("casc_root_n"), 4).alias("per_root"))


@query(f"""WITH {S.WITH_REQUESTS} SELECT {LHOST} AS host, round(sum(CASE WHEN initiator_type = 'parser' THEN transfer_bytes ELSE 0 END) * 1.0 / nullif(sum(transfer_bytes), 0), 6) AS parser_share FROM requests WHERE transfer_bytes IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""")
def parser_share(spark, sf):
    """AGG11: the share of a host's bytes that markup asks for."""
    log = S.requests(spark, sf).where("transfer_bytes is not null").withColumn("host", U.net_host(F.col("url")))
    g = log.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("initiator_type") == "parser", F.col("transfer_bytes")).otherwise(0)).alias("p"), F.sum("transfer_bytes").alias("t")).where("n >= 20")
    return g.select("host", F.round(F.try_divide("p", "t"), 6).alias("parser_share"))


@query(f"""WITH {S.WITH_REQUESTS}, r AS (SELECT resource_type, {LHOST} AS host, count(*) AS n FROM requests GROUP BY 1, 2) SELECT resource_type, host, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY resource_type ORDER BY n DESC, host) AS rank FROM r) WHERE rank <= 3""")
def top_hosts_by_type(spark, sf):
    """WIN2, TOP4: the three busiest hosts of each type."""
    r = S.requests(spark, sf).groupBy("resource_type", U.net_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("resource_type").orderBy(F.desc("n"), "host"))).where("rank <= 3")


@query(f"""WITH {S.WITH_REQUESTS}, v AS (SELECT transfer_bytes AS value, count(*) AS n FROM requests WHERE transfer_bytes IS NOT NULL GROUP BY 1) SELECT value, n, round(sum(n) OVER (ORDER BY value) * 1.0 / sum(n) OVER (), 9) AS cum_share FROM v""")
def size_cdf(spark, sf):
    """AGG37, WIN6: the cumulative distribution of sizes."""
    from tallybrook.operators.evaluate import cdf

    return rounded(cdf(S.requests(spark, sf), "transfer_bytes"), 9)


@query(f"""WITH {S.WITH_REQUESTS}, w AS (SELECT CASE WHEN transfer_bytes = 0 THEN 0 ELSE floor(log10(transfer_bytes))::INTEGER + 1 END AS decade FROM requests WHERE transfer_bytes IS NOT NULL) SELECT decade, count(*) AS n FROM w GROUP BY decade""")
def size_histogram(spark, sf):
    """AGG37: sizes by powers of ten."""
    d = F.when(F.col("transfer_bytes") == 0, 0).otherwise(F.floor(F.log10("transfer_bytes")).cast("int") + 1)
    return S.requests(spark, sf).where("transfer_bytes is not null").groupBy(d.alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.WITH_REQUESTS} SELECT {LHOST} AS host, count(*) AS n, round(stddev_samp(transfer_bytes) / greatest(avg(transfer_bytes), 1), 6) AS cv FROM requests WHERE transfer_bytes IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def host_variation(spark, sf):
    """AGG36: coefficient of variation within hosts."""
    log = S.requests(spark, sf).where("transfer_bytes is not null").withColumn("host", U.net_host(F.col("url")))
    return rounded(log.groupBy("host").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(F.col("transfer_bytes").cast("double")) / F.greatest(F.avg("transfer_bytes"), F.lit(1))).alias("cv")).where("n >= 10"))


@query(f"""WITH {S.WITH_REQUESTS} SELECT {PATH} AS path, count(*) AS n, round(median(transfer_bytes), 4) AS median_bytes, round(stddev_samp(transfer_bytes), 4) AS sd_bytes FROM requests WHERE {LHOST} = 'tag.adnet.example' AND transfer_bytes IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, path LIMIT 8""")
def top_paths(spark, sf):
    """AGG38: the busiest paths of one host."""
    log = S.requests(spark, sf).where(U.net_host(F.col("url")) == "tag.adnet.example").where("transfer_bytes is not null")
    g = log.groupBy(U.rule_path(F.col("url")).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.median("transfer_bytes").alias("median_bytes"), F.stddev_samp(F.col("transfer_bytes").cast("double")).alias("sd_bytes")).where("n >= 20")
    return rounded(g, 4).orderBy(F.desc("n"), "path").limit(8)


@query(f"""WITH {S.WITH_REQUESTS}, k AS (SELECT DISTINCT replace(page_domain, 'www.', '') AS domain FROM requests WHERE page_idx % 3 = 0) SELECT page_domain, count(*) AS n, sum(transfer_bytes)::BIGINT AS bytes, count(DISTINCT CASE WHEN resource_type = 'script' THEN {LHOST} END) AS script_hosts FROM requests WHERE replace(page_domain, 'www.', '') IN (SELECT domain FROM k) GROUP BY page_domain""")
def domain_mass(spark, sf):
    """JN4, AGG15: an either-or key made one, and conditional distinct counts."""
    log = S.requests(spark, sf).withColumn("key", U.without_www(F.col("page_domain")))
    keys = log.where("page_idx % 3 = 0").select("key").distinct()
    return log.join(keys, "key", "left_semi").groupBy("page_domain").agg(F.count(F.lit(1)).alias("n"), F.sum("transfer_bytes").alias("bytes"), F.count_distinct(F.when(F.col("resource_type") == "script", U.net_host(F.col("url")))).alias("script_hosts"))
