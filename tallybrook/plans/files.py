"""Queries over readers: the derived log is written as CSV, HAR bundles, page records and lists, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions import urls as U
from tallybrook.operators import classify as C
from tallybrook.operators import decide as D
from tallybrook.operators import lookup as L
from tallybrook.plans import paired as PP
from tallybrook.plans import rules as RR
from tallybrook.plans.features import LHOST, PATH
from tallybrook.plans.registry import query
from tallybrook.plans.rules import WITH_BEST
from tallybrook.sources import fixtures as S
from tallybrook.sources import readers as X
from tallybrook.sources.storage import scratch


def csv_of(spark, sf, compression: str = "none") -> str:
    """The log as CSV files with the columns of a log export."""
    u, path = F.col("url"), scratch(spark, "log-csv")
    log = S.requests(spark, sf).select(
        U.net_host(u).alias("tracker_domain"), U.rule_path(u).alias("url_path"), U.path_depth(u).alias("path_depth"), F.lit("js").alias("file_extension"), u.contains("?").alias("has_query_params"),
        F.length(u).alias("url_length"), F.lit(1).alias("num_query_params"), "resource_type", "initiator_type", "http_method", "page_domain", "transfer_bytes",
    )
    log.write.option("header", True).option("compression", compression).csv(path)
    return path


@query(f"WITH {S.WITH_REQUESTS} SELECT page_domain, count(*) AS n, sum(greatest(transfer_bytes, 0))::BIGINT AS bytes FROM requests WHERE transfer_bytes IS NOT NULL AND {S.HASH.format('page_domain')} % 4 = 0 GROUP BY 1")
def csv_page_sample(spark, sf):
    """SRC5-6, SNK4: a CSV log with its types, columns pruned, whole pages sampled by hash."""
    return X.csv_log(spark, csv_of(spark, sf), 4).groupBy("page_domain").agg(F.count(F.lit(1)).alias("n"), F.sum("transfer_bytes").alias("bytes"))


@query(f"WITH {S.WITH_REQUESTS} SELECT {LHOST} AS tracker_domain, count(*) AS n, sum(length(url))::BIGINT AS chars, count(*) FILTER (WHERE contains(url, '?')) AS with_query FROM requests WHERE transfer_bytes IS NOT NULL GROUP BY 1")
def gzipped_csv_log(spark, sf):
    """SRC7: a folder of gzipped CSV shards."""
    log = X.csv_log(spark, csv_of(spark, sf, "gzip"))
    return log.groupBy("tracker_domain").agg(F.count(F.lit(1)).alias("n"), F.sum("url_length").alias("chars"), F.count_if("has_query_params").alias("with_query"))


def lines_of(spark, name: str, df: DataFrame) -> str:
    """A row's struct as a line of JSON."""
    path = scratch(spark, name)
    df.select(F.to_json(F.struct("*"))).write.text(path)
    return path


def in_order(item: F.Column) -> F.Column:
    """The items of a page in the order of their positions."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"])


def har_bundles(spark, sf) -> str:
    entry = F.struct(F.struct("url", F.col("http_method").alias("method")).alias("request"), F.struct(F.coalesce("transfer_bytes", F.lit(-1)).alias("_transferSize"), F.lit("").alias("redirectURL")).alias("response"))
    pages = S.requests(spark, sf).groupBy("page_idx").agg(in_order(entry).alias("entries"))
    return lines_of(spark, "har", pages.select("page_idx", F.struct("entries").alias("log")))


@query(f"""WITH {WITH_BEST}, k AS (SELECT page_idx, http_method AS method, url, arg_min(coalesce(transfer_bytes, -1), pos) AS size FROM requests GROUP BY 1, 2, 3)
 SELECT method, {LHOST.replace('url', 'k.url')} AS host, b.pattern IS NOT NULL AS is_tracker, count(*) AS n, sum(size)::BIGINT AS bytes FROM k LEFT JOIN best b ON k.url = b.url GROUP BY 1, 2, 3""")
def har_index(spark, sf):
    """SRC8, PAIR10: HAR entries by page, method and URL, the first wins, with host and tracker flag."""
    index = X.har(spark, har_bundles(spark, sf), bundled=True).groupBy("page_idx", "method", "url").agg(F.min_by("transfer_size", "pos").alias("size"))
    return C.is_tracker(index, S.rules(spark)).groupBy("method", U.net_host(F.col("url")).alias("host"), "is_tracker").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {S.WITH_REQUESTS}, p AS (SELECT page_idx, count(*) AS n, coalesce(sum(transfer_bytes), 0)::BIGINT AS bytes FROM requests WHERE page_idx % 13 <> 0 GROUP BY 1)
 SELECT CASE WHEN page_idx % 7 = 0 THEN 'timeout' ELSE 'ok' END AS outcome, count(*) AS pages, sum(n)::BIGINT AS n_requests, sum(bytes)::BIGINT AS bytes FROM p GROUP BY 1""")
def page_sidecars(spark, sf):
    """SRC9: page records; a cut-off one is skipped."""
    pages = S.requests(spark, sf).groupBy(F.col("page_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("transfer_bytes"))
    line = F.to_json(F.struct("*", F.when(F.col("idx") % 7 == 0, "timeout").otherwise("ok").alias("outcome")))
    path = scratch(spark, "sidecars")
    pages.select(F.when(F.col("idx") % 13 == 0, F.substring(line, 1, 4)).otherwise(line)).write.text(path)
    return X.page_records(spark, path, bundled=True).groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_requests").alias("n_requests"), F.sum("transfer_bytes").alias("bytes"))


@query(f"WITH {S.WITH_PAIRED} SELECT failure, resource_type, count(*) AS n, count(DISTINCT page_idx) AS pages FROM blocked WHERE rep = 1 GROUP BY 1, 2")
def blocked_records(spark, sf):
    """SRC10: blocked requests of every page, read from the blocker's records."""
    pages = S.blocked(spark, sf).where("rep = 1").groupBy("page_idx").agg(in_order(F.struct("url", "resource_type", "failure")).alias("blocked"))
    found = X.blocked_log(spark, lines_of(spark, "blocked", pages), bundled=True)
    return found.groupBy("failure", "resource_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_idx").alias("pages"))


@query(f"WITH {S.WITH_REQUESTS}, f AS (SELECT page_idx, url, arg_min(resource_type, pos) AS t FROM requests GROUP BY 1, 2) SELECT t AS resource_type, count(*) AS n FROM f GROUP BY 1")
def first_types(spark, sf):
    """SRC11: a URL's first type on its page, from the type log."""
    pages = S.requests(spark, sf).groupBy("page_idx").agg(in_order(F.struct("url", "resource_type")).alias("types"))
    return X.type_log(spark, lines_of(spark, "types", pages), bundled=True).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PP._CELLS} SELECT host, width, count(*) AS n, sum(control_bytes - ablated_bytes)::BIGINT AS moved FROM cells GROUP BY 1, 2")
def ablation_records(spark, sf):
    """SRC12: a folder of ablation pages."""
    cell = F.struct("host", "width", "control_bytes", "ablated_bytes")
    pages = PP.cells(spark, sf).groupBy("page_idx", "rep").agg(F.collect_list(cell).alias("cells"))  # a cell for each width
    found = X.ablation_pages(spark, lines_of(spark, "ablation", pages))
    return found.groupBy("host", "width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("control_bytes") - F.col("ablated_bytes")).alias("moved"))


@query(f"""WITH {S.WITH_REQUESTS}, s AS (SELECT page_idx, pos AS k, coalesce(transfer_bytes, 0) AS bytes FROM requests WHERE pos <= 5), d AS (SELECT k, bytes - lag(bytes) OVER (PARTITION BY page_idx ORDER BY k) AS step FROM s)
 SELECT k::INTEGER AS k, count(*) AS n, coalesce(sum(step), 0)::BIGINT AS step FROM d GROUP BY 1""")
def sweep_records(spark, sf):
    """SRC13: a folder of sweep pages, each step against the one before."""
    step = F.struct(F.col("pos").cast("int").alias("k"), F.lit(1).alias("n_blocked"), F.coalesce("transfer_bytes", F.lit(0)).alias("bytes"))
    pages = S.requests(spark, sf).where("pos <= 5").groupBy("page_idx").agg(F.lit(1).alias("rep"), F.collect_list(step).alias("steps"))
    s = X.sweep_pages(spark, lines_of(spark, "sweep", pages))
    before = s.select("page_idx", (F.col("k") + 1).alias("k"), F.col("bytes").alias("before"))
    return s.join(before, ["page_idx", "k"], "left").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("bytes") - F.col("before")), F.lit(0)).alias("step"))


_LISTED = f"""{S.WITH_REQUESTS}, h AS (SELECT {LHOST} AS host, count(*) AS n, coalesce(sum(transfer_bytes), 0)::BIGINT AS bytes FROM requests GROUP BY 1)"""


def services_file(spark, sf) -> DataFrame:
    """A list in the services format over the log's hosts, written and read: metrics hosts are Analytics, others Advertising."""
    host = S.requests(spark, sf).select(U.net_host(F.col("url")).alias("host")).distinct()
    kind = F.when(F.col("host").contains("metrics"), "Analytics").otherwise("Advertising")
    org = F.concat(F.lit('{"'), F.regexp_extract("host", r"([^.]*)\.example$", 1), F.lit('": {"https://'), F.col("host"), F.lit('/": ["'), F.col("host"), F.lit('"], "dnt": "yes"}}'))
    kinds = host.select(kind.alias("kind"), org.alias("org")).groupBy("kind").agg(F.concat(F.lit('"'), "kind", F.lit('": ['), F.array_join(F.array_sort(F.collect_list("org")), ", "), F.lit("]")).alias("part"))
    path = scratch(spark, "services")
    kinds.groupBy().agg(F.concat(F.lit('{"categories": {'), F.array_join(F.array_sort(F.collect_list("part")), ", "), F.lit("}}")).alias("value")).write.text(path)  # a list has some thousand entries
    return X.services_list(spark, path)


@query(f"""WITH {_LISTED}, e AS (SELECT host, CASE WHEN contains(host, 'metrics') THEN 'Analytics' ELSE 'Advertising' END AS category, regexp_extract(host, '([^.]*)\\.example$', 1) AS organization FROM h)
 SELECT row_number() OVER (ORDER BY category, organization, host)::INTEGER AS position, host AS pattern, category, organization, n, bytes FROM e JOIN h USING (host)""")
def list_entries(spark, sf):
    """SRC14-16: the entries of a list file, flattened, without repeats, in order, with the requests of each."""
    entries = C.entries_by_pattern(services_file(spark, sf), ["category", "organization", "pattern"])
    log = S.requests(spark, sf).groupBy(U.net_host(F.col("url")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("bytes"))
    return entries.join(log, "pattern").select("position", "pattern", "category", "organization", "n", "bytes")


@query(f"""WITH {WITH_BEST} SELECT count(*) AS n, count(*) FILTER (WHERE b.pattern IS NOT NULL) AS by_default, count(*) AS by_file FROM requests r LEFT JOIN best b ON r.url = b.url""")
def list_changes(spark, sf):
    """SRC18: the verdicts of the default list, of one from a file, and of the default list again; a list is an argument."""
    log = S.requests(spark, sf)
    count = lambda rules: C.is_tracker(log, rules).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_tracker").alias("k"))
    both = L.one_row(count(S.rules(spark)).select("n", F.col("k").alias("by_default")), count(services_file(spark, sf)).select(F.col("k").alias("by_file")))
    return L.one_row(both, count(S.rules(spark)).select(F.col("k").alias("again"))).where("again = by_default").select("n", "by_default", "by_file")


@query(f"WITH {S.WITH_REQUESTS}, d AS (SELECT page_domain AS domain, count(*) AS n FROM requests GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, domain)::INTEGER AS rank, domain FROM d")
def domain_ranks(spark, sf):
    """SRC20: a ranked list of domains, written as CSV and read."""
    from pyspark.sql import Window

    ranks = S.requests(spark, sf).groupBy(F.col("page_domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "ranks")
    ranks.select(F.row_number().over(Window.orderBy(F.desc("n"), "domain")).alias("rank"), "domain").write.csv(path)  # a row for each domain
    return X.ranked_domains(spark, path)


@query(f"""WITH {S.WITH_REQUESTS}, c AS (SELECT *, CASE WHEN CAST(regexp_extract(page_domain, '([0-9]+)', 1) AS INTEGER) % 4 = 0 THEN 'other' WHEN CAST(regexp_extract(page_domain, '([0-9]+)', 1) AS INTEGER) % 4 = 1 THEN 'news' ELSE 'shop' END AS category FROM requests)
 SELECT category, count(*) AS n, count(DISTINCT page_domain) AS pages, coalesce(sum(transfer_bytes), 0)::BIGINT AS bytes FROM c GROUP BY 1""")
def page_categories(spark, sf):
    """SRC21, JN17: categories of pages from a label file, by the domain with or without www., with a default."""
    number = F.regexp_extract("page_domain", "([0-9]+)", 1).cast("int")
    bare = F.when(number % 2 == 0, F.col("page_domain")).otherwise(F.regexp_replace("page_domain", r"^www\.", ""))
    labels = S.requests(spark, sf).select("page_domain").distinct().where(number % 4 != 0).select(bare.alias("domain"), F.when(number % 4 == 1, "news").otherwise("shop").alias("category"))
    path = scratch(spark, "labels")
    X.write_csv(labels, path)
    log = L.with_dimension(S.requests(spark, sf), X.domain_labels(spark, path, ("news", "shop", "other")), "page_domain", "domain", "category", "other")
    return log.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_domain").alias("pages"), F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("bytes"))


@query(f"WITH {S.WITH_PAIRED} SELECT (SELECT count(*) FROM requests) AS n_requests, (SELECT count(*) FROM blocked) AS n_blocked, (SELECT count(DISTINCT page_idx) FROM blocked) AS pages_blocked")
def summary_report(spark, sf):
    """SNK5: one-row tables written as one JSON report, and read again."""
    path = scratch(spark, "summary")
    X.write_summary(path, log=S.requests(spark, sf).agg(F.count(F.lit(1)).alias("n")), blocked=S.blocked(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_idx").alias("pages")))
    return spark.read.schema("log struct<n: bigint>, blocked struct<n: bigint, pages: bigint>").json(path).select(F.col("log.n").alias("n_requests"), F.col("blocked.n").alias("n_blocked"), F.col("blocked.pages").alias("pages_blocked"))


_BLOCK = S.HASH.format("page_idx::VARCHAR") + " % 16"


@query(f"""WITH {S.WITH_REQUESTS} SELECT page_idx, pos, url FROM requests WHERE {S.HASH.format("'k|' || (" + _BLOCK + ")::VARCHAR")} % 4 = 0""")
def file_block_sample(spark, sf):
    """FLT6: one block in four of a table of sixteen; the others' files are not opened."""
    path = scratch(spark, "log-blocks")
    X.write_blocks(S.requests(spark, sf), path, "page_idx", blocks=16)
    return X.block_sample(spark, path, 4, "k").select("page_idx", "pos", "url")


@query(f"WITH {RR.DECIDED} SELECT reason, count(*) AS n, count(*) FILTER (WHERE reason = 'blocked') AS n_blocked FROM decided GROUP BY reason")
def decisions_by_read_lists(spark, sf):
    """SRC19: the decision with its entity, exception and skip lists written as the browser keeps them and read again."""
    path = scratch(spark, "lists")
    entities = spark.sql(RR._ENTITIES).withColumn("name", F.col("resource"))
    skips = spark.sql(RR._SKIP).withColumn("filter_expression", F.lit(None).cast("string"))
    X.write_lists(path, entities, spark.sql(RR._EXCEPTIONS), skips)
    exceptions = D.active_exceptions(X.exception_list(spark, f"{path}/exceptions"), "142.0", private_browsing=False)
    skip = X.skip_list(spark, f"{path}/skips").where(D.applies(F.col("filter_expression"), "142.0")).select("pattern")
    found = D.decide(RR._paged(spark, sf), D.listed_hosts(S.rules(spark)), X.entity_list(spark, f"{path}/entities"), exceptions, skip)
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("would_block").alias("n_blocked"))
