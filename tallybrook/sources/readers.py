"""Readers of request logs, paired-crawl files and rule lists, with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.sources.fixtures import hash_number

LOG = "tracker_domain string, url_path string, path_depth int, file_extension string, has_query_params boolean, url_length int, num_query_params int, resource_type string, initiator_type string, http_method string, page_domain string, transfer_bytes bigint"
HAR = "log struct<entries: array<struct<request: struct<url: string, method: string>, response: struct<_transferSize: bigint, redirectURL: string>>>>"
PAGE = "idx bigint, url string, outcome string, n_requests bigint, transfer_bytes bigint, cpu_total_s double, host_cpu_pct_mean double, t_start_iso string"
BLOCKED = "blocked array<struct<url: string, resource_type: string, failure: string>>"
TYPES = "url string, resource_type string"
SERVICES = "categories map<string, array<map<string, map<string, string>>>>"
ENTITIES = "entities map<string, struct<properties: array<string>, resources: array<string>>>"
EXCEPTIONS = "data array<struct<classifierFeatures: array<string>, filter_expression: string, category: string, isPrivateBrowsingOnly: boolean, urlPattern: string, topLevelUrlPattern: string>>"
SKIPS = "data array<struct<feature: string, pattern: string, filter_expression: string>>"


def parquet_log(spark: SparkSession, *paths: str) -> DataFrame:
    """A request log of one or many Parquet globs."""
    return spark.read.parquet(*paths)


def csv_log(spark: SparkSession, path: str, page_modulus: int = 1) -> DataFrame:
    """A request log of CSV files, gzipped or not, whole pages sampled by hash; sizes are dropped if null, and at least 0."""
    log = spark.read.schema(LOG).option("header", True).csv(path)
    log = log.where("transfer_bytes is not null").withColumn("transfer_bytes", F.greatest("transfer_bytes", F.lit(0)))
    return log if page_modulus == 1 else log.where(F.pmod(hash_number("page_domain"), F.lit(page_modulus)) == 0)


def _from_path(pattern: str, group: int = 1):
    return F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, group), F.lit(""))


def har(spark: SparkSession, path: str, page_pattern: str = r"har_(\d+)_", bundled: bool = False) -> DataFrame:
    """page_idx, pos, url, method, transfer_size, redirect_url of every HAR entry.

    page_idx comes from the file name; in bundles, which hold one HAR a line, from each line.
    """
    raw = _documents(spark, path, HAR, page_pattern, bundled).select("page_idx", F.posexplode("log.entries").alias("pos", "e"))
    return raw.select("page_idx", "pos", F.col("e.request.url").alias("url"), F.col("e.request.method").alias("method"), F.col("e.response._transferSize").alias("transfer_size"), F.col("e.response.redirectURL").alias("redirect_url"))


def _documents(spark: SparkSession, path: str, schema: str, page_pattern: str, bundled: bool) -> DataFrame:
    """JSON documents with their page_idx; in bundles, lines that are no JSON are skipped."""
    if bundled:
        return spark.read.schema(f"page_idx bigint, {schema}").json(path).where("page_idx is not null")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("page_idx", _from_path(page_pattern).cast("bigint"))


def page_records(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Per-page sidecars, a file or (bundled) a line each; corrupt ones and those without idx are skipped."""
    return spark.read.schema(PAGE).option("multiLine", not bundled).option("mode", "PERMISSIVE").json(path).where("idx is not null")


def blocked_log(spark: SparkSession, path: str, page_pattern: str = r"blocked_(\d+)_", bundled: bool = False) -> DataFrame:
    """page_idx, pos, url, resource_type, failure of every blocked request of a page."""
    return _documents(spark, path, BLOCKED, page_pattern, bundled).select("page_idx", F.posexplode("blocked").alias("pos", "b")).select("page_idx", "pos", "b.*")


def type_log(spark: SparkSession, path: str, page_pattern: str = r"types_(\d+)_", bundled: bool = False) -> DataFrame:
    """page_idx, url, resource_type: a URL's first type on its page."""
    kind = f"array<struct<{TYPES.replace(' string', ': string')}>>"
    if bundled:
        raw = _documents(spark, path, f"types {kind}", page_pattern, True).select("page_idx", F.posexplode("types").alias("pos", "t"))
    else:
        raw = spark.read.option("wholetext", True).text(path).select(_from_path(page_pattern).cast("bigint").alias("page_idx"), F.posexplode(F.from_json("value", kind)).alias("pos", "t"))
    return raw.groupBy("page_idx", "t.url").agg(F.min_by("t.resource_type", "pos").alias("resource_type"))


def ablation_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_idx, rep, host, width, control_bytes, ablated_bytes of every cell of a folder of ablation pages, one a line."""
    cells = "page_idx bigint, rep int, cells array<struct<host: string, width: string, control_bytes: bigint, ablated_bytes: bigint>>"
    return spark.read.schema(cells).json(path).where("page_idx is not null").select("page_idx", "rep", F.explode("cells").alias("c")).select("page_idx", "rep", "c.*")


def sweep_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_idx, rep, k, n_blocked, bytes of every step of a folder of sweep pages, one a line."""
    steps = "page_idx bigint, rep int, steps array<struct<k: int, n_blocked: bigint, bytes: bigint>>"
    return spark.read.schema(steps).json(path).where("page_idx is not null").select("page_idx", "rep", F.explode("steps").alias("s")).select("page_idx", "rep", "s.*")


def services_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a blocklist: entry_id, pattern, category, organization, organization_url.

    Values of an organisation that aren't lists are markers, not entries.
    """
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", SERVICES).alias("j"))
    flat = raw.select(F.posexplode("j.categories").alias("c", "category", "orgs")).select("c", "category", F.posexplode("orgs").alias("o", "org"))
    flat = flat.select("c", "o", "category", F.explode("org").alias("organization", "urls")).select("c", "o", "category", "organization", F.posexplode("urls").alias("u", "organization_url", "own"))
    flat = flat.where(F.col("own").startswith("[")).select("c", "o", "u", "category", "organization", "organization_url", F.posexplode(F.from_json("own", "array<string>")).alias("p", "pattern"))
    order = F.struct("c", "o", "u", "p")
    one = flat.groupBy("pattern", "category", "organization", "organization_url").agg(F.min(order).alias("order"))
    every = one.groupBy().agg(F.array_sort(F.collect_list(F.struct("order", "pattern", "category", "organization", "organization_url"))).alias("all"))  # a list has some thousand entries
    return every.select(F.posexplode("all").alias("at", "e")).select((F.col("at") + 1).alias("entry_id"), "e.pattern", "e.category", "e.organization", "e.organization_url")


def entity_list(spark: SparkSession, path: str) -> DataFrame:
    """resource, property pairs of entities."""
    raw = spark.read.schema(ENTITIES).option("multiLine", True).json(path).select(F.explode("entities").alias("name", "e"))
    return raw.select("name", F.explode("e.resources").alias("resource"), F.col("e.properties").alias("ps")).select("name", "resource", F.explode("ps").alias("property"))


def exception_list(spark: SparkSession, path: str, feature: str = "tracking-protection") -> DataFrame:
    """exception_id, url_pattern, top_pattern, category, private_only, filter_expression of a feature's exceptions."""
    raw = spark.read.schema(EXCEPTIONS).option("multiLine", True).json(path).select(F.posexplode("data").alias("exception_id", "d"))
    own = F.exists("d.classifierFeatures", lambda f: f == feature)
    return raw.where(own).select("exception_id", F.col("d.urlPattern").alias("url_pattern"), F.col("d.topLevelUrlPattern").alias("top_pattern"), F.col("d.category").alias("category"), F.col("d.isPrivateBrowsingOnly").alias("private_only"), F.col("d.filter_expression").alias("filter_expression"))


def skip_list(spark: SparkSession, path: str, feature: str = "tracking-protection") -> DataFrame:
    """pattern and filter_expression of hosts that a feature never blocks."""
    raw = spark.read.schema(SKIPS).option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    return raw.where(F.col("d.feature") == feature).select(F.explode(F.split("d.pattern", ",")).alias("pattern"), F.col("d.filter_expression").alias("filter_expression"))


def ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    """rank, domain of a list with lines 'rank,domain' or 'domain'; the latter rank null."""
    raw = spark.read.schema("a string, b string").csv(path)
    return raw.select(F.when(F.col("b").isNotNull(), F.col("a").try_cast("int")).alias("rank"), F.lower(F.trim(F.coalesce("b", "a"))).alias("domain")).where("domain <> ''")


def domain_labels(spark: SparkSession, path: str, categories: tuple[str, ...]) -> DataFrame:
    """domain, category; a category that isn't known is an error."""
    labels = spark.read.schema("domain string, category string").option("header", True).csv(path)
    odd = labels.where(~F.col("category").isin(*categories)).select("category").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unknown categories {[r[0] for r in odd]}")
    return labels


def write_blocks(df: DataFrame, path: str, *key: str, blocks: int) -> None:
    """df in so many blocks by the hash of a key, a folder each, so that a sample of blocks reads no other."""
    block = F.pmod(hash_number(*key), F.lit(blocks)).cast("int")
    df.withColumn("block", block).repartition("block").write.mode("overwrite").option("compression", "zstd").partitionBy("block").parquet(path)


def block_sample(spark: SparkSession, path: str, every: int, seed: str) -> DataFrame:
    """The rows of one in so many blocks, chosen by hash.  The choice is a filter on the folders' names: the scan lists and
    opens the chosen blocks only."""
    return spark.read.parquet(path).where(F.pmod(hash_number(F.lit(seed), "block"), F.lit(every)) == 0)


def write_lists(path: str, entities: DataFrame, exceptions: DataFrame, skips: DataFrame, feature: str = "tracking-protection") -> None:
    """entities (name, resource, property), exceptions (exception_id, ...) and skips (pattern, filter_expression) as one
    JSON document each, in the form that the readers take; each list is one document by its form, whose size the lists bound."""
    own = entities.groupBy("name").agg(F.struct(F.collect_set("property").alias("properties"), F.collect_set("resource").alias("resources")).alias("e"))
    own.agg(F.map_from_entries(F.collect_list(F.struct("name", "e"))).alias("entities")).write.mode("overwrite").json(f"{path}/entities")
    item = F.struct(F.array(F.lit(feature)).alias("classifierFeatures"), "filter_expression", "category", F.col("private_only").alias("isPrivateBrowsingOnly"), F.col("url_pattern").alias("urlPattern"), F.col("top_pattern").alias("topLevelUrlPattern"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("exception_id", item.alias("x")))), lambda e: e["x"])
    exceptions.agg(ordered.alias("data")).write.mode("overwrite").json(f"{path}/exceptions")
    skips.agg(F.collect_list(F.struct(F.lit(feature).alias("feature"), "pattern", "filter_expression")).alias("data")).write.mode("overwrite").json(f"{path}/skips")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(path: str, **parts: DataFrame) -> None:
    """One-row tables as one JSON object with a field for each."""
    rows = [df.select(F.struct("*").alias(name)) for name, df in parts.items()]
    reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows).write.mode("overwrite").json(path)
