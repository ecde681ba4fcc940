"""Hierarchical size table: fit conditional means from coarse to fine keys, spend a budget on them, and score requests.

Levels, fine to coarse: exact path, path template, path prefix, host, host template, extension and query bucket, extension,
context.  Keys of all but the context level start with the key group of the request's context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions import requests as R
from tallybrook.functions import urls as U
from tallybrook.operators.lookup import one_row
from tallybrook.sources.storage import cut

LEVELS = ("path", "template", "prefix", "host", "host_template", "ext_query", "ext", "context")
#: Main-thread cost by context (ms per KiB), and follow-up transfer by level and context.
CPU_MS_PER_KIB = {"script": 2.0, "image": 0.10, "video": 0.02, "other": 0.10, "audio": 0.02, "css": 0.30, "font": 0.05, "html": 0.30, "text": 0.20, "wasm": 2.00, "xml": 0.20, "json": 0.10}
CPU_MS_FIXED = 0.15
FOLLOWUP_PER_REQUEST, FOLLOWUP_PER_HOST, FOLLOWUP_CPU_MS_PER_KIB = 47_000, 59_900, 0.9
LEVEL_SCALE = {"path": 1.07, "template": 0.95, "prefix": 1.05, "host": 1.07, "host_template": 0.94, "ext_query": 1.09, "ext": 1.07, "context": 1.07, "bodyless": 1.00}
PLAN_ROWS = 500_000  # table rows up to which scoring broadcasts; larger tables are joined by a shuffle


def features(log: DataFrame) -> DataFrame:
    """log (url, resource_type) plus the key parts of every level."""
    p = F.col("parts_")
    out = log.withColumn("parts_", U.url_parts(F.col("url")))
    out = out.withColumns({"host": F.coalesce(p["host"], F.lit("")), "path": p["path"], "ctx": R.context_of(F.col("resource_type")), "context": R.context_name(F.col("resource_type"))})
    out = out.withColumns({"kgroup": R.key_group(F.col("context")), "ext": U.estimator_extension(F.col("path")), "template_": U.path_template(F.col("path")), "host_template_": U.host_template(F.col("host")), "qbucket": U.query_bucket(p["query_length"])})
    return out.drop("parts_")


def keys() -> dict[str, Column]:
    """Key of each level over the columns of features()."""
    g, own = F.col("kgroup"), lambda level, *c: F.concat_ws("|", F.lit(level), *c)
    host, tpl = F.col("host"), F.col("template_")
    return {
        "path": own("path", g, F.concat(host, F.col("path"))),
        "template": own("template", g, F.concat(host, tpl)),
        "prefix": own("prefix", g, F.col("ext"), F.concat(host, U.path_prefix(tpl))),
        "host": own("host", g, host),
        "host_template": own("host_template", g, F.col("host_template_")),
        "ext_query": own("ext_query", g, F.col("ext"), F.col("qbucket").cast("string")),
        "ext": own("ext", g, F.col("ext")),
        "context": own("context", F.col("context")),
    }


def split_bodyless(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a body, bodyless ones)."""
    flag = R.is_bodyless(F.col("http_method"))
    return log.where(~flag), log.where(flag)


def alike(log: DataFrame) -> DataFrame:
    """One row for the sized requests of equal features: url (their host, path and query length), resource_type, rows_ and sum_.

    Requests are added up where they are, so patterns run over different URLs and not over requests.
    """
    y = F.greatest(F.col("transfer_bytes"), F.lit(0)).cast("double")
    return log.where("transfer_bytes is not null").groupBy(U.plain_query(F.col("url")).alias("url"), "resource_type").agg(F.count(F.lit(1)).alias("rows_"), F.sum(y).alias("sum_"))


def fit_levels(log: DataFrame, shrink: float = 0.0, min_count: int = 1, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """level, key, n, mean, parent, est, gain of every key; log: features() of alike().

    Level by level, coarse first: a key's estimate is its mean, shrunk to its rows' parent estimate.  Rows are counted
    once by their URL and then by their chain of keys, so all levels work on the distinct chains.
    """
    made = keys()
    chains = log.groupBy(*(made[v].alias(f"k_{v}") for v in levels)).agg(F.sum("rows_").alias("n"), F.sum("sum_").alias("y"))
    chains = cut(chains)
    chains = one_row(chains, chains.agg((F.sum("y") / F.sum("n")).alias("parent")))
    out = None
    for level in reversed(levels):
        k = f"k_{level}"
        stats = chains.groupBy(k).agg(F.sum("n").alias("count_"), (F.sum("y") / F.sum("n")).alias("mean_"), (F.sum(F.col("parent") * F.col("n")) / F.sum("n")).alias("parent_")).where(F.col("count_") >= min_count)
        stats = stats.withColumn("est_", (F.col("count_") * F.col("mean_") + shrink * F.col("parent_")) / (F.col("count_") + shrink))
        rows = stats.select(F.lit(level).alias("level"), F.col(k).alias("key"), F.col("count_").alias("n"), F.col("mean_").alias("mean"), F.col("parent_").alias("parent"), F.col("est_").alias("est"), (F.col("count_") * F.abs(F.col("est_") - F.col("parent_"))).alias("gain"))
        out = rows if out is None else out.unionByName(rows)
        chains = cut(chains.join(stats.select(k, "est_"), k, "left").withColumn("parent", F.coalesce("est_", "parent")).drop("est_"))  # else each level would double the plan
    return out


def choose(fitted: DataFrame, budget: int) -> DataFrame:
    """The budget's worth of entries of most gain over all levels but the context level; ties by level and key."""
    return fitted.where("level <> 'context'").orderBy(F.desc("gain"), "level", "key").limit(budget)


def context_fallback(fitted: DataFrame, log: DataFrame) -> DataFrame:
    """context and fallback for every context; those without rows take the mean over all."""
    spark = fitted.sparkSession
    names = spark.sql("select explode(array(" + ", ".join(f"'{c}'" for c in R.CONTEXTS) + ")) as context")
    own = fitted.where("level = 'context'").select(F.substring_index("key", "|", -1).alias("context"), "est")
    mean = log.where("transfer_bytes is not null").agg(F.avg(F.greatest("transfer_bytes", F.lit(0))).alias("mean"))
    return one_row(names.join(own, "context", "left"), mean).select("context", F.coalesce("est", "mean").alias("fallback"))


def bodyless_mean(bodyless: DataFrame, fallback: float) -> DataFrame:
    """One row: the mean of bodyless requests, or the fallback without any."""
    return bodyless.where("transfer_bytes is not null").agg(F.coalesce(F.avg(F.greatest("transfer_bytes", F.lit(0))), F.lit(fallback)).alias("bodyless"))


def score(requests: DataFrame, chosen: DataFrame, fallback: DataFrame, bodyless: DataFrame) -> DataFrame:
    """requests plus match_level, est_bytes and cpu_ms: bodyless methods first, then the levels in turn, then the context."""
    out = features(requests)
    small = chosen.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS
    made = keys()
    for level in LEVELS[:-1]:
        own = chosen.where(F.col("level") == level).select(F.col("key").alias(f"k_{level}"), F.col("est").alias(f"e_{level}"))
        out = out.withColumn(f"k_{level}", made[level]).join(F.broadcast(own) if small else own, f"k_{level}", "left")
    out = one_row(out.join(F.broadcast(fallback), "context", "left"), bodyless)
    level, value = F.lit("context"), F.col("fallback")
    for name in reversed(LEVELS[:-1]):
        level = F.when(F.col(f"e_{name}").isNotNull(), name).otherwise(level)
        value = F.coalesce(F.col(f"e_{name}"), value)
    quiet = R.is_bodyless(F.col("http_method"))
    est = F.round(F.greatest(F.when(quiet, F.col("bodyless")).otherwise(value), F.lit(0.0))).cast("long")
    out = out.withColumns({"match_level": F.when(quiet, "bodyless").otherwise(level), "est_bytes": est})
    return out.withColumn("cpu_ms", cpu_ms(F.col("est_bytes"), F.col("context"))).select(*requests.columns, "context", "host", "match_level", "est_bytes", "cpu_ms")


def exp_link(score: Column) -> Column:
    """Whole bytes of a score on the scale of log(1 + bytes), never below 0; the small term keeps halves off the edge."""
    return F.greatest(F.round(F.exp(score) - 1 + 1e-6), F.lit(0.0)).cast("long")


def cpu_ms(size: Column, context: Column) -> Column:
    return CPU_MS_FIXED + F.greatest(size, F.lit(0)) / 1024.0 * R.mapped(context, CPU_MS_PER_KIB, 0.10)


def host_scale(scored: DataFrame, scales: DataFrame) -> DataFrame:
    """scored (with host) plus host_scale: the most specific suffix's value, down to two labels; 1 without any."""
    hosts = scored.select("host").distinct().select("host", F.posexplode(U.cascade_chain(F.col("host"))).alias("depth_", "key"))
    met = hosts.join(F.broadcast(scales) if scales.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS else scales, "key").groupBy("host").agg(F.min_by("scale", "depth_").alias("host_scale_"))
    return scored.join(met, "host", "left").withColumn("host_scale", F.coalesce("host_scale_", F.lit(1.0))).drop("host_scale_")


def followups(scored: DataFrame, root: Column) -> DataFrame:
    """scored (with host_scale) plus followup_bytes and followup_cpu_ms; root: UNKNOWN, FIRST or REPEAT."""
    base = F.when(~F.col("context").isin("script", "html"), 0).when(root == "REPEAT", 0).when(root == "FIRST", FOLLOWUP_PER_HOST).otherwise(FOLLOWUP_PER_REQUEST)
    size = F.round(base * R.mapped(F.col("match_level"), LEVEL_SCALE, 1.0) * F.col("host_scale")).cast("long")
    size = F.when((F.col("est_bytes") <= 0) | (F.col("match_level") == "bodyless"), 0).otherwise(size)
    return scored.withColumn("followup_bytes", size).withColumn("followup_cpu_ms", F.greatest("followup_bytes", F.lit(0)) / 1024.0 * FOLLOWUP_CPU_MS_PER_KIB)


def root_flags(blocked: DataFrame, page: list[str], order: str = "pos") -> DataFrame:
    """blocked plus root: FIRST for a page load's first cascading block of a host, REPEAT for later ones.

    A minimum by page and host decides, not a window, so a host of many requests needs no sort in one task.
    """
    cascading = F.col("context").isin("script", "html")
    first = blocked.where(cascading).groupBy(*page, "host").agg(F.min(order).alias("first_"))
    return blocked.join(first, [*page, "host"], "left").withColumn("root", F.when(~cascading | (F.col(order) <= F.col("first_")), "FIRST").otherwise("REPEAT")).drop("first_")


def measured_correction(priced: DataFrame) -> DataFrame:
    """n_cascading, cascade and correction: by how much follow-up transfer must be scaled to meet the flat price; 1 without any."""
    n, cascade = F.count_if(F.col("followup_bytes") > 0), F.coalesce(F.sum("followup_bytes"), F.lit(0)).cast("long")
    return priced.agg(n.alias("n_cascading"), cascade.alias("cascade")).withColumn("correction", F.coalesce(F.try_divide(F.lit(float(FOLLOWUP_PER_REQUEST)) * F.col("n_cascading"), F.col("cascade")), F.lit(1.0)))
