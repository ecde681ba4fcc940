"""URL filtering against a dated list.

Entries of a list are dated additions and removals of host patterns.  Per pattern they become validity intervals
[from, until); a capture is evaluated against the entries that were active at its fetch time: an as-of join on the
pattern, for the capture's host and each of its parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.components import SALTS


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_until (null: open) from dated entries (pattern, action, category, entry_date).

    An 'add' holds until the pattern's next entry, whatever that is; a 'remove' ends it.  Of several entries of a pattern
    on a day the removal wins, then the smallest category.  Null patterns or dates are ignored; case doesn't matter.
    """
    fine = entries.where("pattern is not null and entry_date is not null").select(F.lower("pattern").alias("pattern"), "action", "category", "entry_date")
    one = fine.groupBy("pattern", "entry_date").agg(F.min_by(F.struct("action", "category"), F.struct((F.col("action") != "remove").alias("a"), F.col("category").alias("b"))).alias("e"))
    chain = one.withColumn("valid_until", F.lead("entry_date").over(Window.partitionBy("pattern").orderBy("entry_date")))
    return chain.where(F.col("e.action") == "add").select("pattern", F.col("e.category").alias("category"), F.col("entry_date").alias("valid_from"), "valid_until")


def host_of(url: F.Column) -> F.Column:
    """Lower-case host, without user, port and trailing dots; null if there is none."""
    authority = F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[^/?#]*?://|//)?([^/?#]*)", 1), r"^.*@", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.+$", ""), F.lit(""))


def evaluate(captures: DataFrame, active: DataFrame) -> DataFrame:
    """capture_id, host, fetch_date, blocked, pattern, category, n_active of every capture (capture_id, url, fetch_date).

    Captures are evaluated once for each host and day, and a day's captures of a host are dealt out by a hash of their ids
    before they meet its result, so a host of a third of all captures is no task of its own;
    the most specific active pattern decides, n_active counts all of them.  Null or host-less URLs and null dates are
    never blocked; repeated captures stay repeated; other columns are not read.
    """
    rows = captures.select("capture_id", host_of(F.col("url")).alias("host"), "fetch_date").withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int"))
    asked = rows.where("host is not null and fetch_date is not null").groupBy("host", "fetch_date").agg(F.expr("bit_or(shiftleft(1L, salt))").alias("salts"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    keys = asked.select("host", "fetch_date", "salts", F.explode(suffixes).alias("pattern"))
    met = keys.join(active, "pattern").where((F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_until").isNull() | (F.col("fetch_date") < F.col("valid_until"))))
    found = met.groupBy("host", "fetch_date").agg(F.max_by(F.struct("pattern", "category"), F.length("pattern")).alias("best"), F.count(F.lit(1)).alias("n_active"), F.first("salts").alias("salts"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)  # the parts that have rows
    out = rows.join(found.withColumn("salt", F.explode(held)).drop("salts"), ["host", "fetch_date", "salt"], "left")
    return out.select("capture_id", "host", "fetch_date", F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.category").alias("category"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the pages table; the fetch date follows from the page_id, as the table has none."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetch_date"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list from the hosts of the pages: a third of all hosts and parents are added on a day, half of these are
    removed later, and a quarter of those come back."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    both = host.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""))).alias("pattern")).where("instr(pattern, '.') > 0").distinct()
    h = both.select("pattern", F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long").alias("h")).where("h % 3 = 0")
    day = lambda n: F.expr(f"date_add(date'2024-01-01', cast({n} as int))")
    category = F.when(F.col("h") % 5 < 2, "spam").when(F.col("h") % 5 < 4, "adult").otherwise("malware")
    first = h.select("pattern", F.lit("add").alias("action"), category.alias("category"), day("h % 150").alias("entry_date"))
    gone = h.where("h % 2 = 0").select("pattern", F.lit("remove"), category, day("h % 150 + 40 + h % 60"))
    back = h.where("h % 8 = 0").select("pattern", F.lit("add"), F.lit("returned"), day("h % 150 + 150 + h % 50"))
    return first.union(gone).union(back)


ORACLE = r"""
WITH caps AS (
  SELECT page_id AS capture_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^(?:[^/?#]*?://|//)?([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '') AS host,
    CAST(DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS DATE) AS fetch_date FROM pages),
hosts AS (SELECT DISTINCT host FROM caps WHERE host IS NOT NULL),
both_ AS (SELECT DISTINCT p AS pattern FROM (SELECT host AS p FROM hosts UNION ALL SELECT regexp_replace(host, '^[^.]*\.', '') FROM hosts) WHERE instr(p, '.') > 0),
h AS (SELECT pattern, CAST(('0x' || substr(md5(pattern), 1, 8)) AS BIGINT) AS h FROM both_),
l AS (SELECT pattern, h, CASE WHEN h % 5 < 2 THEN 'spam' WHEN h % 5 < 4 THEN 'adult' ELSE 'malware' END AS category FROM h WHERE h % 3 = 0),
entries AS (
  SELECT pattern, 'add' AS action, category, DATE '2024-01-01' + CAST(h % 150 AS INTEGER) AS d FROM l
  UNION ALL SELECT pattern, 'remove', category, DATE '2024-01-01' + CAST(h % 150 + 40 + h % 60 AS INTEGER) FROM l WHERE h % 2 = 0
  UNION ALL SELECT pattern, 'add', 'returned', DATE '2024-01-01' + CAST(h % 150 + 150 + h % 50 AS INTEGER) FROM l WHERE h % 8 = 0),
one AS (SELECT pattern, d, action, category FROM (SELECT *, row_number() OVER (PARTITION BY pattern, d ORDER BY action <> 'remove', category) AS rn FROM entries) WHERE rn = 1),
iv AS (SELECT * FROM (SELECT pattern, action, category, d AS valid_from, lead(d) OVER (PARTITION BY pattern ORDER BY d) AS valid_until FROM one) WHERE action = 'add'),
met AS (
  SELECT c.capture_id, iv.pattern, iv.category FROM caps c JOIN iv ON (c.host = iv.pattern OR ends_with(c.host, '.' || iv.pattern))
    AND c.fetch_date >= iv.valid_from AND (iv.valid_until IS NULL OR c.fetch_date < iv.valid_until)),
best AS (SELECT capture_id, arg_max(pattern, length(pattern)) AS pattern, arg_max(category, length(pattern)) AS category, count(*) AS n_active FROM met GROUP BY capture_id)
SELECT c.capture_id, c.host, c.fetch_date, best.pattern IS NOT NULL AS blocked, best.pattern, best.category, coalesce(best.n_active, 0) AS n_active
FROM caps c LEFT JOIN best ON c.capture_id = best.capture_id
"""
