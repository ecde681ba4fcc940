"""URL expressions on literal cases, and the classifier against a row-by-row model of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from tallybrook.functions import urls as U
from tallybrook.operators import classify as C
from tallybrook.operators import decide as D
from tallybrook.operators import size_table as T
from tallybrook.plans import QUERIES
from tallybrook.sources import fixtures as S

from .conftest import SF

HOSTS = [
    ("https://A.example/x", "A.example"), ("//b.example:80/", "b.example"), ("c.example", "c.example"), ("http://u:p@d.example:443?q", "d.example"),
    ("http://[::1]:80/x", "::1"), ("https://e.example...", "e.example"), ("", None), ("  https://f.example/  ", "f.example"), ("https:///path", None), (None, None),
]


def values(spark, rows, name, f):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, u string")
    return [r[0] for r in df.select("k", f(F.col("u")).alias(name)).orderBy("k").select(name).collect()]


def test_hosts(spark):
    assert values(spark, [u for u, _ in HOSTS], "h", U.url_host) == [h for _, h in HOSTS]


def test_paths(spark):
    rows = ["https://h/a/b?c", "https://h", "https://h#f/g", "https://h?x=/y", "//h/p#q"]
    assert values(spark, rows, "p", U.rule_path) == ["/a/b", "", "", "", "/p"]
    assert values(spark, rows, "p", U.url_path) == ["/a/b", None, "/g", "/y", None]  # an authority may run through a query or fragment here


def test_extension_and_params(spark):
    assert values(spark, ["https://cdn.example.com?a=1", "https://h/x.JS?y", "https://h/"], "e", U.file_extension) == ["com", "js", None]
    assert values(spark, ["https://h/", "https://h/?a&b=2&c", "https://h/?"], "n", U.num_query_params) == [1, 3, 1]


def test_templates(spark):
    rows = ["/75bf3488a101739acfe9/x", "/a-en_US-m202608060101-fy2021-12345", "/v1/abc", "/deadbeef/1234567"]
    assert values(spark, rows, "t", U.path_template) == ["/#/x", "/a-en_US-#-fy2021-#", "/v1/abc", "/deadbeef/#"]


def test_filler_query(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (5, 1), (5, 3), (2, 9)], "n int, p int").select("n", "p", U.filler_query(F.col("n"), F.col("p")).alias("q"))
    assert [r["q"] for r in df.collect()] == ["", "?", "?qqqq", "?q&q&", "?&"]


def model(url, rules, wanted=None):
    """The best entry of a URL, row by row: host levels from the whole host on, path rules first."""
    if url is None:
        return None
    rest = url.split("://", 1)[-1].split("?")[0].lower()
    host, slash, path = rest.partition("/")
    host, path = host.split(":")[0], slash + path
    merged = {}
    for e, pattern, category, *_ in rules:
        merged.setdefault(pattern, [e, set()])[1].add(category)
    labels = host.split(".")
    for i in range(len(labels)):
        level = ".".join(labels[i:])
        hits = []
        for pattern, (e, categories) in merged.items():
            h, s, p = pattern.partition("/")
            if h != level or (s and not path.startswith(s + p)):
                continue
            if (categories == {"Content"}) if wanted is None else not categories & set(wanted):
                continue
            hits.append((not s, e))
        if hits:
            return min(hits)[1]
    return None


@pytest.mark.parametrize("wanted", [None, ["Content"], ["Social"], ["Analytics", "Advertising"]])
def test_classifier_model(spark, wanted):
    rules = [tuple(r) for r in S.rules(spark).orderBy("entry_id").collect()]
    rng = random.Random(5)
    hosts = ["adnet.example", "tag.adnet.example", "metrics.example", "social.example", "widget.social.example", "x.widget.social.example", "img.cdnhub.example", "cdnhub.example", "guard.example", "fp.guard.example", "a.fp.guard.example", "none.example", "example"]
    urls = sorted({f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/v1/collect', '/V1/Collect/x', '/v1', '/tag/js'])}{rng.choice(['', '?q=/v1/collect'])}" for _ in range(300)})
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string")
    found = {r["url"]: r["match"]["entry_id"] if r["match"] else None for r in C.with_match(df, S.rules(spark), categories=wanted).collect()}
    assert found == {u: model(u, rules, wanted) for u in [*urls, None]}


def test_unknown_category(spark):
    with pytest.raises(ValueError, match="unknown category"):
        C.wanted_categories(S.rules(spark), "Social, Nothing")
    with pytest.raises(ValueError, match="does not name"):
        C.wanted_categories(S.rules(spark), " , ")


def test_versions(spark):
    rows = [(None, True), ("", True), ('env.version|versionCompare("140.0a1") >= 0', True), ('env.version|versionCompare("142.0") < 0', False), ('env.version|versionCompare("142.0b3") > 0', True), ('env.version|versionCompare("141") >= 0 && env.version|versionCompare("142") <= 0', True)]
    df = spark.createDataFrame([(k, e) for k, (e, _) in enumerate(rows)], "k int, e string")
    assert [r[0] for r in df.select("k", D.applies(F.col("e"), "142.0").alias("a")).orderBy("k").select("a").collect()] == [x for _, x in rows]


def test_urls_of_equal_features(spark):
    """Features and verdicts don't change if letters of the query are replaced, and those of many requests are taken once."""
    urls = ["https://a.example/x.js?id=12&v=3", "https://a.example/x.js?ip=21&v=4", "https://a.example/x.js?id=123&v=3", "http://u@B.example:8/p/m202401123/?", "http://c.example?q", "http://c.example", "//d.example/y?a?b/c",
            "http://e.example/z ?a=1", " http://e.example/z?a=1 ", "http://f.example/s?a=1#b", "http://f.example/s#b?a=1", "http://g.example/t?a\nb", "http://g.example/t ?a b", "http://h.example/é?é\U0001f600", "x?y", "?", "", None]
    df = spark.createDataFrame([(i, u, "script", "GET", 100 * i) for i, u in enumerate(urls)], "i int, url string, resource_type string, http_method string, transfer_bytes long")
    derived = lambda d: [tuple(r) for r in T.features(d.withColumns({"of_": U.net_host(F.col("url")), "under_": U.rule_path(F.col("url"))})).drop("url").orderBy("i").collect()]
    assert derived(df) == derived(df.withColumn("url", U.plain_query(F.col("url"))))
    kinds = {r["url"]: (r["rows_"], r["sum_"]) for r in T.alike(df.where("i < 3")).collect()}
    assert sorted(kinds.values()) == [(1, 200.0), (2, 100.0)]


def test_questions_read_the_log_once(spark):
    plan = QUERIES["estimate_questions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 3  # the log itself, the mean of bodyless requests and that of all


def test_words_of_a_pattern_are_looked_for_as_text(spark):
    """F3 to F8: the flags of exact case are those of the patterns, found without regular expressions where they are plain words."""
    urls = ["https://a.example/js/x.js?tag=1", "https://a.example/ajs", "https://A.example/V1/x", "https://a.example/v1/x", "https://a.example/v/x", "x/vv7/1x1.gif", "pixel", "https://a.example/ads/\npagead", "", None, "/api/", "a.JS", "cookie|sync", ".png", "xpng"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    flags = U.content_flags(F.col("url"), False)
    got = df.select(*(c.alias(k) for k, c in flags.items())).collect()
    want = df.select(*(F.col("url").rlike(p).alias(k) for k, p in U.CONTENT_PATTERNS.items())).collect()
    assert got == want and any(r["path_has_api"] for r in got)
    assert [k for k, c in flags.items() if "RLIKE" in c._jc.toString().upper()] == ["path_has_api"]
