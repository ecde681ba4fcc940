"""Readers on small literal files."""

import gzip
import json

import pytest

from tallybrook.sources import readers as X


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return f"file://{path}"


def test_har_and_blocked(spark, tmp_path):
    har = {"log": {"entries": [{"request": {"url": "https://a/"}, "response": {"_transferSize": 5, "redirectURL": "https://b/"}}, {"request": {"url": "https://b/"}, "response": {"_transferSize": None}}]}}
    put(tmp_path / "har_0007_x.json", har)
    rows = X.har(spark, f"file://{tmp_path}/har_*.json").orderBy("pos").collect()
    assert [(r["page_idx"], r["pos"], r["url"], r["transfer_size"], r["redirect_url"]) for r in rows] == [(7, 0, "https://a/", 5, "https://b/"), (7, 1, "https://b/", None, None)]
    put(tmp_path / "blocked_0007_x.json", {"blocked": [{"url": "https://t/", "resource_type": "script", "failure": "NS_ERROR_TRACKING_URI"}]})
    assert X.blocked_log(spark, f"file://{tmp_path}/blocked_*.json").collect()[0]["failure"] == "NS_ERROR_TRACKING_URI"
    put(tmp_path / "types_0007_x.json", [{"url": "u", "resource_type": "image"}, {"url": "u", "resource_type": "script"}])
    assert [tuple(r) for r in X.type_log(spark, f"file://{tmp_path}/types_*.json").collect()] == [(7, "u", "image")]


def test_page_records_skip_corrupt(spark, tmp_path):
    put(tmp_path / "page_1.json", {"idx": 1, "url": "u", "outcome": "ok"})
    put(tmp_path / "page_2.json", "{broken")
    assert [r["idx"] for r in X.page_records(spark, f"file://{tmp_path}/page_*.json").collect()] == [1]


def test_services_list(spark, tmp_path):
    path = put(tmp_path / "services.json", {"categories": {"Advertising": [{"AdNet": {"https://adnet.example/": ["adnet.example", "x.example/p"], "dnt": "yes"}}], "Social": [{"S": {"https://s.example/": ["s.example"]}}, {"S": {"https://s.example/": ["s.example"]}}]}})
    rows = X.services_list(spark, path).orderBy("entry_id").collect()
    assert [(r["entry_id"], r["pattern"], r["category"], r["organization"]) for r in rows] == [(1, "adnet.example", "Advertising", "AdNet"), (2, "x.example/p", "Advertising", "AdNet"), (3, "s.example", "Social", "S")]


def test_decision_lists(spark, tmp_path):
    entities = X.entity_list(spark, put(tmp_path / "e.json", {"entities": {"A": {"properties": ["a.example"], "resources": ["a.example", "b.example"]}}}))
    assert {tuple(r) for r in entities.collect()} == {("A", "a.example", "a.example"), ("A", "b.example", "a.example")}
    exceptions = X.exception_list(spark, put(tmp_path / "x.json", {"data": [{"classifierFeatures": ["tracking-protection"], "urlPattern": "*://*.a/*", "category": "baseline"}, {"classifierFeatures": ["other"], "urlPattern": "y"}]}))
    assert [r["url_pattern"] for r in exceptions.collect()] == ["*://*.a/*"]
    skips = X.skip_list(spark, put(tmp_path / "s.json", {"data": [{"feature": "tracking-protection", "pattern": "a.example,b.example"}]}))
    assert [r["pattern"] for r in skips.collect()] == ["a.example", "b.example"]


def test_csv(spark, tmp_path):
    lines = "tracker_domain,url_path,path_depth,file_extension,has_query_params,url_length,num_query_params,resource_type,initiator_type,http_method,page_domain,transfer_bytes\na.example,/x,1,,false,20,1,script,parser,GET,p,-5\nb.example,/x,1,,false,20,1,script,parser,GET,p,\n"
    with gzip.open(tmp_path / "log.csv.gz", "wt") as f:
        f.write(lines)
    assert [(r["tracker_domain"], r["transfer_bytes"]) for r in X.csv_log(spark, f"file://{tmp_path}/log.csv.gz").collect()] == [("a.example", 0)]
    assert [tuple(r) for r in X.ranked_domains(spark, put(tmp_path / "r.csv", "1,A.example\nb.example\n")).collect()] == [(1, "a.example"), (None, "b.example")]
    with pytest.raises(ValueError, match="unknown categories"):
        X.domain_labels(spark, put(tmp_path / "l.csv", "domain,category\na,news\nb,odd\n"), ("news",))
    X.write_csv(spark.range(2), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2
    X.write_summary(f"file://{tmp_path}/sum", a=spark.range(1), b=spark.sql("select 2 as x"))
    assert spark.read.json(f"file://{tmp_path}/sum").collect()[0]["b"]["x"] == 2
