"""Selections and audit documents on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.operators import audit as au
from linkloom.operators import overview as ov
from linkloom.operators import selection as se
from linkloom.operators import verticals as ve


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [
        (i, f"/Sec{i % 3}/p{i}", i % 4, ["ck", "cl"][i % 2], "cat", "_mode_", i / 100, i / 50, i % 6, i % 5, i % 7 == 0, i % 5 == 0)
        for i in range(1, 31)
    ]
    return spark.createDataFrame(
        rows,
        "page_id int, path string, depth int, template string, category string, verticale string, pri_score double, cheirank_score double, "
        "in_degree int, out_degree int, can_give_juice boolean, is_low_power boolean",
    )


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, i % 30 + 1, ["nav", "foot"][i % 2], 1.0) for i in range(1, 31)]
    return spark.createDataFrame(rows, "source_id int, target_id int, block_type string, rule_weight float")


def ids(df):
    return sorted(r.page_id for r in df.collect())


def test_filters(metrics, edges):
    assert ids(se.filter_urls(metrics, edges, se.UrlFilter())) == list(range(1, 31))
    assert ids(se.filter_urls(metrics, edges, se.UrlFilter(block_types=[]))) == []
    assert ids(se.filter_urls(metrics, edges, se.UrlFilter(templates=[]))) == list(range(1, 31))
    assert ids(se.filter_urls(metrics, edges, se.UrlFilter(block_types=["foot"]))) == list(range(1, 31, 2))
    literal = se.filter_urls(metrics, edges, se.UrlFilter(url_search="SEC1/"))
    assert ids(literal) == list(range(1, 31, 3))
    assert ids(se.filter_urls(metrics, edges, se.UrlFilter(url_search="s.c1"))) == []
    assert ids(se.filter_urls(metrics, edges, se.UrlFilter(depth_min=1, depth_max=1))) == list(range(1, 31, 4))


def test_samples(metrics):
    sample = ov.systematic_sample(metrics, [F.col("page_id")], 7)
    assert ids(sample) == [1, 6, 11, 16, 21, 26]
    assert ids(ov.systematic_sample(metrics, [F.col("page_id")], 100)) == list(range(1, 31))
    first, again = ov.random_sample_cap(metrics, "page_id", 5), ov.random_sample_cap(metrics.repartition(5), "page_id", 5)
    assert ids(first) == ids(again) and len(ids(first)) == 5


def test_health_is_bounded(metrics):
    health = ov.link_health(metrics).first()
    assert health.pages == 30 and health.orphans == 15 and health.health_score == 0


def test_category_table_uses_the_most_common_template(metrics, spark):
    real = spark.createDataFrame(
        [("/a", "cat", 3, 1.0, "Mode", 2.0), ("/b", "cat", None, 2.0, "Mode", 4.0)],
        "path string, category string, real_clicks long, botify_pr double, botify_verticale string, real_inlinks double",
    )
    row = ve.category_table(metrics.where("page_id < 10"), real).first()
    assert (row.template_dom, row.pages, row.real_pages, row.clicks, row.clicks_avg) == ("cl", 9, 2, 3, 3.0)


def test_audit(spark):
    document = {
        "linking_rules_per_template": {
            "/ad/": {"file_count": 3, "sections": {"nav": {"avg_total_links": 2.0, "avg_links_by_destination": {"/c/": 1.5, "home": 0.5}},
                                                   "foot": {"avg_total_links": 4.0, "avg_links_by_destination": {}}}},
        },
        "linking_matrix_section_x_destination": {"nav": {"/c/": 93.0}, "foot": {"home": 1.0}},
        "anomalies": [{"severity": "HIGH", "template": "t", "type": "x", "detail": "d"}, {"severity": "LOW", "template": "t", "type": "x", "detail": "d"}],
        "json_ld_diff": {"/ad/": {"has_schema": True, "schemas_found": {"Vehicle": 2}}, "/c/": {"has_schema": False, "schemas_found": {}}},
    }
    audits = au.parse_audit(spark.createDataFrame([("a", json.dumps(document))], "audit_id string, audit string"))
    matrix = {r.section: (r["/c/"], r["home"]) for r in au.section_destination_matrix(audits, ["/c/", "home"]).collect()}
    assert matrix == {"nav": (93.0, 0.0), "foot": (0.0, 1.0)}
    profile = {(r.section, r.destination): r.avg_links for r in au.template_section_profile(audits).collect()}
    assert profile == {("nav", "/c/"): 1.5, ("nav", "home"): 0.5, ("foot", "(total)"): 4.0}
    assert au.ad_outlinks_total(audits, "/ad/").first().total_outlinks == 6.0
    assert [tuple(r) for r in au.anomaly_table(audits, ["HIGH"]).collect()] == [("HIGH", "t", 1)]
    checks = {r.template: (r.has_schema, r.Product, r.Article, r.schemas_found) for r in au.schema_checklist(audits).collect()}
    assert checks == {"/ad/": (True, True, False, "Vehicle"), "/c/": (False, False, False, "Aucun")}
