"""Trees, rule and block links, ranking and expansion against small brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bench_graphs import ring_edges, ring_pages
from linkloom.operators import block_edges as be
from linkloom.operators import expansion as ex
from linkloom.operators import rule_edges as ru
from linkloom.operators.rank_iteration import RankOptions, rank_graphs
from linkloom.operators.scoring import compute_pri, edge_id_validation, unknown_page_ids
from linkloom.operators.url_tree import merge_trees, tree_flatten, tree_pages, tree_summary
from linkloom.plans import runs
from linkloom.sources.crawl import tree_json_lines_scan, tree_json_scan
from linkloom.sources.workspace import Workspace

TREE = {
    "catalog/": {
        "brand-a": {"modeles/": {"model-1": "# one", "model-2/": "# two"}, "_meta": "# data"},
        "brand-b/": "# landing",
    },
    "services/": {"financement/": "# financing"},
}
PAGES = "page_id int, path string, parent_path string, cluster_thematique string"


@pytest.fixture(scope="module")
def tree_site(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    (folder / "tree.json").write_text(json.dumps(TREE, indent=1))
    workspace = Workspace(spark, str(folder / "workspace"))
    options = runs.RunOptions(rules=ru.RuleOptions(cluster_peer_k=2, max_out_links_per_page=6))
    runs.analyse_tree(tree_json_scan(spark, str(folder / "tree.json")), workspace, options)
    return workspace


def test_tree_pages(tree_site):
    rows = [tuple(r) for r in tree_site.read("pages").orderBy("page_id").collect()]
    assert rows == [
        (1, "catalog/", None, 1, "catalog", "catalog:__root__", False),
        (2, "catalog/brand-a/", "catalog/", 2, "catalog", "catalog:brand-a", False),
        (3, "catalog/brand-a/_meta", "catalog/brand-a/", 3, "catalog", "catalog:brand-a", True),
        (4, "catalog/brand-a/modeles/", "catalog/brand-a/", 3, "catalog", "catalog:brand-a", False),
        (5, "catalog/brand-a/modeles/model-1/", "catalog/brand-a/modeles/", 4, "catalog", "catalog:brand-a", True),
        (6, "catalog/brand-a/modeles/model-2/", "catalog/brand-a/modeles/", 4, "catalog", "catalog:brand-a", True),
        (7, "catalog/brand-b/", "catalog/", 2, "catalog", "catalog:brand-b", True),
        (8, "services/", None, 1, "services", "services:__root__", False),
        (9, "services/financement/", "services/", 2, "services", "services:financement", True),
    ]
    summary = {(r.metric, r["name"]): r["count"] for r in tree_summary(tree_site.read("pages")).collect()}
    assert summary[("pages", "")] == 9 and summary[("leaves", "")] == 5 and summary[("section", "catalog")] == 7


def test_rule_edges(tree_site):
    found = {(r.source_id, r.target_id, r.block_type, round(r.rule_weight, 4)) for r in tree_site.read("edges").collect()}
    up, down, peer = "hierarchy_up", "hierarchy_down", "cluster_peer"
    assert found == {
        (1, 2, down, 0.7), (1, 7, down, 0.7), (2, 1, up, 1.0), (2, 3, down, 1.1), (2, 4, down, 1.1), (3, 2, up, 1.0),
        (3, 4, peer, 0.4), (3, 5, peer, 0.4), (4, 2, up, 1.0), (4, 5, down, 1.1), (4, 6, down, 1.1), (5, 4, up, 1.0),
        (5, 6, peer, 0.4), (6, 4, up, 1.0), (7, 1, up, 1.0), (8, 9, down, 0.7), (9, 8, up, 1.0),
    }


def test_tree_scores(tree_site):
    scores = tree_site.read("pri_scores").orderBy("page_id").collect()
    assert [round(r.pri_score, 6) for r in scores] == [0.109415, 0.147032, 0.059628, 0.209719, 0.089207, 0.099609, 0.063168, 0.111111, 0.111111]
    assert [round(r.cheirank_score, 6) for r in scores] == [0.118361, 0.203157, 0.111030, 0.156513, 0.067070, 0.054677, 0.066970, 0.111111, 0.111111]


def test_partial_trees_merge(spark, tmp_path):
    docs = [{"a/": {"b": {"c": "x"}}}, {"a/": {"b": {"d": {}}}}, {"a/": {"b": "leaf here"}}]
    (tmp_path / "trees.jsonl").write_text("\n".join(json.dumps(d) for d in docs))
    nodes = tree_flatten(tree_json_lines_scan(spark, str(tmp_path / "trees.jsonl")))
    assert nodes.count() == 8
    pages = {r.path: r.is_leaf for r in tree_pages(merge_trees(nodes)).collect()}
    assert pages == {"a/": False, "a/b/": False, "a/b/c/": True, "a/b/d/": True}


def test_rule_cap_and_dedup(spark):
    pages = spark.createDataFrame(
        [(1, "catalog/", None, "c"), (2, "catalog/a/", "catalog/", "c"), (3, "catalog/b/", "catalog/", "c")], PAGES
    )
    merged = ru.build_rule_edges(pages, ru.RuleOptions(enable_hierarchy_up=False, cluster_peer_k=1)).collect()
    first = [r for r in merged if (r.source_id, r.target_id) == (1, 2)]
    assert len(first) == 1 and first[0].block_type == "hierarchy_down" and abs(first[0].rule_weight - 1.1) < 1e-6
    capped = ru.build_rule_edges(pages, ru.RuleOptions(enable_hierarchy_down=False, cluster_peer_k=1, max_out_links_per_page=1))
    second = capped.where("source_id = 2").collect()
    assert [(r.target_id, r.block_type, r.rule_weight) for r in second] == [(1, "hierarchy_up", 1.0)]
    none = ru.RuleOptions(enable_hierarchy_up=False, enable_hierarchy_down=False, enable_cluster_peer=False)
    assert ru.build_rule_edges(pages, none).count() == 0


@pytest.mark.parametrize("stretch", [3, 5, 1000])
def test_cluster_peer_over_stretches(spark, stretch):
    # One cluster holds most pages, so it spans several stretches.
    clusters = {i: ("big" if i % 5 else f"small-{i % 3}") for i in range(1, 61)}
    pages = spark.createDataFrame(list(clusters.items()), "page_id int, cluster_thematique string")
    got = {(r.source_id, r.target_id) for r in ru.cluster_peer(pages, k=3, stretch=stretch).collect()}
    want = set()
    for name in set(clusters.values()):
        ids = sorted(i for i, c in clusters.items() if c == name)
        want |= {(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, min(a + 4, len(ids)))}
    assert got == want


def exact_rank(n, links, d=0.85):
    m = np.zeros((n, n))
    for s, t, w in links:
        m[s - 1, t - 1] += w
    out = m.sum(axis=1, keepdims=True)
    p = np.where(out > 0, m / np.where(out == 0, 1, out), 1.0 / n)
    return np.linalg.solve(np.eye(n) - d * p.T, np.full(n, (1 - d) / n))


@pytest.mark.parametrize("per_partition", [100_000, 50, 7])
def test_rank_against_linear_algebra(spark, per_partition):
    rng = np.random.default_rng(3)
    n = 60
    # Page 1 links to all pages and page 2 gets links from most; a third of the pages have no out-links.
    links = [(1, t, 1.0) for t in range(2, n + 1)] + [(int(s), 2, 0.5) for s in range(3, 40)]
    links += [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(1, 40, 150), rng.integers(1, n + 1, 150), rng.random(150))]
    # The second weighting lacks a part of the links and weighs some sources with nothing.
    other = [(s, t, None if s == 5 else 0.0 if s == 6 else w * (s % 3 + 1)) for s, t, w in links]
    rows = [(s, t, w, v) for (s, t, w), (_, _, v) in zip(links, other)]
    nodes = spark.range(1, n + 1).select(F.col("id").cast("int").alias("page_id"))
    table = spark.createDataFrame(rows, "source int, target int, w0 double, w1 double")
    options = RankOptions(links_per_partition=per_partition, tolerance=1e-12)
    got = rank_graphs(nodes, table, ["a", "b"], options).orderBy("page_id").collect()
    for name, edges in (("a", links), ("b", [(s, t, w or 0.0) for s, t, w in other])):
        for kind, turned in (("forward", edges), ("reverse", [(t, s, w) for s, t, w in edges])):
            scores = np.array([r[f"{kind}_{name}"] for r in got])
            assert abs(scores.sum() - 1) < 1e-6
            assert np.abs(scores - exact_rank(n, turned)).max() < 1e-8


def test_rank_rounds_and_failure(spark):
    links = spark.createDataFrame([(i, (i * i + j) % (47 - i % 9), 1.0 + j) for i in range(50) for j in range(i % 4)], "source int, target int, w0 double")
    nodes = spark.range(50).withColumnRenamed("id", "page_id")
    many = rank_graphs(nodes, links, ["a"], RankOptions(tolerance=1e-13, steps_per_check=2)).orderBy("page_id").collect()
    few = rank_graphs(nodes, links, ["a"], RankOptions(tolerance=1e-13, steps_per_check=12)).orderBy("page_id").collect()
    assert many == few
    with pytest.raises(RuntimeError, match="still change"):
        rank_graphs(nodes, links, ["a"], RankOptions(tolerance=1e-30, max_iterations=4, steps_per_check=2))
    assert rank_graphs(nodes, links, ["a"], RankOptions(tolerance=0, max_iterations=4)).count() == 50


def test_rank_without_links(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page_id int")
    links = spark.createDataFrame([], "source int, target int, w0 double")
    assert {tuple(r)[1:] for r in rank_graphs(nodes, links, ["g"]).collect()} == {(0.25, 0.25)}
    assert rank_graphs(nodes.limit(0), links, ["g"]).count() == 0


def test_edges_outside_the_page_table(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    rows = [(1, 2, "a", 1.0), (1, 9, "a", 1.0), (9, 1, "b", 1.0), (8, 9, "a", 2.0), (8, 9, "a", 2.0), (1, 9, "a", 1.0)]
    edges = spark.createDataFrame(rows, "source_id long, target_id long, block_type string, rule_weight double")
    assert sorted(tuple(r) for r in edge_id_validation(edges, pages).collect()) == sorted(rows[1:])
    assert {r.page_id for r in unknown_page_ids(edges, pages).collect()} == {8, 9}
    assert edge_id_validation(edges.limit(1), pages).isEmpty()


def test_ring(spark):
    pages, edges = ring_pages(spark, 500, 50), ring_edges(spark, 500, 3000)
    assert edges.count() == 3000
    assert {(r.s, r.t) for r in edges.where("source_id <= 2").selectExpr("source_id s", "target_id t").collect()} == {
        (s, (s + 17 * k - 1) % 500 + 1) for s in (1, 2) for k in range(1, 7)
    }
    scores = compute_pri(pages, edges).orderBy("page_id").collect()
    assert [r.rank for r in scores] == list(range(1, 501))
    assert all(abs(r.pri_score - 1 / 500) < 1e-12 for r in scores)
    looped = ring_edges(spark, 17, 40)  # every step leads back to its source
    assert looped.count() == 0
    assert ring_edges(spark, 34, 100).count() == 34 * 2 and ring_edges(spark, 0, 5).count() == 0


@pytest.fixture(scope="module")
def template_pages(spark):
    categories = spark.createDataFrame([("cars", "_v_"), ("bikes", None)], "category string, verticale string")
    facets = spark.createDataFrame(
        [("cars", "brand", 1, f"b{i}", i) for i in range(1, 7)] + [("cars", "fuel", 2, f"f{i}", i) for i in range(1, 5)]
        + [("bikes", "kind", 1, "road", 1)],
        "category string, facet string, facet_no int, value string, value_no int",
    )
    places = spark.createDataFrame(
        [("region", f"r{i}", i, "c") for i in range(1, 4)] + [("department", "01", 1, "c")] + [("town", f"t{i}", i, f"c{i}") for i in range(1, 6)],
        "kind string, place string, place_no int, code string",
    )
    keywords = spark.createDataFrame(
        [(c, f"{c} {n}", "kind", "road") for c in ("cars", "bikes") for n in range(3)] + [("cars", "cars 1", "fuel", "f1")],
        "category string, keyword string, facet string, value string",
    )
    static = spark.createDataFrame([("/", None, "homepage", "root"), ("/dc/legal", "/", "dc", "dc")], "path string, parent_path string, template string, cluster_thematique string")
    options = ex.ExpansionOptions(combo_values=5, combo_other_values=3, towns_per_category=2, geo_facet_values=5)
    drafts = (
        ex.expand_category_pages(categories, static)
        .unionByName(ex.expand_facet_pages(facets, options))
        .unionByName(ex.expand_geo_pages(categories, places, facets, options))
        .unionByName(ex.expand_keyword_pages(keywords))
        .unionByName(ex.expand_hybrid_pages(keywords, places, options))
    )
    return ex.expand_finalize(drafts)


def test_expansion_counts(template_pages):
    counts = {r.template: r["count"] for r in ex.template_counts(template_pages).collect()}
    assert counts["c_L0"] == 2 and counts["c_L1"] == 2 and counts["c_L2"] == 11
    assert counts["c_L3"] == 5 * 3 + 4 * 3  # five brands with three fuels, four fuels with three brands
    assert counts["cl"] == 2 * (3 + 1 + 2) + 3 * (5 + 4 + 1) and counts["ck"] == 6 and counts["ckl"] == 3 * 7
    ids = sorted(r.page_id for r in template_pages.collect())
    assert ids == list(range(1, len(ids) + 1))


def test_expansion_budget(template_pages):
    drafts = template_pages.select(*ex.DRAFT)
    kept = {r.template: r["count"] for r in ex.template_counts(ex.expand_finalize(drafts, {"cl": 4, "ck": 2})).collect()}
    assert kept["cl"] == 4 and kept["ck"] == 2 and kept["c_L3"] == 27


def test_block_edges(template_pages):
    pages = template_pages.collect()
    cat = {p.page_id: p.cluster_thematique.split(":")[-1] for p in pages}
    block = be.Block(0.8, 2, ["/c/", "homepage"])
    got = {(r.source_id, r.target_id) for r in be.block_top_searches(template_pages, block).collect()}
    want = set()
    for p in pages:
        if p.template in ("c_L0", "c_L1", "c_L2", "c_L3", "homepage"):
            targets = sorted(q.page_id for q in pages if q.template == "ck" and cat[q.page_id] == cat[p.page_id])[:2]
            want |= {(p.page_id, t) for t in targets}
    assert got == want and want
    footer = be.block_footer(template_pages, be.Block(0.15, 3, ["all"])).collect()
    first = sorted(p.page_id for p in pages if p.template in ("dc", "c_L0", "c_L1"))[:3]
    assert {(r.source_id, r.target_id) for r in footer} == {(p.page_id, t) for p in pages for t in first if p.page_id != t}


def test_block_merge_and_empty(spark, template_pages):
    links = spark.createDataFrame(
        [(1, 2, "b", 0.5), (1, 2, "a", 0.5), (1, 2, "c", 0.2), (1, 1, "a", 1.0), (1, 3, "c", 0.9)],
        "source_id int, target_id int, block_type string, rule_weight float",
    )
    merged = [(r.target_id, r.block_type, round(r.rule_weight, 4)) for r in be.block_dedup_cap(links, 5).orderBy("target_id").collect()]
    assert merged == [(2, "a", 1.2), (3, "c", 0.9)]
    off = be.BlockOptions(enable_hierarchy_up=False, enable_hierarchy_down=False, enable_cluster_peer=False)
    assert be.build_block_edges(template_pages, off).count() == 0


@pytest.mark.parametrize("cap", [3, 8, 60])
def test_blocks_in_place_agree_with_merged_links(spark, template_pages, cap):
    """Lists per source page against the plain union of all links; hierarchy as heavy as blocks, so that children tie and overlap."""
    listings = ["/c/", "/ck/", "/cl/", "homepage"]
    blocks = {
        "breadcrumb": be.Block(1.0, 5, ["/c/", "/cl/"]), "seo_top_filters": be.Block(0.7, 4, listings), "top_searches": be.Block(0.8, 2, listings),
        "top_locations": be.Block(0.8, 3, ["/c/"]), "box_top_filters": be.Block(0.65, 2, ["/cl/"], enabled=cap != 8),
        "footer_corporate": be.Block(0.15, 3, ["all"]),
    }
    # a page that is its parent's parent, and one that is its own parent
    odd = spark.createDataFrame(
        [(9001, "/x", "/y", 1, "x", "c:cars", "c_L1", True), (9002, "/y", "/x", 1, "y", "c:cars", "c_L1", True), (9003, "/z", "/z", 1, "z", "c:none", "c_L1", True)],
        template_pages.schema,
    )
    pages = template_pages.unionByName(odd)
    for options in (be.BlockOptions(blocks=blocks, max_out_links_per_page=cap), be.BlockOptions(max_out_links_per_page=cap, enable_cluster_peer=False)):
        got = sorted(map(tuple, be.build_block_edges(pages, options).collect()))
        want = sorted(map(tuple, be.block_dedup_cap(be.all_block_links(pages, options), cap).collect()))
        assert len(got) > 100 or cap == 3 or not options.blocks
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want])


def test_places_in_several_lists(spark, monkeypatch):
    rows = spark.createDataFrame([("a",), ("b",)], "category string")
    places = spark.createDataFrame([("town", f"t{i}", i, f"c{i}") for i in range(1, 12)] + [("region", "r", 1, "x")], "kind string, place string, place_no int, code string")
    want = {(c, f"t{i}", f"c{i}") for c in "ab" for i in range(1, 12)}
    for together in (100, 4):
        monkeypatch.setattr(ex, "PLACES_TOGETHER", together)
        met = ex._with_places(rows, places, "town")
        found = met.collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
        assert together == 4 or "Exchange hashpartitioning" not in met._jdf.queryExecution().optimizedPlan().toString()
        assert ex._with_places(rows, places, "department").isEmpty() and ex._with_places(rows, places, "town", 2).count() == 4


def test_template_run(spark, template_pages, folder):
    workspace = Workspace(spark, folder)
    blocks = be.BlockOptions(blocks={"breadcrumb": be.Block(1.0, 5, ["/c/", "/cl/"])}, max_out_links_per_page=10)
    runs.analyse_templates(template_pages, workspace, blocks)
    scores = workspace.read("pri_scores")
    assert abs(scores.agg(F.sum("pri_score")).first()[0] - 1) < 1e-8
    degree = workspace.read("edges").groupBy("source_id").count().agg(F.max("count")).first()[0]
    assert degree <= 10
