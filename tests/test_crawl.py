"""A small crawl from CSV to scores, marts, scenarios and reports."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import anchors as an
from linkloom.operators import crawl_links as cl
from linkloom.operators import marts, report
from linkloom.operators.scoring import ScoreOptions, compute_pri, scores_normalize
from linkloom.plans import runs
from linkloom.schemas import PAGE_SEGMENTS, PRI_SCORES, SEGMENT_METRICS, URL_METRICS
from linkloom.sources.crawl import EXPORT_COLUMNS, crawl_csv_scan
from linkloom.sources.workspace import Workspace, export_workspace, run_log_append, scenario_table_scan
from linkloom.storage import sql_settings

HEADER = (
    "Type,From,To,Anchor Text,Alt Text,Follow,Target,Rel,Status Code,Status,Path Type,Link Path,Link Position,Link Origin,Size,Transferred"
)
HOST = "https://www.example.com"
LINKS = [
    ("/", "/cars", "Cars", "", "True", 200, "Navigation"),
    ("/", "/contact", "Contact", "", "True", 200, "Footer"),
    ("/cars", "/cars/suv", "SUV d'occasion", "", "True", 200, "Content"),
    ("/cars", "/cars/suv", "SUV d'occasion", "", "True", 200, "Content"),
    ("/cars/suv", "/cars", "Voir voitures", "", "True", 200, "Content"),
    ("/cars/suv", "/contact", "", "Contact image", "True", 200, "Content"),
    ("/cars/suv", "https://www.external.com/", "External link", "", "True", 200, "Content"),
    ("/contact", "/", "Retour accueil", "", "False", 200, "Content"),
    ("/contact", "/cars", "Cars", "", "True", 404, "Content"),
]


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    lines = [HEADER]
    for source, target, anchor, alt, follow, status, position in LINKS:
        to = target if target.startswith("http") else HOST + target
        lines.append(f'Hyperlink,{HOST}{source},{to},"{anchor}",{alt},{follow},,,{status},OK,Absolute,,{position},HTML,1,1')
    lines.append("Image,short row")
    lines.append(f"Hyperlink,{HOST}/cars,{HOST}/cars?page=2,self,,True,,,200,OK,Absolute,,Content,HTML,1,1,extra,fields")
    folder = tmp_path_factory.mktemp("crawl")
    (folder / "links.csv").write_text("\n".join(lines) + "\n")
    workspace = Workspace(spark, str(folder / "workspace"))
    runs.analyse_crawl(crawl_csv_scan(spark, str(folder / "links.csv")), workspace)
    return workspace


def test_scan_is_tolerant(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEADER + "\nHyperlink,a\n" + ",".join("x" * 20) + "\n")
    rows = crawl_csv_scan(spark, str(tmp_path / "x.csv")).collect()
    assert len(rows) == 2 and rows[0].to_url is None and rows[1].link_position == "x"


def test_pages(site):
    rows = [tuple(r) for r in site.read("pages").orderBy("page_id").select("page_id", "path", "parent_path", "depth", "is_leaf").collect()]
    assert rows == [
        (1, "/", None, 0, False),
        (2, "/cars", "/", 1, False),
        (3, "/cars/suv", "/cars", 2, False),
        (4, "/contact", "/", 1, True),
    ]


def test_edges_and_candidates(site):
    edges = {(r.source_id, r.target_id, r.block_type, round(r.rule_weight, 4)) for r in site.read("edges").collect()}
    assert edges == {(1, 2, "navigation", 0.9), (1, 4, "footer", 0.45), (2, 3, "content", 2.0), (3, 2, "content", 1.0), (3, 4, "content", 1.0)}
    found = {
        (r.source_id, r.target_id, r.anchor_type, r.anchor_text, r.anchor_token_count, round(r.rule_weight, 4))
        for r in site.read("anchor_candidates").collect()
    }
    assert found == {
        (1, 2, "exact", "Cars", 1, 0.9),
        (1, 4, "exact", "Contact", 1, 0.45),
        (2, 3, "partial", "SUV d'occasion", 2, 1.0),
        (3, 2, "contextual", "Voir voitures", 2, 1.0),
        (3, 4, "partial", "Contact image", 2, 1.0),
    }


def test_scores(site):
    scores = site.read("pri_scores").orderBy("page_id").collect()
    assert [round(r.pri_score, 6) for r in scores] == [0.094311, 0.294070, 0.344271, 0.267348]
    assert [round(r.cheirank_score, 6) for r in scores] == [0.256855, 0.348911, 0.302152, 0.092082]
    assert [round(r.juice_potential_score, 6) for r in scores] == [0.282184, 0.241847, 0.331948, 0.0]
    assert abs(sum(r.pri_score for r in scores) - 1) < 1e-8 and abs(sum(r.cheirank_score for r in scores) - 1) < 1e-8
    assert [r.rank for r in scores] == [4, 2, 1, 3]
    assert site.read("pri_scores").columns == list(PRI_SCORES)


def test_scores_normalize(site):
    full = site.read("pri_scores")
    bare = scores_normalize(full.select("page_id", "pri_score")).orderBy("page_id").collect()
    assert [r.rank for r in bare] == [4, 2, 1, 3] and all(r.cheirank_score == r.pri_score for r in bare)
    same = scores_normalize(full).orderBy("page_id").collect()
    assert [tuple(r) for r in same] == [tuple(r) for r in full.orderBy("page_id").collect()]
    with pytest.raises(ValueError):
        scores_normalize(full.select("page_id"))


def test_block_filter_and_validation(site):
    pages, edges = site.read("pages"), site.read("edges")
    content = compute_pri(pages, edges, ScoreOptions(include_block_types=["content"])).orderBy("page_id").collect()
    assert [r.out_degree for r in content] == [0, 1, 2, 0]
    assert [r.pri_score for r in content] != [r.pri_score for r in site.read("pri_scores").orderBy("page_id").collect()]
    with pytest.raises(ValueError):
        compute_pri(pages.where("page_id < 4"), edges)


def test_marts(site):
    metrics, segments = site.read("url_metrics"), site.read("page_segments")
    assert metrics.columns == list(URL_METRICS) and segments.columns == list(PAGE_SEGMENTS)
    assert site.read("segment_metrics").columns == list(SEGMENT_METRICS)
    suv = segments.where("page_id = 3").orderBy("level").collect()
    assert [(r.level, r.segment, r.segment_path, r.parent_segment_path, r.is_terminal) for r in suv] == [
        (0, "root", "/", None, False),
        (1, "cars", "/cars", "/", False),
        (2, "suv", "/cars/suv", "/cars", True),
    ]
    home = segments.where("page_id = 1").collect()
    assert len(home) == 1 and home[0].is_terminal
    assert segments.where("level = 0").count() == 4
    without = marts.url_metrics(site.read("pages"), site.read("pri_scores"), site.read("edges"))
    assert {r.unique_anchor_texts_out for r in without.collect()} == {0}


def test_scenarios(site):
    edges = scenario_table_scan(site)
    assert edges.select("scenario").distinct().count() == 3 and edges.count() == 15
    scores = site.read("scenario_pri").groupBy("scenario").agg(F.sum("pri_score").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-8 for r in scores)
    assert site.read("scenario_comparison").count() == 4
    summary = {r.scenario: r.avg_anchor_diversity_score for r in an.scenario_summary(edges).collect()}
    assert len(summary) == 3
    with pytest.raises(ValueError, match="anchor_text"):
        an.scenario_edges(site.read("anchor_candidates").drop("anchor_text"))


def test_rule_candidates_raise_diversity(site):
    base = an.anchor_base(site.read("edges"), site.read("pages"))
    candidates = an.anchor_candidates_rules(base)
    assert candidates.count() == 4 * site.read("edges").count()
    assert {r.anchor_type for r in candidates.collect()} == {"exact", "partial", "contextual", "generic"}
    partial = candidates.where("anchor_type = 'partial' and target_id = 2").first()
    assert partial.anchor_text == "Cars " and partial.anchor_token_count == 2


def test_export(site, spark, folder):
    exported, absent = export_workspace(site, folder)
    counts = {r.table: r.row_count for r in exported.collect()}
    assert counts["pages"] == 4 and counts["edges"] == 5 and "scenario_comparison" in counts and absent == []
    again = spark.read.option("header", True).csv(f"{folder}/csv/edges")
    assert again.count() == 5 and again.columns == ["source_id", "target_id", "block_type", "rule_weight"]
    small = Workspace(spark, folder + "/small")
    with pytest.raises(ValueError, match="pri_scores"):
        export_workspace(small, folder + "/none")
    for name in ("pages", "edges", "pri_scores"):
        small.write(name, site.read(name))
    exported, absent = export_workspace(small, folder + "/few")
    assert exported.count() == 3 and set(absent) == {"anchor_candidates", "page_segments", "url_metrics", "segment_metrics"}


def test_report(site):
    kpis = report.report_kpis(site.read("pages"), site.read("edges"), site.read("pri_scores"), site.read("anchor_candidates"))
    values = {(r.metric, r.name): r.value for r in kpis.collect()}
    assert values[("page_count", "")] == 4 and values[("block_type", "content")] == 3
    assert report.kpis_as_json(kpis).count() == 1
    assert report.report_top_pages(site.read("pri_scores"), site.read("pages")).count() == 4


def test_run_log(site, spark, folder):
    record = runs.run_record(site, "r1", "2024-01-01", 1.5, runs.RunOptions())
    run_log_append(spark, folder + "/log", record)
    log = run_log_append(spark, folder + "/log", record)
    assert log.count() == 2 and log.first().page_count == 4


def test_host_choice(site, spark):
    raw = spark.createDataFrame([("x",) * 8], "type string, from_url string, to_url string, anchor_text string, alt_text string, follow string, status_code string, link_position string")
    by_host = cl.host_links(cl.links_normalized(raw))
    with pytest.raises(ValueError):
        cl.source_host(by_host)
    assert cl.source_host(by_host, " WWW.A.com ") == "www.a.com"


def test_cap_and_top_text(spark):
    edges = spark.createDataFrame([(1, t, "content", float(t % 5)) for t in range(2, 40)], "source_id int, target_id int, block_type string, rule_weight float")
    kept = cl.link_edges_topk(edges, 3).orderBy("target_id").collect()
    assert [r.target_id for r in kept] == [4, 9, 14]
    assert cl.link_edges_topk(edges, 0).count() == 38


@pytest.mark.parametrize("split_bytes", [61, 250, 1 << 20])
def test_line_breaks_in_quotes_across_splits(spark, tmp_path, split_bytes):
    """Files cut into splits of a few bytes, against Python's csv module."""
    import csv
    import random

    drawn = random.Random(split_bytes)
    pieces = ["a", "b c", "\n", '"', ",", '""', "\n\n", "é", ' "x" ', "\r\n", "long words of text " * 3]
    wanted = []
    for number in range(3):
        rows = [["".join(drawn.choice(pieces) for _ in range(drawn.randint(0, 4))) for _ in HEADER.split(",")] for _ in range(25)]
        if number == 2:
            rows = [["plain"] * len(row) for row in rows]
        with (tmp_path / f"part-{number}.csv").open("w", newline="", encoding="utf-8") as out:
            out.write(HEADER + "\n")
            csv.writer(out, lineterminator="\r\n" if number == 1 else "\n", quoting=csv.QUOTE_ALL).writerows(rows)
        wanted += rows
    places = [HEADER.split(",").index(name) for name in EXPORT_COLUMNS]
    expected = sorted([row[place].replace("\r\n", "\n") for place in places] for row in wanted)
    with sql_settings(spark, {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "1"}):
        scanned = crawl_csv_scan(spark, str(tmp_path))
        assert sorted(list(r) for r in scanned.collect()) == expected
        assert split_bytes > 1000 or scanned.rdd.getNumPartitions() > 1


def test_stray_and_unclosed_quotes(spark, tmp_path):
    lines = [HEADER, 'Hyperlink,a,5" disk,x', 'Hyperlink,b,"two', 'lines",x', 'Hyperlink,c,"never closed,x', "Hyperlink,d,e,x"]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    rows = {r.from_url: r.to_url for r in crawl_csv_scan(spark, str(tmp_path / "x.csv")).collect()}
    assert rows["a"] == '5" disk' and rows["b"] == "two\nlines" and rows["d"] == "e" and "c" in rows


def test_profiles_agree_with_the_single_operators(spark):
    rows = [("/a", f"/t{i % 5}", ("content", "footer")[i % 2], ("T1", "More", "t 1", "read more", "x")[i % 5 - i % 3], i % 4 + 1) for i in range(60)]
    groups = spark.createDataFrame(rows, "from_path string, to_path string, block_type string, anchor_text string, instances long")
    groups = groups.groupBy("from_path", "to_path", "block_type", "anchor_text").agg(F.sum("instances").alias("instances"))
    pages = cl.pages_from_links(groups)
    identified = cl.link_id_lookup(groups, pages)
    edges = cl.link_edges_topk(cl.link_edges_agg(identified), 7)
    profiles = cl.link_edges_topk(cl.edge_profiles(identified), 7)
    plain = cl.anchor_candidates_links(cl.anchor_top_text(cl.anchor_text_counts(identified)), edges)

    def values(df):
        return sorted(map(str, df.collect()))

    assert values(cl.profile_edges(profiles)) == values(edges) and len(values(edges)) == 7
    assert values(cl.profile_candidates(profiles)) == values(plain)
