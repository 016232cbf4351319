"""What the ranking and the scenarios move, on rows of their own."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.operators import anchors as an
from linkloom.operators import rank_iteration as ri
from linkloom.operators import scoring as sc
from linkloom.storage import package_on_workers, sql_settings


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_stay_where_they_are(spark):
    package_on_workers(spark)
    links = spark.createDataFrame([(i % 40, (i * i) % 37, 1.0 + i % 3) for i in range(400)], "u long, v long, w0 double")
    options = ri.RankOptions(links_per_partition=200)
    grid = ri.make_grid(spark, 41, 400, 1, options)
    settings = {
        "spark.sql.shuffle.partitions": str(len(grid.keys)),
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    with sql_settings(spark, settings):
        tiles = ri.link_tiles(links, grid, options).repartition(len(grid.keys), "key").persist()
        assert tiles.count() <= len(grid.keys) * links.rdd.getNumPartitions()
        assert len({row.tile for row in tiles.select("tile").collect()}) == len(grid.keys) == 4
        vectors = spark.createDataFrame([], ri.VALUES)
        step = plan_of(ri._at_tiles(tiles, vectors, grid))
        before_the_links, _ = step.split("InMemoryTableScan", 1)
        assert "Exchange" not in before_the_links
        tiles.unpersist()


@pytest.mark.parametrize("steps", [[], [0], [0, 0, 3], [255], [256, 1], [65_535, 0], [65_536, 2], [1] * 9])
def test_targets_are_kept_as_steps(steps):
    places = np.cumsum([70_000, *steps]).astype(np.int32)
    blob = ri._gaps(places).tobytes()
    assert ri._places(pa.scalar(blob, pa.binary()), len(places)).tolist() == places.tolist()
    widest = max(steps, default=0)
    assert len(blob) == 4 + len(steps) * (1 if widest < 256 else 2 if widest < 65_536 else 4)


def test_changes_move_by_narrow_rows(spark, monkeypatch):
    moved = []
    sums = ri._tile_sums

    def noted(rows, *args, **kinds):
        moved.append((rows, kinds.get("share", ri.EXACT)))
        return sums(rows, *args, **kinds)

    monkeypatch.setattr(ri, "_tile_sums", noted)
    nodes = spark.range(50).withColumnRenamed("id", "page_id")
    links = spark.createDataFrame([(i % 50, (7 * i * i) % 47, 1.0 + i % 3) for i in range(600)], "source long, target long, w0 double")
    ri.rank_graphs(nodes, links, ["a"], ri.RankOptions(steps_per_check=4, tolerance=1e-3))
    of_rounds = moved[1:]  # the first adds up what reaches a page
    assert [share for _, share in of_rounds[:4]] == [ri.EXACT, ri.CHANGE, ri.CHANGE, ri.CHANGE]
    assert all(rows.columns == ["key", "tile", "source", "target", "w", "values"] for rows, _ in of_rounds)


def test_one_weighting_ranks_links_without_adding_them_up(spark, monkeypatch):
    handed = []

    def rank(nodes, links, *rest):
        handed.append(links)
        raise InterruptedError

    monkeypatch.setattr(sc, "rank_graphs", rank)
    nodes = spark.createDataFrame([(page,) for page in range(1, 5)], "page_id long")
    kinds = "source_id long, target_id long, block_type string, rule_weight float, variant string"
    rows = [(1, 2, "head", 1.0, "site"), (1, 2, "content", 2.0, "site"), (1, 3, "content", 1.0, "site"), (1, 2, "head", 1.0, "site"), (3, 1, "content", None, "site")]
    with pytest.raises(InterruptedError):
        sc.score_variants(nodes, spark.createDataFrame(rows, kinds), ["site"], sc.ScoreOptions())
    (links,) = handed
    assert "Exchange" not in plan_of(links) and links.count() == 5
    added = links.groupBy("source", "target").agg(F.sum("w0").alias("w0"))
    assert added.count() == 3
    got, want = (sorted(ri.rank_graphs(nodes, each, ["site"]).collect()) for each in (links, added))
    assert got == want


@pytest.mark.parametrize("cores", [1, 2, 4, 8, 12, 16, 24, 100])
def test_tiles_fit_the_cores(monkeypatch, cores):
    monkeypatch.setattr(ri, "_keys", lambda spark, partitions: tuple(range(partitions)))
    spark = SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=cores))
    grid = ri.make_grid(spark, 1_000_000, 100_000_000, 3, ri.RankOptions())
    assert len(grid.keys) <= max(2, cores)
    if cores == 12:
        assert grid.segments + grid.groups == 4


def test_ids_far_apart_and_null(spark):
    far = {0: 5, 1: 10**15, 2: -(10**12)}
    pairs = [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (0, 2, 3.0)]
    kinds = "source long, target long, w0 double"
    near = ri.rank_graphs(spark.range(3).withColumnRenamed("id", "page_id"), spark.createDataFrame(pairs, kinds), ["a"])
    nodes = spark.createDataFrame([(page,) for page in far.values()], "page_id long")
    apart = ri.rank_graphs(nodes, spark.createDataFrame([(far[s], far[t], w) for s, t, w in pairs], kinds), ["a"])
    got = {row.page_id: tuple(row)[1:] for row in apart.collect()}
    assert got == {far[row.page_id]: tuple(row)[1:] for row in near.collect()}


def test_scenarios_move_candidates_once(spark):
    kinds = "source_id long, target_id long, block_type string, rule_weight float, anchor_type string, anchor_text string"
    rows = [(1, t, "content", 1.0, kind, f"{kind} {t % 2}") for t in range(2, 30) for kind in ("exact", "partial", "contextual", "generic")]
    rows += [rows[0], (1, None, "content", 1.0, "exact", "x"), (None, 3, "content", 1.0, "exact", "x"), (1, 2, "content", 2.0, "exact", None)]
    candidates = spark.createDataFrame(rows, kinds)
    edges = an.scenario_edges(candidates)
    assert plan_of(edges).count("Exchange hashpartitioning") == 1
    got = edges.collect()
    # 27 edges with one weight; that to page 2 has two and, where exact is drawn, three texts of it; a null target has none.
    exact = {r.scenario for r in got if r.target_id == 2 and r.anchor_type == "exact"}
    assert len(got) == 3 * (27 + 1 + 2) + 4 * len(exact)
    assert {r.anchor_text for r in got if r.target_id is None} == {an.GENERIC_TEXT}
    score = {(r.scenario, r.anchor_diversity_score) for r in got}
    want = {(r.scenario, r.anchor_diversity_score) for r in an.source_diversity(an.scenario_select_anchor(candidates)).where("source_id = 1").collect()}
    assert score == want and len(score) == 3


def test_scenario_tasks_grow_with_the_candidates(spark, monkeypatch):
    kinds = "source_id long, target_id long, block_type string, rule_weight float, anchor_type string, anchor_text string"
    candidates = spark.createDataFrame([(s, s + 1, "content", 1.0, "exact", "x") for s in range(60)], kinds)

    def tasks():
        return int(re.search(r"hashpartitioning\(source_id#\d+L, (\d+)\)", plan_of(an.scenario_edges(candidates))).group(1))

    assert tasks() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(an, "CANDIDATES_PER_TASK", 7)
    assert tasks() == 9
    assert an.scenario_edges(candidates).count() == 3 * 60
