"""What a task of the ranking holds: rows of bounded length, and a tile's values once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import rank_iteration as ri
from linkloom.storage import package_on_workers, sql_settings

OPTIONS = ri.RankOptions(links_per_partition=100, steps_per_check=2, max_iterations=4, tolerance=0)


def graph(spark, pairs, weightings=2):
    rows = [(s, t, *[1.0 + (s + 3 * t + k) % 4 for k in range(weightings)]) for s, t in pairs]
    kinds = "source long, target long, " + ", ".join(f"w{k} double" for k in range(weightings))
    return spark.range(50).withColumnRenamed("id", "page_id"), spark.createDataFrame(rows, kinds)


def ranks(nodes, links, names=("a", "b")):
    return {row.page_id: [round(x, 6) for x in row[1:]] for row in ri.rank_graphs(nodes, links, list(names), OPTIONS).collect()}


def test_vectors_are_rows_of_bounded_length(spark, monkeypatch):
    nodes, links = graph(spark, [(i % 50, (7 * i * i) % 47) for i in range(600)])
    whole = ranks(nodes, links)
    longest, gathered = [], ri._gathered

    def noted(vector, changes, grid):
        for each in (vector, *changes):
            longest.append(each.agg(F.max(F.length("values")), F.max(F.length("scaled"))).first())
        return gathered(vector, changes, grid)

    monkeypatch.setattr(ri, "PIECE_VALUES", 5)
    monkeypatch.setattr(ri, "_gathered", noted)
    assert ranks(nodes, links) == whole
    assert longest[0] == (5 * 8, 5 * 8) and longest[1] == (5 * 4, 5 * 4)


def test_values_come_once_to_a_tile(spark):
    package_on_workers(spark)
    links = spark.createDataFrame([(i % 40, (i * i) % 37, 1.0) for i in range(400)], "u long, v long, w0 double")
    options = ri.RankOptions(links_per_partition=200, links_per_row=10)
    grid = ri.make_grid(spark, 41, 400, 1, options)
    with sql_settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(len(grid.keys))}):
        tiles = ri._headed(ri.link_tiles(links, grid, options), grid).persist()
        vectors = spark.createDataFrame([(0, s, 0, bytes(4 * grid.length)) for s in range(2 * grid.segments)], ri.VALUES)
        rows = ri._at_tiles(tiles, vectors, grid).collect()
        assert len(rows) == tiles.count() > 3 * len(grid.keys)
        assert sorted(row.tile for row in rows if row["values"] is not None) == list(range(len(grid.keys)))
        tiles.unpersist()


def test_weights_are_kept_in_single_precision_where_that_is_exact():
    assert ri._narrowed(np.array([[0.5, 0.25, 3.0]])).dtype == np.float32
    for weights in ([0.1, 0.5], [1e300, 1.0], [1e-300, 1.0]):
        assert ri._narrowed(np.array([weights])).tolist() == [weights]


@pytest.mark.parametrize("scale", [1e-30])
def test_weights_of_any_size(spark, scale):
    nodes, links = graph(spark, [(i % 50, (7 * i * i) % 47) for i in range(300)])
    scaled = links.withColumns({f"w{k}": F.col(f"w{k}") * scale for k in range(2)})
    assert ranks(nodes, scaled) == ranks(nodes, links)


def test_all_targets_in_one_group_of_segments(spark, monkeypatch):
    nodes, links = graph(spark, [(2 * i + 1, 4 * (i % 5)) for i in range(24)])
    whole = ranks(nodes, links)
    monkeypatch.setattr(ri, "TILE_VALUES", 30)
    assert ranks(nodes, links) == whole
