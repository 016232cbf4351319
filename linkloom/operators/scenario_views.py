"""Reports on anchor scenarios and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.anchors import ANCHOR_TYPES
from linkloom.operators.ordering import quantiles
from linkloom.operators.overview import top_n_by


def scenario_mix_pivot(edges: DataFrame) -> DataFrame:
    wide = edges.groupBy("scenario").pivot("anchor_type", ANCHOR_TYPES).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def _inside(df: DataFrame, selected: DataFrame | None) -> DataFrame:
    return df if selected is None else df.join(selected.select("page_id"), "page_id", "left_semi")


def scenario_top_pages(scores: DataFrame, pages: DataFrame, scenario: str, selected: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Best pages of one scenario inside a selection."""
    chosen = _inside(scores.where(F.col("scenario") == scenario), selected)
    return top_n_by(chosen, "pri_score", n).join(pages.select("page_id", "path"), "page_id", "left").select(
        "rank", "page_id", "path", "pri_score", "in_degree", "out_degree"
    )


def scenario_gainers_losers(
    comparison: DataFrame, pages: DataFrame, delta: str, selected: DataFrame | None = None, n: int = 15
) -> DataFrame:
    """(board, ...): pages a scenario helps and hurts most."""
    changes = _inside(comparison.select("page_id", F.col(delta).alias("delta_pri")), selected)
    gainers = top_n_by(changes, "delta_pri", n).withColumn("board", F.lit("gainers"))
    losers = top_n_by(changes, "delta_pri", n, descending=False).withColumn("board", F.lit("losers"))
    boards = gainers.unionByName(losers)
    return boards.join(pages.select("page_id", "path"), "page_id", "left").select("board", "page_id", "path", "delta_pri")


def scenario_delta_stats(comparison: DataFrame, delta: str, selected: DataFrame | None = None) -> DataFrame:
    changes = _inside(comparison.select("page_id", F.col(delta).alias("delta_pri")), selected)
    median = quantiles(changes, "delta_pri", {}, ["m"]).scalar()
    return changes.agg(
        F.min("delta_pri").alias("min_delta_pri"), F.avg("delta_pri").alias("mean_delta_pri"), F.max("delta_pri").alias("max_delta_pri")
    ).withColumn("median_delta_pri", median)


def scenario_page_impact(comparison: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    return comparison.where(F.col("page_id") == page_id).join(pages.select("page_id", "path"), "page_id", "left")
