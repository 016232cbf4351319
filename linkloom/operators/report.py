"""Workspace report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.marts import top_segments
from linkloom.operators.overview import top_n_by

TOP_COLUMNS = ["page_id", "path", "pri_score", "rank", "cheirank_score", "cheirank_rank", "can_give_juice", "is_low_power"]


def report_kpis(pages: DataFrame, edges: DataFrame, scores: DataFrame, anchors: DataFrame | None = None, mix: int = 15) -> DataFrame:
    """(metric, name, value): table sizes, score sums, flag counts, largest blocks and anchor kinds."""
    have = set(scores.columns)
    figures = {"node_count": F.count(F.lit(1)).cast("double"), "pri_sum": F.coalesce(F.sum("pri_score"), F.lit(0.0))}
    if "cheirank_score" in have:
        figures["cheirank_sum"] = F.coalesce(F.sum("cheirank_score"), F.lit(0.0))
    if "can_give_juice" in have:
        figures["donor_count"] = F.count_if("can_give_juice").cast("double")
    if "is_low_power" in have:
        figures["low_power_count"] = F.count_if("is_low_power").cast("double")
    totals = scores.agg(*[figure.alias(name) for name, figure in figures.items()])
    rows = totals.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in figures])).alias("row")
    ).select("row.metric", F.lit("").alias("name"), "row.value")
    tables = {"page_count": pages, "edge_count": edges}
    mixes = {"block_type": edges}
    if anchors is not None:
        tables["anchor_candidate_count"] = anchors
        mixes["anchor_type"] = anchors
    for metric, table in tables.items():
        size = table.agg(F.count(F.lit(1)).cast("double").alias("value"))
        rows = rows.unionByName(size.select(F.lit(metric).alias("metric"), F.lit("").alias("name"), "value"))
    for column, table in mixes.items():
        top = table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(mix)
        rows = rows.unionByName(
            top.select(F.lit(column).alias("metric"), F.col(column).alias("name"), F.col("n").cast("double").alias("value"))
        )
    return rows


def kpis_as_json(kpis: DataFrame) -> DataFrame:
    """The report figures as one JSON row (their number is small and fixed by the block and anchor kinds)."""
    figure = F.struct("metric", "name", "value")
    return kpis.agg(F.to_json(F.array_sort(F.collect_list(figure))).alias("kpis"))


def report_top_pages(scores: DataFrame, pages: DataFrame, n: int = 20) -> DataFrame:
    best = top_n_by(scores, "pri_score", n)
    joined = pages.select("page_id", "path").join(F.broadcast(best), "page_id")
    return joined.select(*[c for c in TOP_COLUMNS if c == "path" or c in scores.columns])


def report_top_segments(segments: DataFrame, n: int = 20) -> DataFrame:
    return top_segments(segments, 1, n)


def report_table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count) of the named tables."""
    counts = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        counts = row if counts is None else counts.unionByName(row)
    return counts
