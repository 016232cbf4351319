"""Filters over the URL, edge and anchor tables, and the detail views of one page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.marts import n_unique
from linkloom.operators.ordering import quantiles

EXPLORER_COLUMNS = [
    "page_id",
    "path",
    "depth",
    "category",
    "verticale",
    "template",
    "pri_score",
    "rank",
    "cheirank_score",
    "cheirank_rank",
    "in_degree",
    "out_degree",
    "incoming_links",
    "outgoing_links",
    "can_give_juice",
    "is_low_power",
]


@dataclass(frozen=True)
class UrlFilter:
    """None means "everything selected"; an empty block or anchor list selects nothing."""

    segment_level: int = 1
    segment_path: str | None = None
    depth_min: int | None = None
    depth_max: int | None = None
    url_search: str = ""
    templates: list[str] | None = None
    verticals: list[str] | None = None
    block_types: list[str] | None = None
    anchor_types: list[str] | None = None


def filter_urls(
    metrics: DataFrame, edges: DataFrame, selection: UrlFilter, segments: DataFrame | None = None, anchors: DataFrame | None = None
) -> DataFrame:
    """Pages that pass every chosen filter. Order by ``pri_score`` where it is shown."""
    kept = metrics
    if segments is not None and selection.segment_path is not None:
        inside = segments.where(
            (F.col("level") == selection.segment_level) & (F.col("segment_path") == selection.segment_path)
        ).select("page_id")
        kept = kept.join(inside, "page_id", "left_semi")
    if selection.depth_min is not None:
        kept = kept.where(F.col("depth") >= selection.depth_min)
    if selection.depth_max is not None:
        kept = kept.where(F.col("depth") <= selection.depth_max)
    if selection.url_search:
        kept = kept.where(F.lower("path").contains(selection.url_search.lower()))
    for column, chosen in (("template", selection.templates), ("verticale", selection.verticals)):
        if chosen and column in metrics.columns:
            kept = kept.where(F.col(column).isin(chosen))
    for links, column, chosen in (
        (edges, "block_type", selection.block_types),
        (anchors, "anchor_type", selection.anchor_types),
    ):
        if links is not None and chosen is not None:
            having = links.where(F.col(column).isin(chosen)) if chosen else links.where(F.lit(False))
            kept = kept.join(having.select(F.col("source_id").alias("page_id")), "page_id", "left_semi")
    return kept


def _of_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.col("page_id").alias("source_id")), "source_id", "left_semi")


def filter_edges(edges: DataFrame, pages: DataFrame, block_types: list[str] | None = None) -> DataFrame:
    """Edges of the chosen blocks that start on a selected page."""
    return _of_pages(edges if block_types is None else edges.where(F.col("block_type").isin(block_types)), pages)


def filter_anchors(
    anchors: DataFrame, pages: DataFrame, block_types: list[str] | None = None, anchor_types: list[str] | None = None
) -> DataFrame:
    if block_types is not None:
        anchors = anchors.where(F.col("block_type").isin(block_types))
    if anchor_types is not None:
        anchors = anchors.where(F.col("anchor_type").isin(anchor_types))
    return _of_pages(anchors, pages)


def filter_options(metrics: DataFrame, edges: DataFrame, anchors: DataFrame, segments: DataFrame, level: int = 1) -> DataFrame:
    """(option, value, size): what each filter can be set to."""

    def distinct(df: DataFrame, column: str) -> DataFrame:
        known = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("size"))
        return known.select(F.lit(column).alias("option"), F.col(column).alias("value"), "size")

    depth = metrics.agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max")).select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("option"), F.col(n).cast("string").alias("value")) for n in ("depth_min", "depth_max")])
        ).alias("row")
    )
    of_level = segments.where(F.col("level") == level)
    return (
        distinct(edges, "block_type")
        .unionByName(distinct(anchors, "anchor_type"))
        .unionByName(distinct(metrics, "template"))
        .unionByName(distinct(metrics, "verticale"))
        .unionByName(depth.select("row.option", "row.value", F.lit(None).cast("long").alias("size")))
        .unionByName(
            of_level.select(
                F.lit("segment").alias("option"), F.col("segment_path").alias("value"), F.col("page_count").cast("long").alias("size")
            )
        )
    )


def filtered_summary(metrics: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(metric, name, value): totals, block mix and anchor mix of a selection."""
    totals = metrics.agg(
        F.count(F.lit(1)).cast("double").alias("pages"),
        F.coalesce(F.sum("pri_score"), F.lit(0.0)).alias("pri_sum"),
        F.coalesce(F.sum("cheirank_score"), F.lit(0.0)).alias("cheirank_sum"),
        F.count_if("can_give_juice").cast("double").alias("donors"),
        F.count_if("is_low_power").cast("double").alias("low_power"),
    )
    names = totals.columns
    rows = totals.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("row")
    ).select("row.metric", F.lit("").alias("name"), "row.value")
    for df, column in ((edges, "block_type"), (anchors, "anchor_type")):
        mix = df.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("value"))
        rows = rows.unionByName(mix.select(F.lit(column).alias("metric"), F.col(column).alias("name"), "value"))
    return rows


def top_pages(metrics: DataFrame, n: int = 25) -> DataFrame:
    return metrics.orderBy(F.desc("pri_score"), "page_id").limit(n)


def selected_page(metrics: DataFrame, page_id: int | Column) -> DataFrame:
    """The row of one page; none if the selection lacks it."""
    return metrics.where(F.col("page_id") == page_id)


def url_explorer(metrics: DataFrame, n: int = 1000) -> DataFrame:
    return top_pages(metrics, n).select(*[c for c in EXPLORER_COLUMNS if c in metrics.columns])


def _touching(links: DataFrame, page_id: int) -> DataFrame:
    """Both directions of one page's links; the filter reaches the Parquet scan."""
    page = F.lit(page_id)
    return links.where((F.col("source_id") == page) | (F.col("target_id") == page))


def _direction(page_id: int) -> Column:
    is_out = F.col("source_id") == page_id
    both = F.array(
        F.when(is_out, F.lit("out")),
        F.when(F.col("target_id") == page_id, F.lit("in")),
    )
    return F.explode(F.filter(both, lambda d: d.isNotNull()))


def page_neighbors(edges: DataFrame, pages: DataFrame, page_id: int, n: int = 100) -> DataFrame:
    """Strongest out- and in-neighbours of one page with their paths."""
    found = None
    for direction, near, far in (("out", "source_id", "target_id"), ("in", "target_id", "source_id")):
        best = (
            edges.where(F.col(near) == page_id)
            .orderBy(F.desc("rule_weight"), far, "block_type")
            .limit(n)
            .select(F.lit(direction).alias("direction"), F.col(far).alias("page_id"), "block_type", "rule_weight")
        )
        found = best if found is None else found.unionByName(best)
    return found.join(pages.select("page_id", "path"), "page_id", "left").select(
        "direction", "page_id", "path", "block_type", "rule_weight"
    )


def page_block_mix(edges: DataFrame, page_id: int) -> DataFrame:
    return (
        _touching(edges, page_id)
        .select("block_type", _direction(page_id).alias("direction"))
        .groupBy("direction", "block_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def page_anchors(anchors: DataFrame, page_id: int, n: int = 100, with_block: bool = False) -> DataFrame:
    """Most used (text, kind[, block]) on links from and to one page."""
    keys = ["anchor_text", "anchor_type"] + (["block_type"] if with_block else [])
    counted = (
        _touching(anchors, page_id)
        .select(*keys, _direction(page_id).alias("direction"))
        .groupBy("direction", *keys)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    boards = [
        counted.where(F.col("direction") == d).orderBy(F.desc("count"), *keys).limit(n) for d in ("out", "in")
    ]
    return boards[0].unionByName(boards[1])


def anchor_type_mix(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("anchor_type").agg(F.count(F.lit(1)).alias("count"))


def top_anchor_texts(anchors: DataFrame, n: int = 30) -> DataFrame:
    return anchors.groupBy("anchor_text").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "anchor_text").limit(n)


def source_anchor_diversity(anchors: DataFrame) -> DataFrame:
    """One row: mean and median lexical variety of the sources, mean number of anchor kinds."""
    per_source = anchors.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("out_links"),
        n_unique("anchor_text").alias("texts"),
        n_unique("anchor_type").alias("types"),
    )
    ratios = per_source.select((F.col("texts") / F.greatest("out_links", F.lit(1))).alias("ratio"), "types")
    median = quantiles(ratios, "ratio", {}, ["median"]).scalar()
    return ratios.agg(
        F.avg("ratio").alias("mean_lexical_diversity_ratio"), F.avg("types").alias("mean_unique_anchor_types")
    ).select("mean_lexical_diversity_ratio", median.alias("median_lexical_diversity_ratio"), "mean_unique_anchor_types")
