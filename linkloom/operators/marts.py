"""URL-level and segment-level result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import page_category, segment_pieces
from linkloom.schemas import PAGE_SEGMENTS, SEGMENT_METRICS, URL_METRICS, conform

NO_VERTICAL = "_autre_"


def n_unique(column: str) -> Column:
    """Distinct values with null as one of them."""
    return F.countDistinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def link_stats(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Per page: links, weight and distinct partners in both directions."""
    out = edges.groupBy(F.col("source_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("outgoing_links"),
        F.sum("rule_weight").alias("outgoing_weight"),
        n_unique("target_id").alias("unique_out_targets"),
    )
    into = edges.groupBy(F.col("target_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("incoming_links"),
        F.sum("rule_weight").alias("incoming_weight"),
        n_unique("source_id").alias("unique_in_sources"),
    )
    joined = pages.select("page_id").join(out, "page_id", "left").join(into, "page_id", "left")
    return joined.na.fill(0).select(
        "page_id",
        F.col("outgoing_links").cast("long"),
        "outgoing_weight",
        F.col("unique_out_targets").cast("long"),
        F.col("incoming_links").cast("long"),
        "incoming_weight",
        F.col("unique_in_sources").cast("long"),
    )


def anchor_stats(candidates: DataFrame) -> DataFrame:
    """Per source page: distinct anchor texts and kinds."""
    return candidates.groupBy(F.col("source_id").alias("page_id")).agg(
        n_unique("anchor_text").cast("long").alias("unique_anchor_texts_out"),
        n_unique("anchor_type").cast("long").alias("unique_anchor_types_out"),
    )


def url_metrics(pages: DataFrame, scores: DataFrame, edges: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row per page with its scores, link statistics and anchor variety."""
    joined = pages.select("page_id", "path", "depth").join(scores, "page_id", "left")
    joined = joined.join(link_stats(pages, edges), "page_id", "left")
    if candidates is not None:
        joined = joined.join(anchor_stats(candidates), "page_id", "left")
    else:
        joined = joined.withColumn("unique_anchor_texts_out", F.lit(0)).withColumn("unique_anchor_types_out", F.lit(0))
    joined = joined.na.fill(0, ["unique_anchor_texts_out", "unique_anchor_types_out"])
    diversity = F.col("unique_anchor_texts_out") / F.greatest("outgoing_links", F.lit(1))
    return conform(joined.withColumn("lexical_diversity_out", diversity), URL_METRICS)


def page_segments(pages: DataFrame) -> DataFrame:
    """One row per prefix of each path, after a level-0 row for the root."""
    pieces = F.col("_pieces")

    def prefix(length: Column) -> Column:
        return F.concat(F.lit("/"), F.array_join(F.slice(pieces, F.lit(1), length), "/"))

    def row(level: Column, segment: Column, path: Column, parent: Column, last: Column) -> Column:
        return F.struct(
            level.cast("int").alias("level"),
            segment.alias("segment"),
            path.alias("segment_path"),
            parent.cast("string").alias("parent_segment_path"),
            last.alias("is_terminal"),
        )

    root = row(F.lit(0), F.lit("root"), F.lit("/"), F.lit(None), F.size(pieces) == 0)
    below = F.transform(pieces, lambda piece, i: row(i + 1, piece, prefix(i + 1), prefix(i), i + 1 == F.size(pieces)))
    rows = pages.select("page_id", "depth", segment_pieces(F.col("path")).alias("_pieces")).select(
        "page_id", "depth", F.explode(F.concat(F.array(root), below)).alias("row")
    )
    return conform(rows.select("page_id", "depth", "row.*"), PAGE_SEGMENTS)


def segment_metrics(segments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scores and degrees rolled up along the path hierarchy."""
    measures = metrics.select(
        "page_id",
        "pri_score",
        "cheirank_score",
        "can_give_juice",
        "is_low_power",
        "in_degree",
        "out_degree",
        "lexical_diversity_out",
    )
    rolled = (
        segments.select("page_id", "level", "segment_path", "segment")
        .join(measures, "page_id", "left")
        .groupBy("level", "segment_path", "segment")
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.coalesce(F.sum("pri_score"), F.lit(0.0)).alias("pri_sum"),
            F.avg("pri_score").alias("pri_mean"),
            F.coalesce(F.sum("cheirank_score"), F.lit(0.0)).alias("cheirank_sum"),
            F.avg("cheirank_score").alias("cheirank_mean"),
            F.avg(F.col("can_give_juice").cast("double")).alias("donor_ratio"),
            F.avg(F.col("is_low_power").cast("double")).alias("low_power_ratio"),
            F.avg("in_degree").alias("avg_in_degree"),
            F.avg("out_degree").alias("avg_out_degree"),
            F.avg("lexical_diversity_out").alias("avg_lexical_diversity_out"),
        )
    )
    return conform(rolled, SEGMENT_METRICS)


def top_segments(segments: DataFrame, level: int = 1, n: int = 20) -> DataFrame:
    """Largest segments of a level."""
    return segments.where(F.col("level") == level).orderBy(F.desc("page_count"), "segment_path").limit(n)


def url_enrich(metrics: DataFrame, pages: DataFrame, verticals: DataFrame) -> DataFrame:
    """Add template, category and vertical when the pages carry a template.

    ``verticals`` is the lookup table (category, verticale).
    """
    if not {"template", "cluster_thematique"} <= set(pages.columns):
        return metrics
    labels = pages.select("page_id", "template", page_category(F.col("cluster_thematique")).alias("category"))
    labels = labels.join(verticals.select("category", "verticale"), "category", "left").select(
        "page_id", "template", "category", F.coalesce("verticale", F.lit(NO_VERTICAL)).alias("verticale")
    )
    return metrics.join(labels, "page_id", "left")
