"""Nested URL trees (JSON objects) -> pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import segment_pieces
from linkloom.operators.ordering import dense_index
from linkloom.schemas import PAGES, conform
from linkloom.storage import cut_lineage

META_KEY = "_meta"


def _tree_path(parent: Column, key: Column) -> Column:
    piece = F.when((key == META_KEY) | key.endswith("/"), key).otherwise(F.concat(key, F.lit("/")))
    return F.concat(F.coalesce(parent, F.lit("")), piece)


def _children(nodes: DataFrame) -> DataFrame:
    """One row per key of every node (columns ``tree_id, path, node``)."""
    entry = nodes.sparkSession.tvf.variant_explode(F.col("node").outer())
    entry = entry.select(F.col("key"), F.col("value"))
    shape = F.schema_of_variant("value")
    return nodes.lateralJoin(entry).select(
        "tree_id",
        F.col("path").alias("parent_path"),
        _tree_path(F.col("path"), F.col("key")).alias("path"),
        F.col("value").alias("node"),
        (~shape.startswith("OBJECT<") | (shape == "OBJECT<>")).alias("is_leaf"),
    )


def tree_flatten(trees: DataFrame) -> DataFrame:
    """All nodes of all trees, one level of nesting per step.

    ``trees`` has ``tree_id`` and the parsed ``tree`` (variant). A node is a leaf unless it
    is a non-empty object. Equal paths, from one tree or several, all stay.
    """
    start = trees.select("tree_id", F.lit(None).cast("string").alias("path"), F.col("tree").alias("node"))
    found = None
    level = cut_lineage(_children(start))
    while True:
        rows = level.drop("node")
        found = rows if found is None else found.unionByName(rows)
        inner = level.where(~F.col("is_leaf"))
        if inner.isEmpty():
            break
        level = cut_lineage(_children(inner.select("tree_id", "path", "node")))
    pieces = segment_pieces(F.col("path"))
    section = F.coalesce(F.try_element_at(pieces, F.lit(1)), F.lit("root"))
    second = F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit("__root__"))
    return found.select(
        "tree_id",
        "path",
        "parent_path",
        F.size(pieces).cast("int").alias("depth"),
        section.alias("section"),
        F.concat_ws(":", section, second).alias("cluster_thematique"),
        "is_leaf",
    )


def merge_trees(nodes: DataFrame) -> DataFrame:
    """One row per path when a site's tree is stored as many partial trees."""
    return nodes.groupBy("path", "parent_path", "depth", "section", "cluster_thematique").agg(
        F.min("is_leaf").alias("is_leaf"), F.min("tree_id").alias("tree_id")
    )


def tree_pages(nodes: DataFrame) -> DataFrame:
    """Pages with dense ids in path order."""
    return conform(dense_index(nodes, [F.col("path"), F.col("tree_id"), F.col("is_leaf")], "page_id"), PAGES)


def tree_summary(pages: DataFrame) -> DataFrame:
    """(metric, name, count): pages, leaves, clusters and the ten largest sections."""
    totals = pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("is_leaf").alias("leaves"),
        F.countDistinct("cluster_thematique").alias("clusters"),
    ).select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("count")) for m in ("pages", "leaves", "clusters")])
        ).alias("row")
    )
    sections = pages.groupBy("section").agg(F.count(F.lit(1)).alias("count"))
    top = sections.orderBy(F.desc("count"), "section").limit(10)
    return totals.select("row.metric", F.lit("").alias("name"), "row.count").unionByName(
        top.select(F.lit("section").alias("metric"), F.col("section").alias("name"), "count")
    )
