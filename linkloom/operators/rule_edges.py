"""Rule-based links over a page table: parent/child links and neighbours in a cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.ordering import dense_index
from linkloom.schemas import EDGES, conform

# Order in which the rules fill a page's out-links.
PRIORITY = {"hierarchy_up": 0, "hierarchy_down": 1, "cluster_peer": 2}

ROWS_PER_STRETCH = 100_000


@dataclass(frozen=True)
class RuleOptions:
    enable_hierarchy_up: bool = True
    enable_hierarchy_down: bool = True
    enable_cluster_peer: bool = True
    cluster_peer_k: int = 8
    max_out_links_per_page: int = 40
    weight_hierarchy_up: float = 1.0
    weight_hierarchy_down: float = 0.7
    weight_cluster_peer: float = 0.4


def parent_child_pairs(pages: DataFrame) -> DataFrame:
    """(child_id, parent_id) where the parent is a page of the table too."""
    parents = pages.select(F.col("path").alias("parent_path"), F.col("page_id").alias("parent_id"))
    children = pages.where(F.col("parent_path").isNotNull()).select(F.col("page_id").alias("child_id"), "parent_path")
    return children.join(parents, "parent_path").select("child_id", "parent_id")


def _as_edges(pairs: DataFrame, source: str, target: str, block: str, weight: float) -> DataFrame:
    return pairs.select(
        F.col(source).alias("source_id"),
        F.col(target).alias("target_id"),
        F.lit(block).alias("block_type"),
        F.lit(float(weight)).cast("float").alias("rule_weight"),
    )


def hierarchy_up(pairs: DataFrame, weight: float = 1.0) -> DataFrame:
    return _as_edges(pairs, "child_id", "parent_id", "hierarchy_up", weight)


def hierarchy_down(pairs: DataFrame, weight: float = 0.7) -> DataFrame:
    return _as_edges(pairs, "parent_id", "child_id", "hierarchy_down", weight)


def peer_lists(pages: DataFrame, k: int, peer: Column, stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """(page_id, peers): the next k pages (by id) of each page's cluster, no wrap-around, as ``peer`` values.

    A cluster may be any size, so the window runs over stretches of the global
    (cluster, page) order. The first k rows of a stretch are repeated at the end of the
    previous one, which gives every row its k successors.
    """
    placed = dense_index(pages, [F.col("cluster_thematique"), F.col("page_id")], "_n", start=0)
    stretch = max(stretch, k)
    own = F.floor(F.col("_n") / stretch)
    ahead = (F.col("_n") % stretch < k) & (own > 0)
    spread = placed.withColumn(
        "_stretch", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own)))
    )
    order = Window.partitionBy("_stretch").orderBy("_n")
    following = [F.lead(F.struct("cluster_thematique", peer.alias("peer")), step).over(order) for step in range(1, k + 1)]
    rows = spread.select("*", F.array(*following).alias("_next")).where(F.col("_stretch") == F.floor(F.col("_n") / stretch))
    same = F.filter("_next", lambda p: p["cluster_thematique"] == F.col("cluster_thematique"))
    return rows.select("page_id", F.transform(same, lambda p: p["peer"]).alias("peers"))


def cluster_peer(pages: DataFrame, k: int = 8, weight: float = 0.4, stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """Each page links to the next k pages (by id) of its cluster; no wrap-around."""
    lists = peer_lists(pages.select("cluster_thematique", "page_id"), k, F.col("page_id"), stretch)
    return _as_edges(lists.select("page_id", F.explode("peers").alias("peer_id")), "page_id", "peer_id", "cluster_peer", weight)


def edge_dedup_priority(edges: DataFrame) -> DataFrame:
    """One edge per page pair: weights add up, the rule with the lowest priority names it."""
    priority = F.lit(None).cast("int")
    for block, value in PRIORITY.items():
        priority = F.when(F.col("block_type") == block, F.lit(value)).otherwise(priority)
    return (
        edges.where(F.col("source_id") != F.col("target_id"))
        .withColumn("priority", priority)
        .groupBy("source_id", "target_id")
        .agg(
            F.sum("rule_weight").cast("float").alias("rule_weight"),
            F.min("priority").cast("tinyint").alias("priority"),
            F.min_by("block_type", F.struct("priority", "block_type")).alias("block_type"),
        )
        .select("source_id", "target_id", "block_type", "rule_weight", "priority")
    )


def edge_cap_priority(edges: DataFrame, max_out_links_per_page: int = 40) -> DataFrame:
    """First out-links of each page by priority, weight, target; 0 or less keeps all."""
    if max_out_links_per_page > 0:
        order = Window.partitionBy("source_id").orderBy("priority", F.desc("rule_weight"), "target_id")
        edges = edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_out_links_per_page)
    return conform(edges, EDGES)


def build_rule_edges(pages: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """All enabled rules, merged and capped."""
    parts = []
    pairs = parent_child_pairs(pages)
    if options.enable_hierarchy_up:
        parts.append(hierarchy_up(pairs, options.weight_hierarchy_up))
    if options.enable_hierarchy_down:
        parts.append(hierarchy_down(pairs, options.weight_hierarchy_down))
    if options.enable_cluster_peer and options.cluster_peer_k > 0:
        parts.append(cluster_peer(pages, options.cluster_peer_k, options.weight_cluster_peer))
    if not parts:
        return conform(hierarchy_up(pairs).limit(0), EDGES)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return edge_cap_priority(edge_dedup_priority(merged), options.max_out_links_per_page)


def edges_summary(edges: DataFrame) -> DataFrame:
    """(metric, name, count): edges, block mix, largest out-degree."""
    mix = edges.groupBy("block_type").agg(F.count(F.lit(1)).alias("count"))
    degree = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("count"))
    total = edges.agg(F.count(F.lit(1)).alias("count"))
    return (
        total.select(F.lit("edges").alias("metric"), F.lit("").alias("name"), "count")
        .unionByName(degree.select(F.lit("max_out_degree").alias("metric"), F.lit("").alias("name"), "count"))
        .unionByName(mix.select(F.lit("block_type").alias("metric"), F.col("block_type").alias("name"), "count"))
    )
