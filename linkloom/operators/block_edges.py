"""Template-driven link blocks: which page templates show which block, and what it links to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.links import expand_templates
from linkloom.functions.urls import block_category
from linkloom.operators.rule_edges import cluster_peer, hierarchy_down, hierarchy_up, parent_child_pairs, peer_lists
from linkloom.schemas import EDGES, conform
from linkloom.storage import cut_lineage

# Path mark of a region page, and the templates a footer links to.
REGION_MARK = "/rp_"
FACET_TEMPLATES = ["c_L2", "c_L3"]
FOOTER_TEMPLATES = ["dc", "c_L0", "c_L1"]


@dataclass(frozen=True)
class Block:
    weight: float
    max_links: int
    present_on: list[str]
    enabled: bool = True


@dataclass(frozen=True)
class BlockOptions:
    blocks: dict[str, Block] = field(default_factory=dict)
    max_out_links_per_page: int = 120
    enable_hierarchy_up: bool = True
    enable_hierarchy_down: bool = True
    enable_cluster_peer: bool = True
    cluster_peer_k: int = 8
    weight_hierarchy_up: float = 1.0
    weight_hierarchy_down: float = 0.7
    weight_cluster_peer: float = 0.4


def _sources(pages: DataFrame, block: Block) -> DataFrame:
    return pages.where(F.col("template").isin(expand_templates(block.present_on)))


def _edges(pairs: DataFrame, name: str, block: Block) -> DataFrame:
    return pairs.select(
        "source_id",
        "target_id",
        F.lit(name).alias("block_type"),
        F.lit(float(block.weight)).cast("float").alias("rule_weight"),
    )


def block_breadcrumb(pages: DataFrame, block: Block) -> DataFrame:
    """Pages with the block link to their direct parent."""
    parents = pages.select(F.col("path").alias("parent_path"), F.col("page_id").alias("target_id"))
    pairs = _sources(pages, block).select(F.col("page_id").alias("source_id"), "parent_path").join(parents, "parent_path")
    return _edges(pairs, "breadcrumb", block)


def category_links(pages: DataFrame, name: str, block: Block, is_target: Column) -> DataFrame:
    """Pages with the block link to the first ``max_links`` targets (by id) of their category.

    The chosen targets are one short array per category, so the join carries one row per
    source and a very large category only has many sources (AQE splits those).
    """
    category = block_category(F.col("cluster_thematique")).alias("category")
    order = Window.partitionBy("category").orderBy("page_id")
    chosen = (
        pages.where(is_target)
        .select(category, "page_id")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= block.max_links)
        .groupBy("category")
        .agg(F.collect_list("page_id").alias("targets"))
    )
    pairs = (
        _sources(pages, block)
        .select(F.col("page_id").alias("source_id"), category)
        .join(chosen, "category")
        .select("source_id", F.explode("targets").alias("target_id"))
    )
    return _edges(pairs, name, block)


def _region_page() -> Column:
    return (F.col("template") == "cl") & F.col("path").contains(REGION_MARK)


def block_top_facets(pages: DataFrame, block: Block) -> DataFrame:
    return category_links(pages, "seo_top_filters", block, TARGET_PAGES["seo_top_filters"]())


def block_top_searches(pages: DataFrame, block: Block) -> DataFrame:
    return category_links(pages, "top_searches", block, TARGET_PAGES["top_searches"]())


def block_top_locations(pages: DataFrame, block: Block) -> DataFrame:
    return category_links(pages, "top_locations", block, TARGET_PAGES["top_locations"]())


def block_cross_links(pages: DataFrame, block: Block) -> DataFrame:
    return category_links(pages, "box_top_filters", block, TARGET_PAGES["box_top_filters"]())


def block_footer(pages: DataFrame, block: Block) -> DataFrame:
    """Every page links to the same first ``max_links`` footer pages.

    The footer is one array of at most ``max_links`` ids, read as a scalar subquery.
    """
    footer = (
        pages.where(F.col("template").isin(FOOTER_TEMPLATES)).select("page_id").orderBy("page_id").limit(block.max_links)
    )
    targets = footer.agg(F.collect_list("page_id").alias("targets")).scalar()
    pairs = pages.select(F.col("page_id").alias("source_id"), targets.alias("targets")).select(
        "source_id", F.explode("targets").alias("target_id")
    )
    return _edges(pairs.where(F.col("source_id") != F.col("target_id")), "footer_corporate", block)


def block_hierarchy(pages: DataFrame, weight_up: float | None = 1.0, weight_down: float | None = 0.7) -> DataFrame:
    """Links between parents and children, upwards and/or downwards."""
    pairs = parent_child_pairs(pages)
    if weight_up is None:
        return hierarchy_down(pairs, weight_down)
    if weight_down is None:
        return hierarchy_up(pairs, weight_up)
    return hierarchy_up(pairs, weight_up).unionByName(hierarchy_down(pairs, weight_down))


# Blocks whose targets are the first pages of a kind in the source's category.
TARGET_PAGES: dict[str, Callable[[], Column]] = {
    "seo_top_filters": lambda: F.col("template").isin(FACET_TEMPLATES),
    "top_searches": lambda: F.col("template") == "ck",
    "top_locations": _region_page,
    "box_top_filters": _region_page,
}
# Block names as configured, and the operator behind each.
BLOCK_BUILDERS = {
    "breadcrumb": block_breadcrumb,
    "seo_top_filters": block_top_facets,
    "top_searches": block_top_searches,
    "top_locations": block_top_locations,
    "box_top_filters": block_cross_links,
    "footer_corporate": block_footer,
}


def all_block_links(pages: DataFrame, options: BlockOptions) -> DataFrame:
    """Links of all enabled blocks and rules, one row per block that makes them."""
    parts = [
        build(pages, options.blocks[name])
        for name, build in BLOCK_BUILDERS.items()
        if name in options.blocks and options.blocks[name].enabled
    ]
    up = options.weight_hierarchy_up if options.enable_hierarchy_up else None
    down = options.weight_hierarchy_down if options.enable_hierarchy_down else None
    if up is not None or down is not None:
        parts.append(block_hierarchy(pages, up, down))
    if options.enable_cluster_peer and options.cluster_peer_k > 0:
        parts.append(cluster_peer(pages, options.cluster_peer_k, options.weight_cluster_peer))
    if not parts:
        return block_hierarchy(pages).limit(0)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def block_dedup_cap(links: DataFrame, max_out_links_per_page: int = 120) -> DataFrame:
    """One edge per page pair, named after its heaviest block; strongest out-links kept."""
    merged = (
        links.where(F.col("source_id") != F.col("target_id"))
        .groupBy("source_id", "target_id")
        .agg(
            F.sum("rule_weight").cast("float").alias("rule_weight"),
            F.min_by("block_type", F.struct((-F.col("rule_weight")).alias("weight"), "block_type")).alias("block_type"),
        )
    )
    if max_out_links_per_page > 0:
        order = Window.partitionBy("source_id").orderBy(F.desc("rule_weight"), "target_id")
        merged = merged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_out_links_per_page)
    return conform(merged, EDGES)


def build_block_edges(pages: DataFrame, options: BlockOptions) -> DataFrame:
    """All enabled blocks and rules, merged and capped."""
    if options.max_out_links_per_page <= 0:  # a page may keep any number of links, so these can't be lists
        return block_dedup_cap(all_block_links(pages, options), 0)
    return _capped_in_place(pages, options)


def _enabled(options: BlockOptions) -> dict[str, Block]:
    """Everything that makes links, as blocks, in the order of ``min_by(block_type, (-weight, block_type))``."""
    found = {name: options.blocks[name] for name in BLOCK_BUILDERS if name in options.blocks and options.blocks[name].enabled}
    if options.enable_hierarchy_up:
        found["hierarchy_up"] = Block(options.weight_hierarchy_up, 1, [])
    if options.enable_hierarchy_down:
        found["hierarchy_down"] = Block(options.weight_hierarchy_down, 0, [])
    if options.enable_cluster_peer and options.cluster_peer_k > 0:
        found["cluster_peer"] = Block(options.weight_cluster_peer, options.cluster_peer_k, [])
    return dict(sorted(found.items(), key=lambda item: (-np.float32(item[1].weight), item[0])))


def _links_to(number: int, targets: Column) -> Column:
    """Array of (block number, target) from an array of target ids."""
    return F.transform(targets, lambda t: F.struct(F.lit(number).cast("byte").alias("block"), t.alias("target_id")))


def _capped_in_place(pages: DataFrame, options: BlockOptions) -> DataFrame:
    """Edges of all blocks from one row per source page that holds its targets as short lists.

    Pages are laid out by id once. A list is as long as its block's limit; the footer is a constant, category lists come a
    row a category. Links are made, merged by target and capped without leaving the page's task. Of a page's children only
    the first ones by id can be kept for being children alone, as these weigh the same: as many as the cap and all lists
    together. Whether another target is a child too is told by its parent, which the lists carry.
    """
    blocks = _enabled(options)
    number = {name: place for place, name in enumerate(blocks)}
    parents = pages.select(F.col("path").alias("parent_path"), F.col("page_id").alias("parent_id"), F.col("parent_path").alias("grand_path"))
    known = pages.select("page_id", "path", "parent_path", "template", "cluster_thematique").join(parents, "parent_path", "left")
    known = cut_lineage(
        known.select(
            "page_id", "path", "template", "cluster_thematique", "parent_id", (F.col("grand_path") == F.col("path")).alias("mutual"),
            block_category(F.col("cluster_thematique")).alias("category"),
        )
    )
    target = F.struct(F.col("page_id").alias("id"), F.col("parent_id").alias("parent"))
    rows = known.select("page_id", "template", "category", "parent_id", "mutual")

    category_blocks = [name for name in TARGET_PAGES if name in blocks]
    if category_blocks:
        lists = [_first_targets(known, name, blocks[name].max_links, target) for name in category_blocks]
        by_category = reduce(lambda left, right: left.join(right, "category", "full"), lists)
        rows = rows.join(by_category, "category", "left")
    if "cluster_peer" in blocks:
        peers = peer_lists(known.select("cluster_thematique", "page_id", "parent_id"), options.cluster_peer_k, target)
        rows = rows.join(peers.select("page_id", F.col("peers").alias("cluster_peer")), "page_id", "left")
    if "hierarchy_down" in blocks:
        enough = options.max_out_links_per_page + sum(max(0, block.max_links) for block in blocks.values()) + 1
        order = Window.partitionBy("parent_id").orderBy("page_id")
        first = known.where("parent_id is not null").select("parent_id", "page_id").withColumn("_n", F.row_number().over(order))
        children = first.where(F.col("_n") <= enough).groupBy("parent_id").agg(F.collect_list("page_id").alias("children"))
        rows = rows.join(children.withColumnRenamed("parent_id", "_parent"), F.col("page_id") == F.col("_parent"), "left").drop("_parent")

    if "footer_corporate" in blocks:
        footer = known.where(F.col("template").isin(FOOTER_TEMPLATES)).select(target.alias("t")).orderBy("t.id").limit(blocks["footer_corporate"].max_links)
        rows = rows.withColumn("footer_corporate", footer.agg(F.collect_list("t")).scalar())

    def listed(name: str) -> Column:
        """The block's targets (id, parent) on a page that shows it."""
        if name in category_blocks:
            return F.when(F.col("template").isin(expand_templates(blocks[name].present_on)), F.col(name))
        parent = F.array(F.struct(F.col("parent_id").alias("id"), F.lit(None).cast("long").alias("parent")))
        if name == "breadcrumb":
            return F.when(F.col("parent_id").isNotNull() & F.col("template").isin(expand_templates(blocks[name].present_on)), parent)
        if name == "hierarchy_up":
            return F.when(F.col("parent_id").isNotNull(), parent)
        return F.col(name)

    empty = F.array().cast("array<struct<block:tinyint,target_id:bigint>>")
    parts, others = [], []
    for name in blocks:
        if name != "hierarchy_down":
            targets = listed(name)
            others.append(targets)
            parts.append(F.coalesce(_links_to(number[name], F.transform(targets, lambda t: t["id"])), empty))
    if "hierarchy_down" in blocks:
        down = number["hierarchy_down"]
        none = F.array().cast("array<bigint>")
        own = [F.transform(F.filter(t, lambda x: x["parent"] == F.col("page_id")), lambda x: x["id"]) for t in others]
        mutual = F.when(F.coalesce("mutual", F.lit(False)), F.array("parent_id")).otherwise(none)
        every = F.array_distinct(F.concat(F.coalesce("children", none), mutual, *[F.coalesce(ids, none) for ids in own]))
        parts.append(_links_to(down, every))
    if not parts:
        return block_dedup_cap(all_block_links(pages, options), options.max_out_links_per_page)
    links = rows.select(F.col("page_id").alias("source_id"), F.explode(F.concat(*parts)).alias("l")).select("source_id", "l.*")
    weights = F.array(*[F.lit(float(np.float32(block.weight))) for block in blocks.values()])
    names = F.array(*[F.lit(name) for name in blocks])
    merged = (
        links.where(F.col("source_id") != F.col("target_id"))
        .groupBy("source_id", "target_id")
        .agg(F.sum(F.element_at(weights, F.col("block") + 1)).cast("float").alias("rule_weight"), F.min("block").alias("block"))
    )
    order = Window.partitionBy("source_id").orderBy(F.desc("rule_weight"), "target_id")
    kept = merged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= options.max_out_links_per_page)
    return conform(kept.withColumn("block_type", F.element_at(names, F.col("block") + 1)), EDGES)


def _first_targets(pages: DataFrame, name: str, limit: int, target: Column) -> DataFrame:
    """(category, <block name>): the first targets of the block, by id, in each category."""
    order = Window.partitionBy("category").orderBy("page_id")
    chosen = pages.where(TARGET_PAGES[name]()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return chosen.groupBy("category").agg(F.collect_list(target).alias(name))


def block_summary(edges: DataFrame) -> DataFrame:
    """(metric, name, count): edges and block mix."""
    count = F.count(F.lit(1)).alias("count")
    return edges.agg(count).select(F.lit("edges").alias("metric"), F.lit("").alias("name"), "count").unionByName(
        edges.groupBy("block_type").agg(count).select(F.lit("block_type").alias("metric"), F.col("block_type").alias("name"), "count")
    )
