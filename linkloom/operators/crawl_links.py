"""Crawl export (one row per hyperlink) -> pages, weighted edges, anchor candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.anchors import (
    ANCHOR_TYPES,
    anchor_lexical_normal,
    anchor_token_count,
    classify_anchor,
    label_from_path,
    lexical_of,
)
from linkloom.functions.links import TRUE_WORDS, block_rule_weight, block_type_of
from linkloom.functions.text import null_if_empty, or_empty, strip_space
from linkloom.functions.urls import after_scheme, authority, host_of, or_root, parent_path, path_cluster, path_depth, path_of, path_section
from linkloom.operators.ordering import dense_index
from linkloom.schemas import ANCHOR_CANDIDATES, EDGES, PAGES, conform

RAW_LINKS = ["type", "from_url", "to_url", "anchor_text", "alt_text", "follow", "status_code", "link_position"]


@dataclass(frozen=True)
class CrawlOptions:
    source_host: str | None = None
    max_out_links_per_page: int = 120


def links_normalized(raw: DataFrame) -> DataFrame:
    """Typed, cleaned view of the raw link rows (all strings).

    Step by step, each on the columns of the one before: expressions that use a value several times would else hold its making
    as often, and outgrow what can be compiled.
    """
    texts = raw.select(*[F.trim(F.col(name)).alias(name) for name in RAW_LINKS])
    texts = texts.select(*[strip_space(F.col(name)).alias(name) for name in RAW_LINKS])
    split = texts.select(
        F.lower(or_empty(F.col("type"))).alias("link_type"),
        after_scheme(F.col("from_url")).alias("from_rest"),
        after_scheme(F.col("to_url")).alias("to_rest"),
        F.lower(or_empty(F.col("link_position"))).alias("position"),
        F.lower(or_empty(F.col("follow"))).isin(TRUE_WORDS).alias("is_follow"),
        F.col("status_code").try_cast("int").alias("status_code"),
        F.coalesce(null_if_empty(F.col("anchor_text")), null_if_empty(F.col("alt_text"))).alias("text"),
    )
    hosts = split.select("*", authority(F.col("from_rest")).alias("from_site"), authority(F.col("to_rest")).alias("to_site"))
    paths = hosts.select(
        "*",
        path_of(F.col("from_rest"), F.col("from_site")).alias("from_tail"),
        path_of(F.col("to_rest"), F.col("to_site")).alias("to_tail"),
    )
    links = paths.select(
        "link_type",
        host_of(F.col("from_site")).alias("from_host"),
        host_of(F.col("to_site")).alias("to_host"),
        or_root(F.col("from_tail")).alias("from_path"),
        or_root(F.col("to_tail")).alias("to_path"),
        block_type_of(F.col("position")).alias("block_type"),
        "is_follow",
        "status_code",
        "text",
    )
    return links.select("*", F.coalesce("text", label_from_path(F.col("to_path"))).alias("anchor_text")).drop("text")


def _between_pages() -> Column:
    """Whether a normalised row is a followed, working hyperlink between two different pages of its own host."""
    return (
        (F.col("link_type") == "hyperlink")
        & (F.col("status_code") == 200)
        & F.col("is_follow")
        & (F.col("from_host") == F.col("to_host"))
        & (F.col("from_path") != F.col("to_path"))
    )


def host_links(normalized: DataFrame) -> DataFrame:
    """(from_host, link, instances): each host's distinct links with their number, in one pass over the rows.

    ``link`` is null for rows that are no link between two pages of the host; those are one row a host, so
    the instances of a host add up to all its rows and tell the most frequent host. Equal rows are
    counted in the tasks first.
    """
    link = F.when(_between_pages(), F.struct("from_path", "to_path", "block_type", "anchor_text"))
    return normalized.groupBy("from_host", link.alias("link")).agg(F.count(F.lit(1)).alias("instances"))


def _most_frequent_host(counted: DataFrame) -> DataFrame:
    return counted.where(F.col("from_host").isNotNull()).orderBy(F.desc("link_count"), "from_host").limit(1)


def infer_source_host(normalized: DataFrame) -> DataFrame:
    """One row: the most frequent source host over all rows, ties by name."""
    return _most_frequent_host(normalized.groupBy("from_host").agg(F.count(F.lit(1)).alias("link_count")))


def source_host(by_host: DataFrame, override: str | None = None) -> str:
    """The host to analyse, from the counted links of ``host_links``."""
    if override:
        return override.strip().lower()
    found = _most_frequent_host(by_host.groupBy("from_host").agg(F.sum("instances").alias("link_count"))).first()
    if found is None:
        raise ValueError("no http(s) source host in the crawl links")
    return found["from_host"]


def links_internal_follow(normalized: DataFrame, host: str) -> DataFrame:
    """Followed, working hyperlinks between two different pages of the host."""
    return normalized.where(_between_pages() & (F.col("from_host") == host)).select("from_path", "to_path", "block_type", "anchor_text")


def link_groups(by_host: DataFrame, host: str) -> DataFrame:
    """The host's distinct links with their number, from ``host_links``; edges and anchors only need the counts."""
    return by_host.where((F.col("from_host") == host) & F.col("link").isNotNull()).select("link.*", "instances")


def pages_from_links(groups: DataFrame) -> DataFrame:
    """Every path seen on either end, with dense ids in path order."""
    ends = groups.select(
        F.explode(
            F.array(
                F.struct(F.col("from_path").alias("path"), F.lit(True).alias("has_out")),
                F.struct(F.col("to_path").alias("path"), F.lit(False).alias("has_out")),
            )
        ).alias("end")
    ).select("end.*")
    paths = ends.groupBy("path").agg(F.max("has_out").alias("has_out"))
    path = F.col("path")
    numbered = dense_index(paths, [path], "page_id")
    return conform(
        numbered.select(
            "page_id",
            "path",
            parent_path(path).alias("parent_path"),
            path_depth(path).alias("depth"),
            path_section(path).alias("section"),
            path_cluster(path).alias("cluster_thematique"),
            (~F.col("has_out")).alias("is_leaf"),
        ),
        PAGES,
    )


def link_id_lookup(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Page ids for both ends of every link group, the weight of one link of its block, the target's label.

    The label's lexical form is made once a page, before the join.
    """
    sources = pages.select(F.col("path").alias("from_path"), F.col("page_id").alias("source_id"))
    targets = pages.select(
        F.col("path").alias("to_path"),
        F.col("page_id").alias("target_id"),
        anchor_lexical_normal(label_from_path(F.col("path"))).alias("target_label"),
    )
    return (
        groups.join(sources, "from_path")
        .join(targets, "to_path")
        .select(
            "source_id",
            "target_id",
            "block_type",
            block_rule_weight(F.col("block_type")).alias("base_weight"),
            "anchor_text",
            "to_path",
            "target_label",
            "instances",
        )
    )


EDGE_KEY = ["source_id", "target_id", "block_type"]


def _edge_weight() -> Column:
    return F.sum(F.col("base_weight").cast("double") * F.col("instances"))


def link_edges_agg(identified: DataFrame) -> DataFrame:
    """Summed weight per (source, target, block); repeated links add up."""
    return conform(identified.groupBy(*EDGE_KEY).agg(_edge_weight().alias("rule_weight")), EDGES)


def link_edges_topk(edges: DataFrame, max_out_links_per_page: int = 120) -> DataFrame:
    """The strongest out-links of each page; 0 or less keeps all. Other columns stay.

    Spark drops what is beyond the limit in each task before it shuffles, so a page of any number of links is a
    few rows a task.
    """
    if max_out_links_per_page <= 0:
        return edges
    order = Window.partitionBy("source_id").orderBy(F.desc("rule_weight"), "target_id", "block_type")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_out_links_per_page).drop("_n")


def _with_kind(identified: DataFrame) -> DataFrame:
    """Adds anchor_type, in steps on columns of their own."""
    lower = identified.withColumn("_lower", F.lower("anchor_text"))
    normal = lower.withColumn("_normal", lexical_of(F.col("_lower")))
    return normal.withColumn("anchor_type", classify_anchor(F.col("_normal"), F.col("target_label"))).drop("_lower", "_normal")


def anchor_text_counts(identified: DataFrame) -> DataFrame:
    """Uses of each anchor text per edge and anchor kind. All links of one edge weigh the same.

    Rows of ``identified`` are distinct links with their number, and the kind follows from text and target,
    so each row is a count already.
    """
    return _with_kind(identified).select(
        *EDGE_KEY,
        "anchor_type",
        "anchor_text",
        F.col("instances").alias("anchor_instances"),
        F.col("base_weight").alias("rule_weight"),
        anchor_token_count(F.col("anchor_text")).alias("anchor_token_count"),
    )


def _rank_of_text(instances: str) -> Column:
    """Orders texts by use, ties by text: the least one is the most used."""
    return F.struct((-F.col(instances)).alias("uses"), F.col("anchor_text").alias("text"))


def anchor_top_text(counts: DataFrame) -> DataFrame:
    """Most used text per edge and anchor kind, ties by text: one least value, combined in the tasks first."""
    best = counts.groupBy(*EDGE_KEY, "anchor_type").agg(F.min(_rank_of_text("anchor_instances")).alias("best"), F.max("rule_weight").alias("rule_weight"))
    return best.select(
        *EDGE_KEY,
        "anchor_type",
        F.col("best.text").alias("anchor_text"),
        (-F.col("best.uses")).alias("anchor_instances"),
        "rule_weight",
        anchor_token_count(F.col("best.text")).alias("anchor_token_count"),
    )


def anchor_candidates_links(top_texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates of the edges that survived the out-link cap."""
    return conform(top_texts.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_semi"), ANCHOR_CANDIDATES)


def edge_profiles(identified: DataFrame) -> DataFrame:
    """Edges with the most used anchor text of each kind, from one grouping by (source, target, block).

    ``rule_weight`` is the edge's, ``base_weight`` one link's, and a column per anchor kind holds the best
    text, null if the edge has none of it. Edges and candidates are both read off these rows.
    Best texts are aggregated by sorting, and few rows of an edge meet before the shuffle, so rows are sorted behind it only.
    """
    kinds = _with_kind(identified).select(*EDGE_KEY, "anchor_type", "anchor_text", "base_weight", "instances").repartition(*EDGE_KEY)
    best = [F.min(F.when(F.col("anchor_type") == kind, _rank_of_text("instances"))).alias(kind) for kind in ANCHOR_TYPES]
    rows = kinds.groupBy(*EDGE_KEY).agg(_edge_weight().cast("float").alias("rule_weight"), F.max("base_weight").alias("base_weight"), *best)
    return rows.select(*EDGE_KEY, "rule_weight", "base_weight", *[F.col(kind)["text"].alias(kind) for kind in ANCHOR_TYPES])


def profile_edges(profiles: DataFrame) -> DataFrame:
    return conform(profiles, EDGES)


def profile_candidates(profiles: DataFrame) -> DataFrame:
    """Anchor candidates of ``edge_profiles`` rows: no join and no shuffle."""
    texts = [F.struct(F.lit(kind).alias("anchor_type"), F.col(kind).alias("anchor_text")) for kind in ANCHOR_TYPES]
    rows = profiles.select(*EDGE_KEY, F.col("base_weight").alias("rule_weight"), F.explode(F.array(*texts)).alias("c"))
    rows = rows.where("c.anchor_text is not null").select(*EDGE_KEY, "rule_weight", "c.*")
    return conform(rows.withColumn("anchor_token_count", anchor_token_count(F.col("anchor_text"))), ANCHOR_CANDIDATES)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def links_summary(raw: DataFrame, groups: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(metric, name, count): row counts, block mix and anchor mix of one crawl."""

    def single(df: DataFrame, metric: str, count=F.count(F.lit(1))) -> DataFrame:
        return df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("count")).select(
            F.lit(metric).alias("metric"), F.lit("").alias("name"), "count"
        )

    def mix(df: DataFrame, column: str) -> DataFrame:
        return counts_by(df, column).select(F.lit(column).alias("metric"), F.col(column).alias("name"), "count")

    return (
        single(raw, "raw_rows")
        .unionByName(single(groups, "kept_rows", F.sum("instances")))
        .unionByName(single(edges, "edges"))
        .unionByName(single(candidates, "anchor_candidates"))
        .unionByName(mix(edges, "block_type"))
        .unionByName(mix(candidates, "anchor_type"))
    )
