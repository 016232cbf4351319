"""The reference work flows, stage by stage, over a workspace folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import anchors as an
from linkloom.operators import crawl_links as cl
from linkloom.operators import marts
from linkloom.operators.block_edges import BlockOptions, build_block_edges
from linkloom.operators.rule_edges import RuleOptions, build_rule_edges
from linkloom.operators.scoring import ScoreOptions, compute_pri
from linkloom.operators.url_tree import tree_flatten, tree_pages
from linkloom.sources.workspace import Workspace, run_log_append


@dataclass(frozen=True)
class RunOptions:
    crawl: cl.CrawlOptions = field(default_factory=cl.CrawlOptions)
    rules: RuleOptions = field(default_factory=RuleOptions)
    score: ScoreOptions = field(default_factory=ScoreOptions)


def prepare_crawl(raw: DataFrame, workspace: Workspace, options: RunOptions = RunOptions()) -> None:
    """Raw links -> ``host_links``, ``pages``, ``edge_profiles``, ``edges``, ``anchor_candidates``.

    The raw rows are read once: their distinct links are counted per host, which also tells the host.
    Edges and candidates come from one grouping of these by (source, target, block).
    """
    by_host = workspace.write("host_links", cl.host_links(cl.links_normalized(raw)))
    groups = cl.link_groups(by_host, cl.source_host(by_host, options.crawl.source_host))
    pages = workspace.write("pages", cl.pages_from_links(groups))
    profiles = cl.edge_profiles(cl.link_id_lookup(groups, pages))
    profiles = workspace.write("edge_profiles", cl.link_edges_topk(profiles, options.crawl.max_out_links_per_page))
    workspace.write("edges", cl.profile_edges(profiles))
    workspace.write("anchor_candidates", cl.profile_candidates(profiles))


def score_site(workspace: Workspace, options: RunOptions = RunOptions()) -> None:
    workspace.write("pri_scores", compute_pri(workspace.read("pages"), workspace.read("edges"), options.score))


def build_marts(workspace: Workspace) -> None:
    """``url_metrics``, ``page_segments``, ``segment_metrics``."""
    pages = workspace.read("pages")
    candidates = workspace.read("anchor_candidates") if workspace.has("anchor_candidates") else None
    metrics = workspace.write(
        "url_metrics", marts.url_metrics(pages, workspace.read("pri_scores"), workspace.read("edges"), candidates)
    )
    segments = workspace.write("page_segments", marts.page_segments(pages))
    workspace.write("segment_metrics", marts.segment_metrics(segments, metrics))


def model_scenarios(workspace: Workspace, options: RunOptions = RunOptions()) -> None:
    """``scenario_edges``, ``scenario_pri``, ``scenario_comparison``; makes candidates if there are none."""
    pages = workspace.read("pages")
    if not workspace.has("anchor_candidates"):
        base = an.anchor_base(workspace.read("edges"), pages)
        workspace.write("anchor_candidates", an.anchor_candidates_rules(base))
    edges = an.scenario_edges(workspace.read("anchor_candidates"))
    edges = workspace.write("scenario_edges", edges, partition_by=["scenario"])
    scores = workspace.write("scenario_pri", an.scenario_pri(pages, edges, options.score), partition_by=["scenario"])
    workspace.write("scenario_comparison", an.scenario_comparison(scores))


def analyse_crawl(raw: DataFrame, workspace: Workspace, options: RunOptions = RunOptions(), scenarios: bool = True) -> None:
    """Crawl export to scores, marts and scenarios."""
    prepare_crawl(raw, workspace, options)
    score_site(workspace, options)
    build_marts(workspace)
    if scenarios:
        model_scenarios(workspace, options)


def analyse_tree(trees: DataFrame, workspace: Workspace, options: RunOptions = RunOptions()) -> None:
    """URL tree to rule-based edges, scores and marts."""
    pages = workspace.write("pages", tree_pages(tree_flatten(trees)))
    workspace.write("edges", build_rule_edges(pages, options.rules))
    score_site(workspace, options)
    build_marts(workspace)


def analyse_templates(
    pages: DataFrame, workspace: Workspace, blocks: BlockOptions, options: RunOptions = RunOptions()
) -> None:
    """Template pages to block-based edges, scores and marts."""
    pages = workspace.write("pages", pages)
    workspace.write("edges", build_block_edges(pages, blocks))
    score_site(workspace, options)
    build_marts(workspace)


def run_record(workspace: Workspace, run_id: str, timestamp: str, seconds: float, options: RunOptions) -> DataFrame:
    """One row that sums up a finished run."""
    edge_count = workspace.read("edges").agg(F.count(F.lit(1))).scalar()
    page_count = workspace.read("pages").agg(F.count(F.lit(1))).scalar()
    blocks = ",".join(options.score.include_block_types or [])
    return workspace.read("pri_scores").agg(F.sum("pri_score").alias("pri_sum")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(timestamp).alias("timestamp"),
        F.lit(workspace.folder).alias("workspace"),
        page_count.alias("page_count"),
        edge_count.alias("edge_count"),
        "pri_sum",
        F.lit(float(seconds)).alias("duration_seconds"),
        F.lit(options.score.rank.damping).alias("damping"),
        F.lit(blocks).alias("included_block_types"),
        F.lit(options.rules.max_out_links_per_page).alias("max_out_links_per_page"),
        F.lit(options.rules.cluster_peer_k).alias("cluster_peer_k"),
    )


def log_run(workspace: Workspace, log_path: str, record: DataFrame) -> DataFrame:
    return run_log_append(workspace.spark, log_path, record)
