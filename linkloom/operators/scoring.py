"""Page scores: rank, reverse rank, degrees, positions and derived flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.links import juice_score
from linkloom.operators.ordering import dense_index, quantiles
from linkloom.operators.rank_iteration import RankOptions, rank_graphs, weight_columns
from linkloom.schemas import PRI_SCORES, conform, require_columns

LOW_POWER_FRACTION = 0.10
DONOR_FRACTION = 0.90


@dataclass(frozen=True)
class ScoreOptions:
    include_block_types: list[str] | None = None
    use_weights: bool = True
    rank: RankOptions = field(default_factory=RankOptions)


def edge_block_filter(edges: DataFrame, block_types: list[str] | None) -> DataFrame:
    """Edges of the listed block types; an empty list keeps all."""
    return edges.where(F.col("block_type").isin(list(block_types))) if block_types else edges


def unknown_page_ids(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id): ends of edges that are not pages. Ends are counted once before the join, so no page is a hot key."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("page_id")).distinct()
    return ends.join(pages.select("page_id"), "page_id", "left_anti")


def edge_id_validation(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges with an end that is not a page; one scan of the edges and one join.

    Each edge meets the page table with both ends. One that misses both is found twice, and so are its
    repeats, hence the larger of the two counts is how often it occurs.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in edges.columns]).alias("edge")
    ends = F.array(
        F.struct(F.col("source_id").alias("page_id"), F.lit(False).alias("at_target")),
        F.struct(F.col("target_id").alias("page_id"), F.lit(True).alias("at_target")),
    )
    missing = edges.select(whole, F.explode(ends).alias("end")).select("edge", "end.*").join(
        pages.select("page_id"), "page_id", "left_anti"
    )
    at_target = F.count_if("at_target")
    found = missing.groupBy("edge").agg(F.greatest(at_target, F.count(F.lit(1)) - at_target).cast("int").alias("times"))
    return found.select("edge", F.explode(F.sequence(F.lit(1), F.col("times")))).select("edge.*")


def degrees(pages: DataFrame, edges: DataFrame, by: list[str] = []) -> DataFrame:
    """In- and out-degree of every page; parallel edges count, isolated pages have 0."""
    ends = edges.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("source_id").alias("page_id"), F.lit(1).alias("out"), F.lit(0).alias("into")),
                F.struct(F.col("target_id").alias("page_id"), F.lit(0).alias("out"), F.lit(1).alias("into")),
            )
        ).alias("end"),
    ).select(*by, "end.*")
    counted = ends.groupBy(*by, "page_id").agg(F.sum("out").alias("out_degree"), F.sum("into").alias("in_degree"))
    return pages.join(counted, [*by, "page_id"], "left").select(
        *by,
        "page_id",
        F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"),
        F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"),
    )


def score_ranks(scores: DataFrame, page_count: int) -> DataFrame:
    """(graph, page_id, score, rank): 1..N by score, ties by page id, for all graphs in one sort.

    Every graph scores the same N pages, so the position in the common order gives the rank.
    """
    placed = dense_index(scores, [F.col("graph"), F.desc("score"), F.col("page_id")], "_n", start=0)
    return placed.select("graph", "page_id", "score", (F.col("_n") % page_count + 1).alias("rank"))


def _nearest_position(fraction: float, count: int) -> int:
    return int(fraction * (count - 1) + 0.5)


def power_flags(scored: DataFrame, page_count: int) -> DataFrame:
    """Add ``is_low_power`` and ``can_give_juice``, thresholds per variant.

    The low-power threshold is an order statistic of the scores, hence the score of the
    page at a known rank.
    """
    low_rank = page_count - _nearest_position(LOW_POWER_FRACTION, page_count)
    low = scored.where(F.col("rank") == low_rank).select("variant", F.col("pri_score").alias("_low"))
    donors = quantiles(scored, "juice_potential_score", {"_donor": DONOR_FRACTION}, by="variant")
    return (
        scored.join(F.broadcast(low), "variant")
        .join(F.broadcast(donors), "variant")
        .withColumn("is_low_power", F.col("pri_score") <= F.col("_low"))
        .withColumn("can_give_juice", F.col("juice_potential_score") >= F.col("_donor"))
        .drop("_low", "_donor")
    )


def score_variants(pages: DataFrame, edges: DataFrame, variants: list[str], options: ScoreOptions) -> DataFrame:
    """Scores for several weightings of one site (``edges`` has ``variant``), in one loop.

    Variants are columns of the same links and of the same pages until the ranks are sorted.
    """
    nodes = pages.select("page_id")
    page_count = nodes.count()
    weight = (F.col("rule_weight") if options.use_weights else F.lit(1.0)).cast("double")
    ends = [F.col("source_id").alias("source"), F.col("target_id").alias("target")]
    weights = [F.when(F.col("variant") == name, weight) for name in variants]
    if len(variants) == 1:  # parallel links add up in the ranking, so nothing is gained by adding them up before
        links = edges.select(*ends, weights[0].alias("w0"))
    else:
        links = edges.groupBy(*ends).agg(*weight_columns(weights))
    wide = rank_graphs(nodes, links, variants, options.rank)
    graphs = [
        F.struct(F.lit(number).alias("variant_no"), F.lit(kind).alias("kind"), F.col(f"{kind}_{name}").alias("score"))
        for number, name in enumerate(variants)
        for kind in ("forward", "reverse")
    ]
    long = wide.select("page_id", F.explode(F.array(*graphs)).alias("g")).select(F.struct("g.variant_no", "g.kind").alias("graph"), "page_id", "g.score")
    ranked = score_ranks(long, page_count)
    is_forward = F.col("graph.kind") == "forward"
    placed = ranked.groupBy(F.col("graph.variant_no").alias("variant_no"), "page_id").agg(
        F.max(F.when(is_forward, F.col("score"))).alias("pri_score"),
        F.max(F.when(is_forward, F.col("rank"))).cast("long").alias("rank"),
        F.max(F.when(~is_forward, F.col("score"))).alias("cheirank_score"),
        F.max(F.when(~is_forward, F.col("rank"))).cast("long").alias("cheirank_rank"),
    )
    placed = placed.withColumn("variant", F.element_at(F.array(*[F.lit(name) for name in variants]), F.col("variant_no") + 1)).drop("variant_no")
    counted = degrees(placed.select("variant", "page_id"), edges, ["variant"])
    scored = placed.join(counted, ["variant", "page_id"]).withColumn(
        "juice_potential_score", juice_score(F.col("cheirank_score"), F.col("out_degree"))
    )
    return power_flags(scored, page_count).select("variant", *PRI_SCORES)


def compute_pri(pages: DataFrame, edges: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """The ``pri_scores`` table of one site."""
    chosen = edge_block_filter(edges, options.include_block_types)
    if not unknown_page_ids(chosen, pages).isEmpty():
        raise ValueError(f"{edge_id_validation(chosen, pages).count()} edges start or end outside the page table")
    scored = score_variants(pages, chosen.withColumn("variant", F.lit("site")), ["site"], options)
    return conform(scored, PRI_SCORES)


def score_summary(scores: DataFrame) -> DataFrame:
    """One row: sums, thresholds implied by the flags, flag counts."""
    return scores.agg(
        F.count(F.lit(1)).alias("node_count"),
        F.coalesce(F.sum("pri_score"), F.lit(0.0)).alias("pri_sum"),
        F.coalesce(F.sum("cheirank_score"), F.lit(0.0)).alias("cheirank_sum"),
        F.max(F.when(F.col("is_low_power"), F.col("pri_score"))).alias("low_power_threshold"),
        F.min(F.when(F.col("can_give_juice"), F.col("juice_potential_score"))).alias("donor_threshold"),
        F.count_if("is_low_power").alias("low_power_page_count"),
        F.count_if("can_give_juice").alias("donor_page_count"),
    )


def score_leaders(scores: DataFrame, n: int = 10) -> DataFrame:
    """(board, position, page_id, value): top pages by each of the three scores."""
    boards = None
    for board in ("pri_score", "cheirank_score", "juice_potential_score"):
        top = scores.orderBy(F.desc(board), "page_id").limit(n)
        rows = top.select(F.lit(board).alias("board"), "page_id", F.col(board).alias("value"))
        boards = rows if boards is None else boards.unionByName(rows)
    return boards


def scores_normalize(scores: DataFrame) -> DataFrame:
    """The full ``pri_scores`` contract from a table that may lack derived columns."""
    require_columns(scores, ["page_id", "pri_score"], "the score table")
    have = set(scores.columns)
    full = scores.withColumn("page_id", F.col("page_id").cast("long")).withColumn("pri_score", F.col("pri_score").cast("double"))
    if "cheirank_score" not in have:
        full = full.withColumn("cheirank_score", F.col("pri_score"))
    for name in ("out_degree", "in_degree"):
        if name not in have:
            full = full.withColumn(name, F.lit(0))
    if "juice_potential_score" not in have:
        full = full.withColumn("juice_potential_score", juice_score(F.col("cheirank_score"), F.col("out_degree")))
    for rank, score in (("rank", "pri_score"), ("cheirank_rank", "cheirank_score")):
        if rank not in have:
            full = dense_index(full, [F.desc(score), F.col("page_id")], rank)
    if "is_low_power" not in have:
        low = quantiles(full, "pri_score", {"_q": LOW_POWER_FRACTION}).scalar()
        full = full.withColumn("is_low_power", F.col("pri_score") <= low)
    if "can_give_juice" not in have:
        donor = quantiles(full, "juice_potential_score", {"_q": DONOR_FRACTION}).scalar()
        full = full.withColumn("can_give_juice", F.col("juice_potential_score") >= donor)
    return conform(full, PRI_SCORES)
