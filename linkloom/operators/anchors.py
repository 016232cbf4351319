"""Anchor candidates for edges without observed anchors, and anchor-mix scenarios."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.anchors import (
    ANCHOR_TYPES,
    GENERIC_TEXT,
    anchor_token_count,
    anchor_type_choice,
    label_from_path,
    scenario_selector,
)
from linkloom.operators.scoring import ScoreOptions, score_variants
from linkloom.schemas import ANCHOR_CANDIDATES, SCENARIO_EDGES, conform, require_columns

# Texts of generated candidates.
CONTEXT_PREFIX = "Voir "
MISSING_TEXT = "Découvrir"


@dataclass(frozen=True)
class Scenario:
    name: str
    exact: float
    partial: float
    contextual: float
    generic: float
    alpha: float


# The three what-if mixes of anchor kinds and how strongly diversity counts.
SCENARIOS = [
    Scenario("scenario_1_exact_focus", 0.75, 0.15, 0.07, 0.03, 0.05),
    Scenario("scenario_2_balanced_mix", 0.40, 0.30, 0.20, 0.10, 0.18),
    Scenario("scenario_3_diversity_first", 0.20, 0.30, 0.30, 0.20, 0.35),
]

#: A task draws, sorts and weighs the anchors of about so many candidates under every scenario, in memory.
CANDIDATES_PER_TASK = 250_000

CANDIDATE_COLUMNS = ["source_id", "target_id", "block_type", "rule_weight", "anchor_type", "anchor_text"]


def anchor_base(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges with the labels of their target and of the target's parent."""
    targets = pages.select(
        F.col("page_id").alias("target_id"),
        label_from_path(F.col("path")).alias("target_label"),
        label_from_path(F.col("parent_path")).alias("target_parent_label"),
    )
    return edges.join(targets, "target_id", "left").select(
        "source_id", "target_id", "block_type", "rule_weight", "target_label", "target_parent_label"
    )


def anchor_candidates_rules(base: DataFrame) -> DataFrame:
    """Four candidates per edge, one of each kind."""
    label, parent = F.col("target_label"), F.col("target_parent_label")
    longer = F.when(parent.isNotNull() & (parent != label), F.concat(label, F.lit(" "), parent)).otherwise(label)
    texts = {
        "exact": label,
        "partial": longer,
        "contextual": F.concat(F.lit(CONTEXT_PREFIX), label),
        "generic": F.lit(GENERIC_TEXT),
    }
    candidates = F.array(
        *[
            F.struct(F.lit(kind).alias("anchor_type"), F.coalesce(text, F.lit(MISSING_TEXT)).alias("anchor_text"))
            for kind, text in texts.items()
        ]
    )
    rows = base.select("source_id", "target_id", "block_type", "rule_weight", F.explode(candidates).alias("c"))
    rows = rows.select("source_id", "target_id", "block_type", "rule_weight", "c.*")
    return conform(rows.withColumn("anchor_token_count", anchor_token_count(F.col("anchor_text"))), ANCHOR_CANDIDATES)


def anchor_candidates_summary(candidates: DataFrame) -> DataFrame:
    """(metric, name, count): candidates and their mix of kinds."""
    count = F.count(F.lit(1)).alias("count")
    total = candidates.agg(count).select(F.lit("anchor_candidates").alias("metric"), F.lit("").alias("name"), "count")
    mix = candidates.groupBy("anchor_type").agg(count)
    return total.unionByName(mix.select(F.lit("anchor_type").alias("metric"), F.col("anchor_type").alias("name"), "count"))


def candidates_contract_check(candidates: DataFrame) -> DataFrame:
    require_columns(candidates, CANDIDATE_COLUMNS, "the anchor candidate table")
    return candidates


def scenario_base_edges(candidates: DataFrame) -> DataFrame:
    return candidates.select("source_id", "target_id", "block_type", "rule_weight").distinct()


def _scenario_rows(scenarios: list[Scenario]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.exact).alias("upto_exact"),
                F.lit(s.exact + s.partial).alias("upto_partial"),
                F.lit(s.exact + s.partial + s.contextual).alias("upto_contextual"),
                F.lit(s.alpha).alias("alpha"),
            )
            for s in scenarios
        ]
    )


def _edges_with_anchors(candidates: DataFrame) -> DataFrame:
    """The distinct edges with all their (anchor_type, anchor_text), those of one source in one partition.

    The one shuffle of the scenarios: what follows works by edge or by source. An edge with a null in its key has no anchors.
    Rows grow several times behind the shuffle, so the number of tasks is set by how many there are, not by the shuffle's bytes.
    """
    key = ["source_id", "target_id", "block_type"]
    tasks = max(candidates.sparkSession.sparkContext.defaultParallelism, math.ceil(candidates.count() / CANDIDATES_PER_TASK))
    by_source = candidates.select(*CANDIDATE_COLUMNS).repartition(tasks, "source_id")
    known = F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("block_type").isNotNull()
    grouped = by_source.groupBy(*key).agg(
        F.collect_set(F.struct("rule_weight")).alias("weights"),
        F.collect_list(F.when(known, F.struct("anchor_type", "anchor_text"))).alias("anchors"),
    )
    return grouped.select(*key, F.explode("weights").alias("weight"), "anchors").select(*key, "weight.rule_weight", "anchors")


def scenario_select_anchor(candidates: DataFrame, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    """For every edge and scenario: the drawn anchor kind and its text."""
    selector = scenario_selector(F.col("source_id"), F.col("target_id"), F.col("block_type"))
    drawn = (
        _edges_with_anchors(candidates)
        .select("*", selector.alias("selector"))
        .select("*", F.explode(_scenario_rows(scenarios)).alias("s"))
        .select("source_id", "target_id", "block_type", "rule_weight", "anchors", "selector", "s.*")
        .withColumn(
            "anchor_type",
            anchor_type_choice(F.col("selector"), F.col("upto_exact"), F.col("upto_partial"), F.col("upto_contextual")),
        )
    )
    texts = F.transform(F.filter("anchors", lambda a: a["anchor_type"] == F.col("anchor_type")), lambda a: a["anchor_text"])
    return drawn.select(
        "scenario",
        "alpha",
        "source_id",
        "target_id",
        "block_type",
        "rule_weight",
        "anchor_type",
        F.explode_outer(texts).alias("anchor_text"),
    ).withColumn("anchor_text", F.coalesce("anchor_text", F.lit(GENERIC_TEXT)))


def _diversity(total: Column, texts: Column, kinds: dict[str, Column]) -> tuple[Column, Column]:
    """Lexical variety and entropy of anchor kinds, from their counts."""
    entropy = F.lit(0.0)
    for count in kinds.values():
        share = count / total
        entropy = entropy + F.when(share > 0, -share * F.log(share)).otherwise(0.0)
    return (texts / F.greatest(total, F.lit(1))).cast("float"), (entropy / math.log(len(ANCHOR_TYPES))).cast("float")


def _diversity_score() -> Column:
    return (F.col("lexical_diversity_ratio") * 0.5 + F.col("anchor_type_entropy_norm") * 0.5).cast("float").alias("anchor_diversity_score")


def source_diversity(selected: DataFrame) -> DataFrame:
    """Per scenario and source: lexical variety, entropy of anchor kinds, and their mean."""
    counts = selected.groupBy("scenario", "source_id").agg(
        F.count(F.lit(1)).alias("out_links"),
        F.countDistinct("anchor_text").alias("texts"),
        *[F.count_if(F.col("anchor_type") == kind).alias(f"n_{kind}") for kind in ANCHOR_TYPES],
    )
    lexical, entropy = _diversity(F.col("out_links"), F.col("texts"), {kind: F.col(f"n_{kind}") for kind in ANCHOR_TYPES})
    ratios = counts.select("scenario", "source_id", lexical.alias("lexical_diversity_ratio"), entropy.alias("anchor_type_entropy_norm"))
    return ratios.select("*", _diversity_score())


def _with_source_diversity(selected: DataFrame) -> DataFrame:
    """``selected`` with its source's diversity on every row; rows stay in the partition of their source."""
    same_text = Window.partitionBy("scenario", "source_id", "anchor_text").orderBy("anchor_text")
    source = Window.partitionBy("scenario", "source_id")
    first = selected.withColumn("_first", (F.row_number().over(same_text) == 1) & F.col("anchor_text").isNotNull())
    counted = first.select(
        "*",
        F.count(F.lit(1)).over(source).alias("out_links"),
        F.count_if("_first").over(source).alias("texts"),
        *[F.count_if(F.col("anchor_type") == kind).over(source).alias(f"n_{kind}") for kind in ANCHOR_TYPES],
    )
    lexical, entropy = _diversity(F.col("out_links"), F.col("texts"), {kind: F.col(f"n_{kind}") for kind in ANCHOR_TYPES})
    ratios = counted.select(*selected.columns, lexical.alias("lexical_diversity_ratio"), entropy.alias("anchor_type_entropy_norm"))
    return ratios.select(*selected.columns, _diversity_score())


def scenario_edges(candidates: DataFrame, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    """Re-weighted edges of all scenarios in one table, keyed by ``scenario``."""
    selected = scenario_select_anchor(candidates_contract_check(candidates), scenarios)
    weight = F.col("rule_weight") * (1 + F.col("anchor_diversity_score") * F.col("alpha"))
    edges = _with_source_diversity(selected.where("source_id is not null")).withColumn("rule_weight", weight)
    return conform(edges, {"scenario": "string", **SCENARIO_EDGES})


def scenario_pri(
    pages: DataFrame, edges: DataFrame, options: ScoreOptions = ScoreOptions(), scenarios: list[Scenario] = SCENARIOS
) -> DataFrame:
    """Scores of every page under every scenario, from one iteration."""
    variants = edges.withColumnRenamed("scenario", "variant")
    return score_variants(pages, variants, [s.name for s in scenarios], options).withColumnRenamed("variant", "scenario")


def scenario_comparison(scores: DataFrame, scenarios: list[Scenario] = SCENARIOS) -> DataFrame:
    """Scenario scores side by side, and each scenario's difference from the first."""
    names = [s.name for s in scenarios]
    wide = scores.groupBy("page_id").pivot("scenario", names).agg(F.max("pri_score"))
    columns = [F.col(name).alias(f"pri_{name}") for name in names]
    deltas = [(F.col(name) - F.col(names[0])).alias(f"delta_{name}_vs_{names[0]}") for name in names[1:]]
    return wide.select("page_id", *columns, *deltas)


def scenario_summary(edges: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Per scenario: edges, mean diversity, mean weight, anchor mix, and the rank sum."""
    summary = edges.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.avg("anchor_diversity_score").alias("avg_anchor_diversity_score"),
        F.avg("rule_weight").alias("avg_rule_weight"),
        *[F.count_if(F.col("anchor_type") == kind).alias(f"{kind}_count") for kind in ANCHOR_TYPES],
    )
    if scores is None:
        return summary
    return summary.join(scores.groupBy("scenario").agg(F.sum("pri_score").alias("pri_sum")), "scenario", "left")
