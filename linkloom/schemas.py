"""Column contracts of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = {
    "page_id": "bigint",
    "path": "string",
    "parent_path": "string",
    "depth": "int",
    "section": "string",
    "cluster_thematique": "string",
    "is_leaf": "boolean",
}
TEMPLATE_PAGES = {
    "page_id": "bigint",
    "path": "string",
    "parent_path": "string",
    "depth": "int",
    "section": "string",
    "cluster_thematique": "string",
    "template": "string",
    "is_leaf": "boolean",
}
EDGES = {"source_id": "bigint", "target_id": "bigint", "block_type": "string", "rule_weight": "float"}
ANCHOR_CANDIDATES = {
    **EDGES,
    "anchor_type": "string",
    "anchor_text": "string",
    "anchor_token_count": "int",
}
SCENARIO_EDGES = {
    **EDGES,
    "anchor_type": "string",
    "anchor_text": "string",
    "anchor_diversity_score": "float",
}
PRI_SCORES = {
    "page_id": "bigint",
    "pri_score": "double",
    "rank": "bigint",
    "cheirank_score": "double",
    "cheirank_rank": "bigint",
    "juice_potential_score": "double",
    "out_degree": "bigint",
    "in_degree": "bigint",
    "is_low_power": "boolean",
    "can_give_juice": "boolean",
}
URL_METRICS = {
    "page_id": "bigint",
    "path": "string",
    "depth": "int",
    "pri_score": "double",
    "rank": "bigint",
    "cheirank_score": "double",
    "cheirank_rank": "bigint",
    "in_degree": "bigint",
    "out_degree": "bigint",
    "can_give_juice": "boolean",
    "is_low_power": "boolean",
    "incoming_links": "bigint",
    "outgoing_links": "bigint",
    "incoming_weight": "double",
    "outgoing_weight": "double",
    "unique_out_targets": "bigint",
    "unique_in_sources": "bigint",
    "unique_anchor_texts_out": "bigint",
    "unique_anchor_types_out": "bigint",
    "lexical_diversity_out": "double",
}
PAGE_SEGMENTS = {
    "page_id": "bigint",
    "level": "int",
    "segment": "string",
    "segment_path": "string",
    "parent_segment_path": "string",
    "depth": "int",
    "is_terminal": "boolean",
}
SEGMENT_METRICS = {
    "level": "int",
    "segment_path": "string",
    "segment": "string",
    "page_count": "bigint",
    "pri_sum": "double",
    "pri_mean": "double",
    "cheirank_sum": "double",
    "cheirank_mean": "double",
    "donor_ratio": "double",
    "low_power_ratio": "double",
    "avg_in_degree": "double",
    "avg_out_degree": "double",
    "avg_lexical_diversity_out": "double",
}


def conform(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Project and cast to a contract's columns, in its order."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in contract.items()])


def ddl(contract: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in contract.items())


def require_columns(df: DataFrame, names: list[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
