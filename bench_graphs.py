"""Ring-shaped graphs of any size, to time the ranking; not part of the library."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.schemas import EDGES, PAGES, conform

# Fixed value: the stride of rings.
RING_STRIDE = 17


def ring_pages(spark: SparkSession, node_count: int, cluster_count: int) -> DataFrame:
    """``node_count`` pages dealt over ``cluster_count`` clusters in turn."""
    cluster = (F.col("page_id") - 1) % max(cluster_count, 1)
    pages = spark.range(1, node_count + 1).select(F.col("id").alias("page_id")).select(
        "page_id",
        F.concat(F.lit("synthetic/"), F.col("page_id").cast("string"), F.lit("/")).alias("path"),
        F.lit(None).cast("string").alias("parent_path"),
        F.lit(2).alias("depth"),
        F.lit("synthetic").alias("section"),
        F.concat(F.lit("synthetic:cluster-"), cluster.cast("string")).alias("cluster_thematique"),
        F.lit(True).alias("is_leaf"),
    )
    return conform(pages, PAGES)


def ring_edges(spark: SparkSession, node_count: int, edge_count: int) -> DataFrame:
    """The first ``edge_count`` links (source, step order) of a ring with stride-17 jumps.

    A step that leads back to its source does so for every source, so the running number
    of a link is known without sorting.
    """
    if node_count <= 0 or edge_count <= 0:
        return spark.createDataFrame([], "source_id int, target_id int, block_type string, rule_weight float")
    steps_per_node = math.ceil(edge_count / node_count)
    useful = F.filter(
        F.sequence(F.lit(1).cast("long"), F.lit(steps_per_node).cast("long")), lambda s: (s * RING_STRIDE) % node_count != 0
    )
    links = spark.range(1, node_count + 1).select(
        F.col("id").alias("source_id"), F.size(useful).alias("steps"), F.posexplode(useful).alias("step_no", "step")
    )
    number = (F.col("source_id") - 1) * F.col("steps") + F.col("step_no")
    target = (F.col("source_id") + F.col("step") * RING_STRIDE - 1) % node_count + 1
    return conform(
        links.where(number < edge_count).select(
            "source_id", target.alias("target_id"), F.lit("synthetic").alias("block_type"), F.lit(1.0).alias("rule_weight")
        ),
        EDGES,
    )
