"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): equal roots, one component.

    Each round every node moves to the least of itself and its neighbours, in an order drawn anew from
    the round's hash; links are then renamed, and loops and repeats go. A constant share of the nodes
    goes per round whatever the shape (chains too), so the number of rounds grows with the logarithm.
    Minima are combined in the tasks before the shuffle, so a hub of any degree is a few rows.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    number = 0
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        drawn = lambda name: F.struct(F.xxhash64(F.lit(number), F.col(name)).alias("h"), F.col(name).alias("id"))  # noqa: B023, E731
        nearest = both.groupBy("a").agg(F.min(drawn("b")).alias("b"))
        moves = materialize(
            nearest.select(F.col("a").alias("old"), F.least(drawn("a"), F.col("b"))["id"].alias("new")).where("old <> new"), "moves"
        )
        roots = materialize(
            roots.join(moves, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "roots"
        )
        left, right = moves.toDF("old_a", "new_a"), moves.toDF("old_b", "new_b")
        renamed = links.join(left, F.col("a") == F.col("old_a"), "left").join(right, F.col("b") == F.col("old_b"), "left")
        ends = renamed.select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b")).where("a <> b")
        links = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        number += 1
    return roots
