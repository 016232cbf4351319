"""Merkle manifest of a dataset, by a slot pivot.

Rows are leaves. The leaves of a group, in key order, form a tree of ``FANOUT`` children a node, and the
groups' subroots, in group order, form the tree above them. A parent is one aggregate row: conditional
aggregates spread its children into FANOUT columns, one a slot. The columns concatenated are what the parent
hashes, and leaving the own column out gives a child's siblings, so proofs need no window over a group.

All of it is DataFrame functions. Positions come from a range-partitioned order, so one group may hold any
share of the rows; texts are read once and never shuffled, only digests are. Every level is a table of an
eighth of the rows of the one below it, written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import materialize
from linkloom.operators.ordering import dense_index
from linkloom.storage import cut_lineage

#: Children of a node.
FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated; digests go in as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _slots() -> list[str]:
    return [f"s{k}" for k in range(FANOUT)]


def slot_pivot(nodes: DataFrame) -> DataFrame:
    """One row per parent of ``nodes`` (tree, place, size, node): tree, place, size of its level, s0, s1, ...

    ``node`` is a struct that begins with the digest; ``size`` is the number of nodes of the tree at that level.
    """
    slot = F.pmod("place", F.lit(FANOUT))
    spread = [F.max(F.when(slot == k, F.col("node"))).alias(name) for k, name in enumerate(_slots())]
    parent = F.shiftright("place", FANOUT.bit_length() - 1).alias("place")
    return nodes.groupBy("tree", parent, F.ceil(F.col("size") / F.lit(FANOUT)).cast("long").alias("size")).agg(*spread)


def _hashed(pivot: DataFrame) -> DataFrame:
    children = [F.coalesce(F.col(name)["digest"], F.lit("")) for name in _slots()]
    return pivot.select("tree", "place", "size", F.struct(digest(*children).alias("digest")).alias("node"))


def _children(pivot: DataFrame) -> DataFrame:
    """(tree, place, node, path, subroot) of the children of ``pivot`` rows that know the ``path`` above them.

    A path is an array of (left, right): digests of the siblings on either side, from the node up.
    """
    texts = [F.coalesce(F.col(name)["digest"], F.lit("")) for name in _slots()]
    spread = []
    for k, name in enumerate(_slots()):
        siblings = F.struct(
            F.concat(F.lit(""), *texts[:k]).alias("left"), F.concat(F.lit(""), *texts[k + 1 :]).alias("right")
        )
        spread.append(F.struct(F.lit(k).alias("slot"), F.col(name).alias("node"), siblings.alias("siblings")))
    rows = pivot.select("tree", "place", "path", "subroot", F.explode(F.array(*spread)).alias("child"))
    return rows.where("child.node is not null").select(
        "tree",
        (F.col("place") * FANOUT + F.col("child.slot")).alias("place"),
        F.col("child.node").alias("node"),
        F.concat(F.array("child.siblings"), F.col("path")).alias("path"),
        "subroot",
    )


@dataclass
class Forest:
    """Trees of one height or several: the pivots by level, the trees of one node, the tops (tree, digest)."""

    pivots: list[DataFrame]
    single: DataFrame
    tops: DataFrame

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """(tree, place, node, path, subroot) of every bottom node; ``above`` (tree, path, subroot) goes on from its top.

        Goes down a level at a time: a parent is a top, or was reached in the step before. Without ``above``, tops are roots.
        """

        def from_top(rows: DataFrame) -> DataFrame:
            if above is not None:
                return rows.join(above, "tree")
            return rows.withColumns({"path": F.array().cast("array<struct<left:string,right:string>>"), "subroot": F.lit("")})

        found = from_top(self.single).select("tree", "place", "node", "path", "subroot")
        reached = None
        for pivot in reversed(self.pivots):
            parents = from_top(pivot.where("size = 1"))
            if reached is not None:
                known = reached.select("tree", "place", "path", "subroot")
                parents = parents.unionByName(pivot.where("size > 1").join(known, ["tree", "place"]))
            reached = _children(parents)
        return found if reached is None else reached.unionByName(found)


def build_forest(nodes: DataFrame, largest: int) -> Forest:
    """Trees over ``nodes`` (tree, place from 0, size of the tree, node); ``largest`` is the largest size."""
    single = nodes.where("size = 1").select("tree", "place", "node")
    pivots, level = [], nodes
    tops = single.select("tree", F.col("node")["digest"].alias("digest"))
    while largest > 1:
        pivot = materialize(slot_pivot(level.where("size > 1")), f"merkle-level-{len(pivots)}")
        pivots.append(pivot)
        level = _hashed(pivot)
        tops = tops.unionByName(level.where("size = 1").select("tree", F.col("node")["digest"].alias("digest")))
        largest = -(-largest // FANOUT)
    return Forest(pivots, single, tops)


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``leaves`` (group, key, node) as nodes, trees numbered in group order; number of trees, largest size.

    Rows are range-partitioned by (group, key, digest). A run is the rows of a group in one range; what
    earlier runs of the group hold is added to the place within the run. There is a row a run, at most as
    many as ranges and groups, so no row count of a group matters.
    """
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("node.digest").asc()]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged).withColumn("range", F.shiftright("position", _ROW_BITS))
    runs = ranged.groupBy("range", "group").agg(F.count(F.lit(1)).alias("rows"), F.min("position").alias("first"))
    own = Window.partitionBy("group")
    earlier = own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(
        runs.select(
            F.col("range").alias("at"),
            F.col("group").alias("of"),
            (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("rows").over(own).alias("size"),
            F.col("first"),
            F.min("first").over(own).alias("start"),
        ),
        "merkle-runs",
    )
    trees = dense_index(runs.where("first = start").select("start", "size"), [F.col("start")], "tree", start=0)
    count, largest = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    known = runs.join(trees.select("start", "tree"), "start").select("at", "of", "shift", "size", "tree")
    rows = ranged.join(known, (F.col("range") == F.col("at")) & F.col("group").eqNullSafe(F.col("of")))
    return rows.select("tree", (F.col("position") + F.col("shift")).alias("place"), "size", "node"), count, largest


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, carried: dict[str, Column]) -> DataFrame:
    """leaf, subroot, root and path of every row, and the ``carried`` columns.

    ``leaf`` is the row's digest. Leaves of a group ascend by ``key`` (null first; rows of one key by
    digest, so that repeated rows are leaves of their own and the roots don't depend on the input order);
    groups ascend bytewise, null first. Every FANOUT consecutive nodes become one, the last run holds fewer, until
    one is left. ``path`` lists the siblings (left, right) on the way to the root, a level at a time; it is
    empty for the only row of the only group. Only these columns of ``rows`` are read, whatever else it
    has. An empty table has no root and gives an empty table.
    """
    node = F.struct(leaf.alias("digest"), *[column.alias(name) for name, column in carried.items()])
    nodes, trees, largest = _placed(rows.select(group.alias("group"), key.alias("key"), node.alias("node")))
    forest = build_forest(nodes, largest)
    tops = materialize(forest.tops, "merkle-subroots")
    subroots = tops.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("size"), F.struct("digest").alias("node")
    )
    crown = build_forest(subroots, trees)
    root = crown.tops.first()  # one digest
    above = crown.paths().select(F.col("place").alias("tree"), "path", F.col("node.digest").alias("subroot"))
    return forest.paths(above).select(
        *[F.col("node")[name].alias(name) for name in carried],
        F.col("node.digest").alias("leaf"),
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        "path",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda node, siblings: digest(siblings["left"], node, siblings["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path in one digest, from the leaf up and left to right."""
    return digest(F.array_join(F.transform(path, lambda siblings: F.concat(siblings["left"], siblings["right"])), ""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
