"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its ``prefix`` nearest reference vectors (pivots). Inverted lists hold the
vectors of each (label, pivot); two vectors that share at least ``min_shared`` pivots are candidates,
and the cosine decides. There are as many pivots as the square root of the number of vectors, so a list
holds about ``prefix`` times that root, and the pairs looked at grow with the power 1.5 of the vectors. Equal
vectors of a label are one entry with a count. Long lists are cut into blocks that meet pair by pair, and a
block returns counts and spanning links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.blocks import block_pairs
from linkloom.llm.common import materialize, small_batches
from linkloom.llm.components import connected_components

#: Reference vectors, for small and for very large tables; between these the square root of the vectors.
LEAST_PIVOTS, MOST_PIVOTS = 64, 1 << 17
LIST_ROWS = 1024
#: Cosines with pivots, and pairs, that are held at a time.
PRODUCTS, PAIRS = 1 << 22, 1 << 15


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def verified(vectors: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int, threshold: float, min_shared: int):
    """Linked pairs (row numbers) of a block whose first shared pivot is ``pivot``; ``near`` has a row of pivots per vector.

    Two vectors of a list share its pivot. Those that share a further one have a common bit among their other
    pivots' numbers modulo 64; of these pairs the shared pivots are counted, and then the cosine is taken.
    """
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    square = len(a) == len(vectors) and len(b) == len(vectors)
    units, needed = unit(vectors), min(min_shared, near.shape[1])
    bits = np.where(near == pivot, np.uint64(0), np.uint64(1) << (near % 64).astype(np.uint64))
    folded = np.bitwise_or.reduce(bits, axis=1)
    step = 512
    for first in range(0, len(a), step):
        rows = a[first : first + step]
        wanted = (folded[rows][:, None] & folded[b][None, :]) != 0 if needed > 1 else np.ones((len(rows), len(b)), dtype=bool)
        if square:
            wanted &= rows[:, None] < b[None, :]
        x, y = np.nonzero(wanted)
        for at in range(0, len(x), PAIRS):
            p, q = rows[x[at : at + PAIRS]], b[y[at : at + PAIRS]]
            shared = (near[p][:, :, None] == near[q][:, None, :]).any(axis=2)
            lowest = np.where(shared, near[p], np.iinfo(near.dtype).max).min(axis=1)
            met = (lowest == pivot) & (shared.sum(axis=1) >= needed)
            p, q = p[met], q[met]
            linked = np.einsum("ij,ij->i", units[p], units[q]) >= threshold
            if linked.any():
                yield p[linked], q[linked]


def spanning(pairs_a: np.ndarray, pairs_b: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """The pairs that join two groups of ``parent``, which is updated."""

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x, y in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            parent[b] = a
            links.append((x, y))
    return links


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    prefix: int = 6,
    min_shared: int = 2,
) -> DataFrame:
    """key, n_links, component_id and kept, a row per row of ``vectors``.

    Vectors with a null label, null, empty or zero vectors and vectors with null or non-finite
    components link with nothing; vectors of different lengths don't link. Repeated rows are vectors
    of their own. component_id is the least id reachable; kept marks the rows of that id. The pivots
    are different vectors drawn by hash; all vectors are indexed. An empty table gives an empty table.
    """
    numbers = F.col(embedding).cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(F.col(label).isNotNull() & finite & F.exists(numbers, lambda x: x != 0), F.lit(False))
    rows = small_batches(vectors).select(F.col(key).alias("_id"), F.col(label).alias("_label"), numbers.alias("_vector"), sound.alias("_sound"))
    good = rows.where("_sound").withColumn("_length", F.size("_vector"))
    classes = materialize(
        good.groupBy("_label", "_length", "_vector")
        .agg(F.count(F.lit(1)).alias("_count"), F.min("_id").alias("_least"))
        .withColumn("_class", F.monotonically_increasing_id()),
        "vector-classes",
    )
    wanted = min(max(LEAST_PIVOTS, math.isqrt(classes.count())), MOST_PIVOTS)
    drawn = classes.orderBy(F.xxhash64("_vector"), "_class").select("_vector").limit(wanted).collect()  # MOST_PIVOTS rows at most
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(r[0]) for r in drawn}:
        own = [n for n, r in enumerate(drawn) if len(r[0]) == length]
        pivots[length] = np.array(own), unit(np.array([drawn[n][0] for n in own], dtype=np.float64))

    @F.pandas_udf("array<int>")
    def nearest(values: pd.Series) -> pd.Series:
        found: list = [np.zeros(1, dtype=np.int32)] * len(values)  # no pivot of this length: all in one list
        lengths = values.map(len)
        for length, (own, units) in pivots.items():
            at = np.flatnonzero(lengths == length)
            step = max(1, PRODUCTS // len(own))
            for first in range(0, len(at), step):
                part = at[first : first + step]
                far = -(np.stack(values.iloc[part].to_list()) @ units.T)
                order = np.argpartition(far, prefix - 1, axis=1)[:, :prefix] if prefix < len(own) else np.tile(np.arange(len(own)), (len(part), 1))
                for r, places in zip(part, own[order], strict=True):
                    found[r] = places.astype(np.int32)
        return pd.Series(found)

    listed = classes.select("_class", "_count", "_label", "_length", "_vector", nearest("_vector").alias("_near"))
    lists = materialize(listed, "pivot-prefixes").withColumn("_pivot", F.explode("_near"))
    blocks = block_pairs(lists, ["_label", "_length", "_pivot"], F.col("_class"), LIST_ROWS)

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        ids, counts = block["_class"].to_numpy(), block["_count"].to_numpy()
        linked, parent, links = np.zeros(len(block), dtype=np.int64), list(range(len(block))), []
        stacked = np.stack(block["_vector"].to_list()).astype(np.float64)
        near = np.stack(block["_near"].to_list()).astype(np.int64)
        sides = block["_left"].to_numpy(dtype=bool), block["_right"].to_numpy(dtype=bool)
        for a, b in verified(stacked, near, *sides, int(block["_pivot"].iloc[0]), threshold, min_shared):
            np.add.at(linked, a, counts[b])
            np.add.at(linked, b, counts[a])
            links += spanning(a, b, parent)
        some = np.flatnonzero(linked)
        out = pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), dtype="Int64"), "n": linked[some]})
        spans = pd.DataFrame({"a": ids[[x for x, _ in links]], "b": pd.array(ids[[y for _, y in links]], dtype="Int64"), "n": 0}) if links else out[:0]
        return pd.concat([out, spans], ignore_index=True)

    found = materialize(
        blocks.groupBy("_label", "_length", "_pivot", "_i", "_j").applyInPandas(verify, "a long, b long, n long"), "vector-links"
    )
    linked = found.groupBy("a").agg(F.sum("n").alias("_linked"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    known = (
        classes.join(linked, F.col("_class") == F.col("a"), "left")
        .join(roots, F.col("_class") == F.col("node"), "left")
        .select("_label", "_length", "_vector", "_least", (F.coalesce("_linked", F.lit(0)) + F.col("_count") - 1).alias("_links"), F.coalesce("root", "_class").alias("_root"))
    )
    known = materialize(known, "vector-groups")
    least = known.groupBy("_root").agg(F.min("_least").alias("_component"))
    known = known.join(least, "_root").select(
        F.col("_label").alias("_l"), F.col("_vector").alias("_v"), "_links", "_component"
    )
    marked = good.join(known, (F.col("_label") == F.col("_l")) & (F.col("_vector") == F.col("_v")), "left").select("_id", "_links", "_component")
    alone = rows.where("not _sound").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    return marked.union(alone).select(
        F.col("_id").alias(key),
        F.col("_links").cast("long").alias("n_links"),
        F.col("_component").cast("long").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_component")).alias("kept"),
    )
