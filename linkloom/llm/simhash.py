"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has the majority bit of all shingle hashes. Two fingerprints at most ``radius`` bits
apart agree on at least one of ``radius + 1`` bands, so shards are (band, value). A shard's tree holds
its fingerprints, each child under its Hamming distance to the parent; a search follows only the edges
within the radius of its own distance, and runs for all fingerprints of the shard at once. Shards with
too many different fingerprints are cut into parts: each part's tree meets every part's fingerprints.
Equal fingerprints are one node throughout, and a block gives each fingerprint one link to its local
group, so groups of copies of any size give rows in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.blocks import block_pairs
from linkloom.llm.common import LOWER_ASCII, materialize, small_batches
from linkloom.llm.components import connected_components

SHARD_ROWS = 2048
CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles; 0 without words."""
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    count = max(1, len(words) - width + 1)
    starts = [0] + [end + 1 for end in ends[: count - 1]]
    stops = ends[width - 1 :] or ends[-1:]
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, count, CHUNK):
        part = slice(first, first + CHUNK)
        values = np.array([hashed(line[a:b], seed) for a, b in zip(starts[part], stops[part], strict=True)], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > count, bitorder="little")
    return int(majority.view("<u8")[0])


class BKTree:
    """Nodes in arrays; a child hangs under its distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        plain = values.tolist()
        for node in range(1, len(plain)):
            at = 0
            while True:
                distance = (plain[at] ^ plain[node]).bit_count()
                below = self.children[at].setdefault(distance, node)
                if below == node:
                    break
                at = below

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within ``radius`` of it), all queries walking down together."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, active = stack.pop()
            distances = np.bitwise_count(queries[active] ^ self.values[node])
            near = active[distances <= radius]
            if len(near):
                yield node, near
            for distance, child in self.children[node].items():
                follow = active[np.abs(distances.astype(np.int16) - distance) <= radius]
                if len(follow):
                    stack.append((child, follow))


def local_links(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links between ``left`` (the tree) and ``right`` members of a block of different values."""
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    tree_ids, query_ids = np.flatnonzero(left), np.flatnonzero(right)
    for node, near in BKTree(values[tree_ids]).search(values[query_ids], radius):
        own = int(tree_ids[node])
        for other in query_ids[near].tolist():
            a, b = find(own), find(other)
            if a != b:
                parent[b] = a
                links.append((own, other))
    return links


def link_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span every group of the different fingerprints in ``prints`` (fp)."""
    bands = radius + 1
    edges = [64 * n // bands for n in range(bands + 1)]
    keys = [
        F.struct(F.lit(n).alias("band"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"))
        for n, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    shards = prints.select("fp", F.explode(F.array(*keys)).alias("_key")).select("fp", "_key.band", "_key.value")
    blocks = block_pairs(shards, ["band", "value"], F.col("fp"), SHARD_ROWS)
    grouped = blocks.groupBy("band", "value", "_i", "_j").agg(F.collect_list(F.struct("fp", "_left", "_right")).alias("members"))
    # flat arrays reach Python as numpy arrays, about ten bytes a member
    flat = [F.col(f"members.{name}").alias(name) for name in ("fp", "_left", "_right")]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for prints, left, right in zip(batch["fp"], batch["_left"], batch["_right"], strict=True):
                signed = np.array(prints, dtype=np.int64)
                links = local_links(signed.view(np.uint64), np.array(left, dtype=bool), np.array(right, dtype=bool), radius)
                found += [(int(signed[a]), int(signed[b])) for a, b in links]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return grouped.select(*flat).mapInPandas(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, width: int = 4, carried: Sequence[Column] = ()
) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id and _fp, _root, a row per row of ``docs``; then the ``carried`` columns.

    component_id is the least id reachable by links of at most ``radius`` bits, itself included; rows
    without an id don't count for it, unless a component has no other. Null and empty texts and texts
    of white space have fingerprint 0 and link as any other; texts of fewer than ``width`` words are
    one shingle. Repeated rows share their component. An empty table gives an empty table.
    """

    @F.pandas_udf("long")
    def fingerprints(bodies: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(b, width) for b in bodies), dtype=np.uint64, count=len(bodies))
        return pd.Series(values.view(np.int64))

    rows = materialize(small_batches(docs).select(F.col(key).alias("_id"), fingerprints(F.col(text).cast("binary")).alias("_fp"), *carried), "fingerprints")
    classes = materialize(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "classes")
    roots = connected_components(link_fingerprints(classes.select(F.col("_fp").alias("fp")), radius))
    rooted = classes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    known = rooted.join(least, "_root").select(F.col("_fp").alias("_f"), "_root", "component_id")
    return rows.join(known, F.col("_fp") == F.col("_f")).select(
        F.col("_id").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "_fp", "_root", *rows.columns[2:]
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near-duplicates: that of the least id, ties by the text's hash.

    Returns the columns of ``docs``. Of rows that share an id and a group one stays.
    """
    # id and text hash tell rows apart, so fingerprints are made once and rows without an id are no hot key
    told = [F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), F.xxhash64(F.col(text))]
    marked = near_duplicates(docs, text, key, carried=[told[2].alias("_hash")], **options).where(F.col(key).eqNullSafe(F.col("component_id")))
    least = marked.groupBy(F.col(key).alias("_id"), "_root").agg(F.min("_hash").alias("_hash"))
    names = ["_id", "_none", "_hash"]
    chosen = least.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"), F.col("_id").isNull().alias("_none"), "_hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for c, n in zip(told, names, strict=True)])
    same = Window.partitionBy(*names).orderBy(F.col("_row")[text])
    kept = rows.join(chosen, names).withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
