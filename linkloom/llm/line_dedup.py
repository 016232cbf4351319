"""Line deduplication: count the documents of each normalised line, drop lines of too many.

1. Lines are exploded to (key hash, document); a document gives each key once.
2. Distinct documents are counted per key, partially in each task, so a line that a third of all
   documents share is a few counts by the time it is shuffled.
3. Keys of at least ``min_docs`` documents lose their lines everywhere but in the largest document. The
   most common keys are told by a broadcast, as there can be only OFTEN of them; only the others' lines
   are shuffled to find out, so no task gets the lines of one hot key.
4. Documents get the hashes they lose and are put together again from the other lines, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import LOWER_ASCII, SPACE_BYTES, materialize, small_batches

#: A key in over one in so many of all (line, document) rows is common; there are fewer such keys than this.
OFTEN = 10_000


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE_BYTES).translate(LOWER_ASCII)


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None for keys of fewer than ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def repeated_lines(docs: DataFrame, text: str, key: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, hash): the keys that each document loses."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes = [], []
            for doc, body in zip(batch["doc"], batch["body"], strict=True):
                found = {key_hash(line, min_chars) for line in (body or b"").split(b"\n")}
                found.discard(None)
                ids += [doc] * len(found)
                hashes += found
            yield pd.DataFrame({"doc": pd.Series(ids, dtype="Int64"), "hash": hashes})

    narrow = small_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("body"))
    lines = materialize(narrow.mapInPandas(explode, "doc long, hash binary"), "line-keys")
    counted = lines.groupBy("hash").agg(F.countDistinct(F.coalesce(F.col("doc"), F.lit(-(2**63)))).alias("docs"), F.max("doc").alias("last"))
    repeated = materialize(counted.where(F.col("docs") >= min_docs), "repeated-lines")
    often = F.col("docs") * F.lit(OFTEN) > F.lit(lines.count())
    hot, rare = repeated.where(often).select("hash", "last"), repeated.where(~often).select("hash", "last")
    others = lines.join(F.broadcast(hot.select("hash")), "hash", "left_anti")
    found = lines.join(F.broadcast(hot), "hash").unionByName(others.join(rare, "hash"))
    return found.where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "hash")


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped and kept_text.

    Null or empty text is one empty line. Rows of one id are one document: their lines count once,
    and a key dropped from the id goes from all its rows; rows without an id are one document, the
    lowest. A line repeated in the surviving document stays repeated. Result columns replace input
    columns of the same name; all others pass through. An empty table gives an empty table.
    """
    losses = (
        repeated_lines(docs, text, key, min_chars, min_docs)
        .groupBy("doc")
        .agg(F.collect_set("hash").alias("_losses"))
        .withColumnRenamed("doc", "_losing")
    )

    @F.pandas_udf("n_lines long, n_dropped long, kept binary")
    def reassemble(bodies: pd.Series, losing: pd.Series) -> pd.DataFrame:
        rows = []
        for body, losses in zip(bodies, losing, strict=True):
            lines = (body or b"").split(b"\n")
            if losses is None or len(losses) == 0:
                rows.append((len(lines), 0, body or b""))
                continue
            gone = set(losses)
            kept = [line for line in lines if key_hash(line, min_chars) not in gone]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    joined = docs.join(losses.hint("shuffle_hash"), F.col(key).cast("long").eqNullSafe(F.col("_losing")), "left")
    made = joined.withColumn("_made", reassemble(F.col(text).cast("binary"), F.col("_losses")))
    return made.withColumns(
        {
            "n_lines": F.col("_made.n_lines"),
            "n_dropped": F.col("_made.n_dropped"),
            "kept_text": F.col("_made.kept").cast("string"),
        }
    ).drop("_made", "_losses", "_losing")
