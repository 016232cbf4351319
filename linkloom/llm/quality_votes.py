"""Quality classifier: votes of the nearest labelled texts in a latent-semantic space.

A text's terms are hashed byte trigrams, trigrams of character classes, repeated words and its length.
Subspace iteration, run by Spark over a bounded sample of labelled texts, finds the leading singular
directions of their term matrix; the first one is the mean text, so it is left out. The sample's latent
vectors are broadcast. Every text of the corpus is projected, its cosines with all of them are computed in
blocks, and the nearest vote with the power of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import SPACE_BYTES, materialize, small_batches

GRAMS, SHAPES, REPEATS, LENGTHS = 2048, 512, 4, 32
#: Where each kind of term begins; each kind but the last is scaled to length 1.
BOUNDS = (0, GRAMS, GRAMS + SHAPES, GRAMS + SHAPES + REPEATS)
WIDTH = GRAMS + SHAPES + REPEATS + LENGTHS
LENGTH_WEIGHT = 0.5
#: Bytes of a text looked at together; words count as repeated within them.
CHUNK = 1 << 18
#: Documents times labelled vectors multiplied at once.
BLOCK = 256


def _classes() -> np.ndarray:
    """Class of a byte: letter (all of UTF-8 too), capital, digit, blank, line end, comma or stop, other."""
    kinds = np.full(256, 7, dtype=np.uint32)
    kinds[128:] = kinds[ord("a") : ord("z") + 1] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("0") : ord("9") + 1] = 3
    kinds[list(SPACE_BYTES)] = 4
    kinds[ord("\n")] = 5
    kinds[list(b".,")] = 6
    return kinds


_CLASSES = _classes()


def text_terms(body: bytes) -> np.ndarray:
    """The term vector of a whole text, of length 1."""
    counts = np.zeros(WIDTH, dtype=np.int64)
    folded, words = b" " + body + b" ", 0
    for first in range(0, len(folded) - 2, CHUNK):
        part = folded[first : first + CHUNK + 2]
        codes = np.frombuffer(part, dtype=np.uint8)
        a = codes.astype(np.uint32)
        mixed = (a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(2246822519) + a[2:] * np.uint32(3266489917)) * np.uint32(668265263)
        counts[:GRAMS] += np.bincount(mixed >> np.uint32(21), minlength=GRAMS)
        kind = _CLASSES[codes]
        counts[GRAMS : BOUNDS[2]] += np.bincount(kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:], minlength=SHAPES)
        found = part[:CHUNK].split()
        distinct, following = len(set(found)), sum(map(eq, found, found[1:]))
        words += len(found)
        counts[BOUNDS[2] : BOUNDS[3]] += distinct, len(found) - distinct, following, len(found) - following
    values = np.sqrt(counts.astype(np.float64))
    for low, high in zip(BOUNDS, BOUNDS[1:], strict=False):
        kind = values[low:high]
        length = np.sqrt((kind * kind).sum())
        if length > 0:
            kind /= length
    values[BOUNDS[3] + min(LENGTHS - 1, words.bit_length())] = LENGTH_WEIGHT
    return values / np.sqrt((values * values).sum())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _terms(bodies: pd.Series) -> pd.Series:
    return pd.Series([text_terms(b or b"").astype(np.float32) for b in bodies])


@dataclass(frozen=True)
class Voters:
    """Directions of the latent space, and the labelled vectors in it with label and weight."""

    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    neighbours: int
    power: int

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest vectors, by similarity; vectors as near as the last one count too."""
        latent = _units(terms @ self.directions)
        similar = np.round(np.maximum(latent @ self.vectors.T, 0.0), 6)
        k = min(self.neighbours, len(self.vectors))
        least = np.partition(similar, -k, axis=1)[:, -k][:, None]
        votes = np.where(similar >= least, similar**self.power * self.weights, 0.0)
        total = votes.sum(axis=1)
        prior = (self.labels * self.weights).sum() / self.weights.sum()  # a text unlike all others
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(total > 0, np.clip(votes @ self.labels / total, 0.0, 1.0), prior)


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _directions(terms: DataFrame, rank: int, rounds: int) -> np.ndarray:
    """Leading right singular vectors of ``terms`` (a row a text), as columns, without the first.

    Subspace iteration: tasks multiply their rows and give a row a term, Spark adds these up, and the driver keeps the
    columns orthogonal (WIDTH by rank numbers, whatever the sample).
    """
    width = rank + 1
    basis = np.linalg.qr(np.random.default_rng(13).standard_normal((WIDTH, width + 8)))[0]
    for _ in range(rounds):
        current = basis

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(current)  # noqa: B023
            for batch in batches:
                if len(batch):
                    rows = np.stack(batch["terms"].to_list()).astype(np.float64)
                    total += rows.T @ (rows @ current)  # noqa: B023
            yield pd.DataFrame({"term": np.arange(WIDTH), "v": list(total)})

        parts = terms.select("terms").mapInPandas(products, "term int, v array<double>")
        summed = parts.groupBy("term").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(basis.shape[1])]).orderBy("term").collect()
        basis, triangle = np.linalg.qr(np.array([[r[f"v{k}"] for k in range(basis.shape[1])] for r in summed]))
    # the last triangle's singular vectors order the subspace by singular value
    left, values, _ = np.linalg.svd(triangle)
    kept = (basis @ left)[:, 1:width]
    return kept[:, values[1:width] > 1e-9 * max(values[0], 1e-300)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = 2048,
    rank: int = 24,
    neighbours: int = 15,
    power: int = 8,
    rounds: int = 5,
) -> Voters | None:
    """Voters from ``labels`` (key, 0 or 1), at most ``sample`` of each label, drawn by hash.

    Keys with no document, null keys and other label values don't count; a key with both labels counts as 0,
    and of several texts of a key the least one. A vote is weighed by how many labelled rows a drawn one stands
    for, so the draw doesn't change what is likely. None if nothing is left to learn from.
    """
    texts = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
    known = marked.groupBy("key").agg(F.min("label").cast("int").alias("label")).join(texts.select("key"), "key", "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    drawn = None
    for value in sorted(counts):
        share = F.xxhash64("key").cast("double") <= F.lit(2.0**63 * (min(2.0, 4 * sample / counts[value]) - 1))  # about twice the sample
        part = known.where((F.col("label") == value) & share).orderBy(F.xxhash64("key"), "key").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return None
    drawn = materialize(drawn, "quality-draw")  # 2 * sample rows at most
    texts = texts.join(F.broadcast(drawn), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    terms = materialize(texts.select("key", "label", _terms(F.col("text").cast("binary")).alias("terms")), "quality-terms")
    directions = _directions(terms, rank, rounds)

    def latent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["terms"].to_list()).astype(np.float64) @ directions
                yield pd.DataFrame({"key": batch["key"].astype(str), "label": batch["label"], "v": list(_units(rows))})

    found = terms.mapInPandas(latent, "key string, label int, v array<double>").orderBy("key").collect()  # 2 * sample rows at most
    label_of = np.array([r["label"] for r in found], dtype=np.float64)
    per_label = {value: max(1, int((label_of == value).sum())) for value in (0, 1)}
    weights = np.array([counts[int(value)] / per_label[int(value)] for value in label_of])
    vectors = np.array([r["v"] for r in found]).reshape(len(found), directions.shape[1])
    return Voters(directions, vectors, label_of, weights, neighbours, power)


def vote(docs: DataFrame, voters: Voters | None, text: str, threshold: float) -> DataFrame:
    """``docs`` as a struct column ``row``, with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The text alone decides; null is an empty text, which is scored as any other. 0.5 if there are no voters. Input columns are kept
    inside ``row``, so none can clash with the result's.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(voters)  # WIDTH * rank and 2 * sample * rank numbers

    @F.pandas_udf("double")
    def scored(bodies: pd.Series) -> pd.Series:
        voters, scores = shared.value, np.full(len(bodies), 0.5)
        for first in range(0, len(bodies) if voters else 0, BLOCK):
            part = bodies.iloc[first : first + BLOCK]
            scores[first : first + BLOCK] = voters.scores(np.stack([text_terms(b or b"") for b in part]))
        return pd.Series(scores)

    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scored(F.col(text).cast("binary")).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key's text leaves ``part`` when divided by ``parts``; a null key is an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part
