"""Language identification in two steps: the family, then the language within it.

Texts become counts of hashed letter bigrams and trigrams. One-versus-one linear support vector
machines tell families apart, and within each family others tell each two of its languages apart.
They are fitted by Spark on a bounded sample (about ``sample`` labelled documents a language, drawn by
hash); prediction is one pass over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import materialize, small_batches

#: Language families by ISO 639-1 code; a language that isn't listed is a family by itself.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ca", "ro", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}
TRIGRAMS, BIGRAMS = 4096, 1024
WIDTH = TRIGRAMS + BIGRAMS
CHUNK = 1 << 20
#: Letters in lower case, other ASCII as a blank; in UTF-8, Latin capitals lie 32 below small letters.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 or 0x80 <= c <= 0x9E else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256)
)


def text_features(body: bytes) -> np.ndarray:
    """Square roots of the n-gram counts of the whole text, scaled to length 1."""
    folded = b" " + body.translate(_FOLD) + b" "
    counts = np.zeros(WIDTH, dtype=np.int64)
    for first in range(0, max(1, len(folded) - 2), CHUNK):
        part = np.frombuffer(folded[first : first + CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        pairs = part[:-1] * np.uint32(2654435761) + part[1:] * np.uint32(2246822519)
        triples = pairs[:-1] + part[2:] * np.uint32(3266489917)
        counts[:TRIGRAMS] += np.bincount((triples * np.uint32(668265263)) >> np.uint32(20), minlength=TRIGRAMS)
        counts[TRIGRAMS:] += np.bincount((pairs[: len(triples)] * np.uint32(374761393)) >> np.uint32(22), minlength=BIGRAMS)
    blank = np.uint32(32)
    pair = blank * np.uint32(2654435761) + blank * np.uint32(2246822519)
    counts[int((pair + blank * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(20))] = 0  # runs of blanks
    counts[TRIGRAMS + int(pair * np.uint32(374761393) >> np.uint32(22))] = 0
    values = np.sqrt(counts.astype(np.float32))
    length = np.sqrt((values * values).sum())
    return values / length if length > 0 else values


@dataclass
class Duels:
    """One-versus-one machines among ``names``: a row of weights and a bias per pair (first wins if positive)."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    biases: np.ndarray

    def decide(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the winner's number (most duels won, then margins) and a score from 0 to 1."""
        count = len(features)
        if not self.pairs:
            return np.zeros(count, dtype=np.int64), np.ones(count)
        margins = features @ self.weights.T + self.biases
        wins = np.zeros((count, len(self.names)))
        for number, (a, b) in enumerate(self.pairs):
            chance = 1 / (1 + np.exp(-2 * np.clip(margins[:, number], -30, 30)))
            wins[:, a] += (chance > 0.5) + chance * 1e-3
            wins[:, b] += (chance <= 0.5) + (1 - chance) * 1e-3
        best = wins.argmax(axis=1)
        score = np.ones(count)
        for number, (a, b) in enumerate(self.pairs):
            chance = 1 / (1 + np.exp(-2 * np.clip(margins[:, number], -30, 30)))
            score = np.where(best == a, np.minimum(score, chance), np.where(best == b, np.minimum(score, 1 - chance), score))
        return best, score


@dataclass
class LanguageModel:
    families: Duels
    languages: dict[str, Duels]

    def predict(self, features: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.decide(features)
        found = np.empty(len(features), dtype=object)
        score = np.zeros(len(features))
        for number, name in enumerate(self.families.names):
            rows = np.flatnonzero(family == number)
            if len(rows):
                duels = self.languages[name]
                language, within = duels.decide(features[rows])
                found[rows] = np.array(duels.names, dtype=object)[language]
                score[rows] = sure[rows] * within
        return found.tolist(), score


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _features(bodies: pd.Series) -> pd.Series:
    return pd.Series([text_features(b or b"") for b in bodies])


def _fit_duels(rows: DataFrame, column: str, names: list[str]) -> Duels:
    from pyspark.ml.classification import LinearSVC  # here, so that Python workers needn't load it

    names = sorted(names)
    pairs, weights, biases = list(combinations(range(len(names)), 2)), [], []
    for a, b in pairs:
        both = rows.where(F.col(column).isin(names[a], names[b])).select(
            "features", (F.col(column) == names[a]).cast("double").alias("label")
        )
        fitted = LinearSVC(maxIter=30, regParam=1e-3, standardization=False).fit(both)
        weights.append(fitted.coefficients.toArray())
        biases.append(fitted.intercept)
    return Duels(names, pairs, np.array(weights, dtype=np.float32).reshape(len(pairs), WIDTH), np.array(biases))


def fit(docs: DataFrame, text: str, language: str, draw: Column, sample: int = 400) -> LanguageModel | None:
    """Fit on about ``sample`` documents of each language; ``draw`` is a column that tells documents apart.

    Languages are non-null values of ``language`` with a letter in the text; None if there are none.
    """
    from pyspark.ml.functions import array_to_vector

    known = small_batches(docs).where(F.col(language).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    counts = {r[0]: r[1] for r in known.groupBy(language).count().collect()}  # a row a language
    if not counts:
        return None
    share = F.lit(0.0)
    for name, count in counts.items():
        share = F.when(F.col(language) == name, F.lit(min(1.0, sample / count))).otherwise(share)
    chance = F.pmod(F.xxhash64(draw), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    family = F.create_map(*[F.lit(x) for name in sorted(counts) for x in (name, FAMILY_OF.get(name, name))])
    drawn = materialize(
        known.where(chance < share).select(
            F.col(language).alias("language"), family[F.col(language)].alias("family"), _features(F.col(text).cast("binary")).alias("values")
        ),
        "language-sample",
    )
    rows = drawn.select("language", "family", array_to_vector(F.col("values").cast("array<double>")).alias("features"))
    present = drawn.select("language", "family").distinct().collect()  # a row a language
    members: dict[str, list[str]] = {}
    for row in present:
        members.setdefault(row["family"], []).append(row["language"])
    if not members:
        return None
    inside = {name: _fit_duels(rows, "language", languages) for name, languages in members.items()}
    return LanguageModel(_fit_duels(rows, "family", list(members)), inside)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    ``und`` with score 0 if the text is null, empty or has no letter, or nothing could be learned.
    The text alone decides, so equal texts get equal answers. Result columns replace input columns of
    the same name.
    """
    spread = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # WIDTH floats a pair of languages

    @F.pandas_udf("lang string, score double")
    def predict(bodies: pd.Series, lettered: pd.Series) -> pd.DataFrame:
        model = spread.value
        languages, scores = np.full(len(bodies), "und", dtype=object), np.zeros(len(bodies))
        rows = np.flatnonzero(lettered.fillna(False).to_numpy(dtype=bool)) if model else np.array([], dtype=np.int64)
        for first in range(0, len(rows), 256):
            part = rows[first : first + 256]
            found, score = model.predict(np.stack([text_features(bodies.iloc[r]) for r in part]))
            languages[part], scores[part] = found, score
        return pd.DataFrame({"lang": languages, "score": scores})

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    made = docs.withColumn("_made", predict(F.col(text).cast("binary"), lettered))
    return made.withColumns({"lang_pred": F.col("_made.lang"), "score": F.col("_made.score")}).drop("_made")
