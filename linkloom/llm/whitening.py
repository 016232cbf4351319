"""Embedding whitening by spectrum slicing.

Spark sums the vectors and their centred products; what is left is a symmetric matrix of one row a
dimension. The number of negative pivots of its shifted LDL' factorisation is the number of eigenvalues below the
shift (Sylvester's law of inertia), so halving an interval until it holds one eigenvalue isolates each
of the leading ones. Rayleigh quotient iteration then converges cubically from inside that interval, and
the counts on either side of the result certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import small_batches

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more are treated as non-finite; below it floor(SCALE * c) is exact.
LIMIT = float(2**42)
#: Eigenvalues under this part of the largest, times the dimensions, are rounding errors of a rank-deficient table.
RANK_TOLERANCE = 1e-13
#: Factor of Bunch and Kaufman: how small a diagonal entry may be against its column as a pivot of its own.
PIVOT_FACTOR = (1 + 17**0.5) / 8
LONG_MAX = 2**63 - 1


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``matrix`` below ``shift``: negative pivots of LDL' of the shifted matrix.

    Pivots are single entries or blocks of two, chosen by the rule of Bunch and Kaufman, so the factorisation
    of an indefinite matrix stays bounded. A pivot of zero counts as positive: an eigenvalue at the shift.
    """
    a = matrix - shift * np.eye(len(matrix))
    scale = np.abs(a).max(initial=0.0)
    negative = 0
    while len(a):
        n = len(a)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        largest = column[r - 1] if n > 1 else 0.0
        if largest <= np.finfo(float).eps * scale * 1e-3:
            negative += a[0, 0] < 0
            a = a[1:, 1:]
            continue
        if abs(a[0, 0]) < PIVOT_FACTOR * largest:
            row = np.abs(a[r])
            row[r] = 0.0
            if abs(a[0, 0]) * row.max() >= PIVOT_FACTOR * largest * largest:
                pass  # the first entry will do after all
            elif abs(a[r, r]) >= PIVOT_FACTOR * row.max():
                a = _swapped(a, 0, r)
            else:
                a = _swapped(a, 1, r)
                block, rest = a[:2, :2], a[2:, :2]
                low = np.linalg.eigvalsh(block)
                negative += int((low < 0).sum())
                a = a[2:, 2:] - rest @ np.linalg.solve(block, rest.T)
                a = (a + a.T) / 2
                continue
        negative += a[0, 0] < 0
        a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0]) / a[0, 0]
    return int(negative)


def _swapped(a: np.ndarray, i: int, j: int) -> np.ndarray:
    order = np.arange(len(a))
    order[[i, j]] = order[[j, i]]
    return a[np.ix_(order, order)]


def rayleigh(matrix: np.ndarray, start: np.ndarray, shift: float, found: np.ndarray, norm: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from two steps of inverse iteration at ``shift``, across the vectors ``found``."""
    identity, vector, value = np.eye(len(matrix)), start, shift
    for step in range(40):
        vector = vector - found.T @ (found @ vector)
        vector /= np.linalg.norm(vector)
        if step >= 3:
            value = float(vector @ matrix @ vector)
            if np.linalg.norm(matrix @ vector - value * vector) <= 4 * np.finfo(float).eps * norm:
                break
        try:
            moved = np.linalg.solve(matrix - value * identity, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            moved = np.linalg.solve(matrix - (value + np.finfo(float).eps * norm) * identity, vector)
        if not np.isfinite(moved).all():
            break
        vector = moved / np.abs(moved).max()
    vector = vector - found.T @ (found @ vector)
    vector /= np.linalg.norm(vector)
    return float(vector @ matrix @ vector), vector


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) and their unit vectors as rows; fewer if the rank is lower.

    Eigenvalue number k lies between two shifts with at most n - k and at least n - k + 1 eigenvalues below them. The interval is
    halved until it holds no other, or until it is as narrow as rounding errors: equal eigenvalues share it, and
    their vectors are told apart by keeping each across the ones before it.
    """
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    values, vectors = [], np.empty((0, size))
    random = np.random.default_rng(12)
    narrow = max(1, size) * np.finfo(float).eps * norm
    counted: dict[float, int] = {-norm * 1.001: 0, norm * 1.001: size}

    def below(shift: float) -> int:
        if shift not in counted:
            counted[shift] = inertia(matrix, shift)
        return counted[shift]

    for number in range(1, min(count, size) + 1):
        wanted = size - number  # eigenvalues below it
        if norm == 0:
            break
        low = max(s for s, n in counted.items() if n <= wanted)
        high = min(s for s, n in counted.items() if n > wanted)
        while True:
            while high - low > narrow and not (below(low) == wanted and below(high) == wanted + 1):
                middle = (low + high) / 2
                low, high = (middle, high) if below(middle) <= wanted else (low, middle)
            value, vector = rayleigh(matrix, random.standard_normal(size), (low + high) / 2, vectors, norm)
            if low - narrow <= value <= high + narrow or high - low <= narrow:
                break
            middle = (low + high) / 2  # it went to a neighbour: start closer
            low, high = (middle, high) if below(middle) <= wanted else (low, middle)
        if value <= RANK_TOLERANCE * size * (values[0] if values else value) or value <= narrow:
            break
        if below(value - 8 * narrow) > wanted or below(value + 8 * narrow) <= wanted:
            raise ArithmeticError(f"eigenvalue {number} isn't certified by its inertia counts")
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: one number a dimension and a vector a component; ``spread`` bounds max - min of x."""

    count: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    spread: int

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 a row, exact; null if a long can't hold it."""
        if len(self.sums) * (self.count * self.spread) ** 2 <= LONG_MAX:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in centred.tolist()]
        return [value if value <= LONG_MAX else None for value in exact]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.count) @ self.vectors.T / np.sqrt(self.values)


def quantised(values: pd.Series) -> np.ndarray:
    """x of every entry, a row a vector."""
    stacked = np.stack(values.to_list()).astype(np.float64)
    return np.floor(SCALE * stacked).astype(np.int64) + SHIFT


def _times(x: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S; Python's whole numbers where 64 bits might not do."""
    if count * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        return x * count - sums
    return x.astype(object) * count - sums.astype(object)


def sound(vector: Column) -> Column:
    """Whether a vector is not null and all its entries are finite numbers of a size that can be quantised."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LIMIT)))
    return F.coalesce(usable, F.lit(False))


def _sum_rows(parts: DataFrame, width: int) -> np.ndarray:
    """Rows of the same ``row`` number added up by Spark, as a matrix; one row a dimension reaches the driver."""
    rows = parts.groupBy("row").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).orderBy("row").collect()
    return np.array([[r[f"v{k}"] for k in range(width)] for r in rows])


def whiten(
    vectors: DataFrame, components: int = 8, key: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row a vector and component.

    Null vectors and vectors with null, non-finite or immense entries (2^42 and up) drop out. The others
    are the fit list if they have the most common length (ties: the longest); vectors of another length
    have no place in its covariance and drop out as well, as do empty ones. Repeated rows and rows with a
    null key count and are returned like any. Components whose eigenvalue is zero up to rounding can't be whitened and
    are left out, so a table of one vector, or of equal ones, gives no rows, like an empty table. Equal
    eigenvalues have an arbitrary, common choice of vectors. Other columns are not read.
    """
    spark = vectors.sparkSession
    numbers = F.col(embedding).cast("array<double>")
    rows = small_batches(vectors).select(F.col(key).alias("_key"), numbers.alias("_vector")).where(sound(F.col("_vector")) & (F.size("_vector") > 0))
    schema = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("_vector").alias("length")).agg(F.count(F.lit(1)).alias("count"))
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return _named(spark.createDataFrame([], schema), vectors, key)
    length, count = common
    rows = rows.where(F.size("_vector") == length)
    model = fit(rows, length, count, components)
    shared = spark.sparkContext.broadcast(model)  # a vector a component
    error = _identity_error(rows, shared, len(model.values))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, k = shared.value, len(shared.value.values)
        for batch in batches:
            if not len(batch) or not k:
                continue
            centred = _times(quantised(batch["_vector"]), model.count, model.sums)
            yield pd.DataFrame(
                {
                    "key": batch["_key"].astype("Int64").repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)),
                    "n": model.count,
                    "deviation": pd.array(model.deviations(centred), dtype="Int64").repeat(k),
                    "whitened": model.whitened(centred).ravel(),
                    "explained": np.tile(model.values / model.trace, len(batch)),
                    "identity_error": error,
                }
            )

    return _named(rows.mapInPandas(project, schema), vectors, key)


def _named(made: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return made.withColumn("key", F.col("key").cast(vectors.schema[key].dataType)).withColumnRenamed("key", key)


def fit(rows: DataFrame, length: int, count: int, components: int) -> Whitening:
    """Sums, centred covariance and its leading components, over all ``rows`` (_vector, of one length).

    Two passes: whole numbers are added first, then the products of what is left after centring, so that the
    covariance doesn't suffer from the large mean. A task gives one row a dimension.
    """

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, low, high = np.zeros(length, dtype=object), None, None  # whole numbers of any size
        for batch in batches:
            if len(batch):
                x = quantised(batch["_vector"])
                sums = sums + x.sum(axis=0).astype(object)  # a batch fits in 64 bits
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pd.DataFrame({"row": np.arange(length), "total": [Decimal(int(v)) for v in sums], "low": low, "high": high})

    parts = rows.select("_vector").mapInPandas(totals, "row int, total decimal(38,0), low long, high long")
    per = parts.groupBy("row").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("row").collect()
    exact = [int(r["total"]) for r in per]
    sums = np.array(exact, dtype=np.int64 if max(map(abs, exact)) < 2**62 else object)
    spread = max(r["high"] - r["low"] for r in per)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((length, length))
        some = False
        for batch in batches:
            if len(batch):
                centred = _times(quantised(batch["_vector"]), count, sums).astype(np.float64) / count
                total += centred.T @ centred
                some = True
        if some:
            yield pd.DataFrame({"row": np.arange(length), "v": list(total)})

    covariance = _sum_rows(rows.select("_vector").mapInPandas(products, "row int, v array<double>"), length) / count
    covariance = (covariance + covariance.T) / 2
    values, directions = leading_components(covariance, components)
    return Whitening(count, sums, values, directions, float(np.trace(covariance)), spread)


def _identity_error(rows: DataFrame, shared, k: int) -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity), from the vectors themselves."""
    if k == 0:
        return 0.0

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total = shared.value, np.zeros((k, k + 1))
        for batch in batches:
            if len(batch):
                w = model.whitened(_times(quantised(batch["_vector"]), model.count, model.sums))
                total[:, :k] += w.T @ w
                total[:, k] += w.sum(axis=0)
        yield pd.DataFrame({"row": np.arange(k), "v": list(total)})

    total = _sum_rows(rows.select("_vector").mapInPandas(products, "row int, v array<double>"), k + 1) / shared.value.count
    mean = total[:, k]  # zero up to rounding: the vectors were centred before they were projected
    return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max())
