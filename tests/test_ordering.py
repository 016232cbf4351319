"""Dense ids, running totals and order statistics against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators.ordering import dense_index, quantiles, running_total


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    # A third of all rows share one value.
    rows = [(i, 5.0 if rng.random() < 0.34 else round(rng.random() * 10, 2), rng.choice("abc") if i % 3 else "a") for i in range(2000)]
    return rows, spark.createDataFrame(rows, "id int, v double, g string").repartition(7)


def test_dense_index(numbers):
    rows, df = numbers
    got = {r.id: r.n for r in dense_index(df, [F.desc("v"), F.col("id")], "n").collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_running_total(numbers):
    rows, df = numbers
    got = {r.id: r.t for r in running_total(df, [F.col("v"), F.col("id")], "id", "t").collect()}
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        total += r[0]
        want[r[0]] = total
    assert got == want


def nearest(values, q):
    return sorted(values)[math.floor(q * (len(values) - 1) + 0.5)]


@pytest.mark.parametrize("few", [False, True])
def test_quantiles(numbers, few):
    rows, df = numbers
    got = quantiles(df, "v", {"p10": 0.1, "p90": 0.9}, ["mid"], few_values=few).first()
    values = [r[1] for r in rows]
    assert (got.p10, got.p90, got.mid) == (nearest(values, 0.1), nearest(values, 0.9), float(np.median(values)))


@pytest.mark.parametrize("few", [False, True])
def test_grouped_quantiles(numbers, few):
    rows, df = numbers
    got = {r.g: r for r in quantiles(df, "v", {"p10": 0.1, "p50": 0.5}, ["mid"], by="g", few_values=few).collect()}
    for g in "abc":
        values = [r[1] for r in rows if r[2] == g]
        assert (got[g].p10, got[g].p50, got[g].mid) == (nearest(values, 0.1), nearest(values, 0.5), float(np.median(values)))


def test_documented_order_statistics(spark):
    # 7 716 values: the low threshold is the value with 0-based index 772.
    got = quantiles(spark.range(7716).toDF("id"), "id", {"p10": 0.1, "p90": 0.9}).first()
    assert (got.p10, got.p90) == (772, 6944)
