"""Exact percentiles and byte histograms."""

import random

import numpy as np
import pytest

from groundwork.operators.retrieval import exact_percentiles, histogram_vectors, latency


@pytest.mark.parametrize("kind", ["hot", "wide", "two"])
def test_percentiles_are_exact(spark, kind):
    rng = random.Random(3)
    values = {"hot": [7.0] * 500 + [rng.uniform(0, 9) for _ in range(300)], "wide": [10 ** rng.uniform(-300, 300) * rng.choice([1, -1]) for _ in range(300)], "two": [1.0, 2.0]}[kind]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "ms double")
    shares = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.95, "e": 1.0}
    got = exact_percentiles(df, "ms", shares, few=60, accuracy=50).first()
    assert np.allclose([got[x] for x in shares], np.quantile(values, list(shares.values())), rtol=1e-12, atol=0)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "ms double")
    assert tuple(latency(df).first()) == (None,) * 6


def test_histogram_vectors(spark):
    df = spark.createDataFrame([(1, "aab"), (2, None), (3, ""), (4, "é" * 100_000)], "id long, text string")
    rows = {r.id: r.embedding for r in histogram_vectors(df, "id").collect()}
    assert rows[2] == rows[3] == [0.0] * 128
    assert abs(rows[1][97] - 2 / 5**0.5) < 1e-12 and abs(rows[1][98] - 1 / 5**0.5) < 1e-12 and sum(x > 0 for x in rows[1]) == 2
    assert abs(rows[4][0xC3 % 128] - 0.5**0.5) < 1e-12 and abs(rows[4][0xA9 % 128] - 0.5**0.5) < 1e-12
