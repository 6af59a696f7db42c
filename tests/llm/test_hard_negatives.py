"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.llm import hard_negatives as hn


def brute(rows, anchor, positives=5, negatives=10, least=30, most=90):
    """rows: (id, label, vector)."""
    fine = {(i, l, tuple(max(-hn.MOST, min(hn.MOST, math.floor(256 * x))) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in fine:
        if not anchor(a[0]):
            continue
        scored = [(b, sum(x * y for x, y in zip(a[2], b[2], strict=True))) for b in fine if b != a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda r: (-r[1], r[0][0]))
        for p, ps in [r for r in scored if r[0][1] == a[1]][:positives]:
            found = [(b[0], s) for b, s in scored if b[1] != a[1] and least * ps <= 100 * s <= most * ps][:negatives]
            out += [(a[0], p[0], k + 1, b, ps, s) for k, (b, s) in enumerate(found)]
    return sorted(out)


def asked(spark, rows, **more):
    df = spark.createDataFrame([(i, l, v, "clash", "clash", "clash") for i, l, v in rows], "vec_id long, label int, embedding array<float>, anchor string, q string, rank string")
    out = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), **more)
    return sorted(tuple(r) for r in out.collect())


def numbers(rng, n, dim):
    return [float(np.float32(rng.gauss(0, 0.2))) for _ in range(dim)] if n else [0.0] * dim


@pytest.mark.parametrize("block, group", [(40, 3), (None, 4096)])
def test_equals_brute_force(spark, block, group):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), numbers(rng, i % 17, 12)) for i in range(260)]
    rows += [(i, rows[0][1], rows[1][2]) for i in range(300, 380)]  # ties, a hot vector
    rows += rows[:30]  # repeated rows
    rows += [(10, 1, rows[5][2]), (20, 2, rows[6][2])]  # other rows of an id
    rows += [(400, None, rows[1][2]), (410, 1, None), (420, 1, [None] * 12), (430, 1, [float("nan")] * 12), (440, 1, [float("inf")] * 12), (None, 1, rows[1][2]), (450, 1, []), (451, 2, []), (452, 1, []), (460, 1, [0.5, 0.5]), (461, 1, [0.5, 0.25]), (462, 2, [0.25, 0.25]), (470, 1, [-1e30] * 12), (480, 0, [3e6] * 11 + [0.1])]
    got = asked(spark, rows, block_rows=block, group_anchors=group)
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == want and {r[0] for r in want} >= {460, 470, 480} and len(want) > 500


def test_few_rows(spark):
    assert asked(spark, []) == [] and asked(spark, [(10, 1, [1.0])]) == [] and asked(spark, [(11, 1, [1.0]), (12, 1, [1.0]), (13, 2, [0.5])]) == []
    rows = [(10, 1, [1.0]), (12, 1, [1.0]), (13, 2, [0.5])]
    assert asked(spark, rows) == brute(rows, lambda i: i == 10) == [(10, 12, 1, 13, 65536, 32768)]


def test_bounds_shrink_the_bitmap():
    """With energy in few dimensions most rows are not read to the end, and the best are those of all products."""
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((3000, 64)) * (200 * 0.8 ** np.arange(64))).astype(np.int64)
    block = hn.Block(np.arange(3000), np.zeros(3000), vectors, int(np.abs(vectors).max()))
    for a in vectors[:20]:
        at, score, read = block.scan(a, np.ones(3000, bool), hn.among_best(5))
        all_ = vectors @ a
        assert sorted(score)[-5:] == sorted(all_)[-5:] and read < 0.5 * vectors.size
        windows = [(int(0.3 * s), int(0.9 * s)) for s in sorted(all_)[-5:]]
        at, score, _ = block.scan(a, np.ones(3000, bool), hn.best_in_windows(windows, 10))
        for lo, hi in windows:
            assert sorted(score[(score >= lo) & (score <= hi)])[-10:] == sorted(all_[(all_ >= lo) & (all_ <= hi)])[-10:]
