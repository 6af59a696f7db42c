"""Cells around pivots against all inner products."""

import random

import numpy as np
import pytest

from groundwork.operators.retrieval import dense_topk
from groundwork.operators.vector_cells import nearest_vectors, scanned_share


def scaled(v):
    v = np.array(v[:128], float)
    s = float(v @ v)
    return v / s**0.5 if s > 1e-12 and abs(s - 1) > 1e-6 else v


def brute(queries, vectors, k):
    out = []
    for q, a in queries:
        rows = []
        for c, b in vectors:
            if a is not None and b is not None:
                x, y = scaled(a), scaled(b)
                n = min(len(x), len(y))
                rows.append((-round(float(x[:n] @ y[:n]), 9), c))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("pivots, block, group", [(None, 8192, 4096), (9, 7, 3), (1, 1000, 1000)])
def test_equals_all_pairs(spark, pivots, block, group):
    rng = random.Random(5)
    near = lambda c: [x + rng.gauss(0, 0.05) for x in c]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    vectors = [(f"c{i:03d}", near(centres[i % 8])) for i in range(200)] + [(f"d{i}", centres[0]) for i in range(40)] + [("n", None), ("z", [0.0] * 6), ("s", [1.0, 2.0]), ("e", []), ("l", centres[1] + [3.0, 1.0])]
    queries = [(i, near(centres[i % 8])) for i in range(20)] + [(50, None), (51, [0.0] * 6), (52, [1.0])]
    qs, vs = spark.createDataFrame(queries, "query_id int, embedding array<float>"), spark.createDataFrame(vectors, "chunk_id string, embedding array<float>")
    queries = [(q, None if v is None else [float(np.float32(x)) for x in v]) for q, v in queries]
    vectors = [(c, None if v is None else [float(np.float32(x)) for x in v]) for c, v in vectors]
    for k in (1, 5, 300):
        found = nearest_vectors(qs, vs, k, pivots, block, group).collect()
        best = {}
        for r in found:
            best.setdefault(r.query_id, []).append((-round(r.score, 9), r.chunk_id))
        got = sorted((q, i + 1, c, -s) for q, rows in best.items() for i, (s, c) in enumerate(sorted(rows)[:k]))
        assert [x[:3] for x in got] == [x[:3] for x in brute(queries, vectors, k)]
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in dense_topk(qs, vs, 5).collect())
    assert got == [x[:3] for x in brute(queries, vectors, 5)]
    if pivots == 9:
        assert scanned_share(qs, vs, 5, pivots) < 0.6
    assert dense_topk(qs, vs.limit(0), 5).count() == 0 == dense_topk(qs.limit(0), vs, 5).count()


def test_a_task_holds_a_bounded_table_of_scores(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from groundwork.operators import vector_cells as cells

    rng = np.random.default_rng(5)
    make = lambda name, n: pa.table({name: np.arange(n)[::-1], "v": list(rng.integers(-3, 4, (n, 8)).astype(float))})
    vectors, queries = make("id", 4000), make("query", 1500)
    best = cells._best(5, 8, pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]))
    monkeypatch.setattr(cells, "TABLE", 10**9)
    whole = best(vectors, queries)
    monkeypatch.setattr(cells, "TABLE", 50_000)
    tracemalloc.start()
    cut = best(vectors, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cut.drop_columns("score").equals(whole.drop_columns("score")) and np.allclose(cut["score"], whole["score"])
    assert peak < 20_000_000  # all scores at once are 48 MB, and were held several times


def test_coordinates_beyond_the_first_128_count(spark, monkeypatch):
    from groundwork.operators import vector_cells as cells

    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 300))
    x[:, :128] = rng.normal(size=128)  # these say nothing
    vectors, queries = [(i, r.tolist()) for i, r in enumerate(x)], [(i, r.tolist()) for i, r in enumerate(x[:30] + rng.normal(scale=0.3, size=(30, 300)))]
    u, q = (np.array([r for _, r in rows]) for rows in (vectors, queries))
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T, 9)
    want = [(i, r + 1, int(c)) for i, row in enumerate(scores) for r, c in enumerate(np.lexsort((np.arange(120), -row))[:5])]
    qs, vs = spark.createDataFrame(queries, "query_id int, embedding array<double>"), spark.createDataFrame(vectors, "chunk_id int, embedding array<double>")
    for table in (cells.TABLE, 9000):  # also in units of 30 vectors
        monkeypatch.setattr(cells, "TABLE", table)
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in dense_topk(qs, vs, 5).collect()) == want
