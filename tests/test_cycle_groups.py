"""Cycles in groups of equal signatures, searched in tasks or by pivots, against plain searches; their rounds."""

import numpy as np
import pyarrow as pa
import pytest

from groundwork.operators import stratigraphy
from tests.test_strata_rounds import _expected, _frames, _graph


@pytest.mark.parametrize("seed", range(40))
def test_strong_parts_of_edges(seed):
    nodes, edges = _graph(seed)
    edges = {(a, b) for a, b in edges if a != b}
    ids, parts = stratigraphy._strong_parts(np.array([a for a, _ in edges], dtype=np.int64), np.array([b for _, b in edges], dtype=np.int64))
    assert dict(zip(ids.tolist(), parts.tolist(), strict=True)) == _expected(nodes, edges)[2]


def test_groups_are_never_cut(monkeypatch):
    monkeypatch.setattr(stratigraphy, "MOST_LOCAL", 4)
    rows = [(g, 10 * g + i, 10 * g + (i + 1) % 3) for g in range(7) for i in range(3)]
    batches = [pa.RecordBatch.from_pydict({"g": [r[0] for r in rows[i : i + 2]], "older": [r[1] for r in rows[i : i + 2]], "younger": [r[2] for r in rows[i : i + 2]]}) for i in range(0, len(rows), 2)]
    found = [x for b in stratigraphy._searched(iter(batches)) for x in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True)]
    assert dict(found) == {10 * g + i: 10 * g for g in range(7) for i in range(3)} and len(found) == 21


@pytest.mark.parametrize(("growth", "local"), [(8, 0), (0, 2), (0, 100)])
def test_large_groups_go_on_by_pivots(spark, growth, local):
    nodes, edges = _graph(5)
    edges |= {(a, b) for a, b in zip(nodes[:4], [*nodes[1:4], nodes[0]], strict=True)}
    n, e = _frames(spark, nodes, edges)
    assert {r.id: r.component for r in stratigraphy.cycles(n, e, growth, local).collect()} == _expected(nodes, edges)[2]


def test_components_that_follow_each_other_take_few_rounds(spark, monkeypatch):
    written = []
    real = stratigraphy.stored
    monkeypatch.setattr(stratigraphy, "stored", lambda df: written.append(1) or real(df))
    edges = [x for i in range(40) for x in ((2 * i, 2 * i + 1), (2 * i + 1, 2 * i), (2 * i + 1, 2 * i + 2), (i, 2 * i))]
    n, e = _frames(spark, range(81), [x for x in edges if x != (0, 0)])
    found = {r.id: r.component for r in stratigraphy.cycles(n, e).collect()}
    assert found == _expected(list(range(81)), {x for x in edges if x != (0, 0)})[2]
    assert len(written) < 40
