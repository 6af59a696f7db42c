"""Blocks of the index are gathered from sorted postings, whatever the batches."""

import random

import pyarrow as pa
import pytest

from groundwork.operators import search_index


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_no_block_is_cut(monkeypatch, size):
    monkeypatch.setattr(search_index, "GATHERED", 4)
    r = random.Random(size)
    rows = sorted((term, block, c, r.random()) for term in ("a", "b", "é") for block in (0, 1, 2) for c in range(r.choice([1, 2, 9])))
    make = lambda some: pa.RecordBatch.from_pydict({"folder": [len(x[0]) for x in some], "term": [x[0] for x in some], "block": [x[1] for x in some], "w": [x[3] for x in some], "chunk_id": [x[2] for x in some], "tf": [x[2] + 1 for x in some], "length": [7 for _ in some]})
    found = [x for b in search_index._gathered(make(rows[i : i + size]) for i in range(0, len(rows), size)) for x in b.to_pylist()]
    wanted = []
    for key in dict.fromkeys(x[:2] for x in rows):
        own = [x for x in rows if x[:2] == key]
        wanted.append({"folder": 1, "term": key[0], "block": key[1], "n": len(own), "most": max(x[3] for x in own), "postings": [{"chunk_id": x[2], "tf": x[2] + 1, "length": 7} for x in own]})
    assert found == wanted


def test_no_postings():
    assert list(search_index._gathered(iter([]))) == []
