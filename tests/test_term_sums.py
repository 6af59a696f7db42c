"""Terms counted on raw bytes against tokens(), and sums in slices against plain ones."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork import registry
from groundwork.operators import retrieval, term_sums
from groundwork.operators.retrieval import STOP_WORDS, bm25_topk, tokens

TEXTS = ["Ash", "ash2b Ash-ash", None, "", "the KKelvin İstanbul été x xy", "ash", "Über\nash\x00clay\U0001f600pit a", "  ", "CLAY the clay of1 of", "ash"]


def test_cut_as_tokens(spark, monkeypatch):
    monkeypatch.setattr(term_sums, "TEXT", 12)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    wanted = {r.id: Counter(r.t or []) for r in df.select("id", tokens(F.col("text")).alias("t")).collect()}
    words = sorted({w for c in wanted.values() for w in c})
    sent = type("Sent", (), {"value": words})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["id", "text"])
    rows = [r for b in term_sums.counted(sent, STOP_WORDS, pa.int64())(iter([batch.slice(0, 4), batch.slice(4)])) for r in b.to_pylist()]
    assert {r["id"]: {words[t]: n for t, n in zip(r["terms"], r["counts"], strict=True)} for r in rows} == wanted
    assert {r["id"]: r["length"] for r in rows} == {i: c.total() for i, c in wanted.items()}


@pytest.mark.parametrize(("sums", "pairs"), [(1 << 21, 1_000_000), (3, 1_000_000), (40, 2)])
def test_best_passages_as_by_plain_sums(spark, monkeypatch, sums, pairs):
    monkeypatch.setattr(term_sums, "SUMS", sums)
    texts = [(i, " ".join(f"w{j}" for j in range(1, 9) if i % (j + 1) == 0) + " w1" * (i % 3)) for i in range(120)] + [(7, "w1 w2"), (7, "w2 w2"), (8, None)]
    asked = [(q, " ".join(f"w{1 + (q * j) % 9}" for j in range(1, 4)) + " w1 nowhere") for q in range(9)]
    found = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in bm25_topk(spark.createDataFrame(asked, "query_id long, query_text string"), spark.createDataFrame(texts, "chunk_id long, text string").repartition(3), 4, range_pairs=pairs).collect())
    bags = [(i, (t or "").split()) for i, t in texts]
    # texts of one passage and equal length are one, as the search has it
    joined = {}
    for i, words in bags:
        joined.setdefault((i, len(words)), Counter()).update(words)
    mean, n = sum(len(w) for _, w in bags) / len(bags), len(bags)
    df = Counter(w for c in joined.values() for w in c)
    wanted = []
    for q, text in asked:
        scores = Counter()
        for (i, size), c in joined.items():
            for w, times in Counter(text.split()).items():
                if c[w]:
                    scores[i] += times * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
        wanted += [(q, r, i, round(s, 9)) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4], 1)]
    assert [f[:3] for f in found] == [w[:3] for w in wanted]
    assert all(abs(f[3] - w[3]) < 2e-9 for f, w in zip(found, wanted, strict=True))


def test_targets_are_found_once_for_both_methods(spark, data, monkeypatch):
    calls, stored = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df: (calls.append(df.columns), stored(df))[1])
    assert registry.queries()["r7_methods_quality"](spark, data).count() == 2
    assert calls.count(["query_id", "chunk_id"]) == 1
