"""Sources and sinks that no query reaches."""

import json

from groundwork.operators import retrieval
from groundwork.sources import files
from groundwork.views import load


def test_catalog(spark, tmp_path):
    names, kinds = zip(*(c.split() for c in files.CATALOG.split(", ")), strict=True)
    row = ["-5" if kind in ("int", "bigint") else f"text of {n}, é" for n, kind in zip(names, kinds, strict=True)]
    (tmp_path / "catalog.csv").write_text(",".join(names) + "\n" + ",".join(f'"{x}"' for x in row) + "\n")
    got = files.read_catalog(spark, str(tmp_path / "catalog.csv")).collect()
    assert [list(map(str, r)) for r in got] == [row]


def test_passages(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"text {i} é" * i) for i in range(100)], "chunk_id long, text string")
    files.write_passages(chunks, str(tmp_path / "store"))
    ids = spark.createDataFrame([(3,), (3,), (77,), (1000,), (None,)], "chunk_id long")
    assert sorted(map(tuple, files.read_passages(spark, str(tmp_path / "store"), ids).collect())) == [(3, "text 3 é" * 3), (77, "text 77 é" * 77)]


def test_ground_truth_and_page_texts(spark, tmp_path):
    rows = [{"page_id": "p1", "type": "date", "description": "d", "true_value": "1200 BCE"}, {"page_id": "p2", "type": "count", "description": None, "true_value": "7"}]
    (tmp_path / "truth.json").write_text(json.dumps(rows))
    assert [r.asDict() for r in files.read_ground_truth(spark, str(tmp_path / "truth.json")).orderBy("page_id").collect()] == rows
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p1.txt").write_text("Line\n1200 BCE")
    (tmp_path / "a" / "p2.txt").write_text(" ")
    assert [tuple(r) for r in files.read_page_texts(spark, str(tmp_path / "a"), "one").collect()] == [("p1", "Line\n1200 BCE", "one")]


def test_export_all(spark, data, tmp_path):
    tables = {n: load(spark, data, n) for n in files._NAMES}
    made = files.export_all(tables, str(tmp_path / "out"))
    counts = {n: df.count() for n, df in tables.items()}
    rows = {r.name: r for r in made.collect()}
    assert {n: r.n_rows for n, r in rows.items()} == counts
    assert {(r.source_count, r.claim_count, r.schema_version) for r in rows.values()} == {(counts["sources"], counts["claims"], "1.0")}
    assert {n: spark.read.json(f"{tmp_path}/out/archive/{n}").count() for n in counts} == counts
    assert spark.read.text(f"{tmp_path}/out/bibliography", wholetext=True).selectExpr("sum(size(split(value, '@(article|book)')) - 1)").first()[0] == counts["sources"]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/report").collect()]
    assert sum(x.startswith("## ") for x in lines) == 7 and len(lines) > sum(counts[n] for n in ("sites", "strata", "claims"))


def test_page_limits(spark):
    chunks = spark.createDataFrame([(i, i % 2, i, "word " * (i + 1)) for i in range(10)], "chunk_id long, doc_id long, page_ref int, text string")
    hits = retrieval.bm25_topk(spark.createDataFrame([(1, "word")], "query_id long, query_text string"), chunks, 10)
    pages = lambda **only: sorted(r.chunk_id for r in retrieval.allowed(hits, chunks, **only).collect())
    assert pages(min_page=3) == [3, 4, 5, 6, 7, 8, 9] and pages(max_page=0) == [0] and pages(doc=1, min_page=2, max_page=6) == [3, 5]
    assert pages(docs=spark.createDataFrame([(0,)], "doc_id long")) == [0, 2, 4, 6, 8]
