"""Small frames with known answers."""

import pytest
from pyspark.sql import functions as F

from groundwork.functions import scalars as S
from groundwork.operators import chronology, components, conflicts, extraction, gating, graph, retrieval, spatial, stratigraphy, tables
from groundwork.sources import files


@pytest.mark.parametrize(("text", "start", "end"), [("1 BCE", 0, 0), ("1550 BC", -1549, -1549), ("ca. 1400 BCE", -1399, -1399), ("1400 - 1550 BCE", -1549, -1399), ("Late Bronze Age", -1550, -1200), ("Middle Bronze Age", -2000, -1550), ("Natufian", -11500, -9600)])
def test_dates(spark, text, start, end):
    r = chronology.dated(spark.createDataFrame([(1, text)], "id int, t string"), "t").first()
    assert (r.date_start, r.date_end) == (start, end)
    assert r.is_approximate == text.startswith("ca.")


def test_year_labels(spark):
    rows = spark.createDataFrame([(-1549.0,), (0.0,), (1.0,)], "y double").select(S.year_label(F.col("y"))).collect()
    assert [r[0] for r in rows] == ["1550 BCE", "1 BCE", "1 CE"]


CAL = [(3350, 40, -1729.0, -1539.85), (2000, 30, -24.7, 110.0), (8000, 50, -7050.0, -6816.0), (2450, 35, -623.0667, -439.0), (2250, 30, -345.6667, -186.55), (1850, 30, 140.0, 260.0), (1620, 25, 380.0, 480.0), (1100, 25, 879.0, 973.0), (10, 40, 1842.0, 1950.0), (14000, 50, -13500.0, -13500.0)]


def test_calibration(spark):
    df = spark.createDataFrame([(float(a), float(s)) for a, s, _, _ in CAL], "age double, sigma double")
    got = {r.age: (round(r.cal_start, 4), round(r.cal_end, 4)) for r in chronology.calibrated(df).collect()}
    assert got == {float(a): (lo, hi) for a, _, lo, hi in CAL}


def _strata(spark, rows):
    full = [(i, 1, above, [], [], b, c) for i, above, b, c in rows]
    return spark.createDataFrame(full, "id long, site_id long, harris_above array<long>, harris_below array<long>, harris_cut_by array<long>, date_start_bce int, date_end_bce int").withColumns({"date_start_ce": F.lit(0), "date_end_ce": F.lit(0)})


@pytest.mark.parametrize(
    ("edges", "parts"),
    [([(1, 2), (2, 3), (3, 1)], [3]), ([(1, 1)], [1]), ([(1, 2), (2, 1)], [2]), ([(1, 2), (2, 1), (3, 4), (4, 3)], [2, 2]), ([(1, 2), (2, 3), (3, 4)], []), ([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5)], [2, 2])],
)
def test_cycles(spark, edges, parts):
    e = spark.createDataFrame(edges, "older long, younger long")
    nodes = spark.createDataFrame(sorted({(x,) for p in edges for x in p}), "id long")
    found = stratigraphy.cycles(nodes, e).groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == parts


def test_levels_and_inversion(spark):
    strata = _strata(spark, [(1, [2], 1400, 1350), (2, [3], 1800, 1750), (3, [4], 0, 0), (4, [], 0, 0)])
    edges = stratigraphy.precedence(strata)
    done, left, _ = stratigraphy.levels(strata, edges)
    assert {r.id: r.level for r in done.collect()} == {1: 0, 2: 1, 3: 2, 4: 3} and left.count() == 0
    assert [(r.older, r.younger) for r in stratigraphy.stratum_inversions(strata, edges).collect()] == [(1, 2)]


def test_positions(spark):
    d = lambda *p: spark.range(1).select(S.haversine_km(*map(F.lit, p)).alias("k"), S.compass(S.bearing_degrees(*map(F.lit, p))).alias("c")).first()
    assert 21 < d(31.7767, 35.2345, 31.8711, 35.4444).k < 24 and d(31.7767, 35.2345, 31.8711, 35.4444).c in ("ENE", "NE")
    assert 88 < d(31.7767, 35.2345, 32.5856, 35.1847).k < 92
    assert d(0.0, 0.0, 1.0, 1.0).k == -1
    assert d(0.0, 179.9, 0.0, -179.9).k < 50


def _sites(spark, points):
    return spark.createDataFrame([(i, f"s{i}", float(a), float(b), 10.0 * i) for i, (a, b) in enumerate(points)], "id long, site_name string, latitude double, longitude double, elevation double")


def test_neighbours_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(89.9, x) for x in range(-180, 180, 60)] + [(-89.9, 5.0), (0.0, 179.95), (0.0, -179.95), (60.0, 179.9), (60.0, -179.9)]
    sites = _sites(spark, points)
    a, b = sites.alias("a"), sites.alias("b")
    for km in (50.0, 700.0, 6000.0):
        km_ = S.haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
        want = {(r[0], r[1]) for r in a.join(b, F.col("a.id") != F.col("b.id")).where(km_ <= km).select("a.id", "b.id").collect()}
        got = [(r.a, r.b) for r in spatial.neighbour_pairs(sites, km).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_clusters(spark):
    sites = _sites(spark, [(10.0, 10.0), (10.0, 10.0), (10.1, 10.1), (50.0, 50.0)])
    assert {r.id: r.cluster for r in spatial.density_clusters(sites, 35, 1).collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    assert spatial.density_clusters(sites, 0, 3).count() == 0
    assert {r.id for r in spatial.density_clusters(sites, 0, 2).collect()} == {0, 1}


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_paths(spark):
    links = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("a", "d", "x"), ("d", "c", "x"), ("e", "f", "x")], "source string, target string, type string")
    known = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    assert tuple(graph.shortest_path(links, known, "a", "c").first()) == (True, 2, "a b c")
    assert graph.shortest_path(links, known, "c", "a", directed=True).first().found is False
    assert {r.node for r in graph.k_hop(links, known, "c", 1)[0].collect()} == {"b", "c", "d"}


@pytest.mark.parametrize(("text", "raw", "value"), [("The trench revealed a 2.5 cm layer of bitumen backing.", "2.5 cm", "0.025 m"), ("a pebble layer 15-25 cm thick", "15-25 cm", "[0.15, 0.25] m"), ("dated 3350 ± 40 BP here", "3350 ± 40 BP", "3350±40 BP"), ("bricks of 7 x 14 x 28 cm", "7 x 14 x 28 cm", "7x14x28 cm"), ("see fig. 12 and Locus 7", "Locus 7", "7")])
def test_mentions(spark, text, raw, value):
    found = extraction.mentions(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r.raw_match, r.normalized_value) for r in found] == [(raw, value)]
    assert text[found[0].span_start : found[0].span_end] == raw


@pytest.mark.parametrize(("text", "rule", "value"), [("As Smith (1956) says", "author_date", None), ("ash 15 cm thick", "measure", "15"), ("occupied from 1920 to 1925", "event", "1920"), ("10% of acid or 3% of alcohol", "two_percentages", None), ("no numbers here", "none", None), ("built 300 BC", "bce", "300")])
def test_attribution(spark, text, rule, value):
    r = extraction.attributed(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.rule, r.raw_value) == (rule, value)


def test_numbers(spark):
    rows = spark.createDataFrame([("1,000,000",), ("1,2,3",), (" 5–6 ",)], "t string").select(S.normal_number(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["1000000", "12,3", "5-6"]


@pytest.mark.parametrize(("text", "value", "how"), [("it is 20-40 cm", "20-40 cm", "direct"), ("it is 20 — 40 cm", "20-40 cm", "range"), ("10.000 men", "10,000", "comma"), ("8 metres", "8 m.", "unit"), ("in 2000 BC", "2000 B.C.", "phrase"), ("nothing", "12", None), ("", "12", None)])
def test_found_in(spark, text, value, how):
    assert spark.createDataFrame([(text, value)], "t string, v string").select(gating.found_in(F.col("t"), F.col("v"))).first()[0] == how


def test_fusion_of_equal_first_ranks(spark):
    one = spark.createDataFrame([(1, 7, 1.0, 1)], "query_id long, chunk_id long, score double, rank int")
    assert abs(retrieval.fused_topk(one, one).first().score - 2 / 61) < 1e-12


def test_paragraphs(spark):
    text = "a" * 150 + "\n\n" + "b" * 100 + "\n\n" + "tail"
    got = retrieval.paragraphs(spark.createDataFrame([("s", 3, text)], "source_id string, page int, text string")).collect()
    assert [r.chunk_id for r in got] == ["s_p3_c0", "s_p3_c1"] and got[1].text == "tail"


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "project_id string, id long, v string")
    delta = spark.createDataFrame([("p", 2, "c", 1), ("p", 2, "d", 2), ("q", 1, "e", 1)], "project_id string, id long, v string, seq long")
    got = {(r.project_id, r.id): r.v for r in tables.upserted(base, delta, "seq").collect()}
    assert got == {("p", 1): "a", ("p", 2): "d", ("q", 1): "e"}
    assert [r.id for r in tables.without_keys(base, base.where("id = 1")).collect()] == [2]


def test_state_and_archive(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"sites": [{"id": "s1", "latitude": 3.5}], "claims": [{"id": "c1", "site_ids": ["s1"]}]}')
    state = files.read_state(spark, str(tmp_path / "state.json"))
    site = state["sites"].first()
    assert (site.project_id, site.site_name, site.latitude, site.aliases) == ("default", "", 3.5, [])
    assert state["claims"].first().anomaly_flag is False and state["notes"].count() == 0
    files.write_state({"sites": state["sites"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/sites")).count() == 1
    m = files.write_archive({"sites": state["sites"]}, str(tmp_path / "archive")).first()
    assert (m.name, m.n_rows, len(m.checksum)) == ("sites", 1, 64)


def test_page_texts_and_documents(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("one\ntwo")
    (tmp_path / "p2.txt").write_text("")
    assert [(r.page_id, r.text) for r in files.read_page_texts(spark, str(tmp_path), "A").collect()] == [("p1", "one\ntwo")]
    (tmp_path / "d.pdf").write_bytes(b"x BT (Hello) Tj (World) TJ ET y BT (!) Tj ET")
    docs = files.text_runs(files.read_documents(spark, str(tmp_path / "d.pdf")))
    assert docs.first().text == "Hello World !"
    assert files.ingested(docs).first().degradation_class == "CLASS_B"


def test_readiness_of_no_claims(spark):
    claims = spark.createDataFrame([], "id long, claim_text string, chapter string, status string, anomaly_flag boolean, verification_status string")
    evidence = spark.createDataFrame([], "id long, claim_id long, evidence_type string")
    flags = conflicts.audit_flags(claims, evidence)
    assert conflicts.readiness(flags, spark.createDataFrame([(0,)], "n long")).first().score == 100


def test_edges_of_a_path(spark):
    links = spark.createDataFrame([("a", "b", "y"), ("a", "b", "x"), ("c", "b", "z"), ("e", "f", "x")], "source string, target string, type string")
    known = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    ends = (("a", "c", "x z"), ("a", "a", ""), ("a", "f", ""))
    assert [graph.with_edges(graph.shortest_path(links, known, a, b), links).first()["edges"] for a, b, _ in ends] == [e for _, _, e in ends]


def test_compound_query_keeps_to_site_and_stratum(spark):
    claims = spark.createDataFrame([(1, "p", [7], [3]), (2, "p", [7, 8], [4]), (3, "p", [8], [3]), (4, "q", [7], [3])], "id long, project_id string, site_ids array<long>, strata_ids array<long>")
    chunks = spark.createDataFrame([(1, 5, 0, "red clay"), (2, 6, 0, "red clay pot")], "chunk_id long, doc_id long, page_ref long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    sources = spark.createDataFrame([(5, "p", "", ""), (6, "q", "", "")], "id long, project_id string, file_path string, archive_path string")
    queries = spark.createDataFrame([(9, "clay", [1.0, 0.0])], "query_id long, query_text string, embedding array<double>")
    ask = lambda **only: sorted((r.kind, r.id) for r in retrieval.compound_query(queries, chunks, vectors, sources, claims, "p", **only).collect())
    assert ask(site=7, stratum=3) == [("claim", 1), ("passage", 1)]
    assert ask(site=7) == [("claim", 1), ("claim", 2), ("passage", 1)] and len(ask()) == 4
