"""The multi-pattern matcher against a search for each term."""

import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators.matching import contained_terms


def every(text, term):
    return [i for i in range(len(text) - len(term) + 1) if text.startswith(term, i)]


@pytest.mark.parametrize("range_terms, range_chars", [(200_000, 3_000_000), (7, 1000), (1000, 40)])
def test_equals_a_search_for_each_term(spark, range_terms, range_chars):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    terms = [word(rng.randrange(1, 6)) for _ in range(60)] + ["aa", "aaa", "a", "aa", "", None, "b" * 500]
    texts = [None, "", "a", "aaaa", "b" * 1200, "a" * 300_000] + [word(rng.randrange(80)) for _ in range(80)]
    df = spark.createDataFrame([(i % 50, t, "clash", "clash") for i, t in enumerate(texts)], "doc int, body string, term string, n string")
    got = sorted(map(tuple, contained_terms(df, spark.createDataFrame([(t,) for t in terms], "name string"), "doc", "body", "name", range_terms, range_chars).collect()))
    want = []
    for i, t in enumerate(texts):
        for term in {x for x in terms if x}:
            found = every(t or "", term)
            if found:
                want.append((i % 50, term, len(found), found[0]))
    assert got == sorted(want)


def test_no_terms_and_no_texts(spark):
    texts = spark.createDataFrame([("x", "abc")], "id string, text string")
    assert contained_terms(texts, spark.createDataFrame([("",), (None,)], "term string"), "id", "text").collect() == []
    assert contained_terms(texts.limit(0), spark.createDataFrame([("a",)], "term string"), "id", "text").dtypes == [("id", "string"), ("term", "string"), ("n", "bigint"), ("first", "bigint")]


def test_a_million_terms(spark):
    terms = spark.range(1_000_000).select(F.concat(F.lit("name "), F.hex(F.xxhash64("id"))).alias("term"))
    some = [r.term for r in terms.where("id % 100003 = 7").collect()]
    texts = spark.createDataFrame([(i, f"{'x' * i} {t} and {some[0]}, {t[:-1]}") for i, t in enumerate(some)], "id long, text string")
    got = sorted((r.id, r.term) for r in contained_terms(texts, terms, "id", "text").collect())
    assert len(some) == 10 and set(got) >= {(i, t) for i, t in enumerate(some)} | {(i, some[0]) for i in range(10)}
    names = {r.term for r in terms.collect()}
    assert set(got) == {(i, t) for i, x in enumerate(texts.collect()) for t in {x.text[a:b] for a in range(len(x.text)) for b in range(a + 6, min(a + 22, len(x.text)) + 1)} if t in names}
