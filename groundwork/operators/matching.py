"""Which of many terms a text contains, for any number of terms.

Terms are dealt by hash into ranges of bounded size.  Each range is compiled to an
Aho-Corasick automaton in the workers, which reads a text once, whatever the number
of its terms; overlapping and nested terms are all found.  Texts are not moved: the
terms of one range are sent to the tasks, so a dictionary of one range costs one
pass over the texts and no shuffle, and a larger one costs a pass for each range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from groundwork.plans.scratch import spread, stored

#: Bounds of a range: terms and their characters.  The automaton of a worker takes some 60 bytes a character.
RANGE_TERMS, RANGE_CHARS = 200_000, 3_000_000
_COMPILED: dict[str, ahocorasick.Automaton] = {}


def _compiled(key: str, terms: list[str]) -> ahocorasick.Automaton:
    """The automaton of a range; a worker keeps the last one only."""
    if key not in _COMPILED:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            made.add_word(term, i)
        made.make_automaton()
        _COMPILED.clear()
        _COMPILED[key] = made
    return _COMPILED[key]


def _found(key: str, sent, kind: pa.DataType):
    """Batches (id, text) -> (id, term, n, first), a row for each term in a text."""
    names = ["id", "term", "n", "first"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        automaton = _compiled(key, terms)
        at, which, count, first = [], [], [], []
        for batch in batches:
            ids = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits: dict[int, list[int]] = {}
                for end, term in automaton.iter(text or ""):
                    hit = hits.setdefault(term, [0, end])
                    hit[0] += 1
                for term, (n, end) in hits.items():
                    at.append(i)
                    which.append(terms[term])
                    count.append(n)
                    first.append(end - len(terms[term]) + 1)
                if len(at) >= 20_000:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(kind), pa.array(which), pa.array(count, pa.int64()), pa.array(first, pa.int64())], names)
                    at, which, count, first = [], [], [], []
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(kind), pa.array(which), pa.array(count, pa.int64()), pa.array(first, pa.int64())], names)
                at, which, count, first = [], [], [], []

    return of


def contained_terms(texts: DataFrame, terms: DataFrame, id: str, text: str, term: str = "term", range_terms: int = RANGE_TERMS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id, term, n, first) for each different non-empty term that stands in a text: how often, overlaps included, and the first place, from 0, in characters.

    Null and empty texts hold no term; rows with one id are texts of their own."""
    spark = texts.sparkSession
    some = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    dealt = stored(some.withColumn("h", F.pmod(F.xxhash64("term"), F.lit(1 << 20))).repartitionByRange("h").sortWithinPartitions("h"))
    count, chars = dealt.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    ranges = max(-(-count // range_terms), -(-chars // range_chars))
    kind = texts.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType())])
    given = spread(texts.select(F.col(id), F.col(text)))
    passes, step = [], -(-(1 << 20) // max(ranges, 1))
    for low in range(0, 1 << 20, step) if ranges else ():
        own = dealt.where((F.col("h") >= low) & (F.col("h") < low + step)).select("term").toArrow()["term"].to_pylist()
        if own:
            of = _found(uuid.uuid4().hex, spark.sparkContext.broadcast(own), to_arrow_type(kind))
            passes.append(given.mapInArrow(of, schema))
    return reduce(DataFrame.unionAll, passes) if passes else spark.createDataFrame([], schema)
