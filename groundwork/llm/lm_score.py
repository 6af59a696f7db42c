"""Stupid-backoff scores of documents, computed relationally.

Two tables of counts over the whole corpus: words, and word pairs with at least
`least_count` occurrences.  A word w after v scores count(v w) / count(v .) if the
pair is in its table, else backoff * count(w) / total; the first word of a text
scores count(w) / total.  A document's score is the sum of the logarithms.

1. The word table: a count per task, added up by Spark.
2. The texts are exploded into pairs, which go to partitions by hash; a partition
   holds its part of the pair table, joins it to the exploded pairs and returns a
   sum per document.  Pairs are sent packed, sorted and counted per batch of
   documents: six bytes a name, and two for the document.
3. Words that a backoff needs are joined to the word table.
4. The sums are added per document.

Pairs go by their first word, so its total is known in the same place.  Words with
more than `frequent` of all words would gather too much in one partition: their
pairs go by the hash of both words, and their totals are broadcast.  There are at
most 1 / frequent of these, whatever the corpus.  Names are 48-bit hashes: among a
billion different words one in half a million shares its name.

Defined cases: a null or empty text has no words and score 0; a null doc_id has a
null score, but its words count; rows that share a doc_id share one score; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import QUERIES, stored, table
from .words import mix, slices, words

_SHIFT, _ODD = np.uint64(16), np.uint64(0x9FB21C651E98DF25)
#: Words and documents that a task holds before it sends what it has.
BATCH_WORDS, BATCH_DOCS = 1_000_000, 60_000
#: Documents of a batch are numbered in 16 bits.
MOST_DOCS = 65_000
#: Ranges of first words that a partition is worked off in.
STEPS = 16


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, text) -> names of words, document of each word, ids (null: -1 and not sent)."""
    names, docs, ids, n, d = [], [], [], 0, 0
    for batch in batches:
        for a, b in ((k, min(k + BATCH_DOCS, b)) for a, b in slices(batch.column(1)) for k in range(a, b, BATCH_DOCS)):
            if d + b - a > MOST_DOCS:
                yield np.concatenate(names), np.concatenate(docs), pa.chunked_array(ids)
                names, docs, ids, n, d = [], [], [], 0, 0
            w = words(batch.column(1).slice(a, b - a))
            names.append(w.names >> _SHIFT)
            docs.append((w.doc + d).astype(np.int32))
            ids.append(batch.column(0).slice(a, b - a))
            n, d = n + len(w.names), d + b - a
            if n >= BATCH_WORDS or d >= BATCH_DOCS:
                yield np.concatenate(names), np.concatenate(docs), pa.chunked_array(ids)
                names, docs, ids, n, d = [], [], [], 0, 0
    if d:
        yield np.concatenate(names), np.concatenate(docs), pa.chunked_array(ids)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, docs, _ in _batches(batches):
        word, at, n = np.unique(names, return_inverse=True, return_counts=True)
        led = np.bincount(at[:-1], docs[1:] == docs[:-1], len(word)) if len(names) else np.zeros(0)
        for k in range(0, len(word), 50_000):
            some = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(word[some].astype(np.int64)), pa.array(n[some]), pa.array(led[some].astype(np.int64))], ["word", "n", "led"])


def word_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, led): occurrences of each word, and those with a word after them."""
    rows = docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(_count_words, "word bigint, n bigint, led bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("led").alias("led"))


_PACKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("ids", "v", "per_v", "low", "high", "times", "doc")]])


def _send(parts: int, shared):
    """(id, text) -> packed pairs for each part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value[0]
        for names, docs, given in _batches(batches):
            known = np.array(given.is_valid())
            ids = np.array(given.fill_null(-1)).astype(np.int64)
            batch = int(mix(np.array([len(ids)], np.uint64) + np.bitwise_xor.reduce(mix(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64))))[0].view(np.int64)) if len(ids) else 0
            pair = np.flatnonzero(docs[1:] == docs[:-1]) if len(names) else np.zeros(0, np.int64)
            v, w, doc = names[pair], names[pair + 1], docs[pair]
            place = np.minimum(np.searchsorted(frequent, v), max(len(frequent) - 1, 0))
            both = frequent[place] == v if len(frequent) else np.zeros(len(v), bool)
            part = (mix(np.where(both, mix(v) + w * _ODD, v)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((w, v, part))
            v, w, doc, part = v[order], w[order], doc[order], part[order]
            heads = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
            times = np.diff(np.append(heads, len(v)))
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            at_head = np.searchsorted(heads, np.append(starts, len(part)))
            for k, (lo, hi) in enumerate(zip(starts.tolist(), np.append(starts[1:], len(part)).tolist(), strict=True)):  # parts that occur
                p, a, b = int(part[lo]), at_head[k], at_head[k + 1]
                vs, ws = v[heads[a:b]], w[heads[a:b]]
                new = np.flatnonzero(np.append(True, vs[1:] != vs[:-1]))
                used, where = np.unique(doc[lo:hi], return_inverse=True)
                row = {
                    "part": p, "batch": batch, "ids": np.where(known[used], ids[used], np.int64(-(1 << 62))).tobytes(), "v": vs[new].tobytes(), "per_v": np.diff(np.append(new, len(vs))).astype(np.uint32).tobytes(),
                    "low": ws.astype(np.uint32).tobytes(), "high": (ws >> np.uint64(32)).astype(np.uint16).tobytes(), "times": times[a:b].astype(np.uint32).tobytes(), "doc": where.astype(np.uint16).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], _PACKED)

    return of


_SUMS = "batch bigint, ids array<bigint>, sums array<double>, backed array<bigint>, rare array<bigint>, rare_id array<bigint>"
_NO_ID = -(1 << 62)


def _join(shared, total: int, least_count: int, backoff: float):
    """Packed pairs in order of part -> for each batch, sums per document and the rare words that they still need."""

    def find(table: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each name is in a sorted table, and whether."""
        if not len(table):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(table, names), len(table) - 1)
        return at, table[at] == names

    def close(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        frequent, n_of, led_of = shared.value
        load = lambda r, c, kind: np.frombuffer(r[c], kind)
        packs = []
        for r in rows:
            per_v, times = load(r, "per_v", np.uint32), load(r, "times", np.uint32)
            ends = lambda x: np.append(np.uint32(0), np.cumsum(x, dtype=np.uint32))
            packs.append({"v": load(r, "v", np.uint64), "per_v": per_v, "pairs": ends(per_v), "low": load(r, "low", np.uint32), "high": load(r, "high", np.uint16), "times": times, "words": ends(times), "doc": load(r, "doc", np.uint16), "ids": load(r, "ids", np.int64)})
        outs = [{"sums": np.zeros(len(p["ids"])), "backed": np.zeros(len(p["ids"]), np.int64), "rare": [], "rare_id": []} for p in packs]
        edges = np.linspace(0, 2.0**48, STEPS + 1).astype(np.uint64)
        for lo, hi in zip(edges, edges[1:], strict=False):  # first words of a range at a time
            v, w, times, docs = [], [], [], []
            for p in packs:
                i, j = np.searchsorted(p["v"], [lo, hi])
                a, b = p["pairs"][i], p["pairs"][j]
                v.append(np.repeat(p["v"][i:j], p["per_v"][i:j]))
                w.append(p["low"][a:b].astype(np.uint64) | (p["high"][a:b].astype(np.uint64) << np.uint64(32)))
                times.append(p["times"][a:b])
                docs.append(p["doc"][p["words"][a] : p["words"][b]])
            sizes = np.cumsum([0, *map(len, v)])
            all_v, all_w, all_t = np.concatenate(v), np.concatenate(w), np.concatenate(times)
            if not len(all_v):
                continue
            _, at = np.unique(mix(mix(all_v) + all_w * _ODD), return_inverse=True)
            count = np.bincount(at, all_t)[at]
            words_v, at_v = np.unique(all_v, return_inverse=True)
            led = np.bincount(at_v, all_t)
            place, often = find(frequent, words_v)
            led = np.where(often, led_of[place], led) if len(frequent) else led
            place, common = find(frequent, all_w)
            single = np.log(np.where(common, n_of[place], 1) / total) if len(frequent) else np.zeros(len(all_w))
            seen = count >= least_count
            value = np.where(seen, np.log(count / led[at_v]), np.log(backoff) + np.where(common, single, 0.0))
            rare = ~seen & ~common
            for k, out in enumerate(outs):
                some, ids = slice(sizes[k], sizes[k + 1]), packs[k]["ids"]
                spread = lambda x, k=k, some=some, times=times: np.repeat(x[some], times[k])
                out["sums"] += np.bincount(docs[k], spread(value), len(ids))
                out["backed"] += np.bincount(docs[k], spread(~seen), len(ids)).astype(np.int64)
                need = spread(rare)
                out["rare"].append(spread(all_w)[need].astype(np.int64))
                out["rare_id"].append(ids[docs[k][need]])
        for r, p, out in zip(rows, packs, outs, strict=True):
            lists = [p["ids"], out["sums"], out["backed"], *[np.concatenate([np.zeros(0, np.int64), *out[c]]) for c in ("rare", "rare_id")]]
            arrays = [pa.array([x], pa.list_(f.type.value_type)) for x, f in zip(lists, list(_schema())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["batch"]], pa.int64()), *arrays], schema=_schema())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["part"] != part:
                    if rows:
                        yield from close(rows)
                    part, rows = row["part"], []
                rows.append(row)
        if rows:
            yield from close(rows)

    return of


def _schema() -> pa.Schema:
    lists = [("ids", pa.int64()), ("sums", pa.float64()), ("backed", pa.int64()), ("rare", pa.int64()), ("rare_id", pa.int64())]
    return pa.schema([("batch", pa.int64()), *[(c, pa.list_(t)) for c, t in lists]])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums in order of batch -> (id, log_score, backed): one row per document of a batch."""

    def close(ids: list, sums: list, backed: list) -> Iterator[pa.RecordBatch]:
        if ids:
            id, at = np.unique(np.concatenate(ids), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(id), pa.array(np.bincount(at, np.concatenate(sums))), pa.array(np.bincount(at, np.concatenate(backed)).astype(np.int64))], ["id", "log_score", "backed"])

    one, held = None, ([], [], [])
    for batch in batches:
        for k, b in enumerate(batch.column(0).to_pylist()):
            if b != one:
                yield from close(*held)
                one, held = b, ([], [], [])
            for into, c in zip(held, (1, 2, 3), strict=True):
                into.append(batch.column(c)[k].values.to_numpy(zero_copy_only=False))
    yield from close(*held)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, n_words, first): the name of the first word, null without words."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            w = words(batch.column(1).slice(a, b - a))
            n = np.diff(w.first)
            first = (w.names[np.minimum(w.first[:-1], max(len(w.names) - 1, 0))] >> _SHIFT).astype(np.int64) if len(w.names) else np.zeros(b - a, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(first, mask=n == 0)], ["id", "n_words", "first"])


def backoff_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", least_count: int = 2, backoff: float = 0.4, frequent: float = 1e-6, part_words: int = 4_000_000) -> DataFrame:
    """(id, n_words, log_score, mean_log_score, n_backed) per row of docs."""
    given = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    table_ = stored(word_table(given, "id", "text"))
    total = table_.agg(F.sum("n")).first()[0] or 0
    often = table_.where(F.col("n") > total * frequent).orderBy("word").toArrow()  # 1 / frequent rows at most
    shared = docs.sparkSession.sparkContext.broadcast(tuple(often[c].to_numpy().astype(k) for c, k in (("word", np.uint64), ("n", np.int64), ("led", np.int64))))
    parts = max(8, -(-total // part_words))
    packed = given.mapInArrow(_send(parts, shared), "part int, batch bigint, " + ", ".join(f"{c} binary" for c in _PACKED.names[2:]))
    joined = stored(packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_join(shared, total, least_count, backoff), _SUMS))
    sums = joined.select("batch", "ids", "sums", "backed").repartition("batch").sortWithinPartitions("batch").mapInArrow(_add, "id bigint, log_score double, backed bigint")
    ends = given.mapInArrow(_ends, "id bigint, n_words bigint, first bigint")
    single = F.log(F.col("n") / F.lit(max(total, 1)))
    rare = joined.select(F.explode(F.arrays_zip("rare", "rare_id")).alias("r")).select(F.col("r.rare").alias("word"), F.col("r.rare_id").alias("id"))
    rare = rare.join(table_.select("word", "n"), "word").groupBy("id").agg(F.sum(single).alias("log_score"))
    starts = ends.where("first is not null").select("id", F.col("first").alias("word")).join(table_.select("word", "n"), "word").select("id", single.alias("log_score"))
    starts = starts.groupBy("id").agg(F.max("log_score").alias("log_score"))
    none = F.lit(0).cast("long")
    every = sums.unionByName(rare.withColumn("backed", none)).unionByName(starts.withColumn("backed", none)).groupBy("id").agg(F.sum("log_score").alias("s"), F.sum("backed").alias("k"))
    score = F.when(F.col("id").isNotNull(), F.coalesce("s", F.lit(0.0)))
    out = ends.select("id", "n_words").join(every.where(F.col("id") != _NO_ID), "id", "left")
    mean = F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(score)
    return out.select(F.col("id").alias(id), "n_words", score.alias("log_score"), mean.alias("mean_log_score"), F.coalesce("k", none).alias("n_backed"))


@QUERIES.query("op3_lm_score")
def op3_lm_score(spark, sf_dir) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
