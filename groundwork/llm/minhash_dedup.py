"""Near-duplicate documents by bottom-k sketches.

1. A document's set is its distinct word shingles, named by one 64-bit hash.
   Documents with equal sets form a class; only its smallest id goes on.
2. The sketch is the k smallest names.  Inverted lists of the retained values
   generate overlaps: two sets that are similar enough share at least `overlap` of
   their sketches, so they meet in a list of one of each one's rarest values, and
   each needs to be listed under no others.  A document with enough values of its
   own is in no list, and a passage that many documents share makes none among them.
3. Each list links its members to its most central one.  Pairs pass the
   union-sketch estimate, which needs the sketches only; of those that do, the full
   sets are made and prove the exact Jaccard.
4. Where a list still holds different components whose sizes and places allow the
   threshold, a sketch says too little: the documents of such lists are listed
   again by their full sets, rarest names first, with as many names as the
   threshold demands.  Links to the most central one come first, then all pairs of
   different components that can still pass, through the same two tests.

So a group of m near copies costs about m pairs, and no link between components
is given up for the size of a list: step 4 has no cap.  Two tests are probabilistic.
For similarity 0.8 and k = 96, where 77 values are expected to agree, the lists
lose a pair if fewer than 58 of 96 do (3e-6 by the binomial), and the estimate if
fewer than 56 do (4e-7).  Sets of at most k names are compared whole.

Defined cases: a null or empty text has an empty set, is linked with nothing and
stays; a text shorter than the shingle is one shingle; repeated rows of one
doc_id count once as a class and are each returned; a null doc_id is linked with
nothing and stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from groundwork.operators.components import connected_components

from .common import QUERIES, own_columns, small, stored, table
from .words import grams, mix, slices, words

_SIXTYTHREE = np.uint64(1)


def _sets(texts: pa.Array, n: int):
    """The sorted distinct shingle names of each text, as positive 63-bit integers."""
    for a, b in slices(texts):
        w = words(texts.slice(a, b - a), lower=True)
        named = mix(grams(w.names, n)) >> _SIXTYTHREE
        for d in range(b - a):
            lo, hi = w.first[d], w.first[d + 1]
            if hi - lo >= n:
                yield np.unique(named[lo : hi - n + 1])
            elif hi > lo:
                yield mix(grams(w.names[lo:hi], int(hi - lo))) >> _SIXTYTHREE
            else:
                yield np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else [0]
    values = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def sketch(text: Column, shingle: int, k: int) -> Column:
    """struct(n, s1, s2, kept): the set's size, two checksums that name it, and its k smallest names."""

    def of(texts: pa.Array) -> pa.Array:
        sizes, first, second, kept = [], [], [], []
        for s in _sets(texts, shingle):
            sizes.append(len(s))
            first.append(s.sum(dtype=np.uint64).astype(np.int64))
            second.append(np.bitwise_xor.reduce(mix(s)).astype(np.int64) if len(s) else 0)
            kept.append(s[:k])
        return pa.StructArray.from_arrays([pa.array(np.array(x, np.int64)) for x in (sizes, first, second)] + [_lists(kept)], ["n", "s1", "s2", "kept"])

    return arrow_udf(of, "struct<n:bigint,s1:bigint,s2:bigint,kept:array<bigint>>")(text)


def shingle_set(text: Column, shingle: int) -> Column:
    """The whole set, sorted."""
    return arrow_udf(lambda texts: _lists(list(_sets(texts, shingle))), "array<bigint>")(text)


def _listed(entries: DataFrame, least: float) -> DataFrame:
    """entries(id, n, size, v) -> (id, n, size, weight, at, v): of each id, the rarest of its `size` values that it must be listed under, with their places.

    Values of one document only take the first places and lead nowhere; weight is the mean number of documents per value."""
    often = entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    per = entries.join(often, "v").groupBy("id", "n", "size").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("shared"), F.sum("c").alias("weight"))
    own = F.col("size") - F.size("shared")
    room = F.col("size") - F.ceil(F.col("size") * F.lit(least)) + 1 - own
    listed = per.where(room > 0).select("id", "n", "size", ((F.col("weight") + own) / F.col("size")).alias("weight"), own.alias("own"), F.posexplode(F.slice("shared.v", F.lit(1), room.cast("int"))).alias("i", "v"))
    return listed.select("id", "n", "size", "weight", (F.col("own") + F.col("i") + 1).alias("at"), "v")


def _hubs(entries: DataFrame) -> DataFrame:
    """(v, hub, hn): the most central member of each list of two or more, and its size."""
    hub = F.max_by(F.struct(F.col("id").alias("hub"), F.col("n").alias("hn")), F.struct("weight", -F.col("id")))
    return entries.groupBy("v").agg(hub.alias("h"), F.count("*").alias("c")).where("c > 1").select("v", "h.*")


def _stars(entries: DataFrame, hubs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of the members of a list and its hub, if their sizes allow the threshold."""
    close = F.least("n", "hn") * 100 >= F.greatest("n", "hn") * threshold
    return entries.join(hubs, "v").where((F.col("id") != F.col("hub")) & close).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def _estimate(x: Column, y: Column, k: int) -> Column:
    """Jaccard by the k smallest names of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(x, y), union)) / F.size(union)


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: int, k: int, margin: float) -> DataFrame:
    """Of pairs(a, b), those whose estimate by sketches(id, kept) allows the threshold."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("kept").alias(f"k{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_estimate(F.col("ka"), F.col("kb"), k) >= threshold / 100 - margin).select("a", "b")


def _proven(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs(a, b), those whose full sets have the threshold (in percent)."""
    full = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}"))
    both = pairs.join(full("a"), "a").join(full("b"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("i") * 100 >= threshold * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def near_duplicate_links(texts: DataFrame, reps: DataFrame, shingle: int, threshold: int, k: int, overlap: float, margin: float) -> tuple[DataFrame, DataFrame]:
    """(links found, components) among reps(id, n, kept), whose texts are in texts(id, text)."""

    def sets_of(ids: DataFrame) -> DataFrame:
        return stored(texts.join(small(ids), "id").dropDuplicates(["id"]).select("id", shingle_set(F.col("text"), shingle).alias("set")))

    entries = stored(_listed(reps.select("id", "n", F.size("kept").cast("long").alias("size"), F.explode("kept").alias("v")), overlap))
    likely = stored(_likely(_stars(entries, _hubs(entries), threshold), reps, threshold, k, margin))
    some = stored(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct())
    links = stored(_proven(likely, sets_of(some), threshold))
    part = stored(connected_components(links))
    mixed = stored(_mixed(entries, part, threshold))
    if not mixed.take(1):
        return links, part
    sets = sets_of(mixed)
    sketches, size = sets.select("id", F.slice("set", 1, k).alias("kept")), F.size("set").cast("long")
    entries = stored(_listed(sets.select("id", size.alias("n"), size.alias("size"), F.explode("set").alias("v")), threshold / 100))
    hubs = stored(_hubs(entries))
    for pairs in (lambda: _apart(_stars(entries, hubs, threshold), part), lambda: _across(entries, hubs, part, threshold)):
        more = stored(_proven(_likely(pairs(), sketches, threshold, k, margin), sets, threshold))
        if more.take(1):
            links = links.unionByName(more)
            part = stored(connected_components(links))
    return links, part


def _in_parts(df: DataFrame, part: DataFrame, id: str = "id", to: str = "component") -> DataFrame:
    """df with the component of its column id; a document without links is its own."""
    return df.join(part.select(F.col("node").alias(id), F.col("component").alias("__c")), id, "left").withColumn(to, F.coalesce("__c", id)).drop("__c")


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Of pairs(a, b), those of different components."""
    return _in_parts(_in_parts(pairs, part, "a", "ca"), part, "b", "cb").where("ca <> cb").select("a", "b")


def _step(n: Column) -> Column:
    """Sizes in steps of a twentieth."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))


def _mixed(entries: DataFrame, part: DataFrame, threshold: int) -> DataFrame:
    """(id): documents in a list of sketches where different components meet whose sizes and places allow the threshold.

    Of the `size` values that the larger of two sets of sizes n and m retains, the smaller one retains a share p = t / (1 + t) * (1 + m / n) on the average,
    and less than 4.9 standard deviations below it with odds of about 1e-6; from place `at` on there are only size - at + 1."""
    t = threshold / 100
    low = F.pow(F.lit(1.05), F.col("step"))
    p = F.least(F.lit(1.0), t / (1 + t) * (1 + low / F.col("n")))
    needed = F.col("size") * (p - 4.9 * F.sqrt(p * (1 - p) / F.col("size")))
    tagged = _in_parts(entries, part).withColumn("own", _step(F.col("n")))
    dealt = tagged.withColumn("step", F.explode(F.sequence(_step(F.ceil(F.col("n") * t)), "own"))).withColumn("larger", F.col("size") - F.col("at") + 1 >= needed).where("larger or step = own")
    open_ = dealt.groupBy("v", "step").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count_if("larger").alias("l")).where("x <> y and l > 0").select("v", "step")
    return dealt.join(open_, ["v", "step"], "left_semi").select("id").distinct()


def _across(entries: DataFrame, hubs: DataFrame, part: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a list of full sets and can have the threshold.

    A pair is judged in the list of its first common name.  With n >= m names and places at and at2 of that name, at most 1 + min(n - at, m - at2) names
    are common, and t / (100 + t) * (n + m) must be.  Sizes are dealt into steps of a twentieth, so that a list compares only sizes that can pass."""
    t = threshold
    tagged = _in_parts(entries, part).drop("weight")
    mixed = tagged.join(_in_parts(hubs, part, "hub", "major").select("v", "major"), "v").withColumn("minor", F.col("component") != F.col("major"))
    mixed = stored(mixed.join(mixed.where("minor").select("v").distinct(), "v", "left_semi"))
    most = F.least(F.col("n"), F.floor((F.col("n") - F.col("at") + 1) * (100 + t) / t - F.col("n")))
    larger = mixed.withColumn("most", most).withColumn("fewest", F.ceil(F.col("n") * t / 100)).where("most >= fewest")
    larger = larger.withColumn("step", F.explode(F.sequence(_step(F.col("fewest")), _step(F.col("most")))))
    smaller = mixed.where((F.col("n") - F.col("at") + 1) * (100 + t) >= F.col("n") * 2 * t).withColumn("step", _step(F.col("n")))
    a, b = larger.alias("a"), smaller.alias("b")
    fits = F.expr(f"a.component <> b.component and b.n between a.fewest and a.most and (a.n > b.n or a.id > b.id) and (b.n - b.at + 1) * {100 + t} >= {t} * (a.n + b.n)")
    met = lambda x, y: x.join(y, (F.col("a.v") == F.col("b.v")) & (F.col("a.step") == F.col("b.step")) & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return met(a.where("a.minor"), b).unionByName(met(a.where("not a.minor"), b.where("b.minor"))).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: int = 80, k: int = 96, overlap: float = 0.6, margin: float = 0.22) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs; threshold in percent."""
    made = stored(docs.select(F.col(id).alias("id"), sketch(F.col(text), shingle, k).alias("s")).select("id", "s.*"))
    key = ["n", "s1", "s2"]
    some = made.where("n > 0 and id is not null")
    classes = stored(some.groupBy(*key).agg(F.min("id").alias("rep")))
    reps = some.join(classes.select(F.col("rep").alias("id"), *[F.col(c).alias(f"r{c}") for c in key]), "id").where("n = rn and s1 = rs1 and s2 = rs2").select("id", "n", "kept").dropDuplicates(["id"])
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    _, part = near_duplicate_links(texts, stored(reps), shingle, threshold, k, overlap, margin)
    named = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("c"))
    out = made.select("id", *key).join(named, key, "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", **how) -> DataFrame:
    """docs without the rows that have a near duplicate of smaller id."""
    gone = stored(near_duplicates(docs, id, **how).where("not kept").select(F.col(id).alias("__gone")).distinct())
    return docs.join(small(gone), F.col(f"`{id}`") == F.col("__gone"), "left_anti").select(*own_columns(docs))


@QUERIES.query("op10_minhash_dedup")
def op10_minhash_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
