"""Repeated passages by recompression.

A text is a string of word names.  Each round first names maximal runs of one
symbol, then pairs whose left symbol is of the left half of the names and whose
right symbol is of the right half.  A name is a hash of what it stands for, so
the rounds name equal things equally in every task, without a shuffle.  What a
round decides depends on a few words around it, and those words are tracked; inside
equal passages the symbols that their own words prove are therefore the same.

1. A phrase is the string of symbols from a boundary on that covers `SPAN` words or
   a little more; its key is made of the names of its runs and pairs.  Every window of
   `window` words has for anchor a phrase of highest level of those that the words of the
   window prove; of several, the one of largest mixed key.  Equal windows have equal
   anchors, and one anchor serves several windows.  Where no round proves a
   phrase, as inside one long run, the words themselves are the symbols.
2. Spark counts the keys.  Windows whose phrase occurs once are unique; most texts
   end here.
3. The other windows are compared by 128 bits of their words.  A task sends the
   first window of each name that it has in a slice of texts; the earliest one of all
   stays, the others are repeats.
4. A word that a repeat covers is removed.

Rows and bytes moved are in proportion to the anchors and to the repeated windows; a
passage that a third of all documents share is sent once per slice of documents.

Defined cases: a null or empty text has no words and loses none; a text shorter
than the window loses none; a null doc_id takes no part and loses none; doc_id
should be unique: rows with one doc_id share the spans removed; an empty table
gives no rows; other columns are kept and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import QUERIES, own_columns, small, stored, table
from .words import OTHER, Words, grams, mix, slices, spans, words

#: Symbols of further rounds are seldom proven by 20 words.
ROUNDS = 2
#: Words that a phrase covers at least.
SPAN = 7
_FAR, _NEVER = 255, 1 << 40
_RUN, _PAIR, _PHRASE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Symbols:
    """The symbols of many texts.  start: their first words; low[k]..high[k]: the words that prove the boundary before symbol k (one more entry for the end),
    inner_low, inner_high: those that prove what is between its two boundaries."""

    names: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inner_low: np.ndarray
    inner_high: np.ndarray
    n_words: int

    def new_texts(self) -> np.ndarray:
        return np.append(True, self.doc[1:] != self.doc[:-1]) if len(self.doc) else np.zeros(0, bool)

    def joined(self, cut: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        """Symbols joined over the boundaries where cut is False.  The ends of a text are cuts that prove nothing inside another text."""
        at = np.flatnonzero(cut)
        if not len(at):
            return self
        forced = self.new_texts()[at]
        low, high = np.append(np.where(forced, -_NEVER, low[at]), -_NEVER), np.append(np.where(forced, _NEVER, high[at]), _NEVER)
        inner_low = np.minimum.reduceat(np.where(cut, self.inner_low, np.minimum(self.inner_low, self.low[:-1])), at)
        inner_high = np.maximum.reduceat(np.where(cut, self.inner_high, np.maximum(self.inner_high, self.high[:-1])), at)
        return Symbols(names, self.start[at], self.doc[at], low, high, inner_low, inner_high, self.n_words)

    def round(self, turn: int) -> Symbols:
        return self.runs_named().pairs_named(turn)

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        """The words that prove each symbol with both its boundaries."""
        return np.minimum(np.minimum(self.low[:-1], self.low[1:]), self.inner_low), np.maximum(np.maximum(self.high[:-1], self.high[1:]), self.inner_high)

    def runs_named(self) -> Symbols:
        cut = self.new_texts()
        cut[1:] |= self.names[1:] != self.names[:-1]
        at = np.flatnonzero(cut)
        length = np.diff(np.append(at, len(cut))).astype(np.uint64)
        names = np.where(length > 1, mix(self.names[at] + length * _RUN), self.names[at])
        low, high = self._known()
        low[1:], high[1:] = np.minimum(low[1:], low[:-1]), np.maximum(high[1:], high[:-1])  # both neighbours of a boundary
        return self.joined(cut, names, low, high)

    def pairs_named(self, turn: int) -> Symbols:
        right = (mix(self.names + np.uint64(turn)) & np.uint64(1)).astype(bool)
        cut = self.new_texts()
        cut[1:] |= right[:-1] | ~right[1:]
        at = np.flatnonzero(cut)
        second = np.append(self.names[1:], np.uint64(0))
        paired = np.append(~cut[1:], False)
        names = np.where(paired, mix(mix(self.names) + second * _PAIR), self.names)[at]
        # a symbol of the left half proves the boundary before it; one of the right half does so together with the symbol before it
        low, high = self._known()
        with_before = np.append(False, right[1:])
        before_low, before_high = np.append(_NEVER, low[:-1]), np.append(-_NEVER, high[:-1])
        return self.joined(cut, names, np.where(with_before, np.minimum(low, before_low), low), np.where(with_before, np.maximum(high, before_high), high))

    def phrases(self, span: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, low, high) of the phrases at some boundaries: their symbols and the words that prove them."""
        m = len(self.names)
        end = np.searchsorted(np.append(self.start, self.n_words), self.start[some] + span)
        key, low, high = np.zeros(len(some), np.uint64), self.low[some], self.high[some]
        low[end > m], high[end > m] = -_NEVER, _NEVER
        end, scale, at = np.minimum(end, m), np.ones(1, np.uint64), np.arange(len(some))
        for t in range(span):
            on = at[some[at] + t < end[at]]
            if not len(on):
                break
            k = some[on] + t
            key[on] += self.names[k] * scale
            low[on] = np.minimum(low[on], np.minimum(self.inner_low[k], self.low[k + 1]))
            high[on] = np.maximum(high[on], np.maximum(self.inner_high[k], self.high[k + 1]))
            scale = scale * _PHRASE
            at = on
        return mix(key), low, high


def symbols(w: Words) -> Symbols:
    """The words themselves."""
    n = len(w.names)
    place = np.arange(n + 1)
    return Symbols(w.names, place[:-1], w.doc, place.copy(), place.copy(), place[:-1].copy(), place[1:].copy(), n)


def _anchors(w: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the place, the key and the level of the anchor of the window that starts there, if it fits into its text."""
    n = len(w.names)
    chosen, keys, levels = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
    span, last, made = min(SPAN, window), w.first[1:], [symbols(w)]
    for level in range(rounds if n else 0):
        made.append(made[-1].round(level + 1))
    open_ = w.room() >= window
    for level in range(rounds if n else -1, -1, -1):  # windows without a phrase of a level look for one of the next lower
        s, best = made[level], np.zeros(n, np.uint64)
        near = np.concatenate([[0], np.cumsum(open_)])
        some = np.flatnonzero(near[s.start + 1] > near[np.maximum(s.start - window, 0)])
        key, low, high = s.phrases(span, some)
        at = s.start[some]
        fits = (high - low <= window) & (at + span <= last[s.doc[some]])
        at, key, low, high = at[fits], key[fits], low[fits], high[fits]
        value = mix(key) | np.uint64(1)
        on = np.arange(len(at))
        for o in range(window):  # the windows from high - window to low hold the phrase with its proof; of equal keys the last proven one counts
            i = high[on] - window + o
            on = on[i <= low[on]]
            i = high[on] - window + o
            k = on[i >= 0]
            i = i[i >= 0]
            better = open_[i] & (value[k] > best[i])
            k, i = k[better], i[better]
            order = np.argsort(value[k], kind="stable")
            k, i = k[order], i[order]
            best[i], chosen[i], keys[i], levels[i] = value[k], at[k], key[k], level
        open_ = open_ & (best == 0)
        if not open_.any():
            break
    return chosen, keys, levels


def anchors(text: Column, window: int) -> Column:
    """struct(once, more): keys of anchors that a text has once, and those it has more than once."""

    def of(texts: pa.Array) -> pa.Array:
        once, more = [], []
        for a, b in slices(texts):
            w = words(texts.slice(a, b - a))
            chosen, key, _ = _anchors(w, window)
            fits = np.flatnonzero(w.room() >= window)
            place, key = chosen[fits], key[fits]
            order = np.lexsort((key, place))
            place, key = place[order], key[order]
            apart = np.append(True, (place[1:] != place[:-1]) | (key[1:] != key[:-1]))[: len(place)]  # one place may have keys of several levels
            place, key = place[apart], key[apart]
            doc = w.doc[place]
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, np.int64)
            single = np.diff(np.append(new, len(key))) == 1
            for out, some in ((once, new[single]), (more, new[~single])):
                out += np.split(key[some].view(np.int64), np.searchsorted(doc[some], np.arange(1, b - a)))
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in p])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *p]))) for p in (once, more)]
        return pa.StructArray.from_arrays(lists, ["once", "more"])

    return arrow_udf(of, "struct<once:array<bigint>,more:array<bigint>>")(text)


def _shared_windows(ids: np.ndarray, w: Words, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, check, id, start) of the windows whose key is among the sorted shared ones."""
    whole = grams(w.names, window)
    at = np.flatnonzero(w.room()[: len(whole)] >= window)
    if len(at) and len(shared):
        key = _anchors(w, window)[1][at]
        at = at[shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key]
    else:
        at = at[:0]
    doc = w.doc[at]
    check = grams(spans(w.data, w.start, w.end, OTHER), window)[at] if len(at) else np.zeros(0, np.uint64)
    return whole[at].view(np.int64), check.view(np.int64), ids[doc], (at - w.first[doc]).astype(np.int32)


def _windows(window: int):
    """(id, text, keys) -> windows with a key of keys: the first of each name in a slice of texts; later ones are marked and have a name of their own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(ids, kind="stable")
                ids, texts = ids[order], batch.column(1).slice(a, b - a).take(pa.array(order))
                shared = np.unique(batch.column(2).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                parts = [_shared_windows(ids[c:d], words(texts.slice(c, d - c)), shared, window) for c, d in slices(texts)]  # names of 1 MB of text at once
                name, check, id, start = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.lexsort((check, name))  # stable: rows stay in order of (id, start)
                later = np.zeros(len(by), bool)
                later[by[1:]] = (name[by][1:] == name[by][:-1]) & (check[by][1:] == check[by][:-1])
                name, check = np.where(later, id, name), np.where(later, start, check)
                for k in range(0, len(name), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (name, check, id, start, later)], ["name", "check", "id", "start", "later"])

    return of


def kept_words(text: Column, starts: Column, window: int) -> Column:
    """struct(n_words, n_removed, sha256, kept): kept is the text itself if nothing is removed, else its kept words joined by a space."""

    def of(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, starts, strict=True):
            raw = (t.as_py() or "").encode()
            parts = raw.split()  # at exactly the white space of these words
            at = s.values.to_numpy(zero_copy_only=False) if s.is_valid else np.zeros(0, np.int32)
            n, gone = len(parts), 0
            if len(at):
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                stays = np.cumsum(cover)[:n] == 0
                gone = int(n - stays.sum())
                parts = [p for p, yes in zip(parts, stays.tolist(), strict=True) if yes]
            joined = b" ".join(parts)
            out.append((n, gone, hashlib.sha256(joined).hexdigest(), joined.decode() if gone else None))
        c = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.StructArray.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], ["n_words", "n_removed", "sha256", "kept"])

    return arrow_udf(of, "struct<n_words:bigint,n_removed:bigint,sha256:string,kept:string>")(text, starts)


def repeated_windows(docs: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(id, starts): where the repeated windows of a document start."""
    named = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), anchors(F.col(text), window).alias("a"))
    one = F.transform("a.once", lambda k: F.struct(k.alias("key"), F.lit(1).alias("w")))
    two = F.transform("a.more", lambda k: F.struct(k.alias("key"), F.lit(2).alias("w")))
    entries = stored(named.select("id", F.explode(F.concat(one, two)).alias("e")).select("id", "e.key", "e.w"))
    shared = entries.groupBy("key").agg(F.sum("w").alias("w")).where("w > 1").select("key")
    keys = stored(entries.join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("keys")))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(small(keys.select("id")), "id")
    found = texts.join(keys, "id").select("id", "text", "keys").mapInArrow(_windows(window), "name bigint, check bigint, id bigint, start int, later boolean")
    turn = F.row_number().over(Window.partitionBy("name", "check", "later").orderBy("id", "start"))
    return stored(found.withColumn("turn", turn).where("later or turn > 1").groupBy("id").agg(F.collect_list("start").alias("starts")))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """docs with the struct `__kept` of kept_words()."""
    repeats = repeated_windows(docs, id, text, window)
    some = small(repeats.select(F.col("id").alias("__id")))
    none = docs.join(some, F.col(f"`{id}`") == F.col("__id"), "left_anti").select(*own_columns(docs), F.lit(None).cast("array<int>").alias("__starts"))
    hit = docs.join(some, F.col(f"`{id}`") == F.col("__id")).join(repeats.select(F.col("id").alias("__rid"), F.col("starts").alias("__starts")), F.col("__id") == F.col("__rid")).select(*own_columns(docs), "__starts")
    return none.unionByName(hit).withColumn("__kept", kept_words(F.col(f"`{text}`"), F.col("__starts"), window)).drop("__starts")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 20, length: str | None = "n_chars") -> DataFrame:
    """docs with repeated passages cut from the text; length names a column of text lengths to renew."""
    made = remove_repeats(docs, id, text, window).withColumn(text, F.coalesce("__kept.kept", F.col(f"`{text}`")))
    if length in docs.columns:
        made = made.withColumn(length, F.when(F.col("__kept.n_removed") > 0, F.length(F.col(f"`{text}`")).cast("long")).otherwise(F.col(f"`{length}`")))
    return made.select(*own_columns(docs))


@QUERIES.query("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "__kept.n_words", "__kept.n_removed", F.col("__kept.sha256").alias("kept_sha256"))
