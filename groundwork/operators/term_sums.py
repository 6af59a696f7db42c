"""Terms of texts counted, and weights summed for many queries, in Arrow batches.

Terms are those of retrieval.tokens(): runs of ASCII letters and digits, so a text is cut on
its raw bytes.  A task reads each text once and keeps the terms that are asked for only.  Sums
are made a slice of passages at a time, and at most k passages of a bag leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text cut at once, and weights or sums at once; they bound the working memory of a task.
TEXT, SUMS = 1 << 22, 1 << 21
_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
_FOLD[65:91] = _FOLD[97:123]
_PARTS = pa.struct([("length", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
Batches = Iterator[pa.RecordBatch]


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so much weight, one row at least."""
    ends, i = np.cumsum(weights), 0
    while i < len(weights):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The runs of letters and digits of all texts, in small letters, and the text of each."""
    texts = pa.concat_arrays([texts.fill_null("")])
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = folded > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = at[(at > 0) & (at < len(folded))]  # no run goes from one text into the next
    first[border], last[border - 1] = inside[border], inside[border - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(folded[inside]))
    return runs, np.searchsorted(at, starts, "right") - 1


def counted(sent, stop_words: tuple[str, ...], kind: pa.DataType) -> Callable[[Batches], Batches]:
    """Batches (id, text) -> (id, length, terms, counts), a row for each text: its number of terms, and which of the terms sent it has how often."""

    def of(batches: Batches) -> Batches:
        known = pa.concat_arrays([pa.array(stop_words, pa.string()), pa.array(sent.value, pa.string())])
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for i, j in _slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), TEXT):
                runs, text = cut(texts.slice(i, j - i))
                which = pc.fill_null(pc.index_in(runs, value_set=known), -1).to_numpy(zero_copy_only=False)
                long = pc.binary_length(runs).to_numpy(zero_copy_only=False) >= 2
                length = np.bincount(text[long & ((which < 0) | (which >= len(stop_words)))], minlength=j - i)
                asked = which >= len(stop_words)
                pairs, n = np.unique(text[asked].astype(np.int64) * len(known) + which[asked], return_counts=True)
                row, term = pairs // len(known), pairs % len(known) - len(stop_words)
                at = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(kind), pa.array(length, pa.int64()), *lists], ["id", "length", "terms", "counts"])

    return of


def _postings(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A list of (length, terms, counts) for each passage -> the lengths, and row, length, term and count of each posting; texts of one passage and equal length are one."""
    texts = parts.flatten()
    of = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    length, terms, counts = (texts.field(n) for n in ("length", "terms", "counts"))
    length, many = length.to_numpy(zero_copy_only=False), terms.value_lengths().to_numpy(zero_copy_only=False)
    row, size = np.repeat(of, many), np.repeat(length, many)
    term, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, counts))
    if len(of) > len(parts):
        order = np.lexsort((term, size, row))
        row, size, term, n = row[order], size[order], term[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (size[1:] != size[:-1]) | (term[1:] != term[:-1])])[: len(row)])
        row, size, term, n = row[new], size[new], term[new], np.add.reduceat(n, new) if len(n) else n
    return length, row, size, term, n


def frequencies(terms: int) -> Callable[[Batches], Batches]:
    """Batches (parts) -> (term, n): how many passages have a term; -1: texts, -2: their terms in all."""

    def of(batches: Batches) -> Batches:
        found, texts, size = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            length, _, _, term, _ = _postings(batch.column(0))
            found += np.bincount(term, minlength=terms)
            texts, size = texts + len(length), size + int(length.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]), pa.int64()), pa.array(np.concatenate([found[some], [texts, size]]), pa.int64())], ["term", "n"])

    return of


def _best(rows: pa.Table, k: int) -> pa.Table:
    """At most k rows of each bag, as retrieval.ranked() orders them."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("bag", "ascending"), ("shown", "descending"), ("id", "ascending")], null_placement="at_start"))
    bag = rows["bag"].to_numpy()
    return rows.filter(pa.array(np.arange(len(bag)) - np.searchsorted(bag, bag) < k))


def summed(sent, mean_length: float, k1: float, b: float, k: int, kind: pa.DataType) -> Callable[[Batches], Batches]:
    """Batches (id, parts) -> (bag, id, score), the best k passages of a task for each bag; sent: (first, bag, times) of the bags of each term, and the terms' weights."""

    def of(batches: Batches) -> Batches:
        first, bags, times, weight = sent.value
        n_bags = int(bags.max()) + 1 if len(bags) else 0
        least, kept, fresh = np.full(n_bags, -np.inf), None, 0
        for batch in batches:
            ids = batch.column(0).cast(kind)
            _, row, size, term, n = _postings(batch.column(1))
            w = weight[term] * n * (k1 + 1) / (n + k1 * (1 - b + b * size / mean_length))
            each = first[term + 1] - first[term]
            work = np.bincount(row, each, minlength=len(ids)).astype(np.int64)
            at = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, j in _slices(work, SUMS):
                p = slice(at[i], at[j])
                m = each[p]
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[term[p]], m)
                key, value = np.repeat(row[p] - i, m) * n_bags + bags[place], np.repeat(w[p], m) * times[place]
                if (j - i) * n_bags <= 4 * len(key):
                    sums = np.bincount(key, value, minlength=(j - i) * n_bags)
                    key = np.flatnonzero(sums)
                    sums = sums[key]
                else:
                    key, back = np.unique(key, return_inverse=True)
                    sums = np.bincount(back, value, minlength=len(key))
                shown = np.round(sums, 9)
                good = shown >= least[key % max(n_bags, 1)]
                key, sums, shown = key[good], sums[good], shown[good]
                new = pa.table({"bag": key % max(n_bags, 1), "id": ids.take(pa.array(key // max(n_bags, 1) + i)), "score": sums, "shown": shown})
                kept, fresh = new if kept is None else pa.concat_tables([kept, new]), fresh + len(new)
                if fresh > SUMS // 2 or fresh > 4 * k * n_bags:
                    kept, fresh = _best(kept.combine_chunks(), k), 0
                    bag, score = kept["bag"].to_numpy(), kept["shown"].to_numpy()
                    full = np.flatnonzero(np.bincount(bag, minlength=n_bags) >= k)
                    least[full] = score[np.searchsorted(bag, full, "right") - 1]
        if kept is not None and len(kept):
            yield from _best(kept.combine_chunks(), k).select(["bag", "id", "score"]).to_batches(20_000)

    return of
