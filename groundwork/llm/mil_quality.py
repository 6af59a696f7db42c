"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `passage_words` words, all of its text.  Each
passage is encoded from its characters and its repetition; gated attention,
learned from document labels only, weighs the passages, and the weighted
representation is scored.

The model is fitted on a sample of labelled rows of at most `most_training` documents,
half of each label, taken in hashed order; that bound is the only one.  Scoring is
one pass over the texts.  Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text is one passage without words and gets a score;
a document labelled twice with different labels counts as label 0; with no labels
of one kind every score is 0.5; repeated rows are each scored; an empty table gives
no rows; other columns are kept by score_quality() and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import QUERIES, stored, table
from .words import buffers, mix, slices, words

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """A class of each byte: small letters and marks by themselves, capitals, digits, controls, and UTF-8 leads and tails together."""
    c = np.zeros(256, np.int64)
    c[128:192], c[192:224], c[224:], c[65:91], c[48:58] = 1, 2, 3, 4, 5
    for k, b in enumerate([9, 10, *range(32, 48), *range(58, 65), *range(91, 127)]):
        c[b] = 6 + k
    return c


_CLASS = _classes()
_KINDS = int(_CLASS.max()) + 1
#: Numbers that describe a passage: shares of the classes, then words, different words, immediate repeats, length of words.
FEATURES = _KINDS + 4


def passages(texts: pa.Array, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, passages of each text)."""
    w = words(texts)
    n_words = np.diff(w.first)
    per = np.maximum(1, -(-n_words // passage_words))
    first = np.concatenate([[0], np.cumsum(per)])
    count = int(first[-1])
    at = first[w.doc] + (np.arange(len(w.names)) - w.first[w.doc]) // passage_words
    out = np.zeros((count, FEATURES), np.float32)
    if len(at):
        # bytes from a passage's first word to the next passage or the end of the text; blanks that lead the next text are of none
        heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        start, text_end = w.start[heads], buffers(texts)[1][w.doc[heads] + 1]
        after = np.append(start[1:], len(w.data))
        end = np.minimum(after, text_end)
        of_byte = np.repeat(np.stack([at[heads], np.full(len(heads), count)], 1).ravel(), np.stack([end - start, after - end], 1).ravel())
        data = w.data[w.start[0] :]
        shares = np.bincount(of_byte * _KINDS + _CLASS[data], minlength=(count + 1) * _KINDS).reshape(count + 1, _KINDS)[:count]
        out[:, :_KINDS] = np.sqrt(shares / np.maximum(shares.sum(1, keepdims=True), 1))
        size = np.bincount(at, minlength=count)
        keys = mix(w.names + mix(at.astype(np.uint64) * _ODD))
        _, one = np.unique(keys, return_index=True)
        again = np.append(False, (w.names[1:] == w.names[:-1]) & (at[1:] == at[:-1]))
        safe = np.maximum(size, 1)
        out[:, _KINDS] = np.log1p(size)
        out[:, _KINDS + 1] = np.bincount(at[one], minlength=count) / safe
        out[:, _KINDS + 2] = np.bincount(at[again], minlength=count) / safe
        out[:, _KINDS + 3] = np.log1p(np.bincount(at, w.end - w.start, count) / safe)
    return out, per


def encoded(text: Column, passage_words: int) -> Column:
    """The features of all passages of each text, end to end."""

    def of(texts: pa.Array) -> pa.Array:
        parts = [passages(texts.slice(a, b - a), passage_words) for a, b in slices(texts)]
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[p for _, p in parts]]) * FEATURES)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.float32), *[x.ravel() for x, _ in parts]])))

    return arrow_udf(of, "array<float>")(text)


def _softmax(s: np.ndarray, first: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(s - np.maximum.reduceat(s, first)[bag])
    return e / np.add.reduceat(e, first)[bag]


@dataclass
class GatedAttention:
    """tanh encoder E, attention weights V (tanh), U (gate) and w, and classifier c."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict:
        p, first = self.p, np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
        bag = np.repeat(np.arange(len(per)), per)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _softmax((t * g) @ p["w"], first, bag)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "first": first, "bag": bag, "logit": z @ p["c"] + p["b"]}

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(x, per)["logit"])) if len(per) else np.zeros(0)

    def gradients(self, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, r = self.p, self.forward(x, per)
        h, t, g, a, bag = r["h"], r["t"], r["g"], r["a"], r["bag"]
        d = (1 / (1 + np.exp(-r["logit"])) - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, r["first"])[bag])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": r["x"].T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": r["z"].T @ d, "b": np.array(d.sum())}


def fit(x: np.ndarray, per: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> GatedAttention:
    """Adam over bags (x: passages end to end, per: passages of each bag, y: labels)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    size = x.shape[1]
    draw = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    p = {"E": draw(size, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.array(0.0)}
    model = GatedAttention(x.mean(0), x.std(0) + 0.02, p)
    first = np.concatenate([[0], np.cumsum(per)])
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            some = np.sort(order[k : k + batch])
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
            step += 1
            for name, grad in model.gradients(x[rows], per[some], y[some]).items():
                grad = grad + decay * p[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, most_training: int, id: str, text: str, label: str, passage_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, passages and labels of at most most_training labelled documents, half of each label."""
    clean = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    clean = stored(clean)
    halves = [clean.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(most_training // 2) for y in (0, 1)]
    chosen = F.broadcast(stored(halves[0].unionByName(halves[1])))  # most_training rows at most
    bags = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(chosen, "id").select("id", "y", encoded(F.col("text"), passage_words).alias("x"))
    rows = bags.dropDuplicates(["id"]).orderBy("id").toArrow()
    lists = rows["x"].combine_chunks() if rows.num_rows else None
    if lists is None or not len(lists):
        return np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0)
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    per = np.array([len(v) // FEATURES for v in lists])
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(float), per, rows["y"].to_numpy().astype(float)


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most_training: int = 4000, passage_words: int = 128, to: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, learned from labels(id, label); a column named `to` is replaced.

    A null or empty text is scored as a document without words; without labels of both kinds every score is 0.5; no docs give no rows."""
    x, per, y = training_sample(docs, labels, most_training, id, text, label, passage_words)
    if len(set(y)) < 2:
        return docs.withColumn(to, F.lit(0.5))
    model = fit(x, per, y)

    def of(texts: pa.Array) -> pa.Array:
        parts = [model.score(*passages(texts.slice(a, b - a), passage_words)) for a, b in slices(texts)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(to, arrow_udf(of, "double")(F.col(f"`{text}`")))


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@QUERIES.query("op4_mil_quality")
def op4_mil_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = score_quality(docs, labels)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
