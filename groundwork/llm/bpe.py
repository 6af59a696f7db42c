"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over
tokens that accepts exactly the token strings that BPE makes.  It starts with one
state and a loop for each byte.  A merge (u, v) -> w adds one gadget: the arcs u
are led to a copy of their target that has no arc v, and every state with an arc u
gets an arc w to where u v led.  Only what a gadget changes is kept: one removed
arc, one copied state, one new label.

The compiled automaton is laid out once as flat arrays, some 3 MB, and broadcast.
Its arcs are spelled out in bytes: `edges` holds (place, byte) in order, and edge k
leads to place k + 1, so one lookup steps a byte; the arcs that a state lacks are
the chain of removals of the states it was copied from.  A worker encodes all new
words of a slice at once: every word is stepped byte by byte from the left through
these arrays, with the arcs that are under way, and where an arc ends that its
state has, the state after that byte is known.  The automaton is deterministic, so
this is one state per byte.  Decoding emits the labels of the arcs.

Defined cases: a null or empty text has no tokens and decodes to the empty text;
texts of any length are encoded whole; repeated rows and other columns pass
through, and a column with the name of the result is replaced; an empty table gives
no rows; strings of special tokens are taken as those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import QUERIES, table
from .words import mix, slices

#: The pattern that byte-level vocabularies split text with.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of the characters in PLAIN, for which both libraries agree on letters, digits and spaces.
SPLIT_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
#: Words of a worker's younger and of its older memory, and arcs (a power of two) whose presence it remembers: both bound its memory.
MOST_WORDS, KNOWN_ARCS = 60_000, 1 << 19
#: Longer words are stepped one at a time.
LONG_WORD = 256


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Automaton:
    """labels: the bytes of each token; state 0 is the start.

    after[t]: the state that t leads to; origin[s], made[s]: the state that s was copied from and when; removed[s][t]: when arc t left state s;
    left[t], born[t]: the first part of label t and when it was made; name: of the vocabulary."""

    labels: list[bytes]
    specials: dict[str, int]
    after: dict[int, int]
    origin: list[int]
    made: list[int]
    removed: list[dict[int, int]]
    left: dict[int, int]
    born: dict[int, int]
    name: str = ""

    def has(self, state: int, token: int, by: int) -> bool:
        """Whether at time `by` the state has an arc for the token.

        Going back in time, the state becomes the one it was copied from and the token its first part; neither may have been parted while both were there."""
        while True:
            at = self.removed[state].get(token)
            if at is not None and at <= by:
                return False
            made, born = self.made[state], self.born.get(token, 0)
            if self.origin[state] >= 0 and made >= born:
                by, state = min(by, made), self.origin[state]
            elif token in self.left:
                by, token = min(by, born), self.left[token]
            else:
                return True


def compiled(vocabulary: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary (the text of its JSON file)."""
    given = json.loads(vocabulary)
    alphabet, vocab = byte_alphabet(), given["model"]["vocab"]
    specials = {x["content"]: x["id"] for x in given["added_tokens"]}
    size = 1 + max([*vocab.values(), *specials.values()])
    labels = [b""] * size
    for word, t in vocab.items():
        labels[t] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
    for word, t in specials.items():
        labels[t] = word.encode()
    of_byte = {t: 0 for t in range(size) if len(labels[t]) == 1 and t not in specials.values()}
    a = Automaton(labels, specials, of_byte, [-1], [0], [{}], {}, {}, hashlib.sha256(vocabulary.encode()).hexdigest())
    users = {0: len(of_byte) + 1}  # tokens that lead to a state; the start counts as one
    for at, merge in enumerate(given["model"]["merges"], 1):
        u, v = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
        w = vocab[("".join(merge)) if isinstance(merge, list) else merge.replace(" ", "")]
        if u not in a.after or v not in a.after or w in a.after or not a.has(a.after[u], v, at - 1):
            continue
        target, then = a.after[u], a.after[v]
        if users[target] > 1 or u == v:  # others lead there too: the arcs u go to a copy
            users[target] -= 1
            a.origin.append(target)
            a.made.append(at - 1)
            a.removed.append({})
            target = a.after[u] = len(a.origin) - 1
            users[target] = 1
        a.removed[target][v] = at
        a.after[w], a.left[w], a.born[w] = then, u, at
        users[then] += 1
    return a


@dataclass
class Tables:
    """An automaton as flat arrays.  edges: place << 8 | byte, in order; ends: the token that ends at a place, or -1; gone: state << 20 | token, in order, and
    gone_at: when that arc left; after, left, born by token; origin, made by state."""

    edges: np.ndarray
    ends: np.ndarray
    gone: np.ndarray
    gone_at: np.ndarray
    after: np.ndarray
    left: np.ndarray
    born: np.ndarray
    origin: np.ndarray
    made: np.ndarray
    labels: list[bytes]
    specials: dict[str, int]
    name: str

    @property
    def encoder(self) -> Encoder:
        """The encoder of this process; only that of the last vocabulary is kept."""
        if self.name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.name] = Encoder(self)
        return _ENCODERS[self.name]


def tables(a: Automaton) -> Tables:
    size, known = len(a.labels), {a.labels[t]: t for t in a.after}
    place, edges, depth = {b"": 0}, [], 0
    while level := sorted({x[: depth + 1] for x in known if len(x) > depth}):  # in order of (place, byte)
        for prefix in level:
            edges.append(place[prefix[:-1]] << 8 | prefix[-1])
            place[prefix] = len(edges)
        depth += 1
    ends = np.full(len(place), -1, np.int32)
    for word, t in known.items():
        ends[place[word]] = t
    by_token = lambda d, none: np.array([d.get(t, none) for t in range(size)], np.int32)
    gone = sorted((s << 20 | t, at) for s, lacks in enumerate(a.removed) for t, at in lacks.items())
    keys, at = (np.array(x) for x in zip(*gone, strict=True)) if gone else (np.zeros(0, np.int64),) * 2
    flat = [np.array(edges, np.int64), ends, keys.astype(np.int64), at.astype(np.int32), by_token(a.after, -1), by_token(a.left, -1), by_token(a.born, 0), np.array(a.origin, np.int32), np.array(a.made, np.int32)]
    return Tables(*flat, a.labels, a.specials, a.name)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """Encodes by the tables; itself a bounded memory of words -> packed ids, in two generations, so frequent words stay."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.t, self.older = tables, {}
        self.packed = [int(t).to_bytes(4, "little") for t in range(len(tables.labels))]
        special = sorted(tables.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.asked = np.full(KNOWN_ARCS, -1, np.int64)  # state << 21 | token << 1 | whether the state has the arc
        self.first = np.zeros((257, 256), np.int32)  # the steps of the first places, which most steps are
        near = tables.edges[tables.edges >> 8 <= 256]
        self.first[near >> 8, near & 255] = np.arange(1, len(near) + 1)

    def step(self, place: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next place of each, or 0 where there is none."""
        near = place <= 256
        out = self.first[np.where(near, place, 0), byte]
        far = np.flatnonzero(~near)
        at, found = _find(self.t.edges, place[far].astype(np.int64) << 8 | byte[far])
        out[far] = np.where(found, at + 1, 0)
        return out

    def has(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token: Automaton.has() for all at once, for those not known already."""
        key = state.astype(np.int64) << 20 | token
        slot = (mix(key.view(np.uint64)) & np.uint64(KNOWN_ARCS - 1)).astype(np.int64)
        known = self.asked[slot]
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            some, at = np.unique(key[new], return_inverse=True)
            found = self._has(some >> 20, some & 0xFFFFF)[at]
            known[new] = key[new] << 1 | found
            self.asked[slot[new]] = known[new]
        return (known & 1).astype(bool)

    def _has(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        t, out, at = self.t, np.ones(len(state), bool), np.arange(len(state))
        by = np.full(len(state), 1 << 30, np.int64)
        while len(at):
            place, found = _find(t.gone, state << 20 | token)
            lost = found & (t.gone_at[np.minimum(place, len(t.gone_at) - 1)] <= by) if len(t.gone) else found
            out[at[lost]] = False
            made, born, origin = t.made[state], t.born[token], t.origin[state]
            older = (origin >= 0) & (made >= born)
            on = ~lost & (older | (t.left[token] >= 0))
            by = np.minimum(by, np.where(older, made, born))[on]
            state, token, at = np.where(older, origin, state)[on], np.where(older, token, t.left[token])[on], at[on]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """The packed ids of words, all stepped together; words of one length end together."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join([raw[k] for k in order.tolist()]), np.uint8)
        off = np.concatenate([[0], np.cumsum(size)])
        last, back = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int32)
        word = begin = np.zeros(0, np.int32)
        place, state = np.zeros((2, 0), np.int32)
        for e in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -e))  # words longer than e
            on = word < n
            every = np.arange(n, dtype=np.int32)
            now = self.t.after[last[off[:n] + e - 1]] if e else np.zeros(n, np.int32)
            word, begin = np.concatenate([word[on], every]), np.concatenate([begin[on], np.full(n, e, np.int32)])
            place, state = np.concatenate([place[on], np.zeros(n, np.int32)]), np.concatenate([state[on], now])
            place = self.step(place, data[off[word] + e])
            on = place > 0
            word, begin, place, state = word[on], begin[on], place[on], state[on]
            token = self.t.ends[place]
            ended = np.flatnonzero(token >= 0)
            ended = ended[self.has(state[ended], token[ended])]
            to = off[word[ended]] + e
            last[to], back[to] = token[ended], begin[ended]
            if (last[off[:n] + e] < 0).any():
                raise ValueError(f"no token ends {raw[order[int(np.flatnonzero(last[off[:n] + e] < 0)[0])]][: e + 1]!r}")
        every, end, found = np.arange(len(size)), size.copy(), []
        while len(every):  # the arcs from the last to the first
            at = off[every] + end - 1
            found.append((every, last[at]))
            end = back[at]
            every, end = every[end > 0], end[end > 0]
        count = np.zeros(len(size), np.int64)
        for some, _ in found:
            count[some] += 1
        ends = np.cumsum(count)
        ids = np.zeros(int(count.sum()), "<u4")
        for k, (some, token) in enumerate(found, 1):
            ids[ends[some] - k] = token
        flat, out = ids.tobytes(), [b""] * len(raw)
        for k, a, b in zip(order.tolist(), (4 * (ends - count)).tolist(), (4 * ends).tolist(), strict=True):
            out[k] = flat[a:b]
        return out

    def long_word(self, word: str) -> bytes:
        """The same for one word, with plain integers."""
        t, raw = self.t, word.encode()
        edges, ends, after, arcs = t.edges.tolist(), t.ends.tolist(), t.after.tolist(), {}
        last, back, state, live = array("i", [-1]) * len(raw), array("q", [0]) * len(raw), 0, []
        for e, byte in enumerate(raw):
            live.append((e, 0, state))
            on = []
            for begin, place, before in live:
                key = place << 8 | byte
                k = bisect_left(edges, key)
                if k == len(edges) or edges[k] != key:
                    continue
                on.append((begin, k + 1, before))
                token = ends[k + 1]
                if token < 0:
                    continue
                known = arcs.get((before, token))
                if known is None:
                    known = arcs[before, token] = bool(self._has(np.array([before]), np.array([token]))[0])
                if known:
                    last[e], back[e] = token, begin
            live = on
            if last[e] < 0:
                raise ValueError(f"no token ends {raw[: e + 1][-80:]!r}")
            state = after[last[e]]
            if len(arcs) > KNOWN_ARCS:
                arcs.clear()
        tokens, e = [], len(raw)
        while e:
            tokens.append(self.packed[last[e - 1]])
            e = back[e - 1]
        return b"".join(reversed(tokens))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        parts = [self.special.split(x) if self.special and self.special.search(x) else [x] for x in texts]
        split = [[(SPLIT_PLAIN if PLAIN.fullmatch(p) else SPLIT).findall(p) if k % 2 == 0 else p for k, p in enumerate(of)] for of in parts]
        new = set().union(*[ws for of in split for ws in of[::2]]) - self.keys()
        self.update((w, self.older[w]) for w in new & self.older.keys())
        new -= self.older.keys()
        short = [w for w in new if len(w) <= LONG_WORD // 4]
        self.update(zip(short, self.words(short), strict=True))
        self.update((w, self.long_word(w)) for w in new if len(w) > LONG_WORD // 4)
        out = [b"".join([b"".join(map(self.__getitem__, ws)) if k % 2 == 0 else self.packed[self.t.specials[ws]] for k, ws in enumerate(of)]) for of in split]
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.t.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # a file beside the driver, given by its user
        return f.read()


def automaton(spark: SparkSession, vocabulary_path: str):
    """The compiled vocabulary as flat arrays, broadcast."""
    return spark.sparkContext.broadcast(tables(compiled(vocabulary_text(vocabulary_path))))


def _encoded(texts: pa.Array, encoder: Encoder) -> list[bytes]:
    return [ids for a, b in slices(texts, 2 << 20) for ids in encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])]


def encode(text: Column, shared) -> Column:
    """Token ids of each whole text, packed as little-endian 32-bit integers."""
    return arrow_udf(lambda texts: pa.array(_encoded(texts, shared.value.encoder), pa.binary()), "binary")(text)


def decode(ids: Column, shared) -> Column:
    """The text of packed token ids."""
    return arrow_udf(lambda packed: pa.array([shared.value.encoder.decode(p or b"") for p in packed.to_pylist()], pa.string()), "string")(ids)


def encode_and_decode(text: Column, shared) -> Column:
    """struct(ids, decoded): encode() and then decode() in one pass."""

    def of(texts: pa.Array) -> pa.Array:
        e = shared.value.encoder
        ids = _encoded(texts, e)
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([e.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

    return arrow_udf(of, "struct<ids:binary,decoded:string>")(text)


def tokenized(docs: DataFrame, vocabulary_path: str | None = None, text: str = "text", to: str = "tokens") -> DataFrame:
    """docs with the struct `to` of encode_and_decode()."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    return docs.withColumn(to, encode_and_decode(F.col(f"`{text}`"), automaton(docs.sparkSession, vocabulary_path)))


def digests(tokens: str = "tokens") -> list[Column]:
    return [
        (F.length(f"{tokens}.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(f"{tokens}.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col(f"{tokens}.decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]


@QUERIES.query("op5_bpe")
def op5_bpe(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenized(docs).select("doc_id", *digests())
