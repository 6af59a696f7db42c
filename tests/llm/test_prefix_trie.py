"""The trie against dictionaries, and the parentheses against a stack."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from groundwork.llm import prefix_trie as pt


def brute(rows, rebuild=True):
    """rows: (conv_id, turn, role, text) -> the nodes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    name = lambda r, x: hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
    own = {c: [(r, x) for _, r, _, x in sorted((t, r, name(r, x), x) for t, r, x in v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:] if rebuild else own[c]
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[c] for c in children[node]]
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[node] = (min(members[node]), len(node), up, len(members[node]), len(below), sum(b[5] for b in below) or 1, own_saved + sum(b[6] for b in below), digest)
    return sorted(out.values(), key=repr)


def rows_of(rng, n):
    texts = ["", "a", "é 中", "b" * 30, None]
    out = []
    for c in range(n):
        out += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.randrange(1, 12))]
    out += [(c, t, "user", "the same") for c in range(1000, 1300) for t in range(3)]  # a hot conversation
    out += [(2000, t, "user", f"turn {t}") for t in range(700)] + [(2001 + k, t, "user", f"turn {t}" if t < 600 - k else f"{k}") for k in range(4) for t in range(601)]
    return out + [(3001, None, "b", "x"), (3001, None, "a", "y"), (3001, 0, "a", "y"), (3001, 0, "a", "y"), (None, 1, "user", "gone"), (4000, 0, "user", "z" * 3_000_000), (4001, 0, "user", "z" * 3_000_000)]


@pytest.mark.parametrize("shards", [1, 5])
def test_equals_dictionaries(spark, shards):
    rows = rows_of(random.Random(6), 150)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "conv_id long, turn int, role string, text string, name string, size string, base string")
    got = pt.trie(pt.crossed(df), shards).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    plain = pt.trie(pt.sequences(pt.named_turns(df)), shards).collect()
    assert sorted(map(tuple, plain), key=repr) == brute(rows, rebuild=False)


def test_few_rows(spark):
    schema = "conv_id long, turn int, role string, text string"
    one = lambda rows: sorted(map(tuple, pt.trie(pt.crossed(spark.createDataFrame(rows, schema))).collect()), key=repr)
    assert one([]) == [] == one([(None, 1, "user", "x")])
    for rows in ([(1, 0, None, None)], [(5, 0, "user", "x"), (6, 0, "user", "x")], [(4, 0, "user", "x"), (9, 0, "user", "y")]):
        assert one(rows) == brute(rows)


@pytest.mark.parametrize("seed", range(12))
def test_find_close(seed):
    rng = random.Random(seed)
    bits, depth, n = [True], 1, rng.choice([1, 5, 200, 3000])
    for k in range(n):
        up = rng.random() < (0.9 if k < n * rng.random() else 0.45) or depth == 1
        bits.append(up)
        depth += 1 if up else -1
    bits += [False] * depth
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    for block in (2, 7, 128):
        tree = pt.Parentheses(np.array(bits), block)
        at = np.flatnonzero(tree.opens)
        assert tree.find_close(at).tolist() == [want[i] for i in at.tolist()]
