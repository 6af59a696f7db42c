"""Learned scores against plain loops over the same definitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from groundwork.llm import mil_quality, url_filter
from groundwork.llm.common import stored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _log_ratios(strings, order, least):
    """gram -> log ratio: each order's counts are smoothed by the types of their context and the next shorter gram."""
    out, grams = {}, {"a": Counter(), "b": Counter()}
    for text, a, b in strings:
        for k in range(1, order + 2):
            for i in range(len(text) - k + 1):
                grams["a"][text[i : i + k]] += a
                grams["b"][text[i : i + k]] += b

    def probability(side, g):
        if not g:
            return 1 / 256
        after = [n for h, n in grams[side].items() if len(h) == len(g) and h[:-1] == g[:-1] and n > 0]
        low = probability(side, g[1:])
        return (grams[side][g] + len(after) * low) / (sum(after) + len(after)) if after else low

    for g in set(grams["a"]) | set(grams["b"]):
        if grams["a"][g] + grams["b"][g] >= least:
            out[g] = math.log(probability("a", g) / probability("b", g))
    return out


@pytest.mark.parametrize("order, least", [(3, 2), (2, 1)])
def test_op2_scores_equal_plain_counts(spark, order, least):
    rng = random.Random(8)
    strings = [("".join(rng.choice("ab/.é") for _ in range(rng.randrange(1, 14))), rng.randrange(3), rng.randrange(3)) for _ in range(50)] + [("zq", 1, 0), ("", 1, 1), ("unseen~", 0, 0)]
    strings = list({s[0]: s for s in strings}.values())
    df = spark.createDataFrame(strings, "text string, n_allow int, n_block int")
    want = _log_ratios(strings, order, least)
    model = stored(url_filter.language_models(df, order, least))
    got = {r.g: r.ratio for r in model.collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    scores = {r.text: r.score for r in url_filter.ratio_scores(df, model, order).collect()}
    for text, _, _ in strings:
        longest = [next((want[text[i - k : i]] for k in range(min(order + 1, i), 0, -1) if text[i - k : i] in want), 0.0) for i in range(1, len(text) + 1)]
        assert abs(scores.get(text, 0.0) - (sum(longest) / len(longest) if longest else 0.0)) < 1e-9, text


def _features(text, passage_words):
    """Passages of a text, each from its first word to the next passage's, by plain counting."""
    data = (text or "").encode()
    found = list(WORD.finditer(data))
    out = []
    for k in range(0, max(len(found), 1), passage_words):
        part = found[k : k + passage_words]
        row = np.zeros(mil_quality.FEATURES)
        if part:
            end = found[k + passage_words].start() if k + passage_words < len(found) else len(data)
            shares = Counter(int(mil_quality._CLASS[b]) for b in data[part[0].start() : end])
            for c, n in shares.items():
                row[c] = math.sqrt(n / sum(shares.values()))
            words = [m[0] for m in part]
            repeats = sum(x == y for x, y in zip(words, words[1:]))
            row[-4:] = math.log1p(len(words)), len(set(words)) / len(words), repeats / len(words), math.log1p(sum(map(len, words)) / len(words))
        out.append(row)
    return out


TEXTS = ["one two two three", "  leading blanks", None, "", "\n\n", "tail blanks   ", "\tÄpfel 12, 12 $%& x", "w " * 40 + "end"]


def test_op4_features_do_not_depend_on_the_texts_beside():
    together, per = mil_quality.passages(pa.array(TEXTS), 7)
    want = [_features(t, 7) for t in TEXTS]
    assert per.tolist() == [len(x) for x in want]
    assert np.allclose(together, np.concatenate(want), atol=1e-6)


def test_op4_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    x, per = mil_quality.passages(pa.array(TEXTS), 7)
    model = mil_quality.fit(x.astype(float), per, rng.integers(0, 2, len(per)).astype(float), hidden=5, gate=3, epochs=3)
    p, got = model.p, model.score(x.astype(float), per)
    for i, text in enumerate(TEXTS):
        rows = [[(v - m) / s for v, m, s in zip(row, model.mean, model.scale)] for row in _features(text, 7)]
        hidden = [[math.tanh(sum(v * p["E"][a, b] for a, v in enumerate(row)) + p["e"][b]) for b in range(5)] for row in rows]
        sees = [sum(math.tanh(sum(h[a] * p["V"][a, j] for a in range(5))) / (1 + math.exp(-sum(h[a] * p["U"][a, j] for a in range(5)))) * p["w"][j] for j in range(3)) for h in hidden]
        whole = sum(math.exp(s) for s in sees)
        bag = [sum(math.exp(s) / whole * h[a] for s, h in zip(sees, hidden)) for a in range(5)]
        logit = sum(b * c for b, c in zip(bag, p["c"])) + float(p["b"])
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-5, text
