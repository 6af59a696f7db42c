"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.llm import bpe, chat_format, embedding_dedup, lm_score, mil_quality, minhash_dedup, mixing, quality_rules, registry, substring_dedup, url_filter

from groundwork.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, failed string, n_words string"


def make(spark, texts, sources=None):
    """documents with clashing extra columns."""
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentences(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", " \n\t ", "one", "one", "a b c", "x " * 3000, "É ß 中文 😀", "same line here\nsame line here\n"]


def test_every_query_runs_on_the_smallest_tables(spark, data):
    """Queries without a SQL twin give one row per row of their table; test_sql.py runs the others."""
    queries = registry.queries()
    assert {n.split("_")[0] for n in queries} == {f"op{i}" for i in range(1, 14)}
    for name in sorted(set(queries) - set(registry.oracle_sql())):
        of = "pages" if name.startswith("op2_") else "documents"
        assert queries[name](spark, data).count() == spark.read.parquet(f"{data}/{of}.parquet").count(), name


def test_op8_measures(spark):
    rng = random.Random(2)
    phrase = sentences(rng, 9)
    texts = [*EDGE, f"{phrase}\n{phrase} more words\n{phrase}", *[sentences(rng, rng.randrange(60)) + ("\nx\n" * rng.randrange(3)) + "#$ |" * rng.randrange(3) for _ in range(40)]]
    got = {r.doc_id: r for r in quality_rules.ledger(make(spark, texts)).select("doc_id", "measures.*").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), len(lines), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i])[1:7] == want, texts[i]


def test_op8_policy_and_ablation(spark):
    docs = make(spark, ["few words", sentences(random.Random(1), 50), "### $$$ %%% " * 20, None])
    book = quality_rules.ledger(docs, failed="bits")
    kept = [r.doc_id for r in quality_rules.reject_low_quality(docs).collect()]
    assert kept == [1] and quality_rules.reject_low_quality(docs).columns == docs.columns
    rows = {r.rule: r for r in quality_rules.ablation(book, quality_rules.STANDARD, "bits").collect()}
    assert rows["few_words"].n_failed == 2 and rows["few_words"].n_kept_without == 1 + rows["few_words"].n_failed_alone
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_op2_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x", "https://x.net", "https://x.net/", "http://example.com/de/2#t", "http://b.example.com/de/3", "http://notexample.com/de/", "http://q.org/fr/1", "http://q.org/FR/1", "HTTP://É.ORG/a", "http://h://i/j"]
    urls += [f"http://s{i}.example.net/en/{i}" for i in range(40)] + [f"http://t{i}.example.com/de/{i}" for i in range(40)] + ["http://z.example.io/en/5", "http://z.example.io/de/5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("score", "host", "path", "rule", "verdict", "text", "n_allow")})
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert {(r.text, r.n_allow) for r in got.values()} == {("clash", "clash")} and all(isinstance(r.score, float) for r in got.values())
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1] if rest is not None else ""
        host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        want = max(fits, key=lambda r: len(r.rule)) if fits else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want.rule if want else None), u
        assert got[i].verdict in ("allow", "block") and (not want or got[i].verdict == want.verdict)
    assert got[len(urls) - 2].verdict == "allow" and got[len(urls) - 1].verdict == "block"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_op2_model_does_not_shrink_as_pages_grow(spark):
    rng = random.Random(3)
    texts = ["rare.example/xyzzy0", "rare.example/xyzzy0/"] + ["".join(rng.choice("abcd/") for _ in range(60)) for _ in range(3000)]
    strings = spark.createDataFrame([(t, i % 2, 1 - i % 2) for i, t in enumerate(texts)], "text string, n_allow int, n_block int")
    model = stored(url_filter.language_models(strings))
    grams = Counter(t[i : i + k] for t in texts for k in range(1, 7) for i in range(len(t) - k + 1))
    assert {r.g for r in model.collect()} == {g for g, n in grams.items() if n >= 2}
    one, other = ({r.text: r.score for r in url_filter.ratio_scores(strings, model, most_broadcast=n).collect()} for n in (10**6, 0))
    assert len(one) == len(set(texts)) and one.keys() == other.keys() and all(abs(one[t] - other[t]) < 1e-9 for t in one)


def test_op2_plan_has_no_python(spark, data):
    plan = registry.queries()["op2_url_filter"](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def near_copies(rng):
    base = sentences(rng, 120, 5000).split()
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    second = texts[5].split()
    for _ in range(6):
        w = list(second)
        w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    shared = sentences(rng, 60, 5000)
    texts += [f"{shared} {sentences(rng, 80, 5000)}" for _ in range(30)]
    return texts + [texts[0], texts[0].upper(), texts[3]]


def test_op10_equals_brute_force(spark):
    texts = EDGE + near_copies(random.Random(7)) + ["one two", "one two", "One Two", "a b c d", "a b c d e"]
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    texts = [texts[i] for i in order]
    low = str.maketrans(url_filter.UPPER, url_filter.LOWER)
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(make(spark, texts), shingle=4).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_op10_estimate_loses_next_to_nothing():
    how = {n: p.default for n, p in inspect.signature(minhash_dedup.near_duplicates).parameters.items()}
    k, share, margin = how["k"], 0.8, how["margin"]
    least = math.ceil(k * (share - margin))
    assert sum(math.comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(least)) < 1e-6


def test_op10_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def passages(rng):
    p = [sentences(rng, n, 3000) for n in (20, 21, 35, 60)]
    texts = []
    for i in range(60):
        parts = [sentences(rng, rng.randrange(5, 60), 3000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(p), sentences(rng, rng.randrange(0, 30), 3000)]
        texts.append("\n ".join(parts))
    return texts + ["w " * 400, "a b " * 100, "w " * 50, p[3], p[3], " ".join([p[0]] * 3)]


def test_op6_equals_brute_force(spark):
    texts = EDGE + passages(random.Random(11))
    got = {r.doc_id: r["__kept"] for r in substring_dedup.remove_repeats(make(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        assert (got[i].n_words, got[i].n_removed, got[i].sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def test_op6_keys_are_names_of_the_rounds():
    """Equal windows have equal anchors whatever is around them, and these are names that the rounds made; without rounds they are the words."""
    rng, low = random.Random(12), pa.array
    seen, place, turns, n = {}, {}, Counter(), 0
    texts = passages(rng) + [f"{sentences(rng, k, 3)} {p} {sentences(rng, 9, 3)}" for p in (sentences(rng, 45, 9), "a b " * 22, "x y x y z " * 9) for k in range(25)]
    w = substring_dedup.words(low(texts))
    _, key, level = substring_dedup._anchors(w, 20)
    _, plain, none = substring_dedup._anchors(w, 20, rounds=0)
    for i in np.flatnonzero(w.room() >= 20):
        g = tuple(w.names[i : i + 20])
        n += 1
        turns[int(level[i])] += 1
        assert seen.setdefault(g, key[i]) == key[i]
    assert turns[2] > 0.5 * n and turns[1] + turns[2] > 0.6 * n and not none.any()
    high = (level > 0) & (w.room() >= 20)
    assert len(set(key[high]) - set(plain)) > 0.8 * len(set(key[high]))
    rounds = substring_dedup.symbols(w).round(1)
    first, second = rounds.names, np.append(rounds.start[1:], len(w.names)) - rounds.start
    for a, size in zip(rounds.start.tolist(), second.tolist(), strict=True):
        place.setdefault(first[np.searchsorted(rounds.start, a)], set()).add(tuple(w.names[a : a + size]))
    assert all(len(x) == 1 for x in place.values()) and second.max() > 1


def test_op6_sends_every_key(spark):
    """The keys that a text sends are those of all its windows, also where windows share a place and differ in the level of their key."""
    rng = random.Random(13)
    texts = passages(rng) + [f"{sentences(rng, k, 3)} {p} {sentences(rng, 9, 3)}" for p in (sentences(rng, 45, 9), "a b " * 22, "x y x y z " * 9) for k in range(25)]
    rows = make(spark, texts).select("doc_id", substring_dedup.anchors(F.col("text"), 20).alias("a")).select("doc_id", "a.*").collect()
    shared = 0
    for r in rows:
        w = substring_dedup.words(pa.array([texts[r.doc_id]]))
        place, key, _ = substring_dedup._anchors(w, 20)
        fits = np.flatnonzero(w.room() >= 20)
        want = Counter(k for _, k in {(int(p), int(k)) for p, k in zip(place[fits], key[fits].view(np.int64), strict=True)})
        assert sorted(r.once) == sorted(k for k, n in want.items() if n == 1) and sorted(r.more) == sorted(k for k, n in want.items() if n > 1)
        shared += len(set(zip(place[fits].tolist(), key[fits].tolist(), strict=True))) - len(set(place[fits].tolist()))
    assert shared > 0


def test_op6_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(None, "x " * 30, 1), (3, "x " * 30, 1), (4, "é", 1)], "doc_id long, text string, n_chars long")
    out = substring_dedup.without_repeats(docs)
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == docs.columns and rows[None] == ("x " * 30, 1) and rows[4] == ("é", 1) and rows[3] == ("x", 1)
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_op1_is_pfair(spark):
    rng = random.Random(5)
    docs = make(spark, EDGE + ["z" * rng.randrange(200) for _ in range(400)], ["a", "a", "b", None])
    rows = mixing.mix_sources(docs, {"a": 0.5, "b": 0.3}, block_chars=500, bucket_rows=50).collect()
    assert sorted(r.doc_id for r in rows) == list(range(docs.count()))
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(x) == 1 for x in by_slot.values())
    for blocks, weights in (({"a": 50, "b": 200, "c": 7}, {"a": 0.5, "b": 0.3, "c": 0.2}), ({"x": 1, "y": 1000}, {"x": 0.01, "y": 0.99})):
        plan = mixing.phases(blocks, weights)
        slots = {}
        for r in plan:
            for q in range(r["n"]):
                slots[r["slot0"] + q // r["share"] * r["ticks"] + r["slots"][q % r["share"]]] = (r["phase"], r["source"])
        assert sorted(slots) == list(range(sum(blocks.values())))
        for phase in {r["phase"] for r in plan}:
            share = {r["source"]: r["share"] / r["ticks"] for r in plan if r["phase"] == phase}
            count = Counter()
            for t, slot in enumerate((s for s in sorted(slots) if slots[s][0] == phase), 1):
                count[slots[slot][1]] += 1
                assert all(abs(count[s] - w * t) < 1 for s, w in share.items())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_op1_keeps_to_the_target_weights(spark):
    for weights in ({"a": 1 / 3, "b": 2 / 3}, {s: n**0.5 for s, n in zip("abcdefg", (900, 411, 333, 87, 50, 21, 7), strict=True)}, {"a": 1e-4, "b": 0.9999}):
        plan = mixing.phases({s: round(40_000 * w / sum(weights.values())) + 2 for s, w in weights.items()}, weights)
        for r in (r for r in plan if r["phase"] == 0):
            w = weights[r["source"]] / sum(weights.values())
            at = np.array([r["slot0"] + q // r["share"] * r["ticks"] + r["slots"][q % r["share"]] for q in range(r["n"])])
            had = np.arange(r["n"])
            assert (np.abs(had - w * at) < 1 + 1e-6).all() and (np.abs(had + 1 - w * (at + 1)) < 1 + 1e-6).all()
    blocks, weights = {"a": 500, "b": 2000, "c": 70}, {"a": 0.1, "b": 0.7, "c": 0.2}
    rows = mixing.planned(spark, blocks, weights, range_slots=100).collect()
    want = {(r["source"], r["first"] + q): r["slot0"] + x for r in mixing.phases(blocks, weights) for q, x in enumerate(r["slots"])}
    assert len(rows) == 2570 and {(r["__s"], r.mix_block): r.mix_slot for r in rows} == want


def test_op1_takes_many_sources(spark):
    docs = make(spark, ["z" * 50] * 600, [f"s{i}" for i in range(300)])
    slots = [r.mix_slot for r in mixing.mix_sources(docs, {"s0": 0, "s1": 1}, block_chars=100).collect()]
    assert len(slots) == 600 and set(slots) == set(range(300))


def test_op1_order(spark):
    docs = make(spark, ["z" * 50] * 100, ["a", "b"])
    out = mixing.mixed_order(docs, block_chars=100)
    slots = [r.mix_slot for r in out.collect()]
    assert slots == sorted(slots) and out.columns == [*docs.columns, "mix_slot"]


def test_op1_takes_clashes_nulls_and_repeats(spark):
    rows = [(i % 7 or None, "z" * (i % 30), (None, "a", "a", "b")[i % 4]) for i in range(200)] + [(1, None, None), (1, "", ""), (8, "y" * (3 << 20), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("mix_slot", "mix_block", "size", "rows", "n", "slots")})
    out = mixing.mix_sources(docs, block_chars=100, bucket_rows=20)
    key = lambda x: tuple(map(repr, x))
    made = out.collect()
    assert sorted(key((r.doc_id, r.text, r.source)) for r in made) == sorted(map(key, rows))
    assert all(isinstance(r.mix_slot, int) and r.size == "clash" for r in made) and sorted({r.mix_slot for r in made})[0] == 0
    by_slot = defaultdict(set)
    for r in made:
        by_slot[r.mix_slot].add(r.source)
    assert all(len(x) == 1 for x in by_slot.values())


def test_op5_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(9)
    pool = "abcdeehinnorsttu   \n\t'.,19²½Ⅷ\x1c\x85\xa0éßñ中文한\u200b\u3000😀\u0301_-$ǅª"
    texts = EDGE + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(400)] + ["a" * n for n in range(30)] + ["%%%%% don't I'll", "<|endoftext|> x<|endoftext|>"]
    rows = {r.doc_id: r.tokens for r in bpe.tokenized(make(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want, text
        assert rows[i].decoded == t.decode(want, skip_special_tokens=False)
    both = make(spark, texts).select("doc_id", bpe.decode(bpe.encode(F.col("text"), bpe.automaton(spark, path)), bpe.automaton(spark, path)).alias("t"))
    assert all(r.t == (texts[r.doc_id] or "") for r in both.collect())


def test_op5_memory_stays_bounded(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = bpe.tables(bpe.compiled(bpe.vocabulary_text(path)))
    assert sum(x.nbytes for x in vars(made).values() if isinstance(x, np.ndarray)) < 4 << 20
    monkeypatch.setattr(bpe, "MOST_WORDS", 50)
    monkeypatch.setattr(bpe, "KNOWN_ARCS", 64)
    monkeypatch.setattr(bpe, "LONG_WORD", 20)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40)]
    small, library = bpe.Encoder(made), Tokenizer.from_file(path)
    for k in range(0, 40, 4):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts[k : k + 4])] == [library.encode(x, add_special_tokens=False).ids for x in texts[k : k + 4]]
        assert len(small) <= 170 and len(small.older) <= 170


def test_op5_takes_very_long_texts_and_words(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    texts = ["".join(rng.choice("aeinost ") for _ in range(3 << 20)), "".join(rng.choice("abcé") for _ in range(60_000)), "-" * 9000, None]
    for r in bpe.tokenized(make(spark, texts).withColumn("tokens", F.lit("clash"))).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.array_equal(np.frombuffer(r.tokens.ids, "<u4"), want) and r.tokens.decoded == (texts[r.doc_id] or "")
    assert bpe.tokenized(make(spark, ["x"]).limit(0)).count() == 0


def test_op9_round_trip(spark):
    turns = [(1, 0, "system", "be <|end|>\n brief"), (1, 1, "user", "</s>[INST] a\\ [/INST]"), (1, 2, "assistant", "<|turn:user|>\n\\<|end|>\n"), (1, 2, "assistant", None), (None, 0, None, "x"), (2, None, "assistant", "é😀"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    segments = chat_format.formatted(df)
    got = {r.conv_id: r for r in chat_format.digests(segments).collect()}
    by = defaultdict(list)
    for c, turn, role, text in turns:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        want = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0


def test_op9_events_fold(spark):
    e = [(1, 0, 1, 0, "message", "user", "hi"), (1, 1, 1, 1, "message", "assistant", ""), (1, 1, 1, 2, "delta", None, "a"), (1, 1, 1, 4, "regenerate", None, None), (1, 1, 1, 5, "delta", None, "c"), (1, 1, 1, 6, "delta", None, "d"), (1, 2, 1, 7, "message", "user", "x"), (1, 2, 1, 8, "edit", None, "y"), (1, 3, 1, 9, "message", "user", "z"), (1, 3, 1, 10, "delete", None, None)]
    df = spark.createDataFrame(e, "conv_id long, message long, copy int, seq long, kind string, role string, text string")
    assert sorted((r.message, r.role, r.text) for r in chat_format.final_messages(df).collect()) == [(0, "user", "hi"), (1, "assistant", "cd"), (2, "user", "y")]


def test_op7_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 64))
    rows = []
    for i in range(300):
        v = centers[i % 12] + rng.standard_normal(64) * rng.uniform(0.05, 0.45)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 12 % 3)))
    rows += [(300 + i, rows[5][1], 5 % 3) for i in range(4)] + [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] * 64, 1), (403, rows[0][1], None), (404, [None] * 64, 1), (405, [], 1)]
    got = {r.vec_id: r for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=40).collect()}
    good = [r for r in rows if r[0] < 400]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.93) & (same[:, None] == same[None]) & ~np.eye(len(good), dtype=bool)
    found = sum(got[r[0]].n_links for r in good)
    assert 0.97 * link.sum() <= found <= link.sum()
    assert all(got[r[0]].n_links <= n for r, n in zip(good, link.sum(1), strict=True))
    assert got[300].component_id == got[5].component_id and not got[300].kept
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(400, 406))


def test_op7_finds_links_near_the_threshold(spark):
    rng, rows, n = np.random.default_rng(4), [], 0
    half = np.where(np.arange(62) < 31, 1, 0.01)
    for scale in (np.ones(2), np.ones(4), np.ones(8), 1 / np.arange(1.0, 65), half, np.where(np.arange(61) < 31, 1, 0)):
        for _ in range(80):
            x, z = rng.standard_normal((2, len(scale))) * scale
            x /= np.linalg.norm(x)
            z -= (z @ x) * x
            rows += [(n, x.tolist(), n), (n + 1, (0.931 * x + math.sqrt(1 - 0.931**2) * z / np.linalg.norm(z)).tolist(), n)]
            n += 2
    links = {r.vec_id: r.n_links for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [i for i, c in links.items() if c != 1] == []


def test_op7_takes_clashes_repeats_and_no_rows(spark):
    v = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.01, 0.1]]
    rows = [(1, v[0], 0, "x"), (1, v[0], 0, "x"), (2, v[1], 0, "x"), (3, v[2], 0, "x"), (None, v[0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string").withColumns({c: F.lit("clash") for c in ("id", "v", "u", "rep", "copies")})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.similar_vectors(df).collect())
    assert [x[0] for x in got] == [0, 1, 1, 2, 3] and got[0][1] == 0 and got[3][1:] == (0, 2, True) and got[4][2:] == (1, False) and got[1][2] == 1
    assert embedding_dedup.similar_vectors(df.limit(0)).count() == 0


def test_op4_learns_and_is_bounded(spark):
    rng = random.Random(6)
    clean = [sentences(rng, rng.randrange(5, 400)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in sentences(rng, rng.randrange(30, 300)).split()) for _ in range(60)] + ["w1 " * rng.randrange(40, 200) for _ in range(60)]
    texts = [x for p in zip(clean, bad, strict=False) for x in p] + clean[120:] + [None, ""]
    docs = make(spark, texts)
    y = [int(i % 2 == 0 or i >= 240) for i in range(len(texts) - 2)]
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, quality int")
    r = {x.doc_id: x.score for x in mil_quality.score_quality(docs, labels, most_training=150).select("doc_id", "score").collect()}
    held = [i for i in range(len(y)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((r[i] >= 0.7) == bool(y[i]) for i in held) >= 0.93 * len(held)
    assert all(0 <= s <= 1 for s in r.values()) and len(r) == len(texts)
    assert {x.score for x in mil_quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert mil_quality.score_quality(docs.limit(0), labels).count() == 0
    clash = mil_quality.score_quality(docs.withColumns({c: F.lit("clash") for c in ("score", "label", "quality")}), labels, most_training=150)
    assert {x.doc_id: x.score for x in clash.collect()} == r


def test_op4_gradients():
    rng = np.random.default_rng(1)
    x, per, y = rng.standard_normal((9, mil_quality.FEATURES)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    m = mil_quality.fit(x, per, y, hidden=5, gate=3, epochs=1)
    m.p = {k: np.array(v) for k, v in m.p.items()}
    loss = lambda: -np.mean(y * np.log(m.score(x, per)) + (1 - y) * np.log(1 - m.score(x, per)))
    for name, g in m.gradients(x, per, y).items():
        w = m.p[name]
        at = tuple(rng.integers(0, s) for s in w.shape)
        keep = w[at].copy()
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name


@pytest.mark.parametrize("how", [{}, {"frequent": 1e-2, "part_words": 500}, {"least_count": 1, "part_words": 200}])
def test_op3_equals_brute_force(spark, how):
    rng = random.Random(8)
    texts = EDGE + [sentences(rng, rng.randrange(1, 80), 60) for _ in range(80)]
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(w for d in words for w in d)
    pairs = Counter(p for d in words for p in zip(d, d[1:], strict=False))
    led = Counter(v for d in words for v in d[:-1])
    total = sum(n.values())
    got = {r.doc_id: r for r in lm_score.backoff_scores(make(spark, texts), **how).collect()}
    for i, d in enumerate(words):
        want, backed = (math.log(n[d[0]] / total), 0) if d else (0.0, 0)
        for p in zip(d, d[1:], strict=False):
            if pairs[p] >= how.get("least_count", 2):
                want += math.log(pairs[p] / led[p[0]])
            else:
                want, backed = want + math.log(0.4 * n[p[1]] / total), backed + 1
        assert abs(got[i].log_score - want) < 1e-6 and (got[i].n_words, got[i].n_backed) == (len(d), backed)
    assert lm_score.backoff_scores(make(spark, texts).limit(0)).count() == 0


def test_op3_cuts_batches_before_document_numbers_run_out(monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_DOCS", 60)
    monkeypatch.setattr(lm_score, "MOST_DOCS", 65)
    ids = pa.array(range(500))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["a b"] * 500)], ["id", "text"])
    made = list(lm_score._batches([batch.slice(0, 50), batch.slice(50, 450)]))
    assert [x for _, _, i in made for x in i.to_pylist()] == ids.to_pylist() and all(len(i) <= 65 and d.max() < 65 for _, d, i in made)
