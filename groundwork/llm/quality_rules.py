"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one failure bit per rule; a policy is a versioned set of rules and is applied
with one bitwise AND, so that a new policy, or the question what each rule
removes alone, needs no second pass over the texts.

Defined cases: a null or empty text has no words and fails `few_words`; repeated
rows are judged each on its own; an empty table gives an empty ledger; other
columns of the input are not read, so their names cannot clash; texts of any
length are measured whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import QUERIES, table
from .words import buffers, grams, mix, slices, spans, words

MEASURES = "n_words n_lines word_chars n_symbols n_dup_lines n_repeat_words n_upper n_bangs".split()
#: Words in a window for n_repeat_words.
WINDOW = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _within(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Names made distinct between documents."""
    return mix(names + mix(doc.astype(np.uint64) * _ODD))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of them are not the first."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys):
        same[1:] = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    twice[order] = same | np.append(same[1:], False)
    return twice, later


def _counts(texts: pa.Array) -> list[np.ndarray]:
    w = words(texts)
    n = len(w.first) - 1
    data, at = buffers(texts)
    per_doc = lambda hits: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(hits)]))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    # lines: cut at each \n and at each text's end
    cuts = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.union1d(cuts[:-1] + 1, at[:-1]).astype(np.int64)
    starts = starts[starts < len(data)]
    line_doc = np.searchsorted(at[1:], starts, "right")
    ends = np.minimum(cuts[np.searchsorted(cuts, starts)], at[1:][line_doc])
    inked = np.concatenate([[0], np.cumsum(~space)])
    some = inked[ends] > inked[starts]
    starts, ends, line_doc = starts[some], ends[some], line_doc[some]
    _, later = _again(_within(spans(data, starts, ends), line_doc))
    # windows of words
    keys = grams(w.names, WINDOW)
    inside = np.flatnonzero(w.room()[: len(keys)] >= WINDOW)
    twice, _ = _again(_within(keys[inside], w.doc[inside]))
    cover = np.zeros(len(w.names) + 1, np.int64)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    by = lambda doc, n=n: np.bincount(doc, minlength=n)[:n]
    return [
        np.diff(w.first),
        by(line_doc),
        per_doc(((data & 0xC0) != 0x80) & ~space),
        per_doc(_SYMBOL[data]),
        by(line_doc[later]),
        by(w.doc[covered]),
        per_doc((data >= 65) & (data <= 90)),
        per_doc(data == 33),
    ]


def measure(texts: pa.Array) -> pa.Array:
    """The measurements of each text."""
    parts = [_counts(texts.slice(a, b - a)) for a, b in slices(texts)]
    columns = [np.concatenate(c) if parts else np.zeros(0, int) for c in (zip(*parts) if parts else [()] * len(MEASURES))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], MEASURES)


@dataclass(frozen=True)
class Rule:
    """A document fails where the expression over the measurements is true."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    Rule(5, "capitals", "100 * n_upper > 40 * word_chars"),
    Rule(6, "exclamations", "100 * n_bangs > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return reduce(lambda a, b: a | b, (bits[name] for name in self.rules), 0)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("2024-1", tuple(r.name for r in RULES))


def ledger(docs: DataFrame, text: str = "text", measures: str = "measures", failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a struct of measurements and the failure bits, each rule evaluated once."""
    df = docs.withColumn(measures, arrow_udf(measure, "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")(F.col(text)))
    bits = [F.when(_on(rule.fails, measures), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in rules]
    return df.withColumn(failed, reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def _on(condition: str, struct: str) -> Column:
    for m in MEASURES:
        condition = re.sub(rf"\b{m}\b", f"`{struct}`.{m}", condition)
    return F.expr(condition)


def passes(policy: Policy, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(book: DataFrame, policy: Policy, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One pass over the ledger: per rule of the policy, what fails it, what only it rejects, and what stays without it."""
    mask = policy.mask(rules)
    chosen = [r for r in rules if mask >> r.bit & 1]
    under = F.col(failed).bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count("*").alias("n"), F.count_if(under == 0).alias("kept")]
    for r in chosen:
        sums += [F.count_if(under.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"fails_{r.bit}"), F.count_if(under == (1 << r.bit)).alias(f"alone_{r.bit}")]
    one = book.agg(*sums)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"fails_{r.bit}").alias("n_failed"), F.col(f"alone_{r.bit}").alias("n_failed_alone"), (F.col("kept") + F.col(f"alone_{r.bit}")).alias("n_kept_without")) for r in chosen])
    return one.select(F.lit(policy.version).alias("policy"), F.col("n").alias("n_documents"), F.col("kept").alias("n_kept"), F.explode(rows).alias("r")).select("policy", "n_documents", "n_kept", "r.*")


def reject_low_quality(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns."""
    m, f = "__measures", "__failed"
    return ledger(docs, text, m, f).where(passes(policy, f)).select(*[F.col(f"`{c}`") for c in docs.columns])


@QUERIES.query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id",
        *[f"measures.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(BASE)).alias("base_failed"),
        passes(STANDARD).alias("kept"),
        "failed",
    )
