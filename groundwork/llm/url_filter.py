"""URL filter: rules first, then a ratio of two character language models.

Rules label what they match.  From the labelled URLs two variable-order Markov
models are counted, one of allowed and one of blocked URLs, smoothed by
Witten-Bell interpolation from the longest context down to a uniform base.  A URL
that no rule matches is judged by the difference of its two log-likelihoods per
character against a threshold calibrated on labelled URLs held out of the counts.

DataFrame functions only.  URLs are counted and scored once per distinct
normalised string (host and path, digits folded), so a host with a third of all
pages costs one row per different string.  The model keeps every gram that occurs
`least_count` times, so it grows with the input; it is broadcast only if it has
at most `most_broadcast` grams.  Beyond that the grams with a thousandth of all counted
characters (so few, whatever the input) are broadcast and all others joined by a shuffle.

Defined cases: a null URL, and one without `://`, has empty host and path, no
characters and score 0; repeated rows are each returned; an empty table gives no
rows; with no labelled URLs every score is 0 and the threshold 0 (allow); other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import QUERIES, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule list is an expression in the plan, so its length is bounded.
MOST_RULES = 10_000
#: Grams of a model that may be broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST_GRAMS = 300_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits (ties: block first, then by text), as struct(rule, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r.rule), r.verdict != "block", r.rule))
    every = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("h"), F.lit(r.path).alias("p")) for r in ordered])
    hit = F.get(F.filter(every, lambda r: F.startswith(path, r["p"]) & ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"])))), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["rule"].alias("rule"), hit["verdict"].alias("verdict")))


def normalised(host: Column, path: Column) -> Column:
    return F.translate(F.concat(host, path), "123456789", "000000000")


def _grams(df: DataFrame, text: str, order: int) -> DataFrame:
    """A row per character of text, with the grams that end there: g1 is the character, g2 has one before it, ..."""
    at = df.where(F.length(text) > 0).withColumn("i", F.explode(F.sequence(F.lit(1), F.length(text))))
    return at.select("*", *[F.when(F.col("i") >= k, F.substring(F.col(text), F.col("i") - k + 1, F.lit(k))).alias(f"g{k}") for k in range(1, order + 2)])


def language_models(strings: DataFrame, order: int = 5, least_count: int = 2, alphabet: int = 256) -> DataFrame:
    """From strings(text, n_allow, n_block): gram -> log ratio of its smoothed probabilities, and how often it was counted."""
    at = _grams(strings.where("n_allow + n_block > 0"), "text", order)
    stacked = at.select("n_allow", "n_block", F.explode(F.array(*[f"g{k}" for k in range(1, order + 2)])).alias("g")).where(F.col("g").isNotNull())
    counts = stacked.groupBy("g").agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).withColumn("k", F.length("g"))
    counts = stored(counts.withColumn("total", F.col("a") + F.col("b")))
    seen = lambda c: F.count_if(F.col(c) > 0)
    contexts = counts.groupBy(F.substring("g", 1, 9999).substr(F.lit(1), F.length("g") - 1).alias("c"), F.col("k").alias("ck")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), seen("a").alias("ta"), seen("b").alias("tb"))
    kept = counts.where(F.col("total") >= least_count).withColumn("c", F.col("g").substr(F.lit(1), F.length("g") - 1)).join(contexts.withColumnRenamed("ck", "k"), ["c", "k"])
    kept = stored(kept)
    smooth = lambda n, total, types, low: F.when(F.col(total) > 0, (F.col(n) + F.col(types) * F.col(low)) / (F.col(total) + F.col(types))).otherwise(F.col(low))
    levels = []
    for k in range(1, order + 2):
        level = kept.where(F.col("k") == k)
        if k == 1:
            level = level.withColumns({"la": F.lit(1.0 / alphabet), "lb": F.lit(1.0 / alphabet)})
        else:
            level = level.withColumn("s", F.col("g").substr(F.lit(2), F.length("g"))).join(levels[-1].select(F.col("g").alias("s"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "s")
        levels.append(level.select("g", smooth("a", "na", "ta", "la").alias("pa"), smooth("b", "nb", "tb", "lb").alias("pb"), "total"))
    return reduce(DataFrame.unionByName, levels).select("g", F.log(F.col("pa") / F.col("pb")).alias("ratio"), "total")


def ratio_scores(strings: DataFrame, model: DataFrame, order: int = 5, most_broadcast: int = MOST_BROADCAST_GRAMS) -> DataFrame:
    """strings(text) -> text, score: the mean log ratio per character, each by its longest known gram.  model is a stored table."""
    at = _grams(strings.select("text"), "text", order)
    if model.count() > most_broadcast:
        return _shuffled_scores(at, model, order)
    for k in range(order + 1, 0, -1):
        at = at.join(F.broadcast(model.select(F.col("g").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))), f"g{k}", "left")
    best = F.coalesce(*[f"r{k}" for k in range(order + 1, 0, -1)], F.lit(0.0))
    return at.groupBy("text").agg(F.avg(best).alias("score"))


def _shuffled_scores(at: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same with a model of any size: the grams of a text are joined once each, with their places."""
    characters = model.where("length(g) = 1").agg(F.sum("total")).first()[0]
    heavy = F.broadcast(model.where(F.col("total") * 1000 >= characters).select("g", F.col("ratio").alias("heavy")))
    each = at.select("text", "i", F.explode(F.array(*[f"g{k}" for k in range(1, order + 2)])).alias("g")).where(F.col("g").isNotNull())
    per = each.groupBy("text", "g").agg(F.collect_list("i").alias("at")).join(heavy, "g", "left")
    rest = per.where("heavy is null").drop("heavy").join(model.where(F.col("total") * 1000 < characters).select("g", "ratio"), "g")
    known = per.where("heavy is not null").withColumnRenamed("heavy", "ratio").select(*rest.columns).unionByName(rest)
    best = known.select("text", F.explode("at").alias("i"), F.struct(F.length("g").alias("k"), "ratio").alias("r")).groupBy("text", "i").agg(F.max("r").alias("r"))
    sums = best.groupBy("text").agg(F.sum("r.ratio").alias("s"))
    texts = at.select("text").distinct().join(sums, "text", "left")
    return texts.select("text", (F.coalesce("s", F.lit(0.0)) / F.length("text")).alias("score"))


def calibrated(scores: DataFrame, width: float = 0.02) -> float:
    """The threshold on held-out scores(score, n_allow, n_block) with the best sum of both rates.  At most 10/width rows are sorted."""
    bins = scores.groupBy(F.round(F.least(F.greatest(F.col("score"), F.lit(-5.0)), F.lit(5.0)) / width).cast("int").alias("bin")).agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).orderBy("bin").collect()
    a, b = sum(r["a"] for r in bins), sum(r["b"] for r in bins)
    if not a or not b:
        return 0.0
    best, at, below_a, below_b = 0.0, 0.0, 0, 0
    for r, after in zip(bins, [*bins[1:], None], strict=True):
        below_a, below_b = below_a + r["a"], below_b + r["b"]
        gain = below_b / b - below_a / a
        if gain > best:
            best, at = gain, (r["bin"] + (after["bin"] if after else r["bin"] + 1)) / 2 * width
    return at


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", order: int = 5, least_count: int = 2, most_broadcast: int = MOST_BROADCAST_GRAMS) -> DataFrame:
    """pages with host, path, rule, verdict and score; columns of these names are replaced.

    A null url or one without a scheme has an empty host and path and is judged by the model; equal urls get equal rows; no pages give no rows."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.withColumns({"host": host, "path": path})
    judged = judged.withColumns({"__hit": matched(F.col("host"), F.col("path"), rules), "__text": normalised(F.col("host"), F.col("path"))})
    by = lambda v: F.count_if(F.col("__hit.verdict") == v)
    strings = stored(judged.groupBy(F.col("__text").alias("text")).agg(by("allow").alias("n_allow"), by("block").alias("n_block")))
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    model = stored(language_models(strings.where(~held), order, least_count))
    scores = stored(ratio_scores(strings, model, order, most_broadcast))
    threshold = calibrated(scores.join(strings.where(held & (F.col("n_allow") + F.col("n_block") > 0)), "text"))
    out = judged.join(scores.select(F.col("text").alias("__text"), F.col("score").alias("__score")), "__text", "left").withColumn("score", F.coalesce("__score", F.lit(0.0)))
    verdict = F.coalesce(F.col("__hit.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.withColumns({"rule": F.col("__hit.rule"), "verdict": verdict}).drop("__hit", "__text", "__score")


@QUERIES.query("op2_url_filter")
def op2_url_filter(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
