"""Quantities, dates and places in text: mentions, attribution of a clause, and how well both work.

The mention grammars run in one Python table step per batch of texts, since a
mention is dropped where an earlier one overlaps it; all else is column
expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.scalars import signed_bce, wilson_percent, word_count
from groundwork.operators.matching import contained_terms
from groundwork.plans.scratch import spread
from groundwork.registry import operator
from groundwork.views import load, with_views

#: Where no mention may lie, in the order in which they are tried; fixed values.
EXCLUSIONS = (
    ("citation", r"\([A-Za-z\s]*,?\s*(\d{4})\s*:\s*(\d+)\)", 0),
    ("reference", r"(?:reference|ref|bibliography)\s+\d+", re.I),
    ("pointer", r"(?:figure|fig\.|plate|table|page|p\.|pp\.|volume|vol\.)\s+\d+", re.I),
    ("isbn", r"ISBN\s+[\d\-]+", re.I),
    ("headcount", r"\d+\s+(?:workers|laborers|people|men|women)", re.I),
    ("ratio", r"\b\d+\s+to\s+\d+\b(?!\s*(?:cal\s+)?(?:m|cm|mm|metres|meters|km|g|kg|BCE|CE|BC|AD))", re.I),
)
_N, _LEN, _BCE, _CE = r"(\d+(?:\.\d+)?)", r"(mm|cm|m|metres|meters)", r"(BCE|BC|B\.C\.E\.|B\.C\.)", r"(CE|AD|A\.D\.|C\.E\.)"
_ABOUT = r"(c\.|ca\.|circa|approx\.?|about|approximately)"
#: The grammars in order of priority: type, pattern, flags; fixed values.
GRAMMARS = (
    ("COMPOUND_DIMENSION", rf"{_N}\s*(?:x|×)\s*{_N}\s*(?:x|×)\s*{_N}\s*(mm|cm|m)", re.I),
    ("COMPOUND_DIMENSION", rf"{_N}\s*(?:by|x|×)\s*{_N}\s*(mm|cm|m)", re.I),
    ("COMPOUND_DIMENSION", r"\b(\d+)\s*:\s*(\d+)\s*:\s*(\d+)\b", 0),
    ("LINEAR_RANGE", rf"{_N}\s*(?:-|–)\s*{_N}\s*{_LEN}", re.I),
    ("LINEAR_RANGE", rf"between\s+{_N}\s+and\s+{_N}\s+{_LEN}", re.I),
    ("LINEAR_RANGE", rf"from\s+{_N}\s+to\s+{_N}\s+{_LEN}", re.I),
    ("DEPTH_ELEVATION", rf"depth\s+{_N}\s*{_LEN}", re.I),
    ("LINEAR_DIMENSION", rf"\b{_N}\s*(mm|cm|m)\b(?!\s*[:x×\d])", re.I),
    ("MASS_WEIGHT", rf"\b{_N}\s*(g|kg|mg|grams)\b", re.I),
    ("TEMPERATURE", rf"\b{_N}\s*(?:°C|deg\s*C|degrees\s*Celsius)\b", re.I),
    ("UNCALIBRATED_C14_BP", r"(\d+)\s*(?:±|\+/-)\s*(\d+)\s*(BP|rcybp)", re.I),
    ("AUTHOR_CALIBRATED_DATE", rf"(\d+)\s*(?:-|–|to)\s*(\d+)\s*cal\s*{_BCE}", re.I),
    ("AUTHOR_CALIBRATED_DATE", r"(\d+)\s*cal\s+BP", re.I),
    ("APPROX_DATE_BCE", rf"{_ABOUT}\s*(\d+)\s*{_BCE}", re.I),
    ("APPROX_DATE_CE", rf"{_ABOUT}\s*(\d+)\s*{_CE}", re.I),
    ("DATE_RANGE", rf"(\d+)\s*(?:-|–)\s*(\d+)\s*{_BCE}", re.I),
    ("DATE_RANGE_CE", rf"from\s+(\d+)\s+to\s+(\d+)\s*{_CE}", re.I),
    ("EXACT_DATE_BCE", rf"\b(\d+)\s*{_BCE}(?!\w)", re.I),
    ("EXACT_DATE_CE", rf"\b(?:(\d+)\s*{_CE}|(AD|A\.D\.)\s*(\d+))(?!\w)", re.I),
    (
        "ARTIFACT_SPECIMEN_COUNT",
        r"\b(\d+)\s+(?:\S+\s+)?(artifacts?|tools?|implements?|pieces?|cores?|flakes?|handaxes?|hand\s+axes?|choppers?|scrapers?|blades?|burins?|bifaces?|knives?|specimens?|assemblages?|pebble\s+tools?|stone\s+tools?|arrowheads?|points?|microliths?|sherds?|potsherds?|vessels?|beads?|figurines?|querns?|weights?|pithoi|pithos)",
        re.I,
    ),
    ("LOCUS_PROVENANCE", r"\b(Locus|Loc\.|Locality)\s+([A-Za-z0-9\-]+)", 0),
    ("SPATIAL_AREA", r"\bArea\s+([A-Za-z0-9]+)", 0),
    ("STRATUM_NAME", r"\bStratum\s+([IVXLCDM]+[A-Za-z]*|\d+[A-Za-z]*)", 0),
    ("TRENCH_ID", r"\bTrench\s+([IVXLCDM]+[A-Za-z]*|\d+[A-Za-z]*)", 0),
    ("BASKET_UNIT", r"\bBasket\s+(\d+[A-Za-z]*)", 0),
)
_TO_METRES = {"mm": 0.001, "cm": 0.01}
_TO_GRAMS = {"kg": 1000.0, "mg": 0.001}
_SPATIAL = {"LOCUS_PROVENANCE": "locus", "SPATIAL_AREA": "area", "STRATUM_NAME": "stratum", "TRENCH_ID": "trench", "BASKET_UNIT": "basket"}


def _plain(x: float, places: int) -> str:
    return f"{round(x, places):.{places}f}".rstrip("0").rstrip(".")


def normalised(kind: str, rule: int, g: tuple[str | None, ...]) -> tuple[str, str, bool]:
    """(value, unit, flagged) of a match by its groups.  Lengths are in metres, masses in grams, years astronomical."""
    year = lambda s: str(1 - int(s) if int(s) > 0 else int(s))
    if kind == "COMPOUND_DIMENSION":
        return (":".join(g), "compound_ratio", False) if rule == 2 else ("x".join(g[:-1]) + f" {g[-1]}", g[-1], False)
    if kind == "LINEAR_RANGE":
        f = _TO_METRES.get(g[2].lower(), 1.0)
        return f"[{_plain(float(g[0]) * f, 2)}, {_plain(float(g[1]) * f, 2)}] m", g[2], False
    if kind in ("LINEAR_DIMENSION", "DEPTH_ELEVATION"):
        return f"{_plain(float(g[0]) * _TO_METRES.get(g[1].lower(), 1.0), 3)} m", g[1], False
    if kind == "MASS_WEIGHT":
        return f"{_plain(float(g[0]) * _TO_GRAMS.get(g[1].lower(), 1.0), 6)} g", g[1], False
    if kind == "TEMPERATURE":
        return f"{g[0]} °C", "°C", False
    if kind == "UNCALIBRATED_C14_BP":
        return f"{g[0]}±{g[1]} {g[2]}", g[2], True
    if kind == "AUTHOR_CALIBRATED_DATE":
        return (f"{g[0]} cal BP", "cal BP", False) if len(g) == 1 else (f"[{year(g[0])}, {year(g[1])}]", f"cal {g[2]}", False)
    if kind in ("APPROX_DATE_BCE", "APPROX_DATE_CE"):
        return (year(g[1]) if kind.endswith("BCE") else f"+{int(g[1])}"), g[2], False
    if kind == "DATE_RANGE":
        return f"[{year(g[0])}, {year(g[1])}]", g[2], False
    if kind == "DATE_RANGE_CE":
        return f"[+{int(g[0])}, +{int(g[1])}]", g[2], False
    if kind == "EXACT_DATE_BCE":
        return year(g[0]), g[1], False
    if kind == "EXACT_DATE_CE":
        return f"+{int(g[0] or g[3])}", g[1] or g[2], False
    if kind == "ARTIFACT_SPECIMEN_COUNT":
        return g[0], "count", False
    return g[-1], _SPATIAL[kind], False


def _spans(patterns, text: str) -> Iterator[tuple[int, str, re.Match]]:
    for i, (name, pattern, flags) in enumerate(patterns):
        for m in re.finditer(pattern, text, flags):
            yield i, name, m


#: What every grammar needs.
TRIGGER = r"\p{Nd}|Locus|Loc\.|Locality|Area|Stratum|Trench"
MENTION = "doc_id bigint, ord int, mention_type string, raw_match string, normalized_value string, unit string, flagged boolean, span_start int, span_end int"


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> mentions in order of their start."""
    names = [f.split()[0] for f in MENTION.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            taken = [m.span() for _, _, m in _spans(EXCLUSIONS, text)]
            found = []
            for rule, kind, m in _spans(GRAMMARS, text):
                s, e = m.span()
                if all(s >= b or e <= a for a, b in taken):
                    taken.append((s, e))
                    found.append((s, e, kind, m.group(), *normalised(kind, rule, m.groups())))
            rows += [(doc, i, kind, raw, value, unit, flag, s, e) for i, (s, e, kind, raw, value, unit, flag) in enumerate(sorted(found))]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def mentions(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per mention of docs.  Spans count characters; raw_match is the text at the span.

    Texts without a digit or a word that a grammar starts with don't leave the JVM."""
    some = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(TRIGGER))
    return spread(some).mapInArrow(_mentions, MENTION)


def exclusion_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each exclusion pattern occurs, over all texts."""
    n = [F.sum(F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(("(?i)" if flags else "") + p), F.lit(0))), F.lit(0))).cast("long").alias(name) for name, p, flags in EXCLUSIONS]
    return docs.agg(*n)


def mention_profile(found: DataFrame) -> DataFrame:
    return found.groupBy("mention_type", "unit").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"), F.count_distinct("doc_id").alias("n_documents"))


def altered_mentions(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions whose raw match is not what stands at their span; empty if extraction never repairs."""
    return found.join(docs.select("doc_id", "text"), "doc_id").where(F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) != F.col("raw_match")).drop("text")


# attribution -----------------------------------------------------------------
_EVENTS = "founded|built|occupied|abandoned|established|invented|appeared|settled|dated|visited|arrived|recorded|conquered|flourished|excavated|discovered|invited|began|started|appointed|published|written|produced|devised|removed|transferred"
_COUNTED = "bifaces|microliths|potsherds|sherds|cores|flints|blades|tools|beads|axes|cleavers|handaxes|scrapers|points"
_TALLIED = "microliths|potsherds|sherds|flints|tools|cores|bifaces|axes|beads"
#: Patterns of the attribution rules; fixed values.
RULES = {
    "press": r"\b[A-Z][A-Za-z\s]+,\s*[A-Z][a-z]+,\s*(\d{1,2}[\./]\d{1,2}[\./]\d{4})\b",
    "journal": r"\b\d+\s*\(\s*(\d{4})\s*\)\s*:\s*\d+(?:-\d+)?\b",
    "volume": r"(?i)\b(?:vol\.|volume)\s*\d+[\s,]+(?:\(?\d{4}\)?)[,\s]+(?:pp?\.\s*\d+(?:-\d+)?)\b",
    "author_date": r"\b[A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?\s*\(\s*(\d{4}(?::\s*\d+)?)\s*\)",
    "lifespan": r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*\(\s*([12]\d{3})\s*[-–]\s*([12]\d{3})\s*\)",
    "table_depth": r"Depth\s*\((m|cm)\)[\s\S]*?\|\s*(\d+\.\d+)",
    "table_bp": r"(?i)Time\s+range\s+Present\s+to\s+([0-9,]+)\s*(BP|B\.P\.)",
    "table_year": r"Year\s*(?:\|\s*)?(\d{4})\b",
    "table_duration": r"Time\s+range\s+([0-9,]+)\b",
    "two_percentages": r"(\d+(?:\.\d+)?)\s*%[\s\S]*?(?:or|,|and)\s*(\d+(?:\.\d+)?)\s*%",
    "two_years": r"\((\d{4})\)[\s\S]*?(?:and|or)[\s\S]*?\((\d{4})\)",
    "two_tallies": r"(?i)(\d+)\s+([a-z]+)[\s\S]*?(?:and|or)\s+(\d+)\s+([a-z]+)",
    "footnote": r"(\d+(?:\.\d+)?)\s*(m|cm|mm|%)\.(\s*)(\d{1,3})\b",
    "measure": r"(?i)\b(\d+(?:\.\d+)?)\s*(m|metres|meters|cm|centimetres|mm|millimetres|km|kilometres|miles|hours)\b",
    "percentage": r"(\d+(?:\.\d+)?)\s*%",
    "count": rf"(?i)\b(\d+)\s+({_COUNTED})\b",
    "duration": r"(?i)\b(?:period\s+of\s+)?([0-9,]+)\s*(?:years|yrs)\b",
    "bce": r"(\d{1,4})\s*(BC|BCE)\b",
    "event": rf"(?i)\b(?:first\s+)?(?:{_EVENTS})\b[\w\s,]{{0,45}}?\b(?:in|during|around|ca\.|to|at)?\s*([12]\d{{3}})\b",
    "edition": r"(?i)\b(?:first|second|third|revised)\s+(?:edition|book|volume)\b[\w\s,\(]{0,35}?\b(?:in|\()\s*([12]\d{3})\b",
    "year_range": r"(?:from\s+)?([12]\d{3})\s*(?:to|[-–])\s*([12]\d{1,3})\b",
    "year": r"\b(1[0-9]{3}|20[0-9]{2})\b",
}
NON_FINDINGS = ("NON_FINDING", "PAGE_NUMBER", "BIBLIOGRAPHIC_CITATION", "CONTOUR_INTERVAL", "GRID_DIMENSIONS", "CATALOG_ACCESSION")


def attributed(clauses: DataFrame, text: str = "text", prop: str | None = None, subject: str | None = None) -> DataFrame:
    """clauses with rule, outcome, raw_value, value, unit, head_noun and astro_year: the first rule that matches decides.

    One CASE chooses the rule, and the values are taken by that rule's pattern only."""
    t = F.coalesce(F.col(text), F.lit(""))
    p = F.coalesce(F.col(prop), F.lit("")) if prop else F.lit("")
    s = F.coalesce(F.col(subject), F.lit("")) if subject else F.lit("")
    has = lambda rule, of=None: (t if of is None else of).rlike(RULES[rule])
    names = lambda *words: F.coalesce(F.greatest(F.lit(False), *[s.contains(w) for w in words]), F.lit(False))
    table = t.contains("|") | t.contains("Depth (m)") | t.contains("Time range")
    masked = F.regexp_replace(t, RULES["lifespan"], " ")
    noun = lambda g: F.regexp_extract(t, RULES["two_tallies"], g).rlike(f"^(?:{_TALLIED})$")
    rule = (
        F.when(p.isin(*NON_FINDINGS), "non_finding")
        .when(has("press"), "press")
        .when(has("journal") | has("volume"), "journal")
        .when(has("author_date") & ~t.contains("excavations") & ~names("excavation", "publication", "primer", "book"), "author_date")
        .when(has("lifespan") & (names("lifespan") | (p == "PERSON_LIFESPAN") | ((p == "") & (s == ""))), "lifespan")
        .when(table & has("table_depth"), "table_depth")
        .when(table & has("table_bp"), "table_bp")
        .when(table & has("table_year") & ((p == "HISTORICAL_DATE") | names("invention", "year")), "table_year")
        .when(table & has("table_duration"), "table_duration")
        .when(has("two_percentages"), "two_percentages")
        .when(has("two_years"), "two_years")
        .when(has("two_tallies") & noun(2) & noun(4), "two_tallies")
        .when(has("footnote"), "footnote")
        .when(has("measure") & ~t.contains("contour") & ~t.contains("grid"), "measure")
        .when(has("percentage"), "percentage")
        .when(has("count"), "count")
        .when(has("duration") & (p.isin("CHRONOLOGICAL_DURATION", "DURATION") | names("duration", "span")), "duration")
        .when(has("bce"), "bce")
        .when(has("event", masked), "event")
        .when(has("edition", masked), "edition")
        .when(has("year_range", masked), "year_range")
        .when(has("year", masked), "year")
        .otherwise("none")
    )
    made = clauses.withColumns({"rule": rule, "__m": masked})
    r = F.col("rule")
    take = lambda name, g, of=None: F.regexp_extract(t if of is None else F.col("__m"), RULES[name], g)
    end = take("year_range", 2, "m")
    start = take("year_range", 1, "m")
    full_end = F.when(F.length(end) == 2, F.concat(F.substring(start, 1, 2), end)).otherwise(end)
    raw = F.when(r == "table_depth", take("table_depth", 2)).when(r == "year_range", F.concat(start, F.lit("-"), full_end))
    for name in ("table_bp", "table_year", "table_duration", "footnote", "measure", "percentage", "count", "duration", "bce"):
        raw = raw.when(r == name, take(name, 1))
    for name in ("event", "edition", "year"):
        raw = raw.when(r == name, take(name, 1, "m"))
    unit = (
        F.when(r == "table_depth", take("table_depth", 1)).when(r == "table_bp", "BP").when(r.isin("table_duration", "duration"), "years").when(r.isin("table_year", "event", "edition", "year", "year_range"), "CE")
        .when(r == "footnote", take("footnote", 2)).when(r == "measure", take("measure", 2)).when(r == "percentage", "%").when(r == "count", "").when(r == "bce", take("bce", 2))
    )
    outcome = F.when(r.isin("non_finding", "press", "journal", "author_date", "lifespan"), "REJECTED_NON_FINDING").when(r.startswith("two_"), "AMBIGUOUS_MULTI_CANDIDATE").when(r == "none", "UNANCHORED_OR_DEGRADED").otherwise("CANDIDATE_ATTRIBUTED_FINDING")
    made = made.withColumns({"outcome": outcome, "raw_value": raw, "unit": unit, "head_noun": F.when(r == "count", take("count", 2))})
    number = F.replace(F.when(r == "year_range", start).otherwise(F.col("raw_value")), F.lit(","), F.lit("")).try_cast("double")
    year = F.when(r == "bce", signed_bce(number)).when(F.col("unit") == "CE", number)
    return made.withColumns({"value": number, "astro_year": year.cast("long")}).drop("__m")


def needs_second_pass(found: DataFrame, text: str = "text") -> Column:
    """Ambiguous clauses, and those with more than one year from 1000 to 2099."""
    years = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b(?:1[0-9]{3}|20[0-9]{2})\b"), F.lit(0))
    return (F.col("outcome") == "AMBIGUOUS_MULTI_CANDIDATE") | (F.size(years) > 1)


def naive_number(text: Column) -> Column:
    """The first number of a clause."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b\d+(?:[.,]\d+)?\b", 0)


def outcome_confusion(found: DataFrame, expected: str = "expected_action", truth: str = "true_value") -> DataFrame:
    """Cases per outcome class, from what was wanted (accept, reject or flag) and what came."""
    ok, cand = F.col("raw_value") == F.col(truth), F.col("outcome") == "CANDIDATE_ATTRIBUTED_FINDING"
    want = F.col(expected)
    cls = (
        F.when((want == "ACCEPT") & cand & ok, "CORRECT_ACCEPT").when((want == "ACCEPT") & cand, "WRONG_VALUE").when((want == "ACCEPT") & (F.col("outcome") == "AMBIGUOUS_MULTI_CANDIDATE"), "ABSTAINED")
        .when(want == "ACCEPT", "MISSED").when((want == "REJECT") & (F.col("outcome") == "REJECTED_NON_FINDING"), "CORRECT_REJECT").when((want == "REJECT") & cand, "FALSE_ACCEPT").when(want == "REJECT", "WEAK_REJECT")
        .when((want == "FLAG") & (F.col("outcome") == "AMBIGUOUS_MULTI_CANDIDATE"), "CORRECT_FLAG").otherwise("MISSED_FLAG")
    )
    return found.groupBy(cls.alias("outcome_class")).agg(F.count("*").alias("n"))


# evaluation ------------------------------------------------------------------
def gazetteer_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, kind, term) of terms(kind, term) that a text contains verbatim, any number of them."""
    return contained_terms(docs, terms, "doc_id", "text").select("doc_id", "term").join(terms.select("kind", "term").distinct(), "term").select("doc_id", "kind", "term")


def grounded_documents(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, grounded): whether every extracted(doc_id, term) occurs in its document."""
    return extracted.join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.bool_and(F.contains("text", F.col("term"))).alias("grounded"))


def document_report(docs: DataFrame, extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hits, n_extracted, n_expected, precision, recall)."""
    both = extracted.select("doc_id", "term").distinct().withColumn("x", F.lit(1)).join(expected.select("doc_id", "term").distinct().withColumn("y", F.lit(1)), ["doc_id", "term"], "full_outer")
    n = both.groupBy("doc_id").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_hits"), F.count("x").alias("n_extracted"), F.count("y").alias("n_expected"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return docs.select("doc_id", word_count(F.col("text")).alias("n_words")).join(n, "doc_id").withColumns({"precision": share("n_hits", "n_extracted"), "recall": share("n_hits", "n_expected")})


def corpus_report(report: DataFrame, least: float = 0.85) -> DataFrame:
    """Micro precision, macro recall, share of what was made up, and the gate."""
    a = report.agg(F.sum("n_hits").alias("h"), F.sum("n_extracted").alias("x"), F.avg("recall").alias("macro_recall"))
    p = F.when(F.col("x") > 0, F.col("h") / F.col("x")).otherwise(1.0)
    return a.select(p.alias("micro_precision"), "macro_recall", (1 - p).alias("hallucination_rate"), ((p >= least) & (F.col("macro_recall") >= least)).alias("passes"))


def mention_scores(found: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: TP, FP, FN, precision, recall with its 95 % interval, and specificity over cases that expect nothing.

    found(case_id, ord, raw, value) and expected(case_id, ord, raw, value) pair off by value, first with first, second with second."""
    nth = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "raw", "value").orderBy("ord")))
    key = ["case_id", "raw", "value", "k"]
    both = nth(found).select(*key).withColumn("x", F.lit(1)).join(nth(expected).select(*key).withColumn("y", F.lit(1)), key, "full_outer")
    a = both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("tp"), F.count_if(F.col("y").isNull()).alias("fp"), F.count_if(F.col("x").isNull()).alias("fn"))
    clear = cases.select("case_id").join(expected.select("case_id").distinct(), "case_id", "left_anti").join(found.select("case_id").distinct().withColumn("z", F.lit(1)), "case_id", "left").agg(F.count("*").alias("n_negative"), F.count_if(F.col("z").isNull()).alias("n_clear"))
    share = lambda k, n: F.when(n > 0, k / n).otherwise(0.0)
    low, high = wilson_percent(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.join(F.broadcast(clear)).withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "recall_low": low, "recall_high": high, "specificity": share(F.col("n_clear"), F.col("n_negative"))})


_FAMILY = {"date": ("APPROX_DATE_BCE", "APPROX_DATE_CE", "DATE_RANGE", "DATE_RANGE_CE", "EXACT_DATE_BCE", "EXACT_DATE_CE", "AUTHOR_CALIBRATED_DATE", "UNCALIBRATED_C14_BP"), "count": ("ARTIFACT_SPECIMEN_COUNT",), "measurement": ("LINEAR_DIMENSION", "LINEAR_RANGE", "COMPOUND_DIMENSION", "DEPTH_ELEVATION", "MASS_WEIGHT", "TEMPERATURE")}


def family(mention_type: Column) -> Column:
    out = F.lit("place")
    for name, kinds in _FAMILY.items():
        out = F.when(mention_type.isin(*kinds), name).otherwise(out)
    return out


def fact_recall(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(type, n_facts, n_clean, n_extracted): facts (page_id, type, true_value) that stand in the page's text, and those that a mention of their family holds."""
    found = mentions(pages, "page_id").select(F.col("doc_id").alias("page_id"), family(F.col("mention_type")).alias("type"), F.lower("raw_match").alias("raw")).distinct()
    f = facts.withColumn("__f", F.monotonically_increasing_id())
    clean = f.join(pages, "page_id", "left").select("__f", "page_id", "type", "true_value", F.coalesce(F.contains("text", F.col("true_value")), F.lit(False)).alias("clean"))
    v = F.lower("true_value")
    hit = clean.join(found, ["page_id", "type"], "left").groupBy("__f", "type", "clean").agg(F.max(F.coalesce(F.contains("raw", v) | F.contains(v, F.col("raw")), F.lit(False))).alias("hit"))
    return hit.groupBy("type").agg(F.count("*").alias("n_facts"), F.count_if("clean").alias("n_clean"), F.count_if("hit").alias("n_extracted"))


# queries ---------------------------------------------------------------------
@operator("t4_w13_mentions", with_views("""WITH m AS (SELECT id AS doc_id, 'EXACT_DATE_BCE' AS mention_type, '1200 BCE' AS raw_match, '-1199' AS normalized_value, 'BCE' AS unit, strpos(claim_text, '1200 BCE') - 1 AS s FROM {claims} WHERE contains(claim_text, '1200 BCE')
  UNION ALL SELECT id, 'LINEAR_DIMENSION', n || ' cm', regexp_replace(regexp_replace(printf('%.3f', CAST(n AS DOUBLE) / 100), '0+$', ''), '\\.$', '') || ' m', 'cm', strpos(claim_text, n || ' cm thick') - 1 FROM (SELECT id, claim_text, regexp_extract(claim_text, '([0-9]+) cm thick', 1) AS n FROM {claims} WHERE contains(claim_text, ' cm thick')) x)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS ord, mention_type, raw_match, normalized_value, unit, false AS flagged, CAST(s AS INTEGER) AS span_start, CAST(s + length(raw_match) AS INTEGER) AS span_end FROM m"""))
def _t4(spark, d):
    return mentions(load(spark, d, "claims"), "id", "claim_text")


@operator("t4_document_mentions")
def _t4b(spark, d):
    return mentions(load(spark, d, "documents"))


def _exclusions_sql() -> str:
    """Without look-ahead: what must not follow is an optional group, and only matches where it is empty count."""
    flagged = lambda p, flags: ("(?i)" if flags else "") + p
    plain = [f"CAST(sum(len(regexp_extract_all(text, '{flagged(p, f)}'))) AS BIGINT) AS {name}" for name, p, f in EXCLUSIONS if "(?!" not in p]
    ahead = [f"CAST(sum(len(list_filter(regexp_extract_all(text, '{flagged(p.replace('(?!', '(')[:-1], f)})?', 1), lambda x: x = ''))) AS BIGINT) AS {name}" for name, p, f in EXCLUSIONS if "(?!" in p]
    return f"SELECT {', '.join(plain + ahead)} FROM documents"


@operator("t5_exclusions", _exclusions_sql())
def _t5(spark, d):
    return exclusion_counts(load(spark, d, "documents"))


@operator("t6_mention_profile", with_views("SELECT t AS mention_type, u AS unit, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'EXACT_DATE_BCE' AS t, 'BCE' AS u FROM {claims} WHERE contains(claim_text, '1200 BCE') UNION ALL SELECT 'LINEAR_DIMENSION', 'cm' FROM {claims} WHERE contains(claim_text, ' cm thick')) x GROUP BY 1, 2"))
def _t6(spark, d):
    return mention_profile(mentions(load(spark, d, "claims"), "id", "claim_text")).select("mention_type", "unit", "n")


@operator("t14_never_repaired", with_views("SELECT id AS doc_id, claim_text AS raw_match FROM {claims} WHERE false"))
def _t14(spark, d):
    claims = load(spark, d, "claims").select(F.col("id").alias("doc_id"), F.col("claim_text").alias("text"))
    return altered_mentions(mentions(claims), claims).select("doc_id", "raw_match")


@operator("t7_attribution", with_views("""SELECT id, CASE WHEN contains(claim_text, ' cm thick') THEN 'measure' WHEN contains(claim_text, '1200 BCE') THEN 'bce' ELSE 'none' END AS rule,
  CASE WHEN contains(claim_text, ' cm thick') THEN regexp_extract(claim_text, '(\\d+) cm', 1) WHEN contains(claim_text, '1200 BCE') THEN '1200' END AS raw_value, CAST(CASE WHEN NOT contains(claim_text, ' cm thick') AND contains(claim_text, '1200 BCE') THEN -1199 END AS BIGINT) AS astro_year FROM {claims}"""))
def _t7(spark, d):
    return attributed(load(spark, d, "claims").select("id", "claim_text"), "claim_text").select("id", "rule", "raw_value", "astro_year")


@operator("t8_second_pass", with_views("SELECT id, len(regexp_extract_all(claim_text, '\\b(?:1[0-9]{3}|20[0-9]{2})\\b')) > 1 AS needs FROM {claims}".replace("[0-9]{3}", "[0-9][0-9][0-9]").replace("[0-9]{2}", "[0-9][0-9]")))
def _t8(spark, d):
    found = attributed(load(spark, d, "claims").select("id", "claim_text"), "claim_text")
    return found.select("id", needs_second_pass(found, "claim_text").alias("needs"))


@operator("t13_naive_number", with_views("SELECT id, regexp_extract(claim_text, '\\b\\d+(?:[.,]\\d+)?\\b', 0) AS number FROM {claims}"))
def _t13(spark, d):
    return load(spark, d, "claims").select("id", naive_number(F.col("claim_text")).alias("number"))


_TERMS = "(SELECT 'country' AS kind, n_name AS term FROM nation UNION ALL SELECT 'word', 'tion' UNION ALL SELECT 'word', 'License')"


def _terms(spark, d) -> DataFrame:
    return load(spark, d, "nation").selectExpr("'country' AS kind", "n_name AS term").union(spark.range(1).selectExpr("explode(array('tion', 'License')) AS term").selectExpr("'word' AS kind", "term"))


@operator("j25_gazetteer", with_views(f"SELECT doc_id, kind, term FROM documents JOIN {_TERMS} t ON contains(text, term)"))
def _j25(spark, d):
    return gazetteer_hits(load(spark, d, "documents"), _terms(spark, d))


@operator("t10_grounding", with_views("SELECT doc_id, bool_and(contains(text, w)) AS grounded FROM (SELECT doc_id, text, unnest(['the', 'of ']) AS w FROM documents) x GROUP BY 1"))
def _t10(spark, d):
    docs = load(spark, d, "documents")
    return grounded_documents(docs, docs.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("of "))).alias("term")))


_REPORT = f"hit AS (SELECT doc_id, term FROM documents JOIN {_TERMS} t ON contains(text, term)), want AS (SELECT doc_id, term FROM documents JOIN (SELECT 'tion' AS term UNION ALL SELECT 'the') t ON contains(lower(text), term)), bo AS (SELECT coalesce(h.doc_id, w.doc_id) AS doc_id, h.term AS x, w.term AS y FROM hit h FULL OUTER JOIN want w ON h.doc_id = w.doc_id AND h.term = w.term), rp AS (SELECT doc_id, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS h, count(x) AS x, count(y) AS y FROM bo GROUP BY 1)"


def _report(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    want = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(spark.range(1).selectExpr("explode(array('tion', 'the')) AS term")), F.expr("contains(text, term)")).select("doc_id", "term")
    return document_report(docs, gazetteer_hits(docs, _terms(spark, d)), want)


@operator("a25_document_report", with_views(f"WITH {_REPORT} SELECT doc_id, CAST(h AS BIGINT) AS n_hits, CAST(x AS BIGINT) AS n_extracted, CAST(y AS BIGINT) AS n_expected, round(CASE WHEN x > 0 THEN h / CAST(x AS DOUBLE) ELSE 1 END, 6) AS precision, round(CASE WHEN y > 0 THEN h / CAST(y AS DOUBLE) ELSE 1 END, 6) AS recall FROM rp"))
def _a25(spark, d):
    return _report(spark, d).select("doc_id", "n_hits", "n_extracted", "n_expected", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@operator("a25_corpus_report", with_views(f"WITH {_REPORT} SELECT round(sum(h) / CAST(sum(x) AS DOUBLE), 6) AS micro_precision, round(avg(CASE WHEN y > 0 THEN h / CAST(y AS DOUBLE) ELSE 1 END), 6) AS macro_recall FROM rp"))
def _a25b(spark, d):
    return corpus_report(_report(spark, d)).select(F.round("micro_precision", 6).alias("micro_precision"), F.round("macro_recall", 6).alias("macro_recall"))


@operator("f19_word_count", with_views("SELECT doc_id, CAST(len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) AS BIGINT) AS n_words FROM documents WHERE trim(text) <> ''"))
def _f19(spark, d):
    return load(spark, d, "documents").where("trim(text) <> ''").select("doc_id", word_count(F.col("text")).alias("n_words"))


@operator("a22_a23_mention_scores", with_views("""SELECT CAST(count(*) FILTER (WHERE contains(claim_text, ' cm thick')) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE contains(claim_text, '1200 BCE')) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE contains(claim_text, 'collapse')) AS BIGINT) AS fn FROM {claims}"""))
def _a22(spark, d):
    claims = load(spark, d, "claims").select(F.col("id").alias("case_id"), "claim_text")
    found = mentions(claims, "case_id", "claim_text").select(F.col("doc_id").alias("case_id"), "ord", F.col("raw_match").alias("raw"), F.col("normalized_value").alias("value"))
    number = F.regexp_extract("claim_text", r"(\d+) cm", 1)
    metres = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", number.try_cast("double") / 100), r"0+$", ""), r"\.$", "")
    good = claims.where(F.col("claim_text").contains(" cm thick")).select("case_id", F.lit(0).alias("ord"), F.concat(number, F.lit(" cm")).alias("raw"), F.concat(metres, F.lit(" m")).alias("value"))
    missed = claims.where(F.col("claim_text").contains("collapse")).select("case_id", F.lit(0).alias("ord"), F.lit("collapse").alias("raw"), F.lit("collapse").alias("value"))
    return mention_scores(found, good.unionByName(missed), claims).select("tp", "fp", "fn")


@operator("a24_t12_fact_recall", with_views("SELECT 'measurement' AS type, CAST(count(*) AS BIGINT) AS n_facts, CAST(count(*) FILTER (WHERE contains(claim_text, ' cm thick')) AS BIGINT) AS n_clean, CAST(count(*) FILTER (WHERE contains(claim_text, ' cm thick')) AS BIGINT) AS n_extracted FROM {claims}"))
def _a24(spark, d):
    pages = load(spark, d, "claims").select(F.col("id").alias("page_id"), F.col("claim_text").alias("text"))
    facts = pages.select("page_id", F.lit("measurement").alias("type"), F.concat(F.regexp_extract("text", r"(\d+) (?:cm|of|with)|(\d+)$", 1), F.lit(" cm")).alias("true_value"))
    return fact_recall(pages, facts)


@operator("a28_outcomes", with_views("SELECT CASE WHEN contains(claim_text, ' cm thick') OR contains(claim_text, '1200 BCE') THEN CASE WHEN contains(claim_text, ' cm thick') THEN 'CORRECT_ACCEPT' ELSE 'WRONG_VALUE' END ELSE 'MISSED' END AS outcome_class, CAST(count(*) AS BIGINT) AS n FROM {claims} GROUP BY 1"))
def _a28(spark, d):
    cases = load(spark, d, "claims").select("id", "claim_text", F.lit("ACCEPT").alias("expected_action"), F.regexp_extract("claim_text", r"(\d+) cm", 1).alias("true_value"))
    return outcome_confusion(attributed(cases, "claim_text"))
