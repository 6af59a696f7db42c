"""Column expressions: years, positions, labels, weights, names.

All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Pseudo-count of reciprocal rank fusion.
RRF_K = 60
Z_95 = 1.95996


# years -----------------------------------------------------------------------
def to_astro_year(bce: Column, ce: Column) -> Column:
    """A pair of BCE and CE years as an astronomical year (1 BCE is 0); null without either."""
    return F.when(ce > 0, ce).when(bce > 0, F.lit(1) - bce).cast("int")


def signed_bce(year: Column) -> Column:
    """A BCE year as an astronomical one; what isn't positive is taken as converted."""
    return F.when(year > 0, F.lit(1) - year).otherwise(year)


def year_label(year: Column) -> Column:
    """A rounded astronomical year as "N CE" or "N BCE"."""
    y = F.round(year).cast("long")
    return F.when(y > 0, F.concat(y.cast("string"), F.lit(" CE"))).when(y.isNotNull(), F.concat((F.lit(1) - y).cast("string"), F.lit(" BCE")))


def astro_range(start_bce: Column, start_ce: Column, end_bce: Column, end_ce: Column) -> Column:
    """struct(first, last): a missing end copies the other, and the two are put in order."""
    a, b = to_astro_year(start_bce, start_ce), to_astro_year(end_bce, end_ce)
    a, b = F.coalesce(a, b), F.coalesce(b, a)
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))


# positions -------------------------------------------------------------------
def valid_position(lat: Column, lon: Column) -> Column:
    """Not null or NaN, within range, and not exactly (0, 0)."""
    fine = ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0)) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(fine, F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; -1 if a position is not valid."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    km = F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))
    return F.when(valid_position(lat1, lon1) & valid_position(lat2, lon2), km).otherwise(-1.0)


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360); 0 if a position is not valid."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.when(valid_position(lat1, lon1) & valid_position(lat2, lon2), F.pmod(angle + 360.0, F.lit(360.0))).otherwise(0.0)


def compass(bearing: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.round(bearing / 22.5).cast("int") % 16) + 1)


# vectors ---------------------------------------------------------------------
def dot(x: Column, y: Column, most: int = 128) -> Column:
    """Inner product over the shorter of both vectors, cut to `most` coordinates, in double precision."""
    n = F.least(F.size(x), F.size(y), F.lit(most))
    pairs = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def unit(x: Column, most: int = 128) -> Column:
    """A vector scaled to length 1, unless it is nearly zero or already that long."""
    v = F.transform(F.slice(x, 1, most), lambda a: a.cast("double"))
    square = F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a)
    return F.when((square > 1e-12) & (F.abs(square - 1) > 1e-6), F.transform(v, lambda a: a / F.sqrt(square))).otherwise(v)


# retrieval -------------------------------------------------------------------
def bm25_rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_saturation(tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def bm25_weight(tf: Column, df: Column, length: Column, n: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25_rarity(df, n) * bm25_saturation(tf, length, mean_length, k1, b)


def rrf_weight(weight: float, rank: Column, k: int = RRF_K) -> Column:
    return F.when(rank > 0, F.lit(float(weight)) / (rank + k)).otherwise(0.0)


def shown_score(dense: Column, fused: Column) -> Column:
    return F.when(dense > 0, dense).otherwise(fused * 30)


def trust_badge(cls: Column, status: Column, verified: Column) -> Column:
    return (
        F.when(status == "VERIFIED_MANUAL", "VERIFIED_MANUAL")
        .when((cls == "CLASS_A") & (status == "VERIFIED_CONSENSUS"), "VERIFIED_CONSENSUS")
        .when(verified > 0, "PARTIALLY_VERIFIED")
        .otherwise("UNVERIFIED_ROUGH_SCAN")
    )


# text ------------------------------------------------------------------------
def or_label(text: Column, label: str) -> Column:
    """The label for a null or blank text."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(label)).otherwise(text)


def first_named(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def shortened(text: Column, most: int = 50) -> Column:
    """A text of more than `most` characters as its first most - 3 and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def normal_number(text: Column) -> Column:
    """Trimmed, with plain dashes, and without commas between digits."""
    dashes = F.translate(F.trim(text), "‐‑‒–—―", "------")
    return F.when(F.contains(dashes, F.lit(",")), F.regexp_replace(dashes, r"(\d),(\d)", "$1$2")).otherwise(dashes)


def word_count(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def citation_key(author: Column, year: Column, title: Column) -> Column:
    """Surname (before a comma, else the last word), digits of the year and first word of the title, in small letters and digits."""
    a = F.trim(F.coalesce(author, F.lit("")))
    surname = F.when(a.contains(","), F.substring_index(a, ",", 1)).otherwise(F.substring_index(a, " ", -1))
    key = F.lower(F.concat(surname, F.regexp_replace(F.coalesce(year, F.lit("")), r"\D", ""), F.substring_index(F.trim(F.coalesce(title, F.lit(""))), " ", 1)))
    return first_named(F.regexp_replace(key, "[^a-z0-9]", ""), F.lit("ref_archaeo"))


def bibtex_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_])", r"\\$1")


# measures --------------------------------------------------------------------
def density_label(n: Column) -> Column:
    return F.when(n >= 5, "High Density").when(n >= 2, "Moderate").otherwise("Sparse")


def wilson_percent(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of k out of n, in percent within [0, 100]; (0, 0) for n = 0."""
    p, z2 = k / n, Z_95 * Z_95
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z_95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    bound = lambda x: F.when(n > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 100).otherwise(0.0)
    return bound(middle - half), bound(middle + half)
