"""Scalar column helpers: coercion, flags, bins, labels, text and geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month -> season, in calendar order.
SEASONS = {
    1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer",
    7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn", 12: "winter",
}
SEASON_LEVELS = ["winter", "spring", "summer", "autumn"]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
EARTH_RADIUS_KM = 6371.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """Number or NULL; NaN and infinities count as missing."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def moment(x: Column | str, fmt: str | None = None) -> Column:
    """Timestamp or NULL."""
    return F.try_to_timestamp(_c(x), F.lit(fmt)) if fmt else F.try_to_timestamp(_c(x))


def flag(x: Column | str) -> Column:
    """1 where the value is a number above zero, else 0, also when missing."""
    return (F.coalesce(number(x), F.lit(0.0)) > 0).cast("int")


def holds(condition: Column) -> Column:
    """Condition as 0/1 with NULL read as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """Label of the first rule that holds."""
    expr = None
    for cond, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def cyclical(x: Column | str, period: int) -> tuple[Column, Column]:
    angle = F.pmod(number(x), F.lit(float(period))) * (2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def slug(x: Column | str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_c(x).cast("string"))), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(F.coalesce(s, F.lit("unknown")))


def py_slug(text: str) -> str:
    """Same rule for level names known on the driver."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in str(text).strip().lower())
    return "_".join(kept.split()) or "unknown"


def right_closed(x: Column | str, edges: Sequence, labels: Sequence | None = None) -> Column:
    """Bin (lo, hi], lowest edge included; outside the edges NULL. Edges are literals or columns."""
    v = _c(x)
    es = [e if isinstance(e, Column) else F.lit(e) for e in edges]
    expr = None
    for i in range(1, len(es)):
        low = v >= es[0] if i == 1 else v > es[i - 1]
        cond = low & (v <= es[i])
        value = F.lit(labels[i - 1] if labels is not None else i)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def clipped(x: Column | str, low=None, high=None) -> Column:
    """Clip that keeps NULL missing."""
    v = _c(x)
    out = v
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(v.isNotNull(), out)


def season(month: Column | str) -> Column:
    m = _c(month)
    return first_match([(m.isin([k for k, s in SEASONS.items() if s == name]), name) for name in SEASON_LEVELS], "unknown")


def daypart(hour: Column | str) -> Column:
    h = F.coalesce(number(hour), F.lit(0.0))
    return first_match(
        [(h.between(0, 5), "night"), (h.between(6, 11), "morning"), (h.between(12, 17), "afternoon"), (h.between(18, 23), "evening")],
        "unknown",
    )


def weekday_order(name: Column | str) -> Column:
    """Position of a weekday name, Monday first, for ordering output."""
    return F.array_position(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), _c(name)) - 1


def one_hot(x: Column | str, levels: Sequence[str], prefix: str) -> list[Column]:
    """One 0/1 column per known level; an unseen level gives zeros everywhere."""
    return [holds(_c(x) == F.lit(lv)).alias(f"{prefix}__{py_slug(lv)}") for lv in levels]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token arrays, 0 when one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def plain_text(x: Column | str) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks to a blank, blanks squeezed."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))), "[^a-z0-9\\s]+", " ")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def tokens(plain: Column, stop_words: Sequence[str] = (), min_len: int = 3) -> Column:
    """Distinct tokens of plain text without stop words and short ones."""
    words = F.array_distinct(F.split(plain, " "))
    words = F.filter(words, lambda w: F.length(w) >= min_len)
    return F.array_except(words, F.array(*[F.lit(s) for s in stop_words]).cast("array<string>")) if stop_words else words


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def mape_term(y: Column, yhat: Column, eps: float = 1e-6) -> Column:
    return F.abs(y - yhat) / F.greatest(F.abs(y), F.lit(eps)) * 100
