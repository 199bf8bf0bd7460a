"""Assembly of the panel from readings and dimensions, and look-ups across tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.session import staged
from hourgrid.sources.readers import unique_rows

# Defaults for days without events.
EVENT_DEFAULTS = {"event_scale_max": 0, "n_concurrent_events": 0, "data_confidence": "verified", "event_names_combined": ""}


def enrich(df: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a dimension whose key uniqueness is checked inside the plan; the row count cannot grow."""
    return df.join(unique_rows(dimension, keys), list(keys), "left")


def assemble(base: DataFrame, weather: DataFrame, calendar: DataFrame, entities: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Readings with hourly weather, daily calendar, entity attributes and, when given, daily events."""
    out = enrich(enrich(enrich(base, weather, ["hour"]), calendar, ["day"]), entities, ["entity"])
    return out if events is None else add_events(out, events, "day")


def add_events(df: DataFrame, events: DataFrame, day: str) -> DataFrame:
    """Daily events joined on, every is_*_day flag and the known event columns filled for days without events."""
    return fill_event_columns(enrich(df, events, [day]))


def fill_event_columns(df: DataFrame) -> DataFrame:
    flags = [c for c in df.columns if c.startswith("is_") and c.endswith("_day")]
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("tinyint") for c in flags})
    return out.fillna({k: v for k, v in EVENT_DEFAULTS.items() if k in df.columns})


def helper_columns(df: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Joins the helper columns only when some are missing."""
    if all(c in df.columns for c in columns):
        return df
    one = lookup.select(*keys, *columns).groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns])
    return df.drop(*[c for c in columns if c in df.columns]).join(one, list(keys), "left")


def fold_rows(df: DataFrame, folds: DataFrame, hour: str = "hour") -> DataFrame:
    """(fold, role) per row: train before the cut, valid inside the closed window; a row can be in many folds.

    The plan has one row per fold, so the range join compares each row with a handful of windows.
    """
    h = F.col(hour)
    role = F.when(h < F.col("train_end_before"), "train").when(h.between(F.col("valid_start"), F.col("valid_end")), "valid")
    return df.crossJoin(F.broadcast(folds)).withColumn("role", role).where("role IS NOT NULL").drop(
        "train_end_before", "valid_start", "valid_end"
    )


#: Cells of one level that make one of the next: ranges are covered by few cells, points lie in one of each level.
RADIX = 32
LEVELS = 12


def _place(name: str, kind: T.DataType) -> Column:
    """A point as a whole number: days of a date, microseconds of a timestamp."""
    c = F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("long")


def _floor_div(x: Column, by: int = RADIX) -> Column:
    """Whole-number division that rounds down, also below 0."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def _span(a: Column, b: Column) -> Column:
    """Numbers from a to b, b left out."""
    return F.when(a < b, F.sequence(a, b - 1))


def _cell(level: int):
    return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))


def covering_cells(ranges: DataFrame, start: Column, stop: Column) -> DataFrame:
    """The ranges with a row for each of the cells (level, cell) that cover [start, stop): whole cells, apart from each other.

    From each level come the cells up to the first and from the last border of the level above, at most 2 (RADIX - 1); a
    range without points has none.
    """
    out = ranges.withColumns({"_lo": start, "_hi": stop}).where("_lo < _hi")
    cells = []
    for level in range(LEVELS):
        lo, hi = F.col("_lo" if level == 0 else f"_lo{level}"), F.col("_hi" if level == 0 else f"_hi{level}")
        out = out.withColumns({f"_lo{level + 1}": _floor_div(lo + RADIX - 1), f"_hi{level + 1}": _floor_div(hi)})
        up, down = F.col(f"_lo{level + 1}"), F.col(f"_hi{level + 1}")
        split = (up < down) if level + 1 < LEVELS else F.lit(False)
        head = F.when(lo < hi, _span(lo, F.when(split, up * RADIX).otherwise(hi)))
        tail = F.when(split, _span(down * RADIX, hi))
        whole = F.concat(*[F.coalesce(x, F.array().cast("array<bigint>")) for x in (head, tail)])
        cells.append(F.transform(whole, _cell(level)))
        out = out.withColumns({f"_lo{level + 1}": F.when(split, up), f"_hi{level + 1}": F.when(split, down)})
    return out.select(*ranges.columns, F.inline(F.concat(*cells)))


def interval_join(df: DataFrame, ranges: DataFrame, at: str, start: str, end: str, labels: Sequence[str]) -> DataFrame:
    """Left join of rows with all half-open ranges [start, end) that hold their point: a row for each range, or one with nulls.

    An equality join on covering cells, so neither side is sent everywhere nor compared one by one; a range over all
    points is one hot cell, which adaptive execution splits. Points are met once, however many rows have them. Ranges with
    a null end, or that end before they start, hold no point; a null point is in no range.
    """
    kinds = {f.name: f.dataType for f in (*df.schema, *ranges.schema)}
    named = ranges.select(start, end, *labels)
    cells = covering_cells(named, _place(start, kinds[start]), _place(end, kinds[end])).select("level", "cell", *labels)
    cells = staged(cells)
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # LEVELS numbers at most
    points = df.select(F.col(at).alias("_at")).where(F.col("_at").isNotNull()).distinct()
    place = F.col("_place")
    of_level = F.array(*[F.struct(F.lit(n).alias("level"), _floor_div(place, RADIX**n).alias("cell")) for n in levels]) if levels else None
    if of_level is None:
        return df.join(cells.select(*labels), F.lit(False), "left")
    keyed = points.withColumn("_place", _place("_at", kinds[at])).select("_at", F.inline(of_level))
    met = keyed.join(cells, ["level", "cell"]).select("_at", *labels)
    return df.join(met, df[at] == met["_at"], "left").drop("_at")


def interval_totals(df: DataFrame, ranges: DataFrame, at: str, start: str, end: str, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with totals over all half-open ranges [start, end) that hold their point: name -> (count, sum, min or max; column).

    As ``interval_join`` with an aggregation over the result, but equal ranges are reduced first, then all that have a
    covering cell, in tasks before anything is moved: no row is made for a range and a point. A point in no range has
    count 0, else nulls.
    """
    kinds = {f.name: f.dataType for f in (*df.schema, *ranges.schema)}
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    own = [first[kind](c).alias(f"_t_{name}") for name, (kind, c) in totals.items()]

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[(F.sum if kind == "count" else first[kind])(f"_t_{name}").alias(f"_t_{name}") for name, (kind, _) in totals.items()])

    alike = ranges.groupBy(F.col(start).alias("_start"), F.col(end).alias("_end")).agg(*own)
    cells = merged(covering_cells(alike, _place("_start", kinds[start]), _place("_end", kinds[end])), "level", "cell")
    points = df.select(F.col(at).alias("_at")).where(F.col("_at").isNotNull()).distinct().withColumn("_place", _place("_at", kinds[at]))
    of_level = F.array(*[F.struct(F.lit(n).alias("level"), _floor_div(F.col("_place"), RADIX**n).alias("cell")) for n in range(LEVELS)])
    met = merged(points.select("_at", F.inline(of_level)).join(cells, ["level", "cell"]), "_at")
    found = {name: F.coalesce(F.col(f"_t_{name}"), F.lit(0)) if kind == "count" else F.col(f"_t_{name}") for name, (kind, _) in totals.items()}
    return df.join(met, df[at] == met["_at"], "left").select(*[df[c] for c in df.columns], *[c.alias(n) for n, c in found.items()])


def label_by_range(df: DataFrame, ranges: DataFrame, at: str, start: str, end: str, labels: Sequence[str]) -> DataFrame:
    """Half-open interval look-up."""
    return interval_join(df, ranges, at, start, end, labels)


def nearest_marks(df: DataFrame, order: str, marked: Column, keys: Sequence[str] = (), unit: int = 3600) -> DataFrame:
    """Distance to the next and since the previous marked row of a timeline, 0 inside; NULL when there is none."""
    from hourgrid.operators.windows import Look, neighbours

    at = F.col(order)
    line = list(keys) or ["_line"]
    base = df if keys else df.withColumn("_line", F.lit(1))
    out = neighbours(
        base, line, order,
        [Look("_prev", at, where=marked, inclusive=True), Look("_next", at, forward=True, where=marked, inclusive=True)],
    )
    return out.withColumns({"to_mark": (F.col("_next.at") - at) / unit, "since_mark": (at - F.col("_prev.at")) / unit}).drop("_line", "_prev", "_next")


def both_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    left = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    right = b.select(*keys, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return left.join(right, list(keys))
