"""Exact quantiles and average ranks of large groups.

``F.percentile`` keeps a whole group's values in one buffer. Here values are first counted (map-side combine) under a
slice of the number line, slice totals tell which slices hold the wanted order statistics, and only those are sorted,
each in its own task. All shuffles are on (group, slice) or finer. ``by`` columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Slices per power of two; a value's slice depends on the value alone and never decreases with it.
SLICES = 64
_OFFSET = 1200 * SLICES
_OCTAVE = "floor(log2(abs(v)))"
_PLACE = f"({_OCTAVE} * {SLICES} + floor((abs(v) / power(2, {_OCTAVE}) - 1) * {SLICES}) + {_OFFSET})"
_SLICE = f"CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN {_PLACE} ELSE -{_PLACE} END"


def value_counts(df: DataFrame, by: Sequence[str], value: Column | str, marks: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """by, slice, v, n and, per mark, the number of rows that meet it. With a weight column, a row counts as so many."""
    v = F.col(value) if isinstance(value, str) else value
    marks = marks or {}
    rows = df.select(*by, v.cast("double").alias("v"), *[c.alias(m) for m, c in marks.items()], *([F.col(weight).alias("_weight")] if weight else [])).where("v IS NOT NULL")
    n = F.sum("_weight") if weight else F.count("*")
    return rows.groupBy(*by, F.expr(_SLICE).alias("slice"), "v").agg(n.alias("n"), *[F.count_if(m).alias(m) for m in marks])


def _sliced(df: DataFrame, by: list[str], value: Column | str, marks: dict[str, Column] | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    counts = value_counts(df, by, value, marks, weight)
    group = W.partitionBy(*by)
    slices = counts.groupBy(*by, "slice").agg(F.sum("n").alias("_m"))
    before = group.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumns({"below": F.coalesce(F.sum("_m").over(before), F.lit(0)), "total": F.sum("_m").over(group)})
    return counts, slices


def ranked_values(df: DataFrame, by: Sequence[str], value: Column | str, marks: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """by, v, n, marks, total, cum (rows up to and including v), midrank (average rank of the tied rows)."""
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(1))
    counts, slices = _sliced(src, keys, value, marks, weight)
    upto = W.partitionBy(*keys, "slice").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    y = counts.join(slices.drop("_m"), [*keys, "slice"]).withColumn("cum", F.sum("n").over(upto) + F.col("below"))
    return y.select(*by, "v", "n", *(marks or {}), "total", "cum", F.expr("cum - n + (n + 1) / 2 AS midrank"))


def quantiles(df: DataFrame, by: Sequence[str], value: Column | str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group: by + one column per name."""
    keys = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(1))
    counts, slices = _sliced(src, keys, value)
    rank = {n: f"((total - 1) * CAST({float(p)!r} AS DOUBLE))" for n, p in probs.items()}
    hits = [f"(below <= {f}({r}) AND {f}({r}) < below + _m)" for r in rank.values() for f in ("floor", "ceil")]
    wanted = slices.where(" OR ".join(hits)).drop("_m")
    upto = W.partitionBy(*keys, "slice").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    y = counts.join(wanted, [*keys, "slice"]).withColumn("cum", F.sum("n").over(upto) + F.col("below"))

    def at(index: str) -> str:
        return f"max(CASE WHEN cum - n <= {index} AND {index} < cum THEN v END)"

    aggs = [F.expr(f"{at(f'floor({r})')} AS `_a_{n}`") for n, r in rank.items()]
    aggs += [F.expr(f"{at(f'ceil({r})')} AS `_b_{n}`") for n, r in rank.items()]
    out = y.groupBy(*keys, "total").agg(*aggs)
    return out.select(*by, *[F.expr(f"`_a_{n}` + (`_b_{n}` - `_a_{n}`) * ({r} - floor({r})) AS `{n}`") for n, r in rank.items()])


def column_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns in one pass: by, column, one column per name."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "column", "_value"
    )
    return quantiles(long, [*by, "column"], "_value", probs)


def attach_midranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of every row within its group, joined on (group, value)."""
    ranks = ranked_values(df, by, value).select(*by, F.col("v").alias("_v"), F.col("midrank").alias(out))
    base = df.withColumn("_v", F.col(value).cast("double"))
    return base.join(ranks, [*by, "_v"], "left").drop("_v")
