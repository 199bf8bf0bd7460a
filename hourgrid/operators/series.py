"""Regular spines, limited interpolation, and per-series numeric summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.operators.windows import HOUR, Look, neighbours, running_total


def hour_spine(df: DataFrame, keys: Sequence[str], hour: str) -> DataFrame:
    """Every hour between the first and last of each key."""
    ends = df.groupBy(*keys).agg(F.min(hour).alias("_a"), F.max(hour).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias(hour))


def reindexed(df: DataFrame, keys: Sequence[str], hour: str, values: Sequence[str]) -> DataFrame:
    """Values on the full hourly grid, NULL where no row exists."""
    grid = hour_spine(df, keys, hour)
    return grid.join(df.select(*keys, hour, *values), [*keys, hour], "left").withColumn("t", F.unix_timestamp(hour))


def interpolate(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, int], both: bool = False, edges: bool = False
) -> DataFrame:
    """Linear in time, at most ``limit`` rows from each known value; limits count rows, as positions in the series.

    Forward fills the first rows of a gap and holds the last value at the end; ``both`` also fills the last rows of a
    gap and the start. ``edges`` afterwards carries known or filled values into what is left, forward then back.
    """
    df = running_total(df, keys, order, {"_pos": F.lit(1)}, keep=True)
    looks = []
    for c in columns:
        known = F.col(c).isNotNull()
        pack = F.struct(F.col(c).cast("double").alias("v"), F.col("_pos").alias("p"))
        looks += [Look(f"_p_{c}", pack, where=known, inclusive=True), Look(f"_n_{c}", pack, forward=True, where=known, inclusive=True)]
    df = neighbours(df, keys, order, looks, keep=edges)
    t, pos = F.col(order), F.col("_pos")
    out: dict[str, Column] = {}
    for c, limit in columns.items():
        before, after = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        pv, nv = before["value"]["v"], after["value"]["v"]
        line = pv + (nv - pv) * (t - before["at"]) / (after["at"] - before["at"])
        guess = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(line)
        near = F.coalesce(pos - before["value"]["p"] <= limit, F.lit(False))
        if both:
            near = near | F.coalesce(after["value"]["p"] - pos <= limit, F.lit(False))
        out[c] = F.when(near, guess)
    df = df.withColumns(out).drop("_pos", *[f"_{x}_{c}" for c in columns for x in "pn"])
    if edges:
        looks = []
        for c in columns:
            known = F.col(c).isNotNull()
            looks += [Look(f"_p_{c}", F.col(c), where=known, inclusive=True), Look(f"_n_{c}", F.col(c), forward=True, where=known, inclusive=True)]
        df = neighbours(df, keys, order, looks)
        df = df.withColumns({c: F.coalesce(F.col(f"_p_{c}")["value"], F.col(f"_n_{c}")["value"]) for c in columns})
        df = df.drop(*[f"_{x}_{c}" for c in columns for x in "pn"])
    return df


def filled_hours(df: DataFrame, keys: Sequence[str], hour: str, column: str, limit: int, both: bool = False, edges: bool = False) -> DataFrame:
    """``interpolate`` of one column over ``reindexed`` rows, without ordering the grid: (keys, hour, t, column).

    Rows are at whole hours, one for each hour of a key at most, so a key has no more rows than its span has hours. Only
    these rows are moved and sorted. A row that is known, or at an end, holds what all hours up to the next such row need,
    and writes these hours out itself.
    """
    rows = df.select(*keys, F.col(hour).alias("_hour"), F.col(column).cast("double").alias("_v"))
    ordered = W.partitionBy(*keys).orderBy("_hour")
    rows = rows.withColumns({"_first": F.lag("_hour").over(ordered).isNull(), "_last": F.lead("_hour").over(ordered).isNull()})
    rows = rows.where("_v IS NOT NULL OR _first OR _last").withColumn("_at", F.unix_timestamp("_hour"))
    known = F.when(F.col("_v").isNotNull(), F.struct("_v", "_at"))
    rows = rows.withColumns({
        "_before": F.last(known, True).over(ordered.rowsBetween(W.unboundedPreceding, 0)),
        "_after": F.lead(known).over(ordered), "_until": F.lead("_hour").over(ordered) - F.expr("interval 1 hour")})
    out = rows.withColumn(hour, F.explode(F.sequence("_hour", F.coalesce("_until", "_hour"), F.expr("interval 1 hour")))).withColumn("t", F.unix_timestamp(hour))
    t, reach = F.col("t"), limit * HOUR
    pv, pt, nv, nt = (F.col(f"{side}.{x}") for side in ("_before", "_after") for x in ("_v", "_at"))

    def guess(at: Column) -> Column:
        return F.when(pv.isNull() | (at == pt), F.coalesce(pv, nv)).when(nv.isNull(), pv).otherwise(pv + (nv - pv) * (at - pt) / (nt - pt))

    near = F.coalesce(t - pt <= reach, F.lit(False))
    if both:
        near = near | F.coalesce(nt - t <= reach, F.lit(False))
    value = F.when(near, guess(t))
    if edges:
        value = F.coalesce(value, guess(pt + reach), nv)
    return out.select(*keys, hour, "t", value.alias(column))


def integrity(df: DataFrame, keys: Sequence[str], hour: str) -> DataFrame:
    """Expected, actual, missing and surplus hours per series, from one outer join with the spine."""
    grid = hour_spine(df, keys, hour).withColumn("_g", F.lit(1))
    seen = df.groupBy(*keys, hour).agg(F.count("*").alias("_n"))
    both = grid.join(seen, [*keys, hour], "full_outer")
    return both.groupBy(*keys).agg(
        F.count("_g").alias("expected"), F.coalesce(F.sum("_n"), F.lit(0)).alias("actual"),
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_g").isNull()).alias("surplus"),
    )


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Biased autocorrelation of a regular, filled series: full mean and variance in the denominator."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    x = df.join(stats, list(keys)).select(*keys, order, (F.col(value) - F.col("_m")).alias("_x"))
    denom = x.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_x")).alias("_d"))
    later = x.select(*keys, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), F.col(order).alias("_o"), F.col("_x").alias("_y"))
    later = later.withColumn(order, F.col("_o") + F.col("lag") * HOUR).drop("_o")
    num = later.join(x, [*keys, order]).groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s"))
    return num.join(denom, list(keys)).select(*keys, "lag", F.try_divide("_s", "_d").alias("acf"))


def spectrum(df: DataFrame, keys: Sequence[str], order: str, value: str, periods: Sequence[int]) -> DataFrame:
    """Periodogram ordinates of a regular series at chosen periods in rows, as grouped sums of sines and cosines."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"), F.min(order).alias("_t0"))
    x = df.join(stats, list(keys)).withColumn("period", F.explode(F.array(*[F.lit(float(p)) for p in periods])))
    angle = 2 * 3.141592653589793 * ((F.col(order) - F.col("_t0")) / HOUR) / F.col("period")
    dev = F.col(value) - F.col("_m")
    out = x.groupBy(*keys, "period", "_n").agg(F.sum(dev * F.cos(angle)).alias("_c"), F.sum(dev * F.sin(angle)).alias("_s"))
    return out.select(*keys, "period", ((F.pow("_c", 2) + F.pow("_s", 2)) / F.col("_n")).alias("power"))
