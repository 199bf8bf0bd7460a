"""Ordered operators that do not need one task per entity.

A series is cut into time chunks and rows are shuffled by (keys, chunk), so one entity holding most of the rows is
still spread over the cluster. Frames of bounded width read a copied stretch of history from the chunk before
(``with_history``); unbounded look-ups carry one summary row per chunk (``neighbours``, ``running_total``).
``order`` is a bigint column (epoch seconds for hours, days for dates), unique within the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400
CHUNK = 28 * DAY


def epoch(x: Column | str) -> Column:
    return F.unix_timestamp(x)


def _chunk(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width)


def _chunked(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """Rows laid out by (keys, chunk) once, so summaries, join and windows share the exchange.

    A table that still carries its chunk column from the step before is laid out already.
    """
    if "_chunk" in df.columns:
        return df
    out = df.withColumn("_chunk", _chunk(order, width))
    return out.repartition(*[F.col(k) for k in keys], F.col("_chunk"))


@dataclass(frozen=True)
class Look:
    """Nearest row before or after the current one that meets ``where``; ``value`` is what to bring back."""

    name: str
    value: Column
    forward: bool = False
    where: Column | None = None
    inclusive: bool = False


def _done(df: DataFrame, keep: bool, *columns: str) -> DataFrame:
    return df.drop(*columns) if keep else df.drop("_chunk", *columns)


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, looks: Sequence[Look], chunk: int = CHUNK, keep: bool = False
) -> DataFrame:
    """Adds per look a struct (at, value) of the nearest qualifying row, NULL if there is none.

    ``keep`` leaves the chunk column on for a following step with the same keys and order.
    """
    base = _chunked(df, keys, order, chunk)

    def entry(look: Look) -> Column:
        pair = F.struct(F.col(order).alias("at"), look.value.alias("value"))
        return pair if look.where is None else F.when(look.where, pair)

    summary = base.groupBy(*keys, "_chunk").agg(
        *[
            F.min_by(entry(k), F.when(entry(k).isNotNull(), F.col(order))).alias(f"_c_{k.name}")
            if k.forward
            else F.max_by(entry(k), F.when(entry(k).isNotNull(), F.col(order))).alias(f"_c_{k.name}")
            for k in looks
        ]
    )
    # Looking ahead runs over descending order: a frame that shrinks row by row would be evaluated anew for each row.
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        "_chunk",
        *[
            F.last(f"_c_{k.name}", True).over(after if k.forward else before).alias(f"_c_{k.name}")
            for k in looks
        ],
    )
    within = W.partitionBy(*keys, "_chunk")

    def local(look: Look) -> Column:
        ordered = within.orderBy(F.desc(order) if look.forward else F.col(order))
        return F.last(entry(look), True).over(ordered.rowsBetween(W.unboundedPreceding, 0 if look.inclusive else -1))

    out = base.join(carried, [*keys, "_chunk"], "left")
    found = {f"_l_{k.name}": local(k) for k in looks}
    out = out.withColumns(found)
    done = {k.name: F.coalesce(F.col(f"_l_{k.name}"), F.col(f"_c_{k.name}")) for k in looks}
    return _done(out.withColumns(done), keep, *[f"_l_{k.name}" for k in looks], *[f"_c_{k.name}" for k in looks])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, totals: dict[str, Column], chunk: int = CHUNK, keep: bool = False
) -> DataFrame:
    """Inclusive running sums over the whole series of each key."""
    base = _chunked(df.withColumns({f"_v_{n}": v for n, v in totals.items()}), keys, order, chunk)
    summary = base.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in totals]
    )
    within = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = base.join(carried, [*keys, "_chunk"], "left")
    out = out.withColumns({n: F.sum(f"_v_{n}").over(within) + F.col(f"_p_{n}") for n in totals})
    return _done(out, keep, *[f"_v_{n}" for n in totals], *[f"_p_{n}" for n in totals])


def previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: int = CHUNK, keep: bool = False
) -> DataFrame:
    """Row lag by one: adds prev_<column> and prev_<order>."""
    pack = F.struct(*[F.col(c) for c in columns])
    out = neighbours(df, keys, order, [Look("_prev", pack)], chunk, keep)
    cols = {f"prev_{c}": F.col(f"_prev.value.{c}") for c in columns}
    cols[f"prev_{order}"] = F.col("_prev.at")
    return out.withColumns(cols).drop("_prev")


def with_history(df: DataFrame, order: str, back: int, ahead: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Copies rows into the neighbouring chunks whose frames reach them; keep rows where ``_home`` afterwards."""
    if back > chunk or ahead > chunk:
        raise ValueError("frame wider than a chunk")
    t = F.col(order)
    spots = F.array_distinct(
        F.array(F.floor(t / chunk), F.floor((t + back) / chunk), F.floor((t - ahead) / chunk))
    )
    out = df.withColumn("_chunk", F.explode(spots))
    return out.withColumn("_home", F.col("_chunk") == F.floor(t / chunk))


def frame_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    frames: dict[str, tuple[Column, int, int]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Aggregates over value ranges of ``order``: name -> (aggregate, from, to), offsets relative to the row."""
    back = max([0, *[-lo for _, lo, _ in frames.values()]])
    ahead = max([0, *[hi for _, _, hi in frames.values()]])
    spread = with_history(df, order, back, ahead, chunk)
    w = W.partitionBy(*keys, "_chunk").orderBy(order)
    cols = {n: agg.over(w.rangeBetween(lo, hi)) for n, (agg, lo, hi) in frames.items()}
    return spread.withColumns(cols).where("_home").drop("_chunk", "_home")


def exact_lags(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int], prefix: str = "lag_") -> DataFrame:
    """Value exactly k hours earlier, NULL if that hour is not there; one shuffle for all lags."""
    frames = {f"{prefix}{k}h": (F.max(value), -k * HOUR, -k * HOUR) for k in lags}
    return frame_aggregates(df, keys, order, frames)


def rolling_strict(df: DataFrame, keys: Sequence[str], order: str, value: str, hours: int = 24) -> DataFrame:
    """Mean and population sd of the preceding hours, only if every one of them is present and not NULL.

    With one row per hour, ``hours`` values in the range [-hours, -1] is the same as a contiguous stretch.
    """
    lo, hi = -hours * HOUR, -HOUR
    out = frame_aggregates(
        df,
        keys,
        order,
        {"_n": (F.count(value), lo, hi), "_m": (F.avg(value), lo, hi), "_s": (F.stddev_pop(value), lo, hi)},
    )
    full = F.col("_n") == hours
    return out.withColumns({"roll_mean": F.when(full, F.col("_m")), "roll_sd": F.when(full, F.col("_s"))}).drop("_n", "_m", "_s")


def islands(df: DataFrame, keys: Sequence[str], order: str, step: int = HOUR, same: str | None = None) -> DataFrame:
    """Island number per key: a new one starts where the step differs, or, with ``same``, where that value changes."""
    cols = [same] if same else [order]
    out = previous(df, keys, order, cols, keep=True)
    joined = F.col(order) - F.col(f"prev_{order}") == step
    if same:
        joined = joined & F.col(same).eqNullSafe(F.col(f"prev_{same}")) & F.col(same).isNotNull()
    broke = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    drop = [f"prev_{order}"] + ([f"prev_{same}"] if same else [])
    return running_total(out, keys, order, {"island": broke}).drop(*drop)


def flag_runs(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Runs of equal flag values by row order, whatever the time between rows."""
    out = previous(df, keys, order, [flag], keep=True)
    changed = F.when(F.col(flag).eqNullSafe(F.col(f"prev_{flag}")), 0).otherwise(1)
    return running_total(out, keys, order, {"run": changed}).drop(f"prev_{flag}", f"prev_{order}")


def row_lags(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, chunk: int = CHUNK) -> DataFrame:
    """lag_1 .. lag_n by row order. Each chunk hands its newest n values on; n chunks back always hold n rows."""
    base = _chunked(df, keys, order, chunk)
    newest = top_per_group(base.select(*keys, "_chunk", order, value), [*keys, "_chunk"], [F.desc(order)], n, "_d")
    entry = F.struct(F.col(order).alias("at"), F.col(value).alias("v"))
    summary = newest.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(entry), False).alias("_new"))
    across = W.partitionBy(*keys).orderBy("_chunk")
    blank = F.slice("_new", 1, 0)
    earlier = F.concat(*[F.coalesce(F.lag("_new", k).over(across), blank) for k in range(1, n + 1)])
    carried = summary.select(*keys, "_chunk", F.slice(earlier, 1, n).alias("_old"))
    within = W.partitionBy(*keys, "_chunk").orderBy(order)
    out = base.join(carried, [*keys, "_chunk"], "left").withColumn("_r", F.row_number().over(within))
    lags = {
        f"lag_{k}": F.when(F.col("_r") > k, F.lag(value, k).over(within)).otherwise(F.get("_old", F.lit(k) - F.col("_r"))["v"])
        for k in range(1, n + 1)
    }
    return out.withColumns(lags).drop("_chunk", "_old", "_r")


def frozen(df: DataFrame, keys: Sequence[str], order: str, value: str, repeats: int = 4, chunk: int = CHUNK) -> DataFrame:
    """1 from the ``repeats``-th repetition of the previous value on, gaps in time not considered."""
    names = [f"lag_{k}" for k in range(1, repeats + 1)]
    out = row_lags(df, keys, order, value, repeats, chunk)
    same = F.lit(True)
    for name in names:
        same = same & F.coalesce(F.col(value) == F.col(name), F.lit(False))
    return out.withColumn("is_frozen", same.cast("int")).drop(*names)


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[Column], earliest: bool = False) -> DataFrame:
    """One row per key, chosen by an aggregate with map-side combine: a hot key never meets in one task unreduced."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])
    pick = F.min_by(row, rank) if earliest else F.max_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def top_per_group(df: DataFrame, group: Sequence[str], by: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group; Spark limits each group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
