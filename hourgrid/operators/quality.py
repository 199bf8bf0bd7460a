"""Quality masks, flags, repairs, completeness and check tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Flag columns that exclude a row.
EXCLUDING_FLAGS = ["system_blackout", "low_data_coverage", "partial_year", "flag_occ_inconsistent"]
FROZEN_FLAG = "flag_frozen_sensor"
DISCREPANCY_LIMIT = 0.01


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def quality_mask(df: DataFrame, rate: str = "rate", flags: Sequence[str] = tuple(EXCLUDING_FLAGS)) -> Column:
    """Rate within [0, 1] and no excluding flag; flags the table does not have are skipped."""
    tests = [F.col(f) == 0 for f in flags if f in df.columns] + [F.col(rate).between(0, 1)]
    return _true(reduce(lambda a, b: a & b, tests))


def strict_mask(df: DataFrame, rate: str = "rate") -> Column:
    quality = quality_mask(df, rate)
    return quality & _true(F.col(FROZEN_FLAG) == 0) if FROZEN_FLAG in df.columns else quality


def subset_shares(df: DataFrame, rate: str = "rate") -> DataFrame:
    """Rows and share of the full, quality and strict subsets, in one pass."""
    masks = {"full": F.lit(True), "quality": quality_mask(df, rate), "strict": strict_mask(df, rate)}
    arms = [
        F.struct(F.lit(n).alias("subset"), F.count_if(m).alias("n"), (F.avg(m.cast("double")) * 100).alias("share_pct"))
        for n, m in masks.items()
    ]
    return df.agg(F.array(*arms).alias("a")).select(F.inline("a"))


def rename_known(df: DataFrame, names: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Keeps and renames the columns of the map that exist; returns the missing ones too."""
    have = [c for c in names if c in df.columns]
    return df.select(*[F.col(c).alias(names[c]) for c in have]), [c for c in names if c not in df.columns]


def drop_admin(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def columns_by(columns: Sequence[str], prefixes: Sequence[str] = (), exclude: Iterable[str] = (), exclude_prefixes: Sequence[str] = ()) -> list[str]:
    """Columns with one of the prefixes (all when none given), minus excluded ones."""
    out = set(exclude)
    return [
        c for c in columns
        if (not prefixes or c.startswith(tuple(prefixes))) and c not in out
        and not (exclude_prefixes and c.startswith(tuple(exclude_prefixes)))
    ]


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter in turn and the change to the step before, from one scan."""
    arms, passed = [F.struct(F.lit(0).alias("step"), F.lit("all").alias("name"), F.count("*").alias("n"))], F.lit(True)
    for i, (name, cond) in enumerate(steps, 1):
        passed = passed & _true(cond)
        arms.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(passed).alias("n")))
    out = df.agg(F.array(*arms).alias("a"))
    change = F.transform("a", lambda s, i: s.withField("change", F.when(i > 0, s["n"] - F.get("a", i - 1)["n"])))
    return out.select(F.inline(change))


def reading_flags(df: DataFrame, rate: str, occupied: str, capacity: str, limit: float = DISCREPANCY_LIMIT) -> DataFrame:
    """Inconsistent rate, over capacity, negative count; a rate that cannot be recomputed is not inconsistent."""
    recomputed = F.try_divide(F.col(occupied).cast("double"), F.col(capacity).cast("double"))
    return df.withColumns(
        {
            "flag_occ_inconsistent": _true(F.abs(F.col(rate) - recomputed) > limit).cast("int"),
            "flag_overcapacity": _true(F.col(occupied) > F.col(capacity)).cast("int"),
            "flag_negative": _true(F.col(occupied) < 0).cast("int"),
        }
    )


def repair_rates(df: DataFrame, rate: str, occupied: str, capacity: str, flag: str = "flag_occ_inconsistent") -> DataFrame:
    """Fills missing rates and recomputes flagged ones from count and capacity."""
    recomputed = F.try_divide(F.col(occupied).cast("double"), F.col(capacity).cast("double"))
    fixed = F.when(F.col(flag) == 1, recomputed).otherwise(F.coalesce(F.col(rate), recomputed))
    return df.withColumn(rate, fixed)


def completeness(df: DataFrame, entity: str, period: Column, day: str) -> DataFrame:
    """Days, expected (24 a day), actual and missing rows per entity and period.

    Counted per day first, so the distinct count needs no expanded rows.
    """
    daily = df.groupBy(entity, period.alias("period"), day).agg(F.count("*").alias("n"))
    out = daily.groupBy(entity, "period").agg(F.count(day).alias("n_days"), F.sum("n").alias("actual"))
    return out.withColumn("expected", F.col("n_days") * 24).withColumns(
        {"missing": F.col("expected") - F.col("actual"), "completeness": F.round(F.try_divide(F.col("actual"), F.col("expected")), 4)}
    )


def hours_per_day(df: DataFrame, entity: str, day: str, hour: str, expected: DataFrame) -> DataFrame:
    """Distinct hours on the listed days against the expected number; ``expected`` has (day, expected_hours)."""
    days = df.select(entity, F.col(day).alias("day"), F.col(hour).alias("_h"))
    found = days.join(F.broadcast(expected), "day").groupBy(entity, "day", "expected_hours").agg(F.countDistinct("_h").alias("n_hours"))
    return found.withColumn("ok", F.col("n_hours") == F.col("expected_hours"))


def hours_of_day(day: Column, zone: str) -> Column:
    """Hours of a calendar day in a zone by its clock rules: 24, but 23 or 25 where the clock is changed."""
    start, after = (F.unix_seconds(F.to_utc_timestamp(d.cast("timestamp"), zone)) for d in (day, F.date_add(day, 1)))
    return ((after - start) / 3600).cast("int")


def known_capacities(entities: DataFrame, expected: DataFrame) -> DataFrame:
    """OK, MISMATCH or MISSING for every expected (entity, expected_capacity)."""
    joined = expected.join(entities.select("entity", F.col("capacity").alias("actual_capacity")), "entity", "left")
    status = F.when(F.col("actual_capacity").isNull(), "MISSING").when(F.col("actual_capacity") == F.col("expected_capacity"), "OK").otherwise("MISMATCH")
    return joined.withColumn("status", status)


def override_check(df: DataFrame, entities: DataFrame, override: str) -> DataFrame:
    top = df.groupBy("entity").agg(F.max(override).alias("max_override"))
    out = top.join(entities.select("entity", "capacity"), "entity", "left")
    return out.withColumn("exceeds", _true(F.col("max_override") > F.col("capacity")))


def check_rows(df: DataFrame, dataset: str, checks: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """One row per check (name, condition that marks a bad row, action): PASS when no row is affected."""
    arms = [
        F.struct(
            F.lit(name).alias("check"), F.lit(dataset).alias("dataset"),
            F.when(F.count_if(_true(bad)) == 0, "PASS").otherwise("WARN").alias("result"),
            F.count_if(_true(bad)).alias("n_affected"), F.lit(action).alias("action"),
        )
        for name, bad, action in checks
    ]
    return df.agg(F.array(*arms).alias("a")).select(F.inline("a"))


def merge_report(df: DataFrame, name: str, target: str, families: dict[str, Sequence[str]]) -> DataFrame:
    """Rows, missing targets and rows with any missing value per column family."""
    arms = [F.struct(F.lit("rows").alias("metric"), F.count("*").alias("n")),
            F.struct(F.lit(f"null_{target}").alias("metric"), F.count_if(F.col(target).isNull()).alias("n"))]
    for family, columns in families.items():
        have = [c for c in columns if c in df.columns]
        if have:
            any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in have])
            arms.append(F.struct(F.lit(f"any_null_{family}").alias("metric"), F.count_if(any_null).alias("n")))
    return df.agg(F.array(*arms).alias("a")).select(F.lit(name).alias("dataset"), F.inline("a"))


def null_shares(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of missing values per column (and group), all columns in one aggregation."""
    agg = df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return agg.unpivot(list(by), list(columns), "column", "null_share")


def null_status(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count, share and OK / HAS_NULL per column."""
    total = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = total.unpivot(["_n"], list(columns), "column", "n_null")
    return long.select("column", "n_null", (F.coalesce(F.try_divide(F.col("n_null"), F.col("_n")), F.lit(0.0)) * 100).alias("pct_null"),
                       F.when(F.col("n_null") == 0, "OK").otherwise("HAS_NULL").alias("status"))


def state_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True, false and missing counts of nullable flags, with the valid share among known values."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(c)).alias(f"{c}|t"), F.count_if(~F.col(c)).alias(f"{c}|f"), F.count_if(F.col(c).isNull()).alias(f"{c}|m")]
    row = df.agg(*aggs)
    arms = [F.struct(F.lit(c).alias("column"), F.col(f"{c}|t").alias("n_true"), F.col(f"{c}|f").alias("n_false"), F.col(f"{c}|m").alias("n_missing")) for c in columns]
    out = row.select(F.inline(F.array(*arms)))
    return out.withColumn("pct_valid", F.coalesce(F.try_divide(F.col("n_true") * 100, F.col("n_true") + F.col("n_false")), F.lit(0.0)))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Value counts including missing, with shares; the total runs over the few counted values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def value_concentration(df: DataFrame, columns: Sequence[str], threshold: float = 0.995) -> DataFrame:
    """Distinct values (missing counts as one) and top share per column; near-constant at the threshold."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("feature").agg(F.count("*").alias("n_distinct"), (F.max("n") / F.sum("n")).alias("top_share"))
    return out.withColumn("near_constant", F.col("top_share") >= threshold)


def coverage_flags(df: DataFrame, hour: str, year: Column, low_years: Sequence[int], blackout: tuple[str, str], partial_years: Sequence[int]) -> DataFrame:
    h = F.col(hour)
    start, end = (F.lit(x).cast("timestamp") for x in blackout)
    return df.withColumns(
        {
            "low_data_coverage": year.isin(list(low_years)).cast("int"),
            "system_blackout": ((h >= start) & (h < end)).cast("int"),
            "partial_year": year.isin(list(partial_years)).cast("int"),
        }
    )


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact duplicates over all columns and duplicates by key, both before any removal."""
    whole = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    by_key = whole.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_exact"))
    return by_key.agg(F.sum("_exact").alias("n_exact"), F.sum(F.col("_n") - 1).alias("n_by_key"))


def top_and_bottom(df: DataFrame, group: Sequence[str], metric: str, tie: str, n: int) -> DataFrame:
    w = W.partitionBy(*group)
    hi = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(metric), tie))).where(F.col("rank") <= n).withColumn("side", F.lit("top"))
    lo = df.withColumn("rank", F.row_number().over(w.orderBy(F.asc(metric), tie))).where(F.col("rank") <= n).withColumn("side", F.lit("bottom"))
    return hi.unionByName(lo)
