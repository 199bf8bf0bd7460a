"""Descriptive statistics of groups: moments, quantiles, fences, shares, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.quantile import quantiles


def centred(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Value minus its group mean; the means are one small row per group joined back."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    return df.join(means, list(by), "left").withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def sample_skew(value: str) -> Column:
    """Bias-corrected skewness from Spark's population one; NULL under three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: str) -> Column:
    """Bias-corrected excess kurtosis; NULL under four values."""
    n = F.count(value).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def robust_profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, sd, IQR, MAD, skew, kurtosis, extremes, quantiles, CV and share outside the Tukey fences."""
    keys = list(by)
    base = df.select(*keys, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    q = quantiles(base, keys, "x", {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99})
    moments = base.groupBy(*keys).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), sample_skew("x").alias("skew"),
        sample_kurtosis("x").alias("kurtosis"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    joined = base.join(q.select(*keys, "q25", "median", "q75"), keys)
    deviation = joined.select(*keys, F.abs(F.col("x") - F.col("median")).alias("x"))
    mad = quantiles(deviation, keys, "x", {"mad": 0.5})
    iqr = F.col("q75") - F.col("q25")
    outside = (F.col("x") < F.col("q25") - 1.5 * iqr) | (F.col("x") > F.col("q75") + 1.5 * iqr)
    out = joined.groupBy(*keys).agg(F.avg(F.when(iqr == 0, 0.0).otherwise(outside.cast("double"))).alias("_o"))
    res = moments.join(q, keys).join(mad, keys).join(out, keys)
    return res.withColumns(
        {"iqr": F.col("q75") - F.col("q25"), "cv": F.try_divide(F.col("sd"), F.col("mean")), "outlier_pct": F.col("_o") * 100}
    ).drop("_o")


def tukey_fences(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Fences and share of rows outside; a zero IQR counts no outliers."""
    keys = list(by)
    q = quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    q = q.withColumns({"low_fence": F.col("q25") - 1.5 * iqr, "high_fence": F.col("q75") + 1.5 * iqr})
    x = F.col(value)
    outside = F.when(iqr == 0, 0.0).otherwise(((x < F.col("low_fence")) | (x > F.col("high_fence"))).cast("double"))
    return df.where(x.isNotNull()).join(q, keys).groupBy(*keys, "low_fence", "high_fence").agg((F.avg(outside) * 100).alias("outside_pct"))


def pct(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def variance_explained(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """R2 of the means over outer+inner cells: one aggregation to cell sums, one to outer groups."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*outer, *inner).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("ss")
    )
    total = F.sum("ss") - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")
    within = F.sum("ss") - F.sum(F.col("n") * F.col("m") * F.col("m"))
    return cells.groupBy(*outer).agg((1 - F.try_divide(within, total)).alias("r2"))


def profiles(df: DataFrame, value: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Mean profiles over several key sets in one grouping-sets pass; a column outside the set is NULL."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return out.agg(F.grouping_id().alias("gid"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def cohen_d(df: DataFrame, by: Sequence[str], arm: Column, value: str) -> DataFrame:
    """Standardised difference of means between arm true and arm false, pooled sample variance."""
    one, two = F.when(arm, F.col(value)), F.when(~arm, F.col(value))
    s = df.groupBy(*by).agg(
        F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"),
        F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"),
    )
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), (F.col("n1") + F.col("n0") - 2).cast("double"))
    return s.select(*by, "n1", "n0", "m1", "m0", (F.col("m1") - F.col("m0")).alias("delta"),
                    F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled)).alias("cohen_d"))
