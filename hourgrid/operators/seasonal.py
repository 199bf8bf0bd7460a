"""Seasonal structure of series: year comparisons, stationarity, periodogram, smooth response."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.describe import quantiles
from hourgrid.operators.series import HOUR

# Published response-surface coefficients of the unit-root test with a constant, and its valid range.
_TAU_MIN, _TAU_STAR, _TAU_MAX = -18.83, -1.61, 2.74
_SMALL = (2.1659, 1.4412, 0.038269)
_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# Critical values of the level-stationarity test.
_KPSS_CRIT, _KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
# Period bands in hours.
BANDS = {"24h(+/-0.5)": (23.5, 24.5), "168h(+/-8)": (160.0, 176.0), "12h(+/-0.5)": (11.5, 12.5)}


def contrast_over_hours(df: DataFrame, by: Sequence[str], hour: str, arm: Column, value: str) -> DataFrame:
    """Profile difference of two arms per hour: mean, max and min over the hours."""
    cells = df.groupBy(*by, hour).agg((F.avg(F.when(arm, F.col(value))) - F.avg(F.when(~arm, F.col(value)))).alias("d"))
    return cells.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.max("d").alias("max_diff"), F.min("d").alias("min_diff"))


def unit_root_p(stat: float) -> float:
    if stat > _TAU_MAX:
        return 1.0
    if stat < _TAU_MIN:
        return 0.0
    coef = _SMALL if stat <= _TAU_STAR else _LARGE
    return 0.5 * math.erfc(-sum(c * stat**i for i, c in enumerate(coef)) / math.sqrt(2))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    ssr = float(((y - x @ beta) ** 2).sum())
    return beta, ssr, np.linalg.pinv(x.T @ x)


def adf(y: np.ndarray) -> tuple[float, float]:
    """Augmented Dickey-Fuller with constant; lag count by AIC on a common sample."""
    n = len(y)
    top = max(min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2), 0)
    dy = np.diff(y)

    def design(k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        target = dy[skip:]
        cols = [y[skip:-1]] + [dy[skip - i : len(dy) - i] for i in range(1, k + 1)] + [np.ones(len(target))]
        return target, np.column_stack(cols)

    best, best_k = math.inf, 0
    for k in range(top + 1):
        target, x = design(k, top)
        _, ssr, _ = _ols(target, x)
        m = len(target)
        aic = m * (math.log(2 * math.pi * max(ssr, 1e-300) / m) + 1) + 2 * x.shape[1]
        if aic < best:
            best, best_k = aic, k
    target, x = design(best_k, best_k)
    beta, ssr, inv = _ols(target, x)
    se = math.sqrt(max(ssr / (len(target) - x.shape[1]) * inv[0, 0], 1e-300))
    stat = float(beta[0] / se)
    return stat, unit_root_p(stat)


def kpss(y: np.ndarray) -> tuple[float, float]:
    """Level stationarity with the data-dependent bandwidth."""
    n = len(y)
    e = y - y.mean()
    cov = int(n ** (2.0 / 9.0))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, cov + 1):
        c = float(e[i:] @ e[:-i]) / (n / 2.0)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    var = float(e @ e) + 2 * sum((1 - i / (lags + 1.0)) * float(e[i:] @ e[:-i]) for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / (var / n)) if var > 0 else float("nan")
    return stat, float(np.interp(stat, _KPSS_CRIT, _KPSS_P))


def stationarity(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Both tests on the series and its daily, weekly and combined differences; one task per series.

    A series has one row per hour of its span, so a group is bounded by the length of the archive.
    """
    schema = f"`{key}` string, transform string, n_used bigint, adf_stat double, adf_p double, kpss_stat double, kpss_p double"

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(order)[value]
        rows = []
        for name, x in (("raw", s), ("diff_24h", s.diff(24)), ("diff_168h", s.diff(168)), ("diff_24h_then_168h", s.diff(24).diff(168))):
            y = x.dropna().to_numpy(dtype=float)
            if len(y) < 30 or np.ptp(y) == 0:
                rows.append((pdf[key].iloc[0], name, len(y), None, None, None, None))
                continue
            rows.append((pdf[key].iloc[0], name, len(y), *adf(y), *kpss(y)))
        return pd.DataFrame(rows, columns=[key, "transform", "n_used", "adf_stat", "adf_p", "kpss_stat", "kpss_p"])

    out = df.select(F.col(key).cast("string").alias(key), order, value).groupBy(key).applyInPandas(test, schema)
    unit, level = F.col("adf_p") < 0.05, F.col("kpss_p") < 0.05
    label = F.when(unit & ~level, "consistent_stationary").when(~unit & level, "consistent_non_stationary").otherwise("mixed_evidence")
    return out.withColumn("joint_interpretation", label)


def periodogram(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One-sided power spectrum per regular series: (key, period_hours, power) for positive frequencies."""
    schema = f"`{key}` string, period_hours double, power double"

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(dtype=float)
        n = len(x)
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / n**2
        power[1 : (n + 1) // 2] *= 2
        freq = np.fft.rfftfreq(n)
        return pd.DataFrame({key: pdf[key].iloc[0], "period_hours": 1 / freq[1:], "power": power[1:]})

    return df.select(F.col(key).cast("string").alias(key), order, value).groupBy(key).applyInPandas(transform, schema)


def spectrum_peaks(power: DataFrame, key: str, top: int = 8) -> DataFrame:
    from hourgrid.operators.windows import top_per_group

    return top_per_group(power.where(F.col("period_hours").between(2, 1000)), [key], [F.desc("power"), F.col("period_hours")], top)


def band_shares(power: DataFrame, key: str) -> DataFrame:
    """Share of the power with periods of 2 to 1000 hours that lies in each band."""
    p = power.where(F.col("period_hours").between(2, 1000))
    arms = [
        F.struct(F.lit(name).alias("band"), (F.try_divide(F.sum(F.when(F.col("period_hours").between(lo, hi), F.col("power"))), F.sum("power")) * 100).alias("power_share_pct"))
        for name, (lo, hi) in BANDS.items()
    ]
    return p.groupBy(key).agg(F.array(*arms).alias("a")).select(key, F.inline("a")).fillna({"power_share_pct": 0.0})


def smooth_response(df: DataFrame, x: str, y: str, points: int = 100, share: float = 0.2) -> DataFrame:
    """Local linear fit with tricube weights on an even grid of x.

    The half-width at a grid point is the ``share`` quantile of the distances to it, found on value counts. Rows are
    reduced to distinct x before they meet the grid.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(
        F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("y"))
    ends = d.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "a", "b")
    grid = grid.select("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)).alias("x0"))
    met = d.crossJoin(F.broadcast(grid)).withColumn("dist", F.abs(F.col("x") - F.col("x0")))
    width = weighted_quantile(met, ["i", "x0"], "dist", "n", share)
    u = F.col("dist") / F.col("h")
    w = F.col("n") * F.pow(1 - F.pow(F.least(u, F.lit(1.0)), 3), 3)
    z = F.col("x") - F.col("x0")
    s = met.join(width, ["i", "x0"]).where("h > 0").groupBy("i", "x0").agg(
        F.sum(w).alias("s0"), F.sum(w * z).alias("s1"), F.sum(w * z * z).alias("s2"), F.sum(w * F.col("y")).alias("t0"), F.sum(w * z * F.col("y")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(det > 1e-12, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.try_divide("t0", "s0"))
    return s.select(F.col("x0").alias("x"), fit.alias("y_smooth"))


def weighted_quantile(df: DataFrame, by: Sequence[str], value: str, weight: str, p: float) -> DataFrame:
    """Smallest value whose cumulative weight reaches p of the total, per group; two-level sums over value slices."""
    from pyspark.sql import Window as W

    c = df.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("n")).withColumn("b", F.expr("CASE WHEN v = 0 THEN -100000 ELSE floor(log2(v) * 8) END"))
    across = W.partitionBy(*by)
    slices = c.groupBy(*by, "b").agg(F.sum("n").alias("m"))
    slices = slices.withColumns({"below": F.coalesce(F.sum("m").over(across.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("m").over(across)})
    hit = slices.where((F.col("below") < F.col("total") * p) & (F.col("below") + F.col("m") >= F.col("total") * p))
    inside = c.join(hit, [*by, "b"]).withColumn("cum", F.col("below") + F.sum("n").over(W.partitionBy(*by, "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    return inside.where(F.col("cum") >= F.col("total") * p).groupBy(*by).agg(F.min("v").alias("h"))


def bin_edges(df: DataFrame, by: Sequence[str], value: str, bins: int = 4) -> DataFrame:
    """Quantile edges per group as an array, duplicates dropped."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    q = quantiles(df, by, value, names)
    return q.select(*by, F.array_distinct(F.array(*names)).alias("edges"))


def bin_response(df: DataFrame, by: Sequence[str], x: str, y: str, bins: int = 4) -> DataFrame:
    """Mean of y per quantile bin of x (right-closed, lowest edge included); fewer bins where edges coincide."""
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = bin_edges(src, by, x, bins)
    joined = src.join(edges, list(by)) if by else src.crossJoin(F.broadcast(edges))
    number = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(x))), F.lit(1))
    return joined.withColumn("bin", number).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def top_bottom_delta(response: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the highest bin minus that of the lowest, where there are two or more."""
    out = response.groupBy(*by).agg(F.min_by("mean", "bin").alias("low_mean"), F.max_by("mean", "bin").alias("high_mean"), F.count("*").alias("n_bins"))
    return out.where("n_bins >= 2").withColumn("delta", F.col("high_mean") - F.col("low_mean"))


def threshold_effect(df: DataFrame, by: Sequence[str], x: str, y: str, p: float = 0.9) -> DataFrame:
    """Effect of x at or over its quantile."""
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    q = quantiles(src, by, x, {"threshold": p})
    joined = src.join(q, list(by)) if by else src.crossJoin(F.broadcast(q))
    high = F.col(x) >= F.col("threshold")
    return joined.groupBy(*by, "threshold").agg((F.avg(high.cast("double")) * 100).alias("pct_high"),
                                                (F.avg(F.when(high, F.col(y))) - F.avg(F.when(~high, F.col(y)))).alias("delta"))
