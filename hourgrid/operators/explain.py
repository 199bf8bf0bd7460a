"""Attribution summaries: samples, importances, stability, contrasts, evidence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.functions.scalar import daypart, first_match, jaccard
from hourgrid.operators.moments import Linear, group_deviations
from hourgrid.operators.quantile import quantiles


def block_shares(long: DataFrame, by: Sequence[str], block: str, value: str) -> DataFrame:
    """Sum per block and its share of the run's total."""
    sums = long.groupBy(*by, block).agg(F.sum(value).alias("total"))
    total = sums.groupBy(*by).agg(F.sum("total").alias("_t"))
    return sums.join(total, list(by)).withColumn("share", F.try_divide("total", "_t")).drop("_t")


def strata(tier: Column, event: Column, hour: Column) -> Column:
    inner = F.when(F.coalesce(tier, F.lit(False)), "centrum").otherwise("vesten_rand")
    ev = F.when(F.coalesce(event, F.lit(False)), "event").otherwise("non_event")
    return F.concat_ws("|", inner, ev, daypart(hour))


def allocation(counts: DataFrame, target: int) -> DataFrame:
    """Rows to take per stratum: proportional, at least one, largest strata give way, largest remainders gain.

    Input (stratum, n); there are as many rows as strata, a fixed small number.
    """
    total = counts.agg(F.sum("n").alias("_total"))
    a = counts.crossJoin(F.broadcast(total)).withColumn("_x", F.col("n") / F.col("_total") * target)
    a = a.withColumn("_a", F.greatest(F.floor("_x"), F.lit(1)).cast("bigint"))
    by_size = W.orderBy(F.desc("_a"), "stratum").rowsBetween(W.unboundedPreceding, -1)
    over = F.greatest(F.sum("_a").over(W.partitionBy(F.lit(1))) - target, F.lit(0))
    given = F.coalesce(F.sum(F.col("_a") - 1).over(by_size), F.lit(0))
    a = a.withColumn("_take", F.greatest(F.least(over - given, F.col("_a") - 1), F.lit(0))).withColumn("_a", F.col("_a") - F.col("_take"))
    left = F.greatest(F.lit(target) - F.sum("_a").over(W.partitionBy(F.lit(1))), F.lit(0))
    size = F.count("*").over(W.partitionBy(F.lit(1)))
    place = F.row_number().over(W.orderBy(F.desc(F.col("_x") - F.floor("_x")), "stratum")) - 1
    a = a.withColumns({"_left": left, "_size": size, "_place": place})
    extra = F.floor(F.col("_left") / F.col("_size")) + (F.col("_place") < F.col("_left") % F.col("_size")).cast("int")
    return a.select("stratum", "n", F.least(F.col("_a") + extra, F.col("n")).cast("bigint").alias("n_take"))


def stratified_sample(df: DataFrame, stratum: Column, key: Sequence[str], target: int, seed: int = 42) -> DataFrame:
    """Sample of at most ``target`` rows; rows are taken in order of a keyed hash, so partitioning does not matter.

    Each stratum's hash range is cut into buckets; only the bucket holding the cut is ranked.
    """
    x = df.withColumn("stratum", stratum).withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    x = x.withColumn("_b", F.shiftright("_h", 52))
    buckets = x.groupBy("stratum", "_b").agg(F.count("*").alias("_c"))
    counts = buckets.groupBy("stratum").agg(F.sum("_c").alias("n"))
    take = allocation(counts, target)
    upto = W.partitionBy("stratum").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    b = buckets.withColumn("_cc", F.sum("_c").over(upto)).join(take.select("stratum", "n_take"), "stratum")
    b = b.where(F.col("_cc") - F.col("_c") < F.col("n_take"))
    y = x.join(b, ["stratum", "_b"])
    whole = y.where(F.col("_cc") <= F.col("n_take"))
    rank = F.row_number().over(W.partitionBy("stratum").orderBy("_h", *key))
    part = y.where(F.col("_cc") > F.col("n_take")).withColumn("_r", rank).where(F.col("_r") <= F.col("n_take") - (F.col("_cc") - F.col("_c"))).drop("_r")
    return whole.unionByName(part).drop("_h", "_b", "_c", "_cc", "n_take")


def linear_attributions(df: DataFrame, features: Sequence[str], coefficients: Sequence[float], means: Sequence[float | Column], intercept: float) -> DataFrame:
    """attr__<feature> = coefficient x (value - mean), and the base value they add to. A mean may be a column."""
    at = [m if isinstance(m, Column) else F.lit(float(m)) for m in means]
    cols = {f"attr__{f}": (F.col(f).cast("double") - m) * float(c) for f, c, m in zip(features, coefficients, at)}
    base = sum((m * float(c) for c, m in zip(coefficients, at)), F.lit(float(intercept)))
    return df.withColumns({**cols, "base_value": base})


def additivity(df: DataFrame, features: Sequence[str], prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Base plus attributions against the prediction: mean, p95, max error and the share within 1e-4."""
    total = F.col("base_value")
    for f in features:
        total = total + F.col(f"attr__{f}")
    err = df.withColumn("_e", F.abs(total - F.col(prediction)))
    stats = err.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_e").alias("mean_error"), F.max("_e").alias("max_error"), F.avg((F.col("_e") <= 1e-4).cast("double")).alias("pass_rate"))
    p95 = quantiles(err, by, "_e", {"p95_error": 0.95})
    return stats.join(p95, list(by)) if by else stats.crossJoin(p95)


def long_attributions(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide attr__ columns to rows (ids, feature, attribution, feature value)."""
    arms = [F.struct(F.lit(f).alias("feature"), F.col(f"attr__{f}").alias("attribution"), F.col(f).cast("double").alias("feature_value")) for f in features]
    return df.select(*ids, F.inline(F.array(*arms)))


def importance(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute and signed attribution and rank per feature within each context."""
    imp = long.groupBy(*by, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean_signed"), F.count("*").alias("n"))
    return ranked_importance(imp, by)


def linear_importance(df: DataFrame, by: str, rules: Sequence[Linear], means: dict[str, dict[str, float]], fill: dict[str, dict[str, float]]) -> DataFrame:
    """(grp, feature, mean_abs, mean_signed, n) of the attributions of a linear rule for each group, in one scan.

    An attribution is weight x (value - mean), so its mean size is the weight's size times that of the deviation.
    """
    columns = list(dict.fromkeys(c for r in rules for c in r.columns))
    off = group_deviations(df, by, columns, means, fill)
    weights = df.sparkSession.createDataFrame([(r.group, c, float(w)) for r in rules for c, w in zip(r.columns, r.weights, strict=True)], "grp string, `column` string, w double")
    met = off.join(weights, ["grp", "column"])
    return met.select("grp", F.col("column").alias("feature"), (F.abs("w") * F.col("size")).alias("mean_abs"), (F.col("w") * F.col("off")).alias("mean_signed"), "n")


def ranked_importance(imp: DataFrame, by: Sequence[str]) -> DataFrame:
    return imp.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")))


#: A signed mean below this share of the mean size is 0: its sign is that of rounding, and differs with the order of rows.
NO_SIGN = 1e-9


def stability(imp: DataFrame, by: Sequence[str], top: int = 10) -> DataFrame:
    """Over folds: mean and population sd of the rank, share in the top, sign consistency (a mean of 0 has no sign)."""
    signed, least = F.col("mean_signed"), F.col("mean_abs") * NO_SIGN
    return imp.groupBy(*by, "feature").agg(
        F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("sd_rank"), F.avg((F.col("rank") <= top).cast("double")).alias("top_freq"),
        F.greatest(F.avg((signed > least).cast("double")), F.avg((signed < -least).cast("double"))).alias("sign_consistency"),
    )


def top_overlap(imp: DataFrame, by: Sequence[str], fold: str, top: int = 10) -> DataFrame:
    """Mean Jaccard of the top features over all pairs of folds."""
    sets = imp.where(F.col("rank") <= top).groupBy(*by, fold).agg(F.collect_set("feature").alias("s"))
    a, b = sets.select(*by, F.col(fold).alias("fa"), F.col("s").alias("sa")), sets.select(*by, F.col(fold).alias("fb"), F.col("s").alias("sb"))
    pairs = a.join(b, list(by)) if by else a.crossJoin(b)
    return pairs.where("fa < fb").groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg(jaccard(F.col("sa"), F.col("sb"))).alias("mean_jaccard"))


# Thresholds of the critique rules and of evidence strength.
MIN_JACCARD = 0.60
MIN_DIRECTION = 0.65


def critique(overlap_by_run: DataFrame, stab: DataFrame, contrast: DataFrame, holdout: DataFrame, linear_run: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules with value, threshold, triggered and action. ``holdout`` is (run_id, mae); pairs are (benchmark, primary)."""
    j = overlap_by_run.agg(F.min("mean_jaccard").alias("j"))
    top = stab.where(F.col("run_id") == linear_run).orderBy("mean_rank", "feature").limit(20)
    d = top.agg(F.avg("sign_consistency").alias("d"))
    c = contrast.agg(F.avg(((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).cast("double")).alias("c"))

    def mae(run: str) -> Column:
        return F.max(F.when(F.col("run_id") == run, F.col("mae")))

    better = F.lit(False)
    for bench, prim in pairs:
        better = better | F.coalesce(mae(bench) < mae(prim), F.lit(False))
    b = holdout.agg(better.alias("b"))
    row = j.crossJoin(d).crossJoin(c).crossJoin(b)

    def rule(name: str, value: Column, limit: float, hit: Column, action: str, otherwise: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"), F.lit(limit).alias("threshold"), hit.alias("triggered"),
                        F.when(hit, action).otherwise(otherwise).alias("action"))

    low_j, low_d = F.coalesce(F.col("j") < MIN_JACCARD, F.lit(False)), F.coalesce(F.col("d") < MIN_DIRECTION, F.lit(False))
    crossing = F.coalesce(F.col("c") > 0, F.lit(True))
    return row.select(F.inline(F.array(
        rule("top10_jaccard_threshold", F.col("j"), MIN_JACCARD, low_j, "rerun_with_larger_samples", "none"),
        rule("linear_direction_consistency", F.col("d"), MIN_DIRECTION, low_d, "downgrade_directional_claims", "keep_directional_claims"),
        rule("tier_delta_ci_crosses_zero", F.col("c"), 0.0, crossing, "suppress_hard_tier_claims", "allow_hard_tier_claims"),
        rule("benchmark_better_than_primary", F.col("b").cast("int"), 0.0, F.col("b"), "force_tradeoff_paragraph", "none"),
    )))


def evidence_strength(imp: DataFrame, stab: DataFrame, contrast: DataFrame, keys: Sequence[str] = ("run_id", "feature"), top: int = 8) -> DataFrame:
    """Strong, moderate or weak per top feature, with caveats."""
    on = list(keys)
    x = imp.where(F.col("rank") <= top).join(stab.select(*on, "top_freq", "sign_consistency"), on, "left")
    x = x.join(contrast.select(*on, "significant"), on, "left").fillna({"top_freq": 0.0, "sign_consistency": 0.0, "significant": False})
    f, s, g = F.col("top_freq"), F.col("sign_consistency"), F.col("significant")
    x = x.withColumn("strength", first_match([((f >= 0.67) & (s >= 0.65) & g, "strong"), ((f >= 0.34) & (s >= 0.55), "moderate")], "weak"))
    caveat = F.concat_ws("; ", F.when(s < 0.65, "direction not stable over folds"), F.when(~g, "group contrast not robust"))
    return x.withColumn("caveat", F.when(caveat == "", "none").otherwise(caveat))


def tree_attributions(rows: DataFrame, features: Sequence[str], trees: list[dict], weights: Sequence[float], background: np.ndarray, offset: float = 0.0, samples: int = 32, seed: int = 7) -> DataFrame:
    """Monte-Carlo Shapley values of a tree ensemble against a small background table.

    ``rows`` is a sample with the feature columns; trees are flat node arrays (feature, threshold, left, right, value).
    Along each random order of features a row morphs from a background row into itself, so contributions add up to
    prediction minus mean background prediction exactly, for the drawn background rows.
    """
    names = list(features)
    k = len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema += ", " + ", ".join(f"`attr__{n}` double" for n in names) + ", base_value double, model_pred double"

    def predict(x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), offset)
        for w, tree in zip(weights, trees):
            node = np.zeros(len(x), dtype=np.int64)
            feat, cut, left, right, value = (tree[c] for c in ("feature", "threshold", "left", "right", "value"))
            active = feat[node] >= 0
            while active.any():
                at = node[active]
                go_left = x[active, feat[at]] <= cut[at]
                node[active] = np.where(go_left, left[at], right[at])
                active = feat[node] >= 0
            total += w * value[node]
        return total

    def attribute(batches):
        rng = np.random.default_rng(seed)
        orders = [rng.permutation(k) for _ in range(samples)]
        picks = rng.integers(0, len(background), samples)
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            contrib = np.zeros_like(x)
            base = np.zeros(len(x))
            for order, pick in zip(orders, picks):
                current = np.repeat(background[pick][None, :], len(x), axis=0)
                before = predict(current)
                base += before
                for j in order:
                    current[:, j] = x[:, j]
                    after = predict(current)
                    contrib[:, j] += after - before
                    before = after
            out = pdf.copy()
            for j, n in enumerate(names):
                out[f"attr__{n}"] = contrib[:, j] / samples
            out["base_value"] = base / samples
            out["model_pred"] = predict(x)
            yield pd.DataFrame(out)

    return rows.mapInPandas(attribute, schema)
