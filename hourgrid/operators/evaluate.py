"""Splits, fold summaries, baselines, error metrics and selection rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.scalar import mape_term
from hourgrid.operators.windows import latest_per_key

METRICS = ["mae", "rmse", "mape", "mae_inner", "mae_outer", "mae_event", "mae_non_event"]
# Selection rules.
VARIABILITY_LIMIT = 0.15
MAX_RERUNS = 4
MIN_GAIN_PCT = 1.0
MIN_RETENTION_PCT = 80.0


def error_metrics(df: DataFrame, by: Sequence[str], y: str, yhat: str, inner: Column, event: Column) -> DataFrame:
    """MAE, RMSE, MAPE and MAE of segments in one aggregation; an empty segment gives NULL."""
    err = F.abs(F.col(y) - F.col(yhat))
    ins, ev = F.coalesce(inner, F.lit(False)), F.coalesce(event, F.lit(False))
    return df.groupBy(*by).agg(
        F.count(err).alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(mape_term(F.col(y), F.col(yhat))).alias("mape"),
        F.avg(F.when(ins, err)).alias("mae_inner"), F.avg(F.when(~ins, err)).alias("mae_outer"),
        F.avg(F.when(ev, err)).alias("mae_event"), F.avg(F.when(~ev, err)).alias("mae_non_event"),
    )


def cv_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and sd of the metrics over folds; a single fold has sd 0."""
    aggs = [F.count("*").alias("n_folds"), F.avg("n_valid").alias("mean_n_valid")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"sd_{m}")]
    out = results.groupBy(*by).agg(*aggs)
    return out.withColumn("cv_variability_ratio", F.try_divide("sd_mae", "mean_mae"))


def split_label(df: DataFrame, hour: str, holdout_from: str, excluded: Column | None = None) -> DataFrame:
    label = F.when(F.col(hour) >= F.lit(holdout_from).cast("timestamp"), "holdout").otherwise("train")
    return df.withColumn("split", label if excluded is None else F.when(F.coalesce(excluded, F.lit(False)), "excluded").otherwise(label))


def profile_tables(train: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """Mean target by (entity, hour of day, weekday) and coarser, from one grouping-sets pass over cell sums."""
    cells = train.where(F.col(y).isNotNull()).groupBy(*by, "entity", "hod", "dow").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    b = [F.col(c) for c in by]
    sets = [[*b, F.col("entity"), F.col("hod"), F.col("dow")], [*b, F.col("entity"), F.col("hod")], [*b, F.col("entity")], b]
    out = cells.groupingSets(sets, *b, F.col("entity"), F.col("hod"), F.col("dow")).agg(
        (F.grouping("entity") + F.grouping("hod") + F.grouping("dow")).alias("level"), (F.sum("_s") / F.sum("_n")).alias("pred")
    )
    return out


def profile_predict(train: DataFrame, rows: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds profile_pred and profile_stage: most detailed level of the train profile that knows the row."""
    keys = list(by) or ["_one"]
    if not by:
        train, rows = train.withColumn("_one", F.lit(1)), rows.withColumn("_one", F.lit(1))
    tables = profile_tables(train, keys, y)
    levels = [([*keys, "entity", "hod", "dow"], 0, "parking_hour_weekday"), ([*keys, "entity", "hod"], 1, "parking_hour"),
              ([*keys, "entity"], 2, "parking"), (keys, 3, "global")]
    out = rows
    for on, level, name in levels:
        side = tables.where(F.col("level") == level).select(*on, F.col("pred").alias(f"_p{level}"))
        out = out.join(F.broadcast(side) if level == 3 else side, on, "left")  # the coarsest level has a row for each fold
    stage = None
    for _, level, name in levels:
        cond = F.col(f"_p{level}").isNotNull()
        stage = F.when(cond, name) if stage is None else stage.when(cond, name)
    out = out.withColumns({"profile_pred": F.coalesce(*[F.col(f"_p{k}") for k in range(4)]), "profile_stage": stage})
    drop = [f"_p{k}" for k in range(4)] + ([] if by else ["_one"])
    return out.drop(*drop)


def persistence_predict(rows: DataFrame, lag1: str, lag24: str) -> DataFrame:
    """Adds persist_pred and persist_stage on top of ``profile_predict``: one hour ago, a day ago, profile."""
    stage = F.when(F.col(lag1).isNotNull(), "lag1").when(F.col(lag24).isNotNull(), "lag24").otherwise("fallback_profile")
    return rows.withColumns({"persist_pred": F.coalesce(lag1, lag24, "profile_pred"), "persist_stage": stage})


def stage_shares(df: DataFrame, by: Sequence[str], stage: str) -> DataFrame:
    counts = df.groupBy(*by, F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(total, list(by)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


# Ablation variants, feature sets and row filters; model keys and families.
MODELS = {"ridge_a1_0": "ridge", "rf_90_d12_l2": "random_forest", "xgb_80_d4_lr006": "xgboost"}
VARIANTS = [
    ("policy", "P1", "policy_ts", "none"), ("policy", "P2", "policy_tse_no_parking_id", "none"), ("policy", "P3", "policy_tse_full", "none"),
    ("policy", "P4", "policy_tse_exante_strict", "none"), ("forecast", "F1", "forecast_tse", "none"), ("forecast", "F2", "forecast_tsel_core", "none"),
    ("forecast", "F3", "forecast_tsel_core_strict_lagvalid", "l_valid_all_core==1"), ("forecast", "F4", "forecast_tsel_plus_roll_strict", "l_valid_core_plus_roll24==1"),
]
BASELINES = [("P0_profile_baseline", "policy", "P0", "profile_baseline", "baseline_profile"), ("F0_persistence_baseline", "forecast", "F0", "persistence_baseline", "baseline_persistence")]
CV_MODES = ["fold_safe", "fixed_export"]
PLAN_SCHEMA = "run_id string, track string, variant string, model_family string, model_key string, feature_set_id string, row_filter string, seed bigint, primary_metric string, cv_mode string"


def ablation_plan(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Runs x modes as a table: two baselines and every variant with every model."""
    rows = [(rid, tr, v, "baseline", mk, fs, "none") for rid, tr, v, mk, fs in BASELINES]
    rows += [(f"{v}_{mk}", tr, v, fam, mk, fs, rf) for tr, v, fs, rf in VARIANTS for mk, fam in MODELS.items()]
    return spark.createDataFrame([(*r, seed, "mae", mode) for r in rows for mode in CV_MODES], PLAN_SCHEMA)


def rerun_plan(summary: DataFrame, seed: int = 42) -> DataFrame:
    """Up to four reruns for unstable fold-safe runs, the least unstable listed last."""
    filters = {"F3": "l_valid_all_core==1", "F4": "l_valid_core_plus_roll24==1"}
    key = F.try_element_at(F.create_map(*[F.lit(x) for k, f in MODELS.items() for x in (f, k)]), F.col("model_family"))
    high = summary.where((F.col("cv_mode") == "fold_safe") & ~F.col("variant").isin("P0", "F0") & (F.col("cv_variability_ratio") > VARIABILITY_LIMIT))
    order = [F.col("track"), F.col("mean_mae"), F.col("run_id")]
    top = high.orderBy(*order).limit(MAX_RERUNS).withColumn("model_key", key)
    row_filter = F.when(F.col("variant") == "F3", filters["F3"]).when(F.col("variant") == "F4", filters["F4"]).otherwise("none")
    return top.select(
        F.concat_ws("_", F.lit("R1"), "variant", "model_key").alias("run_id"), "track", "variant", "model_family", "model_key",
        F.concat(F.lit("refine_"), "variant").alias("feature_set_id"), row_filter.alias("row_filter"), F.lit(seed).cast("bigint").alias("seed"),
        F.lit("mae").alias("primary_metric"), F.lit("fold_safe").alias("cv_mode"),
    )


def shortlist(summary: DataFrame) -> DataFrame:
    """Best run per variant, the gain and retention rule for F4, holdout selection and the primary run per track."""
    order = [F.col("mean_mae"), F.col("mean_rmse"), F.col("mean_mape"), F.col("run_id")]
    best = latest_per_key(summary.where("cv_mode = 'fold_safe'"), ["track", "variant"], order, earliest=True)

    def of(variant: str, col: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(col)))

    rule = best.agg(of("F2", "mean_mae").alias("m2"), of("F4", "mean_mae").alias("m4"), of("F2", "mean_n_valid").alias("n2"), of("F4", "mean_n_valid").alias("n4"))
    gain = F.coalesce(F.try_divide((F.col("m2") - F.col("m4")) * 100, F.col("m2")), F.lit(0.0))
    kept = F.coalesce(F.try_divide(F.col("n4") * 100, F.col("n2")), F.lit(0.0))
    rule = rule.select(gain.alias("f4_gain_pct"), kept.alias("f4_retention_pct"))
    out = best.crossJoin(F.broadcast(rule))
    rejected = (F.col("variant") == "F4") & ~((F.col("f4_gain_pct") >= MIN_GAIN_PCT) & (F.col("f4_retention_pct") >= MIN_RETENTION_PCT))
    out = out.withColumn("status", F.when(rejected, "rejected_by_f4_rule").otherwise("candidate"))
    held = F.col("variant").isin("P0", "P2", "P3", "P4", "F0", "F1", "F2", "F3", "F4") & (F.col("status") == "candidate")
    out = out.withColumn("selected_for_holdout", held)
    eligible = (F.col("status") == "candidate") & F.col("variant").isin("P2", "P3", "P4", "F1", "F2", "F3", "F4")
    primary = out.where(eligible).groupBy("track").agg(F.min_by("run_id", F.struct(*order)).alias("_primary"))
    out = out.join(F.broadcast(primary), "track", "left")
    return out.withColumn("is_primary", F.coalesce(F.col("run_id") == F.col("_primary"), F.lit(False))).drop("_primary")


def required_present(df: DataFrame, column: str, required: Sequence[str], spark: SparkSession) -> DataFrame:
    """Required values that are missing; empty when all are there."""
    want = spark.createDataFrame([(r,) for r in required], f"{column} string")
    return want.join(df.select(column).distinct(), column, "left_anti")


def go_checks(results: DataFrame, holdout: DataFrame, contract: DataFrame, fold_log: DataFrame, spark: SparkSession) -> DataFrame:
    """Checklist before reporting: every row must be true."""

    def one(name: str, df: DataFrame, ok: Column) -> DataFrame:
        return df.agg(F.coalesce(ok, F.lit(False)).alias("passed")).select(F.lit(name).alias("check"), "passed")

    need = [v for _, v, _, _ in VARIANTS] + ["P0", "F0"]
    parts = [
        one("contract_checks_pass", contract, F.bool_and(F.col("result") == "PASS")),
        one("fold_log_complete", fold_log, F.bool_and((F.col("n_train") > 0) & (F.col("n_valid") > 0))),
        one("all_variants_fold_safe", required_present(results.where("cv_mode = 'fold_safe'"), "variant", need, spark), F.count("*") == 0),
        one("policy_tradeoff_reported", required_present(holdout, "variant", ["P2", "P3", "P4"], spark), F.count("*") == 0),
        one("selection_uses_fold_safe", results.where("cv_mode = 'fold_safe'"), F.count("*") > 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
