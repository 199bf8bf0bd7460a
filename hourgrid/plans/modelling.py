"""Splits, baselines, estimators, cross-validation and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import evaluate as EV
from hourgrid.operators import features as FE
from hourgrid.operators import ledger as L
from hourgrid.operators import models as M
from hourgrid.operators import significance as ST
from hourgrid.operators.panel import fold_rows
from hourgrid.operators.windows import exact_lags
from hourgrid.plans.features import FORECAST, LEVELS, POLICY, built, fold_table, rows
from hourgrid.plans.registry import query
from hourgrid.session import stage_path, staged
from hourgrid.sources.frames import FOLDS, HOLDOUT_FROM



def _segments():
    return F.col("s_tier_is_centrum") == 1, F.col("e_is_event_day") == 1


@query("ml1_split_summary", "split:s n:i first:t last:t n_entities:i mean_rate:f", f"""
  SELECT CASE WHEN ksum % 13 = 0 THEN 'excluded' WHEN hour >= TIMESTAMP '{HOLDOUT_FROM}' THEN 'holdout' ELSE 'train' END AS split, count(*) AS n, min(hour) AS first, max(hour) AS last, count(DISTINCT entity) AS n_entities, avg(rate) AS mean_rate FROM hg_panel GROUP BY 1""")
def ml1(t):
    x = EV.split_label(t.panel, "hour", HOLDOUT_FROM, F.col("ksum") % 13 == 0)
    per = x.groupBy("split", "entity").agg(F.count("*").alias("n"), F.min("hour").alias("a"), F.max("hour").alias("b"), F.sum("rate").alias("s"))
    return per.groupBy("split").agg(F.sum("n").alias("n"), F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("n_entities"), (F.sum("s") / F.sum("n")).alias("mean_rate"))


@query("ml2_fold_plan", "fold:s n_train:i n_valid:i n_valid_entities:i", """
  SELECT fold, count(*) FILTER (WHERE hour < train_end_before) AS n_train, count(*) FILTER (WHERE hour BETWEEN valid_start AND valid_end) AS n_valid, count(DISTINCT entity) FILTER (WHERE hour BETWEEN valid_start AND valid_end) AS n_valid_entities FROM hg_panel, hg_folds GROUP BY 1""")
def ml2(t):
    per = fold_rows(t.panel.select("entity", "hour"), t.folds).groupBy("fold", "role", "entity").agg(F.count("*").alias("n"))
    valid = F.col("role") == "valid"
    return per.groupBy("fold").agg(F.sum(F.when(~valid, F.col("n"))).alias("n_train"), F.sum(F.when(valid, F.col("n"))).alias("n_valid"), F.count_if(valid).alias("n_valid_entities"))


_FOLD_ROWS = """fr AS (SELECT fold, CASE WHEN hour < train_end_before THEN 'train' ELSE 'valid' END AS role, p.* FROM hg_panel p, hg_folds WHERE hour < train_end_before OR hour BETWEEN valid_start AND valid_end)"""
_PROFILE = f"""{_FOLD_ROWS}, tr AS (SELECT * FROM fr WHERE role = 'train'), p3 AS (SELECT fold, entity, hod, dow, avg(rate) AS m3 FROM tr GROUP BY ALL), p2 AS (SELECT fold, entity, hod, avg(rate) AS m2 FROM tr GROUP BY ALL),
  p1 AS (SELECT fold, entity, avg(rate) AS m1 FROM tr GROUP BY ALL), p0 AS (SELECT fold, avg(rate) AS m0 FROM tr GROUP BY ALL),
  pp AS (SELECT v.*, coalesce(m3, m2, m1, m0) AS pred, CASE WHEN m3 IS NOT NULL THEN 'parking_hour_weekday' WHEN m2 IS NOT NULL THEN 'parking_hour' WHEN m1 IS NOT NULL THEN 'parking' ELSE 'global' END AS stage
    FROM fr v LEFT JOIN p3 USING (fold, entity, hod, dow) LEFT JOIN p2 USING (fold, entity, hod) LEFT JOIN p1 USING (fold, entity) LEFT JOIN p0 USING (fold) WHERE role = 'valid'),
  ps AS (SELECT pp.*, coalesce(a.rate, b.rate, pred) AS ppred, CASE WHEN a.rate IS NOT NULL THEN 'lag1' WHEN b.rate IS NOT NULL THEN 'lag24' ELSE 'fallback_profile' END AS pstage FROM pp
    LEFT JOIN fr a ON a.fold = pp.fold AND a.entity = pp.entity AND a.hour = pp.hour - INTERVAL 1 HOUR LEFT JOIN fr b ON b.fold = pp.fold AND b.entity = pp.entity AND b.hour = pp.hour - INTERVAL 24 HOUR)"""


def _baselines(t):
    """Validation rows of every fold with both baseline predictions."""
    x = FE.lag_block(fold_rows(t.panel.select("entity", "hour", "t", "rate", "hod", "dow", "grp"), t.folds), ["fold"])
    out = EV.profile_predict(x.where("role = 'train'"), x.where("role = 'valid'"), "rate", ["fold"])
    return EV.persistence_predict(out, "l_occ_lag_1h", "l_occ_lag_24h")


@query("ml4_fixed_slices", "fold:s role:s n:i mean_rate:f", f"WITH {_FOLD_ROWS} SELECT fold, role, count(*) AS n, avg(rate) AS mean_rate FROM fr GROUP BY ALL")
def ml4(t):
    # Features are built once on the whole train split, then cut into folds.
    x = FE.lag_block(t.panel.select("entity", "hour", "t", "rate"))
    return fold_rows(x, t.folds).groupBy("fold", "role").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"))


@query("ml5_profile_baseline", "fold:s entity:s hour:t profile_pred:f profile_stage:s", f"WITH {_PROFILE} SELECT fold, entity, hour, pred AS profile_pred, stage AS profile_stage FROM pp")
def ml5(t):
    return _baselines(t)


@query("j11_hierarchical_lookup", "fold:s stage:s n:i share:f", f"""
  WITH {_PROFILE} SELECT fold, stage, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY fold)::DOUBLE AS share FROM pp GROUP BY fold, stage""")
def j11(t):
    return EV.stage_shares(_baselines(t), ["fold"], "profile_stage")


@query("ml6_persistence_baseline", "fold:s entity:s hour:t persist_pred:f persist_stage:s", f"WITH {_PROFILE} SELECT fold, entity, hour, ppred AS persist_pred, pstage AS persist_stage FROM ps")
def ml6(t):
    return _baselines(t)


@query("ml12_fold_metrics", "fold:s n:i mae:f rmse:f mape:f3 mae_inner:f mae_outer:f", f"""
  WITH {_PROFILE} SELECT fold, count(*) AS n, avg(abs(rate - ppred)) AS mae, sqrt(avg((rate - ppred) ** 2)) AS rmse, 100 * avg(abs(rate - ppred) / greatest(abs(rate), 1e-6)) AS mape, avg(abs(rate - ppred)) FILTER (WHERE grp = 'centrum') AS mae_inner,
  avg(abs(rate - ppred)) FILTER (WHERE coalesce(grp, '') <> 'centrum') AS mae_outer FROM ps GROUP BY 1""")
def ml12(t):
    return EV.error_metrics(_baselines(t), ["fold"], "rate", "persist_pred", F.col("grp") == "centrum", F.lit(False))


@query("ml3_fold_log", "fold:s n_train:i n_valid:i n_levels:i concurrency_cap:i", """
  WITH f AS (SELECT fold, hour < train_end_before AS tr, m.* FROM hg_mad m, hg_folds WHERE hour < train_end_before OR hour BETWEEN valid_start AND valid_end)
  SELECT fold, count(*) FILTER (WHERE tr) AS n_train, count(*) FILTER (WHERE NOT tr) AS n_valid, count(DISTINCT entity) FILTER (WHERE tr) AS n_levels,
  greatest(CAST(floor(quantile_cont(CAST(n_concurrent_events AS DOUBLE), 0.95) FILTER (WHERE tr)) AS INT), 1) AS concurrency_cap FROM f GROUP BY 1""")
def ml3(t):
    x = fold_rows(rows(t), t.folds)
    p = FE.fit(x.where("role = 'train'"), ["fold"], levels=LEVELS)
    n = x.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "valid").alias("n_valid"))
    return n.join(p, "fold").select("fold", "n_train", "n_valid", F.size("entity_levels").alias("n_levels"), "concurrency_cap")


def _scored_holdout(t, key: str, features, **params):
    x = staged(built(t), ["split"])
    fitted = M.fit_model(key, x.where("split = 'train'"), features, "rate", **params)
    inner, event = _segments()
    scored = fitted.transform(x.where("split = 'holdout'"))
    return EV.error_metrics(scored, [], "rate", "yhat", inner, event).withColumn("model", F.lit(key))


@query("ml7_ridge_holdout", "model:s n:i mae:f4 rmse:f4")
def ml7(t):
    return _scored_holdout(t, "ridge_a1_0", FORECAST)


@query("ml8_forest_holdout", "model:s n:i mae:f4 rmse:f4")
def ml8(t):
    return _scored_holdout(t, "rf_90_d12_l2", FORECAST)


@query("ml9_boosting_holdout", "model:s n:i mae:f4 rmse:f4")
def ml9(t):
    return _scored_holdout(t, "xgb_80_d4_lr006", FORECAST)


@query("ml10_ablation_plan", "run_id:s track:s variant:s model_key:s row_filter:s cv_mode:s n_train:i", """
  WITH v AS (SELECT * FROM (VALUES ('policy', 'P1', 'none'), ('policy', 'P2', 'none'), ('policy', 'P3', 'none'), ('policy', 'P4', 'none'), ('forecast', 'F1', 'none'), ('forecast', 'F2', 'none'), ('forecast', 'F3', 'l_valid_all_core==1'), ('forecast', 'F4', 'l_valid_core_plus_roll24==1')) x(track, variant, row_filter)),
  r AS (SELECT variant || '_' || m AS run_id, track, variant, m AS model_key, row_filter FROM v, (VALUES ('ridge_a1_0'), ('rf_90_d12_l2'), ('xgb_80_d4_lr006')) y(m) UNION ALL VALUES ('P0_profile_baseline', 'policy', 'P0', 'profile_baseline', 'none'), ('F0_persistence_baseline', 'forecast', 'F0', 'persistence_baseline', 'none'))
  SELECT r.*, c AS cv_mode, (SELECT count(*) FROM hg_panel, hg_folds WHERE hour < train_end_before) AS n_train FROM r, (VALUES ('fold_safe'), ('fixed_export')) z(c)""")
def ml10(t):
    n = fold_rows(t.panel.select("hour"), t.folds).agg(F.count_if(F.col("role") == "train").alias("n_train"))
    return EV.ablation_plan(t.spark).crossJoin(F.broadcast(n))


def swept(t, models: tuple[str, ...] = ("baseline", "ridge"), folder: str | None = None, tree_params: dict | None = None):
    """The ledger's cells of the ablation plan for some model families, in both modes and all folds."""
    tables = {"fold_safe": staged(fold_table(t), ["fold", "role"]), "fixed_export": staged(fold_rows(built(t).where("split = 'train'").drop("split"), t.folds), ["fold", "role"])}
    plan = [r.asDict() for r in EV.ablation_plan(t.spark).where(F.col("model_family").isin(*models)).orderBy("run_id", "cv_mode").collect()]
    inner, event = _segments()
    kept = L.Ledger(t.spark, folder or stage_path(t.spark, "ledger"))
    return L.sweep(plan, [f[0] for f in FOLDS], tables, FE.catalogue(LEVELS), set(), inner, event, kept, tree_params=tree_params)


@query("ml11_run_plan", "run_id:s cv_mode:s fold_id:s n_train:i n_valid:i mae:f4 rmse:f4 mape:f3 mae_inner:f4 mae_event:f4 fit_status:s")
def ml11(t):
    return swept(t)


def _ledger_summary(t):
    return EV.cv_summary(swept(t), ["run_id", "track", "variant", "model_family", "cv_mode"])


@query("ml13_ledger_reruns", "run_id:s variant:s row_filter:s feature_set_id:s")
def ml13_ledger(t):
    return EV.rerun_plan(_ledger_summary(t))


@query("ml14_ledger_shortlist", "run_id:s variant:s mean_mae:f4 status:s selected_for_holdout:b is_primary:b f4_gain_pct:f3 f4_retention_pct:f3")
def ml14_ledger(t):
    return EV.shortlist(_ledger_summary(t))


# Results of simple forecasts over weeks stand in for fitted runs in the selection rules.
_RUNS = """px AS (SELECT a.entity, a.hour, a.week, a.rate, a.grp, b.rate AS l1, c.rate AS l24, d.rate AS l168 FROM hg_panel a LEFT JOIN hg_panel b ON b.entity = a.entity AND b.hour = a.hour - INTERVAL 1 HOUR LEFT JOIN hg_panel c ON c.entity = a.entity AND c.hour = a.hour - INTERVAL 24 HOUR LEFT JOIN hg_panel d ON d.entity = a.entity AND d.hour = a.hour - INTERVAL 168 HOUR),
  res AS (SELECT run_id, track, variant, 'ridge' AS model_family, week, count(*) AS n_valid, avg(abs(rate - yhat)) AS mae, sqrt(avg((rate - yhat) ** 2)) AS rmse, 100 * avg(abs(rate - yhat) / greatest(rate, 1e-6)) AS mape FROM (
    SELECT 'F2_a' AS run_id, 'forecast' AS track, 'F2' AS variant, week, rate, l1 AS yhat FROM px UNION ALL SELECT 'F2_b', 'forecast', 'F2', week, rate, l24 FROM px UNION ALL SELECT 'F4_a', 'forecast', 'F4', week, rate, (l1 + l24) / 2 FROM px
    UNION ALL SELECT 'P2_a', 'policy', 'P2', week, rate, l168 FROM px UNION ALL SELECT 'P0_a', 'policy', 'P0', week, rate, (l24 + l168) / 2 FROM px) WHERE yhat IS NOT NULL GROUP BY ALL),
  sm AS (SELECT run_id, track, variant, model_family, avg(n_valid) AS mean_n_valid, avg(mae) AS mean_mae, coalesce(stddev_samp(mae), 0) AS sd_mae, avg(rmse) AS mean_rmse, avg(mape) AS mean_mape, coalesce(stddev_samp(mae), 0) / avg(mae) AS ratio FROM res GROUP BY ALL)"""


def _summary(t):
    x = exact_lags(t.panel.select("entity", "hour", "t", "week", "rate", "grp"), ["entity"], "t", "rate", [1, 24, 168])
    l1, l24, l168 = F.col("lag_1h"), F.col("lag_24h"), F.col("lag_168h")
    runs = [("F2_a", "forecast", "F2", l1), ("F2_b", "forecast", "F2", l24), ("F4_a", "forecast", "F4", (l1 + l24) / 2), ("P2_a", "policy", "P2", l168), ("P0_a", "policy", "P0", (l24 + l168) / 2)]
    arms = [F.struct(F.lit(r).alias("run_id"), F.lit(tr).alias("track"), F.lit(v).alias("variant"), y.alias("yhat")) for r, tr, v, y in runs]
    long = x.select("week", "rate", "grp", F.inline(F.array(*arms))).where("yhat IS NOT NULL")
    keys = ["run_id", "track", "variant", "week"]
    m = EV.error_metrics(long, keys, "rate", "yhat", F.col("grp") == "centrum", F.lit(False)).withColumnRenamed("n", "n_valid")
    m = m.withColumns({"model_family": F.lit("ridge"), "cv_mode": F.lit("fold_safe")})
    return EV.cv_summary(m, ["run_id", "track", "variant", "model_family", "cv_mode"])


@query("ml13_rerun_plan", "run_id:s variant:s row_filter:s feature_set_id:s", f"""
  WITH {_RUNS} SELECT 'R1_' || variant || '_ridge_a1_0' AS run_id, variant, CASE variant WHEN 'F3' THEN 'l_valid_all_core==1' WHEN 'F4' THEN 'l_valid_core_plus_roll24==1' ELSE 'none' END AS row_filter, 'refine_' || variant AS feature_set_id
  FROM (SELECT * FROM sm WHERE variant NOT IN ('P0', 'F0') AND ratio > 0.15 ORDER BY track, mean_mae, run_id LIMIT 4)""")
def ml13(t):
    return EV.rerun_plan(_summary(t))


@query("ml14_shortlist", "run_id:s variant:s mean_mae:f status:s selected_for_holdout:b is_primary:b f4_gain_pct:f4 f4_retention_pct:f4", f"""
  WITH {_RUNS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, variant ORDER BY mean_mae, mean_rmse, mean_mape, run_id) AS r FROM sm) WHERE r = 1),
  rule AS (SELECT 100 * (max(mean_mae) FILTER (WHERE variant = 'F2') - max(mean_mae) FILTER (WHERE variant = 'F4')) / max(mean_mae) FILTER (WHERE variant = 'F2') AS f4_gain_pct, 100 * max(mean_n_valid) FILTER (WHERE variant = 'F4') / max(mean_n_valid) FILTER (WHERE variant = 'F2') AS f4_retention_pct FROM best),
  st AS (SELECT *, CASE WHEN variant = 'F4' AND NOT (f4_gain_pct >= 1 AND f4_retention_pct >= 80) THEN 'rejected_by_f4_rule' ELSE 'candidate' END AS status FROM best, rule),
  pr AS (SELECT track, arg_min(run_id, mean_mae) AS run_id FROM st WHERE status = 'candidate' AND variant NOT IN ('P0', 'P1', 'F0') GROUP BY 1)
  SELECT st.*, variant <> 'P1' AND status = 'candidate' AS selected_for_holdout, st.run_id IN (SELECT run_id FROM pr) AS is_primary FROM st""")
def ml14(t):
    return EV.shortlist(_summary(t))


@query("ml15_holdout_comparison", "n:i mean_d:f dm_stat:f", f"""
  WITH tr AS (SELECT * FROM hg_panel WHERE hour < TIMESTAMP '{HOLDOUT_FROM}'), p3 AS (SELECT entity, hod, dow, avg(rate) AS m3 FROM tr GROUP BY ALL), p2 AS (SELECT entity, hod, avg(rate) AS m2 FROM tr GROUP BY ALL),
  e AS (SELECT v.entity, v.hour, abs(v.rate - coalesce(m3, m2)) - abs(v.rate - b.rate) AS d FROM hg_panel v LEFT JOIN p3 USING (entity, hod, dow) LEFT JOIN p2 USING (entity, hod) JOIN hg_panel b ON b.entity = v.entity AND b.hour = v.hour - INTERVAL 24 HOUR WHERE v.hour >= TIMESTAMP '{HOLDOUT_FROM}'),
  i AS (SELECT row_number() OVER (ORDER BY entity, hour) AS i, d FROM e), cv AS (SELECT k, covar_samp(x.d, y.d) AS c FROM i x CROSS JOIN (SELECT unnest(range(1, 25)) AS k) JOIN i y ON y.i = x.i - k GROUP BY 1),
  s AS (SELECT count(*) AS n, avg(d) AS mean_d, var_samp(d) + (SELECT sum(2 * (1 - k / 25.0::DOUBLE) * c) FROM cv) AS s FROM i) SELECT n, mean_d, mean_d / sqrt(s / n) AS dm_stat FROM s""")
def ml15(t):
    x = EV.split_label(FE.lag_block(t.panel.select("entity", "hour", "t", "rate", "hod", "dow")), "hour", HOLDOUT_FROM)
    hold = EV.profile_predict(x.where("split = 'train'"), x.where("split = 'holdout'"), "rate")
    hold = hold.withColumns({"e1": F.col("rate") - F.col("profile_pred"), "e2": F.col("rate") - F.col("l_occ_lag_24h")})
    return ST.diebold_mariano(hold, ["entity"], "t", "e1", "e2", 24)


@query("ml16_go_checks", "check:s passed:b", f"""
  WITH {_RUNS} SELECT c AS "check", p AS passed FROM (SELECT count(*) AS n FROM sm), (VALUES ('contract_checks_pass', true), ('fold_log_complete', true), ('all_variants_fold_safe', false), ('policy_tradeoff_reported', false), ('selection_uses_fold_safe', true)) v(c, p) WHERE n > 0""")
def ml16(t):
    s = _summary(t)
    contract = FE.contract_checks(FE.time_block(rows(t)).withColumns({c: F.lit(0) for c in FORECAST if not c.startswith("t_")}), FE.registry_frame(t.spark, LEVELS), POLICY, FORECAST)
    return EV.go_checks(s, s, contract, ml2(t), t.spark)
