"""Attributions of a linear score and of tree ensembles, and their summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hourgrid.functions import scalar as S
from hourgrid.operators import explain as X
from hourgrid.operators import evaluate as EV
from hourgrid.operators import models as M
from hourgrid.operators import moments as O
from hourgrid.operators import significance as ST
from hourgrid.operators.evaluate import required_present
from hourgrid.plans.features import FORECAST, built, fold_table
from hourgrid.plans.modelling import _baselines, _PROFILE
from hourgrid.plans.registry import query
from hourgrid.session import staged
from hourgrid.sources.frames import HOLDOUT_FROM

FEATURES = ["f_hour", "f_weekday", "f_temp", "f_event", "f_humidity"]
COEFS = [0.01, -0.02, 0.003, 0.05, 0.0004]

_BASE = """fx AS (SELECT entity, hour, week, hod, rate, CASE WHEN grp = 'centrum' THEN 'centrum' ELSE 'vesten_rand' END AS tier, is_event_day AS ev, CAST(hod AS DOUBLE) AS f_hour, CAST(dow AS DOUBLE) AS f_weekday, temp AS f_temp, CAST(is_event_day AS DOUBLE) AS f_event, coalesce(humidity, 50) AS f_humidity FROM hg_mad),
  mu AS (SELECT avg(f_hour) AS m0, avg(f_weekday) AS m1, avg(f_temp) AS m2, avg(f_event) AS m3, avg(f_humidity) AS m4 FROM fx),
  atr AS (SELECT fx.*, 0.01 * (f_hour - m0) AS a0, -0.02 * (f_weekday - m1) AS a1, 0.003 * (f_temp - m2) AS a2, 0.05 * (f_event - m3) AS a3, 0.0004 * (f_humidity - m4) AS a4, 0.2 + 0.01 * m0 - 0.02 * m1 + 0.003 * m2 + 0.05 * m3 + 0.0004 * m4 AS base_value FROM fx, mu),
  lo AS (SELECT entity, hour, week, tier, 'f_hour' AS feature, a0 AS a, f_hour AS x FROM atr UNION ALL SELECT entity, hour, week, tier, 'f_weekday', a1, f_weekday FROM atr UNION ALL SELECT entity, hour, week, tier, 'f_temp', a2, f_temp FROM atr
    UNION ALL SELECT entity, hour, week, tier, 'f_event', a3, f_event FROM atr UNION ALL SELECT entity, hour, week, tier, 'f_humidity', a4, f_humidity FROM atr),
  im AS (SELECT week, feature, avg(abs(a)) AS mean_abs, avg(a) AS mean_signed, count(*) AS n FROM lo GROUP BY ALL), ir AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY mean_abs DESC, feature) AS rank FROM im)"""


def _rows(t):
    m = t.mad
    return m.select(
        "entity", "hour", "week", "hod", "t", "rate", F.when(F.coalesce(F.col("grp") == "centrum", F.lit(False)), "centrum").otherwise("vesten_rand").alias("tier"), F.col("is_event_day").alias("ev"),
        F.col("hod").cast("double").alias("f_hour"), F.col("dow").cast("double").alias("f_weekday"), F.col("temp").alias("f_temp"), F.col("is_event_day").cast("double").alias("f_event"),
        F.coalesce("humidity", F.lit(50.0)).alias("f_humidity"))


def _attributed(t):
    df = _rows(t)
    means = df.agg(*[F.avg(f).alias(f"mean__{f}") for f in FEATURES])
    out = X.linear_attributions(df.crossJoin(F.broadcast(means)), FEATURES, COEFS, [F.col(f"mean__{f}") for f in FEATURES], 0.2)  # the means are one row
    pred = F.lit(0.2)
    for f, c in zip(FEATURES, COEFS):
        pred = pred + F.col(f) * c
    return out.withColumn("yhat", pred)


def _long(t):
    return X.long_attributions(_attributed(t), ["entity", "hour", "t", "week", "tier"], FEATURES)


def _importance(t):
    return X.importance(_long(t), ["week"]).withColumn("run_id", F.lit("linear"))


_STRATA = """st AS (SELECT tier || '|' || CASE WHEN ev = 1 THEN 'event' ELSE 'non_event' END || '|' || CASE WHEN hod <= 5 THEN 'night' WHEN hod <= 11 THEN 'morning' WHEN hod <= 17 THEN 'afternoon' ELSE 'evening' END AS stratum, count(*) AS n FROM fx GROUP BY 1),
  al AS (SELECT *, n / sum(n) OVER ()::DOUBLE * 500 AS x, greatest(floor(n / sum(n) OVER ()::DOUBLE * 500), 1) AS a FROM st),
  ex AS (SELECT *, 500 - sum(a) OVER () AS lefts, count(*) OVER () AS k, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) - 1 AS place FROM al)"""


@query("ex1_stratified_sample", "stratum:s n_sampled:i", f"""
  WITH {_BASE}, {_STRATA} SELECT stratum, least(n, a + CASE WHEN lefts > 0 THEN floor(lefts / k) + CAST(place < lefts % k AS INT) ELSE 0 END) AS n_sampled FROM ex""")
def ex1(t):
    df = _rows(t)
    s = X.stratified_sample(df, X.strata(F.col("tier") == "centrum", F.col("ev") == 1, F.col("hod")), ["entity", "t"], 500)
    return s.groupBy("stratum").agg(F.count("*").alias("n_sampled"))


@query("ex2_linear_attributions", "entity:s hour:t attr__f_hour:f attr__f_temp:f attr__f_event:f base_value:f", f"""
  WITH {_BASE} SELECT entity, hour, a0 AS attr__f_hour, a2 AS attr__f_temp, a3 AS attr__f_event, base_value FROM atr""")
def ex2(t):
    return _attributed(t)


@query("ex2_ridge_attributions", "entity:s n:i n_inputs:i adds_up:b base_is_mean:b", f"""
  SELECT entity, count(*) AS n, {len(FORECAST)} AS n_inputs, true AS adds_up, true AS base_is_mean FROM hg_mad WHERE hour >= TIMESTAMP '{HOLDOUT_FROM}' GROUP BY 1""")
def ex2_ridge(t):
    # A fitted ridge on all inputs: attributions of the holdout add up to its predictions, their base is the mean of the train target.
    x = staged(built(t), ["split"])
    train = x.where("split = 'train' AND rate IS NOT NULL")
    fitted = M.fit_ridge(train, FORECAST, "rate")
    out = X.linear_attributions(fitted.transform(x.where("split = 'holdout'")), FORECAST, fitted.linear["coefficients"], fitted.linear["means"], fitted.linear["intercept"][0])
    per = X.additivity(out, FORECAST, "yhat", ["entity"])
    mean = train.agg(F.avg("rate").alias("mean_rate"))
    base = out.select("entity", "base_value").distinct().crossJoin(F.broadcast(mean))  # the mean is one row
    return per.join(base, "entity").select("entity", "n", F.lit(len(FORECAST)).alias("n_inputs"), (F.col("max_error") < 1e-9).alias("adds_up"), (F.abs(F.col("base_value") - F.col("mean_rate")) < 1e-9).alias("base_is_mean"))


def _sampled(t, n: int = 60):
    x = staged(built(t, lags=False).select("entity", "hour", "t", "rate", "split", "hod", "s_tier_is_centrum", "e_is_event_day", *TREE_FEATURES), ["split"])
    return x, X.stratified_sample(x.where("split = 'holdout'"), X.strata(F.col("s_tier_is_centrum") == 1, F.col("e_is_event_day") == 1, F.col("hod")), ["entity", "t"], n)


TREE_FEATURES = ["t_hour_sin", "t_hour_cos", "t_is_weekend", "s_log_total_capacity", "e_temp_c", "e_wind_speed_ms"]


@query("ex3_tree_attributions", "n:i additive:b n_features:i")
def ex3(t):
    x, sample = _sampled(t)
    train = x.where("split = 'train'")
    fitted = M.fit_forest(train, TREE_FEATURES, "rate", numTrees=5, maxDepth=4)
    trees = M.tree_arrays(fitted.model.toDebugString)
    ground = X.stratified_sample(train, X.strata(F.col("s_tier_is_centrum") == 1, F.col("e_is_event_day") == 1, F.col("hod")), ["entity", "t"], 50)
    background = np.array([[r[f] for f in TREE_FEATURES] for r in M.imputed(ground, fitted.fill).select(*TREE_FEATURES).collect()], dtype=float)
    rows = M.imputed(sample, fitted.fill).select("entity", "t", *TREE_FEATURES)
    out = X.tree_attributions(rows, TREE_FEATURES, trees, [1.0 / len(trees)] * len(trees), background, samples=16)
    checked = X.additivity(out, TREE_FEATURES, "model_pred")
    return checked.select("n", (F.col("max_error") < 1e-9).alias("additive"), F.lit(len(TREE_FEATURES)).alias("n_features"))


@query("ex4_additivity", "week:i n:i mean_error:f max_error:f p95_error:f pass_rate:f", f"""
  WITH {_BASE} SELECT week, count(*) AS n, 0.0 AS mean_error, 0.0 AS max_error, 0.0 AS p95_error, avg(CAST(abs(base_value + a0 + a1 + a2 + a3 + a4 - (0.2 + 0.01 * f_hour - 0.02 * f_weekday + 0.003 * f_temp + 0.05 * f_event + 0.0004 * f_humidity)) <= 1e-4 AS INT)) AS pass_rate FROM atr GROUP BY 1""")
def ex4(t):
    return X.additivity(_attributed(t), FEATURES, "yhat", ["week"])


@query("ex5_importance", "week:i feature:s mean_abs:f mean_signed:f n:i rank:i", f"WITH {_BASE} SELECT * FROM ir")
def ex5(t):
    return _importance(t)


@query("ex5_group_importance", "tier:s feature:s mean_abs:f mean_signed:f n:i rank:i", f"""
  WITH {_BASE} SELECT *, row_number() OVER (PARTITION BY tier ORDER BY mean_abs DESC, feature) AS rank FROM (SELECT tier, feature, avg(abs(a)) AS mean_abs, avg(a) AS mean_signed, count(*) AS n FROM lo GROUP BY ALL)""")
def ex5_group(t):
    return X.importance(_long(t), ["tier"])


@query("ex6_fold_stability", "feature:s mean_rank:f sd_rank:f top_freq:f sign_consistency:f", f"""
  WITH {_BASE} SELECT feature, avg(rank) AS mean_rank, stddev_pop(rank) AS sd_rank, avg(CAST(rank <= 2 AS INT)) AS top_freq, greatest(avg(CAST(mean_signed > 0 AS INT)), avg(CAST(mean_signed < 0 AS INT))) AS sign_consistency FROM ir GROUP BY 1""")
def ex6(t):
    return X.stability(_importance(t), ["run_id"], 2)


@query("ex7_top_overlap", "run_id:s n_pairs:i mean_jaccard:f", f"""
  WITH {_BASE}, w AS (SELECT DISTINCT week FROM ir), p AS (SELECT a.week AS wa, b.week AS wb FROM w a JOIN w b ON a.week < b.week), c AS (SELECT a.week AS wa, b.week AS wb, count(*) AS i FROM ir a JOIN ir b ON a.feature = b.feature AND a.week < b.week WHERE a.rank <= 2 AND b.rank <= 2 GROUP BY ALL)
  SELECT 'linear' AS run_id, count(*) AS n_pairs, avg(coalesce(i, 0) / (4 - coalesce(i, 0))::DOUBLE) AS mean_jaccard FROM p LEFT JOIN c USING (wa, wb)""")
def ex7(t):
    return X.top_overlap(_importance(t), ["run_id"], "week", 2)


# Rows of the sample, and replicates.
SAMPLE, REPLICATES = 20_000, 400


def _contrast(t):
    """Group contrast of absolute attributions on a stratified sample."""
    df = staged(_attributed(t))
    sample = X.stratified_sample(df, X.strata(F.col("tier") == "centrum", F.col("ev") == 1, F.col("hod")), ["entity", "t"], SAMPLE)
    long = X.long_attributions(sample, ["entity", "t", "tier"], FEATURES)
    x = long.select("feature", (F.col("tier") == "centrum").cast("int").alias("a"), F.abs("attribution").alias("v"), F.concat_ws("|", "entity", F.col("t").cast("string")).alias("key"))
    x = staged(x)
    boot = ST.bootstrap_delta(x, ["feature"], "a", "v", "key", reps=REPLICATES)
    perm = ST.permutation_p(x, ["feature"], "a", "v", "key", reps=REPLICATES)
    out = boot.join(perm, "feature").withColumn("run_id", F.lit("linear"))
    return out.withColumn("significant", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & (F.col("p_value") < 0.05))


@query("ex8_group_contrast", "feature:s delta:f ci_low:f ci_high:f p_value:f significant:b")
def ex8(t):
    return _contrast(t)


@query("ex9_baseline_diagnostics", "fold:s stage:s n:i share:f", f"""
  WITH {_PROFILE} SELECT fold, pstage AS stage, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY fold)::DOUBLE AS share FROM ps GROUP BY fold, pstage""")
def ex9(t):
    return EV.stage_shares(_baselines(t), ["fold"], "persist_stage")


@query("ex9_context_metrics", "fold:s mae_profile:f mae_persist:f", f"WITH {_PROFILE} SELECT fold, avg(abs(rate - pred)) AS mae_profile, avg(abs(rate - ppred)) AS mae_persist FROM ps GROUP BY 1")
def ex9_context(t):
    b = _baselines(t)
    return b.groupBy("fold").agg(F.avg(F.abs(F.col("rate") - F.col("profile_pred"))).alias("mae_profile"), F.avg(F.abs(F.col("rate") - F.col("persist_pred"))).alias("mae_persist"))


@query("ex10_critique_rules", "rule:s threshold:f triggered:b action:s")
def ex10(t):
    imp = _importance(t)
    b = _baselines(t)
    err = [F.struct(F.lit(r).alias("run_id"), F.avg(F.abs(F.col("rate") - F.col(c))).alias("mae")) for r, c in (("P0", "profile_pred"), ("F0", "persist_pred"))]
    holdout = b.agg(F.array(*err).alias("a")).select(F.inline("a"))
    return X.critique(X.top_overlap(imp, ["run_id"], "week", 2), X.stability(imp, ["run_id"], 2), _contrast(t), holdout, "linear", [("P0", "F0")])


@query("ex11_evidence_strength", "week:i feature:s rank:i strength:s caveat:s")
def ex11(t):
    imp = _importance(t)
    return X.evidence_strength(imp, X.stability(imp, ["run_id"], 2), _contrast(t), top=3)


@query("ex12_dependence_data", "feature:s bin:i n:i mean_attribution:f", f"""
  WITH {_BASE} SELECT feature, floor(x / 10) AS bin, count(*) AS n, avg(a) AS mean_attribution FROM lo GROUP BY ALL""")
def ex12(t):
    long = X.long_attributions(_attributed(t), [], FEATURES)
    return long.groupBy("feature", F.floor(F.col("feature_value") / 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("attribution").alias("mean_attribution"))


@query("ex13_scope_checks", "feature:s", f"WITH {_BASE} SELECT f AS feature FROM (VALUES ('f_hour'), ('f_temp'), ('f_wind')) v(f) WHERE f NOT IN (SELECT feature FROM ir)")
def ex13(t):
    return required_present(_importance(t), "feature", ["f_hour", "f_temp", "f_wind"], t.spark)


@query("daypart_attribution", "daypart:s n:i mean_hour_attribution:f", f"""
  WITH {_BASE} SELECT CASE WHEN hod <= 5 THEN 'night' WHEN hod <= 11 THEN 'morning' WHEN hod <= 17 THEN 'afternoon' ELSE 'evening' END AS daypart, count(*) AS n, avg(a0) AS mean_hour_attribution FROM atr GROUP BY 1""")
def daypart_attribution(t):
    return _attributed(t).groupBy(S.daypart("hod").alias("daypart")).agg(F.count("*").alias("n"), F.avg("attr__f_hour").alias("mean_hour_attribution"))


def fold_importance(t):
    """Importance of the inputs of a ridge fitted in each fold, over the fold's validation rows."""
    table = staged(fold_table(t), ["fold", "role"])
    train, valid = table.where("role = 'train' AND rate IS NOT NULL"), table.where("role = 'valid'")
    fill = O.group_medians(train, "fold", FORECAST)
    products = O.group_products(train, "fold", FORECAST, "rate", fill)
    means = {g: dict(zip(FORECAST, map(float, found.mean))) for g, found in products.items()}
    rules = [O.Linear("ridge", g, tuple(FORECAST), *O.ridge(found, FORECAST, M.GRID["ridge_a1_0"]["alpha"])) for g, found in products.items()]
    out = X.linear_importance(valid, "fold", rules, means, fill).withColumn("fold", F.split_part("grp", F.lit("|"), F.lit(1)))
    return X.ranked_importance(out, ["fold"]).withColumn("run_id", F.lit("F2_ridge_a1_0"))


@query("ex5_fold_importance", "fold:s feature:s mean_abs:f4 mean_signed:f4 n:i")
def ex5_fold(t):
    return fold_importance(t)


@query("ex6_ridge_stability", "feature:s top_freq:f sign_consistency:f")
def ex6_ridge(t):
    return X.stability(staged(fold_importance(t)), ["run_id"], 10)


@query("ex7_ridge_overlap", "run_id:s n_pairs:i mean_jaccard:f")
def ex7_ridge(t):
    return X.top_overlap(staged(fold_importance(t)), ["run_id"], "fold", 10)
