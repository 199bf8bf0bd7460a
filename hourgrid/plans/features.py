"""Feature engineering with train-only parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import features as FE
from hourgrid.operators.evaluate import split_label
from hourgrid.operators.panel import fold_rows
from hourgrid.plans.registry import query
from hourgrid.sources.frames import HOLDOUT_FROM

LEVELS = ["click", "error", "purchase", "signup", "view"]
POLICY = [f.name for f in FE.catalogue(LEVELS) if f.block != "L"]
FORECAST = [f.name for f in FE.catalogue(LEVELS)]


def rows(t):
    """Panel with all columns the blocks need."""
    df = t.mad.withColumns({"month": F.month("hour"), "year": F.year("hour")})
    return df.select("entity", "hour", "t", "day", "week", "rate", "hod", "dow", "month", "year", "capacity", "grp", "temp", "precip", "wind", "gust", "sun_minutes",
                     "shortwave", "humidity", "is_event_day", "is_football_day", "is_national_holiday", "is_other_holiday", "is_school_vacation", "event_scale_max",
                     "n_concurrent_events", "kickoff_hour")


def split_rows(t):
    return split_label(rows(t), "hour", HOLDOUT_FROM)


def built(t, lags: bool = True):
    """All blocks, parameters from the train split."""
    df = split_rows(t)
    return FE.build(df, FE.fit(df.where("split = 'train'"), levels=LEVELS), LEVELS, lags=lags)


def fold_table(t, lags: bool = True):
    """All blocks per fold, parameters from each fold's train rows."""
    df = fold_rows(rows(t), t.folds)
    return FE.build(df, FE.fit(df.where("role = 'train'"), ["fold"], levels=LEVELS), LEVELS, ["fold"], lags)


_TIME = """tb AS (SELECT *, CASE WHEN is_event_day = 1 THEN 'event_day' WHEN is_national_holiday + is_other_holiday > 0 THEN 'holiday' WHEN is_school_vacation = 1 THEN 'school_vacation' WHEN dow >= 5 THEN 'weekend_regular' ELSE 'weekday_regular' END AS dc FROM hg_mad)"""


@query("fe1_time_block", "entity:s hour:t t_hour_sin:f t_weekday_cos:f t_month_sin:f t_is_weekend:i t_is_any_holiday:i t_day_class_5:s t_day_class_5__holiday:i t_season__winter:i t_is_2020_regime:i", f"""
  WITH {_TIME} SELECT entity, hour, sin(2 * pi() * hod / 24) AS t_hour_sin, cos(2 * pi() * dow / 7) AS t_weekday_cos, sin(2 * pi() * month(hour) / 12) AS t_month_sin, CAST(dow >= 5 AS INT) AS t_is_weekend,
  CAST(is_national_holiday + is_other_holiday > 0 AS INT) AS t_is_any_holiday, dc AS t_day_class_5, CAST(dc = 'holiday' AS INT) AS t_day_class_5__holiday, CAST(month(hour) IN (12, 1, 2) AS INT) AS t_season__winter, 0 AS t_is_2020_regime FROM tb""")
def fe1(t):
    return FE.time_block(rows(t))


_TRAIN = f"hour < TIMESTAMP '{HOLDOUT_FROM}'"
_PARAMS = """SELECT {by} quantile_cont(capacity, 0) AS c0, quantile_cont(capacity, 1 / 3.0::DOUBLE) AS c1, quantile_cont(capacity, 2 / 3.0::DOUBLE) AS c2, quantile_cont(capacity, 1) AS c3,
  quantile_cont(precip, 0.5) FILTER (WHERE precip > 0) AS precip_q50, quantile_cont(precip, 0.9) FILTER (WHERE precip > 0) AS precip_q90, quantile_cont(wind, 0.9) AS wind_q90, quantile_cont(gust, 0.9) AS gust_q90,
  greatest(CAST(floor(quantile_cont(n_concurrent_events, 0.95)) AS INT), 1) AS concurrency_cap"""
_PAR = f"par AS ({_PARAMS.format(by='')} FROM (SELECT * REPLACE (CAST(capacity AS DOUBLE) AS capacity, CAST(n_concurrent_events AS DOUBLE) AS n_concurrent_events) FROM hg_mad) WHERE {_TRAIN})"


@query("fe2_space_block", "entity:s s_tier_is_centrum:i s_tier_is_rand:i s_log_total_capacity:f s_capacity_bucket:s s_capacity_bucket__medium:i s_parking_id__view:i n:i", f"""
  WITH {_PAR}, x AS (SELECT *, CASE WHEN capacity < c0 OR capacity > c3 THEN NULL WHEN NOT (c0 < c1 AND c1 < c2 AND c2 < c3) THEN 'small' WHEN capacity <= c1 THEN 'small' WHEN capacity <= c2 THEN 'medium' ELSE 'large' END AS b FROM hg_mad, par)
  SELECT entity, max(CAST(coalesce(grp = 'centrum', false) AS INT)) AS s_tier_is_centrum, max(CAST(coalesce(grp = 'rand', false) AS INT)) AS s_tier_is_rand, max(ln(1 + capacity)) AS s_log_total_capacity, max(b) AS s_capacity_bucket,
  max(CAST(coalesce(b = 'medium', false) AS INT)) AS s_capacity_bucket__medium, max(CAST(entity = 'view' AS INT)) AS s_parking_id__view, count(*) AS n FROM x GROUP BY 1""")
def fe2(t):
    df = split_rows(t)
    out = FE.space_block(FE.with_params(df, FE.fit(df.where("split = 'train'"), levels=LEVELS)), LEVELS)
    cols = ["s_tier_is_centrum", "s_tier_is_rand", "s_log_total_capacity", "s_capacity_bucket", "s_capacity_bucket__medium", "s_parking_id__view"]
    return out.groupBy("entity").agg(*[F.max(c).alias(c) for c in cols], F.count("*").alias("n"))


@query("fe3_fit_params_by_fold", "fold:s c0:f c1:f c2:f c3:f precip_q50:f precip_q90:f wind_q90:f gust_q90:f concurrency_cap:i n_levels:i", f"""
  {_PARAMS.format(by='fold,')}, count(DISTINCT entity) AS n_levels FROM (SELECT * REPLACE (CAST(capacity AS DOUBLE) AS capacity, CAST(n_concurrent_events AS DOUBLE) AS n_concurrent_events) FROM hg_mad), hg_folds WHERE hour < train_end_before GROUP BY fold""")
def fe3(t):
    p = FE.fit(fold_rows(rows(t), t.folds).where("role = 'train'"), ["fold"], levels=LEVELS)
    return p.select("*", *[F.get("capacity_edges", F.lit(i)).alias(f"c{i}") for i in range(4)], F.size("entity_levels").alias("n_levels"))


@query("fe4_external_block", "entity:s hour:t e_temp_c_sq:f4 e_precip_bin:s e_precip_bin__heavy:i e_is_high_wind_speed:i e_is_high_wind_gust:i e_sun_duration_ratio:f e_sun_intensity_log1p:f e_event_scale_is_large:i e_n_concurrent_events_capped:f e_has_football_kickoff:i e_football_kickoff_hour_sin:f", f"""
  WITH {_PAR}, x AS (SELECT *, CASE WHEN precip = 0 THEN 'dry' WHEN precip <= precip_q50 THEN 'light' WHEN precip <= precip_q90 THEN 'moderate' WHEN precip > precip_q90 THEN 'heavy' ELSE 'unknown' END AS b FROM hg_mad, par)
  SELECT entity, hour, temp * temp AS e_temp_c_sq, b AS e_precip_bin, CAST(b = 'heavy' AS INT) AS e_precip_bin__heavy, CAST(coalesce(wind >= wind_q90, false) AS INT) AS e_is_high_wind_speed, CAST(coalesce(gust >= gust_q90, false) AS INT) AS e_is_high_wind_gust,
  CASE WHEN sun_minutes IS NOT NULL THEN least(sun_minutes / 60, 1) END AS e_sun_duration_ratio, CASE WHEN shortwave IS NOT NULL THEN ln(1 + greatest(shortwave, 0)) END AS e_sun_intensity_log1p, CAST(event_scale_max >= 2 AS INT) AS e_event_scale_is_large,
  least(n_concurrent_events, concurrency_cap) AS e_n_concurrent_events_capped, CAST(kickoff_hour IS NOT NULL AS INT) AS e_has_football_kickoff, sin(2 * pi() * coalesce(kickoff_hour, 0) / 24) AS e_football_kickoff_hour_sin FROM x""")
def fe4(t):
    df = split_rows(t)
    return FE.external_block(FE.with_params(df, FE.fit(df.where("split = 'train'"), levels=LEVELS)))


@query("fe5_interactions", "entity:s e_int_event_x_tier_centrum:i e_int_holiday_x_tier_centrum:i e_int_vacation_x_tier_centrum:i e_int_temp_x_season__winter:f4 e_int_wind_x_season__summer:f4", """
  SELECT entity, sum(is_event_day * c) AS e_int_event_x_tier_centrum, sum(CAST(is_national_holiday + is_other_holiday > 0 AS INT) * c) AS e_int_holiday_x_tier_centrum, sum(is_school_vacation * c) AS e_int_vacation_x_tier_centrum,
  sum(temp) AS e_int_temp_x_season__winter, 0 AS e_int_wind_x_season__summer FROM (SELECT *, CAST(coalesce(grp = 'centrum', false) AS INT) AS c FROM hg_mad) GROUP BY 1""")
def fe5(t):
    df = split_rows(t)
    x = FE.with_params(df, FE.fit(df.where("split = 'train'"), levels=LEVELS))
    x = FE.interaction_block(FE.external_block(FE.space_block(FE.time_block(x), LEVELS)))
    cols = ["e_int_event_x_tier_centrum", "e_int_holiday_x_tier_centrum", "e_int_vacation_x_tier_centrum", "e_int_temp_x_season__winter", "e_int_wind_x_season__summer"]
    return x.groupBy("entity").agg(*[F.sum(c).alias(c) for c in cols])


_PROX = """line AS (SELECT hour, max(is_event_day) AS e FROM hg_mad GROUP BY 1), ev AS (SELECT hour AS eh FROM line WHERE e = 1),
  px AS (SELECT l.hour, e, coalesce(least((epoch(n.eh) - epoch(l.hour)) / 3600, 72), CASE WHEN n.eh IS NULL THEN 73 END) AS nx, coalesce(least((epoch(l.hour) - epoch(p.eh)) / 3600, 72), CASE WHEN p.eh IS NULL THEN 73 END) AS pv, n.eh AS ne, p.eh AS pe
    FROM line l ASOF LEFT JOIN ev p ON l.hour >= p.eh ASOF LEFT JOIN ev n ON l.hour <= n.eh),
  prox AS (SELECT hour, e, CASE WHEN ne IS NULL THEN 73 ELSE nx END AS too, CASE WHEN pe IS NULL THEN 73 ELSE pv END AS since FROM px)"""


@query("fe6_event_proximity", "hour:t e_hours_to_event_clip:i e_hours_since_event_clip:i e_event_proximity_clip:i e_event_window_pre_24h:i e_event_window_post_24h:i", f"""
  WITH {_PROX} SELECT hour, too AS e_hours_to_event_clip, since AS e_hours_since_event_clip, least(too, since) AS e_event_proximity_clip, CAST(e = 0 AND too <= 24 AS INT) AS e_event_window_pre_24h, CAST(e = 0 AND since <= 24 AS INT) AS e_event_window_post_24h FROM prox""")
def fe6(t):
    return FE.event_proximity(rows(t)).withColumn("hour", F.timestamp_seconds("t"))


_LAGS = """lg AS (SELECT a.entity, a.hour, a.rate, b.rate AS l1, c.rate AS l24, d.rate AS l168 FROM hg_panel a LEFT JOIN hg_panel b ON b.entity = a.entity AND b.hour = a.hour - INTERVAL 1 HOUR
  LEFT JOIN hg_panel c ON c.entity = a.entity AND c.hour = a.hour - INTERVAL 24 HOUR LEFT JOIN hg_panel d ON d.entity = a.entity AND d.hour = a.hour - INTERVAL 168 HOUR),
  rl AS (SELECT entity, hour, CASE WHEN count(rate) OVER w = 24 THEN avg(rate) OVER w END AS rm FROM hg_panel WINDOW w AS (PARTITION BY entity ORDER BY hour RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)),
  lv AS (SELECT lg.*, rm, CAST(l1 IS NOT NULL AND l24 IS NOT NULL AND l168 IS NOT NULL AS INT) AS core, CAST(rm IS NOT NULL AS INT) AS roll FROM lg JOIN rl USING (entity, hour))"""


@query("fe7_lag_features", "entity:s hour:t l_occ_lag_1h:f l_occ_lag_24h:f l_occ_lag_168h:f l_occ_lag_delta_1h_24h:f l_occ_lag_delta_24h_168h:f", f"""
  WITH {_LAGS} SELECT entity, hour, l1 AS l_occ_lag_1h, l24 AS l_occ_lag_24h, l168 AS l_occ_lag_168h, l1 - l24 AS l_occ_lag_delta_1h_24h, l24 - l168 AS l_occ_lag_delta_24h_168h FROM lv""")
def fe7(t):
    return FE.lag_block(t.panel.select("entity", "hour", "t", "rate"))


@query("fe8_rolling_features", "entity:s hour:t l_occ_rollmean_24h_strict:f", f"WITH {_LAGS} SELECT entity, hour, rm AS l_occ_rollmean_24h_strict FROM lv")
def fe8(t):
    return FE.lag_block(t.panel.select("entity", "hour", "t", "rate"))


@query("fe9_lag_validity", "entity:s n:i n_core:i n_roll:i n_both:i", f"WITH {_LAGS} SELECT entity, count(*) AS n, sum(core) AS n_core, sum(roll) AS n_roll, sum(core * roll) AS n_both FROM lv GROUP BY 1")
def fe9(t):
    x = FE.lag_block(t.panel.select("entity", "hour", "t", "rate"))
    return x.groupBy("entity").agg(F.count("*").alias("n"), F.sum("l_valid_all_core").alias("n_core"), F.sum("l_valid_roll24_strict").alias("n_roll"), F.sum("l_valid_core_plus_roll24").alias("n_both"))


@query("pf11_row_filter", "row_filter:s n:i mean_rate:f", f"""
  WITH {_LAGS} SELECT 'none' AS row_filter, count(*) AS n, avg(rate) AS mean_rate FROM lv UNION ALL SELECT 'l_valid_all_core==1', count(*), avg(rate) FROM lv WHERE core = 1 UNION ALL SELECT 'l_valid_core_plus_roll24==1', count(*), avg(rate) FROM lv WHERE core * roll = 1""")
def pf11(t):
    x = FE.lag_block(t.panel.select("entity", "hour", "t", "rate"))
    # One pass: a row counts under every filter it passes.
    arms = [F.when(F.lit(True) if k == "none" else F.col(c) == 1, F.lit(k)) for k, c in FE.ROW_FILTERS.items()]
    long = x.select("rate", F.explode(F.filter(F.array(*arms), lambda k: k.isNotNull())).alias("row_filter"))
    return long.groupBy("row_filter").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"))


@query("fe10_fold_safe_blocks", "fold:s role:s n:i n_heavy:i n_high_wind:i n_medium:i n_pre:i n_lag1:i n_both:i", """
  WITH f AS (SELECT fold, CASE WHEN hour < train_end_before THEN 'train' ELSE 'valid' END AS role, m.* REPLACE (CAST(capacity AS DOUBLE) AS capacity) FROM hg_mad m, hg_folds WHERE hour < train_end_before OR hour BETWEEN valid_start AND valid_end),
  p AS (SELECT fold, quantile_cont(capacity, 0) AS c0, quantile_cont(capacity, 1 / 3.0::DOUBLE) AS c1, quantile_cont(capacity, 2 / 3.0::DOUBLE) AS c2, quantile_cont(capacity, 1) AS c3, quantile_cont(precip, 0.9) FILTER (WHERE precip > 0) AS q90, quantile_cont(wind, 0.9) AS w90 FROM f WHERE role = 'train' GROUP BY 1),
  l AS (SELECT fold, hour, max(is_event_day) AS e FROM f GROUP BY ALL), n AS (SELECT a.fold, a.hour, CAST(a.e = 0 AND min(b.hour) - a.hour <= INTERVAL 24 HOUR AS INT) AS pre FROM l a LEFT JOIN l b ON b.fold = a.fold AND b.e = 1 AND b.hour >= a.hour GROUP BY a.fold, a.hour, a.e),
  r AS (SELECT fold, entity, hour, count(rate) OVER w AS c FROM f WINDOW w AS (PARTITION BY fold, entity ORDER BY hour RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING))
  SELECT f.fold, f.role, count(*) AS n, count(*) FILTER (WHERE f.precip > q90) AS n_heavy, count(*) FILTER (WHERE f.wind >= w90) AS n_high_wind, count(*) FILTER (WHERE c0 < c1 AND c1 < c2 AND c2 < c3 AND f.capacity > c1 AND f.capacity <= c2) AS n_medium, sum(coalesce(pre, 0)) AS n_pre,
  count(g.rate) AS n_lag1, count(*) FILTER (WHERE g.rate IS NOT NULL AND h.rate IS NOT NULL AND k.rate IS NOT NULL AND r.c = 24) AS n_both FROM f JOIN p USING (fold) JOIN n USING (fold, hour) JOIN r USING (fold, entity, hour)
  LEFT JOIN f g ON g.fold = f.fold AND g.entity = f.entity AND g.hour = f.hour - INTERVAL 1 HOUR LEFT JOIN f h ON h.fold = f.fold AND h.entity = f.entity AND h.hour = f.hour - INTERVAL 24 HOUR LEFT JOIN f k ON k.fold = f.fold AND k.entity = f.entity AND k.hour = f.hour - INTERVAL 168 HOUR GROUP BY ALL""")
def fe10(t):
    x = fold_table(t)
    return x.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.sum("e_precip_bin__heavy").alias("n_heavy"), F.sum("e_is_high_wind_speed").alias("n_high_wind"), F.sum("s_capacity_bucket__medium").alias("n_medium"),
        F.sum("e_event_window_pre_24h").alias("n_pre"), F.count("l_occ_lag_1h").alias("n_lag1"), F.sum("l_valid_core_plus_roll24").alias("n_both"))


@query("fe11_feature_registry", "block:s requires_fit:b n_features:i n_present:i n_rows:i")
def fe11(t):
    x = built(t)
    present = [f for f in FORECAST if f in x.columns]
    counts = x.agg(F.count("*").alias("n_rows"))
    reg = FE.registry_frame(t.spark, LEVELS).withColumn("present", F.col("feature_name").isin(present))
    return reg.groupBy("block", "requires_fit").agg(F.count("*").alias("n_features"), F.count_if("present").alias("n_present")).crossJoin(F.broadcast(counts))


@query("fe12_contract_checks", "check:s result:s", """
  SELECT c AS "check", 'PASS' AS result FROM (SELECT count(*) FILTER (WHERE NOT rate BETWEEN 0 AND 1) AS bad FROM hg_panel), (VALUES ('no_lag_in_policy_set'), ('five_lag_inputs'), ('no_forbidden_names'), ('columns_present'), ('no_duplicate_inputs'), ('target_in_range'), ('one_day_class'), ('all_inputs_registered')) v(c) WHERE bad = 0""")
def fe12(t):
    return FE.contract_checks(built(t), FE.registry_frame(t.spark, LEVELS), POLICY, FORECAST)


@query("fe13_event_contract", "availability_label:s included_primary:b n_features:i n_nonzero_rows:i")
def fe13(t):
    names = [n for n in POLICY if n.startswith("e_")]
    used = built(t, lags=False).agg(*[F.count_if(F.col(n) != 0).alias(n) for n in names]).unpivot([], names, "feature_name", "n")
    c = FE.event_contract(FE.registry_frame(t.spark, LEVELS)).join(used, "feature_name")
    return c.groupBy("availability_label", "included_primary").agg(F.count("*").alias("n_features"), F.sum("n").alias("n_nonzero_rows"))


@query("fe14_sample_loss", "split:s entity:s n:i core_share:f both_share:f recovered_24h:i", f"""
  WITH {_LAGS}, s AS (SELECT *, CASE WHEN {_TRAIN} THEN 'train' ELSE 'holdout' END AS split FROM lv)
  SELECT s.split, s.entity, count(*) AS n, avg(core) AS core_share, avg(core * roll) AS both_share, count(*) FILTER (WHERE l24 IS NOT NULL AND s.split = 'holdout' AND s.hour - INTERVAL 24 HOUR < TIMESTAMP '{HOLDOUT_FROM}') AS recovered_24h FROM s GROUP BY ALL""")
def fe14(t):
    x = split_label(FE.lag_block(t.panel.select("entity", "hour", "t", "rate")), "hour", HOLDOUT_FROM)
    within = FE.lag_block(split_label(t.panel.select("entity", "hour", "t", "rate"), "hour", HOLDOUT_FROM), ["split"]).select("entity", "hour", F.col("l_occ_lag_24h").alias("own_24h"))
    y = x.join(within, ["entity", "hour"])
    gained = F.col("l_occ_lag_24h").isNotNull() & F.col("own_24h").isNull()
    return y.groupBy("split", "entity").agg(F.count("*").alias("n"), F.avg("l_valid_all_core").alias("core_share"), F.avg("l_valid_core_plus_roll24").alias("both_share"), F.count_if(gained).alias("recovered_24h"))
