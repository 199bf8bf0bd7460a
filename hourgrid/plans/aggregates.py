"""Aggregations: groups, quantiles, quality and coverage tables, error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import describe as D
from hourgrid.operators import quality as Q
from hourgrid.operators import quantile as QT
from hourgrid.operators.evaluate import cv_summary, error_metrics
from hourgrid.plans.registry import query


@query("a1_group_stats", "l_returnflag:s l_linestatus:s n:i n_orders:i mean_qty:f median_price:f sd_qty:f min_date:d max_date:d", """
  SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, avg(l_quantity) AS mean_qty,
  quantile_cont(l_extendedprice, 0.5) AS median_price, stddev_samp(l_quantity) AS sd_qty, min(l_shipdate) AS min_date, max(l_shipdate) AS max_date
  FROM lineitem GROUP BY ALL""")
def a1(t):
    keys = ["l_returnflag", "l_linestatus"]
    li = t.table("lineitem").select(*keys, "l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate")
    # Distinct orders through a pre-aggregation on (group, order): spread over orders, not over four groups.
    per = li.groupBy(*keys, "l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("ss"),
                                              F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    n, s = F.sum("n"), F.sum("s")
    base = per.groupBy(*keys).agg(n.alias("n"), F.count("*").alias("n_orders"), (s / n).alias("mean_qty"),
                                  F.sqrt((F.sum("ss") - s * s / n) / (n - 1)).alias("sd_qty"), F.min("lo").alias("min_date"), F.max("hi").alias("max_date"))
    return base.join(QT.quantiles(li, keys, "l_extendedprice", {"median_price": 0.5}), keys)


@query("a2_group_quantiles", "l_returnflag:s q25:f q75:f q95:f q99:f iqr:f", """
  SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75, quantile_cont(l_extendedprice, 0.95) AS q95,
  quantile_cont(l_extendedprice, 0.99) AS q99, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1""")
def a2(t):
    q = QT.quantiles(t.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q75": 0.75, "q95": 0.95, "q99": 0.99})
    return q.withColumn("iqr", F.col("q75") - F.col("q25"))


@query("a3_robust_profile", "entity:s n:i mean:f median:f sd:f iqr:f mad:f skew:f5 kurtosis:f5 min:f q01:f q95:f q99:f max:f cv:f outlier_pct:f", """
  WITH q AS (SELECT event_type AS entity, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd,
    quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, skewness(value) AS skew, kurtosis(value) AS kurtosis,
    min(value) AS min, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99, max(value) AS max FROM events GROUP BY 1),
  m AS (SELECT e.event_type AS entity, quantile_cont(abs(value - median), 0.5) AS mad,
    100 * avg(CAST(value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) AS INT)) AS outlier_pct FROM events e JOIN q ON q.entity = e.event_type GROUP BY 1)
  SELECT q.*, q75 - q25 AS iqr, mad, sd / mean AS cv, outlier_pct FROM q JOIN m USING (entity)""")
def a3(t):
    return D.robust_profile(t.readings, ["entity"], "value")


@query("a4_tukey_fences", "entity:s low_fence:f high_fence:f outside_pct:f", """
  WITH q AS (SELECT event_type AS entity, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
  SELECT entity, a - 1.5 * (b - a) AS low_fence, b + 1.5 * (b - a) AS high_fence,
  100 * avg(CAST(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS INT)) AS outside_pct FROM events JOIN q ON entity = event_type GROUP BY ALL""")
def a4(t):
    return D.tukey_fences(t.readings, ["entity"], "value")


@query("a5_threshold_shares", "entity:s pct_90:f pct_95:f pct_small_change:f pct_large_change:f", """
  SELECT entity, 100 * avg(CAST(rate >= 0.9 AS INT)) AS pct_90, 100 * avg(CAST(rate >= 0.95 AS INT)) AS pct_95,
  100 * avg(CAST(d < 0.05 AS INT)) AS pct_small_change, 100 * avg(CAST(d > 0.3 AS INT)) AS pct_large_change
  FROM (SELECT *, abs(rate - lag(rate) OVER (PARTITION BY entity ORDER BY hour)) AS d FROM hg_panel) GROUP BY 1""")
def a5(t):
    from hourgrid.operators.windows import previous

    df = previous(t.panel.select("entity", "t", "rate"), ["entity"], "t", ["rate"]).withColumn("d", F.abs(F.col("rate") - F.col("prev_rate")))
    return df.groupBy("entity").agg(D.pct(F.col("rate") >= 0.9).alias("pct_90"), D.pct(F.col("rate") >= 0.95).alias("pct_95"),
                                    D.pct(F.col("d") < 0.05).alias("pct_small_change"), D.pct(F.col("d") > 0.3).alias("pct_large_change"))


@query("a7_completeness", "entity:s period:i n_days:i expected:i actual:i missing:i completeness:f", """
  SELECT *, n_days * 24 AS expected, n_days * 24 - actual AS missing, round(actual / (n_days * 24)::DOUBLE, 4) AS completeness FROM (
  SELECT entity, week AS period, count(DISTINCT day) AS n_days, count(*) AS actual FROM hg_sparse GROUP BY ALL)""")
def a7(t):
    return Q.completeness(t.sparse, "entity", F.col("week"), "day")


@query("a8_coverage", "entity:s first:t last:t n:i covered_pct:f", """
  SELECT entity, min(hour) AS first, max(hour) AS last, count(*) AS n, 100.0 * count(*) / (SELECT date_diff('hour', min(hour), max(hour)) + 1 FROM hg_sparse) AS covered_pct
  FROM hg_sparse GROUP BY 1""")
def a8(t):
    df = t.sparse.select("entity", "hour", "t")
    span = df.agg(((F.max("t") - F.min("t")) / 3600 + 1).alias("span"))
    return df.groupBy("entity").agg(F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("n")).crossJoin(
        F.broadcast(span)).withColumn("covered_pct", F.col("n") * 100 / F.col("span"))


_WCOLS = ["temp", "precip", "gust", "humidity", "sun_minutes", "shortwave"]


@query("a9_missingness", "column:s null_share:f", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CAST({c} IS NULL AS INT)) AS null_share FROM hg_weather" for c in _WCOLS))
def a9(t):
    return Q.null_shares(t.weather, _WCOLS)


@query("a9_missingness_by_day", "day:d column:s null_share:f", " UNION ALL ".join(
    f"SELECT CAST(hour AS DATE) AS day, '{c}' AS \"column\", avg(CAST({c} IS NULL AS INT)) AS null_share FROM hg_weather GROUP BY 1" for c in _WCOLS))
def a9_day(t):
    return Q.null_shares(t.weather.withColumn("day", F.to_date("hour")), _WCOLS, ["day"])


@query("a10_quality_counts", "check:s n_affected:i result:s", """
  SELECT 'over_capacity' AS "check", count(*) FILTER (WHERE count_in > override) AS n_affected, CASE WHEN count(*) FILTER (WHERE count_in > override) = 0 THEN 'PASS' ELSE 'WARN' END AS result FROM hg_reported
  UNION ALL SELECT 'negative', count(*) FILTER (WHERE count_in < 0), CASE WHEN count(*) FILTER (WHERE count_in < 0) = 0 THEN 'PASS' ELSE 'WARN' END FROM hg_reported
  UNION ALL SELECT 'out_of_range', count(*) FILTER (WHERE NOT rate_in BETWEEN 0 AND 1), CASE WHEN count(*) FILTER (WHERE NOT rate_in BETWEEN 0 AND 1) = 0 THEN 'PASS' ELSE 'WARN' END FROM hg_reported
  UNION ALL SELECT 'null_rate', count(*) FILTER (WHERE rate_in IS NULL), CASE WHEN count(*) FILTER (WHERE rate_in IS NULL) = 0 THEN 'PASS' ELSE 'WARN' END FROM hg_reported""")
def a10(t):
    return Q.check_rows(t.reported, "reported", [
        ("over_capacity", F.col("count_in") > F.col("override"), "flag"), ("negative", F.col("count_in") < 0, "flag"),
        ("out_of_range", ~F.col("rate_in").between(0, 1), "mask"), ("null_rate", F.col("rate_in").isNull(), "repair")])


_QC = ["qc_temp", "qc_precip", "qc_wind", "qc_humidity"]


@query("a11_qc_states", "column:s n_true:i n_false:i n_missing:i pct_valid:f", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c}) AS n_true, count(*) FILTER (WHERE NOT {c}) AS n_false, count(*) FILTER (WHERE {c} IS NULL) AS n_missing,"
    f" 100.0 * count(*) FILTER (WHERE {c}) / count({c}) AS pct_valid FROM hg_weather" for c in _QC))
def a11(t):
    return Q.state_shares(t.weather, _QC)


@query("a12_value_shares", "event_scale_max:s n:i share:f", """
  SELECT event_scale_max, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM (SELECT nullif(event_scale_max, 0) AS event_scale_max FROM hg_mad) GROUP BY 1""")
def a12(t):
    return Q.value_shares(t.mad.select(F.nullif("event_scale_max", F.lit(0)).alias("event_scale_max")), "event_scale_max")


@query("a13_hours_on_days", "entity:s day:d expected_hours:i n_hours:i ok:b", """
  SELECT *, n_hours = expected_hours AS ok FROM (SELECT entity, day, x AS expected_hours, count(DISTINCT hod) AS n_hours FROM hg_panel
  JOIN (VALUES (DATE '2024-01-07', 23), (DATE '2024-01-14', 25), (DATE '2024-01-21', 24)) v(d, x) ON d = day GROUP BY entity, day, x)""")
def a13(t):
    expected = t.spark.sql("SELECT * FROM VALUES (date'2024-01-07', 23), (date'2024-01-14', 25), (date'2024-01-21', 24) AS v(day, expected_hours)")
    return Q.hours_per_day(t.panel, "entity", "day", "hod", expected)


@query("a13_clock_change_days", "day:d hours:i n_orders:i", """
  SELECT * FROM (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN isodow(o_orderdate) <> 7 OR day(o_orderdate) < 25 THEN 24 WHEN month(o_orderdate) = 3 THEN 23 WHEN month(o_orderdate) = 10 THEN 25 ELSE 24 END AS hours, count(*) AS n_orders FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY ALL) WHERE hours <> 24""")
def a13_clock(t):
    day = F.to_date("o_orderdate")
    days = t.table("orders").where(F.year(day) >= 1996).groupBy(day.alias("day")).agg(F.count("*").alias("n_orders"))  # the October rule began then
    return days.withColumn("hours", Q.hours_of_day(F.col("day"), "Europe/Brussels")).where("hours <> 24")


@query("a14_override_check", "entity:s max_override:i capacity:i exceeds:b", """
  SELECT entity, max(override + CAST(ksum % 41 = 0 AS INT)) AS max_override, any_value(e.capacity) AS capacity, max(override + CAST(ksum % 41 = 0 AS INT)) > any_value(e.capacity) AS exceeds
  FROM hg_reported LEFT JOIN hg_entities e USING (entity) GROUP BY 1""")
def a14(t):
    df = t.reported.withColumn("override", F.col("override") + (F.col("ksum") % 41 == 0).cast("int"))
    return Q.override_check(df, t.entities, "override")


@query("a15_merge_report", "dataset:s metric:s n:i", """
  SELECT 'mad' AS dataset, 'rows' AS metric, count(*) AS n FROM hg_mad UNION ALL SELECT 'mad', 'null_rate', count(*) FILTER (WHERE rate IS NULL) FROM hg_mad
  UNION ALL SELECT 'mad', 'any_null_weather', count(*) FILTER (WHERE temp IS NULL OR precip IS NULL OR humidity IS NULL) FROM hg_mad
  UNION ALL SELECT 'mad', 'any_null_events', count(*) FILTER (WHERE is_event_day IS NULL OR kickoff_hour IS NULL) FROM hg_mad""")
def a15(t):
    return Q.merge_report(t.mad, "mad", "rate", {"weather": ["temp", "precip", "humidity", "dew"], "events": ["is_event_day", "kickoff_hour"]})


_PRED = """pred AS (SELECT a.*, b.rate AS yhat FROM hg_mad a JOIN hg_panel b ON a.entity = b.entity AND b.hour = a.hour - INTERVAL 24 HOUR)"""


def _predictions(t):
    from hourgrid.operators.windows import exact_lags

    lagged = exact_lags(t.panel.select("entity", "hour", "t", "rate"), ["entity"], "t", "rate", [24]).select("entity", "hour", F.col("lag_24h").alias("yhat"))
    return t.mad.join(lagged.where("yhat IS NOT NULL"), ["entity", "hour"])


@query("a17_error_metrics", "week:i n:i mae:f rmse:f mape:f3 mae_inner:f mae_outer:f mae_event:f mae_non_event:f", f"""
  WITH {_PRED} SELECT week, count(*) AS n, avg(abs(rate - yhat)) AS mae, sqrt(avg((rate - yhat) ** 2)) AS rmse,
  100 * avg(abs(rate - yhat) / greatest(abs(rate), 1e-6)) AS mape, avg(abs(rate - yhat)) FILTER (WHERE grp = 'centrum') AS mae_inner,
  avg(abs(rate - yhat)) FILTER (WHERE coalesce(grp, '') <> 'centrum') AS mae_outer, avg(abs(rate - yhat)) FILTER (WHERE is_event_day = 1) AS mae_event,
  avg(abs(rate - yhat)) FILTER (WHERE is_event_day = 0) AS mae_non_event FROM pred GROUP BY 1""")
def a17(t):
    return error_metrics(_predictions(t), ["week"], "rate", "yhat", inner=F.col("grp") == "centrum", event=F.col("is_event_day") == 1)


@query("a16_cv_summary", "entity:s n_folds:i mean_mae:f sd_mae:f mean_rmse:f cv_variability_ratio:f", f"""
  WITH {_PRED}, m AS (SELECT entity, week, avg(abs(rate - yhat)) AS mae, sqrt(avg((rate - yhat) ** 2)) AS rmse FROM pred GROUP BY ALL)
  SELECT entity, count(*) AS n_folds, avg(mae) AS mean_mae, coalesce(stddev_samp(mae), 0) AS sd_mae, avg(rmse) AS mean_rmse,
  coalesce(stddev_samp(mae), 0) / avg(mae) AS cv_variability_ratio FROM m GROUP BY 1""")
def a16(t):
    m = error_metrics(_predictions(t), ["entity", "week"], "rate", "yhat", inner=F.col("grp") == "centrum", event=F.col("is_event_day") == 1)
    return cv_summary(m.withColumn("n_valid", F.col("n")), ["entity"])


@query("a18_target_consistency", "entity:s mean_abs_error:f max_abs_error:f n_capacities:i r_reported:f", """
  WITH x AS (SELECT *, count_in / nullif(override, 0)::DOUBLE AS calc FROM hg_reported)
  SELECT entity, avg(abs(rate_in - calc)) AS mean_abs_error, max(abs(rate_in - calc)) AS max_abs_error, count(DISTINCT override) AS n_capacities,
  corr(rate_in, calc) AS r_reported FROM x GROUP BY 1""")
def a18(t):
    calc = F.try_divide(F.col("count_in").cast("double"), F.col("override").cast("double"))
    x = t.reported.withColumn("calc", calc).withColumn("err", F.abs(F.col("rate_in") - F.col("calc")))
    base = x.groupBy("entity").agg(F.avg("err").alias("mean_abs_error"), F.max("err").alias("max_abs_error"), F.corr("rate_in", "calc").alias("r_reported"))
    caps = x.select("entity", "override").distinct().groupBy("entity").agg(F.count("*").alias("n_capacities"))
    return base.join(caps, "entity")


@query("a19_near_constant", "feature:s n_distinct:i top_share:f near_constant:b", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_distinct, max(n) / sum(n)::DOUBLE AS top_share, max(n) / sum(n) >= 0.9 AS near_constant FROM (SELECT {c}, count(*) AS n FROM hg_mad GROUP BY 1)"
    for c in ["hod", "weekend", "is_football_day", "event_scale_max", "grp"]))
def a19(t):
    return Q.value_concentration(t.mad, ["hod", "weekend", "is_football_day", "event_scale_max", "grp"], 0.9)


@query("a21_dataset_profile", "dataset:s n:i first:t last:t n_entities:i weeks:s", " UNION ALL ".join(
    f"SELECT '{x}' AS dataset, count(*) AS n, min(hour) AS first, max(hour) AS last, count(DISTINCT entity) AS n_entities, string_agg(DISTINCT week::VARCHAR, ',' ORDER BY week::VARCHAR) AS weeks FROM hg_{x}"
    for x in ("panel", "sparse")))
def a21(t):
    both = t.panel.select("entity", "hour", "week").withColumn("dataset", F.lit("panel")).unionByName(
        t.sparse.select("entity", "hour", "week").withColumn("dataset", F.lit("sparse")))
    per = both.groupBy("dataset", "entity").agg(F.count("*").alias("n"), F.min("hour").alias("a"), F.max("hour").alias("b"))
    weeks = both.select("dataset", F.col("week").cast("string").alias("week")).distinct().groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_list("week")), ",").alias("weeks"))
    return per.groupBy("dataset").agg(F.sum("n").alias("n"), F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("n_entities")).join(weeks, "dataset")


@query("a22_top_bottom", "lang:s side:s rank:i source:s mean_chars:f", """
  WITH m AS (SELECT lang, source, avg(n_chars) AS mean_chars FROM documents GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mean_chars DESC, source) AS hi, row_number() OVER (PARTITION BY lang ORDER BY mean_chars, source) AS lo FROM m)
  SELECT lang, 'top' AS side, hi AS rank, source, mean_chars FROM r WHERE hi <= 3 UNION ALL SELECT lang, 'bottom', lo, source, mean_chars FROM r WHERE lo <= 3""")
def a22(t):
    m = t.table("documents").groupBy("lang", "source").agg((F.sum("n_chars") / F.count("*")).alias("mean_chars"))
    return Q.top_and_bottom(m, ["lang"], "mean_chars", "source", 3)


@query("a23_block_share", "entity:s block:s total:f share:f", """
  WITH m AS (SELECT entity, CASE WHEN weekend = 1 THEN 'weekend' ELSE 'weekday' END AS block, sum(rate) AS total FROM hg_panel GROUP BY ALL)
  SELECT *, total / sum(total) OVER (PARTITION BY entity) AS share FROM m""")
def a23(t):
    from hourgrid.operators.explain import block_shares

    long = t.panel.select("entity", F.when(F.col("weekend") == 1, "weekend").otherwise("weekday").alias("block"), "rate")
    return block_shares(long, ["entity"], "block", "rate")


@query("a24_strength_ratio", "hod:i dense_mean:f sparse_mean:f ratio:f", """
  SELECT hod, d AS dense_mean, s AS sparse_mean, d / s AS ratio FROM (SELECT hod, avg(value) AS d FROM hg_panel GROUP BY 1) JOIN
  (SELECT hod, avg(value) AS s FROM hg_sparse GROUP BY 1) USING (hod)""")
def a24(t):
    both = t.panel.select("hod", "value", F.lit("d").alias("k")).unionByName(t.sparse.select("hod", "value", F.lit("s").alias("k")))
    out = both.groupBy("hod").agg(F.avg(F.when(F.col("k") == "d", F.col("value"))).alias("dense_mean"), F.avg(F.when(F.col("k") == "s", F.col("value"))).alias("sparse_mean"))
    return out.withColumn("ratio", F.try_divide("dense_mean", "sparse_mean"))
