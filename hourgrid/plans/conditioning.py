"""Time-series conditioning: spines, filling, sensor cleaning, flags and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import quality as Q
from hourgrid.operators import series as TS
from hourgrid.operators import weather as WX
from hourgrid.operators.windows import DAY, frozen, latest_per_key
from hourgrid.plans.registry import query

# SQL for limited interpolation over hg rows: positions count rows.


def _fill_sql(source: str, key: str, col: str, limit: int, both: bool = False) -> str:
    near = f"coalesce(pos - pp <= {limit}, false)" + (f" OR coalesce(np - pos <= {limit}, false)" if both else "")
    return f"""SELECT * EXCLUDE (pv, pt, pp, nv, nt, np, {col}), CASE WHEN {near} THEN
      CASE WHEN {col} IS NOT NULL THEN {col} WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt)::DOUBLE END END AS {col} FROM (
      SELECT *, last_value({col} IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN {col} IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
      last_value(CASE WHEN {col} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp, first_value({col} IGNORE NULLS) OVER f AS nv,
      first_value(CASE WHEN {col} IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt, first_value(CASE WHEN {col} IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np
      FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t) AS pos FROM ({source}))
      WINDOW b AS (PARTITION BY {key} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY {key} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


_GRID = """SELECT s.entity, s.hour, CAST(epoch(s.hour) AS BIGINT) AS t, p.value FROM (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour
  FROM (SELECT entity, min(hour) AS a, max(hour) AS b FROM hg_sparse GROUP BY 1)) s LEFT JOIN hg_sparse p USING (entity, hour)"""


@query("ts1_spine_missing", "entity:s n_hours:i missing_pct:f", f"""
  SELECT entity, count(*) AS n_hours, 100.0 * avg(CAST(value IS NULL AS INT)) AS missing_pct FROM ({_GRID}) GROUP BY 1""")
def ts1(t):
    grid = TS.reindexed(t.sparse, ["entity"], "hour", ["value"])
    return grid.groupBy("entity").agg(F.count("*").alias("n_hours"), (F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_pct"))


@query("ts2_interpolate_forward", "entity:s hour:t value:f", f"SELECT entity, hour, value FROM ({_fill_sql(_GRID, 'entity', 'value', 2)})")
def ts2(t):
    return TS.filled_hours(t.sparse, ["entity"], "hour", "value", 2)


@query("ts2_interpolate_both", "entity:s n:i n_null:i total:f4", f"""
  SELECT entity, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_null, sum(value) AS total FROM ({_fill_sql(_GRID, 'entity', 'value', 3, True)}) GROUP BY 1""")
def ts2_both(t):
    out = TS.filled_hours(t.sparse, ["entity"], "hour", "value", 3, both=True)
    return out.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), F.sum("value").alias("total"))


@query("ts2_interpolate_then_edges", "entity:s n_null:i total:f4", f"""
  SELECT entity, 0 AS n_null, sum(v) AS total FROM (SELECT entity, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t),
    first_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM ({_fill_sql(_GRID, 'entity', 'value', 6)})) GROUP BY 1""")
def ts2_edges(t):
    out = TS.filled_hours(t.sparse, ["entity"], "hour", "value", 6, edges=True)
    return out.groupBy("entity").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.sum("value").alias("total"))


@query("ts3_invalidate_by_code", "column:s n_before:i n_after:i", """
  SELECT 'temp' AS "column", count(*) FILTER (WHERE temp IS NULL) AS n_before, count(*) FILTER (WHERE temp IS NULL OR qc_temp = false) AS n_after FROM hg_weather
  UNION ALL SELECT 'precip', count(*) FILTER (WHERE precip IS NULL), count(*) FILTER (WHERE precip IS NULL OR qc_precip = false) FROM hg_weather""")
def ts3(t):
    return WX.fill_counts(t.weather, WX.invalidate(t.weather, {"temp": "qc_temp", "precip": "qc_precip"}), ["temp", "precip"])


@query("ts3_clean_invalid", "hour:t temp:f wind:f", f"""
  SELECT hour, temp, wind FROM ({_fill_sql(_fill_sql("SELECT 1 AS g, hour, t, CASE WHEN qc_temp = false THEN NULL ELSE temp END AS temp, CASE WHEN qc_wind = false THEN NULL ELSE wind END AS wind FROM hg_weather", 'g', 'temp', 2).replace('SELECT * EXCLUDE (', 'SELECT * EXCLUDE (pos, '), 'g', 'wind', 2)})""")
def ts3_clean(t):
    w = t.weather.select(F.lit(1).alias("g"), "hour", "t", "temp", "wind", "qc_temp", "qc_wind")
    return WX.clean_invalid(w, ["g"], "t", {"temp": "qc_temp", "wind": "qc_wind"}, 2)


@query("ts4_physical_range", "n:i n_null:i low:f high:f total:f", """
  SELECT count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null, min(v) AS low, max(v) AS high, sum(v) AS total FROM (
  SELECT CASE WHEN shortwave BETWEEN -5 AND 1400 THEN greatest(shortwave, 0) END AS v FROM hg_weather)""")
def ts4(t):
    w = WX.physical_radiation(t.weather.select("shortwave"), ["shortwave"])
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("shortwave").isNull()).alias("n_null"), F.min("shortwave").alias("low"),
                 F.max("shortwave").alias("high"), F.sum("shortwave").alias("total"))


@query("ts5_sunshine_conflict", "pearson_r:f n_conflict:i pct_conflict:f", """
  SELECT corr(shortwave, sun_minutes) FILTER (WHERE shortwave > 0) AS pearson_r, count(*) FILTER (WHERE shortwave > 120 AND sun_minutes = 0) AS n_conflict,
  100 * avg(CAST(coalesce(shortwave > 120 AND sun_minutes = 0, false) AS INT)) AS pct_conflict FROM hg_weather""")
def ts5(t):
    w = t.weather.withColumn("c", WX.sunshine_conflict("shortwave", "sun_minutes"))
    lit = F.col("shortwave") > 0
    return w.agg(F.corr(F.when(lit, F.col("shortwave")), F.col("sun_minutes")).alias("pearson_r"), F.sum("c").alias("n_conflict"), (F.avg("c") * 100).alias("pct_conflict"))


_NIGHT_SQL = "(" + " OR ".join(f"(month(hour) = {m} AND (hour(hour) <= {a} OR hour(hour) >= {b}))" for m, (a, b) in WX.NIGHT.items()) + ")"
_IMP0 = f"""SELECT 1 AS g, hour, t, precip, gust, temp, wind, CASE WHEN humidity IS NULL THEN NULL ELSE humidity END AS humidity,
  CASE WHEN shortwave IS NULL AND {_NIGHT_SQL} THEN 0.0 ELSE shortwave END AS shortwave FROM (SELECT * REPLACE (CASE WHEN qc_temp = false THEN NULL ELSE temp END AS temp, CASE WHEN qc_wind = false THEN NULL ELSE wind END AS wind) FROM hg_weather)"""


def _chain(sql: str, columns: dict[str, int]) -> str:
    for i, (c, limit) in enumerate(columns.items()):
        step = _fill_sql(sql, "g", c, limit, True)
        sql = step.replace("SELECT * EXCLUDE (", "SELECT * EXCLUDE (pos, ", 1)
    return sql


@query("ts6_imputation_policy", "hour:t temp:f wind:f gust:f precip:f humidity:f shortwave:f precip_imputed:i", f"""
  SELECT hour, temp, wind, coalesce(gust, wind) AS gust, coalesce(precip, 0) AS precip, humidity, shortwave, CAST(precip IS NULL AS INT) AS precip_imputed
  FROM ({_chain(_IMP0, {'temp': 6, 'wind': 3, 'humidity': 3, 'shortwave': 2})})""")
def ts6(t):
    w = WX.invalidate(t.weather.withColumn("g", F.lit(1)), {"temp": "qc_temp", "wind": "qc_wind"})
    return WX.impute(w, ["g"], "t", "hour", {"temp": 6, "wind": 3, "humidity": 3}, "precip", "gust", "wind", ["shortwave"])


@query("ts7_series_integrity", "entity:s expected:i actual:i missing:i surplus:i", """
  SELECT entity, date_diff('hour', min(hour), max(hour)) + 1 AS expected, count(*) AS actual, date_diff('hour', min(hour), max(hour)) + 1 - count(*) AS missing, 0 AS surplus
  FROM hg_sparse GROUP BY 1""")
def ts7(t):
    return TS.integrity(t.sparse, ["entity"], "hour")


@query("ts8_null_status", "column:s n_null:i pct_null:f status:s", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, 100.0 * avg(CAST({c} IS NULL AS INT)) AS pct_null, CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'OK' ELSE 'HAS_NULL' END AS status FROM hg_weather"
    for c in ["temp", "precip", "humidity"]))
def ts8(t):
    return Q.null_status(t.weather, ["temp", "precip", "humidity"])


@query("ts9_first_sun_hour", "month:i n_days:i mean_first_hour:f", """
  SELECT month(day) AS month, count(*) AS n_days, avg(f) AS mean_first_hour FROM (SELECT CAST(hour AS DATE) AS day, max(shortwave) AS m,
  min(hour(hour)) FILTER (WHERE shortwave > 200) AS f FROM hg_weather GROUP BY 1) WHERE m > 400 GROUP BY 1""")
def ts9(t):
    return WX.first_sun_hours(t.weather, "hour", "shortwave", 200.0, 400.0)


@query("ts10_coverage_flags", "low_data_coverage:i system_blackout:i partial_year:i n:i", """
  SELECT CAST(year(o_orderdate) IN (1995, 1998) AS INT) AS low_data_coverage, CAST(o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1997-07-01' AS INT) AS system_blackout,
  CAST(year(o_orderdate) = 2001 AS INT) AS partial_year, count(*) AS n FROM orders GROUP BY ALL""")
def ts10(t):
    o = t.table("orders").select(F.col("o_orderdate").cast("timestamp").alias("hour"))
    out = Q.coverage_flags(o, "hour", F.year("hour"), [1995, 1998], ("1996-06-01", "1997-07-01"), [2001])
    return out.groupBy("low_data_coverage", "system_blackout", "partial_year").agg(F.count("*").alias("n"))


_FLAGS_SQL = """flagged AS (SELECT *, count_in / nullif(override, 0)::DOUBLE AS calc, CAST(coalesce(abs(rate_in - count_in / nullif(override, 0)::DOUBLE) > 0.01, false) AS INT) AS flag_occ_inconsistent,
  CAST(count_in > override AS INT) AS flag_overcapacity, CAST(count_in < 0 AS INT) AS flag_negative FROM hg_reported)"""


@query("ts11_reading_flags", "entity:s hour:t flag_occ_inconsistent:i flag_overcapacity:i flag_negative:i", f"WITH {_FLAGS_SQL} SELECT * FROM flagged")
def ts11(t):
    return Q.reading_flags(t.reported, "rate_in", "count_in", "override")


@query("ts12_repair_rates", "entity:s n_null:i total:f", f"""
  WITH {_FLAGS_SQL} SELECT entity, count(*) FILTER (WHERE v IS NULL) AS n_null, sum(v) AS total FROM
  (SELECT entity, CASE WHEN flag_occ_inconsistent = 1 THEN calc ELSE coalesce(rate_in, calc) END AS v FROM flagged) GROUP BY 1""")
def ts12(t):
    out = Q.repair_rates(Q.reading_flags(t.reported, "rate_in", "count_in", "override"), "rate_in", "count_in", "override")
    return out.groupBy("entity").agg(F.count_if(F.col("rate_in").isNull()).alias("n_null"), F.sum("rate_in").alias("total"))


@query("ts12_frozen_then_dedup", "user_id:i hour:t event_id:i is_frozen:i", """
  WITH x AS (SELECT event_id, user_id, hour, ts, cents // 2000 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM hg_readings),
  f AS (SELECT *, CAST(coalesce(v = lag(v, 1) OVER w AND v = lag(v, 2) OVER w AND v = lag(v, 3) OVER w AND v = lag(v, 4) OVER w, false) AS INT) AS is_frozen FROM x WINDOW w AS (PARTITION BY user_id ORDER BY o))
  SELECT user_id, hour, event_id, is_frozen FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY ts DESC, event_id DESC) AS r FROM f) WHERE r = 1""")
def ts12_frozen(t):
    x = t.readings.select("event_id", "user_id", "hour", "ts", F.floor(F.col("cents") / 2000).alias("v"),
                          F.unix_micros("ts").alias("o"))
    # The order column counts microseconds, so chunks of a day are given in microseconds too.
    flagged = frozen(x, ["user_id"], "o", "v", 4, chunk=DAY * 1_000_000)
    return latest_per_key(flagged.select("user_id", "hour", "event_id", "ts", "is_frozen"), ["user_id", "hour"], [F.col("ts"), F.col("event_id")])


@query("ts13_check_log", "check:s dataset:s result:s n_affected:i action:s", f"""
  WITH {_FLAGS_SQL} SELECT 'inconsistent' AS "check", 'reported' AS dataset, CASE WHEN sum(flag_occ_inconsistent) = 0 THEN 'PASS' ELSE 'WARN' END AS result, sum(flag_occ_inconsistent) AS n_affected, 'recompute' AS action FROM flagged
  UNION ALL SELECT 'over_capacity', 'reported', CASE WHEN sum(flag_overcapacity) = 0 THEN 'PASS' ELSE 'WARN' END, sum(flag_overcapacity), 'flag' FROM flagged
  UNION ALL SELECT 'duplicates', 'sparse', 'PASS', 0, 'none' FROM (SELECT count(*) FROM hg_sparse)""")
def ts13(t):
    a = Q.check_rows(Q.reading_flags(t.reported, "rate_in", "count_in", "override"), "reported",
                     [("inconsistent", F.col("flag_occ_inconsistent") == 1, "recompute"), ("over_capacity", F.col("flag_overcapacity") == 1, "flag")])
    dup = t.sparse.groupBy("entity", "hour").agg(F.count("*").alias("n"))
    return a.unionByName(Q.check_rows(dup, "sparse", [("duplicates", F.col("n") > 1, "none")]))
