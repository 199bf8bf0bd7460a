"""Windows and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.operators import quantile as QT
from hourgrid.operators import windows as O
from hourgrid.operators.weather import suspect_periods
from hourgrid.plans.registry import query


@query("w1_row_lag_lead", "entity:s hour:t prev:f next:f diff:f", """
  SELECT entity, hour, lag(value) OVER w AS prev, lead(value) OVER w AS next, abs(value - lag(value) OVER w) AS diff
  FROM hg_sparse WINDOW w AS (PARTITION BY entity ORDER BY hour)""")
def w1(t):
    df = t.sparse.select("entity", "hour", "t", "value")
    df = O.neighbours(df, ["entity"], "t", [O.Look("a", F.col("value")), O.Look("b", F.col("value"), forward=True)])
    return df.select("entity", "hour", F.col("a.value").alias("prev"), F.col("b.value").alias("next"),
                     F.abs(F.col("value") - F.col("a.value")).alias("diff"))


@query("w2_exact_hour_lags", "entity:s hour:t lag_1h:f lag_24h:f lag_168h:f", """
  SELECT a.entity, a.hour, b.value AS lag_1h, c.value AS lag_24h, d.value AS lag_168h FROM hg_sparse a
  LEFT JOIN hg_sparse b ON b.entity = a.entity AND b.hour = a.hour - INTERVAL 1 HOUR
  LEFT JOIN hg_sparse c ON c.entity = a.entity AND c.hour = a.hour - INTERVAL 24 HOUR
  LEFT JOIN hg_sparse d ON d.entity = a.entity AND d.hour = a.hour - INTERVAL 168 HOUR""")
def w2(t):
    return O.exact_lags(t.sparse.select("entity", "hour", "t", "value"), ["entity"], "t", "value", [1, 24, 168])


@query("w3_strict_rolling", "entity:s hour:t roll_mean:f roll_sd:f", """
  SELECT entity, hour, CASE WHEN n = 24 THEN m END AS roll_mean, CASE WHEN n = 24 THEN s END AS roll_sd FROM (
  SELECT entity, hour, count(rate) OVER w AS n, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS s FROM (
    SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY hour) AS isl FROM (
      SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY entity ORDER BY hour) = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM hg_panel))
  WINDOW w AS (PARTITION BY entity, isl ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""")
def w3(t):
    return O.rolling_strict(t.panel.select("entity", "hour", "t", "rate"), ["entity"], "t", "rate", 24)


@query("w4_rolling_min_count", "entity:s day:d roll:f", """
  SELECT entity, day, CASE WHEN count(*) OVER w >= 7 THEN avg(rate) OVER w END AS roll FROM hg_daily
  WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def w4(t):
    # One row per calendar day: bounded by the days of the archive, whatever the size of the source.
    w = W.partitionBy("entity").orderBy("d").rowsBetween(-29, 0)
    return t.daily.select("entity", "day", F.when(F.count("rate").over(w) >= 7, F.avg("rate").over(w)).alias("roll"))


@query("w5_islands", "entity:s island:i start:t finish:t hours:i", """
  SELECT entity, isl AS island, min(hour) AS start, max(hour) AS finish, count(*) AS hours FROM (
    SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY hour) AS isl FROM (
      SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY entity ORDER BY hour) = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM hg_sparse))
  GROUP BY ALL""")
def w5(t):
    df = O.islands(t.sparse.select("entity", "hour", "t"), ["entity"], "t")
    return df.groupBy("entity", "island").agg(F.min("hour").alias("start"), F.max("hour").alias("finish"), F.count("*").alias("hours"))


@query("w6_flag_runs", "entity:s start:t finish:t hours:i days:f", """
  SELECT entity, min(hour) AS start, max(hour) AS finish, count(*) AS hours, round(count(*) / 24.0, 1) AS days FROM (
    SELECT *, sum(chg) OVER (PARTITION BY entity ORDER BY hour) AS run FROM (
      SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY entity ORDER BY hour) THEN 0 ELSE 1 END AS chg FROM (
        SELECT entity, hour, CAST(ksum % 3 <> 0 AS INT) AS f FROM hg_panel))) WHERE f = 1 GROUP BY entity, run""")
def w6(t):
    df = t.panel.select("entity", "hour", "t", (F.col("ksum") % 3 != 0).cast("int").alias("f"))
    return suspect_periods(df, ["entity"], "t", "hour", "f")


@query("w7_frozen_sensor", "entity:s hour:t occupied:i is_frozen:i", """
  SELECT entity, hour, occupied, CASE WHEN cum >= 4 AND same = 1 THEN 1 ELSE 0 END AS is_frozen FROM (
    SELECT *, sum(same) OVER (PARTITION BY entity, grp ORDER BY hour) AS cum FROM (
      SELECT *, sum(1 - same) OVER (PARTITION BY entity ORDER BY hour) AS grp FROM (
        SELECT entity, hour, occupied, CASE WHEN occupied = lag(occupied) OVER (PARTITION BY entity ORDER BY hour) THEN 1 ELSE 0 END AS same
        FROM (SELECT entity, hour, occupied // 2 AS occupied FROM hg_sparse))))""")
def w7(t):
    df = t.sparse.select("entity", "hour", "t", F.floor(F.col("occupied") / 2).alias("occupied"))
    return O.frozen(df, ["entity"], "t", "occupied", 4)


@query("w8_constant_runs", "entity:s longest:i n_6h:i n_3h:i", """
  SELECT entity, max(n) AS longest, count(*) FILTER (WHERE n >= 6) AS n_6h, count(*) FILTER (WHERE n >= 3) AS n_3h FROM (
   SELECT entity, isl, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY hour) AS isl FROM (
      SELECT entity, hour, v, CASE WHEN v = lag(v) OVER w AND hour - lag(hour) OVER w = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk
      FROM (SELECT entity, hour, occupied // 3 AS v FROM hg_panel) WINDOW w AS (PARTITION BY entity ORDER BY hour))) GROUP BY ALL) GROUP BY 1""")
def w8(t):
    df = t.panel.select("entity", "t", F.floor(F.col("occupied") / 3).alias("v"))
    runs = O.islands(df, ["entity"], "t", same="v").groupBy("entity", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("entity").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 6).alias("n_6h"), F.count_if(F.col("n") >= 3).alias("n_3h"))


@query("w9_gap_profile", "entity:s max_gap_h:f p95_gap_h:f pct_over_1h:f", """
  SELECT entity, max(g) AS max_gap_h, quantile_cont(g, 0.95) AS p95_gap_h, 100 * avg(CAST(g > 1 AS INT)) AS pct_over_1h FROM (
  SELECT entity, (epoch(hour) - epoch(lag(hour) OVER (PARTITION BY entity ORDER BY hour))) / 3600.0::DOUBLE AS g FROM hg_sparse)
  WHERE g IS NOT NULL GROUP BY 1""")
def w9(t):
    gaps = O.previous(t.sparse.select("entity", "t"), ["entity"], "t", ["t"]).where("prev_t IS NOT NULL")
    gaps = gaps.select("entity", ((F.col("t") - F.col("prev_t")) / 3600).alias("g"))
    stats = gaps.groupBy("entity").agg(F.max("g").alias("max_gap_h"), (F.avg((F.col("g") > 1).cast("double")) * 100).alias("pct_over_1h"))
    return stats.join(QT.quantiles(gaps, ["entity"], "g", {"p95_gap_h": 0.95}), "entity")


@query("w10_latest_per_key", "user_id:i hour:t event_id:i value:f", """
  SELECT user_id, hour, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY ts DESC, event_id DESC) AS r
  FROM hg_readings) WHERE r = 1""")
def w10(t):
    df = t.readings.select("user_id", "hour", "ts", "event_id", "value")
    return O.latest_per_key(df, ["user_id", "hour"], [F.col("ts"), F.col("event_id")])


@query("w10_duplicate_counts", "n_exact:i n_by_key:i", """
  WITH x AS (SELECT user_id, hour, entity, cents % 4 AS c FROM hg_readings)
  SELECT (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS n_exact,
         (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT user_id, hour FROM x)) AS n_by_key""")
def w10_counts(t):
    from hourgrid.operators.quality import duplicate_counts

    return duplicate_counts(t.readings.select("user_id", "hour", "entity", (F.col("cents") % 4).alias("c")), ["user_id", "hour"])


@query("w11_first_by_priority", "date:d kind:s name:s id:i", """
  SELECT date, kind, name, id FROM (SELECT *, row_number() OVER (PARTITION BY date, kind ORDER BY scale, id) AS r FROM hg_registry) WHERE r = 1""")
def w11(t):
    df = t.registry.select("date", "kind", "name", "id", "scale")
    return O.latest_per_key(df, ["date", "kind"], [F.col("scale"), F.col("id")], earliest=True)


@query("w12_group_centring", "entity:s hour:t centred:f", """
  SELECT entity, hour, rate - avg(rate) OVER (PARTITION BY entity, week) AS centred FROM hg_panel""")
def w12(t):
    from hourgrid.operators.describe import centred

    return centred(t.panel.select("entity", "hour", "week", "rate"), ["entity", "week"], "rate", "centred")


@query("w13_rank_top_k", "source:s rank:i doc_id:i n_chars:i", """
  SELECT source, r AS rank, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
  WHERE r <= 3""")
def w13(t):
    return O.top_per_group(t.table("documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)


@query("w14_first_after_sort", "entity:s hour:t value:f", """
  SELECT entity, hour, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, hour) AS r FROM hg_sparse) WHERE r = 1""")
def w14(t):
    df = t.sparse.select("entity", "hour", "value", "t")
    return O.latest_per_key(df, ["entity"], [F.col("value"), -F.col("t")])


@query("w15_midranks", "entity:s hour:t midrank:f", """
  SELECT entity, hour, rank() OVER (PARTITION BY entity ORDER BY occupied) + (count(*) OVER (PARTITION BY entity, occupied) - 1) / 2.0 AS midrank
  FROM hg_panel""")
def w15(t):
    return QT.attach_midranks(t.panel.select("entity", "hour", "occupied"), ["entity"], "occupied", "midrank")


@query("w16_running_min_from_end", "family:s id:i q:f", """
  SELECT family, id, least(1, min(p * n / r) OVER (PARTITION BY family ORDER BY r DESC)) AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS n FROM (
      SELECT s_nationkey AS family, s_suppkey AS id, (s_suppkey * 37 % 101 + 1) / 1000.0::DOUBLE AS p FROM supplier))""")
def w16(t):
    from hourgrid.operators.significance import adjust_bh

    df = t.table("supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("id"),
                                    ((F.col("s_suppkey") * 37 % 101 + 1) / 1000).alias("p"))
    return adjust_bh(df, "p", "q", ["family"], ["id"])


@query("w17_group_row_shift", "hour:t inner_rate:f outer_next:f", """
  SELECT hour, i AS inner_rate, lead(o, 2) OVER (ORDER BY hour) AS outer_next FROM (SELECT hour,
   avg(rate) FILTER (WHERE grp = 'centrum') AS i, avg(rate) FILTER (WHERE coalesce(grp, '') <> 'centrum') AS o FROM hg_panel GROUP BY hour)""")
def w17(t):
    from hourgrid.operators.spatial import two_group_hours

    table = two_group_hours(t.panel, "rate", "grp", "centrum")
    # One row per hour of the archive: bounded by the calendar.
    w = W.partitionBy(F.lit(1)).orderBy("hour")
    return table.select("hour", F.col("inner").alias("inner_rate"), F.lead("outer", 2).over(w).alias("outer_next"))


@query("w18_event_windows", "entity:s day:d near:i after1:i far:i", """
  SELECT entity, day, CASE WHEN max(e) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 THEN 1 ELSE 0 END AS near,
  coalesce(lag(e) OVER (PARTITION BY entity ORDER BY day), 0) AS after1,
  1 - max(e) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS far
  FROM (SELECT entity, day, CAST(disc % 11 = 0 AS INT) AS e FROM hg_daily)""")
def w18(t):
    df = t.daily.select("entity", "day", "d", (F.col("disc") % 11 == 0).cast("int").alias("e"))
    w = W.partitionBy("entity").orderBy("d")
    near = F.max("e").over(w.rowsBetween(-2, 2))
    return df.select("entity", "day", near.alias("near"), F.coalesce(F.lag("e").over(w), F.lit(0)).alias("after1"), (1 - near).alias("far"))
