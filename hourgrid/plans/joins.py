"""Joins: enrichment, as-of, range, fuzzy, semi, anti and pair joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import panel as P
from hourgrid.operators import windows as O
from hourgrid.operators.quality import known_capacities
from hourgrid.plans.registry import query


@query("j1_many_to_one_enrichment", "entity:s hour:t rate:f temp:f is_event_day:i capacity:i", """
  SELECT p.entity, p.hour, p.rate, w.temp, d.is_event_day, e.capacity FROM hg_panel p LEFT JOIN hg_weather w USING (hour)
  LEFT JOIN hg_days d USING (day) LEFT JOIN hg_entities e ON e.entity = p.entity""")
def j1(t):
    return P.assemble(t.panel.select("entity", "hour", "day", "rate"), t.weather.select("hour", "temp"),
                      t.days.select("day", "is_event_day"), t.entities.select("entity", "capacity"))


@query("j2_events_filled", "day:d n:i is_event_day:i is_football_day:i event_scale_max:i", """
  SELECT p.day, count(*) AS n, max(coalesce(is_event_day, 0)) AS is_event_day, max(coalesce(is_football_day, 0)) AS is_football_day,
  max(coalesce(event_scale_max, 0)) AS event_scale_max FROM hg_panel p
  LEFT JOIN (SELECT * FROM hg_days WHERE is_event_day = 1) d USING (day) GROUP BY 1""")
def j2(t):
    events = t.days.where("is_event_day = 1").select("day", "is_event_day", "is_football_day", "event_scale_max")
    out = P.add_events(t.panel.select("entity", "hour", "day"), events, "day")
    return out.groupBy("day").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("is_event_day", "is_football_day", "event_scale_max")])


@query("j3_day_spine", "date:d n_orders:i", """
  SELECT d.date, count(o.o_orderkey) AS n_orders FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY))::DATE AS date FROM orders) d
  LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.date GROUP BY 1""")
def j3(t):
    from hourgrid.operators.calendar import spine_of

    per = t.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n_orders"))
    return spine_of(per, "date").join(per, "date", "left").fillna({"n_orders": 0})


@query("j4_shifted_lag", "entity:s hour:t lag_24h:f", """
  SELECT a.entity, a.hour, b.rate AS lag_24h FROM hg_panel a LEFT JOIN hg_panel b ON a.entity = b.entity AND b.hour = a.hour - INTERVAL 24 HOUR""")
def j4(t):
    return O.exact_lags(t.panel.select("entity", "hour", "t", "rate"), ["entity"], "t", "rate", [24])


@query("j5_asof_both_ways", "hour:t to_event:f since_event:f", """
  WITH h AS (SELECT hour, max(is_event_day) AS e FROM hg_mad GROUP BY 1), ev AS (SELECT hour AS eh FROM h WHERE e = 1)
  SELECT h.hour, (epoch(n.eh) - epoch(h.hour)) / 3600.0 AS to_event, (epoch(h.hour) - epoch(p.eh)) / 3600.0 AS since_event
  FROM h ASOF LEFT JOIN ev p ON h.hour >= p.eh ASOF LEFT JOIN ev n ON h.hour <= n.eh""")
def j5(t):
    hours = t.mad.groupBy("hour", "t").agg(F.max("is_event_day").alias("e"))
    out = P.nearest_marks(hours, "t", F.col("e") == 1)
    return out.select("hour", F.col("to_mark").alias("to_event"), F.col("since_mark").alias("since_event"))


@query("j6_fold_ranges", "fold:s role:s n:i", """
  SELECT fold, CASE WHEN hour < train_end_before THEN 'train' ELSE 'valid' END AS role, count(*) AS n FROM hg_panel, hg_folds
  WHERE hour < train_end_before OR hour BETWEEN valid_start AND valid_end GROUP BY ALL""")
def j6(t):
    return P.fold_rows(t.panel.select("hour"), t.folds).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("j6_interval_label", "season:s n:i", """
  SELECT CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' THEN 'first'
  WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-07-01' AND DATE '1998-12-31' THEN 'second' END AS season, count(*) AS n FROM orders GROUP BY 1""")
def j6_label(t):
    ranges = t.spark.sql("SELECT * FROM VALUES (date'1996-01-01', date'1996-07-01', 'first'), (date'1996-07-01', date'1999-01-01', 'second') AS r(a, b, season)")
    days = t.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    return P.label_by_range(days, ranges, "date", "a", "b", ["season"]).groupBy("season").agg(F.sum("n").alias("n"))


@query("j6_many_ranges", "ship_date:s n_open:i first_order:i last_order:i", """
  WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) AS b FROM orders), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
  SELECT day AS ship_date, count(o_orderkey) AS n_open, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM d LEFT JOIN r ON day >= a AND day < b GROUP BY 1""")
def j6_many_ranges(t):
    """A range for each order; one in 45 is empty."""
    opened = F.to_date("o_orderdate")
    ranges = t.table("orders").select("o_orderkey", opened.alias("a"), F.date_add(opened, (F.col("o_orderkey") % 45).cast("int")).alias("b"))
    days = t.table("lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    totals = {"n_open": ("count", "o_orderkey"), "first_order": ("min", "o_orderkey"), "last_order": ("max", "o_orderkey")}
    return P.interval_totals(days, ranges, "day", "a", "b", totals).withColumn("ship_date", F.col("day").cast("string"))


@query("j8_anti_missing_hours", "entity:s n_missing:i", """
  WITH s AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM (SELECT entity, min(hour) AS a, max(hour) AS b FROM hg_panel GROUP BY 1))
  SELECT entity, count(*) AS n_missing FROM s ANTI JOIN hg_panel p USING (entity, hour) GROUP BY 1""")
def j8(t):
    from hourgrid.operators.series import hour_spine

    return hour_spine(t.panel, ["entity"], "hour").join(t.panel.select("entity", "hour"), ["entity", "hour"], "left_anti").groupBy(
        "entity").agg(F.count("*").alias("n_missing"))


@query("j9_semi_common_entities", "entity:s n:i", """
  SELECT entity, count(*) AS n FROM hg_sparse a SEMI JOIN (SELECT DISTINCT entity FROM hg_sparse WHERE day >= DATE '2024-01-16') b USING (entity)
  WHERE day < DATE '2024-01-16' GROUP BY 1""")
def j9(t):
    late = t.sparse.where(F.col("day") >= F.lit("2024-01-16").cast("date")).select("entity")
    early = t.sparse.where(F.col("day") < F.lit("2024-01-16").cast("date"))
    # Reduce before the join: one row per entity on both sides.
    return early.groupBy("entity").agg(F.count("*").alias("n")).join(late.distinct(), "entity", "left_semi")


@query("j10_prediction_pairs", "entity:s n:i mae_a:f mae_b:f", """
  WITH a AS (SELECT x.entity, x.hour, x.rate, y.rate AS p FROM hg_panel x JOIN hg_panel y ON x.entity = y.entity AND y.hour = x.hour - INTERVAL 1 HOUR),
  b AS (SELECT x.entity, x.hour, x.rate, y.rate AS p FROM hg_panel x JOIN hg_panel y ON x.entity = y.entity AND y.hour = x.hour - INTERVAL 24 HOUR)
  SELECT entity, count(*) AS n, avg(abs(a.rate - a.p)) AS mae_a, avg(abs(b.rate - b.p)) AS mae_b FROM a JOIN b USING (entity, hour) GROUP BY 1""")
def j10(t):
    lagged = O.exact_lags(t.panel.select("entity", "hour", "t", "rate"), ["entity"], "t", "rate", [1, 24])
    a = lagged.where("lag_1h IS NOT NULL").select("entity", "hour", "rate", F.col("lag_1h").alias("p"))
    b = lagged.where("lag_24h IS NOT NULL").select("entity", "hour", "rate", F.col("lag_24h").alias("p"))
    both = P.both_predictions(a, b, ["entity", "hour"], ["rate", "p"])
    return both.groupBy("entity").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("rate_a") - F.col("p_a"))).alias("mae_a"),
                                      F.avg(F.abs(F.col("rate_b") - F.col("p_b"))).alias("mae_b"))


@query("j12_unordered_pairs", "a:s b:s n_common:i", """
  SELECT x.entity AS a, y.entity AS b, count(*) AS n_common FROM hg_panel x JOIN hg_panel y ON x.hour = y.hour AND x.entity < y.entity GROUP BY ALL""")
def j12(t):
    from hourgrid.operators.spatial import pair_correlation

    return pair_correlation(t.panel, "entity", ["hour"], "rate").select("a", "b", F.col("n").alias("n_common"))


@query("j13_outer_stats", "entity:s n_early:i n_late:i", """
  WITH a AS (SELECT entity, count(*) AS n_early FROM hg_sparse WHERE day < DATE '2024-01-16' GROUP BY 1),
  b AS (SELECT entity, count(*) AS n_late FROM hg_sparse WHERE day >= DATE '2024-01-16' GROUP BY 1)
  SELECT entity, n_early, n_late FROM a FULL JOIN b USING (entity)""")
def j13(t):
    d = F.col("day")
    a = t.sparse.where(d < F.lit("2024-01-16").cast("date")).groupBy("entity").agg(F.count("*").alias("n_early"))
    b = t.sparse.where(d >= F.lit("2024-01-16").cast("date")).groupBy("entity").agg(F.count("*").alias("n_late"))
    return a.join(b, "entity", "full_outer")


@query("j14_helper_columns", "hod:i dow:i n:i", "SELECT hod, dow, count(*) AS n FROM hg_panel GROUP BY ALL")
def j14(t):
    slim = t.panel.select("entity", "hour", "rate")
    return P.helper_columns(slim, t.panel, ["entity", "hour"], ["hod", "dow"]).groupBy("hod", "dow").agg(F.count("*").alias("n"))


@query("j15_lag_alignment_audit", "lag:i n:i match_share:f", """
  SELECT k AS lag, count(*) AS n, 1.0 AS match_share FROM hg_panel a CROSS JOIN (VALUES (1), (24), (168)) v(k)
  SEMI JOIN hg_panel b ON a.entity = b.entity AND b.hour = a.hour - to_hours(k) GROUP BY 1""")
def j15(t):
    from hourgrid.operators.features import lag_alignment

    lagged = O.exact_lags(t.panel.select("entity", "hour", "t", "rate"), ["entity"], "t", "rate", [1, 24, 168])
    return lag_alignment(lagged, t.panel, [1, 24, 168], "rate")


@query("j16_known_capacities", "entity:s expected_capacity:i actual_capacity:i status:s", """
  SELECT x.entity, x.expected_capacity, e.capacity AS actual_capacity, CASE WHEN e.capacity IS NULL THEN 'MISSING'
  WHEN e.capacity = x.expected_capacity THEN 'OK' ELSE 'MISMATCH' END AS status FROM (
    SELECT CASE WHEN entity = 'view' THEN 'old_view' ELSE entity END AS entity, capacity + CAST(entity = 'click' AS INT) AS expected_capacity FROM hg_entities) x
  LEFT JOIN hg_entities e USING (entity)""")
def j16(t):
    expected = t.entities.select(F.when(F.col("entity") == "view", "old_view").otherwise(F.col("entity")).alias("entity"),
                                 (F.col("capacity") + (F.col("entity") == "click").cast("int")).alias("expected_capacity"))
    return known_capacities(t.entities, expected)
