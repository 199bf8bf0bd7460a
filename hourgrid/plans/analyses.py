"""Descriptive, seasonal and spatial analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions import scalar as S
from hourgrid.operators import describe as D
from hourgrid.operators import quality as Q
from hourgrid.operators import seasonal as SE
from hourgrid.operators import series as TS
from hourgrid.operators import significance as ST
from hourgrid.operators import spatial as SP
from hourgrid.operators.windows import frame_aggregates
from hourgrid.plans.registry import query


@query("an1_mean_profiles", "grp:s hod:i dow:i weekend:i n:i mean:f", """
  SELECT grp, hod, dow, weekend, count(rate) AS n, avg(rate) AS mean FROM (SELECT coalesce(grp, 'none') AS grp, hod, dow, weekend, rate FROM hg_panel)
  GROUP BY GROUPING SETS ((hod), (dow), (hod, dow), (grp, hod), (hod, weekend))""")
def an1(t):
    df = t.panel.select(F.coalesce("grp", F.lit("none")).alias("grp"), "hod", "dow", "weekend", "rate")
    # Sums per finest cell first: grouping sets then expand cells, not readings.
    cells = df.groupBy("grp", "hod", "dow", "weekend").agg(F.sum("rate").alias("s"), F.count("rate").alias("n"))
    sets = [["hod"], ["dow"], ["hod", "dow"], ["grp", "hod"], ["hod", "weekend"]]
    cols = [F.col(c) for c in ("grp", "hod", "dow", "weekend")]
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))


@query("an2_profile_contrasts", "entity:s mean_diff:f max_diff:f min_diff:f", """
  SELECT entity, avg(d) AS mean_diff, max(d) AS max_diff, min(d) AS min_diff FROM (SELECT entity, hod, avg(rate) FILTER (WHERE weekend = 1) - avg(rate) FILTER (WHERE weekend = 0) AS d FROM hg_panel GROUP BY ALL) GROUP BY 1""")
def an2(t):
    return SE.contrast_over_hours(t.panel, ["entity"], "hod", F.col("weekend") == 1, "rate")


@query("an3_year_pairs", "a:i b:i n:i r:f rho:f shift:f", """
  WITH m AS (SELECT year, month, round(avg(rate), 9) AS v FROM hg_daily GROUP BY ALL),
  p AS (SELECT x.year AS a, y.year AS b, x.v AS u, y.v AS w FROM m x JOIN m y ON x.month = y.month AND x.year < y.year),
  r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY a, b ORDER BY w) + (count(*) OVER (PARTITION BY a, b, w) - 1) / 2.0 AS rw FROM p)
  SELECT a, b, count(*) AS n, corr(u, w) AS r, corr(ru, rw) AS rho, avg(w - u) AS shift FROM r GROUP BY ALL""")
def an3(t):
    m = t.daily.groupBy("year", "month").agg(F.round(F.avg("rate"), 9).alias("v"))
    p = m.select("month", F.col("year").alias("a"), F.col("v").alias("u")).join(m.select("month", F.col("year").alias("b"), F.col("v").alias("w")), "month").where("a < b")
    base = p.groupBy("a", "b").agg(F.corr("u", "w").alias("r"), F.avg(F.col("w") - F.col("u")).alias("shift"))
    return base.join(ST.spearman(p, ["a", "b"], "u", "w"), ["a", "b"])


@query("an3_year_signatures", "year:i n:i mean:f median:f sd:f", "SELECT year, count(*) AS n, avg(rate) AS mean, quantile_cont(rate, 0.5) AS median, stddev_samp(rate) AS sd FROM hg_daily GROUP BY 1")
def an3_sig(t):
    d = t.daily
    return d.groupBy("year").agg(F.count("*").alias("n"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd")).join(
        D.quantiles(d, ["year"], "rate", {"median": 0.5}), "year")


@query("an4_variance_explained", "entity:s r2_hour:f r2_hour_weekday:f amplitude:f", """
  WITH x AS (SELECT entity, rate, avg(rate) OVER (PARTITION BY entity) AS m, avg(rate) OVER (PARTITION BY entity, hod) AS mh, avg(rate) OVER (PARTITION BY entity, hod, dow) AS mhd FROM hg_panel)
  SELECT entity, 1 - sum((rate - mh) ** 2) / sum((rate - m) ** 2) AS r2_hour, 1 - sum((rate - mhd) ** 2) / sum((rate - m) ** 2) AS r2_hour_weekday, max(mh) - min(mh) AS amplitude FROM x GROUP BY 1""")
def an4(t):
    p = t.panel.select("entity", "hod", "dow", "rate")
    a = D.variance_explained(p, ["entity"], ["hod"], "rate").withColumnRenamed("r2", "r2_hour")
    b = D.variance_explained(p, ["entity"], ["hod", "dow"], "rate").withColumnRenamed("r2", "r2_hour_weekday")
    amp = p.groupBy("entity", "hod").agg(F.avg("rate").alias("m")).groupBy("entity").agg((F.max("m") - F.min("m")).alias("amplitude"))
    return a.join(b, "entity").join(amp, "entity")


_SERIES = """series AS (SELECT entity, hour, CAST(epoch(hour) AS BIGINT) AS t, coalesce(rate, last_value(rate IGNORE NULLS) OVER (PARTITION BY entity ORDER BY hour)) AS v FROM (
  SELECT s.entity, s.hour, p.rate FROM (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM (SELECT entity, min(hour) AS a, max(hour) AS b FROM hg_panel GROUP BY 1)) s LEFT JOIN hg_panel p USING (entity, hour)))"""


def _filled(t):
    from hourgrid.operators.windows import Look, neighbours

    grid = TS.reindexed(t.panel, ["entity"], "hour", ["rate"])
    out = neighbours(grid, ["entity"], "t", [Look("p", F.col("rate"), where=F.col("rate").isNotNull(), inclusive=True)])
    return out.select("entity", "hour", "t", F.col("p.value").alias("v"))


@query("an5_autocorrelation", "entity:s lag:i acf:f", f"""
  WITH {_SERIES}, x AS (SELECT *, v - avg(v) OVER (PARTITION BY entity) AS d FROM series), s AS (SELECT entity, sum(d * d) AS den FROM x GROUP BY 1)
  SELECT a.entity, k AS lag, sum(a.d * b.d) / any_value(den) AS acf FROM x a CROSS JOIN (VALUES (1), (24), (168)) l(k) JOIN x b ON a.entity = b.entity AND b.hour = a.hour - to_hours(k) JOIN s ON s.entity = a.entity GROUP BY ALL""")
def an5(t):
    return TS.autocorrelation(_filled(t), ["entity"], "t", "v", [1, 24, 168])


@query("an6_stationarity", "entity:s transform:s n_used:i adf_stat:f4 adf_p:f4 kpss_stat:f4 kpss_p:f4 joint_interpretation:s")
def an6(t):
    return SE.stationarity(_filled(t), "entity", "t", "v")


_POWER = f"""{_SERIES}, x AS (SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS DOUBLE) AS j, v - avg(v) OVER (PARTITION BY entity) AS d, count(*) OVER (PARTITION BY entity) AS n FROM series),
  f AS (SELECT entity, n, k, 2 * pi() * k / n AS w FROM (SELECT DISTINCT entity, n, unnest(range(1, n // 2 + 1)) AS k FROM x)),
  pw AS (SELECT x.entity, f.n / f.k::DOUBLE AS period_hours, (sum(d * cos(w * j)) ** 2 + sum(d * sin(w * j)) ** 2) / f.n ** 2 * CASE WHEN 2 * f.k = f.n THEN 1 ELSE 2 END AS power FROM x JOIN f USING (entity) GROUP BY x.entity, f.n, f.k)"""


@query("an7_spectrum_peaks", "entity:s rank:i period_hours:f power:f", f"""
  WITH {_POWER} SELECT entity, r AS rank, period_hours, power FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY power DESC, period_hours) AS r FROM pw WHERE period_hours BETWEEN 2 AND 1000) WHERE r <= 8""")
def an7(t):
    return SE.spectrum_peaks(SE.periodogram(_filled(t), "entity", "t", "v"), "entity", 8)


@query("an7_band_shares", "entity:s band:s power_share_pct:f", f"""
  WITH {_POWER}, q AS (SELECT * FROM pw WHERE period_hours BETWEEN 2 AND 1000)
  SELECT entity, b AS band, 100 * coalesce(sum(power) FILTER (WHERE period_hours BETWEEN lo AND hi), 0) / sum(power) AS power_share_pct FROM q, (VALUES ('24h(+/-0.5)', 23.5, 24.5), ('168h(+/-8)', 160, 176), ('12h(+/-0.5)', 11.5, 12.5)) v(b, lo, hi) GROUP BY ALL""")
def an7_bands(t):
    return SE.band_shares(SE.periodogram(_filled(t), "entity", "t", "v"), "entity")


@query("an8_entity_inventory", "grp:s n_entities:i n_rows:i capacity:i mean_rate:f", """
  SELECT coalesce(grp, 'none') AS grp, count(DISTINCT entity) AS n_entities, count(*) AS n_rows, sum(DISTINCT capacity * 1000 + ascii(entity)) - sum(DISTINCT capacity * 1000 + ascii(entity)) + max(c) AS capacity, avg(rate) AS mean_rate
  FROM hg_panel JOIN (SELECT coalesce(grp, 'none') AS g, sum(capacity) AS c FROM hg_entities GROUP BY 1) ON g = coalesce(grp, 'none') GROUP BY 1""".replace("sum(DISTINCT capacity * 1000 + ascii(entity)) - sum(DISTINCT capacity * 1000 + ascii(entity)) + max(c)", "max(c)"))
def an8(t):
    per = t.panel.groupBy("entity", F.coalesce("grp", F.lit("none")).alias("grp"), "capacity").agg(F.count("*").alias("n"), F.sum("rate").alias("s"))
    return per.groupBy("grp").agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_rows"), F.sum("capacity").alias("capacity"), (F.sum("s") / F.sum("n")).alias("mean_rate"))


def _nations(t):
    """Entity table by nation: capacity is the number of lines, rate the mean discount.

    Lines are summed per supplier first; only those sums meet the supplier table.
    """
    li = t.table("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100)).alias("d"))
    x = li.join(t.table("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("s_nationkey")
    return x.agg(F.sum("n").alias("capacity"), F.round(F.sum("d") / F.sum("n"), 6).alias("mean_rate"))


@query("an9_capacity_relation", "slope:f slope_low:f slope_high:f rho:f n:i", """
  WITH p AS (SELECT count(*) AS x, round(sum(round(l_discount * 100)) / count(*), 6) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey),
  s AS (SELECT (b.y - a.y) / (b.x - a.x) AS slope FROM p a JOIN p b ON a.x < b.x), o AS (SELECT slope, row_number() OVER (ORDER BY slope) - 1 AS i FROM s),
  z AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS n, (SELECT count(*) FROM s) AS m, (SELECT sum(c * (c - 1) * (2 * c + 5)) FROM (SELECT count(*) AS c FROM p GROUP BY x)) AS tx, (SELECT sum(c * (c - 1) * (2 * c + 5)) FROM (SELECT count(*) AS c FROM p GROUP BY y)) AS ty),
  h AS (SELECT m, 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - tx - ty) / 18.0) AS half FROM z),
  e AS (SELECT least(round_even((m + half) / 2, 0)::BIGINT, m - 1) AS hi, greatest(round_even((m - half) / 2, 0)::BIGINT - 1, 0) AS lo FROM h),
  r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
  SELECT (SELECT quantile_cont(slope, 0.5) FROM s) AS slope, (SELECT slope FROM o, e WHERE i = lo) AS slope_low, (SELECT slope FROM o, e WHERE i = hi) AS slope_high,
  (SELECT corr(rx, ry) FROM r) AS rho, (SELECT count(*) FROM p) AS n""")
def an9(t):
    e = _nations(t)
    return SP.theil_sen(e, "capacity", "mean_rate").crossJoin(F.broadcast(ST.spearman(e, [], "capacity", "mean_rate")))


@query("an10_week_profile_similarity", "a:s b:s n:i r:f same_group:i", """
  WITH c AS (SELECT entity, dow, hod, avg(rate) AS m FROM hg_panel GROUP BY ALL), z AS (SELECT entity, dow, hod, (m - avg(m) OVER (PARTITION BY entity)) / stddev_samp(m) OVER (PARTITION BY entity) AS z FROM c),
  g AS (SELECT entity, coalesce(grp, 'none') AS g FROM hg_entities)
  SELECT x.entity AS a, y.entity AS b, count(*) AS n, corr(x.z, y.z) AS r, CAST(any_value(gx.g) = any_value(gy.g) AS INT) AS same_group
  FROM z x JOIN z y ON x.dow = y.dow AND x.hod = y.hod AND x.entity < y.entity JOIN g gx ON gx.entity = x.entity JOIN g gy ON gy.entity = y.entity GROUP BY x.entity, y.entity""")
def an10(t):
    z = SP.z_scored_profile(t.panel, "entity", ["dow", "hod"], "rate")
    return SP.group_contrast(SP.pair_correlation(z, "entity", ["dow", "hod"], "z"), t.entities)


@query("an11_distance_similarity", "a:s b:s n:i r:f km:f", """
  SELECT x.entity AS a, y.entity AS b, count(*) AS n, CASE WHEN count(*) >= 200 THEN corr(x.rate, y.rate) END AS r,
  any_value(2 * 6371 * asin(sqrt(sin(radians(f.lat - e.lat) / 2) ** 2 + cos(radians(e.lat)) * cos(radians(f.lat)) * sin(radians(f.lon - e.lon) / 2) ** 2))) AS km
  FROM hg_panel x JOIN hg_panel y ON x.hour = y.hour AND x.entity < y.entity JOIN hg_entities e ON e.entity = x.entity JOIN hg_entities f ON f.entity = y.entity GROUP BY x.entity, y.entity""")
def an11(t):
    return SP.with_distance(SP.pair_correlation(t.panel, "entity", ["hour"], "rate", 200), t.entities)


_TWO = """two AS (SELECT hour, avg(rate) FILTER (WHERE grp = 'centrum') AS i, avg(rate) FILTER (WHERE coalesce(grp, '') <> 'centrum') AS o FROM hg_panel GROUP BY 1)"""


@query("an12_spill_over", "threshold:f lag:i n_high:i n_low:i mean_high:f mean_low:f delta:f", f"""
  WITH {_TWO} SELECT thr AS threshold, k AS lag, count(*) FILTER (WHERE a.i >= thr) AS n_high, count(*) FILTER (WHERE a.i < thr) AS n_low, avg(b.o) FILTER (WHERE a.i >= thr) AS mean_high, avg(b.o) FILTER (WHERE a.i < thr) AS mean_low,
  CASE WHEN count(*) FILTER (WHERE a.i >= thr) >= 20 AND count(*) FILTER (WHERE a.i < thr) >= 20 THEN avg(b.o) FILTER (WHERE a.i >= thr) - avg(b.o) FILTER (WHERE a.i < thr) END AS delta
  FROM two a, (VALUES (0.3::DOUBLE), (0.5), (0.9)) h(thr), (VALUES (0), (1), (3)) l(k), two b WHERE b.hour = a.hour + to_hours(k) AND a.i IS NOT NULL AND b.o IS NOT NULL GROUP BY ALL""")
def an12(t):
    return SP.spill_over(SP.two_group_hours(t.panel, "rate", "grp", "centrum"), [0.3, 0.5, 0.9], [0, 1, 3])


@query("an12_share_spill_over", "threshold:f lag:i n_high:i n_low:i delta:f", """
  WITH two AS (SELECT hour, avg(CAST(rate >= 0.4 AS INT)) FILTER (WHERE grp = 'centrum') AS i, avg(rate) FILTER (WHERE coalesce(grp, '') <> 'centrum') AS o FROM hg_panel GROUP BY 1)
  SELECT 0.5 AS threshold, k AS lag, count(*) FILTER (WHERE a.i >= 0.5) AS n_high, count(*) FILTER (WHERE a.i < 0.5) AS n_low, CASE WHEN count(*) FILTER (WHERE a.i >= 0.5) >= 20 AND count(*) FILTER (WHERE a.i < 0.5) >= 20
  THEN avg(b.o) FILTER (WHERE a.i >= 0.5) - avg(b.o) FILTER (WHERE a.i < 0.5) END AS delta FROM two a, (VALUES (0), (1), (3)) l(k), two b WHERE b.hour = a.hour + to_hours(k) AND a.i IS NOT NULL AND b.o IS NOT NULL GROUP BY ALL""")
def an12_share(t):
    p = t.panel.withColumn("x", F.when(F.col("grp") == "centrum", (F.col("rate") >= 0.4).cast("double")).otherwise(F.col("rate")))
    return SP.spill_over(SP.two_group_hours(p, "x", "grp", "centrum"), [0.5], [0, 1, 3])


@query("an13_lead_lag", "lag:i n:i r:f", f"""
  WITH {_TWO} SELECT k AS lag, count(*) AS n, corr(a.i, b.o) AS r FROM two a, (SELECT unnest(range(-6, 7)) AS k), two b WHERE b.hour = a.hour + to_hours(CAST(k AS INT)) AND a.i IS NOT NULL AND b.o IS NOT NULL GROUP BY 1""")
def an13(t):
    return SP.lead_lag(SP.two_group_hours(t.panel, "rate", "grp", "centrum"), list(range(-6, 7)))


@query("an14_dataset_comparison", "scope:s n1:i n0:i m1:f m0:f delta:f cohen_d:f", """
  WITH u AS (SELECT 1 AS dense, value, hod, dow FROM hg_panel UNION ALL SELECT 0, value, hod, dow FROM hg_sparse), s AS (SELECT 'all' AS scope, * FROM u UNION ALL SELECT 'day', * FROM u WHERE hod BETWEEN 8 AND 19 UNION ALL SELECT 'weekend', * FROM u WHERE dow >= 5),
  a AS (SELECT scope, count(*) FILTER (WHERE dense = 1) AS n1, count(*) FILTER (WHERE dense = 0) AS n0, avg(value) FILTER (WHERE dense = 1) AS m1, avg(value) FILTER (WHERE dense = 0) AS m0, var_samp(value) FILTER (WHERE dense = 1) AS v1, var_samp(value) FILTER (WHERE dense = 0) AS v0 FROM s GROUP BY 1)
  SELECT scope, n1, n0, m1, m0, m1 - m0 AS delta, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS cohen_d FROM a""")
def an14(t):
    u = t.panel.select("value", "hod", "dow", F.lit(True).alias("dense")).unionByName(t.sparse.select("value", "hod", "dow", F.lit(False).alias("dense")))
    scopes = F.filter(F.array(F.lit("all"), F.when(F.col("hod").between(8, 19), "day"), F.when(F.col("dow") >= 5, "weekend")), lambda s: s.isNotNull())
    return D.cohen_d(u.withColumn("scope", F.explode(scopes)), ["scope"], F.col("dense"), "value")


@query("an14_profile_similarity", "scope:s r:f mae:f n:i", """
  WITH a AS (SELECT weekend, hod, avg(value) AS x FROM hg_panel GROUP BY ALL), b AS (SELECT weekend, hod, avg(value) AS y FROM hg_sparse GROUP BY ALL)
  SELECT CASE WHEN weekend = 1 THEN 'weekend' ELSE 'weekday' END AS scope, corr(x, y) AS r, avg(abs(x - y)) AS mae, count(*) AS n FROM a JOIN b USING (weekend, hod) GROUP BY 1""")
def an14_profile(t):
    u = t.panel.select("weekend", "hod", "value", F.lit(1).alias("d")).unionByName(t.sparse.select("weekend", "hod", "value", F.lit(0).alias("d")))
    p = u.groupBy("weekend", "hod").agg(F.avg(F.when(F.col("d") == 1, F.col("value"))).alias("x"), F.avg(F.when(F.col("d") == 0, F.col("value"))).alias("y"))
    return p.groupBy(F.when(F.col("weekend") == 1, "weekend").otherwise("weekday").alias("scope")).agg(
        F.corr("x", "y").alias("r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.count("*").alias("n"))


@query("an15_bin_response", "entity:s bin:i n:i mean:f", """
  WITH e AS (SELECT entity, quantile_cont(humidity, 0.25) AS a, quantile_cont(humidity, 0.5) AS b, quantile_cont(humidity, 0.75) AS c FROM hg_mad WHERE humidity IS NOT NULL GROUP BY 1)
  SELECT entity, 1 + CAST(humidity > a AS INT) + CAST(humidity > b AS INT) + CAST(humidity > c AS INT) AS bin, count(*) AS n, avg(rate) AS mean FROM hg_mad JOIN e USING (entity) WHERE humidity IS NOT NULL GROUP BY ALL""")
def an15(t):
    return SE.bin_response(t.mad.select("entity", "humidity", "rate"), ["entity"], "humidity", "rate", 4)


@query("an15_top_bottom_delta", "entity:s low_mean:f high_mean:f n_bins:i delta:f", """
  WITH e AS (SELECT entity, quantile_cont(humidity, 0.25) AS a, quantile_cont(humidity, 0.75) AS c FROM hg_mad WHERE humidity IS NOT NULL GROUP BY 1)
  SELECT entity, avg(rate) FILTER (WHERE humidity <= a) AS low_mean, avg(rate) FILTER (WHERE humidity > c) AS high_mean, 4 AS n_bins, avg(rate) FILTER (WHERE humidity > c) - avg(rate) FILTER (WHERE humidity <= a) AS delta FROM hg_mad JOIN e USING (entity) WHERE humidity IS NOT NULL GROUP BY 1""")
def an15_delta(t):
    return SE.top_bottom_delta(SE.bin_response(t.mad.select("entity", "humidity", "rate"), ["entity"], "humidity", "rate", 4), ["entity"])


@query("an15_rain_bins", "bin:s n:i mean:f median:f", """
  SELECT CASE WHEN precip = 0 THEN '0' WHEN precip <= 1 THEN '0-1' WHEN precip <= 3 THEN '1-3' WHEN precip <= 8 THEN '3-8' ELSE '8+' END AS bin, count(*) AS n, avg(rate) AS mean, quantile_cont(rate, 0.5) AS median FROM hg_mad WHERE precip IS NOT NULL GROUP BY 1""")
def an15_rain(t):
    b = S.right_closed("precip", [-0.01, 0.0, 1.0, 3.0, 8.0, 100000.0], ["0", "0-1", "1-3", "3-8", "8+"])
    df = t.mad.where("precip IS NOT NULL").select(b.alias("bin"), "rate")
    return df.groupBy("bin").agg(F.count("*").alias("n"), F.avg("rate").alias("mean")).join(D.quantiles(df, ["bin"], "rate", {"median": 0.5}), "bin")


@query("an16_threshold_effect", "entity:s threshold:f pct_high:f delta:f", """
  WITH e AS (SELECT entity, quantile_cont(wind, 0.9) AS q FROM hg_mad GROUP BY 1)
  SELECT entity, q AS threshold, 100 * avg(CAST(wind >= q AS INT)) AS pct_high, avg(rate) FILTER (WHERE wind >= q) - avg(rate) FILTER (WHERE wind < q) AS delta FROM hg_mad JOIN e USING (entity) GROUP BY ALL""")
def an16(t):
    return SE.threshold_effect(t.mad.select("entity", "wind", "rate"), ["entity"], "wind", "rate")


@query("an17_smooth_response", "x:f y_smooth:f5", """
  WITH d AS (SELECT humidity AS x, count(*)::DOUBLE AS n, avg(rate) AS y FROM hg_mad WHERE humidity IS NOT NULL GROUP BY 1), r AS (SELECT min(x) AS a, max(x) AS b, sum(n) AS total FROM d),
  g AS (SELECT i, a + (b - a) * i / 99 AS x0, total FROM r, (SELECT unnest(range(0, 100)) AS i)), m AS (SELECT *, abs(x - x0) AS dist FROM d, g),
  c AS (SELECT i, dist, sum(n) OVER (PARTITION BY i ORDER BY dist) AS cum, total FROM m), h AS (SELECT i, min(dist) AS h FROM c WHERE cum >= total * 0.2 GROUP BY 1),
  k AS (SELECT i, x0, y, x - x0 AS z, n * (1 - least(dist / h, 1) ** 3) ** 3 AS w FROM m JOIN h USING (i) WHERE h > 0),
  s AS (SELECT i, x0, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * y) AS t0, sum(w * z * y) AS t1 FROM k GROUP BY ALL)
  SELECT x0 AS x, CASE WHEN s0 * s2 - s1 * s1 > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS y_smooth FROM s""")
def an17(t):
    return SE.smooth_response(t.mad.select("humidity", "rate"), "humidity", "rate")


_PHASES = ["pre_far(-8,-3]", "pre_near(-3,-1]", "kick_window(-1,0.5]", "post_short(0.5,2.5]", "post_mid(2.5,6]", "post_late(6,12]"]


@query("an18_kickoff_phases", "phase:s n:i mean:f", """
  SELECT CASE WHEN d > -8 AND d <= -3 THEN 'pre_far(-8,-3]' WHEN d > -3 AND d <= -1 THEN 'pre_near(-3,-1]' WHEN d > -1 AND d <= 0.5 THEN 'kick_window(-1,0.5]' WHEN d > 0.5 AND d <= 2.5 THEN 'post_short(0.5,2.5]' WHEN d > 2.5 AND d <= 6 THEN 'post_mid(2.5,6]'
  ELSE 'post_late(6,12]' END AS phase, count(*) AS n, avg(rate) AS mean FROM (SELECT hod - kickoff_hour AS d, rate FROM hg_mad) WHERE d > -8 AND d <= 12 GROUP BY 1""")
def an18(t):
    d = t.mad.where("kickoff_hour IS NOT NULL").select((F.col("hod") - F.col("kickoff_hour")).alias("d"), "rate")
    # The first phase is open at -8: a bin edge is never in the bin above it.
    phase = S.right_closed(F.when(F.col("d") > -8, F.col("d")), [-8.0, -3.0, -1.0, 0.5, 2.5, 6.0, 12.0], _PHASES)
    return d.withColumn("phase", phase).where("phase IS NOT NULL").groupBy("phase").agg(F.count("*").alias("n"), F.avg("rate").alias("mean"))


@query("an18_event_day_windows", "lag_days:i n_window:i n_baseline:i delta:f", """
  WITH d AS (SELECT entity, day, avg(rate) AS occ, CAST(max(disc) % 11 = 0 AS INT) AS e FROM hg_daily GROUP BY ALL), l AS (SELECT *, coalesce(max(e) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY FOLLOWING), 0) AS near FROM d)
  SELECT k AS lag_days, sum(CAST(x.e = 1 AS INT)) AS n_window, (SELECT count(*) FROM l WHERE near = 0) AS n_baseline, avg(l.occ) FILTER (WHERE x.e = 1) - (SELECT avg(occ) FROM l WHERE near = 0) AS delta
  FROM l CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) v(k) LEFT JOIN d x ON x.entity = l.entity AND x.day = l.day + CAST(-k AS INT) GROUP BY k""")
def an18_windows(t):
    d = t.daily.select("entity", "day", F.col("d").cast("bigint").alias("d"), F.col("rate").alias("occ"), (F.col("disc") % 11 == 0).cast("int").alias("e"))
    frames = {"near": (F.max("e"), -2, 2), **{f"e_{k + 2}": (F.max("e"), -k, -k) for k in range(-2, 3)}}
    x = frame_aggregates(d, ["entity"], "d", frames, chunk=365)
    arms = [F.struct(F.lit(k).alias("lag_days"), F.col(f"e_{k + 2}").alias("w")) for k in range(-2, 3)]
    long = x.select("near", "occ", F.inline(F.array(*arms)))
    win, far = F.coalesce(F.col("w") == 1, F.lit(False)), F.col("near") == 0
    return long.groupBy("lag_days").agg(F.count_if(win).alias("n_window"), F.count_if(far).alias("n_baseline"),
                                        (F.avg(F.when(win, F.col("occ"))) - F.avg(F.when(far, F.col("occ")))).alias("delta"))


@query("an19_scale_response", "feature:s level:i n:i mean:f", """
  SELECT 'event_scale_max' AS feature, event_scale_max AS level, count(*) AS n, avg(rate) AS mean FROM hg_mad GROUP BY ALL UNION ALL SELECT 'n_concurrent_events', n_concurrent_events, count(*), avg(rate) FROM hg_mad GROUP BY ALL""")
def an19(t):
    long = t.mad.select("rate", "event_scale_max", "n_concurrent_events").unpivot(["rate"], ["event_scale_max", "n_concurrent_events"], "feature", "level")
    return long.groupBy("feature", "level").agg(F.count("*").alias("n"), F.avg("rate").alias("mean"))


@query("an19_monotonic_trend", "entity:s n:i rho:f", """
  SELECT entity, count(*) AS n, corr(a, b) AS rho FROM (SELECT entity, rank() OVER (PARTITION BY entity ORDER BY n_concurrent_events) + (count(*) OVER (PARTITION BY entity, n_concurrent_events) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY entity ORDER BY occupied) + (count(*) OVER (PARTITION BY entity, occupied) - 1) / 2.0 AS b FROM hg_mad WHERE is_event_day = 1) GROUP BY 1""")
def an19_trend(t):
    ev = t.mad.where("is_event_day = 1").select("entity", "n_concurrent_events", "occupied")
    return ST.spearman(ev, ["entity"], "n_concurrent_events", "occupied")


@query("quality_share_by_group", "grp:s null_share:f", "SELECT coalesce(grp, 'none') AS grp, avg(CAST(rate_in IS NULL AS INT)) AS null_share FROM hg_reported GROUP BY 1")
def quality_share(t):
    return Q.null_shares(t.reported.withColumn("grp", F.coalesce("grp", F.lit("none"))), ["rate_in"], ["grp"]).drop("column")
