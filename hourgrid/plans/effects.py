"""Effect sizes and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import significance as ST
from hourgrid.operators.windows import exact_lags
from hourgrid.plans.registry import query


def norm_p(z: str) -> str:
    """SQL for the two-sided normal tail: the error function as a series of positive terms."""
    x = f"(abs({z}) / sqrt(2))"
    series = f"list_sum(list_transform(range(0, 120), lambda n: exp(-{x} * {x} + (2 * n + 1) * ln({x}) - lgamma(n + 1.5))))"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {x} = 0 THEN 1.0 WHEN {x} > 5.5 THEN 0.0 ELSE greatest(0.0, 1 - {series}) END)"


@query("st1_binary_effect", "entity:s n1:i n0:i mean1:f mean0:f delta:f", """
  SELECT entity, count(*) FILTER (WHERE e = 1) AS n1, count(*) FILTER (WHERE e = 0) AS n0, avg(rate) FILTER (WHERE e = 1) AS mean1, avg(rate) FILTER (WHERE e = 0) AS mean0,
  CASE WHEN count(*) FILTER (WHERE e = 1) >= 30 AND count(*) FILTER (WHERE e = 0) >= 30 THEN avg(rate) FILTER (WHERE e = 1) - avg(rate) FILTER (WHERE e = 0) END AS delta FROM (SELECT *, is_event_day AS e FROM hg_mad) GROUP BY 1""")
def st1(t):
    return ST.binary_effect(t.mad, ["entity"], "is_event_day", "rate")


@query("st1_label_effect", "lang:s n1:i n0:i mean1:f4 mean0:f4 delta:f4", """
  SELECT lang, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, avg(n_chars) FILTER (WHERE quality = 1) AS mean1, avg(n_chars) FILTER (WHERE quality = 0) AS mean0,
  CASE WHEN count(*) FILTER (WHERE quality = 1) >= 10 AND count(*) FILTER (WHERE quality = 0) >= 10 THEN avg(n_chars) FILTER (WHERE quality = 1) - avg(n_chars) FILTER (WHERE quality = 0) END AS delta FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def st1_labels(t):
    d = t.table("documents").select("doc_id", "lang", "n_chars").join(t.table("labels").select("doc_id", "quality"), "doc_id")
    return ST.binary_effect(d, ["lang"], "quality", "n_chars", 10)


@query("st2_period_adjusted_delta", "entity:s adjusted_delta:f n_periods:i", """
  WITH m AS (SELECT entity, week, count(*) AS n, avg(rate) FILTER (WHERE is_event_day = 1) - avg(rate) FILTER (WHERE is_event_day = 0) AS d FROM hg_mad GROUP BY ALL
  HAVING count(*) FILTER (WHERE is_event_day = 1) >= 20 AND count(*) FILTER (WHERE is_event_day = 0) >= 20) SELECT entity, sum(d * n) / sum(n) AS adjusted_delta, count(*) AS n_periods FROM m GROUP BY 1""")
def st2(t):
    return ST.adjusted_delta(t.mad, ["entity"], "week", "is_event_day", "rate")


def _mwu_sql(by: str, source: str) -> str:
    part = f"PARTITION BY {by}"
    return f"""SELECT {by}, n1, n0, u, (abs(u - n1 * n0 / 2.0) - 0.5) / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1.0)))) AS z, 2 * u / (n1 * n0)::DOUBLE - 1 AS cliffs_delta FROM (
      SELECT {by}, count(*) FILTER (WHERE e = 1) AS n1, count(*) FILTER (WHERE e = 0) AS n0, sum(r) FILTER (WHERE e = 1) - count(*) FILTER (WHERE e = 1) * (count(*) FILTER (WHERE e = 1) + 1) / 2.0 AS u, sum(c * c - 1)::DOUBLE AS tie
      FROM (SELECT {by}, e, rank() OVER ({part} ORDER BY v) + (count(*) OVER ({part}, v) - 1) / 2.0 AS r, count(*) OVER ({part}, v) AS c FROM ({source})) GROUP BY ALL)"""


_MWU_ENTITY = _mwu_sql("entity", "SELECT entity, is_event_day AS e, occupied AS v FROM hg_mad")


@query("st3_mann_whitney", "entity:s n1:i n0:i u:f z:f p_value:f cliffs_delta:f", f"SELECT *, {norm_p('z')} AS p_value FROM ({_MWU_ENTITY})")
def st3(t):
    return ST.mann_whitney(t.mad, ["entity"], "is_event_day", "occupied")


_DELTAS = """del AS (SELECT hod, CASE WHEN grp = 'centrum' THEN 'in' ELSE 'out' END AS side, count(*) FILTER (WHERE weekend = 1) AS n1, count(*) FILTER (WHERE weekend = 0) AS n0, avg(rate) FILTER (WHERE weekend = 1) - avg(rate) FILTER (WHERE weekend = 0) AS delta,
  sqrt(var_samp(rate) FILTER (WHERE weekend = 1) / count(*) FILTER (WHERE weekend = 1) + var_samp(rate) FILTER (WHERE weekend = 0) / count(*) FILTER (WHERE weekend = 0)) AS se FROM hg_panel GROUP BY ALL)"""


def _deltas(t):
    p = t.panel.withColumn("side", F.when(F.coalesce(F.col("grp") == "centrum", F.lit(False)), "in").otherwise("out"))
    return ST.delta_with_se(p, ["hod", "side"], "weekend", "rate")


@query("st4_difference_in_differences", "hod:i delta_a:f delta_b:f difference:f", """
  WITH nano AS (SELECT hod, CASE WHEN grp = 'centrum' THEN 'in' ELSE 'out' END AS side, weekend, occupied::BIGINT * 1000000000 // capacity::BIGINT AS v FROM hg_panel),
  del AS (SELECT hod, side, sum(v) FILTER (WHERE weekend = 1)::DOUBLE / count(*) FILTER (WHERE weekend = 1) - sum(v) FILTER (WHERE weekend = 0)::DOUBLE / count(*) FILTER (WHERE weekend = 0) AS delta FROM nano GROUP BY ALL)
  SELECT hod, max(delta) FILTER (WHERE side = 'in') / 1e9 AS delta_a, max(delta) FILTER (WHERE side = 'out') / 1e9 AS delta_b, (max(delta) FILTER (WHERE side = 'in') - max(delta) FILTER (WHERE side = 'out')) / 1e9 AS difference FROM del GROUP BY 1""")
def st4(t):
    # Rates in whole billionths: sums of doubles depend on the order of tasks, and a mean on a rounding edge shows it.
    p = t.panel.withColumn("side", F.when(F.coalesce(F.col("grp") == "centrum", F.lit(False)), "in").otherwise("out"))
    deltas = ST.delta_with_se(p.withColumn("nano", F.expr("occupied * 1000000000L div cast(capacity as bigint)")), ["hod", "side"], "weekend", "nano")
    out = ST.difference_of_deltas(deltas, ["hod"], "side", "in", "out")
    return out.select("hod", *[(F.col(c) / 1e9).alias(c) for c in ("delta_a", "delta_b", "difference")])


_ZTEST = f"""{_DELTAS}, zt AS (SELECT hod, (max(delta) FILTER (WHERE side = 'in') - max(delta) FILTER (WHERE side = 'out')) / sqrt((max(se) FILTER (WHERE side = 'in')) ** 2 + (max(se) FILTER (WHERE side = 'out')) ** 2) AS z FROM del GROUP BY 1)"""


@query("st5_delta_z_test", "hod:i z:f p_value:f", f"WITH {_ZTEST} SELECT hod, z, {norm_p('z')} AS p_value FROM zt")
def st5(t):
    return ST.difference_of_deltas(_deltas(t), ["hod"], "side", "in", "out")


def _spear_sql(by: str, x: str, y: str, source: str) -> str:
    p = f"PARTITION BY {by}"
    return f"""SELECT {by}, count(*) AS n, corr(a, b) AS rho FROM (SELECT {by}, rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({p}, {x}) - 1) / 2.0 AS a, rank() OVER ({p} ORDER BY {y}) + (count(*) OVER ({p}, {y}) - 1) / 2.0 AS b FROM ({source})) GROUP BY {by}"""


_SP_ENTITY = _spear_sql("entity", "humidity", "occupied", "SELECT entity, humidity, occupied FROM hg_mad WHERE humidity IS NOT NULL")


@query("st6_spearman", "entity:s n:i rho:f t_stat:f", f"SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_stat FROM ({_SP_ENTITY})")
def st6(t):
    return ST.spearman(t.mad, ["entity"], "humidity", "occupied")


@query("st6_spearman_centred", "entity:s n:i rho:f", _spear_sql("entity", "x", "y", """
  SELECT entity, round(humidity - avg(humidity) OVER (PARTITION BY entity, week), 9) AS x, round(occupied - avg(occupied) OVER (PARTITION BY entity, week), 9) AS y FROM hg_mad WHERE humidity IS NOT NULL"""))
def st6_centred(t):
    return ST.spearman_centred(t.mad.select("entity", "week", "humidity", F.col("occupied").cast("double").alias("occupied")), ["entity"], "week", "humidity", "occupied")


@query("st7_fisher_z", "a:s b:s z:f p_value:f", f"""
  WITH s AS ({_SP_ENTITY}), p AS (SELECT x.entity AS a, y.entity AS b, (atanh(x.rho) - atanh(y.rho)) / sqrt(1 / (x.n - 3.0::DOUBLE) + 1 / (y.n - 3.0::DOUBLE)) AS z FROM s x JOIN s y ON x.entity < y.entity)
  SELECT a, b, z, {norm_p('z')} AS p_value FROM p""")
def st7(t):
    s = ST.spearman(t.mad, ["entity"], "humidity", "occupied")
    x, y = s.select(F.col("entity").alias("a"), F.col("rho").alias("r1"), F.col("n").alias("n1")), s.select(F.col("entity").alias("b"), F.col("rho").alias("r2"), F.col("n").alias("n2"))
    return ST.fisher_difference(x.join(y, F.col("a") < F.col("b")), "r1", "n1", "r2", "n2")


@query("st8_benjamini_hochberg", "hod:i p_value:f q:f", f"""
  WITH {_ZTEST}, p AS (SELECT hod, {norm_p('z')} AS p_value FROM zt) SELECT hod, p_value, least(1, min(p_value * n / r) OVER (ORDER BY r DESC)) AS q FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value, hod) AS r FROM p)""")
def st8(t):
    return ST.adjust_bh(ST.difference_of_deltas(_deltas(t), ["hod"], "side", "in", "out"), "p_value", "q", (), ["hod"])


_CATALOGUE = f"""{_ZTEST}, cat AS (SELECT 'entity_x_event' AS family, entity AS test_id, {norm_p('z')} AS p_value, cliffs_delta AS effect, 'delta' AS effect_metric FROM ({_MWU_ENTITY})
  UNION ALL SELECT 'hour_x_weekend', CAST(hod AS VARCHAR), {norm_p('z')}, difference, 'delta_diff' FROM zt JOIN (SELECT hod, max(delta) FILTER (WHERE side = 'in') - max(delta) FILTER (WHERE side = 'out') AS difference FROM del GROUP BY 1) USING (hod)),
  lab AS (SELECT *, round(least(1, min(p_value * n / r) OVER (ORDER BY r DESC)), 9) AS q_global, round(least(1, min(p_value * nf / rf) OVER (PARTITION BY family ORDER BY rf DESC)), 9) AS q_family FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value, test_id) AS r,
    count(*) OVER (PARTITION BY family) AS nf, row_number() OVER (PARTITION BY family ORDER BY p_value, test_id) AS rf FROM cat)),
  ev AS (SELECT *, CASE WHEN q_global < 0.05 AND abs(effect) >= 0.02 THEN 'robust (stat + practical)' WHEN q_global < 0.05 THEN 'detectable but small' ELSE 'inconclusive' END AS evidence FROM lab)"""


def _catalogue(t):
    a = ST.mann_whitney(t.mad, ["entity"], "is_event_day", "occupied").select(
        F.lit("entity_x_event").alias("family"), F.col("entity").alias("test_id"), "p_value", F.col("cliffs_delta").alias("effect"), F.lit("delta").alias("effect_metric"))
    b = ST.difference_of_deltas(_deltas(t), ["hod"], "side", "in", "out").select(
        F.lit("hour_x_weekend").alias("family"), F.col("hod").cast("string").alias("test_id"), "p_value", F.col("difference").alias("effect"), F.lit("delta_diff").alias("effect_metric"))
    tests = ST.adjust_bh(a.unionByName(b), "p_value", "q_global", (), ["test_id"])
    tests = ST.adjust_bh(tests, "p_value", "q_family", ["family"], ["test_id"])
    return ST.evidence(tests, "q_global", "effect", ST.THRESHOLDS, "effect_metric")


@query("st9_evidence_catalogue", "family:s test_id:s q_global:f q_family:f effect:f evidence:s", f"WITH {_CATALOGUE} SELECT * FROM ev")
def st9(t):
    return _catalogue(t)


@query("st9_family_summary", "family:s n_tests:i n_global:i n_family:i n_robust:i", f"""
  WITH {_CATALOGUE} SELECT family, count(*) AS n_tests, count(*) FILTER (WHERE q_global < 0.05) AS n_global, count(*) FILTER (WHERE q_family < 0.05) AS n_family, count(*) FILTER (WHERE evidence LIKE 'robust%') AS n_robust FROM ev GROUP BY 1""")
def st9_summary(t):
    return _catalogue(t).groupBy("family").agg(F.count("*").alias("n_tests"), F.count_if(F.col("q_global") < 0.05).alias("n_global"),
                                               F.count_if(F.col("q_family") < 0.05).alias("n_family"), F.count_if(F.col("evidence") == ST.ROBUST).alias("n_robust"))


@query("st10_hourly_event_effects", "hod:i n1:i n0:i u:f p_value:f cliffs_delta:f", f"SELECT *, {norm_p('z')} AS p_value FROM ({_mwu_sql('hod', 'SELECT hod, is_event_day AS e, occupied AS v FROM hg_mad')})")
def st10(t):
    return ST.mann_whitney(t.mad, ["hod"], "is_event_day", "occupied")


@query("st10_weekpart_event_effects", "weekend:i n1:i n0:i u:f p_value:f cliffs_delta:f", f"SELECT *, {norm_p('z')} AS p_value FROM ({_mwu_sql('weekend', 'SELECT weekend, is_event_day AS e, occupied AS v FROM hg_mad')})")
def st10_week(t):
    return ST.mann_whitney(t.mad, ["weekend"], "is_event_day", "occupied")


@query("st11_diebold_mariano", "n:i mean_d:f dm_stat:f p_value:f", f"""
  WITH e AS (SELECT a.entity, a.hour, abs(a.rate - b.rate) - abs(a.rate - c.rate) AS d FROM hg_panel a JOIN hg_panel b ON a.entity = b.entity AND b.hour = a.hour - INTERVAL 1 HOUR JOIN hg_panel c ON a.entity = c.entity AND c.hour = a.hour - INTERVAL 24 HOUR),
  i AS (SELECT row_number() OVER (ORDER BY entity, hour) AS i, d FROM e), cv AS (SELECT k, covar_samp(x.d, y.d) AS c FROM i x CROSS JOIN (SELECT unnest(range(1, 25)) AS k) JOIN i y ON y.i = x.i - k GROUP BY 1),
  s AS (SELECT count(*) AS n, avg(d) AS mean_d, var_samp(d) + (SELECT sum(2 * (1 - k / 25.0::DOUBLE) * c) FROM cv) AS s FROM i), z AS (SELECT n, mean_d, mean_d / sqrt(s / n) AS dm_stat FROM s)
  SELECT *, {norm_p('dm_stat')} AS p_value FROM z""")
def st11(t):
    x = exact_lags(t.panel.select("entity", "hour", "t", "rate"), ["entity"], "t", "rate", [1, 24])
    x = x.withColumns({"e1": F.col("rate") - F.col("lag_1h"), "e2": F.col("rate") - F.col("lag_24h")})
    return ST.diebold_mariano(x, ["entity"], "t", "e1", "e2", 24)


_RESAMPLED = f"""m AS (SELECT entity, is_event_day AS a, rate AS v, entity || '|' || t AS key, {ST.sql_key_number("entity || '|' || t")} AS x FROM hg_mad WHERE rate IS NOT NULL AND is_event_day IS NOT NULL),
  r AS (SELECT unnest(range(1, 401)) AS rep)"""


@query("st12_bootstrap_interval", "boot_mean:f ci_low:f ci_high:f", f"""
  WITH {_RESAMPLED}, u AS (SELECT rep, a, v, {ST.sql_drawn('x', 'rep')} AS u FROM m, r), w AS (SELECT rep, a, v, {' + '.join(f'(u >= {c})::INT' for c in ST.poisson_cuts())} AS w FROM u),
  d AS (SELECT rep, sum(w * v) FILTER (WHERE a = 1) / sum(w) FILTER (WHERE a = 1) - sum(w * v) FILTER (WHERE a = 0) / sum(w) FILTER (WHERE a = 0) AS delta FROM w GROUP BY 1)
  SELECT avg(delta) AS boot_mean, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM d""")
def st12(t):
    m = t.mad.select(F.lit("all").alias("g"), F.col("is_event_day").alias("a"), "rate", F.concat_ws("|", "entity", F.col("t").cast("string")).alias("key"))
    return ST.bootstrap_delta(m, ["g"], "a", "rate", "key", reps=400)


@query("st13_permutation_p", "entity:s delta:f p_value:f", f"""
  WITH {_RESAMPLED}, n AS (SELECT entity, count(*) FILTER (WHERE a = 1) AS n1, count(*) FILTER (WHERE a = 0) AS n0, sum(v) AS whole, avg(v) FILTER (WHERE a = 1) - avg(v) FILTER (WHERE a = 0) AS obs FROM m GROUP BY 1),
  o AS (SELECT entity, rep, v, row_number() OVER (PARTITION BY entity, rep ORDER BY {ST.sql_drawn('x', 'rep')}, key) AS i FROM m, r),
  s AS (SELECT entity, rep, sum(v) FILTER (WHERE i <= n1) AS s1, any_value(n1) AS n1, any_value(n0) AS n0, any_value(whole) AS whole, any_value(obs) AS obs FROM o JOIN n USING (entity) WHERE n1 > 0 AND n0 > 0 GROUP BY ALL)
  SELECT entity, any_value(obs) AS delta, greatest(avg((abs(s1 / n1 - (whole - s1) / n0) >= abs(obs))::INT), 1 / 400.0::DOUBLE) AS p_value FROM s GROUP BY 1""")
def st13(t):
    m = t.mad.select("entity", F.col("is_event_day").alias("a"), "rate", F.concat_ws("|", "entity", F.col("t").cast("string")).alias("key"))
    return ST.permutation_p(m, ["entity"], "a", "rate", "key", reps=400)
