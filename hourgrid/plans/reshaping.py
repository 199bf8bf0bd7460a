"""Sorts, limits, set operations, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions import scalar as S
from hourgrid.operators import quantile as QT
from hourgrid.operators import spatial as SP
from hourgrid.operators.evaluate import required_present
from hourgrid.operators.explain import top_overlap
from hourgrid.plans.registry import query
from hourgrid.session import stage_path
from hourgrid.sources import readers as R


@query("sl1_mixed_sort", "lang:s source:s n:i mean_chars:f", "SELECT lang, source, count(*) AS n, avg(n_chars) AS mean_chars FROM documents GROUP BY ALL ORDER BY n DESC, mean_chars, lang, source")
def sl1(t):
    d = t.table("documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
    return d.orderBy(F.desc("n"), "mean_chars", "lang", "source")


@query("sl2_top_and_tail", "side:s doc_id:i n_chars:i", """
  (SELECT 'largest' AS side, doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) UNION ALL
  (SELECT 'smallest', doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 20)""")
def sl2(t):
    d = t.table("documents").select("doc_id", "n_chars")
    hi = d.orderBy(F.desc("n_chars"), "doc_id").limit(20).select(F.lit("largest").alias("side"), "doc_id", "n_chars")
    return hi.unionByName(d.orderBy("n_chars", "doc_id").limit(20).select(F.lit("smallest").alias("side"), "doc_id", "n_chars"))


@query("sl3_weekday_order", "position:i weekday:s n:i", "SELECT isodow(day) - 1 AS position, dayname(day) AS weekday, count(*) AS n FROM hg_daily GROUP BY ALL ORDER BY 1")
def sl3(t):
    d = t.daily.groupBy(F.date_format("day", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))
    return d.withColumn("position", S.weekday_order("weekday")).orderBy("position")


@query("sl4_export_order", "entity:s n:i disordered:i", "SELECT entity, count(*) AS n, 0 AS disordered FROM hg_panel GROUP BY 1")
def sl4(t):
    """The panel as it lies in the written files: rows of each entity, and those not in their place."""
    path = stage_path(t.spark, "export")
    R.write_panel(t.panel.select("entity", "hour", "rate"), path)
    wrong = R.disorder(t.spark, path).groupBy("entity").agg(F.count("*").alias("disordered"))
    n = t.spark.read.parquet(path).groupBy("entity").agg(F.count("*").alias("n"))
    return n.join(wrong, "entity", "left").fillna(0, ["disordered"])


@query("so1_labelled_union", "dataset:s n:i n_capacity:i", """
  SELECT 'dense' AS dataset, count(*) AS n, count(capacity) AS n_capacity FROM hg_panel UNION ALL SELECT 'sparse', count(*), 0 FROM hg_sparse""")
def so1(t):
    both = t.panel.select("entity", "hour", "value", "capacity").withColumn("dataset", F.lit("dense")).unionByName(
        t.sparse.select("entity", "hour", "value").withColumn("dataset", F.lit("sparse")), allowMissingColumns=True)
    return both.groupBy("dataset").agg(F.count("*").alias("n"), F.count("capacity").alias("n_capacity"))


@query("so2_distinct_subset", "l_partkey:i l_suppkey:i l_orderkey:i", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def so2(t):
    from hourgrid.operators.windows import latest_per_key

    return latest_per_key(t.table("lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], [F.col("l_orderkey")], earliest=True)


@query("so3_intersect", "hour:t", "SELECT hour FROM hg_panel WHERE entity = 'click' INTERSECT SELECT hour FROM hg_panel WHERE entity = 'error'")
def so3(t):
    p = t.panel.select("entity", "hour")
    return p.where("entity = 'click'").select("hour").intersect(p.where("entity = 'error'").select("hour"))


@query("so4_except", "hour:t", "SELECT hour FROM hg_panel EXCEPT SELECT hour FROM hg_panel WHERE entity = 'click'")
def so4(t):
    p = t.panel.select("entity", "hour")
    return p.select("hour").distinct().join(p.where("entity = 'click'").select("hour"), "hour", "left_anti")


@query("so5_top_set_jaccard", "run_id:s n_pairs:i mean_jaccard:f", """
  WITH s AS (SELECT week, hod, row_number() OVER (PARTITION BY week ORDER BY m DESC, CAST(hod AS VARCHAR)) AS r FROM (SELECT week, hod, round(avg(rate), 12) AS m FROM hg_panel GROUP BY ALL)),
  x AS (SELECT a.week AS wa, b.week AS wb, count(*) AS i FROM s a JOIN s b ON a.hod = b.hod AND a.week < b.week WHERE a.r <= 10 AND b.r <= 10 GROUP BY ALL),
  w AS (SELECT DISTINCT week FROM s), p AS (SELECT a.week AS wa, b.week AS wb FROM w a JOIN w b ON a.week < b.week)
  SELECT 'panel' AS run_id, count(*) AS n_pairs, avg(coalesce(i, 0) / (20 - coalesce(i, 0))::DOUBLE) AS mean_jaccard FROM p LEFT JOIN x USING (wa, wb)""")
def so5(t):
    from hourgrid.operators.windows import top_per_group

    m = t.panel.groupBy("week", "hod").agg(F.round(F.avg("rate"), 12).alias("m")).withColumn("feature", F.col("hod").cast("string"))
    imp = top_per_group(m, ["week"], [F.desc("m"), F.col("feature")], 10).withColumn("run_id", F.lit("panel"))
    return top_overlap(imp, ["run_id"], "week")


@query("so6_required_set", "entity:s", "SELECT e AS entity FROM (VALUES ('click'), ('refund'), ('view')) v(e) WHERE e NOT IN (SELECT entity FROM hg_panel)")
def so6(t):
    return required_present(t.panel, "entity", ["click", "refund", "view"], t.spark)


_YEARS = list(range(1995, 2002))


@query("rs1_pivot_single", "month:i " + " ".join(f"y{y}:i" for y in _YEARS), "SELECT month, " + ", ".join(f"max(q) FILTER (WHERE year = {y}) AS y{y}" for y in _YEARS)
       + " FROM (SELECT month, year, sum(qty) AS q FROM hg_daily GROUP BY ALL) GROUP BY 1")
def rs1(t):
    cells = t.daily.groupBy("month", "year").agg(F.sum("qty").alias("q"))
    out = cells.groupBy("month").pivot("year", _YEARS).agg(F.first("q"))
    return out.select("month", *[F.col(str(y)).alias(f"y{y}") for y in _YEARS])


_WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


@query("rs2_pivot_mean", "hod:i " + " ".join(f"{d}:f" for d in _WEEK), "SELECT hod, " + ", ".join(f"avg(rate) FILTER (WHERE dow = {i}) AS {d}" for i, d in enumerate(_WEEK)) + " FROM hg_panel GROUP BY 1")
def rs2(t):
    out = t.panel.groupBy("hod").pivot("dow", list(range(7))).agg(F.avg("rate"))
    return out.select("hod", *[F.col(str(i)).alias(d) for i, d in enumerate(_WEEK)])


@query("rs3_wide_to_long", "variable:s n:i mean:f", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean FROM hg_weather" for c in ["temp", "wind", "humidity", "shortwave"]))
def rs3(t):
    w = t.weather.select("temp", "wind", "humidity", "shortwave").unpivot([], ["temp", "wind", "humidity", "shortwave"], "variable", "v")
    return w.groupBy("variable").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


@query("rs4_correlation_pairs", "a:i b:i n:i r:f", """
  WITH c AS (SELECT year AS y, month, entity, avg(rate) AS v FROM hg_daily GROUP BY ALL)
  SELECT p.y AS a, q.y AS b, count(*) AS n, CASE WHEN count(*) >= 24 THEN corr(p.v, q.v) END AS r FROM c p JOIN c q ON p.month = q.month AND p.entity = q.entity AND p.y < q.y GROUP BY ALL""")
def rs4(t):
    cells = t.daily.groupBy("year", "month", "entity").agg(F.avg("rate").alias("v"))
    return SP.pair_correlation(cells, "year", ["month", "entity"], "v", 24)


@query("sc1_cyclical", "hod:i s:f c:f n:i", "SELECT hod, sin(2 * pi() * hod / 24) AS s, cos(2 * pi() * hod / 24) AS c, count(*) AS n FROM hg_panel GROUP BY 1")
def sc1(t):
    s, c = S.cyclical("hod", 24)
    return t.panel.groupBy("hod").agg(F.count("*").alias("n")).select("hod", s.alias("s"), c.alias("c"), "n")


@query("sc2_slug", "slug:s n:i", """
  SELECT coalesce(nullif(trim(regexp_replace(lower(trim(o_orderpriority || ' / ' || o_orderstatus)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug, count(*) AS n FROM orders GROUP BY 1""")
def sc2(t):
    return t.table("orders").groupBy(S.slug(F.concat_ws(" / ", "o_orderpriority", "o_orderstatus")).alias("slug")).agg(F.count("*").alias("n"))


@query("sc3_quantile_bins", "bucket:s n:i lo:f hi:f", """
  WITH e AS (SELECT quantile_cont(p_retailprice, 0) AS a, quantile_cont(p_retailprice, 1 / 3.0::DOUBLE) AS b, quantile_cont(p_retailprice, 2 / 3.0::DOUBLE) AS c FROM part)
  SELECT CASE WHEN p_retailprice <= b THEN 'small' WHEN p_retailprice <= c THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part, e GROUP BY 1""")
def sc3(t):
    from hourgrid.operators.features import capacity_bucket, capacity_edges

    p = t.table("part").select(F.col("p_retailprice").alias("capacity"))
    x = p.crossJoin(F.broadcast(capacity_edges(p)))
    b = capacity_bucket(F.col("capacity"), F.array("p0", "p33", "p67", "p100"))
    return x.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.min("capacity").alias("lo"), F.max("capacity").alias("hi"))


@query("sc4_fixed_bins", "bin:s n:i mean:f", """
  SELECT CASE WHEN value > -0.01 AND value <= 5 THEN '0-5' WHEN value > 5 AND value <= 20 THEN '5-20' WHEN value > 20 AND value <= 100 THEN '20-100' WHEN value > 100 AND value <= 400 THEN '100-400' END AS bin,
  count(*) AS n, avg(value) AS mean FROM events GROUP BY 1""")
def sc4(t):
    b = S.right_closed("value", [-0.01, 5.0, 20.0, 100.0, 400.0], ["0-5", "5-20", "20-100", "100-400"])
    return t.table("events").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("sc5_math", "entity:s log_sum:f square_sum:f3 product_sum:f", """
  SELECT event_type AS entity, sum(ln(1 + value)) AS log_sum, sum(value * value) AS square_sum, sum(least(value, 100) * (event_id % 2)) AS product_sum FROM events GROUP BY 1""")
def sc5(t):
    v = F.col("value")
    return t.table("events").groupBy(F.col("event_type").alias("entity")).agg(
        F.sum(F.log1p(v)).alias("log_sum"), F.sum(F.pow(v, 2)).alias("square_sum"), F.sum(S.clipped(v, high=100.0) * (F.col("event_id") % 2)).alias("product_sum"))


@query("sc6_calendar_parts", "season:s daypart:s weekend:i n:i", """
  SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
  CASE WHEN h <= 5 THEN 'night' WHEN h <= 11 THEN 'morning' WHEN h <= 17 THEN 'afternoon' ELSE 'evening' END AS daypart, CAST(isodow(o_orderdate) >= 6 AS INT) AS weekend, count(*) AS n
  FROM (SELECT *, o_orderkey % 24 AS h FROM orders) GROUP BY ALL""")
def sc6(t):
    d = F.col("o_orderdate")
    return t.table("orders").groupBy(S.season(F.month(d)).alias("season"), S.daypart(F.col("o_orderkey") % 24).alias("daypart"),
                                     (F.weekday(d) >= 5).cast("int").alias("weekend")).agg(F.count("*").alias("n"))


@query("sc7_date_parts", "period:s n:i first:d brussels_hours:i", """
  SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n, min(CAST(ts AS DATE)) AS first, count(DISTINCT hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Brussels')) AS brussels_hours FROM events GROUP BY 1""")
def sc7(t):
    ts = F.col("ts").cast("timestamp")
    e = t.table("events").select(F.date_format(ts, "yyyy-MM").alias("period"), F.to_date(ts).alias("d"), F.hour(F.from_utc_timestamp(ts, "Europe/Brussels")).alias("h"))
    per = e.groupBy("period", "h").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    return per.groupBy("period").agg(F.sum("n").alias("n"), F.min("d").alias("first"), F.count("*").alias("brussels_hours"))


@query("sc8_strings", "lang:s n_match:i names:s", """
  SELECT lang, count(*) FILTER (WHERE regexp_matches(lower(trim(text)), '(the|das|que)')) AS n_match, string_agg(DISTINCT upper(source), ' | ' ORDER BY upper(source)) AS names FROM documents GROUP BY 1""")
def sc8(t):
    d = t.table("documents").groupBy("lang", F.upper("source").alias("s")).agg(F.count_if(F.lower(F.trim("text")).rlike("(the|das|que)")).alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("n_match"), F.array_join(F.array_sort(F.collect_list("s")), " | ").alias("names"))


@query("sc9_json_lookup", "flag:s n:i", """
  SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'false' WHEN k % 11 = 0 THEN NULL ELSE 'true' END AS flag, count(*) AS n FROM hg_readings GROUP BY 1""")
def sc9(t):
    from hourgrid.operators.weather import quality_codes

    k = F.col("k")
    body = F.when(F.col("event_id") % 7 == 0, "bad").when(k % 5 == 0, '{"validated":{"PRESSURE":false}}').when(k % 11 == 0, '{"validated":{}}').otherwise('{"validated":{"PRESSURE":true}}')
    df = quality_codes(t.readings.select(body.alias("qc")), "qc", {"pressure": "PRESSURE"})
    return df.groupBy(F.col("qc_pressure").cast("string").alias("flag")).agg(F.count("*").alias("n"))


@query("sc10_haversine", "a:s b:s km:f", """
  SELECT x.entity AS a, y.entity AS b, 2 * 6371 * asin(sqrt(sin(radians(y.lat - x.lat) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(y.lat)) * sin(radians(y.lon - x.lon) / 2) ** 2)) AS km
  FROM hg_entities x JOIN hg_entities y ON x.entity < y.entity""")
def sc10(t):
    e = t.entities
    pairs = e.select(F.col("entity").alias("a")).join(e.select(F.col("entity").alias("b")), F.col("a") < F.col("b"))
    return SP.with_distance(pairs, e)


@query("sc11_set_similarity", "conv_id:i turn:i jaccard:f overlap:f", """
  WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations)
  SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE AS jaccard, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE AS overlap
  FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def sc11(t):
    w = t.table("conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    a, b = w.withColumnRenamed("w", "a"), w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", S.jaccard(F.col("a"), F.col("b")).alias("jaccard"), S.overlap(F.col("a"), F.col("b")).alias("overlap"))


@query("sc12_one_hot", "entity:s x__click:i x__view:i x__refund:i", """
  SELECT entity, sum(CAST(entity = 'click' AS INT)) AS x__click, sum(CAST(entity = 'view' AS INT)) AS x__view, 0 AS x__refund FROM hg_panel GROUP BY 1""")
def sc12(t):
    hot = t.panel.select("entity", *S.one_hot("entity", ["click", "view", "refund"], "x"))
    return hot.groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("x__click", "x__view", "x__refund")])


@query("sc13_name_rules", "label:s n_features:i n_values:i", """
  WITH c AS (SELECT count(hod) AS t_hour_sin, count(temp) AS e_temp_c, count(precip) AS e_precip_bin__dry, count(rate) AS l_occ_lag_1h, count(is_event_day) AS e_is_event_day FROM hg_mad)
  SELECT label, count(*) AS n_features, sum(n) AS n_values FROM (SELECT 'cyclical' AS label, t_hour_sin AS n FROM c UNION ALL SELECT 'identity', e_temp_c FROM c UNION ALL SELECT 'one_hot', e_precip_bin__dry FROM c
  UNION ALL SELECT 'lag', l_occ_lag_1h FROM c UNION ALL SELECT 'flag', e_is_event_day FROM c) GROUP BY 1""")
def sc13(t):
    from hourgrid.operators.features import transformation

    c = t.mad.agg(F.count("hod").alias("t_hour_sin"), F.count("temp").alias("e_temp_c"), F.count("precip").alias("e_precip_bin__dry"),
                  F.count("rate").alias("l_occ_lag_1h"), F.count("is_event_day").alias("e_is_event_day"))
    long = c.unpivot([], c.columns, "name", "n")
    return long.groupBy(transformation(F.col("name")).alias("label")).agg(F.count("*").alias("n_features"), F.sum("n").alias("n_values"))


@query("sc14_result_rows", "entity:s metric:s value:f", """
  SELECT entity, 'min' AS metric, min(rate) AS value FROM hg_panel GROUP BY 1 UNION ALL SELECT entity, 'max', max(rate) FROM hg_panel GROUP BY 1 UNION ALL SELECT entity, 'mean', avg(rate) FROM hg_panel GROUP BY 1""")
def sc14(t):
    arms = [F.struct(F.lit(n).alias("metric"), f("rate").alias("value")) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return t.panel.groupBy("entity").agg(F.array(*arms).alias("a")).select("entity", F.inline("a"))


@query("array_column_norms", "label:i n:i mean_norm:f5", """
  SELECT label, count(*) AS n, avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS mean_norm FROM embeddings GROUP BY 1""")
def embedding(t):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return t.table("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(norm).alias("mean_norm"))


@query("quantiles_by_column", "column:s q10:f q90:f", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.1) AS q10, quantile_cont({c}, 0.9) AS q90 FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"]))
def by_column(t):
    return QT.column_quantiles(t.table("lineitem"), [], ["l_quantity", "l_discount", "l_tax"], {"q10": 0.1, "q90": 0.9})
