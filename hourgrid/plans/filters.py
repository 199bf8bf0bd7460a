"""Sources, filters and coercion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourgrid.functions import scalar as S
from hourgrid.operators import quality as Q
from hourgrid.plans.registry import query
from hourgrid.session import shared_folder
from hourgrid.sources import readers as R


@query("flagship_event_effect", "grp:s hod:i n:i mean_rate:f n_event:i n_other:i delta:f week_adjusted:f", """
  WITH q AS (SELECT coalesce(grp, 'none') AS grp, hod, week, rate, is_event_day AS e FROM hg_mad WHERE rate BETWEEN 0 AND 1),
  a AS (SELECT grp, hod, count(*) AS n, avg(rate) AS mean_rate, count(*) FILTER (WHERE e = 1) AS n_event,
        count(*) FILTER (WHERE e = 0) AS n_other, avg(rate) FILTER (WHERE e = 1) - avg(rate) FILTER (WHERE e = 0) AS delta
        FROM q GROUP BY ALL),
  m AS (SELECT grp, hod, week, count(*) AS n, avg(rate) FILTER (WHERE e = 1) - avg(rate) FILTER (WHERE e = 0) AS delta FROM q
        GROUP BY ALL HAVING count(*) FILTER (WHERE e = 1) >= 2 AND count(*) FILTER (WHERE e = 0) >= 2),
  w AS (SELECT grp, hod, sum(delta * n) / sum(n) AS week_adjusted FROM m GROUP BY ALL)
  SELECT a.*, w.week_adjusted FROM a LEFT JOIN w USING (grp, hod)""")
def flagship(t):
    q = t.mad.where(F.col("rate").between(0, 1)).select(
        F.coalesce("grp", F.lit("none")).alias("grp"), "hod", "week", "rate", F.col("is_event_day").alias("e"))
    on, off = F.col("e") == 1, F.col("e") == 0
    # One shuffle: sums per (group, hour, week) roll up to both results.
    weekly = q.groupBy("grp", "hod", "week").agg(
        F.count("*").alias("n"), F.sum("rate").alias("s"), F.count_if(on).alias("n1"), F.count_if(off).alias("n0"),
        F.sum(F.when(on, F.col("rate"))).alias("s1"), F.sum(F.when(off, F.col("rate"))).alias("s0"))
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    delta = F.try_divide(F.col("s1"), F.col("n1")) - F.try_divide(F.col("s0"), F.col("n0"))
    return weekly.groupBy("grp", "hod").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_rate"), F.sum("n1").alias("n_event"), F.sum("n0").alias("n_other"),
        (F.try_divide(F.sum("s1"), F.sum("n1")) - F.try_divide(F.sum("s0"), F.sum("n0"))).alias("delta"),
        F.try_divide(F.sum(F.when(enough, delta * F.col("n"))), F.sum(F.when(enough, F.col("n")))).alias("week_adjusted"))


@query("io2_required_parquet", "event_type:s n:i first:t last:t", """
  SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1""")
def io2(t):
    df = R.read_parquet(t.spark, f"{t.folder}/events.parquet", ["event_id", "ts", "event_type", "value"])
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("io5_optional_events", "variant:s n:i n_event:i", """
  SELECT 'with' AS variant, count(*) AS n, sum(is_event_day) AS n_event FROM hg_panel LEFT JOIN hg_days USING (day)
  UNION ALL SELECT 'without', count(*), NULL FROM hg_panel""")
def io5(t):
    parts = []
    for label, days in (("with", t.days), ("without", None)):
        df = t.panel.select("day") if days is None else t.panel.select("day").join(days.select("day", "is_event_day"), "day", "left")
        total = F.sum("is_event_day") if days is not None else F.lit(None).cast("bigint")
        parts.append(df.agg(F.count("*").alias("n"), total.alias("n_event")).withColumn("variant", F.lit(label)))
    return parts[0].unionByName(parts[1])


@query("io7_fingerprint_audit", "dataset:s expected_rows:i observed_rows:i status:s", """
  SELECT 'orders' AS dataset, count(*) AS expected_rows, count(*) AS observed_rows, 'OK' AS status FROM orders
  UNION ALL SELECT 'supplier', count(*), count(*), 'CHANGED' FROM supplier
  UNION ALL SELECT 'nation', NULL, count(*), 'UNEXPECTED' FROM nation
  UNION ALL SELECT 'region', count(*), NULL, 'MISSING' FROM region""")
def io7(t):
    seen = R.fingerprint(t.table("orders"), "orders").unionByName(R.fingerprint(t.table("supplier"), "supplier")).unionByName(
        R.fingerprint(t.table("nation"), "nation"))
    shuffled = t.table("orders").repartition(3, "o_custkey")
    altered = t.table("supplier").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    known = R.fingerprint(shuffled, "orders").unionByName(R.fingerprint(altered, "supplier")).unionByName(
        R.fingerprint(t.table("region"), "region"))
    return R.audit_fingerprints(seen, known)


@query("io8_page_fixtures", "date:d kickoff_hour:f", """
  WITH made AS (SELECT '<table><tr class="x"><td>' || day(d) || ' ' || monthname(d) || ' ' || year(d) || '</td><td>' ||
      CASE WHEN o % 2 = 0 THEN 'Mechelen' ELSE 'Other' END || '</td><td>2 – 1</td><td>Mechelen' ||
      CASE WHEN o % 5 = 0 THEN ' 19:30' ELSE '' END || '</td></tr></table>' AS html
      FROM (SELECT o_orderdate AS d, o_orderkey AS o FROM orders)),
  r AS (SELECT trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM made),
  x AS (SELECT text, CAST(strptime(regexp_extract(text, '(\\d{1,2} [A-Z][a-z]+ \\d{4})', 1), '%d %B %Y') AS DATE) AS date FROM r)
  SELECT date, min(CASE WHEN text LIKE '%:%' THEN 19.5 WHEN isodow(date) >= 6 THEN 18.0 ELSE 20.75 END) AS kickoff_hour
  FROM x WHERE instr(text, 'Mechelen') < instr(text, '2 – 1') GROUP BY date""")
def io8(t):
    d, o = F.col("o_orderdate"), F.col("o_orderkey")
    html = F.concat(
        F.lit('<table><tr class="x"><td>'), F.date_format(d, "d MMMM yyyy"), F.lit("</td><td>"),
        F.when(o % 2 == 0, "Mechelen").otherwise("Other"), F.lit("</td><td>2 – 1</td><td>Mechelen"),
        F.when(o % 5 == 0, " 19:30").otherwise(""), F.lit("</td></tr></table>"))
    return R.fixture_rows(t.table("orders").select(html.alias("html")), "Mechelen")


@query("io8_page_rows", "n_rows:i n_pages:i", """
  SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_pages FROM (SELECT greatest(len(string_split(html, '<p>')) - 1, 0) AS n FROM pages)""")
def io8_rows(t):
    n = F.size(F.split("html", "<p>")) - 1
    return t.table("pages").agg(F.sum(n).alias("n_rows"), F.count("*").alias("n_pages"))


@query("pf1_coerce", "event_type:s n:i n_number:i n_date:i total:f", """
  SELECT event_type, count(*) AS n, count(TRY_CAST(s AS DOUBLE)) AS n_number, count(TRY_CAST(d AS TIMESTAMP)) AS n_date,
  sum(TRY_CAST(s AS DOUBLE)) AS total
  FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS s,
        CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS d FROM events) GROUP BY 1""")
def pf1(t):
    k = F.col("event_id")
    e = t.table("events").select(
        "event_type", F.when(k % 7 == 0, F.concat(F.lit("x"), "value")).otherwise(F.col("value").cast("string")).alias("s"),
        F.when(k % 5 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("d"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(S.number("s")).alias("n_number"),
                                       F.count(S.moment("d")).alias("n_date"), F.sum(S.number("s")).alias("total"))


@query("pf2_flags", "k:i flag:i n:i", """
  SELECT k, CASE WHEN coalesce(TRY_CAST(s AS DOUBLE), 0) > 0 THEN 1 ELSE 0 END AS flag, count(*) AS n
  FROM (SELECT event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '0' WHEN 2 THEN '-2' WHEN 3 THEN '0.5' END AS s FROM events)
  GROUP BY ALL""")
def pf2(t):
    k = F.col("event_id") % 5
    s = F.when(k == 0, "yes").when(k == 1, "0").when(k == 2, "-2").when(k == 3, "0.5")
    return t.table("events").groupBy(k.alias("k"), S.flag(s).alias("flag")).agg(F.count("*").alias("n"))


@query("pf3_rename_known", "column:s present:b n_values:i", """
  SELECT 'timestamp' AS column, true AS present, count(hour) AS n_values FROM hg_weather UNION ALL
  SELECT 'temp_c', true, count(temp) FROM hg_weather UNION ALL SELECT 'precip_mm', true, count(precip) FROM hg_weather UNION ALL
  SELECT 'dew_point', false, 0 FROM (SELECT count(*) FROM hg_weather)""")
def pf3(t):
    names = {"hour": "timestamp", "temp": "temp_c", "precip": "precip_mm", "dew": "dew_point"}
    out, missing = Q.rename_known(t.weather, names)
    counted = out.agg(*[F.count(c).alias(c) for c in out.columns], *[F.lit(0).cast("bigint").alias(names[m]) for m in missing])
    long = counted.unpivot([], counted.columns, "column", "n_values")
    return long.withColumn("present", ~F.col("column").isin([names[m] for m in missing]))


@query("pf4_drop_columns", "grp:s n:i n_rate:i", """
  SELECT grp, count(*) AS n, count(rate) AS n_rate FROM hg_panel WHERE grp IS NOT NULL GROUP BY 1""")
def pf4(t):
    df = Q.drop_admin(t.panel, ["published", "created_at", "ksum"])
    return df.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.count("*").alias("n"), F.count("rate").alias("n_rate"))


_FLAGGED = """flagged AS (SELECT *, CAST(ksum % 17 = 0 AS INT) AS low_data_coverage, CAST(ksum % 13 = 0 AS INT) AS system_blackout,
  CAST(ksum % 7 = 0 AS INT) AS flag_frozen_sensor FROM hg_panel)"""


def _flagged(t):
    k = F.col("ksum")
    return t.panel.withColumns({"low_data_coverage": (k % 17 == 0).cast("int"), "system_blackout": (k % 13 == 0).cast("int"),
                                "flag_frozen_sensor": (k % 7 == 0).cast("int")})


@query("pf5_quality_mask", "entity:s n:i mean_rate:f", f"""
  WITH {_FLAGGED} SELECT entity, count(*) AS n, avg(rate) AS mean_rate FROM flagged
  WHERE low_data_coverage = 0 AND system_blackout = 0 AND rate BETWEEN 0 AND 1 GROUP BY 1""")
def pf5(t):
    df = _flagged(t)
    return df.where(Q.quality_mask(df)).groupBy("entity").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"))


@query("pf6_nested_subsets", "subset:s n:i share_pct:f", f"""
  WITH {_FLAGGED}, m AS (SELECT coalesce(low_data_coverage = 0 AND system_blackout = 0 AND rate BETWEEN 0 AND 1, false) AS q,
  flag_frozen_sensor = 0 AS nf FROM flagged)
  SELECT 'full' AS subset, count(*) AS n, 100.0 AS share_pct FROM m UNION ALL
  SELECT 'quality', count(*) FILTER (WHERE q), 100 * avg(q::INT) FROM m UNION ALL
  SELECT 'strict', count(*) FILTER (WHERE q AND nf), 100 * avg((q AND nf)::INT) FROM m""")
def pf6(t):
    return Q.subset_shares(_flagged(t))


@query("pf7_membership", "n_orders:i n_customers:i", """
  SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_orderstatus IN ('F', 'O')
  AND year(o_orderdate) IN (1996, 1998) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def pf7(t):
    keep = t.table("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    years = (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01") | (F.col("o_orderdate") >= "1998-01-01") & (
        F.col("o_orderdate") < "1999-01-01")
    o = t.table("orders").where(F.col("o_orderstatus").isin("F", "O") & years)
    # Count per customer first, then count customers: no expand for the distinct.
    per = o.join(keep, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.count("*").alias("n_customers"))


@query("pf8_text_funnel", "step:i name:s n:i change:i", """
  WITH d AS (SELECT lower(text || ' ' || source) AS x, n_chars, lang FROM documents),
  f AS (SELECT 0 AS step, 'all' AS name, count(*) AS n FROM d UNION ALL
  SELECT 1, 'latin', count(*) FILTER (WHERE lang IN ('en', 'fr')) FROM d UNION ALL
  SELECT 2, 'keyword', count(*) FILTER (WHERE lang IN ('en', 'fr') AND regexp_matches(x, 'the|elle')) FROM d UNION ALL
  SELECT 3, 'not_blocked', count(*) FILTER (WHERE lang IN ('en', 'fr') AND regexp_matches(x, 'the|elle') AND NOT regexp_matches(x, 'copyright|license')) FROM d)
  SELECT step, name, n, n - lag(n) OVER (ORDER BY step) AS change FROM f""")
def pf8(t):
    x = F.lower(F.concat_ws(" ", "text", "source"))
    return Q.funnel(t.table("documents"), [("latin", F.col("lang").isin("en", "fr")), ("keyword", x.rlike("the|elle")),
                                           ("not_blocked", ~x.rlike("copyright|license"))])


@query("a20_funnel_changes", "step:i name:s n:i change:i", """
  WITH f AS (SELECT 0 AS step, 'all' AS name, count(*) AS n FROM hg_reported UNION ALL
  SELECT 1, 'has_rate', count(*) FILTER (WHERE rate_in IS NOT NULL) FROM hg_reported UNION ALL
  SELECT 2, 'positive', count(*) FILTER (WHERE rate_in IS NOT NULL AND count_in >= 0) FROM hg_reported)
  SELECT step, name, n, n - lag(n) OVER (ORDER BY step) AS change FROM f""")
def a20(t):
    return Q.funnel(t.reported, [("has_rate", F.col("rate_in").isNotNull()), ("positive", F.col("count_in") >= 0)])


@query("pf9_time_ranges", "part:s n:i", """
  SELECT CASE WHEN hour >= TIMESTAMP '2024-01-05' AND hour < TIMESTAMP '2024-01-08' THEN 'blackout'
  WHEN hour BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:00:00' THEN 'window' ELSE 'rest' END AS part, count(*) AS n
  FROM hg_panel GROUP BY 1""")
def pf9(t):
    h = F.col("hour")
    part = S.first_match([((h >= F.lit("2024-01-05").cast("timestamp")) & (h < F.lit("2024-01-08").cast("timestamp")), "blackout"),
                          (h.between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12 23:00:00").cast("timestamp")), "window")], "rest")
    return t.panel.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("pf10_first_match", "day_class:s n_days:i", """
  SELECT CASE WHEN is_national_holiday = 1 THEN 'national_holiday' WHEN is_other_holiday = 1 THEN 'other_holiday'
  WHEN is_school_vacation = 1 THEN 'school_vacation' WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'regular_day' END AS day_class,
  count(*) AS n_days FROM hg_days GROUP BY 1""")
def pf10(t):
    from hourgrid.operators.calendar import calendar_class

    return t.days.groupBy(calendar_class("day").alias("day_class")).agg(F.count("*").alias("n_days"))


@query("pf12_columns_by_set", "feature_set:s n_features:i n_values:i", """
  SELECT 'time_space' AS feature_set, 2 AS n_features, count(hod) + count(dow) AS n_values FROM hg_mad UNION ALL
  SELECT 'all', 5, count(hod) + count(dow) + count(temp) + count(precip) + count(wind) FROM hg_mad UNION ALL
  SELECT 'without_rain', 4, count(hod) + count(dow) + count(temp) + count(wind) FROM hg_mad""")
def pf12(t):
    df = t.mad.select(F.col("hod").alias("t_hod"), F.col("dow").alias("t_dow"), F.col("temp").alias("e_temp"),
                      F.col("precip").alias("e_precip"), F.col("wind").alias("e_wind"))
    sets = {"time_space": Q.columns_by(df.columns, prefixes=("t_", "s_")), "all": Q.columns_by(df.columns),
            "without_rain": Q.columns_by(df.columns, exclude=("e_precip",))}
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    arms = [F.struct(F.lit(n).alias("feature_set"), F.lit(len(cs)).alias("n_features"),
                     sum((F.col(c) for c in cs[1:]), F.col(cs[0])).alias("n_values")) for n, cs in sets.items()]
    return counts.select(F.inline(F.array(*arms)))


@query("pf13_defaults", "entity:s n_null_before:i n_null_after:i total:f", """
  SELECT entity, count(*) FILTER (WHERE rate_in IS NULL) AS n_null_before, 0 AS n_null_after, sum(coalesce(rate_in, 0)) AS total
  FROM hg_reported GROUP BY 1""")
def pf13(t):
    df = t.reported.withColumn("was", F.col("rate_in").isNull()).fillna({"rate_in": 0.0})
    return df.groupBy("entity").agg(F.count_if("was").alias("n_null_before"), F.count_if(F.col("rate_in").isNull()).alias("n_null_after"),
                                    F.sum("rate_in").alias("total"))


@query("pf14_clip", "n:i n_null:i low:f high:f total:f", """
  SELECT count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null, min(v) AS low, max(v) AS high, sum(v) AS total
  FROM (SELECT CASE WHEN rate_in IS NOT NULL THEN greatest(0.0, least(0.6, rate_in)) END AS v FROM hg_reported)""")
def pf14(t):
    v = S.clipped("rate_in", 0.0, 0.6)
    return t.reported.select(v.alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"),
                                               F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))


@query("pf15_key_consistency", "label:s n:i n_mismatch:i", """
  SELECT entity || '|' || coalesce(grp, 'none') AS label, count(*) AS n, count(*) FILTER (WHERE hod % 24 <> (hod + CAST(ksum % 31 = 0 AS INT)) % 24) AS n_mismatch
  FROM hg_panel GROUP BY 1""")
def pf15(t):
    stored = (F.col("hod") + (F.col("ksum") % 31 == 0).cast("int")) % 24
    label = F.concat_ws("|", "entity", F.coalesce("grp", F.lit("none")))
    return t.panel.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.count_if(F.hour("hour") != stored).alias("n_mismatch"))


def _stage_path(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@query("io1_csv_required", "name:s n:i first:d", """
  SELECT o_orderstatus AS name, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first FROM (SELECT DISTINCT o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) GROUP BY 1""")
def io1(t):
    path = _stage_path(t)
    days = t.table("orders").select(F.col("o_orderstatus").alias("Feestdag"), F.date_format("o_orderdate", "dd MMM yyyy").alias("Datum")).distinct()
    days.write.option("header", True).csv(path)
    back = R.read_csv(t.spark, path, R.HOLIDAY_COLUMNS, R.HOLIDAY_SCHEMA)
    return back.groupBy(F.col("Feestdag").alias("name")).agg(F.count("*").alias("n"), F.min(F.to_date("Datum", "dd MMM yyyy")).alias("first"))


@query("io3_tagged_files", "kind:s has_file:b n:i", """
  SELECT 'national' AS kind, true AS has_file, count(*) AS n FROM (SELECT DISTINCT o_orderdate FROM orders WHERE o_orderstatus = 'F') UNION ALL
  SELECT 'other', true, count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus <> 'F')""")
def io3(t):
    path = _stage_path(t)
    parts = []
    status = F.col("o_orderstatus")
    for kind, wanted in (("national", status == "F"), ("other", status != "F")):
        days = t.table("orders").where(wanted).select(status.alias("Feestdag"), F.date_format("o_orderdate", "dd MMM yyyy").alias("Datum"))
        days.distinct().write.option("header", True).csv(f"{path}/{kind}_files")
        parts.append(R.read_tagged_csv(t.spark, f"{path}/{kind}_*", R.HOLIDAY_COLUMNS, "kind", kind))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("kind").agg(F.bool_and(F.col("source_file").endswith(".csv")).alias("has_file"), F.count("*").alias("n"))


@query("io4_plans_and_optional", "source:s n:i", """
  SELECT 'json' AS source, count(*) AS n FROM nation UNION ALL SELECT 'csv', count(*) FROM nation UNION ALL SELECT 'missing', 0 FROM (SELECT count(*) FROM nation)""")
def io4(t):
    path = _stage_path(t)
    nation = t.table("nation").select("n_nationkey", "n_name")
    nation.write.json(f"{path}/manifest")
    nation.write.option("header", True).csv(f"{path}/plan")
    schema = nation.schema
    frames = {"json": R.read_json(t.spark, f"{path}/manifest", schema, multiline=False), "csv": R.read_or_empty(t.spark, f"{path}/plan", schema),
              "missing": R.read_or_empty(t.spark, f"{path}/absent", schema)}
    out = [df.agg(F.count("n_name").alias("n")).select(F.lit(k).alias("source"), "n") for k, df in frames.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("io6_partitioned_write", "split:s n:i n_entities:i", """
  SELECT CASE WHEN hour >= TIMESTAMP '2024-01-23' THEN 'holdout' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT entity) AS n_entities FROM hg_panel GROUP BY 1""")
def io6(t):
    from hourgrid.operators.evaluate import split_label

    path = _stage_path(t)
    R.write_panel(split_label(t.panel, "hour", "2024-01-23"), path, ["split"])
    back = R.read_parquet(t.spark, path, ["entity", "hour", "rate", "split"])
    per = back.groupBy("split", "entity").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("n_entities"))


@query("io6_range_read", "entity:s hour:t rate:f", """
  WITH e AS (SELECT min(entity) AS first, max(entity) AS last FROM hg_panel) SELECT entity, hour, rate FROM hg_panel, e
  WHERE (entity > first OR hour >= TIMESTAMP '2024-01-10') AND (entity < last OR hour <= TIMESTAMP '2024-01-20')""")
def io6_range(t):
    """Reads a range of keys back through the manifest of the written panel."""
    path = _stage_path(t)
    R.write_panel(t.panel.select("entity", "hour", "rate"), path)
    held = R.write_manifest(t.spark, path)
    ends = held.agg(F.min("first.entity").alias("a"), F.max("last.entity").alias("b")).first()
    return R.read_keys(t.spark, path, {"entity": ends["a"], "hour": "2024-01-10"}, {"entity": ends["b"], "hour": "2024-01-20"})
