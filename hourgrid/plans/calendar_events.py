"""Calendar and event-registry construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import calendar as C
from hourgrid.operators import events as E
from hourgrid.plans.registry import query

FLAGS = {"is_urgent_day": "urgent", "is_high_day": "high", "is_low_day": "low"}


def _holidays(t, low: int, high: int, kind: str):
    o = t.table("orders").where((F.col("o_totalprice") >= low) & (F.col("o_totalprice") < high))
    raw = o.select(F.col("o_orderstatus").alias("Feestdag"), F.date_format("o_orderdate", "dd MMM yyyy").alias("Datum"))
    return C.normal_holidays(raw, kind)


_HOL = "SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderstatus) AS name FROM orders WHERE o_totalprice >= {a} AND o_totalprice < {b} GROUP BY 1"


@query("ce1_holidays", "date:d holiday_type:s holiday_name:s year:i", f"""
  SELECT date, 'national' AS holiday_type, name AS holiday_name, year(date) AS year FROM ({_HOL.format(a=499000, b=600000)})""")
def ce1(t):
    return _holidays(t, 499000, 600000, "national")


@query("ce2_vacation_days", "date:d vacation_name:s vacation_type:s", """
  SELECT DISTINCT CAST(unnest(generate_series(l_shipdate, l_shipdate + to_days(l_linenumber), INTERVAL 1 DAY)) AS DATE) AS date, l_returnflag AS vacation_name, l_linestatus AS vacation_type FROM lineitem""")
def ce2(t):
    day = F.to_date("l_shipdate")
    # Equal intervals first become one row.
    li = t.table("lineitem").select(F.col("l_returnflag").alias("vacation_name"), F.col("l_linestatus").alias("vacation_type"), day.alias("a"),
                                    F.date_add(day, F.col("l_linenumber")).alias("b")).distinct()
    return C.interval_days(li, "a", "b", "vacation_name")


_CAL = f"""cal AS (SELECT s.date, n.name AS nat, o.name AS oth, v.name AS vac FROM
  (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date FROM orders) s
  LEFT JOIN ({_HOL.format(a=499000, b=600000)}) n USING (date) LEFT JOIN ({_HOL.format(a=498000, b=499000)}) o USING (date)
  LEFT JOIN (SELECT date, min(name) AS name FROM (SELECT CAST(unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS DATE) AS date, o_orderpriority AS name FROM orders WHERE o_totalprice < 2500) GROUP BY 1) v USING (date))"""


def _calendar(t):
    hol = _holidays(t, 499000, 600000, "national").unionByName(_holidays(t, 498000, 499000, "other"))
    o = t.table("orders").where("o_totalprice < 2500").select(F.col("o_orderpriority").alias("vacation_name"), F.lit("school").alias("vacation_type"),
                                                               F.to_date("o_orderdate").alias("a"), F.date_add("o_orderdate", 5).alias("b"))
    spine = C.spine_of(t.table("orders").select(F.to_date("o_orderdate").alias("day")), "day")
    return C.master_calendar(hol, C.interval_days(o, "a", "b", "vacation_name"), spine)


@query("ce3_master_calendar", "date:d national_holiday_name:s other_holiday_name:s vacation_name:s is_any_holiday:i is_school_vacation:i calendar_day_class:s year:i weekday:i is_weekend:i", f"""
  WITH {_CAL} SELECT date, nat AS national_holiday_name, oth AS other_holiday_name, vac AS vacation_name, CAST(nat IS NOT NULL OR oth IS NOT NULL AS INT) AS is_any_holiday,
  CAST(vac IS NOT NULL AS INT) AS is_school_vacation, CASE WHEN nat IS NOT NULL THEN 'national_holiday' WHEN oth IS NOT NULL THEN 'other_holiday' WHEN vac IS NOT NULL THEN 'school_vacation'
  WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'regular_day' END AS calendar_day_class, year(date) AS year, isodow(date) - 1 AS weekday, CAST(isodow(date) >= 6 AS INT) AS is_weekend FROM cal""")
def ce3(t):
    return _calendar(t)


@query("ce4_event_records", "kind:s date:d n:i n_multiday:i", """
  SELECT kind, date, count(*) AS n, sum(m) AS n_multiday FROM (SELECT lower(substr(o_orderpriority, 3)) AS kind, CAST(o_orderkey % 4 > 0 AS INT) AS m,
  CAST(unnest(generate_series(o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 4 AS INT)), INTERVAL 1 DAY)) AS DATE) AS date FROM orders) GROUP BY ALL""")
def ce4(t):
    start = F.to_date("o_orderdate")
    extra = (F.col("o_orderkey") % 4).cast("int")
    conf = t.table("orders").select(F.lower(F.expr("substr(o_orderpriority, 3)")).alias("kind"), start.alias("start"),
                                    F.when(extra > 0, F.date_add(start, extra)).alias("end"))
    return E.records(conf).groupBy("kind", "date").agg(F.count("*").alias("n"), F.sum("is_multiday_event").alias("n_multiday"))


@query("ce5_registry_checks", "registry:s n_rows:i n_null_dates:i n_duplicates:i", """
  SELECT 'orders' AS registry, count(*) AS n_rows, count(*) FILTER (WHERE date IS NULL) AS n_null_dates, count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, kind, name FROM r)) AS n_duplicates FROM r
""".replace("FROM r", "FROM (SELECT CASE WHEN id % 50 <> 0 THEN date END AS date, kind, name FROM hg_registry)"))
def ce5(t):
    r = t.registry.withColumn("date", F.when(F.col("id") % 50 != 0, F.col("date")))
    return E.registry_checks(r, "orders")


@query("ce6_clean_dump", "id:i start_local:t hours:f text:s", """
  WITH d AS (SELECT o_custkey AS id, o_orderpriority AS owner, o_orderstatus AS status, o_orderstatus || ' ' || o_orderpriority AS text, o_orderdate AS start, o_orderdate + to_hours(CAST(o_orderkey % 50 - 5 AS INT)) AS finish FROM orders)
  SELECT id, start AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Brussels' AS start_local, (epoch(finish) - epoch(start)) / 3600.0 AS hours, text FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY finish DESC, start DESC, text DESC) AS r
    FROM d WHERE owner IN ('1-URGENT', '2-HIGH', '5-LOW') AND status IN ('F', 'O') AND NOT regexp_matches(lower(text), 'f 5-low') AND finish >= start) WHERE r = 1""")
def ce6(t):
    o = t.table("orders")
    start = F.col("o_orderdate").cast("timestamp")
    d = o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderstatus").alias("status"),
                 F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"), start.alias("start"),
                 F.timestamp_add("HOUR", F.col("o_orderkey") % 50 - 5, start).alias("finish"))
    return E.clean_dump(d, ["1-URGENT", "2-HIGH", "5-LOW"], ["F", "O"], "f 5-low")


# The words of the documents, and their sources as types: both kinds of words and types occur.
_FOR, _AGAINST = "pour|with|nicht|para", "license|@|[|]"
_REASON = f"""CASE WHEN regexp_matches(x, '{_AGAINST}') THEN 'irrelevant' WHEN k IN ('src0', 'src1', 'src2') AND NOT regexp_matches(x, '{_FOR}') THEN 'low_impact'
  WHEN k = 'src3' AND NOT regexp_matches(x, '{_FOR}') THEN 'unnamed' END"""


@query("ce7_relevance_filter", "lang:s reason:s n:i n_chars:i", f"""
  SELECT lang, coalesce({_REASON}, 'stays') AS reason, count(*) AS n, sum(n_chars) AS n_chars FROM (SELECT *, lower(source) AS k, lower(coalesce(text, '') || ' ' || coalesce(source, '')) AS x FROM documents) GROUP BY ALL""")
def ce7(t):
    reason = E.drop_reason(F.col("source"), F.col("text"), _FOR, _AGAINST, ["src0", "src1", "src2"], "src3")
    return t.table("documents").groupBy("lang", F.coalesce(reason, F.lit("stays")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("ce7_relevance_words", "id:i reason:s", f"""
  SELECT p_partkey AS id, CASE WHEN regexp_matches(x, '{E.IRRELEVANT}') THEN 'irrelevant' WHEN k IN ('ambulante handel', 'speelstraat', 'terras evenement') AND NOT regexp_matches(x, '{E.RELEVANT}') THEN 'low_impact'
  WHEN k = 'andere' AND NOT regexp_matches(x, '{E.RELEVANT}') THEN 'unnamed' END AS reason FROM (SELECT p_partkey, lower(kind) AS k, lower(text || ' ' || kind) AS x FROM (
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Sport' WHEN 1 THEN 'Speelstraat' WHEN 2 THEN 'Andere' ELSE 'Terras evenement' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'Kraan ' WHEN 1 THEN 'kv  Mechelen ' WHEN 2 THEN 'levering Concert ' ELSE '' END || p_name AS text FROM part))""")
def ce7_words(t):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "Sport").when(k % 4 == 1, "Speelstraat").when(k % 4 == 2, "Andere").otherwise("Terras evenement")
    head = F.when(k % 5 == 0, "Kraan ").when(k % 5 == 1, "kv  Mechelen ").when(k % 5 == 2, "levering Concert ").otherwise("")
    return t.table("part").select(k.alias("id"), E.drop_reason(kind, F.concat(head, "p_name")).alias("reason"))


_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'Sport' WHEN 1 THEN ' markt ' WHEN 2 THEN 'Feest/Kermis' WHEN 3 THEN 'Andere' WHEN 4 THEN 'iets' END"
_TEXT = "CASE p_partkey % 9 WHEN 0 THEN 'KV Mechelen ' WHEN 1 THEN 'Carnaval ' WHEN 2 THEN 'stoet ' WHEN 3 THEN 'Maanrock festival ' WHEN 4 THEN 'concert ' WHEN 5 THEN 'jaarmarkt ' ELSE '' END || p_name"


def _dump(t):
    k = F.col("p_partkey")
    kinds = F.create_map(*[F.lit(x) for kv in {0: "Sport", 1: " markt ", 2: "Feest/Kermis", 3: "Andere", 4: "iets"}.items() for x in kv])
    heads = F.create_map(*[F.lit(x) for kv in {0: "KV Mechelen ", 1: "Carnaval ", 2: "stoet ", 3: "Maanrock festival ", 4: "concert ", 5: "jaarmarkt "}.items() for x in kv])
    return t.table("part").select(
        k.alias("id"), F.try_element_at(kinds, (k % 6).cast("int")).alias("kind"), F.concat(F.coalesce(F.try_element_at(heads, (k % 9).cast("int")), F.lit("")), "p_name").alias("text"),
        F.when(k % 4 == 0, "Afgelopen").otherwise("Gepland").alias("status"), (k % 100).cast("double").alias("hours"),
        F.timestamp_seconds(F.lit(1704067200) + k * 5400).alias("start"))


@query("ce8_infer_attributes", "id:i event_type:s event_scale:i expected_attendance:f football_kickoff_hour:f data_confidence:s is_multiday_event:i event_family:s type_mismatch:b", f"""
  WITH d AS (SELECT p_partkey AS id, {_KIND} AS kind, {_TEXT} AS text, p_partkey % 4 = 0 AS past, CAST(p_partkey % 100 AS DOUBLE) AS hours, TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 5400) AS start FROM part),
  a AS (SELECT *, CASE lower(trim(kind)) WHEN 'sport' THEN 'sport' WHEN 'markt' THEN 'markt' WHEN 'feest/kermis' THEN 'kermis' ELSE 'other' END AS base, lower(coalesce(kind || ' ', '') || text) AS x FROM d),
  b AS (SELECT *, CASE WHEN regexp_matches(x, 'kv\\s*mechelen|malinwa|voetbal|thuiswedstrijd|achter de kazerne') THEN 'football' WHEN x LIKE '%carnaval%' THEN 'carnival' WHEN regexp_matches(x, 'processie|stoet|optocht') THEN 'procession'
    WHEN base = 'other' AND regexp_matches(x, 'festival|concert|muziek|podium|optreden') THEN 'festival' ELSE base END AS event_type FROM a),
  c AS (SELECT *, CASE WHEN lower(text) LIKE '%maanrock%' THEN 3 WHEN hours >= 72 THEN least(3, s + 1) ELSE s END AS event_scale FROM (SELECT *, CASE WHEN event_type IN ('football', 'sport', 'festival', 'procession', 'carnival') THEN 2 ELSE 1 END AS s FROM b))
  SELECT id, event_type, event_scale, CASE event_type WHEN 'football' THEN 11000 WHEN 'sport' THEN 6000 WHEN 'festival' THEN 8000 WHEN 'procession' THEN 6000 WHEN 'kermis' THEN 2500 WHEN 'markt' THEN 1800 WHEN 'carnival' THEN 5000 ELSE 1200 END
    * CASE event_scale WHEN 1 THEN 0.7 WHEN 3 THEN 1.6 ELSE 1.0 END AS expected_attendance, CASE WHEN event_type = 'football' THEN hour(start) + minute(start) / 60.0 END AS football_kickoff_hour,
  CASE WHEN past THEN 'verified' ELSE 'estimated' END AS data_confidence, CAST(hours >= 24 AS INT) AS is_multiday_event,
  CASE WHEN lower(text) LIKE '%maanrock%' THEN 'maanrock' WHEN lower(text) LIKE '%carnaval%' THEN 'carnaval' WHEN regexp_matches(lower(text), 'kermis|foor') THEN 'kermis' WHEN regexp_matches(lower(text), 'kv\\s*mechelen') THEN 'kvm'
    WHEN regexp_matches(lower(text), 'markt|braderie') THEN 'markt' ELSE 'other' END AS event_family, base <> event_type AS type_mismatch FROM c""")
def ce8(t):
    return E.standard_rows(_dump(t))


_PLAIN = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "list_filter(list_distinct(string_split({c}, ' ')), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in E.STOP_WORDS) + "], w))"


@query("ce9_tokens_overlap", "item_id:i n_words:i overlap:f", f"""
  WITH b AS (SELECT item_id, {_PLAIN.format(c='text')} AS p FROM benchmark), w AS (SELECT item_id, {_WORDS.format(c='p')} AS w FROM b)
  SELECT a.item_id, len(a.w) AS n_words, CASE WHEN least(len(a.w), len(c.w)) > 0 THEN len(list_intersect(a.w, c.w)) / least(len(a.w), len(c.w))::DOUBLE ELSE 0 END AS overlap
  FROM w a JOIN w c ON c.item_id = a.item_id + 1""")
def ce9(t):
    from hourgrid.functions.scalar import overlap, plain_text, tokens

    w = t.table("benchmark").select("item_id", tokens(plain_text("text"), E.STOP_WORDS).alias("w"))
    nxt = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return w.join(nxt, "item_id").select("item_id", F.size("w").alias("n_words"), overlap(F.col("w"), F.col("v")).alias("overlap"))


def _two_sources(t):
    k = F.col("p_partkey")
    name = F.concat_ws(" ", F.element_at(F.array(F.lit("Carnaval"), F.lit("Markt"), F.lit("plein"), F.lit("groot"), F.lit("zomer")), (k % 5 + 1).cast("int")), "p_name",
                       F.when(k % 3 == 0, "2800").when(k % 3 == 1, "festival"), F.when(k % 7 == 0, F.lower("p_type")))
    rows = t.table("part").select(k.alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("date"), name.alias("name"), F.col("p_type").alias("kind"))
    mine = F.col("kind").isin("ECONOMY", "PROMO")
    return rows.where(~mine).drop("kind"), rows.where(mine).drop("kind")


_SRC = f"""src AS (SELECT p_partkey AS id, DATE '2024-01-01' + p_size AS date, concat_ws(' ', ['Carnaval', 'Markt', 'plein', 'groot', 'zomer'][p_partkey % 5 + 1], p_name,
    CASE p_partkey % 3 WHEN 0 THEN '2800' WHEN 1 THEN 'festival' END, CASE WHEN p_partkey % 7 = 0 THEN lower(p_type) END) AS name, p_type IN ('ECONOMY', 'PROMO') AS base FROM part),
  z AS (SELECT *, {_PLAIN.format(c='name')} AS p, CASE WHEN lower(name) LIKE '%carnaval%' THEN 'carnaval' WHEN lower(name) LIKE '%markt%' THEN 'markt' ELSE 'other' END AS fam FROM src),
  y AS (SELECT *, {_WORDS.format(c='p')} AS w FROM z),
  m AS (SELECT a.id, bool_or(a.fam <> 'other' AND a.fam = b.fam) AS family_match, bool_or(contains(b.p, a.p) OR contains(a.p, b.p)) AS exact_match,
    bool_or(1 - levenshtein(a.p, b.p) / greatest(length(a.p), length(b.p))::DOUBLE >= 0.9 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE >= 0.6) AS similar_match
    FROM y a JOIN y b ON a.date = b.date WHERE NOT a.base AND b.base GROUP BY 1)"""


@query("ce10_cross_source_duplicates", "id:i family_match:b exact_match:b similar_match:b is_probable_duplicate:b", f"""
  WITH {_SRC} SELECT id, coalesce(family_match, false) AS family_match, coalesce(exact_match, false) AS exact_match, coalesce(similar_match, false) AS similar_match,
  coalesce(family_match OR exact_match OR similar_match, false) AS is_probable_duplicate FROM src LEFT JOIN m USING (id) WHERE NOT base""")
def ce10(t):
    rows, baseline = _two_sources(t)
    return E.cross_source_duplicates(rows, baseline)


@query("j7_fuzzy_candidates", "date:d n:i n_duplicate:i", f"""
  WITH {_SRC} SELECT date, count(*) AS n, count(*) FILTER (WHERE family_match OR exact_match OR similar_match) AS n_duplicate FROM src LEFT JOIN m USING (id) WHERE NOT base GROUP BY 1""")
def j7(t):
    rows, baseline = _two_sources(t)
    return E.cross_source_duplicates(rows, baseline).groupBy("date").agg(F.count("*").alias("n"), F.count_if("is_probable_duplicate").alias("n_duplicate"))


@query("ce11_integrate_by_priority", "date:d kind:s name:s id:i source_priority:i", """
  WITH b AS (SELECT date, kind, name, id, CASE WHEN scale = 1 THEN 0 ELSE 1 END AS source_priority FROM hg_registry)
  SELECT date, kind, name, id, source_priority FROM (SELECT *, row_number() OVER (PARTITION BY date, kind, name ORDER BY source_priority, id) AS r FROM b) WHERE r = 1""")
def ce11(t):
    r = t.registry.select("date", "kind", "name", "id", "scale")
    base = r.where("scale = 1").drop("scale").withColumn("source_priority", F.lit(0))
    return E.integrate(base, r.where("scale <> 1").drop("scale").withColumn("source_priority", F.lit(1)))


_DAILY_SQL = """daily AS (SELECT date, max(scale) AS event_scale_max, count(DISTINCT kind) AS n_concurrent_events, arg_min(kickoff_hour, id) FILTER (WHERE kickoff_hour IS NOT NULL) AS football_kickoff_hour,
  ['verified', 'estimated', 'covid_modified'][max(CASE confidence WHEN 'verified' THEN 1 WHEN 'estimated' THEN 2 ELSE 3 END)] AS data_confidence, string_agg(DISTINCT name, ' | ' ORDER BY name) AS event_names_combined,
  max(CAST(kind = 'urgent' AS INT)) AS is_urgent_day, max(CAST(kind = 'high' AS INT)) AS is_high_day, max(CAST(kind = 'low' AS INT)) AS is_low_day, 1 AS is_event_day FROM hg_registry GROUP BY 1)"""
_DAILY_COLS = "date:d event_scale_max:i n_concurrent_events:i football_kickoff_hour:f data_confidence:s event_names_combined:s is_urgent_day:i is_high_day:i is_low_day:i is_event_day:i"


@query("a6_daily_event_rollup", _DAILY_COLS, f"WITH {_DAILY_SQL} SELECT * FROM daily")
def a6(t):
    return E.daily_events(t.registry, FLAGS)


_MASTER_SQL = _DAILY_SQL + """, master AS (SELECT s.date, coalesce(event_scale_max, 0) AS event_scale_max, coalesce(n_concurrent_events, 0) AS n_concurrent_events, football_kickoff_hour,
  coalesce(data_confidence, 'verified') AS data_confidence, coalesce(event_names_combined, '') AS event_names_combined, coalesce(is_urgent_day, 0) AS is_urgent_day, coalesce(is_high_day, 0) AS is_high_day,
  coalesce(is_low_day, 0) AS is_low_day, coalesce(is_event_day, 0) AS is_event_day FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date) s LEFT JOIN daily USING (date))"""


def _master(t):
    return E.events_master(E.daily_events(t.registry, FLAGS), C.day_spine(t.spark, "1995-01-01", "2001-12-31"), list(FLAGS))


@query("ce12_events_master", _DAILY_COLS, f"WITH {_MASTER_SQL} SELECT * FROM master")
def ce12(t):
    return _master(t)


@query("ce12_master_checks", "check:s result:s n:i", f"""
  WITH {_MASTER_SQL} SELECT c AS "check", 'PASS' AS result, 0 AS n FROM (SELECT count(*) FROM master), (VALUES ('unique_dates'), ('no_missing_days'), ('flags_are_0_1'), ('no_null_confidence')) v(c)""")
def ce12_checks(t):
    return E.master_checks(_master(t), list(FLAGS))


@query("ce13_event_summaries", "flag:s n_days:i pct_days:f", f"""
  WITH {_MASTER_SQL} SELECT 'is_urgent_day' AS flag, sum(is_urgent_day) AS n_days, 100.0 * sum(is_urgent_day) / count(*) AS pct_days FROM master UNION ALL
  SELECT 'is_high_day', sum(is_high_day), 100.0 * sum(is_high_day) / count(*) FROM master UNION ALL SELECT 'is_event_day', sum(is_event_day), 100.0 * sum(is_event_day) / count(*) FROM master""")
def ce13(t):
    return E.summaries(_master(t), ["is_urgent_day", "is_high_day", "is_event_day"])


@query("ce13_busiest_days", "date:d n_concurrent_events:i event_scale_max:i", f"""
  WITH {_DAILY_SQL} SELECT date, n_concurrent_events, event_scale_max FROM daily ORDER BY n_concurrent_events DESC, event_scale_max DESC, date LIMIT 15""")
def ce13_top(t):
    d = E.daily_events(t.registry, FLAGS)
    return d.orderBy(F.desc("n_concurrent_events"), F.desc("event_scale_max"), "date").limit(15)
