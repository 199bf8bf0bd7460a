"""Hand-made vectors for the rules that are easy to get wrong."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.functions import scalar as S
from hourgrid.functions.tails import normal_p, student_p
from hourgrid.operators import events as E
from hourgrid.operators import features as FE
from hourgrid.operators import quantile as QT
from hourgrid.operators import series as TS
from hourgrid.operators import significance as ST
from hourgrid.operators import weather as WX
from hourgrid.operators import windows as O

HOUR = 3600


def hours(spark, values, key="a"):
    return spark.createDataFrame([(key, i * HOUR, v) for i, v in enumerate(values)], "entity string, t bigint, v double")


def column(df, order="t", name="v"):
    return [r[name] for r in df.orderBy(order).collect()]


GAPS = [None, 1.0, None, None, None, 5.0, None, None, None]


@pytest.mark.parametrize("chunk", [2 * HOUR, 28 * 24 * HOUR])
@pytest.mark.parametrize("both,edges,limit,expected", [
    (False, False, 2, [None, 1, 2, 3, None, 5, 5, 5, None]),
    (True, False, 2, [1, 1, 2, 3, 4, 5, 5, 5, None]),
    (False, True, 6, [1, 1, 2, 3, 4, 5, 5, 5, 5]),
])
def test_limited_interpolation(spark, monkeypatch, chunk, both, edges, limit, expected):
    for f in (O.neighbours, O.running_total):
        monkeypatch.setattr(f, "__defaults__", (chunk, False))
    out = TS.interpolate(hours(spark, GAPS), ["entity"], "t", {"v": limit}, both=both, edges=edges)
    assert column(out) == expected


@pytest.mark.parametrize("chunk", [HOUR, 2 * HOUR, 28 * 24 * HOUR])
def test_frozen_flag_starts_at_fourth_repeat(spark, chunk):
    out = O.frozen(hours(spark, [7.0, 7.0, 7.0, 7.0, 7.0, 8.0]), ["entity"], "t", "v", chunk=chunk)
    assert column(out, name="is_frozen") == [0, 0, 0, 0, 1, 0]


def test_latest_publication_wins(spark):
    df = spark.createDataFrame([("a", 1, "10:00", 5), ("a", 1, "10:05", 6)], "entity string, hour int, published string, v int")
    assert O.latest_per_key(df, ["entity", "hour"], [F.col("published")]).first()["v"] == 6


def test_event_proximity(spark):
    df = spark.createDataFrame([(h * HOUR, int(h == 100)) for h in (0, 76, 100, 124, 180)], "t bigint, is_event_day int")
    rows = FE.event_proximity(df).orderBy("t").collect()
    assert [r.e_hours_to_event_clip for r in rows] == [72, 24, 0, 73, 73]
    assert [r.e_hours_since_event_clip for r in rows] == [73, 73, 0, 24, 72]
    assert [r.e_event_window_pre_24h for r in rows] == [0, 1, 0, 0, 0]
    assert [r.e_event_window_post_24h for r in rows] == [0, 0, 0, 1, 0]


def test_no_event_gives_sentinel(spark):
    df = spark.createDataFrame([(0, 0), (HOUR, 0)], "t bigint, is_event_day int")
    assert {r.e_event_proximity_clip for r in FE.event_proximity(df).collect()} == {73}


def test_strict_rolling_needs_contiguous_hours(spark):
    times = list(range(26)) + [28]
    df = spark.createDataFrame([("a", h * HOUR, float(h)) for h in times], "entity string, t bigint, v double")
    rows = O.rolling_strict(df, ["entity"], "t", "v").orderBy("t").collect()
    assert [i for i, r in enumerate(rows) if r.roll_mean is not None] == [24, 25]
    assert rows[24].roll_sd == pytest.approx(np.std(range(24)))


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.1,)], "v double")
    assert [r[0] for r in df.select(S.right_closed("v", [0.0, 1.0, 2.0])).collect()] == [1, 1, 2, 2, None]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    q = {r.i: r.q for r in ST.adjust_bh(df, "p", "q", (), ["i"]).collect()}
    assert q[4] is None and [q[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.04, 0.04])


def test_day_class_prefers_event(spark):
    df = spark.createDataFrame([(1, 1, 0, 1, 12, 5, 1, 2024)], "is_event_day int, is_national_holiday int, is_other_holiday int, is_school_vacation int, hod int, dow int, month int, year int")
    assert FE.time_block(df).first()["t_day_class_5"] == "event_day"


def test_quality_codes(spark):
    df = spark.createDataFrame([('{"validated":{"PRESSURE":false}}',), ("bad",), (None,)], "qc string")
    assert [r.qc_p for r in WX.quality_codes(df, "qc", {"p": "PRESSURE"}).collect()] == [False, None, None]


def test_false_code_invalidates_missing_does_not(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, None)], "v double, q boolean")
    assert [r.v for r in WX.invalidate(df, {"v": "q"}).collect()] == [1.0, None, 3.0]


def test_mape_of_zero(spark):
    assert spark.range(1).select(S.mape_term(F.lit(0.0), F.lit(0.1))).first()[0] == pytest.approx(1e7)


def test_adjusted_delta_ignores_thin_periods(spark):
    rows = [(1, f, float(f)) for f in (0, 1) for _ in range(20)] + [(2, 1, 9.0)] * 19 + [(2, 0, 0.0)] * 40
    df = spark.createDataFrame(rows, "month int, flag int, v double").withColumn("g", F.lit(1))
    r = ST.adjusted_delta(df, ["g"], "month", "flag", "v").first()
    assert r.adjusted_delta == pytest.approx(1.0) and r.n_periods == 1


def test_slug(spark):
    df = spark.createDataFrame([(" P Grote-Markt! ",), ("!!",), (None,)], "s string")
    assert [r[0] for r in df.select(S.slug("s")).collect()] == ["p_grote_markt", "unknown", "unknown"]
    assert S.py_slug(" P Grote-Markt! ") == "p_grote_markt"


def test_tails(spark):
    r = spark.createDataFrame([(1.959963985, 2.2281388519649385, 10.0)], "z double, t double, d double").select(normal_p("z"), student_p("t", "d")).first()
    assert r[0] == pytest.approx(0.05, abs=1e-8) and r[1] == pytest.approx(0.05, abs=1e-8)


def test_event_rules(spark):
    df = spark.createDataFrame([("Andere", "Concert op de Markt", 80.0), ("Markt", "KV Mechelen", 2.0), ("Feest/Kermis", "Maanrock", 2.0)], "kind string, text string, hours double")
    out = df.withColumn("type", E.event_type(F.col("kind"), F.col("text")))
    out = out.withColumn("scale", E.event_scale(F.col("type"), F.col("text"), F.col("hours"))).collect()
    assert [(r.type, r.scale) for r in out] == [("festival", 3), ("football", 2), ("kermis", 3)]


def test_duplicates_against_brute_force(spark):
    names_a = ["Grote Markt", "ab", "Zomer Carnaval 2024", "jazz avond kerk", "unieke naam hier", "x", "!!"]
    names_b = ["grote markt mechelen", "abc", "Carnaval stoet", "jazz avonds kerk", "iets anders"]
    a = spark.createDataFrame([(i, 1, n) for i, n in enumerate(names_a)], "id int, date int, name string")
    b = spark.createDataFrame([(1, n) for n in names_b], "date int, name string")
    got = {r.id: r.is_probable_duplicate for r in E.cross_source_duplicates(a, b).collect()}
    pairs = a.crossJoin(b.select(F.col("name").alias("other"))).withColumns({"p": S.plain_text("name"), "q": S.plain_text("other")})
    pairs = pairs.withColumns({"f": (E.family(F.col("name")) == E.family(F.col("other"))) & (E.family(F.col("name")) != "other"),
                               "c": (F.col("p") != "") & (F.col("q").contains(F.col("p")) | F.col("p").contains(F.col("q"))),
                               "s": (S.edit_ratio(F.col("p"), F.col("q")) >= 0.9) & (S.overlap(S.tokens(F.col("p"), E.STOP_WORDS), S.tokens(F.col("q"), E.STOP_WORDS)) >= 0.6)})
    want = {r.id: r.d for r in pairs.groupBy("id").agg(F.bool_or(F.col("f") | F.col("c") | F.col("s")).alias("d")).collect()}
    assert got == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=401), "b": rng.exponential(1e6, 77), "c": np.array([5.0]), "d": np.repeat([0.0, -2.0, 3.5], 9), "e": -rng.exponential(1e-4, 100)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "g string, v double")
    probs = {"p0": 0.0, "p1": 0.01, "p33": 1 / 3, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in QT.quantiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.g], p), rel=1e-12, abs=1e-300)


def test_slices_never_decrease(spark):
    edges = [s * math.ldexp(1 + k * 2**-52, e) for s in (-1, 1) for e in (-40, -1, 0, 1, 2, 30) for k in (0, 1, 2**51, 2**52 - 1)]
    df = spark.createDataFrame([(float(v),) for v in edges + [0.0]], "v double")
    rows = QT.value_counts(df, [], "v").orderBy("v").collect()
    assert all(a.slice <= b.slice for a, b in zip(rows, rows[1:]))


def test_relevance_drop_reasons(spark):
    rows = [
        (1, "Sport", "Kraan bij concert", "irrelevant"), (2, "Speelstraat", "Zomerstraat", "low_impact"), (3, "Speelstraat", "Optocht", None), (4, "Andere", "Vergadering", "unnamed"),
        (5, "Andere", "KV  Mechelen thuis", None), (6, "Markt", "Zonder woord", None), (7, None, None, None), (8, "Andere", "inname  openbaar domein voor kermis", "irrelevant"), (9, "andere, feest/kermis", "x", None),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, text string, want string").withColumn("got", E.drop_reason(F.col("kind"), F.col("text")))
    assert all(r.got == r.want for r in df.collect())


def test_variants_select_from_the_registry():
    reg = FE.catalogue(["a", "b"])
    names = {(t, v): FE.inputs_of(t, v, reg, {"e_event_window_pre_24h"}) for t, vs in FE.VARIANTS.items() for v in vs}
    blocks = {f.name: f.block for f in reg}
    assert names["policy", "P0"] == [] and {blocks[n] for n in names["policy", "P1"]} == {"T", "S"}
    assert set(names["policy", "P3"]) - set(names["policy", "P2"]) == {"s_parking_id__a", "s_parking_id__b"}
    assert set(names["policy", "P3"]) - set(names["policy", "P4"]) == {"e_event_window_pre_24h"}
    assert names["forecast", "F1"] == names["policy", "P3"] and names["forecast", "F2"] == names["forecast", "F3"]
    assert set(names["forecast", "F4"]) - set(names["forecast", "F3"]) == set(FE.ROLL_INPUTS)
    with pytest.raises(ValueError):
        FE.inputs_of("policy", "F1", reg)


def test_hours_of_clock_change_days(spark):
    from hourgrid.operators import quality as Q

    df = spark.createDataFrame([("2024-03-31", 23), ("2024-10-27", 25), ("2024-10-28", 24), (None, None)], "d string, want int").withColumn("got", Q.hours_of_day(F.to_date("d"), "Europe/Brussels"))
    assert all(r.got == r.want for r in df.collect())


@pytest.mark.parametrize("both,edges,limit", [(False, False, 2), (True, False, 3), (False, True, 6), (True, True, 1), (False, True, 0)])
def test_hours_filled_by_gap_equal_those_filled_on_the_grid(spark, both, edges, limit):
    rng = np.random.default_rng(limit)
    rows = [(f"k{k}", int(h) * HOUR, None if rng.random() < 0.3 else float(rng.normal())) for k in range(12) for h in sorted(rng.choice(90, 12, replace=False))]
    rows += [("one", 5 * HOUR, 1.0), ("null", 5 * HOUR, None), ("nulls", 5 * HOUR, None), ("nulls", 9 * HOUR, None)]
    df = spark.createDataFrame(rows, "entity string, s long, v double").select("entity", F.timestamp_seconds("s").alias("hour"), "v").repartition(5)
    want = TS.interpolate(TS.reindexed(df, ["entity"], "hour", ["v"]), ["entity"], "t", {"v": limit}, both=both, edges=edges)
    got = TS.filled_hours(df, ["entity"], "hour", "v", limit, both, edges)
    values = [sorted(map(repr, map(tuple, x.select("entity", "hour", "t", "v").collect()))) for x in (want, got)]
    assert values[0] == values[1]
    assert got._jdf.queryExecution().executedPlan().toString().count("Generate") == 1
