from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import panel as P


def brute(points, ranges):
    out = []
    for p in points:
        met = [n for a, b, n in ranges if None not in (p, a, b) and a <= p < b]
        out += [(p, n) for n in met or [None]]
    return sorted(out, key=repr)


def joined(spark, points, ranges, kind):
    df = spark.createDataFrame([(p,) for p in points], f"at {kind}").repartition(3)
    found = P.interval_join(df, spark.createDataFrame(ranges, f"a {kind}, b {kind}, name int"), "at", "a", "b", ["name"])
    return found, sorted((tuple(r) for r in found.select("at", "name").collect()), key=repr)


@pytest.mark.parametrize("width", [3, 100, 10**6, 10**13])
def test_numbers_in_many_ranges(spark, width):
    rng = random.Random(width)
    points = [rng.randrange(-width, width) for _ in range(120)] + [0, 0, -1, None, None]
    ranges = [(a := rng.randrange(-width, width), a + rng.randrange(-1, width), n) for n in range(60)] + [(-width, width, 90), (None, 5, 91), (5, None, 92), (7, 7, 93), (-(2**62), 2**62, 94)]
    assert joined(spark, points, ranges, "long")[1] == brute(points, ranges)


def test_dates_timestamps_and_no_ranges(spark):
    day = dt.date(1969, 12, 20)
    points = [day + dt.timedelta(days=i) for i in range(30)] + [None]
    ranges = [(day, day + dt.timedelta(days=9), 1), (day + dt.timedelta(days=5), day + dt.timedelta(days=25), 2)]
    assert joined(spark, points, ranges, "date")[1] == brute(points, ranges)
    noon = dt.datetime(2000, 1, 1, 12)
    times = [noon + dt.timedelta(microseconds=i) for i in range(-2, 3)]
    spans = [(noon, noon + dt.timedelta(microseconds=1), 1), (noon - dt.timedelta(days=900), noon, 2)]
    assert joined(spark, times, spans, "timestamp")[1] == brute(times, spans)
    assert joined(spark, points, [], "date")[1] == brute(points, [])
    assert joined(spark, [], ranges, "date")[1] == []


def test_plan_compares_no_pairs(spark):
    ranges = [(n, n + 50, n) for n in range(10_000)]
    found, _ = joined(spark, [1, 70, 9_999], ranges, "long")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    counts = {r["at"]: r["n"] for r in found.groupBy("at").agg(F.count("name").alias("n")).collect()}
    assert counts == {1: 2, 70: 50, 9_999: 50}


def test_totals_over_ranges_make_no_row_for_a_pair(spark):
    rng = random.Random(6)
    points = [rng.randrange(-300, 300) for _ in range(80)] + [0, 0, None, 10**6]
    ranges = [(a := rng.randrange(-300, 300), a + rng.randrange(-1, 200), rng.randrange(50)) for _ in range(70)] * 2 + [(None, 5, 91), (5, None, 92), (7, 7, 93)]
    df = spark.createDataFrame([(p,) for p in points], "at long").repartition(3)
    kinds = {"n": ("count", "name"), "total": ("sum", "name"), "least": ("min", "name"), "most": ("max", "name")}
    found = P.interval_totals(df, spark.createDataFrame(ranges, "a long, b long, name int"), "at", "a", "b", kinds)
    want = []
    for p in points:
        met = [n for a, b, n in ranges if None not in (p, a, b) and a <= p < b]
        want.append((p, len(met), sum(met) if met else None, min(met, default=None), max(met, default=None)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
