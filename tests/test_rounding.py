"""Results that must not hang on the rounding of sums of doubles."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from hourgrid.operators import explain as X
from hourgrid.operators import significance as ST


def exact_p(counts, arms, reps):
    """The permutation p of whole numbers, in whole numbers."""
    x = [int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % ST.PRIME for k in range(len(counts))]
    n1, n0, whole = sum(arms), len(arms) - sum(arms), sum(counts)
    gap = lambda s: abs(s * n0 - (whole - s) * n1)
    observed = gap(sum(c for c, a in zip(counts, arms) if a))
    drawn = (sorted((ST.drawn(x[k], r), str(k), counts[k]) for k in range(len(counts)))[:n1] for r in range(1, reps + 1))
    hits = sum(gap(sum(c for *_, c in own)) >= observed for own in drawn)
    return max(hits / reps, 1 / reps)


def test_permutation_counts_equal_differences_as_large(spark):
    rng = random.Random(4)
    cases = {g: ([rng.randrange(6) for _ in range(200)], [int(i % 3 == 0) for i in range(200)]) for g in "abcd"}
    rows = [(g, str(k), a, c / 7) for g, (counts, arms) in cases.items() for k, (c, a) in enumerate(zip(counts, arms))]
    df = spark.createDataFrame(rows, "g string, k string, a int, v double")
    got = {r.g: r.p_value for r in ST.permutation_p(df.repartition(5), ["g"], "a", "v", "k", reps=200).collect()}
    assert got == {g: exact_p(*case, 200) for g, case in cases.items()}


def test_stability_gives_a_mean_of_zero_no_sign(spark):
    rows = [(w, "noise", 0.06, s * 1e-19) for w, s in enumerate((1, -1, 1, 0))] + [(w, "small", 1e-6, s * 1e-9) for w, s in enumerate((1, -1, 1, 1))]
    imp = spark.createDataFrame(rows, "week int, feature string, mean_abs double, mean_signed double").withColumn("run_id", F.lit("x"))
    got = {r.feature: r.sign_consistency for r in X.stability(X.ranked_importance(imp, ["week"]), ["run_id"], 1).collect()}
    assert got == {"noise": 0.0, "small": 0.75}
