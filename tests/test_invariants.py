"""Properties that must hold whatever the data, and independence of partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import describe as D
from hourgrid.operators import explain as X
from hourgrid.operators import features as FE
from hourgrid.operators import models as M
from hourgrid.operators import seasonal as SE
from hourgrid.operators import significance as ST
from hourgrid.operators import windows as O
from hourgrid.plans import load_all
from hourgrid.session import staged
from hourgrid.sources import readers as R
from hourgrid.sources.frames import Frames

load_all()
from hourgrid.plans import features as PF  # noqa: E402

HOUR = 3600
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    return Frames(spark, DATA)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in "abc":
        t = np.cumsum(rng.choice([1, 1, 1, 2, 40], 300))
        v = np.round(rng.normal(size=300), 1)
        rows += [(e, int(h) * HOUR, None if rng.random() < 0.1 else float(x)) for h, x in zip(t, v)]
    return pd.DataFrame(rows, columns=["entity", "t", "v"]), spark.createDataFrame(rows, "entity string, t bigint, v double")


@pytest.mark.parametrize("chunk", [7 * HOUR, 100 * HOUR, O.CHUNK])
def test_chunked_row_operators_match_pandas(walk, chunk):
    pdf, df = walk
    g = pdf.sort_values(["entity", "t"]).groupby("entity")
    out = O.neighbours(df, ["entity"], "t", [O.Look("p", F.col("v"), where=F.col("v").isNotNull(), inclusive=True),
                                             O.Look("n", F.col("v"), forward=True, where=F.col("v").isNotNull(), inclusive=True)], chunk)
    got = out.select("entity", "t", F.col("p.value").alias("p"), F.col("n.value").alias("n")).toPandas().sort_values(["entity", "t"])
    assert np.allclose(got.p, g.v.ffill(), equal_nan=True) and np.allclose(got.n, g.v.bfill(), equal_nan=True)
    total = O.running_total(df, ["entity"], "t", {"c": F.lit(1)}, chunk).toPandas().sort_values(["entity", "t"])
    assert list(total.c) == list(g.cumcount() + 1)
    lags = O.row_lags(df, ["entity"], "t", "v", 3, chunk).toPandas().sort_values(["entity", "t"])
    for k in (1, 2, 3):
        assert np.allclose(lags[f"lag_{k}"].astype(float), g.v.shift(k), equal_nan=True)


def test_range_lag_equals_join(walk):
    _, df = walk
    lag = O.exact_lags(df, ["entity"], "t", "v", [1, 24])
    for k in (1, 24):
        other = df.select("entity", (F.col("t") + k * HOUR).alias("t"), F.col("v").alias("w"))
        assert lag.join(other, ["entity", "t"], "left").where(~F.col(f"lag_{k}h").eqNullSafe(F.col("w"))).count() == 0


def test_partition_independence(frames):
    panel = frames.panel.select("entity", "hour", "t", "rate", "occupied")

    def run(n):
        p = panel.repartition(n)
        a = O.frozen(O.exact_lags(p, ["entity"], "t", "rate", [1]), ["entity"], "t", "occupied")
        s = X.stratified_sample(p, F.col("entity"), ["entity", "t"], 50)
        m = ST.mann_whitney(p.withColumn("f", (F.col("t") / HOUR % 2).cast("int")), ["entity"], "f", "occupied")
        return [sorted(map(tuple, x.collect()), key=repr) for x in (a, s, m)]

    assert run(1) == run(7)


def test_left_joins_keep_rows_and_guard_keys(spark, frames):
    assert frames.mad.count() == frames.panel.count()
    twice = frames.days.unionByName(frames.days)
    with pytest.raises(Exception, match="not unique"):
        R.unique_rows(twice, ["day"]).collect()


def test_holdout_cannot_change_parameters(frames):
    rows = PF.split_rows(frames)
    altered = rows.withColumns({"wind": F.when(F.col("split") == "holdout", 1e6).otherwise(F.col("wind")), "capacity": F.when(F.col("split") == "holdout", 1).otherwise(F.col("capacity"))})
    a, b = (FE.fit(x.where("split = 'train'"), levels=PF.LEVELS).first() for x in (rows, altered))
    assert a == b


def test_one_hots_and_fold_roles(frames):
    x = staged(PF.fold_table(frames, lags=False))
    hots = [c for c in x.columns if c.startswith("s_parking_id__")]
    assert x.where(sum((F.col(c) for c in hots), F.lit(0)) > 1).count() == 0
    ends = x.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("t"))).alias("a"), F.min(F.when(F.col("role") == "valid", F.col("t"))).alias("b"))
    assert ends.where("a >= b").count() == 0


def test_mann_whitney_arms_add_up(frames):
    p = frames.panel.withColumn("f", F.col("weekend")).withColumn("g", 1 - F.col("weekend"))
    a, b = ST.mann_whitney(p, [], "f", "occupied").first(), ST.mann_whitney(p, [], "g", "occupied").first()
    assert a.u + b.u == a.n1 * a.n0 and a.p_value == pytest.approx(b.p_value)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    n, k = 400, 6
    x = rng.normal(size=(n, k)) * [1, 10, 0.1, 1, 1, 1]
    x[:, 4] = x[:, 3] + 0.01 * rng.normal(size=n)
    x[:, 5] = 2.0
    y = x @ [1, 0.2, 3, -1, 0.5, 0] + rng.normal(size=n)
    names = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))
    fit = M.fit_ridge(df, names, "y", 1.0)
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - x.mean(axis=0)) / sd
    w = np.linalg.solve(z.T @ z + np.eye(k), z.T @ (y - y.mean()))
    assert np.allclose(fit.linear["coefficients"], w / sd, atol=1e-9)
    got = np.array([r.yhat for r in fit.transform(df).orderBy(*names).collect()])
    want = (z @ w + y.mean())[np.lexsort(x.T[::-1])]
    assert np.allclose(got, want, atol=1e-8)


def test_linear_attributions_add_up(frames):
    df = frames.panel.select("entity", "t", F.col("hod").cast("double").alias("a"), F.col("dow").cast("double").alias("b"))
    out = X.linear_attributions(df, ["a", "b"], [0.5, -2.0], [11.5, 3.0], 1.0).withColumn("p", 1.0 + 0.5 * F.col("a") - 2.0 * F.col("b"))
    assert X.additivity(out, ["a", "b"], "p").first().max_error < 1e-9


def test_tree_text_predicts_like_the_model(spark, frames):
    df = frames.panel.select(F.col("hod").cast("double").alias("a"), F.col("dow").cast("double").alias("b"), "rate")
    fit = M.fit_forest(df, ["a", "b"], "rate", numTrees=3, maxDepth=3)
    trees = M.tree_arrays(fit.model.toDebugString)
    rows = fit.transform(df).distinct()
    out = X.tree_attributions(rows.select("a", "b", "yhat"), ["a", "b"], trees, [1 / 3] * 3, np.array([[0.0, 0.0], [12.0, 3.0]]), samples=4)
    assert out.where(F.abs(F.col("model_pred") - F.col("yhat")) > 1e-9).count() == 0
    assert X.additivity(out, ["a", "b"], "model_pred").first().max_error < 1e-9


def test_sample_is_exact_and_proportional(frames):
    s = X.stratified_sample(frames.sparse, F.col("weekend").cast("string"), ["entity", "t"], 100)
    assert s.count() == 100 and s.select("entity", "t").distinct().count() == 100


def test_permutation_and_bootstrap_find_a_shift(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i < 60), float(rng.normal() + (i < 60))) for i in range(160)]
    df = spark.createDataFrame(rows, "k int, a int, v double").withColumn("g", F.lit("x"))
    boot, perm = ST.bootstrap_delta(df, ["g"], "a", "v", "k").first(), ST.permutation_p(df, ["g"], "a", "v", "k").first()
    assert boot.ci_low > 0 and perm.p_value <= 0.02
    null = df.withColumn("v", F.pmod(F.xxhash64("k"), F.lit(1000)).cast("double"))
    assert ST.permutation_p(null, ["g"], "a", "v", "k").first().p_value > 0.02


def test_permutation_takes_exactly_n1_rows(spark):
    # With value 1 in every row each permuted arm has mean 1, so no statistic differs from 0.
    df = spark.range(37).select(F.lit("x").alias("g"), F.col("id").alias("k"), (F.col("id") < 11).cast("int").alias("a"), F.lit(1.0).alias("v"))
    r = ST.permutation_p(df, ["g"], "a", "v", "k", reps=50).first()
    assert r.delta == 0 and r.p_value == 1.0


def test_unit_root_tests_tell_noise_from_walk():
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=600), np.cumsum(rng.normal(size=600))
    assert SE.adf(noise)[1] < 0.01 < 0.1 < SE.adf(walk)[1]
    assert SE.kpss(noise)[1] == 0.1 and SE.kpss(walk)[1] < 0.05


def test_robust_profile_matches_pandas(spark):
    rng = np.random.default_rng(8)
    x = pd.Series(rng.gamma(2, size=200))
    r = D.robust_profile(spark.createDataFrame([("g", float(v)) for v in x], "g string, v double"), ["g"], "v").first()
    assert r.skew == pytest.approx(x.skew()) and r.kurtosis == pytest.approx(x.kurt())
    assert r.mad == pytest.approx((x - x.median()).abs().median()) and r.sd == pytest.approx(x.std())
