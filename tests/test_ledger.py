from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import evaluate as EV
from hourgrid.operators import explain as X
from hourgrid.operators import features as FE
from hourgrid.operators import ledger as L
from hourgrid.operators import moments as O
from hourgrid.plans.features import LEVELS, fold_table
from hourgrid.plans.modelling import _segments
from hourgrid.session import stage_path, staged
from hourgrid.sources.frames import FOLDS, Frames

FOLDER = "/root/testdata/sf0.001"


def test_medians_of_groups_and_filters(spark):
    rng = np.random.default_rng(4)
    columns = {
        "x": rng.normal(size=900), "same": np.full(900, 7.5), "few": rng.integers(-3, 3, 900) / 1.0, "close": 1e6 + rng.random(900) * 1e-9, "tiny": rng.normal(size=900) * 1e-310,
        "gaps": np.where(rng.random(900) < 0.4, np.nan, rng.normal(size=900)), "none": np.full(900, np.nan),
    }
    group, passes = rng.integers(0, 3, 900), rng.integers(0, 2, 900)
    rows = [(str(g), int(p), *[None if c == "gaps" and np.isnan(v) else float(v) for c, v in zip(columns, r, strict=True)]) for g, p, *r in zip(group, passes, *columns.values(), strict=True)]
    df = spark.createDataFrame(rows, "g string, passes int, " + ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    found = O.group_medians(df, "g", list(columns), (("all", ""), ("some", "passes")))
    for g in range(3):
        for name, mask in (("all", group == g), ("some", (group == g) & (passes == 1))):
            want = {c: float(np.nanmedian(v[mask])) for c, v in columns.items() if c != "none"}
            assert found[f"{g}|{name}"] == want
    assert O.group_medians(df.limit(0), "g", list(columns)) == {}


def test_products_and_ridge_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4)) * [1, 100, 1e-3, 0] + [0, 1e5, 0, 3]
    y = x @ [1, 0.01, 5, 0] + rng.normal(size=400)
    df = spark.createDataFrame([(["p", "q"][i % 2], *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "g string, a double, b double, c double, d double, y double").repartition(3)
    got = O.group_products(df, "g", ["a", "b", "c", "d"], "y", {"p|none": {"b": 1e5}})["p|none"]
    own, target = x[::2], y[::2]
    assert got.n == 200 and np.allclose(got.mean, [*own.mean(0), target.mean()])
    weights, base = O.ridge(got, ["a", "b", "c", "d"], 1.0)
    sd = own.std(0)
    sd[3] = 1
    z = (own - own.mean(0)) / sd
    want = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (target - target.mean())) / sd
    assert np.allclose(weights, want, atol=1e-9) and np.isclose(base, target.mean() - own.mean(0) @ want)


@pytest.fixture(scope="module")
def setting(spark):
    t = Frames(spark, FOLDER)
    tables = {"fold_safe": staged(fold_table(t), ["fold", "role"])}
    plan = [r.asDict() for r in EV.ablation_plan(spark).where("cv_mode = 'fold_safe'").orderBy("run_id").collect()]
    inner, event = _segments()
    folds = [f[0] for f in FOLDS]
    small = {"rf_90_d12_l2": {"numTrees": 2, "maxDepth": 2}, "xgb_80_d4_lr006": {"maxIter": 1, "maxDepth": 1}}

    def sweep(part, folder, folds=folds):
        return L.sweep(part, folds, tables, FE.catalogue(LEVELS), set(), inner, event, L.Ledger(spark, folder), tree_params=small)

    return plan, folds, tables["fold_safe"], sweep


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sweep_fills_every_cell_once_and_goes_on_after_a_stop(spark, setting):
    plan, folds, table, sweep = setting
    folder = stage_path(spark, "ledger")
    linear = [r for r in plan if r["model_family"] in ("baseline", "ridge")]
    first = cells(sweep(linear[:4], folder))  # as if ended early
    files = set(spark.read.parquet(folder).inputFiles())
    whole = cells(sweep(linear, folder))
    assert set(first) <= set(whole) and len(whole) == len(linear) * len(folds)
    assert files < set(spark.read.parquet(folder).inputFiles())
    assert cells(sweep(linear, folder)) == whole and L.Ledger(spark, folder).cells().count() == len(whole)
    again = cells(sweep(linear, stage_path(spark, "ledger")))
    assert again == whole
    assert {r[-2] for r in whole} <= {"ok", "empty_after_filter"}


def test_cells_hold_the_metrics_of_their_fit(spark, setting):
    plan, folds, table, sweep = setting
    run = next(r for r in plan if r["run_id"] == "F2_ridge_a1_0")
    row = next(r for r in sweep([run], stage_path(spark, "ledger")).collect() if r["fold_id"] == folds[-1])
    names = FE.inputs_of(run["track"], run["variant"], FE.catalogue(LEVELS), set())
    rows = table.where(F.col("fold") == folds[-1]).where("rate IS NOT NULL").select("role", "rate", *names).toPandas().astype({n: float for n in ("rate", *names)})
    train, valid = (rows[rows.role == r] for r in ("train", "valid"))
    fill = train[names].median().fillna(0.0)
    x, v = train[names].fillna(fill).to_numpy(), valid[names].fillna(fill).to_numpy()
    sd = x.std(0)
    flat = sd <= 1e-9 * np.maximum(1, np.abs(x.mean(0)))
    sd[flat] = 1
    z = np.where(flat, 0, (x - x.mean(0)) / sd)
    w = np.linalg.solve(z.T @ z + np.eye(len(names)), z.T @ (train.rate - train.rate.mean()).to_numpy())
    error = np.abs(valid.rate.to_numpy() - (train.rate.mean() + np.where(flat, 0, (v - x.mean(0)) / sd) @ w))
    assert (row["n_train"], row["n_valid"]) == (len(train), len(valid))
    assert row["mae"] == pytest.approx(error.mean(), rel=1e-6) and row["rmse"] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6)


def test_runs_with_the_same_fit_share_it_and_trees_are_cells_too(spark, setting):
    plan, folds, table, sweep = setting
    part = [r for r in plan if r["variant"] in ("P3", "P4") and r["model_family"] == "random_forest"]
    out = sweep(part, stage_path(spark, "ledger"), folds[-1:]).collect()
    assert len(out) == len(part)
    by_fit = {}
    for r in out:
        if r["fit_status"] == "ok":
            by_fit.setdefault(r["fit"], []).append((r["variant"], r["mae"]))
    assert by_fit and all({v for v, _ in f} == {"P3", "P4"} and len({m for _, m in f}) == 1 for f in by_fit.values())


def test_importance_is_that_of_the_attributions(spark):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b) if b > -1 else None) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("g", F.lit("g")).repartition(3)
    rule = O.Linear("r", "g|none", ("a", "b"), np.array([2.0, -0.5]), 0.0)
    found = {r["feature"]: r for r in X.ranked_importance(X.linear_importance(df, "g", [rule], {"g|none": {"a": 0.1, "b": 0.2}}, {"g|none": {"b": 0.3}}), ["grp"]).collect()}
    a, b = np.array([2 * (x - 0.1) for x, _ in rows]), np.array([-0.5 * ((0.3 if y is None else y) - 0.2) for _, y in rows])
    for name, v, rank in (("a", a, 1), ("b", b, 2)):
        assert (found[name]["n"], found[name]["rank"]) == (200, rank)
        assert found[name]["mean_abs"] == pytest.approx(np.abs(v).mean()) and found[name]["mean_signed"] == pytest.approx(v.mean())
