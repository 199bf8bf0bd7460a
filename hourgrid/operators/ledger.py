"""The sweep over a run plan, kept in a ledger: a table of cells (run, fold, mode) in the shared folder.

A cell is written once, by Spark's commit protocol, so a sweep that was ended goes on where it stopped. Runs that come to
the same fit (fold, mode, inputs, rows, model, seed) share it. Medians for empty inputs and the products for all linear
models of all folds and row filters come from one scan each; linear predictions are scored where the rows are. Tree models
are fitted cell by cell, some at a time, as Spark jobs of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators import models as M
from hourgrid.operators import moments as O
from hourgrid.operators.evaluate import METRICS, error_metrics, persistence_predict, profile_predict
from hourgrid.operators.features import ROW_FILTERS, Feature, filter_rows, inputs_of

KEYS = ("run_id", "cv_mode", "fold_id", "track", "variant", "model_family", "model_key")
CELL_SQL = ", ".join([f"{k} string" for k in KEYS] + ["n_train long", "n_valid long"] + [f"{m} double" for m in METRICS] + ["fit_status string", "fit string"])
SEGMENTS = {"inner": "_inner", "event": "_event"}


def cell_name(run: dict, fold: str) -> str:
    return f"{run['cv_mode']}-{run['run_id']}-{fold}"


class Ledger:
    """Cells of a sweep in a folder; a new folder begins a new sweep."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def exists(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def cells(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], f"{CELL_SQL}, cell string")
        return self.spark.read.schema(f"{CELL_SQL}, cell string").parquet(self.folder).drop("part")

    def done(self) -> set[str]:
        return {r["cell"] for r in self.cells().select("cell").distinct().collect()}

    def add(self, rows: Sequence[dict]) -> None:
        names = [c.split()[0] for c in CELL_SQL.split(", ")]
        frame = self.spark.createDataFrame([tuple(r.get(n) for n in names) + (cell_name(r, r["fold_id"]),) for r in rows], f"{CELL_SQL}, cell string")
        # Each addition is a folder of its own: writers that run side by side share no temporary files.
        frame.coalesce(1).write.parquet(f"{self.folder}/part={uuid.uuid4().hex}")


def fit_name(run: dict, fold: str, inputs: Sequence[str]) -> str:
    """What decides a fit; runs with the same name share it."""
    return hashlib.sha256(repr((run["cv_mode"], fold, tuple(inputs), run["row_filter"], run["model_key"], run["seed"])).encode()).hexdigest()[:16]


def rounded(value: float | None) -> float | None:
    """Ten digits: sums come in any order, and cells of equal sweeps are equal."""
    return None if value is None else float(f"{value:.10g}")


def _groups(filters: Iterable[str]) -> list[tuple[str, str]]:
    return [(f, "" if f == "none" else ROW_FILTERS[f]) for f in sorted(filters)]


def sweep(plan: Sequence[dict], folds: Sequence[str], tables: dict[str, DataFrame], registered: Sequence[Feature], late: set[str], inner: Column, event: Column, ledger: Ledger, y: str = "rate", at_once: int = 4, tree_params: dict | None = None) -> DataFrame:
    """Fills the ledger with the cells of the plan that it lacks; returns its cells.

    ``tables``: for each mode the written feature table with fold and role. A cell without train or validation rows has
    the status ``empty_after_filter``, one whose fit fails on its data the status ``error: ...``; other errors end the sweep.
    """
    done = ledger.done()
    for mode, table in tables.items():
        cells = [(run, fold) for run in plan for fold in folds if run["cv_mode"] == mode and cell_name(run, fold) not in done]
        if cells:
            _mode(cells, table.withColumns({SEGMENTS["inner"]: F.coalesce(inner, F.lit(False)).cast("double"), SEGMENTS["event"]: F.coalesce(event, F.lit(False)).cast("double")}), registered, late, ledger, y, at_once, tree_params or {})
    return ledger.cells().drop("cell")


def _mode(cells, table, registered, late, ledger, y, at_once, tree_params) -> None:
    filters = _groups({run["row_filter"] for run, _ in cells})
    counts = table.where(F.col(y).isNotNull()).groupBy("fold", "role").agg(*[F.sum(F.lit(1) if not c else F.when(F.col(c) == 1, 1)).alias(f"n{i}") for i, (_, c) in enumerate(filters)]).collect()
    sizes = {(r["fold"], r["role"], name): r[f"n{i}"] or 0 for r in counts for i, (name, _) in enumerate(filters)}

    def row(run: dict, fold: str, metrics: dict, status: str, fit: str = "") -> dict:
        n_train, n_valid = (sizes.get((fold, role, run["row_filter"]), 0) for role in ("train", "valid"))
        return {k: run.get(k) for k in KEYS} | {"fold_id": fold, "n_train": n_train, "n_valid": n_valid, "fit_status": status, "fit": fit} | {m: rounded(metrics.get(m)) for m in METRICS}

    def empty(run: dict, fold: str) -> bool:
        return any(sizes.get((fold, role, run["row_filter"]), 0) == 0 for role in ("train", "valid"))

    ready = [row(run, fold, {}, "empty_after_filter") for run, fold in cells if empty(run, fold)]
    cells = [(run, fold) for run, fold in cells if not empty(run, fold)]
    train, valid = table.where("role = 'train'"), table.where("role = 'valid'")

    base = [(run, fold) for run, fold in cells if run["model_family"] == "baseline"]
    if base:
        predicted = persistence_predict(profile_predict(train, valid, y, ["fold"]), "l_occ_lag_1h", "l_occ_lag_24h")
        both = predicted.select("fold", y, *SEGMENTS.values(), F.inline(F.array(*[F.struct(F.lit(k).alias("model_key"), F.col(c).alias("yhat")) for k, c in (("profile_baseline", "profile_pred"), ("persistence_baseline", "persist_pred"))])))
        found = {(r["model_key"], r["fold"]): r.asDict() for r in error_metrics(both, ["model_key", "fold"], y, "yhat", F.col(SEGMENTS["inner"]) == 1, F.col(SEGMENTS["event"]) == 1).collect()}
        ready += [row(run, fold, found[run["model_key"], fold], "ok") for run, fold in base]
    if ready:
        ledger.add(ready)

    fits: dict[str, list[tuple[dict, str]]] = {}
    inputs: dict[str, list[str]] = {}
    for run, fold in cells:
        if run["model_family"] != "baseline":
            own = inputs_of(run["track"], run["variant"], registered, late)
            name = fit_name(run, fold, own)
            fits.setdefault(name, []).append((run, fold))
            inputs[name] = own
    if not fits:
        return
    columns = list(dict.fromkeys(c for own in inputs.values() for c in own))
    fill = O.group_medians(train.where(F.col(y).isNotNull()), "fold", columns, filters)
    group = {name: f"{of[0][1]}|{of[0][0]['row_filter']}" for name, of in fits.items()}

    linear = [name for name, of in fits.items() if of[0][0]["model_family"] == "ridge"]
    if linear:
        products = O.group_products(train, "fold", columns, y, fill, filters)
        rules, failed = [], {}
        for name in linear:
            try:
                weights, constant = O.ridge(products[group[name]], inputs[name], M.GRID[fits[name][0][0]["model_key"]]["alpha"])
                rules.append(O.Linear(name, group[name], tuple(inputs[name]), weights, constant))
            except M.FIT_ERRORS as problem:
                failed[name] = f"error: {type(problem).__name__}"
        found = {r["run"]: r.asDict() for r in O.linear_metrics(valid, "fold", y, SEGMENTS["inner"], SEGMENTS["event"], rules, fill, filters).collect()}
        ledger.add([row(run, fold, found.get(name, {}), failed.get(name, "ok"), name) for name in linear for run, fold in fits[name]])

    def tree(name: str) -> None:
        run, fold = fits[name][0]
        part = filter_rows(table.where(F.col("fold") == fold), run["row_filter"])
        try:
            model = M.fit_model(run["model_key"], part.where("role = 'train'"), inputs[name], y, run["seed"], fill=fill.get(group[name], {}), **tree_params.get(run["model_key"], {}))
            scored = model.transform(part.where("role = 'valid'"))
            metrics, status = error_metrics(scored, [], y, "yhat", F.col(SEGMENTS["inner"]) == 1, F.col(SEGMENTS["event"]) == 1).first().asDict(), "ok"
        except M.FIT_ERRORS as problem:
            metrics, status = {}, f"error: {type(problem).__name__}"
        ledger.add([row(r, f, metrics, status, name) for r, f in fits[name]])

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(tree, [name for name in fits if name not in linear]))
