"""Regressors on feature tables: fit on train rows, predict any rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException, SparkRuntimeException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.operators.moments import group_medians

# Model grid.
GRID = {
    "ridge_a1_0": {"alpha": 1.0},
    "rf_90_d12_l2": {"numTrees": 90, "maxDepth": 12, "minInstancesPerNode": 2},
    "xgb_80_d4_lr006": {"maxIter": 80, "maxDepth": 4, "stepSize": 0.06, "subsamplingRate": 0.85},
}


def medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact train medians; a column without values gives 0. One number per feature reaches the driver."""
    found = group_medians(train.withColumn("_all", F.lit("")), "_all", features).get("|none", {})
    return {f: float(found.get(f, 0.0)) for f in features}


def imputed(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in fill.items()})


@dataclass
class Fitted:
    """A fitted regressor: features, medians and how to add the prediction column yhat."""

    key: str
    features: list[str]
    fill: dict[str, float]
    predict: Callable[[DataFrame], DataFrame]
    model: object = None
    linear: dict[str, list[float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predict(imputed(df, self.fill))


def fit_ridge(train: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> Fitted:
    """Ridge on standardised features: penalty alpha x sum of squared coefficients beside the residual sum of squares.

    The correlation matrix of features and target is one distributed pass; with it the normal equations are
    (R + alpha/n I) w = r_y sd(y), a system of the size of the feature list.
    """
    features = list(features)
    fill = medians(train, features)
    x = imputed(train.where(F.col(y).isNotNull()).select(*features, F.col(y).cast("double").alias("_y")), fill)
    columns = [*features, "_y"]
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(x).select("v").persist()
    stats = vectors.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).select("s.*").first()
    n, mean = int(stats["count"]), np.array(stats["mean"])
    # The summary has the sample variance; scaling uses the population one. A constant column keeps scale 1.
    sd = np.sqrt(np.maximum(np.array(stats["variance"]), 0.0) * (n - 1) / max(n, 1))
    flat = sd <= 1e-9 * np.maximum(1.0, np.abs(mean))
    scale = np.where(flat, 1.0, sd)
    r = np.array(Correlation.corr(vectors, "v").first()[0].toArray())
    vectors.unpersist()
    r[flat, :], r[:, flat] = 0.0, 0.0
    np.fill_diagonal(r, 1.0)
    k = len(features)
    w = np.linalg.solve(r[:k, :k] + alpha / n * np.eye(k), r[:k, k] * scale[k])
    raw = [float(v) for v in w / scale[:k]]
    base = float(mean[k] - np.dot(raw, mean[:k]))
    linear = {"coefficients": raw, "means": [float(m) for m in mean[:k]], "intercept": [base]}

    def predict(df: DataFrame) -> DataFrame:
        terms = " + ".join(f"`{f}` * CAST({c!r} AS DOUBLE)" for f, c in zip(features, raw))
        return df.withColumn("yhat", F.expr(f"CAST({base!r} AS DOUBLE) + {terms}"))

    return Fitted("ridge", features, fill, predict, None, linear)


def _fit_trees(estimator, key: str, train: DataFrame, features: Sequence[str], y: str, fill: dict[str, float] | None = None) -> Fitted:
    features = list(features)
    fill = medians(train, features) if fill is None else {f: fill.get(f, 0.0) for f in features}
    assemble = VectorAssembler(inputCols=features, outputCol="_features")
    model = estimator.setFeaturesCol("_features").setLabelCol(y).setPredictionCol("yhat").fit(assemble.transform(imputed(train.where(F.col(y).isNotNull()), fill)))
    return Fitted(key, features, fill, lambda df: model.transform(assemble.transform(df)).drop("_features"), model)


def fit_forest(train: DataFrame, features: Sequence[str], y: str, seed: int = 42, fill: dict[str, float] | None = None, **params) -> Fitted:
    cfg = {**GRID["rf_90_d12_l2"], "featureSubsetStrategy": "all", "subsamplingRate": 1.0, "seed": seed, **params}
    return _fit_trees(RandomForestRegressor(**cfg), "random_forest", train, features, y, fill)


def fit_boosting(train: DataFrame, features: Sequence[str], y: str, seed: int = 42, fill: dict[str, float] | None = None, **params) -> Fitted:
    return _fit_trees(GBTRegressor(**{**GRID["xgb_80_d4_lr006"], "seed": seed, **params}), "xgboost", train, features, y, fill)


def fit_model(key: str, train: DataFrame, features: Sequence[str], y: str, seed: int = 42, **params) -> Fitted:
    if key == "ridge_a1_0":
        return fit_ridge(train, features, y, GRID[key]["alpha"])
    if key == "rf_90_d12_l2":
        return fit_forest(train, features, y, seed, **params)
    if key == "xgb_80_d4_lr006":
        return fit_boosting(train, features, y, seed, **params)
    raise ValueError(f"unknown model {key}")


#: What a fit or its scoring raises on data it cannot use.
FIT_ERRORS = (IllegalArgumentException, SparkRuntimeException, Py4JJavaError, np.linalg.LinAlgError)


def tree_arrays(debug_text: str) -> list[dict]:
    """Node arrays per tree from a fitted ensemble's printed form: feature -1 marks a leaf."""
    trees: list[dict] = []
    nodes: list[list] = []
    stack: list[tuple[int, str]] = []

    def close() -> None:
        if nodes:
            cols = list(zip(*nodes))
            trees.append({"feature": np.array(cols[0], dtype=np.int64), "threshold": np.array(cols[1]), "left": np.array(cols[2], dtype=np.int64),
                          "right": np.array(cols[3], dtype=np.int64), "value": np.array(cols[4])})

    def attach(index: int) -> None:
        if stack:
            parent, side = stack.pop()
            nodes[parent][2 if side == "left" else 3] = index

    for line in debug_text.splitlines():
        text = line.strip()
        if text.startswith("Tree "):
            close()
            nodes, stack = [], []
        elif text.startswith("If "):
            feat, cut = re.match(r"If \(feature (\d+) <= ([-+0-9.eE]+)\)", text).groups()
            attach(len(nodes))
            nodes.append([int(feat), float(cut), -1, -1, 0.0])
            at = len(nodes) - 1
            stack += [(at, "right"), (at, "left")]
        elif text.startswith("Predict:"):
            attach(len(nodes))
            nodes.append([-1, 0.0, -1, -1, float(text.split(":")[1])])
    close()
    return trees
