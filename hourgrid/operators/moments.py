"""Exact medians and product sums of many columns by group: few scans, and no row is moved.

Tasks look at columns, not at rows made long: each hands on counts of value ranges, or sums of products, that add up. A
median is found by its bits: all values are counted by their first bits, then those of the ranges that hold the middle
ones by their next bits, until a range holds one value. What moves is bounded by the number of ranges, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value that a scan tells apart.
STEPS = (16, 24, 24)
Groups = Sequence[tuple[str, str]]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def members(b: pa.RecordBatch, by: str, groups: Groups) -> Iterator[tuple[str, np.ndarray]]:
    """Group names with the rows of a batch in each: a value of ``by`` with a filter, whose column is 1 where it lets a row pass."""
    coded = b.column(by).dictionary_encode()
    of = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for i, value in enumerate(coded.dictionary.to_pylist()):
        for name, column in groups:
            rows = of == i if not column else (of == i) & (numbers(b.column(column)) == 1)
            if rows.any():
                yield f"{value}|{name}", np.flatnonzero(rows)


COUNTED = pa.schema([("grp", pa.string()), ("col", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
COUNTED_SQL = "grp string, col int, bucket long, n long, lo double, hi double"


def counting(by: str, groups: Groups, columns: Sequence[str], shift: int, wanted: dict[tuple[str, int], set[int]] | None, step: int):
    """Counts of values by their bits above ``shift``, of those whose bits above ``shift + step`` are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list] = [[] for _ in COUNTED]
            for grp, rows in members(b, by, groups):
                for c, name in enumerate(columns):
                    target = None if wanted is None else wanted.get((grp, c))
                    if wanted is not None and not target:
                        continue
                    x = numbers(b.column(name))[rows]
                    x = x[np.isfinite(x)]
                    bits = ordered_bits(x)
                    if target:
                        keep = np.isin(bits >> np.uint64(shift + step), np.array(sorted(target), np.uint64))
                        x, bits = x[keep], bits[keep]
                    if not len(x):
                        continue
                    order = np.argsort(bits, kind="stable")
                    found, first, n = np.unique(bits[order] >> np.uint64(shift), return_index=True, return_counts=True)
                    x = x[order] + 0.0
                    for part, value in zip(parts, ([grp] * len(found), [c] * len(found), found.astype(np.int64), n, x[first], x[first + n - 1]), strict=True):
                        part.append(pa.array(value))
            columns_of = [pa.concat_arrays([a.cast(f.type) for a in p]) if p else pa.array([], f.type) for p, f in zip(parts, COUNTED, strict=True)]
            yield pa.RecordBatch.from_arrays(columns_of, schema=COUNTED)

    return run


def group_medians(df: DataFrame, by: str, columns: Sequence[str], groups: Groups = (("none", ""),)) -> dict[str, dict[str, float]]:
    """Median of each column in each group ("value|filter"), over values that are neither null nor NaN; none: no entry.

    Of an even number of values it is the mean of the middle two. Two numbers a column and group come to the driver.
    """
    columns = list(columns)
    used = df.select(by, *columns, *sorted({c for _, c in groups if c} - set(columns)))
    kinds = {f.name: f.dataType.simpleString() for f in used.schema}
    used = used.select(F.col(by).cast("string").alias(by), *[F.col(c).cast("double").alias(c) if kinds[c] != "double" else F.col(c) for c in used.columns if c != by])
    out: dict[str, dict[str, float]] = {}
    # For each column of a group: the two middle ranks, counted from the start of the range that holds them.
    wanted: dict[tuple[str, int], dict[int, list[int]]] | None = None
    middle: dict[tuple[str, int], list[float]] = {}
    shift = 64
    for step in STEPS:
        shift -= step
        prefixes = None if wanted is None else {k: set(v) for k, v in wanted.items()}
        counted = used.mapInArrow(counting(by, groups, columns, shift, prefixes, step), COUNTED_SQL)
        counted = counted.groupBy("grp", "col", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        above = F.expr(f"shiftrightunsigned(bucket, {step})") if wanted is not None else F.lit(0).cast("long")
        run = Window.partitionBy("grp", "col", "above").orderBy("bucket")
        placed = counted.withColumn("above", above).withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("whole", F.sum("n").over(Window.partitionBy("grp", "col", "above")))
        if wanted is None:
            low, high = F.expr("(whole - 1) div 2"), F.expr("whole div 2")
            hit = F.array(*[F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), r - F.col("before")) for r in (low, high)])
            rows = placed.withColumn("ranks", F.filter(hit, lambda x: x.isNotNull())).where(F.size("ranks") > 0)
        else:
            ask = used.sparkSession.createDataFrame([(g, c, p, r) for (g, c), v in wanted.items() for p, ranks in v.items() for r in ranks], "grp string, col int, above long, rank long")
            met = placed.join(F.broadcast(ask), ["grp", "col", "above"]).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
            rows = met.withColumn("ranks", F.array(F.col("rank") - F.col("before")))
        left: dict[tuple[str, int], dict[int, list[int]]] = {}
        for r in rows.select("grp", "col", "bucket", "lo", "hi", "ranks").collect():
            for rank in r["ranks"]:
                if r["lo"] == r["hi"]:
                    middle.setdefault((r["grp"], r["col"]), []).append(r["lo"])
                else:
                    left.setdefault((r["grp"], r["col"]), {}).setdefault(r["bucket"], []).append(rank)
        if not left:
            break
        wanted = left
    for (grp, c), values in middle.items():
        out.setdefault(grp, {})[columns[c]] = sum(values) / len(values)
    return out


@dataclass(frozen=True)
class Products:
    """Number of rows, means, and covariances (of the population) of some columns."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray


def filled(b: pa.RecordBatch, columns: Sequence[str], fill: dict[str, float]) -> np.ndarray:
    x = np.column_stack([numbers(b.column(c)) for c in columns])
    return np.where(np.isnan(x), np.array([fill.get(c, 0.0) for c in columns]), x)


def summing(by: str, groups: Groups, columns: Sequence[str], y: str, fill: dict[str, dict[str, float]]):
    """Sums of products of the columns, y and 1, less the fill values, of a task's rows with a y: a row for each of them."""
    schema = pa.schema([("grp", pa.string()), ("i", pa.int32()), ("products", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            target = numbers(b.column(y))
            for grp, rows in members(b, by, groups):
                rows = rows[np.isfinite(target[rows])]
                own = fill.get(grp, {})
                part = b.take(pa.array(rows))
                x = filled(part, columns, own) - np.array([own.get(c, 0.0) for c in columns])
                z = np.column_stack((x, target[rows], np.ones(len(rows))))
                sums[grp] = sums.get(grp, 0.0) + z.T @ z
        for grp, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(s)), pa.array(range(len(s)), pa.int32()), pa.array(list(s), schema.field("products").type)], schema=schema)

    return run


def group_products(df: DataFrame, by: str, columns: Sequence[str], y: str, fill: dict[str, dict[str, float]], groups: Groups = (("none", ""),)) -> dict[str, Products]:
    """Products of the columns and y in each group, nulls filled by the group's values, in one scan.

    A matrix of the number of columns comes to the driver for each group.
    """
    columns = list(columns)
    width = len(columns) + 2
    used = df.select(F.col(by).cast("string").alias(by), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*columns, y, *[c for _, c in groups if c]])])
    rows = used.mapInArrow(summing(by, groups, columns, y, fill), "grp string, i int, products array<double>")
    added = rows.groupBy("grp", "i").agg(F.array(*[F.sum(F.col("products")[j]) for j in range(width)]).alias("products"))
    found: dict[str, np.ndarray] = {}
    for r in added.collect():
        found.setdefault(r["grp"], np.zeros((width, width)))[r["i"]] = r["products"]
    out = {}
    for grp, s in found.items():
        n = int(round(s[-1, -1]))
        shift = np.array([fill.get(grp, {}).get(c, 0.0) for c in columns] + [0.0])
        mean = s[-1, :-1] / n
        out[grp] = Products((*columns, y), n, mean + shift, s[:-1, :-1] / n - np.outer(mean, mean))
    return out


@dataclass(frozen=True)
class Linear:
    """A fitted linear rule: run names it, in the group ("value|filter") whose rows it scores."""

    run: str
    group: str
    columns: tuple[str, ...]
    weights: np.ndarray
    base: float


def ridge(products: Products, features: Sequence[str], alpha: float) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge on standardised columns; a column that does not vary has weight 0."""
    at = [products.columns.index(f) for f in features]
    k, mean, var = len(at), products.mean, np.maximum(np.diag(products.cov), 0.0)
    sd = np.sqrt(var[at])
    flat = sd <= 1e-9 * np.maximum(1.0, np.abs(mean[at]))
    scale = np.where(flat, 1.0, sd)
    r = products.cov[np.ix_(at, at)] / np.outer(scale, scale)
    r[flat, :], r[:, flat] = 0.0, 0.0
    np.fill_diagonal(r, 1.0)
    towards = np.where(flat, 0.0, products.cov[at, -1] / scale)
    weights = np.linalg.solve(r + alpha / products.n * np.eye(k), towards) / scale
    return weights, float(mean[-1] - weights @ mean[at])


def deviating(by: str, groups: Groups, columns: Sequence[str], means: dict[str, dict[str, float]], fill: dict[str, dict[str, float]]):
    schema = pa.schema([("grp", pa.string()), ("column", pa.string()), ("n", pa.int64()), ("size", pa.float64()), ("off", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, rows in members(b, by, groups):
                if grp in means:
                    off = filled(b.take(pa.array(rows)), columns, fill.get(grp, {})) - np.array([means[grp][c] for c in columns])
                    values = ([grp] * len(columns), list(columns), [len(rows)] * len(columns), np.abs(off).sum(axis=0), off.sum(axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return run


def group_deviations(df: DataFrame, by: str, columns: Sequence[str], means: dict[str, dict[str, float]], fill: dict[str, dict[str, float]], groups: Groups = (("none", ""),)) -> DataFrame:
    """(grp, column, n, size, off): mean size and mean of each column's deviation from its group's mean, in one scan."""
    used = df.select(F.col(by).cast("string").alias(by), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*columns, *[c for _, c in groups if c]])])
    sums = used.mapInArrow(deviating(by, groups, list(columns), means, fill), "grp string, `column` string, n long, size double, off double")
    return sums.groupBy("grp", "column").agg(F.sum("n").alias("n"), (F.sum("size") / F.sum("n")).alias("size"), (F.sum("off") / F.sum("n")).alias("off"))


#: Sums that metrics are made of.
SUMS = ("n", "abs", "square", "share", "n_inner", "inner", "n_outer", "outer", "n_event", "event", "n_plain", "plain")


def scoring(by: str, groups: Groups, y: str, inner: str, event: str, rules: Sequence[Linear], fill: dict[str, dict[str, float]]):
    schema = pa.schema([("grp", pa.string()), ("run", pa.string())] + [(s, pa.float64()) for s in SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            target, is_inner, is_event = numbers(b.column(y)), numbers(b.column(inner)) == 1, numbers(b.column(event)) == 1
            out = []
            for grp, rows in members(b, by, groups):
                own = [r for r in rules if r.group == grp]
                rows = rows[np.isfinite(target[rows])]
                if not own or not len(rows):
                    continue
                columns = list(dict.fromkeys(c for r in own for c in r.columns))
                x = filled(b.take(pa.array(rows)), columns, fill.get(grp, {}))
                place = {c: i for i, c in enumerate(columns)}
                actual = target[rows]
                for r in own:
                    error = np.abs(actual - (x[:, [place[c] for c in r.columns]] @ r.weights + r.base))
                    sums = [len(rows), error.sum(), (error**2).sum(), (100 * error / np.maximum(np.abs(actual), 1e-6)).sum()]
                    for m in (is_inner[rows], ~is_inner[rows], is_event[rows], ~is_event[rows]):
                        sums += [m.sum(), error[m].sum()]
                    out.append((grp, r.run, *map(float, sums)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def linear_metrics(df: DataFrame, by: str, y: str, inner: str, event: str, rules: Sequence[Linear], fill: dict[str, dict[str, float]], groups: Groups = (("none", ""),)) -> DataFrame:
    """(grp, run, n, mae, rmse, mape, mae of segments) of all rules on the rows of their groups, in one scan.

    ``inner`` and ``event`` are columns that are 1 in the segment. Rows are scored and summed up where they are.
    """
    columns = dict.fromkeys([*[c for r in rules for c in r.columns], y, inner, event, *[c for _, c in groups if c]])
    used = df.select(F.col(by).cast("string").alias(by), *[F.col(c).cast("double").alias(c) for c in columns])
    sums = used.mapInArrow(scoring(by, groups, y, inner, event, rules, fill), "grp string, run string, " + ", ".join(f"`{s}` double" for s in SUMS))
    added = sums.groupBy("grp", "run").agg(*[F.sum(s).alias(s) for s in SUMS])
    mean: Callable = lambda a, n: F.try_divide(F.col(a), F.col(n))
    return added.select(
        "grp", "run", F.col("n").cast("long").alias("n"), mean("abs", "n").alias("mae"), F.sqrt(mean("square", "n")).alias("rmse"), mean("share", "n").alias("mape"),
        mean("inner", "n_inner").alias("mae_inner"), mean("outer", "n_outer").alias("mae_outer"), mean("event", "n_event").alias("mae_event"), mean("plain", "n_plain").alias("mae_non_event"),
    )
