"""Effect sizes and significance tests. Statistics are aggregations; tails are computed on the result rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.functions.tails import normal_p, student_p
from hourgrid.operators.describe import centred
from hourgrid.operators.quantile import ranked_values
from hourgrid.session import staged


# Practical thresholds per kind of effect, and evidence labels.
THRESHOLDS = {"delta": 0.02, "delta_diff": 0.02, "rho": 0.10, "rho_diff": 0.05}
ROBUST, SMALL, OPEN = "robust (stat + practical)", "detectable but small", "inconclusive"


def binary_effect(df: DataFrame, by: Sequence[str], flag: str, value: str, min_n: int = 30) -> DataFrame:
    """Counts and means with and without the flag, and their difference when both arms are large enough."""
    on, off = F.col(flag) == 1, F.col(flag) == 0
    s = df.groupBy(*by).agg(
        F.count(F.when(on, F.col(value))).alias("n1"), F.count(F.when(off, F.col(value))).alias("n0"),
        F.avg(F.when(on, F.col(value))).alias("mean1"), F.avg(F.when(off, F.col(value))).alias("mean0"),
    )
    enough = (F.col("n1") >= min_n) & (F.col("n0") >= min_n)
    return s.withColumn("delta", F.when(enough, F.col("mean1") - F.col("mean0")))


def adjusted_delta(df: DataFrame, by: Sequence[str], period: str, flag: str, value: str, min_n: int = 20) -> DataFrame:
    """Row-weighted mean of per-period deltas over the periods with enough rows in both arms."""
    per = binary_effect(df, [*by, period], flag, value, min_n).where("delta IS NOT NULL")
    weight = F.col("n1") + F.col("n0")
    return per.groupBy(*by).agg((F.sum(F.col("delta") * weight) / F.sum(weight)).alias("adjusted_delta"), F.count("*").alias("n_periods"))


def mann_whitney(df: DataFrame, by: Sequence[str], flag: str, value: str, min_n: int = 1) -> DataFrame:
    """U of the flagged arm, tie-corrected z with continuity, two-sided p, Cliff's delta.

    Only distinct values per group are ranked; each carries its counts per arm.
    """
    keys = list(by) or ["_all"]
    src = (df if by else df.withColumn("_all", F.lit(1))).where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    s = ranked_values(src, keys, value, {"n1v": F.col(flag) == 1}).groupBy(*keys).agg(
        F.sum("n1v").alias("n1"), F.sum(F.col("n") - F.col("n1v")).alias("n0"), F.sum(F.col("n1v") * F.col("midrank")).alias("_r1"),
        F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("_tie"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("_tie"), n * (n - 1)))
    enough = (F.col("n1") >= min_n) & (F.col("n0") >= min_n)
    # Two-sided: the larger of the two U counts against the mean, less one half for continuity.
    dist = F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(-0.5))
    s = s.withColumns({"u": F.when(enough, u), "z": F.when(enough & (var > 0), dist / F.sqrt(var)),
                       "cliffs_delta": F.when(enough, F.try_divide(2 * u, n1 * n0) - 1)})
    s = s.withColumn("p_value", F.least(normal_p(F.greatest(F.col("z"), F.lit(0.0))), F.lit(1.0)))
    s = s.withColumn("p_value", F.when(F.col("z").isNotNull(), F.col("p_value")))
    return s.select(*by, "n1", "n0", "u", "z", "p_value", "cliffs_delta")


def adjust_bh(df: DataFrame, p: str, q: str, family: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg over result rows; a NULL p stays NULL and is not counted."""
    fam = [F.col(f) for f in family] or [F.lit(1)]
    known = F.col(p).isNotNull()
    by_p = W.partitionBy(*fam, known).orderBy(F.col(p), *[F.col(x) for x in tie])
    ranked = df.withColumns({"_r": F.row_number().over(by_p), "_n": F.count(p).over(W.partitionBy(*fam, known))})
    tail = W.partitionBy(*fam, known).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    value = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(tail))
    return ranked.withColumn(q, F.when(known, value)).drop("_r", "_n")


def delta_with_se(df: DataFrame, by: Sequence[str], flag: str, value: str) -> DataFrame:
    """Difference of means of two arms and its standard error. Whole values are summed exactly, in any order."""
    on, off = F.when(F.col(flag) == 1, F.col(value)), F.when(F.col(flag) == 0, F.col(value))
    s = df.groupBy(*by).agg(F.count(on).alias("n1"), F.count(off).alias("n0"), F.try_divide(F.sum(on), F.count(on)).alias("_m1"), F.try_divide(F.sum(off), F.count(off)).alias("_m0"),
                            F.var_samp(on).alias("_v1"), F.var_samp(off).alias("_v0"))
    se = F.sqrt(F.try_divide(F.col("_v1"), F.col("n1").cast("double")) + F.try_divide(F.col("_v0"), F.col("n0").cast("double")))
    return s.select(*by, "n1", "n0", (F.col("_m1") - F.col("_m0")).alias("delta"), se.alias("se"))


def difference_of_deltas(deltas: DataFrame, by: Sequence[str], side: str, a: str, b: str) -> DataFrame:
    """z-test between the deltas of two sides; input from ``delta_with_se``."""

    def of(label: str, col: str) -> Column:
        return F.max(F.when(F.col(side) == label, F.col(col)))

    s = deltas.groupBy(*by).agg(of(a, "delta").alias("delta_a"), of(b, "delta").alias("delta_b"), of(a, "se").alias("_sa"), of(b, "se").alias("_sb"))
    s = s.withColumn("difference", F.col("delta_a") - F.col("delta_b"))
    s = s.withColumn("z", F.try_divide(F.col("difference"), F.sqrt(F.pow("_sa", 2) + F.pow("_sb", 2))))
    return s.withColumn("p_value", normal_p("z")).drop("_sa", "_sb")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Rank correlation with average ranks, and its t statistic and p.

    Rows are counted by (x, y) first, so that a value with most of the rows meets its rank once for each partner value.
    """
    keys = list(by) or ["_all"]
    src = (df if by else df.withColumn("_all", F.lit(1))).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = src.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_w"))

    def ranks(value: str) -> DataFrame:
        """Average ranks less their mean."""
        return ranked_values(cells, keys, value, weight="_w").select(*keys, F.col("v").alias(value), (F.col("midrank") - (F.col("total") + 1) / 2).alias(f"{value}r"))

    w, a, b = F.col("_w"), F.col("_xr"), F.col("_yr")
    ranked = cells.join(ranks("_x"), [*keys, "_x"]).join(ranks("_y"), [*keys, "_y"])
    s = ranked.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"))
    s = s.withColumn("rho", F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))))
    # No spread in one of the ranks gives no correlation.
    s = s.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))
    t = F.col("rho") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("rho") * F.col("rho")))
    s = s.withColumn("t_stat", t).withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 2).cast("double")))
    return s.select(*by, "n", "rho", "t_stat", "p_value")


def spearman_centred(df: DataFrame, by: Sequence[str], period: str, x: str, y: str, min_n: int = 3) -> DataFrame:
    """Rank correlation after removing the period means of both variables."""
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = centred(centred(src, [*by, period], x, "_cx"), [*by, period], y, "_cy")
    # Rounded so that equal deviations stay tied whatever the order of summation.
    both = both.withColumns({"_cx": F.round("_cx", 9), "_cy": F.round("_cy", 9)})
    return spearman(both, by, "_cx", "_cy", min_n)


def fisher_difference(df: DataFrame, r1: str, n1: str, r2: str, n2: str) -> DataFrame:
    """z-test of two independent correlations on result rows."""
    se = F.sqrt(F.try_divide(F.lit(1.0), (F.col(n1) - 3).cast("double")) + F.try_divide(F.lit(1.0), (F.col(n2) - 3).cast("double")))
    enough = (F.col(n1) > 3) & (F.col(n2) > 3)

    def bounded(r: str) -> Column:
        return F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col(r)))

    out = df.withColumn("z", F.when(enough & F.col(r1).isNotNull() & F.col(r2).isNotNull(), (F.atanh(bounded(r1)) - F.atanh(bounded(r2))) / se))
    return out.withColumn("p_value", normal_p("z"))


def evidence(df: DataFrame, q: str, effect: str, thresholds: dict[str, float], kind: str) -> DataFrame:
    """Practical threshold per kind of test and an evidence label."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col(kind))
    sig = F.coalesce(F.col(q) < 0.05, F.lit(False))
    large = F.coalesce(F.abs(effect) >= limit, F.lit(False))
    label = F.when(sig & large, ROBUST).when(sig, SMALL).otherwise(OPEN)
    return df.withColumns({"practical_threshold": limit, "evidence": label})


#: Rows of a chunk whose lagged pairs one task forms.
DM_CHUNK = 1 << 14


def diebold_mariano(df: DataFrame, keys: Sequence[str], order: str, e1: str, e2: str, lag: int = 24) -> DataFrame:
    """Compares absolute errors of two forecasts, Bartlett-weighted variance over ``lag`` rows.

    Rows follow (keys, order). Row numbers are two-level sums, so no task sees the whole series; they are cut into chunks
    with a copied rim of ``lag`` rows, so one exchange of about the rows themselves serves all lags.
    """
    from hourgrid.operators.windows import running_total, with_history

    # The losses are read several times below: a stage table keeps their lineage out of every branch.
    loss = staged(df.select(*keys, order, (F.abs(e1) - F.abs(e2)).alias("d")).where("d IS NOT NULL"))
    per_key = loss.groupBy(*keys).agg(F.count("*").alias("_n"))
    # One row per entity: the offsets of entities in key order.
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_key.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = running_total(loss, keys, order, {"_i": F.lit(1)}).join(offsets, list(keys))
    rows = numbered.select((F.col("_i") + F.col("_off")).alias("i"), "d")
    spread = with_history(rows, "i", lag, chunk=max(lag, DM_CHUNK))
    near = W.partitionBy("_chunk").orderBy("i")
    lagged = spread.select("_home", "d", *[F.lag("d", k).over(near).alias(f"_y{k}") for k in range(1, lag + 1)]).where("_home")
    out = lagged.agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.var_samp("d").alias("_g0"), *[F.covar_samp("d", f"_y{k}").alias(f"_c{k}") for k in range(1, lag + 1)])
    extra = sum((F.coalesce(F.col(f"_c{k}"), F.lit(0.0)) * (2 * (1 - k / (lag + 1.0))) for k in range(1, lag + 1)), F.lit(0.0))
    out = out.withColumn("_s", F.col("_g0") + extra)
    ok = (F.col("n") >= 10) & (F.col("_s") > 0)
    out = out.withColumn("dm_stat", F.when(ok, F.col("mean_d") / F.sqrt(F.col("_s") / F.col("n"))))
    return out.withColumn("p_value", normal_p("dm_stat")).select("n", "mean_d", "dm_stat", "p_value")


#: A prime below 2 ** 31: products of two smaller numbers stay within a long, in Spark, SQL and NumPy alike.
PRIME = 2**31 - 1
# Cumulative Poisson(1) probabilities for 0, 1, 2, ... events.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
           0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]


def key_number(key: str) -> Column:
    """A number below PRIME for each key, from its digest."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % F.lit(PRIME)


def drawn(x, rep, seed: int = 42):
    """A number below PRIME for each key number and replicate; columns or arrays of longs."""
    u = x * ((rep * 1103515245 + 12345 + seed * 7919) % PRIME) % PRIME
    u = (u * u + x + rep) % PRIME
    return (u * 48271 + x) % PRIME


def sql_drawn(x: str, rep: str, seed: int = 42) -> str:
    """The same as SQL text."""
    u = f"(({x} * (({rep} * 1103515245 + 12345 + {seed * 7919}) % {PRIME})) % {PRIME})"
    return f"((((({u} * {u} + {x} + {rep}) % {PRIME}) * 48271) + {x}) % {PRIME})"


def sql_key_number(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {PRIME})"


def poisson_cuts() -> list[int]:
    return [int(p * PRIME) for p in POISSON]


def _cells(b: pa.RecordBatch, keys: Sequence[str]) -> tuple[list[tuple], np.ndarray]:
    """The different groups of a batch, and the number of each row's group."""
    if not keys:
        return [()], np.zeros(len(b), np.int64)
    cells = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
    place = {c: i for i, c in enumerate(dict.fromkeys(cells))}
    return list(place), np.array([place[c] for c in cells], np.int64)


def _replicates(keys: list[str], reps: int, seed: int):
    """Sums of weighted values and of weights of a task's rows by (group, arm), all replicates of a cell in one vector."""
    cuts = np.array(poisson_cuts())
    number = np.arange(1, reps + 1)
    vector = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for b in batches:
            schema = schema or pa.schema([*[b.schema.field(k) for k in keys], b.schema.field("_a"), ("_s", vector), ("_n", vector)])
            groups, of = _cells(b, (*keys, "_a"))
            v, x = np.asarray(b.column("_v"), np.float64), np.asarray(b.column("_x"), np.int64)
            for i in range(0, len(b), 2048):
                part = slice(i, i + 2048)
                w = np.searchsorted(cuts, drawn(x[part, None], number, seed), side="right").astype(np.float64)
                for at, cell in enumerate(groups):
                    mine = of[part] == at
                    if mine.any():
                        own = np.stack((v[part][mine] @ w[mine], w[mine].sum(axis=0)))
                        sums[cell] = sums[cell] + own if cell in sums else own
            if len(sums) > 2000:
                yield out(sums, schema)
                sums = {}
        if sums:
            yield out(sums, schema)

    def out(sums: dict[tuple, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        columns = [*zip(*sums, strict=True), [s[0].tolist() for s in sums.values()], [s[1].tolist() for s in sums.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def bootstrap_delta(df: DataFrame, by: Sequence[str], arm: str, value: str, key: str, reps: int = 400, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Bootstrap interval of mean(arm=1) - mean(arm=0), with Poisson weights from a keyed number.

    Rows are not repeated: a task sums all replicates of a (group, arm) as one vector, and only vectors are moved.
    """
    keys = list(by)
    x = df.where(F.col(value).isNotNull() & F.col(arm).isNotNull()).select(*keys, F.col(arm).cast("int").alias("_a"), F.col(value).cast("double").alias("_v"), key_number(key).alias("_x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name not in ("_v", "_x"))
    parts = x.mapInArrow(_replicates(keys, reps, seed), f"{kinds}, _s array<double>, _n array<double>")
    each = parts.select(*keys, "_a", F.posexplode(F.arrays_zip("_s", "_n")).alias("rep", "_c"))

    def mean(a: int) -> Column:
        on = F.col("_a") == a
        return F.try_divide(F.sum(F.when(on, F.col("_c")["_s"])), F.sum(F.when(on, F.col("_c")["_n"])))

    per = each.groupBy(*keys, "rep").agg((mean(1) - mean(0)).alias("delta"))
    return per.groupBy(*keys).agg(
        F.avg("delta").alias("boot_mean"), F.percentile("delta", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("delta", F.lit(1 - alpha / 2)).alias("ci_high"),
    )


#: Slices of the range of drawn numbers.
SLICES = 64
SLICE = -(-PRIME // SLICES)
#: Differences of means this near to the observed one, as a share of the mean size of a value, are as large: sums of
#: doubles differ by the order of their rows, so equal differences would be told apart by chance.
TIE = 1e-9


def _sliced(keys: list[str], reps: int, seed: int):
    """Rows and their sum by group, replicate and slice of the drawn number, over a task's rows."""
    number = np.arange(1, reps + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        schema = None
        for b in batches:
            schema = schema or pa.schema([*[b.schema.field(k) for k in keys], ("rep", pa.int64()), ("_b", pa.int64()), ("_c", pa.int64()), ("_s", pa.float64())])
            groups, of = _cells(b, keys)
            v, x = np.asarray(b.column("_v"), np.float64), np.asarray(b.column("_x"), np.int64)
            for at, group in enumerate(groups):
                own = np.flatnonzero(of == at)
                for i in range(0, len(own), 2048):
                    rows = own[i : i + 2048]
                    cell = drawn(x[rows, None], number, seed) // SLICE + (number - 1) * SLICES
                    both = np.stack((np.bincount(cell.ravel(), minlength=reps * SLICES), np.bincount(cell.ravel(), np.repeat(v[rows], reps), minlength=reps * SLICES)))
                    found[group] = found[group] + both if group in found else both
            if len(found) > 64:
                yield from out(found, schema)
                found = {}
        yield from out(found, schema)

    def out(found: dict[tuple, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for group, (count, total) in found.items():
            at = np.flatnonzero(count)
            columns = [*[[k] * len(at) for k in group], at // SLICES + 1, at % SLICES, count[at].astype(np.int64), total[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def permutation_p(df: DataFrame, by: Sequence[str], arm: str, value: str, key: str, reps: int = 400, seed: int = 42) -> DataFrame:
    """Share of label permutations with a difference of means at least as large (up to ``TIE``), not below 1/reps.

    A replicate puts the n1 rows with the smallest drawn numbers in arm 1. Tasks count and sum their rows by slices of the
    number, all replicates at once; the slice with the cut is known from these counts, and only its rows (1 of 64 for each
    replicate) are moved and ranked. The table of cuts has a row for each group and replicate; it is written, so that it
    is broadcast only while its size is below the session's bound.
    """
    keys = list(by)
    x = df.where(F.col(value).isNotNull()).select(*keys, F.col(arm).alias("_a"), F.col(value).cast("double").alias("_v"), F.col(key).alias("_k"), key_number(key).alias("_x"))
    size = x.groupBy(*keys).agg(
        F.count_if(F.col("_a") == 1).alias("_n1"), F.count_if(F.col("_a") == 0).alias("_n0"), F.sum("_v").alias("_sum"), F.avg(F.abs("_v")).alias("_scale"),
        (F.avg(F.when(F.col("_a") == 1, F.col("_v"))) - F.avg(F.when(F.col("_a") == 0, F.col("_v")))).alias("_obs"),
    ).where("_n1 > 0 AND _n0 > 0")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in x.select(*keys).schema)
    counted = x.select(*keys, "_v", "_x").mapInArrow(_sliced(keys, reps, seed), f"{kinds}rep long, _b long, _c long, _s double")
    # Whole slices below the cut are summed, only the slice with the cut is ranked.
    buckets = counted.groupBy(*keys, "rep", "_b").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
    run = W.partitionBy(*keys, "rep").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    buckets = buckets.withColumns({"_cc": F.sum("_c").over(run), "_cs": F.sum("_s").over(run)}).join(size, keys)
    cut = buckets.where((F.col("_cc") >= F.col("_n1")) & (F.col("_cc") - F.col("_c") < F.col("_n1")))
    cut = staged(cut.select(*keys, "rep", "_b", "_cc", "_cs", "_c", "_s", "_n1", "_n0", "_sum", "_scale", "_obs"))
    # The cuts of a group as an array by replicate: a row finds the replicates in whose cut slice it lies.
    wanted = cut.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rep", "_b"))).alias("_cuts"))
    h = drawn(F.col("_x"), F.col("_r")["rep"], seed)
    near = x.join(wanted, keys).select(*keys, "_v", "_k", "_x", F.explode("_cuts").alias("_r")).withColumn("_h", h)
    near = near.where(F.call_function("div", F.col("_h"), F.lit(SLICE)) == F.col("_r")["_b"]).select(*keys, "_v", "_k", "_h", F.col("_r")["rep"].alias("rep"))
    inside = near.join(cut, [*keys, "rep"])
    r = F.row_number().over(W.partitionBy(*keys, "rep").orderBy("_h", "_k"))
    take = inside.withColumn("_take", r <= F.col("_n1") - (F.col("_cc") - F.col("_c")))
    per = take.groupBy(*keys, "rep").agg(
        F.max("_obs").alias("_obs"), F.max("_n1").alias("_n1"), F.max("_n0").alias("_n0"), F.max("_sum").alias("_sum"), F.max("_scale").alias("_scale"),
        (F.max(F.col("_cs") - F.col("_s")) + F.coalesce(F.sum(F.when(F.col("_take"), F.col("_v"))), F.lit(0.0))).alias("_s1"),
    )
    stat = F.col("_s1") / F.col("_n1") - (F.col("_sum") - F.col("_s1")) / F.col("_n0")
    hit = (F.abs(stat) >= F.abs("_obs") - TIE * F.col("_scale")).cast("double")
    return per.groupBy(*keys).agg(F.greatest(F.avg(hit), F.lit(1.0 / reps)).alias("p_value"), F.max("_obs").alias("delta"))
