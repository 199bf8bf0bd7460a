"""Relations between entities: pair similarity, distance, spill-over, lead and lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.functions.scalar import haversine_km
from hourgrid.operators.quantile import quantiles, ranked_values


PAIR_BLOCKS = 8


def two_group_hours(panel: DataFrame, value: str, group: str, inner: str) -> DataFrame:
    """Mean of the inner group and of everything else per hour; a missing group counts as outside."""
    inside = F.coalesce(F.col(group) == inner, F.lit(False))
    return panel.groupBy("hour", "t").agg(
        F.avg(F.when(inside, F.col(value))).alias("inner"), F.avg(F.when(~inside, F.col(value))).alias("outer")
    )


def pair_correlation(cells: DataFrame, entity: str, slot: Sequence[str], value: str, min_n: int = 1) -> DataFrame:
    """Correlation of every unordered pair of entities over common slots; slots with few entities stay small.

    Output is entities squared, as asked for; the join key is the slot, spread over as many keys as there are slots.
    """
    a = cells.select(*slot, F.col(entity).alias("a"), F.col(value).alias("x"))
    b = cells.select(*slot, F.col(entity).alias("b"), F.col(value).alias("y"))
    pairs = a.join(b, list(slot)).where((F.col("a") < F.col("b")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return out.withColumn("r", F.when((F.col("n") >= min_n) & ~F.isnan("r"), F.col("r")))


def z_scored_profile(panel: DataFrame, entity: str, slot: Sequence[str], value: str) -> DataFrame:
    """Mean per slot, standardised within the entity."""
    cells = panel.groupBy(entity, *slot).agg(F.avg(value).alias("m"))
    stats = cells.groupBy(entity).agg(F.avg("m").alias("_mu"), F.stddev_samp("m").alias("_sd"))
    return cells.join(stats, entity).select(entity, *slot, F.try_divide(F.col("m") - F.col("_mu"), F.col("_sd")).alias("z"))


def with_distance(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    e = entities.select("entity", "lat", "lon")
    a = e.select(F.col("entity").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = e.select(F.col("entity").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    out = pairs.join(a, "a").join(b, "b")
    return out.withColumn("km", haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))).drop("la", "oa", "lb", "ob")


def shifted_hours(hours: DataFrame, lags: Sequence[int], column: str, by_rows: bool = False) -> DataFrame:
    """Hour table x lags with the column's value that many hours later (earlier when negative).

    By exact hour through a shifted join; ``by_rows`` moves by table rows instead, so gaps shorten the lag.
    """
    if by_rows:
        w = W.orderBy("t")
        numbered = hours.withColumn("_p", F.row_number().over(w))
        pos, step = "_p", 1
    else:
        numbered, pos, step = hours.withColumn("_p", F.col("t")), "_p", 3600
    later = numbered.select(
        F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), F.col(pos).alias("_q"), F.col(column).alias("shifted")
    ).withColumn(pos, F.col("_q") - F.col("lag") * step).drop("_q")
    return numbered.join(later, pos).drop("_p")


def spill_over(hours: DataFrame, thresholds: Sequence[float], lags: Sequence[int], min_n: int = 20, by_rows: bool = False) -> DataFrame:
    """Mean outer value later, after hours with the inner value at or over a threshold, against the other hours."""
    x = shifted_hours(hours, lags, "outer", by_rows).where("inner IS NOT NULL AND shifted IS NOT NULL")
    x = x.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    high = F.col("inner") >= F.col("threshold")
    s = x.groupBy("threshold", "lag").agg(
        F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"),
        F.avg(F.when(high, F.col("shifted"))).alias("mean_high"), F.avg(F.when(~high, F.col("shifted"))).alias("mean_low"),
    )
    enough = (F.col("n_high") >= min_n) & (F.col("n_low") >= min_n)
    return s.withColumn("delta", F.when(enough, F.col("mean_high") - F.col("mean_low")))


def lead_lag(hours: DataFrame, lags: Sequence[int], by_rows: bool = False) -> DataFrame:
    x = shifted_hours(hours, lags, "outer", by_rows).where("inner IS NOT NULL AND shifted IS NOT NULL")
    return x.groupBy("lag").agg(F.count("*").alias("n"), F.corr("inner", "shifted").alias("r"))


def theil_sen(points: DataFrame, x: str, y: str) -> DataFrame:
    """Median pair slope with its 95 % interval by the rank variance; input is an entity table, one row per entity.

    All pairs of entities are what the estimator is defined on. They are spread over block pairs (an equality join on
    hashed blocks), and slopes are counted per value at once.
    """
    d = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    every = F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)))
    own = F.pmod(F.xxhash64("x", "y"), F.lit(PAIR_BLOCKS)).cast("int")
    left = d.select(F.col("x").alias("xa"), F.col("y").alias("ya"), own.alias("i"), every.alias("j"))
    right = d.select(F.col("x").alias("xb"), F.col("y").alias("yb"), every.alias("i"), own.alias("j"))
    slopes = left.join(right, ["i", "j"]).where("xa < xb").select(F.try_divide(F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")).alias("slope"))

    def ties(c: str) -> DataFrame:
        k = F.col("count")
        return d.groupBy(c).count().agg(F.coalesce(F.sum(k * (k - 1) * (2 * k + 5)), F.lit(0)).alias(f"_t{c}"))

    n = F.col("_n")
    size = d.agg(F.count("*").alias("_n")).crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(slopes.agg(F.count("*").alias("_m")))
    sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("_tx") - F.col("_ty")) / 18.0)
    # Fixed value: the 97.5 % normal quantile.
    half = 1.959963984540054 * sigma
    size = size.withColumns(
        {
            "_hi": F.least(F.bround((F.col("_m") + half) / 2).cast("bigint"), F.col("_m") - 1),
            "_lo": F.greatest(F.bround((F.col("_m") - half) / 2).cast("bigint") - 1, F.lit(0)),
        }
    )
    ranked = ranked_values(slopes, [], "slope").crossJoin(F.broadcast(size))

    def at(index: str) -> Column:
        return F.max(F.when((F.col("cum") - F.col("n") <= F.col(index)) & (F.col(index) < F.col("cum")), F.col("v")))

    ends = ranked.agg(at("_lo").alias("slope_low"), at("_hi").alias("slope_high"))
    return quantiles(slopes, [], "slope", {"slope": 0.5}).crossJoin(ends)


def group_contrast(pairs: DataFrame, groups: DataFrame, same: str = "same_group") -> DataFrame:
    """Pairs labelled by whether both entities share a group (missing groups count as one group)."""
    g = groups.select("entity", F.coalesce("grp", F.lit("none")).alias("g"))
    out = pairs.join(g.select(F.col("entity").alias("a"), F.col("g").alias("ga")), "a").join(
        g.select(F.col("entity").alias("b"), F.col("g").alias("gb")), "b"
    )
    return out.withColumn(same, (F.col("ga") == F.col("gb")).cast("int")).drop("ga", "gb")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
