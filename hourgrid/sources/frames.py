"""Panels and dimensions derived from the driver tables, in Spark and, for checking, as SQL table expressions.

All averages come from integer cents, so they do not depend on the order of summation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Group of each entity; one entity has none.
GROUPS = {"click": "centrum", "view": "centrum", "purchase": "vesten", "signup": "rand"}
HOLDOUT_FROM = "2024-01-23"
# Fold, train_end_before, valid_start, valid_end.
FOLDS = [
    ("fold_1", "2024-01-08 00:00:00", "2024-01-08 00:00:00", "2024-01-12 23:00:00"),
    ("fold_2", "2024-01-13 00:00:00", "2024-01-13 00:00:00", "2024-01-17 23:00:00"),
    ("fold_3", "2024-01-18 00:00:00", "2024-01-18 00:00:00", "2024-01-22 23:00:00"),
]


class Frames:
    """Lazy tables over one directory of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("event_type").alias("entity"),
            "user_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "value",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
            F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("hour"),
        )

    def _cells(self, entity: str) -> DataFrame:
        return self.readings.groupBy(F.col(entity).cast("string").alias("entity"), "hour").agg(
            F.count("*").alias("occupied"),
            F.max("ts").alias("published"),
            F.sum("k").alias("ksum"),
            (F.sum("cents") / F.count("*") / 100).alias("value"),
        )

    @staticmethod
    def _with_calendar(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "t": F.unix_timestamp("hour"),
                "day": F.to_date("hour"),
                "hod": F.hour("hour"),
                "dow": F.weekday("hour"),
                "week": F.weekofyear("hour"),
                "weekend": (F.weekday("hour") >= 5).cast("int"),
            }
        )

    @cached_property
    def entities(self) -> DataFrame:
        """Entity dimension: capacity, group (NULL for one), position."""
        cells = self._cells("entity")
        group = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
        return cells.groupBy("entity").agg(F.max("occupied").alias("capacity"), F.sum("ksum").alias("_s")).select(
            "entity",
            "capacity",
            F.try_element_at(group, F.col("entity")).alias("grp"),
            (51.0 + (F.col("_s") % 100) / 1000).alias("lat"),
            (4.4 + (F.col("_s") % 37) / 1000).alias("lon"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Dense hourly panel: one row per (entity, hour)."""
        df = self._cells("entity").join(self.entities.select("entity", "capacity", "grp"), "entity")
        return self._with_calendar(df).withColumn("rate", F.col("occupied") / F.col("capacity"))

    @cached_property
    def sparse(self) -> DataFrame:
        """Sparse hourly panel by user: many entities with gaps."""
        return self._with_calendar(self._cells("user_id"))

    @cached_property
    def reported(self) -> DataFrame:
        """The dense panel as sensors would report it: halved capacities, wrong, missing and negative values."""
        k = F.col("ksum")
        df = self.panel.withColumn("override", F.when(k % 17 == 0, F.floor(F.col("capacity") / 2)).otherwise(F.col("capacity")))
        df = df.withColumn("count_in", F.when(k % 29 == 0, F.lit(-1)).otherwise(F.col("occupied")))
        base = F.try_divide(F.col("count_in").cast("double"), F.col("override").cast("double"))
        rate = F.when(k % 19 == 0, None).when(k % 23 == 0, base + 0.05).otherwise(base)
        return df.withColumn("rate_in", rate).select(
            "entity", "hour", "t", "day", "hod", "grp", "capacity", "published", "ksum", "override", "count_in", "rate_in"
        )

    @cached_property
    def weather(self) -> DataFrame:
        """Hourly sensor table with quality flags that may be true, false or missing."""
        k = F.sum("k")
        df = self.readings.groupBy("hour").agg(
            k.alias("s"),
            F.count("*").alias("n"),
            (F.sum("cents") / F.count("*") / 100).alias("_temp"),
            F.sum(F.when(F.col("k") % 3 == 0, 1).otherwise(0)).alias("_rain"),
            (F.max("cents") / 100).alias("_wind"),
            (F.max(F.when(F.col("k") % 2 == 0, F.col("cents"))) / 100).alias("_gust"),
            (F.sum("cents") / 100).alias("_wave"),
        )
        s = F.col("s")

        def qc(mod: int):
            return F.when(s % 11 == 0, None).otherwise(s % mod != 0)

        return df.select(
            "hour",
            F.unix_timestamp("hour").alias("t"),
            "s",
            F.col("_temp").alias("temp"),
            F.when(s % 13 == 0, None).when(s % 2 == 0, 0.0).otherwise(F.col("_rain").cast("double")).alias("precip"),
            F.col("_wind").alias("wind"),
            F.col("_gust").alias("gust"),
            F.when(s % 9 == 0, None).otherwise((s % 101).cast("double")).alias("humidity"),
            (950.0 + s % 97).alias("pressure"),
            F.when(s % 8 == 0, None).otherwise((s % 61).cast("double")).alias("sun_minutes"),
            F.when(s % 10 == 0, None).otherwise(F.col("_wave") * 2 - 10).alias("shortwave"),
            qc(7).alias("qc_temp"),
            qc(5).alias("qc_precip"),
            qc(12).alias("qc_wind"),
            qc(4).alias("qc_humidity"),
        )

    @cached_property
    def days(self) -> DataFrame:
        """Day dimension: event, holiday and vacation flags."""
        df = self.readings.groupBy(F.to_date("hour").alias("day")).agg(F.sum("k").alias("s"))
        s = F.col("s")
        return df.select(
            "day",
            (s % 3 == 0).cast("int").alias("is_event_day"),
            (s % 6 == 0).cast("int").alias("is_football_day"),
            (s % 7 == 0).cast("int").alias("is_national_holiday"),
            (s % 5 == 1).cast("int").alias("is_other_holiday"),
            (s % 4 == 1).cast("int").alias("is_school_vacation"),
            F.when(s % 3 == 0, 1 + s % 2).otherwise(0).alias("event_scale_max"),
            F.when(s % 3 == 0, 1 + s % 4).otherwise(0).alias("n_concurrent_events"),
            F.when(s % 6 == 0, 14.0 + s % 8).alias("kickoff_hour"),
        )

    @cached_property
    def mad(self) -> DataFrame:
        """Panel with weather and day columns."""
        w = self.weather.select("hour", "temp", "precip", "wind", "gust", "humidity", "sun_minutes", "shortwave")
        return self.panel.join(w, "hour", "left").join(self.days, "day", "left")

    @cached_property
    def daily(self) -> DataFrame:
        """Long daily panel: one row per (entity, day) over several years."""
        day = F.to_date("l_shipdate")
        cells = self.table("lineitem").groupBy(F.col("l_returnflag").alias("entity"), day.alias("day")).agg(
            F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"), F.sum(F.round(F.col("l_discount") * 100)).cast("bigint").alias("disc")
        )
        top = cells.groupBy("entity").agg(F.max("qty").alias("capacity"))
        return cells.join(top, "entity").select(
            "entity", "day", F.unix_date("day").alias("d"), "n", "qty", "disc", "capacity", (F.col("qty") / F.col("capacity")).alias("rate"),
            F.year("day").alias("year"), F.month("day").alias("month"), F.weekday("day").alias("dow"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Event registry, many rows per day."""
        kind = F.col("o_orderpriority")
        return self.table("orders").select(
            F.to_date("o_orderdate").alias("date"),
            F.concat_ws(" ", F.col("o_orderstatus"), F.expr("substr(o_orderpriority, 3)")).alias("name"),
            F.lower(F.expr("substr(o_orderpriority, 3)")).alias("kind"),
            (1 + F.col("o_orderkey") % 3).cast("int").alias("scale"),
            F.when(kind == "1-URGENT", 12.0 + F.col("o_orderkey") % 10).alias("kickoff_hour"),
            F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "estimated").otherwise("covid_modified").alias("confidence"),
            F.col("o_orderkey").alias("id"),
        )

    @cached_property
    def folds(self) -> DataFrame:
        rows = ", ".join(f"('{f}', timestamp'{a}', timestamp'{b}', timestamp'{c}')" for f, a, b, c in FOLDS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(fold, train_end_before, valid_start, valid_end)")


def _calendar(hour: str) -> str:
    return (
        f"CAST(epoch({hour}) AS BIGINT) AS t, CAST({hour} AS DATE) AS day, hour({hour}) AS hod, isodow({hour}) - 1 AS dow, "
        f"week({hour}) AS week, CAST(isodow({hour}) >= 6 AS INT) AS weekend"
    )


_QC = "CASE WHEN s % 11 = 0 THEN NULL ELSE s % {m} <> 0 END"

COMMON_SQL = {
    "hg_readings": """SELECT event_id, event_type AS entity, user_id, ts, value, CAST(round(value * 100) AS BIGINT) AS cents,
        CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, date_trunc('hour', ts) AS hour FROM events""",
    "hg_cells": """SELECT entity, hour, count(*) AS occupied, max(ts) AS published, CAST(sum(k) AS BIGINT) AS ksum,
        CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS value FROM hg_readings GROUP BY ALL""",
    "hg_entities": f"""SELECT entity, max(occupied) AS capacity,
        CASE {' '.join(f"WHEN entity = '{e}' THEN '{g}'" for e, g in GROUPS.items())} END AS grp,
        51.0 + (sum(ksum) % 100) / 1000 AS lat, 4.4 + (sum(ksum) % 37) / 1000 AS lon FROM hg_cells GROUP BY entity""",
    "hg_panel": f"""SELECT c.*, e.capacity, e.grp, CAST(c.occupied AS DOUBLE) / e.capacity AS rate, {_calendar('c.hour')}
        FROM hg_cells c JOIN hg_entities e USING (entity)""",
    "hg_sparse": f"""SELECT *, {_calendar('hour')} FROM (SELECT CAST(user_id AS VARCHAR) AS entity, hour, count(*) AS occupied,
        max(ts) AS published, CAST(sum(k) AS BIGINT) AS ksum, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS value
        FROM hg_readings GROUP BY ALL)""",
    "hg_reported": """SELECT entity, hour, t, day, hod, grp, capacity, published, ksum, override, count_in,
        CASE WHEN ksum % 19 = 0 THEN NULL WHEN ksum % 23 = 0 THEN count_in / nullif(override, 0)::DOUBLE + 0.05
             ELSE count_in / nullif(override, 0)::DOUBLE END AS rate_in
        FROM (SELECT *, CASE WHEN ksum % 17 = 0 THEN capacity // 2 ELSE capacity END AS override,
                        CASE WHEN ksum % 29 = 0 THEN -1 ELSE occupied END AS count_in FROM hg_panel)""",
    "hg_weather": f"""SELECT hour, CAST(epoch(hour) AS BIGINT) AS t, s, temp,
        CASE WHEN s % 13 = 0 THEN NULL WHEN s % 2 = 0 THEN 0.0 ELSE CAST(rain AS DOUBLE) END AS precip, wind, gust,
        CASE WHEN s % 9 = 0 THEN NULL ELSE CAST(s % 101 AS DOUBLE) END AS humidity, CAST(950 + s % 97 AS DOUBLE) AS pressure,
        CASE WHEN s % 8 = 0 THEN NULL ELSE CAST(s % 61 AS DOUBLE) END AS sun_minutes,
        CASE WHEN s % 10 = 0 THEN NULL ELSE wave * 2 - 10 END AS shortwave,
        {_QC.format(m=7)} AS qc_temp, {_QC.format(m=5)} AS qc_precip, {_QC.format(m=12)} AS qc_wind, {_QC.format(m=4)} AS qc_humidity
        FROM (SELECT hour, CAST(sum(k) AS BIGINT) AS s, count(*) AS n, CAST(sum(cents) AS DOUBLE) / count(*) / 100 AS temp,
              count(*) FILTER (WHERE k % 3 = 0) AS rain, max(cents) / 100.0::DOUBLE AS wind,
              max(cents) FILTER (WHERE k % 2 = 0) / 100.0::DOUBLE AS gust, CAST(sum(cents) AS DOUBLE) / 100 AS wave
              FROM hg_readings GROUP BY hour)""",
    "hg_days": """SELECT day, CAST(s % 3 = 0 AS INT) AS is_event_day, CAST(s % 6 = 0 AS INT) AS is_football_day,
        CAST(s % 7 = 0 AS INT) AS is_national_holiday, CAST(s % 5 = 1 AS INT) AS is_other_holiday,
        CAST(s % 4 = 1 AS INT) AS is_school_vacation, CASE WHEN s % 3 = 0 THEN 1 + s % 2 ELSE 0 END AS event_scale_max,
        CASE WHEN s % 3 = 0 THEN 1 + s % 4 ELSE 0 END AS n_concurrent_events,
        CASE WHEN s % 6 = 0 THEN CAST(14 + s % 8 AS DOUBLE) END AS kickoff_hour
        FROM (SELECT CAST(hour AS DATE) AS day, CAST(sum(k) AS BIGINT) AS s FROM hg_readings GROUP BY 1)""",
    "hg_mad": """SELECT p.*, w.temp, w.precip, w.wind, w.gust, w.humidity, w.sun_minutes, w.shortwave, d.* EXCLUDE (day)
        FROM hg_panel p LEFT JOIN hg_weather w USING (hour) LEFT JOIN hg_days d USING (day)""",
    "hg_daily": """SELECT entity, day, CAST(day - DATE '1970-01-01' AS BIGINT) AS d, n, qty, disc, capacity,
        qty / capacity::DOUBLE AS rate, year(day) AS year, month(day) AS month, isodow(day) - 1 AS dow
        FROM (SELECT *, max(qty) OVER (PARTITION BY entity) AS capacity FROM (
              SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS day, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty,
              CAST(sum(round(l_discount * 100)) AS BIGINT) AS disc FROM lineitem GROUP BY ALL))""",
    "hg_registry": """SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus || ' ' || substr(o_orderpriority, 3) AS name,
        lower(substr(o_orderpriority, 3)) AS kind, CAST(1 + o_orderkey % 3 AS INT) AS scale,
        CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(12 + o_orderkey % 10 AS DOUBLE) END AS kickoff_hour,
        CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'estimated' ELSE 'covid_modified' END AS confidence,
        o_orderkey AS id FROM orders""",
    "hg_folds": "SELECT * FROM (VALUES "
    + ", ".join(f"('{f}', TIMESTAMP '{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for f, a, b, c in FOLDS)
    + ") AS t(fold, train_end_before, valid_start, valid_end)",
}
