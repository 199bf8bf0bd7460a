"""Day spine, holidays, vacations and the master calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.scalar import first_match
from hourgrid.operators.windows import latest_per_key

# Columns of the calendar.
CALENDAR_COLUMNS = [
    "date", "national_holiday_name", "other_holiday_name", "vacation_name", "vacation_type", "is_national_holiday",
    "is_other_holiday", "is_any_holiday", "is_school_vacation", "calendar_day_class", "year", "month", "weekday", "is_weekend",
]


def calendar_class(day: str = "date") -> Column:
    """National holiday, other holiday, school vacation, weekend, regular day: first that holds."""
    # Names of the classes.
    return first_match(
        [(F.col("is_national_holiday") == 1, "national_holiday"), (F.col("is_other_holiday") == 1, "other_holiday"),
         (F.col("is_school_vacation") == 1, "school_vacation"), (F.weekday(day) >= 5, "weekend")],
        "regular_day",
    )


def day_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def spine_of(df: DataFrame, day: str) -> DataFrame:
    """Every day between the first and last of the table."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))


def normal_holidays(raw: DataFrame, kind: str, name: str = "Feestdag", day: str = "Datum", fmt: str = "dd MMM yyyy") -> DataFrame:
    """Parsed holidays, one per (date, type); a date that does not parse fails the job."""
    if kind not in {"national", "other"}:
        raise ValueError("kind must be national or other")
    df = raw.select(F.col(name).alias("holiday_name"), F.to_date(day, fmt).alias("date"), F.lit(kind).alias("holiday_type"))
    df = latest_per_key(df, ["date", "holiday_type"], [F.col("holiday_name")], earliest=True)
    return df.withColumn("year", F.year("date").cast("bigint")).select("holiday_name", "date", "holiday_type", "year")


def interval_days(df: DataFrame, start: str, end: str, label: str) -> DataFrame:
    """One row per day of each interval; an interval that ends before it starts fails the job."""
    bad = F.raise_error(F.concat(F.lit("interval ends before it starts: "), F.col(label).cast("string")))
    days = F.when(F.col(end) >= F.col(start), F.sequence(F.col(start), F.col(end))).otherwise(bad)
    return df.withColumn("date", F.explode(days)).drop(start, end).distinct()


def master_calendar(holidays: DataFrame, vacation_days: DataFrame, spine: DataFrame) -> DataFrame:
    """One row per spine day with names, flags and class; several entries on one day resolve to the first name."""

    def of(kind: str) -> DataFrame:
        return holidays.where(F.col("holiday_type") == kind).groupBy("date").agg(F.min("holiday_name").alias(f"{kind}_holiday_name"))

    vacations = latest_per_key(
        vacation_days.select("date", "vacation_name", "vacation_type"), ["date"], [F.col("vacation_name"), F.col("vacation_type")], earliest=True
    )
    df = spine.join(of("national"), "date", "left").join(of("other"), "date", "left").join(vacations, "date", "left")
    df = df.withColumns(
        {
            "is_national_holiday": F.col("national_holiday_name").isNotNull().cast("tinyint"),
            "is_other_holiday": F.col("other_holiday_name").isNotNull().cast("tinyint"),
            "is_any_holiday": (F.col("national_holiday_name").isNotNull() | F.col("other_holiday_name").isNotNull()).cast("tinyint"),
            "is_school_vacation": F.col("vacation_name").isNotNull().cast("tinyint"),
            "year": F.year("date").cast("smallint"),
            "month": F.month("date").cast("tinyint"),
            "weekday": F.weekday("date").cast("tinyint"),
            "is_weekend": (F.weekday("date") >= 5).cast("tinyint"),
        }
    )
    return df.withColumn("calendar_day_class", calendar_class()).select(*CALENDAR_COLUMNS)
