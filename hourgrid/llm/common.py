"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Folder names that plain reads must skip start with one of these.
HIDDEN = ("_", ".")
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> SparkSession:
    """Bounds the bytes of what goes to a Python worker at once, unless the session says so itself: texts differ in length."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(size))
    return spark


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: made once for each key, then handed out again.

    The functions of this package travel by value, so a module variable would be new in every task.
    """
    store = sys.__dict__.setdefault("_hourgrid_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def strings(column: pa.Array) -> Iterator[str]:
    """Texts of an Arrow column; null counts as empty."""
    return ("" if x is None else x for x in column.to_pylist())


def unique_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, for a column that goes again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
