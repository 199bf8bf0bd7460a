"""Session settings shared by tests, the benchmark and jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

STAGE_KEY = "spark.hourgrid.stage"
STAGES: dict[str, list[str]] = {}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python line of every column expression more than doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the submitter supplies master, memory and partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hourgrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the session's spark.checkpoint.dir, or spark.hourgrid.stage where only that is set.

    A local session with neither gets a fresh folder, removed when Python ends. Any other session is refused, and so is a
    spark.hourgrid.stage on a local disk, which the executors of a cluster do not share.
    """
    local = spark.sparkContext.master.split("[")[0] == "local"
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.conf.get(STAGE_KEY, None)
    if folder is None:
        if not local:
            raise ValueError(f"set spark.checkpoint.dir or {STAGE_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-hourgrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(STAGE_KEY, folder)
    if not local and (folder.startswith("file:") or ":" not in folder.split("/")[0]):
        raise ValueError(f"{STAGE_KEY} is on a local disk: {folder}")
    return folder


def stage_path(spark: SparkSession, label: str = "stage") -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Writes the table to the shared folder and reads it back: the stage boundary between features and models.

    Later plans start from files, so they stay small and a lost executor costs a re-read instead of the whole lineage.
    ``drop_stages`` removes what a session has staged.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.select(*[c for c in df.columns if c not in partition], *partition).schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Removes all stage tables of this application; call it when the results that read them are written."""
    paths = STAGES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_path(spark, path)
    return len(paths)
