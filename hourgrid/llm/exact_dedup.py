"""Exact deduplication as a stream: keyed state on disk, kept without expiry, and a check of full bytes on hits.

Arrivals are files of a folder. The state is keyed by the digest of the normalised text and holds the smallest
identifier met so far, the locator of that row's content (file and row in it) and how many rows had the digest. It lives
in RocksDB on the executors' disks, with its changes in the checkpoint folder, so a lost executor's part is rebuilt
elsewhere. Rows of a digest are reduced in each task before they meet, so a text with a third of all rows is no load.

A digest met before is only a hit. The content of hits is read again, that of the retained row by its locator, and
compared byte for byte; rows whose bytes differ from those of the retained row are told apart by their content.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import text_or_empty
from hourgrid.session import stage_path, staged

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # All stores of an executor share this much outside the heap; what does not fit is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # Many small stores would take megabytes each before anything is in them.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Least input of one round of the stream; larger inputs are taken in about so many rounds.
ROUND_BYTES, ROUNDS = 256 << 20, 8
#: Files are taken in however much older they are than the newest one.
NO_AGE = "36500d"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for a while; what the session had comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bytes_of(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space as one blank; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def fingerprints(rows: DataFrame, id_col: str = "doc_id", text: str = "text", digest_of: Column | None = None) -> DataFrame:
    """(digest, id, file, row) of each row of a batch or a stream of files."""
    where = F.col("_metadata")
    return rows.select((digest(text) if digest_of is None else digest_of).alias("digest"), F.col(id_col).cast("long").alias("id"), where["file_path"].alias("file"), where["row_index"].alias("row"))


def retained(arrivals: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of fingerprints until all that has arrived is taken in; returns the state.

    (digest, first: struct(null_id, id, file, row), seen). A further call with the same folder goes on from the state
    and takes in what has arrived since.
    """
    spark = arrivals.sparkSession
    # A null id is only retained where no row of the text has one.
    first = F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "file", "row"))
    state = arrivals.groupBy("digest").agg(first.alias("first"), F.count("*").alias("seen"))
    with settings(spark, ROCKSDB):
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(folder)
    fields = kept.schema["value"].dataType.names
    return kept.select(F.col("key.digest").alias("digest"), F.col("value")[fields[0]].alias("first"), F.col("value")[fields[1]].alias("seen"))


def deduplicate(spark: SparkSession, source: str, id_col: str = "doc_id", text: str = "text", state_folder: str | None = None, round_bytes: int | None = None, digest_of: Column | None = None) -> DataFrame:
    """One row per row of the Parquet files in ``source``: id, keep_id, group_size, kept, digest, file, row.

    Of rows with equal normalised text the one with the smallest id stays; of repeated rows with one id the first by
    file and row. Null ids come last: such a row stays only where no row of its text has an id. An empty folder table
    gives no rows. ``digest_of`` may replace the digest; a weak one only costs more checks.
    """
    schema = spark.read.parquet(source).schema
    source = source.rstrip("/")
    pattern = f"{source[:-1]}[{source[-1]}]"  # a stream takes a single file only by a pattern
    round_bytes = round_bytes or max(ROUND_BYTES, -(-bytes_of(spark, source) // ROUNDS))
    arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", round_bytes).option("maxFileAge", NO_AGE).parquet(pattern)
    state = retained(fingerprints(arrivals, id_col, text, digest_of), state_folder or stage_path(spark, "dedup-state"))
    content = spark.read.schema(schema).parquet(source)
    rows = staged(fingerprints(content, id_col, text, digest_of).join(state, "digest"))
    hits = rows.where("seen > 1").select("file", "row", "digest", "first")
    where = F.col("_metadata")
    located = content.select(where["file_path"].alias("file"), where["row_index"].alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    texts = staged(located.join(hits, ["file", "row"]).select("digest", "first", "id", "file", "row", normalised("text").alias("norm")))
    # Whole contents are the grouping key here, so contents are compared byte for byte, within tasks first.
    own = F.struct(F.col("id").isNull().alias("null_id"), "id", "file", "row")
    contents = texts.groupBy("digest", "norm").agg(F.min(own).alias("own"), F.count("*").alias("size"), F.max(own == F.col("first")).alias("is_retained"))
    several = contents.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1")
    # Digests that stand for several contents: their rows get what belongs to their own content.
    apart = texts.join(several, "digest").join(contents, ["digest", "norm"]).select("file", "row", "own", "size")
    out = rows.join(apart, ["file", "row"], "left")
    first, size = F.coalesce("own", "first"), F.coalesce("size", "seen")
    return out.select("id", first["id"].alias("keep_id"), size.alias("group_size"), ((F.col("file") == first["file"]) & (F.col("row") == first["row"])).alias("kept"), "digest", "file", "row")
