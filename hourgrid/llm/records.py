"""Token ids as length-delimited binary records with masked checksums, and a separate index of offsets.

A file is a row of frames. A frame is

    length of the body, 8 bytes | masked crc32 of these 8 bytes, 4 bytes | body | masked crc32 of the body, 4 bytes | line feed

and a body is ``width`` (1 byte: bytes of an id, 2 or 4), a flag for a null key (1 byte), the key (8 bytes, signed), then
the ids. All numbers are little-endian. The mask turns a checksum round by 15 bits and adds a constant, so that a
checksum of bytes that hold checksums stays sound. Readers go by lengths; the line feed is only Spark's row end.

Files are in ascending order of keys, within and across files (by the number in their names). They are written by Spark's own text sink: its
commit protocol leaves out what lost or repeated tasks wrote, on any store that Spark reaches. Files are read whole, one
at a time, so their size is a parameter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import batch, text_or_empty
from hourgrid.llm.tokens import encoder, public_path

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
HEAD, BODY = "<QI", "<BBq"
#: Text that goes into one file.
FILE_BYTES = 32 << 20

FRAMES = pa.schema([("frame", pa.binary())])
INDEX = pa.schema([(n, pa.int64()) for n in ("offset", "length", "doc_id", "local_start", "n_tokens", "ids_crc32")] + [("file", pa.string())])
INDEX_SQL = "offset long, length long, doc_id long, local_start long, n_tokens long, ids_crc32 long, file string"
SEQUENCES_SQL = "place long, doc_id long, ids array<long>"


class CorruptRecord(ValueError):
    """A frame whose length or body does not match its checksum, or that ends too early."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    body = struct.pack(BODY, ids.dtype.itemsize, key is None, key or 0) + ids.tobytes()
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Key and ids of the frame at an offset, and the offset behind it."""
    if at + struct.calcsize(HEAD) > len(data):
        raise CorruptRecord(f"no frame at {at}")
    length, check = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise CorruptRecord(f"length at {at} does not match its checksum")
    start, end = at + struct.calcsize(HEAD), at + struct.calcsize(HEAD) + length
    body = bytes(data[start:end])
    if len(body) < length or end + 5 > len(data) or masked(body) != int.from_bytes(data[end : end + 4], "little"):
        raise CorruptRecord(f"body at {start} does not match its checksum")
    width, null, key = struct.unpack_from(BODY, body)
    return None if null else key, np.frombuffer(body, f"<u{width}", offset=struct.calcsize(BODY)), end + 5


def frames_of(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(public_path(tokenizer))
        end = np.array([end_id], enc.dtype)
        for b in batches:
            out, size = [], 0
            for key, ids in zip(b.column("key").to_pylist(), enc.ids(b.column("text")), strict=True):
                out.append(frame(key, np.concatenate((ids, end))))
                size += len(out[-1])
                if size > FILE_BYTES:
                    yield batch(FRAMES, frame=out)
                    out, size = [], 0
            yield batch(FRAMES, frame=out)

    return encode


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encodes whole texts (null: empty), adds ``end_id`` to each, and writes them in ascending order of keys.

    Null keys come first. Rows of one key (repeated rows) are in the order of their texts' hashes, so that many of them
    can lie in several files. An empty table gives a folder without frames.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["key", F.xxhash64("text")]
    ordered = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    frames = ordered.mapInArrow(frames_of(tokenizer, end_id), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each frame of whole files, all checksums checked."""
    for b in batches:
        for name, content in zip(b.column("file"), b.column("content"), strict=True):
            data, at, start = memoryview(content.as_buffer()), 0, 0
            rows = []
            while at < len(data):
                key, ids, behind = unframe(data, at)
                rows.append((at, behind - at, key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name.as_py()))
                at, start = behind, start + len(ids)
            if rows:
                yield batch(INDEX, **dict(zip(INDEX.names, zip(*rows, strict=True), strict=True)))


def write_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Reads all files of a folder, checks them and writes where each record lies; returns the written index."""
    files_of(spark, folder).mapInArrow(scan, INDEX_SQL).write.parquet(index)
    return spark.read.schema(INDEX_SQL).parquet(index)


def with_start(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records before a record, over all files in order.

    Only one total for each file is put in order: that of the numbers in their names, which are longer from 100,000 files on.
    """
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_ids"))
    number = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long")
    before = totals.select("file", F.coalesce(F.sum("_ids").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return index.join(before, "file").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for b in batches:
        for content, wanted in zip(b.column("content"), b.column("wanted").to_pylist(), strict=True):
            data = memoryview(content.as_buffer())
            for w in wanted:
                key, ids, _ = unframe(data, w["offset"])
                yield batch(schema, place=[w["place"]], doc_id=[key], ids=[ids.astype(np.int64)])


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Sequences at index rows (file, offset), each with the row's ``place``: reads in any order, such as a shuffled one."""
    by_file = wanted.groupBy("file").agg(F.collect_list(F.struct("place", "offset")).alias("wanted"))
    return files_of(spark, folder).join(by_file, "file").select("content", "wanted").mapInArrow(pick, SEQUENCES_SQL)


def shuffled(index: DataFrame, seed: int, key: Column | None = None) -> DataFrame:
    """Index rows with a ``place`` drawn from file and offset: ordered by it, they are one epoch's order."""
    return index.withColumn("place", F.xxhash64("file", "offset", F.lit(seed)) if key is None else key)
