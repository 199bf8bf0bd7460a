"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts are a group and stay together. A group's size is a vector (bytes, tokens, rows), in shares of the
whole. It goes to the shard for which the dot product with the residual capacity is highest.

Groups are first reduced in their tasks to one row. The few groups that are large against a shard (their number is
bounded by how large they must be) are placed by one task, in falling order. The others are dealt by their digest to
blocks; in each block, in falling order, groups are placed against the block's part of what the large groups have left
of every shard. Blocks are independent, so they run in parallel, and each levels its own small end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import text_or_empty
from hourgrid.session import staged

#: Groups placed by one task on average, and the share of a shard from which on a group is large.
BLOCK_GROUPS, LARGE = 8192, 1 / 512
#: What bytes, tokens and rows count in the dot product: where a group of many short rows makes them differ, bytes come first.
WEIGHTS = (8.0, 1.0, 1.0)

PLACED = pa.schema([("digest", pa.binary()), ("shard", pa.int32())])


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, bytes, tokens, crc) of every row; null texts count as empty. Bytes are those of the text plus 1."""
    t = F.col("_t")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("_t"))
    return rows.select("doc_id", F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), (F.octet_length(t) + 1).cast("long").alias("bytes"), F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(t.cast("binary")).alias("crc"))


def place(demand: np.ndarray, capacity: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Shard of each demand, taken in falling order of the largest component. Both as shares of like measure.

    A shard's residual capacity may become negative, it then repels what asks for that dimension.
    """
    left = capacity.copy()
    out = np.zeros(len(demand), np.int32)
    for i in np.lexsort((np.arange(len(demand)), -demand.max(axis=1))) if len(demand) else ():
        s = int(np.argmax(left @ (demand[i] * weights)))
        out[i] = s
        left[s] -= demand[i]
    return out


def placing(totals: list[float], capacity: list[list[float]], turn: bool, weights: tuple[float, ...]):
    """``capacity``: shares of every shard, of which the group of rows takes what it is of the whole."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("digest")
        demand = np.stack([np.asarray(group.column(c), np.float64) for c in ("bytes", "tokens", "rows")], axis=1) / np.array(totals)
        cap = np.array(capacity)
        if turn:
            # Equal shards are met in another order in every block, so that no shard is first everywhere.
            by = int(group.column("block")[0].as_py()) % len(cap)
            order = np.roll(np.arange(len(cap)), by)
            shard = order[place(demand, cap[order] * demand.sum(axis=0), weights)]
        else:
            shard = place(demand, cap, weights)
        return pa.Table.from_arrays([group.column("digest").cast(pa.binary()), pa.array(shard, pa.int32())], schema=PLACED)

    return run


def assign(groups: DataFrame, shards: int, block_groups: int = BLOCK_GROUPS, large: float = LARGE, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(digest, shard) for groups (digest, bytes, tokens, rows) of a table that is cheap to read again."""
    sums = groups.agg(F.count("*"), F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
    totals = [float(x or 1) or 1.0 for x in sums[1:]]
    share = F.greatest(*[F.col(c) / F.lit(t) for c, t in zip(("bytes", "tokens", "rows"), totals, strict=True)])
    marked = groups.withColumn("is_large", share > F.lit(large / shards))
    capacity = np.full((shards, 3), 1.0 / shards)
    # At most 3 * shards / large groups.
    big = staged(marked.where("is_large").groupBy(F.lit(0).alias("block")).applyInArrow(placing(totals, capacity.tolist(), False, weights), "digest binary, shard int"))
    loads = big.join(groups, "digest").groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")]).collect()  # a row for each shard
    for r in loads:
        capacity[r["shard"]] -= np.array(r[1:], float) / np.array(totals)
    capacity = np.maximum(capacity, 0)
    whole = capacity.sum(axis=0)
    rest = np.where(whole > 0, capacity / np.where(whole > 0, whole, 1), 1.0 / shards)
    blocks = max(1, -(-sums[0] // block_groups))
    small = marked.where("not is_large").withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))
    return big.unionByName(small.groupBy("block").applyInArrow(placing(totals, rest.tolist(), True, weights), "digest binary, shard int"))


def with_slots(rows: DataFrame, parts: int, shard: str = "shard", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``slot``: the row's number in its shard, from 0 without gaps, in the given order.

    Rows are dealt to ranges; in every range those of a shard are numbered apart, and behind what earlier ranges hold.
    """
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged)
    counts = ranged.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy(shard, "_part").orderBy(*order)
    numbered = ranged.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(before) if parts <= 10_000 else before, [shard, "_part"]).withColumn("slot", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", block_groups: int = BLOCK_GROUPS, large: float = LARGE, rows_a_part: int = 1 << 20) -> DataFrame:
    """(doc_id, digest, bytes, tokens, crc, shard, slot) of every row.

    Null and empty texts are one group; repeated rows are rows of one group; null ids have slots of their own, first in
    their shard. An empty table gives no rows.
    """
    rows = staged(sizes(docs, key, text))
    groups = staged(rows.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    placed = assign(groups, shards, block_groups, large)
    count = rows.count()
    return with_slots(rows.join(placed, "digest"), max(1, -(-count // rows_a_part)), order=("doc_id", "crc"))


def unsigned(crc: str = "crc") -> Column:
    return F.col(crc).cast("long")
