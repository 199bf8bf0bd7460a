"""Packing of token ids into windows by multiway differencing (Karmarkar and Karp).

Each task packs the documents it reads, so nothing is shuffled. Whole windows of a long document go out as they are.
What is left of each document is cut into pieces of at most ``piece`` ids (some documents into far smaller ones);
pieces are gathered until they fill ``block`` windows, and these are parted into as many near-equal sets: partial partitions, each a list of k sums, are merged two at
a time, the ones with the largest imbalances first, the largest sums of one upon the smallest of the other. Where the
fullest set exceeds a window, the number of windows rises and the block is parted anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from hourgrid.llm.common import batch, text_or_empty
from hourgrid.llm.tokens import encoder, public_path

WINDOW = 2048
#: Longest piece of a document's rest; windows gathered before they are parted.
PIECE, BLOCK = 512, 512
#: The rest of one document in so many is cut finely: differencing needs small items to end with to come out level.
FINE_EVERY, FINE = 16, 32

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The set, from 0 to k - 1, of each item, such that the sums of the sets are near equal."""
    n = len(sizes)
    if k <= 1 or not n:
        return np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    singles, at = sizes[order], 0
    # A partial partition: k sums in falling order, and for each the tree of its items (-1: no item).
    heap: list[tuple] = []
    left, right, trees = [], [], n  # of the trees from number n on
    made = 0

    def single(i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Items met while a partition has empty sets take one each, which is what merging them one by one gives."""
        sums, tree = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[:width], tree[:width] = singles[i : i + width], order[i : i + width]
        return sums, tree

    def push(sums: np.ndarray, tree: np.ndarray) -> None:
        nonlocal made
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), made, sums, tree))
        made += 1

    def next_largest() -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        while at < n and (not heap or singles[at] >= -heap[0][0]):
            width = min(k, n - at)
            push(*single(at, width))
            at += width
        return heapq.heappop(heap)[2:]

    while True:
        a, ta = next_largest()
        if at >= n and not heap:
            break
        b, tb = (x[::-1] for x in next_largest())
        both = (ta >= 0) & (tb >= 0)
        count = int(both.sum())
        tree = np.where(ta >= 0, ta, tb)
        left.append(ta[both])
        right.append(tb[both])
        tree[both] = np.arange(trees, trees + count)
        trees += count
        sums = a + b
        down = np.argsort(-sums, kind="stable")
        push(sums[down], tree[down])
    of_tree = np.full(trees, -1, np.int64)
    of_tree[ta[ta >= 0]] = np.flatnonzero(ta >= 0)
    for x, y in zip(reversed(left), reversed(right), strict=True):  # later trees hold earlier ones
        trees -= len(x)
        of_tree[x] = of_tree[y] = of_tree[trees : trees + len(x)]
    return of_tree[:n]


def windows_of(sizes: np.ndarray, window: int) -> np.ndarray:
    """The set of each item: as many near-equal sets as keep within a window."""
    total = int(sizes.sum())
    k = -(-total // window)
    while True:
        part = differencing(sizes, k)
        over = float(np.bincount(part, sizes, minlength=1).max()) - window
        if over <= 0:
            return part
        # As many more as bring the mean down by what the fullest set exceeds it.
        k = max(k + 1, min(k + k // 8, -(-total // max(1, int(total / k - over)))))


def packed(tokenizer: str, end_id: int, window: int, piece: int, block: int, fine_every: int, fine: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(public_path(tokenizer))
        end = np.array([end_id], enc.dtype)
        sequence = TaskContext.get().partitionId() << 33
        whole: list[tuple] = []
        rest: list[tuple] = []
        gathered = seen = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return batch(PIECES, **dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)))

        def part() -> list[tuple]:
            nonlocal sequence
            sets = windows_of(np.array([r[2] for r in rest]), window)
            rows, at = [], dict.fromkeys(sets.tolist(), 0)
            number = {s: sequence + n for n, s in enumerate(at)}
            sequence += len(at)
            for r, s in zip(rest, sets.tolist(), strict=True):
                rows.append((*r, number[s], at[s]))
                at[s] += r[2]
            rest.clear()
            return rows

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text")), strict=True):
                ids = np.concatenate((ids, end))
                n = len(ids)
                for at in range(0, n - n % window, window):
                    whole.append((doc, at, window, ids[at : at + window].tobytes(), n, sequence, 0))
                    sequence += 1
                at, left = n - n % window, n % window
                seen += 1
                cuts = -(-left // (min(fine, piece) if seen % fine_every == 0 else piece))
                for c in range(cuts):  # of like length
                    stop = n - left + left * (c + 1) // cuts
                    rest.append((doc, at, stop - at, ids[at:stop].tobytes(), n))
                    at = stop
                gathered += left
                if gathered >= block * window:
                    yield out(part())
                    gathered = 0
                if len(whole) >= block:
                    yield out(whole)
                    whole.clear()
        if rest:
            yield out(part())
        if whole:
            yield out(whole)

    return pack


def crc(ids: pa.Array, width: int = 2) -> pa.Array:
    return pa.array([zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4").tobytes()) for x in ids], pa.int64())


CHECKED_SQL = PIECES_SQL.replace("ids binary", "ids_crc32 long")
CHECKED = pa.schema([pa.field("ids_crc32", pa.int64()) if f.name == "ids" else f for f in PIECES])


def with_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of packed pieces with the checksum in the place of the ids, see ``checksums``."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([crc(b.column(n)) if n == "ids" else b.column(n) for n in PIECES.names], schema=CHECKED)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK, fine_every: int = FINE_EVERY, fine: int = FINE, checked: bool = False) -> DataFrame:
    """Pieces of all documents with their ids (little-endian, 2 bytes each where the vocabulary allows) and their place.

    A null text counts as empty, so every row has at least the end id; repeated rows are packed one by one; a null
    ``doc_id`` is passed on. An empty table gives no rows. Sequences are numbered apart in every task, from 0 in the
    first, with gaps between tasks; offsets in a sequence have no gaps. ``checked``: checksums of the ids instead of the
    ids, made from them where they are, so that no ids are moved.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = packed(tokenizer, end_id, window, piece, block, fine_every, fine)
    return rows.mapInArrow(lambda batches: with_checksums(pieces(batches)), CHECKED_SQL) if checked else rows.mapInArrow(pieces, PIECES_SQL)


def checksums(ids_column: str = "ids", width: int = 2):
    """Unsigned crc32 of packed ids, each widened to 4 little-endian bytes."""

    def of(ids: pa.Array) -> pa.Array:
        return crc(ids, width)

    return F.arrow_udf(of, "long")(ids_column)
