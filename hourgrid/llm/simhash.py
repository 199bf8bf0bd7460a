"""Near duplicates by SimHash: an inverted index over byte positions of fingerprints, with count filtering.

A fingerprint has 64 bits in 8 bytes. Two that differ in at most 3 bits differ in at most 3 bytes, so they share at
least 5 of the 8 positional bytes: that is the count which candidates must reach. Posting lists of single positional
bytes would bring together every 32nd pair of the corpus. The lists here are those of four positions at once, over the
14 sets of four positions whose numbers give 0 when combined by exclusive or: any 3 positions lie in one of these sets,
and the rest of a set is a set again, so any pair with at most 3 differing bytes shares a list. Within a list, shared
positional bytes are tallied for each pair, pairs with fewer than the guaranteed count go, the rest is verified by
counting differing bits. From a list come only the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import batch, text_or_empty
from hourgrid.llm.components import components
from hourgrid.session import staged

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Longest posting list met by one task at once; longer ones are cut into tiles, and each pair of tiles is a group.
TILE = 4096
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 14

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def position_sets() -> list[tuple[int, ...]]:
    return [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text: words at ASCII white space, A-Z lowered, repeats count."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in cuts], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        counts += np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def prints_of(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(t.as_buffer().to_pybytes(), shingle, seed) for t in b.column("text")]
            yield batch(PRINTS, doc_id=b.column("doc_id"), fp=np.array(values, np.uint64).view(np.int64))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long. Null texts count as empty and have fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(prints_of(shingle, seed), "doc_id long, fp long")


def forest(values: np.ndarray, radius: int) -> tuple[list[np.uint64], list[np.uint64]]:
    """Links of a spanning forest of the values that differ in at most so many bits."""
    a, b = [], []
    left = np.unique(values)
    least = 8 - radius
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            differ = left ^ x
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= least
            near[near] = np.bitwise_count(differ[near]) <= radius
            found = list(left[near])
            a += [x] * len(found)
            b += found
            todo += found
            left = left[~near]
    return a, b


def links_of(radius: int):
    def run(group: pa.Table) -> pa.Table:
        a, b = forest(np.asarray(group.column("fp")).view(np.uint64), radius)
        columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
        return pa.Table.from_arrays(columns, schema=LINKS)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp`` that connect all those with at most ``radius`` (0 to 3) differing bits.

    Lists are counted first, and a list of one needs no partner, so hardly any of the postings is moved twice. A list of
    more than ``tile`` is dealt to pairs of tiles: none of its pairs is lost, and no task meets more than two tiles.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the position sets are made for at most 3 differing bytes")
    masks = [sum(0xFF << (8 * p) for p in s) for s in position_sets()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for n, m in enumerate(signed)])
    postings = distinct.select("fp", F.explode(keys).alias("k")).select("k.list", "k.shared", "fp")
    sizes = postings.groupBy("list", "shared").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = postings.join(sizes, ["list", "shared"]).withColumn("tiles", tiles).withColumn("own", own)
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, F.col("own")) * F.col("tiles") + F.greatest(t, F.col("own")))
    return met.select("list", "shared", F.explode(cells).alias("cell"), "fp").groupBy("list", "shared", "cell").applyInArrow(links_of(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable by links of at most ``radius`` bits.

    Equal fingerprints are one node. Rows with a null ``doc_id`` take part, and get the smallest id of their component,
    null if it has none. Repeated rows stay repeated. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle, seed))
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = staged(placed)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
