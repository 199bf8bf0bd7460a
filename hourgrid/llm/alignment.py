"""Alignment of the tokens of two tokenizers over the bytes of a text, and how often ids meet in the corpus.

Tokens of either side lie one behind the other over the same bytes. For each token start ``pandas.merge_asof``, keyed by
document, finds the token of the other side that covers it; both directions together are all overlaps of tokens. An
overlap whose tokens end together closes a group, and every token of one side is linked with every one of the other side
of its group.

For each pair of ids the documents that hold it linked are counted over the corpus. A task gathers documents into blocks
and counts the different pairs of a block first, so a pair met by a third of all documents moves once a block. Counts
come back by pair, then by block, where each document's links are summed by their place in the block's list of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from hourgrid.llm.common import batch, kept, text_or_empty
from hourgrid.llm.tokens import WordEncoder, encoder, piece_encoder, public_path
from hourgrid.session import staged

#: Text of a block of documents, and the part of it that is aligned at once; a longer text is a block of its own.
BLOCK_BYTES, PART_BYTES = 8 << 20, 2 << 20
#: Tokens of one side joined at once: long texts are cut where tokens of both sides begin.
JOINED = 300_000
#: Links of one side's ids by the other's within a group that are counted id by id first.
LARGE_GROUP = 4096
#: A pair of ids in one number: the first side's id times this plus the second's.
SIDE = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 ones stand for themselves, the other bytes for those from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_level(e: WordEncoder) -> list[bytes]:
    alphabet = byte_alphabet()
    out = [b""] * len(e.bytes_of)
    for entry, i in e.tokenizer.get_vocab().items():
        out[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    return out


def piece_level(e) -> list[bytes]:
    out = []
    for i in range(e.pieces.get_piece_size()):
        piece = e.pieces.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if e.pieces.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Side:
    """Tokens of one tokenizer: ids, and the bytes and the printed form of each id."""

    def __init__(self, store, spelled: list[bytes]):
        self.store = store
        self.spelled = pa.array(spelled, pa.large_binary())
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        numbers = [str(i).encode() for i in range(len(spelled))]
        self.count = len(numbers)
        #: Printed ids with what stands behind: a comma, or the end of a group (a bar or a semicolon), or nothing.
        self.printed = {mark: pa.array([x + mark for x in numbers], pa.large_binary()) for mark in (b",", b"|", b";", b"")}

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs, counts = [np.zeros(0, np.int64)], []
        for _, ids, starts in self.store.encoded(texts):
            runs.append(ids.astype(np.int64))
            counts.append(np.diff(starts))
        return np.concatenate(runs), np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)


def sides(first: str, second: str) -> tuple[Side, Side]:
    """The byte-level vocabulary and the pieces, as a worker keeps them."""
    a, b = encoder(public_path(first)), piece_encoder(public_path(second))
    return kept(("side", first), lambda: Side(a, byte_level(a))), kept(("side", second), lambda: Side(b, piece_level(b)))


def buffer_of(column: pa.Array) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def matching(side: Side, ids: np.ndarray, counts: np.ndarray, spaced: pa.Array) -> np.ndarray:
    """Whether the joined bytes of each text's tokens are those of the text."""
    want = np.asarray(pc.binary_length(spaced)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    got = np.diff(np.concatenate(([0], np.cumsum(side.sizes[ids])))[ends])
    have, right = buffer_of(side.spelled.take(pa.array(ids))), buffer_of(spaced)
    same = got == want
    if same.all() and np.array_equal(have, right):
        return same
    at, to = np.concatenate(([0], np.cumsum(got))), np.concatenate(([0], np.cumsum(want)))
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(have[at[i] : at[i + 1]], right[to[i] : to[i + 1]])
    return same


def covering(tokens: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Each token with the token of the other side that covers its start."""
    return pd.merge_asof(tokens, others, on="at", by="doc")


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all tokens that overlap, in order: the union of what both directions find."""
    left = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    right = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    one, two = covering(left, right), covering(right, left)
    # A pair that begins together is found from both sides. Overlaps run along the text: places only rise.
    key = np.concatenate((one["a"].to_numpy() + one["b"].to_numpy(), two["a"].to_numpy() + two["b"].to_numpy()))
    a, b = (np.concatenate((one[c].to_numpy(), two[c].to_numpy())) for c in ("a", "b"))
    _, first = np.unique(key, return_index=True)
    return a[first], b[first]


def groups_of(doc_a, start_a, end_a, doc_b, start_b, end_b) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of either side, numbered along the texts, and how many there are."""
    group_a, group_b = np.zeros(len(start_a), np.int64), np.zeros(len(start_b), np.int64)
    at_a = at_b = groups = 0
    while at_a < len(start_a):
        stop_a, stop_b = len(start_a), len(start_b)
        cut = at_a + JOINED
        while cut < len(start_a):
            place = int(np.searchsorted(start_b, start_a[cut]))
            if place < len(start_b) and start_b[place] == start_a[cut]:
                stop_a, stop_b = cut, place
                break
            cut += 1
        own, other = slice(at_a, stop_a), slice(at_b, stop_b)
        a, b = overlaps(doc_a[own], start_a[own], doc_b[other], start_b[other])
        closes = end_a[own][a] == end_b[other][b]
        number = groups + np.cumsum(closes) - closes
        group_a[at_a + a], group_b[at_b + b] = number, number
        groups += int(closes.sum())
        at_a, at_b = stop_a, stop_b
    return group_a, group_b, groups


def run_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups with so many members on either side: places of all pairs, as places in the two lists of members."""
    times = left * right
    of = np.repeat(np.arange(len(left)), times)
    within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    wide = right[of]
    return (np.cumsum(left) - left)[of] + within // wide, (np.cumsum(right) - right)[of] + within % wide


def links(ids_a, group_a, ids_b, group_b, doc_of_group, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, pair, times) of the different pairs of ids linked in each document, document by document."""
    left, right = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    large = left * right > LARGE_GROUP
    small_a, small_b = ~large[group_a] if groups else group_a, ~large[group_b] if groups else group_b
    a, b = run_pairs(np.where(large, 0, left), np.where(large, 0, right))
    pair = ids_a[small_a][a] * SIDE + ids_b[small_b][b]
    doc = np.repeat(doc_of_group, np.where(large, 0, left * right))
    times = np.ones(len(pair), np.int64)
    if large.any():  # counted id by id, so that repeats make no pairs
        pairs, docs, counts = [pair], [doc], [times]
        end_a, end_b = np.cumsum(left), np.cumsum(right)
        for g in np.flatnonzero(large):
            ua, na = np.unique(ids_a[end_a[g] - left[g] : end_a[g]], return_counts=True)
            ub, nb = np.unique(ids_b[end_b[g] - right[g] : end_b[g]], return_counts=True)
            pairs.append((ua[:, None] * SIDE + ub).ravel())
            counts.append((na[:, None] * nb).ravel())
            docs.append(np.full(len(ua) * len(ub), doc_of_group[g]))
        pair, doc, times = np.concatenate(pairs), np.concatenate(docs), np.concatenate(counts)
    # Ordered by document and pair: pairs by their number among the different ones, so that one sort does.
    coded = pa.array(pair).dictionary_encode()
    different = np.asarray(coded.dictionary)
    key = doc * len(different) + np.asarray(coded.indices)
    if (times == 1).all():
        key, times = np.unique(key, return_counts=True)
    else:
        key, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, times).astype(np.int64)
    return key // max(1, len(different)), different[key % max(1, len(different))], times


def printed(a: Side, ids_a, group_a, b: Side, ids_b, group_b, groups: int, last_of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all texts as bytes, and the bytes up to each group's end."""
    left, right = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    # A group's first side stands before its second one.
    place_a = np.arange(len(ids_a)) + (np.cumsum(right) - right)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(left)[group_b]
    ends_a = np.zeros(len(ids_a), bool)
    ends_a[np.cumsum(left) - 1] = True
    ends_b = np.zeros(len(ids_b), np.int64)
    ends_b[np.cumsum(right) - 1] = np.where(last_of_doc, 2, 1)
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[place_a] = ids_a + a.count * ends_a
    code[place_b] = 2 * a.count + ids_b + b.count * ends_b
    spelled = kept(("printed", a.count, b.count), lambda: pa.concat_arrays([a.printed[b","], a.printed[b"|"], b.printed[b","], b.printed[b";"], b.printed[b""]]))
    taken = spelled.take(pa.array(code))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    return buffer_of(taken), ends[np.cumsum(left + right)] if groups else np.zeros(0, np.int64)


def align(a: Side, b: Side, texts: pa.Array):
    """For texts: per text n_a, n_b, n_groups, n_links, digest of the groups; and the texts' linked pairs (doc, pair, times)."""
    n = len(texts)
    filled = np.asarray(pc.greater(pc.binary_length(texts), 0)).astype(bool)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    ids_a, n_a = a.tokens(spaced)
    ids_b, n_b = b.tokens(texts)
    fits = filled & matching(a, ids_a, n_a, spaced) & matching(b, ids_b, n_b, spaced)
    if not fits.all():  # texts without tokens
        ids_a, ids_b = ids_a[np.repeat(fits, n_a)], ids_b[np.repeat(fits, n_b)]
        n_a, n_b = np.where(fits, n_a, 0), np.where(fits, n_b, 0)
    end_a, end_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    group_a, group_b, groups = groups_of(doc_a, end_a - a.sizes[ids_a], end_a, doc_b, end_b - b.sizes[ids_b], end_b)
    left, right = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    doc_of_group = doc_a[np.cumsum(left) - 1] if groups else np.zeros(0, np.int64)
    n_groups = np.bincount(doc_of_group, minlength=n)
    n_links = np.bincount(doc_of_group, left * right, minlength=n).astype(np.int64) if groups else np.zeros(n, np.int64)
    digests = [""] * n
    if groups:
        last = np.append(doc_of_group[1:] != doc_of_group[:-1], True)
        data, ends = printed(a, ids_a, group_a, b, ids_b, group_b, groups, last)
        at = 0
        for doc, end in zip(doc_of_group[last].tolist(), ends[last].tolist(), strict=True):
            digests[doc] = hashlib.sha256(data[at:end]).hexdigest()
            at = end
    return (n_a, n_b, n_groups, n_links, digests), links(ids_a, group_a, ids_b, group_b, doc_of_group, groups)


BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("docs", pa.binary())]
)
BLOCKS_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs binary, docs binary"


def aligning(first: str, second: str, block_bytes: int, part_bytes: int):
    """A row for each document, and after those of a block one with the block's pairs and how many of its documents hold each.

    ``places``: numbers of a document's pairs in the block's list; ``times``: how often each is linked, 4 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(first, second)
        block = (TaskContext.get().partitionId() << 32) - 1
        rows, doc, pair, times, size = [], [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows, doc, pair, times, size, block
            block += 1
            coded = pa.array(np.concatenate(pair)).dictionary_encode()
            places, different = np.asarray(coded.indices).astype("<u4"), np.asarray(coded.dictionary)
            docs = np.bincount(places, minlength=len(different)).astype("<u4")
            counts = np.bincount(np.concatenate(doc), minlength=len(rows))
            ends = (np.cumsum(counts) * 4).tolist()
            place_bytes, time_bytes = places.tobytes(), np.concatenate(times).astype("<u4").tobytes()
            step = max(1, len(rows) // 8)
            for i in range(0, len(rows), step):
                own = [(block, *r, place_bytes[e - 4 * c : e], time_bytes[e - 4 * c : e], None, None) for r, e, c in zip(rows[i : i + step], ends[i : i + step], counts[i : i + step].tolist(), strict=True)]
                yield batch(BLOCKS, **dict(zip(BLOCKS.names, zip(*own, strict=True), strict=True)))
            last = (block, *[None] * 8, different.astype("<u8").tobytes(), docs.tobytes())
            yield batch(BLOCKS, **{n: [v] for n, v in zip(BLOCKS.names, last, strict=True)})
            rows, doc, pair, times, size = [], [], [], [], 0
            pa.default_memory_pool().release_unused()

        for got in batches:
            texts = got.column("text").cast(pa.large_string())
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + part_bytes, side="right")))
                own, found = align(a, b, texts.slice(at, end - at))
                columns = [x.tolist() if isinstance(x, np.ndarray) else x for x in own]
                doc.append(found[0] + len(rows))
                pair.append(found[1])
                times.append(found[2])
                rows += zip(got.column("doc_id").slice(at, end - at).to_pylist(), *columns, strict=True)
                size += int(sizes[at:end].sum())
                at = end
                if size >= block_bytes:
                    yield from out()
        if rows:
            yield from out()

    return run


def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, pair, docs) of each pair of each block."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])
    for b in batches:
        for block, pairs, docs in zip(b.column("block"), b.column("pairs"), b.column("docs"), strict=True):
            p = np.frombuffer(pairs.as_buffer(), "<u8").astype(np.int64)
            d = np.frombuffer(docs.as_buffer(), "<u4").astype(np.int64)
            for i in range(0, len(p), 1 << 16):
                part = slice(i, i + (1 << 16))
                n = len(p[part])
                yield batch(schema, block=np.full(n, block.as_py()), place=np.arange(i, i + n, dtype=np.int32), pair=p[part], docs=d[part])


SUMMED = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])
SUMMED_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summing(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links; ``counts``: the block's pairs."""
    place = np.asarray(counts.column("place"))
    number, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    number[place], best[place] = np.asarray(counts.column("number")), np.asarray(counts.column("best").cast(pa.int64()))
    n_best, count_sum = [], []
    for places, times in zip(docs.column("places"), docs.column("times"), strict=True):
        at, n = np.frombuffer(places.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
        n_best.append(int(best[at] @ n))
        count_sum.append(int(number[at] @ n))
    names = [n for n in SUMMED.names if n not in ("n_best", "count_sum")]
    columns = {n: docs.column(n) for n in names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.Table.from_arrays([columns[n] for n in SUMMED.names], schema=SUMMED)


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, number, best) over all documents: how many hold the pair linked, and whether no pair of its first id has more."""
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("number"))
    first = F.shiftright("pair", 32).cast("int")
    counts = staged(counts.withColumn("id_a", first))
    most = counts.groupBy("id_a").agg(F.max("number").alias("most"))  # a row for each id of the vocabulary
    return counts.join(most, "id_a").select("pair", "number", (F.col("number") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the counts of all pairs of ids.

    Null and empty texts have no tokens, nor have texts that a side does not give back byte for byte: their numbers are 0
    and their digest is ''. Rows with one id or a null id are documents of their own. Empty tables give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    found = staged(rows.mapInArrow(aligning(first, second, block_bytes, part_bytes), BLOCKS_SQL))
    listed = found.where(F.col("pairs").isNotNull()).select("block", "pairs", "docs").mapInArrow(listing, "block long, place int, pair long, docs long")
    numbers = staged(pair_counts(listed))
    # A pair is there once for each block, so no pair is hot; a block's pairs are bounded by its text.
    placed = listed.join(numbers, "pair").select("block", "place", "number", "best")
    documents = found.where(F.col("pairs").isNull()).drop("pairs", "docs")
    summed = documents.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(summing, SUMMED_SQL)
    pairs = numbers.select(F.shiftright("pair", 32).cast("int").alias("id_a"), F.col("pair").bitwiseAND(F.lit(SIDE - 1)).cast("int").alias("id_b"), F.col("number").alias("documents"), "best")
    return summed, pairs
