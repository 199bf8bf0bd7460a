"""Groups of texts whose word shingles have a Jaccard similarity of at least 0.8: SimHash and a wider positional byte index.

Two texts at that similarity differ in about ten of 64 SimHash bits, and an index that finds ten bits brings together a
corpus with its square. So SimHash links (``simhash.links``, at most 3 bits) give the light edits, and a second signature
gives the rest: 64 positions, each the low byte of the least of a text's shingle hashes under a function of its own. Two
texts agree at a position with the probability of their similarity. It is used like the fingerprint: lists of five
positional bytes bring candidates together, shared positional bytes are tallied, pairs below ``LEAST_SHARED`` go, and the
rest is verified on the whole sets of shingles. A pair at 0.8 shares a list with probability 0.99.

From a list come the links to two of its texts only, so lists of thousands of copies make no pairs of their own.

What that leaves out is found exactly. Of two sets at the similarity, the first elements (a fifth and one more at 0.8) in
any one order of all shingles share an element. Texts that are not in one group yet meet in a list for each such element;
pairs go whose sizes, places of the element or bitmaps rule the similarity out, the rest is verified.

The order is by how common a shingle is, rare ones first. A text that differs too much from the many copies of another
has its own shingles first then, and reaches theirs at a place where no similarity is left: a group of copies makes no
pairs with its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm import simhash
from hourgrid.llm.common import batch, text_or_empty
from hourgrid.llm.components import components
from hourgrid.session import staged

SHINGLE, SIMILARITY = 5, 0.8
POSITIONS, LIST = 64, 5
#: A pair at the similarity shares 51 positions, give or take 3; five times that below.
LEAST_SHARED = 36
#: Text looked at together.
AT_ONCE = 2 << 20
#: The sample that shows which shingles are common is one text in so many, of small corpora so many texts; the least count
#: of a common one there and among all texts with a candidate. The sample grows with the corpus, so that lists do not.
#: Common shingles come last in the order of shingles, which bears on the length of lists, not on the result.
SAMPLE_EVERY, SAMPLE, COMMON, COMMON_NEAR = 4, 20_000, 3, 8
#: Slots of the table of common shingles: so many for each, and bits of their number at least and at most.
SLOTS, LEAST_BITS, MOST_BITS, SLOT_SHIFT = 16, 16, 24, 20
#: Bytes of a set's bitmap, and pairs handed on at once.
BITMAP, PAIRS = 128, 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in turn, and how many each has; fewer words than ``width`` are one shingle.

    Words are those between ASCII white space, A-Z lowered. A shingle's hash is made of its words' hashes in order.
    """
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    text = np.asarray(pc.list_parent_indices(pieces))
    coded = pieces.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    filled = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))
    code = np.asarray(coded.indices)
    if len(code):
        some = filled[code]
        code, text = code[some], text[some]
    words = np.bincount(text, minlength=len(texts)) if len(code) else np.zeros(len(texts), np.int64)
    own = hashes[code] if len(code) else np.zeros(0, np.uint64)
    counts = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    starts = np.cumsum(words) - words
    first = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    behind = np.repeat(starts + words, counts)
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        there = first + k < behind
        out = out * MULTIPLIER + np.where(there, own[np.minimum(first + k, len(own) - 1)], np.uint64(k)) if len(own) else out
    return mixed(out), counts


def parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.cumsum(np.asarray(pc.binary_length(column)))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield at, column.slice(at, end - at)
        at = end
        pa.default_memory_pool().release_unused()


SIGNED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.binary()), ("signature", pa.binary()), ("fp", pa.int64())])


def nodes_of(texts: pa.Array) -> list[bytes]:
    return [hashlib.md5(b" ".join(t.as_buffer().to_pybytes().lower().split())).digest() for t in texts]


def signing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in parts(b.column("text").cast(pa.large_string())):
                n = len(texts)
                nodes = nodes_of(texts)
                hashes, counts = shingles(texts, width)
                filled = np.flatnonzero(counts)
                signature = np.zeros((n, POSITIONS), np.uint8)
                bits = np.zeros((n, 64), bool)
                if len(filled):
                    starts = (np.cumsum(counts) - counts)[filled]
                    for i, seed in enumerate(SEEDS):
                        signature[filled, i] = (np.minimum.reduceat((hashes ^ (hashes >> np.uint64(29))) * seed, starts) >> np.uint64(13)).astype(np.uint8)
                    for i in range(64):
                        ones = np.add.reduceat(((hashes >> np.uint64(63 - i)) & np.uint64(1)).astype(np.int64), starts)
                        bits[filled, i] = 2 * ones > counts[filled]
                fp = np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64) if n else np.zeros(0, np.int64)
                own = b.slice(at, n)
                yield batch(SIGNED, doc_id=own.column("doc_id"), mark=own.column("mark"), node=nodes, signature=[s.tobytes() for s in signature], fp=fp)

    return run


def set_of(width: int):
    schema = pa.schema([("node", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in parts(b.column("text").cast(pa.large_string())):
                hashes, counts = shingles(texts, width)
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield batch(schema, node=b.column("node").slice(at, len(texts)), hashes=sets)

    return run


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all sets, a row each."""
    for b in batches:
        h = np.frombuffer(b"".join(b.column("hashes").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])


def least_shared(a, b, similarity: float):
    """How many elements two sets of these sizes share at the similarity."""
    return np.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)


def ordered_sets(width: int, similarity: float | None, common: np.ndarray):
    """Of each text of a task: node, size of its set, bitmap (parities of the elements at a bit), and its first elements in the order of shingles.

    The order is by ``common`` (see ``common_shingles``), then by hash. Without a similarity these are all elements.
    """
    schema = pa.schema([("node", pa.binary()), ("size", pa.int32()), ("bits", pa.binary()), ("head", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for at, texts in parts(b.column("text").cast(pa.large_string())):
                hashes, counts = shingles(texts, width)
                ends = np.cumsum(counts)
                rows = []
                for node, e, c in zip(nodes_of(texts), ends.tolist(), counts.tolist(), strict=True):
                    if not c or node in seen:
                        continue
                    seen.add(node)
                    own = np.unique(hashes[e - c : e])
                    n = len(own)
                    bits = np.packbits((np.bincount((own >> np.uint64(7)).astype(np.int64) % (8 * BITMAP), minlength=8 * BITMAP) & 1).astype(bool))
                    if similarity is not None:
                        level = common[(own >> np.uint64(SLOT_SHIFT)) & np.uint64(len(common) - 1)]
                        own = own[np.argsort(level, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]
                    rows.append((node, n, bits.tobytes(), own.view(np.int64)))
                if rows:
                    nodes, sizes, maps, heads = zip(*rows, strict=True)
                    yield batch(schema, node=nodes, size=sizes, bits=maps, head=heads)

    return run


PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def pairs_of_lists(similarity: float):
    """Pairs of a task's rows (h, size, place, node, root), ordered by h and size, that have h in common and may be at the similarity.

    All lists go on together: each row is met with the next one, then the one behind it, as long as that is in its list
    and not too large. A list that goes on in the next batch waits for it.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, size, place = (np.asarray(t.column(c)) for c in ("h", "size", "place"))
        root = np.asarray(t.column("root").combine_chunks().dictionary_encode().indices) if len(t) else h
        node = t.column("node").combine_chunks()
        active, d = np.arange(len(t)), 0
        while len(active):
            d += 1
            active = active[active + d < len(t)]
            other = active + d
            on = (h[active] == h[other]) & (size[active] >= similarity * size[other] - 1e-9)
            active, other = active[on], other[on]
            most = np.minimum(size[active] - place[active], size[other] - place[other])
            good = (root[active] != root[other]) & (most >= least_shared(size[active], size[other], similarity))
            x, y = active[good], other[good]
            for i in range(0, len(x), PAIRS):
                a, b = (node.take(pa.array(v[i : i + PAIRS])) for v in (x, y))
                yield pa.RecordBatch.from_arrays([a.cast(pa.binary()), b.cast(pa.binary())], schema=PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            h = np.asarray(t.column("h"))
            cut = int(np.searchsorted(h, h[-1], side="left")) if len(h) else 0
            yield from pairs(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None:
            yield from pairs(left)

    return run


def may_match(similarity: float):
    """Elements of one set only flip a bit each, so bitmaps differ in no more bits than there are such elements."""

    def run(a: pa.Array, b: pa.Array, m: pa.Array, n: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITMAP // 8) for c in (a, b))
        both = np.asarray(m).astype(np.int64) + np.asarray(n)
        return pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= both - 2 * least_shared(np.asarray(m).astype(np.int64), np.asarray(n), similarity))

    return run


def shared_positions(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many positional bytes two signatures share."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in (a, b))
    return pa.array((x == y).sum(axis=1), pa.int32())


def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        both = len(np.intersect1d(p, q, assume_unique=True))
        out.append(both / max(1, len(p) + len(q) - both))
    return pa.array(out, pa.float64())


def mark(text: str = "text", key: str = "doc_id") -> Column:
    """Tells rows of different texts or ids apart."""
    return F.xxhash64(F.col(key).cast("long"), text_or_empty(text))


def stars(nodes: DataFrame, key: Column) -> DataFrame:
    """Links of the nodes with one key to two of them: that with the smallest id, and one drawn by the key.

    Copies of one text are near it rather than near each other. The smallest id is most likely that of the text itself;
    the drawn node is another in each list, and a pair shares several lists.
    """
    keyed = nodes.select(key.alias("key"), "node", F.struct("first", "node").alias("by_id"), F.struct(F.xxhash64(key, "node").alias("drawn"), "node").alias("by_draw"))
    least = keyed.groupBy("key").agg(F.min("by_id")["node"].alias("one"), F.min("by_draw")["node"].alias("other"), F.count("*").alias("n")).where("n > 1")
    met = keyed.select("key", "node").join(least, "key")
    return met.select(F.col("node").alias("a"), F.explode(F.array("one", "other")).alias("b")).where("a <> b")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that a list of positional bytes or a SimHash link brings together."""
    lists = F.transform(F.sequence(F.lit(0), F.lit(POSITIONS // LIST - 1)), lambda i: F.xxhash64(i, F.col("signature").substr(i * LIST + 1, F.lit(LIST))))
    wide = stars(nodes.select("node", "first", F.explode(lists).alias("list")), F.col("list"))
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    close = simhash.links(prints.select("fp"))
    named = close.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return wide.union(stars(nodes, F.col("fp"))).union(named.select("x", "y")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def sets_of(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The sets of shingles of the nodes in pairs (a, b)."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "first"), "node")
    wanted = staged(wanted.select("node", F.col("first")["mark"].alias("of_mark"), F.col("first")["doc_id"].alias("of_doc")))
    texts = rows.join(wanted, (rows["mark"] == wanted["of_mark"]) & rows["doc_id"].eqNullSafe(wanted["of_doc"])).select("node", "text")
    return staged(texts.mapInArrow(set_of(shingle), "node binary, hashes binary").dropDuplicates(["node"]))


def similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity."""
    a, b = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"of_{n}")) for n in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where(F.arrow_udf(jaccard, "double")("of_a", "of_b") >= similarity).select("a", "b")


ORDERED = "node binary, size int, bits binary, head array<bigint>"


def common_shingles(rows: DataFrame, sets: DataFrame, shingle: int, n_rows: int) -> np.ndarray:
    """How common the shingles of a slot are: the power of two in the count of its most common one, 0 if none is common.

    Texts with many copies have a candidate, so ``sets`` shows their shingles whatever the size of the corpus; the sample
    shows passages that many texts share. The table is bounded; in a full one rare shingles share slots of common ones.
    """
    every = min(SAMPLE_EVERY, -(-max(n_rows, 1) // SAMPLE))
    sample = rows.where(F.pmod("mark", F.lit(every)) == 0).mapInArrow(ordered_sets(shingle, None, np.zeros(1, np.uint8)), ORDERED).select(F.explode("head").alias("h"))
    often = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("h", (F.col("n") * every).alias("n"))
    near = sets.mapInArrow(elements, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_NEAR)
    both = staged(often.union(near))
    slots = 1 << min(MOST_BITS, max(LEAST_BITS, (SLOTS * both.count()).bit_length()))
    slot = F.shiftrightunsigned("h", SLOT_SHIFT).bitwiseAND(F.lit(slots - 1)).cast("int")
    levels = both.groupBy(slot.alias("slot")).agg(F.max(F.floor(F.log2("n"))).cast("byte").alias("level")).toArrow()
    table = np.zeros(slots, np.uint8)
    table[np.asarray(levels.column("slot"))] = np.asarray(levels.column("level"))
    return table


def left_out(rows: DataFrame, roots: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """Pairs of nodes apart that may have the similarity; every pair of two groups that has it is among them."""
    # Lists hold most of what is moved: a row has a short number for its text and 64 bits for its group.
    heads = staged(rows.mapInArrow(ordered_sets(shingle, similarity, common), ORDERED).withColumn("number", F.unhex(F.hex(F.monotonically_increasing_id()))))
    grouped = heads.join(staged(roots), "node", "left").select(F.col("number").alias("node"), F.xxhash64(F.coalesce("root", "node")).alias("root"), "size", "head")
    lists = grouped.select("node", "root", "size", F.posexplode("head").alias("place", "h")).repartition("h").sortWithinPartitions("h", "size", "node")
    pairs = lists.mapInArrow(pairs_of_lists(similarity), "a binary, b binary").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    a, b = (heads.select(F.col("number").alias(n), F.col("node").alias(f"node_{n}"), F.col("bits").alias(f"of_{n}"), F.col("size").alias(f"size_{n}")) for n in ("a", "b"))
    near = pairs.join(a, "a").join(b, "b").where(F.arrow_udf(may_match(similarity), "boolean")("of_a", "of_b", "size_a", "size_b"))
    return staged(near.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct())


def repeats(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark) of the rows that go, so that one row of each group stays: that with the smallest id.

    A group is held together by links of texts with at least ``similarity``, or equal but for white space and A-Z. Null
    texts are empty; empty texts are one group. Null ids come last. Rows with one id and different texts are told apart
    (``mark``); rows that repeat both id and text stay or go together. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), mark(text, key).alias("mark"), text_or_empty(text).alias("text"))
    signed = staged(rows.mapInArrow(signing(shingle), "doc_id long, mark long, node binary, signature binary, fp long"))
    own = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "mark"))
    nodes = staged(signed.groupBy("node").agg(own.alias("first"), F.any_value("signature").alias("signature"), F.any_value("fp").alias("fp"), F.count("*").alias("rows")))
    pairs = candidates(nodes)
    a, b = (nodes.select(F.col("node").alias(n), F.col("signature").alias(f"of_{n}")) for n in ("a", "b"))
    tallied = pairs.join(a, "a").join(b, "b").where(F.arrow_udf(shared_positions, "int")("of_a", "of_b") >= LEAST_SHARED)
    tallied = staged(tallied.select("a", "b"))
    sets = sets_of(rows, nodes, tallied, shingle)
    links = staged(similar(sets, tallied, similarity))
    more = left_out(rows, components(links), shingle, similarity, common_shingles(rows, sets, shingle, signed.count()))
    links = links.union(similar(sets_of(rows, nodes, more, shingle), more, similarity))
    roots = components(staged(links))
    grouped = nodes.join(roots, "node", "left").select("node", "first", "rows", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    best = grouped.where("linked").groupBy("root").agg(F.min("first").alias("best"))
    several = grouped.join(best, "root", "left").where("linked or rows > 1").select("node", F.coalesce("best", "first").alias("best"))
    # A written table: below the session's bound it is broadcast, else rows of a hot text are split.
    met = signed.select("doc_id", "mark", "node").join(staged(several), "node")
    return met.where(F.col("mark") != F.col("best")["mark"]).select("doc_id", "mark").distinct()
