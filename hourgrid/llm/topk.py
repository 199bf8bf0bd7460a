"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks.

Vectors are turned into whole numbers. A term is a dimension, its posting list the vectors of a block with a weight that
is not 0 there. For each query of a block, each of its terms scatters its weighted postings into a dense array of scores,
one for each vector of the other block; a partition selection takes the best, and the best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.session import staged

#: Queries and candidates that meet in one task: the array of scores has their product in cells.
QUERY_BLOCK, ROW_BLOCK = 256, 8192

FOUND = pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")])


def whole_numbers(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: str = "embedding") -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def dense(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of at most ``width`` numbers as a matrix, filled with zeros behind the end of a row."""
    column = lists.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; among equal ones the smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def accumulate(k: int):
    def run(group: pa.Table) -> pa.Table:
        is_query = np.asarray(group.column("is_query").combine_chunks().cast(pa.uint8())).astype(bool)
        queries, rows = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        if not len(queries) or not len(rows):
            return FOUND.empty_table()
        # Rows in order of ids: results do not depend on the order they arrive in.
        rows = rows.sort_by("vec_id")
        width = max(int(np.diff(np.asarray(x.column("weights").combine_chunks().offsets)).max()) for x in (queries, rows))
        ids = np.asarray(rows.column("vec_id"))
        columns = dense(rows.column("weights"), width).T
        postings = [(at := np.flatnonzero(c), c[at]) for c in columns]
        full = [len(at) == len(ids) for at, _ in postings]
        scores = np.zeros(len(ids), np.int64)
        out = []
        for query_id, terms in zip(queries.column("vec_id").to_pylist(), dense(queries.column("weights"), width), strict=True):
            scores[:] = 0
            for t in np.flatnonzero(terms):
                at, weights = postings[t]
                if full[t]:
                    scores += terms[t] * weights
                else:
                    scores[at] += terms[t] * weights
            other = ids != query_id
            own, found = ids[other], scores[other]
            for i in best(own, found, k):
                out.append((query_id, own[i], found[i]))
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], schema=FOUND)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best among all rows with another id.

    Vectors that are null or hold a null or non-finite component take no part, neither do rows without an id; shorter
    vectors count as filled with zeros. Ties go to the smaller id. Of repeated rows each takes part: each repeat of a
    row that is no query can be found, a repeated query is asked once. Blocks are drawn from ids, so that a block of
    queries meets a block of rows in one task of bounded size.
    """
    fine = vectors.where(usable(vector) & F.col(id_col).isNotNull())
    rows = staged(fine.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("weights"), F.coalesce(is_query, F.lit(False)).alias("is_query")))
    counts = rows.agg(F.count("*"), F.count_if("is_query")).first()
    n_rows, n_queries = max(1, -(-counts[0] // row_block)), max(1, -(-counts[1] // query_block))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("is_query").dropDuplicates(["vec_id"]).select(block(n_queries, 1).alias("qb"), every(n_rows).alias("rb"), "vec_id", "weights", F.lit(True).alias("is_query"))
    # Repeats would fall into one block by their id: they are dealt by the whole row.
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_rows)).cast("int")
    met = rows.select(dealt.alias("rb"), "vec_id", "weights").select(every(n_queries).alias("qb"), "rb", "vec_id", "weights", F.lit(False).alias("is_query"))
    found = asked.unionByName(met).groupBy("qb", "rb").applyInArrow(accumulate(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
