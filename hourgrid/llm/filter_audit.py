"""Interaction of filters, by the potential of the removal game (Hart and Mas-Colell).

For a set of filters S, v(S) is the number of documents that fail one of them. The potential of a set follows from those of
its subsets with one filter less: |S| P(S) = v(S) + sum of P(S without i) over i in S, with P(no filter) = 0. A filter's
Shapley value is P(all) - P(all without it), and what it removes at a step of any order is the difference of v of the
coalitions before and after it. The corpus is only counted by sets of failed filters, at most 32 numbers a part.

Potentials are kept as whole numbers, |S|! P(S), so sums over all orders are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import batch, text_or_empty
from hourgrid.session import staged

#: The filters that look at a text alone, in the order of their bits; the last letter is that of repeated texts.
ALONE, REPEATED = "ABCD", "E"
UPPER = bytes(range(0x41, 0x5B))
SYMBOLS = b"#$%&*|"
#: Bytes of a character behind its first.
FOLLOWING = bytes(range(0x80, 0xC0))

FAILS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("digest", pa.binary())])


def fails_alone(text: bytes) -> int:
    """Bits of the conditions that a text meets: few words (1), few different words (2), capitals (4), symbols (8)."""
    words = text.split()
    characters = len(text.translate(None, FOLLOWING))
    capitals = len(text) - len(text.translate(None, UPPER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * characters) << 2 | (symbols > 0) << 3


def failing(judge: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fails, digests = [], []
            for t in b.column("text"):
                text = t.as_buffer().to_pybytes()
                fails.append(judge(text))
                digests.append(hashlib.sha256(text).digest())
            yield batch(FAILS, doc_id=b.column("doc_id"), part=b.column("part"), fails=fails, digest=digests)

    return run


def failed(docs: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, fails) of every row: bits of the filters it fails, bit 16 for a text that a smaller id has too.

    Null texts are empty, a null part is the part ''. Rows without an id are never the smaller ones, nor do they fail for
    being repeated; rows that repeat an id and a text do not fail for one another. Only digests that occur more than
    once are joined back; the rows of a hot one are split where the table is too large to broadcast.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).cast("binary").alias("text"))
    marked = staged(rows.mapInArrow(failing(fails_alone), "doc_id long, part string, fails int, digest binary"))  # texts are read once
    firsts = staged(marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"))
    repeated = F.when(F.col("doc_id") > F.col("least"), 1 << len(ALONE)).otherwise(0)
    return marked.join(firsts, "digest", "left").select("doc_id", "part", (F.col("fails") + repeated).alias("fails"))


def audit(marked: DataFrame, letters: str = ALONE + REPEATED) -> DataFrame:
    """Each step of each order of the filters, by part: what it keeps and removes, and each filter's Shapley value.

    ``marked`` has part, fails (bits of failed filters, the first letter the lowest), good and toxic. A row for each part,
    order and step, zeros included: kept, removed, redundant (fails the filter, removed before), unique_fails (fails no
    other), good_lost, toxic_lost and ``shapley``, the removals of the filter summed over all orders. No part, no rows.
    """
    n = len(letters)
    every = (1 << n) - 1
    counted = marked.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # At most 32 entries a part.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    removed = "transform(sequence(0, {every}), s -> aggregate(cells, 0L, (t, c) -> t + if((c.fails & s) <> 0, c.{what}, 0L)))"
    games = parts.select("part", F.expr("aggregate(cells, 0L, (t, c) -> t + c.n)").alias("whole"), *[F.expr(removed.format(every=every, what=w)).alias(f"v_{w}") for w in ("n", "good", "toxic")])
    # Sets come in the order of their numbers, so those with one filter less are there already.
    potential = f"""aggregate(sequence(1, {every}), array(0L), (p, s) -> concat(p, array(factorial(bit_count(s) - 1) * v_n[s]
      + aggregate(filter(sequence(0, {n - 1}), i -> (s & shiftleft(1, i)) <> 0), 0L, (t, i) -> t + p[s - shiftleft(1, i)]))))"""
    games = games.withColumn("potential", F.expr(potential))
    orders = F.lit(",".join("".join(p) for p in permutations(letters)))
    steps = games.select("*", F.explode(F.split(orders, ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1)"
    before = f"aggregate(filter(sequence(1, {n}), i -> i < step), 0, (s, i) -> s | shiftleft(1, instr('{letters}', substring(filter_order, i, 1)) - 1))"
    steps = steps.withColumns({"bit": F.expr(bit), "before": F.expr(before)})
    lost = lambda v: F.expr(f"{v}[before | bit] - {v}[before]")
    return steps.select(
        "part", "filter_order", "step",
        F.expr("whole - v_n[before | bit]").alias("kept"),
        lost("v_n").alias("removed"),
        F.expr("v_n[bit] - (v_n[before | bit] - v_n[before])").alias("redundant"),
        F.expr(f"v_n[{every}] - v_n[{every} - bit]").alias("unique_fails"),
        lost("v_good").alias("good_lost"),
        lost("v_toxic").alias("toxic_lost"),
        F.expr(f"potential[{every}] - {n} * potential[{every} - bit]").alias("shapley"),
    )


def labelled(marked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds good and toxic: whether a label row of the id says so. Ids without labels, and null ones, are neither."""
    says = labels.groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return marked.join(says, marked["doc_id"] == says["_key"], "left").select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


ORACLE = r"""
  WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
  w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
      + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
  c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
  f AS (SELECT chr(65 + i::INTEGER) AS x, (1 << i)::INTEGER AS bit FROM range(5) t(i)),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
  s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS gone FROM o, range(1, 6) t(step)),
  t AS (SELECT filter_order, step, bit, coalesce(gone, 0)::INTEGER AS gone FROM s),
  r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (gone | bit) = 0) AS kept, sum(n) FILTER (fails & gone = 0 AND fails & bit <> 0) AS removed,
      sum(n) FILTER (fails & gone <> 0 AND fails & bit <> 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
      sum(good) FILTER (fails & gone = 0 AND fails & bit <> 0) AS good_lost, sum(toxic) FILTER (fails & gone = 0 AND fails & bit <> 0) AS toxic_lost FROM c, t GROUP BY ALL)
  SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
