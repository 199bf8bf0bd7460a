"""Language of texts by Bayesian fusion of evidence: the text, the declared markup language, the address suffix, the host.

The text's likelihood comes from byte trigrams, counted on a bounded sample of labelled rows. What a declaration or a
suffix says about the language, and which languages a host has, is counted over all rows: each row gives its text
posterior, summed by declaration, by suffix, by host and by domain. A host's shares are smoothed towards those of its
domain, these towards those of all rows; a row's own vote is taken out of its host's. One more class stands for text in
no language: all trigrams alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import batch, text_or_empty, unique_name
from hourgrid.session import staged

#: Buckets of trigrams, labelled rows of each language in the sample, and the fewest rows that make a model of a label.
BUCKETS, SAMPLE_ROWS, LEAST_ROWS = 1 << 16, 1000, 5
#: With more languages than this the model holds only the trigrams that a language has, and sums run over (value, class).
DENSE = 64
NONE = "und"
#: Trigrams overlap, so their log-likelihoods count for a third. Strength of the smoothing, in rows.
WEIGHT, STRENGTH = 1 / 3, 20.0
#: Prior share of texts in no language, and the part of declarations that say nothing.
NONE_SHARE, NOISE = 0.01, 0.05
#: Bytes scored at once.
AT_ONCE = 1 << 20

#: Byte classes: 0 for what is no letter, a-z (A-Z lowered) from 1, parts of other characters from 27.
CLASSES = bytes(b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 + (b & 63) if b >= 128 else 0 for b in range(256))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: BUCKETS rows of log-probabilities, a column for each language and the last one for none; None if there are many.
    table: np.ndarray | None
    #: Otherwise: the log-probability of a trigram that a class has not met, and by bucket where its entries begin, their
    #: classes and by how much these have it more likely.
    unmet: np.ndarray | None = None
    begins: np.ndarray | None = None
    holders: np.ndarray | None = None
    gains: np.ndarray | None = None

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, NONE)


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the trigrams of a text between blanks; bucket 0 is that of trigrams without a letter."""
    c = np.frombuffer(b"\0" + text.translate(CLASSES) + b"\0", np.uint8).astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.uint32)
    code = (c[:-2] * 92 + c[1:-1]) * 92 + c[2:]
    return np.where(code == 0, 0, ((code * np.uint32(2654435761)) >> np.uint32(16)) | np.uint32(1))


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    for b in batches:
        counts: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            t = trigrams(text.as_buffer().to_pybytes())
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            counts[lang] += np.bincount(t, minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield batch(schema, lang=[lang] * len(at), bucket=at.astype(np.int32), n=n[at])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS) -> Model | None:
    """Trigram model from about ``sample_rows`` rows of each language with ``least_rows`` rows, drawn by a hash of the key.

    Labels are two or three letters, in any case, with or without a region; rows without one take no part. None if no
    label has enough rows. The counts that come to the driver are the trigrams of the sample of each language.
    """
    label = F.lower(F.regexp_extract(F.coalesce(F.col(lang).cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    rows = labelled.select(F.col(key).cast("string").alias("key"), label.alias("lang"), text_or_empty(text).cast("binary").alias("text")).where(F.col("lang") != "")
    # Two or three letters make some 18,000 labels at most, so this table is broadcast.
    sizes = staged(rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows))
    names = tuple(sorted(r["lang"] for r in sizes.collect()))
    if not names:
        return None
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(sizes), "lang").where(part < F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n")))
    counts = drawn.select("lang", "text").mapInArrow(counting, "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = pa.array(names)
    column = pc.index_in(found.column("lang"), value_set=place).to_numpy()
    bucket, n = np.asarray(found.column("bucket")), np.asarray(found.column("n"))
    if len(names) > DENSE:
        return sparse(names, bucket, column, n)
    table = np.full((BUCKETS, len(names) + 1), 0.5)
    table[bucket, column] += n
    table[0] = 0
    table[:, -1] = 1
    table = np.log(np.maximum(table, 1e-300) / table.sum(axis=0))
    table[0] = 0
    return Model(names, (table * WEIGHT).astype(np.float32))


def sparse(names: tuple[str, ...], bucket: np.ndarray, column: np.ndarray, n: np.ndarray) -> Model:
    """The model of many languages: the same log-probabilities, stored for the trigrams that a language has."""
    some = bucket != 0
    bucket, column, n = bucket[some], column[some], n[some]
    order = np.argsort(bucket, kind="stable")
    sums_of = np.bincount(column, weights=n, minlength=len(names)) + 0.5 * BUCKETS
    unmet = np.append(np.log(0.5 / sums_of), -np.log(BUCKETS)) * WEIGHT
    begins = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    return Model(names, None, unmet, begins, column[order].astype(np.int32), (np.log1p(2.0 * n[order]) * WEIGHT).astype(np.float32))


def score_sparse(model: Model, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = len(model.classes)
    out, known = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        times = np.bincount(trigrams(text), minlength=BUCKETS)
        times[0] = 0
        met = np.flatnonzero(times)
        known[i] = times.sum()
        lengths = model.begins[met + 1] - model.begins[met]
        at = np.repeat(model.begins[met] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        out[i] = known[i] * model.unmet + np.bincount(model.holders[at], weights=np.repeat(times[met], lengths) * model.gains[at], minlength=n)
    return out, known


def score(model: Model, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log-likelihoods (texts by classes), and the trigrams with a letter of each text."""
    if model.table is None:
        return score_sparse(model, texts)
    out = np.zeros((len(texts), len(model.classes)))
    known = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        found = [trigrams(t) for t in texts[at:end]]
        if end - at == 1 and size > AT_ONCE:  # a long text, in parts
            for i in range(0, len(found[0]), AT_ONCE):
                out[at] += model.table[found[0][i : i + AT_ONCE]].sum(axis=0, dtype=np.float64)
            known[at] = np.count_nonzero(found[0])
        else:
            filled = [i for i, t in enumerate(found) if len(t)]
            if filled:
                joined = np.concatenate([found[i] for i in filled])
                starts = np.cumsum([0] + [len(found[i]) for i in filled])[:-1]
                rows = at + np.array(filled)
                out[rows] = np.add.reduceat(model.table[joined].astype(np.float64), starts)
                known[rows] = np.add.reduceat((joined != 0).astype(np.int64), starts)
        at = end
    return out, known


def scoring(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs, known = score(model, [t.as_buffer().to_pybytes() for t in b.column("text")])
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in b.schema.names if n != "text"} | {"logs": pa.array(list(logs), pa.list_(pa.float64())), "known": pa.array(known)})

    return run


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, and not again for each element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(logs: Column) -> Column:
    over = lambda raised: bound(total(raised), lambda s: F.transform(raised, lambda x: x / s))
    return bound(logs, lambda l: bound(F.array_max(l), lambda m: bound(F.transform(l, lambda x: F.exp(x - m)), over)))


def sums(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Summed posteriors by some columns, and the rows behind them."""
    if n > DENSE + 1:
        each = rows.select(*by, F.posexplode("posterior").alias("at", "vote")).groupBy(*by, "at").agg(F.sum("vote").alias("vote"), F.count("*").alias("rows"))
        per = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "vote"))).alias("votes"), F.max("rows").alias("rows"))
        return per.select(*by, F.transform("votes", lambda x: x["vote"]).alias("sums"), "rows")
    per = rows.groupBy(*by).agg(*[F.sum(F.col("posterior")[i]).alias(f"s{i}") for i in range(n)], F.count("*").alias("rows"))
    return per.select(*by, F.array(*[f"s{i}" for i in range(n)]).alias("sums"), "rows")


def identify(rows: DataFrame, model: Model, extra: Sequence[str] = ()) -> DataFrame:
    """Language of rows (text, declared, suffix, host, domain): those but the text, ``extra``, and language, probability,
    text_language, known (trigrams with a letter).

    A declared language that the model does not have is kept where no fitted one explains the text better than none does
    (the probability is then that of none). Null evidence says nothing, a null host is the host ''. A text without a letter has no language (``und``). Repeated
    rows are rows of their own; an empty table gives no rows.
    """
    n = len(model.classes)
    names = F.array(*[F.lit(x) for x in model.classes])
    code = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    known = F.when(code.isin(*model.languages), code).otherwise(F.when(code == "", "").otherwise("other"))
    label = unique_name(rows, "_label")
    evidence = rows.select(*extra, known.alias("declared"), F.when(known == "other", code).otherwise("").alias(label), *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("suffix", "host", "domain")], text_or_empty().cast("binary").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in evidence.schema if f.name != "text")
    scored = evidence.mapInArrow(scoring(model), f"{kinds}, logs array<double>, known long")
    # Before anything is counted, languages are alike but for the class of none.
    start = [math.log((1 - NONE_SHARE) / (n - 1))] * (n - 1) + [math.log(NONE_SHARE)]
    flat = F.array(*[F.lit(x) for x in start])
    # A text without letters gives no vote.
    votes = F.when(F.col("known") > 0, softmax(F.zip_with("logs", flat, lambda a, b: a + b))).otherwise(F.transform(flat, lambda x: F.lit(0.0)))
    scored = staged(scored.withColumn("posterior", votes))

    whole = sums(scored, [], n).first()  # one row
    counted = [x or 0.0 for x in whole["sums"]] or [0.0] * n
    overall = [(c + STRENGTH * math.exp(p)) / (sum(counted) + STRENGTH) for c, p in zip(counted, start, strict=True)]

    def smoothed(votes: Column, towards: Column) -> Column:
        return bound(total(votes), lambda of_all: F.zip_with(votes, towards, lambda a, b: (a + F.lit(STRENGTH) * b) / (of_all + F.lit(STRENGTH))))

    base = F.array(*[F.lit(x) for x in overall])
    domains = sums(scored, ["domain"], n).select("domain", smoothed(F.col("sums"), base).alias("domain_share"))
    hosts = staged(sums(scored, ["host", "domain"], n).join(domains, "domain").select("host", "domain", F.col("sums").alias("host_sums"), "domain_share"))

    def says(column: str) -> DataFrame:
        """Log of how much more often a class has a value than all classes have it, with some noise for either."""
        per = sums(scored, [column], n)
        # Smoothed like a host without a domain: the shares of classes among rows with the value.
        share = smoothed(F.col("sums"), base)
        ratio = F.zip_with(share, base, lambda a, b: F.log(F.lit(NOISE) + F.lit(1 - NOISE) * a / b))
        silent = F.transform(ratio, lambda x: F.lit(0.0))
        return staged(per.select(column, F.when(F.col(column) == "", silent).otherwise(ratio).alias(f"{column}_says")))

    # Written tables have known sizes: below the session's bound they are broadcast, else hot keys are split.
    met = scored.join(hosts, ["host", "domain"]).join(says("declared"), "declared").join(says("suffix"), "suffix")
    others = F.zip_with("host_sums", "posterior", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = F.transform(smoothed(others, F.col("domain_share")), lambda x: F.log(x))
    fused = F.zip_with(F.zip_with(F.zip_with("logs", prior, lambda a, b: a + b), F.col("declared_says"), lambda a, b: a + b), F.col("suffix_says"), lambda a, b: a + b)
    out = met.withColumn("fused", softmax(fused))
    place = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    none = F.col("known") == 0
    best = place(F.col("fused"))
    best = F.when((best == NONE) & (F.col(label) != ""), F.col(label)).otherwise(best)
    return out.select(
        *extra, "declared", "suffix", "host", "domain", "known",
        F.when(none, NONE).otherwise(best).alias("language"),
        F.when(none, 1.0).otherwise(F.array_max("fused")).alias("probability"),
        F.when(none, NONE).otherwise(place(F.col("logs"))).alias("text_language"),
    )


def rejected(column: str = "language") -> Column:
    return F.col(column) == NONE
