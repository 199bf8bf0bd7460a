"""The corpus pipeline: documents in, packed sequences out.

Every stage but the last returns documents with the columns it got; its result is written and read again for the next.
Rows that go are few, so a stage writes those and joins documents against them: a small table is broadcast by its
written size, and documents are not moved then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import exact_dedup, language, mixing, near_texts, packing
from hourgrid.llm.common import bounded_batches, unique_name
from hourgrid.session import stage_path, staged


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay; ``lang`` counts as declared, ``source`` as host. Without any label all stay.

    A null or empty text has no language and goes; null labels and sources say nothing. Rows that repeat text, label and
    source go or stay together. An empty table stays empty.
    """
    model = language.fit(docs)
    if model is None:
        return docs
    mark = F.xxhash64("text", "lang", "source")
    nothing = F.lit("")
    rows = docs.select("text", F.col("lang").alias("declared"), nothing.alias("suffix"), F.col("source").alias("host"), nothing.alias("domain"), F.col("doc_id").alias("id_of_row"), mark.alias("mark_of_row"))
    gone = staged(language.identify(rows, model, ["id_of_row", "mark_of_row"]).where(language.rejected()).select("id_of_row", "mark_of_row").distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id_of_row"]) & (mark == gone["mark_of_row"]), "left_anti")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays.

    Null texts are empty; null ids come last; of rows that repeat the id and the text the first by file and row stays. An
    empty table stays empty.
    """
    source = stage_path(spark, "arrivals")
    docs.write.parquet(source)
    gone = exact_dedup.deduplicate(spark, source).where(~F.col("kept"))
    gone = staged(gone.select(F.col("file").alias("file_of_row"), F.col("row").alias("row_of_row")))
    content = spark.read.schema(docs.schema).parquet(source)
    file, row = unique_name(docs, "_file"), unique_name(docs, "_row")
    placed = content.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return placed.join(gone, (placed[file] == gone["file_of_row"]) & (placed[row] == gone["row_of_row"]), "left_anti").select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Null texts are empty, and empty texts are one group; null ids come last. Of two texts with one id each goes or stays
    by itself; rows that repeat id and text go or stay together. An empty table stays empty.
    """
    gone = staged(near_texts.repeats(docs).select(F.col("doc_id").alias("id_of_row"), F.col("mark").alias("mark_of_row")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id_of_row"]) & (near_texts.mark() == gone["mark_of_row"]), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target shares of tokens.

    Null sources and languages are the value ''; rows with one id, repeated or null, are drawn alike. An empty table stays empty.
    """
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, see ``packing.pack``.

    A null text has only the end id; repeated rows are packed one by one, null ids are passed on. An empty table gives no rows.
    """
    return packing.pack(docs, "word_bpe_49k.json", 1, checked=True)


def bounded(stage):
    return lambda spark, docs, sf_dir: stage(bounded_batches(spark), docs, sf_dir)


STAGES = [(name, bounded(stage)) for name, stage in (("language", identified), ("exact_dedup", deduplicated), ("near_dedup", distinct_texts), ("mix", mixed), ("pack", packed))]
#: Trigram scores, fingerprints and token ids are not for SQL; tests compare with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
