"""Queries of the operators, each over the whole of its table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import alignment, divergence, exact_dedup, filter_audit, language, licenses, lines, mixing, packing, records, sharding, simhash, topk
from hourgrid.llm.common import bounded_batches, table
from hourgrid.session import stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = lambda spark, sf_dir: build(bounded_batches(spark), sf_dir)
    return build


@query
def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = stage_path(spark, "records"), stage_path(spark, "index")
    records.write_records(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json", 2)
    found = records.with_start(records.write_index(spark, folder, index))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


@query
def op6_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1, checked=True)


@query
def op1_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op8_simhash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op9_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE["op1_stream_dedup"] = r"""
  WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
  SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
  FROM n WINDOW w AS (PARTITION BY norm)"""

ORACLE["op9_term_at_a_time"] = """
  WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM v),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM w q, w c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank", vec_id, score FROM s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


@query
def op10_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    exact = F.filter("matches", lambda m: m["exact_phrase"])
    joined = lambda m: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))))
    first = F.array_min(F.transform(exact, lambda m: m["word"]))
    last = F.array_max(F.transform(exact, lambda m: m["word"]))
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), joined(exact).alias("base_labels"), joined(F.col("matches")).alias("labels"), score.alias("score"), "matches")


@query
def op3_rake_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), bounded=False)  # as its SQL counterpart defines the rates
    return found.select("doc_id", "source", "lang", "topic", "tokens", F.round("rate", 6).alias("rate"), "chosen")


ORACLE["op3_rake_mix"] = f"""
  WITH mix_docs AS (SELECT * FROM documents), {mixing.oracle_ctes()}
  SELECT doc_id, source, lang, topic, tokens, round(rate, 6) AS rate, {mixing.oracle_draw()} < rate AS chosen FROM mix_rows JOIN mix_rates USING (source, lang, topic)"""


@query
def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_boilerplate(table(spark, sf_dir, "pages"), "page_id", lines.host(), lines.lines_of_html())
    return found.select("page_id", "host", F.array_join("lines", "\n").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


ORACLE["op5_site_lines"] = lines.ORACLE


@query
def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages")
    host = lines.host()
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3}(?:-[A-Za-z0-9-]*)?)", 1)
    rows = pages.select("page_id", F.array_join(lines.lines_of_html(), "\n").alias("text"), declared.alias("declared"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1).alias("domain"))
    found = language.identify(rows, model, ["page_id"])
    return found.select("page_id", "host", "declared", "suffix", "language", "probability", "text_language", (~language.rejected()).alias("accepted"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = filter_audit.failed(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.labelled(marked, table(spark, sf_dir, "labels")))


ORACLE["op12_filter_audit"] = filter_audit.ORACLE


@query
def op13_language_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = divergence.judge(docs, divergence.references(docs))
    distances = [F.round(c, 6).alias(c) for c in ("character_distance", "word_distance")]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *distances)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))[0]
