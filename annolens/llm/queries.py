"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm import bpe_codec, class_lm, itq_dedup, line_runs, near_dedup, quality_rules, secret_scan, spelling_variants, suffix_match, token_count, varint_ids, warc_convert, whitening
from annolens.llm._common import cut, read_table, shared_dir


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "posterior")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_match.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        suffix_match.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"), "longest",
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.components(read_table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", near_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = shared_dir(spark), shared_dir(spark)
    warc_convert.write_arc(read_table(spark, sf_dir, "pages"), arc)
    warc_convert.write_warc(warc_convert.convert(warc_convert.read_arc(spark, arc, deflate=True)), warc, deflated=True)
    records = cut(warc_convert.read_warc(spark, warc).drop("payload"))
    return warc_convert.with_referred(records).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    varint_ids.write_ids(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return varint_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, scored = class_lm.train_and_score(docs, ~class_lm.is_held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", class_lm.is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_codec.encode_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(read_table(spark, sf_dir, "documents"))
    counts = [secret_scan.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.described(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.described(F.col("spans")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_frequent(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.components(read_table(spark, sf_dir, "embeddings"), 0.9)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, "embedding", 1024, 100_000), 8)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.runs(read_table(spark, sf_dir, "documents"), 7)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h, size = F.crc32(key.cast("binary")), F.length("run")
    at = F.pmod(F.col("h"), size).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    words = found.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, without).otherwise(F.col("run")).alias("word"))
    return spelling_variants.group(spelling_variants.vocabulary(words, 7, 2), 10)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_class_lm": op7_class_lm,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_whitening": op12_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

#: All pairs of vectors, and the smallest id that links reach.
ORACLE_SQL: dict[str, str] = {
    "op11_embedding_dedup": """WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, b FROM reached JOIN edges ON a = other),
least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
linked AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN linked ON a = e.vec_id""",
}
