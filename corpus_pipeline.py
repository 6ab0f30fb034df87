"""A corpus pipeline of five stages, each one operator of ``annolens.llm`` on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs.

Cases: a null, empty or short text fails the quality rules and goes in the first stage; what reaches
a later one all the same is a text of no words there: it keeps its one empty line, is a near copy of
other blank texts, is not contaminated and has no ids. Rows are decided one by one, so repeated rows
share their fate until the near-duplicate stage, where rows that share the kept id stay together and
rows without an id stay. Columns beyond doc_id and text pass through up to the last stage; an empty
table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm import bpe_codec, line_runs, near_dedup, quality_rules, suffix_match
from annolens.llm._common import cut, prepare, read_table, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision of quality rules rejects go."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from every document; n_chars, where there is one, follows the text."""
    prepare(spark)
    kept = line_runs.drop_frequent(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word similarity of at least 0.8) stays."""
    prepare(spark)
    return near_dedup.keep_one(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return suffix_match.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    prepare(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_codec.encode_decode(docs.select("doc_id", "text"), ranks, pattern)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", bpe),
]

#: Suffix arrays, near-duplicate classes and byte-pair merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        docs, done = cut(stage(spark, docs, sf_dir), path, codec="snappy"), before
        if done:
            remove(spark, done)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
