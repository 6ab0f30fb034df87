"""The whole pipeline against plain versions of its stages, and its stages on odd tables."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from annolens.llm import quality_rules
from tests.llm import brute
from tests.llm.test_shingle_join import brute as near_classes

SMALL = "/root/testdata/sf0.001"


def test_run_is_what_plain_stages_leave(spark, tmp_path):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    extra = [(9000 + i, None if i == 0 else " " * i if i < 3 else rows[i][1]) for i in range(8)]
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame(extra, "doc_id long, text string")
    for name in set(table.columns) - {"doc_id", "text"}:
        more = more.selectExpr("*", f"cast(null AS {table.schema[name].dataType.simpleString()}) AS {name}")
    table.unionByName(more.select(*table.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = rows + extra
    # the verdicts of the fitted rules are the operator's; all that follows is plain
    judged = {r.doc_id: r.kept for r in quality_rules.score(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    docs = [(k, t) for k, t in docs if judged[k]]
    found = {}
    for _, t in docs:
        for key in {brute_key(x) for x in t.split("\n")} - {""}:
            found[key] = found.get(key, 0) + 1
    docs = [(k, "\n".join(x for x in t.split("\n") if not (brute_key(x) and found[brute_key(x)] >= 10))) for k, t in docs]
    classes, _ = near_classes(docs)
    docs = [(k, t) for k, t in docs if classes[k] == k]
    dirty = {r[0] for r in brute.contamination(docs, bench) if r[-1]}
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = sorted((k, len(ids := codec.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for k, t in docs if k not in dirty)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == wanted


def brute_key(line):
    ascii_lower = line.strip(" \t\n\x0b\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in ascii_lower)


PLAIN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the quiet river bank"


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(30_000))
    rows = [(1, PLAIN), (1, PLAIN), (2, PLAIN), (None, PLAIN), (3, None), (4, ""), (5, " \n "), (6, long), (None, None)]
    kinds = "doc_id long, text string, quality int, n_lines string, node string"
    docs = spark.createDataFrame([(i, t, 7, "x", None) for i, t in rows], kinds)
    out = stage(spark, docs, SMALL)
    kept = sorted((r.doc_id for r in out.collect()), key=repr)
    wanted = {
        0: [1, 1, 2, 6, None],
        1: [i for i, _ in rows],
        2: [1, 1, 3, 6, None, None],
        3: [i for i, _ in rows],
        4: [i for i, _ in rows],
    }[k]
    assert kept == sorted(wanted, key=repr)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert stage(spark, spark.createDataFrame([], kinds), SMALL).count() == 0
