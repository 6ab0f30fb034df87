"""Class bigrams of all words, and equal counts at the edge of the core."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from annolens.llm import class_lm

SMALL = "/root/testdata/sf0.001"


def test_equal_counts_fill_the_core(spark):
    text = " ".join(f"w{i}" for i in range(3500))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    counts = class_lm.word_counts(docs)
    words, n = class_lm.core_words(counts)
    assert len(words) in (3000, 3001) and class_lm.END in words and n.sum() == 7002
    assert class_lm.core_words(counts.repartition(7))[0] == words
    assert counts.where(class_lm.among(class_lm.frequent(counts, 1000))).count() == 1000
    assert counts.where(class_lm.among(class_lm.frequent(counts, 10**6))).count() == 3501
    assert counts.where(class_lm.among(class_lm.frequent(counts.limit(0), 5))).count() == 3501


def test_class_bigrams_equal_a_plain_count(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, None), (10**9, "")], docs.schema))
    model, lexicon = class_lm.classes_of_words(docs, core=40, head=60)
    rows = class_lm.classed(docs, model, lexicon)
    of = {bytes(r.word): r["class"] for r in lexicon.collect()} | {w: int(model.class_of[i]) for w, i in model.at.items()}
    wanted = Counter()
    for r in docs.collect():
        cls = [model.start, *(of[w] for w in class_lm.tokens(r.text))]
        wanted.update(zip(cls, cls[1:]))
    found = class_lm.class_bigrams(rows, model)
    assert {(a, b): int(found[a, b]) for a, b in zip(*np.nonzero(found))} == dict(wanted)
    assert found.sum() == model.total  # every token of the training documents


def test_learned_and_scored_at_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    training = F.col("doc_id") % 3 != 0
    model, out = class_lm.train_and_score(docs, training)
    apart, lexicon = class_lm.train(docs.where(training))
    assert np.array_equal(model.transition, apart.transition)
    one = {r.doc_id: (r.score, r.base_score, r.n_known) for r in out.collect()}
    two = {r.doc_id: (r.score, r.base_score, r.n_known) for r in class_lm.score(docs, apart, lexicon).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)
