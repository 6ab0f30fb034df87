"""The near-duplicate stage against all pairs' five-word Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from annolens.llm import shingle_join


def planted():
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    passage = " ".join(word() for _ in range(12))
    texts = [None, "", " ", "one", "One ", "two words"]
    for i in range(60):
        w = [word() for _ in range(r.randrange(60, 400))]
        texts.append(" ".join(w) + " " + passage)  # a passage that every text quotes
        for edits in (1, 2, 3, 4, 6, 8):
            v = list(w)
            for _ in range(edits):  # a changed sentence of three words
                at = r.randrange(len(v) - 3)
                v[at : at + 3] = [word() for _ in range(3)]
            texts.append(" ".join(v) + " " + passage)
    base = [word() for _ in range(300)]
    for i in range(150):  # more near copies than a cell holds, some too far from one another
        v = list(base)
        for _ in range(r.randrange(1, 9)):
            v[r.randrange(300)] = word()
        texts.append(" ".join(v))
    return [(i, t) for i, t in enumerate(texts)]


def brute(docs):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, up = {k: grams(t) for k, t in docs}, {k: k for k, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    found = 0
    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
                    found += 0 < both < len(sets[a] | sets[b])
    return {k: root(k) for k in sets}, found


@pytest.fixture(scope="module")
def docs():
    return planted()


@pytest.mark.parametrize("cell_rows", [64, 3])
def test_every_pair_of_four_fifths_is_linked(spark, docs, monkeypatch, cell_rows):
    monkeypatch.setattr(shingle_join, "CELL_ROWS", cell_rows)
    wanted, pairs = brute(docs)
    assert pairs > 300
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in shingle_join.components(df).collect()} == wanted


def test_stage_keeps_one_of_each_class(spark, docs):
    wanted, _ = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == set(wanted.values())
