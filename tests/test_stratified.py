"""The stratified split on planted images, one class in one kind and one kind that is hot."""

import random
from collections import Counter

import pytest

from annolens.operators import datasets


def planted():
    r = random.Random(3)
    images = {i: {9: 1} for i in range(1000)}  # a class in one kind only
    images |= {1000 + i: {1: 2} for i in range(2000)}  # a hot kind
    images |= {3000 + i: dict(Counter(r.choices((1, 2, 3, 4), (60, 25, 10, 5), k=r.randrange(1, 9)))) for i in range(600)}
    images |= {3600 + i: {} for i in range(100)}
    return images


def plain(images, ratio, classes, targets):
    """One image at a time, without the hash shards; images of a kind are interchangeable."""
    kinds = Counter(tuple(sorted(v.items())) for v in images.values() if v)
    n_blank = sum(not v for v in images.values())
    have, took = Counter(), Counter()
    for _ in range(round(len(images) * ratio) - round(n_blank * ratio)):
        def score(kind):
            v = dict(kind)
            loss = sum(((have[c] + v.get(c, 0) - targets[c]) / max(targets[c], 1)) ** 2 for c in classes)
            return loss - 0.02 * sum(min(v.get(c, 0), max(targets[c] - have[c], 0)) / max(targets[c], 1) for c in classes)

        best = min((k for k in kinds if took[k] < kinds[k]), key=score)
        took[best] += 1
        have.update(dict(best))
    return have


@pytest.mark.parametrize("shard_kinds", [2000, 20])
def test_class_shares(spark, monkeypatch, shard_kinds):
    monkeypatch.setattr(datasets, "SHARD_KINDS", shard_kinds)
    images = planted()
    rows = [(i, c) for i, v in images.items() for c, n in v.items() for _ in range(n)]
    labels = spark.createDataFrame(rows, "image_id long, cls int")
    out = datasets.stratified_split(labels, spark.createDataFrame([(i,) for i in images], "image_id long"), 0.2, least={4: 60}).collect()
    assert sorted(r.image_id for r in out) == sorted(images)
    val = [r.image_id for r in out if r.split == "val"]
    assert len(val) == round(len(images) * 0.2) and sum(not images[i] for i in val) == 20
    total, have = Counter(c for _, c in rows), Counter()
    for i in val:
        have.update(images[i])
    targets = {c: max(round(n * 0.2), 60 if c == 4 else 0) for c, n in total.items()}
    wanted = plain(images, 0.2, sorted(total), targets)
    for c in total:
        off = abs(wanted[c] - targets[c])
        assert abs(have[c] - targets[c]) <= off + 0.1 * targets[c], (c, have[c], wanted[c], targets[c])


def test_impossible_target(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "image_id long, cls int")
    with pytest.raises(ValueError, match="above the total"):
        datasets.stratified_split(labels, labels.select("image_id"), 0.5, least={0: 3})
