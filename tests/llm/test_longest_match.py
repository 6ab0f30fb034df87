"""The longest match of decontamination, with items that share windows."""

import random

from annolens.llm import suffix_match


def brute(text, items, window):
    w, best = text.split(), 0
    for item in (x.split() for x in items):
        for p in range(len(w)):
            for q in range(len(item)):
                n = 0
                while p + n < len(w) and q + n < len(item) and w[p + n] == item[q + n]:
                    n += 1
                best = max(best, n if n >= min(window, len(item)) else 0)
    return best


def test_longest_of_items_that_share_windows(spark):
    rng = random.Random(11)
    w = [f"w{i}" for i in range(60)]
    texts, items = [" ".join(w)], [" ".join(w[:13]), " ".join(w[1:] + ["end"])]
    items += [" ".join(rng.choice("ab") for _ in range(rng.randint(14, 40))) for _ in range(4)]
    texts += [" ".join(rng.choice("ab") for _ in range(400)) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (13, 5):
        out = {r.doc_id: r.longest for r in suffix_match.matches(docs, bench, window=window).collect()}
        assert out == {i: brute(t, items, window) for i, t in enumerate(texts)}
        assert out[0] == 59


def test_repeated_words_and_copies_of_an_item(spark):
    import time

    rng = random.Random(2)
    words = [f"v{rng.randrange(5000)}" for _ in range(200)]
    items = ["echo " * 2000, *[" ".join(words)] * 1000]
    texts = ["echo " * 8000, *[" ".join(["start", *words, "end"])] * 300]
    test = suffix_match.TestSuffixes(list(enumerate(items)), 13)
    began = time.perf_counter()
    ids = [0]
    for t in texts:
        ids += [test.vocabulary.get(w, 0) for w in t.encode().split()] + [0]
    import numpy as np

    ids = np.array(ids, np.int32)
    position, which = test.search(ids)
    longest = test.longest(ids, position, which)
    assert time.perf_counter() - began < 5
    assert longest[position == 1] == 2000 and longest.max() == 2000
    assert sorted(longest[position > 8001])[-300:] == [200] * 300
