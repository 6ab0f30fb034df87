"""Spelling variants against a plain version, with odd words."""

import random
import re
from collections import Counter
from zlib import crc32

from annolens.llm import queries as q
from annolens.llm import spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def grouped(count, ratio=10):
    out, form = [], {}
    by_size = {}
    for w in count:
        by_size.setdefault(len(w), []).append(w)
    for w, n in count.items():
        others = [o for k in (-1, 0, 1) for o in by_size.get(len(w) + k, []) if near(w, o)]
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best and count[best] >= ratio * n else None
        out.append((w, form[w], n, len(others), count[best] if form[w] else None))
    rows = []
    for w, f, *rest in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, f, root, *rest))
    return sorted(rows, key=repr)


def counted(docs):
    count = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_query_equals_all_pairs(spark, tmp_path):
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [None, "", "Größenordnung größenordnung Grössenordnung GRÖSSENORDNUNG " * 20, "aaaaaaaa aaaaaaaaa aaaaaaab baaaaaaa " * 5, "abababab babababa abababa ababababa " * 3, "×÷×÷×÷×÷ ×÷×÷×÷× " * 4, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000 + " " + "x" * 4999, "letters7letters letters_letters"]
    more = pd.DataFrame({"doc_id": [None, *range(10**6, 10**6 + len(odd) - 1)], "text": odd, "lang": None, "source": None, "n_chars": 0})
    rows = pd.concat([docs.astype({"doc_id": "Int64"}), more.astype({"doc_id": "Int64"}), docs[:3].astype({"doc_id": "Int64"})], ignore_index=True)
    rows.to_parquet(tmp_path / "documents.parquet")
    pairs = [(None if pd.isna(k) else int(k), t) for k, t in zip(rows.doc_id, rows.text)]
    out = q.op13_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == grouped(counted(pairs))


def test_words_of_few_letters_and_chains(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 11))): rng.choice([2, 3, 25, 300, 4000]) for _ in range(900)}
    words |= {"chainsx": 2, "chains": 20, "chain": 200, "chainé": 2000}
    out = spelling_variants.group(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got(out) == grouped(words)
    assert {r.word: r.root for r in out.collect()}["chainsx"] == "chainé"


def test_no_words(spark):
    assert spelling_variants.group(spark.createDataFrame([], "word string, n long")).count() == 0
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y")], "doc_id long, text string, word string")
    assert spelling_variants.runs(docs).count() == 0
