"""Nulls, empty tables, repeated rows, clashing columns, and the parts that a query does not show."""

import base64
import os
import random
import re
import string
import struct

import numpy as np
import public_tokenizers as P
import pytest

from annolens.llm import bpe_codec, class_lm, line_runs, near_dedup, quality_rules, secret_scan, suffix_match, token_count, varint_ids, warc_convert
from annolens.llm._common import shared_dir

PLAIN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak"
CLASH = "doc_id long, text string, n_words long, quality string, votes int, kept string, ids string, decoded string, fp string, component_id string, n_lines string, n_dropped string, spans string, base string, row string, score string"
ROWS = [(1, PLAIN), (1, PLAIN), (None, PLAIN), (2, None), (None, None), (3, ""), (4, "short")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 7, *["x" if i != 1 else 1 for i in range(13)]) for k, t in ROWS], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(9, "seven wise owls watch"), (None, PLAIN), (8, None)], "item_id long, text string")


def keys(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=repr)


def test_quality(docs, none):
    assert keys(quality_rules.score(docs)) == sorted((k for k, _ in ROWS), key=repr)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert all(r.text == PLAIN and r.kept == "x" for r in kept.collect())
    assert quality_rules.score(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_quality_votes_against_all_must_pass():
    votes = [((1, 1, 1), 800), ((-1, -1, 0), 150), ((-1, 1, 1), 50)]
    model = quality_rules.fit(votes, 3)
    odds = [model.log_odds(v) for v, _ in votes]
    assert odds[0] > 0 > odds[1] and model.rounds >= 2


def test_token_counts(docs, none):
    path = P.path("piece_bpe_32k.model")
    out = token_count.token_counts(docs, path)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == len(ROWS)
    assert token_count.token_counts(none, path).count() == 0


def test_decontamination(docs, none, bench, spark):
    out = {(r.doc_id, r.n_hit): r for r in suffix_match.matches(docs, bench).collect()}
    assert out[1, 18]["items"] == [9] and out[1, 18].longest == 18  # all are words of the item without an id
    assert [(s["from"], s["to"]) for s in out[1, 18].spans] == [(0, 18)]
    (own, *_) = suffix_match.matches(docs.where("text IS NOT NULL AND doc_id = 1"), bench.where("item_id = 9")).collect()
    assert (own.n_hit, own.longest, [(s["from"], s["to"]) for s in own.spans]) == (4, 4, [(10, 14)])
    left = suffix_match.decontaminate(docs, bench)
    assert left.columns == docs.columns and keys(left) == sorted([2, None, 3, 4], key=repr)
    assert suffix_match.matches(none, bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert suffix_match.decontaminate(docs, nothing).count() == len(ROWS)


def test_suffix_search_on_few_words():
    rng = random.Random(5)
    for _ in range(20):
        text = [rng.choice("ab") for _ in range(60)]
        items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(6)]
        t = suffix_match.TestSuffixes(items, 5)
        ids = np.array([t.vocabulary.get(w.encode(), 0) for w in text], np.int32)
        position, which = t.search(ids)
        found = {(int(p), t.keys[w]) for p, w in zip(position, which)}
        assert found == {(p, k) for k in t.keys for p in range(61 - len(k)) if tuple(ids[p : p + len(k)].tolist()) == k}


def test_near_dedup(docs, none):
    out = sorted(((r.doc_id, r.component_id) for r in near_dedup.components(docs).collect()), key=repr)
    assert out == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (None, 2), (3, 2), (4, 4)], key=repr)
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns and keys(left) == sorted([1, 1, None, None, 2, 4], key=repr)
    assert near_dedup.components(none).count() == 0


def test_links_of_a_dense_cell_are_few(spark):
    rng = random.Random(8)
    base, spots = rng.getrandbits(64), rng.sample(range(64), 22)
    fps = {base ^ sum(1 << b for b in rng.sample(spots, rng.randrange(9))) for _ in range(10_000)}
    fps |= {f ^ 1 << 63 - b ^ 1 << 31 - b for f in rng.sample(sorted(fps), 500) for b in (rng.randrange(20),)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = near_dedup.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert len(pairs) < 40 * len(fps)
    up = {f: f for f in fps}
    mine = dict(up)

    def root(of, x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    flips = [0, *(1 << i for i in range(64)), *((1 << i) + (1 << j) for i in range(64) for j in range(i))]
    for f in fps:
        for m in flips:
            if f ^ m in up:
                up[root(up, f)] = root(up, f ^ m)
    for r in pairs:
        a, b = r.a & (2**64 - 1), r.b & (2**64 - 1)
        assert (a ^ b).bit_count() <= 2
        mine[root(mine, a)] = root(mine, b)
    same = {}
    assert all(same.setdefault(root(up, f), root(mine, f)) == root(mine, f) for f in fps) and len(set(same.values())) == len(same)


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_join_every_near_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dedup, "CELL_ROWS", crowd)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum({1 << rng.randrange(64) for _ in range(n)}) for s in seeds for n in (0, 1, 1, 2, 2, 3, 4)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = near_dedup.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in near_dedup.connected(pairs).collect()}
    up = {f: f for f in fps}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                up[root(b)] = root(a)
    same = {}
    for f in fps:
        assert same.setdefault(root(f), roots.get(f, f)) == roots.get(f, f)
    assert len(set(same.values())) == len(same)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = df.selectExpr("a", "b", "bit_count(a ^ b) AS hamming").withColumn("lower", near_dedup.manhattan(near_dedup.embedding(df.a), near_dedup.embedding(df.b)))
    count = lambda x: [(x >> i & 3).bit_count() for i in range(0, 64, 2)]
    for r in out.collect():
        wanted = sum(abs(p - q) for p, q in zip(count(r.a & (2**64 - 1)), count(r.b & (2**64 - 1))))
        assert r.lower == wanted <= r.hamming


def test_warc(spark):
    same = "<html>" + "ä" * 100
    rows = [(5, "u v", same), (3, None, same), (3, "w", same), (None, "n", same), (7, "x", None), (8, "y", "")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(3)
    arc, out = shared_dir(spark), shared_dir(spark)
    warc_convert.write_arc(pages, arc)
    warc_convert.write_warc(warc_convert.convert(warc_convert.read_arc(spark, arc)), out)
    got = warc_convert.with_referred(warc_convert.read_warc(spark, out)).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr)
    n = len(same.encode())
    assert kinds == sorted([(5, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (None, "response", None, n), (7, "response", None, 0), (8, "response", None, 0)], key=repr)
    assert {r.payload.decode() for r in got if r.payload is not None} == {same, ""}
    empty = shared_dir(spark)
    warc_convert.write_arc(pages.limit(0), empty)
    assert warc_convert.read_arc(spark, empty).count() == 0


def test_arc_header_lines():
    for version, n in ((1, 5), (2, 10)):
        assert len(warc_convert.arc_line(version, "http://a", "192.0.2.1", "20200102030405", "text/html", 200, 0, "f", 3).split(b" ")) == n
    bad = warc_convert.member(warc_convert.arc_line(1, "http://a", "192.0.2.1", "20200102030405", "text/html", 200, 0, "f", 3) + b"abc\n")
    with pytest.raises(ValueError, match="version block"):
        list(warc_convert.arc_records(bad))


def test_token_files(spark, docs, none):
    for df, n in ((docs, len(ROWS)), (none, 0)):
        path = shared_dir(spark)
        varint_ids.write_ids(df, path, P.path("byte_bpe_50k.json"), P.PATTERN)
        got = varint_ids.read_ids(spark, path).orderBy("start").collect()
        assert len(got) == n
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        assert all(bytes(r.ids[-4:]) == b"\0\0\0\0" and len(r.ids) == 4 * r.n_tokens for r in got)


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        control, data = varint_ids.pack(values)
        assert len(control) == -(-n // 4)
        assert (varint_ids.unpack(control, data, n) == values).all()


def test_class_lm(docs, none):
    model, counts = class_lm.train(docs)
    out = class_lm.score(docs, model, counts).collect()
    assert len(out) == len(ROWS) and all(r.n_known == r.n_tokens and r.score < 0 for r in out)
    model, counts = class_lm.train(none)
    assert all(r.n_known == 0 and r.base_score == 0 for r in class_lm.score(docs, model, counts).collect())


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    for size, k in ((40, 4), (200, 9)):
        a, b = np.divmod(rng.choice(size * size, size * 12, replace=False), size)
        n = rng.integers(1, 50, len(a))
        count = np.bincount(b, n, size)
        classes, pair, seen = class_lm.exchange(a, b, n, count, k, tolerance=0)
        assert all(x <= y + 1e-6 for x, y in zip(seen, seen[1:])) and seen[-1] > seen[0]
        exact = np.zeros_like(pair)
        np.add.at(exact, (classes[a], classes[b]), n)
        assert np.allclose(pair, exact) and classes[-1] == k and (classes[:-1] < k).all()
        assert np.isclose(seen[-1], class_lm.likelihood(exact))


def test_class_lm_places_words_outside_the_core(spark):
    rng = random.Random(4)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    line = lambda: " ".join(x for _ in range(20) for x in (rng.choice(a), rng.choice(b)))
    docs = spark.createDataFrame([(str(i), line()) for i in range(300)], "doc_id string, text string").repartition(7)
    model, lexicon = class_lm.train(docs, core=20, head=30)
    found = {bytes(r.word).decode(): (r.n, r["class"]) for r in lexicon.collect()}
    assert 61 <= len(found) <= 80 and class_lm.END.decode() not in found
    wanted = class_lm.Counter(w for r in docs.collect() for w in r.text.split())
    assert all(wanted[w] == n for w, (n, _) in found.items())
    shared = {c for w, (_, c) in found.items() if w[0] == "a"} & {c for w, (_, c) in found.items() if w[0] == "b"}
    assert not shared
    plain = sum(np.log10((wanted[w] + 1) / (model.total + model.distinct + 1)) for w in docs.first().text.split())
    one = [r for r in class_lm.score(docs, model, lexicon).collect() if r.doc_id == docs.first().doc_id][0]
    assert one.n_known == one.n_tokens == 41 and abs(one.base_score - plain - np.log10(301 / (model.total + model.distinct + 1))) < 1e-6
    assert one.score > one.base_score + 6


def test_class_lm_learns_order(spark):
    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    line = lambda: " ".join(x for _ in range(20) for x in (rng.choice(a), rng.choice(b)))
    train = spark.createDataFrame([(i, line()) for i in range(300)], "doc_id long, text string")
    model, counts = class_lm.train(train)
    ordered, mixed = line(), " ".join(sorted(line().split()))
    scores = {r.doc_id: r.score for r in class_lm.score(spark.createDataFrame([(1, ordered), (2, mixed)], "doc_id long, text string"), model, counts).collect()}
    assert scores[1] > scores[2] + 5


def test_bpe_codec(docs, none):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    both = bpe_codec.decode(bpe_codec.encode(docs, ranks, P.PATTERN), ranks, P.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in both.collect()) == sorted(t or "" for _, t in ROWS)
    assert bpe_codec.encode(none, ranks, P.PATTERN).count() == 0


def test_arc_faults_are_rejected(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "page " * 40 + str(i)) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/arc"
    warc_convert.write_arc(pages, path)
    (name,) = [p for p in os.listdir(path) if p.startswith("part-")]
    content = open(f"{path}/{name}", "rb").read()
    with open(f"{path}/broken.arc", "wb") as f:
        f.write(content + warc_convert.member(b"http://x/ only three fields\n"))
    bad = warc_convert.rejected_archives(spark, path).collect()
    assert [(r.records, r.path.rsplit("/", 1)[1]) for r in bad] == [(6, "broken.arc")]
    assert warc_convert.read_arc(spark, path).count() == 12


def test_one_page_many_times(spark, monkeypatch):
    monkeypatch.setattr(warc_convert, "LEAST_HOT", 20)
    same = "all the same " * 20
    arc = spark.createDataFrame([(i, same if i % 3 else f"{i} {same}") for i in range(90)], "page_id long, html string")
    rows = arc.selectExpr("page_id", "sha2(html, 256) AS digest", "cast(length(html) AS long) AS payload_bytes", "html")
    out = {r.page_id: r["first"] for r in warc_convert.convert(rows).collect()}
    assert out == {i: 1 if i % 3 and i > 1 else None for i in range(90)}


def test_id_files_by_name_are_in_order(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(PLAIN.split()) for _ in range(50))) for i in rng.sample(range(10**6), 800)], "doc_id long, text string").repartition(6)
    path = f"{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        varint_ids.write_ids(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    starts = []
    for name in sorted(os.path.join(d, f) for d, _, files in os.walk(f"{path}/blocks") for f in files if f.startswith("part-")):
        raw, at = open(name, "rb").read(), 0
        while at < len(raw):
            _, n, _, start, c, d = struct.unpack_from(varint_ids.HEADER, raw, at)
            starts.append(start)
            at += struct.calcsize(varint_ids.HEADER) + 13 * n + c + d + 1
    assert len(starts) > 1 and starts == sorted(starts)


def test_item_without_id_hits_words(spark):
    docs = spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string")
    (r,) = suffix_match.matches(docs, spark.createDataFrame([(None, "two three")], "item_id long, text string")).collect()
    assert (r.n_hit, r["items"]) == (2, [])


def test_spans_of_many_matches(spark):
    text = " ".join(f"x{i} deadbeef{i:012x} y" for i in range(700))
    (r,) = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    wanted = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    assert [(x.s, x.e) for x in r.base] == wanted


def test_secrets_by_length(spark):
    """Recall on held-out planted strings of three alphabets, by length, and what is added on ordinary identifiers."""
    rng = random.Random(11)
    alphabets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    token = lambda n: "".join(rng.choice(rng.choice(alphabets)) for _ in range(n))
    words = "connection manager default configuration handler internal process request response session builder value".split()
    name = lambda: rng.choice(["_", "-", ""]).join(rng.choice(words) for _ in range(3))
    rows = [(i, f"{name()} uses {name()} with password={token(18)} in {name()}") for i in range(400)]
    planted = {1000 + k: (n, token(n)) for k, n in enumerate([12, 16, 20, 32] * 40)}
    rows += [(i, f"see {t} here") for i, (_, t) in planted.items()] + [(5000 + i, f"the {name()} and {name()}") for i in range(300)]
    found = {r.doc_id: [x for x in r.spans if x.k == len(secret_scan.KINDS)] for r in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {n: np.mean([bool(found[i]) for i, (m, _) in planted.items() if m == n]) for n in (12, 16, 20, 32)}
    assert recall[32] > 0.98 and min(recall.values()) > 0.8, recall  # 0.85, 0.93, 0.90 and 1.00 when written
    assert sum(bool(found[5000 + i]) for i in range(300)) <= 3


def test_secret_scan(spark, docs, none):
    assert secret_scan.find(none).count() == 0
    assert keys(secret_scan.find(docs)) == sorted((k for k, _ in ROWS), key=repr)
    rng = random.Random(7)
    token = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    words = "connection manager default configuration handler internal process request response session builder value".split()
    name = lambda: "_".join(rng.choice(words) for _ in range(4))
    rows = [(i, f"{name()} uses {name()} with password={token(18)} in {name()} and then {name()}") for i in range(300)]
    alone = token(24)
    rows += [(1000, f"here is {alone} by itself"), (1001, f"call {name()} and {name()} again")]
    out = {r.doc_id: r for r in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.s, s.e) for s in out[1000].spans] == [(8, 8 + len(alone))] and not out[1000].base
    assert not out[1001].spans and len(out[0].spans) == 1


@pytest.mark.parametrize("broadcast_keys", [100, 0])
def test_line_dedup(spark, docs, none, broadcast_keys):
    rows = [(i, f"Shared line\nown {i}\n\n  shared LINE\t") for i in range(12)] + [(None, None), (99, ""), (5, "own 5"), (5, "own 5")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, h1 int, n_lines string")
    out = line_runs.drop_frequent(df, broadcast_keys=broadcast_keys).collect()
    assert len(out) == len(rows)
    assert {(r.n_lines, r.n_dropped) for r in out if r.doc_id in range(12) and "\n" in r.text} == {(4, 2)}
    assert {(r.text, r.n_lines, r.n_dropped) for r in out if r.doc_id in (None, 99)} == {("", 1, 0)}
    assert line_runs.drop_frequent(none).count() == 0


def test_runs_merge_by_level(spark):
    runs = line_runs.LineRuns(spark, min_docs=3)
    for k in range(6):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, k, 1), (3, k % 2, 1)], "h1 long, h2 long, n long"))
    assert len(runs.levels) == 3
    assert sorted((r.h1, r.h2) for r in runs.frequent().collect()) == [(1, 1), (3, 0), (3, 1)]
