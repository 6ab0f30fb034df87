"""Embedding near-copies and whitening against plain versions, with odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from annolens.llm import itq_dedup, whitening
from annolens.llm import queries as q

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, row string, node string, c string"


def table(spark, pairs):
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v], 1, "x", "y", "z") for i, v in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def linked(pairs, least=0.9):
    """(id, links, component) by all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in pairs]
    d = max([len(v) for (_, v), k in zip(pairs, ok) if k], default=1)
    x = np.array([list(v) + [0.0] * (d - len(v)) if k else [0.0] * d for (_, v), k in zip(pairs, ok)], float).reshape(-1, d)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = (x @ x.T >= least) & np.array(ok)[:, None] & np.array(ok)[None]
    np.fill_diagonal(near, False)
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        root[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            ids[find(i)] = min(k, ids.get(find(i), k))
    return [(k, int(near[i].sum()), ids.get(find(i))) for i, (k, _) in enumerate(pairs)]


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def test_small_table_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    out = q.op11_embedding_dedup(spark, SMALL)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got(out) == sorted(linked([(r.vec_id, r.embedding) for r in rows]), key=repr)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(1, [1, 0]), (2, [1, 0.1]), (2, [1, 0.1]), (None, [1, 0.05]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, []), (9, [5]), (10, [1e300, 1e299]), (11, [-1, 0]), (None, [-1, 0.01]), (None, [0, 1])]
    out = itq_dedup.components(table(spark, pairs))
    assert got(out) == sorted(linked(pairs), key=repr)
    kept = {(r.vec_id, r.kept) for r in out.collect()}
    assert (1, True) in kept and (2, False) in kept and (None, True) in kept and (3, True) in kept
    assert itq_dedup.components(table(spark, [])).count() == 0
    assert got(itq_dedup.components(table(spark, [(1, None), (2, [0, 0])]))) == [(1, 0, 1), (2, 0, 2)]


def crowd(seed, alone, groups, spread, d=24):
    """Vectors of their own and groups about one direction each, ids shuffled."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(alone, d))]
    for size, by in zip(groups, spread):
        parts.append(rng.normal(size=d) + by * rng.normal(size=(size, d)))
    rows = np.vstack(parts)
    return list(zip(rng.permutation(len(rows)).tolist(), rows))


def test_dense_groups_keep_every_link(spark, monkeypatch):
    for name, value in (("BUCKET", 100), ("CHUNK", 150), ("CROWD", 16)):
        monkeypatch.setattr(itq_dedup, name, value)
    pairs = crowd(7, 500, [700, 200, 100, 60], [0.05, 0.2, 0.33, 0.0])
    wanted = {k: (n, c) for k, n, c in linked(pairs)}
    out = {r.vec_id: r for r in itq_dedup.components(table(spark, pairs)).collect()}
    assert len(out) == len(pairs)
    assert all(out[k].n_links <= n for k, (n, _) in wanted.items())
    assert sum(r.n_links for r in out.values()) >= 0.98 * sum(n for n, _ in wanted.values())
    tight = [k for (k, _), i in zip(pairs, range(len(pairs))) if 500 <= i < 1200]
    assert all(out[k].n_links == wanted[k][0] for k in tight)  # a group of close copies loses none
    assert sum(out[k].component_id == c for k, (_, c) in wanted.items()) >= 0.99 * len(pairs)


def test_recall_of_pairs_at_the_least_cosine(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(2000, 48))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = itq_dedup._turned(u, rng.normal(size=u.shape), 0.9005)
    pairs = [*enumerate(u), *((10_000 + i, x) for i, x in enumerate(v))]
    wanted = {k: n for k, n, _ in linked(pairs)}
    out = {r.vec_id: r.n_links for r in itq_dedup.components(table(spark, pairs)).collect()}
    assert all(out[k] <= n for k, n in wanted.items())
    assert sum(out.values()) >= 0.9 * sum(wanted.values())


def whitened(vectors, k=8):
    """n, trace, eigenvalues, vectors, deviations, centred rows from exact rational sums."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    return n, float(np.trace(v)), e[::-1][:k], u[:, ::-1][:, :k], [sum(c * c for c in r) for r in centred], np.array(centred, float) / n, v


def test_whitening_equals_exact_sums(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    n, trace, e, u, deviation, centred, _ = whitened([r.embedding for r in rows])
    out = q.op12_whitening(spark, SMALL)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    by = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(by) == 8 * len(rows)
    for i, r in enumerate(rows):
        for c in range(8):
            o = by[r.vec_id, c + 1]
            assert (o.n, o.deviation) == (n, deviation[i]) and math.isclose(o.explained, e[c] / trace, rel_tol=1e-9) and o.identity_error < 1e-9
    for c in range(8):
        mine, theirs = np.array([by[r.vec_id, c + 1].whitened for r in rows]), centred @ u[:, c] / math.sqrt(e[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6


def test_covariance_is_right_where_doubles_cancel(spark):
    rng = np.random.default_rng(1)
    rows = [[1e6 + x, 1e6 + y, 1e-3 * x] for x, y in rng.normal(size=(301, 2))]
    *_, v = whitened(rows)
    vectors = table(spark, enumerate(rows)).repartition(40)
    model = whitening.sums(vectors, "embedding", 1024, 100_000)
    assert np.array_equal(whitening.covariance(vectors, "embedding", model), v) or np.allclose(whitening.covariance(vectors, "embedding", model), v, rtol=4e-16, atol=0)


def test_whole_numbers_of_any_size():
    model = whitening.Model(1, 0, 3, [1 << 62, 5], 1 << 62)
    d = model.centred(np.array([[1 << 61, 7], [3, -1]], np.int64))
    assert d.tolist() == [[3 * (1 << 61) - (1 << 62), 16], [9 - (1 << 62), -8]]
    high, low = whitening._parts(d)
    assert [[int(h) + int(l) for h, l in zip(*r)] for r in zip(high.tolist(), low.tolist())] == d.tolist()


def test_double_double():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(57, 4)) * 1e12, rng.normal(size=(57, 4))
    high, low = whitening.dd_total(*whitening.two_product(a, b))
    for j in range(4):
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a[:, j], b[:, j]))
        assert abs(Fraction(high[j]) + Fraction(low[j]) - exact) <= abs(exact) * Fraction(1, 10**25) + Fraction(1, 10**15)


def test_odd_vectors_of_whitening(spark):
    nan = float("nan")
    pairs = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.1, -2]), (2, None), (3, [nan, 1]), (4, [None, 1]), (5, [7]), (6, [])]
    vectors = table(spark, pairs)
    out = whitening.whiten(vectors, whitening.fit(vectors), 8).collect()
    n, trace, e, *_ = whitened([[0.5, 0.25], [0.5, 0.25], [0.1, -2], [7, 0], [0, 0]])
    assert sorted((r.vec_id, r.component) for r in out if r.vec_id) == [(1, 1), (1, 1), (1, 2), (1, 2), (5, 1), (5, 2), (6, 1), (6, 2)]
    assert all(r.n == n and math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9) for r in out)
    none = table(spark, [(1, None)])
    assert whitening.whiten(none, whitening.fit(none), 8).count() == 0
    same = table(spark, [(1, [1, 2]), (2, [1, 2])])
    assert {(r.whitened, r.identity_error, r.deviation) for r in whitening.whiten(same, whitening.fit(same), 8).collect()} == {(None, None, 0)}
    with pytest.raises(Exception, match="beyond"):
        whitening.fit(table(spark, [(1, [1e30, 1])]))


def test_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb

    pairs = [*crowd(5, 200, [60, 20], [0.1, 0.3], d=8), (1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7)]
    table(spark, pairs).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({q.ORACLE_SQL['op11_embedding_dedup']})").fetchall()
    mine = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in q.op11_embedding_dedup(spark, str(tmp_path)).collect()]
    assert sorted(mine) == sorted(theirs) and sum(r[1] for r in mine) > 1000
