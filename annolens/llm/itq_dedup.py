"""Near copies among embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

Codes. On a bounded sample (SAMPLE rows chosen by hash) vectors are centred and turned to their principal
axes; a rotation is learned by turns of signs and of an orthogonal Procrustes fit, so that the signs of
rotated vectors are balanced bits that follow the data closely. Where more bits are needed than one
rotation gives, others are learned from other starts.

Tables. A code is cut into substrings of b bits, one table each, with about BUCKET vectors a bucket at any
size of the table (b grows with its logarithm); two vectors meet if a substring is equal. As many tables
are taken as find RECALL of the pairs at just the least cosine, which is measured on the sample's own
vectors, each with a partner turned by that angle at random and one turned towards another vector. Of
those that meet, codes of FILTER bits within a Hamming distance measured the same way are candidates,
and each candidate is decided by the cosine of the vectors in double precision. Buckets of more than
CHUNK entries are compared chunk by chunk in tasks of their own.

Dense groups. Vectors that crowd in one cell of longer substrings are put in balls: the mean of some of
the cell is a centre, and those within half the angle of it are all linked with each other. A ball enters a
bucket once, however many members it has there. Two balls link as a whole, or not at all, if the angle
of their centres says so for all members (triangle inequality); else members are held against a centre,
and pairs of members are compared only where that leaves it open. So a group of n close copies needs
about n comparisons, and no link is lost or assumed.

Cases: vectors that are null, empty, zero or hold null or non-finite entries link with nothing; shorter
vectors count as ended by zeros; rows with equal or null ids are vectors of their own; a component
without an id has a null component_id, and rows without an id are kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm._common import cut, join_hot, remove, shared_dir
from annolens.llm._vectors import matrix, packed, unpacked, usable
from annolens.llm.near_dedup import connected

SAMPLE, TURNS = 10_000, 20
RECALL, WITHIN = 0.97, 0.995
BUCKET, CHUNK, FILTER = 1000, 2000, 128
CELLS, CROWD, MEAN_OF, ROUNDS = 4, 128, 64, 4
MARGIN = 1e-7
SEED = 42


@dataclass
class Coder:
    """``tables`` substrings of ``bits`` bits, CELLS longer ones of ``cell_bits``, and the distance up to which codes are candidates."""

    mean: np.ndarray
    planes: np.ndarray
    tables: int
    bits: int
    cell_bits: int
    distance: int

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.planes > 0

    def substrings(self, signs: np.ndarray, count: int, bits: int) -> np.ndarray:
        return _numbers(signs[:, : count * bits], count, bits)


def _numbers(signs: np.ndarray, count: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros((len(signs), count), np.int64)
    return signs.reshape(len(signs), count, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _longs(signs: np.ndarray) -> np.ndarray:
    """The first FILTER bits as 64-bit integers."""
    return np.packbits(signs[:, :FILTER], axis=1).view("<i8")


def rotation(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix that brings ``rows`` close to their signs."""
    r = np.linalg.qr(rng.normal(size=(rows.shape[1],) * 2))[0]
    for _ in range(TURNS):
        u, _, v = np.linalg.svd(np.where(rows @ r > 0, 1.0, -1.0).T @ rows)
        r = (u @ v).T
    return r


def _turned(unit: np.ndarray, towards: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at ``cosine`` from ``unit``, in the planes that ``towards`` spans with them."""
    w = towards - (towards * unit).sum(1, keepdims=True) * unit
    length = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.divide(w, length, out=np.zeros_like(w), where=length > 1e-9)
    return cosine * unit + np.sqrt(1 - cosine**2) * w


def fit(sample: np.ndarray, n: int, cosine: float) -> Coder:
    """The coder for ``n`` vectors, learned from ``sample``, rows of unit length."""
    rng = np.random.default_rng(SEED)
    mean = sample.mean(axis=0)
    axes = np.linalg.svd((sample - mean).T @ (sample - mean))[0]
    turned = (sample - mean) @ axes
    some = sample[rng.permutation(len(sample))[:2000]]
    partners = [_turned(some, other, cosine) for other in (rng.normal(size=some.shape), some[rng.permutation(len(some))])]
    planes, of, others = np.zeros((len(mean), 0)), np.zeros((len(some), 0), bool), [np.zeros((len(some), 0), bool)] * 2
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BUCKET))))
    cell_bits = min(30, max(1, int(np.ceil(np.log2(max(n, 2))))))
    met, tables = [np.zeros(len(some), bool) for _ in partners], 0
    while planes.shape[1] < max(FILTER, CELLS * cell_bits) or min(m.mean() for m in met) < RECALL:
        if planes.shape[1] < max(FILTER, CELLS * cell_bits, (tables + 1) * bits):
            more = axes @ rotation(turned, rng)
            planes = np.hstack([planes, more])
            of, others = np.hstack([of, (some - mean) @ more > 0]), [np.hstack([o, (p - mean) @ more > 0]) for o, p in zip(others, partners)]
            continue
        at = slice(tables * bits, (tables + 1) * bits)
        met = [m | (of[:, at] == o[:, at]).all(axis=1) for m, o in zip(met, others)]
        tables += 1
    apart = [(of[:, :FILTER] != o[:, :FILTER]).sum(1) for o in others]
    return Coder(mean, planes, tables, bits, cell_bits, int(max(np.quantile(a, WITHIN) for a in apart)))


def _units(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, row, v): a number for each row, and its vector at unit length as bytes, null for one that links with nothing."""
    good = usable(vector) & (F.size(vector) > 0)
    d = vectors.where(good).agg(F.max(F.size(vector))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            x = np.zeros((b.num_rows, d))
            x[there] = matrix(b.column(2).drop_null(), d)
            x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)  # else squares of large entries overflow
            length = np.linalg.norm(x, axis=1, keepdims=True)
            ok = length[:, 0] > 0
            x = np.divide(x, length, out=x, where=length > 0)
            v = pa.array([r.tobytes() if k else None for r, k in zip(x, ok)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v], names=[id_col, "row", "v"])

    kind = vectors.schema[id_col].dataType.simpleString()
    numbered = vectors.select(id_col, F.monotonically_increasing_id().alias("row"), F.when(good, F.col(vector)).alias(vector))
    return cut(numbered.mapInArrow(run, f"`{id_col}` {kind}, row long, v binary"))


def _codes(units: DataFrame, coder: Coder) -> DataFrame:
    """(row, f0, f1, keys, cells) of the rows of ``units`` (row, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = coder.signs(unpacked(b.column(1)).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, coder.planes.shape[1]), bool)
            f = _longs(s)
            lists = [pa.array(list(coder.substrings(s, *x)), pa.list_(pa.int64())) for x in ((coder.tables, coder.bits), (CELLS, coder.cell_bits))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f[:, 0]), pa.array(f[:, 1]), *lists], names=["row", "f0", "f1", "keys", "cells"])

    return units.select("row", "v").mapInArrow(run, "row long, f0 long, f1 long, keys array<long>, cells array<long>")


def _with_cosine(rows: DataFrame, keep: str) -> DataFrame:
    """``rows`` (columns of ``keep``, then x and y, unit vectors) with their cosine ``c`` in place of x and y."""
    names = keep.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.einsum("ij,ij->i", unpacked(b.column(len(names))), unpacked(b.column(len(names) + 1)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(c)], names=[*names, "c"])

    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "x", "y").mapInArrow(run, f"{types}, c double")


def _means(picked: DataFrame) -> DataFrame:
    """(cell, centre) from ``picked`` (cell, some vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.array([unpacked(pa.array(x.as_py(), pa.binary())).mean(axis=0) for x in b.column(1)])
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)
                yield pa.RecordBatch.from_arrays([b.column(0), packed(m)], names=["cell", "centre"])

    return picked.mapInArrow(run, "cell long, centre binary")


def balls(units: DataFrame, codes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame] | None:
    """Members (row, ball) and balls (node, v, radius, size), named by their least row; None where nothing is crowded.

    Each round takes the centres of the cells that are crowded by rows in no ball yet; what ROUNDS leave are rows of their own.
    """
    left, members, found = codes.select("row", "cells"), [], []
    half = float(np.cos(np.arccos(cosine) / 2 - MARGIN))
    vectors = units.select("row", F.col("v").alias("x"))
    for _ in range(ROUNDS):
        cells = left.select("row", F.posexplode("cells").alias("t", "key")).select("row", F.xxhash64("t", "key").alias("cell"))
        counts = cut(cells.groupBy("cell").agg(F.count("*").alias("__n")).where(F.col("__n") > CROWD))
        if counts.isEmpty():
            break
        crowded = cut(join_hot(cells, counts.withColumnRenamed("__n", "n"), "cell", counts=counts))
        some = crowded.where(F.pmod(F.xxhash64("row", "cell"), F.col("n")) < MEAN_OF)
        centres = cut(_means(some.join(vectors, "row").groupBy("cell").agg(F.collect_list("x"))))
        tried = join_hot(crowded, centres.withColumnRenamed("centre", "y"), "cell", counts=counts).join(vectors, "row")
        best = _with_cosine(tried, "row cell").where(F.col("c") >= half).groupBy("row").agg(F.max(F.struct("c", "cell")).alias("m"))
        taken = cut(best.select("row", "m.cell", "m.c"))
        made = taken.groupBy("cell").agg(F.min("row").alias("node"), F.min("c").alias("c"), F.count("*").alias("size")).where("size > 1")
        radius = F.acos(F.least(F.col("c"), F.lit(1.0)))
        found.append(cut(made.join(centres, "cell").select("cell", "node", F.col("centre").alias("v"), radius.alias("radius"), "size")))
        members.append(cut(join_hot(taken.select("row", "cell"), found[-1].select("cell", F.col("node").alias("ball")), "cell").select("row", "ball")))
        left = cut(left.join(members[-1], "row", "left_anti"))
    if not found:
        return None
    return reduce(DataFrame.union, members), reduce(DataFrame.union, found).drop("cell")


def _entries(codes: DataFrame, dense, coder: Coder, cosine: float) -> DataFrame:
    """(t, key, node, f0, f1, slack): every bucket's rows that are in no ball, and balls with members in it."""
    single = codes
    if dense:
        members, made = dense
        single = codes.join(members, "row", "left_anti")
    entries = single.select(F.posexplode("keys").alias("t", "key"), F.col("row").alias("node"), "f0", "f1", F.lit(0).alias("slack"))
    if dense:
        wider = F.ceil(F.col("radius") * (1.2 * coder.distance / np.arccos(cosine))).cast("int")
        named = _codes(made.select(F.col("node").alias("row"), "v"), coder).select(F.col("row").alias("node"), "f0", "f1").join(made.select("node", wider.alias("slack")), "node")
        there = codes.join(members, "row").select(F.posexplode("keys").alias("t", "key"), F.col("ball").alias("node")).distinct()
        entries = entries.union(there.join(named, "node").select("t", "key", "node", "f0", "f1", "slack"))
    return entries


def candidates(entries: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: nodes of one bucket whose codes differ in ``distance`` bits at most, and both their slacks."""

    def compare(x: dict, y: dict | None) -> tuple[np.ndarray, np.ndarray]:
        one, a, b = y is None, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        y = x if one else y
        for i in range(0, len(x["node"]), 256):
            s = slice(i, i + 256)
            bits = sum(np.bitwise_count(x[f][s, None] ^ y[f][None]).astype(np.int16) for f in ("f0", "f1"))
            near = bits <= distance + x["slack"][s, None] + y["slack"][None]
            if one:
                near &= np.arange(len(y["node"])) > np.arange(i, i + len(near))[:, None]
            p, q = np.nonzero(near)
            a.append(x["node"][s][p])
            b.append(y["node"][q])
        return np.concatenate(a), np.concatenate(b)

    def run(t: pa.Table) -> pa.Table:
        c = {n: t[n].to_numpy() for n in ("node", "f0", "f1", "slack", "side")}
        c["f0"], c["f1"] = (c[f].view(np.uint64) for f in ("f0", "f1"))
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        part = lambda side: {k: v[c["side"] == side] for k, v in c.items()}
        a, b = compare(part(lo), None if lo == hi else part(hi))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    counts = cut(entries.groupBy("t", "key").agg(F.count("*").alias("__n")).where(F.col("__n") > CHUNK).select(F.xxhash64("t", "key").alias("bucket"), "__n"))
    entries = entries.withColumn("bucket", F.xxhash64("t", "key"))
    k = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / CHUNK).cast("int")
    if counts.isEmpty():
        dealt = entries.select("bucket", *[F.lit(0).alias(c) for c in ("side", "lo", "hi")], "node", "f0", "f1", "slack")
    else:
        marked = join_hot(entries, counts.withColumnRenamed("__n", "n"), "bucket", "left", counts)
        sided = marked.withColumn("k", k).withColumn("side", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        other = sided.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        dealt = other.select("bucket", "side", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "node", "f0", "f1", "slack")
    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def links(units: DataFrame, cosine: float = 0.9):
    """Of ``units``: members (row, ball) or None, what counts for a node or a row, and edges (a, b) of linked nodes.

    Gives (members, nodes (node, v, radius, size), by_node (node, k), by_row (row, k), edges).
    """
    spark = units.sparkSession
    there = units.where(F.col("v").isNotNull()).select("row", "v")
    n = there.count()
    rows = there.orderBy(F.xxhash64("v")).limit(SAMPLE).collect() if n else []
    if not rows:
        return None
    coder = fit(np.array([np.frombuffer(r.v, "<f8") for r in rows]), n, cosine)
    codes = cut(_codes(there, coder))
    dense = balls(there, codes, cosine)
    single = there.join(dense[0], "row", "left_anti") if dense else there
    nodes = single.select(F.col("row").alias("node"), "v", F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("size"))
    if dense:
        nodes = nodes.union(dense[1].select("node", "v", "radius", "size"))
    nodes = cut(nodes)
    entries_at = shared_dir(spark)
    found = cut(candidates(cut(_entries(codes, dense, coder, cosine), entries_at), coder.distance))
    remove(spark, entries_at)

    most = float(np.arccos(cosine))
    angle = F.acos(F.greatest(F.least(F.col("c"), F.lit(1.0)), F.lit(-1.0)))
    of = lambda k, v: nodes.select(F.col("node").alias(k), F.col("v").alias(v), F.col("radius").alias(f"r{k}"), F.col("size").alias(f"s{k}"))
    first = join_hot(found, of("a", "x"), "a")
    both = join_hot(first, of("b", "y"), "b", counts=found.groupBy("b").agg(F.count("*").alias("__n")))
    held = _with_cosine(both, "a b ra rb sa sb")
    exact = (F.col("sa") == 1) & (F.col("sb") == 1)
    wide = F.col("ra") + F.col("rb")
    whole = F.when(exact, F.col("c") >= cosine).otherwise(angle + wide <= most - MARGIN)
    open_ = F.when(exact, False).otherwise(angle - wide <= most + MARGIN)
    told = cut(held.withColumn("whole", whole).where(F.col("whole") | open_).select("a", "b", "sa", "sb", "whole"))
    sure = told.where("whole")
    by_node = [sure.select(F.col("a").alias("node"), F.col("sb").alias("k")), sure.select(F.col("b").alias("node"), F.col("sa").alias("k"))]
    edges, by_row = [sure.select("a", "b")], []
    rest = told.where("NOT whole")
    if dense and not rest.isEmpty():
        members, made = dense
        v = lambda name, row: there.select(F.col("row").alias(row), F.col("v").alias(name))
        # one side's members against the other side's centre, the smaller one's where both are balls
        turn = (F.col("sa") > F.col("sb")) & (F.col("sb") > 1) | (F.col("sa") == 1)
        rest = rest.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
        single_side = rest.join(members, rest.a == members.ball).select("a", "b", "row")
        against = join_hot(cut(single_side), of("b", "y"), "b").join(v("x", "row"), "row")
        held = _with_cosine(against, "a b row rb sb")
        alone = F.col("sb") == 1
        whole = F.when(alone, F.col("c") >= cosine).otherwise(angle + F.col("rb") <= most - MARGIN)
        open_ = F.when(alone, False).otherwise(angle - F.col("rb") <= most + MARGIN)
        told = cut(held.withColumn("whole", whole).where(F.col("whole") | open_).select("a", "b", "row", "sb", "whole"))
        sure = told.where("whole")
        by_row.append(sure.select("row", F.col("sb").alias("k")))
        by_node.append(sure.select(F.col("b").alias("node"), F.lit(1).cast("long").alias("k")))
        edges.append(sure.select("a", "b"))
        pairs = told.where("NOT whole").join(members.select(F.col("row").alias("other"), F.col("ball").alias("b")), "b").select("a", "b", "row", "other")
        close = cut(_with_cosine(pairs.join(v("x", "row"), "row").join(v("y", "other"), "other"), "a b row other").where(F.col("c") >= cosine).drop("c"))
        for side in ("row", "other"):
            by_row.append(close.select(F.col(side).alias("row"), F.lit(1).cast("long").alias("k")))
        edges.append(close.select("a", "b"))
    union = lambda some: reduce(DataFrame.union, some)
    return dense and dense[0], nodes, union(by_node), union(by_row) if by_row else None, union(edges)


def components(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept for every row: the vectors linked with it, and the smallest id reachable by links."""
    units = _units(vectors, id_col, vector)
    found = links(units, cosine)
    if found is None:
        return units.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    members, nodes, by_node, by_row, edges = found
    total = lambda df, key: df.groupBy(key).agg(F.sum("k").alias("k"))
    classes = connected(edges)
    info = nodes.select("node", "size").join(total(by_node, "node"), "node", "left").join(classes, "node", "left")
    info = cut(info.select("node", (F.coalesce("k", F.lit(0)) + F.col("size") - 1).alias("k"), F.coalesce("root", "node").alias("root")))
    rows = units.select(id_col, "row")
    rows = rows.join(members, "row", "left").select(id_col, "row", F.coalesce("ball", "row").alias("node")) if members else rows.withColumn("node", F.col("row"))
    counted = join_hot(cut(rows), info, "node", "left").select(id_col, "row", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("root", "row").alias("root"))
    if by_row is not None:
        counted = counted.join(total(by_row, "row").withColumnRenamed("k", "more"), "row", "left").select(id_col, "row", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"), "root")
    counted = cut(counted)
    least = counted.groupBy("root").agg(F.min(id_col).alias("component_id"))
    out = join_hot(counted, least, "root").select(id_col, F.col("k").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
