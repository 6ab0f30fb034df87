"""Near-duplicate classes by SimHash and a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two; the embedding is the vector of
their bit counts. Changing one bit moves one count by one, so the Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints:
a lower bound. Counts 0, 1, 2 are kept in unary, which makes the Manhattan
distance the number of differing bits of two packed longs.

The range join (Manhattan distance at most 2) runs on a grid: the 32 axes form
blocks, and as at most two steps separate a pair, it agrees on all blocks but two;
so each vector goes to the cells that every choice of all blocks but two makes, and
rows of one cell are joined, filtered by the bound and verified bit by bit. Equal
fingerprints are one row before the join. The grid has 4 blocks; fingerprints in
cells of more than CELL_ROWS go on. Of these, all that differ within one segment only
are linked at once, cell by cell of the other 31 segments; the rest is asked only of
pairs in different classes so far, on grids of 8 and 16 blocks and, for what is still
crowded, on one of single axes with their bits, whose cells have 16 fingerprints at
most. So a pair that meets in crowded cells is found by a finer grid, no cell that
grows is joined with itself, and a dense group does not give all its pairs.

Classes are connected components by alternating large-star and small-star steps
on the linked fingerprints, each step written to the shared folder.

Cases: null, empty or blank text has fingerprint zero and links like any other;
documents with fewer words than a shingle use their whole word sequence; repeated
rows share a class; a class without any id has a null class id; an empty table
gives an empty result; extra columns are ignored by ``components`` and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm._common import cut, join_hot, remove, shared_dir

SEED = 42
CELL_ROWS = 16
BLOCKS = (8, 16, 32)
AXES = 32
_EVEN = 0x5555555555555555
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included, in order."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.array([], np.uint64)
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    size = min(shingle, len(w))
    return np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint64)


def simhash(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprint(text: str | None, shingle: int) -> int:
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary in its own two bits."""
    x, y, even = fp, F.shiftrightunsigned(fp, 1), F.lit(_EVEN)
    return x.bitwiseOR(y).bitwiseAND(even).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(even), 1))


def manhattan(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(fps: DataFrame, blocks: int, of: str, free: int = 2) -> DataFrame:
    """The rows of ``fps`` with ``cell``, for every choice of all but ``free`` of ``blocks`` blocks of ``of``'s 64 bits."""
    width = 64 // blocks
    whole = [(1 << width) - 1 << width * i for i in range(blocks)]
    masks = [_signed((1 << 64) - 1 - sum(left)) for left in combinations(whole, free)]
    chosen = fps.select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    return chosen.select(*fps.columns, F.xxhash64("mask", F.col(of).bitwiseAND(F.col("mask"))).alias("cell"))


def _near(cells: DataFrame, bits: int, apart: bool = False) -> DataFrame:
    """Pairs (a, b) of one cell within ``bits``; with ``apart``, one for each two classes (root)."""
    a, b = cells.alias("a"), cells.alias("b")
    near = (manhattan(F.col("a.v"), F.col("b.v")) <= bits) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
    order = F.col("a.root") < F.col("b.root") if apart else F.col("a.fp") < F.col("b.fp")
    found = a.join(b, (F.col("a.cell") == F.col("b.cell")) & order & near)
    if not apart:
        return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    one = found.groupBy("a.root", "b.root").agg(F.min(F.struct(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))).alias("m"))
    return one.select(F.least("m.a", "m.b").alias("a"), F.greatest("m.a", "m.b").alias("b"))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints of ``fp`` within ``bits`` = 2 bits, enough to connect every two such fingerprints."""
    if bits != 2:
        raise ValueError("the grids are laid out for two differing bits")
    cells = _cells(fps.select("fp", embedding(F.col("fp")).alias("v")), 4, "v")
    counts = cut(cells.groupBy("cell").agg(F.count("*").alias("__n")).where(F.col("__n") > CELL_ROWS))
    if counts.isEmpty():
        return _near(cells, bits).distinct()
    marked = cut(join_hot(cells, counts.select("cell", F.lit(True).alias("crowded")), "cell", "left", counts))
    rest = cut(marked.where("crowded").select("fp", "v").distinct())
    inner = _cells(rest, AXES, "fp", 1).groupBy("cell").agg(F.sort_array(F.collect_set("fp")).alias("some")).where(F.size("some") > 1)  # four at most
    star = cut(inner.select(F.col("some")[0].alias("a"), F.explode(F.slice("some", 2, 4)).alias("b")).distinct())
    found = [_near(marked.where(F.col("crowded").isNull()), bits), star]
    classes = connected(star)
    rest = cut(rest.join(classes, rest.fp == classes.node, "left").select("fp", "v", F.coalesce("root", "fp").alias("root")))
    for blocks in BLOCKS:
        cells = _cells(rest, blocks, "fp" if blocks == AXES else "v")
        mixed = cut(cells.groupBy("cell").agg(F.count("*").alias("__n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi"))
        if mixed.isEmpty():
            break
        crowded = F.lit(False) if blocks == AXES else F.col("__n") > CELL_ROWS
        marked = cut(join_hot(cells, mixed.select("cell", crowded.alias("crowded")), "cell", counts=mixed))
        found.append(_near(marked.where("NOT crowded"), bits, apart=True))
        rest = cut(marked.where("crowded").select("fp", "v", "root").distinct())
    return reduce(DataFrame.union, found).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node of its component."""
    spark = edges.sparkSession
    path = shared_dir(spark)
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), path)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen = digest(now)
    while True:
        # large star: every larger neighbour of u joins the least of u and its neighbours
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n"))
        large_path, small_path, least_path = shared_dir(spark), shared_dir(spark), shared_dir(spark)
        least = cut(least.select("a", F.least("a", "m").alias("m"), "__n"), least_path)
        large = join_hot(both.where("b > a"), least.drop("__n"), "a", counts=least).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: u and its smaller neighbours join the least of them
        held = cut(large, large_path)
        least = held.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("__n"))
        moved = join_hot(held, least.drop("__n"), "b", counts=least).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        small = cut(moved.union(least.select(F.col("m").alias("a"), "b")).distinct(), small_path)
        for done in (path, large_path, least_path):
            remove(spark, done)
        now, path, before, seen = small, small_path, seen, digest(small)
        if seen == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def components(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id, the smallest id of the document's class, for every row."""
    held = cut(fingerprints(docs, shingle, id_col, text_col))
    by_fp = cut(held.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("__n")))
    roots = connected(links(by_fp.select("fp")))
    classes = cut(by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), "__n"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(join_hot(classes, smallest, "root").select("fp", "component_id"))
    return join_hot(held, named, "fp", counts=by_fp).select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of the smallest document of each class, with all their columns.

    With ``similarity`` (0.8 and five words) classes are those of ``shingle_join``: SimHash links and links that
    fingerprints miss, all verified by the Jaccard similarity of shingle sets. Rows without an id cannot be told
    apart and stay; rows that share the kept id stay together.
    """
    if similarity is None:
        classes = components(docs, shingle, id_col, text_col)
    elif (similarity, shingle) == (0.8, 5):
        from annolens.llm import shingle_join

        classes = shingle_join.components(docs, id_col, text_col)
    else:
        raise ValueError("shingle_join is laid out for five words and a similarity of 0.8")
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").select(*docs.columns)
    return named.union(docs.where(F.col(id_col).isNull()))
