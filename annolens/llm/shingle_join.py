"""Near copies for ``near_dedup.keep_one``: documents whose sets of five-word shingles have a Jaccard similarity of at least 4/5.

Pairs at that similarity differ in up to a dozen bits of a 64-bit SimHash, where no grid is
selective, so fingerprints give a part of the candidates only: those that ``near_dedup.links``
finds on its popcount grid, and equal ones. The other candidates come from cells of shingles.

Each set sends its LOW shingles of the least hashes to cells. Going through the union of two
similar sets by hash, each shingle is in both sets with a chance of 4/5 or more; the two sets
share no cell only if a dozen or more in a row are not, a chance below one in 10^8. A cell with
more than CELL_ROWS sets holds a passage that many texts quote, or the near copies of one text.
Sets with FREE or more of four cells not so crowded need the others only, by the same reckoning
with the crowded shingles taken out. Sets with more crowded cells (``crowd``) are compared with one
member of each crowded cell. Where classes then differ inside a cell, its sets go to the cells of
their n - ceil(4n/5) + 1 rarest shingles, of which two similar sets always share one, and members of
different classes are paired. What is crowded even there goes to BANDS cells of BAND min-hashes,
which two similar sets all miss with a chance of about 10^-9. These joins look at the parities of
shingle counts in 64 * WORDS ranges of the hash, whose distance is a lower bound of what differs, so
that of a large group of texts that are almost similar enough hardly any pair comes out.

Candidates with unequal sizes go, then those whose shingle counts in BUCKETS ranges of the hash
have too large a Manhattan distance (a lower bound of what differs), then the sets themselves are
compared. Sets stand for all rows that have them; equal sets are one node, named by a hash of the
set. Joins on keys that may be hot go through ``join_hot``; nothing is gathered on the driver.

Cases: null, empty or blank texts have the empty set and are copies of one another; a text with
fewer words than a shingle is one shingle; rows without an id link others but stay; rows that share
the kept id stay together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolens.llm._common import cut, join_hot
from annolens.llm.near_dedup import SEED, connected, shingle_hashes, simhash
from annolens.llm.near_dedup import links as simhash_links

SHINGLE = 5
LOW, CELL_ROWS, BUCKETS = 32, 16, 64
BAND, BANDS = 6, 68
WORDS = 16
FIRST_OF = 8  # one cell in so many is looked at first
PARITY = [f"p{i}" for i in range(WORDS)]
CELLED = ["cell", "node", "n", "root", *PARITY]
_ODD = np.random.Generator(np.random.PCG64(SEED)).integers(1 << 62, size=(BANDS, BAND), dtype=np.uint64) * 2 + 1


def shingles(text: str | None) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def node(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.array(xxh64_intdigest(s.tobytes(), SEED), np.uint64).view(np.int64))


def _keyed(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    return docs.select(*more, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), text_col)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, node, n, fp, low) of every row: its set's name and size, SimHash, and least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, fps, low = [], [], [], []
            for t in b.column(2):
                h = shingle_hashes(t.as_py(), SHINGLE)
                s = np.unique(h)
                nodes.append(node(s))
                sizes.append(len(s))
                fps.append(simhash(h))
                low.append(s[:LOW].view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(x, pa.int64()) for x in (nodes, sizes, fps)), pa.array(low, pa.list_(pa.int64()))], names=[id_col, "text_key", "node", "n", "fp", "low"])

    return _keyed(docs, text_col, id_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, text_key long, node long, n long, fp long, low array<long>")


def sets_of(docs: DataFrame, keys: DataFrame, text_col: str, counts: DataFrame) -> DataFrame:
    """(node, n, ranges, shingles) of the sets whose text is among ``keys`` (text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0)]
            ranges = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes() for s in found]
            rows = [pa.array([node(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(ranges, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["node", "n", "ranges", "shingles"])

    texts = join_hot(_keyed(docs, text_col), keys, "text_key", "left_semi", counts).dropDuplicates(["text_key"]).select(text_col)
    return texts.mapInArrow(run, "node long, n long, ranges binary, shingles binary").dropDuplicates(["node"])


def _alike(common, a, b):
    """Whether ``common`` of sets of ``a`` and ``b`` shingles are a similarity of 4/5."""
    return 9 * common >= 4 * (a + b)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b), a written table, whose sets have a similarity of 4/5."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, BUCKETS).astype(np.int64) for c in b.columns[2:])
            a, c = x.sum(1), y.sum(1)
            keep = _alike((a + c - np.abs(x - y).sum(1)) // 2, a, c)  # what is common at most
            yield b.select([0, 1]).filter(pa.array(keep))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                keep.append(_alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def both(pairs, what):
        one = lambda k: sets.select(F.col("node").alias(k), F.col(what).alias(f"{what}_{k}"))
        first = join_hot(pairs, one("a"), "a")
        return join_hot(first, one("b"), "b", counts=pairs.groupBy("b").agg(F.count("*").alias("__n"))).select("a", "b", f"{what}_a", f"{what}_b")

    near = cut(both(pairs, "ranges").mapInArrow(bounded, "a long, b long"))
    return both(near, "shingles").mapInArrow(compared, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (a, na, b, nb) whose sizes allow a similarity of 4/5."""
    sized = pairs.where((F.col("a") != F.col("b")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")))
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_cells(left: DataFrame, right: DataFrame, also=None) -> DataFrame:
    """(a, na, b, nb) of the rows of one cell."""
    x, y = left.alias("x"), right.alias("y")
    on = F.col("x.cell") == F.col("y.cell")
    return x.join(y, on if also is None else on & also).select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb"))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, na, b, nb) of nodes with equal fingerprints, each beside one of them, and of one node each of a fingerprint and the smallest linked to it."""
    one = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("m"), F.count("*").alias("__n")).select("fp", F.col("m.node").alias("b"), F.col("m.n").alias("nb"), "__n"))
    equal = join_hot(nodes.select("fp", "node", "n"), one.drop("__n"), "fp", counts=one).select(F.col("node").alias("a"), F.col("n").alias("na"), "b", "nb").where("a <> b")
    linked = simhash_links(one.select("fp")).groupBy("b").agg(F.min("a").alias("a"))
    side = lambda k: one.select(F.col("fp").alias(k), F.col("b").alias(f"node_{k}"), F.col("nb").alias(f"n_{k}"))
    return equal.union(linked.join(side("a"), "a").join(side("b"), "b").select("node_a", "n_a", "node_b", "n_b"))


def parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """Of each set, the parities of its shingle counts in 64 * WORDS ranges of the hash, as WORDS columns of 64 bits."""
    odd = [np.bincount((s.view(np.uint64) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1 for s in sets]
    packed = np.packbits(np.array(odd, np.uint8).reshape(len(sets), -1), axis=1).view(">i8").astype(np.int64).reshape(len(sets), WORDS)
    return [pa.array(packed[:, i]) for i in range(WORDS)]


def _close():
    """Whether two rows may be similar: every shingle of one set only changes one parity, so the parities differ in no more places than the sets."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in PARITY])
    return 9 * apart <= F.col("x.n") + F.col("y.n")


def bands(rows: DataFrame) -> DataFrame:
    """(cell, node, n, root) and parities for every band of min-hashes of ``rows`` (node, n, root, shingles)."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, sets = [], [np.frombuffer(x.as_py(), np.uint64) for x in b.column(3)]
            for s in sets:
                cells += [xxh64_intdigest(np.multiply.outer(odd, s).min(1).tobytes(), k) for k, odd in enumerate(_ODD)]
            at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(cells, np.uint64).view(np.int64)), *(c.take(at) for c in (*b.columns[:3], *parities(sets)))], names=CELLED)

    return rows.select("node", "n", "root", "shingles").mapInArrow(run, ", ".join(f"{c} long" for c in CELLED))


def _mixed(cells: DataFrame) -> DataFrame:
    """(cell, main) of the cells with more than one class; main is the class with most rows."""
    sizes = cells.groupBy("cell", "root").count()
    return sizes.groupBy("cell").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("classes")).where("classes > 1").select("cell", F.col("m.root").alias("main"))


def _in_mixed(cells: DataFrame) -> DataFrame:
    """(node) of the nodes with a cell of more than one class; what some of its cells show of a node is not asked of the others."""
    mixed = cut(_mixed(cells).select("cell"))
    some = F.pmod(F.xxhash64("cell", "node"), F.lit(FIRST_OF)) == 0
    found = cut(join_hot(cells.where(some), mixed, "cell", "left_semi").select("node").distinct())
    rest = cut(cells.where(~some).join(found, "node", "left_anti"))
    return found.union(join_hot(rest, mixed, "cell", "left_semi").select("node").distinct())


def links(docs: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root) of the nodes that have a near copy. ``names`` is the written table of ``named``."""
    nodes = cut(names.drop("text_key").dropDuplicates(["node"]).select("node", "n", "fp", "low"))
    cells = nodes.where("n > 0").select("node", "n", F.explode("low").alias("cell"))
    counts = cut(cells.groupBy("cell").agg(F.count("*").alias("__n")).where("__n > 1"))
    shared = cut(join_hot(cells, counts.select("cell", F.col("__n").alias("rows")), "cell", counts=counts))
    sparse, crowded = shared.where(F.col("rows") <= CELL_ROWS), shared.where(F.col("rows") > CELL_ROWS)
    few = crowded.groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(4 * F.col("k") > F.least("n", F.lit(LOW))).select("node")
    crowd = cut(crowded.join(few, "node", "left_semi"))
    first = _centres(crowd)
    starred = join_hot(crowd.select("cell", F.col("node").alias("a"), F.col("n").alias("na")), first, "cell").select("a", "na", "b", "nb")
    candidates = _in_cells(sparse, sparse, F.col("x.node") < F.col("y.node")).union(starred).union(by_fingerprint(nodes))
    pairs = cut(_ordered(candidates))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct()
    keys = names.groupBy("node").agg(F.min("text_key").alias("text_key")).join(wanted, "node", "left_semi").select("text_key").distinct()
    texts = cut(names.groupBy("text_key").agg(F.count("*").alias("__n")))
    sets = cut(sets_of(docs, cut(keys), text_col, texts))
    edges = cut(similar(pairs, sets))
    roots = cut(connected(edges))
    if crowd.isEmpty():
        return roots
    rooted = cut(crowd.join(roots, "node", "left").select("cell", "node", "n", F.coalesce("root", "node").alias("root")))
    placed = cut(_in_mixed(rooted))
    if placed.isEmpty():
        return roots
    members = cut(rooted.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root")).join(placed, "node").join(sets.select("node", "shingles"), "node"))
    cells = cut(prefixes(members))
    counts = cut(cells.groupBy("cell").agg(F.count("*").alias("__n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi"))
    mixed = cut(join_hot(cells, counts.select("cell", F.col("__n").alias("rows")), "cell", counts=counts))
    few, dense = mixed.where(F.col("rows") <= CELL_ROWS), mixed.where(F.col("rows") > CELL_ROWS)
    candidates = _in_cells(few, few, (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _close())
    if not dense.isEmpty():
        banded = cut(bands(members.join(dense.select("node").distinct(), "node", "left_semi")))
        open_ = cut(join_hot(banded, _mixed(banded), "cell"))
        once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))  # where neither is of the main class
        candidates = candidates.union(_in_cells(open_.where("root <> main"), open_, (F.col("x.root") != F.col("y.root")) & once & _close()))
    rest = cut(_ordered(candidates))
    if rest.isEmpty():
        return roots
    return connected(_links_of(roots).union(similar(rest, sets)))


def prefixes(rows: DataFrame) -> DataFrame:
    """(cell, node, n, root) and parities, for the shingles of each set, rarest first among ``rows`` (node, n, root, shingles), of which two similar sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_py(), np.int64) for x in b.column(3)]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([], np.int64), *sets])), *(c.take(at) for c in (*b.columns[:3], *parities(sets)))], names=CELLED)

    every = cut(rows.select("node", "n", "root", "shingles").mapInArrow(run, ", ".join(f"{c} long" for c in CELLED)))
    counts = cut(every.groupBy("cell").agg(F.count("*").alias("__n")))
    known = join_hot(every, counts.select("cell", F.col("__n").alias("f")), "cell", counts=counts)
    place = F.row_number().over(Window.partitionBy("node").orderBy("f", "cell"))
    return known.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(4 * F.col("n") / 5) + 1).select(*CELLED)


def _centres(cells: DataFrame) -> DataFrame:
    """(cell, b, nb): a member of each cell, another one in another cell."""
    return cells.groupBy("cell").agg(F.min(F.struct(F.xxhash64("cell", "node"), "node", "n")).alias("m")).select("cell", F.col("m.node").alias("b"), F.col("m.n").alias("nb"))


def _links_of(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id, the smallest id of the row's class, for every row."""
    names = cut(named(docs, id_col, text_col))
    roots = cut(links(docs, names, text_col))
    held = cut(join_hot(names.select(id_col, "node"), roots, "node", "left").select(id_col, F.coalesce("root", "node").alias("root")))
    return join_hot(held, held.groupBy("root").agg(F.min(id_col).alias("component_id")), "root").select(id_col, "component_id")
