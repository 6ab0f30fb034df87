"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line with white space stripped and A-Z lower-cased, held as a
128-bit hash. Documents arrive in batches. A batch's keys are counted by document,
merge-anti-joined with the run of settled keys (those already found in enough
documents), and added as a run of level 0. When a level holds FAN_OUT runs they are
merged, counts adding up, into one run of the next level, and keys that reach the
threshold join the settled run. After the last batch everything is merged; the
settled keys are the frequent lines.

A run is a table bucketed and sorted by key. All runs have the same buckets, so the
anti-join and the compaction, two runs at a time, are merges bucket by bucket without
a shuffle of any run; only a batch's own counts are dealt to the buckets, once. A
table that is there at once is dealt into BATCHES arrivals.

``drop_frequent`` then removes their lines. Up to BROADCAST_KEYS settled keys (their
number is checked) go to every task; beyond that, each document's keys are semi-joined
with the runs and its frequent keys joined back to it. Both ways give the same rows.

Cases: null or empty text is one empty line, kept; a blank line has an empty key and
is never dropped; a document is a row, so repeated rows count one each; a line that a
document repeats counts once; extra columns stay, but for those named n_lines or n_dropped,
which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm._common import cut, remove, shared_dir

FAN_OUT = 2
BATCHES = 8
BROADCAST_KEYS = 100_000  # about 10 MB in a worker
KEYS = ["h1", "h2"]
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes | None:
    """16 bytes for a line's key; None for an empty key."""
    from xxhash import xxh3_128_digest

    key = line.strip().lower()
    return xxh3_128_digest(key) if key else None


def line_keys(docs: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """``key_cols`` and (h1, h2) for every distinct line key of every row."""
    n = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for i, text in enumerate(b.column(n)):
                own = set(map(line_key, (text.as_py() or "").encode().split(b"\n")))
                own.discard(None)
                rows += [i] * len(own)
                keys += own
            pair = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(n)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=[*key_cols, *KEYS])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in key_cols]
    return docs.select(*key_cols, text_col).mapInArrow(run, ", ".join([*kinds, "h1 long, h2 long"]))


class LineRuns:
    """Runs of (h1, h2, n documents), tables bucketed and sorted by key, in levels, and the settled run of frequent keys."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10):
        self.spark, self.path, self.min_docs = spark, path or shared_dir(spark), min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.settled: str | None = None
        self.before = spark.conf.get(ORDERED, None)
        spark.conf.set(ORDERED, "true")  # a bucket is one sorted file

    def close(self) -> None:
        """Take all runs out of the catalogue and of the folder, and set the session as it was."""
        for run in [*(r for level in self.levels for r in level), *([self.settled] if self.settled else [])]:
            self._drop(run)
        self.levels, self.settled = [], None
        if self.before is None:
            self.spark.conf.unset(ORDERED)
        else:
            self.spark.conf.set(ORDERED, self.before)

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        run = f"{self.name}_{self.made}"
        df.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.path}/{run}").option("compression", "zstd").saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        remove(self.spark, f"{self.path}/{run}")

    def add(self, counts: DataFrame) -> None:
        """Add one batch: (h1, h2, n), a row for each key."""
        counts = counts.repartition(self.buckets, *KEYS)
        if self.settled:
            counts = counts.join(self.spark.table(self.settled).hint("merge"), KEYS, "left_anti")
        self._place(0, self._write(counts))

    def _place(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_OUT:
            runs, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._merge(runs))

    def _both(self, a: str, b: str | DataFrame, n) -> DataFrame:
        """The keys of two runs, by a merge of their buckets; ``n`` makes one count of both."""
        x, y = self.spark.table(a), b if isinstance(b, DataFrame) else self.spark.table(b)
        joined = x.withColumnRenamed("n", "a").join(y.withColumnRenamed("n", "b"), KEYS, "full")
        return joined.select(*KEYS, n(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("n"))

    def _merge(self, runs: list[str]) -> str:
        """One run from several; keys at the threshold join the settled run."""
        merged = runs[0]
        for r in runs[1:]:
            a, merged = merged, self._write(self._both(merged, r, lambda x, y: x + y))
            self._drop(a)
            self._drop(r)
        found = self.spark.table(merged).where(F.col("n") >= self.min_docs)
        before, self.settled = self.settled, self._write(self._both(self.settled, found, F.greatest) if self.settled else found)
        if before:
            self._drop(before)
        return merged

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches; merges what is left."""
        left = [r for level in self.levels for r in level]
        self.levels = [[self._merge(left)]] if left else []
        return self.spark.table(self.settled).select(*KEYS) if self.settled else self.spark.createDataFrame([], "h1 long, h2 long")


def frequent_lines(docs: DataFrame, min_docs: int = 10, text_col: str = "text") -> DataFrame:
    """(h1, h2) of the line keys of ``docs`` found in at least ``min_docs`` rows.

    The arrivals are dealt by a hash of the text and counted in one scan.
    """
    spark = docs.sparkSession
    incoming = shared_dir(spark)
    text = docs.select(F.pmod(F.xxhash64(text_col), F.lit(BATCHES)).cast("int").alias("batch"), F.col(text_col).alias("text"))
    counted = line_keys(text, ["batch"]).groupBy("batch", *KEYS).agg(F.count("*").alias("n"))
    counted.write.partitionBy("batch").option("compression", "zstd").parquet(incoming)
    runs = LineRuns(spark, min_docs=min_docs)
    arrived = spark.read.schema("h1 long, h2 long, n long, batch int").parquet(incoming)
    for k in range(BATCHES):
        runs.add(arrived.where(F.col("batch") == k).drop("batch"))
    found = cut(runs.frequent())
    runs.close()
    remove(spark, incoming)
    return found


def _strip(text: str | None, frequent) -> tuple[str, int, int]:
    lines = (text or "").encode().split(b"\n")
    kept = [x for x in lines if line_key(x) not in frequent]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def drop_frequent(docs: DataFrame, min_docs: int = 10, text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with frequent lines cut from ``text_col``, and n_lines and n_dropped added."""
    docs = docs.drop("n_lines", "n_dropped")
    frequent = frequent_lines(docs, min_docs, text_col)
    names = docs.columns
    at = names.index(text_col)

    def replaced(b: pa.RecordBatch, sets) -> pa.RecordBatch:
        rows = [_strip(t.as_py(), s) for t, s in zip(b.column(at), sets)]
        cols = list(b.columns[: len(names)])
        cols[at] = pa.array([r[0] for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, n_dropped long"])
    if frequent.count() <= broadcast_keys:
        keys = docs.sparkSession.sparkContext.broadcast(frozenset(np.array([r.h1, r.h2], ">i8").tobytes() for r in frequent.toLocalIterator()))

        def run(batches):
            every = keys.value
            for b in batches:
                yield replaced(b, (every for _ in range(b.num_rows)))

        return docs.mapInArrow(run, schema)

    # rows are named by two hashes of the text, which alone decides on its lines
    row = [F.xxhash64(text_col).alias("__r1"), F.xxhash64(F.lit(1), text_col).alias("__r2")]
    named = docs.select("*", *row)
    hits = line_keys(named.select("__r1", "__r2", text_col), ["__r1", "__r2"], text_col).join(frequent, KEYS, "left_semi")
    per_row = hits.groupBy("__r1", "__r2").agg(F.collect_set(F.struct(*KEYS)).alias("__keys"))
    joined = named.join(per_row, ["__r1", "__r2"], "left").select(*names, "__keys")

    def run_joined(batches):
        for b in batches:
            sets = ({np.array([k["h1"], k["h2"]], ">i8").tobytes() for k in ks or ()} for ks in b.column(len(names)).to_pylist())
            yield replaced(b, sets)

    return joined.mapInArrow(run_joined, schema)
