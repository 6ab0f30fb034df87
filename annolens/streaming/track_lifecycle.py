"""The life of tracks on a stream: one state for each stream, which holds its live tracks only.

Sightings wait in the state until the watermark has passed their time; then frames are taken in order,
so the result is that of ``operators.lifecycle`` on all sightings that were not late. A sighting
behind the watermark is late and dropped. Tracks leave the state when they are removed, so it grows with
the objects in sight, not with the length of the stream. A timer goes off when the watermark passes a
waiting sighting.

State values are packed arrays of whole numbers: sightings of one time as they come, so that none is
written twice, and live tracks by object in pieces of PIECE, read and written once a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annolens.sources.folders import scratch, written

OUT = "stream long, frame long, object long, track_id long, state string"
CODED = "stream long, frame long, object long, track_id long, code long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACKED, LOST, REMOVED = 1, 2, 3


PIECE = 1 << 15


def _table(rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream", "frame", "object", "track_id", "code"], dtype="int64")


def _unpacked(value: tuple, columns: int) -> np.ndarray:
    return np.frombuffer(bytes(value[0]), "<i8").reshape(-1, columns)


class Lifecycle(StatefulProcessor):
    """States: sightings that wait, by time; live tracks (object, id, last frame, state) by object; the last id and frame."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, piece long", "sightings binary")
        self.pieces = handle.getMapState("pieces", "ms long", "n long")
        self.live = handle.getMapState("live", "piece long", "tracks binary")
        self.count = handle.getValueState("count", "track_id long, frame long, pieces long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some, n = [], 0
        for batch in rows:
            some.append(batch[["ms", "frame", "object"]].to_numpy("int64"))
            n += len(batch)
            if n >= PIECE:
                self._wait(np.concatenate(some))
                some, n = [], 0
        if n:
            self._wait(np.concatenate(some))
        yield _table(np.zeros((0, 5), np.int64))

    def _wait(self, rows: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        times, first = np.unique(rows[:, 0], return_index=True)
        for ms, part in zip(times.tolist(), np.split(rows[:, 1:], first[1:])):
            n = self.pieces.getValue((ms,))[0] if self.pieces.containsKey((ms,)) else 0
            self.waiting.updateValue((ms, n), (np.ascontiguousarray(part, "<i8").tobytes(),))
            self.pieces.updateValue((ms,), (n + 1,))
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()  # timers go off in order of time
        found = []
        for k in range(self.pieces.getValue((ms,))[0]):
            found.append(_unpacked(self.waiting.getValue((ms, k)), 2))
            self.waiting.removeKey((ms, k))
        self.pieces.removeKey((ms,))
        rows = np.concatenate(found)
        last_id, last_frame, held = self.count.get() if self.count.exists() else (0, None, 0)
        live = np.concatenate([np.zeros((0, 4), np.int64), *(_unpacked(self.live.getValue((k,)), 4) for k in range(held))])
        for frame in np.unique(rows[:, 0]).tolist():
            if last_frame is not None and frame < last_frame:
                continue
            out, live, last_id = self._frame(live, last_id, frame, np.unique(rows[rows[:, 0] == frame, 1]))
            last_frame = frame
            yield _table(np.insert(out, 0, int(key[0]), axis=1))
        n = -(-len(live) // PIECE)
        for k in range(n):
            self.live.updateValue((k,), (np.ascontiguousarray(live[k * PIECE : (k + 1) * PIECE], "<i8").tobytes(),))
        for k in range(n, held):
            self.live.removeKey((k,))
        self.count.update((last_id, last_frame, n))

    def _frame(self, live: np.ndarray, last_id: int, frame: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Changes up to and in ``frame``, then the live tracks and the last id: changes of missed tracks first fell due in earlier frames."""

        def changes(frames, rows, code):
            return np.stack([np.broadcast_to(frames, len(rows)), rows[:, 0], rows[:, 1], np.full(len(rows), code)], axis=1)

        live = live.copy()
        obj, last = live[:, 0], live[:, 2]
        lost = (live[:, 3] == TRACKED) & ((last + 1 < frame) | (last + 1 == frame) & ~np.isin(obj, seen))
        out = [changes(last[lost] + 1, live[lost], LOST)]
        live[lost, 3] = LOST
        gone = (live[:, 3] == LOST) & (last + self.patience + 1 <= frame)
        out.append(changes(last[gone] + self.patience + 1, live[gone], REMOVED))
        live = live[~gone]
        new = np.setdiff1d(seen, live[:, 0], assume_unique=True)
        started = np.stack([new, last_id + 1 + np.arange(len(new)), np.full(len(new), frame), np.full(len(new), LOST)], axis=1)
        live = np.concatenate([live, started])
        live = live[np.argsort(live[:, 0], kind="stable")]
        here = np.isin(live[:, 0], seen, assume_unique=True)
        out.append(changes(frame, live[here & (live[:, 3] == LOST)], TRACKED))
        live[here, 2:] = frame, TRACKED
        return np.concatenate(out), live, last_id + len(new)

    def close(self) -> None:
        pass


def transitions(sightings: DataFrame, patience: int = 30, delay: str = "0 seconds") -> DataFrame:
    """Changes of state from a stream of stream, frame, object, ts; rows more than ``delay`` behind the newest are late.

    Frames of one stream follow the order of ts. The session needs the state store of STORE.
    """
    timed = sightings.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    found = timed.groupBy("stream").transformWithStateInPandas(Lifecycle(patience), CODED, "Append", "EventTime")
    name = F.get(F.array(*map(F.lit, ("tracked", "lost", "removed"))), F.col("code").cast("int") - 1)
    return found.select("stream", "frame", "object", "track_id", name.alias("state"))


def from_table(spark: SparkSession, source: DataFrame, patience: int, parts: int = 4, files: int = 2) -> DataFrame:
    """Run the stream over a table of sightings, in ``parts`` by time of ``files`` files each, to its end.

    Rows within a part come in any order, so the delay is the longest part's; a last row of a
    stream of its own (-1) moves the watermark past all others.
    """
    here = scratch(spark)
    source = written(source)
    timed = source.withColumn("__at", F.unix_seconds("ts"))
    ends = timed.approxQuantile("__at", [i / parts for i in range(parts + 1)], 0.01)
    if not ends:
        return spark.createDataFrame([], OUT)
    edges = sorted(set(map(int, ends)))
    bounds = list(zip(edges, [*edges[1:], None]))
    for low, high in bounds:
        part = timed.where((F.col("__at") >= low if low != edges[0] else F.lit(True)) & (F.col("__at") < high if high is not None else F.lit(True)))
        part.drop("__at").repartition(files, "stream").write.mode("append").parquet(f"{here}/in")
    least, most = timed.agg(F.min("__at"), F.max("__at")).first()
    delay = max([b - a for a, b in zip([least, *edges[1:]], [*edges[1:], most])]) + 1
    last = spark.range(1).select(F.lit(-1).cast("long").alias("stream"), F.lit(0).cast("long").alias("frame"), F.lit(0).cast("long").alias("object"), F.timestamp_seconds(F.lit(most + 2 * delay)).alias("ts"))
    last.select(*[F.col(f.name).cast(f.dataType) for f in source.schema]).write.mode("append").parquet(f"{here}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{here}/in")
        run = transitions(stream, patience, f"{delay} seconds").writeStream.format("parquet").option("path", f"{here}/out").option("checkpointLocation", f"{here}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).parquet(f"{here}/out").where("stream <> -1")
