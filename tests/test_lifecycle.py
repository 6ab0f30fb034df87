"""Track lifecycles: the batch form against a plain loop, the stream against the batch form, late rows."""

import random
from datetime import datetime, timedelta, timezone

from annolens.operators import lifecycle
from annolens.streaming import track_lifecycle

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "stream long, frame long, object long, ts timestamp"


def rows(seed, streams=3, frames=40, objects=6):
    rng = random.Random(seed)
    out = []
    for s in range(streams):
        seen = {o: rng.random() < 0.5 for o in range(objects)}
        for f in range(frames):
            for o in range(objects):
                seen[o] = rng.random() < (0.8 if seen[o] else 0.15)
                if seen[o]:
                    out.append((s, f, o, START + timedelta(seconds=f)))
    return out


def plain(sightings, patience):
    out = []
    for s in {r[0] for r in sightings}:
        at = {}
        for _, f, o, _ in (r for r in sightings if r[0] == s):
            at.setdefault(f, set()).add(o)
        live, count = {}, 0
        for f in range(min(at), max(at) + 1):
            seen = at.get(f, set())
            for o, (track, last, lost) in list(live.items()):
                if f == last + 1 and o not in seen:
                    live[o] = track, last, True
                    out.append((s, f, o, track, "lost"))
                if f == last + patience + 1:
                    out.append((s, f, o, track, "removed"))
                    del live[o]
            for o in sorted(seen):
                if o not in live:
                    count += 1
                    out.append((s, f, o, count, "tracked"))
                    live[o] = count, f, False
                else:
                    if live[o][2]:
                        out.append((s, f, o, live[o][0], "tracked"))
                    live[o] = live[o][0], f, False
    return sorted(out)


def got(df):
    return sorted((r.stream, r.frame, r.object, r.track_id, r.state) for r in df.collect())


def test_batch_equals_a_plain_loop(spark):
    some = rows(1)
    df = spark.createDataFrame(some, SCHEMA)
    assert got(lifecycle.transitions(df, 3)) == plain(some, 3)
    assert got(lifecycle.transitions(df.union(df), 5)) == plain(some, 5)
    assert lifecycle.transitions(df.limit(0), 3).count() == 0


def test_stream_equals_batch(spark):
    some = rows(2, streams=2, frames=25)
    some += [(s, 25, 9, START + timedelta(seconds=25)) for s in range(2)]
    df = spark.createDataFrame(some, SCHEMA)
    out = got(track_lifecycle.from_table(spark, df, 3))
    assert out == got(lifecycle.transitions(df, 3))


def test_late_rows_are_dropped(spark, tmp_path):
    first = [(1, f, 1, START + timedelta(seconds=f)) for f in range(10)]
    late = [(1, 10, 1, START + timedelta(seconds=10)), (1, 5, 8, START + timedelta(seconds=5))]  # not late yet: the watermark of the batch before counts
    later = [(1, 2, 7, START + timedelta(seconds=2)), (1, 11, 1, START + timedelta(seconds=11))]
    end = [(1, 12, 1, START + timedelta(seconds=12))]
    for part in (first, late, later, end):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", track_lifecycle.STORE)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = track_lifecycle.transitions(stream, 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got(spark.read.schema(track_lifecycle.OUT).parquet(str(tmp_path / "out"))) == [(1, 0, 1, 1, "tracked"), (1, 5, 8, 2, "tracked"), (1, 6, 8, 2, "lost")]


class Kept:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        rows = self.rows
        return {
            "getValue": rows.get, "containsKey": rows.__contains__, "updateValue": rows.__setitem__, "removeKey": lambda k: rows.pop(k, None), "iterator": lambda: iter(list(rows.items())),
            "exists": lambda: () in rows, "get": lambda: rows[()], "update": lambda v: rows.__setitem__((), v),
        }[name]


def test_a_frame_does_not_ask_the_state_for_each_track():
    """the calls grow with frames and batches, not with sightings or live tracks, and no waiting sighting is written twice."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, set()

        def getMapState(self, name, *kinds):
            return self.states.setdefault(name, Kept())

        getValueState = getMapState

        def registerTimer(self, ms):
            self.timers.add(ms)

    class Due:
        def __init__(self, ms):
            self.getExpiryTimeInMs = lambda: ms

    some = rows(5, streams=1, frames=20, objects=1500)
    some += [(0, 20, 9999, START)]
    handle, life = Handle(), track_lifecycle.Lifecycle(3)
    life.init(handle)
    table = pd.DataFrame([(f, o, 1000 * f) for _, f, o, _ in some], columns=["frame", "object", "ms"]).sample(frac=1, random_state=0)
    list(life.handleInputRows((0,), iter([table[i : i + 1000] for i in range(0, len(table), 1000)]), None))
    out = [r for ms in sorted(handle.timers) for t in life.handleExpiredTimer((0,), None, Due(ms)) for r in t.itertuples(index=False, name=None)]
    assert sorted((*r[:4], ("tracked", "lost", "removed")[r[4] - 1]) for r in out) == plain(some, 3)
    assert sum(x.calls for x in handle.states.values()) < 600
