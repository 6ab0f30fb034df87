"""Tracks over time: an object that is seen is tracked, one that is missed is lost, one lost too long is removed.

Sightings are stream, frame, object (what an association calls it). A track starts when an object is
first seen, or seen again after its track was removed; ids count up by stream in order of first frame,
then object. A frame that a stream has is one in which any of its objects is seen; in other
numbers nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tracks(sightings: DataFrame, patience: int = 30) -> DataFrame:
    """Sightings with track_id, start (the track's first frame) and gap (frames since the last sighting, null at a start).

    A track is removed once its object has not been seen for more than ``patience`` frames. Ids come from
    counts by stream and start frame, so no task numbers all tracks of a stream.
    """
    one = sightings.select("stream", "frame", "object").distinct()
    w = Window.partitionBy("stream", "object").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    gone = gap.isNull() | (gap > patience)
    seen = one.withColumn("gap", F.when(~gone, gap)).withColumn("start", F.last(F.when(F.col("gap").isNull(), F.col("frame")), True).over(w))
    starts = seen.where("gap IS NULL").select("stream", "object", "start")
    per_frame = starts.groupBy("stream", "start").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("stream").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each frame with a start
    before = per_frame.select("stream", "start", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("stream", "start").orderBy("object"))
    ids = starts.withColumn("place", place).join(before, ["stream", "start"]).select("stream", "object", "start", (F.col("before") + F.col("place")).alias("track_id"))
    return seen.join(ids, ["stream", "object", "start"]).select("stream", "object", "frame", "track_id", "start", "gap")


def transitions(sightings: DataFrame, patience: int = 30) -> DataFrame:
    """(stream, frame, object, track_id, state) whenever a track's state changes: tracked, lost, removed.

    A track is lost in the frame after its last sighting and removed ``patience`` frames after that. Changes later than
    a stream's last frame have not happened yet.
    """
    found = tracks(sightings, patience)
    after = F.lead("frame").over(Window.partitionBy("stream", "track_id").orderBy("frame"))
    end = sightings.groupBy("stream").agg(F.max("frame").alias("end"))
    held = found.withColumn("after", after).join(F.broadcast(end), "stream")  # one row a stream

    def change(when: Column, frame: Column, state: str) -> Column:
        return F.when(when & (frame <= F.col("end")), F.struct(frame.alias("frame"), F.lit(state).alias("state")))

    frame, missed = F.col("frame"), F.col("after").isNull() | (F.col("after") > F.col("frame") + 1)
    changes = F.array(
        change(F.col("gap").isNull() | (F.col("gap") > 1), frame, "tracked"),
        change(missed, frame + 1, "lost"),
        change(F.col("after").isNull(), frame + patience + 1, "removed"),
    )
    return held.select("stream", "object", "track_id", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("stream", "c.frame", "object", "track_id", "c.state")
