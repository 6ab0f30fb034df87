"""Analytics over tracked objects (stream, track_id, frame, x, y, cls): lines, regions, speeds, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions.geometry import in_points, in_polygon, segments_meet

TRACK = ["stream", "track_id"]


def with_previous(tracks: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Add px, py: the track's point one row before."""
    w = Window.partitionBy(*keys).orderBy("frame")
    return tracks.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})


def history(tracks: DataFrame, n: int = 30, keys: list[str] = TRACK) -> DataFrame:
    """Add ``trail``: the last ``n`` points including the row's own."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(n - 1), 0)
    return tracks.withColumn("trail", F.collect_list(F.struct("x", "y")).over(w))


def _in_out(vertical: bool) -> Column:
    forward = F.col("x") > F.col("px") if vertical else F.col("y") > F.col("py")
    return F.when(forward, "IN").otherwise("OUT")


def count_crossings(tracks: DataFrame, region: list[tuple[float, float]], keys: list[str] = TRACK) -> DataFrame:
    """(cls, direction, n): each track counts once, when its step first meets a line (two points; touching counts) or it is first seen inside a polygon, not on its edge, with a point before."""
    steps = with_previous(tracks, keys).where("px IS NOT NULL")
    xs, ys = [p[0] for p in region], [p[1] for p in region]
    if len(region) == 2:
        (ax, ay), (bx, by) = region
        hit = segments_meet(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.lit(float(ax)), F.lit(float(ay)), F.lit(float(bx)), F.lit(float(by)))
        vertical = abs(ax - bx) < abs(ay - by)
    else:
        hit = in_polygon(F.col("x"), F.col("y"), region)
        vertical = max(xs) - min(xs) < max(ys) - min(ys)
    first = steps.where(hit).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))).where("__n = 1")
    return first.groupBy("cls", _in_out(vertical).alias("direction")).agg(F.count("*").alias("n"))


def region_occupancy(tracks: DataFrame, regions: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(frame, region, n) for every frame and region, zero-filled. Regions are literals, so there is no join."""
    flags = [F.sum(F.when(in_polygon(F.col("x"), F.col("y"), p), 1).otherwise(0)).alias(name) for name, p in regions.items()]
    wide = tracks.groupBy("frame").agg(*flags)
    return wide.unpivot(["frame"], list(regions), "region", "n")


def queue_counts(tracks: DataFrame, region: list[tuple[float, float]], keys: list[str] = TRACK) -> DataFrame:
    """(frame, n): points inside the region of tracks seen before; zero-filled over frames."""
    inside = in_polygon(F.col("x"), F.col("y"), region) & F.col("px").isNotNull()
    return with_previous(tracks, keys).groupBy("frame").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("n"))


def slot_occupancy(tracks: DataFrame, slots: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(frame, occupied, available): slots with any whole-pixel point inside or on their edge."""
    whole = lambda v: v.cast("long") if hasattr(v, "cast") else int(v)
    taken = [F.max(F.when(in_polygon(whole(F.col("x")), whole(F.col("y")), [(whole(x), whole(y)) for x, y in p], boundary=True), 1).otherwise(0)) for p in slots.values()]
    occupied = taken[0]
    for t in taken[1:]:
        occupied = occupied + t
    return tracks.groupBy("frame").agg(occupied.alias("occupied")).withColumn("available", F.lit(len(slots)) - F.col("occupied"))


def speeds(tracks: DataFrame, fps: float = 30.0, metres: float = 0.05, points: int = 5, most: int = 120, keys: list[str] = TRACK) -> DataFrame:
    """(keys, speed): whole km/h from the first to the ``points``-th point of each track that has as many."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    ends = tracks.withColumn("__n", n).where(F.col("__n").isin(1, points))
    at = lambda c, k: F.max(F.when(F.col("__n") == k, F.col(c)))
    both = ends.groupBy(*keys).agg(*[at(c, k).alias(f"{c}{i}") for c in ("x", "y", "frame") for i, k in enumerate((1, points))]).where("frame1 IS NOT NULL")
    metre = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) * metres
    kmh = metre / ((F.col("frame1") - F.col("frame0")) / fps) * 3.6
    return both.select(*keys, F.floor(F.least(kmh, F.lit(float(most)))).cast("int").alias("speed"))


def repetitions(angles: DataFrame, up: float = 145.0, down: float = 90.0, keys: list[str] = TRACK) -> DataFrame:
    """(keys, n): times the angle fell below ``down`` after it had risen above ``up``."""
    w = Window.partitionBy(*keys).orderBy("frame")
    stage = F.when(F.col("angle") < down, "down").when(F.col("angle") > up, "up")
    before = F.last("stage", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return angles.withColumn("stage", stage).withColumn("before", before).groupBy(*keys).agg(F.sum(F.when((F.col("stage") == "down") & (F.col("before") == "up"), 1).otherwise(0)).alias("n"))


def series(tracks: DataFrame, every: int = 30, keep: int = 45, by_class: bool = False, pad: bool = False) -> DataFrame:
    """(frame[, cls], n) of every ``every``-th frame, the last ``keep`` of them; with ``pad`` a class has 0 in frames without it."""
    keys = ["frame", "cls"] if by_class else ["frame"]
    counted = tracks.where(F.col("frame") % every == 0).groupBy(*keys).agg(F.count("*").alias("n"))
    last = counted.select("frame").distinct().orderBy(F.desc("frame")).limit(keep)
    shown = counted.join(F.broadcast(last), "frame", "left_semi")
    if not (by_class and pad):
        return shown
    classes = shown.agg(F.collect_set("cls").alias("c"))  # one row of class names
    return last.join(F.broadcast(classes)).select("frame", F.explode("c").alias("cls")).join(shown, keys, "left").na.fill(0, ["n"])


def heat_grid(boxes: DataFrame, cell: int, radius: str = "r", gain: int = 2) -> DataFrame:
    """(gx, gy, heat): ``gain`` for each box whose disc (x, y, radius) covers the cell's corner."""
    r = F.col(radius)
    span = lambda c: F.explode(F.sequence(F.ceil((F.col(c) - r) / cell).cast("int"), F.floor((F.col(c) + r) / cell).cast("int")))
    cells = boxes.withColumn("gx", span("x")).withColumn("gy", span("y"))
    inside = F.pow(F.col("gx") * cell - F.col("x"), 2) + F.pow(F.col("gy") * cell - F.col("y"), 2) <= r * r
    return cells.where(inside).groupBy("gx", "gy").agg((F.count("*") * gain).alias("heat"))


def first_alarm(tracks: DataFrame, records: int = 5, by: list[str] | None = None) -> DataFrame:
    """The first frame with ``records`` detections or more."""
    keys = by or []
    busy = tracks.groupBy(*keys, "frame").agg(F.count("*").alias("n")).where(F.col("n") >= records)
    group = busy.groupBy(*keys) if keys else busy.groupBy()
    return group.agg(F.min("frame").alias("frame"), F.min_by("n", "frame").alias("n"))


def pair_distance(tracks: DataFrame, one: Column, other: Column) -> DataFrame:
    """(frame, distance) of the whole-number centroids of two chosen tracks in the frames both are in."""
    a = tracks.where(one).select("frame", F.floor("x").alias("ax"), F.floor("y").alias("ay"))
    b = tracks.where(other).select("frame", F.floor("x").alias("bx"), F.floor("y").alias("by"))
    return a.join(b, "frame").select("frame", F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)).alias("distance"))


def latest_only(frames: DataFrame, key: str = "stream") -> DataFrame:
    """Each stream's row of the largest frame: what remains when stale frames are dropped."""
    return frames.groupBy(key).agg(F.max_by(F.struct(*[c for c in frames.columns if c != key]), "frame").alias("__r")).select(key, "__r.*")


def observation_before(tracks: DataFrame, delta: int, keys: list[str] = TRACK) -> DataFrame:
    """Add ox, oy: the track's latest point at least ``delta`` frames back, or its earliest point before the row."""
    w = Window.partitionBy(*keys).orderBy("frame")
    far = w.rangeBetween(Window.unboundedPreceding, -delta)
    past = w.rangeBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last(F.struct("x", "y")).over(far), F.first(F.struct("x", "y")).over(past))
    return tracks.withColumn("__o", found).withColumns({"ox": F.col("__o.x"), "oy": F.col("__o.y")}).drop("__o")


def slots_by_file(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """``slot_occupancy`` for slots of a table (region, points) as ``sources.annotations.read_regions`` gives; regions are few and broadcast."""
    held = tracks.join(F.broadcast(regions)).where(in_points(F.col("x").cast("long"), F.col("y").cast("long"), F.col("points"), boundary=True))
    taken = held.groupBy("frame").agg(F.countDistinct("region").alias("occupied"))
    slots = regions.agg(F.count("*").alias("slots"))
    every = tracks.select("frame").distinct().join(taken, "frame", "left").join(F.broadcast(slots))
    return every.select("frame", F.coalesce("occupied", F.lit(0)).alias("occupied"), (F.col("slots") - F.coalesce("occupied", F.lit(0))).alias("available"))


def inside_zone(tracks: DataFrame, region: list[tuple[float, float]]) -> DataFrame:
    """The points inside a zone: what a tracker sees of a masked frame."""
    return tracks.where(in_polygon(F.col("x"), F.col("y"), region, boundary=True))
