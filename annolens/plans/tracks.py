"""Queries over tracked points and run logs made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolens.operators import runlog, zones
from annolens.plans import views
from annolens.plans.boxes import _six
from annolens.plans.views import TRACKS, registry
from annolens.streaming import zone_counts

QUERIES, ORACLE_SQL, query = registry()


LINE = [(320.0, -1.0), (320.0, 481.0)]
ZONE = [(100.0, 50.0), (400.0, 50.0), (400.0, 300.0), (100.0, 300.0)]
_PREV = "prev AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame))"
_INZONE = "(x > 100 AND x < 400 AND y > 50 AND y < 300)"
_SLOTS = "max(CASE WHEN x BETWEEN 100 AND 400 AND y BETWEEN 50 AND 300 THEN 1 ELSE 0 END) + max(CASE WHEN x <= 320 THEN 1 ELSE 0 END)"


@query(
    """SELECT cls, CASE WHEN x > px THEN 'IN' ELSE 'OUT' END AS direction, count(*) AS n FROM (SELECT * FROM prev WHERE px IS NOT NULL AND (px - 320) * (x - 320) <= 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame) = 1) GROUP BY ALL""",
    TRACKS,
    _PREV,
)
def zone_in_out_counts(spark, sf_dir):
    return zones.count_crossings(views.tracks(spark, sf_dir), LINE)


@query(f"SELECT frame, 'left' AS region, count(*) FILTER (x < 320) AS n FROM tracks GROUP BY frame UNION ALL SELECT frame, 'zone', count(*) FILTER ({_INZONE}) FROM tracks GROUP BY frame", TRACKS)
def region_occupancy(spark, sf_dir):
    left = [(-1.0, -1.0), (320.0, -1.0), (320.0, 481.0), (-1.0, 481.0)]
    return zones.region_occupancy(views.tracks(spark, sf_dir), {"left": left, "zone": ZONE})


@query(f"SELECT frame, count(*) FILTER ({_INZONE} AND px IS NOT NULL) AS n FROM prev GROUP BY frame", TRACKS, _PREV)
def queue_count(spark, sf_dir):
    return zones.queue_counts(views.tracks(spark, sf_dir), ZONE)


@query(f"SELECT frame, {_SLOTS} AS occupied, 2 - ({_SLOTS}) AS available FROM tracks GROUP BY frame", TRACKS)
def slot_occupancy(spark, sf_dir):
    left = [(-1.0, -1.0), (320.0, -1.0), (320.0, 481.0), (-1.0, 481.0)]
    return zones.slot_occupancy(views.tracks(spark, sf_dir), {"zone": ZONE, "left": left})


@query(
    """SELECT a.track_id, floor(least(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) * 0.05 / ((b.frame - a.frame) / 30.0::DOUBLE) * 3.6, 120.0))::INTEGER AS speed FROM tracks a JOIN tracks b ON a.track_id = b.track_id AND a.frame = 1 AND b.frame = 5""",
    TRACKS,
)
def speed_estimate(spark, sf_dir):
    return zones.speeds(views.tracks(spark, sf_dir)).select("track_id", "speed")


@query(
    """SELECT track_id, sum(CASE WHEN stage = 'down' AND before = 'up' THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT *, last_value(stage IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
    SELECT track_id, frame, CASE WHEN x % 180 < 90 THEN 'down' WHEN x % 180 > 145 THEN 'up' END AS stage FROM tracks)) GROUP BY track_id""",
    TRACKS,
)
def repetition_count(spark, sf_dir):
    return zones.repetitions(views.tracks(spark, sf_dir).withColumn("angle", F.col("x") % 180)).select("track_id", "n")


@query("SELECT frame, cls, count(*) AS n FROM tracks WHERE frame % 5 = 0 AND frame IN (SELECT DISTINCT frame FROM tracks WHERE frame % 5 = 0 ORDER BY frame DESC LIMIT 45) GROUP BY ALL", TRACKS)
def series_by_frame(spark, sf_dir):
    return zones.series(views.tracks(spark, sf_dir), every=5, by_class=True)


@query(
    """SELECT f.frame, c.cls, coalesce(n, 0) AS n FROM (SELECT DISTINCT frame FROM shown) f CROSS JOIN (SELECT DISTINCT cls FROM shown) c LEFT JOIN (SELECT frame, cls, count(*) AS n FROM shown GROUP BY ALL) s ON s.frame = f.frame AND s.cls = c.cls""",
    TRACKS,
    "shown AS (SELECT frame, cls FROM tracks WHERE frame % 5 = 0 AND frame IN (SELECT DISTINCT frame FROM tracks WHERE frame % 5 = 0 ORDER BY frame DESC LIMIT 45))",
)
def series_padded(spark, sf_dir):
    """The feature is the last 45 of every fifth frame, classes that a frame lacks at 0."""
    return zones.series(views.tracks(spark, sf_dir), every=5, by_class=True, pad=True)


@query(
    """SELECT gx, gy, count(*) * 2 AS heat FROM (SELECT x, y, gx, unnest(range(ceil((y - 24) / 16)::INTEGER, floor((y + 24) / 16)::INTEGER + 1)) AS gy FROM (
    SELECT x, y, unnest(range(ceil((x - 24) / 16)::INTEGER, floor((x + 24) / 16)::INTEGER + 1)) AS gx FROM tracks)) WHERE pow(gx * 16 - x, 2) + pow(gy * 16 - y, 2) <= 576 GROUP BY ALL""",
    TRACKS,
)
def heat_grid(spark, sf_dir):
    out = zones.heat_grid(views.tracks(spark, sf_dir).withColumn("r", F.lit(24.0)), 16)
    return out.select(F.col("gx").cast("long"), F.col("gy").cast("long"), "heat")


@query("SELECT cls, min(frame) AS frame, arg_min(n, frame) AS n FROM (SELECT cls, frame, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) >= 5) GROUP BY cls", TRACKS)
def first_alarm(spark, sf_dir):
    out = zones.first_alarm(views.tracks(spark, sf_dir), by=["cls"])
    return out.select("cls", F.col("frame").cast("long"), "n")


@query("SELECT a.frame, round(sqrt(pow(floor(a.x) - floor(b.x), 2) + pow(floor(a.y) - floor(b.y), 2)), 6) AS distance FROM tracks a JOIN tracks b USING (frame) WHERE a.track_id = 1 AND b.track_id = 2", TRACKS)
def pair_distance(spark, sf_dir):
    return _six(zones.pair_distance(views.tracks(spark, sf_dir), F.col("track_id") == 1, F.col("track_id") == 2), "distance")


@query("SELECT track_id, frame, [x, y] AS at FROM tracks QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) = 1", TRACKS)
def latest_frame(spark, sf_dir):
    return zones.latest_only(views.tracks(spark, sf_dir), "track_id").select("track_id", "frame", F.array("x", "y").alias("at"))


@query(
    """SELECT t.track_id, t.frame, coalesce(arg_max(o.x, o.frame) FILTER (o.frame <= t.frame - 3), arg_min(o.x, o.frame)) AS ox, coalesce(arg_max(o.y, o.frame) FILTER (o.frame <= t.frame - 3), arg_min(o.y, o.frame)) AS oy
    FROM tracks t LEFT JOIN tracks o ON o.track_id = t.track_id AND o.frame < t.frame GROUP BY ALL""",
    TRACKS,
)
def observation_before(spark, sf_dir):
    return zones.observation_before(views.tracks(spark, sf_dir), 3).select("track_id", "frame", "ox", "oy")


_LOG = "log AS (SELECT track_id AS run, frame AS epoch, x AS fitness, y AS loss FROM tracks)"


def _log(spark, sf_dir):
    return views.tracks(spark, sf_dir).select(F.col("track_id").alias("run"), F.col("frame").alias("epoch"), F.col("x").alias("fitness"), F.col("y").alias("loss"))


@query("SELECT run, epoch, fitness FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY fitness DESC, epoch) = 1", TRACKS, _LOG)
def runlog_best_epoch(spark, sf_dir):
    return runlog.best_epoch(_log(spark, sf_dir), "fitness")


@query(
    """SELECT run, epoch, round(sum(w * v) / (SELECT sum(exp(-0.5 * pow(range / 3.0, 2))) FROM range(-12, 13)), 6) AS smooth FROM (SELECT run, epoch, k.range AS k, exp(-0.5 * pow(k.range / 3.0, 2)) AS w, n, ((epoch + k.range - 1) % (2 * n) + 2 * n) % (2 * n) AS f
    FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM log), range(-12, 13) k) a JOIN (SELECT run, epoch AS s, fitness AS v FROM log) b USING (run) WHERE s = CASE WHEN f < n THEN f ELSE 2 * n - 1 - f END + 1 GROUP BY ALL""",
    TRACKS,
    _LOG,
)
def runlog_smooth(spark, sf_dir):
    return _six(runlog.gaussian_smooth(_log(spark, sf_dir), "fitness").select("run", "epoch", "smooth"), "smooth")


_CLIP = "{b} AS (SELECT run, epoch, fitness FROM (SELECT *, avg(fitness) OVER (PARTITION BY run) AS m, stddev_pop(fitness) OVER (PARTITION BY run) AS d FROM {a}) WHERE fitness >= m - 1.5 * d AND fitness <= m + 1.5 * d)"


@query("SELECT run, count(*) AS n, round(avg(fitness), 6) AS mean FROM c3 GROUP BY run", TRACKS, _LOG, *[_CLIP.format(a=a, b=b) for a, b in (("log", "c1"), ("c1", "c2"), ("c2", "c3"))])
def sigma_clip(spark, sf_dir):
    kept = runlog.sigma_clip(_log(spark, sf_dir), "fitness", sigma=1.5, by=["run"])
    return kept.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("fitness"), 6).alias("mean"))


@query("SELECT run, round(regr_slope(loss, epoch), 6) AS slope, round(regr_intercept(loss, epoch), 6) AS intercept FROM log GROUP BY run HAVING count(*) > 1", TRACKS, _LOG)
def linear_fit(spark, sf_dir):
    log = _log(spark, sf_dir)
    many = log.groupBy("run").count().where("count > 1").select("run")
    return _six(runlog.linear_fit(log.join(many, "run", "left_semi"), "epoch", "loss", ["run"]), "slope", "intercept")


@query(
    """SELECT run, min(epoch) FILTER (epoch - b >= 5) AS stop FROM (SELECT run, epoch, -(max({'v': fitness, 'e': -epoch}) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)).e AS b FROM log) GROUP BY run""",
    TRACKS,
    _LOG,
)
def early_stop(spark, sf_dir):
    return runlog.early_stop(_log(spark, sf_dir), "fitness", 5)


@query(
    """SELECT cls, direction, sum(n)::BIGINT AS n FROM (SELECT cls, CASE WHEN x > px THEN 'IN' ELSE 'OUT' END AS direction, 1 AS n FROM (SELECT * FROM prev WHERE px IS NOT NULL AND (px - 320) * (x - 320) <= 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame) = 1)) GROUP BY ALL""",
    TRACKS,
    _PREV,
)
def streaming_zone_counts(spark, sf_dir):
    """The counts of ``zone_in_out_counts`` from a stream with state for each track."""
    return zone_counts.from_table(spark, f"{sf_dir}/events.parquet", 320.0)
