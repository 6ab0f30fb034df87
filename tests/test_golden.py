"""Hand-written expectations: published counts and their rates, tie rules, region edges, odd lines."""

import pytest
from pyspark.sql import functions as F

from annolens.functions import geometry as geo
from annolens.functions import strings
from annolens.operators import matching, metrics, suppression, zones
from annolens.sources import annotations, labels, reports

#: class, tp, fp, fn, precision, recall, f1 of two published evaluations (fixed values)
UNIFORM = [
    ("chipping", 122, 112, 86, 0.521368, 0.586538, 0.552036),
    ("scratch", 5, 3, 15, 0.625, 0.25, 0.357143),
    ("splash", 173, 147, 136, 0.540625, 0.559871, 0.550079),
    ("spot", 133, 156, 180, 0.460208, 0.42492, 0.44186),
    ("all", 433, 418, 417, 0.508813, 0.509412, 0.509112),
]
BY_CLASS = [
    ("chipping", 116, 92, 92, 0.557692, 0.557692, 0.557692),
    ("scratch", 8, 7, 12, 0.533333, 0.4, 0.457143),
    ("splash", 158, 103, 151, 0.605364, 0.511327, 0.554386),
    ("spot", 133, 156, 180, 0.460208, 0.42492, 0.44186),
    ("all", 415, 358, 435, 0.536869, 0.488235, 0.511399),
]


@pytest.mark.parametrize("table", [UNIFORM, BY_CLASS])
def test_published_rates(spark, table):
    counts = spark.createDataFrame([(i, *r[1:4]) for i, r in enumerate(table[:-1])], "cls int, tp long, fp long, fn long")
    out = {r.cls: r for r in metrics.prf(metrics.with_total(counts)).collect()}
    for i, (_, tp, fp, fn, p, r, f1) in enumerate(table):
        row = out[i if i < 4 else -1]
        assert (row.tp, row.fp, row.fn) == (tp, fp, fn)
        assert [round(v, 6) for v in (row.precision, row.recall, row.f1)] == [p, r, f1]


BOX = "image_id int, cls int, det_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, *rows):
    return spark.createDataFrame([(0, 0, i, float(c), *map(float, b)) for i, (c, *b) in enumerate(rows)], BOX)


def test_greedy_takes_the_later_of_equal_truths(spark):
    gt, pred = boxes(spark, (1, 0, 0, 10, 10), (1, 0, 0, 10, 10)), boxes(spark, (0.9, 0, 0, 10, 8))
    (row,) = matching.match_greedy(gt, pred).collect()
    assert [(m.p, m.g) for m in row.matched] == [(0, 1)]


def test_confidence_or_overlap_decides(spark):
    gt, pred = boxes(spark, (1, 0, 0, 10, 10)), boxes(spark, (0.9, 0, 0, 10, 6), (0.5, 0, 0, 10, 8))
    found = matching.pairs(gt, pred)
    assert [r.p_det_id for r in matching.match_validator(found, [0.5]).collect()] == [0]
    assert [r.p_det_id for r in matching.match_confusion(found).collect()] == [1]


def test_overlap_at_the_threshold(spark):
    gt, pred = boxes(spark, (1, 0, 0, 10, 10)), boxes(spark, (0.9, 0, 0, 10, 5))  # IoU 1/2
    found = matching.pairs(gt, pred)
    assert matching.match_validator(found, [0.5]).count() == 1
    assert [len(r.matched) for r in matching.match_greedy(gt, pred, 0.5).collect()] == [1]
    assert matching.match_confusion(found, 0.5).count() == 0
    both = boxes(spark, (0.9, 0, 0, 10, 10), (0.8, 0, 0, 10, 5))
    assert suppression.suppress_greedy(both, 0.5).count() == 2
    assert suppression.suppress_fast(both, 0.5).count() == 1


def test_suppression_of_a_chain(spark):
    chain = boxes(spark, (0.9, 0, 0, 10, 10), (0.8, 5, 0, 15, 10), (0.7, 10, 0, 20, 10))  # neighbours at IoU 1/3
    assert sorted(r.det_id for r in suppression.suppress_greedy(chain, 0.3).collect()) == [0, 2]
    assert sorted(r.det_id for r in suppression.suppress_fast(chain, 0.3).collect()) == [0]


def test_empty_image_is_perfect(spark):
    none, image = boxes(spark).limit(0), spark.createDataFrame([(0,)], "image_id int")
    matched = none.select("image_id")
    (r,) = metrics.image_metrics(image, none, none, matched).collect()
    assert (r.precision, r.recall, r.f1) == (1, 1, 1)


def test_absent_classes(spark):
    """A class without truth is not averaged; one with truth and no prediction counts as 0."""
    gt, pred = boxes(spark, (1, 0, 0, 10, 10)), boxes(spark, (0.9, 0, 0, 10, 10))
    gt = gt.union(gt.withColumn("cls", F.lit(1)))
    pred = pred.union(pred.select("image_id", F.lit(2).alias("cls"), F.lit(7).alias("det_id"), *pred.columns[3:]))
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n"))
    matched = matching.match_validator(matching.pairs(gt, pred), [0.5])
    ap = metrics.average_precision(metrics.ranked(pred, matched, n_gt, [0.5]), n_gt, [0.5])
    got = {r.cls: round(r.ap, 3) for r in ap.collect()}
    assert got == {0: 0.995, 1: 0.0}


def test_predictions_of_a_quarter_are_not_confident(spark):
    pred = boxes(spark, (0.25, 0, 0, 1, 1), (0.26, 0, 0, 1, 1))
    assert [r.det_id for r in metrics.confident(pred, 0.001).collect()] == [1]
    assert metrics.confident(pred, 0.2).count() == 2


def track(spark, *points):
    return spark.createDataFrame([(0, t, k, float(x), float(y), "car") for t, p in enumerate(points) for k, (x, y) in enumerate(p)], "stream int, track_id int, frame int, x double, y double, cls string")


def test_touching_a_line_counts(spark):
    line = [(10.0, 0.0), (10.0, 20.0)]
    moves = [[(5, 5), (10, 5)], [(10, 5), (5, 5)], [(5, 5), (9, 5)], [(5, 25), (15, 25)], [(10, 2), (10, 8)], [(5, 20), (15, 20)]]
    found = {(r.direction): r.n for r in zones.count_crossings(track(spark, *moves), line).collect()}
    assert found == {"IN": 2, "OUT": 2}  # landing, end point; leaving, moving along it
    flat = {(r.direction): r.n for r in zones.count_crossings(track(spark, [(5, 5), (5, 10)], [(5, 10), (5, 4)]), [(0.0, 10.0), (20.0, 10.0)]).collect()}
    assert flat == {"IN": 1, "OUT": 1}


def test_edges_of_regions(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    points = spark.createDataFrame([(0.0, 5.0), (10.0, 10.0), (5.0, 0.0), (5.0, 5.0), (11.0, 5.0)], "x double, y double")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in square])
    x, y = F.col("x"), F.col("y")
    got = points.select(*(f(x, y, shape, boundary=b).alias(f"c{i}") for i, (f, shape, b) in enumerate([(geo.in_polygon, square, False), (geo.in_polygon, square, True), (geo.in_points, ring, False), (geo.in_points, ring, True)]))).collect()
    assert [tuple(r) for r in got] == [(False, True, False, True)] * 3 + [(True,) * 4, (False,) * 4]


def test_slots_hold_their_edge_in_whole_pixels(spark):
    (r,) = zones.slot_occupancy(track(spark, [(10.9, 4.2)]), {"a": [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], "b": [(11.0, 0.0), (12.0, 0.0), (12.0, 9.0)]}).collect()
    assert (r.occupied, r.available) == (1, 1)


def test_text_of_numbers(spark):
    values = [0.0, 0.5, 1 / 3, 123456.0, 1234567.0, 0.00012345678, 0.000012345678, 100.0, -2.5, 1e-7, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(strings.general(F.col("v"))).collect()] == [f"{v:g}" for v in values]
    assert [r[0] for r in df.select(strings.fixed(F.col("v"), 6)).collect()] == [f"{v:.6f}" for v in values]
    assert spark.range(1).select(strings.clean(F.lit("a`b´c|d"))).first()[0] == "a_b´c_d"


def lines(spark, *values):
    return spark.createDataFrame([("p", "s", v) for v in values], "path string, stem string, value string")


def test_label_lines(spark):
    odd = lines(spark, "1 0.5 0.5 0.2", "", "0 0 0 1 0 1 1", "2.0 .5 .5 .2 .1")
    got = [(r.cls, r.x, r.y, r.w, r.h) for r in labels.lenient(odd).collect()]
    assert got == [(0, 0.5, 0.5, 1.0, 1.0), (2, 0.5, 0.5, 0.2, 0.1)]
    assert [r.cls for r in labels.five_fields(odd).collect()] == [2]
    for bad in ("1 0.5 0.5 0.2", "", "1 .1 .2 .3 .4 .5", "a .1 .2 .3 .4", "1 .1 .2 x .4"):
        with pytest.raises(Exception, match="unsupported label line"):
            labels.strict(lines(spark, bad)).collect()
    with pytest.raises(Exception, match="five fields"):
        labels.class_totals(lines(spark, "1 2 3")).collect()
    (r,) = labels.strict(lines(spark, "1 .5 .5 .2 .1"), prediction=True).collect()
    assert r.conf == 1.0


def test_category_ids(spark):
    df = spark.createDataFrame([(1, 0), (13, 11), (12, None), (90, 79), (91, None), (0, None)], "c int, want int")
    assert all(r.c == r.want for r in df.select(annotations.compact_class(F.col("c")).alias("c"), "want").collect())


def test_run_lengths(spark):
    rows = [("a", i, v) for i, v in enumerate([True, True, False, True])] + [("b", 0, False), ("b", 1, False)]
    got = {r.k: r.counts for r in reports.run_lengths(spark.createDataFrame(rows, "k string, at int, on boolean"), ["k"]).collect()}
    assert got == {"a": [0, 2, 1, 1], "b": [2]}


def test_marks_and_their_precision_equal_the_curve(spark):
    """One row a prediction gives the pairs and the average precision of one row for each threshold."""
    import random

    rng = random.Random(4)
    rows = lambda n: [(i, k, rng.randrange(2), rng.randrange(8) / 8, *(x := rng.randrange(6), y := rng.randrange(6)), x + rng.randrange(2, 6), y + rng.randrange(2, 6)) for i in range(30) for k in range(n)]
    schema = "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
    gt, pred = (spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows(n)], schema) for n in (6, 9))
    steps, found = metrics.STEPS, matching.pairs(gt, pred)
    matched, marks = matching.match_validator(found, steps), matching.match_marks(found, steps)
    got = {(r.image_id, steps[i], r.p_det_id, r.g_det_id) for r in marks.collect() for i in range(10) if r.marks >> i & 1}
    assert got == {(r.image_id, r.threshold, r.p_det_id, r.g_det_id) for r in matched.collect()}
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n"))
    wanted = metrics.average_precision(metrics.ranked(pred, matched, n_gt, steps), n_gt, steps).collect()
    ap = metrics.average_precision_of(pred, marks, n_gt, steps).collect()
    plain = lambda some: {(r.cls, r.threshold): round(r.ap, 9) for r in some}
    assert plain(ap) == plain(wanted) and len(ap) == 20
