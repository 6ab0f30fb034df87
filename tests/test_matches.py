"""Evaluation by size, windows, assignments and rectangles against plain versions and hand-written cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from annolens.functions import geometry as geo
from annolens.operators import association, grid, sized

GT = "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, area double, crowd boolean"
DET = "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, area double, conf double"


def square(x, y, side):
    return float(x), float(y), float(x + side), float(y + side), float(side * side)


def values(df):
    return {r.name: r.value for r in df.collect()}


def test_ignored_truth_counts_nowhere(spark):
    """One small and one medium truth, a crowd, a prediction on each, one inside the crowd again, and one on nothing."""
    gt = spark.createDataFrame([(1, 1, 0, *square(0, 0, 20), False), (1, 2, 0, *square(100, 100, 50), False), (1, 3, 0, *square(300, 300, 200), True)], GT)
    det = [(1, 1, 0, *square(0, 0, 20), 0.9), (1, 2, 0, *square(100, 100, 50), 0.8), (1, 3, 0, *square(310, 310, 60), 0.95), (1, 4, 0, *square(400, 400, 60), 0.94), (1, 5, 0, *square(700, 700, 60), 0.85)]
    out = values(sized.summary(gt, spark.createDataFrame(det, DET)))
    # by confidence: crowd, crowd (left out), right, wrong, right
    assert math.isclose(out["AP"], (51 * 1 + 50 * 2 / 3) / 101) and out["AP50"] == out["AP75"] == pytest.approx(out["AP"])
    assert out["AP_small"] == 1.0  # the medium truth and what lies outside the range is left out
    assert math.isclose(out["AP_medium"], 0.5)
    assert out["AP_large"] == out["AR_large"] == -1
    assert (out["AR_1"], out["AR_10"], out["AR_100"]) == (0.0, 1.0, 1.0)  # the most confident prediction lies in the crowd
    assert (out["AR_small"], out["AR_medium"]) == (1.0, 1.0)


def test_a_free_truth_goes_before_an_ignored_one(spark):
    gt = spark.createDataFrame([(1, 1, 0, *square(0, 0, 30), False), (1, 2, 0, *square(0, 0, 32), True), (2, 1, 0, *square(0, 0, 10), False)], GT)
    pred = spark.createDataFrame([(1, 1, 0, *square(0, 0, 32), 0.9), (1, 2, 0, *square(0, 0, 31), 0.8)], DET)
    looked = sized.outcomes(gt, pred, [0.5], {"all": (0.0, 1e10), "large": (1000.0, 1e10)})
    got = {(r.range, r.det_id): (r.hit, r.left_out) for r in looked.collect()}
    assert got == {("all", 1): (True, False), ("all", 2): (True, True), ("large", 1): (True, True), ("large", 2): (True, True)}
    assert {(r.range, r.n) for r in sized.truths(gt).collect()} == {("all", 2), ("small", 2)}


def plain_outcomes(gt, pred, threshold, low, high, most):
    """Each prediction's (hit, left out), by the rules written out as loops over all truths."""
    out = {}
    keys = {(g[0], g[2]) for g in gt} | {(p[0], p[2]) for p in pred}
    for image, cls in keys:
        truths = [g for g in gt if (g[0], g[2]) == (image, cls)]
        skip = {g[1]: g[8] or not low <= g[7] <= high for g in truths}
        used = set()
        for p in sorted((p for p in pred if (p[0], p[2]) == (image, cls)), key=lambda p: (-p[8], p[1]))[:most]:
            best = None
            for g in truths:
                w, h = min(g[5], p[5]) - max(g[3], p[3]), min(g[6], p[6]) - max(g[4], p[4])
                inter = max(w, 0) * max(h, 0)
                share = inter / p[7] if g[8] else inter / (p[7] + g[7] - inter)
                if share >= threshold and (g[8] or g[1] not in used):
                    best = max(best or (), (not skip[g[1]], share, g[1]))
            if best:
                used.add(best[2])
                out[image, cls, p[1]] = True, not best[0]
            else:
                out[image, cls, p[1]] = False, not low <= p[7] <= high
    return out


def test_outcomes_equal_plain_loops(spark):
    rng = random.Random(5)
    box = lambda: square(rng.randrange(0, 80, 4), rng.randrange(0, 80, 4), rng.choice([16, 24, 32, 40]))
    gt = [(i, k, rng.randrange(2), *box(), rng.random() < 0.2) for i in range(6) for k in range(12)]
    pred = [(i, k, rng.randrange(2), *box(), rng.randrange(10) / 10) for i in range(6) for k in range(14)]
    areas = {"all": (0.0, 1e10), "mid": (500.0, 1100.0)}
    looked = sized.outcomes(spark.createDataFrame(gt, GT), spark.createDataFrame(pred, DET), [0.3, 0.5], areas, 5).collect()
    for name, (low, high) in areas.items():
        for t in (0.3, 0.5):
            got = {(r.image_id, r.cls, r.det_id): (r.hit, r.left_out) for r in looked if (r.range, r.threshold) == (name, t)}
            assert got == plain_outcomes(gt, pred, t, low, high, 5)


def test_no_predictions_and_no_truth(spark):
    gt = spark.createDataFrame([(1, 1, 0, *square(0, 0, 20), False)], GT)
    none = spark.createDataFrame([], DET)
    assert values(sized.summary(gt, none))["AP"] == 0.0
    assert set(values(sized.summary(gt.limit(0), none)).values()) == {-1.0}


def test_curve_in_ranges_of_confidence(spark, monkeypatch):
    rng = random.Random(2)
    gt = [(i, k, 0, *square(100 * k, 0, 40), False) for i in range(20) for k in range(4)]
    pred = [(i, k, 0, *square(100 * k + rng.randrange(0, 30), 0, 40), rng.randrange(50) / 50) for i in range(20) for k in range(5)]
    tables = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, DET)
    whole = values(sized.summary(*tables))
    monkeypatch.setattr(sized, "ROWS_A_RANGE", 100)
    assert values(sized.summary(*tables)) == pytest.approx(whole)


# --- windows and objects


def points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


POINTS = "array<struct<x: double, y: double>>"


def test_polygon_clipping_and_area(spark):
    shapes = [
        (points((0, 0), (4, 0), (4, 4), (0, 4)), 4.0),  # a square, a quarter inside
        (points((2, 2), (3, 2), (3, 3), (2, 3)), 1.0),  # inside
        (points((9, 9), (10, 9), (10, 10)), 0.0),  # outside
        (points((0, 0), (12, 0), (0, 12)), 16.0),  # a triangle around the box
        (points((1, 3), (3, 1), (5, 3), (3, 5)), 8.0),  # a diamond, inside to its corners
        (points((3, 0), (6, 3), (3, 6), (0, 3)), 14.0),  # a diamond that loses its corners
        (points((2, 0), (3, 0), (3, 3), (4, 3), (4, 0), (5, 0), (5, 4), (2, 4)), 7.0),  # concave: a U upside down
    ]
    df = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(shapes)], f"i int, points {POINTS}, wanted double")
    lit = lambda *v: [F.lit(float(x)) for x in v]
    clipped = geo.polygon_area(geo.clip_polygon(F.col("points"), *lit(1, 1, 5, 5)))
    low = geo.polygon_area(geo.clip_polygon(F.col("points"), *lit(2, 2, 6, 6)))
    got = {r.i: (r.a, r.b) for r in df.select("i", clipped.alias("a"), low.alias("b")).collect()}
    assert got[0][1] == 4.0 and got[1][0] == 1.0 and got[2] == (0.0, 0.0) and got[3][0] == 16.0 and got[4][0] == 8.0 and got[5][0] == pytest.approx(14.0)
    assert got[6][0] == pytest.approx(7.0)


def test_windows_equal_all_pairs(spark):
    rng = random.Random(3)
    windows = [(i, float(x), float(y), float(x + 32), float(y + 32)) for i in range(3) for x in (0, 24, 48) for y in (0, 24)]
    objects = []
    for k in range(120):
        x, y, a, b, r = rng.randrange(-10, 90), rng.randrange(-10, 70), rng.randrange(1, 30), rng.randrange(1, 12), rng.random() * 3
        c, s = math.cos(r), math.sin(r)
        objects.append((k % 3, k, k % 2, points(*[(x + u * a * c - v * b * s, y + u * a * s + v * b * c) for u, v in ((1, 1), (1, -1), (-1, -1), (-1, 1))])))
    w = spark.createDataFrame(windows, "image_id long, x1 double, y1 double, x2 double, y2 double")
    o = spark.createDataFrame(objects, f"image_id long, det_id long, cls int, points {POINTS}")
    got = {(r.image_id, r.x1, r.y1, r.det_id): r.iof for r in grid.window_objects(w, o, 0.7, cell=20.0).collect()}
    pairs = w.join(o, "image_id").withColumn("iof", geo.polygon_area(geo.clip_polygon(F.col("points"), *geo.columns("", "x1 y1 x2 y2"))) / geo.polygon_area(F.col("points")))
    wanted = {(r.image_id, r.x1, r.y1, r.det_id): r.iof for r in pairs.where("iof >= 0.7").collect()}
    assert got == pytest.approx(wanted) and len(got) > 20
    assert grid.window_objects(w, o.limit(0), 0.7).count() == 0 and grid.window_objects(w.limit(0), o, 0.7).count() == 0


def test_grid_pairs_once_each(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), k, float(x := rng.randrange(-20, 60)), float(y := rng.randrange(-20, 60)), float(x + rng.randrange(1, 30)), float(y + rng.randrange(1, 30))) for k in range(150)]
    df = spark.createDataFrame(rows, "image_id long, k long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.a_k, r.b_k) for r in grid.grid_pairs(df, df, ["image_id"], 7.0).collect())
    wanted = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5])
    assert got == wanted


def test_smallest_rectangle(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    turned = [(10 + u * c - v * s, 5 + u * s + v * c) for u, v in ((4, 1), (4, -1), (-4, -1), (-4, 1), (0, 0), (2, 1))]
    tall = [(u * c - v * s, u * s + v * c) for u, v in ((1, 4), (1, -4), (-1, -4), (-1, 4))]
    cases = [(0, points(*turned)), (1, points(*tall)), (2, points((1, 1))), (3, points((0, 0), (3, 4), (6, 8))), (4, points((0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (0, 0)))]
    df = spark.createDataFrame(cases, f"i int, points {POINTS}").select("i", geo.smallest_rectangle(F.col("points")).alias("r"), F.size(geo.hull(F.col("points"))).alias("n"))
    got = {r.i: (round(r.r.x, 9), round(r.r.y, 9), round(r.r.w, 9), round(r.r.h, 9), round(r.r.r, 9), r.n) for r in df.collect()}
    assert got[0] == (10, 5, 8, 2, 0.3, 4)
    assert got[1] == (0, 0, 8, 2, round(0.3 + math.pi / 2, 9), 4)
    assert got[2] == (1, 1, 0, 0, 0, 1)
    assert got[3][2:4] == (10, 0) and got[3][5] == 2
    assert got[4] == (1, 1, 2, 2, 0, 4)


def test_smallest_rectangle_by_angle(spark):
    rng = random.Random(4)
    shapes = [[(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(rng.randrange(3, 12))] for _ in range(40)]
    df = spark.createDataFrame([(i, points(*p)) for i, p in enumerate(shapes)], f"i int, points {POINTS}")
    for r in df.select("i", geo.smallest_rectangle(F.col("points")).alias("r")).collect():
        p = shapes[r.i]
        area = min(
            (max(x * math.cos(t) + y * math.sin(t) for x, y in p) - min(x * math.cos(t) + y * math.sin(t) for x, y in p)) * (max(y * math.cos(t) - x * math.sin(t) for x, y in p) - min(y * math.cos(t) - x * math.sin(t) for x, y in p))
            for a, b in itertools.permutations(p, 2)
            for t in [math.atan2(b[1] - a[1], b[0] - a[0])]
        )
        assert math.isclose(r.r.w * r.r.h, area, rel_tol=1e-9) and -math.pi / 4 <= r.r.r < 3 * math.pi / 4 and r.r.w >= r.r.h


# --- associations

EDGES = "image_id long, a long, b long, benefit long"


def best_total(edges):
    """The largest total of one group by trying every partner of each a."""
    by = {}
    for a, b, v in edges:
        by.setdefault(a, []).append((b, v))
    order = sorted(by)

    def go(i, used):
        if i == len(order):
            return 0
        return max([go(i + 1, used)] + [v + go(i + 1, used | {b}) for b, v in by[order[i]] if b not in used])

    return go(0, frozenset())


def one_to_one(rows):
    assert len({(r.image_id, r.a) for r in rows}) == len({(r.image_id, r.b) for r in rows}) == len(rows)


def test_assignment_is_optimal(spark):
    rng = random.Random(1)
    rows = [(i, a, b, rng.choice([1, 5, 5, 7, 1000, rng.randrange(1, 100)])) for i in range(60) for a in range(rng.randrange(1, 8)) for b in range(rng.randrange(1, 8)) if rng.random() < 0.7]
    rows += [(100, a, b, rng.randrange(1, 50)) for a in range(30) for b in range(3)] + [(101, a, b, rng.randrange(1, 50)) for a in range(3) for b in range(12)]
    found = association.assign(spark.createDataFrame(rows, EDGES)).collect()
    one_to_one(found)
    total = {}
    for r in found:
        assert (r.image_id, r.a, r.b, r.benefit) in rows
        total[r.image_id] = total.get(r.image_id, 0) + r.benefit
    for i in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == i]
        if i == 100:
            own = [(b, a, v) for a, b, v in own]
        assert total[i] == best_total(own)
    assert association.assign(spark.createDataFrame([(1, 1, 1, 0)], EDGES)).count() == 0
    left = association.unmatched(spark.createDataFrame([(100, a) for a in range(30)], "image_id long, det long"), spark.createDataFrame(found), ("image_id",), "det", "a")
    assert left.count() == 27


def test_auction_of_a_large_group(spark):
    rng = random.Random(8)
    rows = [(1, a, b, rng.randrange(1, 6)) for a in range(4) for b in range(4) if rng.random() < 0.7] + [(2, 1, 1, 3), (2, 2, 1, 5)]
    found = association.auction(spark.createDataFrame(rows, EDGES), ["image_id"], 0.06).collect()
    one_to_one(found)
    assert sum(r.benefit for r in found if r.image_id == 1) == best_total([r[1:] for r in rows if r[0] == 1])
    assert [(r.a, r.b) for r in found if r.image_id == 2] == [(2, 1)]


def plain_mutual(cost, limit, step):
    cost, out, n = dict(cost), [], 0
    while cost:
        of_a = {a: min((c, b) for (x, b), c in cost.items() if x == a)[1] for a, _ in cost}
        of_b = {b: min((c, a) for (a, y), c in cost.items() if y == b)[1] for _, b in cost}
        new = [(a, b) for a, b in of_a.items() if of_b[b] == a and cost[a, b] < limit]
        if not new:
            break
        out += [(a, b, n) for a, b in new]
        for a, b in new:
            cost = {k: c for k, c in cost.items() if k[0] != a and k[1] != b}
        limit, n = limit - step, n + 1
    return out


def test_mutual_nearest_equals_a_plain_loop(spark):
    rng = random.Random(6)
    groups = {i: {(a, b): rng.randrange(0, 40) / 40 for a in range(rng.randrange(1, 9)) for b in range(rng.randrange(1, 9)) if rng.random() < 0.8} for i in range(25)}
    rows = [(i, a, b, c) for i, g in groups.items() for (a, b), c in g.items()]
    found = association.mutual_nearest(spark.createDataFrame(rows, "image_id long, a long, b long, cost double"), 0.8, 0.1)
    got = sorted((r.image_id, r.a, r.b, r.round) for r in found.collect())
    assert got == sorted((i, *m) for i, g in groups.items() for m in plain_mutual(g, 0.8, 0.1))
    assert association.mutual_nearest(spark.createDataFrame([], "image_id long, a long, b long, cost double"), 0.8).count() == 0


def test_outcomes_counted_by_bits(spark):
    rng = random.Random(8)
    box = lambda: square(rng.randrange(0, 60, 4), rng.randrange(0, 60, 4), rng.choice([16, 24, 40]))
    gt = spark.createDataFrame([(i, k, rng.randrange(2), *box(), rng.random() < 0.2) for i in range(5) for k in range(10)], GT)
    pred = spark.createDataFrame([(i, k, rng.randrange(2), *box(), rng.randrange(10) / 10) for i in range(5) for k in range(12)], DET)
    n = {tuple(r)[:5]: r.n for r in sized.counts(gt, pred).collect()}
    wanted = sized.outcomes(gt, pred).groupBy("cls", "range", "threshold", "hit", "left_out").count().collect()
    assert n == {tuple(r)[:5]: r["count"] for r in wanted}
