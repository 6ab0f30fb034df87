"""Runs of pixels against a pixel by pixel test of centres."""

import random

from annolens.operators import raster

POINTS = "image_id long, det_id long, points array<struct<x: double, y: double>>"
W, H = 24, 18


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ax > x) != (bx > x) and ay + (x - ax) * (by - ay) / (bx - ax) > y:
            hit = not hit
    return hit


def shapes(seed=3, n=25):
    rng = random.Random(seed)
    out = [(i % 4, i, [(rng.uniform(-4, W + 4), rng.uniform(-4, H + 4)) for _ in range(rng.randrange(3, 8))]) for i in range(n)]
    return out + [(9, 100, [(1, 1), (2, 2)]), (9, 101, [(-9, -9), (-5, -9), (-5, -5)]), (9, 102, [(0, 0), (W, 0), (W, H), (0, H)]), (9, 103, [(2.1, 2.1), (2.2, 2.1), (2.2, 2.2)])]


def pixels(ring):
    if len(ring) < 3:
        return set()
    return {(x, y) for x in range(W) for y in range(H) if inside(ring, x + 0.5, y + 0.5)}


def table(spark, some):
    return spark.createDataFrame([(i, d, [{"x": float(x), "y": float(y)} for x, y in p]) for i, d, p in some], POINTS)


def covered(runs):
    out = {}
    for r in runs.collect():
        cells = out.setdefault((r.image_id, r.det_id), set())
        for y in range(r.y0, r.y1):
            assert (r.px, y) not in cells
            cells.add((r.px, y))
    return out


def test_runs_equal_pixels(spark):
    some = shapes()
    runs = raster.column_runs(table(spark, some), W, H)
    wanted = {(i, d): p for i, d, ring in some if (p := pixels(ring))}
    assert covered(runs) == wanted
    assert {(r.image_id, r.det_id): r.area for r in raster.areas(runs).collect()} == {k: len(v) for k, v in wanted.items()}
    box = {(r.image_id, r.det_id): (r.x1, r.y1, r.x2, r.y2) for r in raster.boxes(runs).collect()}
    assert box == {k: (min(x for x, _ in v), min(y for _, y in v), max(x for x, _ in v) + 1, max(y for _, y in v) + 1) for k, v in wanted.items()}


def test_run_lengths_and_back(spark):
    some = shapes(4)
    runs = raster.column_runs(table(spark, some), W, H)
    counts = raster.run_counts(runs, W, H)
    for r in counts.collect():
        assert sum(r.counts) == W * H and all(c > 0 for c in r.counts[1:])
        flat = []
        for k, c in enumerate(r.counts):
            flat += [k % 2 == 1] * c
        ring = next(p for i, d, p in some if (i, d) == (r.image_id, r.det_id))
        assert {(i // H, i % H) for i, on in enumerate(flat) if on} == pixels(ring)
    assert covered(raster.runs_of(counts, H)) == covered(runs)


def test_the_smallest_is_on_top(spark):
    some = shapes(5)
    got = covered(raster.owners(raster.column_runs(table(spark, some), W, H)))
    cover = {(i, d): pixels(p) for i, d, p in some}
    wanted = {}
    for image in {i for i, *_ in some}:
        own = {d: p for (i, d), p in cover.items() if i == image and p}
        for cell in set().union(*own.values()) if own else ():
            d = min((len(p), -d, d) for d, p in own.items() if cell in p)[2]
            wanted.setdefault((image, d), set()).add(cell)
    assert got == wanted


def test_no_polygons(spark):
    runs = raster.column_runs(table(spark, []), W, H)
    assert runs.count() == raster.owners(runs).count() == raster.run_counts(runs, W, H).count() == 0
    assert raster.runs_of(spark.createDataFrame([(1, 1, [W * H])], "image_id long, det_id long, counts array<long>"), H).count() == 0


def test_owners_look_at_each_mask_once(spark, monkeypatch):
    monkeypatch.setattr(raster, "STEP_RUNS", 5)
    shapes_ = table(spark, shapes(7, 40))
    owned = raster.owners(raster.masks(shapes_, W, H))
    assert covered(owned) == covered(raster.owners(raster.column_runs(shapes_, W, H)))
    plan = owned._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 2


def test_masks_are_measured_without_shuffles(spark):
    masks = raster.masks(table(spark, shapes(8)), W, H)
    back = raster.measured(raster.masks_of(raster.run_counts(masks, W, H), H))
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    runs = raster.column_runs(table(spark, shapes(8)), W, H)
    wanted = raster.areas(runs).join(raster.boxes(runs), ["image_id", "det_id"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wanted.collect()))
