"""Detection, classification and segmentation metrics over matched boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.sources.folders import written

RANGES = 64
STEPS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def prf(df: DataFrame) -> DataFrame:
    """Add precision, recall and f1 from tp, fp, fn; empty denominators give 0."""
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_counts(gt: DataFrame, pred: DataFrame, matched: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn for every row of ``classes`` (by columns and cls), zero-filled; ``matched`` has one row for each true positive."""
    keys = [*(by or []), "cls"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = classes
    for df, name in ((gt, "n_gt"), (pred, "n_pred"), (matched, "tp")):
        out = out.join(n(df, name), keys, "left")
    out = out.na.fill(0, ["n_gt", "n_pred", "tp"])
    return out.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def with_total(counts: DataFrame, by: list[str] | None = None, label: int = -1) -> DataFrame:
    """Class rows and one row of sums over classes (cls = ``label``), by grouping sets."""
    by = by or []
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    every = counts.groupBy(*by).agg(*sums).withColumn("cls", F.lit(label))
    return counts.select(*by, "cls", "tp", "fp", "fn").unionByName(every.select(*by, "cls", "tp", "fp", "fn"))


def best_by_f1(scored: DataFrame, by: list[str]) -> DataFrame:
    """The threshold of largest f1, the smallest on ties."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")
    group = scored.groupBy(*by) if by else scored.groupBy()
    return group.agg(best).select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def ranked(pred: DataFrame, matched: DataFrame, n_gt: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per class and threshold, predictions by confidence with running recall and precision.

    ``matched`` has (image_id, cls, threshold, p_det_id); classes come from ``n_gt`` (cls, n). Ties of
    confidence are one step in order of image and detection. A class is numbered in RANGES ranges of
    confidence (``part``), each after the counts of those before it, so no task sorts a whole class. The
    curve is written once; what is made of it reads that table.
    """
    steps = pred.select("image_id", "cls", "det_id", "conf", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hits = matched.select("image_id", "cls", "threshold", F.col("p_det_id").alias("det_id"), F.lit(1).alias("tp"))
    flagged = steps.join(hits, ["image_id", "cls", "threshold", "det_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    edges = sorted(set(pred.approxQuantile("conf", [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("conf"))) if edges else F.lit(0)
    flagged = flagged.withColumn("part", part)
    keys = ["cls", "threshold"]
    w = Window.partitionBy(*keys, "part").orderBy(F.desc("conf"), "image_id", "det_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = flagged.groupBy(*keys, "part").agg(F.sum("tp").alias("t"), F.count("*").alias("c"))
    before = sums.select(*keys, "part", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("c0"))
    runs = flagged.withColumns({"tpc": F.sum("tp").over(w), "k": F.count("*").over(w)}).join(before, [*keys, "part"]).withColumns({"tpc": F.col("tpc") + F.col("t0"), "k": F.col("k") + F.col("c0")}).drop("t0", "c0")
    return written(runs.join(F.broadcast(n_gt), "cls").withColumns({"recall": F.col("tpc") / (F.col("n") + F.lit(1e-16)), "precision": F.col("tpc") / F.col("k")}))


def average_precision(curve: DataFrame, n_gt: DataFrame, thresholds: list[float]) -> DataFrame:
    """(cls, threshold, ap): precision envelope at 101 recalls, by trapezoids; classes without predictions have 0.

    Points of equal recall are first reduced to the one that interpolation sees, so each class and
    threshold keeps at most one point for each true positive.
    """
    keys = ["cls", "threshold"]
    # the largest precision from here on: within the range of confidence, and over the ranges that follow
    tails = Window.partitionBy(*keys, "part").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = curve.groupBy(*keys, "part").agg(F.max("precision").alias("m")).select(*keys, "part", F.max("m").over(later).alias("m"))
    shaped = curve.withColumn("env", F.max("precision").over(tails)).join(tops, [*keys, "part"]).withColumn("env", F.greatest("env", "m"))
    # of equal recalls the last point holds to its right, the first point's envelope is what its left neighbour leads to
    points = shaped.groupBy(*keys, "tpc").agg(F.max("recall").alias("r"), F.max("env").alias("first"), F.min("env").alias("last"))
    ends = curve.groupBy(*keys).agg(F.max("recall").alias("top"))
    front = ends.select(*keys, F.lit(-1).cast("long").alias("tpc"), F.lit(0.0).alias("r"), F.lit(1.0).alias("first"), F.lit(1.0).alias("last"))
    # hits count up by one, so a point's successor is found by its number
    at = F.greatest("tpc", F.lit(0)).alias("at")
    lead = points.unionByName(front).groupBy(*keys, at).agg(F.max("r").alias("r"), F.max("first").alias("first"), F.min_by("last", F.col("tpc") * -1).alias("last"))
    following = lead.select(*keys, (F.col("at") - 1).alias("at"), F.col("r").alias("r2"), F.col("first").alias("p2"))
    spans = lead.join(following, [*keys, "at"], "left")
    closed = spans.join(ends, keys)
    # after the last recall the curve falls to 0 at once and stays there
    left = F.when(F.col("r2").isNull(), 0.0).otherwise(F.col("last"))
    grid = F.explode(F.sequence(F.ceil(F.round(F.col("r") * 100, 9)).cast("int"), F.when(F.col("r2").isNull(), 100).otherwise((F.ceil(F.round(F.col("r2") * 100, 9)) - 1).cast("int"))))
    usable = closed.where(F.col("r2").isNull() | (F.ceil(F.round(F.col("r") * 100, 9)) <= F.ceil(F.round(F.col("r2") * 100, 9)) - 1))
    at = usable.select(*keys, "r", "r2", "p2", left.alias("p"), "top", grid.alias("g"))
    value = F.when(F.col("r2").isNull(), 0.0).otherwise(F.col("p") + (F.col("p2") - F.col("p")) * (F.col("g") / 100 - F.col("r")) / (F.col("r2") - F.col("r")))
    weight = F.when(F.col("g").isin(0, 100), 0.005).otherwise(0.01)
    area = at.groupBy(*keys).agg(F.sum(value * weight).alias("ap"))
    full = n_gt.select("cls", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return full.join(area, keys, "left").na.fill(0.0, ["ap"])


def ranges_of(df: DataFrame, ranges: int, column: str = "conf") -> Column:
    """The number of a row's range among about ``ranges`` equal ones, the largest values first."""
    edges = sorted(set(df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col(column))) if edges else F.lit(0)


def summed_up(rows: DataFrame, sums: dict[str, Column], keys: list[str], order: list) -> DataFrame:
    """``rows`` with running totals (columns ``sums``, of whole numbers) in ``order`` within ``keys``; ``part`` numbers ranges that follow one another, each summed by itself."""
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    whole = rows.groupBy(*keys, "part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = whole.select(*keys, "part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_0") for n in sums])
    w = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.select(*rows.columns, *[F.sum(c).over(w).alias(f"{n}_1") for n, c in sums.items()])
    both = runs.join(F.broadcast(before), [*keys, "part"])
    return both.select(*rows.columns, *[(F.col(f"{n}_0") + F.col(f"{n}_1")).alias(n) for n in sums])


def average_precision_of(pred: DataFrame, marks: DataFrame, n_gt: DataFrame, thresholds: list[float]) -> DataFrame:
    """``average_precision`` of the curve ``ranked``, from ``matching.match_marks``, with one row a prediction instead of one for each threshold.

    Precision falls between hits, so the envelope at a recall is the largest precision of the hits beyond
    it: of each class and threshold at most 101 of them are kept.
    """
    keys = ["cls", "threshold"]
    hits = marks.select("image_id", "cls", F.col("p_det_id").alias("det_id"), "marks")
    flagged = pred.select("image_id", "cls", "det_id", "conf").join(hits, ["image_id", "cls", "det_id"], "left").na.fill(0, ["marks"])
    flagged = written(flagged)
    flagged = flagged.withColumn("part", ranges_of(flagged, RANGES))
    bit = lambda i: F.shiftright("marks", i).bitwiseAND(F.lit(1).cast("long"))
    sums = {"k": F.lit(1), **{f"t{i}": bit(i) for i in range(len(thresholds))}}
    runs = summed_up(flagged, sums, ["cls"], [F.desc("conf"), "image_id", "det_id"]).where("marks <> 0")
    steps = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("tpc"), bit(i).alias("hit")) for i, t in enumerate(thresholds)])
    points = runs.select("cls", "k", F.explode(steps).alias("s")).where("s.hit = 1").join(F.broadcast(n_gt), "cls")
    reached = F.ceil(F.round(F.col("s.tpc") / (F.col("n") + F.lit(1e-16)) * 100, 9)) - 1
    tops = points.groupBy("cls", "s.threshold", F.least(reached, F.lit(100)).alias("g")).agg(F.max(F.col("s.tpc") / F.col("k")).alias("p"))
    later = Window.partitionBy(*keys).orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.when(F.col("g") < 0, 0.0).when(F.col("g") >= 100, 1.0).otherwise(F.col("g") * 0.01 + 0.005)
    spans = tops.withColumn("w", weight).select(*keys, F.max("p").over(later).alias("p"), (F.col("w") - F.coalesce(F.lag("w").over(Window.partitionBy(*keys).orderBy("g")), F.lit(0.0))).alias("w"))
    area = spans.groupBy(*keys).agg(F.sum(F.col("p") * F.col("w")).alias("ap"))
    full = n_gt.select("cls", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return full.join(area, keys, "left").na.fill(0.0, ["ap"])


def mean_ap(ap: DataFrame) -> DataFrame:
    """map50, map75, map50_95 over classes."""
    at = lambda t: F.avg(F.when(F.col("threshold") == t, F.col("ap")))
    return ap.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("ap").alias("map50_95"))


def image_metrics(images: DataFrame, gt: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Precision, recall and f1 of every image; an image without truth and predictions has 1."""
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    out = images
    for df, name in ((gt, "n_gt"), (pred, "n_pred"), (matched, "tp")):
        out = out.join(n(df, name), "image_id", "left")
    out = out.na.fill(0, ["n_gt", "n_pred", "tp"]).withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    empty = (F.col("n_gt") == 0) & (F.col("n_pred") == 0)
    scored = prf(out)
    return scored.select("image_id", "tp", "fp", "fn", *[F.when(empty, 1.0).otherwise(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def confusion_matrix(gt: DataFrame, pred: DataFrame, matched: DataFrame, n_classes: int) -> DataFrame:
    """(pred_cls, gt_cls, n): matched pairs, missed truth at pred_cls = n_classes, unmatched predictions at gt_cls = n_classes."""
    hit = matched.select(F.col("p_cls").alias("pred_cls"), F.col("g_cls").alias("gt_cls"))
    used_gt = matched.select("image_id", F.col("g_det_id").alias("det_id"))
    used_pred = matched.select("image_id", F.col("p_det_id").alias("det_id"))
    missed = gt.join(used_gt, ["image_id", "det_id"], "left_anti").select(F.lit(n_classes).alias("pred_cls"), F.col("cls").alias("gt_cls"))
    extra = pred.join(used_pred, ["image_id", "det_id"], "left_anti").select(F.col("cls").alias("pred_cls"), F.lit(n_classes).alias("gt_cls"))
    return hit.unionByName(missed).unionByName(extra).groupBy("pred_cls", "gt_cls").agg(F.count("*").alias("n"))


def confident(pred: DataFrame, conf: float | None = None, rotated: bool = False) -> DataFrame:
    """Predictions that a confusion matrix looks at: strictly above ``conf``, which is 0.25 where none or the validator's default is given."""
    return pred.where(F.col("conf") > (0.25 if conf in (None, 0.01 if rotated else 0.001) else conf))


def class_maps(ap: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, map): mean average precision over the thresholds; classes without truth have the mean over all."""
    every = ap.agg(F.avg("ap").alias("all"))
    own = ap.groupBy("cls").agg(F.avg("ap").alias("map"))
    return classes.join(own, "cls", "left").join(F.broadcast(every)).select("cls", F.coalesce("map", "all").alias("map"))


def pixel_ratio(pixels: DataFrame, names: list[int], key: str = "image_id") -> DataFrame:
    """(key, cls, pixel_ratio): share of each named class in all pixel counts (key, cls, n) of an image."""
    total = F.sum("n").over(Window.partitionBy(key))
    return pixels.withColumn("pixel_ratio", F.bround(F.col("n") / total, 5)).where(F.col("cls").isin(names)).select(key, "cls", "pixel_ratio")


def normalize_columns(matrix: DataFrame) -> DataFrame:
    """Shares of each truth column."""
    return matrix.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("gt_cls")) + F.lit(1e-9)))


def matrix_tp_fp(matrix: DataFrame, n_classes: int) -> DataFrame:
    """tp and fp of each class from a confusion matrix; the background is left out."""
    hit = F.col("pred_cls") == F.col("gt_cls")
    sums = [F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("fp")]
    return matrix.where(F.col("pred_cls") < n_classes).groupBy(F.col("pred_cls").alias("cls")).agg(*sums)


def top_k_accuracy(scored: DataFrame, k: int, key: str, truth: str) -> DataFrame:
    """Shares of ``key`` whose ``truth`` is among the first and the first ``k`` classes by score (rows: key, truth, cls, score)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "cls"))
    hits = scored.withColumn("n", n).where(F.col("n") <= k).groupBy(key).agg(F.max(F.when((F.col("n") == 1) & (F.col("cls") == F.col(truth)), 1).otherwise(0)).alias("a"), F.max(F.when(F.col("cls") == F.col(truth), 1).otherwise(0)).alias("b"))
    return hits.agg(F.avg("a").alias("top1"), F.avg("b").alias("topk"))


def semantic_scores(matrix: DataFrame, ignore: int = 255) -> DataFrame:
    """(cls, iou, accuracy) from pixel counts (pred, gt, n); ``mean_iou`` over classes with truth is its average."""
    m = matrix.where(F.col("gt") != ignore)
    gt = m.groupBy(F.col("gt").alias("cls")).agg(F.sum("n").alias("n_gt"), F.sum(F.when(F.col("pred") == F.col("gt"), F.col("n")).otherwise(0)).alias("hit"))
    pred = m.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    both = gt.join(pred, "cls", "left").na.fill(0, ["n_pred"])
    return both.select("cls", (F.col("hit") / (F.col("n_gt") + F.col("n_pred") - F.col("hit"))).alias("iou"), (F.col("hit") / F.col("n_gt")).alias("accuracy"))


def f1_operating_point(curve: DataFrame, n_classes: int, grid: int = 1000, taps: int = 101) -> DataFrame:
    """(conf, f1): the confidence where the mean F1 over classes, smoothed over ``taps`` grid points, is largest; the first on ties."""
    mean = rate_curves(curve, grid).groupBy("g").agg((F.sum(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + F.lit(1e-16))) / n_classes).alias("f1"))
    points = curve.sparkSession.range(grid).select(F.col("id").cast("int").alias("g")).join(mean, "g", "left").na.fill(0.0, ["f1"])
    half = taps // 2
    spread = points.select("f1", F.explode(F.sequence(F.when(F.col("g") == 0, -half).otherwise(F.col("g")), F.when(F.col("g") == grid - 1, grid - 1 + half).otherwise(F.col("g")))).alias("g"))
    reach = spread.select("f1", F.explode(F.sequence(F.col("g") - half, F.col("g") + half)).alias("g")).where(F.col("g").between(0, grid - 1))
    smooth = reach.groupBy("g").agg((F.sum("f1") / taps).alias("f1"))
    best = smooth.agg(F.max(F.struct(F.round("f1", 12).alias("f"), (-F.col("g")).alias("g"))).alias("b"))
    return best.select((-F.col("b.g") / F.lit(float(grid - 1))).alias("conf"), F.col("b.f").alias("f1"))


def mean_rates(curve: DataFrame, n_classes: int, grid: int = 1000, taps: int = 101) -> DataFrame:
    """(conf, precision, recall): means over classes at the confidence of ``f1_operating_point``; a class without predictions has 0 for both."""
    best = f1_operating_point(curve, n_classes, grid, taps).select("conf", F.round(F.col("conf") * (grid - 1)).cast("int").alias("g"))
    at = F.broadcast(best).join(rate_curves(curve, grid), "g", "left")
    return at.groupBy("conf").agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) / n_classes).alias(n) for c, n in (("p", "precision"), ("r", "recall"))])


def rate_curves(curve: DataFrame, grid: int = 1000) -> DataFrame:
    """(cls, g, r, p): recall and precision of each class at the confidences g / (grid - 1), where there are predictions of it at or above.

    ``curve`` is one threshold's ranked predictions. Between two confidences recall and precision are
    interpolated; below the least confidence the last values hold, above the largest recall is 0 and precision 1.
    """
    w = Window.partitionBy("cls").orderBy("conf")  # two rows for each grid point at most
    g = F.lit(float(grid - 1))
    at = curve.groupBy("cls", "conf").agg(F.max_by("recall", "k").alias("r_hi"), F.max_by("precision", "k").alias("p_hi"), F.min_by("recall", "k").alias("r_lo"), F.min_by("precision", "k").alias("p_lo"))
    # between two grid points only the least and the largest confidence lead anywhere
    row = F.struct("conf", "r_hi", "p_hi", "r_lo", "p_lo")
    outer = at.groupBy("cls", F.ceil(F.round(F.col("conf") * g, 9)).alias("cell")).agg(F.min(row).alias("a"), F.max(row).alias("b"))
    at = outer.select("cls", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("cls", "x.*")
    # stepping down in confidence meets the first row of a tie first
    spans = at.withColumns({"c2": F.lead("conf").over(w), "r2": F.lead("r_hi").over(w), "p2": F.lead("p_hi").over(w), "first": F.row_number().over(w) == 1})
    low = F.when(F.col("first"), 0).otherwise(F.ceil(F.round(F.col("conf") * g, 9)).cast("int"))
    high = F.when(F.col("c2").isNull(), F.floor(F.round(F.col("conf") * g, 9))).otherwise(F.ceil(F.round(F.col("c2") * g, 9)) - 1).cast("int")
    rows = spans.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("g"))
    x = F.col("g") / g
    part = lambda a, b: F.when((x <= F.col("conf")) | F.col("c2").isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * (x - F.col("conf")) / (F.col("c2") - F.col("conf")))
    return rows.select("cls", "g", part("r_lo", "r2").alias("r"), part("p_lo", "p2").alias("p"))
