"""Dataset checks, statistics, splits, sampling and tiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions.geometry import Box, flipped, xywh_to_xyxy, xyxy_to_xywh
from annolens.functions.overlap import ioa
from annolens.operators.grid import FEW, grid_pairs

CORNERS = ["x1", "y1", "x2", "y2"]


def hash_unit(*parts) -> Column:
    """A number in [0, 1) from the md5 of the blank-joined parts: the portable pseudo-random order."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", *parts)), 1, 8), 16, 10).cast("double") / 4294967296


def verify_labels(labels: DataFrame, n_classes: int, high: float = 1.01, low: float = -0.01) -> DataFrame:
    """Per image: rows, out_of_bounds, bad_class, duplicates and status (empty rows are not labels)."""
    out = F.greatest("x", "y", "w", "h") > high
    under = F.least("x", "y", "w", "h") < low
    wrong = (F.col("cls") < 0) | (F.col("cls") >= n_classes)
    n = labels.groupBy("image_id", "cls", "x", "y", "w", "h").agg(F.count("*").alias("n"))
    sums = n.groupBy("image_id").agg(F.sum("n").alias("rows"), F.sum(F.when(out | under, F.col("n")).otherwise(0)).alias("out_of_bounds"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("bad_class"), F.sum(F.col("n") - 1).alias("duplicates"))
    return sums.withColumn("status", F.when((F.col("out_of_bounds") > 0) | (F.col("bad_class") > 0), "corrupt").otherwise("found"))


def scanned_labels(images: DataFrame, files: DataFrame, rows: DataFrame, n_classes: int, high: float = 1.01, low: float = -0.01) -> DataFrame:
    """Every image with the state of its label file and how many distinct rows it gives.

    ``files`` (image_id, length) lists the label files there are, ``rows`` (image_id, cls, x, y, w, h) is what
    they hold. A file is missing, empty, corrupt (a value out of bounds or a class out of range; its rows go)
    or found; repeated rows count once and are reported.
    """
    checked = verify_labels(rows, n_classes, high, low)
    held = images.join(files, "image_id", "left").join(checked, "image_id", "left")
    status = F.when(F.col("length").isNull(), "missing").when((F.col("length") == 0) | F.col("rows").isNull(), "empty").otherwise(F.col("status"))
    kept = F.when(status == "found", F.col("rows") - F.col("duplicates")).otherwise(0)
    return held.select("image_id", status.alias("status"), kept.cast("long").alias("kept"), F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"))


def class_histogram(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n) of every class, zero-filled."""
    return classes.join(labels.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").na.fill(0, ["n"])


def dataset_stats(images: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: instances and images; zero-filled."""
    seen = labels.join(images, "image_id", "left_semi").groupBy("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
    return classes.join(seen, "cls", "left").na.fill(0, ["instances", "images"])


BUCKET_ROWS = 50_000


def hash_rank(rows: DataFrame, id_col: str, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Add ``__r`` and ``__n``: a row's place by hash in its group, from 1, and the group's rows.

    Rows of a group are numbered within hash buckets, each after the rows of the buckets before it, so
    no task ranks a whole group.
    """
    buckets = max(1, rows.count() // BUCKET_ROWS)
    group = [F.col(c) for c in by or []] or [F.lit(0)]
    names = [f"__g{i}" for i in range(len(group))]
    keyed = rows.withColumns(dict(zip(names, group))).withColumn("__u", hash_unit(F.lit(seed), F.col(id_col)))
    keyed = keyed.withColumn("__b", F.floor(F.col("__u") * buckets).cast("int"))
    sizes = keyed.groupBy(*names, "__b").agg(F.count("*").alias("c"))
    ahead, whole = Window.partitionBy(*names).orderBy("__b"), Window.partitionBy(*names)  # one row for each bucket
    before = sizes.select(*names, "__b", (F.sum("c").over(ahead) - F.col("c")).alias("__before"), F.sum("c").over(whole).alias("__n"))
    on = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*names, "__b")]
    local = F.row_number().over(Window.partitionBy(*(f"k.{c}" for c in (*names, "__b"))).orderBy("__u", F.col(f"k.{id_col}")))
    placed = keyed.alias("k").join(before.alias("s"), reduce(lambda a, b: a & b, on)).withColumn("__r", F.col("__before") + local)
    return placed.select(*(f"k.{c}" for c in rows.columns), "__r", "__n")


def quota_split(rows: DataFrame, ratio: float, id_col: str, by: list[str] | None = None, seed: int = 0, floor: bool = False, least: int = 0) -> DataFrame:
    """Add ``split``: the round (or floor) of ``ratio`` of each group's rows, at least ``least``, chosen by hash, are val."""
    size = F.floor(F.col("__n") * ratio) if floor else F.bround(F.col("__n") * ratio)
    val = F.col("__r") <= F.greatest(size, F.lit(least))
    return hash_rank(rows, id_col, by, seed).withColumn("split", F.when(val, "val").otherwise("train")).select(*rows.columns, "split")


def recipes(rows: DataFrame, weights: list[tuple[str, float]], id_col: str, seed: int = 0) -> DataFrame:
    """Add ``recipe``: each takes its rounded weight of all rows in hash order, the last what is left."""
    chosen, edge = F.lit(weights[-1][0]), F.lit(0)
    edges = []
    for name, weight in weights[:-1]:
        edge = edge + F.bround(F.col("__n") * weight)
        edges.append((name, edge))
    for name, edge in reversed(edges):
        chosen = F.when(F.col("__r") <= edge, name).otherwise(chosen)
    return hash_rank(rows, id_col, seed=seed).withColumn("recipe", chosen).select(*rows.columns, "recipe")


def paired_donors(backgrounds: DataFrame, donors: DataFrame, seed: int = 0) -> DataFrame:
    """(image_id, donor): backgrounds in hash order take donors in hash order, over and over."""
    d = hash_rank(donors, "image_id", seed=seed + 1).select(F.col("image_id").alias("donor"), F.col("__r").alias("at"), F.col("__n").alias("donors"))
    b = hash_rank(backgrounds, "image_id", seed=seed)
    n = d.agg(F.max("donors").alias("n"))
    return b.join(F.broadcast(n)).withColumn("at", F.pmod(F.col("__r") - 1, F.col("n")) + 1).join(d, "at").select("image_id", "donor")


def copy_donors(labels: DataFrame, share: float, most: float = 0.3, cell: float = 0.25) -> DataFrame:
    """(image_id, det_id) of mirrored instances to paste: those that cover less than ``most`` of every instance, ``share`` of them from the least covering on.

    In an image of more than FEW instances mirrored and own ones meet in cells of side ``cell``, so only those that overlap
    are compared; others cover nothing.
    """
    sides = [c.alias(n) for c, n in zip(flipped(*(F.col(c) for c in CORNERS), width=F.lit(1.0)), CORNERS)]
    near = grid_pairs(labels.select("image_id", "det_id", *sides), labels.select("image_id", *CORNERS), ["image_id"], cell, FEW)
    cover = near.groupBy("image_id", F.col("a_det_id").alias("det_id")).agg(F.max(ioa(tuple(F.col(f"a_{n}") for n in CORNERS), tuple(F.col(f"b_{n}") for n in CORNERS))).alias("worst"))
    worst = labels.select("image_id", "det_id").join(cover, ["image_id", "det_id"], "left").na.fill(0.0, ["worst"]).where(F.col("worst") < most)
    image = Window.partitionBy("image_id")
    ranked = worst.withColumns({"r": F.row_number().over(image.orderBy("worst", "det_id")), "n": F.count("*").over(image)})
    return ranked.where(F.col("r") <= F.bround(F.col("n") * share)).select("image_id", "det_id")


def text_samples(labels: DataFrame, images: DataFrame, classes: int, most: int, negatives: int, seed: int = 0) -> DataFrame:
    """(image_id, texts): classes of an image, then classes it lacks by hash, ``most`` in all and ``negatives`` at most; padded with -1."""
    present = labels.groupBy("image_id").agg(F.sort_array(F.collect_set("cls")).alias("own"))
    held = images.join(present, "image_id", "left").withColumn("own", F.slice(F.coalesce("own", F.array().cast("array<int>")), 1, most))
    every = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(hash_unit(F.lit(seed), F.col("image_id"), c).alias("u"), c.alias("c")))
    lacking = F.transform(F.sort_array(F.filter(every, lambda x: ~F.array_contains("own", x["c"]))), lambda x: x["c"])
    taken = F.slice(lacking, F.lit(1), F.greatest(F.least(F.lit(min(classes, most)) - F.size("own"), F.lit(negatives)), F.lit(0)))
    texts = F.concat("own", taken)
    return held.select("image_id", F.concat(texts, F.array_repeat(F.lit(-1), F.lit(most) - F.size(texts))).alias("texts"))


def extrapolated(rows: DataFrame, value: str, id_col: str, most: int = 30, margin: float = 0.5, seed: int = 0) -> DataFrame:
    """One row: the total of ``value`` as ``most`` rows by hash suggest it, with a margin. The sample is the feature."""
    few = rows.select(F.col(value).alias("v"), hash_unit(F.lit(seed), F.col(id_col)).alias("u"), F.col(id_col).alias("i")).orderBy("u", "i").limit(most)
    n = rows.agg(F.count("*").alias("rows"))
    return few.agg(F.sum("v").alias("b"), F.count("*").alias("n")).join(n).select((F.col("b") * F.col("rows") / F.col("n") * (1 + margin)).alias("required"))


def stats_report(images: DataFrame, labels: DataFrame, classes: list[int]) -> DataFrame:
    """One row: instances, images and unlabelled images in all, and both by class in the order of ``classes``."""
    n = labels.groupBy("image_id", "cls").agg(F.count("*").alias("n"))
    by = images.join(n, "image_id", "left").groupBy("image_id").agg(*[F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in classes], F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return by.agg(
        F.sum("all").alias("instances"), F.array(*[F.sum(f"c{c}") for c in classes]).alias("instances_by_class"), F.count("*").alias("images"),
        F.sum((F.col("all") == 0).cast("long")).alias("unlabelled"), F.array(*[F.sum((F.col(f"c{c}") > 0).cast("long")) for c in classes]).alias("images_by_class"),
    )


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All datasets one after another with ``part``, the number of the one a row is from."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def unknown_labels(labels: DataFrame, name: str, known: list[str]) -> DataFrame:
    """Distinct labels that are not among ``known``, which may not repeat."""
    if len(known) != len(set(known)):
        raise ValueError("class names repeat")
    return labels.select(name).where(~F.col(name).isin(known) & (F.trim(name) != "")).distinct()


def weighted_split(rows: DataFrame, weights: list[tuple[str, float]], id_col: str, seed: int = 0) -> DataFrame:
    """Add ``split`` by cumulative weights of a hash in [0, 1)."""
    u, total, chosen = hash_unit(F.lit(seed), F.col(id_col)), 0.0, F.lit(weights[-1][0])
    steps = []
    for name, weight in weights:
        total += weight
        steps.append((name, total))
    for name, edge in reversed(steps[:-1]):
        chosen = F.when(u < edge, name).otherwise(chosen)
    return rows.withColumn("split", chosen)


def k_folds(labels: DataFrame, k: int, classes: list[int], seed: int = 0) -> DataFrame:
    """Per fold and class: val and train instances and their ratio (val / (train + 1e-7))."""
    fold = F.pmod(F.floor(hash_unit(F.lit(seed), F.col("image_id")) * 4294967296), F.lit(k)).cast("int")
    per = labels.withColumn("fold", fold).groupBy("fold", "cls").agg(F.count("*").alias("val"))
    total = F.sum("val").over(Window.partitionBy("cls"))
    return per.where(F.col("cls").isin(classes)).withColumn("train", total - F.col("val")).withColumn("ratio", F.col("val") / (F.col("train") + F.lit(1e-7)))


SHARD_KINDS, SWAPS = 2000, 8


def allotted(total: int, sizes: list[int]) -> list[int]:
    """``total`` in whole parts in proportion to ``sizes``; the largest remainders are rounded up, and no part exceeds its size."""
    whole = sum(sizes)
    if not whole:
        return [0] * len(sizes)
    parts = [total * n // whole for n in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (-(total * sizes[i] % whole), i))
    for i in order[: total - sum(parts)]:
        parts[i] += 1
    return parts


def chosen_kinds(counts, sizes, targets, wanted: int):
    """How many images of each kind to take: ``wanted`` in all, their class sums near ``targets``.

    ``counts`` is kinds x classes, ``sizes`` the images of each kind. Greedy by the loss less a bonus
    for missing classes, a run of one kind at a time while it is still the best at the run's end, then
    at most SWAPS swaps that lower the loss.
    """
    import numpy as np

    took, have, scale = np.zeros(len(sizes), np.int64), np.zeros(len(targets)), np.maximum(targets, 1)
    loss = lambda v: (((v - targets) / scale) ** 2).sum(-1)

    def best(at, open_):
        bonus = (np.minimum(counts, np.maximum(targets - at, 0)) / scale).sum(1)
        return int(np.argmin(np.where(open_, loss(at + counts) - 0.02 * bonus, np.inf)))

    left = min(wanted, int(sizes.sum()))
    while left > 0:
        open_ = took < sizes
        i = best(have, open_)
        most, run = min(left, int(sizes[i] - took[i])), 1
        while run < most and best(have + (min(2 * run, most) - 1) * counts[i], open_) == i:
            run = min(2 * run, most)
        took[i] += run
        left -= run
        have = have + run * counts[i]
    for _ in range(SWAPS):
        now = loss(have)
        for i in np.flatnonzero(took).tolist():
            after = np.where(took < sizes, loss(have - counts[i] + counts), np.inf)
            better = np.flatnonzero(after + 1e-12 < now)
            if len(better):
                took[i] -= 1
                took[better[0]] += 1
                have = have - counts[i] + counts[better[0]]
                break
        else:
            break
    return took


def stratified_split(labels: DataFrame, images: DataFrame, ratio: float, least: dict[int, int] | None = None, seed: int = 0) -> DataFrame:
    """(image_id, split): val images chosen so that class counts come near ``ratio`` of each class, at least ``least``.

    Images with the same class counts are interchangeable, so the choice runs over kinds of images,
    not over images: kinds are counted in Spark and dealt to shards of about SHARD_KINDS by hash. The
    targets of all, and the images to take, are allotted to the shards by what each holds; the choice
    (sequential by nature) is made for each shard in one task, and quotas are filled by hash order.
    Images without labels give their own share. A target above a class's total is an error.
    """
    import numpy as np
    import pandas as pd

    counts = labels.groupBy("image_id", "cls").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("kind"))
    every = images.join(counts, "image_id", "left").withColumn("kind", F.coalesce(F.to_json("kind"), F.lit("[]")))
    kinds = every.groupBy("kind").agg(F.count("*").alias("n"))
    shards = max(1, -(-kinds.count() // SHARD_KINDS))
    dealt = kinds.withColumn("shard", F.pmod(F.xxhash64("kind"), F.lit(shards)).cast("int"))
    pictures = {(r.shard, r.plain): r.n for r in dealt.groupBy("shard", (F.col("kind") == "[]").alias("plain")).agg(F.sum("n").alias("n")).collect()}
    per_kind = dealt.select("shard", F.col("n").alias("times"), F.explode(F.from_json("kind", "array<struct<cls: int, n: long>>")).alias("x"))
    held = {(r.shard, r.cls): r.n for r in per_kind.groupBy("shard", "x.cls").agg(F.sum(F.col("times") * F.col("x.n")).alias("n")).collect()}
    classes = sorted({c for _, c in held} | set(least or {}))
    total = {c: sum(held.get((i, c), 0) for i in range(shards)) for c in classes}
    target = {c: max(round(n * ratio), (least or {}).get(c, 0)) for c, n in total.items()}
    if impossible := [f"{c}: {target[c]} of {total[c]}" for c in classes if target[c] > total[c]]:
        raise ValueError(f"validation targets above the total of a class: {', '.join(impossible)}")
    blank = sum(n for (_, plain), n in pictures.items() if plain)
    blank_val = round(blank * ratio)
    shares = {c: allotted(target[c], [held.get((i, c), 0) for i in range(shards)]) for c in classes}
    with_labels = [pictures.get((i, False), 0) for i in range(shards)]
    wanted = allotted(min(round((blank + sum(with_labels)) * ratio) - blank_val, sum(with_labels)), with_labels)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        pdf = pdf.sort_values("kind").reset_index(drop=True)
        shard, place = int(pdf.shard[0]), {c: k for k, c in enumerate(classes)}
        vectors = np.zeros((len(pdf), len(classes)))
        for i, kind in enumerate(pdf.kind):
            for x in json.loads(kind):
                vectors[i, place[x["cls"]]] = x["n"]
        named = (pdf.kind != "[]").to_numpy()
        quota = np.full(len(pdf), blank_val, np.int64)  # of the kind without labels
        quota[named] = chosen_kinds(vectors[named], pdf.n.to_numpy()[named], np.array([shares[c][shard] for c in classes], float), wanted[shard])
        return pdf.assign(quota=quota)[["kind", "quota"]]

    quotas = dealt.groupBy("shard").applyInPandas(choose, "kind string, quota long")
    ranked = hash_rank(every, "image_id", ["kind"], seed)
    return ranked.join(quotas, "kind").select("image_id", F.when(F.col("__r") <= F.col("quota"), "val").otherwise("train").alias("split"))


def minority_images(labels: DataFrame, wanted: int, excluded: list[int]) -> DataFrame:
    """Images that have class ``wanted`` and none of ``excluded``."""
    flags = labels.groupBy("image_id").agg(F.max(F.when(F.col("cls") == wanted, 1).otherwise(0)).alias("w"), F.max(F.when(F.col("cls").isin(excluded), 1).otherwise(0)).alias("x"))
    return flags.where("w = 1 AND x = 0").select("image_id")


def oversample(rows: DataFrame, chosen: DataFrame, variants: int) -> DataFrame:
    """Every row of a chosen image ``variants`` times, numbered from 1."""
    return rows.join(chosen, "image_id", "left_semi").withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))


def repetition_plan(labels: DataFrame, most: int) -> DataFrame:
    """(image_id, repeats): the rounded ratio of the largest class total to the total of the image's rarest class, at most ``most``."""
    total = labels.groupBy("cls").agg(F.count("*").alias("n"))
    top = total.agg(F.max("n").alias("top"))
    rarest = labels.select("image_id", "cls").distinct().join(F.broadcast(total), "cls").groupBy("image_id").agg(F.min("n").alias("n"))
    return rarest.join(F.broadcast(top)).select("image_id", F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.col("top") / F.col("n")))).cast("long").alias("repeats"))


def grid_tiles(labels: DataFrame, grid: int, width: float = 1.0, height: float = 1.0, min_visible: float = 0.2, min_pixels: float = 2.0) -> DataFrame:
    """Labels clipped to a ``grid`` x ``grid`` tiling: tile, xywh relative to it; small or mostly hidden parts go."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1)))
    t = labels.withColumn("tile", cells)
    tw, th = width / grid, height / grid
    left, top = (F.col("tile") % grid) * tw, F.floor(F.col("tile") / grid) * th
    x1, y1, x2, y2 = xywh_to_xyxy(F.col("x") * width, F.col("y") * height, F.col("w") * width, F.col("h") * height)
    a, b, c, d = F.greatest(x1, left), F.greatest(y1, top), F.least(x2, left + tw), F.least(y2, top + th)
    visible = (c - a) * (d - b) / ((x2 - x1) * (y2 - y1))
    kept = t.where((c - a >= min_pixels) & (d - b >= min_pixels) & (visible >= min_visible))
    x, y, w, h = xyxy_to_xywh(a - left, b - top, c - left, d - top)
    return kept.withColumns({"x": x / tw, "y": y / th, "w": w / tw, "h": h / th})


def window_grid(images: DataFrame, crop: int, gap: int, least: float = 0.6, eps: float = 0.01) -> DataFrame:
    """Sliding windows of each image (image_id, width, height; one row an image): the last is moved to the border; windows mostly outside go, unless all are."""
    step = crop - gap
    starts = lambda size: F.transform(F.sequence(F.lit(0), F.when(F.col(size) <= crop, 0).otherwise(F.ceil((F.col(size) - crop) / step)).cast("int")), lambda i: F.when((F.col(size) > crop) & (i * step + crop > F.col(size)), F.col(size) - crop).otherwise(i * step))
    # the largest share of an image's windows is the product of the largest shares of both sides, so no windows need to meet
    held = lambda at, size: F.array_max(F.transform(at, lambda x: F.least(x + crop, F.col(size)) - x))
    tops = images.withColumns({"xs": F.array_distinct(starts("width")), "ys": F.array_distinct(starts("height"))})
    tops = tops.withColumn("top", held("xs", "width") * held("ys", "height") / float(crop * crop))
    w = tops.withColumn("x1", F.explode("xs")).withColumn("y1", F.explode("ys"))
    inside = (F.least(F.col("x1") + crop, "width") - F.col("x1")) * (F.least(F.col("y1") + crop, "height") - F.col("y1")) / float(crop * crop)
    rated = w.withColumn("ratio", inside)
    return rated.where((F.col("ratio") > least) | ((F.col("top") <= least) & (F.col("ratio") > F.col("top") - eps))).select("image_id", "x1", "y1", (F.col("x1") + crop).alias("x2"), (F.col("y1") + crop).alias("y2"), "ratio")


def category_frequency(captions: DataFrame, text: str, separator: str = "/") -> DataFrame:
    """(category, n) of trimmed, lower-cased parts."""
    parts = captions.select(F.explode(F.split(text, separator)).alias("part")).select(F.lower(F.trim("part")).alias("category"))
    return parts.where("category <> ''").groupBy("category").agg(F.count("*").alias("n"))


def frequent_categories(frequency: DataFrame, threshold: int = 100) -> DataFrame:
    """Categories with at least min(largest, ``threshold``) entries."""
    top = frequency.agg(F.max("n").alias("top"))
    return frequency.join(F.broadcast(top)).where(F.col("n") >= F.least("top", F.lit(threshold))).drop("top")


def histogram_2d(rows: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """(bx, by, n) over [0, 1) squared."""
    b = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return rows.where((F.col(x).between(0, 1)) & (F.col(y).between(0, 1))).groupBy(b(x).alias("bx"), b(y).alias("by")).agg(F.count("*").alias("n"))


def value_rank(rows: DataFrame, value: str, id_col: str, seed: int = 0) -> DataFrame:
    """Add ``__r``: a row's place among all by ``value``, then hash, from 1.

    Rows are numbered within ranges of the value, each after the rows of the ranges before it; a value
    that fills several ranges is parted by the hash, so no task ranks more than about BUCKET_ROWS.
    """
    buckets = max(1, rows.count() // BUCKET_ROWS)
    edges = rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    times = {e: edges.count(e) for e in sorted(set(edges))}
    known, repeated = F.array(*map(F.lit, times)).cast("array<double>"), F.array(*map(F.lit, times.values())).cast("array<int>")
    at = F.size(F.filter(known, lambda e: e <= F.col(value)))
    keyed = rows.withColumns({"__u": hash_unit(F.lit(seed), F.col(id_col)), "__a": at})
    same = F.get(known, F.col("__a") - 1) == F.col(value)
    keyed = keyed.withColumn("__s", F.when(same, F.floor(F.col("__u") * F.get(repeated, F.col("__a") - 1))).otherwise(buckets))
    sizes = keyed.groupBy("__a", "__s").agg(F.count("*").alias("c"))
    before = sizes.select("__a", "__s", (F.sum("c").over(Window.orderBy("__a", "__s")) - F.col("c")).alias("__before"))  # one row for each range
    local = F.row_number().over(Window.partitionBy("__a", "__s").orderBy(value, "__u", id_col))
    return keyed.join(F.broadcast(before), ["__a", "__s"]).withColumn("__r", F.col("__before") + local).select(*rows.columns, "__r")


def shape_batches(images: DataFrame, size: int, id_col: str = "image_id") -> DataFrame:
    """Images by aspect ratio in batches of ``size``, with each batch's least and largest ratio."""
    ratio = images.withColumn("ratio", F.col("height") / F.col("width"))
    placed = value_rank(ratio, "ratio", id_col).withColumn("batch", F.floor((F.col("__r") - 1) / size))
    return placed.groupBy("batch").agg(F.count("*").alias("n"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))


def box_columns(b: Box, names: str = "x1 y1 x2 y2") -> list[Column]:
    return [c.alias(n) for c, n in zip(b, names.split())]
