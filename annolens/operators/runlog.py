"""Analytics over run logs: best epochs, smoothing, outlier rejection, fits, early stopping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolens.operators.datasets import hash_unit


def best_epoch(log: DataFrame, value: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Each run's epoch of largest value, the first on ties."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).alias("b")
    return log.groupBy(run).agg(best).select(run, (-F.col("b.e")).alias(epoch), F.col("b.v").alias(value))


def gaussian_smooth(log: DataFrame, value: str, sigma: float = 3.0, truncate: float = 4.0, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Add ``smooth``: the value under a Gaussian kernel; series are mirrored at both ends.

    ``epoch`` counts from 1 without gaps. What is mirrored lies within the kernel's reach of a row,
    so one window holds all that the row needs.
    """
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.lit(w / sum(weights)) for w in weights])
    w = Window.partitionBy(run).orderBy(epoch)
    near = F.collect_list(F.col(value)).over(w.rowsBetween(-radius, radius))
    placed = log.withColumns({"__near": near, "__n": F.count("*").over(Window.partitionBy(run))})

    def weighed(total, k):
        period = 2 * F.col("__n")
        fold = F.pmod(F.col(epoch) + k - 1, period)
        source = F.when(fold < F.col("__n"), fold).otherwise(period - 1 - fold) + 1
        at = (source - F.col(epoch) + F.least(F.col(epoch) - 1, F.lit(radius))).cast("int")
        return total + F.get(kernel, k + radius) * F.get("__near", at)

    return placed.withColumn("smooth", F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), weighed)).drop("__near", "__n")


def sigma_clip(rows: DataFrame, value: str, sigma: float = 2.0, rounds: int = 3, by: list[str] | None = None, lower_only: bool = False) -> DataFrame:
    """Rows within ``sigma`` population deviations of the mean, repeated ``rounds`` times."""
    w = Window.partitionBy(*by) if by else None
    out = rows
    for _ in range(rounds):
        if w is not None:
            out = out.withColumns({"__m": F.avg(value).over(w), "__d": F.stddev_pop(value).over(w)})
        else:
            out = out.join(F.broadcast(out.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"))))
        low, high = F.col(value) >= F.col("__m") - sigma * F.col("__d"), F.col(value) <= F.col("__m") + sigma * F.col("__d")
        out = out.where(low if lower_only else low & high).drop("__m", "__d")
    return out


def linear_fit(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def increasing(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rows whose ``y`` is above that of the row before by ``x``, and the first: the points a memory fit uses."""
    before = F.lag(y).over(Window.partitionBy(*by).orderBy(x))
    return rows.withColumn("__y", before).where(F.col("__y").isNull() | (F.col(y) > F.col("__y"))).drop("__y")


def early_stop(log: DataFrame, value: str, patience: int, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """(run, stop): the first epoch at least ``patience`` after the best so far; null if none."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = -F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).over(w)["e"]
    late = log.withColumn("__b", best).withColumn("__late", F.col(epoch) - F.col("__b") >= patience)
    return late.groupBy(run).agg(F.min(F.when(F.col("__late"), F.col(epoch))).alias("stop"))


def top_results(results: DataFrame, n: int, fitness: str = "fitness") -> DataFrame:
    """The ``n`` rows of largest fitness."""
    return results.orderBy(F.desc(fitness), *[c for c in results.columns if c != fitness]).limit(n)


def crossover(parents: DataFrame, genes: list[str], k: int = 9, alpha: float = 0.2, seed: int = 0, fitness: str = "fitness") -> DataFrame:
    """(gene, value): a child of ``k`` parents drawn by fitness, each gene uniform over their range widened by ``alpha`` of it on both sides.

    ``parents`` is a report of a few rows, as of ``top_results``. A parent's weight is its fitness less the
    least, plus 1e-6; draws are numbers from the hash of seed and draw, looked up in the running sum of weights
    by falling fitness. A gene that all drawn parents share gets a range between 0.01 and 0.1.
    """
    order = Window.orderBy(F.desc(fitness), *genes)  # a few rows
    weight = F.col(fitness) - F.min(fitness).over(Window.partitionBy()) + 1e-6
    held = parents.select(fitness, *genes, weight.alias("__w")).withColumn("__high", F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = held.withColumns({"__low": F.col("__high") - F.col("__w"), "__all": F.sum("__w").over(Window.partitionBy())})
    draws = parents.sparkSession.range(k).select(hash_unit(F.lit(seed), F.lit("draw"), F.col("id")).alias("__u"))
    at = F.col("__u") * F.col("__all")
    drawn = held.join(F.broadcast(draws), (at >= F.col("__low")) & (at < F.col("__high")))
    each = drawn.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), F.col(g).cast("double").alias("v")) for g in genes])).alias("x")).select("x.*")
    ends = each.groupBy("gene").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    number = lambda what: hash_unit(F.lit(seed), F.lit(what), F.col("gene"))
    span = F.when(F.col("high") == F.col("low"), 0.01 + 0.09 * number("span")).otherwise(F.col("high") - F.col("low"))
    least, most = F.col("low") - alpha * F.col("span"), F.col("high") + alpha * F.col("span")
    return ends.withColumn("span", span).select("gene", (least + number("gene") * (most - least)).alias("value"))


def mutated(child: DataFrame, bounds: dict[str, tuple[float, ...]], chance: float = 0.5, sigma: float = 0.2, seed: int = 0, tries: int = 64) -> DataFrame:
    """(gene, value) of ``child`` with some genes scaled by a log-normal factor between 1/4 and 4, kept within ``bounds`` (low, high, and perhaps a gain), to five digits.

    Of ``tries`` draws by hash the first that changes a gene is taken.
    """
    spaces = child.sparkSession.createDataFrame([(g, float(b[0]), float(b[1]), float(b[2]) if len(b) == 3 else 1.0) for g, b in bounds.items()], "gene string, low double, high double, gain double")
    number = lambda what: hash_unit(F.lit(seed), F.lit(what), F.col("try"), F.col("gene"))
    normal = F.sqrt(-2 * F.ln(1 - number("size"))) * F.cos(2 * F.pi() * number("turn"))
    factor = F.when(number("mask") < chance, F.least(F.greatest(F.exp(normal * sigma * F.col("gain")), F.lit(0.25)), F.lit(4.0))).otherwise(1.0)
    draws = child.join(F.broadcast(spaces), "gene").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("factor", factor)
    used = draws.where("factor <> 1").agg(F.coalesce(F.min("try"), F.lit(0)).alias("used"))
    kept = draws.join(F.broadcast(used)).where("try = used")
    return kept.select("gene", F.round(F.least(F.greatest(F.col("value") * F.col("factor"), "low"), "high"), 5).alias("value"))


def smoothed_series(rows: DataFrame, value: str, taps: int, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Add ``smooth``: centred moving average over ``taps`` rows, the ends repeated."""
    half = taps // 2
    w = Window.partitionBy(run).orderBy(epoch)
    ends = Window.partitionBy(run)
    near = w.rowsBetween(-half, half)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    k, n = F.row_number().over(w), F.count("*").over(ends)
    before, after = F.greatest(F.lit(0), half - (k - 1)), F.greatest(F.lit(0), half - (n - k))
    return rows.withColumn("smooth", (F.sum(value).over(near) + first * before + last * after) / (2 * half + 1))


def benchmark_table(results: DataFrame, order: list[str], metric: str, floor: float) -> DataFrame:
    """A report of a few rows: numbered by ``order``, values as text with "-" for null, and whether ``metric`` is above ``floor``."""
    n = F.row_number().over(Window.orderBy(*order))  # one row for each exported format
    return results.select(n.alias("index"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in results.columns], F.coalesce(F.col(metric) > floor, F.lit(False)).alias("passed"))
