"""One-to-one association by costs: mutual nearest rounds, and assignments of largest total benefit.

Tables hold pairs (keys, a, b, cost or benefit) with the pairs that are possible only. All groups of
``keys`` are worked on together, round by round; a round is written to the shared folder, so the plan stays short
and lost executors cost no recomputation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.sources.folders import written

EXACT = 10
TOGETHER = 4


def mutual_nearest(costs: DataFrame, threshold: float, step: float = 0.05, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, a, b, cost, round) of pairs that are each other's nearest among those left, below a threshold that falls by ``step`` each round.

    Ties go to the smaller b of an a, and the smaller a of a b. With costs of 0 or more there are at most
    ``threshold / step`` rounds, rounded up; a group in which a round finds nothing is done, as its threshold only falls.
    """
    left, found, limit, n = costs.select(*keys, "a", "b", "cost"), [], threshold, 0
    of_a, of_b = Window.partitionBy(*keys, "a"), Window.partitionBy(*keys, "b")
    while True:
        near = left.where(F.col("cost") < limit)
        first = near.withColumn("__a", F.row_number().over(of_a.orderBy("cost", "b")))
        mutual = first.withColumn("__b", F.row_number().over(of_b.orderBy("cost", "a"))).withColumn("match", (F.col("__a") == 1) & (F.col("__b") == 1))
        taken = mutual.withColumn("__b", F.max("match").over(of_b)).withColumn("__a", F.max("match").over(of_a))
        now = written(taken.select(*keys, "a", "b", "cost", "match", (F.col("__a") | F.col("__b")).alias("gone")))
        new = now.where("match")
        found.append(new.select(*keys, "a", "b", "cost", F.lit(n).alias("round")))
        if new.isEmpty():
            return reduce(DataFrame.union, found)
        left, limit, n = now.where("NOT gone").drop("match", "gone"), limit - step, n + 1


def _best_by_subset(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of the largest total for groups of at most EXACT b: the best total for every set of b in use, one a after another.

    With m of b, one of the first m of a by benefit is free for every b, so others need no look. Of equal
    totals the list of pairs that comes last in order is taken.
    """
    top = F.row_number().over(Window.partitionBy(*keys, "b").orderBy(F.desc("benefit"), "a"))
    some = edges.withColumn("__r", top).where(F.col("__r") <= EXACT)
    named = some.withColumn("p", F.dense_rank().over(Window.partitionBy(*keys).orderBy("a"))).withColumn("o", F.dense_rank().over(Window.partitionBy(*keys).orderBy("b")) - 1)
    pair = F.struct("a", "b", "benefit")
    turns = written(named.groupBy(*keys, "p").agg(F.sort_array(F.collect_list(F.struct("o", pair.alias("pair")))).alias("options")))
    last = turns.agg(F.max("p")).first()[0] or 0
    kind = turns.schema["options"].dataType.elementType["pair"].dataType.simpleString()
    states = turns.select(*keys).distinct().select(*keys, F.lit(0).alias("used"), F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{kind}>").alias("pairs"))
    for p in range(1, last + 1):
        both = states.join(turns.where(F.col("p") == p).select(*keys, "options"), keys, "left")
        state = lambda used, total, pairs: F.struct(used.alias("used"), total.alias("total"), pairs.alias("pairs"))
        bit = lambda o: F.element_at(F.array(*[F.lit(1 << i) for i in range(EXACT)]), o["o"] + 1)
        free = F.filter(F.coalesce("options", F.array().cast(turns.schema["options"].dataType)), lambda o: F.col("used").bitwiseAND(bit(o)) == 0)
        taken = F.transform(free, lambda o: state(F.col("used").bitwiseOR(bit(o)), F.col("total") + o["pair"]["benefit"], F.concat(F.col("pairs"), F.array(o["pair"]))))
        each = both.select(*keys, F.explode(F.concat(F.array(state(F.col("used"), F.col("total"), F.col("pairs"))), taken)).alias("s")).select(*keys, "s.*")
        best = each.groupBy(*keys, "used").agg(F.max(F.struct("total", "pairs")).alias("m"))
        states = best.select(*keys, "used", "m.total", "m.pairs")
        if p % TOGETHER == 0:
            states = written(states)
    final = states.groupBy(*keys).agg(F.max(F.struct("total", "pairs")).alias("m"))
    return final.select(*keys, F.explode("m.pairs").alias("x")).select(*keys, "x.*")


def auction(edges: DataFrame, keys: list[str], finest: float = 1.0) -> DataFrame:
    """Pairs whose total benefit is within ``2 n * finest`` of the largest, n a group's number of a and b; exact for whole benefits if that is below 1.

    Every a gets a b of its own that stands for having no partner, every b such an a, and the stand-ins of a pair
    may take each other, so that all bidders end with something. All without an object bid at once for the one of
    largest benefit less price; the price rises by what it is ahead of the second, and by epsilon. Epsilon starts at
    an eighth of the largest benefit and falls to ``finest`` by quarters, each time from the prices found before.
    """
    edges = written(edges.select(*keys, "a", "b", F.col("benefit").cast("double").alias("benefit")))
    side = lambda who, c: F.struct(F.lit(who).alias("side"), F.col(c).alias("id"))
    zero = F.lit(0.0)
    possible = [
        edges.select(*keys, side("a", "a").alias("who"), side("b", "b").alias("what"), "benefit"),
        edges.select(*keys, side("b", "b").alias("who"), side("a", "a").alias("what"), zero.alias("benefit")),
        edges.select(*keys, "a").distinct().select(*keys, side("a", "a").alias("who"), side("a", "a").alias("what"), zero.alias("benefit")),
        edges.select(*keys, "b").distinct().select(*keys, side("b", "b").alias("who"), side("b", "b").alias("what"), zero.alias("benefit")),
    ]
    possible = written(reduce(DataFrame.union, possible))
    most = edges.agg(F.max("benefit")).first()[0] or 0.0
    owner = F.lit(None).cast(possible.schema["who"].dataType)
    prices = possible.select(*keys, "what").distinct().select(*keys, "what", zero.alias("price"), owner.alias("owner"))
    epsilon = max(most / 8, finest)
    while True:
        prices = prices.withColumn("owner", owner)
        while True:
            prices = written(prices)
            owners = prices.where(F.col("owner").isNotNull()).select(*keys, F.col("owner").alias("who"))
            free = possible.join(owners, [*keys, "who"], "left_anti")
            if free.isEmpty():
                break
            net = free.join(prices.drop("owner"), [*keys, "what"]).withColumn("net", F.col("benefit") - F.col("price"))
            two = F.slice(F.sort_array(F.collect_list(F.struct("net", "what", "price")), asc=False), 1, 2)
            # the prices that matter are those of this bidder's objects only
            top = net.groupBy(*keys, "who").agg(two.alias("t"))
            ahead = F.when(F.size("t") > 1, F.get("t", F.lit(0))["net"] - F.get("t", F.lit(1))["net"]).otherwise(F.lit(most))
            bids = top.select(*keys, "who", F.col("t")[0]["what"].alias("what"), (F.col("t")[0]["price"] + ahead + epsilon).alias("bid"))
            won = bids.groupBy(*keys, "what").agg(F.max(F.struct("bid", "who")).alias("w"))
            after = prices.join(won, [*keys, "what"], "left")
            prices = after.select(*keys, "what", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.who", "owner").alias("owner"))
        if epsilon <= finest:
            break
        epsilon = max(epsilon / 4, finest)
    sold = prices.where("what.side = 'b' AND owner.side = 'a'").select(*keys, F.col("owner.id").alias("a"), F.col("what.id").alias("b"))
    return sold.join(edges, [*keys, "a", "b"])


def parted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with __part, the smallest a that pairs lead to: what is in different parts of a group has no pair in common.

    Every round takes the smallest over each b, then over each a, until nothing changes.
    """
    now, changed = edges.withColumn("__part", F.col("a")), True
    while changed:
        b = F.min("__part").over(Window.partitionBy(*keys, "b"))
        a = F.min("__b").over(Window.partitionBy(*keys, "a"))
        step = written(now.withColumn("__b", b).withColumn("__a", a).withColumn("__new", F.col("__a") < F.col("__part")))
        changed = not step.where("__new").isEmpty()
        now = step.select(*edges.columns, F.col("__a").alias("__part"))
    return now


def assign(edges: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, a, b, benefit): pairs of the largest total, nothing twice; ``benefit`` is a whole number, and only those above 0 count.

    Groups fall into parts without pairs between them. Parts with at most EXACT of b, or of a, go set by set; larger
    ones by auction, which is exact too as long as benefits are whole (epsilon is below one over the part's size).
    """
    names, keys = list(keys), [*keys, "__part"]
    edges = parted(edges.where("benefit > 0").select(*names, "a", "b", F.col("benefit").cast("long").alias("benefit")), names)
    sizes = edges.groupBy(*keys).agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    dealt = written(edges.join(sizes, keys))
    few_b, few_a = F.col("nb") <= EXACT, F.col("na") <= EXACT
    turned = [F.col("b").alias("a"), F.col("a").alias("b"), "benefit"]
    straight = _best_by_subset(dealt.where(few_b).select(*keys, "a", "b", "benefit"), keys)
    swapped = _best_by_subset(dealt.where(~few_b & few_a).select(*keys, *turned), keys).select(*keys, *turned)
    out, large = straight.union(swapped), dealt.where(~few_b & ~few_a)
    widest = large.agg(F.max(F.col("na") + F.col("nb"))).first()[0]
    if widest:
        out = out.union(auction(large, keys, 0.9 / (2 * widest)).select(*keys, "a", "b", F.col("benefit").cast("long")))
    return out.drop("__part")


def unmatched(rows: DataFrame, pairs: DataFrame, keys: tuple[str, ...], name: str, side: str) -> DataFrame:
    """Rows of one side that no pair holds; ``name`` is their own column, ``side`` that of the pairs."""
    return rows.join(pairs.select(*keys, F.col(side).alias(name)), [*keys, name], "left_anti")
