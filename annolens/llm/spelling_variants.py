"""Words that differ by one inserted, deleted or replaced character, found by their rarest bigrams.

The bigrams of all words are put in one order, from rare to frequent (ties by text). One edit leaves all
but two bigrams of either word as they are, so two near words share one of the three that come first in
each: their prefixes. A shared bigram has the same place in words of equal length; in a word longer by
one it has the same place or the next. So prefixes are joined on bigram, place and length, and the edit
distance is verified in the join. If bigrams of one kind repeat in a word, earlier places come first; the
k-th one that an edit leaves is the k-th left in the other word, so the first of them is in both prefixes.

The number of bigrams is bounded by the square of the alphabet (of 90 letters as the query takes words),
which is what is broadcast. Chains of forms are followed by pointer doubling: counts grow tenfold with each step,
so a chain has fewer than twenty and five rounds reach its end. All expressions are Spark's own.

Cases: a null text has no words; a null id counts as an empty one in the query's rule; repeated rows count
each time; an empty table gives an empty result; extra columns are ignored. A word of fewer than four
characters has too few bigrams for a prefix and is near none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm._common import cut, remove, shared_dir

LETTERS = "A-Za-zÀ-ÿ"
PREFIX = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every run of letters of at least ``least`` of them, A to Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(id_col, F.explode(found).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def vocabulary(words: DataFrame, least: int = 7, occurrences: int = 2, word: str = "word") -> DataFrame:
    """(word, n) of the words of at least ``least`` characters that occur at least ``occurrences`` times."""
    long = words.where(F.length(word) >= least)
    return long.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def prefixes(words: DataFrame) -> DataFrame:
    """(word, n, size, gram, at): the three bigrams of each word that come first in the order of all."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") > PREFIX).select("word", "n", F.explode(F.transform(places, lambda i: F.struct(F.substring(F.col("word"), i, F.lit(2)).alias("gram"), i.alias("at")))).alias("g"))
    grams = grams.select("word", "n", "g.gram", "g.at")
    order = grams.groupBy("gram").agg(F.count("*").alias("frequency"))  # alphabet squared at most
    ranked = grams.join(F.broadcast(order), "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("frequency", "gram", "at"))).alias("g"))
    return ranked.select("word", "n", F.length("word").alias("size"), F.explode(F.slice("g", 1, PREFIX)).alias("g")).select("word", "n", "size", "g.gram", "g.at")


def _intact(size: Column, at: Column, least: Column) -> Column:
    """What an edit leaves of a word beside a bigram that it leaves, by the half of the side it is on; as hashes.

    ``least`` is the length of the shorter word of a pair. An edit behind the bigram, which then has the same place ``at`` in both
    words, leaves the part up to the bigram and one half of the rest; one before it leaves what the bigram begins
    and one half of the start.
    """
    word, tail = F.col("word"), size - at + 1
    behind, place = least - at - 1, least - tail + 1
    half = lambda x: F.floor(x / 2).cast("int")
    key = lambda kind, where, *parts: F.xxhash64(F.lit(kind), least, where, *parts)
    after = F.array(key(1, at, F.left(word, at + 1 + half(behind))), key(2, at, F.left(word, at + 1), F.right(word, behind - half(behind))))
    before = F.array(key(3, place, F.right(word, tail + half(place - 1))), key(4, place, F.left(word, place - 1 - half(place - 1)), F.right(word, tail)))
    none = F.array().cast("array<bigint>")
    return F.concat(F.when(behind >= 0, after).otherwise(none), F.when(place >= 1, before).otherwise(none))


def near(first: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of every two words at distance one, once, b the longer or else the later one; ``first`` is a written table of prefixes."""
    size, at = F.col("size"), F.col("at")
    keyed = lambda keys, name: first.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), size.alias(f"{name}_size"), F.explode(keys).alias("key"))
    a = keyed(_intact(size, at, size), "a")
    b = keyed(F.concat(_intact(size, at, size), _intact(size, at, size - 1)), "b")
    apart = (F.col("b_size") > F.col("a_size")) | (F.col("a") < F.col("b"))
    close = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return a.join(b, "key").where(apart & close).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain that starts at each word of ``forms`` (word, form)."""
    path = shared_dir(forms.sparkSession)
    now = cut(forms.select("word", F.col("form").alias("root")), path)
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = shared_dir(forms.sparkSession)
        held = cut(moved, new)
        remove(forms.sparkSession, path)
        now, path = held.select("word", "root"), new
        if held.where("moved").isEmpty():
            return now


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n).

    A word's form is the most frequent of its near words (ties: the first in code-point order) if it
    occurs at least ``ratio`` times as often, root the end of the chain of forms.
    """
    spark = words.sparkSession
    known, first, pairs = (shared_dir(spark) for _ in range(3))
    words = cut(words, known)
    found = near(cut(prefixes(words), first))
    both = cut(found.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )).alias("p")).select("p.*"), pairs)
    remove(spark, first)
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    for done in (known, pairs):
        remove(spark, done)
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
