"""Weak supervision of text quality: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one ratio of a document and votes good, bad, or abstains. The
votes of all documents are counted by pattern (at most 3 to the number of rules,
whatever the corpus holds); expectation-maximisation on those counts estimates, for
each rule, how often it votes each way on good and on bad documents, and the share of
good ones. A document's posterior probability of being good then decides, instead of
every rule having to pass. Features, votes and posteriors are Column expressions;
documents are read once for the votes and not shuffled.

Base features of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
as described at ``features``; a text with fewer than MIN_WORDS words or more than a
fifth of its words in repeated windows fails outright.

Cases: null or empty text has no words and fails the base rule; repeated rows are
judged alike; an empty table fits the starting values and returns nothing; extra
columns stay, and columns named like a feature are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm._common import cut, let

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
GOOD, BAD, ABSTAIN = 1, -1, 0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(placed: Column) -> Column:
        twice = F.filter(placed, lambda e, i: ((i > 0) & (F.get(placed, i - 1)["h"] == e["h"])) | F.coalesce(F.get(placed, i + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def counted(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(placed, repeated))

    return let(grams, counted)


def features(text: Column) -> Column:
    """A struct of the base features and of the counts that the rules look at.

    n_words: words ``[^\\x20\\x09-\\x0D]+``; word_chars: their code points; n_symbols: characters of SYMBOLS;
    n_dup_lines: lines with a word equal to an earlier line; n_repeat_words: words in repeated windows.
    """
    text = F.coalesce(text, F.lit(""))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    trimmed = F.btrim(text, F.lit(SPACES))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            only("#*$%&|<>").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(hashes(w), lambda h: _repeat_words(h, n)).alias("n_repeat_words"),
            let(hashes(w), lambda h: F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, i - 1) == x)))).cast("long").alias("n_stutter"),
            let(lines, F.size).cast("long").alias("n_lines"),
            only("A-Z").alias("n_upper"),
            only("!").alias("n_bangs"),
            F.regexp_count(text, F.lit("[#*$%&!]{2,}")).cast("long").alias("n_marked"),
            ((F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("")))) / 3).cast("long").alias("n_bars"),
        )

    return let(split, of_words)


def base_failed(f) -> Column:
    return (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > 20 * f("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad at ``bad`` or above, good at ``good`` or below, and abstains in between or without a denominator."""

    name: str
    part: str
    whole: str
    good: float
    bad: float

    def vote(self, f) -> Column:
        ratio = f(self.part) / F.when(f(self.whole) > 0, f(self.whole))
        return F.when(ratio >= self.bad, BAD).when(ratio <= self.good, GOOD).otherwise(ABSTAIN)


RULES = [
    Rule("symbols", "n_symbols", "word_chars", 0.005, 0.05),
    Rule("marked words", "n_marked", "n_words", 0.02, 0.2),
    Rule("table bars", "n_bars", "n_words", 0.02, 0.2),
    Rule("capitals", "n_upper", "word_chars", 0.1, 0.3),
    Rule("exclamations", "n_bangs", "n_words", 0.02, 0.3),
    Rule("stutter", "n_stutter", "n_words", 0.03, 0.3),
    Rule("repeated words", "n_repeat_words", "n_words", 0.1, 0.18),
]


@dataclass
class Model:
    """Log-odds that a document is good: a start value and one weight for each vote of each rule."""

    prior: float = 0.8
    rates: list = field(default_factory=list)  # for each rule: {vote: (rate if good, rate if bad)}
    rounds: int = 0

    def log_odds(self, votes: list) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(r[v][0] / r[v][1]) for r, v in zip(self.rates, votes))

    def posterior(self, columns: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rates, c in zip(self.rates, columns):
            weight = {v: math.log(g / b) for v, (g, b) in rates.items()}
            odds = odds + F.when(c == GOOD, weight[GOOD]).when(c == BAD, weight[BAD]).otherwise(weight[ABSTAIN])
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 50, smooth: float = 1.0) -> Model:
    """Expectation-maximisation for two classes on counted vote patterns.

    It starts by believing any bad vote, which fixes which class is which: a kind of junk usually shows
    in one rule only, so the good votes of the others must not outvote it from the start. Rates are
    smoothed by ``smooth`` votes.
    """
    good = [0.05 if BAD in v else 0.95 for v, _ in patterns]
    model = Model(rates=[{GOOD: (0.6, 0.2), ABSTAIN: (0.3, 0.3), BAD: (0.1, 0.5)} for _ in range(n_rules)])
    for done in range(rounds if patterns else 0):
        total = sum(n for _, n in patterns)
        share = sum(n * g for (_, n), g in zip(patterns, good))
        model.prior = min(0.999, max(0.001, (share + smooth) / (total + 2 * smooth)))
        for k in range(n_rules):
            rates = {}
            for vote in (GOOD, ABSTAIN, BAD):
                a = sum(n * g for (v, n), g in zip(patterns, good) if v[k] == vote)
                b = sum(n * (1 - g) for (v, n), g in zip(patterns, good) if v[k] == vote)
                rates[vote] = ((a + smooth) / (share + 3 * smooth), (b + smooth) / (total - share + 3 * smooth))
            model.rates[k] = rates
        now = [1 / (1 + math.exp(-max(-500, min(500, model.log_odds(v))))) for v, _ in patterns]
        model.rounds = done + 1
        if max(abs(a - b) for a, b in zip(now, good)) < 1e-6:
            break
        good = now
    return model


def with_votes(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with the struct ``quality`` of features and the array ``votes``."""
    measured = docs.withColumn("quality", features(F.col(text_col)))
    f = lambda name: F.col(f"quality.{name}")
    return measured.withColumn("votes", F.array(*[r.vote(f) for r in rules]))


def judge(voted: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Fit on all rows of ``voted`` (a written table) that pass the base rule, and add base_failed, posterior and kept."""
    f = lambda name: F.col(f"quality.{name}")
    counted = voted.where(~base_failed(f)).groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    model = fit([(tuple(r.votes), r["count"]) for r in counted], len(rules))
    posterior = model.posterior([F.get("votes", F.lit(k)) for k in range(len(rules))])
    return voted.withColumn("base_failed", base_failed(f)).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base features, base_failed, posterior and kept for every row."""
    return judge(cut(with_votes(docs.select(id_col, text_col), text_col).drop(text_col))).select(id_col, *[f"quality.{c}" for c in BASE], "base_failed", "posterior", "kept")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows judged good, with all their columns; texts are measured once and written with their votes."""
    names = [c if c not in ("quality", "votes", "base_failed", "posterior", "kept") else f"__{c}" for c in docs.columns]
    voted = cut(with_votes(docs.toDF(*names), text_col), codec="snappy")
    return judge(voted).where("kept").select(*names).toDF(*docs.columns)
