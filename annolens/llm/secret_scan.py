"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Patterns find assignments of long values to secret-like names, access keys and hexadecimal
runs. Two first-order character models, one of random strings and one of ordinary
identifiers, are counted from labelled samples: the values that the patterns matched in
all documents, and the runs of token characters outside the patterns' matches in a sample
of about ``sample_docs`` documents chosen by hash (a bounded sample for fitting; every text
is scanned and every candidate scored). Rates of a pair back off to those of its second
character. A run of LEAST token characters or more is a secret if its log-likelihood ratio
outweighs prior odds of one secret in PRIOR runs, so that a short run must look more random
than a long one. Such spans are added to the pattern spans; runs that overlap one are left out.

All of it is Column expressions: spans are the running sums of the lengths of matches and of
the gaps between them, in code points, taken block by block so that a text of many matches
costs little more than in proportion; overlaps are found by one merge of the sorted spans. The
model is one array of len(ALPHABET) squared numbers, whatever the corpus holds.

Cases: null or empty text has no spans; texts without ASCII or of any length are scanned
whole; repeated rows give repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm._common import cut, let

#: name, pattern, group of the value, least characters of the value (fixed values)
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
MARKOV = "markov"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 12
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ORDINARY = r"[A-Za-z0-9+/_=-]{4,}"
SAMPLE_DOCS = 20_000
BACKOFF = 64.0
PRIOR = 10
BLOCK = 256
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def _running(values: Column, op) -> Column:
    """Inclusive running results of ``op`` over an array of integers: within blocks, then with what came before a block."""

    def folded(a: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            return F.concat(acc, F.array(F.when(last.isNull(), x).otherwise(op(last, x))))

        return F.aggregate(a, F.array().cast("array<int>"), step)

    def joined(blocks: Column) -> Column:
        before = folded(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        shift = lambda b, i, o: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(o, i - 1), x)))
        return let(before, lambda o: F.flatten(F.transform(blocks, lambda b, i: shift(b, i, o))))

    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
    return let(F.transform(starts, lambda i: folded(F.slice(values, i + 1, F.lit(BLOCK)))), joined)


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind, value); short values are dropped after matching."""
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m

    def placed(found: Column) -> Column:
        def ended(gaps: Column) -> Column:
            return _running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda a, b: a + b)

        def spanned(ends: Column) -> Column:
            one = lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.lit(kind).alias("k"), F.get(ends, i).alias("e"), value(m).alias("v"))
            return F.filter(F.transform(found, one), lambda x: F.length(x["v"]) >= least)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(let(F.split(text, pattern, -1), ended), spanned))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``base`` (pattern spans) and ``candidates`` (runs of token characters) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[_spans(text, p, k, g, n) for k, (_, p, g, n) in enumerate(KINDS)])
    return docs.select(id_col, F.sort_array(base).alias("base"), _spans(text, CANDIDATE, len(KINDS), 0, 0).alias("candidates"))


def _transitions(strings: DataFrame) -> DataFrame:
    """(pair, n) of neighbouring characters of the column ``v``."""
    pairs = let(F.split("v", ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1))))
    return strings.where(F.length("v") >= 2).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _rates(counts: DataFrame) -> list[list[float]]:
    """Rate of each second character after each first, backing off to its rate after any."""
    size, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    table = [[0] * size for _ in range(size)]
    for r in counts.collect():  # one row for each pair of characters at most
        a, b = at.get(r.pair[0]), at.get(r.pair[1])
        if a is not None and b is not None:
            table[a][b] += r.n
    total = sum(map(sum, table))
    alone = [(sum(column) + 1) / (total + size) for column in zip(*table)]
    return [[(n + BACKOFF * u) / (sum(row) + BACKOFF) for n, u in zip(row, alone)] for row in table]


def train(scanned: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """The log-likelihood ratio of each pair of ALPHABET, row by row."""
    random_counts = _transitions(scanned.select(F.explode("base").alias("b")).select("b.v"))
    share = max(1, scanned.count() // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(share)) == 0)
    rest = F.col(text_col)
    for _, pattern, *_ in KINDS:
        rest = F.regexp_replace(rest, pattern, " ")
    word_counts = _transitions(sample.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("v")))
    return [math.log(p / q) for random_row, word_row in zip(_rates(random_counts), _rates(word_counts)) for p, q in zip(random_row, word_row)]


def log_ratio(value: Column, model: Column) -> Column:
    """Log-likelihood ratio of a string over ALPHABET."""
    size = len(ALPHABET)

    def total(at: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.get(model, (F.get(at, i) - 1) * size + F.get(at, i + 1) - 1))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)

    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)), total)


def free(base: Column, candidates: Column) -> Column:
    """Those of ``candidates``, which do not overlap each other, that no span of ``base`` overlaps."""
    of_base = lambda x: x["k"] < len(KINDS)

    def merged(every: Column) -> Column:
        reach = _running(F.transform(every, lambda x: F.when(of_base(x), x["e"]).otherwise(0)), F.greatest)

        def kept(ends: Column) -> Column:
            def alone(x: Column, i: Column) -> Column:
                after = F.get(every, i + 1)
                touched = F.coalesce(of_base(after) & (after["s"] < x["e"]), F.lit(False))
                return ~of_base(x) & (F.get(ends, i) <= x["s"]) & ~touched

            return F.filter(every, alone)

        return let(reach, kept)

    return F.when(F.size(base) == 0, candidates).when(F.size(candidates) == 0, candidates).otherwise(let(F.sort_array(F.concat(base, candidates)), merged))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """id, ``base`` and ``spans`` (base and added spans by start) of every row; texts are scanned once."""
    scanned = cut(scan(docs, id_col, text_col))
    numbers = ",".join(f"{x:.6f}" for x in train(scanned, docs, id_col, text_col, sample_docs))
    model = F.from_json(F.lit(f"[{numbers}]"), "array<double>")
    added = F.filter(free(F.col("base"), F.col("candidates")), lambda c: log_ratio(c["v"], model) >= math.log(PRIOR))
    return scanned.select(id_col, "base", F.sort_array(F.concat("base", added)).alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def counted(spans: Column, kind: str) -> Column:
    k = [name for name, *_ in KINDS].index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")
