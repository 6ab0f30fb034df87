"""Class-based n-gram scoring: words in classes found by exchange, class transitions, word emissions.

Core words, the most frequent ones (CORE at most), a document's end, and one type for all other
words are counted as neighbours in Spark. Exchange clustering then moves core words, one after
another, to the class that raises the likelihood of the class bigrams most; a word's neighbours
are counted exactly at each move, its own bigram apart, so no move lowers the likelihood, and it
ends when a round moves nothing or adds less than a share of TOLERANCE. Their bigrams are at most
(CORE + 2) squared numbers, whatever the corpus holds. There are about as many classes as the
square root of the core words.

Every other word of LEAST or more occurrences gets its class in Spark, by the exchange gain of its
counts before and after each class to first order (one move of each word, against the classes of
the core words); their number has no cap. Words seen less often share one more class, in which an
unseen word counts as one more word. Once every word has its class, the class bigrams of all tokens are
counted, from the documents' classes in order, which scoring then uses too. Where more words are equally
frequent than a number of words leaves room for, those of the least hashes are taken.

A text's probability is the product of class transitions and words within classes, both smoothed.
Scoring looks words up in the broadcast head of the vocabulary (HEAD words at most) and joins the
other words of each document, once a document, with the table of words; the classes of a document
in order wait as one byte a token.

Cases: null or empty text is one end token; repeated rows keep their own score; a null id
counts as training; with no training documents every token has probability one in the base
score and the start rates in the model's; extra columns are ignored; ids keep their type.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm._common import cut, remove, shared_dir

CORE, HEAD, LEAST, MOST_CLASSES, ROUNDS, TOLERANCE, SMOOTH = 3000, 100_000, 3, 120, 30, 1e-4, 0.1
FLUSH = 300_000
PAIRS = 1 << 22
END = b"\n"  # no word holds a newline
ELSEWHERE = 255  # in a document's classes: the next of its words that are not in the head


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) over all rows; tasks add up to FLUSH words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                held.update(tokens(text.as_py()))
            if len(held) >= FLUSH:
                yield out()
                held.clear()
        yield out()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[int, int | None]:
    """(n, hash): the ``most`` most frequent words are those with a larger count, and of those with that count the ones up to that hash; see ``among``."""
    kept = 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # the most frequent levels only
        room, size = most - kept, r["count"]
        if size > room:
            if not room:
                return r.n, None
            share = min(1.0, (room + 6 * room**0.5 + 10) / size)
            below = int(-(2**63) + share * (2**64 - 1))
            h = F.xxhash64("word")
            first = sorted(x.h for x in counts.where((F.col("n") == r.n) & (h <= max(min(below, 2**63 - 1), -(2**63)))).select(h.alias("h")).collect())  # about ``room``
            return r.n, first[min(room, len(first)) - 1] if first else None
        kept += size
    return 0, None


def among(edge: tuple[int, int | None]) -> Column:
    """Whether a word (word, n) is one of ``frequent``."""
    n, limit = edge
    more = F.col("n") > n
    return more if limit is None else more | ((F.col("n") == n) & (F.xxhash64("word") <= limit))


def core_words(counts: DataFrame, most: int = CORE) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words with their counts, END among them, and the count of all others last."""
    top = sorted(((r.n, bytes(r.word)) for r in counts.where(among(frequent(counts, most))).collect()), key=lambda x: (-x[0], x[1]))
    words, n = [w for _, w in top], [n for n, _ in top]
    if END not in words:
        words.append(END)
        n.append(sum(r.n for r in counts.where(F.col("word") == F.lit(END)).collect()))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return words, np.array([*n, total - sum(n)], np.float64)


def core_bigrams(docs: DataFrame, core, text_col: str = "text") -> DataFrame:
    """(a, b, n): how often core word b follows core word a, by number; all other words have one number, the last. ``core`` is a broadcast."""

    def run(batches):
        at, end = core.value
        other, size = len(at), len(at) + 1

        def out(pairs):
            both, n = np.unique(np.concatenate(pairs), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((both // size).astype(np.int32)), pa.array((both % size).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                kinds = np.array([at.get(w, other) for w in tokens(text.as_py())], np.int64)
                held.append(np.concatenate([[end], kinds[:-1]]) * size + kinds)
                n += len(kinds)
            if n >= PAIRS:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return docs.select(text_col).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pair: np.ndarray) -> float:
    """Log-likelihood of class bigrams but for the words' own counts, which no move changes."""
    return float(_xlogx(pair).sum() - _xlogx(pair.sum(0)).sum() - _xlogx(pair.sum(1)).sum())


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, count: np.ndarray, k: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the types by exchange, the class bigram counts, and the likelihood after each round.

    Type ``a[i]`` stands before type ``b[i]`` ``n[i]`` times. The last type keeps class ``k``, which no other enters.
    """
    size = len(count)
    own = np.zeros(size)
    same = a == b
    own[a[same]] = n[same]
    a, b, n = a[~same], b[~same], n[~same].astype(np.float64)
    after, before = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    starts = lambda x, order: np.searchsorted(x[order], np.arange(size + 1))
    to, to_n, to_at = b[after], n[after], starts(a, after)
    by, by_n, by_at = a[before], n[before], starts(b, before)
    order = np.argsort(-count[:-1], kind="stable")
    classes = np.full(size, k, np.int64)
    classes[order] = np.arange(len(order)) % k
    pair = np.zeros((k + 1, k + 1))
    np.add.at(pair, (classes[a], classes[b]), n)
    np.add.at(pair, (classes, classes), own)
    seen, at = [likelihood(pair)], np.arange(k)
    for _ in range(rounds):
        moved = 0
        for t in order.tolist():
            i, j, p, q, c = to_at[t], to_at[t + 1], by_at[t], by_at[t + 1], classes[t]
            if i == j and p == q:
                continue
            right = np.bincount(classes[to[i:j]], to_n[i:j], k + 1)
            left = np.bincount(classes[by[p:q]], by_n[p:q], k + 1)
            pair[c] -= right  # take the type out of its class
            pair[:, c] -= left
            pair[c, c] -= own[t]
            gain = (_xlogx(pair + right) - _xlogx(pair)).sum(1)[:k] + (_xlogx(pair + left[:, None]) - _xlogx(pair)).sum(0)[:k]
            inner = pair[at, at]  # both sides of a class meet in its own cell
            gain += _xlogx(inner + right[:k] + left[:k] + own[t]) + _xlogx(inner) - _xlogx(inner + right[:k]) - _xlogx(inner + left[:k])
            rows, cols = pair.sum(1)[:k] + left[:k], pair.sum(0)[:k] + right[:k]  # the other side is added wherever it goes
            gain -= _xlogx(rows + right.sum() + own[t]) - _xlogx(rows) + _xlogx(cols + left.sum() + own[t]) - _xlogx(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-6:
                best = int(c)
            pair[best] += right
            pair[:, best] += left
            pair[best, best] += own[t]
            classes[t] = best
            moved += best != c
        seen.append(likelihood(pair))
        if not moved or seen[-1] - seen[-2] <= tolerance * abs(seen[-1] - seen[0]):
            break
    return classes, pair, seen


def contexts(docs: DataFrame, core, text_col: str = "text") -> DataFrame:
    """(word, slots, ns): how often words outside the core stand after (slot c) and before (slot k + 1 + c) class c, summed within tasks."""

    def run(batches):
        at, end, classes, k = core.value
        other, width = len(at), 2 * (k + 1)

        def out(ids, held):
            both, n = np.unique(np.concatenate(held), return_counts=True)
            word, slot = both // width, both % width
            offsets = np.searchsorted(word, np.arange(len(ids) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (slot.astype(np.int32), n.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), *lists], names=["word", "slots", "ns"])

        ids, held, n = {}, [], 0
        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                kinds = np.array([at.get(w, other) for w in words], np.int64)
                found = np.flatnonzero(kinds == other)  # never the last token, which is an end
                if not len(found):
                    continue
                local = np.array([ids.setdefault(words[i], len(ids)) for i in found.tolist()], np.int64) * width
                cls = classes[kinds]
                held += [local + np.where(found > 0, cls[found - 1], classes[end]), local + k + 1 + cls[found + 1]]
                n += 2 * len(found)
            if n >= PAIRS or len(ids) >= FLUSH:
                yield out(ids, held)
                ids, held, n = {}, [], 0
        if held:
            yield out(ids, held)

    return docs.select(text_col).mapInArrow(run, "word binary, slots array<int>, ns array<long>")


def place_words(found: DataFrame, pair: np.ndarray, least: int = LEAST) -> DataFrame:
    """(word, n, class) of every word of ``contexts``.

    The rows of a word follow one another, however many tasks sent it, and are added as they come.
    """
    k = len(pair) - 1
    width = 2 * (k + 1)
    logs = np.log(pair + SMOOTH)
    into, out_of = logs - np.log(pair.sum(0) + SMOOTH * (k + 1)), logs.T - np.log(pair.sum(1) + SMOOTH * (k + 1))
    kinds = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])

    def run(batches):
        def placed(words, dense):
            n = dense[:, : k + 1].sum(1)
            gain = dense[:, : k + 1] @ into + dense[:, k + 1 :] @ out_of
            classes = np.where(n >= least, np.argmax(gain[:, :k], 1), k)
            return pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(classes.astype(np.int32))], schema=kinds)

        word, carried = None, np.zeros((1, width))
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            words, ids = coded.dictionary, coded.indices.to_numpy()
            at = np.repeat(ids, np.diff(b.column(1).offsets.to_numpy()))
            dense = np.bincount(at * width + b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), len(words) * width).reshape(-1, width)
            if word is not None:
                if words[0].as_py() == word:
                    dense[0] += carried[0]
                else:
                    yield placed(pa.array([word], pa.binary()), carried)
            if len(words) > 1:
                yield placed(words[:-1], dense[:-1])
            word, carried = words[-1].as_py(), dense[-1:]
        if word is not None:
            yield placed(pa.array([word], pa.binary()), carried)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int")


@dataclass
class Model:
    """What scoring needs besides the table of words outside the head."""

    at: dict[bytes, int]  # head word -> place in n and class_of
    n: np.ndarray
    class_of: np.ndarray
    transition: np.ndarray | None  # log10
    within: np.ndarray  # log10 of what a word's count, plus one, is divided by in its class
    start: int  # class of END
    total: int
    distinct: int
    edge: tuple[int, int | None]  # of the head, for ``among``
    seen: list[float]

    @property
    def denominator(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))

    @property
    def rare(self) -> int:
        return len(self.within) - 1


def classes_of_words(docs: DataFrame, text_col: str = "text", core: int = CORE, head: int = HEAD, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model but for its transitions, and the written table (word, n, class) of all words outside the core, from all rows of ``docs``."""
    sc = docs.sparkSession.sparkContext
    counts = cut(word_counts(docs, text_col))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, n = core_words(counts, core)
    at, end = {w: i for i, w in enumerate(words)}, words.index(END)
    shared = sc.broadcast((at, end))
    pairs = core_bigrams(docs, shared, text_col).toArrow()  # core words squared at most
    k = max(2, min(MOST_CLASSES, isqrt(len(words))))
    classes, pair, seen = exchange(*(pairs.column(c).to_numpy() for c in ("a", "b", "n")), n, k)
    lexicon = cut(place_words(contexts(docs, sc.broadcast((at, end, classes, k)), text_col), pair, least))
    per_class = {r["class"]: (r.n, r.words) for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    mass = np.bincount(classes[:-1], n[:-1] + 1, k + 1) + [sum(per_class.get(c, (0, 0))) for c in range(k + 1)]
    mass[k] += 1  # an unseen word
    edge = frequent(counts, head)
    top = sorted((bytes(r.word), r.n, r["class"]) for r in lexicon.where(among(edge)).collect())
    place = {**at, **{w: len(at) + i for i, (w, _, _) in enumerate(top)}}
    model = Model(place, np.array([*n[:-1], *(x[1] for x in top)]), np.array([*classes[:-1], *(x[2] for x in top)], np.uint8), None, np.log10(np.maximum(mass, 1)), int(classes[end]), total, distinct, edge, seen)
    return model, lexicon


def train(docs: DataFrame, text_col: str = "text", core: int = CORE, head: int = HEAD, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model and the written table (word, n, class) of all words outside the core, from all rows of ``docs``."""
    model, lexicon = classes_of_words(docs, text_col, core, head, least)
    rows = classed(docs.select(F.lit(0).alias("__id"), text_col), model, lexicon, "__id", text_col)
    return replace(model, transition=transitions(rows, model)), lexicon


def transitions(rows: DataFrame, model: Model) -> np.ndarray:
    """Smoothed log10 of the class bigrams of ``rows`` of ``classed``, END before each document."""
    return smoothed(class_bigrams(rows, model))


def class_bigrams(rows: DataFrame, model: Model) -> np.ndarray:
    """How often a class follows another in ``rows``, all tokens counted."""
    size, start = model.rare + 1, model.start

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for classes in b.column(0):
                cls = np.frombuffer(classes.as_buffer(), np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate([[start], cls[:-1]]) * size + cls, minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    counted = np.zeros(size * size)
    for r in rows.select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # classes squared at most
        counted[r.cell] = r.n
    return counted.reshape(size, size)


def smoothed(joint: np.ndarray) -> np.ndarray:
    return np.log10((joint + SMOOTH) / (joint.sum(1, keepdims=True) + SMOOTH * len(joint)))


def classed(docs: DataFrame, model: Model, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, emitted (log10 of the words within their classes) and classes (a byte a token) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType

    def looked_up(batches):
        m = shared.value
        get, row, n = m.at.get, TaskContext.get().partitionId() << 40, 0
        logs = np.log10(m.n + 1)
        emitted = logs - m.within[m.class_of]
        for b in batches:
            rows = {name: [] for name in ("row", "n_tokens", "in_head", "base", "model", "classes", "places", "rest")}
            for text in b.column(1):
                words = tokens(text.as_py())
                at = np.array([get(w, -1) for w in words], np.int64)
                known, out = at[at >= 0], np.flatnonzero(at < 0).tolist()
                rest: dict[bytes, int] = {}
                places = [rest.setdefault(words[i], len(rest)) for i in out]
                rows["row"].append(row + n)
                rows["n_tokens"].append(len(words))
                rows["in_head"].append(int((m.n[known] > 0).sum()))
                rows["base"].append(float(logs[known].sum() - len(words) * m.denominator))
                rows["model"].append(float(emitted[known].sum()))
                rows["classes"].append(np.where(at >= 0, m.class_of[at], ELSEWHERE).astype(np.uint8).tobytes())
                rows["places"].append(np.array(places, "<u4").tobytes())
                rows["rest"].append(list(rest))
                n += 1
            types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types))], names=[id_col, *rows])

    def resolved(batches):
        m = shared.value
        for b in batches:
            cols = {name: b.column(name).to_pylist() for name in ("in_head", "base", "model", "classes", "places", "found")}
            known, base, emitted, whole = [], [], [], []
            for in_head, b_, m_, classes, places, found in zip(*cols.values()):
                cls, place = np.frombuffer(classes, np.uint8), np.frombuffer(places, "<u4")
                if len(place):
                    size = int(place.max()) + 1
                    n, of = np.zeros(size), np.full(size, m.rare)
                    for f in found or ():
                        n[f["at"]], of[f["at"]] = f["n"], f["class"]
                    cls = cls.copy()
                    cls[cls == ELSEWHERE] = of[place]
                    logs = np.log10(n + 1)
                    in_head += int((n[place] > 0).sum())
                    b_ += float(logs[place].sum())
                    m_ += float((logs - m.within[of])[place].sum())
                known.append(in_head)
                base.append(b_)
                emitted.append(m_)
                whole.append(cls.tobytes())
            made = [pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(emitted, pa.float64()), pa.array(whole, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("n_tokens"), *made], names=[id_col, "n_tokens", "n_known", "base_score", "emitted", "classes"])

    spark = docs.sparkSession
    first, joined = shared_dir(spark), shared_dir(spark)
    held = cut(docs.select(id_col, text_col).mapInArrow(looked_up, f"`{id_col}` {kind.simpleString()}, row long, n_tokens long, in_head long, base double, model double, classes binary, places binary, rest array<binary>"), first)
    rest = held.select("row", F.posexplode("rest").alias("at", "word"))
    tail = lexicon.where(~among(model.edge))
    found = rest.join(tail, "word").groupBy("row").agg(F.collect_list(F.struct("at", "n", "class")).alias("found"))  # a document's own words
    both = held.drop("rest").join(found, "row", "left").drop("row")
    out = cut(both.mapInArrow(resolved, f"`{id_col}` {kind.simpleString()}, n_tokens long, n_known long, base_score double, emitted double, classes binary"), joined)
    remove(spark, first)
    return out


def scored(rows: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, base_score and score of ``rows`` of ``classed``."""
    start, transition = model.start, model.transition
    names = [id_col, "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for b in batches:
            total = []
            for emitted, classes in zip(b.column(4).to_pylist(), b.column(5)):
                cls = np.frombuffer(classes.as_buffer(), np.uint8)
                total.append(emitted + float(transition[np.concatenate([[start], cls[:-1]]), cls].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(total, pa.float64())], names=names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "n_tokens", "n_known", "base_score", "emitted", "classes").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, model: Model, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score of every row."""
    return scored(classed(docs, model, lexicon, id_col, text_col), model, id_col)


def train_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model learned from the rows where ``training`` (of the id) holds, and the scores of all rows, whose words are looked up once for both."""
    model, lexicon = classes_of_words(docs.where(training), text_col)
    rows = classed(docs, model, lexicon, id_col, text_col)
    model = replace(model, transition=transitions(rows.where(training), model))
    return model, scored(rows, model, id_col)


def is_held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
