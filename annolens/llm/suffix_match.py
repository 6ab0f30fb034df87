"""Benchmark decontamination with suffix arrays over the training documents.

Training documents are read in shards of whole documents. A shard's words that
occur in the benchmark become integers, all others separators; positions from
which no window can fit before a separator are left out, the rest are sorted by
the words that follow: the shard's suffix array. Every benchmark suffix is then
binary-searched in it, all at once in numpy; the matching interval gives the
locations. The longest match comes from one more suffix array, to full depth, of the parts of shard and
benchmark that lie in windows found: it is the prefix shared with the nearest benchmark suffix.
A window is ``window`` consecutive words of an item; an item of fewer words is
one window. Documents are affected by the share of their words inside a window.

The benchmark is read in blocks of bounded size, broadcast block by block; a
shard searches every block, so neither side is shuffled and nothing is capped. Of
several blocks a worker holds one at a time.

Cases: null, empty or wordless text has no words and no hits; an item without an id
hits words and is not listed; repeated items and documents give repeated rows; an empty benchmark
hits nothing; item ids are whole numbers or texts; extra columns are passed through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_WORDS = 1_000_000
BLOCK_BYTES = 32 << 20
#: Lower-cases A-Z and turns every byte that is no word byte into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and bytes from 128 up, A-Z lower-cased."""
    return (text or "").encode().translate(WORD_BYTES).split()


class TestSuffixes:
    """The windows of one benchmark block: distinct word sequences and the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window, self.vocabulary = window, {}
        suffixes: dict[tuple[int, ...], set[int]] = {}
        texts: dict[tuple[int, ...], int] = {}
        places: dict[tuple[int, ...], list[int]] = {}
        end = 0
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            if not ids:
                continue
            new = ids not in texts  # copies add their item only
            first = texts.setdefault(ids, end)
            for i in range(max(1, len(ids) - window + 1)):
                key = ids[i : i + window]
                suffixes.setdefault(key, set()).update([item] if item is not None else ())
                if new:
                    places.setdefault(key, []).append(first + i)
            end += (len(ids) + 1) * new
        self.text = np.zeros(end, np.int32)  # distinct texts, a 0 after each
        for ids, first in texts.items():
            self.text[first : first + len(ids)] = ids
        self.keys = list(suffixes)
        self.items = [sorted(suffixes[k]) for k in self.keys]
        self.places = [np.array(places[k], np.int64) for k in self.keys]
        self.sizes = np.array([len(k) for k in self.keys], np.int64)
        self.matrix = np.zeros((len(self.keys), window), np.int32)
        for row, k in zip(self.matrix, self.keys):
            row[: len(k)] = k

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window number) of every occurrence; ``ids`` holds 0 for words outside the block."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.keys:
            return none
        order, depth = suffix_array(ids, int(self.sizes.min()), self.window)
        if not len(order):
            return none
        low = _bound(ids, order, self.matrix, self.sizes, right=False)
        high = _bound(ids, order, self.matrix, self.sizes, right=True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
        return order[at], which

    def longest(self, ids: np.ndarray, position: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Words of the longest verbatim match from each occurrence on.

        A whole short item is as long as it is. Else the parts of ``ids`` and of the texts that lie in windows found go
        into one suffix array, where a match's text is the nearest before or after it.
        """
        out = self.sizes[which].copy()
        full = np.flatnonzero(out == self.window)
        if len(full):
            mine = _spans(position[full], self.window, len(ids))
            theirs = _spans(np.concatenate([self.places[k] for k in np.unique(which[full])]), self.window, len(self.text))
            inside, starts = np.concatenate(mine), np.array([x[0] for x in mine])
            at = np.searchsorted(inside, position[full]) + np.searchsorted(starts, position[full], side="right") - 1
            out[full] = common_prefixes(_joined(ids, mine), _joined(self.text, theirs), at)
        return out


def _spans(starts: np.ndarray, size: int, n: int) -> list[np.ndarray]:
    """The runs of positions below ``n`` that lie within ``size`` from some start, in order."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1)


def _joined(ids: np.ndarray, spans: list[np.ndarray]) -> np.ndarray:
    """The words of spans, a 0 after each."""
    return np.concatenate([np.append(ids[s], 0) for s in spans]).astype(np.int64)


def common_prefixes(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words that the suffix of ``a`` at each place shares with the suffix of ``b`` that shares most; 0 ends a suffix.

    Ranks by 1, 2, 4, ... words are kept, so that the prefix of two suffixes is measured by falling powers.
    """
    both = np.concatenate([a, b])
    n, ends = len(both), np.flatnonzero(both == 0)
    rank = both.copy()
    rank[ends] = -1 - np.arange(len(ends))  # no separator equals another
    levels = [np.unique(rank, return_inverse=True)[1]]
    while 1 << len(levels) - 1 < np.diff(ends, prepend=-1).max() and levels[-1].max() < n - 1:
        done = 1 << len(levels) - 1
        ahead = np.zeros(n, np.int64)
        ahead[: n - done] = levels[-1][done:] + 1
        levels.append(np.unique(levels[-1].astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1])
    order = np.argsort(levels[-1], kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    other = order >= len(a)
    before = np.maximum.accumulate(np.where(other, np.arange(n), -1))
    after = np.minimum.accumulate(np.where(other, np.arange(n), n)[::-1])[::-1]
    best = np.zeros(len(at), np.int64)
    for near in (before[place[at]], after[place[at]]):
        there = np.flatnonzero((near >= 0) & (near < n))
        p, q = at[there].copy(), order[near[there]]
        size = np.zeros(len(there), np.int64)
        for k in reversed(range(len(levels))):
            ok = (np.maximum(p, q) + (1 << k) <= n) & (levels[k][np.minimum(p, n - 1)] == levels[k][np.minimum(q, n - 1)])
            step = ok.astype(np.int64) << k
            p, q, size = p + step, q + step, size + step
        best[there] = np.maximum(best[there], size)
    return best


def suffix_array(ids: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, int]:
    """Start positions with at least ``least`` words before a separator, sorted by their next ``depth`` words (prefix doubling)."""
    n = len(ids)
    stops = np.flatnonzero(ids == 0)
    next_stop = np.full(n, n, np.int64)
    if len(stops):
        k = np.searchsorted(stops, np.arange(n))
        next_stop = np.where(k < len(stops), stops[np.minimum(k, len(stops) - 1)], n)
    start = np.flatnonzero(next_stop - np.arange(n) >= least)
    if not len(start):
        return start, depth
    # ranks are needed only where a kept suffix can look: from its start on for depth words
    rank = ids.astype(np.int64)
    done = 1
    while done < depth:
        ahead = np.zeros(n, np.int64)
        if done < n:
            ahead[:-done] = rank[done:]
        key = rank * (int(rank.max()) + 2) + ahead
        key[rank == 0] = 0  # separators end a suffix
        if int(rank.max()) > 1 << 30:
            raise OverflowError("shard too large")
        need = _covered(start, n, depth)
        values, inverse = np.unique(key[need], return_inverse=True)
        fresh = np.zeros(n, np.int64)
        fresh[need] = inverse + (0 if len(values) and values[0] == 0 else 1)
        rank, done = fresh, done * 2
    return start[np.argsort(rank[start], kind="stable")], depth


def _covered(start: np.ndarray, n: int, depth: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + 2 * depth, n), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _bound(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray, sizes: np.ndarray, right: bool) -> np.ndarray:
    """First suffix not less than (right: greater than, as far as the wanted words go) each wanted row, by binary search for all rows at once."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    span = np.arange(wanted.shape[1])
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        at = order[mid][:, None] + span
        got = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], 0)
        # a separator ends the suffix: what follows it is less than any word
        got[np.cumsum(got == 0, axis=1) > 0] = 0
        want = wanted[open_]
        differs = (got != want) & (span < sizes[open_][:, None])
        first = differs.argmax(axis=1)
        rows = np.arange(len(open_))
        less = differs[rows, first] & (got[rows, first] < want[rows, first])
        same = ~differs[rows, first]
        up = less | same if right else less
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """The benchmark as broadcast blocks of about BLOCK_BYTES each; the driver holds one at a time."""
    spark = benchmark.sparkSession
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k)
        items = [(r[0], r[1]) for r in part.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator()]
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, items))


_built: dict[tuple[str, int], TestSuffixes] = {}


def _shards(batches: Iterator[pa.RecordBatch], text_at: int, blocks: list, window: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with, for each row, (words, hit spans, items, longest match)."""
    held, size = [], 0
    for b in batches:
        tokens = [words(t.as_py()) for t in b.column(text_at)]
        held.append((b, tokens))
        size += sum(map(len, tokens))
        if size >= SHARD_WORDS:
            yield from _search(held, blocks, window)
            held, size = [], 0
    if held:
        yield from _search(held, blocks, window)


def _search(held: list, blocks: list, window: int):
    docs = [t for _, tokens in held for t in tokens]
    first = np.cumsum([0, *(len(t) + 1 for t in docs)])  # a separator after each document
    owner_of = lambda p: np.searchsorted(first, p, side="right") - 1
    spans: dict[int, np.ndarray] = {}
    items: dict[int, set] = {}
    longest: dict[int, int] = {}
    edge = np.zeros(first[-1] + 1, np.int32)
    for bc in blocks:
        name, block_items = bc.value
        if len(blocks) > 1:
            vars(bc).pop("_value", None)  # it is read anew from the worker's disk
        if (name, window) not in _built:
            _built.clear()
            _built[name, window] = TestSuffixes(block_items, window)
        test = _built[name, window]
        get = test.vocabulary.get
        ids = np.zeros(first[-1], np.int32)
        for at, t in zip(first.tolist(), docs):
            ids[at : at + len(t)] = [get(w, 0) for w in t]
        position, which = test.search(ids)
        if not len(position):
            continue
        np.add.at(edge, position, 1)
        np.add.at(edge, position + test.sizes[which], -1)
        owner = owner_of(position)
        pairs = np.unique(owner * len(test.keys) + which)
        for d, k in zip((pairs // len(test.keys)).tolist(), (pairs % len(test.keys)).tolist()):
            items.setdefault(d, set()).update(test.items[k])
        most = np.zeros(len(docs), np.int64)
        np.maximum.at(most, owner, test.longest(ids, position, which))
        for d in np.flatnonzero(most).tolist():
            longest[d] = max(longest.get(d, 0), int(most[d]))
    hit = np.cumsum(edge[:-1]) > 0
    at = 0
    for b, tokens in held:
        rows = []
        for t in tokens:
            own = hit[first[at] : first[at] + len(t)]
            step = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            rows.append((len(t), step.reshape(-1, 2).tolist(), sorted(items.get(at, ())), longest.get(at, 0)))
            at += 1
        yield b, rows


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, spans (word ranges inside windows), items, longest (words of the longest match)."""
    blocks = list(_blocks(benchmark, item_col, item_text, window))
    item_kind = "string" if benchmark.schema[item_col].dataType.simpleString() == "string" else "long"

    def run(batches):
        for b, rows in _shards(batches, 1, blocks, window):
            cols = [
                b.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([sum(j - i for i, j in r[1]) for r in rows], pa.int64()),
                pa.array([[{"from": i, "to": j} for i, j in r[1]] for r in rows], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                pa.array([r[2] for r in rows], pa.list_(pa.string() if item_kind == "string" else pa.int64())),
                pa.array([r[3] for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "spans", "items", "longest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, spans array<struct<from: long, to: long>>, items array<{item_kind}>, longest long")


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = list(_blocks(benchmark, item_col, item_text, window))
    text_at = docs.columns.index(text_col)

    def run(batches):
        for b, rows in _shards(batches, text_at, blocks, window):
            hits = [(r[0], sum(j - i for i, j in r[1])) for r in rows]
            yield b.filter(pa.array([not (h > 0 and 20 * h >= n) for n, h in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
