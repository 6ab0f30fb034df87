"""Token counts by heap-and-linked-list byte-pair merging, without producing ids.

The vocabulary is a sentencepiece BPE model. A text's symbols form a doubly
linked list; a heap holds every adjacent pair that is a piece, keyed by
(rank, position). Popping the lowest rank, leftmost first, merges the pair and
pushes its new neighbours. The count is the number of initial symbols minus the
number of merges; a symbol outside the vocabulary counts its UTF-8 bytes.

Merges never cross two characters that are adjacent in no piece, so a text is
cut there and counts of words, runs and cut units are kept in tables of a fixed
number of bytes. They only save time: an evicted unit is merged again.

Cases: null or empty text has 0 tokens and 0 bytes; rows are never dropped or
merged, so repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm._chunks import Table

SPACE = "▁"


class BpeCounter:
    """Counts the tokens of texts under one sentencepiece BPE model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        self.prefix = spec.add_dummy_prefix
        normal = [p for p in model.pieces if p.type == 1]
        order = sorted(range(len(normal)), key=lambda i: (-normal[i].score, i))
        self.rank = {normal[i].piece: r for r, i in enumerate(order)}
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.space_leads = not any(j[1] == SPACE and j[0] != SPACE for j in self.joined)
        self.words = Table(lambda w: self.units(SPACE + w))
        self.runs = Table(self.units)
        self.pieces = Table(self.merge)

    def count(self, text: str) -> int:
        if not text:
            return 0
        norm = text.replace(" ", SPACE)
        if self.prefix:
            norm = SPACE + norm
        if not self.space_leads:
            return self.units(norm)
        if norm[0] == SPACE and SPACE * 2 not in norm:
            return sum(map(self.words.__getitem__, norm[1:].split(SPACE)))
        return sum(map(self.runs.__getitem__, _RUN.findall(norm)))

    def units(self, run: str) -> int:
        """Cut where no piece joins two neighbours, and add up the units."""
        joined, start, total = self.joined, 0, 0
        for i in range(1, len(run)):
            if run[i - 1 : i + 1] not in joined:
                total += self.pieces[run[start:i]]
                start = i
        return total + self.pieces[run[start:]]

    def merge(self, unit: str) -> int:
        """Heap-and-linked-list merging of one unit."""
        rank, n = self.rank, len(unit)
        if n == 1:
            return 1 if unit in rank or not self.byte_fallback else len(unit.encode())
        symbol = list(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (r := rank.get(unit[i : i + 2])) is not None:
                heap.append((r, i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one side was merged meanwhile
            merges += 1
            symbol[i], symbol[j] = both, _ = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(both + symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, both, symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get(symbol[h] + both)) is not None:
                heapq.heappush(heap, (r, h, symbol[h], both))
        count = n - merges
        if self.byte_fallback:
            count += sum(len(s.encode()) - 1 for s in symbol if len(s) == 1 and s not in rank)
        return count


_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


_loaded: dict[str, BpeCounter] = {}


def counter(model_file: str) -> BpeCounter:
    """One counter per Python worker, so the table of counts outlives a task."""
    if model_file not in _loaded:
        _loaded[model_file] = BpeCounter(model_file)
    return _loaded[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every row, in the partitions the rows came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                n_bytes.append(len(t.encode()))
                n_tokens.append(count(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = docs.select(id_col, text_col).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
