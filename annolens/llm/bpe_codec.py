"""Byte-level BPE encoding and decoding through a sentencepiece model made from rank files.

A rank file holds base64 byte strings and their ranks. Each becomes a NORMAL
piece of a BPE ModelProto, written as byte-mapped characters and scored by its
negative rank, so the id is the rank; normalisation is identity and no prefix is
added. Sentencepiece merges the best-scored pair first, leftmost on ties, which
is the order of ranks. Texts are split by the pre-token pattern and each match
is encoded by itself; a match that is in the vocabulary is its own token, as in
the rank library. Decoding maps ids back to their bytes.

Cases: null or empty text encodes to no ids and decodes to no bytes; rows are
kept one to one whatever repeats; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annolens.llm._chunks import ChunkEncoder, byte_chars


def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE ModelProto whose ids are the ranks; the unknown piece takes the id after the last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_chars()
    model = pb.ModelProto()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    for token, rank in ordered:
        model.pieces.add(piece="".join(chars[b] for b in token), score=float(-rank), type=1)
    model.pieces.add(piece="<unk>", score=0.0, type=2)
    t = model.trainer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id, t.byte_fallback = 2, len(ordered) + 1, len(ordered), -1, -1, -1, False
    n = model.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.map = dict(enumerate(byte_chars()))
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.chunks = ChunkEncoder(pattern, self.pretoken)

    def pretoken(self, match: str) -> bytes:
        raw = match.encode()
        if (rank := self.ranks.get(raw)) is not None:
            return rank.to_bytes(4, "little")
        return np.array(self.model.encode(raw.decode("latin-1").translate(self.map)), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        return self.chunks.encode(text)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    if (rank_file, pattern) not in _loaded:
        _loaded[rank_file, pattern] = Codec(rank_file, pattern)
    return _loaded[rank_file, pattern]


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Replace ``text_col`` by ``out``, its packed ids (binary); every other column stays."""
    return _mapped(docs, lambda one: [lambda t: one.encode(t or "")], rank_file, pattern, text_col, [out])


def decode(coded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that ``ids_col`` stands for."""
    return _mapped(coded, lambda one: [lambda x: one.decode(x or b"")], rank_file, pattern, ids_col, [out], keep=True)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids by one codec: ``text_col`` becomes ``ids`` and ``out``."""
    return _mapped(docs, lambda one: [lambda t: one.encode(t or ""), one.decode], rank_file, pattern, text_col, [ids, out])


def _mapped(df: DataFrame, steps, rank_file: str, pattern: str, last: str, outs: list[str], keep: bool = False) -> DataFrame:
    """Each of ``steps`` makes one of ``outs`` of what the step before made of ``last``; the codec's tables end with the task."""
    others = [c for c in df.columns if c != last and c not in outs] + [last] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(rank_file, pattern)
        try:
            for b in batches:
                values, made = [x.as_py() for x in b.columns[-1]], []
                for step in steps(one):
                    values = list(map(step, values))
                    made.append(pa.array(values, pa.binary()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *made], names=[*others, *outs])
        finally:
            one.chunks.release()

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others] + [f"`{c}` binary" for c in outs]
    return df.select(*others, *[last] * (not keep)).mapInArrow(run, ", ".join(kinds))
