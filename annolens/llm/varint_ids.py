"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0 is the most frequent) and each
rank takes one to four bytes. Lengths stand apart from data: a control byte holds
four two-bit lengths, so a block decodes with numpy table lookups and no loop over
values. Blocks hold whole documents in ascending id order; a block's header has
its first token's position in the corpus, so blocks can be read in any order. Files
are in one folder for each range of ids, and folders by name are in the order of ids.

Layout of a block: magic ``FVB1``, then little-endian u32 documents, u64 tokens,
u64 first position, u64 control bytes, u64 data bytes; per document i64 id, u8
validity, u32 tokens; control bytes; data bytes; one newline.

Ids are whole numbers; other ids end the job. Cases: null or empty text is one end id; a null document id sorts first and reads
back as null; equal ids keep both rows; an empty table gives files without blocks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm._chunks import byte_chars, encode_together
from annolens.llm._common import cut, remove, shared_dir

BLOCK_TOKENS = 1 << 18
GROUP_BYTES = 1 << 30
GROUP_TEXT = 20 << 20  # bytes of texts encoded together, but for the last batch
TOGETHER = 50  # matches in one string for the library
MAGIC, HEADER = b"FVB1", "<4sIQQQQ"
#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    r = np.ascontiguousarray(ranks, "<u4")
    size = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``: lengths from a table by control byte, bytes gathered by position."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        has = np.flatnonzero(size > k)
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class TextEncoder:
    """Ids by the tokenizers library, which gets each distinct match of the pattern in a group of texts once."""

    def __init__(self, tokenizer_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.findall, self.matches = regex.compile(pattern).findall, _model_encoder(self.library) or self.each

    def each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that go through the library whole."""
        ids = [self.library.encode(x, add_special_tokens=False).ids for x in texts.to_pylist()]
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.array(list(map(len, ids)), np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in one array, and their number for each text."""
        texts, whole = texts.fill_null(""), np.zeros(len(texts), bool)
        for x in self.special:  # an added token may start or end inside a match
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not whole.any():
            return encode_together(texts, self.findall, self.matches)
        ids, sizes = encode_together(pc.if_else(pa.array(whole), "", texts), self.findall, self.matches)
        more, n = self.each(texts.filter(pa.array(whole)))
        ids, sizes[whole] = np.insert(ids, np.repeat(np.cumsum(sizes)[whole], n), more), n
        return ids, sizes

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_loaded: dict[str, TextEncoder] = {}


def encoder(tokenizer_file: str, pattern: str) -> TextEncoder:
    if tokenizer_file not in _loaded:
        _loaded[tokenizer_file] = TextEncoder(tokenizer_file, pattern)
    return _loaded[tokenizer_file]


def _model_encoder(tokenizer):
    """Ids of matches by the library's model alone, or None where more than byte mapping precedes the model.

    Matches need no normalising or splitting, and the offsets that a full encoding keeps cost more than its merges. The
    library gets many of them between spaces, which byte mapping leaves in none; the bytes of the ids tell where each ends.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

    before = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(before, ByteLevel) or before.add_prefix_space:
        return None
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer, vocab = CharDelimiterSplit(" "), model.get_vocab()
    if not vocab.keys() >= set(byte_chars()):  # a byte without an id would be left out
        return None
    mapped, n_bytes = np.array(list(map(ord, byte_chars())), "<u2"), np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        n_bytes[i] = len(token)

    def encode(matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        length = pc.binary_length(matches).to_numpy().astype(np.int64)
        ends = np.cumsum(length)
        raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(matches)], matches), "")[0].as_buffer(), np.uint8)
        spaced = np.insert(mapped[raw], ends[:-1], 32).tobytes().decode("utf-16-le")
        cuts = np.append((ends - length)[::TOGETHER] + np.arange(0, len(ends), TOGETHER), len(spaced) + 1).tolist()
        ids = [np.zeros(0, "<u4")]
        for k in range(0, len(cuts) - 1, 200):
            some = cuts[k : k + 201]
            ids += [np.array(x.ids, "<u4") for x in model.encode_batch_fast([spaced[i : j - 1] for i, j in zip(some, some[1:])], add_special_tokens=False)]
        ids = np.concatenate(ids)
        to = np.cumsum(n_bytes[ids])
        last = np.searchsorted(to, ends)
        if len(ends) and (to[-1] != ends[-1] or (to[last] != ends).any()):
            raise ValueError("an id crosses two words")
        return ids, np.diff(last, prepend=-1)

    return encode


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about GROUP_TEXT bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GROUP_TEXT:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _sorted_blocks(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, pattern).encode
        part, ids, sizes, held, n, before, block = TaskContext.get().partitionId(), [], [], [], 0, 0, 0

        def full():
            row = {"part": [part], "block": [block], "before": [before], "doc_ids": [ids], "sizes": [sizes], "ids": [np.concatenate(held).tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=kinds)

        for b in _grouped(batches):
            coded, each = encode(b.column(1))
            ends = np.cumsum(each)
            coded, ends = np.insert(coded, ends, end_id).astype("<u2" if small else "<u4"), ends + np.arange(1, len(ends) + 1)
            keys, each, at, done = b.column(0).to_pylist(), (each + 1).tolist(), 0, 0
            for k, to in enumerate(ends.tolist(), 1):
                if n + to - at >= BLOCK_TOKENS or k == len(keys):
                    ids += keys[done:k]
                    sizes += each[done:k]
                    held.append(coded[at:to])
                    n, at, done = n + to - at, to, k
                if n >= BLOCK_TOKENS:
                    yield full()
                    ids, sizes, held, n, before, block = [], [], [], 0, before + n, block + 1
        if ids:
            yield full()

    from tokenizers import Tokenizer

    small = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    return ordered.mapInArrow(run, "part int, block int, before long, doc_ids array<long>, sizes array<int>, ids binary").withColumn("wide", F.lit(4 - 2 * small))


def _frequencies(blocks: DataFrame) -> DataFrame:
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids, wide in zip(b.column(0), b.column(1).to_pylist()):
                n = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{wide}"))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return blocks.select("ids", "wide").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, append ``end_id``, and write ``path``/blocks and ``path``/ranks.

    The text is sorted by id before it is encoded, so it is shuffled once and encoded once, a group
    of about GROUP_TEXT bytes together;
    ids wait in a written table while their frequencies are counted. The driver holds one
    count per vocabulary entry and one total per range partition.
    """
    spark = docs.sparkSession
    held = shared_dir(spark)
    # one row group a file, so that a range of ids is read by one task
    _sorted_blocks(docs, tokenizer_file, pattern, end_id, id_col, text_col).write.options(**{"compression": "zstd", "parquet.block.size": GROUP_BYTES}).parquet(held)
    blocks = spark.read.parquet(held)
    by_rank = sorted(((r.n, r.id) for r in _frequencies(blocks).collect()), key=lambda x: (-x[0], x[1]))
    ranks = np.zeros(max((i for _, i in by_rank), default=0) + 1, "<u4")
    for rank, (_, i) in enumerate(by_rank):
        ranks[i] = rank
    totals = blocks.groupBy("part").agg(F.max(F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    first, at = {}, 0
    for r in totals:
        first[r.part] = at
        at += r.n

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                control, data = pack(ranks[np.frombuffer(row["ids"], f"<u{row['wide']}")])
                keys = row["doc_ids"]
                head = struct.pack(HEADER, MAGIC, len(keys), sum(row["sizes"]), first[row["part"]] + row["before"], len(control), len(data))
                docs = np.array([k or 0 for k in keys], "<i8").tobytes() + bytes(k is not None for k in keys) + np.array(row["sizes"], "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([head + docs + control + data], pa.binary())], names=["part", "value"])

    coded = blocks.sortWithinPartitions("part", "block").mapInArrow(run, "part int, value binary")
    named = coded.select(F.format_string("%08d", "part").alias("part"), F.col("value").cast("string"))
    named.sortWithinPartitions("part").write.partitionBy("part").option("lineSep", "\n").text(f"{path}/blocks")
    spark.createDataFrame([(i, r) for r, (_, i) in enumerate(by_rank)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    remove(spark, held)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens and ids (packed u32) of every document."""
    ranked = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r.id for r in ranked], "<u4")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw, at = content.as_buffer(), 0
                while at < raw.size:
                    magic, docs, tokens, start, n_control, n_data = struct.unpack_from(HEADER, raw, at)
                    if magic != MAGIC:
                        raise ValueError(f"no block at byte {at}")
                    at += struct.calcsize(HEADER)
                    take = lambda n: (at, at + n)
                    parts = []
                    for n in (8 * docs, docs, 4 * docs, n_control, n_data):
                        i, j = take(n)
                        parts.append(bytes(raw[i:j]))
                        at = j
                    at += 1
                    sizes = np.frombuffer(parts[2], "<u4").astype(np.int64)
                    ids = id_of[unpack(parts[3], parts[4], tokens)].tobytes()
                    ends = np.cumsum(sizes)
                    begins = ends - sizes
                    keys = pa.array(np.frombuffer(parts[0], "<i8"), mask=np.frombuffer(parts[1], np.uint8) == 0)
                    packed = pa.array([ids[4 * i : 4 * j] for i, j in zip(begins.tolist(), ends.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + begins), pa.array(sizes), packed], names=[id_col, "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    return files.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")
