"""Token files in Simple-8b: a selector in the top four bits of each 64-bit word says how many ids it packs."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import WordTokens, tokenizer_path

#: Ids in a word and bits of each, by selector; the last, the escape, holds a place in the block's list of wide values.
PACKS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNTS = np.array([n for n, _ in PACKS])
_LIMITS = np.array([1 << b for b in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)], np.uint64)
_NEED = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
_HEAD = struct.Struct("<4sqqqq")
#: A block closes once it has so many ids; documents are never cut.
BLOCK_IDS = 65_536
#: The block's index has an offset for each run of so many words.
INDEX_WORDS = 1024


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped values of unsigned 64-bit integers; the last word may be padded with zeros."""
    n = len(values)
    values = np.asarray(values, np.uint64)
    wide = values >> np.uint64(30) != 0
    padded = np.zeros(n + 240, np.uint64)
    padded[:n] = np.where(wide, 0, values)
    small = padded.astype(np.int64)
    need = _NEED[np.minimum(small, len(_NEED) - 1)]
    if n and len(big := np.flatnonzero(small >= len(_NEED))):
        need[big] = np.searchsorted(_LIMITS, padded[big], side="right")
    need[:n][wide] = 200
    fits_from = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 10: 9, 12: 10, 15: 11, 20: 12, 30: 13}
    largest = {1: need}
    width = 1
    while width < 128:
        m = largest[width].copy()
        np.maximum(m[:-width], m[width:], out=m[:-width])
        width *= 2
        largest[width] = m
    chosen = np.full(n, ESCAPE, np.uint8)
    for selector in range(14, -1, -1):
        count, bits = PACKS[selector]
        p = 1 << (count.bit_length() - 1)
        part = largest[p]
        top = np.maximum(part[:n], part[count - p : count - p + n])
        chosen[top <= fits_from[bits]] = selector
    step, starts, at = _COUNTS.astype(np.uint8)[chosen].tobytes(), [], 0
    put = starts.append
    while at < n:
        put(at)
        at += step[at]
    first = np.array(starts, np.int64)
    kind = chosen[first] if n else np.zeros(0, np.uint8)
    words = kind.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(PACKS[:ESCAPE]):
        if bits and len(mine := np.flatnonzero(kind == selector)):
            cells = padded[first[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[mine] |= np.bitwise_or.reduce(cells, axis=1)
    out = np.flatnonzero(kind == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    return words, values[first[out]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The values; each selector's words are decoded together."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[kind]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = ends - counts
    for selector, (count, bits) in enumerate(PACKS[:ESCAPE]):
        if bits and len(mine := np.flatnonzero(kind == selector)):
            cells = words[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
            out[at[mine][:, None] + np.arange(count)] = cells
    if len(mine := np.flatnonzero(kind == ESCAPE)):
        out[at[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def block_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None] | None = None) -> bytes:
    """One block of the file format: head, ids of each document, its number and whether it has one, index, words, escaped values."""
    words, escapes = pack(ids)
    counts = _COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    index = (np.cumsum(counts) - counts)[::INDEX_WORDS]
    doc_ids = [None] * len(lengths) if doc_ids is None else doc_ids
    numbers, known = np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "<i8")
    return b"".join([_HEAD.pack(b"S8B2", len(ids), len(lengths), len(words), len(escapes)), *(x.astype("<i8").tobytes() for x in (lengths, numbers, known, index)), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def open_block(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in all, ids of each document, its number and whether it has one, index, words, escaped values."""
    magic, n, n_docs, n_words, n_escapes = _HEAD.unpack_from(payload)
    if magic != b"S8B2":
        raise ValueError("not a Simple-8b block")
    parts, at = [], _HEAD.size
    for count, kind in ((n_docs, "<i8"), (n_docs, "<i8"), (n_docs, "<i8"), (-(-n_words // INDEX_WORDS), "<i8"), (n_words, "<u8"), (n_escapes, "<u8")):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += 8 * count
    return n, *parts


def block_ids(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and how many each document has."""
    n, lengths, _, _, _, words, escapes = open_block(payload)
    return unpack(words, escapes, n), lengths


def slice_ids(payload: bytes, start: int, stop: int) -> np.ndarray:
    """Some ids of a block; only the runs of words that hold them are decoded, found by the index."""
    n, _, _, _, index, words, escapes = open_block(payload)
    stop = min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    lo, hi = np.searchsorted(index, start, side="right") - 1, np.searchsorted(index, stop, side="left")
    run = words[lo * INDEX_WORDS : hi * INDEX_WORDS]
    got = unpack(run, escapes, int(_COUNTS[(run >> np.uint64(60)).astype(np.int64)].sum()))
    return got[start - int(index[lo]) : stop - int(index[lo])]


BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("within", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("payload", T.BinaryType())])
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the token files: ascending doc_id over all parts, and within each part in blocks.

    A null text has the end id only; documents of one id stand in the order of their texts, null ids come first.
    """

    def encode(batches):
        part, block, within, tail = TaskContext.get().partitionId(), 0, 0, np.array([end_id], "<u4").tobytes()
        tokens, held, ids, size = WordTokens.of(tokenizer, glued=True), [], [], 0

        def close():
            values = np.frombuffer(b"".join(held), "<u4")
            row = {"part": [part], "block": [block], "within": [within], "n_ids": [len(values)]}
            return common.to_batch(BLOCKS, row | {"payload": [block_bytes(values, np.array([len(x) // 4 for x in held], np.int64), ids)]})

        for batch in common.slices(batches, 1024):
            for doc_id, code in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                held.append(code + tail)
                ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= BLOCK_IDS:
                    yield close()
                    block, within, held, ids, size = block + 1, within + size, [], [], 0
        if held:
            yield close()

    common.texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Reads token files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32. Null ids come back as null,
    repeated rows each with their own start, files of an empty table as no rows.

    Only a total for each part meets in one place; the totals are broadcast, one row for each task that wrote.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def decode(batches):
        for batch in common.slices(batches, 1):
            base, payload = (batch.column(i)[0].as_py() for i in range(2))
            _, _, numbers, known, *_ = open_block(payload)
            values, lengths = block_ids(payload)
            raw, ends = values.astype("<u4").tobytes(), np.cumsum(lengths)
            starts = ends - lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids = pa.array(numbers, pa.int64(), mask=known == 0)
            yield common.to_batch(ROWS, {"doc_id": ids, "start": starts + base, "n_tokens": lengths, "ids_crc32": crcs})

    placed = blocks.join(F.broadcast(before), "part")
    return placed.select((F.col("before") + F.col("within")).alias("base"), "payload").mapInArrow(decode, ROWS)


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads them back. A null or empty text has the end id only; long texts are
    whole in one block; rows of one id stand in the order of their texts, null ids first; an empty table gives no rows."""
    path = common.shared_path(spark, "simple8b")
    write_blocks(common.table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_blocks(spark, path)
