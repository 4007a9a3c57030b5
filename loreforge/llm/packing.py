"""Cost-balanced packing of token ids into training sequences."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .tokens import WordTokens, tokenizer_path

CAPACITY = 4096
#: Documents are packed together in groups that close at so many ids.
GROUP_IDS = 1 << 20
#: Attention costs a * n + b * n * n for a piece of n ids: projections are linear, scores quadratic.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")] + [T.StructField("sequence_cost", T.DoubleType())]
)


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def sequence_sizes(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, and powers of two for what is left: sizes that need no padding."""
    left = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def balance(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    Documents are cut at the capacity. Pieces in descending length go to the sequence of lowest cost that has room;
    where none has, the piece is cut to the room of the lowest-cost open sequence and the rest stands in line again.
    Room in all is exactly what the documents need, so every sequence ends full.
    """
    sizes = np.array(sequence_sizes(sum(lengths), capacity), np.int64)
    room, spent = sizes.copy(), np.zeros(len(sizes))
    line = [(-min(capacity, n - at), doc, at) for doc, n in enumerate(lengths) for at in range(0, n, capacity)]
    heapq.heapify(line)
    out = []
    while line:
        size, doc, at = heapq.heappop(line)
        size = -size
        fits = np.flatnonzero(room >= size)
        if not len(fits):
            fits = np.flatnonzero(room > 0)
        to = int(fits[np.argmin(spent[fits])])
        put = min(size, int(room[to]))
        out.append((doc, at, put, to, int(sizes[to] - room[to])))
        room[to] -= put
        spent[to] += cost(put)
        if put < size:
            heapq.heappush(line, (put - size, doc, at + put))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_ids: int = GROUP_IDS, end_id: int = 2) -> DataFrame:
    """One row for each piece of each document (null text: its end id only; repeated rows are packed each).

    A task packs what it reads in groups of about `group_ids` ids, so nothing is shuffled and a task's memory is bounded
    by a group and one document. sequence_id: the task in the upper bits, so ids differ between tasks and a task that is
    run again gives the same.
    """

    def run(batches):
        tokens, tail = WordTokens.of(tokenizer, glued=False), np.array([end_id], "<u4").tobytes()
        sequence, held, ids, size = TaskContext.get().partitionId() << 36, [], [], 0

        def close(first: int):
            pieces = balance([len(x) // 4 for x in held], capacity)
            spent, full = {}, {}
            for _, _, n, to, offset in pieces:
                spent[to] = spent.get(to, 0.0) + cost(n)
                full[to] = max(full.get(to, 0), offset + n)
            rows = [(ids[d], at, n, zlib.crc32(memoryview(held[d])[4 * at : 4 * (at + n)]), len(held[d]) // 4, first + to, offset, full[to], spent[to]) for d, at, n, to, offset in pieces]
            return common.to_batch(PIECES, dict(zip(PIECES.names, zip(*rows, strict=True), strict=True))), len(full)

        for batch in common.slices(batches):
            for doc_id, code in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                held.append(code + tail)
                ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= group_ids:
                    out, n = close(sequence)
                    yield out
                    sequence, held, ids, size = sequence + n, [], [], 0
        if held:
            yield close(sequence)[0]

    return common.texts(docs).mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents. A null or empty text is its end id; long texts are cut at the capacity; rows that repeat are
    packed each; an empty table gives no rows. Other columns are not read."""
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
