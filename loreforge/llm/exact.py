"""Exact duplicates by an extendible-hash index on shared files: a directory that doubles, buckets of key ranges, chains of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Deleted from a text before it is compared: space and the control characters 9 to 13.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
SEED = 42
#: Distinct keys of a bucket before it splits, and the bits of the directory at most: 2^20 slots are 5 MB wherever they go.
#: A bucket with that many bits may be overfull; it is a longer chain then.
CAPACITY, MOST_BITS = 1024, 20
#: Bytes of texts that a task of the first step keeps, so that copies of them need no text of their own.
HELD_BYTES = 48 << 20

_KEYS = T.StructType([T.StructField("key", T.LongType())])
#: A row of the table, and its text where it is the task's first one of this text and its key has other rows.
ROWS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "row", "chars", "key", "first")]
    + [T.StructField("sha256", T.StringType()), T.StructField("text", T.BinaryType())]
)
#: One of the texts that a task has seen, with its rows summed up: how many, and which of them stays.
CLASSES = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "key", "chain", "keep_id", "keep_row", "group_size")])


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)


def key_of(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, SEED)


class Directory:
    """Which bucket has a key: the key's first `bits` bits are a slot, and `depth` has for each slot how many of them its bucket has.

    Slots that agree in that many bits are one bucket, named by the least of them; so a bucket is a range of keys.
    """

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        """counts: distinct keys by their first bits, a power of two of them. Starts with one bucket; while one is overfull,
        it splits, and the directory doubles where that bucket had one slot left."""
        most = int(len(counts)).bit_length() - 1
        levels = [counts]
        for _ in range(most):
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        levels.reverse()  # levels[b]: keys by their first b bits
        depth, bits = np.zeros(1, np.int8), 0
        while bits < most:
            overfull = (depth == bits) & (levels[bits] > capacity)
            if not overfull.any():
                break
            depth, bits = np.repeat(depth + overfull.astype(np.int8), 2), bits + 1
        self.bits, self.depth = bits, depth

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def buckets(self) -> np.ndarray:
        """The bucket of each slot."""
        left = self.bits - self.depth.astype(np.int64)
        return np.arange(len(self.depth)) >> left << left

    def rows(self, spark: SparkSession) -> DataFrame:
        """slot, bucket, depth: the directory as it stands in its file."""
        return spark.createDataFrame(pa.table({"slot": np.arange(len(self.depth)), "bucket": self.buckets(), "depth": self.depth.astype(np.int32)}))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory for the distinct keys of a table; 2^20 counts come to the driver at most."""
    top = F.shiftrightunsigned("key", 64 - MOST_BITS)
    found = keys.groupBy(top.alias("top")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << MOST_BITS, np.int64)
    counts[found["top"].to_numpy()] = found["n"].to_numpy()
    return Directory(counts, capacity)


def keys(docs: DataFrame) -> DataFrame:
    """key and its number of rows (n)."""

    def run(batches):
        for batch in common.slices(batches):
            found = np.array([key_of(normalised(t)) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    return docs.select("text").mapInArrow(run, _KEYS).groupBy("key").agg(F.count("*").alias("n"))


def _shared(keys: DataFrame) -> np.ndarray:
    """2^20 bits: whether a key with these first bits has several rows. Rows elsewhere need no comparison."""
    top = F.shiftrightunsigned("key", 64 - MOST_BITS)
    found = keys.where("n > 1").select(top.alias("top")).distinct().toArrow()["top"].to_numpy()
    bits = np.zeros(1 << MOST_BITS, bool)
    bits[found] = True
    return np.packbits(bits)


def rows(docs: DataFrame, shared: np.ndarray, held_bytes: int = HELD_BYTES) -> DataFrame:
    """ROWS of a table. `first` names the task's first row of the same text; only that one brings the text along.

    A task forgets its texts once they take `held_bytes`: a later copy is a first row again, and meets the others in its bucket.
    """
    at = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        marks, number = at.value, TaskContext.get().partitionId() << 40
        held: dict[int, list[tuple[bytes, int]]] = {}
        size = 0
        for batch in common.slices(batches):
            out = {f.name: [] for f in ROWS.fields}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = normalised(text)
                key = key_of(data)
                top = key >> (64 - MOST_BITS)
                first, brought = number, None
                if marks[top >> 3] >> (7 - (top & 7)) & 1:
                    chain = held.setdefault(key, [])
                    first = next((n for known, n in chain if known == data), number)
                    if first == number:
                        if (size := size + len(data) + 100) > held_bytes:
                            held, size = {}, len(data)
                            chain = held.setdefault(key, [])
                        chain.append((data, number))
                        brought = data
                for name, value in zip(ROWS.names, (doc_id, number, len(text or ""), key - (key >> 63 << 64), first, hashlib.sha256(data).hexdigest(), brought), strict=True):
                    out[name].append(value)
                number += 1
            yield common.to_batch(ROWS, out)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


_BEST = ("chars", "no_id", "doc_id", "row")


def _order(c: str = "") -> Column:
    """Of equal texts stays the row with the most characters, then the smallest id (a null one last), then any one row."""
    return F.struct((-F.col(f"{c}chars")).alias("chars"), F.col(f"{c}doc_id").isNull().alias("no_id"), F.col(f"{c}doc_id").alias("doc_id"), F.col(f"{c}row").alias("row"))


def _chains(batches):
    """Owner task: equal keys are neighbours, and those of one key are held against the texts of its chain byte for byte.

    A class of a task has two rows: its text, where it brought one, and then its sums.
    """
    out: dict[str, list] = {f.name: [] for f in CLASSES.fields}
    key, chain, texts, waiting, brought = None, {}, [], [], (None, None)

    def close():
        for first, link in waiting:
            size, best = chain[link]
            for name, value in zip(CLASSES.names, (first, key, link, best[2], best[3], size), strict=True):
                out[name].append(value)

    for batch in common.slices(batches, 512):
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for k, first, data, size, best in zip(*columns, strict=True):
            if size is None:
                brought = first, data
                continue
            if k != key:
                close()
                key, chain, texts, waiting = k, {}, [], []
            data = brought[1] if brought[0] == first else None
            best = tuple(best[n] for n in _BEST)
            link = next((i for i, known in enumerate(texts) if known == data), len(texts))
            if link == len(texts):
                texts.append(data)
            had = chain.get(link)
            chain[link] = (size + had[0], min(best, had[1], key=_rank)) if had else (size, best)
            waiting.append((first, link))
        if out["first"]:
            yield common.to_batch(CLASSES, out)
            out = {f.name: [] for f in CLASSES.fields}
    close()
    yield common.to_batch(CLASSES, out)


def _rank(best: tuple) -> tuple:
    chars, no_id, doc_id, row = best
    return chars, no_id, doc_id or 0, row


def _dealt(firsts: DataFrame, index: Directory) -> DataFrame:
    """Rows by the owners of their buckets, in order of their keys: an owner has a stretch of the directory, and no bucket has two."""
    n = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = index.rows(firsts.sparkSession).select("slot", (F.col("bucket") * n / len(index.depth)).cast("int").alias("owner"))
    slot = F.shiftrightunsigned("key", 64 - index.bits) if index.bits else F.lit(0).cast("long")
    owned = firsts.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")
    return owned.repartitionById(n, "owner").sortWithinPartitions("key", "first", F.asc_nulls_first("size"))


class Index:
    """The index as files of the shared folder.

    directory: slot, bucket, depth.  rows: ROWS of the table, dealt as it was read.
    classes: each distinct text as its tasks saw it (first), by owner and key, with its place in its key's chain, the row that
    stays and the number of rows.
    """

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY):
        spark = docs.sparkSession
        found = common.settled(keys(docs), "exact-keys")
        self.directory = directory(found, capacity)
        self.rows = common.settled(rows(docs, _shared(found)), "exact-rows")
        common.drop(found)
        summed = self.rows.groupBy("key", "first").agg(F.count("*").alias("size"), F.min(_order()).alias("best"))
        brought = self.rows.where(F.col("text").isNotNull()).select("key", "first", "text")
        both = brought.unionByName(summed, allowMissingColumns=True)
        self.classes = common.settled(_dealt(both, self.directory).select("key", "first", "text", "size", "best").mapInArrow(_chains, CLASSES), "exact-classes")
        self.slots = common.settled(self.directory.rows(spark), "exact-directory")

    def groups(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of each row, and its row number."""
        of = self.classes.select("first", "keep_id", "keep_row", "group_size")
        return self.rows.drop("text").join(of, "first").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"), "row")

    def entries(self) -> DataFrame:
        """One row for each distinct text: its key, its place in the key's chain, the id that stays and the number of rows."""
        return self.classes.groupBy("key", "chain").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))

    def drop(self) -> None:
        common.drop(self.rows, self.classes, self.slots)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each row with the row that stays of those with its text, blanks deleted.

    Keys are 64-bit hashes of normalised texts. They are counted first, so that the directory can split what is overfull and
    texts whose key no other row has stay where they are. The others are chained in the task that reads them (copies within
    it leave one text) and then in the task that owns their bucket. A key's chain holds its different texts, told apart by
    their bytes; a group of copies has one text for each reading task there.
    """
    return Index(docs, capacity).groups().drop("row")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and which row of its text stays.

    A null text is empty, and equal to those of blanks only; of ties in length the smallest doc_id stays, a null id last; rows
    that repeat have a row each, and one of them is kept. Long texts are read whole, an empty table gives no rows, and other
    columns are not read.
    """
    return exact_groups(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
