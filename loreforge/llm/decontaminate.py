"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH, THRESHOLD = 5, 0.8
#: Minima of each signature. A passage that holds 0.8 of an item has a Jaccard likeness of 0.19 at least with the window
#: around it, so all of 64 minima differ in about one of 700,000 cases.
MINIMA = 64
#: Items whose signatures are broadcast at a time; more are searched for in further blocks.
BLOCK_ITEMS = 20_000
#: Their bytes, about.
BLOCK_BYTES = 64 << 20
_GAP = re.compile(r"\W+")
_ASCII_GAPS = bytes(32 if i < 128 and not (chr(i).isalnum() or i == 95) else i for i in range(256))
_SEEDS = np.random.default_rng(8).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
#: Texts are hashed in stretches of about so many bytes.
STRETCH = 1 << 20
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def folded(text: str) -> bytes:
    """The text in lower case with each sign that is no letter, digit or underscore as a space; words() of it are what counts."""
    low = text.lower()
    if not low.isascii() and not all(c.isalnum() for c in set(low) if c > "\x7f"):
        low = _GAP.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_ASCII_GAPS)


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from sums of its bytes times powers of a base; a word's place makes no difference."""
    out, at = [], 0
    while at < len(data):
        stop = len(data) if len(data) - at <= STRETCH else data.find(b" ", at + STRETCH)
        stop = len(data) if stop < 0 else stop
        b = np.frombuffer(data, np.uint8, stop - at, at)
        up, down = power_tables(len(b) + 1)
        edges = np.flatnonzero(np.diff((b != 32).view(np.int8), prepend=0, append=0))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        out.append((h ^ (h >> np.uint64(31))) * _STEP)
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words, from the words' hashes."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def minima(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value under each hash function, and the shingle that has it."""
    values = (hashes[:, None] * _SEEDS) ^ (hashes[:, None] >> np.uint64(32)) * (_SEEDS ^ _STEP)
    at = values.argmin(axis=0)
    return values[at, np.arange(MINIMA)], hashes[at]


class Index:
    """Signatures of a block of items by size: a class holds items of 2^c to 2^(c+1) - 1 shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.exact: list[tuple[int, set[bytes], int]] = []
        self.classes: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = {}
        probes: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            data = folded(text or "")
            words = data.split()
            width = min(WIDTH, len(words))
            if not width:
                continue
            number = len(self.exact)
            self.exact.append((item_id, shingles(words, width), width))
            hashes = np.unique(shingle_hashes(word_hashes(data), width))
            least, who = minima(hashes)
            table = self.classes.setdefault((width, len(hashes).bit_length() - 1), {})
            for k, v in enumerate(least.tolist()):
                table.setdefault((k, v), []).append(number)
            probes.setdefault(width, []).append(who)
        self.probes = {w: np.unique(np.concatenate(x)) for w, x in probes.items()}
        self.filters = {}
        for w, x in self.probes.items():
            self.filters[w] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[w][(x >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, data: bytes) -> set[int]:
        """Items one of whose minima is a minimum of a window of the text.

        Windows of a class are four times its least size and overlap by half, so a passage lies within one. A window can
        only agree with an item in a minimum if it holds the shingle that has it; others need no signature.
        """
        found: set[int] = set()
        words = word_hashes(data)
        for width, probe in self.probes.items():
            h = shingle_hashes(words, width)
            maybe = np.flatnonzero(self.filters[width][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            hits = maybe[probe[np.minimum(np.searchsorted(probe, h[maybe]), len(probe) - 1)] == h[maybe]]
            if not len(hits):
                continue
            for (w, c), table in self.classes.items():
                if w != width:
                    continue
                stride = 2 << c
                for j in np.unique(np.concatenate([hits // stride, np.maximum(hits // stride - 1, 0)])).tolist():
                    least, _ = minima(h[j * stride : (j + 2) * stride])
                    for key in enumerate(least.tolist()):
                        found.update(table.get(key, ()))
        return found

    def matches(self, text: str, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(item, shared shingles, shingles of the item) of each item of which the text holds enough, counted exactly."""
        data = folded(text)
        if found := self.candidates(data):
            words = data.split()
            of = {w: shingles(words, w) for w in {self.exact[k][2] for k in found}}
            for k in sorted(found):
                item_id, mine, width = self.exact[k]
                shared = len(mine & of[width])
                if shared >= threshold * len(mine):
                    yield item_id, shared, len(mine)


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of a bounded number of rows and bytes; the documents are read once for each block."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    totals = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if totals["n"] <= size and totals["bytes"] <= BLOCK_BYTES:
        blocks = [items]
    else:
        parts = max(-(-2 * totals["n"] // size), -(-2 * totals["bytes"] // BLOCK_BYTES))
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        blocks = [items.where(number == k) for k in range(parts)]
    for block in blocks:
        yield [(r[0], r[1]) for r in block.toLocalIterator()]


MATCHES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "shared", "n_shingles")] + [T.StructField("containment", T.DoubleType())])


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment of each document that holds this share of an item's shingles.

    Shingles are distinct runs of five words; an item of fewer words is one shingle; null and empty texts match nothing.
    Documents that repeat match each; items that repeat (id and text) are one. Empty tables give no rows.
    Documents are not shuffled, and windows and candidates never leave a task.
    """
    out = None
    for items in item_blocks(benchmark):
        shared_index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches, index=shared_index):
            for batch in common.slices(batches):
                rows = [(i, item, s, n, s / n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item, s, n in index.value.matches(t, threshold)]
                if rows:
                    yield common.to_batch(MATCHES, dict(zip(MATCHES.names, zip(*rows, strict=True), strict=True)))

        found = common.texts(docs).mapInArrow(run, MATCHES)
        out = found if out is None else out.union(found)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that hold no item. Null and empty texts stay; rows that repeat stay or go each;
    without items all stay."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark):
        shared_index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches, index=shared_index):
            for batch in common.slices(batches):
                clean = [not any(True for _ in index.value.matches(t or "", threshold)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds an item, with how much of it. Nulls, short items, repeated rows and empty tables as in search."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS r(p)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM s), unnest(range(1, len(w) - k + 2)) AS r(p)
)
SELECT doc_id, item_id, count(*) AS shared, n_shingles, count(*) / n_shingles AS containment
FROM s JOIN g USING (k, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles
"""
