"""Language-model scoring by a probabilistic suffix tree over the bytes of words."""

from __future__ import annotations

import math
from functools import cached_property
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .decontaminate import power_tables

#: The longest context in bytes; a context and the byte after it fill one 64-bit key.
DEPTH = 7
#: (State, next byte) pairs of a tree that is broadcast, at most: one of more is looked up by a shuffle, whole. Texts of so many
#: bytes in all are tried with a broadcast tree first.
MAX_PAIRS, SMALL_BYTES = 1_000_000, 8 << 20
#: Bytes of texts whose distinct keys are asked for together.
BLOCK_BYTES = 6 << 20
#: Words of this share of all tokens are looked up in the tasks: 10 million at most. Others are joined.
FREQUENT_SHARE = 1e-7
#: Taken off each word's count; the spelling shares it out.
DISCOUNT = 0.7
#: The tree's part in each token's chance; the rest is the token's share.
TREE_WEIGHT = 0.8
END = 0x0A
#: Bytes that a task looks at together, and distinct contexts that a worker keeps scores of.
CHUNK_BYTES, CACHE_KEYS = 1 << 21, 1_000_000
WORD, GRAM, SHORT = 0, 1, 2
#: Contexts of more bytes than this are tested in the task that has all texts' counts of their last bytes; shorter ones after that.
SPLIT = 3
#: Keys that a task holds before it sums equal ones up: of the texts that it counts, and of the counts that it gathers.
FLUSH_KEYS, ROWS = 4_000_000, 2_000_000
_FOLD = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))


class Chunk:
    """Token hashes and byte keys of some texts. Words are spelled with a space after each, and a text ends with its own sign.

    A key holds a byte in its lowest place and the DEPTH bytes before it above; before a text there are end signs. A
    token's hash is mixed from the sum of its bytes times powers of a base modulo 2^64; the end's sum is empty.
    """

    def __init__(self, texts: list[bytes]):
        pad = b"\n" * DEPTH + b" "
        parts = [b"".join((pad, t.translate(_FOLD), b" \n")) for t in texts]
        b = np.frombuffer(b"".join(parts), np.uint8)
        space, before = b == 32, np.concatenate([[END], b[:-1]])
        keep = ~space | ((before != 32) & (before != END))  # one space after each word
        stops = np.cumsum(keep)[np.cumsum([len(p) for p in parts]) - 1]
        b = b[keep]
        real = np.ones(len(b), bool)
        for d in range(DEPTH):
            real[np.concatenate([[0], stops[:-1]]) + d] = False
        closing = np.flatnonzero(real & ((b == 32) | (b == END)))
        self.n_tokens = np.diff(np.searchsorted(closing, stops), prepend=0)
        starts = np.concatenate([[DEPTH], closing[:-1] + 1])
        starts[np.cumsum(self.n_tokens)[:-1]] += DEPTH
        self._spans = b, starts, closing
        two = b.astype(np.uint16)
        two[1:] |= b[:-1].astype(np.uint16) << np.uint16(8)
        four = two.astype(np.uint32)
        four[2:] |= two[:-2].astype(np.uint32) << np.uint32(16)
        keys = four.astype(np.uint64)
        keys[4:] |= keys[:-4] << np.uint64(32)  # eight bytes: DEPTH and one
        self.keys = keys[real]
        self.starts = np.cumsum(real)[starts] - 1

    @cached_property
    def hashes(self) -> np.ndarray:
        b, starts, closing = self._spans
        up, down = power_tables(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        h = (sums[closing] - sums[starts]) * down[starts]
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)


def _chunks(batches, column: int):
    """(row numbers from, rows, texts) of about CHUNK_BYTES."""
    for batch in common.slices(batches, 512):
        texts, held, size, first = batch.column(column).to_pylist(), [], 0, 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(first, len(held)), held
                held, size, first = [], 0, i + 1


#: A task's counts travel in parts, by a hash of the word or of the last SPLIT bytes of the context: one for so many bytes of text,
#: 2^PART_BITS at least.
PART_BYTES, PART_BITS = 128 << 20, 10
_BLOBS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())])


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _planes(values: np.ndarray) -> bytes:
    """The values' bytes by their place, which compresses well for sorted keys."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(raw: memoryview, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


_MODEL = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("gain", T.DoubleType())])


def _part(turned: np.ndarray, bits: int) -> np.ndarray:
    """Of turned grams the part, of 2^bits, by the last SPLIT bytes of the context."""
    return _spread(turned & ~_NEXT & ~_mask(DEPTH - 1 - SPLIT), bits)


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)


def _counted(batches, bits: int = PART_BITS, grams: int = GRAM):
    """(kind, part, n, counts) of a task's texts: n distinct words (hashes) and turned grams, or pairs of SHORT contexts, with their
    counts, as bytes, in 2^bits parts."""
    held: dict[int, list[np.ndarray]] = {WORD: [], grams: []}

    def rows(kind):
        keys = np.sort(np.concatenate(held[kind]))
        held[kind] = []
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)
        part = _part(keys, bits) if kind == GRAM else _spread(keys, bits)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
        for at in range(0, len(edges) - 1, 64):
            some = list(zip(edges[at : at + 64], edges[at + 1 : at + 65]))
            blobs = [pa.compress(_planes(keys[i:j]) + _planes(counts[i:j]), "zstd", asbytes=True) for i, j in some]
            yield common.to_batch(_BLOBS, {"kind": np.full(len(some), kind, np.int32), "part": part[[i for i, _ in some]].astype(np.int32), "n": [j - i for i, j in some], "counts": blobs})

    for _, texts in _chunks(batches, 0):
        chunk = Chunk(texts)
        held[WORD].append(chunk.hashes.view(np.uint64))
        held[grams].append(chunk.keys.byteswap() if grams == GRAM else chunk.keys & _mask(SPLIT - 1))
        for kind in held:
            if sum(map(len, held[kind])) >= FLUSH_KEYS:
                yield from rows(kind)
    for kind in held:
        if held[kind]:
            yield from rows(kind)


def _mask(level: int) -> np.uint64:
    """Of a key the bytes of a context of this length and the byte after it."""
    return np.uint64((1 << 8 * (level + 1)) - 1)


def _shares(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of sorted pairs of a level each one's share of its context's."""
    context = pair >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    return n / np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(pair))))


def _gains(pair: np.ndarray, n: np.ndarray, short: np.ndarray, shares: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted pairs of a level, and those of the level below with their shares: which stay, and each one's context's gain."""
    context = pair >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    kinds = np.diff(np.append(first, len(pair)))
    total = np.add.reduceat(n, first)
    before = shares[np.searchsorted(short, pair & _mask(level - 1))]
    gain = np.add.reduceat(n * np.log(n / np.repeat(total, kinds) / before), first)
    return np.repeat(gain >= 0.5 * kinds * np.log(total + 1), kinds), np.repeat(gain, kinds)


def _levels(keys: np.ndarray, counts: np.ndarray, most: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted pairs of the contexts of most to least bytes, and their counts."""
    levels = {most + 1: (keys, counts)}
    for k in range(most, least - 1, -1):
        levels[k] = _sums(levels[k + 1][0] & _mask(k), levels[k + 1][1])
    return levels


def _tested(keys: np.ndarray, counts: np.ndarray):
    """Model rows of all (distinct) keys of some contexts of SPLIT bytes: states of longer contexts that pass, and the pairs of SPLIT bytes."""
    levels = _levels(keys, counts, DEPTH, SPLIT)

    def rows(kind, level, pair, n, gain):
        for at in range(0, len(pair), 1 << 17):
            part = slice(at, at + (1 << 17))
            m = len(pair[part])
            yield common.to_batch(_MODEL, {"kind": np.full(m, kind, np.int32), "level": np.full(m, level, np.int32), "key": pair[part].view(np.int64), "n": n[part].astype(np.int64), "gain": gain[part]})

    for k in range(SPLIT + 1, DEPTH + 1):
        stays, gain = _gains(*levels[k], levels[k - 1][0], _shares(*levels[k - 1]), k)
        yield from rows(GRAM, k, levels[k][0][stays], levels[k][1][stays], gain[stays])
    yield from rows(SHORT, SPLIT, *levels[SPLIT], np.zeros(len(levels[SPLIT][0])))


def _summed(batches):
    """Model rows from the counts of a partition, which has all of its words and of its contexts of SPLIT bytes: words with
    their counts, and what _tested says of grams. Equal keys are summed up as they come in."""
    held, size, most = {WORD: [], GRAM: [], SHORT: []}, 0, ROWS

    def merge(kind):
        return [_sums(*map(np.concatenate, zip(*held[kind])))] if held[kind] else []

    for batch in common.slices(batches, 64):
        for kind, n, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            raw = memoryview(pa.decompress(blob, 12 * n, "zstd", asbytes=True))
            held[kind].append((_values(raw[: 8 * n], np.uint64, n), _values(raw[8 * n :], np.uint32, n).astype(np.int64)))
            size += n
        if size >= most:
            held = {kind: merge(kind) for kind in held}
            size = sum(len(keys) for part in held.values() for keys, _ in part)
            most = max(ROWS, 2 * size)
    for kind, level in ((WORD, 0), (SHORT, SPLIT - 1)):
        for keys, counts in merge(kind):
            for at in range(0, len(keys), 1 << 17):
                k = keys[at : at + (1 << 17)].view(np.int64)
                yield common.to_batch(_MODEL, {"kind": np.full(len(k), kind, np.int32), "level": np.full(len(k), level, np.int32), "key": k, "n": counts[at : at + (1 << 17)], "gain": np.zeros(len(k))})
        held[kind] = []
    for keys, counts in merge(GRAM):
        held[GRAM] = []
        yield from _tested(keys.byteswap(), counts)


def model_table(docs: DataFrame) -> DataFrame:
    """(kind, level, key, n, gain) over all texts (column text, bytes): words, tested states of more than SPLIT bytes, pairs of SPLIT bytes.

    Counts of a task are shuffled once, grams by the last SPLIT bytes of their context: then all that the divergence test of
    longer contexts needs, their next bytes and those of their suffixes, is in one task. It holds the distinct keys of its
    partition, as an aggregation does. The parts grow in number with the input; what they cannot split are the keys of one context of
    SPLIT bytes, the largest of which has under a hundredth of all distinct keys.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(PART_BITS, math.ceil(math.log2(max(1, total / PART_BYTES)))))
    return docs.mapInArrow(lambda batches: _counted(batches, bits), _BLOBS).repartition("kind", "part").mapInArrow(_summed, _MODEL)


_NEXT = np.uint64(0xFF << 56)


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys by their next byte, then their context from its last byte back: a context's suffixes are its prefixes so, and
    looking sorted keys up at each length walks through each table in order."""
    return (keys.view(np.uint64) if keys.dtype == np.int64 else keys).byteswap()


class Tree:
    """States by level, each with its next bytes' counts; a state's chances are smoothed with its longest kept suffix's."""

    def __init__(self, level: np.ndarray, key: np.ndarray, n: np.ndarray):
        """Counts n of (context, byte) keys of the kept states by length of the context; that of no bytes is the root."""
        root = np.zeros(256)
        mine = level == 0
        root[(key[mine] & 255).astype(int)] = n[mine]
        self.root = (root + 1) / (root.sum() + 256)
        self.levels = []
        for k in range(1, DEPTH + 1):
            self._add(k, key[level == k], n[level == k])
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros(0)

    def _add(self, k: int, key: np.ndarray, n: np.ndarray) -> None:
        pair = _turned(key)
        order = np.argsort(pair)
        pair, count = pair[order], n[order].astype(np.float64)
        context, of, kinds = np.unique(pair & ~_NEXT, return_inverse=True, return_counts=True)
        share, total = 2.0 + 0.5 * kinds, np.bincount(of, count, len(context))
        chance = (count + share[of] * self._chance(pair, k - 1)) / (total[of] + share[of])
        self.levels.append((context, share / (total + share), pair, chance))

    def deeper(self, states: dict[int, tuple[np.ndarray, np.ndarray]]) -> Tree:
        """A tree of this one's states of shorter contexts and these: pairs and their counts, from SPLIT bytes on."""
        tree = Tree.__new__(Tree)
        tree.root, tree.levels = self.root, self.levels[: SPLIT - 1]
        for k in range(SPLIT, DEPTH + 1):
            tree._add(k, *states[k])
        tree.known, tree.scores = np.zeros(0, np.uint64), np.zeros(0)
        return tree

    def __getstate__(self):
        return self.__dict__ | {"known": np.zeros(0, np.uint64), "scores": np.zeros(0)}

    def _chance(self, turned: np.ndarray, deepest: int = DEPTH) -> np.ndarray:
        """The chance of each (turned) key's byte in the state of the longest suffix of its context, of so many bytes at most.

        A byte that a state was met with has its smoothed chance there; one that it was not met with has the state's rest
        of the chance in the next shorter state.
        """
        p, open_ends = np.ones(len(turned)), np.arange(len(turned))
        for k in range(deepest, 0, -1):
            states, rest, pairs, chance = self.levels[k - 1]
            if not len(pairs) or not len(open_ends):
                continue
            pair = turned[open_ends] & ~(_mask(DEPTH - 1 - k) if k < DEPTH else np.uint64(0))
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            there = pairs[at] == pair
            p[open_ends[there]] *= chance[at[there]]
            open_ends, pair = open_ends[~there], pair[~there] & ~_NEXT
            at = np.minimum(np.searchsorted(states, pair), len(states) - 1)
            p[open_ends] *= np.where(states[at] == pair, rest[at], 1.0)
        p[open_ends] *= self.root[(turned[open_ends] >> np.uint64(56)).astype(np.int64)]
        return p

    def log(self, keys: np.ndarray) -> np.ndarray:
        """The same for keys in any order and number; scores of distinct keys are kept."""
        code, distinct = pd.factorize(keys)
        turned = _turned(distinct)
        order = np.argsort(turned)
        ranked = turned[order]
        out = np.empty(len(ranked))
        new = np.ones(len(ranked), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, ranked), len(self.known) - 1)
            new = self.known[at] != ranked
            out[~new] = self.scores[at[~new]]
        out[new] = np.log10(self._chance(ranked[new]))
        if len(self.known) + int(new.sum()) > CACHE_KEYS:
            self.known, self.scores = ranked, out.copy()
        elif new.any():
            at = np.searchsorted(self.known, ranked[new])
            self.known, self.scores = np.insert(self.known, at, ranked[new]), np.insert(self.scores, at, out[new])
        back = np.empty(len(distinct))
        back[order] = out
        return back[code]


def states(model: DataFrame) -> DataFrame:
    """(level, key, n, gain) of the (context, byte) pairs of all contexts that pass the divergence test.

    A context of any count is tested: its next bytes must diverge from those of the context without its first byte by more
    nats in all than half the logarithm of its count for each distinct next byte, which is what stating them would cost.
    The context of no bytes always stays. Long contexts were tested where they were counted; those of SPLIT bytes and less
    are, here, few. A context has at most 256 next bytes, so no group is large.
    """
    masks = [int(_mask(k)) for k in range(SPLIT + 1)]
    tall = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col("key").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    pairs = model.where(F.col("kind") == SHORT).select(tall.alias("at"), "n").groupBy("at.level", "at.key").agg(F.sum("n").alias("n")).withColumn("context", F.shiftrightunsigned("key", 8))
    of = Window.partitionBy("level", "context")
    pairs = common.settled(pairs.select("level", "key", "n", "context", (F.col("n") / F.sum("n").over(of)).alias("chance")), "suffix-pairs")
    shorter = pairs.where(F.col("level") < SPLIT).select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"), F.col("chance").alias("before"))
    parent = F.coalesce(*[F.when(F.col("level") == k, F.col("key").bitwiseAND(F.lit(masks[k - 1]))) for k in range(1, SPLIT + 1)])
    both = pairs.where("level > 0").withColumn("parent", parent).join(shorter, ["level", "parent"])
    nodes = both.groupBy("level", "context").agg(
        F.sum(F.col("n") * F.log(F.col("chance") / F.col("before"))).alias("gain"), F.sum("n").alias("total"), F.collect_list(F.struct("key", "n")).alias("next")
    )
    kept = nodes.where(F.col("gain") >= 0.5 * F.size("next") * F.log(F.col("total") + 1)).select("level", F.explode("next").alias("p"), "gain")
    root = pairs.where("level = 0").select("level", "key", "n", F.lit(math.inf).alias("gain"))
    short = kept.select("level", "p.key", "p.n", "gain").union(root)
    return short.union(model.where(F.col("kind") == GRAM).select("level", "key", "n", "gain"))


def grow(kept: DataFrame, most: int = MAX_PAIRS) -> Tree:
    """The tree of the states of largest gain, with `most` pairs at most beside the root; only these come to the driver."""
    step = F.when(F.col("level") > 0, F.floor(4 * F.log2("gain")).cast("int")).otherwise(F.lit(1 << 30))
    sizes = sorted(((r["step"], r["n"]) for r in kept.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for at, n in sizes:
        if at < 1 << 30 and held + n > most:
            break
        least, held = at, held + (n if at < 1 << 30 else 0)
    table = kept.where(step >= least).select("level", "key", "n").toArrow()
    return Tree(*(table[c].to_numpy() for c in ("level", "key", "n")))


_SCORED = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())]
    + [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    + [T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("spelled", T.ArrayType(T.FloatType()))]
)


def token_score(c, spelled, n: int, v: int):
    """Log10 of a token's chance: of the tree's chance of its bytes after those before it, and of its discounted share of all
    tokens with the tree's chance for what was taken off, the weighted mean. Over all words it sums to 1 at most.
    """
    if not n:
        return spelled
    return np.log10((1 - TREE_WEIGHT) * np.maximum(c - DISCOUNT, 0) / n + (TREE_WEIGHT + (1 - TREE_WEIGHT) * DISCOUNT * v / n) * 10.0**spelled)


def _blocks(rows):
    """Of rows (task, doc_id, held_out, text) each task's texts in blocks, training ones and others apart: task, the block's number in
    it, held_out, ids, texts. Rows alone end a block, so the same rows in the same order give the same blocks."""
    for task, mine in groupby(rows, key=itemgetter(0)):
        number, held, size = 0, {False: ([], []), True: ([], [])}, {False: 0, True: 0}
        for _, doc_id, out, text in mine:
            ids, texts = held[out]
            ids.append(doc_id)
            texts.append(text)
            size[out] += len(text) + DEPTH
            if size[out] >= BLOCK_BYTES:
                held[out], size[out] = ([], []), 0
                yield task, number, out, ids, texts
                number += 1
        for out, (ids, texts) in held.items():
            if texts:
                yield task, number, out, ids, texts
                number += 1


def _cut(texts: list[bytes]) -> list[slice]:
    """Stretches of texts of about CHUNK_BYTES."""
    edges = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(texts)]
    return [slice(i, j) for i, j in zip(cuts, cuts[1:])]


def _packed(batches):
    """A row for each block: its texts, compressed, their lengths and ids."""
    for task, number, out, ids, texts in _blocks(_doc_rows(batches)):
        data = b"".join(texts)
        yield pa.RecordBatch.from_arrays([
            pa.array([task], pa.int64()), pa.array([number], pa.int32()), pa.array([-1], pa.int32()), pa.array([len(data)], pa.int64()),
            pa.array([_ZSTD.compress(data, asbytes=True)], pa.binary()), pa.array([out]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
        ], names=_PACKED.names)


_ASKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("task", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])
_PACKED = T.StructType([T.StructField(n, t) for n, t in (("task", T.LongType()), ("block", T.IntegerType()), ("part", T.IntegerType()), ("n", T.LongType()), ("data", T.BinaryType()), ("held_out", T.BooleanType()), ("ids", T.ArrayType(T.LongType())), ("sizes", T.ArrayType(T.IntegerType())))])
_ZSTD = pa.Codec("zstd", compression_level=3)
#: How many rows a task of a scan numbers, as Spark's increasing ids do.
_ROW_BITS = 33


def _doc_rows(batches):
    for batch in common.slices(batches, 512):
        at, *columns = (batch.column(c).to_pylist() for c in range(4))
        yield from zip((x >> _ROW_BITS for x in at), *columns, strict=True)


def _asked(batches, bits: int):
    """Of each block the distinct turned keys, by part, and how often training texts have them."""
    for task, number, out, _, texts in _blocks(_doc_rows(batches)):
        keys = np.concatenate([Chunk(texts[some]).keys for some in _cut(texts)])
        keys.byteswap(inplace=True)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)
        if out:
            counts[:] = 0
        part = _part(keys, bits)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
        for at in range(0, len(edges) - 1, 64):
            some = list(zip(edges[at : at + 64], edges[at + 1 : at + 65]))
            blobs = [_ZSTD.compress(_planes(keys[i:j]) + _planes(counts[i:j]), asbytes=True) for i, j in some]
            yield common.to_batch(_ASKED, {"part": part[[i for i, _ in some]].astype(np.int32), "task": np.full(len(some), task), "block": np.full(len(some), number, np.int32), "n": [j - i for i, j in some], "data": blobs})


class Short:
    """Pairs of contexts of less than SPLIT bytes: all of the longest of these, with their shares, and the tree of the states that pass."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        levels = _levels(pair, n, SPLIT - 1, 0)
        kept = [(0, *levels[0])]
        for k in range(1, SPLIT):
            stays, _ = _gains(*levels[k], levels[k - 1][0], _shares(*levels[k - 1]), k) if len(pair) else (np.zeros(0, bool), None)
            kept.append((k, levels[k][0][stays], levels[k][1][stays]))
        self.pair, self.share = levels[SPLIT - 1][0], _shares(*levels[SPLIT - 1]) if len(pair) else np.zeros(0)
        self.tree = Tree(*(np.concatenate(x) for x in zip(*((np.full(len(p), k), p, c) for k, p, c in kept))))


def _answered(batches, short: Short):
    """The rows of _asked, sorted by part, with log10 of each key's chance, of 11 significant bits, in place of keys and counts. A part has all keys of its
    contexts of SPLIT bytes, so the states of these and longer contexts are tested and grown here, whatever their number."""

    def parsed(n, data):
        raw = memoryview(pa.decompress(data, 12 * n, "zstd", asbytes=True))
        return _values(raw[: 8 * n], np.uint64, n), _values(raw[8 * n :], np.uint32, n).astype(np.int64)

    asked = (row for batch in common.slices(batches, 64) for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
    for part, rows in groupby(asked, key=itemgetter(0)):
        rows, held, size, most = list(rows), [], 0, ROWS
        for *_, n, data in rows:
            held.append(parsed(n, data))
            size += n
            if size >= most:
                held = [_sums(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                most = max(ROWS, 2 * size)
        turned, counts = _sums(*map(np.concatenate, zip(*held)))
        met = counts > 0
        levels, states = _levels(turned[met].byteswap(), counts[met], DEPTH, SPLIT), {}
        below, shares = short.pair, short.share
        for k in range(SPLIT, DEPTH + 1):
            pair, n = levels[k]
            stays = _gains(pair, n, below, shares, k)[0] if len(pair) else np.zeros(0, bool)
            states[k] = pair[stays], n[stays]
            below, shares = pair, _shares(pair, n) if len(pair) else np.zeros(0)
        chances = np.log10(short.tree.deeper(states)._chance(turned)).astype(np.float16)
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            data = [_ZSTD.compress(_planes(chances[np.searchsorted(turned, parsed(n, x)[0])]), asbytes=True) for *_, n, x in some]
            _, task, block, n, _ = zip(*some)
            yield common.to_batch(_ASKED, {"part": np.full(len(some), part, np.int32), "task": task, "block": block, "n": n, "data": data})


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct turned keys in order, and which of them each key is."""
    turned = keys.byteswap()
    order = np.argsort(turned)
    turned = turned[order]
    new = np.concatenate([[True], turned[1:] != turned[:-1]])
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return turned[new], of


def _spelled(chunks: list[Chunk], answers: list[tuple[int, int, bytes]], bits: int):
    """Of each of a block's chunks log10 of the chance of each key, from the answers of all parts (part, n, data). The chunks lose their keys."""
    own = []
    for chunk in chunks:
        own.append(_distinct(chunk.keys))
        del chunk.keys
    distinct = np.concatenate([d for d, _ in own])
    distinct.sort()
    distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
    if sum(n for _, n, _ in answers) != len(distinct):
        raise RuntimeError("the documents were not read in the same order twice")
    chance = np.empty(len(distinct), np.float16)
    chance[np.argsort(_part(distinct, bits), kind="stable")] = np.concatenate([_values(memoryview(pa.decompress(x, 2 * n, "zstd", asbytes=True)), np.float16, n) for _, n, x in sorted(answers)])
    for mine, of in own:
        yield chance[np.searchsorted(distinct, mine)].astype(np.float64)[of]


class Words:
    """Counts of words: how many tokens and distinct words there are, and the counts of frequent words, in order of their hashes."""

    def __init__(self, words: DataFrame):
        sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = sums["n"], sums["v"]
        self.least = max(1, int(np.ceil(FREQUENT_SHARE * self.n)))
        table = words.where(F.col("n") >= self.least).select("key", "n").toArrow()
        order = np.argsort(table["key"].to_numpy())
        self.known, self.often = table["key"].to_numpy()[order], table["n"].to_numpy()[order]
        self.base = np.log10(self.n + self.v + 1)

    def scored(self, row: int, ids, held_out, chunk: Chunk, chances: np.ndarray) -> pa.RecordBatch:
        """Rows of _SCORED of a chunk's texts, from log10 of each key's chance; tokens of other words are left to the join."""
        spelled = np.add.reduceat(chances, chunk.starts)
        c = np.zeros(len(chunk.hashes))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, chunk.hashes), len(self.known) - 1)
            c = np.where(self.known[at] == chunk.hashes, self.often[at], 0).astype(np.float64)
        rare = (c == 0) & (self.least > 1)
        starts = np.concatenate([[0], np.cumsum(chunk.n_tokens)[:-1]])
        there = ~rare
        add = lambda x: np.add.reduceat(np.where(there, x, 0.0), starts)
        sizes = np.add.reduceat(rare.astype(np.int64), starts)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        k = len(starts)
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(row, row + k)), ids, held_out, pa.array(chunk.n_tokens), pa.array(add(c > 0).astype(np.int64)),
            pa.array(add(np.log10(c + 1) - self.base)), pa.array(add(token_score(c, spelled, self.n, self.v))),
            pa.ListArray.from_arrays(offsets, pa.array(chunk.hashes[rare])), pa.ListArray.from_arrays(offsets, pa.array(spelled[rare].astype(np.float32))),
        ], names=_SCORED.names)


def _with_broadcast_tree(src: DataFrame) -> tuple[DataFrame, Words, DataFrame] | None:
    """Word counts and scored rows by a tree that is broadcast whole; none if it has over MAX_PAIRS pairs."""
    model = common.settled(model_table(src.where(~F.col("held_out")).select("text")), "suffix-model")
    kept = common.settled(states(model), "suffix-states")
    if kept.where("level > 0").count() > MAX_PAIRS:
        common.drop(model, kept)
        return None
    counts = model.where(F.col("kind") == WORD)
    words = Words(counts)
    shared = src.sparkSession.sparkContext.broadcast((grow(kept), words))
    common.drop(kept)

    def run(batches):
        tree, words = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch, texts in _chunks(batches, 2):
            chunk = Chunk(texts)
            yield words.scored(row, batch.column(0), batch.column(1), chunk, tree.log(chunk.keys))
            row += len(texts)

    return counts, words, src.mapInArrow(run, _SCORED)


def _with_shuffled_tree(src: DataFrame, total: int) -> tuple[DataFrame, Words, DataFrame]:
    """Word counts and scored rows by a tree of any size, of which a task has the states of some parts.

    Words and pairs of contexts of less than SPLIT bytes (2^24 at most, broadcast) are counted first. Then the distinct keys of each
    block of texts travel once, with their counts, to the task that has all keys of their contexts of SPLIT bytes. That task tests the
    states, keeps all that pass, and answers each block's keys with their chances, which meet the block's packed texts by a second shuffle.
    Rows have the number that their scan gives them, which must be the same in both scans; the numbers of keys are compared.
    """
    spark = src.sparkSession
    bits = min(30, max(PART_BITS, math.ceil(math.log2(max(1, total / PART_BYTES)))))
    tallied = src.where(~F.col("held_out")).select("text").mapInArrow(lambda batches: _counted(batches, bits, SHORT), _BLOBS)
    model = common.settled(tallied.repartition("kind", "part").mapInArrow(_summed, _MODEL), "suffix-model")
    counts = model.where(F.col("kind") == WORD)
    pairs = model.where(F.col("kind") == SHORT).select("key", "n").toArrow()
    shared = spark.sparkContext.broadcast(Short(pairs["key"].to_numpy().astype(np.int64).view(np.uint64), pairs["n"].to_numpy()))
    numbered = src.select(F.monotonically_increasing_id().alias("at"), "doc_id", "held_out", "text")
    asked = numbered.mapInArrow(lambda batches: _asked(batches, bits), _ASKED)
    answered = asked.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _answered(batches, shared.value), _ASKED)
    words = Words(counts)
    often = spark.sparkContext.broadcast(words)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in _PACKED.fields[5:]]
    both = numbered.mapInArrow(_packed, _PACKED).union(answered.select("task", "block", "part", "n", "data", *none))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        rows = (r for batch in common.slices(batches, 64) for r in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True))
        for _, block in groupby(rows, key=itemgetter(0, 1)):
            *_, n, data, out, ids, sizes = next(block)
            if sizes is None:
                raise RuntimeError("the documents were not read in the same order twice")
            data, ends = pa.decompress(data, n, "zstd", asbytes=True), np.cumsum(sizes).tolist()
            texts = [data[i:j] for i, j in zip([0, *ends], ends)]
            cut = _cut(texts)
            chunks = [Chunk(texts[some]) for some in cut]
            del data, texts
            for some, chunk, chances in zip(cut, chunks, _spelled(chunks, [r[2:5] for r in block], bits), strict=True):
                k = some.stop - some.start
                yield often.value.scored(row, pa.array(ids[some], pa.int64()), pa.array(np.full(k, out)), chunk, chances)
                row += k

    return counts, words, both.repartition("task", "block").sortWithinPartitions("task", "block", "part").mapInArrow(run, _SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; a null text has the end token only.

    Counts come from all training documents, and every state that passes the divergence test has its say. A small tree is
    broadcast, one of over MAX_PAIRS pairs is looked up by a shuffle; frequent words are broadcast, and tokens of other words are
    joined with their counts by hash, of which each is rare, so no key is hot.
    """
    src = docs.select("doc_id", common.in_fold(F.col("doc_id"), 7, 2).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts, words, rows = (total <= SMALL_BYTES and _with_broadcast_tree(src)) or _with_shuffled_tree(src, total)
    n, v = words.n, words.v
    scored = common.settled(rows, "suffix-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelled")).alias("t")).select("row", F.col("t.rare").alias("key"), F.col("t.spelled").cast("double").alias("s"))
    c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    found = rare.join(counts.where(F.col("n") < words.least).select("key", "n"), "key", "left").select(
        "row", F.when(c > 0, 1).otherwise(0).alias("k"), (F.log10(c + 1) - float(words.base)).alias("b"), F.log10((1 - TREE_WEIGHT) * F.greatest(c - DISCOUNT, F.lit(0.0)) / max(n, 1) + (TREE_WEIGHT + (1 - TREE_WEIGHT) * DISCOUNT * v / max(n, 1)) * F.pow(F.lit(10.0), F.col("s"))).alias("s")
    )
    more = found.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    return scored.drop("rare", "spelled").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. A null or empty text has the end only; long texts are scored whole; rows that repeat are scored
    each and learned from each; a null id is learned from; an empty table gives no rows. Other columns are not read."""
    return score_documents(common.table(spark, sf_dir, "documents"))
