"""Near copies by the likeness of their five-word shingles: keys of several minima find candidates, exact sets decide."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .decontaminate import shingle_hashes, word_hashes

WIDTH = 5
#: Texts are linked if they share this part of all their distinct shingles: 4 of 5.
SHARED, OF = 4, 5
#: Keys of a text and minima in a key. Of pairs that are just like enough, one in 97,000 has no key in common.
KEYS, MINIMA = 16, 3
_SEEDS = np.random.default_rng(9).integers(0, 1 << 63, KEYS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _PIECE = np.uint64(0x9E3779B97F4A7C15), 1 << 13
_GAPS = bytes(32 if 9 <= i <= 13 else i for i in range(256))
#: Shingles of a list that a task compares at a time.
LONG = 1 << 22
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingles(text: bytes) -> tuple[int, np.ndarray]:
    """A digest of the words in order, and hashes of the distinct runs of five words; of all words where there are fewer."""
    words = word_hashes(text.lower().translate(_GAPS))
    return xxhash.xxh64_intdigest(words.tobytes()), np.unique(shingle_hashes(words, min(WIDTH, len(words)))) if len(words) else words


def keys(hashes: np.ndarray) -> np.ndarray:
    """A text's keys, of so many minima each; none without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PIECE):
        np.minimum(least, (_SEEDS[:, None] * hashes[None, at : at + _PIECE]).min(axis=1), out=least)
    out = np.arange(KEYS, dtype=np.uint64)
    for column in least.reshape(KEYS, MINIMA).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _set(text: str | None) -> np.ndarray:
    return shingles((text or "").encode("utf-8", "surrogatepass"))[1]


def _sizes_near(x: Column, y: Column) -> Column:
    return OF * F.least(x, y) >= SHARED * F.greatest(x, y)


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those alike enough, counted exactly; texts: (node, text). Rows of one `a` follow each other."""

    def run(batches):
        last, mine = None, np.zeros(0, np.uint64)
        for batch in common.slices(batches):
            a, b, keep = batch.column(0).to_pylist(), batch.column(1), []
            for i, node in enumerate(a):
                if node != last:
                    last, mine = node, _set(batch.column(2)[i].as_py())
                other = _set(batch.column(3)[i].as_py())
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(OF * shared >= SHARED * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), b], names=LINKS.names).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, LINKS)


def spanning(roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between texts of different roots that join all sets which any such link joins.

    A text of which others here have less than 0.8 drops out first. Then each text that is not of the most frequent root
    is held against all, by counting over an inverted index of their shingles.
    """
    sizes, alive = np.array([len(x) for x in sets]), np.ones(len(sets), bool)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    distinct, code = np.unique(flat, return_inverse=True)
    for _ in range(8):
        often = np.bincount(code[alive[owner]], minlength=len(distinct))
        now = alive & (OF * np.bincount(owner, often[code] > 1, len(sets)) >= SHARED * sizes) & (sizes > 0)
        if (now == alive).all():
            break
        alive = now
    label = np.unique(roots, return_inverse=True)[1]
    here = np.flatnonzero(alive[owner])
    here = here[np.argsort(code[here], kind="stable")]
    holders, often = owner[here], np.bincount(code[here], minlength=len(distinct))
    first, ends, out = np.concatenate([[0], np.cumsum(often)[:-1]]), np.cumsum(sizes), []
    if not alive.any():
        return out
    main = np.bincount(label[alive]).argmax()
    for x in np.flatnonzero(alive & (label != main)).tolist():
        mine = code[ends[x] - sizes[x] : ends[x]]
        n = often[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((OF * shared >= SHARED * (sizes[x] + sizes - shared)) & alive & (label != label[x]))
        for y in near.tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _by_list(lists: DataFrame) -> DataFrame:
    """Links within lists of (key, node, root, text) rows; a task holds the shingles of one list at a time."""

    def run(batches):
        key, nodes, roots, sets = None, [], [], []

        def close():
            pairs = spanning(np.array(roots), sets) if len(set(roots)) > 1 else []
            return common.to_batch(LINKS, {"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]})

        for batch in common.slices(batches):
            for k, node, root, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield close()
                    key, nodes, roots, sets = k, [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(_set(text))
        if len(nodes) > 1:
            yield close()

    return lists.select("key", "node", "root", "text").repartition("key").sortWithinPartitions("key").mapInArrow(run, LINKS)


def _mixed(post: DataFrame) -> DataFrame:
    """(key, node, root, size) rows of keys that nodes of several roots have, with the list's shingles in all."""
    lists = post.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("root").alias("least"), F.max("root").alias("most"))
    return post.hint("merge").join(lists.where("least < most").select("key", "n", "all"), "key")


def links(nodes: DataFrame, texts: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that, with those of each node to its `root`, join what is alike; none between sets is lost.

    nodes: (node, root, size, keys) of distinct texts, texts: (node, text). Nodes with a key in common are candidates. Each
    list's nodes are held against its hub first: the node whose keys are the most frequent, which of a text and its near
    copies is the text. Lists that have nodes of several sets after that are compared in tasks, where what cannot be alike
    drops out at once and only links that join sets leave. A list of more than LONG shingles is split by the second key
    that its nodes share (of pairs that are just like enough, one in 5,000 has one key in common only), and one that is
    too long still into pairs of blocks. Joins with texts and postings are sort-merge joins at every size, so what is
    shuffled is in proportion to the input.
    """
    lists = common.settled(_mixed(nodes.select("node", "root", "size", F.explode("keys").alias("key"))), "similar-lists")
    fame = lists.groupBy("node").agg(F.sum("n").alias("fame"))
    hubs = lists.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", "node", "root", "size")).alias("hub"))
    first = lists.join(hubs, "key").where((F.col("root") != F.col("hub.root")) & _sizes_near(F.col("size"), F.col("hub.size")))
    first = common.settled(first.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "similar-pairs")
    asked = common.settled(texts.hint("merge").join(lists.select("node").distinct(), "node", "left_semi"), "similar-texts")
    found = common.settled(_alike(first, asked), "similar-links")
    roots = components(found.union(nodes.where("node <> root").select("root", "node")))
    now = lists.drop("root", "n", "all").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "size")
    mixed = common.settled(_mixed(now), "similar-mixed")
    short = mixed.where(F.col("all") <= LONG).select("key", "node", "root")
    long = mixed.where(F.col("all") > LONG).select("key", "node", "root", "size").join(nodes.select("node", "keys"), "node")
    second = F.explode(F.array_except("keys", F.array("key"))).alias("other")
    long = long.select("key", "node", "root", "size", second).select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "node", "root", "size").distinct()
    long = common.settled(_mixed(long), "similar-long")
    blocks = F.ceil(2 * F.col("all") / LONG).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    blocked = long.select("key", "node", "root", own.alias("own"), other).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "root")
    within = common.settled(_by_list(short.union(blocked).join(asked.hint("merge"), "node")), "similar-links")
    common.drop(lists, first, asked, mixed, long)
    return found.union(within)
