"""SimHash near-duplicates: a byte-position index with count filtering, and components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, similar

SEED, WORDS, MAX_BITS = 42, 3, 3
#: Three differing bits touch three of the eight bytes at most, so linked fingerprints share five.
BYTES, MIN_SHARED = 8, 5
#: Of five shared positions, three lie within one half; so the index has a posting for each three bytes of a half.
TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
#: A posting list with more fingerprints is indexed anew by five bytes.
LONG_LIST = 2048

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("bits", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of so many lower-case words, repeats included; of all words where there are fewer."""
    found = text.lower().split()  # on bytes: A-Z only, and at space and the characters 9 to 13
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(found) - k + 1)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes; no words: zero."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its 64 bits as a signed integer; a null text has no words."""

    def run(batches):
        for batch in common.slices(batches):
            bits = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=FINGERPRINTS.names)

    return common.texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, FINGERPRINTS)


def _key(positions: tuple[int, ...], tag: int):
    """The bytes at these positions, and which positions they are, as one value."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return F.struct(F.lit(tag).alias("tag"), F.col("bits").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes"))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Count filter, then verification: at least five positional bytes in common, and at most three bits apart."""
    apart = x ^ y
    shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = shared >= MIN_SHARED
    out[out] = np.bitwise_count(apart[out]) <= MAX_BITS
    return out


def _spanning(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join each linked set among a list's distinct fingerprints: a tree of it, never all of its pairs."""
    rest = bits
    while len(rest) > 1:
        reached, rest = rest[:1], rest[1:]
        while len(reached) and len(rest):
            one, reached = reached[0], reached[1:]
            near = _near(np.full(len(rest), one), rest)
            if near.any():
                yield np.full(int(near.sum()), one), rest[near]
                reached, rest = np.concatenate([reached, rest[near]]), rest[~near]


def _flips(free: list[int]) -> np.ndarray:
    """What changes one to three bits of these byte positions."""
    one = [1 << (8 * p + b) for p in free for b in range(8)]
    return np.array(one + [a ^ b for a, b in combinations(one, 2)] + [a ^ b ^ c for a, b, c in combinations(one, 3)], np.uint64)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each member once a[i] and b[i] are in one set: larger roots are hooked below smaller ones, and paths
    are halved until all members point at their root."""
    x, y = root[a], root[b]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return root


def _spanning_five(bits: np.ndarray, positions: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for a list that shares five bytes: where it is long, its fingerprints look up each of the 2,324 changes."""
    if len(bits) <= LONG_LIST:
        yield from _spanning(bits)
        return
    bits = np.sort(bits)
    root = np.arange(len(bits))
    flips = _flips([p for p in range(BYTES) if p not in positions])
    for flip in flips:
        other = bits ^ flip
        at = np.minimum(np.searchsorted(bits, other), len(bits) - 1)
        hit = np.flatnonzero((bits[at] == other) & (at > np.arange(len(bits))))
        if len(hit):  # only links that join what is apart so far
            new = hit[root[hit] != root[at[hit]]]
            if len(new):
                yield bits[new], bits[at[new]]
                root = _joined(root, new, at[new])


def _by_list(frame: DataFrame, five: bool) -> DataFrame:
    """Links within the posting lists of (key, bits) rows; equal keys are neighbours in sorted partitions."""

    def run(batches):
        tags, keys, held = [], [], []

        def links(last: bool):
            nonlocal tags, keys, held
            tag, key, bits = (np.concatenate(x) for x in (tags, keys, held))
            edge = np.flatnonzero((tag[1:] != tag[:-1]) | (key[1:] != key[:-1])) + 1
            cut = len(bits) if last else (edge[-1] if len(edge) else 0)
            starts = np.concatenate([[0], edge])
            ends = np.concatenate([edge, [len(bits)]])
            keep = (ends <= cut) & (ends - starts > 1)
            out = []
            for n in range(2, 5):  # short lists together
                at = starts[keep & (ends - starts == n)]
                for i, j in combinations(range(n), 2):
                    near = _near(bits[at + i], bits[at + j])
                    out.append((bits[at + i][near], bits[at + j][near]))
            for a, b in zip(starts[keep & (ends - starts > 4)].tolist(), ends[keep & (ends - starts > 4)].tolist()):
                out.extend(_spanning_five(bits[a:b], FIVES[tag[a]]) if five else _spanning(bits[a:b]))
            tags, keys, held = [tag[cut:]], [key[cut:]], [bits[cut:]]
            x, y = (np.concatenate([o[k] for o in out]).view(np.int64) if out else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=LINKS.names)

        size = 0
        for batch in batches:
            if batch.num_rows:
                tags.append(batch.column(0).to_numpy())
                keys.append(batch.column(1).to_numpy())
                held.append(batch.column(2).to_numpy().view(np.uint64))
                size += batch.num_rows
                if size >= 200_000:
                    yield links(False)
                    size = 0
        if held:
            yield links(True)

    return frame.select("key.tag", "key.bytes", "bits").repartition("tag", "bytes").sortWithinPartitions("tag", "bytes", "bits").mapInArrow(run, LINKS)


#: Any five positions hold three of a half and two more.
FIVES = list(combinations(range(BYTES), MIN_SHARED))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join what is linked among distinct fingerprints (column bits), with no link between sets lost.

    The index is by positions of bytes, three at a time: a list of one byte would have 1/256 of all fingerprints. Who
    shares a list is tallied by the bytes of the pair's XOR that are zero (five at least) and verified by its bits.
    Each fingerprint is posted under eight triples of its bytes. Lists of one are dropped by a count that is summed up
    before its shuffle. A list too long to be compared pair by pair is split: a linked pair shares two more bytes, so its
    fingerprints are posted under the five-byte keys that contain the triple. Such a list has at most 2^24 fingerprints,
    and its work is in proportion to it.
    """
    post = distinct.select("bits", F.explode(F.array(*[_key(c, k) for k, c in enumerate(TRIPLES)])).alias("key"))
    sizes = post.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = common.settled(post.join(sizes, "key"), "simhash-postings")
    short = _by_list(many.where(F.col("n") <= LONG_LIST).select("key", "bits"), False)
    fives = []
    for k, triple in enumerate(TRIPLES):
        more = [c for c in FIVES if set(triple) <= set(c)]
        fives.append(F.when(F.col("key.tag") == k, F.array(*[_key(c, FIVES.index(c)) for c in more])))
    long = many.where(F.col("n") > LONG_LIST).select("bits", F.explode(F.coalesce(*fives)).alias("key")).distinct()
    return short.union(_by_list(long, True)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b): the least node that it reaches.

    Rounds of larger-star and smaller-star, each written to the shared folder; they end when a round changes nothing.
    """
    pairs = common.settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = common.settled(smaller, "components")
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (pairs, new))
        common.drop(pairs)
        pairs = new
        if before == after:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links) of each row.

    Exact copies share a fingerprint and take part in the search once. Null ids are kept, and name no component unless
    no other id is there; a component of null ids only has a null component_id.
    """
    marked = common.settled(fingerprints(docs), "simhash")
    distinct = common.settled(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("bits")))
    classes = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = classes.join(named, "root").select("bits", "component_id")
    return marked.join(of, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, alike: bool = False) -> DataFrame:
    """The documents, all columns as they are, without near-duplicates: of each component the row of the smallest doc_id
    stays (of repeated rows one; a null id only where the component has no other).

    alike: texts that share 0.8 of their five-word shingles are linked too, whatever their bits.
    """
    at, bits, row, more = docs.columns.index("text"), "__simhash_bits", "__simhash_row", ["__simhash_digest", "__simhash_size", "__simhash_keys"]
    schema = T.StructType([*docs.schema.fields, T.StructField(bits, T.LongType()), T.StructField(row, T.LongType())])
    if alike:
        schema = T.StructType([*schema.fields, *map(T.StructField, more, (T.LongType(), T.LongType(), T.ArrayType(T.LongType())))])

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in common.slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            columns = [pa.array(found.view(np.int64)), pa.array(np.arange(number, number + len(found)))]
            if alike:
                sets = [similar.shingles(t) for t in texts]
                columns += [pa.array(np.array([d for d, _ in sets], np.uint64).view(np.int64)), pa.array([len(h) for _, h in sets], pa.int64())]
                columns.append(pa.array([similar.keys(h) for _, h in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)
            number += len(found)

    marked = common.settled(docs.mapInArrow(run, schema), "simhash-documents")
    light = marked.select("doc_id", F.col(bits).alias("bits"), F.col(row).alias("row"), *(F.col(c).alias(c[10:]) for c in more if alike))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    distinct = common.settled(light.groupBy("bits").agg(F.min(order).alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("bits")))
    root = F.coalesce("root", "bits")
    sets = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", root.alias("root"), "first")
    if alike:
        # A node is a distinct text, by its least row; those of a set of fingerprints hang together by the least of the set.
        sets = common.settled(sets, "simhash-sets")
        texts = light.groupBy("bits", "digest").agg(F.min(F.struct("row", "size", "keys")).alias("node"), F.min(order).alias("first"))
        texts = common.settled(texts.join(sets.select("bits", F.col("root").alias("set")), "bits").select("node", "set", "first"), "simhash-texts")
        heads = texts.groupBy("set").agg(F.min("node.row").alias("root"))
        nodes = common.settled(texts.join(heads, "set").select(F.col("node.row").alias("node"), "root", "first", "node.size", "node.keys"), "simhash-nodes")
        common.drop(sets, texts)
        near = similar.links(nodes, marked.select(F.col(row).alias("node"), "text"), components)
        roots = components(near.union(nodes.where("node <> root").select("root", "node")))
        sets = nodes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay = common.settled(sets.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("stays")), "simhash-stay")
    common.drop(distinct, *([nodes] if alike else []))
    return marked.hint("merge").join(stay, F.col(row) == F.col("stays"), "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component. A null or empty text has fingerprint zero and links to others of zero; long
    texts are read whole; rows that repeat have a row each; an empty table gives none. Other columns are not read."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
