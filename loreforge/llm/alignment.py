"""Alignment of two tokenizers: linked token ids, how many documents hold each pair, counted in vectors under a minimal perfect hash."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import tokenizer_path

#: A pair of ids is one number: A's id, then B's in so many bits.
B_BITS = 15
#: Pairs of a shard of the hash, on average; bits for each pair of a level, and levels at most (keys beyond them are listed).
SHARD_PAIRS, SPREAD, LEVELS = 1 << 14, 2, 40
#: Pairs that are broadcast at a time (8 bytes each and a bit): more of them are looked up in further passes over the documents' pairs.
MAX_PAIRS = 8_000_000
#: Units that a worker keeps aligned, and their bytes; it then starts anew, which costs time and changes no result.
CACHE_UNITS, CACHE_BYTES = 1_200_000, 32 << 20
#: Characters of a text that are cut into units at a time.
PART = 1 << 20
#: Pairs of a task before they are summed up; groups of tasks whose vectors are summed first.
HELD_PAIRS, FAN_IN = 2_000_000, 32

#: Both tokenizers end a token before a space between two signs: a unit is what stands between two such spaces.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside white space: among units between spaces, one that is empty or has white space at its edge.
_EDGE = re.compile(r" \s|\s ")

PAIRS = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
SHARDS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("sizes", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("pairs", T.BinaryType())])
VECTORS = T.StructType([T.StructField("shard", T.LongType()), T.StructField("part", T.LongType()), T.StructField("counts", T.BinaryType())])
#: What a document's text alone gives, and what the counts of all documents give.
OWN, COUNTED = ("n_a", "n_b", "n_groups", "n_links"), ("n_best", "count_sum")
ENCODED = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in OWN] + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])
ALIGNED = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in (*OWN, *COUNTED)] + [T.StructField("groups_sha256", T.StringType())])


def byte_alphabet() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.a_spaced = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_spaced = np.array([p[:1] == "▁" for p in pieces])
        # A piece with a space behind another sign would reach over the edge of a unit.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and len(pieces) <= 1 << B_BITS

    def units(self, text: str) -> Iterator[list[str]]:
        """A text's units, some at a time."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while len(text) - at > PART and (m := _CUT.search(text, at + PART)):
            yield _CUT.split(text[at : m.start()])
            at = m.end()
        yield _CUT.split(text[at:] if at else text)

    def encode(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The units in the order in which they are encoded, ids by A and by B of a space and each unit, how many ids each has,
        and whether both give the unit's bytes back (else it has none).

        Units without a space inside are encoded many at a time; each starts with the token that has its space.
        """
        plain, odd = [], []
        for u in units:
            (plain if u and " " not in u and "▁" not in u and not u[0].isspace() and not u[-1].isspace() else odd).append(u)
        order, a, b, size_a, size_b, good = [], [], [], [], [], []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            text = " " + " ".join(some)
            ia = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ib = np.array(self.b.encode(text[1:]), np.int64)
            edges_a, edges_b = np.flatnonzero(self.a_spaced[ia]), np.flatnonzero(self.b_spaced[ib])
            if len(edges_a) != len(some) or len(edges_b) != len(some) or b"".join([self.b_bytes[i] for i in ib.tolist()]) != text.encode("utf-8", "surrogatepass"):
                odd += some
                continue
            order += some
            a.append(ia)
            b.append(ib)
            size_a.append(np.diff(edges_a, append=len(ia)))
            size_b.append(np.diff(edges_b, append=len(ib)))
            good.append(np.ones(len(some), bool))
        for u in odd:
            raw = f" {u}".encode("utf-8", "surrogatepass")
            ids = [self.a.encode(f" {u}", add_special_tokens=False).ids, self.b.encode(u)]
            whole = all(b"".join([t[i] for i in x]) == raw for t, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))
            for x, to, size in zip(ids if whole else ([], []), (a, b), (size_a, size_b), strict=True):
                to.append(np.array(x, np.int64))
                size.append([len(x)])
            good.append([whole])
            order.append(u)
        return order, *(np.concatenate(x) for x in (a, b, size_a, size_b, good))


def aligned(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B: groups end where tokens of both end. Both sides have the same bytes."""
    ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)


def links(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each group's distinct pairs: their group, pair, and how many occurrences of them are linked there."""
    ka, ma = np.unique(group_a << 20 | a, return_counts=True)
    kb, mb = np.unique(group_b << 20 | b, return_counts=True)
    na, nb = np.bincount(ka >> 20, minlength=groups), np.bincount(kb >> 20, minlength=groups)
    size = na * nb
    of = np.repeat(np.arange(groups), size)
    k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    i, j = (np.cumsum(na) - na)[of] + k // nb[of], (np.cumsum(nb) - nb)[of] + k % nb[of]
    low = (1 << 20) - 1
    return of, (ka[i] & low) << B_BITS | (kb[j] & low), ma[i] * mb[j]


class _Grown:
    """An array that grows at its end, and to 64 bits where a number needs them."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1024, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.held.dtype == np.int32 and more.max(initial=0) >> 31:
            self.held = self.held.astype(np.int64)
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held) // 4, len(more)), self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class Units:
    """What a worker knows of each unit it has met. named: whether it keeps the ids of the unit's groups as text, too."""

    _last: tuple = (None, None)

    def __init__(self, pair: Pair, named=False):
        self.pair = pair
        self.signs = [np.array([f"{k}{c}" for k in range(n)], object) for n, c in ((len(pair.a_bytes), ","), (len(pair.a_bytes), "|"), (len(pair.b_bytes), ","), (len(pair.b_bytes), ";"))] if named else None
        self.clear()

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Units:
        """The worker's, kept from task to task."""
        if cls._last[0] != paths:
            cls._last = paths, cls(Pair(*paths), named=True)
        return cls._last[1]

    @classmethod
    def leave(cls) -> None:
        """Frees the worker's, whose texts are done with."""
        cls._last = (None, None)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.numbers = {n: _Grown(np.int32) for n in OWN}
        self.good, self.begin, self.pairs, self.times = _Grown(bool), _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self.begin.add(np.zeros(1, np.int64))
        self.names: list[str] = []

    def learn(self, units: set[str]) -> None:
        new = list(units.difference(self.known))
        if not new:
            return
        new, a, b, size_a, size_b, good = self.pair.encode(new)
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.bytes += sum(map(len, new))
        group_a, group_b = aligned(self.pair, a, b)
        groups = int(group_a[-1]) + 1 if len(a) else 0
        unit_a = np.searchsorted(end_a, np.arange(len(a)), "right")
        unit_of = np.zeros(groups, np.int64)
        unit_of[group_a] = unit_a
        of, pairs, times = links(a, group_a, b, group_b, groups)
        unit = unit_of[of]
        n = len(new)
        edges = np.searchsorted(unit, np.arange(n + 1))
        self.good.add(good)
        for name, found in zip(OWN, (size_a, size_b, np.bincount(unit_of, minlength=n), _stretches(times, edges)), strict=True):
            self.numbers[name].add(found)
        self.pairs.add(pairs)
        self.times.add(times)
        self.begin.add(int(self.begin.held[self.begin.n - 1]) + edges[1:])
        if self.signs is None:
            return
        # The ids of each group as text, A's before B's; a group's last id ends with ';', which goes at the end of a unit.
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        text = np.concatenate([np.where(last_a, self.signs[1][a], self.signs[0][a]), np.where(last_b, self.signs[3][b], self.signs[2][b])])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        text, stops = text[order].tolist(), (end_a + end_b).tolist()
        self.names += ["".join(text[i:j])[:-1] for i, j in zip([0, *stops], stops)]

    def ids(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """The units of each text in its order: the text's number, its units' (some at a time for a long text), and whether
        they are the last of the text. What is known may start anew between two of them."""
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            if sum(map(len, some)) <= PART and (found := self._plain(some)) is not None:
                for k, own in enumerate(found):
                    yield at + k, own, True
            elif sum(map(len, some)) <= PART:
                cut = [next(self.pair.units(t)) for t in some]
                self._room()
                self.learn(set().union(*cut))
                for k, units in enumerate(cut):
                    yield at + k, np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)), True
            else:
                for k, t in enumerate(some):
                    waiting = None
                    for units in self.pair.units(t):
                        if waiting is not None:
                            yield at + k, waiting, False
                        self._room()
                        self.learn(set(units))
                        waiting = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
                    yield at + k, waiting, True

    def _plain(self, texts: list[str]) -> list[np.ndarray] | None:
        """The units of each text if all its spaces stand between two signs: each distinct unit is looked up once."""
        try:
            cut = pc.split_pattern(pa.array(texts, pa.string()), " ") if self.pair.cuts else None
        except UnicodeEncodeError:
            return None
        if cut is None:
            return None
        coded = cut.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if _EDGE.search(f" {' '.join(distinct)} "):
            return None
        self._room()
        self.learn(set(distinct))
        ids = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        return np.split(ids, cut.offsets.to_numpy()[1:-1])

    def linked(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a text's units, and how many occurrences of them are linked there; a pair may come again."""
        own, repeats = np.unique(own, return_counts=True)
        begin = self.begin.held[own]
        n = self.begin.held[own + 1] - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.pairs.held[at], self.times.held[at] * np.repeat(repeats, n)

    def _room(self) -> None:
        if len(self.known) > CACHE_UNITS or self.bytes > CACHE_BYTES:
            self.clear()


def _stretches(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of each stretch between two edges."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[edges])


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in held]))
    return pairs, n


def encoded(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """ENCODED of each document: what its text gives, its distinct pairs, and how many occurrences of each are linked."""

    def run(batches):
        units = Units.of(paths)
        for batch in common.slices(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = {n: np.zeros(len(texts), np.int64) for n in OWN}
            digests, pairs, times = [""] * len(texts), [b""] * len(texts), [b""] * len(texts)
            held = [k for k, t in enumerate(texts) if t]
            good, digest, linked = True, None, []
            for k, own, ended in units.ids([texts[k] for k in held]):
                k = held[k]
                good &= bool(units.good.held[own].all())
                if good:
                    for n in OWN:
                        out[n][k] += units.numbers[n].held[own].sum()
                    names = ";".join([units.names[i] for i in own.tolist()]).encode()
                    if digest is None:
                        digest = hashlib.sha256(names)
                    else:
                        digest.update(b";" + names)
                    linked.append(units.linked(own))
                if len(linked) > 1 or linked and ended:
                    linked = [_summed(linked)]
                if ended:
                    if good:
                        digests[k], pairs[k], times[k] = digest.hexdigest(), linked[0][0].tobytes(), _narrow(linked[0][1])
                    else:
                        for n in OWN:
                            out[n][k] = 0
                    good, digest, linked = True, None, []
            yield common.to_batch(ENCODED, {"doc_id": ids, **out, "groups_sha256": digests, "pairs": pairs, "times": times})

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of no more bytes than the largest needs."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of some documents, and where each document's begin, and the last's end."""
    held = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int32), *held]), np.cumsum([0, *map(len, held)])


def _times_of(column: pa.Array, edges: np.ndarray) -> np.ndarray:
    """The numbers of the documents' pairs, of as many bytes as there are for each."""
    sizes = np.diff(edges).tolist()
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"u{len(x) // n}") for x, n in zip(column.to_pylist(), sizes, strict=True) if n)], dtype=np.int64, casting="unsafe")


def linked_pairs(documents: DataFrame) -> DataFrame:
    """pair and n: of each task's linked pairs, how many of its documents (rows of ENCODED) hold them."""

    def run(batches):
        Units.leave()
        held, size = [], 0
        for batch in common.slices(batches):
            pairs, n = np.unique(_pairs_of(batch.column(0))[0], return_counts=True)
            held.append((pairs.astype(np.int64), n))
            size += len(pairs)
            if size > HELD_PAIRS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=PAIRS.names)
                    held, size = [], 0
        pairs, n = _summed(held)
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (pairs, n)], names=PAIRS.names)

    return documents.select("pairs").mapInArrow(run, PAIRS)


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Which shard a pair is in, for Spark and for arrays: pairs have 31 bits, so no product passes 63.
_SPREADER = 2654435761


def _shard(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs * _SPREADER) & 0xFFFFFFFF) >> (32 - bits)


def minimal_hash(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct pairs: levels of bits, in each of which a pair alone at its place sets the bit there.

    Returns the levels' sizes in words of 64 bits, all words, and the pairs in order of their hash: that of a pair is the number
    of bits set before its own. What the last level leaves has no bit and is listed behind.
    """
    left, sizes, words, order = pairs, [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-SPREAD * len(left) // 64)
        at = (_mixed(left, level) % np.uint64(size * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=size * 64) == 1
        placed = alone[at]
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        order.append(left[placed][np.argsort(at[placed])])
        sizes.append(size)
        left = left[~placed]
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return np.array(sizes, np.int32), join(words, np.uint64), join([*order, np.sort(left)], np.int64)


class Hash:
    """Shards of a minimal perfect hash. A pair's index is its place in `pairs`, where it is verified."""

    def __init__(self, shards: list[dict], bits: int):
        """shards: rows of SHARDS, any of the 2^bits there are."""
        self.bits = bits
        levels = max((len(s["sizes"]) // 4 for s in shards), default=0)
        self.size, self.offset = np.zeros((1 << bits, levels), np.int64), np.zeros((1 << bits, levels), np.int64)
        words, pairs, at = [], [], 0
        self.first = np.zeros((1 << bits) + 1, np.int64)
        n = np.zeros(1 << bits, np.int64)
        for s in sorted(shards, key=lambda s: s["shard"]):
            sizes = np.frombuffer(s["sizes"], np.int32)
            self.size[s["shard"], : len(sizes)] = sizes
            self.offset[s["shard"], : len(sizes)] = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            words.append(np.frombuffer(s["bits"], np.uint64))
            pairs.append(np.frombuffer(s["pairs"], np.int32))
            n[s["shard"]] = len(pairs[-1])
        self.first[1:] = np.cumsum(n)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int32)
        ones = np.bitwise_count(self.words).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])
        # Bits set before a word, counted from where its shard starts, and from the shard's first pair.
        start = self.offset[:, 0] if levels else np.zeros(1 << bits, np.int64)
        shard_of = np.repeat(np.flatnonzero(n), [int(self.size[s].sum()) for s in np.flatnonzero(n)]) if len(words) else np.zeros(0, np.int64)
        self.rank = before[:-1] - before[start[shard_of]] + self.first[shard_of]
        self.listed = {s: int(before[start[s] + self.size[s].sum()] - before[start[s]] + self.first[s]) for s in np.flatnonzero(n)}

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """The index of each pair, -1 for those that are not in these shards."""
        out = np.full(len(pairs), -1, np.int64)
        shard = _shard(pairs, self.bits)
        todo = np.arange(len(pairs))
        for level in range(self.size.shape[1]):
            size = self.size[shard[todo], level]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            place = (_mixed(pairs[todo], level) % (size * 64).astype(np.uint64)).astype(np.int64)
            word = self.offset[shard[todo], level] + (place >> 6)
            bit = (place & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            rank = self.rank[word] + np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        for k in todo:  # beyond the last level
            s = int(shard[k])
            stretch = self.pairs[self.listed.get(s, 0) : self.first[s + 1] if s in self.listed else 0]
            j = int(np.searchsorted(stretch, pairs[k]))
            if j < len(stretch) and stretch[j] == pairs[k]:
                out[k] = self.listed[s] + j
        known = out >= 0
        out[known] = np.where(self.pairs[out[known]] == pairs[known], out[known], -1)
        return out


class Counts:
    """A hash, the vector of its pairs' counts, and the highest count of each A id."""

    _last: tuple = (None, None)

    @classmethod
    def of(cls, name: str, parts: Callable[[], tuple]) -> Counts:
        """The worker's, kept from task to task of one pass."""
        if cls._last[0] != name:
            cls._last = (None, None)
            cls._last = name, cls(*parts())
        return cls._last[1]

    def __init__(self, shards: list[dict], counts: dict[int, bytes], bits: int, highest: np.ndarray):
        self.hash, self.highest = Hash(shards, bits), highest
        self.counts = np.concatenate([np.frombuffer(counts[s["shard"]], np.int64) for s in sorted(shards, key=lambda s: s["shard"])] or [np.zeros(0, np.int64)])
        if not len(self.counts) or self.counts.max() < 1 << 31:
            self.counts = self.counts.astype(np.int32)

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's count (0 where it is in none of these shards), and whether its A id has no higher one."""
        at = self.hash.index(pairs)
        count = np.where(at >= 0, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0).astype(np.int64)
        return count, (at >= 0) & (count == self.highest[pairs >> B_BITS])


def _shards(pairs: DataFrame, bits: int) -> DataFrame:
    """The hash of each shard, made in the task that has its pairs."""

    def run(batches):
        held, now = [], None

        def made():
            sizes, words, order = minimal_hash(np.concatenate(held))
            return common.to_batch(SHARDS, {"shard": [now], "sizes": [sizes.tobytes()], "bits": [words.tobytes()], "pairs": [order.astype(np.int32).tobytes()]})

        for batch in batches:
            shards, found = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    if now is not None and shards[i] != now:
                        yield made()
                        held = []
                    now = int(shards[i])
                    held.append(found[i:j])
        if held:
            yield made()

    return pairs.select(_shard_column(bits).alias("shard"), "pair").repartition("shard").sortWithinPartitions("shard", "pair").mapInArrow(run, SHARDS)


def _shard_column(bits: int):
    return F.shiftrightunsigned((F.col("pair") * _SPREADER).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int64).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)


def _vectors(seen: DataFrame, shards: DataFrame, bits: int, blocks: list[list[int]]) -> DataFrame:
    """shard and counts: each shard's dense vector, summed up over the tasks in two steps.

    A task looks up its pairs in a block of shards at a time and adds their counts to vectors, one for each shard that it meets.
    """
    out = None
    for block in blocks:
        rows = shards.where(F.col("shard").isin(block)).toArrow().to_pylist() if len(blocks) > 1 else shards.toArrow().to_pylist()
        at = seen.sparkSession.sparkContext.broadcast((rows, bits))

        def run(batches, at=at):
            table = Hash(*at.value)
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                pairs, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                index = table.index(pairs)
                pairs, n, index = pairs[index >= 0], n[index >= 0], index[index >= 0]
                shard = _shard(pairs, bits)
                for s in np.unique(shard).tolist():
                    own = shard == s
                    if s not in sums:
                        sums[s] = np.zeros(table.first[s + 1] - table.first[s], np.int64)
                    np.add.at(sums[s], index[own] - table.first[s], n[own])
            part = TaskContext.get().partitionId() % FAN_IN
            for s, v in sums.items():
                yield common.to_batch(VECTORS, {"shard": [s], "part": [part], "counts": [len(v).to_bytes(8, "little") + _packed(v)]})

        vectors = seen.mapInArrow(run, VECTORS)
        out = vectors if out is None else out.union(vectors)
    return _tree_sum(_tree_sum(out, "shard", "part").withColumn("part", F.lit(0).cast("long")), "shard")


def _tree_sum(vectors: DataFrame, *keys: str) -> DataFrame:
    """Vectors of equal keys added up; a task has one sum in hand."""

    def run(batches):
        now, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                n = int.from_bytes(row["counts"][:8], "little")
                v = _unpacked(row["counts"][8:], n)
                if now == (row["shard"], row["part"]):
                    total = total + v
                    continue
                if now is not None:
                    yield common.to_batch(VECTORS, {"shard": [now[0]], "part": [now[1]], "counts": [len(total).to_bytes(8, "little") + _packed(total)]})
                now, total = (row["shard"], row["part"]), v
        if now is not None:
            yield common.to_batch(VECTORS, {"shard": [now[0]], "part": [now[1]], "counts": [len(total).to_bytes(8, "little") + _packed(total)]})

    return vectors.repartition(*keys).sortWithinPartitions("shard", "part").mapInArrow(run, VECTORS)


_HIGHEST = T.StructType([T.StructField("a", T.LongType()), T.StructField("n", T.LongType())])


def _highest(shards: DataFrame, vectors: DataFrame) -> np.ndarray:
    """The highest count of each A id: 2^16 numbers."""

    def run(batches):
        most = np.zeros(1 << 16, np.int64)
        for batch in common.slices(batches, 16):
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["pairs"], np.int32)
                np.maximum.at(most, pairs >> B_BITS, _unpacked(row["counts"][8:], len(pairs)))
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at])], names=_HIGHEST.names)

    found = shards.select("shard", "pairs").join(vectors.select("shard", "counts"), "shard").mapInArrow(run, _HIGHEST).groupBy("a").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


class PairCounts:
    """The corpus's linked pairs and how many documents hold each: shards of the hash and their vectors, as tables.

    documents: rows of ENCODED and a number of each. pairs: how many there are. bits: of the shard numbers. blocks: shards that
    are looked up together.
    """

    def __init__(self, docs: DataFrame, paths: tuple[str, str], max_pairs: int = MAX_PAIRS):
        self.documents = common.settled(encoded(docs, paths).withColumn("row", F.monotonically_increasing_id()), "alignment-documents")
        seen = common.settled(linked_pairs(self.documents), "alignment-seen")
        distinct = common.settled(seen.select("pair").distinct(), "alignment-pairs")
        self.pairs = distinct.count()
        self.bits = max(1, (self.pairs // SHARD_PAIRS).bit_length())
        self.shards = common.settled(_shards(distinct, self.bits), "alignment-shards")
        n = max(1, -(-self.pairs // max_pairs))
        width = -(-(1 << self.bits) // n)
        self.blocks = [list(range(k, min(k + width, 1 << self.bits))) for k in range(0, 1 << self.bits, width)]
        self.vectors = common.settled(_vectors(seen, self.shards, self.bits, self.blocks), "alignment-counts")
        common.drop(seen, distinct)
        self.highest = _highest(self.shards, self.vectors)

    def block(self, shards: list[int]) -> tuple:
        """What `Counts` needs of some shards; its size is bounded by the pairs of a block."""
        rows = self.shards.where(F.col("shard").between(shards[0], shards[-1])).join(self.vectors.select("shard", "counts"), "shard").toArrow().to_pylist()
        counts = {r["shard"]: r.pop("counts") for r in rows}
        return rows, {s: _unpacked(c[8:], int.from_bytes(c[:8], "little")).tobytes() for s, c in counts.items()}, self.bits, self.highest


def _looked_up(documents: DataFrame, at, name: str) -> DataFrame:
    """ALIGNED of each document and its row's number, with the counts of one block of shards."""
    schema = T.StructType([*ALIGNED.fields, T.StructField("row", T.LongType())])
    same = [c for c in schema.names if c not in COUNTED]

    def run(batches):
        Units.leave()
        counts = Counts.of(name, lambda: at.value)
        for batch in common.slices(batches):
            pairs, edges = _pairs_of(batch.column("pairs"))
            times = _times_of(batch.column("times"), edges)
            count, best = counts.look_up(pairs.astype(np.int64))
            yield common.to_batch(schema, {c: batch.column(c) for c in same} | {"n_best": _stretches(times * best, edges), "count_sum": _stretches(times * count, edges)})

    return documents.select(*same, "pairs", "times").mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """How the ids of two tokenizers are linked in each document, and how usual these links are in all of them.

    Each text is aligned once; what it gives is kept as a table, with the document's distinct linked pairs. From these the tasks
    gather their pairs and how many of their documents hold them. A minimal perfect hash of the distinct pairs, made by shards,
    gives each a place in a dense vector; the tasks' vectors are added up in a tree. A pass over the table looks the documents'
    pairs up; where the hash has more than `max_pairs` pairs there is one for each block of shards, and their sums are added.
    """
    counts = PairCounts(docs, (a_path, b_path), max_pairs)
    context = docs.sparkSession.sparkContext
    passes = [_looked_up(counts.documents, context.broadcast(counts.block(b)), f"{counts.shards.settled_at} {k}") for k, b in enumerate(counts.blocks)]
    if len(passes) == 1:
        return passes[0].select(*ALIGNED.names)
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    return every.groupBy("row").agg(*((F.sum if c in COUNTED else F.first)(c).alias(c) for c in ALIGNED.names)).select(*ALIGNED.names)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's links between the byte-level and the piece vocabulary.

    Null and empty texts, and those that a tokenizer does not give back, have zeros and an empty digest; long texts are aligned
    whole; rows that repeat count each and have a row each; an empty table gives no rows. Other columns are not read.
    """
    return align(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
