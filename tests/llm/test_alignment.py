"""Two tokenizers aligned: units against whole texts, the hash against its keys, the query against plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreforge.llm import alignment as al
from loreforge.llm.tokens import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["<|endoftext|>", "  ", "\n", " \n", "\t", "é", "é", "中文", "▁", "'s", "123", " ", "　", "<s>", "<0x41>", "İ", "\x00", "\r\n", "😀", "a" * 50, "-" * 30, " ", " ", "\x1f"]


@pytest.fixture(scope="module")
def pair():
    return al.Pair(*PATHS)


def _groups(pair, text):
    """Ids of the whole text by both tokenizers, cut where tokens of both end; None for a text that is not given back."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    ends, joined = [], []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        parts = [table[i] for i in ids]
        joined.append(b"".join(parts))
        ends.append(np.cumsum([len(p) for p in parts]).tolist())
    if any(j != (" " + text).encode() for j in joined):
        return None
    out, start = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(ids, es) if start < e <= end] for ids, es in zip((a, b), ends)))
        start = end
    return out


def _plain(pair, rows):
    found = [(doc_id, _groups(pair, text)) for doc_id, text in rows]
    count = Counter(p for _, g in found if g for p in {(a, b) for x, y in g for a in x for b in y})
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for doc_id, g in found:
        if not g:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) if rng.random() < 0.4 else rng.choice(["word", "straße", "Bar,", "x", "tokenization", "e.g."]) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_query_against_plain_counting(spark, pair, monkeypatch):
    texts = _texts(1, 120)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " "), (None, texts[3]), (7, texts[7]), (7, texts[7]), (503, "the same words again " * 3000), (504, "x" * 5000)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_a int").repartition(4)
    names = [c for c in al.ALIGNED.names if c != "text_sha256"]
    want = _plain(pair, rows)
    got = al.align(frame, *PATHS)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == want
    # More pairs than may be broadcast: blocks of shards, a pass for each.
    monkeypatch.setattr(al, "SHARD_PAIRS", 16)
    got = al.align(frame, *PATHS, max_pairs=30)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert al.PairCounts(frame, PATHS, 30).blocks[1:]


def test_empty_table_and_table_without_tokens(spark):
    frame = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in al.align(frame, *PATHS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert al.align(frame.limit(0), *PATHS).collect() == []


def test_units_give_what_whole_texts_give(pair):
    assert pair.cuts

    class Ones:
        def look_up(self, pairs):
            return np.ones(len(pairs), np.int64), np.ones(len(pairs), bool)

    texts = [t for t in _texts(2, 1500) if t]
    units = al.Units(pair, Ones())
    for k, ids, ended in units.ids(texts):
        want = _groups(pair, texts[k])
        assert ended and bool(units.good.held[ids].all()) == (want is not None)
        if want:
            assert ";".join(units.names[i] for i in ids) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
            assert units.numbers["n_links"].held[ids].sum() == sum(len(x) * len(y) for x, y in want)


def test_long_texts_are_cut_into_parts(pair, monkeypatch):
    text = "some words, and more of them\n" * 200
    whole = next(pair.units(text))
    monkeypatch.setattr(al, "PART", 500)
    parts = list(pair.units(text))
    assert len(parts) > 5 and [u for p in parts for u in p] == whole


def _shards_of(keys, bits):
    rows = []
    for s in range(1 << bits):
        sizes, words, order = al.minimal_hash(keys[al._shard(keys, bits) == s])
        rows.append({"shard": s, "sizes": sizes.tobytes(), "bits": words.tobytes(), "pairs": order.astype(np.int32).tobytes()})
    return rows


@pytest.mark.parametrize("levels", [40, 2])  # with two, many keys are listed behind the levels
def test_hash_is_minimal_and_verified(monkeypatch, levels):
    monkeypatch.setattr(al, "LEVELS", levels)
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 31, 20_000))
    rows = _shards_of(keys, 3)
    table = al.Hash(rows, 3)
    assert (np.sort(table.index(keys)) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 31, 5000), keys)
    assert (table.index(others) == -1).all()
    some = al.Hash(rows[2:5], 3)
    own = np.isin(al._shard(keys, 3), [2, 3, 4])
    assert (np.sort(some.index(keys[own])) == np.arange(own.sum())).all() and (some.index(keys[~own]) == -1).all()
    assert (al.Hash([], 3).index(keys) == -1).all()


def test_shards_are_the_same_in_spark(spark):
    keys = np.random.default_rng(6).integers(0, 1 << 31, 1000)
    got = spark.createDataFrame([(int(k),) for k in keys], "pair long").select("pair", al._shard_column(7).alias("s")).collect()
    assert all(r.s == al._shard(np.array([r.pair]), 7)[0] for r in got)


def test_a_worker_keeps_the_units_of_some_tasks():
    class Plain:
        a_size = b_size = np.ones(1, np.int64)
        met = 0

        def encode(self, units):
            self.met += len(units)
            one = np.ones(len(units), np.int64)
            return list(units), one * 0, one * 0, one, one, one == 1

    units = al.Units(Plain())
    for _ in range(2):
        for at in range(0, 1_100_000, 50_000):
            units._room()
            units.learn({f"u{k}" for k in range(at, at + 50_000)})
    assert units.pair.met == 1_100_000


def test_plain_texts_have_the_units_of_the_pattern(pair):
    rng = random.Random(5)
    units = al.Units(pair)
    for _ in range(200):
        texts = ["".join(rng.choice([" ", "a", "bc", "é", "\n", *([" "] * (rng.random() < 0.3)), "　", "\x1f"][: rng.choice([4, 5, 8])]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 3))]
        found = units._plain(texts)
        names = {i: u for u, i in units.known.items()}
        if found is not None:
            assert [[names[i] for i in own.tolist()] for own in found] == [next(pair.units(t)) for t in texts]
    assert units._plain(["one two", "two three"]) is not None and units._plain(["one  two"]) is None and units._plain(["a\ud800"]) is None


def test_texts_are_read_once_whatever_the_blocks(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def met(text):
        read.add(1)
        return text

    frame = spark.createDataFrame(list(enumerate(_texts(7, 40))), "doc_id long, text string").select("doc_id", met("text").alias("text"))
    monkeypatch.setattr(al, "SHARD_PAIRS", 16)
    for max_pairs, blocks in ((al.MAX_PAIRS, 1), (30, 2)):
        before = read.value
        counts = al.PairCounts(frame, PATHS, max_pairs)
        assert len(counts.blocks) >= blocks and read.value - before == 40
        before = read.value
        assert len(al.align(frame, *PATHS, max_pairs=max_pairs).collect()) == 40
        assert read.value - before == 40


def test_texts_of_several_parts_give_what_each_part_gives(spark, pair):
    short, times = "some words, straße\nand Bar, tokenization e.g. " + "-" * 30 + " x", 30_000
    long = " ".join([short] * times)
    assert len(long) > 2 * al.PART
    rows = [(1, short), (4, "straße Bar,")]
    got = {r[0]: tuple(r) for r in al.align(spark.createDataFrame([(1, long), (2, f"{long} ▁"), (3, f"▁ {long}"), rows[1]], "doc_id long, text string").repartition(1), *PATHS).collect()}
    want = {r[0]: r for r in _plain(pair, rows)}
    groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in _groups(pair, short))
    assert got[4] == want[4] and got[2][1:] == got[3][1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[1] == (1, *(n * times for n in want[1][1:7]), hashlib.sha256(";".join([groups] * times).encode()).hexdigest())


def test_numbers_keep_their_values_in_few_bytes():
    for numbers in ([], [1, 255], [256, 3], [70_000], [1 << 40, 2]):
        grown = al._Grown(np.int32)
        grown.add(np.ones(3, np.int64))
        grown.add(np.array(numbers, np.int64))
        assert grown.held[: grown.n].tolist() == [1, 1, 1, *numbers]
        x = np.array(numbers, np.int64)
        column = al.pa.array([b"", al._narrow(x), al._narrow(x[:1])])
        edges = np.cumsum([0, 0, len(x), len(x[:1])])
        assert al._times_of(column, edges).tolist() == numbers + numbers[:1]
    assert len(al._narrow(np.array([1, 255]))) == 2
