import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreforge.llm import common, packing, simple8b
from loreforge.llm.tokens import WordTokens, tokenizer_path

ODD = ["", " ", "  a  b\n\n c", "a\tb 's it's  x", "x　 y\x1c z <|endoftext|> q", "é ́a", "don't  STOP", "日本 語 12 345", "it's foo.\nBar, don't.\n'Tis x_y a² b.\n", "x.\ny z\nQ* A--b (c) d's\n\nE"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, np.uint64)
    data = simple8b.block_bytes(ids, np.array([len(ids)]))
    assert (simple8b.block_ids(data)[0] == ids).all()
    lo, hi = len(ids) // 3, 2 * len(ids) // 3
    assert (simple8b.slice_ids(data, lo, hi) == ids[lo:hi]).all()


def test_index_finds_runs():
    ids = np.random.default_rng(0).integers(0, 70000, 100_000).astype(np.uint64)
    data = simple8b.block_bytes(ids, np.array([len(ids)]))
    assert (simple8b.slice_ids(data, 77_777, 90_001) == ids[77_777:90_001]).all()


@pytest.mark.parametrize("name, glued", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_cache_gives_the_tokenizer_s_ids(spark, sf, name, glued):
    texts = [r[0] for r in common.table(spark, sf, "documents").select("text").limit(150).collect()] + ODD
    encoder = WordTokens(tokenizer_path(name), glued)
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts) == want  # from the cache


def _expected(texts, name):
    encoder = WordTokens(tokenizer_path(name), True).tokenizer
    return [np.array([*e.ids, 2], "<u4") for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark):
    texts = [*ODD, None, "long " * 60_000, "same", "same"]
    rows = [(i * 3 - 5, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(3)
    path = common.shared_path(spark, "test-s8b")
    simple8b.write_blocks(docs, path, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(simple8b.read_blocks(spark, path).collect())
    before = 0
    for (doc_id, *_), ids, row in zip(rows, _expected(texts, "byte_bpe_50k.json"), got, strict=True):
        assert tuple(row) == (doc_id, before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_token_files_of_empty_and_null_id_tables(spark):
    path = common.shared_path(spark, "test-s8b")
    simple8b.write_blocks(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path("byte_bpe_50k.json"))
    assert simple8b.read_blocks(spark, path).count() == 0
    block = simple8b.block_bytes(np.arange(5, dtype=np.uint64), np.array([2, 3]), [None, -7])
    _, lengths, numbers, known, *_ = simple8b.open_block(block)
    assert (lengths.tolist(), numbers.tolist(), known.tolist()) == ([2, 3], [0, -7], [0, 1])
    path = common.shared_path(spark, "test-s8b")
    simple8b.write_blocks(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), path, tokenizer_path("byte_bpe_50k.json"))
    assert sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in simple8b.read_blocks(spark, path).collect()) == [(False, 0, 0, 2), (True, 1, 2, 2), (True, 1, 4, 2)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_balance_fills_every_sequence(lengths):
    pieces = packing.balance(lengths)
    of, sequences = {}, {}
    for doc, at, n, to, offset in pieces:
        of.setdefault(doc, []).append((at, n))
        sequences.setdefault(to, []).append((offset, n))
    for doc, size in enumerate(lengths):
        at = 0
        for start, n in sorted(of[doc]):
            assert start == at and n > 0
            at += n
        assert at == size
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == packing.CAPACITY or at < packing.CAPACITY and at & (at - 1) == 0


def _assigned(lengths, capacity):
    """The rule in plain words: longest piece first, to the cheapest sequence that it fits, else cut to the cheapest with room."""
    sizes = packing.sequence_sizes(sum(lengths), capacity)
    spent, used, line, out = [0.0] * len(sizes), [0] * len(sizes), [], []
    for doc, n in enumerate(lengths):
        line += [(min(capacity, n - at), doc, at) for at in range(0, n, capacity)]
    while line:
        line.sort(key=lambda p: (-p[0], p[1], p[2]))
        size, doc, at = line.pop(0)
        free = [k for k in range(len(sizes)) if sizes[k] - used[k] >= size] or [k for k in range(len(sizes)) if sizes[k] > used[k]]
        to = min(free, key=lambda k: (spent[k], k))
        put = min(size, sizes[to] - used[to])
        out.append((doc, at, put, to, used[to]))
        used[to] += put
        spent[to] += put + put * put / 1024
        if put < size:
            line.append((size - put, doc, at + put))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), min_size=1, max_size=40), st.sampled_from([16, 64]))
def test_balance_follows_the_costs(lengths, capacity):
    assert sorted(packing.balance(lengths, capacity)) == _assigned(lengths, capacity)


def test_costs_are_linear_and_quadratic():
    assert packing.cost(0) == 0 and packing.cost(1024) == 2048 and packing.cost(4096) == 4096 + 16384


def test_pack(spark):
    texts = [*ODD, None, "word " * 9_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id int").repartition(3)
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), group_ids=5_000).collect()
    plain = WordTokens(tokenizer_path("word_bpe_49k.json"), False).tokenizer
    for i, e in enumerate(plain.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids, at = np.array([*e.ids, 2], "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
