"""Searches of the written index against scans."""

import random
import tempfile

import pytest

from loreforge.operators import index, search


def _docs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        words = [rng.choice(["the", "the", "of", "that", "Other", "word"]) for _ in range(rng.randint(0, 6))]
        words += ["that"] * (9 if 300 <= k < 310 else 0) + ["rare"] * (k in (5, 305, 880)) + ["of"] * (k == 305)
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows + [(None, "that of"), (900, None), (901, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def made(spark):
    docs = _docs(spark)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    index.write_index(docs, "doc_id", "text", path, 32)
    return docs, index.Index(spark, path)


@pytest.mark.parametrize("words, k", [(["that"], 10), (["that", "of"], 5), (["THAT", "the", "of"], 25), (["rare"], 10), (["rare", "that"], 1), (["none"], 5), (["that", "none"], 5), (["that", "of"], 5000)])
def test_index_gives_what_a_scan_gives(made, words, k):
    docs, idx = made
    want = [(r.doc_id, r.score) for r in search.keyword_top(docs.where("doc_id is not null"), "doc_id", "text", words, k).collect()]
    assert [(r.key, r.score) for r in idx.top(words, k).collect()] == want
    assert idx.blocks_read <= idx.blocks_there


def test_blocks_that_cannot_enter_are_not_read(made):
    _, idx = made
    assert len(idx.top(["that"], 10).collect()) == 10
    assert idx.blocks_there == 29 and idx.blocks_read <= 3


def test_blocks_are_bounded(made):
    assert made[1].rows.where("n > 32").isEmpty()
