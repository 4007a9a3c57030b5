"""Phrases by the parse against counts of all texts."""

import random
import re
from collections import Counter

from loreforge.llm import phrases


def _pieces(text):
    low = (text or "").encode().lower().decode()
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def _plain(rows, top=phrases.TOP):
    f, n = {}, Counter()
    for text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for w in _pieces(text):
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                c.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if " " in p and a >= phrases.LEAST}
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(1_000_000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 50 * a for q, b in found.items()):
                continue
            scored.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _texts(seed, count):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gämma", "delta", "x", "'s", "Été", "new", "york", "city", "中文"]
    def one():
        out = []
        for _ in range(rng.randrange(0, 60)):
            out.append(rng.choice(words) if rng.random() < 0.7 else "new york city")
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", " \r\n"]))
        return "".join(out)
    return [(one(), rng.choice(["en", "de", None])) for _ in range(count)]


def _frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase int").repartition(3)


def test_against_counts_of_all_texts(spark):
    rows = _texts(1, 150)
    rows += [rows[0]] * 40 + [(None, "en"), ("", None), (" ,.;", "fr"), ("one " * 20000, "es"), ("lone", "it")]
    got = sorted(map(tuple, phrases.collocations(_frame(spark, rows)).collect()))
    assert got == _plain(rows) and len(got) > 50
    few = sorted(map(tuple, phrases.collocations(_frame(spark, rows), 5).collect()))
    assert few == _plain(rows, 5)


def test_empty_table(spark):
    assert phrases.collocations(_frame(spark, _texts(1, 2)).limit(0)).collect() == []


def test_chunks_hold_each_phrase_once():
    rng = random.Random(3)
    cut = 0
    for text, _ in _texts(2, 200):
        if rng.random() < 0.1:
            text *= 30
        found, ends = phrases.parse(text.encode().lower())
        chunks = [c.split(" ") for c in found.to_pylist()]
        cut += sum(not e for e in ends)
        for k in (1, 2, 3):
            got = Counter()
            for w, e in zip(chunks, ends, strict=True):
                own = len(w) if e else len(w) - phrases.OVERLAP
                got.update(tuple(w[i : i + k]) for i in range(own) if i + k <= len(w))
            want = Counter(tuple(w[i : i + k]) for w in _pieces(text) for i in range(len(w) - k + 1))
            assert got == want
    assert cut > 50


def test_a_long_text_is_cut_at_its_breaks_only(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 100)
    text = "some words here, and more of them. " * 50 + "y" * 500
    blocks = list(phrases._blocks(["short", text, "", "tail"]))
    assert len(blocks) > 10
    want = [w for t in ("short", text, "", "tail") for w in _pieces(t) if w]
    assert [w for b in blocks for w in _pieces(b.decode()) if w] == want


def test_scores_pass_64_bits(spark):
    frame = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a long, l long, r long")
    a, left, right = 3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007
    assert frame.select(phrases._score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)
