import math
import re
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from loreforge.llm import common, language, quality, suffix_tree, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, label int"
ROWS = [(1, None, None, "s", None, 0.1, "x", 1), (2, "", "en", "s", 0, 0.1, "x", 1), (None, "some text", "en", None, 9, None, None, None), (3, "word " * 200_000, "de", "s", 1_000_000, 0.1, "x", 1), (3, "word " * 3, "de", "s", 15, 0.1, "x", 1), (4, "12 .. 34", "fr", "s", -5, 0.1, "x", 1)]


@pytest.fixture(scope="module")
def tables(spark, sf):
    return common.table(spark, sf, "documents"), common.table(spark, sf, "labels")


def _held(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    return [(truth[r.doc_id], r) for r in rows if r.held_out and r.doc_id in truth]


@pytest.mark.parametrize("op, column, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.92)])
def test_held_out_accuracy(tables, op, column, least):
    docs, labels = tables
    rows = op.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= op.THRESHOLD)
    held = _held(rows, labels, column)
    assert np.mean([y == r.predicted for y, r in held]) >= least


@pytest.mark.parametrize("op, column", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_tables(spark, tables, op, column):
    docs, labels = spark.createDataFrame(ROWS, ODD), tables[1]
    assert op.classify(docs, labels).count() == len(ROWS)
    assert op.classify(docs, labels.limit(0)).count() == len(ROWS)
    assert op.classify(docs.limit(0), labels).count() == 0
    keep = quality.keep_good if op is quality else toxicity.keep_clean
    assert keep(docs, labels).columns == docs.columns


def test_labels_lang_source_and_ids_are_no_inputs(tables):
    docs, labels = tables
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'other' as source", "n_chars")
    for op in (quality, toxicity):
        a = {r.doc_id: r.score for r in op.classify(docs, labels).collect()}
        assert a == {r.doc_id: r.score for r in op.classify(other, labels).collect()}


def test_obfuscated_words_are_restored(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    for text, word in (("such an 1d10t here", "idiot"), ("a st*pid thing", "stupid"), ("you s t u p i d thing", "stupid"), ("what a l-o-s-e-r this is", "loser"), ("so stuuuuupid of them", "stupid"), ("m0r0n", "moron"), ("tr@sh.", "trash"), ("$tupid", "stupid"), ("p a t h e t i c", "pathetic"), ("S.C.U.M", "scum")):
        assert word in toxicity.restore(text, model.chars), text
        assert model.score(f"the and of that {text} for the") >= model.score(f"the and of that {word} for the") > model.score("the and of that for the"), text
    for text in ("a plain line of words, nothing else", "call 555-6835 or mail a.b@example.com on 61.131.143.218", "good*** stuff### here!!"):
        assert model.score(text) < toxicity.THRESHOLD, text


def _cheapest(token, model):
    """All readings of a lattice, one by one."""
    best = None
    for ways in product(*toxicity.lattice(token)):
        a, b, total = toxicity.GAP, toxicity.GAP, 0.0
        for reading, extra in ways:
            total += extra
            for c in reading:
                k = toxicity._SYMBOL.get(c, toxicity.OTHER if c.isalpha() else toxicity.GAP)
                total += model.cost[a][b][k]
                a, b = b, k
        total += model.cost[a][b][toxicity.GAP]
        best = min(best or (math.inf, ""), (total, "".join(r for r, _ in ways)))
    return best


def test_viterbi_finds_the_cheapest_of_all_readings():
    rng = np.random.default_rng(7)
    model = toxicity.CharModel(rng.integers(0, 9, toxicity.SIZE**3))
    for token in ("st*pid", "1d10t", "l-o-s-e-r", "aab11*s", "so", "$$cc--um", "b00o0k", "ééa@", "x", "--"):
        reading = toxicity.decode(token, model)
        total, _ = _cheapest(token, model)
        costs = {"".join(r for r, _ in ways): None for ways in product(*toxicity.lattice(token))}
        assert reading in costs
        # the reading's own cheapest way costs what the cheapest of all does
        own = min(
            sum(extra for _, extra in ways) + _spent("".join(r for r, _ in ways), model)
            for ways in product(*toxicity.lattice(token))
            if "".join(r for r, _ in ways) == reading
        )
        assert math.isclose(own, total, rel_tol=1e-9), token


def _spent(text, model):
    a, b, total = toxicity.GAP, toxicity.GAP, 0.0
    for c in text:
        k = toxicity._SYMBOL.get(c, toxicity.OTHER if c.isalpha() else toxicity.GAP)
        total += model.cost[a][b][k]
        a, b = b, k
    return total + model.cost[a][b][toxicity.GAP]


@pytest.mark.parametrize("sign", list("-*_.~=#|+!/ ") + ["- ", " -", "a ", "a- ", "* *"])
def test_rules_of_signs_and_long_tokens_take_little_time(sign):
    model = toxicity.CharModel(np.ones(toxicity.SIZE**3, int))
    began = time.perf_counter()
    for text in (f"see {sign * 10_000}Original Message", f"{sign * 10_000}END", sign * 10_000 + "(name)"):
        toxicity.restore(text, model)
    assert time.perf_counter() - began < 3
    assert len(toxicity.restore("x" * 200_000 + "ab" * 100_000, model)) == 2


def test_doubled_letters_and_short_spelt_words_are_decoded(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    for text, word in (("so stuupid", "stupid"), ("an iddiot", "idiot"), ("you s c u m", "scum")):
        assert word in toxicity.restore(text, model.chars), text


def test_pairs_of_the_factorisation_machine_one_by_one():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine(50, 4)
    model.factors = rng.normal(0, 1, (50, 4)).astype(np.float32)
    model.linear, model.bias = rng.normal(0, 1, 50).astype(np.float32), 0.3
    rows = [(rng.choice(50, n, replace=False), rng.normal(0, 1, n).astype(np.float32)) for n in (1, 7, 20)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])[:-1]])
    got = model.raw(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts)
    for (slots, values), score in zip(rows, got, strict=True):
        want = model.bias + sum(model.linear[i] * x for i, x in zip(slots, values))
        want += sum(model.factors[slots[i]] @ model.factors[slots[j]] * values[i] * values[j] for i in range(len(slots)) for j in range(i))
        assert math.isclose(score, want, rel_tol=1e-4, abs_tol=1e-4)


def test_sizes_that_are_no_numbers(spark, tables):
    docs = tables[0].selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'many' end as n_chars").limit(20)
    assert quality.classify(docs, tables[1]).count() == quality.classify(docs, tables[1].limit(0)).count() == 20
    assert quality.keep_good(docs, tables[1]).columns == docs.columns and quality.keep_good(docs, tables[1]).count() <= 20


def test_hierarchy_against_a_plain_vote():
    rng = np.random.default_rng(5)
    centres = {"es": 0, "fr": 1, "it": 2, "de": 8, "nl": 9, "xx": 20}
    langs = np.array([k for k in centres for _ in range(40)], object)
    x = np.zeros((len(langs), 32), np.float32)
    x[np.arange(len(langs)), [centres[k] for k in langs]] = 1
    x += np.abs(rng.normal(0, 0.35, x.shape)).astype(np.float32)
    model = language.Hierarchy(x, langs)

    def vote(machines, row):
        wins, least = dict.fromkeys(machines.classes, 0), dict.fromkeys(machines.classes, math.inf)
        for k, (i, j) in enumerate(machines.pairs):
            margin = float(row @ machines.weights[k] + machines.bias[k])
            a, b = machines.classes[i], machines.classes[j]
            wins[a if margin > 0 else b] += 1
            least[a], least[b] = min(least[a], margin), min(least[b], -margin)
        return max(machines.classes, key=lambda c: wins[c] + 0.5 * math.tanh(least[c]))

    got, _ = model.predict(x)
    for row, lang in zip(x, got, strict=True):
        assert lang == vote(model.within[vote(model.families, row)], row)
    assert (got == langs).mean() > 0.9 and len(model.within["romance"].pairs) == 3 and model.within["xx"].pairs == []


def test_a_column_of_too_many_languages_is_refused(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'some words' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="more than 200"):
        language.identify(docs)


def test_language(spark, tables):
    docs, _ = tables
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert np.mean([truth[i] == r.lang_pred for i, r in rows.items() if r.held_out]) > 0.97
    odd = language.identify(spark.createDataFrame(ROWS, ODD)).collect()
    assert len(odd) == len(ROWS) and sorted(str(r.doc_id) for r in odd if r.lang_pred == "und") == ["1", "2", "4"]
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


@pytest.mark.parametrize("share", [1e-7, 3e-5])  # with and without words that are joined
def test_suffix_tree(tables, monkeypatch, share):
    monkeypatch.setattr(suffix_tree, "FREQUENT_SHARE", share)
    docs, _ = tables
    rows = {r.doc_id: r for r in suffix_tree.score_documents(docs).collect()}
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) + ["\n"] for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    for fold in (True, False):
        assert sum(r.score for i, r in rows.items() if held[i] == fold) > sum(r.base_score for i, r in rows.items() if held[i] == fold)


@pytest.mark.parametrize("share", [1e-7, 3e-5])
def test_suffix_tree_of_more_pairs_than_are_broadcast_loses_none(spark, tables, monkeypatch, share):
    monkeypatch.setattr(suffix_tree, "FREQUENT_SHARE", share)
    docs = tables[0].select("doc_id", "text").union(spark.createDataFrame(ROWS, ODD).select("doc_id", "text"))
    whole, shuffled = [], []
    for most, out in ((10**9, whole), (500, shuffled)):
        monkeypatch.setattr(suffix_tree, "MAX_PAIRS", most)
        monkeypatch.setattr(suffix_tree.grow, "__defaults__", (most,))
        out += sorted(suffix_tree.score_documents(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    assert len(whole) == len(shuffled) == docs.count()
    for a, b in zip(whole, shuffled, strict=True):
        assert a[:5] == b[:5] and math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isclose(a.score, b.score, rel_tol=3e-4), (a, b)
    assert math.isclose(sum(r.score for r in whole), sum(r.score for r in shuffled), rel_tol=1e-5)


def test_blocks_of_texts_do_not_hang_on_how_rows_are_batched(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 1000)
    texts, bits = _texts() * 3, suffix_tree.PART_BITS
    at = [(1 << 33) * (k // 40) + k % 40 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(at), pa.array(range(len(texts))), pa.array([k % 3 == 0 for k in range(len(texts))]), pa.array(texts)], names=["at", "doc_id", "held_out", "text"])
    blocks = [[block[:4] for block in suffix_tree._blocks(suffix_tree._doc_rows(some))] for some in ([batch], [batch.slice(k, 7) for k in range(0, len(texts), 7)])]
    assert blocks[0] == blocks[1] and len({b[:2] for b in blocks[0]}) > 6 and sorted(i for *_, ids in blocks[0] for i in ids) == list(range(len(texts)))
    asked = sorted((r for b in suffix_tree._asked([batch], bits) for r in b.to_pylist()), key=lambda r: r["part"])
    keys = suffix_tree.Chunk([t for k, t in enumerate(texts) if k % 3]).keys
    short = suffix_tree.Short(*suffix_tree._sums(keys & suffix_tree._mask(2), np.ones(len(keys), np.int64)))
    answers = {}
    for b in suffix_tree._answered([pa.RecordBatch.from_pylist(asked)], short):
        for r in b.to_pylist():
            answers.setdefault((r["task"], r["block"]), []).append((r["part"], r["n"], r["data"]))
    chance = {}
    for t, n, *_, mine in suffix_tree._blocks(suffix_tree._doc_rows([batch])):
        chunks = [suffix_tree.Chunk(mine[some]) for some in suffix_tree._cut(mine)]
        keys = [chunk.keys for chunk in chunks]
        for some, found in zip(keys, suffix_tree._spelled(chunks, answers[t, n], bits), strict=True):
            for key, x in zip(some.tolist(), found.tolist(), strict=True):
                assert x < 0 and chance.setdefault(key, x) == x
    with pytest.raises(RuntimeError):
        next(suffix_tree._spelled([suffix_tree.Chunk(mine)], [], bits))


def _texts():
    rng = np.random.default_rng(3)
    return [" ".join("".join(rng.choice(list("abc"), 3)) for _ in range(200)).encode() for _ in range(20)] + [b"\xff\xfe high bytes \xf0\x9f\x98\x80" * 5, b"the same passage again and again " * 9]


def _model(spark):
    docs = spark.createDataFrame([(bytearray(t),) for t in _texts()], "text binary").repartition(3)
    return common.settled(suffix_tree.model_table(docs), "test-suffix-model")


def test_tasks_that_look_at_few_rows_together_keep_the_same_states(monkeypatch):
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array(_texts())], names=["text"])
    counted = pa.Table.from_batches([b for half in (texts.slice(0, 9), texts.slice(9)) for b in suffix_tree._counted([half])])
    out = []
    for rows in (1 << 20, 50):
        monkeypatch.setattr(suffix_tree, "ROWS", rows)
        table = pa.Table.from_batches(list(suffix_tree._summed(counted.to_batches(max_chunksize=9))))
        out.append(sorted(zip(*(table[c].to_pylist() for c in ("kind", "level", "key", "n")), strict=True)))
    assert out[0] == out[1] and {r[0] for r in out[0]} == {0, 1, 2}


def test_states_are_those_that_a_plain_divergence_test_keeps(spark):
    keys = suffix_tree.Chunk(_texts()).keys
    counts = [Counter() for _ in range(suffix_tree.DEPTH + 1)]
    for key in keys.tolist():
        for k in range(suffix_tree.DEPTH + 1):
            counts[k][key & (1 << 8 * (k + 1)) - 1] += 1
    want = dict(((0, key), c) for key, c in counts[0].items())
    for k in range(1, suffix_tree.DEPTH + 1):
        total, before, gain, kinds = Counter(), Counter(), Counter(), Counter()
        for key, c in counts[k].items():
            total[key >> 8] += c
        for key, c in counts[k - 1].items():
            before[key >> 8] += c
        for key, c in counts[k].items():
            short = key & (1 << 8 * k) - 1
            gain[key >> 8] += c * math.log(c / total[key >> 8] / (counts[k - 1][short] / before[short >> 8]))
            kinds[key >> 8] += 1
        want |= {(k, key): c for key, c in counts[k].items() if gain[key >> 8] >= 0.5 * kinds[key >> 8] * math.log(total[key >> 8] + 1)}
    kept = suffix_tree.states(_model(spark))
    got = {(r.level, r.key & (1 << 64) - 1): r.n for r in kept.collect()}
    assert got == want and len({k for k, _ in want}) >= suffix_tree.DEPTH
    small = suffix_tree.grow(kept, 500)
    assert 100 < sum(len(pairs) for _, _, pairs, _ in small.levels) <= 500


def test_suffix_tree_chances_sum_to_one(spark):
    keys = suffix_tree.Chunk(_texts()).keys
    tree = suffix_tree.grow(suffix_tree.states(_model(spark)))
    assert sum(len(states) > 0 for states, *_ in tree.levels) >= suffix_tree.DEPTH - 1
    for context in keys[50:60] >> np.uint64(8):
        every = (np.uint64(int(context) << 8 & (1 << 64) - 1)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** tree.log(every)).sum(), 1, rel_tol=1e-9)


def test_suffix_tree_odd_tables(spark):
    odd = suffix_tree.score_documents(spark.createDataFrame(ROWS, ODD)).collect()
    assert len(odd) == len(ROWS) and all(math.isfinite(r.score) for r in odd)
    assert next(r for r in odd if r.doc_id == 1).n_tokens == 1
    assert suffix_tree.score_documents(spark.createDataFrame([], ODD)).count() == 0


def test_tokens_without_a_letter_go_through_the_lattice():
    import numpy as np

    from loreforge.llm import toxicity as t

    counts = np.zeros(t.SIZE**3, np.int64)
    for word in ("ass", "shit", "sit", "the", "you", "here"):
        k = [t.GAP, t.GAP, *(t._SYMBOL[c] for c in word), t.GAP]
        for x, y, z in zip(k, k[1:], k[2:]):
            counts[(x * t.SIZE + y) * t.SIZE + z] += 1000
    model = t.CharModel(counts)
    for token, word in (("455", "ass"), ("$#!7", "shit"), ("5#17", "shit"), ("(455)", "ass"), ("455,", "ass"), ("$#!7.", "shit"), ("a55", "ass")):
        assert word in t.restore(f"you {token} here", model), token
    assert {"you", "here"} <= t.restore("you ... here -- ,", model)
