from loreforge.llm import common, decontaminate


def _pairs(docs, items):
    out = {}
    for d, text in docs:
        words = decontaminate.folded(text or "").split()
        for i, item in items:
            mine = decontaminate.folded(item or "").split()
            k = min(5, len(mine))
            if k:
                s = decontaminate.shingles(mine, k)
                n = len(s & decontaminate.shingles(words, k))
                if n >= 0.8 * len(s):
                    out[d, i] = n / len(s)
    return out


def test_against_brute_force(spark, sf, monkeypatch):
    docs, items = common.table(spark, sf, "documents").limit(600), common.table(spark, sf, "benchmark")
    want = _pairs([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.search(docs, items).collect()}
    assert want and got == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)  # several blocks of items
    assert {(r.doc_id, r.item_id): r.containment for r in decontaminate.search(docs, items).collect()} == want
    clean = decontaminate.without_matches(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_short_items_changes_and_odd_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three"
    padding = "nothing to see here at all " * 5000
    near = item.replace("omega", "OTHER").replace(" beta", ",\nBETA!")
    docs = [(1, padding + item + padding), (2, near), (3, item[:60]), (4, None), (5, ""), (6, "x Yes No y"), (7, "straße «alpha» beta gamma delta epsilon"), (1, "x yes no"), (None, item)]
    items = [(10, item), (11, "yes no"), (12, ""), (13, None), (14, "Straße alpha beta gamma delta")]
    df = spark.createDataFrame([(*d, "s", 1.0) for d in docs], "doc_id long, text string, shared string, containment double")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.search(df, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 10), (2, 10), (6, 11), (1, 11), (7, 14), (None, 10)], key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(df, none).count() == 0 and decontaminate.without_matches(df, none).count() == len(docs)
    assert decontaminate.search(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
