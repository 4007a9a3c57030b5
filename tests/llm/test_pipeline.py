import corpus_pipeline
from loreforge.llm import common, decontaminate, quality, simhash, toxicity

from .test_similar import kept


def test_stages_do_what_their_operators_say(spark, sf):
    docs = common.table(spark, sf, "documents")
    labels, items = common.table(spark, sf, "labels"), common.table(spark, sf, "benchmark")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.settled(stage(spark, out[-1] if out else docs, sf), f"test-{name}"))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in [docs, *out]]
    assert all(d.columns == docs.columns for d in out[:-1])
    assert ids[1] == {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert ids[2] == {r.doc_id for r in toxicity.classify(out[0], labels).where("predicted = 0").collect()}
    assert ids[3] == kept({r.doc_id: r.text or "" for r in out[1].collect()})  # three bits apart at most, or 0.8 of shingles shared
    assert ids[3] <= {r.component_id for r in simhash.near_duplicates(out[1]).collect()}
    assert ids[4] == ids[3] - {r.doc_id for r in decontaminate.search(out[2], items).collect()}
    assert ids[5] == ids[4]
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == ids[5]


def test_stages_take_empty_tables_and_more_columns(spark, sf):
    docs = common.table(spark, sf, "documents").limit(0).selectExpr("*", "1.5 as score", "doc_id as y", "text as bits")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == docs.columns and new.count() == 0
