"""From raw documents to packed sequences: rejected, toxic, repeated and contaminated documents go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreforge.llm import common, decontaminate, packing, quality, simhash, toxicity
from loreforge.llm.tokens import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: null, empty and long texts by their score, rows that repeat each; an empty
    table stays empty, and further columns stay as they are. The classifier learns from the labels of these documents."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic, with the same rules for nulls, repeated rows, empty tables and further columns."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints three bits apart at most, or 0.8 of five-word shingles shared.

    Of a group the smallest doc_id stays, of repeated rows one, a null id only where its group has no other. All empty and
    null texts are one group. An empty table stays empty, and further columns stay as they are."""
    return simhash.one_of_each(docs, alike=True)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay, and so does every document where there are no items."""
    return decontaminate.without_matches(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; null and empty texts are their end id, and an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", good), ("toxicity", clean), ("near_dedup", distinct), ("decontamination", uncontaminated), ("packing", packed)]
#: Classifiers, hashes and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each written before the next one reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = common.settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            common.drop(docs)  # what the stage before kept is in this one's table
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
