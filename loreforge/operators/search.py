"""Ranked retrieval: keywords, vectors, and both."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors

#: Passages of one or two words that are broadcast at a time.
SHORT_BLOCK = 5_000


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(token, key, tf): the inverted index."""
    return docs.select(key, F.explode(text.tokens(F.col(body))).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def keyword_top(docs: DataFrame, key: str, body: str, words: list[str], k: int) -> DataFrame:
    """The k best documents that hold all words: the sum of tf / (tf + 1.2), then the key.

    A text that lacks a word even as a part goes first; in the others the words are counted where no letter or digit stands
    beside them, which is what makes them tokens; case does not count. Nothing is exploded or shuffled but the k best of each task.
    """
    low = F.lower(F.col(body))
    hits, words = docs, [w.lower() for w in words]
    for word in words:
        hits = hits.where(F.contains(low, F.lit(word)))
    for i, word in enumerate(words):
        quoted = re.sub(r"([^\w\s])", r"\\\1", word)
        whole = rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])"
        hits = hits.withColumn(f"_tf{i}", F.regexp_count(low, F.lit(whole))).where(F.col(f"_tf{i}") > 0)
    score = sum((F.col(f"_tf{i}") / (F.col(f"_tf{i}") + 1.2) for i in range(1, len(words))), F.col("_tf0") / (F.col("_tf0") + 1.2))
    return hits.withColumn("score", F.round(score, 6)).drop(*[f"_tf{i}" for i in range(len(words))]).orderBy(F.desc("score"), key).limit(k)


def vector_top(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k most alike by cosine, then by key; rows without a valid vector take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    good = rows.where(vectors.valid(F.col(vector), len(query)))
    return good.withColumn("score", F.round(vectors.cosine(F.col(vector), q), 6)).orderBy(F.desc("score"), key).limit(k)


def hybrid(semantic: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """The union of both results by key, without fusing scores: semantic rank first, then keyword rank."""
    s, w = semantic.select(key, F.col("rank").alias("semantic_rank")), keyword.select(key, F.col("rank").alias("keyword_rank"))
    return s.join(w, key, "full_outer").orderBy(F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), key)


def merged(first: DataFrame, second: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, found_by, conflict) of two results as one: which of them has a record, and whether both have it but differ."""
    a = first.select(key, F.col(payload).alias("_a"), F.lit(True).alias("_in_a"))
    b = second.select(key, F.col(payload).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    found = F.when(F.col("_in_a").isNull(), "second").when(F.col("_in_b").isNull(), "first").otherwise("both")
    return both.select(key, found.alias("found_by"), ((found == "both") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("conflict"))


def holding(docs: DataFrame, items: DataFrame, block: int = SHORT_BLOCK) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) that contain a passage (item_id, passage).

    A passage of three words or more is found by its longest inner word, which white space bounds on both sides, and then
    compared. Shorter ones have no such word: the documents are read once for each block of them, each of bounded size.
    """
    words = F.split("passage", r"\s+")
    inner = F.array_sort(F.transform(F.slice(words, 2, F.size(words) - 2), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word"))))
    keyed = items.where(F.size(words) > 2).select("item_id", inner[0]["word"].alias("word"))
    posted = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    pairs = posted.join(keyed, "word").select("doc_id", "item_id")
    out = pairs.join(items, "item_id").join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    short = items.where(F.size(words) <= 2)
    parts = -(-2 * short.count() // block)
    for k in range(parts):
        some = short if parts < 2 else short.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts)) == k)
        out = out.union(docs.join(F.broadcast(some), F.contains("text", "passage")).select("doc_id", "item_id"))
    return out
