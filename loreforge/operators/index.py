"""A keyword index as a table: postings in blocks of key ranges, each with its greatest count, so that a search reads few of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import postings


def term_score(tf: Column) -> Column:
    return tf / (tf + 1.2)


def write_index(docs: DataFrame, key: str, body: str, path: str, width: int = 4096) -> None:
    """Writes (token, range, most, n, keys, counts): a block for each token and range of `width` integer keys.

    A block has `width` postings at most, so no group is large whatever a token's share of the texts; counts of a text's tokens are
    summed before they are shuffled. Files hold ranges of tokens in order, so that a token's blocks are found by their statistics.
    """
    found = postings(docs.where(F.col(key).isNotNull()), key, body).withColumn("range", F.floor(F.col(key) / width))
    blocks = found.groupBy("token", "range").agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), F.col("tf").cast("int").alias("tf")))).alias("held"))
    rows = blocks.select("token", "range", F.array_max("held.tf").alias("most"), F.size("held").alias("n"), F.col("held.key").alias("keys"), F.col("held.tf").alias("counts"))
    rows.repartitionByRange(*[F.col(c) for c in ("token", "range")]).sortWithinPartitions("token", "range").write.parquet(path)


class Index:
    """An index that was written. blocks_read and blocks_there tell of the last search how many of its words' blocks it read."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(path)
        self.blocks_read = self.blocks_there = 0

    def top(self, words: list[str], k: int) -> DataFrame:
        """(key, score): the k best texts that hold all words, by the sum of tf / (tf + 1.2) rounded to six places, then by key.

        A range's bound is the sum of its blocks' greatest counts' scores. The ranges of the highest bounds that have k texts for
        each word are read first; the k-th score found there leaves out all ranges whose bound is lower. Bounds are read without the
        postings. What comes to the driver is one bound for each of the first ranges, k at most, and one score.
        """
        words = sorted({w.lower() for w in words})
        own = self.rows.where(F.col("token").isin(words))
        bounds = own.groupBy("range").agg(F.count("*").alias("words"), F.round(F.sum(term_score(F.col("most"))), 6).alias("bound"), F.min("n").alias("n"))
        self.blocks_read, self.blocks_there = 0, own.count()
        whole = bounds.where(F.col("words") == len(words)).select("range", "bound", "n")
        first, texts = [], 0
        for row in whole.orderBy(F.desc("bound"), "range").limit(k).collect():
            first.append(row)
            texts += row["n"]
            if texts >= k:
                break
        if not first:
            return self._scored(own.limit(0), words)
        opening = own.where(F.col("range").isin([r["range"] for r in first]))
        scores = [r["score"] for r in self._scored(opening, words).orderBy(F.desc("score"), "key").limit(k).collect()]
        least = scores[-1] if len(scores) == k else 0.0
        candidates = whole.where(F.col("bound") >= least).select("range")
        self.blocks_read = candidates.count() * len(words)
        return self._scored(own.join(candidates, "range", "left_semi"), words).orderBy(F.desc("score"), "key").limit(k)

    def _scored(self, blocks: DataFrame, words: list[str]) -> DataFrame:
        held = blocks.select("token", F.explode(F.arrays_zip("keys", "counts")).alias("p")).select("token", F.col("p.keys").alias("key"), F.col("p.counts").alias("tf"))
        parts = [F.max(F.when(F.col("token") == w, term_score(F.col("tf")))) for w in words]
        total = reduce(lambda a, b: a + b, parts)  # null where a word lacks
        return held.groupBy("key").agg(F.round(total, 6).alias("score")).where(F.col("score").isNotNull())
