"""Joins, overlays and classifications of the knowledge base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, namespace: str, column: str = "namespace") -> DataFrame:
    """Every read goes through its namespace; the predicate reaches the scan."""
    return df.where(F.col(column) == namespace)


def latest_as_of(events: DataFrame, keys: list[str], sequence: str, watermark) -> DataFrame:
    """The last event of each subject up to the watermark. A max_by aggregate combines before the shuffle, where a window
    would sort all events of a hot subject in one task."""
    rest = [c for c in events.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(sequence)).alias("_last")
    return events.where(F.col(sequence) <= watermark).groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def overlay(records: DataFrame, reviews: DataFrame, key: str, status: str, default: str = "pending_review") -> DataFrame:
    """Records with their review status, the default where there is none."""
    return records.join(reviews.select(key, status), key, "left").withColumn(status, F.coalesce(status, F.lit(default)))


def heads(revisions: DataFrame, ident: str, previous: str) -> DataFrame:
    """Revisions that no other names as its predecessor."""
    named = revisions.where(F.col(previous).isNotNull()).select(F.col(previous).alias(ident))
    return revisions.join(named, ident, "left_anti")


def current(heads: DataFrame, review_heads: DataFrame, reviews: DataFrame, default: str = "pending_review") -> DataFrame:
    """Heads (subject columns, head) with the last review (subject, review) of each and its status (review, status)."""
    joined = heads.join(review_heads.withColumnRenamed("subject", "head"), "head", "left").join(reviews, "review", "left")
    return joined.select(*heads.columns, "review", F.coalesce("status", F.lit(default)).alias("status"))


def any_of(rows: DataFrame, key: str, others: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose key is in any of the tables: a union of semi-joins, where an OR in one join would fan out."""
    parts = [rows.join(other.select(F.col(column).alias(key)), key, "left_semi") for other, column in others]
    return reduce(DataFrame.unionByName, parts).distinct()


def dangling(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """References to what is not there: an empty result proves closure."""
    return rows.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)), column, "left_anti")


def resolution(matches: Column, dynamic: Column) -> Column:
    """A dynamic reference stays dynamic whatever it matches; several matches are ambiguous, never the first of them."""
    return F.when(dynamic, "dynamic").when(matches == 0, "missing").when(matches == 1, "resolved").otherwise("ambiguous")


def resolve(references: DataFrame, entities: DataFrame) -> DataFrame:
    """references (ref, library?, name, dynamic) against distinct entities (library, name): resolution and candidates.

    Matches are counted in two equi-joins, by library and name and by name alone; the entities of a name are gathered
    before the join, so that a name with many references meets one row.
    """
    distinct = entities.select("library", "name").distinct()
    exact = references.where("library is not null").join(distinct.withColumn("_hit", F.lit(1)), ["library", "name"], "left")
    exact = exact.select("ref", "dynamic", F.when(F.col("_hit") == 1, F.array("library")).otherwise(F.array().cast("array<string>")).alias("found"))
    by_name = distinct.groupBy("name").agg(F.array_sort(F.collect_set("library")).alias("found"))
    loose = references.where("library is null").drop("library").join(by_name, "name", "left")
    loose = loose.select("ref", "dynamic", F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    both = exact.unionByName(loose)
    state = resolution(F.size("found"), F.col("dynamic"))
    return both.select("ref", state.alias("resolution"), F.when(state == "ambiguous", F.array_join("found", ",")).otherwise("").alias("candidates"), F.when(state == "resolved", F.col("found")[0]).alias("target"))


def best_ranked(entities: DataFrame, name: str, library: str, ordered: list[str]) -> DataFrame:
    """For each name the library that stands first in the list, and how many entities it has: ties are ambiguous."""
    rank = F.array_position(F.array(*map(F.lit, ordered)), F.col(library))
    ranked = entities.where(F.col(library).isin(ordered)).groupBy(name, library).agg(F.count("*").alias("n"), F.min(rank).alias("rank"))
    best = ranked.groupBy(name).agg(F.min_by(F.struct(library, "n"), "rank").alias("b"))
    return best.select(name, F.col(f"b.{library}").alias(library), resolution(F.col("b.n"), F.lit(False)).alias("resolution"))


def appended(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """What an idempotent append does with each incoming row: insert, same, or conflict where the payload differs."""
    old = existing.select(key, F.col(payload).alias("_old"), F.lit(True).alias("_there"))
    joined = incoming.join(old, key, "left")
    return joined.withColumn("outcome", F.when(F.col("_there").isNull(), "insert").when(F.col(payload).eqNullSafe(F.col("_old")), "same").otherwise("conflict")).drop("_old", "_there")


def compared_and_set(proposals: DataFrame, current: DataFrame, subject: str, expected: str, head: str) -> DataFrame:
    """Proposals whose expected head is the current one are accepted; others are stale. No head expects null."""
    joined = proposals.join(current.select(subject, F.col(head).alias("_head")), subject, "left")
    return joined.withColumn("accepted", F.col(expected).eqNullSafe(F.col("_head"))).drop("_head")


def prepared(declared: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Every declared or received path with its status."""
    d, r = declared.select(key).distinct().withColumn("_d", F.lit(1)), received.select(key).distinct().withColumn("_r", F.lit(1))
    return d.join(r, key, "full_outer").select(key, F.when(F.col("_d").isNull(), "undeclared").when(F.col("_r").isNull(), "missing").otherwise("ready").alias("status"))


def ordinal(df: DataFrame, anchor: list[str], order: str) -> DataFrame:
    """The place of each row in its anchor, from 0."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*anchor).orderBy(order)) - 1)


def merged_claim(values: Column, unknown: str) -> Column:
    """Exactly one concrete claim counts; none or conflicting ones are unknown."""
    found = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != unknown)))
    return F.when(F.size(found) == 1, found[0]).otherwise(unknown)
