"""Immutable snapshots: membership rows, scans over them, exports and their validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def members(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, id) of a snapshot from tables of ids by kind; ids as text, each once."""
    views = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")) for kind, (df, key) in parts.items()]
    return reduce(DataFrame.unionByName, views).distinct()


def scan(snapshot: DataFrame, facts: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """(kind, id, payload) of the members only: each kind is a semi-join of its facts with its members."""
    views = []
    for kind, (df, key, payload) in facts.items():
        mine = snapshot.where(F.col("kind") == kind).select("id")
        views.append(df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), payload.alias("payload")).join(mine, "id", "left_semi"))
    return reduce(DataFrame.unionByName, views)


def missing(snapshot: DataFrame, facts: DataFrame) -> DataFrame:
    """Members without a fact: an empty result proves that the snapshot is closed."""
    return snapshot.join(facts.select("kind", "id"), ["kind", "id"], "left_anti")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """The rows, or an error if there are more; one row beyond the bound is looked for, no more."""
    if df.limit(most + 1).count() > most:
        raise ValueError("RESULT_LIMIT")
    return df


def exported(records: DataFrame) -> DataFrame:
    """(path, kind, bytes, sha256, content) of a page for each record: masked, under a name that only its digest makes up."""
    content = F.concat(F.lit("# "), F.col("kind"), F.lit(" "), F.col("id"), F.lit("\n\n"), text.mask(F.col("payload")), F.lit("\n"))
    pages = records.select(text.hashed_name(F.col("kind"), F.col("id"), "md").alias("path"), "kind", content.alias("content"))
    return pages.select("path", "kind", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def faults(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, fault) where pages and manifest differ: missing, unlisted, or changed content."""
    held = pages.select("path", F.sha2("content", 256).alias("found"))
    both = manifest.select("path", "sha256").join(held, "path", "full_outer")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256") != F.col("found"), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def diagram(edges: DataFrame) -> DataFrame:
    """(line) of a flow diagram from edges (src, src_label, dst, dst_label); signs in labels are entities."""
    def node(name: str) -> Column:
        return F.concat(F.col(name), F.lit('["'), text.diagram_label(F.col(f"{name}_label")), F.lit('"]'))

    return edges.select(F.concat(node("src"), F.lit(" --> "), node("dst")).alias("line"))
