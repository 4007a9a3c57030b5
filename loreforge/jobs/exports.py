"""Queries of snapshots, exports and metadata. Each stands beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lineage import shared_folder
from ..operators import relational, snapshots
from ..sources import trees
from ..sources.tables import table
from .registry import Registry
from .retrieval import _MASK_SQL

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query


_SNAPSHOT_SQL = """r AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'passage', CAST(item_id AS VARCHAR), text FROM benchmark)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the good documents and all passages."""
    documents, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    snapshot = snapshots.members({"document": (table(spark, sf_dir, "labels").where("quality = 1"), "doc_id"), "passage": (passages, "item_id")})
    return snapshots.scan(snapshot, {"document": (documents, "doc_id", F.col("text")), "passage": (passages, "item_id", F.col("text"))})


@query(f"WITH {_SNAPSHOT_SQL} SELECT kind, id, sha256(text) AS payload_sha256 FROM r")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("kind", "id", F.sha2("payload", 256).alias("payload_sha256"))


@query(f"""WITH {_SNAPSHOT_SQL}, p AS (SELECT kind, id, '# ' || kind || ' ' || id || chr(10) || chr(10) || {_MASK_SQL} || chr(10) AS content FROM r)
SELECT kind || '/' || sha256(id) || '.md' AS path, kind, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM p""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.exported(_records(spark, sf_dir)).drop("content")


@query(f"""WITH {_SNAPSHOT_SQL}, p AS (SELECT kind, id, '# ' || kind || ' ' || id || chr(10) || chr(10) || {_MASK_SQL} || chr(10) AS content FROM r)
SELECT kind || '/' || sha256(id) || '.md' AS path, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS sha256, sha256(content) AS read_sha256, CAST(NULL AS VARCHAR) AS fault FROM p""")
def exported_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a snapshot written as files of a tree, read back and held against the tree's own listing."""
    root = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    trees.write_tree(snapshots.exported(_records(spark, sf_dir)).select("path", F.encode("content", "UTF-8").alias("content")), root)
    there = trees.read_tree(spark, root).select("path", F.sha2("content", 256).alias("read_sha256"))
    return trees.listing(spark, root).join(there, "path", "full_outer").join(trees.tree_faults(spark, root), "path", "left").select("path", "bytes", "sha256", "read_sha256", "fault")


@query(f"""WITH {_SNAPSHOT_SQL} SELECT 'document/' || sha256(id) || '.md' AS path, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'missing' ELSE 'changed' END AS fault FROM r WHERE kind = 'document' AND CAST(id AS BIGINT) % 3 < 2
UNION ALL SELECT 'passage/' || sha256(id) || '.md', 'unlisted' FROM r WHERE kind = 'passage'""")
def export_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of documents only against pages of which each third is gone and another third is not as listed."""
    records = _records(spark, sf_dir)
    pages = snapshots.exported(records)
    third = F.when(F.col("kind") == "document", F.col("id").cast("long") % 3)
    kept = records.where(third.isNull() | (third != 0)).withColumn("payload", F.when(third == 1, F.concat("payload", F.lit("?"))).otherwise(F.col("payload")))
    return snapshots.faults(pages.where("kind = 'document'"), snapshots.exported(kept))


@query("""SELECT kind, count(*) AS missing FROM (SELECT 'document' AS kind, doc_id AS id FROM labels UNION SELECT 'page', doc_id FROM labels) m
WHERE (kind = 'document' AND id NOT IN (SELECT doc_id FROM documents)) OR (kind = 'page' AND id NOT IN (SELECT page_id FROM pages)) GROUP BY kind""")
def snapshot_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    snapshot = snapshots.members({"document": (labels, "doc_id"), "page": (labels, "doc_id")})
    facts = snapshots.members({"document": (table(spark, sf_dir, "documents"), "doc_id"), "page": (table(spark, sf_dir, "pages"), "page_id")})
    return snapshots.missing(snapshot, facts).groupBy("kind").agg(F.count("*").alias("missing"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.k') IS NOT NULL AS valid, len(json_keys(props)) AS keys FROM events")
def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read by an explicit schema; what does not fit it is marked, not dropped."""
    record = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", record["k"].alias("k"), record["k"].isNotNull().alias("valid"), F.size(F.json_object_keys("props")).alias("keys"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) h WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = h.href) GROUP BY page_id, href""")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(text.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))
    return relational.dangling(links, "href", pages, "url").select("page_id", "href", "n")
