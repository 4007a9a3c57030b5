"""Queries of canonical records, heads, coverage and masked chunks. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, text
from ..operators import relational, search, snapshots
from ..sources import members
from ..sources.tables import table
from .registry import Registry
from .retrieval import _MASK_SQL, _TOKENS_SQL

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query


@query("""SELECT event_id, sha256('{"k":' || json_extract(props, '$.k') || ',"type":"' || event_type || '"}') AS sha256, CAST(NULL AS VARCHAR) AS error FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, 'DUPLICATE_KEY' FROM events WHERE event_type = 'error'""")
def canonical_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the canonical form of each event's metadata; that of errors names a key twice and has none."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{ "type": "'), "event_type", F.lit('", "k": '), k, F.when(F.col("event_type") == "error", F.lit(', "k": 0')).otherwise(""), F.lit(" }"))
    found = table(spark, sf_dir, "events").select("event_id", canonical.canonical(body).alias("c"))
    return found.select("event_id", "c.sha256", "c.error")


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS composed FROM documents")
def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(canonical.composed("text"), 256).alias("composed"))


@query("SELECT c_custkey, coalesce(max(event_id), 0) AS watermark FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'purchase' GROUP BY c_custkey")
def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of each customer, zero where there is none."""
    last = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("last", F.lit(0)).alias("watermark"))


@query("""WITH r AS (SELECT o_custkey, o_orderstatus = 'F' AS complete, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'O' THEN 'open' END AS reason FROM orders)
SELECT o_custkey, count(*) AS facts, count(*) FILTER (complete) AS complete, array_to_string(list_sort(coalesce(list(DISTINCT reason) FILTER (reason IS NOT NULL), [])), ',') AS reasons FROM r GROUP BY o_custkey""")
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts of each subject are complete, and the distinct reasons why others are not."""
    status = F.col("o_orderstatus")
    reason = F.when(status == "P", "pending").when((status == "O") & (F.col("o_totalprice") > 200000), "large").when(status == "O", "open")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("facts"), F.count_if(status == "F").alias("complete"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"))


@query("""WITH a AS (SELECT doc_id AS id, sha256(text) AS payload FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN sha256(text || '?') ELSE sha256(text) END AS payload FROM documents JOIN labels USING (doc_id))
SELECT id, CASE WHEN a.id IS NULL THEN 'second' WHEN b.id IS NULL THEN 'first' ELSE 'both' END AS found_by, coalesce(a.payload <> b.payload, false) AS conflict FROM a FULL JOIN b USING (id)""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results as one by id; a record that both have must be the same in both."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("payload"))
    second = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.sha2(F.concat("text", F.when(F.col("quality") == 0, "?").otherwise("")), 256).alias("payload"))
    return search.merged(first, second, "id", "payload")


@query("""WITH h AS (SELECT o_custkey, max(o_orderkey) AS head FROM orders GROUP BY o_custkey), v AS (SELECT l_orderkey AS subject, max(l_partkey) AS review FROM lineitem GROUP BY l_orderkey), p AS (SELECT p_partkey AS review, p_type AS status FROM part WHERE p_size > 10)
SELECT h.o_custkey, h.head, v.review, coalesce(p.status, 'pending_review') AS status FROM h LEFT JOIN v ON v.subject = h.head LEFT JOIN p ON p.review = v.review""")
def current_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each subject, its last review, and what that says."""
    heads = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("head"))
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("subject")).agg(F.max("l_partkey").alias("review"))
    reviews = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("review"), F.col("p_type").alias("status"))
    return relational.current(heads, last, reviews)


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT o_orderkey, count(l_suppkey) AS cited, count(l_suppkey) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)) AS outside FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def citation_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each record's citations are members, and how many are not: none outside means it is closed."""
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    known = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("there"))
    of = cited.join(known, "l_suppkey", "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("cited"), F.count_if(F.col("there").isNull()).alias("outside"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(of, "o_orderkey", "left").select("o_orderkey", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("outside", F.lit(0)).alias("outside"))


@query("SELECT DISTINCT l_partkey, l_suppkey, p_brand, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def member_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of two kinds of members met together, each pair once."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    met = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return met.join(suppliers, "l_suppkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_partkey", "l_suppkey", "p_brand", "s_name")


@query("SELECT e.event_id, s.n FROM events e JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) s USING (user_id, event_type)")
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with how many of its kind its user has: a join over both columns."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return events.join(events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"]).select("event_id", "n")


@query("SELECT r_regionkey, r_name FROM region")
def bounded_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions, or an error if there were more than a hundred."""
    return snapshots.bounded(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), 100)


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, sha256(line) AS line FROM (SELECT doc_id, line_no, {_MASK_SQL} AS line, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS used FROM l WHERE line_no BETWEEN 1 AND 200) WHERE used <= 65536""")
def masked_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 lines of each text, credentials masked, as far as 64 KiB go; the bounds are the feature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return members.window(docs, "doc_id", "body", 1, 200, 65536).select("doc_id", "line_no", F.sha2("line", 256).alias("line"))


@query(rf"""WITH m AS (SELECT doc_id, {_MASK_SQL} AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), t AS (SELECT doc_id, unnest({_TOKENS_SQL}) AS token FROM m)
SELECT 'chunk_' || sha256('document/' || doc_id) AS chunk_id, count(*) AS tokens, count(DISTINCT token) AS words, count(*) FILTER (token = 'redacted') AS masked FROM t GROUP BY doc_id""")
def masked_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a label cites as masked chunks of an index."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    chunks = docs.select(F.concat(F.lit("chunk_"), F.sha2(F.concat(F.lit("document/"), F.col("doc_id").cast("string")), 256)).alias("chunk_id"), text.mask(F.col("text")).alias("text"))
    found = search.postings(chunks, "chunk_id", "text")
    return found.groupBy("chunk_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("words"), F.coalesce(F.sum(F.when(F.col("token") == "redacted", F.col("tf"))), F.lit(0)).alias("masked"))


@query(f"SELECT doc_id, sha256(text) AS record_sha256, 'display/1' AS policy, sha256({_MASK_SQL}) AS shown FROM documents")
def read_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as readers see them: masked, with the digest of the original and the policy's name."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("record_sha256"), F.lit("display/1").alias("policy"), F.sha2(text.mask(F.col("text")), 256).alias("shown"))


@query("""SELECT line, sha256(line) AS sha256 FROM (SELECT 'r' || r_regionkey || '["' || replace(r_name, '_', '#95;') || '"] --> n' || n_nationkey || '["' || replace(n_name, '_', '#95;') || '"]' AS line FROM nation JOIN region ON r_regionkey = n_regionkey)""")
def diagram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagram of regions and nations, one edge a line, with labels that no sign can break."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = joined.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("src"), F.col("r_name").alias("src_label"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.col("n_name").alias("dst_label"))
    return snapshots.diagram(nodes).select("line", F.sha2("line", 256).alias("sha256"))


@query("""WITH r AS (SELECT o_custkey, '{"kind":"order","id":"' || o_orderkey || '","status":"' || o_orderstatus || '"}' AS line, o_orderkey FROM orders)
SELECT o_custkey, count(*) AS lines, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM r GROUP BY o_custkey""")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of JSON lines for each customer: how many, and the digest of the whole file."""
    line = F.to_json(F.struct(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("rows"))
    body = F.concat(F.array_join("rows.line", "\n"), F.lit("\n"))
    return rows.select("o_custkey", F.size("rows").cast("long").alias("lines"), F.sha2(body, 256).alias("sha256"))


@query("""WITH t AS (SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings e ORDER BY score DESC, vec_id LIMIT 20)
SELECT t.vec_id, row_number() OVER (ORDER BY score DESC, t.vec_id) - 1 AS place, sha256(d.text) AS chunk, CASE WHEN d.doc_id IS NULL THEN 'NOT_FOUND' WHEN l.doc_id IS NULL THEN 'UNCITED' END AS fault FROM t LEFT JOIN documents d ON d.doc_id = vec_id LEFT JOIN labels l ON l.doc_id = vec_id""")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the 20 nearest vectors in their order; the limit is the feature. A chunk must be there and cited."""
    vectors = table(spark, sf_dir, "embeddings")
    near = search.vector_top(vectors, "vec_id", "embedding", vectors.where("vec_id = 0").select("embedding").first()[0], 20)
    ranked = near.select("vec_id", (F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")) - 1).alias("place"))  # 20 rows
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.sha2("text", 256).alias("chunk"))
    cited = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("cited"))
    found = docs.join(F.broadcast(ranked), "vec_id", "right").join(cited, "vec_id", "left")
    return found.select("vec_id", "place", "chunk", F.when(F.col("chunk").isNull(), "NOT_FOUND").when(F.col("cited").isNull(), "UNCITED").alias("fault"))
