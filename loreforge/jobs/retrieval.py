"""Queries that search, traverse, pack and render. Each stands beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lineage import shared_folder
from ..operators import flow, graph, index, packing, search
from ..sources import members
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query


_TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_STATUS_SQL = "coalesce(CASE l.quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' END, 'pending_review')"


@query(f"""WITH t AS (SELECT doc_id, source, {_TOKENS_SQL} AS w FROM documents), c AS (SELECT doc_id, source, len(list_filter(w, lambda x: x = 'that')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM t)
SELECT doc_id, source, round(a / (a + 1.2) + b / (b + 1.2), 6) AS score, {_STATUS_SQL} AS status FROM c LEFT JOIN labels l USING (doc_id) WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents that hold all words, with their review status; the limit is the feature."""
    top = search.keyword_top(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "text", ["that", "with"], 50).drop("text")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").otherwise("pending_review")
    return top.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "score", status.alias("status"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'that')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM t)
SELECT doc_id, round(a / (a + 1.2) + b / (b + 1.2), 6) AS score FROM c WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents that hold all words, from an index that is written first; the limit is the feature."""
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index.write_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", path, 64)
    return index.Index(spark, path).top(["that", "with"], 20).select(F.col("key").alias("doc_id"), "score")


@query(f"SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most FROM (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS token FROM documents) GROUP BY token, doc_id) GROUP BY token")
def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


_COSINE_SQL = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT e.vec_id, e.label, {_COSINE_SQL} AS score FROM embeddings e ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors most like the first one; the limit is the feature."""
    return search.vector_top(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 20).select("vec_id", "label", "score")


@query(f"""WITH s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS semantic_rank FROM (SELECT e.vec_id, {_COSINE_SQL} AS score FROM embeddings e ORDER BY score DESC, vec_id LIMIT 20)),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS keyword_rank FROM (SELECT doc_id, round(a / (a + 1.2), 6) AS score FROM (SELECT doc_id, len(list_filter({_TOKENS_SQL}, lambda x: x = 'that')) AS a FROM documents) WHERE a > 0 ORDER BY score DESC, doc_id LIMIT 20))
SELECT id, semantic_rank, keyword_rank FROM s FULL JOIN k USING (id)""")
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both results of at most 20 rows, ranked among themselves, without fused scores."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1
    near = search.vector_top(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 20).select(F.col("vec_id").alias("id"), "score")
    words = search.keyword_top(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ["that"], 20).select(F.col("doc_id").alias("id"), "score")
    return search.hybrid(near.withColumn("rank", rank), words.withColumn("rank", rank), "id")


_MASK_SQL = "text"
for _pattern, _to in ((text.ASSIGNMENT, r"\1=[REDACTED]"), (text.BEARER, "Bearer [REDACTED]"), (text.URI, r"\1[REDACTED]@")):
    _MASK_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(_MASK_SQL, _pattern.replace("'", "''"), _to)


@query(f"SELECT doc_id, sha256(masked) AS masked_sha256, masked <> text AS changed FROM (SELECT doc_id, text, {_MASK_SQL} AS masked FROM documents)")
def mask_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.mask(F.col("text")).alias("masked"))
    return docs.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), (F.col("masked") != F.col("text")).alias("changed"))


@query("SELECT doc_id, sha256(text) AS sha256, 'documents/' || sha256(CAST(doc_id AS VARCHAR)) || '.json' AS file, regexp_matches(sha256(text), '^[a-f0-9]{64}$') AS valid FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("sha256"), text.hashed_name(F.lit("documents"), F.col("doc_id").cast("string")).alias("file"), digest.rlike("^[a-f0-9]{64}$").alias("valid"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def utf8_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_length(F.col("text")).cast("long").alias("bytes"))


@query("""SELECT source, doc_id, bytes, used FROM (SELECT source, doc_id, bytes, CAST(sum(bytes) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used
FROM (SELECT source || '/' || lang AS source, doc_id, octet_length(encode(text)) AS bytes FROM documents)) WHERE used <= 20000""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("source"), "doc_id", text.byte_length(F.col("text")).alias("bytes"))
    return packing.budget_prefix(rows, "source", "doc_id", "bytes", 20000)


@query(None)
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("source"), "doc_id", text.byte_length(F.col("text")).cast("long").alias("bytes"))
    return packing.greedy(rows, "source", "doc_id", "bytes", 20000)


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, sha256(translate(regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '([\\`*_{}\[\]()#+.!|>~-])', '\\\1', 'g'), chr(13) || chr(10), '  ')) AS markdown_sha256 FROM pages""")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.markdown(F.col("html")), 256).alias("markdown_sha256"))


@query(r"""SELECT page_id, line_no, line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages) WHERE line_no BETWEEN 2 AND 5""")
def source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("at", "line"))
    return lines.where(F.col("at").between(1, 4)).select("page_id", (F.col("at") + 1).alias("line_no"), "line")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/?', '') AS path FROM pages)
SELECT page_id, path, len(path) > 0 AND octet_length(encode(path)) <= 4096 AND NOT regexp_matches(path, '[\x00-\x1f\x7f\\:]') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS valid, regexp_matches(path, '^(fr|en/.*5|de/1.*)$') AS left_out FROM p""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/?", "").alias("path"))
    hit = F.col("path").rlike("|".join(text.glob_regex(p) for p in ("fr", "en/*5", "de/1*")))
    return pages.select("page_id", "path", text.relative_path_ok(F.col("path")).alias("valid"), hit.alias("left_out"))


@query("""SELECT event_id, regexp_matches(z, '^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?(Z|[+-]\\d\\d:?\\d\\d)$') AS zoned,
CASE k WHEN 'Z' THEN 26 WHEN 'T' THEN 8 ELSE CASE f WHEN '*ISO' THEN 10 WHEN '*JUL' THEN 6 ELSE 8 END END AS display_length
FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END AS z,
CASE event_type WHEN 'view' THEN 'Z' WHEN 'click' THEN 'T' ELSE 'L' END AS k, CASE event_id % 4 WHEN 0 THEN '*ISO' WHEN 1 THEN '*JUL' ELSE '*DMY' END AS f FROM events)""".replace("\\\\", "\\"))
def temporal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    zone = F.when(n % 3 == 0, "").when(n % 3 == 1, "Z").otherwise("+02:00")
    kind = F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "click", "T").otherwise("L")
    form = F.when(n % 4 == 0, "*ISO").when(n % 4 == 1, "*JUL").otherwise("*DMY")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", text.zoned_time_ok(stamp).alias("zoned"), text.temporal_length(kind, form).alias("display_length"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def containment_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage as it is."""
    return search.holding(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))


_EDGES_SQL = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || s_nationkey, CASE WHEN s_acctbal >= 0 THEN 's' || s_suppkey END FROM supplier"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to nations to customers to orders, and nations to suppliers, unresolved where in debt."""
    def ident(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    nation, customer, orders, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "orders", "supplier"))
    parts = [nation.select(ident("r", "n_regionkey").alias("src"), ident("n", "n_nationkey").alias("dst")), customer.select(ident("n", "c_nationkey").alias("src"), ident("c", "c_custkey").alias("dst")), orders.select(ident("c", "o_custkey").alias("src"), ident("o", "o_orderkey").alias("dst")), supplier.select(ident("n", "s_nationkey").alias("src"), F.when(F.col("s_acctbal") >= 0, ident("s", "s_suppkey")).alias("dst"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH RECURSIVE e AS ({_EDGES_SQL}), b AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS level FROM region UNION ALL
SELECT b.seed, e.dst, b.level + 1 FROM b JOIN e ON e.src = b.node WHERE e.dst IS NOT NULL AND b.level < 2), m AS (SELECT seed, node, min(level) AS level FROM b GROUP BY seed, node)
SELECT seed, node, level, CASE WHEN node IN (SELECT src FROM e WHERE dst IS NULL) THEN 'unresolved' WHEN level = 2 AND EXISTS (SELECT 1 FROM e WHERE e.src = m.node AND e.dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m x WHERE x.seed = m.seed AND x.node = e.dst)) THEN 'traversal_limit' ELSE '' END AS boundary FROM m""")
def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed")).withColumn("node", F.col("seed"))
    return graph.bounded_bfs(edges, seeds, 2)


@query(f"""WITH RECURSIVE e AS ({_EDGES_SQL}), b AS (SELECT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS node, 0 AS level FROM nation UNION ALL
SELECT b.seed, e.dst, b.level + 1 FROM b JOIN e ON e.src = b.node WHERE e.dst IS NOT NULL AND b.level < 8) SELECT seed AS application, node AS member, min(level) AS distance FROM b WHERE node <> seed GROUP BY seed, node""")
def reach_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("seed")).withColumn("node", F.col("seed"))
    found = graph.reach(_edges(spark, sf_dir), seeds).where("node <> seed")
    return found.select(F.col("seed").alias("application"), F.col("node").alias("member"), F.col("level").alias("distance"))


_UP_SQL = """SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0"""


def _up_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(name: str, a: str, b: str, condition: str = "true"):
        return table(spark, sf_dir, name).where(condition).select(F.concat(F.lit(a[0]), F.col(a[2:]).cast("string")).alias("src"), F.concat(F.lit(b[0]), F.col(b[2:]).cast("string")).alias("dst"))

    return edge("orders", "o:o_orderkey", "c:o_custkey").union(edge("customer", "c:c_custkey", "n:c_nationkey")).union(edge("nation", "n:n_nationkey", "r:n_regionkey")).union(edge("nation", "r:n_regionkey", "n:n_nationkey", "n_nationkey % 5 = 0"))


@query(f"""WITH RECURSIVE e AS ({_UP_SQL}), p AS (SELECT src AS at, [src] AS path FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)) UNION ALL
SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.at WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 4),
w AS (SELECT p.path, p.at, count(e.dst) AS ways, count(e.dst) FILTER (NOT list_contains(p.path, e.dst)) AS fresh FROM p LEFT JOIN e ON e.src = p.at GROUP BY p.path, p.at)
SELECT array_to_string(path, '>') AS path, len(path) AS nodes, CASE WHEN ways = 0 THEN 'leaf' WHEN fresh = 0 THEN 'cycle' ELSE 'limit' END AS ending FROM w WHERE len(path) > 1 AND (fresh = 0 OR len(path) = 4)""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to regions, with ways back from regions to some nations."""
    return graph.simple_paths(_up_links(spark, sf_dir), 4)


@query(f"""WITH RECURSIVE e AS ({_UP_SQL}), p AS (SELECT src AS at, [src] AS path FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e)) UNION ALL
SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.at WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 6),
w AS (SELECT p.path, CASE WHEN e.dst IS NULL THEN 'leaf' WHEN len(p.path) = 6 THEN 'limit' ELSE 'cycle' END AS ending, CASE WHEN len(p.path) < 6 THEN e.dst END AS back FROM p LEFT JOIN e ON e.src = p.at WHERE len(p.path) = 6 OR e.dst IS NULL OR list_contains(p.path, e.dst)),
d AS (SELECT DISTINCT * FROM w)
SELECT array_to_string(path, '>') AS path, len(path) AS nodes, ending, back FROM d ORDER BY CASE WHEN back IS NULL THEN path ELSE list_append(path, back) END, ending LIMIT 300""")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 ways from orders up to regions and on, with each way back."""
    return graph.bounded_paths(_up_links(spark, sf_dir), 6, 300)[0]


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
l AS (SELECT DISTINCT src AS node, 0 AS layer FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, l.layer + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(layer) AS layer FROM l GROUP BY node""")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).where("dst is not null and dst not like 's%'")
    return graph.layers(edges.select(F.col("src").alias("node")).union(edges.select("dst")), edges)


@query("""SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_quantity >= 50 UNION SELECT l_partkey + 10000000 FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)
UNION SELECT l_suppkey + 20000000 FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))""")
def citation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    part, supplier = F.col("l_partkey") + 10_000_000, F.col("l_suppkey") + 20_000_000
    links = items.select(F.col("l_orderkey").alias("src"), part.alias("dst")).union(items.select(part, supplier)).distinct()
    return graph.closure(links, items.where("l_quantity >= 50").select(F.col("l_orderkey").alias("node")))


_FLOW_SQL = """n AS (SELECT conv_id AS artifact, turn AS node, role AS defines, role = 'system' AND turn > 0 AS barrier FROM conversations),
e AS (SELECT a.artifact, a.node AS src, b.node AS dst FROM n a JOIN n b ON b.artifact = a.artifact AND (b.node = a.node + 1 OR (b.node = a.node + 3 AND a.node % 2 = 0))),
v AS (SELECT DISTINCT artifact, 'user' AS variable FROM n UNION SELECT DISTINCT artifact, 'assistant' FROM n)"""


def _conversation_flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as statements: each defines its role, later system turns are barriers, and even turns may skip two."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("artifact"), F.col("turn").alias("node"), "role")
    nodes = turns.select("artifact", "node", ((F.col("role") == "system") & (F.col("node") > 0)).alias("barrier"), F.array("role").alias("defines"), F.array(F.lit("user"), F.lit("assistant")).alias("uses"))
    ways = F.explode(F.when(F.col("node") % 2 == 0, F.array(F.col("node") + 1, F.col("node") + 3)).otherwise(F.array(F.col("node") + 1)))
    edges = turns.select("artifact", F.col("node").alias("src"), ways.alias("dst")).join(turns.select("artifact", F.col("node").alias("dst")), ["artifact", "dst"], "left_semi")
    return nodes, edges, turns.where("node = 0").select("artifact", "node")


@query(f"""WITH RECURSIVE {_FLOW_SQL}, r(artifact, node, variable, definition) AS (
SELECT v.artifact, 0, v.variable, -1 FROM v JOIN n ON n.artifact = v.artifact AND n.node = 0
UNION SELECT e.artifact, e.dst, n.defines, n.node FROM n JOIN e ON e.artifact = n.artifact AND e.src = n.node WHERE NOT n.barrier AND n.defines <> 'system'
UNION SELECT e.artifact, e.dst, v.variable, -1 FROM n JOIN e ON e.artifact = n.artifact AND e.src = n.node JOIN v ON v.artifact = n.artifact WHERE n.barrier
UNION SELECT e.artifact, e.dst, r.variable, r.definition FROM r JOIN n ON n.artifact = r.artifact AND n.node = r.node JOIN e ON e.artifact = n.artifact AND e.src = n.node WHERE NOT n.barrier AND n.defines <> r.variable)
SELECT n.artifact, n.node, v.variable, coalesce(array_to_string(list_sort(list(DISTINCT r.definition) FILTER (r.definition >= 0)), ','), '') AS definitions,
count(r.definition) FILTER (r.definition >= 0) > 0 AND count(*) FILTER (r.definition = -1) = 0 AS definite
FROM n JOIN v ON v.artifact = n.artifact LEFT JOIN r ON r.artifact = n.artifact AND r.node = n.node AND r.variable = v.variable GROUP BY n.artifact, n.node, v.variable""")
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flow.reaching(*_conversation_flow(spark, sf_dir))
    return found.select("artifact", "node", "variable", F.array_join("definitions", ",").alias("definitions"), "definite")


@query(f"""WITH RECURSIVE {_FLOW_SQL}, a(artifact, avoided, node) AS (SELECT n.artifact, m.node, 0 FROM n JOIN n m ON m.artifact = n.artifact WHERE n.node = 0 AND m.node <> 0
UNION SELECT a.artifact, a.avoided, e.dst FROM a JOIN e ON e.artifact = a.artifact AND e.src = a.node WHERE e.dst <> a.avoided)
SELECT n.artifact, n.node, m.node AS dominator FROM n JOIN n m ON m.artifact = n.artifact AND m.node <> n.node WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.artifact = n.artifact AND a.avoided = m.node AND a.node = n.node)""")
def dominator_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, entries = _conversation_flow(spark, sf_dir)
    return flow.dominators(edges, entries)


@query(f"""WITH RECURSIVE {_FLOW_SQL}, a(artifact, avoided, node) AS (SELECT n.artifact, m.node, 0 FROM n JOIN n m ON m.artifact = n.artifact WHERE n.node = 0 AND m.node <> 0
UNION SELECT a.artifact, a.avoided, e.dst FROM a JOIN e ON e.artifact = a.artifact AND e.src = a.node WHERE e.dst <> a.avoided),
d AS (SELECT n.artifact, n.node, m.node AS dominator FROM n JOIN n m ON m.artifact = n.artifact AND m.node <> n.node WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.artifact = n.artifact AND a.avoided = m.node AND a.node = n.node)),
k AS (SELECT artifact, node, count(*) AS depth FROM d GROUP BY ALL), r AS (SELECT DISTINCT artifact, node FROM d UNION SELECT artifact, 0 FROM n WHERE node = 0)
SELECT r.artifact, r.node, arg_max(d.dominator, coalesce(k.depth, 0)) AS idom, count(d.dominator) AS depth FROM r LEFT JOIN d ON d.artifact = r.artifact AND d.node = r.node LEFT JOIN k ON k.artifact = r.artifact AND k.node = d.dominator GROUP BY r.artifact, r.node""")
def dominator_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's immediate dominator, and how many it has: the tree's numbers say what stands above what."""
    _, edges, entries = _conversation_flow(spark, sf_dir)
    tree = flow.dominator_tree(edges, entries)
    above = tree.select("artifact", F.col("first").alias("a"), F.col("last").alias("b"))
    held = tree.join(above, "artifact").where("a < first and first <= b").groupBy("artifact", "node").agg(F.count("*").alias("depth"))
    return tree.join(held, ["artifact", "node"], "left").select("artifact", "node", "idom", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


@query(r"""SELECT page_id, line_no, trim(substr(rpad(line, 80, ' '), 19, 10)) AS name_field, trim(substr(rpad(line, 80, ' '), 45, 36)) AS functions,
len(rtrim(line)) > 80 AS overflow FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages)""")
def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns of each line of each page."""
    rows = members.lines(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    cut = members.description_columns(F.col("line"))
    return rows.select("page_id", "line_no", cut["name"].alias("name_field"), cut["functions"].alias("functions"), (F.length(F.rtrim("line")) > 80).alias("overflow"))
