"""Queries of records closed over their evidence, facts for a reader, packages and pages. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, graph, packing
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query

_EVIDENCE_SQL = """sup AS (SELECT l_partkey AS src, 10000000 + min(l_suppkey) AS dst FROM lineitem GROUP BY l_partkey),
ev AS (SELECT p_partkey AS evidence, CASE WHEN p_size <= 15 THEN 'observed' WHEN p_size <= 40 THEN 'inferred' ELSE 'unresolved' END AS classification, p_retailprice > 1080 AS blocked FROM part
UNION ALL SELECT 10000000 + s_suppkey, 'observed', false FROM supplier WHERE s_acctbal >= 0),
cited AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS evidence FROM lineitem),
closed AS (SELECT item, evidence FROM cited UNION SELECT item, dst FROM cited JOIN sup ON src = evidence WHERE evidence IN (SELECT evidence FROM ev)),
items AS (SELECT item, list_sort(list(evidence)) AS evidence, bool_and(evidence IN (SELECT evidence FROM ev)) AS complete FROM closed GROUP BY item)"""


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders cite their parts, and parts their first supplier; suppliers in debt are not there."""
    items, part, supplier = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    evidence = part.select(F.col("p_partkey").alias("evidence"), F.when(F.col("p_size") <= 15, "observed").when(F.col("p_size") <= 40, "inferred").otherwise("unresolved").alias("classification"), (F.col("p_retailprice") > 1080).alias("blocked"))
    evidence = evidence.unionByName(supplier.where("s_acctbal >= 0").select((F.col("s_suppkey") + 10_000_000).alias("evidence"), F.lit("observed").alias("classification"), F.lit(False).alias("blocked")))
    links = items.groupBy(F.col("l_partkey").alias("src")).agg((F.min("l_suppkey") + 10_000_000).alias("dst"))
    cited = items.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("evidence"))
    return cited, links, evidence


def _joined(column: str):
    return F.array_join(column, ",")


@query(f"WITH {_EVIDENCE_SQL} SELECT item, CAST(len(evidence) AS BIGINT) AS n, complete, sha256('[' || array_to_string(evidence, ',') || ']') AS fingerprint FROM items")
def item_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order cites in any depth, whether all of it is there, and the digest of the list."""
    closure = assembly.item_closure(*_evidence(spark, sf_dir))
    of = closure.groupBy("item").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"), F.bool_and("complete").alias("complete"))
    return of.select("item", F.size("evidence").cast("long").alias("n"), "complete", F.sha2(F.concat(F.lit("["), _joined("evidence"), F.lit("]")), 256).alias("fingerprint"))


@query(f"""WITH {_EVIDENCE_SQL}, direct AS (SELECT item, sha256('[' || string_agg(CAST(evidence AS VARCHAR), ',' ORDER BY evidence) || ']') AS stated FROM cited GROUP BY item)
SELECT item, stated <> sha256('[' || array_to_string(evidence, ',') || ']') AS stale FROM items JOIN direct USING (item)""")
def stale_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that state the digest of what they cite themselves, held against the digest of the closure."""
    cited = _evidence(spark, sf_dir)[0].distinct()
    stated = cited.groupBy("item").agg(F.sha2(F.concat(F.lit("["), _joined(F.array_sort(F.collect_list("evidence"))), F.lit("]")), 256).alias("stated"))
    return item_citations(spark, sf_dir).join(stated, "item").select("item", (F.col("stated") != F.col("fingerprint")).alias("stale"))


_FACTS_SQL = f"""{_EVIDENCE_SQL},
rec AS (SELECT o_orderkey AS id, o_custkey || '/' || o_orderstatus AS text, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank FROM orders),
weak AS (SELECT item, max(CASE WHEN classification = 'unresolved' OR blocked THEN 2 ELSE 0 END) AS w FROM closed JOIN ev USING (evidence) GROUP BY item),
pairs AS (SELECT sha256(text) AS h, id, evidence, greatest(w, rank) AS rank, text FROM rec JOIN items ON item = id AND complete JOIN weak USING (item)),
facts AS (SELECT 'chunk:' || h AS key, min(id) AS id, list_sort(list_distinct(flatten(list(evidence)))) AS evidence, max(rank) AS rank, max(octet_length(encode(text))) AS bytes FROM pairs GROUP BY h)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited, links, evidence = _evidence(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    urgency = F.when(F.col("o_orderpriority") == "1-URGENT", "observed").when(F.col("o_orderpriority") == "2-HIGH", "inferred").otherwise("unresolved")
    records = orders.select(F.lit("chunk").alias("type"), F.col("o_orderkey").alias("id"), F.concat(F.col("o_custkey").cast("string"), F.lit("/"), "o_orderstatus").alias("text"), urgency.alias("classification"))
    return assembly.facts(records, assembly.item_closure(cited, links, evidence), evidence)


@query(f"WITH {_FACTS_SQL} SELECT key, id, array_to_string(evidence, ',') AS evidence, ['observed', 'inferred', 'unresolved'][rank + 1] AS classification, CAST(bytes AS BIGINT) AS bytes FROM facts")
def context_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer in one state are one fact, with the evidence of all of them."""
    return _facts(spark, sf_dir).select("key", "id", _joined("evidence").alias("evidence"), "classification", "bytes")


@query(None)
def context_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of each class in order of their keys, packed with their citations into 20,000 bytes."""
    candidates = _facts(spark, sf_dir).select(F.col("classification").alias("request"), F.lit(0).alias("place"), "key", "evidence", "bytes")
    return assembly.package(candidates, 20_000, 120)


@query(None)
def serialised_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source and language as facts of one request, packed into 20,000 bytes of JSON with 1,000 in reserve; each cites
    its own length, and the label of one that has one."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("request"), "doc_id", "text", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    cites = F.array(F.struct(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), F.col("n_chars").cast("string").alias("record")), F.struct(F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("id"), F.lit("label").alias("record")))
    candidates = docs.select("request", F.lit(0).alias("place"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.coalesce("text", F.lit("")).alias("fact"), F.filter(cites, lambda c: c["id"].isNotNull()).alias("evidence"), F.when(F.col("quality") == 1, "observed").otherwise("inferred").alias("classification"))
    requests = docs.groupBy("request").agg(F.array(F.concat(F.lit("n"), F.min("doc_id").cast("string")), F.lit("q1")).alias("asked")).withColumn("notes", F.array(F.lit("Sources are not verified.")))
    return packing.serialised(requests, candidates, 20_000, 1_000).select("request", "used", "facts", "omitted", F.sha2("package", 256).alias("package_sha256"), "fault")


@query(f"""WITH {_EVIDENCE_SQL}, latest AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS id, l_returnflag AS flag FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) WHERE l_linenumber <= 4 ORDER BY l_orderkey, l_linenumber DESC),
r AS (SELECT o_custkey AS entity, coalesce(flag = 'A', false) AS verified, coalesce(complete, true) AS complete, coalesce(evidence, []) AS evidence FROM orders LEFT JOIN latest ON id = o_orderkey LEFT JOIN items ON item = o_orderkey)
SELECT c_custkey AS entity, count(r.entity) AS records, count(*) FILTER (verified) AS verified, coalesce(bool_and(complete), true) AS complete, CAST(len(list_distinct(coalesce(flatten(list(evidence)), []))) AS BIGINT) AS evidence FROM customer LEFT JOIN r ON r.entity = c_custkey GROUP BY c_custkey""")
def assembled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, the reviews of these as of the fourth, and the evidence of all of them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    reviews = lines.select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("sequence"), F.when(F.col("flag") == "A", "verified").when(F.col("flag") == "R", "rejected").otherwise("pending_review").alias("status"))
    found = assembly.assembled(orders, assembly.item_closure(*_evidence(spark, sf_dir)), reviews, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity")), 4)
    return found.withColumn("evidence", F.size("evidence").cast("long"))


@query("SELECT i.item_id AS doc_id, lang, CASE WHEN d.doc_id IS NULL THEN 'NOT_FOUND' END AS fault FROM (SELECT item_id FROM benchmark UNION SELECT doc_id FROM labels UNION SELECT page_id + 900 FROM pages) i LEFT JOIN documents d ON d.doc_id = i.item_id")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the ids that items, labels and pages ask for; an id that is not there is a fault, not a gap."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).union(table(spark, sf_dir, "labels").select("doc_id")).union(table(spark, sf_dir, "pages").select(F.col("page_id") + 900))
    return assembly.required(asked, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "fault")


@query("""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), k AS (SELECT DISTINCT page_id FROM r WHERE href LIKE '%t%')
SELECT p.page_id, CASE WHEN k.page_id IS NULL THEN 'UNCITED' END AS fault FROM pages p LEFT JOIN k USING (page_id)""")
def uncited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks: one without a link of the kind that counts is uncited."""
    pages = table(spark, sf_dir, "pages")
    cited = pages.where(F.exists(text.links(F.col("html")), lambda h: h.like("%t%"))).select("page_id")
    return assembly.required(pages, cited, "page_id").select("page_id", F.when(F.col("fault").isNotNull(), "UNCITED").alias("fault"))


@query("SELECT doc_id, contains(lower(text), 'that') AND contains(lower(text), 'en') AS holds FROM documents")
def scoped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text holds all words, as parts and in any case."""
    return table(spark, sf_dir, "documents").select("doc_id", text.holds_all(F.col("text"), F.array(F.lit("That"), F.lit("en"))).alias("holds"))


@query("SELECT *, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)) > 100 AS truncated FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 100)")
def truncated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 customers of most orders, and whether there are more; the limit is the feature."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return assembly.page(counts, [F.desc("n"), F.asc("o_custkey")], 100)


def _typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of nations and regions, orders of customers; suppliers in debt belong to no known nation."""
    def edges(name: str, prefix: str, key: str, to: str, column: str, relationship: str, known: str = "true"):
        ident = F.concat(F.lit(prefix), F.col(key).cast("string"))
        target = F.when(F.expr(known), F.concat(F.lit(to), F.col(column).cast("string")))
        return table(spark, sf_dir, name).select(F.concat(ident, F.lit(">"), F.lit(to)).alias("id"), ident.alias("src"), target.alias("dst"), F.lit(relationship).alias("relationship"))

    parts = [edges("customer", "c", "c_custkey", "n", "c_nationkey", "MEMBER_OF"), edges("supplier", "s", "s_suppkey", "n", "s_nationkey", "MEMBER_OF", "s_acctbal >= 0"), edges("orders", "o", "o_orderkey", "c", "o_custkey", "DEPENDS_ON"), edges("nation", "n", "n_nationkey", "r", "n_regionkey", "CONTAINS")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT 's' || s_suppkey || '>n' AS id, 0 AS level, CASE WHEN s_acctbal < 0 THEN 'unresolved' ELSE '' END AS boundary FROM supplier
UNION ALL SELECT 'n' || n_nationkey || '>r', 1, 'traversal_limit' FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal >= 0)""")
def typed_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all suppliers, over membership and containment only, one level on."""
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.traverse(_typed_edges(spark, sf_dir), seeds, 1, "outgoing", ("MEMBER_OF", "CONTAINS"), graph.BEYOND, graph.BEYOND)[0]


@query("""SELECT 'n' || n_nationkey || '>r' AS id, 0 AS level, '' AS boundary FROM nation UNION ALL SELECT 'c' || c_custkey || '>n', 1, 'traversal_limit' FROM customer
UNION ALL SELECT 's' || s_suppkey || '>n', 1, 'traversal_limit' FROM supplier WHERE s_acctbal >= 0""")
def incoming_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leads to the regions, against the direction of the edges; without types, as no type is asked for."""
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.traverse(_typed_edges(spark, sf_dir), seeds, 1, "incoming", (), graph.BEYOND, graph.BEYOND)[0]


def _support(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders rest on the order before; those of customers in debt go round in a circle, and the largest are not there."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.lag("o_orderkey").over(w).alias("before"))
    ends = orders.groupBy("o_custkey").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    circles = ends.join(debtors, "o_custkey", "left_semi").select(F.col("first").alias("src"), F.col("last").alias("dst"))
    links = orders.where("before is not null").select(F.col("node").alias("src"), F.col("before").alias("dst")).unionByName(circles)
    nodes = orders.where("o_totalprice < 480000")
    return nodes, links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS node, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
nodes AS (SELECT * FROM o WHERE o_totalprice < 480000),
links AS (SELECT node AS src, before AS dst FROM o WHERE before IS NOT NULL AND node IN (SELECT node FROM nodes)
UNION SELECT min(node), max(node) FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey HAVING min(node) IN (SELECT node FROM nodes)),
c(root, node) AS (SELECT node, node FROM nodes UNION SELECT c.root, l.dst FROM c JOIN links l ON l.src = c.node),
loops AS (SELECT DISTINCT c.node FROM c JOIN links l ON l.src = c.node WHERE EXISTS (SELECT 1 FROM c d WHERE d.root = l.dst AND d.node = c.node)),
s AS (SELECT c.root, bool_or(c.node IN (SELECT node FROM loops)) AS loop, bool_or(n.node IS NULL) AS lost, bool_or(n.o_orderstatus = 'P') AS barrier, bool_or(n.o_orderpriority = '5-LOW') AS open FROM c LEFT JOIN nodes n ON n.node = c.node GROUP BY c.root)
SELECT root AS node, CASE WHEN loop THEN 'cycle' WHEN lost THEN 'missing' WHEN barrier THEN 'analysis_barrier' WHEN open THEN 'unresolved_reference' ELSE 'supported' END AS state FROM s""")
def support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all that an order rests on supports a conclusion, or what is the first fault."""
    nodes, links = _support(spark, sf_dir)
    return assembly.support_states(nodes, links, {"analysis_barrier": F.col("o_orderstatus") == "P", "unresolved_reference": F.col("o_orderpriority") == "5-LOW"})
