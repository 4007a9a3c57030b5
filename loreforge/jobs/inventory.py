"""Queries of declared and received metadata, bindings of names and descriptions. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import binding, inventory, relational
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query


def _text(column: str):
    return F.col(column).cast("string")


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'UNKNOWN_KIND' WHEN role = 'system' THEN 'INVALID_KEYS' END AS fault, CASE WHEN role = 'user' THEN 2 END AS records FROM conversations""")
def metadata_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes written from turns: users' are sound, assistants' are of no known kind, systems' have a key too many."""
    kind = F.when(F.col("role") == "user", "inventory").when(F.col("role") == "assistant", "notes").otherwise("schema")
    more = F.when(F.col("role") == "system", F.lit(',"extra":1')).otherwise("")
    body = F.concat(F.lit('{"schema_version":"0.1.0","kind":"'), kind, F.lit('","records":["'), _text("turn"), F.lit('",{"a":1}]'), more, F.lit("}"))
    found = inventory.envelopes(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body")))
    return found.select("conv_id", "turn", "fault", F.when(F.col("records").isNotNull(), F.size("records")).alias("records"))


@query("""SELECT lower(url) AS subject, 'DUPLICATE_PATH' AS fault FROM (SELECT url FROM pages UNION ALL SELECT upper(url) FROM pages WHERE html LIKE '%lang="en"%') GROUP BY lower(url) HAVING count(*) > 1
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'UNDECLARED_MEMBER' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which the English ones are declared again in capitals, and orders of customers whom nobody declares."""
    pages = table(spark, sf_dir, "pages")
    declared = pages.select(F.col("url").alias("path")).union(pages.where(F.contains("html", F.lit('lang="en"'))).select(F.upper("url")))
    memberships = table(spark, sf_dir, "orders").select(_text("o_orderkey").alias("application"), _text("o_custkey").alias("member"))
    return inventory.manifest_faults(declared, memberships, table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(_text("c_custkey").alias("member")))


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS path, octet_length(encode(html)) AS size FROM pages),
t AS (SELECT host, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(len(string_split(path, '/'))) AS INTEGER) AS depth, CAST(max(size) AS BIGINT) AS longest FROM p GROUP BY host)
SELECT *, CASE WHEN entries > 12 THEN 'entries_limit' WHEN bytes > 60000 THEN 'bytes_limit' WHEN depth > 2 THEN 'depth_limit' WHEN longest > 9000 THEN 'file_limit' END AS fault FROM t""")
def scan_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as archives of pages, against the bounds of an import."""
    entries = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"), F.octet_length("html").alias("size"))
    return inventory.scan_budget(entries, "host", "path", "size", {"entries": 12, "bytes": 60000, "depth": 2, "file": 9000})


@query("""SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'es' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.lang <> 'es' AND o.text = d.text) THEN 'missing' WHEN lang <> 'es' OR EXISTS (SELECT 1 FROM documents o WHERE o.lang <> 'es' AND o.text = d.text) THEN
CASE WHEN EXISTS (SELECT 1 FROM documents o WHERE o.lang <> 'es' AND o.text = d.text AND o.lang = 'de') THEN 'damaged' ELSE 'ready' END END AS status FROM documents d""")
def sealed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of all documents restored from stored bytes: Spanish ones are gone, and German ones damaged."""
    docs = table(spark, sf_dir, "documents")
    sealed = docs.select(_text("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    stored = docs.where("lang <> 'es'").select(F.sha2("text", 256).alias("sha256"), F.when(F.col("lang") == "de", F.concat("text", F.lit("?"))).otherwise(F.col("text")).cast("binary").alias("content"), (F.col("lang") == "de").alias("bad"))
    return inventory.restored(sealed, stored.groupBy("sha256").agg(F.max_by("content", "bad").alias("content")))


@query("""SELECT o_custkey AS identity, min(o_orderpriority) AS kind, CASE WHEN count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'P') = 1 THEN min(o_orderstatus) FILTER (o_orderstatus <> 'P') ELSE 'unknown' END AS availability,
array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS evidence, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'KIND_CONFLICT' END AS fault FROM orders GROUP BY o_custkey""")
def inventory_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as identities of which each order claims a kind and an availability."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("availability"), F.col("o_orderkey").alias("evidence"))
    return inventory.entities(claims).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH m AS (SELECT n_regionkey AS application, 'n' || n_nationkey AS member, 0 AS level, ['e' || n_nationkey] AS evidence FROM nation
UNION ALL SELECT n_regionkey, 'c' || c_custkey, 1, ['1' || c_custkey, 'e' || n_nationkey] FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, 'o' || o_orderkey, 2, ['1' || c_custkey, '2' || o_orderkey, 'e' || n_nationkey] FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)
SELECT application, member, level, array_to_string(list_sort(evidence), ',') AS evidence, CAST(NULL AS VARCHAR) AS fault FROM m""")
def membership_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as applications of their nations: customers and orders belong to them over calls; suppliers are only contained."""
    nation, customer, orders, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "orders", "supplier"))

    def ident(prefix: str, column: str):
        return F.concat(F.lit(prefix), _text(column))

    def edges(df: DataFrame, number: str, src, key: str, prefix: str, relationship: str):
        return df.select(ident(number, key).alias("id"), src.alias("src"), ident(prefix, key).alias("dst"), F.lit(relationship).alias("relationship"))

    links = edges(customer, "1", ident("n", "c_nationkey"), "c_custkey", "c", "CALLS").unionByName(edges(orders, "2", ident("c", "o_custkey"), "o_orderkey", "o", "READS")).unionByName(edges(supplier, "3", ident("n", "s_nationkey"), "s_suppkey", "s", "CONTAINS"))
    kinds = nation.select(ident("n", "n_nationkey").alias("identity"), F.lit("Program").alias("kind")).union(table(spark, sf_dir, "region").select(ident("r", "r_regionkey"), F.lit("Application")))
    applications = nation.select(F.col("n_regionkey").alias("application"), ident("n", "n_nationkey").alias("member"), ident("e", "n_nationkey").alias("evidence"))
    return inventory.memberships(applications, kinds, links).withColumn("evidence", F.array_join("evidence", ","))


_CALLS_SQL = """calls AS (SELECT p_partkey AS call, CASE WHEN p_size > 45 THEN '&' || p_name WHEN p_size <= 20 THEN p_brand || '/' || p_name ELSE p_name || CASE WHEN p_size > 40 THEN '?' ELSE '' END END AS target FROM part),
programs AS (SELECT p_brand AS library, p_name AS name, list_sort(list(DISTINCT p_type)) AS found FROM part GROUP BY 1, 2)"""


@query(f"""WITH {_CALLS_SQL}, hits AS (SELECT call, target, found, list_position(['Brand#5', 'Brand#11', 'Brand#3', 'Brand#23'], library) AS place FROM calls LEFT JOIN programs ON NOT contains(target, '/') AND name = target AND library IN ('Brand#5', 'Brand#11', 'Brand#3', 'Brand#23')),
f AS (SELECT call, target, coalesce(arg_min(found, place), []) AS found FROM hits WHERE NOT contains(target, '/') GROUP BY call, target
UNION ALL SELECT call, target, coalesce(found, []) FROM calls LEFT JOIN programs ON library || '/' || name = target WHERE contains(target, '/')),
s AS (SELECT call, found, CASE WHEN starts_with(target, '&') THEN 'dynamic' WHEN len(found) = 0 THEN 'missing' WHEN len(found) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM f)
SELECT call, resolution, CASE WHEN resolution = 'resolved' THEN found[1] END AS target, CASE WHEN resolution = 'ambiguous' THEN array_to_string(found, ',') ELSE '' END AS candidates FROM s""")
def static_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of parts by brand and name, by name over a list of brands, or by a variable."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    target = F.when(size > 45, F.concat(F.lit("&"), "p_name")).when(size <= 20, F.concat("p_brand", F.lit("/"), "p_name")).otherwise(F.concat("p_name", F.when(size > 40, "?").otherwise("")))
    calls = part.select(F.col("p_partkey").alias("call"), target.alias("target_text"), F.array(*map(F.lit, ("Brand#5", "Brand#11", "Brand#3", "Brand#23"))).alias("libraries"))
    programs = part.select(F.col("p_brand").alias("library"), F.col("p_name").alias("name"), F.col("p_type").alias("program"))
    return binding.static_calls(calls, programs).withColumn("candidates", F.array_join("candidates", ","))


@query(f"""WITH {_CALLS_SQL}, r AS (SELECT call, CASE WHEN starts_with(target, '&') THEN 'dynamic' WHEN contains(target, '/') THEN 'qualified' ELSE 'listed' END AS status FROM calls)
SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY status""")
def reference_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return inventory.accounting(table(spark, sf_dir, "part").select(F.when(size > 45, "dynamic").when(size <= 20, "qualified").otherwise("listed").alias("status")))


@query("""WITH s AS (SELECT DISTINCT conv_id, 'user' AS scope, 'u' || conv_id AS symbol FROM conversations WHERE role = 'user'), m AS (SELECT DISTINCT conv_id, 'm' || conv_id AS symbol FROM conversations WHERE turn > 4)
SELECT c.conv_id AS artifact, c.turn, coalesce(s.symbol, m.symbol) AS symbol FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.scope = c.role LEFT JOIN m ON m.conv_id = c.conv_id""")
def shadowed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn uses a name: users declare it in their own scope, and longer conversations in the main one."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("artifact"), "turn", F.col("role").alias("scope"), F.lit("topic").alias("name"))
    own = turns.where("scope = 'user'").select("artifact", "scope", "name", F.concat(F.lit("u"), _text("artifact")).alias("symbol"))
    outer = turns.where("turn > 4").select("artifact", F.lit("main").alias("scope"), "name", F.concat(F.lit("m"), _text("artifact")).alias("symbol"))
    return binding.shadowed(turns, own.union(outer).distinct()).select("artifact", "turn", "symbol")


@query("""WITH a AS (SELECT l_orderkey, list({'datatype': l_returnflag, 'dimensions': l_linenumber} ORDER BY l_linenumber, l_returnflag) AS args FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
p AS (SELECT o_orderkey AS call, x.args AS parameters, y.args AS arguments FROM o JOIN a x ON x.l_orderkey = before JOIN a y ON y.l_orderkey = o_orderkey)
SELECT call, CASE WHEN len(parameters) <> len(arguments) THEN 'ARGUMENT_COUNT' WHEN parameters <> arguments THEN 'ARGUMENT_TYPE' END AS fault FROM p""")
def signature_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as arguments for those of the customer's order before."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    of = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(lines, lambda x: F.struct(x["l_returnflag"].alias("datatype"), x["l_linenumber"].alias("dimensions"))).alias("args"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.lag("o_orderkey").over(w).alias("before")).where("before is not null")
    both = calls.join(of.select(F.col("l_orderkey").alias("before"), F.col("args").alias("parameters")), "before").join(of.select(F.col("l_orderkey").alias("call"), F.col("args").alias("arguments")), "call")
    return both.select("call", binding.signature_fault(F.col("parameters"), F.col("arguments")).alias("fault"))


@query("""WITH f AS (SELECT o_custkey AS artifact, o_orderpriority AS file, o_orderstatus AS record, list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR))) AS fmt FROM orders GROUP BY ALL),
ff AS (SELECT o_custkey AS artifact, o_orderpriority AS name, list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR))) AS fmt FROM orders GROUP BY 1, 2), fr AS (SELECT o_custkey AS artifact, o_orderstatus AS name, list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR))) AS fmt FROM orders GROUP BY 1, 2),
op AS (SELECT event_id AS operation, user_id AS artifact, event_type IN ('view', 'click') AS is_read, CASE event_type WHEN 'view' THEN '1-URGENT' WHEN 'click' THEN '5-LOW' WHEN 'purchase' THEN 'F' WHEN 'error' THEN 'O' ELSE 'X' END AS name FROM events),
s AS (SELECT operation, coalesce(ff.fmt, fr.fmt, []) AS fmt FROM op LEFT JOIN ff ON is_read AND ff.artifact = op.artifact AND ff.name = op.name LEFT JOIN fr ON NOT is_read AND fr.artifact = op.artifact AND fr.name = op.name)
SELECT operation, CASE len(fmt) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN len(fmt) = 1 THEN fmt[1] END AS target, CASE WHEN len(fmt) > 1 THEN array_to_string(fmt, ',') ELSE '' END AS candidates FROM s""")
def record_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on the records that a customer's orders declare."""
    kind = F.col("event_type")
    name = F.when(kind == "view", "1-URGENT").when(kind == "click", "5-LOW").when(kind == "purchase", "F").when(kind == "error", "O").otherwise("X")
    operations = table(spark, sf_dir, "events").select(F.col("event_id").alias("operation"), F.col("user_id").alias("artifact"), F.when(kind.isin("view", "click"), "read").otherwise("write").alias("action"), name.alias("name"))
    formats = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact"), F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("record"), _text("o_orderkey").alias("format"))
    return binding.record_formats(operations, formats).withColumn("candidates", F.array_join("candidates", ","))


@query("""WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS field, p_brand, p_type, p_name, CASE WHEN p_size <= 25 THEN p_type END AS datatype, CASE WHEN p_size <= 40 THEN p_size END AS length, min(p_name) OVER (PARTITION BY p_brand, p_type) AS ref FROM part),
t AS (SELECT p_brand, p_type, p_name, list_sort(list(field)) AS found FROM f GROUP BY ALL),
b AS (SELECT f.field, CASE len(found) WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN len(found) = 1 THEN found[1] END AS target FROM f JOIN t ON t.p_brand = f.p_brand AND t.p_type = f.p_type AND t.p_name = f.ref WHERE f.datatype IS NULL)
SELECT f.field, coalesce(resolution, 'none') AS resolution, b.target, coalesce(f.datatype, s.datatype) AS datatype, coalesce(f.length, s.length) AS length FROM f LEFT JOIN b USING (field) LEFT JOIN f s ON s.field = b.target""")
def inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fields: those of larger sizes take their type and length from the first name of their brand and kind."""
    first = F.min("p_name").over(Window.partitionBy("p_brand", "p_type"))
    own = F.when(F.col("p_size") <= 25, F.col("p_type"))
    fields = table(spark, sf_dir, "part").select(_text("p_partkey").alias("field"), F.col("p_brand").alias("library"), F.col("p_type").alias("file"), F.col("p_name").alias("name"), own.alias("datatype"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("length"), F.when(own.isNull(), F.col("p_type")).alias("ref_file"), F.when(own.isNull(), first).alias("ref_name"))
    return binding.related_fields(fields)


@query("SELECT n_nationkey, n_regionkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) = 'building'")
def caseless_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and segment, whatever the case of the segment's name."""
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", F.lit("Building").alias("segment"))
    found = binding.same_name(wanted, table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("segment")), ["c_nationkey"], "segment")
    return found.select(F.col("c_nationkey").alias("n_nationkey"), "n_regionkey", "c_custkey")


@query("SELECT c_custkey AS owner, coalesce(['O', 'F', 'P'][max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END)], 'none') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def spread_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer has the worst status of all their orders."""
    orders = table(spark, sf_dir, "orders")
    owned = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner")).join(orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("member")), "owner", "left")
    return binding.spread_status(owned, orders.select(F.col("o_orderkey").alias("member"), F.col("o_orderstatus").alias("status")), ["O", "F", "P"], "none")


@query("SELECT user_id AS subject, event_type AS code, props AS message, count(*) AS n FROM events GROUP BY ALL")
def diagnostics_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.one_of_each(table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("code"), F.col("props").alias("message")))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'programs' WHEN p_type = 'LARGE' THEN 'files' ELSE 'other' END AS category FROM part")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", inventory.category(F.col("p_type"), {"programs": ("ECONOMY", "SMALL"), "files": ("LARGE",)}, "other").alias("category"))


@query("""WITH c AS (SELECT lower(c_mktsegment) AS name, min(c_custkey) AS least FROM customer GROUP BY 1), a AS (SELECT a.c_custkey FROM customer a JOIN c ON c.least = a.c_custkey)
SELECT o_custkey, o_orderkey, s.s_suppkey FROM orders JOIN a ON a.c_custkey = o_custkey LEFT JOIN supplier s ON s.s_suppkey = o_orderkey""")
def run_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by two keys and their members, with what of them a third table knows."""
    first = table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(first.select("o_custkey"), "o_custkey", "left_semi")
    return orders.join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("s_suppkey") == F.col("o_orderkey"), "left").select("o_custkey", "o_orderkey", "s_suppkey")


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope of each customer: a claim of the customer, and a reference for each order to a part by its name."""
    part, items, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    first = items.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    lines = orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(part, "p_partkey")
    target = F.struct(F.lit("Part").alias("kind"), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("name"), (F.col("o_orderstatus") == "P").alias("dynamic"))
    reference = F.to_json(F.struct(F.lit("reference").alias("record_type"), F.concat(F.lit("o"), _text("o_orderkey")).alias("from_identity"), F.lit("READS").alias("relationship"), target.alias("target")))
    claims = part.select(F.lit("parts").alias("evidence"), F.to_json(F.struct(F.lit("entity").alias("record_type"), F.concat("p_brand", F.lit("/p"), F.floor(F.col("p_partkey") / F.when(F.col("p_size") > 25, 2).otherwise(3)).cast("string")).alias("identity"), F.lit("Part").alias("kind"), F.col("p_type").alias("availability"))).alias("record"))
    rows = lines.select(F.concat(F.lit("c"), _text("o_custkey")).alias("evidence"), reference.alias("record")).union(claims)
    body = F.to_json(F.struct(F.lit("0.1.0").alias("schema_version"), F.lit("inventory").alias("kind"), F.array_sort(F.collect_list("record")).alias("records")))
    return rows.groupBy("evidence").agg(body.alias("body"))


_OFFLINE_SQL = """e AS (SELECT DISTINCT p_brand || '/p' || (p_partkey // CASE WHEN p_size > 25 THEN 2 ELSE 3 END) AS identity, p_type FROM part),
n AS (SELECT identity, split_part(identity, '/', 2) AS name, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'unknown' END AS availability FROM e GROUP BY identity)"""


@query(f"""WITH {_OFFLINE_SQL}, t AS (SELECT name, count(*) AS n, min(identity) AS one FROM n GROUP BY name),
r AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'P' AS dynamic, 'p' || (min(l_partkey) // 2) AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
s AS (SELECT r.*, CASE WHEN dynamic THEN 'dynamic' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, one FROM r LEFT JOIN t USING (name))
SELECT 'o' || o_orderkey AS src, 'READS' AS relationship, resolution, CASE WHEN resolution = 'resolved' THEN one END AS dst, 'c' || o_custkey AS evidence FROM s""")
def offline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the envelopes of all customers give."""
    return inventory.offline(_envelopes(spark, sf_dir))[1]


@query(f"WITH {_OFFLINE_SQL} SELECT identity, 'Part' AS kind, availability, 'parts' AS evidence FROM n")
def offline_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that the envelope of the parts claims."""
    found = inventory.offline(_envelopes(spark, sf_dir))[0]
    return found.select("identity", "kind", "availability", F.array_join("evidence", ",").alias("evidence"))
