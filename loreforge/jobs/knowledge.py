"""Queries of records, reviews, revisions and references. Each stands beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, relational
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src0' AND lang IN ('en', 'de')")
def scan_filter_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.scoped(table(spark, sf_dir, "documents"), "src0", "source")
    return rows.where(F.col("lang").isin("en", "de")).select("doc_id", "lang", "n_chars")


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) ORDER BY user_id, event_id DESC")
def latest_as_of_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of the first half of all."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    watermark = events.agg(F.max("event_id")).first()[0] or 0
    return relational.latest_as_of(events, ["user_id"], "event_id", watermark // 2)


@query("""SELECT d.doc_id, d.source, coalesce(CASE l.quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' END, 'pending_review') AS status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").alias("status"))
    return relational.overlay(table(spark, sf_dir, "documents").select("doc_id", "source"), reviews, "doc_id", "status")


@query("""SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS orders, count(*) AS n FROM orders GROUP BY o_custkey""")
def ordered_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"), F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_totalprice > 100000)), ','), '') AS large_orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def optional_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links are gathered before the join, so that a customer without any keeps an empty list."""
    links = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("links"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(links, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.array_join("links", ","), F.lit("")).alias("large_orders"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def json_path_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("""SELECT c.c_custkey, o.last_order, o.n FROM customer c LEFT JOIN
(SELECT o_custkey, max(o_orderdate) AS last_order, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
ORDER BY o.last_order DESC NULLS LAST, c.c_custkey LIMIT 100""")
def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the most recently active; the limit is the feature."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "last_order", "n").orderBy(F.desc_nulls_last("last_order"), "c_custkey").limit(100)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey")
def newest_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


_CHAIN_SQL = "(SELECT o_orderkey AS id, o_custkey AS subject, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a chain of revisions."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.lag("o_orderkey").over(w).alias("previous"))


@query(f"SELECT r.subject, r.id AS head FROM {_CHAIN_SQL} r WHERE NOT EXISTS (SELECT 1 FROM {_CHAIN_SQL} p WHERE p.previous = r.id)")
def revision_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.heads(_revisions(spark, sf_dir), "id", "previous").select("subject", F.col("id").alias("head"))


@query(f"""WITH h AS (SELECT r.subject, r.id AS head FROM {_CHAIN_SQL} r WHERE NOT EXISTS (SELECT 1 FROM {_CHAIN_SQL} p WHERE p.previous = r.id)),
p AS (SELECT c_custkey AS subject, CASE WHEN c_nationkey % 2 = 0 THEN head END AS expected FROM customer LEFT JOIN h ON h.subject = c_custkey)
SELECT p.subject, p.expected, p.expected IS NOT DISTINCT FROM h.head AS accepted FROM p LEFT JOIN h USING (subject)""")
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = revision_heads(spark, sf_dir)
    joined = table(spark, sf_dir, "customer").join(heads, F.col("c_custkey") == F.col("subject"), "left")
    proposals = joined.select(F.col("c_custkey").alias("subject"), F.when(F.col("c_nationkey") % 2 == 0, F.col("head")).alias("expected"))
    return relational.compared_and_set(proposals, heads, "subject", "expected", "head")


@query("""WITH old AS (SELECT doc_id, sha256(text) AS payload FROM documents WHERE lang <> 'fr'),
new AS (SELECT doc_id, CASE WHEN source = 'src3' THEN sha256(text || '!') ELSE sha256(text) END AS payload FROM documents)
SELECT new.doc_id, CASE WHEN old.doc_id IS NULL THEN 'insert' WHEN old.payload = new.payload THEN 'same' ELSE 'conflict' END AS outcome FROM new LEFT JOIN old USING (doc_id)""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("payload"))
    new = docs.select("doc_id", F.when(F.col("source") == "src3", F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("payload"))
    return relational.appended(old, new, "doc_id", "payload").select("doc_id", "outcome")


@query("""SELECT 'supplier' AS kind, count(*) AS missing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def snapshot_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    out = None
    for kind, rows, column, target, key in (("supplier", items, "l_suppkey", "supplier", "s_suppkey"), ("part", items, "l_partkey", "part", "p_partkey"), ("order", items, "l_orderkey", "orders", "o_orderkey"), ("customer", orders, "o_custkey", "customer", "c_custkey")):
        n = relational.dangling(rows.select(column), column, table(spark, sf_dir, target), key).agg(F.count("*").alias("missing")).select(F.lit(kind).alias("kind"), "missing")
        out = n if out is None else out.unionByName(n)
    return out


_REFS_SQL = "(SELECT p_partkey AS ref, CASE WHEN p_size % 3 = 0 THEN p_brand END AS library, CASE WHEN p_size % 7 = 0 THEN p_name || '?' ELSE p_name END AS name, p_size % 10 = 0 AS dynamic FROM part)"


@query(f"""WITH e AS (SELECT DISTINCT p_brand AS library, p_name AS name FROM part), r AS (SELECT * FROM {_REFS_SQL}),
m AS (SELECT r.ref, r.dynamic, count(e.name) AS n, coalesce(string_agg(e.library, ',' ORDER BY e.library), '') AS libs, min(e.library) AS one
FROM r LEFT JOIN e ON e.name = r.name AND (r.library IS NULL OR e.library = r.library) GROUP BY r.ref, r.dynamic),
s AS (SELECT *, CASE WHEN dynamic THEN 'dynamic' WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM m)
SELECT ref, resolution, CASE WHEN resolution = 'ambiguous' THEN libs ELSE '' END AS candidates, CASE WHEN resolution = 'resolved' THEN one END AS target FROM s""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size")
    refs = parts.select(F.col("p_partkey").alias("ref"), F.when(size % 3 == 0, F.col("p_brand")).alias("library"), F.when(size % 7 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"), (size % 10 == 0).alias("dynamic"))
    return relational.resolve(refs, parts.select(F.col("p_brand").alias("library"), F.col("p_name").alias("name")))


@query("""WITH l AS (SELECT p_name, p_brand, count(*) AS n, min(list_position(['Brand#55', 'Brand#11', 'Brand#34', 'Brand#23'], p_brand)) AS r FROM part
WHERE p_brand IN ('Brand#55', 'Brand#11', 'Brand#34', 'Brand#23') GROUP BY 1, 2)
SELECT p_name, arg_min(p_brand, r) AS p_brand, CASE WHEN arg_min(n, r) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM l GROUP BY p_name""")
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.best_ranked(table(spark, sf_dir, "part"), "p_name", "p_brand", ["Brand#55", "Brand#11", "Brand#34", "Brand#23"])


@query("SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS ordinal FROM (SELECT conv_id, role, turn FROM conversations)")
def ordinal_in_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ordinal(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_role, coalesce(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) = 1, false) AS adjacent FROM conversations")
def prior_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("prior_role"), F.coalesce(F.col("turn") - F.lag("turn").over(w) == 1, F.lit(False)).alias("adjacent"))


@query("""SELECT e.event_id, s.event_id AS scope_id FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup'
AND epoch_us(e.ts) >= epoch_us(s.ts) AND epoch_us(e.ts) < epoch_us(s.ts) + 3600000000""")
def guard_scope_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hour = 3_600_000_000
    scopes = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("scope_id"), F.col("at").alias("start"), (F.col("at") + hour).alias("stop"))
    return intervals.containing(events.drop("event_type"), scopes, "user_id", "at", "start", "stop", hour).select("event_id", "scope_id")


@query("""WITH s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + 600000000 * (1 + event_id % 3) AS b FROM events)
SELECT x.event_id AS left_id, y.event_id AS right_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type = 'view' AND y.event_type = 'purchase' AND x.a < y.b AND y.a < x.b""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("a"), (at + 600_000_000 * (1 + F.col("event_id") % 3)).alias("b"))
    views = spans.where("event_type = 'view'").select("user_id", F.col("event_id").alias("left_id"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    buys = spans.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("right_id"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return intervals.overlapping(views, buys, "user_id", ("a1", "b1"), ("a2", "b2"), 1_800_000_000).select("left_id", "right_id")


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, coalesce(bool_or(toxic = 1), false) AS any_toxic,
array_to_string(list_sort(list(DISTINCT lang) FILTER (toxic = 1)), ',') AS toxic_langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    toxic = F.col("toxic") == 1
    langs = F.array_sort(F.collect_set(F.when(toxic, F.col("lang"))))
    return joined.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"),
        F.coalesce(F.bool_or(toxic), F.lit(False)).alias("any_toxic"), F.when(F.size(langs) > 0, F.array_join(langs, ",")).alias("toxic_langs"),
    )


@query("SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'unknown' END AS lang FROM (SELECT source || '-' || (doc_id // 2) AS source, lang FROM documents) GROUP BY source")
def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("source"), "lang")
    return claims.groupBy("source").agg(relational.merged_claim(F.collect_set("lang"), "unknown").alias("lang"))


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_returnflag").alias("flags")).where("flags > 1")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') OR c_custkey IN (SELECT s_suppkey FROM supplier)""")
def reachable_by_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    return relational.any_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", [(big, "o_custkey"), (failed, "user_id"), (table(spark, sf_dir, "supplier"), "s_suppkey")])


@query("""SELECT path, CASE WHEN d IS NULL THEN 'undeclared' WHEN r IS NULL THEN 'missing' ELSE 'ready' END AS status FROM
(SELECT DISTINCT doc_id AS path, 1 AS d FROM documents WHERE lang <> 'es') FULL JOIN (SELECT DISTINCT doc_id AS path, 1 AS r FROM labels) USING (path)""")
def import_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("path"))
    return relational.prepared(declared, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")), "path")


@query("""SELECT text_hash, min(doc_id) AS least_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS evidence,
CASE max(CASE quality WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) WHEN 0 THEN 'observed' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS classification
FROM (SELECT sha256(text) AS text_hash, doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY text_hash""")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal chunks merge: all evidence, the weakest classification, the least id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_hash")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rank = F.max(F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2))
    return rows.groupBy("text_hash").agg(
        F.min("doc_id").alias("least_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("evidence"),
        F.element_at(F.array(F.lit("observed"), F.lit("inferred"), F.lit("unresolved")), rank + 1).alias("classification"),
    )


@query("""SELECT o_custkey, sha256('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']') AS fingerprint FROM orders GROUP BY o_custkey""")
def list_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a sorted list in canonical JSON; integers need no escapes, so the JVM can write it."""
    json = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ","), F.lit("]"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(json, 256).alias("fingerprint"))


@query("""SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS versions, len(list_filter(list(DISTINCT source), lambda x: x NOT IN ('src0', 'src1', 'src2'))) = 0 AS compatible FROM documents GROUP BY lang""")
def version_negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.collect_set("source")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(found), ",").alias("versions"), (F.size(F.array_except(found, F.array(*map(F.lit, ("src0", "src1", "src2"))))) == 0).alias("compatible"))


@query("""SELECT kind, id, min(label) AS label FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'customer', o_custkey, NULL FROM orders) GROUP BY kind, id""")
def record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all kinds in one stream, one of each (kind, id)."""
    parts = [("customer", "customer", "c_custkey", F.col("c_name")), ("supplier", "supplier", "s_suppkey", F.col("s_name")), ("part", "part", "p_partkey", F.col("p_name")), ("customer", "orders", "o_custkey", F.lit(None).cast("string"))]
    views = [table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), label.alias("label")) for kind, name, key, label in parts]
    both = views[0]
    for view in views[1:]:
        both = both.unionByName(view)
    return both.groupBy("kind", "id").agg(F.min("label").alias("label"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    counts = items.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first"), F.count_if(F.col("b") & ~F.col("a")).alias("second"))
    return counts.unpivot([], ["both", "first", "second"], "part", "n")


@query("""SELECT conv_id, array_to_string(list(CASE WHEN role = 'system' THEN 'policy' ELSE role END ORDER BY turn), '>') AS members FROM conversations GROUP BY conv_id""")
def manifest_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: F.when(r["role"] == "system", "policy").otherwise(r["role"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(roles, ">").alias("members"))
