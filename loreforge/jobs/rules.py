"""Queries of control structures, slices, lineages, includes and reviews. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import assembly, flow, structure, writers
from ..sources.tables import table
from .registry import Registry
from .retrieval import _FLOW_SQL, _conversation_flow

R = Registry()
QUERIES, SQL, query = R.queries, R.sql, R.query

_STATEMENTS_SQL = """ranked AS (SELECT l_orderkey AS artifact, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS node, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS flag, l_quantity AS q FROM lineitem),
opened AS (SELECT artifact, node, n, flag = 'R' AS looped FROM ranked WHERE node <= n // 2),
held AS (SELECT r.artifact, r.node, o.node AS head, o.looped, r.n % 2 = 1 AND r.node = r.n // 2 + 1 AND NOT (SELECT looped FROM opened i WHERE i.artifact = r.artifact AND i.node = r.n // 2) AS arm, o.node = r.n // 2 AS inmost FROM ranked r JOIN opened o ON o.artifact = r.artifact AND o.node < r.node AND r.node < r.n + 1 - o.node)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as nested statements: the first half opens structures, the second half ends them inside out, and
    a line in the middle is the other arm of an if. Returned lines are loops."""
    w = Window.partitionBy("l_orderkey")
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact"), F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("node"), F.count("*").over(w).alias("n"), F.col("l_returnflag").alias("flag"))
    mirror = ranked.select("artifact", (F.col("n") + 1 - F.col("node")).alias("node"), F.col("flag").alias("opener"))
    both = ranked.join(mirror, ["artifact", "node"])
    half = F.floor(F.col("n") / 2)
    kind = F.when(F.col("node") <= half, F.when(F.col("flag") == "R", "dow").otherwise("if")).when(F.col("node") > F.col("n") - half, F.when(F.col("opener") == "R", "enddo").otherwise("endif")).otherwise("middle")
    inner = ranked.where(F.col("node") == half).select("artifact", F.col("flag").alias("inner"))
    middle = F.when(kind != "middle", kind).when(F.coalesce("inner", F.lit("R")) == "R", "assign").otherwise("else")
    return both.join(inner, "artifact", "left").select("artifact", "node", middle.alias("kind"))


@query(f"""WITH {_STATEMENTS_SQL} SELECT artifact, node, head, CASE WHEN looped THEN 'limited' WHEN arm AND inmost THEN 'false' ELSE 'true' END AS polarity FROM held""")
def structured_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.guards(_statements(spark, sf_dir), 4)


@query(f"""WITH {_STATEMENTS_SQL} SELECT artifact, node AS open, n + 1 - node AS close, CASE WHEN looped THEN 'loop' ELSE 'if' END AS frame, node - 1 AS depth, CAST(NULL AS VARCHAR) AS fault FROM opened""")
def control_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.frames(_statements(spark, sf_dir))


@query(f"""WITH RECURSIVE {_FLOW_SQL}, a(artifact, avoided, node) AS (SELECT n.artifact, m.node, 0 FROM n JOIN n m ON m.artifact = n.artifact WHERE n.node = 0 AND m.node <> 0
UNION SELECT a.artifact, a.avoided, e.dst FROM a JOIN e ON e.artifact = a.artifact AND e.src = a.node WHERE e.dst <> a.avoided),
d AS (SELECT n.artifact, n.node, m.node AS dominator FROM n JOIN n m ON m.artifact = n.artifact AND m.node <> n.node WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.artifact = n.artifact AND a.avoided = m.node AND a.node = n.node)),
h AS (SELECT artifact, src AS head FROM e GROUP BY 1, 2 HAVING count(DISTINCT dst) > 1),
w(artifact, head, arm, node) AS (SELECT e.artifact, h.head, e.dst, e.dst FROM h JOIN e ON e.artifact = h.artifact AND e.src = h.head
UNION SELECT w.artifact, w.head, w.arm, e.dst FROM w JOIN e ON e.artifact = w.artifact AND e.src = w.node WHERE w.node <> w.head)
SELECT d.artifact, d.node, d.dominator AS head, min(w.arm) AS arm FROM d JOIN n c ON c.artifact = d.artifact AND c.node = d.node AND c.defines = 'assistant' JOIN w ON w.artifact = d.artifact AND w.head = d.dominator AND w.node = d.node GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which arms of which branches the turns of assistants come."""
    nodes, edges, entries = _conversation_flow(spark, sf_dir)
    candidates = nodes.where(F.array_contains("defines", "assistant")).select("artifact", "node")
    return flow.arm_conditions(edges, entries, candidates)


@query(f"""WITH RECURSIVE {_FLOW_SQL}, r(artifact, node, variable, definition) AS (
SELECT v.artifact, 0, v.variable, -1 FROM v JOIN n ON n.artifact = v.artifact AND n.node = 0
UNION SELECT e.artifact, e.dst, n.defines, n.node FROM n JOIN e ON e.artifact = n.artifact AND e.src = n.node WHERE NOT n.barrier AND n.defines <> 'system'
UNION SELECT e.artifact, e.dst, v.variable, -1 FROM n JOIN e ON e.artifact = n.artifact AND e.src = n.node JOIN v ON v.artifact = n.artifact WHERE n.barrier
UNION SELECT e.artifact, e.dst, r.variable, r.definition FROM r JOIN n ON n.artifact = r.artifact AND n.node = r.node JOIN e ON e.artifact = n.artifact AND e.src = n.node WHERE NOT n.barrier AND n.defines <> r.variable),
u AS (SELECT n.artifact, n.node, v.variable, list(DISTINCT r.definition) FILTER (r.definition >= 0) AS defs, count(r.definition) FILTER (r.definition >= 0) > 0 AND count(*) FILTER (r.definition = -1) = 0 AS definite
FROM n JOIN v ON v.artifact = n.artifact LEFT JOIN r ON r.artifact = n.artifact AND r.node = n.node AND r.variable = v.variable GROUP BY n.artifact, n.node, v.variable),
s(artifact, node, member) AS (SELECT DISTINCT artifact, node, node FROM u UNION SELECT s.artifact, s.node, d.def FROM s JOIN (SELECT artifact, node, unnest(defs) AS def FROM u) d ON d.artifact = s.artifact AND d.node = s.member)
SELECT s.artifact, s.node, count(DISTINCT s.member) AS members, CASE max(CASE WHEN n.barrier OR x.weak THEN 2 WHEN n.defines = 'user' AND n.node > 5 THEN 1 ELSE 0 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'unresolved' ELSE 'supported' END AS state
FROM s JOIN n ON n.artifact = s.artifact AND n.node = s.member JOIN (SELECT artifact, node, bool_or(NOT definite) AS weak FROM u GROUP BY 1, 2) x ON x.artifact = s.artifact AND x.node = s.member GROUP BY s.artifact, s.node""")
def claim_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn rests on: later user turns refer to what is not resolved."""
    nodes, edges, entries = _conversation_flow(spark, sf_dir)
    found = flow.reaching(nodes, edges, entries)
    references = nodes.where(F.array_contains("defines", "user") & (F.col("node") > 5)).select("artifact", "node", F.lit("missing").alias("resolution"))
    return structure.slices(found, nodes.where("barrier").select("artifact", "node"), references)


# Each line of an order is a block of statements by its flag and status; the order ends with a write. Symbols are v0 to v2.
_BLOCKS = {
    "RO": (("if", "assign", "else", "assign", "endif"), ((0, 1), (0, 2), (1, 4), (2, 3), (3, 4))),
    "RF": (("if", "assign", "elseif", "update", "endif"), ((0, 1), (0, 2), (1, 4), (2, 3), (2, 4), (3, 4))),
    "AF": (("dow", "update", "enddo"), ((0, 1), (1, 2), (2, 0))),
    "AO": (("assign",), ()),
    "NO": (("assign",), ()),
    "NF": (("if", "return", "endif"), ((0, 1), (0, 2))),
}
_BLOCK_KINDS = ", ".join(f"('{b}', {k}, '{kind}')" for b, (kinds, _) in _BLOCKS.items() for k, kind in enumerate(kinds))
_BLOCK_EDGES = ", ".join(f"('{b}', {x}, {y})" for b, (_, edges) in _BLOCKS.items() for x, y in edges)
_BLOCK_ENDS = ", ".join(f"('{b}', {len(kinds) - 1})" for b, (kinds, _) in _BLOCKS.items())
_PROGRAM_SQL = f"""l AS (SELECT l_orderkey AS artifact, 10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_returnflag || l_linestatus AS block, l_partkey % 3 AS p, l_suppkey % 3 AS s, l_orderkey % 3 AS o, l_tax, l_discount, l_quantity FROM lineitem),
e0 AS (SELECT artifact, max(pos) + 10 AS pos FROM l GROUP BY artifact),
st AS (SELECT artifact, pos + k AS node, kind, 'main' AS scope, l.* EXCLUDE (artifact, pos), k FROM l JOIN (VALUES {_BLOCK_KINDS}) AS b(block, k, kind) USING (block)
UNION ALL SELECT artifact, pos, 'write', 'main', '', 0, 0, artifact % 3, 0, 0, 0, 0 FROM e0),
ed AS (SELECT artifact, pos + x AS src, pos + y AS dst FROM l JOIN (VALUES {_BLOCK_EDGES}) AS b(block, x, y) USING (block)
UNION ALL SELECT artifact, pos + k, pos + 10 FROM l JOIN (VALUES {_BLOCK_ENDS}) AS b(block, k) USING (block)),
ef AS (SELECT artifact, node, kind,
  CASE kind WHEN 'if' THEN ['v' || o] WHEN 'elseif' THEN ['v' || p] WHEN 'dow' THEN ['v' || o] WHEN 'update' THEN ['v' || p] WHEN 'write' THEN ['v' || o, 'v2'] WHEN 'assign' THEN (CASE WHEN k = 3 AND l_quantity > 45 THEN ['unresolved:' || p] ELSE ['v' || s] END) ELSE [] END AS reads,
  CASE kind WHEN 'assign' THEN ['v' || p] WHEN 'update' THEN ['v' || s] ELSE [] END AS writes, kind = 'update' AND l_tax > 0.06 AS unknown FROM st),
rf AS (SELECT artifact, node FROM st WHERE kind = 'if' AND l_discount > 0.08),
dg AS (SELECT artifact, node, 'DECIMAL_OVERFLOW' AS code FROM st WHERE kind = 'assign' AND l_quantity < 3),
g AS (SELECT l.artifact, pos + n AS node, pos + h AS head, pol AS polarity FROM l JOIN (VALUES ('RO', 1, 0, 'true'), ('RO', 2, 0, 'false'), ('RO', 3, 0, 'false'), ('RF', 1, 0, 'true'), ('RF', 2, 0, 'false'), ('RF', 2, 2, 'true'), ('RF', 3, 0, 'false'), ('RF', 3, 2, 'true'), ('AF', 1, 0, 'limited'), ('NF', 1, 0, 'true')) AS b(block, n, h, pol) USING (block))"""


def _programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Statements, edges, effects, references and blocking diagnostics of the orders as programs."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    name = lambda c: F.concat(F.lit("v"), F.pmod(F.col(c), F.lit(3)).cast("string"))
    lines = cut(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact"), (10 * F.row_number().over(w)).cast("long").alias("at"), F.concat("l_returnflag", "l_linestatus").alias("block"), name("l_partkey").alias("p"), name("l_suppkey").alias("s"), name("l_orderkey").alias("o"), "l_tax", "l_discount", "l_quantity"))  # read by all that follows
    per_block = lambda rows: F.explode(F.element_at(F.create_map(*[x for b, v in _BLOCKS.items() for x in (F.lit(b), F.array(*[F.struct(*r) for r in rows(*v)]))]), F.col("block")))
    kinds = per_block(lambda kinds, _: [(F.lit(k).alias("k"), F.lit(kind).alias("kind")) for k, kind in enumerate(kinds)])
    links = per_block(lambda kinds, edges: [(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in (*edges, (len(kinds) - 1, 10))])
    last = lines.groupBy("artifact").agg((F.max("at") + 10).alias("node"), F.max("o").alias("o"))
    st = lines.select("*", kinds.alias("b")).select("artifact", (F.col("at") + F.col("b.k")).alias("node"), F.col("b.kind").alias("kind"), F.col("b.k").alias("k"), "p", "s", "o", "l_tax", "l_discount", "l_quantity")
    st = st.unionByName(last.select("artifact", "node", F.lit("write").alias("kind"), "o"), allowMissingColumns=True).withColumn("scope", F.lit("main"))
    edges = lines.select("artifact", "at", links.alias("b")).select("artifact", (F.col("at") + F.col("b.x")).alias("src"), (F.col("at") + F.col("b.y")).alias("dst"))
    kind, none = F.col("kind"), F.array().cast("array<string>")
    spelt = F.when((F.col("k") == 3) & (F.col("l_quantity") > 45), F.concat(F.lit("unresolved:"), F.substring("p", 2, 1))).otherwise(F.col("s"))
    reads = F.when(kind.isin("if", "dow"), F.array("o")).when(kind.isin("elseif", "update"), F.array("p")).when(kind == "write", F.array("o", F.lit("v2"))).when(kind == "assign", F.array(spelt)).otherwise(none)
    writes = F.when(kind == "assign", F.array("p")).when(kind == "update", F.array("s")).otherwise(none)
    effects = st.select("artifact", "node", reads.alias("reads"), writes.alias("writes"), ((kind == "update") & (F.col("l_tax") > 0.06)).alias("unknown"))
    references = st.where("kind = 'if' and l_discount > 0.08").select("artifact", "node", F.lit("missing").alias("resolution"))
    diagnostics = st.where("kind = 'assign' and l_quantity < 3").select("artifact", "node", F.lit("DECIMAL_OVERFLOW").alias("code"))
    return st.select("artifact", "node", "kind", "scope"), edges, effects, references, diagnostics


_SLICES_SQL = f"""{_PROGRAM_SQL},
c AS (SELECT artifact, node AS use FROM st WHERE kind IN ('assign', 'update', 'write')),
s0 AS (SELECT artifact, use, use AS member FROM c UNION SELECT c.artifact, use, head FROM c JOIN g ON g.artifact = c.artifact AND g.node = use),
r(artifact, use, member) AS (SELECT * FROM s0 UNION SELECT r.artifact, use, src FROM r JOIN ed ON ed.artifact = r.artifact AND dst = member),
may AS (SELECT * FROM (SELECT * FROM r EXCEPT SELECT * FROM s0) x WHERE NOT EXISTS (SELECT 1 FROM g a JOIN g b ON b.artifact = a.artifact AND b.head = a.head AND b.polarity <> a.polarity WHERE a.artifact = x.artifact AND a.node = x.use AND b.node = x.member)),
rd AS (SELECT artifact, node, unnest(reads) AS symbol FROM ef), wr AS (SELECT artifact, node, unnest(writes) AS symbol FROM ef),
asking AS (SELECT DISTINCT s0.artifact, use FROM s0 JOIN rd ON rd.artifact = s0.artifact AND rd.node = member),
m(artifact, use, member, below) AS (SELECT artifact, use, member, 1000000 FROM s0
UNION SELECT may.artifact, may.use, member, member FROM may JOIN ef ON ef.artifact = may.artifact AND ef.node = member AND unknown JOIN asking ON asking.artifact = may.artifact AND asking.use = may.use
UNION SELECT m.artifact, m.use, may.member, may.member FROM m JOIN rd ON rd.artifact = m.artifact AND rd.node = m.member JOIN wr ON wr.artifact = m.artifact AND wr.symbol = rd.symbol JOIN may ON may.artifact = m.artifact AND may.use = m.use AND may.member = wr.node AND may.member < m.below),
mm AS (SELECT DISTINCT artifact, use, member FROM m),
codes AS (SELECT mm.artifact, use, 'UNKNOWN_EFFECT' AS code FROM mm JOIN ef ON ef.artifact = mm.artifact AND ef.node = member AND unknown
UNION SELECT mm.artifact, use, code FROM mm JOIN dg ON dg.artifact = mm.artifact AND dg.node = member
UNION SELECT mm.artifact, use, 'UNRESOLVED_SYMBOL' FROM mm JOIN rd ON rd.artifact = mm.artifact AND rd.node = member AND symbol LIKE 'unresolved:%'
UNION SELECT c.artifact, use, 'LIMITED_CONTROL_REGION' FROM c JOIN g ON g.artifact = c.artifact AND g.node = use AND polarity = 'limited'
UNION SELECT c.artifact, use, 'CONTROL_FLOW_TERMINATION_UNMODELED' FROM c JOIN st ON st.artifact = c.artifact AND st.kind = 'return' AND st.node < use),
b AS (SELECT artifact, use, string_agg(code, ',' ORDER BY code) AS barriers FROM codes GROUP BY ALL),
u AS (SELECT DISTINCT mm.artifact, use FROM mm JOIN rf ON rf.artifact = mm.artifact AND rf.node = member),
sl AS (SELECT mm.artifact, mm.use AS node, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members, coalesce(any_value(barriers), '') AS barriers, CASE WHEN any_value(barriers) IS NOT NULL THEN 'blocked' WHEN any_value(u.use) IS NOT NULL THEN 'unresolved' ELSE 'supported_within_profile' END AS state
FROM mm LEFT JOIN b ON b.artifact = mm.artifact AND b.use = mm.use LEFT JOIN u ON u.artifact = mm.artifact AND u.use = mm.use GROUP BY mm.artifact, mm.use)"""


def _sliced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    nodes, edges, effects, *rest = _programs(spark, sf_dir)
    nodes = structure.sound(nodes)
    held = cut(structure.guards_of_sound(nodes, 8))
    candidates = nodes.where(F.col("kind").isin("assign", "update", "write")).select("artifact", "node")
    return nodes, effects, held, candidates, structure.fact_slices(nodes, edges, effects, *rest, candidates, held=held)


@query(f"WITH RECURSIVE {_SLICES_SQL} SELECT * FROM sl")
def guarded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each assignment, update and write of the orders' programs rests on, without the other arms of its ifs."""
    return _sliced(spark, sf_dir)[-1].select("artifact", "node", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join("barriers", ",").alias("barriers"), "state")


@query(f"""WITH RECURSIVE {_SLICES_SQL},
a AS (SELECT st.artifact, st.node, sl.state, sha256(concat_ws('/', CAST(st.artifact AS VARCHAR), scope, kind, coalesce(writes[1], ''))) AS anchor FROM st JOIN sl ON sl.artifact = st.artifact AND sl.node = st.node JOIN (SELECT artifact, node, writes FROM ef) f ON f.artifact = st.artifact AND f.node = st.node),
o AS (SELECT *, row_number() OVER (PARTITION BY artifact, anchor ORDER BY node) - 1 AS ordinal FROM a),
t AS (SELECT artifact, node, string_agg(head || ':' || polarity, ',' ORDER BY head) AS conditions FROM g WHERE polarity <> 'limited' GROUP BY ALL)
SELECT 'rule_' || sha256('fact-source-candidate/' || anchor || '/' || ordinal) AS rule_id, o.artifact, o.node, coalesce(conditions, '') AS conditions, ordinal, state FROM o LEFT JOIN t ON t.artifact = o.artifact AND t.node = o.node""")
def guarded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the orders' programs under their guards, with the support of their slices."""
    nodes, effects, held, candidates, supports = _sliced(spark, sf_dir)
    targets = effects.select("artifact", "node", F.get("writes", F.lit(0)).alias("target"))
    return structure.guarded_rules(candidates.join(targets, ["artifact", "node"]), nodes, supports, held=held)


_EVENT_KINDS = {"click": "if", "view": "endif", "purchase": "else", "signup": "assign", "error": "procedure_start"}


@query("""WITH RECURSIVE k AS (SELECT user_id AS artifact, event_id AS node, CASE event_type WHEN 'click' THEN 'if' WHEN 'view' THEN 'endif' WHEN 'purchase' THEN 'else' WHEN 'signup' THEN 'assign' ELSE 'procedure_start' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s(artifact, i, node, stack, fault) AS (SELECT artifact, 0::BIGINT, 0::BIGINT, '', '' FROM k GROUP BY artifact
UNION ALL SELECT k.artifact, k.i, k.node, CASE kind WHEN 'if' THEN stack || 'i' WHEN 'else' THEN left(stack, len(stack) - 1) || 'e' WHEN 'endif' THEN left(stack, len(stack) - 1) ELSE stack END,
CASE WHEN kind = 'procedure_start' AND stack <> '' THEN 'SCOPE' WHEN kind = 'else' AND right(stack, 1) <> 'i' THEN 'ARM' WHEN kind = 'endif' AND stack = '' THEN 'END' WHEN k.i = k.n AND (CASE kind WHEN 'if' THEN len(stack) + 1 WHEN 'endif' THEN len(stack) - 1 ELSE len(stack) END) > 0 THEN 'UNCLOSED' ELSE '' END
FROM s JOIN k ON k.artifact = s.artifact AND k.i = s.i + 1 WHERE fault = '') SELECT artifact, node, fault FROM s WHERE fault <> ''""")
def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of users as statements, most of which do not nest: the first that is wrong."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _EVENT_KINDS.items() for x in kv]), F.col("event_type"))
    return structure.structure_faults(table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact"), F.col("event_id").alias("node"), kind.alias("kind")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, CASE l_returnflag WHEN 'R' THEN 'update' WHEN 'A' THEN 'call' ELSE 'write' END AS kind, lag(CASE l_returnflag WHEN 'R' THEN 'update' WHEN 'A' THEN 'call' ELSE 'write' END) OVER (PARTITION BY l_orderkey, l_linestatus, l_returnflag = 'N' ORDER BY l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) AS before FROM lineitem)
SELECT l_orderkey AS artifact, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS node, l_partkey AS callee FROM l WHERE kind = 'call' AND before = 'update' AND l_partkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_discount = 0) AND l_partkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07)""")
def local_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as updates, calls and writes: a call right after an update, of an order that writes for sure and has no unknown effect."""
    items = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "update").when(F.col("l_returnflag") == "A", "call").otherwise("write")
    node = F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    statements = items.select(F.col("l_orderkey").alias("artifact"), F.col("l_linestatus").alias("scope"), (F.col("l_returnflag") == "N").alias("guards"), node.alias("node"), kind.alias("kind"), F.col("l_partkey").alias("callee"))
    writes = items.where("l_returnflag = 'N' and l_discount = 0").select(F.col("l_orderkey").alias("artifact"))
    return structure.update_call_write(statements, writes, items.where("l_tax > 0.07").select(F.col("l_orderkey").alias("artifact")))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority AS p, o_orderstatus AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
i AS (SELECT id AS cur, before AS nxt FROM o WHERE before IS NOT NULL UNION SELECT o.id, m.last FROM o JOIN (SELECT o_custkey, max(id) AS last FROM o GROUP BY 1) m USING (o_custkey)),
k AS (SELECT id AS cur, CASE s WHEN 'P' THEN 2 ELSE 1 END AS copies FROM o WHERE p <> '5-LOW'),
w(root, cur, way, level, status) AS (SELECT k.cur, k.cur, [k.cur], 0, 'included' FROM k WHERE copies = 1
UNION ALL SELECT w.root, i.nxt, list_append(w.way, i.nxt), w.level + 1, CASE WHEN list_contains(w.way, i.nxt) THEN 'cycle' WHEN w.level >= 2 THEN 'limit' WHEN k.copies IS NULL THEN 'missing' WHEN k.copies > 1 THEN 'ambiguous' ELSE 'included' END
FROM w JOIN i ON i.cur = w.cur LEFT JOIN k ON k.cur = i.nxt WHERE w.status = 'included')
SELECT root, cur AS member, level, status, count(*) AS n FROM w WHERE level > 0 GROUP BY ALL""")
def expanded_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders include the customer's order before and the last one: pending ones come twice, low ones are nowhere."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"), "o_custkey", "o_orderpriority", "o_orderstatus", F.lag("o_orderkey").over(w).alias("before"))
    last = orders.groupBy("o_custkey").agg(F.max("member").alias("includes"))
    includes = orders.where("before is not null").select("member", F.col("before").alias("includes")).union(orders.join(last, "o_custkey").select("member", "includes")).distinct()
    members = orders.where("o_orderpriority <> '5-LOW'").select("member", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("copies"))
    return structure.expanded(includes, members, 2)


_CHAIN_SQL = "o AS (SELECT o_orderkey AS id, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.lag("o_orderkey").over(w).alias("previous"))


@query(f"""WITH RECURSIVE {_CHAIN_SQL}, a(start, id, distance) AS (SELECT id, previous, 1 FROM o WHERE previous IS NOT NULL AND id NOT IN (SELECT previous FROM o WHERE previous IS NOT NULL)
UNION ALL SELECT a.start, o.previous, a.distance + 1 FROM a JOIN o ON o.id = a.id WHERE o.previous IS NOT NULL AND a.distance < 100) SELECT start, id, distance FROM a""")
def revision_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisions behind each head, a hundred at most."""
    chains = _chains(spark, sf_dir)
    heads = chains.join(chains.where("previous is not null").select(F.col("previous").alias("id")), "id", "left_anti")
    return structure.ancestors(chains, heads)


@query("""WITH o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders)
SELECT n.o_custkey, CASE WHEN p.o_orderkey IS NULL THEN 'new' WHEN p.o_orderstatus = n.o_orderstatus AND p.o_orderpriority = n.o_orderpriority THEN 'same' ELSE 'changed' END AS change FROM o n LEFT JOIN orders p ON p.o_orderkey = n.previous WHERE n.place = 1""")
def changed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer against the one before; key, price and date may differ."""
    orders = table(spark, sf_dir, "orders")
    chains = _chains(spark, sf_dir)
    last = chains.groupBy("o_custkey").agg(F.max_by(F.struct("id", "previous"), "id").alias("h")).select("h.id", "h.previous")
    new = orders.join(last.select(F.col("id").alias("o_orderkey")), "o_orderkey", "left_semi")
    old = orders.join(last.select(F.col("previous").alias("o_orderkey")), "o_orderkey", "left_semi")
    return structure.changed(new, old, "o_custkey", ("o_orderkey", "o_totalprice", "o_orderdate"))


@query("""SELECT user_id AS subject, event_id AS sequence, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events""")
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews of each subject in order, each with the one before."""
    w = Window.partitionBy("subject").orderBy("sequence")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("sequence"), F.col("event_type").alias("status"))
    return rows.select("subject", "sequence", "status", (F.row_number().over(w) - 1).alias("ordinal"), F.lag("status").over(w).alias("before"))


@query("""WITH d AS (SELECT o_orderkey AS subject, CASE o_orderpriority WHEN '1-URGENT' THEN 'approve' WHEN '2-HIGH' THEN 'reject' WHEN '3-MEDIUM' THEN 'approve' ELSE 'correct' END AS decision, CASE o_orderstatus WHEN 'F' THEN o_custkey + 1 ELSE o_custkey END AS expected FROM orders),
s AS (SELECT o_orderkey AS subject, o_custkey AS head, CASE WHEN o_totalprice > 250000 THEN 'rejected' ELSE 'pending_review' END AS status FROM orders WHERE o_totalprice < 450000),
g AS (SELECT l_orderkey AS subject, CASE WHEN count(*) > count(p_partkey) THEN 'missing' WHEN bool_or(p_type = 'LARGE') THEN 'analysis_barrier' ELSE 'supported' END AS state FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 2) ON p_partkey = l_partkey GROUP BY l_orderkey),
j AS (SELECT d.*, head, status, CASE WHEN head IS NULL THEN 'NOT_FOUND' WHEN expected <> head THEN 'STALE' WHEN decision = 'approve' AND coalesce(state, 'supported') <> 'supported' THEN 'UNSUPPORTED' WHEN decision = 'approve' AND status = 'rejected' THEN 'REJECTED' ELSE 'accepted' END AS outcome FROM d LEFT JOIN s USING (subject) LEFT JOIN g USING (subject))
SELECT subject, decision, outcome, CASE WHEN outcome <> 'accepted' THEN status WHEN decision = 'approve' THEN 'verified' WHEN decision = 'reject' THEN 'rejected' ELSE 'pending_review' END AS status FROM j""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on orders: some expect another head, some rest on parts that are missing or barriers, some approve what is rejected."""
    orders = table(spark, sf_dir, "orders")
    decision = F.when(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"), "approve").when(F.col("o_orderpriority") == "2-HIGH", "reject").otherwise("correct")
    decisions = orders.select(F.col("o_orderkey").alias("subject"), decision.alias("decision"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("expected"))
    subjects = orders.where("o_totalprice < 450000").select(F.col("o_orderkey").alias("subject"), F.col("o_custkey").alias("head"), F.when(F.col("o_totalprice") > 250000, "rejected").otherwise("pending_review").alias("status"))
    order, part = (F.concat(F.lit(c), F.col(k).cast("string")) for c, k in (("o", "l_orderkey"), ("p", "l_partkey")))
    parts = table(spark, sf_dir, "part").where("p_size > 2").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("type"))
    nodes = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("type")).union(parts)
    links = table(spark, sf_dir, "lineitem").select(order.alias("src"), part.alias("dst"))
    states = assembly.support_states(nodes, links, {"analysis_barrier": F.col("type") == "LARGE"})
    gate = states.where(F.startswith("node", F.lit("o"))).select(F.substring("node", 2, 30).cast("long").alias("subject"), "state")
    return writers.reviewed(subjects, decisions, gate)


@query("""WITH m AS (SELECT lang AS snapshot, source AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents), c AS (SELECT source AS kind, CAST(doc_id AS VARCHAR) AS id, 'rev_' || sha256(text) AS replacement FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source <> 'src0')
SELECT snapshot || '+' AS snapshot, kind, coalesce(replacement, id) AS id FROM m LEFT JOIN c USING (kind, id) WHERE snapshot IN (SELECT snapshot FROM m JOIN c USING (kind, id))""")
def successor_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by language; each that holds a corrected document has a successor with the revision in its place."""
    docs = table(spark, sf_dir, "documents")
    ident = F.col("doc_id").cast("string")
    manifest = docs.select(F.col("lang").alias("snapshot"), F.col("source").alias("kind"), ident.alias("id"))
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").where("source <> 'src0'")
    return writers.corrected(manifest, toxic.select(F.col("source").alias("kind"), ident.alias("id"), F.concat(F.lit("rev_"), F.sha2("text", 256)).alias("replacement")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'NOT_AN_ACTION' WHEN l_tax > 0.07 THEN 'BARRIER' WHEN l_discount = 0 THEN 'UNCITED' WHEN l_linestatus = 'O' AND l_quantity < 5 THEN 'INDICATOR' END AS skipped FROM lineitem""")
def candidate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidate rules: those that are left out say why, the others have no reason."""
    why = writers.first_fault({"NOT_AN_ACTION": F.col("l_returnflag") != "N", "BARRIER": F.col("l_tax") <= 0.07, "UNCITED": F.col("l_discount") != 0, "INDICATOR": ~((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 5))})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", why.alias("skipped"))


@query(f"""WITH {_FLOW_SQL} SELECT 'fact_' || sha256(kind || '/' || artifact || '/' || node || '/' || name) AS fact_id, kind, artifact, node, name FROM (
SELECT 'declaration' AS kind, artifact, node, defines AS name FROM n WHERE NOT barrier UNION ALL SELECT 'reference', n.artifact, n.node, v.variable FROM n JOIN v ON v.artifact = n.artifact UNION ALL SELECT 'effect', artifact, node, 'unknown' FROM n WHERE barrier)""")
def published_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all statements in one stream: what each declares, refers to and may change."""
    return structure.statement_facts(_conversation_flow(spark, sf_dir)[0])


@query(f"""WITH c AS ({SQL["rule_conditions"]}), k AS (SELECT conv_id AS artifact, turn AS node FROM conversations WHERE role = 'assistant'),
r AS (SELECT k.artifact, k.node, coalesce(string_agg(c.head || ':' || c.arm, ',' ORDER BY c.head), '') AS conditions FROM k LEFT JOIN c ON c.artifact = k.artifact AND c.node = k.node GROUP BY 1, 2)
SELECT 'rule_' || sha256(artifact || '/' || node || '/' || conditions) AS rule_id, artifact, node, conditions, row_number() OVER (PARTITION BY artifact ORDER BY node) - 1 AS ordinal FROM r""")
def extracted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of assistants as rules: under which conditions each comes, in which place, with an id of what it says."""
    candidates = _conversation_flow(spark, sf_dir)[0].where(F.array_contains("defines", "assistant")).select("artifact", "node")
    return structure.rules(candidates, rule_conditions(spark, sf_dir))


@query("""WITH b AS (SELECT l_orderkey AS rule_id, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag FROM lineitem)
SELECT rule_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0.07 THEN 'BARRIER' WHEN p_partkey IS NULL THEN 'WORKFLOW_MISSING' WHEN s_suppkey IS NULL THEN 'EVIDENCE_MISSING' WHEN l_suppkey % 4 = 0 THEN 'same' WHEN l_suppkey % 4 = 1 THEN 'conflict' ELSE 'insert' END AS outcome
FROM b LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) ON s_suppkey = l_suppkey""")
def bundle_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rules of a bundle: each cites a workflow and evidence that are known, and has no barrier. Those of some suppliers are
    stored already, of others in another form."""
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_orderkey").alias("rule_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("workflow"), F.col("l_suppkey").alias("evidence"), F.lit("").alias("payload"), "l_tax")
    fourth = F.pmod("l_suppkey", F.lit(4))
    stored = rows.where(fourth < 2).select("key", F.when(fourth == 0, "").otherwise("?").alias("payload")).distinct()
    found = writers.admitted(rows, stored, "key", "payload", {"BARRIER": F.col("l_tax") <= 0.07}, [("workflow", table(spark, sf_dir, "part").where("p_size > 5"), "p_partkey"), ("evidence", table(spark, sf_dir, "supplier").where("s_acctbal >= 0"), "s_suppkey")])
    return found.select("rule_id", "l_linenumber", "l_partkey", "l_suppkey", "outcome")
