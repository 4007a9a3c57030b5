"""Bounded traversals. Frontiers are DataFrames; each round is one join with the edges, and its lineage is cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, fixpoint


#: More rows than any bound of a traversal.
BEYOND = (1 << 31) - 2


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, level, boundary) from edges (src, dst; a null dst is unresolved) and seeds (seed, node).

    A node is met once for each seed, at its least level. boundary: `unresolved` if it has such an edge, `traversal_limit`
    if at the last level it has an edge to what was not met.
    """
    seen = cut(seeds.select("seed", "node").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(edges.where("dst is not null"), F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    open_ends = edges.where("dst is null").select(F.col("src").alias("node")).distinct().withColumn("unresolved", F.lit(True))
    last = seen.where(F.col("level") == depth).join(edges.where("dst is not null"), F.col("node") == F.col("src")).select("seed", "node", F.col("dst"))
    beyond = last.join(seen.select("seed", F.col("node").alias("dst")), ["seed", "dst"], "left_anti").select("seed", "node").distinct().withColumn("limited", F.lit(True))
    marked = seen.join(open_ends, "node", "left").join(beyond, ["seed", "node"], "left")
    return marked.select("seed", "node", "level", F.when(F.col("unresolved"), "unresolved").when(F.col("limited"), "traversal_limit").otherwise("").alias("boundary"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing", relationships: tuple[str, ...] = (), max_nodes: int = 1000, max_edges: int = 2500) -> tuple[DataFrame, bool]:
    """The edges (id, src, dst, relationship; a null dst is unresolved) that seeds (node) meet in `depth` + 1 rounds, with their
    level and boundary, and whether a bound cut anything off.

    Edges are taken by id in each round, `max_edges` in all. An unresolved edge is a boundary. An edge to a new node is a
    `traversal_limit` boundary in the last round, and where the node would be one too many; nodes are taken in by their
    least edge. No relationships mean all. What a round holds is within the bounds, so its ranks are over few rows.
    """
    ways = []
    if direction in ("outgoing", "both"):
        ways.append(edges.select("id", F.col("src").alias("node"), F.col("dst").alias("to"), "relationship", F.col("dst").isNotNull().alias("resolved")))
    if direction in ("incoming", "both"):
        ways.append(edges.where("dst is not null").select("id", F.col("dst").alias("node"), F.col("src").alias("to"), "relationship", F.lit(True).alias("resolved")))
    links = reduce(DataFrame.unionByName, ways)
    if relationships:
        links = links.where(F.col("relationship").isin(*relationships))
    nodes = frontier = cut(seeds.select("node").distinct())
    met, n_nodes, n_edges, truncated = None, nodes.count(), 0, False
    for level in range(depth + 1):
        found = links.join(frontier, "node", "left_semi").groupBy("id").agg(F.max("resolved").alias("resolved"), F.array_distinct(F.collect_list("to")).alias("to"))
        if met is not None:
            found = found.join(met.select("id"), "id", "left_anti")
        taken = cut(found.orderBy("id").limit(min(max_edges - n_edges, BEYOND) + 1))
        held = taken.count()
        if held > max_edges - n_edges:
            truncated, held = True, max_edges - n_edges
            taken = cut(taken.orderBy("id").limit(held))
        n_edges += held
        fresh = taken.where("resolved").select("id", F.explode("to").alias("node")).join(nodes, "node", "left_anti")
        first = fresh.groupBy("node").agg(F.min("id").alias("first"))
        room = max_nodes - n_nodes if level < depth else 0
        inside = cut(first.orderBy("first", "node").limit(min(max(0, room), BEYOND)).select("node"))
        outside = fresh.join(inside, "node", "left_anti").select("id").distinct().withColumn("limited", F.lit(True))
        rows = taken.join(outside, "id", "left").select("id", F.lit(level).alias("level"), F.when(~F.col("resolved"), "unresolved").when(F.col("limited"), "traversal_limit").otherwise("").alias("boundary"))
        rows = cut(rows)
        truncated = truncated or not rows.where("boundary = 'traversal_limit'").isEmpty()
        met = rows if met is None else met.unionByName(rows)
        n_nodes += inside.count()
        nodes, frontier = nodes.union(inside), inside
        if n_edges >= max_edges or frontier.isEmpty():
            break
    return met, truncated


def closure(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that seeds (node) cite over any number of links (src, dst); cycles end by the anti-join."""
    return fixpoint(seeds.select("node").distinct(), lambda at: at.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), ["node"])


def simple_paths(edges: DataFrame, depth: int) -> DataFrame:
    """(path, nodes, ending): from each root along edges (src, dst), no node twice, at most `depth` nodes.

    ending: leaf, cycle (the only way on repeats a node) or limit. A path has one edge at least.
    """
    links = edges.select("src", "dst").distinct()
    roots = links.select(F.col("src").alias("node")).distinct().join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    grown = cut(roots.select(F.array("node").alias("path"), F.col("node").alias("at")))
    done = None
    for size in range(1, depth + 1):
        on = grown.join(links, F.col("at") == F.col("src"), "left").withColumn("again", F.array_contains("path", F.col("dst")))
        ways = on.groupBy("path", "at").agg(F.count("dst").alias("ways"), F.count_if(F.col("dst").isNotNull() & ~F.col("again")).alias("fresh"))
        ended = ways.where((F.size("path") > 1) & ((F.col("fresh") == 0) | F.lit(size == depth)))
        ended = ended.select("path", F.when(F.col("ways") == 0, "leaf").when(F.col("fresh") == 0, "cycle").otherwise("limit").alias("ending"))
        done = ended if done is None else done.unionByName(ended)
        if size < depth:
            grown = cut(on.where(F.col("dst").isNotNull() & ~F.col("again")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
    return done.select(F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"), "ending")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, level, support): all that seeds (seed, node) reach over edges (src, dst; a null dst leads nowhere), at
    its least level. support: the distinct evidence (an array, if the edges have it) of one shortest way.
    """
    evidence = F.col("evidence") if "evidence" in edges.columns else F.array().cast("array<string>")
    links = edges.where("dst is not null").select("src", "dst", evidence.alias("evidence"))
    start = seeds.select("seed", "node").distinct().withColumn("level", F.lit(0)).withColumn("support", F.array().cast(links.schema["evidence"].dataType))

    def step(at: DataFrame) -> DataFrame:
        out = at.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("level") + 1).alias("level"), F.array_sort(F.array_union("support", "evidence")).alias("support"))
        return out.groupBy("seed", "node", "level").agg(F.min("support").alias("support"))

    return fixpoint(start, step, ["seed", "node"])


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): the least node that it hangs together with over links (src, dst), whatever their direction."""
    both = cut(links.union(links.select("dst", "src")).distinct())
    labels = cut(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("near"))
        new = cut(labels.join(near, F.col("node") == F.col("src")).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def call_paths(edges: DataFrame, depth: int) -> DataFrame:
    """(path, nodes, ending, back): from each root and then, in rounds, from the least node with edges that no path has met,
    one in each set that hangs together, so that cycles without a root give paths too.

    ending: leaf, limit (`depth` nodes with ways on), or cycle, a row for each edge back to a node of the path (`back`).
    """
    links = cut(edges.where("dst is not null").select("src", "dst").distinct())
    sources = links.select(F.col("src").alias("node")).distinct()
    starts, done, met, labels = sources.join(links.select(F.col("dst").alias("node")), "node", "left_anti"), None, None, None
    while True:
        grown = cut(starts.select(F.array("node").alias("path"), F.col("node").alias("at")))
        for size in range(1, depth + 1):
            met = grown.select(F.col("at").alias("node")) if met is None else met.union(grown.select("at"))
            on = grown.join(links, F.col("at") == F.col("src"), "left").withColumn("again", F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False)))
            ending = F.when(F.col("dst").isNull(), "leaf").when(F.lit(size == depth), "limit").when(F.col("again"), "cycle")
            ended = on.select("path", ending.alias("ending"), F.when(ending == "cycle", F.col("dst")).alias("back")).where("ending is not null").distinct()
            done = ended if done is None else done.unionByName(ended)
            if size < depth:
                grown = cut(on.where(F.col("dst").isNotNull() & ~F.col("again")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        met, done = cut(met.distinct()), cut(done)
        rest = cut(sources.join(met, "node", "left_anti"))
        if rest.isEmpty():
            return done.select(F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"), "ending", "back")
        labels = _labels(links) if labels is None else labels
        starts = rest.join(labels, "node").groupBy("label").agg(F.min("node").alias("node"))


def bounded_paths(edges: DataFrame, depth: int, most: int = 1000, work: int = 100_000) -> tuple[DataFrame, list[str]]:
    """(path, nodes, ending, back) as call_paths gives them, `most` at most, and which limits were met.

    Paths are in order: those from roots first, then those from nodes that no path before has met, each in the order of their
    nodes. Every beginning of a path goes on to one path at least, so a round keeps the first `most` of what is done and what still
    grows: later ones cannot be among the first. Each node's first `most` links do likewise. So a round has most * most rows before
    its cap and `most` after it, whatever the graph.

    limits: `path_limit` if there are more paths, `depth_limit` if a path was ended at `depth` nodes, `work_limit` if more than
    `work` links were looked at, which ends the search with the paths that are done.
    """
    order = Window.partitionBy("src").orderBy("dst")
    links = cut(edges.where("dst is not null").select("src", "dst").distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank"))
    everything = edges.where("dst is not null").select("src", "dst").distinct()
    sources = cut(everything.select(F.col("src").alias("node")).distinct())
    starts, labels, met, done, phase, looked, limits = sources.join(everything.select(F.col("dst").alias("node")), "node", "left_anti"), None, None, None, 0, 0, set()

    def first(rows: DataFrame) -> DataFrame:
        kept = cut(rows.orderBy("phase", "way", F.col("ending").isNull(), "ending").limit(most + 1))
        if kept.count() <= most:
            return kept
        limits.add("path_limit")
        return cut(kept.orderBy("phase", "way", F.col("ending").isNull(), "ending").limit(most))

    while True:
        new = starts.select(F.lit(phase).alias("phase"), F.array("node").alias("way"), F.array("node").alias("path"), F.lit(None).cast("string").alias("ending"), F.lit(None).cast(links.schema["dst"].dataType).alias("back"))
        held = first(new if done is None else done.unionByName(new))
        for size in range(1, depth + 1):
            growing = held.where("ending is null")
            nodes = growing.select(F.element_at("path", -1).alias("node"))
            met = cut((nodes if met is None else met.union(nodes)).distinct())
            at = growing.select("phase", "path", F.element_at("path", -1).alias("src"))
            on = at.join(links, "src", "left").withColumn("again", F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False)))
            if size < depth:
                looked += on.count()
                if looked > work:
                    limits.add("work_limit")
                    return _named(held.where("ending is not null")), sorted(limits)
            ending = F.when(F.col("dst").isNull(), "leaf").when(F.lit(size == depth), "limit").when(F.col("again"), "cycle")
            back = F.when(ending == "cycle", F.col("dst"))
            way = F.when(ending.isin("leaf", "limit"), F.col("path")).otherwise(F.concat("path", F.array("dst")))
            grown = on.select("phase", way.alias("way"), F.when(ending.isNull(), way).otherwise(F.col("path")).alias("path"), ending.alias("ending"), back.alias("back")).distinct()
            held = first(held.where("ending is not null").unionByName(grown))
            if held.where("ending is null").isEmpty():
                break
        done = held
        if "path_limit" in limits and done.where(F.col("phase") == 0).count() == most:
            break
        rest = cut(sources.join(met, "node", "left_anti"))
        if rest.isEmpty():
            break
        labels = _labels(links) if labels is None else labels
        starts, phase = rest.join(labels, "node").groupBy("label").agg(F.min("node").alias("node")), 1
    if not done.where("ending = 'limit'").isEmpty():
        limits.add("depth_limit")
    return _named(done), sorted(limits)


def _named(done: DataFrame) -> DataFrame:
    return done.select(F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"), "ending", "back")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): parents (src) stand in lower layers than children (dst). What a cycle holds back has layer null."""
    rest, placed, layer = cut(nodes.select("node").distinct()), None, 0
    links = cut(edges.select("src", "dst").distinct())
    while True:
        held = links.select(F.col("dst").alias("node")).distinct()
        free = cut(rest.join(held, "node", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        rest = cut(rest.join(free, "node", "left_anti"))
        links = cut(links.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        layer += 1
    stuck = rest.withColumn("layer", F.lit(None).cast("int"))
    return stuck if placed is None else placed.unionByName(stuck)
