"""Records put together for a reader: closed over their evidence, with their reviews, within bounds and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, fixpoint
from .packing import could_fit
from .relational import latest_as_of

#: Classifications from the strongest to the weakest.
CLASSES = ("observed", "inferred", "unresolved")


def class_rank(classification: Column) -> Column:
    """The place in CLASSES; none counts as unresolved."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), classification), F.lit(3)) - 1


def class_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), (rank + 1).cast("int"))


def item_closure(citations: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(item, evidence, complete): all that each item cites (item, evidence), directly or over links (src, dst).

    What is cited but not there (no row of evidence: evidence) leads no further; an item that cites such a thing in any
    depth is not complete.
    """
    there = evidence.select("evidence").distinct().withColumn("there", F.lit(True))
    on = links.join(there.select(F.col("evidence").alias("src")), "src", "left_semi").select("src", "dst").distinct()

    def step(at: DataFrame) -> DataFrame:
        return at.join(on, F.col("evidence") == F.col("src")).select("item", F.col("dst").alias("evidence")).distinct()

    reached = fixpoint(citations.select("item", "evidence").distinct(), step, ["item", "evidence"]).join(there, "evidence", "left")
    lost = reached.where("there is null").select("item").distinct().withColumn("lost", F.lit(True))
    return reached.join(lost, "item", "left").select("item", "evidence", F.col("lost").isNull().alias("complete"))


def facts(records: DataFrame, closure: DataFrame, evidence: DataFrame) -> DataFrame:
    """(key, id, evidence, classification, bytes) of the facts that a package may hold.

    records: (type, id, text, classification); equal texts of chunks are one fact, with all their evidence, the weakest
    classification and the least id. An item without a complete, non-empty closure gives none. Evidence (evidence,
    classification, blocked) that is unresolved or blocked makes its fact unresolved.
    """
    weak = evidence.select("evidence", ((F.col("classification") == "unresolved") | F.col("blocked")).alias("weak"))
    of = closure.where("complete").join(weak, "evidence").groupBy("item").agg(F.array_sort(F.collect_set("evidence")).alias("support"), F.bool_or("weak").alias("weak"))
    key = F.when(F.col("type") == "chunk", F.concat(F.lit("chunk:"), F.sha2("text", 256))).otherwise(F.concat("type", F.lit(":"), F.col("id").cast("string")))
    rows = records.join(of, F.col("id") == F.col("item")).select(key.alias("key"), "type", "id", "text", "support", F.when(F.col("weak"), 2).otherwise(class_rank(F.col("classification"))).alias("rank"))
    merged = rows.groupBy("key").agg(F.min("type").alias("type"), F.min("id").alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("support")))).alias("evidence"), F.max("rank").alias("rank"), F.max(F.octet_length("text")).cast("long").alias("bytes"))
    return merged.select("key", "type", "id", "evidence", class_name(F.col("rank")).alias("classification"), "bytes")


PACKED = "request string, key string, used long"


def package(candidates: DataFrame, budget: int, citation_bytes: int) -> DataFrame:
    """(request, key, used): for each request its candidates (request, place, key, evidence, bytes) in the order of place
    and key, each taken if it and its citations that are not there yet fit the rest of the budget.

    What alone is over the budget is left out before, and so is what a task's own candidates leave no room for (packing.could_fit:
    a candidate costs its bytes at least, and those of all its citations at most). The last task of a request reads one row at a time
    and holds the citations taken so far, which the budget bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request, used, cited = None, 0, set()
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != request:
                    request, used, cited = row[0], 0, set()
                new = [e for e in row[2] if e not in cited]
                size = row[3] + citation_bytes * len(new)
                if used + size <= budget:
                    used += size
                    cited.update(new)
                    out.append((request, row[1], used))
            yield pa.RecordBatch.from_pylist([dict(zip(("request", "key", "used"), r)) for r in out], pa.schema([("request", pa.string()), ("key", pa.string()), ("used", pa.int64())]))

    whole = (F.col("bytes") + citation_bytes * F.size("evidence")).cast("long")
    alone = candidates.where(whole <= budget).select("request", "place", "key", F.col("evidence").cast("array<string>").alias("evidence"), F.col("bytes").cast("long").alias("bytes"), whole.alias("whole"))
    ordered = could_fit(alone, "request", ["place", "key"], "bytes", "whole", budget).repartition("request").sortWithinPartitions("request", "place", "key")
    return ordered.drop("place", "whole").mapInArrow(run, PACKED)


def assembled(records: DataFrame, closure: DataFrame, reviews: DataFrame, entities: DataFrame, watermark: int) -> DataFrame:
    """Records (id, entity) with their review as of a watermark and the evidence of their closure, and a row for each
    entity they belong to that sums its records up: how many there are, how many verified, all their evidence.

    reviews: (subject, sequence, status); closure: (item, evidence, complete); entities: (entity).
    """
    status = latest_as_of(reviews.select("subject", "sequence", "status"), ["subject"], "sequence", watermark)
    of = closure.groupBy("item").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"), F.min("complete").alias("complete"))
    rows = records.join(status, F.col("id") == F.col("subject"), "left").join(of, F.col("id") == F.col("item"), "left")
    none = F.array().cast(of.schema["evidence"].dataType)
    rows = rows.select("entity", F.coalesce("status", F.lit("pending_review")).alias("status"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("complete", F.lit(True)).alias("complete"))
    summed = rows.groupBy("entity").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "verified").alias("verified"), F.bool_and("complete").alias("complete"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return entities.select("entity").distinct().join(summed, "entity", "left").select("entity", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("complete", F.lit(True)).alias("complete"), F.coalesce("evidence", none).alias("evidence"))


def required(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The found rows of the keys asked for, and a row with `fault` NOT_FOUND for each key that is not there."""
    wanted = asked.select(key).distinct()
    return wanted.join(found.withColumn("_there", F.lit(True)), key, "left").withColumn("fault", F.when(F.col("_there").isNull(), "NOT_FOUND")).drop("_there")


def page(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in order with a flag whether there are more; one row beyond the page is read, no more."""
    top = rows.orderBy(*order).limit(most + 1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the rows of one page
    numbered = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("_n"), F.count("*").over(whole).alias("_all"))
    return numbered.where(F.col("_n") <= most).withColumn("truncated", F.col("_all") > most).drop("_n", "_all")


def support_states(nodes: DataFrame, links: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """(node, state): `supported`, or the first of the faults that something in the node's closure has.

    nodes: (node, columns of the policies); links: (src, dst) supports. The faults are, in order: `cycle` (a way leads into
    one), `missing` (a support is not there), then the policies by name, each a condition on a node's own columns. Each fault
    spreads from where it is to all that rest on it, so nothing grows with the number of ways.
    """
    down = links.select("src", "dst").distinct()
    back = down.select(F.col("dst").alias("node"), F.col("src").alias("user"))
    faulty = down.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node"), F.lit(2).alias("rank"))
    for rank, condition in enumerate(policies.values(), 3):
        faulty = faulty.union(nodes.where(condition).select("node", F.lit(rank).alias("rank")))

    def spread(at: DataFrame) -> DataFrame:
        return at.join(back, "node").select(F.col("user").alias("node"), "rank").distinct()

    worst = fixpoint(faulty.distinct(), spread, ["node", "rank"]).groupBy("node").agg(F.min("rank").alias("rank"))
    names = F.array(*map(F.lit, ("cycle", "missing", *policies)))
    looped = into_cycles(down).withColumn("loop", F.lit(1))
    state = F.coalesce(F.when(F.col("loop") == 1, "cycle"), F.when(F.col("rank").isNotNull(), F.element_at(names, F.col("rank"))), F.lit("supported"))
    return nodes.select("node").join(worst, "node", "left").join(looped, "node", "left").select("node", state.alias("state"))


def into_cycles(links: DataFrame) -> DataFrame:
    """(node) from which a way leads into a cycle: what is left once nodes without links onward are taken away in rounds."""
    left = cut(links.select("src", "dst").distinct())
    n = left.count()
    while True:
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            return left.select(F.col("src").alias("node")).distinct()
