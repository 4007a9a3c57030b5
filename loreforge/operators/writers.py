"""Append-only writes: what may be written, what is there already, and what contradicts it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from .intervals import containing
from .relational import appended


def first_fault(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks (false or null), or null."""
    out = None
    for name, ok in rules.items():
        broken = ~F.coalesce(ok, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def admitted(incoming: DataFrame, existing: DataFrame, key: str, payload: str, rules: dict[str, Column], references: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """incoming with `outcome`: the first rule or reference that a row breaks, else insert, same, or conflict.

    references: (column, table, key column); a column that is not null must be in its table. The fault is the column's name
    in capitals with _MISSING. Rows of a key that come several times with one payload count as one; with several, all conflict.
    """
    rows = incoming.withColumn("_fault", first_fault(rules)) if rules else incoming.withColumn("_fault", F.lit(None).cast("string"))
    for column, targets, name in references:
        held = targets.select(F.col(name).alias(column)).distinct().withColumn("_held", F.lit(True))
        rows = rows.join(held, column, "left")
        rows = rows.withColumn("_fault", F.coalesce("_fault", F.when(F.col(column).isNotNull() & F.col("_held").isNull(), f"{column.upper()}_MISSING"))).drop("_held")
    several = rows.where("_fault is null").groupBy(key).agg(F.count_distinct(payload).alias("_kinds"))
    rows = appended(existing, rows, key, payload).join(several, key, "left")
    return rows.withColumn("outcome", F.coalesce("_fault", F.when(F.col("_kinds") > 1, "conflict"), "outcome")).drop("_fault", "_kinds").distinct()


def observed(records: DataFrame, run: str, identity: list[str], attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, identity columns), one for each identity, and their observations of a run (observation_id,
    entity_id, attributes)."""
    ident = F.concat(F.lit("ent_"), F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in identity])), 256))
    rows = records.select(ident.alias("entity_id"), *identity, *attributes)
    said = F.to_json(F.struct(F.lit(run).alias("run"), "entity_id", *attributes), {"ignoreNullFields": "false"})
    return rows.select("entity_id", *identity).distinct(), rows.select(F.concat(F.lit("obs_"), F.sha2(said, 256)).alias("observation_id"), "entity_id", *attributes).distinct()


def uncovered(spans: DataFrame, covers: DataFrame, key: str, ident: str, width: int) -> DataFrame:
    """Spans (key, ident, start, stop) that lie in no cover (key, start, stop) of their key as a whole."""
    held = containing(spans.select(key, ident, F.col("start").alias("_a"), F.col("stop").alias("_b")), covers.select(key, "start", "stop"), key, "_a", "start", "stop", width)
    return spans.join(held.where("_b <= stop").select(key, ident).distinct(), [key, ident], "left_anti")


def map_faults(segments: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, fault) of the segments (decoded_start, decoded_stop, raw_start, raw_stop) of an origin map that do not go on
    where the one before ends, or are empty or run backwards."""
    w = Window.partitionBy(key).orderBy(order)
    before, raw = F.lag("decoded_stop", 1, 0).over(w), F.lag("raw_stop", 1, 0).over(w)
    fault = F.when((F.col("decoded_stop") <= F.col("decoded_start")) | (F.col("raw_stop") < F.col("raw_start")), "EMPTY").when(F.col("decoded_start") != before, "GAP").when(F.col("raw_start") < raw, "BACKWARDS")
    return segments.select(key, order, fault.alias("fault")).where("fault is not null")


def bundle_faults(facts: DataFrame, effects: DataFrame) -> DataFrame:
    """(fact, fault) of a bundle of facts (fact, effect): ids that come twice, effects that are not there or unknown."""
    twice = facts.groupBy("fact").agg(F.count("*").alias("n")).where("n > 1").select("fact", F.lit("DUPLICATE_FACT").alias("fault"))
    cited = facts.where("effect is not null").join(effects, "effect", "left")
    weak = cited.select("fact", F.when(F.col("unknown").isNull(), "MISSING_EFFECT").when(F.col("unknown"), "UNKNOWN_EFFECT").alias("fault")).where("fault is not null").distinct()
    return twice.unionByName(weak)


def path_faults(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, step, fault) of paths (path, nodes: an array) whose neighbours no edge (src, dst) joins, or that come back."""
    steps = paths.select("path", F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("src"), F.slice("nodes", 2, F.size("nodes")).alias("dst"))).alias("step", "e")).select("path", "step", "e.src", "e.dst")
    broken = steps.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("path", "step", F.lit("NO_EDGE").alias("fault"))
    again = paths.where(F.size(F.array_distinct("nodes")) < F.size("nodes")).select("path", F.lit(-1).alias("step"), F.lit("REPEATED_NODE").alias("fault"))
    return broken.unionByName(again)


def reviewed(subjects: DataFrame, decisions: DataFrame, gate: DataFrame) -> DataFrame:
    """(subject, decision, outcome, status) of decisions (subject, decision, expected) on heads (subject, head, status).

    A decision on another head than the current one is stale. An approval needs a supported closure (gate: subject, state);
    what is rejected already cannot be approved. Others set the status that they name.
    """
    joined = decisions.join(subjects, "subject", "left").join(gate, "subject", "left")
    outcome = (
        F.when(F.col("head").isNull(), "NOT_FOUND").when(~F.col("expected").eqNullSafe(F.col("head")), "STALE")
        .when((F.col("decision") == "approve") & (F.coalesce("state", F.lit("missing")) != "supported"), "UNSUPPORTED")
        .when((F.col("decision") == "approve") & (F.col("status") == "rejected"), "REJECTED").otherwise("accepted")
    )
    status = F.when(outcome != "accepted", F.col("status")).when(F.col("decision") == "approve", "verified").when(F.col("decision") == "reject", "rejected").otherwise("pending_review")
    return joined.select("subject", "decision", outcome.alias("outcome"), status.alias("status"))


def corrected(manifest: DataFrame, corrections: DataFrame) -> DataFrame:
    """(snapshot, kind, id): the manifest (snapshot, kind, id) of the successor of each snapshot that holds a corrected
    revision (kind, id, replacement, successor by snapshot); all other members stay."""
    swapped = manifest.join(corrections, ["kind", "id"], "left")
    touched = swapped.where("replacement is not null").select("snapshot").distinct()
    return swapped.join(touched, "snapshot", "left_semi").select(F.concat("snapshot", F.lit("+")).alias("snapshot"), "kind", F.coalesce("replacement", "id").alias("id"))


def published(members: DataFrame, facts: DataFrame, name: str) -> str:
    """Writes a snapshot's members (kind, id) as a table of the shared folder once all of them are facts (kind, id), each
    kind in its own partition; returns its path. A snapshot that is there already must be the same."""
    lost = members.join(facts.select("kind", "id"), ["kind", "id"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("SNAPSHOT_NOT_CLOSED")
    path = f"{shared_folder(members.sparkSession).rstrip('/')}/snapshot-{name}"
    rows = members.select("kind", "id").distinct()
    try:
        rows.repartition("kind", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("kind").parquet(path)
    except Exception as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        there = members.sparkSession.read.parquet(path).select("kind", "id")
        if not rows.exceptAll(there).isEmpty() or not there.exceptAll(rows).isEmpty():
            raise ValueError("SNAPSHOT_CONFLICT") from error
    return path


def export_faults(files: DataFrame, manifest: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, fault) of an export: files (path, sha256) that differ from the manifest (path, sha256), links (path, target)
    to no file, and edges (src, dst) whose ends are no nodes (node).

    A path may have several files and entries: equal digests cancel out, and of what is left of a path, entries and files make
    pairs that are CHANGED, entries over are MISSING and files over UNLISTED, a row for each. These are counts, so a path with
    many files is summed up before its shuffle.
    """
    said, held = F.greatest(F.col("_n"), F.lit(0)), F.greatest(-F.col("_n"), F.lit(0))
    both = manifest.select("path", "sha256", F.lit(1).alias("_n")).union(files.select("path", "sha256", F.lit(-1).alias("_n")))
    left = both.groupBy("path", "sha256").agg(F.sum("_n").alias("_n")).where("_n <> 0").groupBy("path").agg(F.sum(said).alias("_said"), F.sum(held).alias("_is"))
    counts = {"CHANGED": F.least("_said", "_is"), "MISSING": F.greatest(F.col("_said") - F.col("_is"), F.lit(0)), "UNLISTED": F.greatest(F.col("_is") - F.col("_said"), F.lit(0))}
    parts = [left.select(F.col("path").alias("subject"), F.explode(F.concat(*[F.array_repeat(F.lit(fault), n.cast("int")) for fault, n in counts.items()])).alias("fault"))]
    parts.append(links.join(files.select(F.col("path").alias("target")), "target", "left_anti").select(F.col("path").alias("subject"), F.lit("BROKEN_LINK").alias("fault")).distinct())
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    parts.append(ends.join(nodes.select("node"), "node", "left_anti").select(F.col("node").alias("subject"), F.lit("UNKNOWN_NODE").alias("fault")))
    return reduce(DataFrame.unionByName, parts)
