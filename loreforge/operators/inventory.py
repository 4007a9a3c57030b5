"""From declared and received metadata to entities, references, memberships and their accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import fixpoint
from .binding import classified
from .relational import merged_claim

#: Relationships that membership does not go through, and kinds that it stops at.
STRUCTURAL, TOPS = ("MEMBER_OF", "CONTAINS"), ("Application", "System")
# Kinds of metadata envelopes.
KINDS = ("inventory", "schema", "binding", "job", "dsp_pgmref")


def envelopes(raw: DataFrame, body: str = "body") -> DataFrame:
    """raw with its envelope read: kind, records (JSON texts), and fault where it is none.

    An envelope has the keys schema_version, kind and records and no other; its kind is known and its records are a list.
    """
    parsed = F.from_json(body, "schema_version string, kind string, records array<string>")
    keys = F.array_sort(F.json_object_keys(body))
    fault = (
        F.when(keys.isNull(), "INVALID_JSON")
        .when(keys != F.array(*map(F.lit, ("kind", "records", "schema_version"))), "INVALID_KEYS")
        .when(~F.coalesce(parsed["kind"].isin(*KINDS), F.lit(False)), "UNKNOWN_KIND")
        .when(parsed["records"].isNull(), "INVALID_RECORDS")
    )
    return raw.select("*", parsed["kind"].alias("kind"), F.when(fault.isNull(), parsed["records"]).alias("records"), fault.alias("fault"))


def manifest_faults(declared: DataFrame, memberships: DataFrame, members: DataFrame) -> DataFrame:
    """(subject, fault): paths declared twice in any case, and memberships (application, member) whose member nobody declares.

    declared: (path), members: (member).
    """
    twice = declared.groupBy(F.lower("path").alias("subject")).agg(F.count("*").alias("n")).where("n > 1").select("subject", F.lit("DUPLICATE_PATH").alias("fault"))
    lost = memberships.join(members.select("member").distinct(), "member", "left_anti").select(F.col("member").alias("subject"), F.lit("UNDECLARED_MEMBER").alias("fault")).distinct()
    return twice.unionByName(lost)


def scan_budget(entries: DataFrame, archive: str, path: str, size: str, most: dict[str, int]) -> DataFrame:
    """(archive, entries, bytes, depth, longest, fault) against bounds `entries`, `bytes`, `depth` and `file`; the first
    that is broken is named. Totals are summed before the shuffle, so a large archive is no large group."""
    totals = entries.groupBy(archive).agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"), F.max(F.size(F.split(path, "/"))).alias("depth"), F.max(size).cast("long").alias("longest"))
    fault = None
    for name, column in (("entries", "entries"), ("bytes", "bytes"), ("depth", "depth"), ("file", "longest")):
        over = F.col(column) > most[name]
        fault = F.when(over, f"{name}_limit") if fault is None else fault.when(over, f"{name}_limit")
    return totals.withColumn("fault", fault)


def restored(sealed: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, status) of a sealed plan (path, sha256) against stored bytes (sha256 of the name, content): ready, missing, damaged."""
    held = blobs.select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("_sound"))
    return sealed.join(held, "sha256", "left").select("path", F.when(F.col("_sound").isNull(), "missing").when(F.col("_sound"), "ready").otherwise("damaged").alias("status"))


def entities(claims: DataFrame) -> DataFrame:
    """One row for each identity of the claims (identity, kind, availability, evidence): availability is what all concrete
    claims agree on, else unknown; evidence is that of all of them."""
    by = claims.groupBy("identity").agg(F.min("kind").alias("kind"), F.count_distinct("kind").alias("kinds"), F.collect_set("availability").alias("said"), F.array_sort(F.collect_set("evidence")).alias("evidence"))
    return by.select("identity", "kind", merged_claim(F.col("said"), "unknown").alias("availability"), "evidence", F.when(F.col("kinds") > 1, "KIND_CONFLICT").alias("fault"))


def memberships(applications: DataFrame, entities: DataFrame, edges: DataFrame, most_evidence: int = 128) -> DataFrame:
    """(application, member, level, evidence, fault): what an application's direct members reach over resolved edges.

    applications: (application, member, evidence), entities: (identity, kind), edges: (id, src, dst, relationship). Ways do not
    go over structural relationships nor on from applications and systems. Each member has the evidence of the way that was
    met first, by the least edge ids; more than `most_evidence` of it is a fault.
    """
    links = edges.where(F.col("dst").isNotNull() & ~F.col("relationship").isin(*STRUCTURAL)).select("src", "dst", "id")
    closed = entities.where(F.col("kind").isin(*TOPS)).select(F.col("identity").alias("member"))
    start = applications.groupBy("application", "member").agg(F.array_sort(F.collect_set("evidence")).alias("evidence")).withColumn("level", F.lit(0))

    def step(at: DataFrame) -> DataFrame:
        out = at.join(closed, "member", "left_anti").join(links, F.col("member") == F.col("src"))
        ways = out.groupBy("application", F.col("dst").alias("to"), "level").agg(F.min_by(F.struct("evidence", "id"), F.col("id")).alias("w"))
        return ways.select("application", F.col("to").alias("member"), F.array_sort(F.array_union("w.evidence", F.array(F.col("w.id").cast("string")))).alias("evidence"), (F.col("level") + 1).alias("level"))

    found = fixpoint(start.select("application", "member", "evidence", "level"), step, ["application", "member"])
    return found.select("application", "member", "level", "evidence", F.when(F.size("evidence") > most_evidence, "EVIDENCE_LIMIT").alias("fault"))


def accounting(statuses: DataFrame, by: str = "status") -> DataFrame:
    """(status, n, share): how many of all are in each status; the counts add up to the whole."""
    counts = statuses.groupBy(by).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row for each status
    return counts.select(by, "n", F.round(F.col("n") / whole, 6).alias("share"))


def category(kind: Column, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """The category that lists a kind."""
    out = None
    for name, kinds in rules.items():
        hit = kind.isin(*kinds)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


RECORD = "record_type string, identity string, kind string, availability string, from_identity string, relationship string, target struct<kind: string, name: string, dynamic: boolean>"


def offline(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Entities and edges of metadata envelopes (evidence, body).

    Entities (identity, kind, availability, evidence, fault) are merged over all records that claim them. Edges (src,
    relationship, resolution, dst, evidence) are references by kind and name: one target resolves them, several are ambiguous
    and none is missing, a dynamic one stays dynamic. Envelopes and records with faults give neither.
    """
    rows = envelopes(raw, body).where("fault is null").select("evidence", F.explode("records").alias("text"))
    records = rows.select("evidence", F.from_json("text", RECORD).alias("r")).select("evidence", "r.*")
    claims = records.where("record_type = 'entity' and identity is not null and kind is not null")
    found = entities(claims.select("identity", "kind", F.coalesce("availability", F.lit("unknown")).alias("availability"), "evidence"))
    targets = found.where("fault is null").select("kind", F.element_at(F.split("identity", "/"), -1).alias("name"), "identity")
    references = records.where("record_type = 'reference' and from_identity is not null and target is not null")
    asked = references.select(F.col("from_identity").alias("src"), "relationship", "evidence", F.col("target.kind").alias("kind"), F.col("target.name").alias("name"), F.coalesce("target.dynamic", F.lit(False)).alias("dynamic")).distinct()
    edges = classified(asked, targets, ["kind", "name"], "identity", ["src", "relationship", "evidence"])
    return found, edges.select("src", "relationship", "resolution", F.col("target").alias("dst"), "evidence")
