"""Binding of names, calls, records and descriptions as joins over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import resolution


def classified(references: DataFrame, targets: DataFrame, on: list[str], target: str, keep: list[str]) -> DataFrame:
    """References (keep, dynamic, the columns of `on`) with what they match: resolution, target (of one match), candidates.

    Targets of a key are gathered before the join, so a reference meets one row; a null key matches nothing.
    """
    by_key = targets.groupBy(*on).agg(F.array_sort(F.collect_set(target)).alias("_found"))
    joined = references.join(by_key, on, "left")
    found = F.coalesce("_found", F.array().cast(by_key.schema["_found"].dataType))
    state = resolution(F.size(found), F.coalesce(F.col("dynamic"), F.lit(False)))
    return joined.select(*keep, state.alias("resolution"), F.when(state == "resolved", found[0]).alias("target"), F.when(state == "ambiguous", found).otherwise(F.array().cast(by_key.schema["_found"].dataType)).alias("candidates"))


def static_calls(calls: DataFrame, programs: DataFrame) -> DataFrame:
    """(call, resolution, target, candidates) of calls (call, target_text, libraries) against programs (library, name, program).

    `LIB/NAME` is looked up in that library only. A bare name is looked up in the call's library list: the first library
    that has it decides, and several programs of it there are ambiguous. A name that starts with & is a variable: dynamic.
    """
    parts = F.split("target_text", "/")
    named = calls.select("call", "libraries", parts, F.startswith("target_text", F.lit("&")).alias("dynamic")).toDF("call", "libraries", "parts", "dynamic")
    qualified = named.where(F.size("parts") == 2).select("call", "dynamic", F.col("parts")[0].alias("library"), F.col("parts")[1].alias("name"))
    exact = classified(qualified, programs, ["library", "name"], "program", ["call"])
    bare = named.where(F.size("parts") != 2).select("call", "dynamic", F.col("parts")[0].alias("name"), "libraries")
    listed = bare.select("call", "dynamic", "name", F.posexplode_outer("libraries").alias("place", "library"))
    hits = listed.join(programs.groupBy("library", "name").agg(F.array_sort(F.collect_set("program")).alias("found")), ["library", "name"], "left")
    first = hits.groupBy("call").agg(F.bool_or("dynamic").alias("dynamic"), F.min_by("found", F.when(F.col("found").isNotNull(), F.col("place"))).alias("found"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    state = resolution(F.size(found), F.col("dynamic"))
    loose = first.select("call", state.alias("resolution"), F.when(state == "resolved", found[0]).alias("target"), F.when(state == "ambiguous", found).otherwise(F.array().cast("array<string>")).alias("candidates"))
    return exact.unionByName(loose)


def shadowed(uses: DataFrame, symbols: DataFrame, main: str = "main") -> DataFrame:
    """Uses (artifact, scope, name, ...) with the symbol they mean: that of their own scope, else that of the main scope."""
    own = symbols.select("artifact", "scope", "name", F.col("symbol").alias("_own"))
    outer = symbols.where(F.col("scope") == main).select("artifact", "name", F.col("symbol").alias("_outer"))
    joined = uses.join(own, ["artifact", "scope", "name"], "left").join(outer, ["artifact", "name"], "left")
    return joined.withColumn("symbol", F.coalesce("_own", "_outer")).drop("_own", "_outer")


def signature_fault(parameters: Column, arguments: Column) -> Column:
    """Why arguments do not fit parameters (arrays of (datatype, dimensions) structs, by position); null if they do."""
    pairs = F.zip_with(parameters, arguments, lambda p, a: p["datatype"].eqNullSafe(a["datatype"]) & p["dimensions"].eqNullSafe(a["dimensions"]))
    return F.when(F.size(parameters) != F.size(arguments), "ARGUMENT_COUNT").when(~F.forall(pairs, lambda same: same), "ARGUMENT_TYPE")


def record_formats(operations: DataFrame, formats: DataFrame) -> DataFrame:
    """(operation, resolution, target, candidates): reads are bound by file, writes and updates by record name.

    operations: (operation, artifact, action, name), formats: (artifact, file, record, format) of the files that an artifact declares.
    """
    reads = operations.where("action = 'read'").select("operation", "artifact", F.col("name").alias("file"), F.lit(False).alias("dynamic"))
    writes = operations.where("action <> 'read'").select("operation", "artifact", F.col("name").alias("record"), F.lit(False).alias("dynamic"))
    return classified(reads, formats, ["artifact", "file"], "format", ["operation"]).unionByName(classified(writes, formats, ["artifact", "record"], "format", ["operation"]))


def related_fields(fields: DataFrame) -> DataFrame:
    """(field, resolution, target, inherited datatype and length) of fields (field, library, file, name, datatype, length, ref_file,
    ref_name): one without a datatype refers to a field of another file in its library and takes what it lacks from it."""
    asking = fields.where("ref_name is not null").select("field", F.lit(False).alias("dynamic"), "library", F.col("ref_file").alias("file"), F.col("ref_name").alias("name"))
    bound = classified(asking, fields, ["library", "file", "name"], "field", ["field"]).drop("candidates")
    source = fields.select(F.col("field").alias("target"), F.col("datatype").alias("_type"), F.col("length").alias("_length"))
    joined = fields.select("field", "datatype", "length").join(bound, "field", "left").join(source, "target", "left")
    return joined.select("field", F.coalesce("resolution", F.lit("none")).alias("resolution"), "target", F.coalesce("datatype", "_type").alias("datatype"), F.coalesce("length", "_length").alias("length"))


def same_name(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """An equi-join whose name matches in any case."""
    return left.withColumn("_low", F.lower(name)).join(right.withColumn("_low", F.lower(name)).drop(name), [*keys, "_low"]).drop("_low")


def spread_status(owned: DataFrame, statuses: DataFrame, order: list[str], default: str) -> DataFrame:
    """(owner, status): the worst status, by place in `order`, of what each owner has over its edges (owner, member)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    worst = owned.join(statuses.select("member", place.alias("place")), "member", "left").groupBy("owner").agg(F.max("place").alias("place"))
    return worst.select("owner", F.when(F.coalesce("place", F.lit(0)) > 0, F.element_at(F.array(*map(F.lit, order)), F.col("place").cast("int"))).otherwise(default).alias("status"))


def one_of_each(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics (subject, code, message) each once, with how often each was given."""
    return diagnostics.groupBy("subject", "code", "message").agg(F.count("*").alias("n"))
