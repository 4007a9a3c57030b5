"""Schemas compiled to column expressions: the first fault of JSON records, with its path. No record leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FAULT = "struct<path: string, fault: string>"
#: What Spark calls a variant's kind, by the name that a schema has for it.
_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
#: Keywords that are compiled; a schema with others is refused, so that nothing is left unchecked.
KEYWORDS = {"type", "const", "enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "$ref", "$defs", "title", "description", "$schema", "$id"}


def first_schema_fault(record: Column, schema: dict) -> Column:
    """(path, fault) of the first thing that is wrong with a JSON record (text), or null; a null record is not checked.

    A value is checked for its type, then const and enum, its length, pattern or bounds, or its members: those that lack (REQUIRED), those
    that are not in a closed object (CLOSED, at the least name), then each property in the schema's order, or each item in the
    array's. What has a wrong type is not looked into. Patterns are searched for, as in JSON Schema. `$ref` names a definition of `$defs`,
    which may not lead back to itself.
    """
    value = F.try_parse_json(record)
    broken = F.when(record.isNotNull() & value.isNull(), _fault(F.lit("$"), "INVALID_JSON"))
    return F.coalesce(broken, F.when(record.isNotNull(), _first(value, schema, F.lit("$"), schema.get("$defs", {}), ())))


def _fault(path: Column, name: str) -> Column:
    return F.struct(path.alias("path"), F.lit(name).alias("fault"))


def _is(kind: Column, name: str) -> Column:
    found = None
    for start in _KINDS[name]:
        one = F.startswith(kind, F.lit(start))
        found = one if found is None else found | one
    return found


def _equals(value: Column, kind: Column, wanted) -> Column:
    """Whether a variant is this JSON scalar."""
    if wanted is None:
        return _is(kind, "null")
    name, spark = ("boolean", "boolean") if isinstance(wanted, bool) else ("integer", "bigint") if isinstance(wanted, int) else ("string", "string")
    return _is(kind, name) & F.coalesce(F.try_variant_get(value, "$", spark) == F.lit(wanted), F.lit(False))


def _first(value: Column, schema: dict, path: Column, defs: dict, on_way: tuple[str, ...]) -> Column:
    if "$ref" in schema:
        name = schema["$ref"].removeprefix("#/$defs/")
        if name in on_way or name not in defs:
            raise ValueError("SCHEMA_REFERENCE")
        return _first(value, defs[name], path, defs, (*on_way, name))
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"SCHEMA_KEYWORD {sorted(unknown)[0]}")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    faults = []

    def rule(ok: Column, name: str) -> None:
        faults.append(F.when(~F.coalesce(ok, F.lit(False)), _fault(path, name)))

    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rule(_any([_is(kind, n) for n in names]), "TYPE")
    if "const" in schema:
        rule(_equals(value, kind, schema["const"]), "CONST")
    if "enum" in schema:
        rule(_any([_equals(value, kind, w) for w in schema["enum"]]), "ENUM")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    size = F.length(text)
    for key, ok, name, of in (
        ("minLength", lambda n: size >= n, "MIN_LENGTH", "string"), ("maxLength", lambda n: size <= n, "MAX_LENGTH", "string"),
        ("pattern", lambda p: text.rlike(p), "PATTERN", "string"), ("minimum", lambda n: number >= n, "MINIMUM", "number"), ("maximum", lambda n: number <= n, "MAXIMUM", "number"),
    ):
        if key in schema:
            rule(~_is(kind, of) | ok(schema[key]), name)
    if {"required", "properties", "additionalProperties"} & set(schema):
        faults.append(F.when(_is(kind, "object"), _members(value, schema, path, defs, on_way)))
    if {"items", "minItems", "maxItems"} & set(schema):
        faults.append(F.when(_is(kind, "array"), _items(value, schema, path, defs, on_way)))
    return F.coalesce(*faults) if faults else F.lit(None).cast(_FAULT)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _members(value: Column, schema: dict, path: Column, defs: dict, on_way: tuple[str, ...]) -> Column:
    held = F.try_variant_get(value, "$", "map<string,variant>")
    names = F.map_keys(held)
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    faults = [F.when(~F.array_contains(names, name), _fault(at(name), "REQUIRED")) for name in schema.get("required", ())]
    known = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        others = F.array_sort(F.filter(names, lambda n: ~n.isin(*known) if known else F.lit(True)))
        faults.append(F.when(F.size(others) > 0, _fault(F.concat(path, F.lit("."), F.get(others, F.lit(0))), "CLOSED")))
    for name, inner in known.items():
        faults.append(F.when(F.array_contains(names, name), _first(F.try_variant_get(value, f'$["{name}"]', "variant"), inner, at(name), defs, on_way)))
    return F.coalesce(*faults) if faults else F.lit(None).cast(_FAULT)


def _items(value: Column, schema: dict, path: Column, defs: dict, on_way: tuple[str, ...]) -> Column:
    held = F.try_variant_get(value, "$", "array<variant>")
    faults = []
    if "minItems" in schema:
        faults.append(F.when(F.size(held) < schema["minItems"], _fault(path, "MIN_ITEMS")))
    if "maxItems" in schema:
        faults.append(F.when(F.size(held) > schema["maxItems"], _fault(path, "MAX_ITEMS")))
    if "items" in schema:
        each = F.transform(held, lambda x, i: _first(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), defs, on_way))
        faults.append(F.get(F.filter(each, lambda f: f.isNotNull()), F.lit(0)))
    return F.coalesce(*faults)
