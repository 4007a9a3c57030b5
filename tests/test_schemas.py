"""Compiled schemas against a plain validator."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loreforge.operators import schemas

LINE = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1}, "tag": {"enum": ["a", "b", None, 3]}, "more": {"type": "array", "maxItems": 2, "items": {"type": ["string", "null"], "maxLength": 3}}}}
SCHEMA = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False, "$defs": {"line": LINE},
    "properties": {"id": {"type": "string", "pattern": "^[a-z]+-[0-9]$", "minLength": 3}, "kind": {"const": "order"}, "price": {"type": "number", "minimum": 1, "maximum": 99.5}, "on": {"type": "boolean"}, "lines": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/line"}}},
}


def _kind(v):
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}[type(v)]


def _plain(v, s, path="$"):
    if "$ref" in s:
        s = SCHEMA["$defs"]["line"]
    kind = _kind(v)
    names = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    same = lambda a, b: type(a) is type(b) and a == b
    if names and kind not in names and not (kind == "integer" and "number" in names):
        return path, "TYPE"
    if "const" in s and not same(v, s["const"]):
        return path, "CONST"
    if "enum" in s and not any(same(v, w) for w in s["enum"]):
        return path, "ENUM"
    if kind == "string":
        for bad, name in ((len(v) < s.get("minLength", 0), "MIN_LENGTH"), (len(v) > s.get("maxLength", 99), "MAX_LENGTH"), (not re.search(s.get("pattern", ""), v), "PATTERN")):
            if bad:
                return path, name
    if kind in ("integer", "number"):
        if v < s.get("minimum", v):
            return path, "MINIMUM"
        if v > s.get("maximum", v):
            return path, "MAXIMUM"
    if kind == "object":
        for name in s.get("required", ()):
            if name not in v:
                return f"{path}.{name}", "REQUIRED"
        if s.get("additionalProperties") is False and (others := sorted(set(v) - set(s["properties"]))):
            return f"{path}.{others[0]}", "CLOSED"
        for name, inner in s.get("properties", {}).items():
            if name in v and (f := _plain(v[name], inner, f"{path}.{name}")):
                return f
    if kind == "array":
        if len(v) < s.get("minItems", 0):
            return path, "MIN_ITEMS"
        if len(v) > s.get("maxItems", 99):
            return path, "MAX_ITEMS"
        for i, x in enumerate(v):
            if "items" in s and (f := _plain(x, s["items"], f"{path}[{i}]")):
                return f
    return None


def test_faults_against_a_plain_validator(spark):
    rng = random.Random(7)
    odd = ["x", "", 0, 1, -3, 2.5, 100, True, False, None, [], {}, "abc-1", "order", [1], {"n": 1}]
    def line():
        out = {"n": rng.choice([1, 2, 2, 5, rng.choice(odd)]), "tag": rng.choice(["a", "b", None, 3, rng.choice(odd)]), "more": [rng.choice(["a", None, "abc", rng.choice(odd)]) for _ in range(rng.choice([0, 1, 2, 2, 3]))]}
        return {k: v for k, v in out.items() if rng.random() < 0.9} | ({"extra": 1} if rng.random() < 0.05 else {})
    rows = []
    for _ in range(600):
        record = {"id": rng.choice(["abc-1"] * 20 + ["ABC-1", "a"]), "kind": "order", "price": rng.choice([1, 50, 99.5, 2.25, 50, 99.75]), "on": rng.choice([True, False]), "lines": [line() for _ in range(rng.randint(1, 3))]}
        for k in list(record):
            if rng.random() < 0.06:
                record[k] = rng.choice(odd)
            elif rng.random() < 0.05:
                del record[k]
        rows.append(json.dumps(record | ({"zeta": 1, "alpha": 2} if rng.random() < 0.05 else {})))
    rows += [json.dumps(x) for x in odd] + ["{", "nonsense", "", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, r string")
    got = {r.i: r.f for r in frame.select("i", schemas.first_schema_fault(F.col("r"), SCHEMA).alias("f")).collect()}
    kinds = set()
    for i, r in enumerate(rows):
        if r is None:
            want = None
        else:
            try:
                want = _plain(json.loads(r), SCHEMA)
            except ValueError:
                want = "$", "INVALID_JSON"
        assert (tuple(got[i]) if got[i] else None) == want, r
        kinds.add(want and want[1])
    assert kinds >= {None, "TYPE", "CONST", "ENUM", "REQUIRED", "CLOSED", "MIN_LENGTH", "PATTERN", "MINIMUM", "MAXIMUM", "MAX_ITEMS", "MIN_ITEMS", "INVALID_JSON"}


def test_what_is_not_compiled_is_refused(spark):
    with pytest.raises(ValueError, match="SCHEMA_KEYWORD oneOf"):
        schemas.first_schema_fault(F.lit("1"), {"oneOf": []})
    with pytest.raises(ValueError, match="SCHEMA_REFERENCE"):
        schemas.first_schema_fault(F.lit("1"), {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}})
