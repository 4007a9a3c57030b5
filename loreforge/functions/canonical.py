"""Canonical JSON, its digest and the identities made of it. Keys are in the order of their UTF-16 units."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ASSIGNMENT, BEARER, URI, relative_path_ok

SAFE = 2**53 - 1
_CANONICAL = T.StructType([T.StructField(n, T.StringType()) for n in ("canonical", "sha256", "error")])


def _object(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("DUPLICATE_KEY")
    return dict(sorted(out.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass")))


def _number(text: str) -> int:
    value = Decimal(text)
    if value != value.to_integral_value() or abs(value) > SAFE:
        raise ValueError("UNSAFE_INTEGER" if value == value.to_integral_value() and text.lstrip("-").isdigit() else "INVALID_NUMBER")
    return int(value)


def _constant(_: str):
    raise ValueError("INVALID_NUMBER")


def canonical_json(text: str) -> bytes:
    value = json.loads(text, object_pairs_hook=_object, parse_int=_number, parse_float=_number, parse_constant=_constant)
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8")
    except UnicodeEncodeError as error:
        raise ValueError("INVALID_UNICODE") from error


@F.pandas_udf(_CANONICAL)
def canonical(column: pd.Series) -> pd.DataFrame:
    """Canonical form and digest of JSON text, or why there is none; null stays null."""

    def one(text):
        if text is None:
            return None, None, None
        try:
            raw = canonical_json(text)
            return raw.decode(), hashlib.sha256(raw).hexdigest(), None
        except ValueError as error:
            return None, None, str(error) if str(error).isupper() else "INVALID_JSON"

    return pd.DataFrame([one(t) for t in column], columns=["canonical", "sha256", "error"])


@F.pandas_udf(T.StringType())
def composed(column: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return column.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def canonical_path_ok(path: Column) -> Column:
    """Whether a relative path has one portable spelling: none of its signs are controls or unassigned, no part ends in a dot
    or a space, and it is in NFKC already."""
    ends = F.forall(F.split(path, "/"), lambda p: ~p.rlike("[. ]$"))
    return relative_path_ok(path) & F.coalesce(~path.rlike(r"\p{C}") & ends & (folded(path) == path), F.lit(False))


@F.pandas_udf(T.StringType())
def folded(column: pd.Series) -> pd.Series:
    """Unicode NFKC."""
    return column.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def _folded_key(key: str) -> str:
    return key.lower().replace("-", "_")


def masked(value: str) -> str:
    """What text.mask makes of a string, for strings within JSON."""
    value = re.sub(ASSIGNMENT, r"\1=[REDACTED]", value)
    return re.sub(URI, r"\1[REDACTED]@", re.sub(BEARER, "Bearer [REDACTED]", value))


def scrub(drop: tuple[str, ...] = (), under: tuple[str, ...] | None = None, redact: tuple[str, ...] = ()):
    """A column function over JSON text: keys in `drop` go (anywhere, or only below a key in `under`), values of keys in
    `redact` are replaced whatever they are (a key counts in lower case with `_` for `-`), and credentials within the strings that
    stay are masked where anything is redacted; the result is canonical. What is no JSON becomes null."""
    hidden = {_folded_key(k) for k in redact}

    def walk(value, inside: bool):
        if isinstance(value, list):
            return [walk(v, inside) for v in value]
        if isinstance(value, str) and hidden:
            return masked(value)
        if not isinstance(value, dict):
            return value
        out = {}
        for k, v in value.items():
            if k in drop and (under is None or inside):
                continue
            out[k] = "[REDACTED]" if _folded_key(k) in hidden else walk(v, inside or (under is not None and k in under))
        return out

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else json.dumps(walk(json.loads(canonical_json(text)), False), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return column.map(one)

    return run
