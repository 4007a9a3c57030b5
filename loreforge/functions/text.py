"""Column expressions over text: masking, digests, budgets, escapes, links, paths. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The credential patterns of the display policy.
ASSIGNMENT = r"""(?i)\b(password|passwd|token|api[_-]?key|secret|authorization)["']?\s*[:=]\s*(?:"[^"\n]*"|'[^'\n]*'|[^\s,;]+)"""
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
URI = r"([A-Za-z][A-Za-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@"
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "private_key", "access_token", "refresh_token", "bearer_token")
# Path patterns that an import leaves out.
EXCLUSIONS = (
    ".git", ".git/*", "node_modules", "node_modules/*", "*/.git", "*/.git/*", "*/node_modules", "*/node_modules/*", ".local", ".local/*", "*/.local", "*/.local/*",
    ".env", ".env.*", "*/.env", "*/.env.*", "*.pem", "*.key", "*.p12",
)


def mask(text: Column) -> Column:
    """The text with credentials replaced; for display only, never before hashing."""
    text = F.regexp_replace(text, ASSIGNMENT, "$1=[REDACTED]")
    return F.regexp_replace(F.regexp_replace(text, BEARER, "Bearer [REDACTED]"), URI, "$1[REDACTED]@")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, neither stemmed nor filtered; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def byte_length(text: Column) -> Column:
    """UTF-8 bytes: an upper bound of a text's tokens."""
    return F.octet_length(F.coalesce(text, F.lit("")))


def hashed_name(kind: Column, ident: Column, suffix: str = "json") -> Column:
    return F.concat(kind, F.lit("/"), F.sha2(ident, 256), F.lit(f".{suffix}"))


def markdown(text: Column) -> Column:
    """HTML entities first, then Markdown's signs, then line breaks."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    text = F.regexp_replace(text, r"([\\`*_{}\[\]()#+.!|>~-])", r"\\$1")
    return F.translate(text, "\r\n", "  ")


def relative_path_ok(path: Column) -> Column:
    """Whether a path has one portable spelling: relative, no empty, `.` or `..` part, no control sign, colon or backslash."""
    parts_ok = F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce((F.length(path) > 0) & (F.octet_length(path) <= 4096) & ~path.rlike(r"[\x00-\x1f\x7f\\:]") & parts_ok, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression: `*` spans separators too, as in the fnmatch rules of the import."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() else c for c in pattern) + "$"


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUSIONS) -> Column:
    """Whether the path or one of the folders above it matches a pattern."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    whole = "|".join(f"(?:{glob_regex(p)[5:-1]})" for p in patterns)
    return F.coalesce(F.exists(above, lambda p: p.rlike(f"(?s)^(?:{whole})$")), F.lit(False))


def zoned_time_ok(text: Column) -> Column:
    """Whether a text is an ISO time with an offset."""
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.lit(False))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def temporal_length(kind: Column, form: Column) -> Column:
    """Display length of a date (L), time (T) or timestamp (Z) by its format."""
    return F.when(kind == "Z", 26).when(kind == "T", 8).when(kind == "L", F.when(form.isin("*ISO", "*USA", "*EUR", "*JIS"), 10).when(form == "*JUL", 6).otherwise(8))


def line_and_column(text: Column, offset: Column) -> Column:
    """(line, column), both from 1, of a character offset from 0; CRLF, CR and LF each end one line."""
    before = F.substr(text, F.lit(1), offset)
    lines = F.split(before, "\r\n|\r|\n")
    return F.struct(F.size(lines).alias("line"), (F.length(F.element_at(lines, -1)) + 1).alias("column"))


def diagram_label(text: Column, most: int = 200) -> Column:
    """A label in which each sign beyond letters, digits and spaces is its number as an entity, of so many characters at most."""
    signs = F.split(F.substring(F.coalesce(text, F.lit("")), 1, most), "")
    coded = F.transform(F.filter(signs, lambda c: c != ""), lambda c: F.when(c.rlike("^[A-Za-z0-9 ]$"), c).otherwise(F.concat(F.lit("#"), F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10), F.lit(";"))))
    return F.array_join(coded, "")


def decoded_base64(text: Column) -> Column:
    """The bytes of a Base64 text in its strict form (full groups of four, padding at the end only), else null."""
    strict = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(strict, F.try_to_binary(text, F.lit("base64")))


def excerpt(text: Column, most: int) -> Column:
    """(text, truncated, limitation): the first characters, and a note where more was there."""
    longer = F.length(text) > most
    return F.struct(F.substring(text, 1, most).alias("text"), longer.alias("truncated"), F.when(longer, F.concat(F.lit("Excerpt of "), F.lit(str(most)), F.lit(" characters"))).alias("limitation"))


def holds_all(text: Column, words: Column) -> Column:
    """Whether a text holds each word as a part, in any case; no words hold."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.forall(words, lambda w: F.contains(low, F.lower(w)))


def backoff_seconds(attempt: Column) -> Column:
    """Five seconds, doubled with each attempt from the second on, twenty at most."""
    return F.least(F.lit(20), F.lit(5) * F.pow(F.lit(2), F.greatest(attempt, F.lit(1)) - 1)).cast("int")
