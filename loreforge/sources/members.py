"""Source members: files of archives and folders, their encodings, their lines and fixed columns."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: Bounds of an import: bytes of a member, and how many times its packed size it may have.
MEMBER_BYTES, RATIO = 16 << 20, 1000
# Encodings of members and their codecs.
ENCODINGS = {
    "utf8": "utf-8", "utf-8": "utf-8", "ccsid:1208": "utf-8", "ascii": "ascii", "us-ascii": "ascii", "ccsid:367": "ascii",
    "utf16le": "utf-16-le", "utf-16le": "utf-16-le", "utf-16-le": "utf-16-le", "utf16be": "utf-16-be", "utf-16be": "utf-16-be", "utf-16-be": "utf-16-be", "ccsid:1200": "utf-16-be",
    "ccsid:37": "cp037", "cp037": "cp037", "ccsid:500": "cp500", "cp500": "cp500", "ibm037": "cp037", "ibm500": "cp500",
}
# Columns of a data description line, from 0, the end excluded.
COLUMNS = {"form": (5, 6), "indicators": (6, 16), "specification": (16, 17), "name": (18, 28), "reference": (28, 29), "length": (29, 34), "datatype": (34, 35), "decimals": (35, 37), "usage": (37, 38), "line": (38, 41), "column": (41, 44), "functions": (44, 80)}

_MEMBERS = T.StructType([T.StructField("archive", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("status", T.StringType())])


def folder_members(spark: SparkSession, root: str) -> DataFrame:
    """path, content and digest of each file below a folder that no exclusion names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/", "")
    return files.select(path.alias("path"), "content").where(~text.excluded(F.col("path"))).withColumn("sha256", F.sha2("content", 256))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, content, status of each member of ZIP archives; a member that is not accepted has no content.

    status: accepted, excluded, encrypted, linked, oversized, ratio, path, duplicate (after folding case) or damaged. A
    file that is no archive gives one damaged row.
    """

    def scan(frames):
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        met: set[str] = set()
                        for info in archive.infolist():
                            if info.is_dir():
                                continue
                            status, body = _verdict(info, met), None
                            if status == "accepted":
                                try:
                                    body = archive.read(info)
                                except (zipfile.BadZipFile, NotImplementedError, OSError):
                                    status = "damaged"
                            rows.append((name, info.filename, body, status))
                except zipfile.BadZipFile:
                    rows.append((name, None, None, "damaged"))
            yield pd.DataFrame(rows, columns=_MEMBERS.names)

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, _MEMBERS)
    left_out = (F.col("status") == "accepted") & text.excluded(F.col("path"))
    return found.withColumns({"content": F.when(~F.coalesce(left_out, F.lit(False)), F.col("content")), "status": F.when(left_out, "excluded").otherwise(F.col("status"))})


def _verdict(info: zipfile.ZipInfo, met: set[str]) -> str:
    parts = info.filename.split("/")
    if "\\" in info.filename or ":" in info.filename or any(p in ("", ".", "..") for p in parts):
        return "path"
    folded = info.filename.casefold()
    again = folded in met
    met.add(folded)
    if again:
        return "duplicate"
    if info.flag_bits & 1:
        return "encrypted"
    if info.external_attr >> 16 & 0o170000 == 0o120000:
        return "linked"
    if info.file_size > MEMBER_BYTES:
        return "oversized"
    return "ratio" if info.file_size > RATIO * max(1, info.compress_size) else "accepted"


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])


@F.pandas_udf(_DECODED)
def decoded(content: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """Text of a member by its encoding, or why there is none; a matching byte-order mark is dropped."""

    def one(data, name):
        codec = ENCODINGS.get((name or "").lower())
        if data is None or codec is None:
            return None, "UNSUPPORTED_ENCODING"
        if codec.startswith("utf-16"):
            mark, other = (b"\xff\xfe", b"\xfe\xff") if codec.endswith("le") else (b"\xfe\xff", b"\xff\xfe")
            if data.startswith(other):
                return None, "BOM_MISMATCH"
            data = data.removeprefix(mark)
        try:
            return data.decode(codec), "accepted"
        except UnicodeError:
            return None, "INVALID_ENCODING"

    return pd.DataFrame([one(d, e) for d, e in zip(content, encoding)], columns=_DECODED.names)


def lines(members: DataFrame, key: str, body: str) -> DataFrame:
    """Lines from 1, whatever ends them."""
    return members.select(key, F.posexplode(F.split(body, "\r\n|\r|\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def window(members: DataFrame, key: str, body: str, first: int, last: int, most_bytes: int) -> DataFrame:
    """Lines (key, line_no, line) from first to last with credentials masked, as far as `most_bytes` of the source go."""
    rows = members.select(key, F.posexplode(F.slice(F.split(body, "\n"), first, last - first + 1)).alias("at", "_line"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # last - first + 1 rows at most
    used = rows.withColumn("_used", F.sum(F.octet_length("_line") + 1).over(w)).where(F.col("_used") <= most_bytes)
    return used.select(key, (F.col("at") + first).alias("line_no"), text.mask(F.col("_line")).alias("line"))


def description_columns(line: Column) -> dict[str, Column]:
    """The fixed columns of a data description line, trimmed."""
    padded = F.rpad(line, 80, " ")
    return {name: F.trim(F.substring(padded, a + 1, b - a)) for name, (a, b) in COLUMNS.items()}


def description_kinds(source: DataFrame) -> DataFrame:
    """Lines (key columns, line) with their fixed columns as `d_` columns, what they declare, and whether text beyond
    column 80 makes them a barrier."""
    parts = {f"d_{name}": part for name, part in description_columns(F.col("line")).items()}
    rows = source.where((F.substring("line", 7, 1) != "*") & (F.trim("line") != "")).withColumns(parts)
    kind = (
        F.when(F.col("d_specification") == "R", "record").when(F.col("d_specification") == "K", "key").when((F.col("d_specification") == "") & (F.col("d_name") != ""), "field")
        .when((F.col("d_line") != "") & (F.col("d_column") != ""), "constant").when(F.col("d_functions") != "", "keyword").otherwise("opaque")
    )
    return rows.withColumn("kind", kind).withColumn("overflow", F.length(F.rtrim("line")) > 80)
