"""Origin maps: where characters of a decoded, expanded text come from, as runs of characters and joins of intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut, fixpoint
from ..sources.members import ENCODINGS
from .intervals import containing, overlapping

RUNS = T.StructType(
    [T.StructField("member", T.StringType()), T.StructField("status", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "stop", "raw_start", "raw_width", "decoded_start", "decoded_width", "line", "line_start")]
)


def _widths(codec: str, points: np.ndarray) -> np.ndarray:
    """Bytes of each character: of UTF-8 by its size, of UTF-16 two or four, else one."""
    if codec == "utf-8":
        return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.where(points > 0xFFFF, 4, 2) if codec.startswith("utf-16") else np.ones(len(points), np.int64)


def character_runs(members: DataFrame) -> DataFrame:
    """RUNS of members (member, content, encoding): characters start to stop (exclusive) that stand in one line and have the same
    number of bytes each, in the raw content and in UTF-8; so an offset within a run is a multiplication.

    A run also has its line (from 1) and where that starts. What cannot be decoded is one row with its status; an empty member has
    one empty run. Lines end with CR LF, CR or LF. A member is decoded in the task that reads it and nothing is shuffled.
    """

    def rows(name: str, data: bytes | None, encoding: str | None):
        codec = ENCODINGS.get((encoding or "").lower())
        if data is None or codec is None:
            return [(name, "UNSUPPORTED_ENCODING", *[None] * 8)]
        skipped = 0
        if codec.startswith("utf-16"):
            mark, other = (b"\xff\xfe", b"\xfe\xff") if codec.endswith("le") else (b"\xfe\xff", b"\xff\xfe")
            if data.startswith(other):
                return [(name, "BOM_MISMATCH", *[None] * 8)]
            skipped = 2 * data.startswith(mark)
        try:
            text = data[skipped:].decode(codec)
        except UnicodeError:
            return [(name, "INVALID_ENCODING", *[None] * 8)]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = len(points)
        if not n:
            return [(name, "accepted", 0, 0, skipped, 1, 0, 1, 1, 0)]
        raw, out = _widths(codec, points), _widths("utf-8", points)
        ends = (points == 10) | ((points == 13) & (np.append(points[1:], 0) != 10))
        line = np.concatenate([[0], np.cumsum(ends)[:-1]])
        first = np.flatnonzero(np.concatenate([[True], (raw[1:] != raw[:-1]) | (out[1:] != out[:-1]) | (line[1:] != line[:-1])]))
        raw_at, out_at = (np.concatenate([[0], np.cumsum(w)[:-1]]) for w in (raw, out))
        line_starts = np.concatenate([[0], np.flatnonzero(ends) + 1])
        columns = (first, np.append(first[1:], n), raw_at[first] + skipped, raw[first], out_at[first], out[first], line[first] + 1, line_starts[line[first]])
        return [(name, "accepted", *r) for r in zip(*(c.tolist() for c in columns), strict=True)]

    def run(batches):
        for batch in batches:
            for name, data, encoding in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = list(zip(*rows(name, data, encoding), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(found)], names=RUNS.names)

    return members.select(F.col("member").cast("string"), "content", "encoding").mapInArrow(run, RUNS)


def expanded_segments(sizes: DataFrame, includes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, start, stop, member, source_start, trail) of the text that each root becomes once includes are put in place.

    sizes: (member, chars). includes: (member, start, stop, included): these characters of a member give way to what they include,
    over any number of levels, without cycles and without overlaps. A member's size once expanded comes from the members below it,
    round by round; then offsets go from the roots down. Rows are pieces of the expanded texts; nothing is listed twice that does
    not stand in a text twice. trail: the starts of the includes on the way, which tells pieces apart.
    """
    known = includes.join(sizes.select(F.col("member").alias("included")), "included", "left_semi")
    # Sizes once expanded: members whose includes are all done are added up in each round.
    done = cut(sizes.join(known.select("member").distinct(), "member", "left_anti").select("member", F.col("chars").alias("whole")))
    rest = cut(known)
    while not rest.isEmpty():
        held = rest.join(done.select(F.col("member").alias("included"), "whole"), "included", "left")
        ready = held.groupBy("member").agg(F.bool_and(F.col("whole").isNotNull()).alias("ready"), F.sum(F.col("whole") - (F.col("stop") - F.col("start"))).alias("more")).where("ready")
        new = cut(ready.join(sizes, "member").select("member", (F.col("chars") + F.col("more")).alias("whole")))
        if new.isEmpty():
            raise ValueError("INCLUDE_CYCLE")
        done = cut(done.union(new))
        rest = cut(rest.join(new, "member", "left_anti"))
    # Of each member: its own pieces between includes, and where its includes start in the text that it becomes.
    sized = known.join(done.select(F.col("member").alias("included"), "whole"), "included").join(sizes, "member")
    w = Window.partitionBy("member").orderBy("start")
    placed = cut(sized.select("member", "start", "stop", "included", "chars", F.coalesce(F.sum(F.col("whole") - F.col("stop") + F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"), F.col("whole"), F.lag("stop", 1, 0).over(w).alias("before"), F.lead("start").over(w).isNull().alias("last")))
    ahead = placed.select("member", F.col("before").alias("a"), F.col("start").alias("b"), "shift")
    behind = placed.where("last").select("member", F.col("stop").alias("a"), F.col("chars").alias("b"), (F.col("shift") + F.col("whole") - F.col("stop") + F.col("start")).alias("shift"))
    plain = sizes.join(known.select("member").distinct(), "member", "left_anti").select("member", F.lit(0).cast("long").alias("a"), F.col("chars").alias("b"), F.lit(0).cast("long").alias("shift"))
    pieces = ahead.union(behind).union(plain).where("b > a")
    start = roots.select(F.col("member").alias("root"), "member", F.lit(0).cast("long").alias("base"), F.array().cast("array<bigint>").alias("trail"))
    on = placed.select("member", "start", F.col("included"), "shift")

    def step(at: DataFrame) -> DataFrame:
        return at.join(on, "member").select("root", F.col("included").alias("member"), (F.col("base") + F.col("start") + F.col("shift")).alias("base"), F.concat("trail", F.array(F.col("start"))).alias("trail"))

    found = fixpoint(start, step, ["root", "member", "base", "trail"])
    return found.join(pieces, "member").select("root", (F.col("base") + F.col("a") + F.col("shift")).alias("start"), (F.col("base") + F.col("b") + F.col("shift")).alias("stop"), "member", F.col("a").alias("source_start"), "trail")


def span_origins(spans: DataFrame, segments: DataFrame, runs: DataFrame, width: int = 256) -> DataFrame:
    """(span, root, at, member, source_start, source_stop, byte_start, byte_stop, decoded_start, decoded_stop, start_line, start_column,
    end_line, end_column) of each stretch of spans (span, root, start, stop) of expanded texts, in their order.

    Spans meet segments, and both ends of what they share meet the runs of the member, by joins of intervals on bins.
    """
    met = overlapping(spans.select("span", F.col("root"), F.col("start").alias("x"), F.col("stop").alias("y")), segments.select("root", "start", "stop", F.col("member"), "source_start"), "root", ("x", "y"), ("start", "stop"), width)
    at = F.greatest("x", "start")
    met = met.select("span", "root", at.alias("at"), F.col("member").cast("string").alias("member"), (F.col("source_start") + at - F.col("start")).alias("source_start"), (F.col("source_start") + F.least("y", "stop") - F.col("start")).alias("source_stop"))
    met = met.withColumn("last", F.col("source_stop") - 1)
    good = runs.where("status = 'accepted'").withColumnsRenamed({"start": "run_start", "stop": "run_stop"}).drop("status")
    ids = ["span", "root", "at", "member", "source_start", "source_stop", "last"]
    first = containing(met, good, "member", "source_start", "run_start", "run_stop", width)
    into = F.col("source_start") - F.col("run_start")
    first = first.select(*ids, (F.col("raw_start") + into * F.col("raw_width")).alias("byte_start"), (F.col("decoded_start") + into * F.col("decoded_width")).alias("decoded_start"), F.col("line").alias("start_line"), (F.col("source_start") - F.col("line_start") + 1).alias("start_column"))
    end = containing(first.withColumnRenamed("decoded_start", "from"), good, "member", "last", "run_start", "run_stop", width)
    past = F.col("source_stop") - F.col("run_start")
    return end.select("span", "root", "at", "member", "source_start", "source_stop", "byte_start", (F.col("raw_start") + past * F.col("raw_width")).alias("byte_stop"), F.col("from").alias("decoded_start"), (F.col("decoded_start") + past * F.col("decoded_width")).alias("decoded_stop"), "start_line", "start_column", F.col("line").alias("end_line"), (F.col("source_stop") - F.col("line_start") + 1).alias("end_column"))
