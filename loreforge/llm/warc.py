"""WARC archives written and read by Spark; records are found by verified boundary chains."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of so many bytes and more are stored once; equal ones revisit it.
REVISIT_BYTES = 100
#: Candidates are linked within stretches of so many bytes, then stretches by pointer jumping.
STRETCH = 1 << 20
#: A head has at most so many fields; a candidate with more is none.
HEAD_FIELDS = 64
#: Slots that the digests of shared payloads are hashed to: what is broadcast has at most so many rows.
SLOTS = 1 << 20
#: A file closes after as many records as make up so many bytes on average.
FILE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = re.compile(rb"([\w-]+):[ \t]*(.*)")
_NUMBER = re.compile(rb"\d{1,15}")
_PAGE = re.compile(rb"<urn:page:(-?\d{1,19})>")

CANDIDATES = T.StructType(
    [T.StructField("file", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("stretch", "offset", "exit", "first", "last", "page_id", "payload_bytes")]
    + [T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null html: empty), its digest and bytes."""
    src = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    return src.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})


def records(src: DataFrame, digests: DataFrame) -> DataFrame:
    """A row for each page (as payloads() gives them) with its record as text, without the closing blank lines.

    digests: (page_id, digest, n) of all pages. The smallest page_id of each payload is looked up by digest; only pages whose
    digest falls into a slot of a shared one are shuffled for that, with all others written where they are read. A digest
    that many pages share is summed up before the shuffle, and its pages are split by the skew-join rule. Rows that repeat
    the smallest page_id are responses too; a null page_id is never referred to; line breaks in a url become spaces.
    """
    slot = F.when(F.col("n") >= REVISIT_BYTES, F.pmod(F.xxhash64("digest"), F.lit(SLOTS))).alias("slot")
    shared = digests.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("holder"), F.count("*").alias("copies"))
    shared = shared.where((F.col("copies") > 1) & F.col("holder").isNotNull()).select("digest", F.lit(REVISIT_BYTES).alias("n"), "holder")
    slots = F.broadcast(shared.select(slot).distinct())
    src = src.select("*", slot)
    looked_up = src.join(slots, "slot", "left_semi").join(shared.drop("n"), "digest", "left")
    rows = src.join(slots, "slot", "left_anti").withColumn("holder", F.lit(None).cast("long")).unionByName(looked_up)
    rows = rows.withColumn("again", F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END))
    block = F.when(F.col("again"), F.lit("")).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]+", " ")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def page(col: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("none")), F.lit(">"))

    again = F.col("again")
    return rows.select(
        F.concat(
            F.lit(MAGIC.decode()),
            line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", page(F.col("page_id"))),
            line("WARC-Target-URI", uri),
            F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            line("WARC-Payload-Length", F.col("n").cast("string")),
            line("WARC-Refers-To", F.when(again, page(F.col("holder")))),
            line("WARC-Profile", F.when(again, F.lit(_PROFILE))),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Plain WARC files. One has about FILE_BYTES; beyond 2 GiB, which Spark could not read back, it would only be if its
    pages were 32 times as long as those of the table are on average."""
    src = payloads(pages)
    digests = common.settled(src.select("page_id", "digest", "n"), "warc-digests")
    mean = digests.agg(F.avg("n")).first()[0] or 0
    records(src, digests).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 500)))).text(path)
    common.drop(digests)


def _fields(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """The fields of a head and where its body starts; None at the first line that is no field, or beyond HEAD_FIELDS."""
    fields: dict[bytes, bytes] = {}
    for _ in range(HEAD_FIELDS + 1):
        end = data.find(b"\r\n", at)
        if end == at:
            return fields, at + 2
        found = _FIELD.fullmatch(data[at:end]) if end > 0 else None
        if not found:
            return None
        fields[found[1].lower()] = found[2]
        at = end + 2
    return None


def _page(value: bytes) -> int | None:
    found = _PAGE.fullmatch(value.strip())
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _candidate(data: bytes, at: int) -> tuple | None:
    """What a record that starts here would be, by its head: successor, body, page_id, payload bytes, digest, type, refers_to.

    Bytes of payloads get here too: whatever they hold, they make a candidate or none, and never an error.
    """
    head = _fields(data, at + len(MAGIC))
    if not head:
        return None
    fields, body = head
    length, size = fields.get(b"content-length", b""), fields.get(b"warc-payload-length", b"0")
    if not _NUMBER.fullmatch(length) or not _NUMBER.fullmatch(size):
        return None
    stop = body + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    digest, n = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("ascii", "replace"), int(size)
    return stop + 4, body, _page(fields.get(b"warc-record-id", b"")), n, digest, kind, _page(fields.get(b"warc-refers-to", b""))


def _payload(data: bytes, body: int, stop: int) -> tuple[int, str]:
    """Bytes and digest of a response's payload, which follows the head of its body."""
    start = data.find(b"\r\n\r\n", body, stop)
    payload = memoryview(data)[start + 4 if start >= 0 else body : stop]
    return len(payload), hashlib.sha256(payload).hexdigest()


def _stretch(data: bytes, lo: int, hi: int, read_to: int = 0) -> tuple[list[tuple], int]:
    """Candidates that start in a stretch, in order: offset, exit, first, last, and what the record says.

    exit: where the chain from here leaves the stretch, or -1 if it breaks. The chains form a forest whose roots leave;
    first and last number it in depth-first order, so that x lies on the chain from y if x.first <= y.first <= x.last.

    Payloads are read once at most: a response that starts before the end of the last payload read (`read_to`, which is returned
    too) lies within it, is on no chain from the file's start, and keeps the digest of its head. So nested records cost their
    heads only.
    """
    found, at = {}, data.find(MAGIC, lo, hi + len(MAGIC) - 1)
    while 0 <= at < hi:
        if got := _candidate(data, at):
            to, body, page, n, digest, kind, refers_to = got
            if at >= read_to:
                read_to = to
                if kind == "response":
                    n, digest = _payload(data, body, to - 4)
            found[at] = to, page, n, digest, kind, refers_to
        at = data.find(MAGIC, at + 1, hi + len(MAGIC) - 1)
    below, exits, first, free, roots = dict.fromkeys(found, 1), {}, {}, {}, 0
    for at in sorted(found):
        if (to := found[at][0]) in found:
            below[to] += below[at]
    for at in sorted(found, reverse=True):
        to = found[at][0]
        if to in found:
            exits[at], first[at] = exits[to], free[to]
            free[to] += below[at]
        else:
            exits[at], first[at] = to if to >= hi else -1, roots
            roots += below[at]
        free[at] = first[at] + 1
    return [(at, exits[at], first[at], first[at] + below[at] - 1, *found[at][1:]) for at in sorted(found)], read_to


def candidates(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """Every place in the archives that could be a record, magic inside payloads included."""

    def scan(batches):
        for batch in common.slices(batches, 1):
            name, data = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            read_to = 0
            for k, lo in enumerate(range(0, len(data), stretch)):
                rows, read_to = _stretch(data, lo, min(lo + stretch, len(data)), read_to)
                if rows:
                    offset, leave, first, last, page, size, digest, kind, to = zip(*rows, strict=True)
                    n = len(rows)
                    yield common.to_batch(CANDIDATES, {"file": [name] * n, "stretch": [k] * n, "offset": offset, "exit": leave, "first": first, "last": last, "page_id": page, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": to})

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(scan, CANDIDATES)


def verified(found: DataFrame) -> DataFrame:
    """The candidates on the chain from each file's start.

    Entries of stretches are reached by pointer jumping: the jump doubles in each round, so the rounds are the logarithm
    of the stretches in a file. Only links between stretches take part, never whole files' records.
    """
    links = found.where("exit >= 0").select("file", F.col("offset").alias("at"), "exit")
    targets = links.select("file", F.col("exit").alias("at")).union(links.where("at = 0").select("file", "at")).distinct()
    jump = common.settled(links.join(targets, ["file", "at"], "left_semi"), "warc-jump")
    reached = common.settled(found.where("offset = 0").select("file", F.col("offset").alias("at")), "warc-reached")
    longest = found.agg(F.max("stretch")).first()[0]
    rounds = math.ceil(math.log2(longest + 2)) if longest is not None else 0
    for _ in range(rounds):
        step = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        onward = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        further = common.settled(reached.union(step).distinct(), "warc-reached"), common.settled(jump.join(onward, ["file", "exit"]).select("file", "at", F.col("beyond").alias("exit")), "warc-jump")
        common.drop(reached, jump)
        reached, jump = further
    entries = found.join(reached.withColumnRenamed("at", "offset"), ["file", "offset"], "left_semi").select("file", "stretch", F.col("first").alias("entry"))
    records = common.settled(found.join(entries, ["file", "stretch"]).where("first <= entry and entry <= last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"), "warc-records")
    common.drop(reached, jump)
    return records


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each true record. Digests and sizes of responses are of the payloads as read.

    An empty folder has no records; a broken chain keeps the records before the break; repeated records are kept each.
    """
    found = common.settled(candidates(spark, path), "warc-candidates")
    records = verified(found)
    common.drop(found)
    return records


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives of all pages, reads them back, and returns a row for each record read.

    Null html is an empty payload, null page_id is kept and never referred to, rows that repeat a page are records each, an
    empty table gives no rows, and other columns of the table are not read. The archives are deleted once they are read.
    """
    path = common.shared_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    common.delete(spark, path)
    return found


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), h AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS holder FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder IS NOT NULL AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM h
"""
