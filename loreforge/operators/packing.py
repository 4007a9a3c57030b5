"""Packing facts into a budget."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def budget_prefix(df: DataFrame, request: str, order: str, size: str, budget: int) -> DataFrame:
    """For each request the rows in order whose running size stays within the budget (sizes are not negative).

    Each task first drops what its own rows before it put beyond the budget already, but for the first such row, which keeps
    all later ones out; so of a hot request the window gets a prefix from each task, never all rows.
    """
    place, at = df.columns.index(request), df.columns.index(size)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            keep = []
            for key, n in zip(batch.column(place).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if (key,) != last:
                    last, used = (key,), 0
                keep.append(used <= budget)
                used += n or 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    running = F.sum(size).over(Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.sortWithinPartitions(request, order).mapInArrow(prune, df.schema).withColumn("used", running).where(F.col("used") <= budget)


class _Sums:
    """Sums by size of what has come so far (a Fenwick tree); a size beyond the budget is none."""

    def __init__(self, most: int):
        self.held = [0] * (most + 2)

    def add(self, at: int, n: int) -> None:
        at += 1
        while at < len(self.held):
            self.held[at] += n
            at += at & -at

    def upto(self, at: int) -> int:
        total, at = 0, min(at, len(self.held) - 2) + 1
        while at > 0:
            total += self.held[at]
            at -= at & -at
        return total


#: Parts that the rows of a request are dealt to before its last task.
PARTS = 64


def could_fit(df: DataFrame, request: str, order: list[str], least: str, most: str, budget: int) -> DataFrame:
    """The rows that a greedy packing in order may take; what no task's own rows leave room for goes before the shuffle.

    A row costs `least` at least and `most` at most (whole numbers). If it is taken, all rows of its request before it that cost no
    more than its `least` were taken too, for they had at least its room. So it cannot be taken if what these cost is over the budget
    with it, or if one of them cannot be. Of equal sizes s a task keeps budget / s rows, so about budget * log(budget) of a request,
    however many it has; a second round by (request, part) leaves the last task as many for each of PARTS.
    """
    place, low, high = df.columns.index(request), df.columns.index(least), df.columns.index(most)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums, limit = None, None, budget + 1
        for batch in batches:
            keep = []
            for key, a, b in zip(batch.column(place).to_pylist(), batch.column(low).to_pylist(), batch.column(high).to_pylist(), strict=True):
                if (key,) != last:
                    last, sums, limit = (key,), _Sums(budget), budget + 1
                fits = a is not None and a <= budget and a < limit and sums.upto(a) + a <= budget
                keep.append(fits)
                if not fits:
                    limit = min(limit, b if b is not None else limit)
                elif b <= budget:
                    sums.add(b, a)
            yield batch.filter(pa.array(keep, pa.bool_()))

    pruned = df.sortWithinPartitions(request, *order).mapInArrow(prune, df.schema)
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    return pruned.repartition(F.col(request), part).sortWithinPartitions(request, *order).mapInArrow(prune, df.schema)


def greedy(df: DataFrame, request: str, order: str, size: str, budget: int) -> DataFrame:
    """For each request: rows in order, each taken if it still fits; smaller ones after a skipped row may fit.

    Tasks first drop what cannot be taken (could_fit), so that a hot request's last task has a bounded number of rows of each part.
    It reads its requests row by row in their order and holds a running total only. Sizes only are moved, never texts.
    """
    kinds = dict(df.dtypes)
    rows = could_fit(df.select(request, order, size).where(F.col(size) <= budget), request, [order], size, size, budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, 0
        for batch in batches:
            keep, totals = [], []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (key,) != at:
                    at, used = (key,), 0
                keep.append(fits := n is not None and used + n <= budget)
                used += n if fits else 0
                totals.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals, pa.int64())], names=[request, order, size, "used"]).filter(pa.array(keep, pa.bool_()))

    return rows.repartition(request).sortWithinPartitions(request, order).mapInArrow(run, f"{request} {kinds[request]}, {order} {kinds[order]}, {size} {kinds[size]}, used long")


PACKAGES = "request string, package string, used long, reserved long, facts int, omitted int, fault string"


def _canonical(value) -> bytes:
    """JSON with sorted keys and without gaps, in UTF-8; the parts of a package have ASCII keys, so their order is that of UTF-16 too."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()


def _chunk(ident: str, fact: str, evidence: list[dict], cited: set[str], classification: str) -> bytes:
    """A fact as it stands in a package: its text holds the fact and the records of evidence that nothing before it has cited."""
    text = _canonical({"citations": [{"evidence_id": e["id"], "record": e["record"]} for e in evidence if e["id"] not in cited], "fact": fact, "trust": "untrusted_source_data"})
    return _canonical({"chunk_id": ident, "classification": classification, "evidence_ids": [e["id"] for e in evidence], "text": text.decode(), "token_count": len(text)})


def serialised(requests: DataFrame, candidates: DataFrame, budget: int, reserve: int) -> DataFrame:
    """PACKAGES: the package of each request (request, asked: the evidence ids that it is about, notes) from its candidates (request, place,
    id, fact, evidence: array of (id, record), classification), as canonical JSON whose UTF-8 bytes, all of it counted, stay within
    budget - reserve.

    Candidates come in the order of place and id. One is taken if the whole package with it fits: its own text, the records of evidence that
    is cited for the first time, the list of what is asked but not cited, which gets shorter, the number of facts left out, and the count
    of bytes itself, which is part of what it counts. A request whose empty package is over the budget has the fault
    CONTEXT_BUDGET_EXCEEDED and none; one without candidates has an empty package.

    Sizes are added up, so a candidate costs its own bytes and no new serialisation of the package. A task holds one request's package,
    which the budget bounds; what cannot be taken goes before the shuffle (could_fit: a candidate costs at least its fact, at most all).
    """
    most = budget - reserve

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for ident, fact, evidence, classification in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                known = {e["id"] for e in evidence}
                gone = sum(len(_canonical(e)) + 1 for e in known)  # at most so many bytes leave the list of what is not cited
                low.append(max(0, len(_chunk(ident, fact, evidence, known, classification)) - gone))
                high.append(len(_chunk(ident, fact, evidence, set(), classification)) + 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=[*batch.schema.names, "low", "high"])

    evidence = F.array_sort(F.transform("evidence", lambda e: F.struct(e["id"].cast("string").alias("id"), e["record"].cast("string").alias("record"))))
    told = candidates.select(F.col("request").cast("string").alias("request"), F.col("place").cast("long").alias("place"), F.col("id").cast("string").alias("id"), "fact", evidence.alias("evidence"), "classification")
    rows = told.mapInArrow(sized, T.StructType([*told.schema.fields, T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    counts = told.groupBy("request").agg(F.count("*").alias("n"))
    fitting = could_fit(rows, "request", ["place", "id"], "low", "high", max(0, most)).drop("low", "high")
    heads = requests.select(F.col("request").cast("string").alias("request"), F.array_sort(F.array_distinct(F.col("asked").cast("array<string>"))).alias("asked"), "notes").join(counts, "request", "left")
    both = heads.withColumn("place", F.lit(-(1 << 62)).cast("long")).unionByName(fitting, allowMissingColumns=True).select("request", "place", "id", "fact", "evidence", "classification", "asked", "notes", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["request", "package", "used", "reserved", "facts", "omitted", "fault"]
        schema = pa.schema([("request", pa.string()), ("package", pa.string()), ("used", pa.int64()), ("reserved", pa.int64()), ("facts", pa.int32()), ("omitted", pa.int32()), ("fault", pa.string())])
        head, chunks, size, cited = None, [], 0, set()

        def envelope(taken: int, open_ids: list[str], used: int) -> dict:
            return {"budget": {"count_method": "utf8_bytes", "max": budget, "reserved": reserve, "used": used}, "chunks": [], "limitations": [*(head["notes"] or []), f"{(head['n'] or 0) - taken} retrieved facts omitted."], "omitted_evidence_ids": open_ids, "request": head["request"]}

        def counted(fixed: int) -> int:
            """The bytes of a package whose count of them is a part of it (one digit stands in `fixed`)."""
            used = fixed
            while (now := fixed - 1 + len(str(used))) != used:
                used = now
            return used

        def whole(more: int, ids: set[str], taken: int) -> int:
            # Omitted facts are counted as in the package so far: those after this one are not known yet, and count when it is closed.
            return counted(len(_canonical(envelope(taken, [a for a in head["asked"] if a not in ids], 0))) + size + more + max(0, taken - 1))

        def close() -> list:
            taken = len(chunks)
            used = whole(0, cited, taken)
            if used > most:
                return [head["request"], None, None, reserve, 0, head["n"] or 0, "CONTEXT_BUDGET_EXCEEDED"]
            body = envelope(taken, [a for a in head["asked"] if a not in cited], used)
            text = _canonical(body).replace(b'"chunks":[]', b'"chunks":[' + b",".join(chunks) + b"]", 1)
            return [head["request"], text.decode(), used, reserve, taken, (head["n"] or 0) - taken, None]

        out: list[list] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["asked"] is not None:
                    if head:
                        out.append(close())
                    head, chunks, size, cited = row, [], 0, set()
                    continue
                if not head or row["request"] != head["request"]:
                    continue  # candidates of a request that nobody made
                chunk = _chunk(row["id"], row["fact"], row["evidence"], cited, row["classification"])
                ids = cited | {e["id"] for e in row["evidence"]}
                if whole(len(chunk), ids, len(chunks) + 1) <= most:
                    chunks.append(chunk)
                    size, cited = size + len(chunk), ids
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if head:
            yield pa.RecordBatch.from_pylist([dict(zip(names, close(), strict=True))], schema)

    return both.repartition("request").sortWithinPartitions("request", "place", "id").mapInArrow(run, PACKAGES)
