"""Document fingerprints that subtract: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Each digest stands in one cell of each of the tables; the cells of a table at least, and paragraphs for each of them in a fingerprint.
TABLES, BASE_CELLS, PER_CELL = 3, 4, 4
#: A failed peeling is tried again with so many times the cells.
LARGER = 4
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_CHECK, _NTH = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xA0761D6478BD642F)
#: A line is cut after a word whose last bytes hash to zero in so many bits, so paragraphs have eight words or so.
CUT_BITS = 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _CHECK
    return x ^ (x >> np.uint64(29))


def paragraphs(data: bytes) -> np.ndarray:
    """Digests of a text's paragraphs: lines, cut further where their content says so, hence alike in any place.

    The n-th copy of a paragraph has its own digest. An empty text has none.
    """
    if not data:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(b == 32)
    padded = np.concatenate([np.zeros(6, np.uint32), b.astype(np.uint32)])
    h = np.zeros(len(gaps), np.uint32)
    for back in range(1, 7):
        h = h * np.uint32(0x01000193) + padded[gaps + 6 - back]
    cuts = gaps[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CUT_BITS) == 0]
    ends = np.union1d(cuts, np.flatnonzero(b == 10)) + 1
    at = [0, *ends.tolist()]
    if at[-1] != len(data):
        at.append(len(data))
    out = np.array([xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(at, at[1:])], np.uint64)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    nth = np.arange(len(out)) - np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
    out[order] = ranked + nth.astype(np.uint64) * _NTH
    return out


def _places(digests: np.ndarray, cells: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A digest's cell in each table. cells: of one table, a power of two; offset: of its sketch's first cell."""
    return np.stack([offset + k * cells + (_mixed(digests * salt) >> np.uint64(20)).astype(np.int64) % cells for k, salt in enumerate(_SALTS)])


#: A cell as it stands in a fingerprint, and the bits of a check that count.
_CELL, _LOW = np.dtype([("n", "<i2"), ("k", "<u8"), ("c", "<u4")]), np.uint64(0xFFFFFFFF)


class Sketches:
    """Many sketches side by side: counts, sums of digests and of their checks, which add and subtract cell by cell."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.offsets = np.concatenate([[0], np.cumsum(cells * TABLES)])
        self.count = np.zeros(self.offsets[-1], np.int64)
        self.key, self.check = np.zeros(self.offsets[-1], np.uint64), np.zeros(self.offsets[-1], np.uint64)

    def add(self, digests: np.ndarray, of: np.ndarray, sign: np.ndarray) -> None:
        """Puts each digest into its sketch, or takes it out of it where the sign is -1."""
        signed = sign.astype(np.uint64)
        key, check = digests * signed, _mixed(digests) * signed
        for at in _places(digests, self.cells[of], self.offsets[of]):
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    def texts(self) -> list[str]:
        """Each sketch as text: count, sum and check of each cell in base64."""
        raw = np.zeros(len(self.count), _CELL)
        raw["n"], raw["k"], raw["c"] = self.count, self.key, self.check & _LOW
        data, width = raw.tobytes(), raw.dtype.itemsize
        return [base64.b64encode(data[a * width : b * width]).decode() for a, b in zip(self.offsets, self.offsets[1:])]

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """How many digests each difference has, and whether all of them were recovered."""
        owner = np.repeat(np.arange(len(self.cells)), self.cells * TABLES)
        found = np.zeros(len(self.cells), np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            digest = self.key[look] * sign.astype(np.uint64)
            pure = (self.check[look] * sign.astype(np.uint64) ^ _mixed(digest)) & _LOW == 0
            mine = np.unique(np.rec.fromarrays([owner[look[pure]], digest[pure], sign[pure]], names="of,digest,sign"))
            if not len(mine):
                break
            of, digest, sign = mine["of"].astype(np.int64), np.ascontiguousarray(mine["digest"]), np.ascontiguousarray(mine["sign"])
            found += np.bincount(of, minlength=len(found))
            self.add(digest, of, -sign)
            touched = np.unique(_places(digest, self.cells[of], self.offsets[of]))
            look = touched[np.abs(self.count[touched]) == 1]
        left = np.bincount(owner, ((self.count != 0) | (self.key != 0)).astype(float), minlength=len(found))
        return found, left == 0


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return (np.concatenate(lists) if lists else np.zeros(0, np.uint64)), of


def _size_class(paragraphs: np.ndarray) -> np.ndarray:
    """Cells of a table for so many paragraphs: a power of two, so that a larger sketch folds into a smaller one."""
    wanted = np.maximum(BASE_CELLS, -(-paragraphs // PER_CELL))
    return 1 << np.ceil(np.log2(wanted)).astype(np.int64)


def fingerprints(lists: list[np.ndarray]) -> list[str]:
    """The text form of each list's sketch, after the number of its paragraphs; its size follows from that number alone."""
    s = Sketches(_size_class(np.array([len(x) for x in lists], np.int64)))
    digests, of = _flat(lists)
    s.add(digests, of, np.ones(len(of), np.int64))
    return [f"{len(x)}:{t}" for x, t in zip(lists, s.texts(), strict=True)]


def near(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, from these alone: the share of paragraphs in common, 1 for two empty ones.

    The larger sketch folds to the smaller one's size, the two subtract, and peeling gives the number of paragraphs by which they
    differ. A pair that differs by more than its cells give back (about three quarters of the paragraphs of the smaller one) has that
    number estimated from the squares of the cells' counts, whose sum is that number on average, with an error of about the
    root of 2 / (3 cells).
    """
    numbers, cells = np.zeros((2, len(a)), np.int64), np.zeros(len(a), np.int64)
    parts: list[list[np.ndarray]] = [[], []]
    for i, pair in enumerate(zip(a, b, strict=True)):
        raw = []
        for side, text in enumerate(pair):
            n, data = text.split(":")
            numbers[side, i] = int(n)
            raw.append(np.frombuffer(base64.b64decode(data), _CELL))
        cells[i] = min(map(len, raw)) // TABLES
        for side in (0, 1):
            parts[side].append(raw[side].reshape(TABLES, -1, cells[i]))
    s = Sketches(cells)
    for side, sign in ((0, np.int64(1)), (1, np.int64(-1))):
        for name, to in (("n", s.count), ("k", s.key), ("c", s.check)):
            folded = [x[name].astype(to.dtype).sum(axis=1).ravel() for x in parts[side]]
            if folded:
                to += np.concatenate(folded) * sign.astype(to.dtype)
    squares = np.add.reduceat(s.count**2, s.offsets[:-1]) / TABLES if len(a) else np.zeros(0)
    found, whole = s.peel()
    apart, both = numbers[0] - numbers[1], numbers.sum(axis=0)
    estimate = np.clip((squares - apart**2 / np.maximum(cells, 1)) / (1 - 1 / np.maximum(cells, 2)), np.maximum(np.abs(apart), found), both)
    return 1.0 - np.where(whole, found, estimate) / np.maximum(both, 1)


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """By how many paragraph digests two versions differ, all of them recovered.

    Sketches subtract and are peeled; where cells are left, the pair is sketched anew with more cells. The first size
    follows from the number of paragraphs by which the pair differs at least.
    """
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    differ, todo = np.zeros(len(a), np.int64), np.arange(len(a))
    cells = np.full(len(a), BASE_CELLS)
    while np.any(small := cells * TABLES < np.abs(na - nb)):
        cells[small] *= LARGER
    while len(todo):
        s = Sketches(cells[todo])
        for lists, sign in ((a, 1), (b, -1)):
            digests, of = _flat([lists[i] for i in todo])
            s.add(digests, of, np.full(len(of), sign, np.int64))
        n, whole = s.peel()
        differ[todo[whole]] = n[whole]
        todo = todo[~whole]
        cells[todo] *= LARGER
    return differ


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by bisection."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(bounds))


NEIGHBOURS = "part int, copy int, doc_id long, text string"


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range in descending order and after it (copy = 1) the row that follows it.

    Null ids come last; rows of one id are in the order of their texts. The range after the last is the first. Texts are
    shuffled once; only one id for each range comes to the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = common.texts(docs).withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key"))
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [k / min(4 * n, 256) for k in range(1, min(4 * n, 256))], 0.002)})
    fine = max(1, -(-4 * n // 256))
    part = _range_of(F.col("key"), bounds)
    if fine > 1 and len(bounds) > 1:  # equal widths within a range
        spans = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(max(1, b - a))).alias("w")) for a, b in zip([bounds[0], *bounds], [*bounds, bounds[-1] + 1])])
        span = F.element_at(spans, part + 1)
        within = F.least(F.greatest(F.floor((F.col("key") - span["lo"]) / span["w"] * fine), F.lit(0)), F.lit(fine - 1))
        part = (part * fine + within).cast("int")
    heads = sorted((r["part"], r["key"]) for r in ids.groupBy(part.alias("part")).agg(F.max("key").alias("key")).collect())
    to = [(key, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, key) in enumerate(heads)]
    copies = F.broadcast(spark.createDataFrame(to, "head long, dest int"))  # one row for each range
    both = src.join(copies, F.col("key") == F.col("head"), "left")
    here = F.explode(F.when(F.col("dest").isNull(), F.array(F.struct(part.alias("part"), F.lit(0).alias("copy")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(0).alias("copy")), F.struct(F.col("dest").alias("part"), F.lit(1).alias("copy")))))
    dealt = both.withColumn("at", here).select("at.part", "at.copy", "doc_id", "key", "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "copy", F.desc("key"), "text").select("part", "copy", "doc_id", "text")


FINGERPRINTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
    + [T.StructField(n, T.LongType()) for n in ("n_paragraphs", "differ_edited", "differ_next")]
)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the next document's beginning, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited version, and how alike these and the next document's are: near_* from the
    fingerprints alone, differ_* the paragraph digests that are not in both, recovered from sketches as large as that takes.

    A table of one document has itself as the next one. Null and empty texts have no paragraphs and are alike.
    """

    def flush(rows: list[tuple], following: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for _, t in rows]
        new = [edited(t, f).encode("utf-8", "surrogatepass") for (_, t), f in zip(rows, following, strict=True)]
        a, b = [paragraphs(x) for x in raw], [paragraphs(x) for x in new]
        last = paragraphs(following[-1].encode("utf-8", "surrogatepass"))
        c = [a[i + 1] if i + 1 < len(rows) and following[i] is rows[i + 1][1] else (last if i + 1 == len(rows) else paragraphs(following[i].encode("utf-8", "surrogatepass"))) for i in range(len(rows))]
        n = len(rows)
        # Of the rows after these only what no row here has is fingerprinted once more.
        own = fingerprints(a)
        more = [k for k in range(n) if not (k + 1 < n and c[k] is a[k + 1])]
        after = dict(zip(more, fingerprints([c[k] for k in more]), strict=True))
        following_own = [after[k] if k in after else own[k + 1] for k in range(n)]
        edited_own = fingerprints(b)
        alike, differ = near(own + own, edited_own + following_own), differences(a + a, b + c)
        return common.to_batch(FINGERPRINTS, {"doc_id": [i for i, _ in rows], "n_chars": [len(t) for _, t in rows], "edited_sha256": [hashlib.sha256(x).hexdigest() for x in new], "fingerprint": own, "edited_fingerprint": edited_own, "near_edited": alike[:n], "near_next": alike[n:], "n_paragraphs": [len(x) for x in a], "differ_edited": differ[:n], "differ_next": differ[n:]})

    def run(batches):
        rows, following, size, last = [], [], 0, None  # last: the row that waits for the one after it
        for batch in common.slices(batches):
            for part, copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] == part:
                    rows.append(last[1:])
                    following.append(text)
                    size += len(text)
                    if len(rows) >= 256 or size > 2_000_000:
                        yield flush(rows, following)
                        rows, following, size = [], [], 0
                last = None if copy else (part, doc_id, text)
        if rows:
            yield flush(rows, following)

    return neighbours(docs).mapInArrow(run, FINGERPRINTS)


def op2_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited version's and their likeness.

    A null text is empty; long texts are read whole; rows of one id are ordered by their texts and each have a next one; null
    ids come last; a table of one row is its own next one, and an empty table gives no rows. Other columns are not read.
    """
    return compare_versions(common.table(spark, sf_dir, "documents"))
