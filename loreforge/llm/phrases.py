"""Phrases that stick together, counted on a prefix-free parse: chunks cut where two words say so, each distinct one read once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A phrase has two or three words; it counts from so many occurrences, and so many of a language are returned.
LONGEST, LEAST, TOP = 3, 10, 2000
#: A pair of words ends a chunk and begins the next one if its hash has so many leading zeros: one pair in 16.
CUT_BITS = 4
#: Words that neighbouring chunks share: no phrase is longer by more than one, so each lies within the chunk where it begins.
OVERLAP = LONGEST - 1
#: Bytes of text that a task has in its arrays at a time.
BLOCK = 1 << 20
#: Bits of the filter that says which words or pairs may be frequent; what passes is counted exactly.
FILTER_BITS = 24
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"

CHUNKS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("ends", T.BooleanType())])
GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("a", T.LongType())])

_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAPS)], _KIND[list(_BREAKS)] = 1, 2
_ROOT = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _series(root: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, root, np.uint64)]))


_INVERSE_ROOT = pow(_ROOT, -1, 1 << 64)
_POWERS, _INVERSE = _series(_ROOT, BLOCK), _series(_INVERSE_ROOT, BLOCK)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse; longer ones are made for a block with one very long piece."""
    return (_POWERS, _INVERSE) if n < len(_POWERS) else (_series(_ROOT, n), _series(_INVERSE_ROOT, n))


def _word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: differences of a sum of powers, moved to the word's start."""
    power, inverse = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def _gathered(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of a buffer as Arrow strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[at])])


def _blocks(texts: list[str]) -> Iterator[bytes]:
    """The texts in lower case, with a break between them, in blocks; a long text is cut at its breaks."""
    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower()
        for part in [data] if len(data) <= BLOCK else _BREAK.split(data):
            if held and size + len(part) > BLOCK:
                yield b"\n".join(held)
                held, size = [], 0
            held.append(part)
            size += len(part) + 1
    if held:
        yield b"\n".join(held)


def parse(block: bytes) -> tuple[pa.Array, np.ndarray]:
    """The chunks of a block of text, words parted by one space, and which of them end with their piece.

    A chunk begins with its piece or with a pair of words that is a cut, and goes on to the end of the next such pair; so it
    shares that pair with the chunk after it. Chunks depend on the words around them only, hence alike in every copy.
    """
    b = np.frombuffer(block, np.uint8)
    kind = _KIND[b]
    word = kind == 0
    before = np.concatenate([[False], word[:-1]]) if len(b) else word
    begin = np.flatnonzero(word & ~before)
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, bool)
    end = np.flatnonzero(before & ~word)
    if word[-1]:
        end = np.append(end, len(b))
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])
    new_piece = np.concatenate([[True], breaks[begin[1:]] != breaks[end[:-1]]])
    size = end - begin
    # The words side by side, one space after each.
    keep = word | before
    flat = np.where(word[keep], b[keep], np.uint8(32))
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    ends = starts + size
    h = _word_hashes(flat, starts, ends)
    n = len(starts)
    pair = _mixed(h[:-1] * np.uint64(3) + h[1:]) if n > 1 else np.zeros(0, np.uint64)
    cut = np.zeros(n, bool)
    cut[:-1] = (pair >> np.uint64(64 - CUT_BITS) == 0) & ~new_piece[1:]
    first = np.flatnonzero(cut | new_piece)
    following = np.append(first[1:], n)
    ending = np.append(new_piece[first[1:]], True)
    last = np.where(ending, following - 1, following + OVERLAP - 1)
    return _gathered(flat, starts[first], ends[last]), ending


def chunks(docs: DataFrame) -> DataFrame:
    """The dictionary of the parse, with its frequencies: lang, chunk, ends (with its piece), freq."""

    def run(batches):
        for batch in common.slices(batches, 1024):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, held in by_lang.items():
                for block in _blocks(held):
                    found, ends = parse(block)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(found)), found, pa.array(ends)], names=CHUNKS.names)

    told = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return told.mapInArrow(run, CHUNKS).groupBy("lang", "chunk", "ends").agg(F.count("*").alias("freq"))


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for each row's language, so that a filter holds those of all languages."""
    coded = langs.dictionary_encode()
    names = [int.from_bytes((x or "").encode()[:64].ljust(8, b"\0"), "little") % (1 << 64) for x in coded.dictionary.to_pylist()]
    return _mixed(np.array(names, np.uint64))[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _chunk_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all chunks, where words start and end in them, and each word's chunk."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    spaces = np.flatnonzero(b == 32)
    starts = np.sort(np.concatenate([offsets[:-1], spaces + 1]))
    ends = np.sort(np.concatenate([offsets[1:], spaces]))
    return b, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _gram_hashes(h: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
    """Of each run of n words, by where it starts (those that run out of the chunk have a value of no meaning)."""
    out = h
    for k in range(1, n):
        out = out * np.uint64(0x100000001B3) + np.append(h[k:], np.zeros(k, np.uint64))
    return _mixed(out ^ salt)


def grams(dictionary: DataFrame, n: int, frequent: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, a: how often each run of n words occurs in the texts, by the chunks that hold it.

    A chunk's runs count as often as the chunk does, but for those that begin where the next chunk begins.
    frequent: only runs whose first and last n - 1 words pass this filter.
    """
    at = dictionary.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        bits = at.value
        for batch in common.slices(batches, 8192):
            lang, ends, freq = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            b, starts, stops, of = _chunk_words(batch.column(1))
            last = np.searchsorted(of, np.arange(len(ends)), "right")  # one past a chunk's words
            own = np.where(ends, last, last - OVERLAP)  # one past those that begin here only
            i = np.arange(len(starts))
            good = (i < own[of]) & (i + n <= last[of])
            if bits is not None and len(starts):
                h = _gram_hashes(_word_hashes(b, starts, stops), n - 1, _salts(lang)[of])
                passed = _passes(bits, h)
                good &= passed & np.append(passed[1:], False)
            i = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(of[i])), _gathered(b, starts[i], stops[i + n - 1]), pa.array(freq[of[i]])], names=GRAMS.names)

    counted = dictionary.select("lang", "chunk", "ends", "freq").mapInArrow(run, GRAMS)
    return counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


_SLOTS = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("bits", T.LongType())])


def frequent_filter(counted: DataFrame) -> np.ndarray:
    """A filter of the phrases with LEAST occurrences: 2^24 bits at most, whatever their number."""

    def run(batches):
        for batch in batches:
            b, starts, stops, of = _chunk_words(batch.column(1))
            first = np.searchsorted(of, np.arange(batch.num_rows))
            n = int(np.diff(np.append(first, len(of))).max(initial=1))
            h = _gram_hashes(_word_hashes(b, starts, stops), n, _salts(batch.column(0))[of])[first]
            at = np.unique((h >> np.uint64(64 - FILTER_BITS)).astype(np.int64))
            slot, of = np.unique(at >> 6, return_inverse=True)
            word = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(word, of, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(word.view(np.int64))], names=_SLOTS.names)

    marks = counted.where(F.col("a") >= LEAST).select("lang", "phrase").mapInArrow(run, _SLOTS)
    found = marks.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits, so for counts up to 10^16."""
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (_exact(a) * _exact(a)).cast("decimal(31,0)"), _exact(left) * _exact(right))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of LEAST occurrences has parts of as many; so pairs are counted among frequent words and triples among frequent
    pairs, with a filter of bounded size to begin with. What a score needs is then found by joins.
    """
    dictionary = common.settled(chunks(docs), "phrase-chunks")
    one = common.settled(grams(dictionary, 1), "phrase-words")
    two = common.settled(grams(dictionary, 2, frequent_filter(one)).where(F.col("a") >= LEAST), "phrase-pairs")
    three = common.settled(grams(dictionary, 3, frequent_filter(two)).where(F.col("a") >= LEAST), "phrase-triples")
    common.drop(dictionary)
    words = one.where(F.col("a") >= LEAST)
    totals = one.groupBy("lang").agg(F.sum("a").alias("n"))  # a row for each language

    def part(counts: DataFrame, key: str, name: str) -> DataFrame:
        return counts.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))

    head, tail = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    pairs = two.withColumn("w1", head).withColumn("w2", tail).join(part(words, "w1", "l"), ["lang", "w1"]).join(part(words, "w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
    begins, rest = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    triples = three.withColumn("w1", head).withColumn("w3", tail).withColumn("p1", begins).withColumn("p2", rest)
    for counts, key, name in ((words, "w1", "l1"), (two, "p2", "r1"), (two, "p1", "l2"), (words, "w3", "r2")):
        triples = triples.join(part(counts, key, name), ["lang", key])
    cuts = F.least(F.struct(_score("a", "l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(_score("a", "l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")))
    triples = triples.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inside = three.select("lang", F.explode(F.array(begins, rest)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    pairs = pairs.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50)).drop("longer")
    return _ranked(pairs.unionByName(triples), totals, top)


def _ranked(scored: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first of each language: of each 64th part of it first, then of what these leave."""
    order = "ORDER BY score DESC, a DESC, phrase"
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = parts.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases that stick together.

    Null texts are empty, null languages are `und`; long texts are read whole; rows that repeat count each; phrases with the
    same score and count are in the order of their bytes; a language without phrases, or an empty table, gives no rows. Other
    columns are not read.
    """
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {LEAST}),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, 1 AS k, w[1] AS p, array_to_string(w[2:], ' ') AS q FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE m = 3),
cuts AS (
  SELECT parts.*, x.a AS l, y.a AS r, (1000000 * parts.a * parts.a) // (x.a * y.a) AS score
  FROM parts JOIN f AS x ON x.lang = parts.lang AND x.phrase = parts.p JOIN f AS y ON y.lang = parts.lang AND y.phrase = parts.q),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3) GROUP BY ALL)
SELECT lowest.lang, row_number() OVER best AS rank, lowest.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n::BIGINT AS n, score::BIGINT AS score
FROM lowest JOIN totals ON totals.lang = lowest.lang LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a
WINDOW best AS (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase)
QUALIFY rank <= {TOP}
"""
