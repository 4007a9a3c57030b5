"""Toxicity by a noisy channel: obfuscated words are decoded by Viterbi search, and the restored text is scored."""

from __future__ import annotations

import re
import unicodedata
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled documents that the classifier is fitted on at most: the ids that hash lowest.
TRAIN_DOCS = 8000
THRESHOLD = 0.3
#: Signs that may count in the language model; other letters share one symbol, and so does what is no letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàáâçèéêëìíîïñòóôùúûœæåøãõ"
GAP, OTHER, SIZE = 0, len(LETTERS) + 1, len(LETTERS) + 2
_SYMBOL = {c: k + 1 for k, c in enumerate(LETTERS)}
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "¡": "i", "*": "aeiou", "#": "h"}
#: Signs that may be put between the letters of a word.
BETWEEN = " .-_*~'`´^,:;/\\|+="
#: Costs of the channel in nats: a sign for a letter, a sign left out, a sign that ends a word, a repeated letter written
#: once or twice.
SUBSTITUTED, LEFT_OUT, KEPT, REPEATED = 1.5, 0.7, 6.0, 0.3
#: Words whose features a worker keeps.
CACHE_WORDS = 300_000
FEATURE_BITS, PREFIXES = 22, (4, 5, 6)

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‚‘’…–—¿"
_TWICE = re.compile(r"([^\W\d_])\1")
#: Three single signs or more with one to three separators between them. No sign is both, so a text is read once.
_SPELT = re.compile(r"(?<!\S)[^\s.\-_*](?:[ .\-_*]{1,3}[^\s.\-_*](?![^\s.\-_*])){2,}")


class CharModel:
    """Chances of a sign after the two before it, from counts of three, smoothed with those of two and of one."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p = (one + 1) / (one.sum() + SIZE)
        p = (two + 5 * p) / (two.sum(axis=1, keepdims=True) + 5)
        self.cost = (-np.log((three + 3 * p[None]) / (three.sum(axis=2, keepdims=True) + 3))).astype(np.float32).tolist()
        self.decoded: dict[str, list[str]] = {}

    def __getstate__(self):
        return self.__dict__ | {"decoded": {}}


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each stretch of a token may stand for, with costs: letters for signs, nothing for signs in between, and
    one or two letters for a run of one."""
    out, at = [], 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        n = end - at
        if c.isalpha():
            ways = [(c, 0.0)] if n == 1 else [(c, REPEATED), (c * 2, 0.0 if n == 2 else REPEATED)]
        else:
            ways = [(letter, SUBSTITUTED) for letter in LEET.get(c, "")]
            if n > 1:
                ways += [(letter * 2, SUBSTITUTED) for letter in LEET.get(c, "")]
            if c in BETWEEN:
                ways.append(("", LEFT_OUT * n))
            if c not in LEET:  # the token as written is scored too
                ways.append((c * n, KEPT if c in BETWEEN else 0.0))
        out.append(ways)
        at = end
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a token.

    States are the last two symbols, with the cheapest way to each; so time and memory are in proportion to the length.
    """
    cost = model.cost
    spent: dict[tuple[int, int], float] = {(GAP, GAP): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for ways in lattice(token):
        after: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (x, y), so_far in spent.items():
            for reading, extra in ways:
                a, b, total = x, y, so_far + extra
                for c in reading:
                    k = _SYMBOL.get(c, OTHER if c.isalpha() else GAP)
                    total += cost[a][b][k]
                    a, b = b, k
                if (a, b) not in after or total < after[a, b]:
                    after[a, b], came[a, b] = total, ((x, y), reading)
        spent = after
        back.append(came)
    at = min(spent, key=lambda s: (spent[s] + cost[s[0]][s[1]][GAP], s))
    readings = []
    for came in reversed(back):
        at, reading = came[at]
        readings.append(reading)
    return "".join(reversed(readings))


def ambiguous(token: str) -> bool:
    """Whether a token has another reading that holds a letter: it has doubled letters, or signs among letters or in their place.
    A word of letters none of which is doubled has itself only."""
    return bool(_TWICE.search(token)) if token.isalpha() else any(c.isalpha() or c in LEET for c in token)


def _decoded(token: str, model: CharModel) -> list[str]:
    """Words of the likeliest reading; those of frequent tokens are kept by the worker."""
    words = model.decoded.get(token)
    if words is None:
        if len(model.decoded) > CACHE_WORDS:
            model.decoded.clear()
        words = model.decoded[token] = _letters(decode(token, model))
    return words


def restore(text: str, model: CharModel) -> set[str]:
    """The distinct words of a text in lower case, as written and as restored.

    Each token with more than one reading goes through the lattice, digits and signs without any letter too. Signs at its edges
    are read both as marks around it and as letters of it, where they stand for some.
    """
    low = text.lower()
    words: set[str] = set()
    for token in set(low.split()):
        if token.isalpha():
            words.add(token)
            if _TWICE.search(token):
                words.update(_decoded(token, model))
            continue
        bare = token.strip(_EDGE)
        words.update((bare, *_letters(bare)))
        if bare and bare.isalpha() and not _TWICE.search(bare) and token.lstrip(_EDGE) != token and token[0] in LEET and not token.startswith(token[0] * 2):
            words.update(_decoded(token.rstrip(".,!?;:"), model))  # a sign in front may be its first letter
        elif ambiguous(body := token.rstrip(".,?;:")):
            front = body if token[0] in LEET else bare
            readings = {bare, front, body} if body[-1] in LEET or token[0] in LEET else {bare}
            for reading in readings:
                if reading and ambiguous(reading):
                    words.update(_decoded(reading, model))
    for found in _SPELT.finditer(low):
        words.update(_letters(decode(found[0], model)))
    words.discard("")
    return words


def _letters(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text)


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings; accents written as marks of their own are put together first."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    mask = (1 << FEATURE_BITS) - 1
    return [crc32(f"w{word}".encode("utf-8", "surrogatepass")) & mask, *(crc32(f"p{word[:n]}".encode("utf-8", "surrogatepass")) & mask for n in PREFIXES if len(word) >= n)]


class Scorer:
    """Logistic regression over the features that go with toxic documents; a text's score is of what it holds, not how often."""

    def __init__(self, chars: CharModel, rows: list[np.ndarray], y: np.ndarray):
        self.chars = chars
        self.known: dict[str, tuple[int, ...]] = {}
        n, positive = len(y), float(y.sum())
        self.bias, self.weights, self.number = -3.0, np.zeros(1), {}
        if not n or not positive or positive == n:
            self.bias = -5.0 if not positive else 5.0
            return
        seen, toxic = np.zeros(1 << FEATURE_BITS, np.int32), np.zeros(1 << FEATURE_BITS, np.int32)
        for row, label in zip(rows, y):
            seen[row] += 1
            if label:
                toxic[row] += 1
        rate = positive / n
        gain = (toxic - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1)
        best = np.flatnonzero(gain > 2.5)
        best = best[(toxic[best] >= 2) & (toxic[best] > 3 * rate * seen[best])]
        self.number = {int(k): i for i, k in enumerate(best)}
        column = np.full(1 << FEATURE_BITS, -1, np.int32)
        column[best] = np.arange(len(best))
        cols = [(lambda c: c[c >= 0])(column[row]) for row in rows]
        flat, owner = np.concatenate(cols), np.repeat(np.arange(n), [len(c) for c in cols])
        w, b = np.zeros(len(best) + 1), float(np.log(rate / (1 - rate)))
        past, past_b = np.full(len(w), 1e-3), 1e-3
        for _ in range(400):
            wrong = common.sigmoid(np.bincount(owner, w[flat], n) + b) - y
            grad = np.bincount(flat, wrong[owner], len(w)) + 0.3 * w
            past += grad**2
            past_b += wrong.sum() ** 2
            w -= 0.3 * grad / np.sqrt(past)
            b -= 0.3 * wrong.sum() / np.sqrt(past_b)
        self.weights, self.bias = w, b

    def score(self, text: str) -> float:
        held: set[int] = set()
        for word in restore(text, self.chars):
            numbers = self.known.get(word)
            if numbers is None:
                if len(self.known) > CACHE_WORDS:
                    self.known.clear()
                numbers = self.known[word] = tuple(self.number[f] for f in word_features(word) if f in self.number)
            held.update(numbers)
        return float(common.sigmoid(np.array([self.bias + self.weights[sorted(held)].sum()]))[0]) if held else float(common.sigmoid(np.array([self.bias]))[0])

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


_COUNTS = T.StructType([T.StructField("three", T.IntegerType()), T.StructField("n", T.LongType())])
_ROWS = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("features", T.BinaryType())])
_TABLE = np.full(0x180, OTHER, np.int32)
_TABLE[[i for i in range(0x180) if not chr(i).isalpha()]] = GAP
_TABLE[[ord(c) for c in LETTERS if ord(c) < 0x180]] = [k for c, k in _SYMBOL.items() if ord(c) < 0x180]


def char_model(docs: DataFrame) -> CharModel:
    """Counts of three signs over all texts outside the held-out fold; at most SIZE^3 sums come to the driver."""

    def run(batches):
        counts = np.zeros(SIZE**3, np.int64)
        for batch in common.slices(batches):
            text = "  ".join(batch.column(0).to_pylist()).lower()
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            k = np.where(points < 0x180, _TABLE[np.minimum(points, 0x17F)], OTHER)
            if len(k) > 2:
                counts += np.bincount((k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:], minlength=SIZE**3)
        at = np.flatnonzero(counts)
        yield common.to_batch(_COUNTS, {"three": at.astype(np.int32), "n": counts[at]})

    own = docs.where(F.col("text").isNotNull() & ~common.in_fold(F.col("doc_id"), 4, 2)).select("text")
    table = own.mapInArrow(run, _COUNTS).groupBy("three").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, np.int64)
    counts[table["three"].to_numpy()] = table["n"].to_numpy()
    return CharModel(counts)


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    chars = char_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def run(batches):
        for batch in common.slices(batches):
            rows = [np.unique(np.array([f for w in restore(t, shared.value) for f in word_features(w)], np.int32)) for t in batch.column(1).to_pylist()]
            yield common.to_batch(_ROWS, {"y": batch.column(0), "features": [r.tobytes() for r in rows]})

    sample = common.labelled_sample(common.texts(docs), labels, "toxic", TRAIN_DOCS)
    table = sample.select("_y", "text").mapInArrow(run, _ROWS).toArrow()
    raw = sorted(zip(table["features"].to_pylist(), table["y"].to_pylist(), strict=True))
    return Scorer(chars, [np.frombuffer(f, "<i4") for f, _ in raw], np.array([y for _, y in raw], np.float64))


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts get the score of a text without features; very long texts, tokens and rules of signs are read whole,
    in time in proportion to their length. Rows that repeat are scored each, equal texts alike. A null id is not held out.
    An empty table gives no rows; without labels of both kinds every row has one score. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # 2^FEATURE_BITS weights at most, and SIZE^3 costs

    def run(batches):
        for batch in common.slices(batches):
            s = np.array([model.value.score(t) for t in batch.column(2).to_pylist()])
            yield common.to_batch(SCORES, {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return common.texts(docs).select("doc_id", common.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "text").mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that are not found toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in common.slices(batches):
            yield batch.filter(pa.array([model.value.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity. Nulls, empty and long texts, repeated rows and empty tables as in classify."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
