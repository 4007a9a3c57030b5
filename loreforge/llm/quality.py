"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled documents that the model is fitted on at most: the ids that hash lowest.
TRAIN_DOCS = 6000
THRESHOLD = 0.7
WORD_SLOTS, RANK, EPOCHS, BATCH, RATE = 1 << 15, 8, 12, 128, 0.05
DECAY = 1e-5
#: Each statistic has a slot for its value and one for each bin that it falls into.
STATS = ("repeats", "distinct", "symbols", "capitals", "digits", "bars", "exclamations", "stops", "lines", "word_length", "non_ascii", "spaces", "words", "n_chars")
BINS = 12
_STAT_SLOTS = len(STATS) * (BINS + 1)
SLOTS = WORD_SLOTS + _STAT_SLOTS

_KIND = np.zeros((256, 8), np.float32)
for _chars, _column in (("#$%&*+<=>@\\^_`{}~", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), ("|", 3), ("!?", 4), (".,;:", 5), ("\n", 6), (" \t", 7)):
    _KIND[[ord(c) for c in _chars], _column] = 1


def statistics(text: str, words: list[str], counts: Counter, n_chars: int) -> np.ndarray:
    """Structure statistics and metadata, each between 0 and 1 in the order of STATS."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    symbols, capitals, digits, bars, loud, stops, lines, spaces = (seen @ _KIND).tolist()
    n, size = max(1, len(words)), max(1, len(text))
    repeats = sum(map(eq, words, words[1:])) / n
    high = float(seen[128:].sum())
    return np.array([
        repeats, len(counts) / n, min(1, symbols / n / 3), capitals / size, digits / size, min(1, bars / n), min(1, loud / n / 2), min(1, stops / n), min(1, lines / n),
        min(1, size / n / 20), high / max(1, len(raw)), spaces / size, min(1, np.log2(n + 1) / 20), min(1, np.log2(n_chars + 1) / 24),
    ], np.float32)


def features(text: str, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document; the values of its words have length 1 together."""
    words = text.split()
    counts = Counter(words)
    slots = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % WORD_SLOTS for w in counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(values):
        values /= np.sqrt(values @ values)
    stats = statistics(text, words, counts, n_chars)
    base = WORD_SLOTS + np.arange(len(STATS), dtype=np.int32) * (BINS + 1)
    binned = base + 1 + np.minimum((stats ** 0.5 * BINS).astype(np.int32), BINS - 1)
    return np.concatenate([slots, base, binned]).astype(np.int32), np.concatenate([values, stats, np.full(len(STATS), 0.5, np.float32)])


class FactorisationMachine:
    """y = b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs by half of (sum v x)^2 - sum (v x)^2."""

    def __init__(self, slots: int, rank: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(slots, np.float32)
        self.factors = rng.normal(0, 0.02, (slots, rank)).astype(np.float32)

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of documents whose features stand one after the other; each has some."""
        scaled = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((scaled**2).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + pairs

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Logistic loss by AdaGrad over small batches, in an order that is the same in each run."""
        rng = np.random.default_rng(1)
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = float(np.log(mean / (1 - mean)))
        past_w, past_v, past_b = np.full_like(self.linear, 1e-4), np.full_like(self.factors, 1e-4), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                some = order[at : at + BATCH]
                sizes = np.array([len(rows[i][0]) for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                slots, values = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
                owner = np.repeat(np.arange(len(some)), sizes)
                wrong = (common.sigmoid(self.raw(slots, values, starts)) - y[some]) / len(some)
                scaled = self.factors[slots] * values[:, None]
                sums = np.add.reduceat(scaled, starts, axis=0)
                pull = wrong[owner] * values
                used, place = np.unique(slots, return_inverse=True)
                grad_w = np.bincount(place, pull, len(used)) + DECAY * self.linear[used]
                step = (sums[owner] - scaled) * pull[:, None]
                grad_v = np.stack([np.bincount(place, step[:, k], len(used)) for k in range(step.shape[1])], axis=1) + DECAY * self.factors[used]
                grad_b = float(wrong.sum())
                past_w[used] += grad_w**2
                past_v[used] += grad_v**2
                past_b += grad_b**2
                self.linear[used] -= RATE * grad_w / np.sqrt(past_w[used])
                self.factors[used] -= RATE * grad_v / np.sqrt(past_v[used])
                self.bias -= RATE * grad_b / np.sqrt(past_b)


_FEATURES = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    """The model from labelled documents outside the held-out fold; with no labels at all it gives one score."""

    def run(batches):
        for batch in common.slices(batches):
            rows = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield common.to_batch(_FEATURES, {"y": batch.column(0), "slots": [s.tobytes() for s, _ in rows], "values": [v.astype("<f4").tobytes() for _, v in rows]})

    sample = common.labelled_sample(_inputs(docs), labels, "quality", TRAIN_DOCS)
    table = sample.select("_y", "text", "n_chars").mapInArrow(run, _FEATURES).toArrow()
    rows = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4")) for s, v in zip(table["slots"].to_pylist(), table["values"].to_pylist(), strict=True)]
    y = np.array(table["y"].to_pylist(), np.float32)
    order = np.argsort([crc32(s.tobytes() + v.tobytes()) for s, v in rows], kind="stable") if rows else []
    model = FactorisationMachine(SLOTS, RANK)
    if rows:
        model.fit([rows[i] for i in order], y[order])
    return model


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and its length as metadata, counted where the table has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.coalesce(F.col("n_chars").try_cast("long"), F.length(text).cast("long")) if "n_chars" in docs.columns else F.length(text).cast("long")
    return docs.select("doc_id", text.alias("text"), F.greatest(size, F.lit(0)).alias("n_chars"))


def _size(value, text: str) -> int:
    """The stated length, or the text's where none or no number is stated."""
    try:
        return max(0, int(value))
    except (TypeError, ValueError):
        return len(text)


def scores(model: FactorisationMachine, texts: list[str], sizes: list[int]) -> np.ndarray:
    rows = [features(t, n) for t, n in zip(texts, sizes, strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])[:-1]]).astype(np.int64)
    return common.sigmoid(model.raw(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts)).astype(np.float64)


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts are scored by their statistics; very long ones whole. Rows that repeat are scored each, and equal
    texts of equal n_chars alike. A null id is not held out. An empty table gives no rows; without labels every row has one
    score. n_chars is counted where it lacks or is no number; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # SLOTS * (RANK + 1) numbers

    def run(batches):
        for batch in common.slices(batches):
            s = scores(model.value, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield common.to_batch(SCORES, {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return _inputs(docs).select("doc_id", common.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "text", "n_chars").mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that the classifier does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            sizes = [_size(n, t) for t, n in zip(texts, batch.column(size).to_pylist() if size is not None else [None] * len(texts), strict=True)]
            yield batch.filter(pa.array(scores(model.value, texts, sizes) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality. Nulls, empty and long texts, repeated rows and empty tables as in classify."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
