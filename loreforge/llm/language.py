"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents of each language that the model is fitted on at most, about: those whose ids hash lowest.
TRAIN_DOCS = 700
SLOTS = 4096
#: Languages that are learned at most; a column of more values is no column of languages.
MAX_LANGS = 200
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi", "romance": "ca es fr gl it la oc pt ro", "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv", "celtic": "br cy ga gd", "uralic": "et fi hu", "turkic": "az kk ky tr tt uz", "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur", "dravidian": "kn ml ta te", "sinitic": "zh yue", "austronesian": "id jv ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of hashed runs of one to three characters, in lower case; None if no letter is there.

    Digits, signs and white space are one gap, so that layout does not matter.
    """
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters(points)
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint32)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (points[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    counts = np.zeros(SLOTS)
    for h in (one, two, three):
        counts += np.bincount(h >> np.uint32(20), minlength=SLOTS) / max(1, len(h))
    return np.sqrt(counts / 3).astype(np.float32)


_KNOWN = np.array([chr(i).isalpha() for i in range(0x3000)])


def _letters(points: np.ndarray) -> np.ndarray:
    out = _KNOWN[np.minimum(points, len(_KNOWN) - 1)]
    for i in np.flatnonzero(points >= len(_KNOWN)):
        out[i] = chr(points[i]).isalpha()
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 300.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient descent; y is 1 or -1."""
    n = len(y)
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    z = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    w = ahead = np.zeros(z.shape[1], np.float32)
    step, t = 1.0 / (1.0 + 4.0 * cost), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        grad = ahead - 2 * cost * (z.T @ (side * y * slack))
        new, after = ahead - step * grad, (1 + float(np.sqrt(1 + 4 * t * t))) / 2
        ahead, w, t = new + ((t - 1) / after) * (new - w), new, after
    return w[:-1], float(w[-1])


class Machines:
    """One-versus-one machines over some classes; a class wins by votes, then by its margins."""

    def __init__(self, classes: list[str], x: np.ndarray, y: np.ndarray):
        self.classes, self.pairs = classes, list(combinations(range(len(classes)), 2))
        fitted = []
        for i, j in self.pairs:
            mine = (y == classes[i]) | (y == classes[j])
            fitted.append(fit_svm(x[mine], np.where(y[mine] == classes[i], 1, -1).astype(np.float32)))
        self.weights = np.stack([w for w, _ in fitted]) if fitted else np.zeros((0, x.shape[1]), np.float32)
        self.bias = np.array([b for _, b in fitted], np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The class of each row, and the lowest of its chances against another one."""
        if not self.pairs:
            return [self.classes[0]] * len(x), np.ones(len(x))
        margins = x @ self.weights.T + self.bias
        votes, least = np.zeros((len(x), len(self.classes))), np.full((len(x), len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += margins[:, k] > 0
            votes[:, j] += margins[:, k] <= 0
            least[:, i] = np.minimum(least[:, i], margins[:, k])
            least[:, j] = np.minimum(least[:, j], -margins[:, k])
        best = (votes + 0.5 * np.tanh(least)).argmax(axis=1)
        return [self.classes[k] for k in best], common.sigmoid(3.0 * least[np.arange(len(x)), best])


class Hierarchy:
    """Machines between families, and machines within each."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        of = np.array([family(lang) for lang in langs])
        self.families = Machines(sorted(set(of.tolist())), x, of)
        self.within = {name: Machines(sorted(set(langs[of == name].tolist())), x[of == name], langs[of == name]) for name in self.families.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, sure = self.families.predict(x)
        langs, score = np.empty(len(x), object), np.zeros(len(x))
        for name in set(names):
            mine = np.array([n == name for n in names])
            langs[mine], among = self.within[name].predict(x[mine])
            score[mine] = sure[mine] * among
        return langs, score


_ROWS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])


def train(docs: DataFrame) -> Hierarchy | None:
    """From text and lang outside the held-out fold; None if no such document has a letter."""
    own = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~common.in_fold(F.col("doc_id"), 3, 1))
    sizes = {r[0]: r[1] for r in own.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    span = 1 << 30
    limit = F.element_at(F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, max(1, min(span, span * TRAIN_DOCS // n)))]), F.col("lang"))
    some = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < limit)

    def run(batches):
        for batch in common.slices(batches):
            rows = [(lang, x) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (x := features(t)) is not None]
            yield common.to_batch(_ROWS, {"lang": [lang for lang, _ in rows], "x": [x.astype("<f2").tobytes() for _, x in rows]})

    table = some.select("lang", "text").mapInArrow(run, _ROWS).toArrow()
    raw = sorted(zip(table["lang"].to_pylist(), table["x"].to_pylist(), strict=True))
    if not raw:
        return None
    return Hierarchy(np.stack([np.frombuffer(x, "<f2") for _, x in raw]).astype(np.float32), np.array([lang for lang, _ in raw], object))


PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; `und` with score 0 where no letter is there or nothing was learned.

    Null texts have no letter; long ones are read whole. Rows that repeat are predicted each, equal texts alike. Ties of votes
    go to the larger margin, then to the language first in order. A null id is not held out, and a null lang teaches nothing.
    An empty table gives no rows. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))  # a weight for each slot and pair of classes

    def run(batches):
        for batch in common.slices(batches):
            found = [features(t) for t in batch.column(2).to_pylist()] if model.value else [None] * batch.num_rows
            langs, scores = np.full(len(found), UNKNOWN, object), np.zeros(len(found))
            if known := [i for i, x in enumerate(found) if x is not None]:
                langs[known], scores[known] = model.value.predict(np.stack([found[i] for i in known]))
            yield common.to_batch(PREDICTED, {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": langs.tolist(), "score": scores})

    return docs.select("doc_id", common.in_fold(F.col("doc_id"), 3, 1).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, PREDICTED)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language. Nulls, empty and long texts, repeated rows and empty tables as in identify."""
    return identify(common.table(spark, sf_dir, "documents"))
