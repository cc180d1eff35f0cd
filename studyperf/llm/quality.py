"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is a sum of hashed features' weights; ordered thresholds t1 < t2 part the grades: P(grade >= k) = sigmoid(score - t_k). All
thresholds share the weights. From it come the expected grade and the tail probability P(grade >= keep), by which documents are selected. Features, all counted over the whole text: which
beginnings of words (3 to 5 letters, without case) occur, and how frequent each shape of their ends is (capitals, digits, symbols), and repeats of the word before.

Training takes at most about SAMPLE labelled documents a grade, chosen by a hash of their ids, and minimises the log loss with an L1 penalty by accelerated proximal steps.
Null, empty and blank texts have no features: the thresholds alone decide. Long texts are read whole. Several labels for a document: the lowest grade holds. Grades that no label has keep their thresholds at the edge, so the scale stays the same. No labels at all: every document is kept, with null scores. No documents: an empty result. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .langid import sampled

SAMPLE = 2500
#: Grades 0 (toxic), 1 (of low quality), 2 (good), whichever of them the labels hold.
GRADES = 3
BITS = 18
CACHE = 400_000


def _shape(tail: str) -> str:
    case = "-" if not any(map(str.isalpha, tail)) else "X" if tail.upper() == tail else "x"
    return case + ("9" if any(map(str.isdigit, tail)) else "") + "".join(sorted({c for c in tail if not c.isalnum()}))


def _bin(name: str) -> int:
    return xxhash.xxh64_intdigest(name) >> 64 - BITS


class Features:
    """A text's features: bins and values. What beginnings and ends of words give is kept, up to CACHE of them."""

    def __init__(self):
        self.heads: dict[str, tuple[int, ...]] = {}
        self.tails: dict[str, int] = {}
        self.repeat = _bin("repeat")

    def _head(self, head: str) -> tuple[int, ...]:
        if len(self.heads) > CACHE:
            self.heads.clear()
        low = "".join(filter(str.isalpha, head.lower()))
        out = self.heads[head] = tuple(_bin(f"{n} {low[:n]}") for n in {min(len(low), 3), min(len(low), 4), len(low)} if n)
        return out

    def _tail(self, tail: str) -> int:
        if len(self.tails) > CACHE:
            self.tails.clear()
        out = self.tails[tail] = _bin("shape " + _shape(tail))
        return out

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        there, shapes = set(), Counter()
        for head in {word[:5] for word in words}:
            there.update(self.heads.get(head) or self._head(head))
        for tail, n in Counter([word[-3:] for word in words]).items():
            shapes[self.tails.get(tail) or self._tail(tail)] += n
        if repeats := sum(map(str.__eq__, words, words[1:])):
            shapes[self.repeat] += repeats
        bins = np.fromiter([*there, *shapes], np.int64, len(there) + len(shapes))
        values = np.ones(len(bins), np.float32)
        values[len(there) :] = 5 * np.sqrt(np.fromiter(shapes.values(), np.float32, len(shapes)) / len(words))
        return bins, values


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(bins: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, penalty: float = 6e-4, steps: int = 200, grade_count: int = GRADES) -> Model:
    """Accelerated proximal gradient on the mean log loss of the grades, each grade weighing alike as far as its share is above a tenth."""
    used, at, times = np.unique(np.concatenate(bins), return_inverse=True, return_counts=True)
    rows, x = np.repeat(np.arange(len(bins)), [len(b) for b in bins]), np.concatenate(values).astype(np.float64)
    common = (times >= 3)[at]  # rarer features get no weight
    used, at = np.unique(used[at[common]], return_inverse=True)
    rows, x = rows[common], x[common]
    share = np.bincount(grades, minlength=grade_count) / len(grades)
    weight = (1 / np.maximum(share, 0.1))[grades]
    weight /= weight.sum()
    above = grades[:, None] >= np.arange(1, grade_count)[None, :]
    w, t = np.zeros(len(used)), np.log(np.maximum(1 - above.mean(0), 1e-3) / np.maximum(above.mean(0), 1e-3))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(len(t)))
    vw, vt, speed, rate, last = w.copy(), t.copy(), 1.0, 1.0, np.inf

    def loss(w, t, slope=False):
        z = np.bincount(rows, x * w[at], len(bins))[:, None] - t[None, :]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        lower, upper = np.hstack([np.ones((len(p), 1)), p]), np.hstack([p, np.zeros((len(p), 1))])
        own = np.maximum((lower - upper)[np.arange(len(p)), grades], 1e-12)
        value = -(weight * np.log(own)).sum()
        if not slope:
            return value
        d = np.zeros_like(p)  # of log own by z
        q = p * (1 - p)
        for g in range(grade_count):
            mine = grades == g
            if g:
                d[mine, g - 1] += q[mine, g - 1] / own[mine]
            if g < grade_count - 1:
                d[mine, g] -= q[mine, g] / own[mine]
        d *= -weight[:, None]
        return value, np.bincount(at, x * d.sum(1)[rows], len(used)), -d.sum(0)

    for _ in range(steps):
        value, gw, gt = loss(vw, vt, True)
        while True:
            w2 = vw - rate * gw
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
            t2 = np.maximum.accumulate(vt - rate * gt)
            dw, dt = w2 - vw, t2 - vt
            if loss(w2, t2) <= value + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        vw, vt = w2 + (speed - 1) / faster * (w2 - w), np.maximum.accumulate(t2 + (speed - 1) / faster * (t2 - t))
        w, t, speed, rate = w2, t2, faster, rate * 1.05
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, t)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 of low quality, 2 good. Several labels: the lowest."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text; grades: doc_id, grade. The sample's ids are broadcast: their number is bounded."""
    chosen = sampled(grades, "grade", sample)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            got = [features.of(t or "") for t in batch["text"]]
            yield pd.DataFrame({"grade": batch["grade"], "bins": [b.astype("<i4").tobytes() for b, _ in got], "vals": [v.tobytes() for _, v in got]})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInPandas(featured, "grade int, bins binary, vals binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["grade", "bins", "vals"], ignore_index=True)  # tasks end in any order
    return fit([np.frombuffer(b, "<i4") for b in rows["bins"]], [np.frombuffer(v, np.float32) for v in rows["vals"]], rows["grade"].to_numpy(int))


def _verdicts(model: Model | None, features: Features, texts: pd.Series, keep: int, least: float) -> pd.DataFrame:
    if model is None:
        return pd.DataFrame({"expected_grade": np.full(len(texts), np.nan), "tail_probability": np.nan, "kept": True})
    scores = np.zeros(len(texts))
    for i, text in enumerate(texts):
        bins, values = features.of(text or "")
        scores[i] = model.weights[bins].astype(np.float64) @ values
    tails = model.tails(scores)
    tail = tails[:, keep - 1]
    return pd.DataFrame({"expected_grade": tails.sum(1), "tail_probability": tail, "kept": tail >= least})


def score(docs: DataFrame, model: Model | None, keep: int = 2, least: float = 0.5) -> DataFrame:
    """docs with the columns expected_grade, tail_probability (of grade `keep` or above) and kept in the struct `quality_verdict`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double, kept boolean")
    def verdict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, features = shared.value, Features()
        for part in texts:
            yield _verdicts(model, features, part, keep, least)

    return docs.withColumn("quality_verdict", verdict(F.col("text")))


def select(docs: DataFrame, model: Model | None, keep: int = 2, least: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    scored = score(docs, model, keep, least)
    return scored.where("quality_verdict.kept").select(*(scored[c] for c in docs.columns))
