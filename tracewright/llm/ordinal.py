"""Quality by ordinal regression: a cumulative-link (proportional odds) model over hashed text.

P(grade <= k) = logistic(threshold_k - score): one weight vector over hashed words, word shapes and a
few measures of the text, shared by all grades, and ordered thresholds. Documents are scored where they are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_by_hash, small_batches

DIM = 1 << 15
#: Labelled rows that the model is fitted on, at most (the first by a hash of the id).
SAMPLE_ROWS = 10_000


def _shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", word[:40])
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", s))


def _slot(kind: str, value) -> int:
    return xxhash.xxh32_intdigest(f"{kind} {value}") % DIM


class Hasher:
    """Sparse features of texts; distinct words are remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _of(self, w: str) -> tuple[int, int]:
        if len(self.known) > 300_000:
            self.known.clear()
        got = self.known[w] = (_slot("w", w.lower()), _slot("s", _shape(w)))
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values): words and shapes by their share, each kind of unit length; measures as buckets of value 0.3."""
        text = text or ""
        words = Counter(text.split())
        n, get = sum(words.values()), self.known.get
        slots, values = [], []
        if n:
            pair = np.array([get(w) or self._of(w) for w in words])
            c = np.fromiter(words.values(), float, len(words))
            for col in (0, 1):
                u, at = np.unique(pair[:, col], return_inverse=True)
                v = np.bincount(at, c)
                slots.append(u)
                values.append(v / np.sqrt((v * v).sum()))
        lines = text.split("\n")
        size = max(1, len(text))
        measures = {"length": int(np.log2(n + 1)), "distinct": int(10 * len(words) / max(1, n)), "word": min(20, len(text) // max(1, n)), "lines": int(10 * len(set(lines)) / len(lines)), "top": int(10 * max(words.values(), default=0) / max(1, n)),
                    "upper": int(10 * sum(map(str.isupper, words)) / max(1, len(words))), "digit": int(20 * len(re.findall(r"\d", text)) / size), "odd": int(20 * len(re.findall(r"[^\w\s]", text)) / size), "short": int(10 * sum(len(x) < 40 for x in lines) / len(lines))}
        slots.append(np.array([_slot(k, v) for k, v in measures.items()]))
        values.append(np.full(len(measures), 0.3))
        return np.concatenate(slots).astype(np.int32), np.concatenate(values).astype(np.float32)


def probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each score (rows) and each threshold (columns)."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -30, 30)))


def thresholds(t: np.ndarray) -> np.ndarray:
    """Ordered thresholds of free parameters: the first one, then the logarithms of the steps."""
    return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def loss_and_gradient(w: np.ndarray, t: np.ndarray, row: np.ndarray, idx: np.ndarray, val: np.ndarray, grade: np.ndarray, pull: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of ``grade`` with a pull of the weights to 0, and its gradient by (w, t)."""
    n, k, at = len(grade), len(t), np.arange(len(grade))
    score = np.bincount(row, w[idx] * val, n)
    up = np.concatenate([np.ones((n, 1)), probabilities(score, thresholds(t)), np.zeros((n, 1))], 1)  # P(grade >= k)
    p = np.maximum(up[at, grade] - up[at, grade + 1], 1e-12)
    d = up * (1 - up)
    g_score = -(d[at, grade] - d[at, grade + 1]) / p / n
    g_theta = np.array([((grade == j + 1) * d[:, j + 1] / p - (grade == j) * d[:, j + 1] / p).sum() / n for j in range(k)])
    later = np.cumsum(g_theta[::-1])[::-1]
    g = np.concatenate([np.bincount(idx, val * g_score[row], len(w)) + pull * w, later[:1], later[1:] * np.exp(t[1:])])
    return float(-np.log(p).mean() + pull * (w * w).sum() / 2), g


def fit_arrays(slots: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, grades: int, steps: int = 250, pull: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of grades 0..grades-1 by full-batch Adam on the mean log-likelihood."""
    row, idx, val = np.repeat(np.arange(len(slots)), [len(s) for s in slots]), np.concatenate(slots), np.concatenate(values).astype(float)
    k = grades - 1
    share = np.clip([(grade <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    w, t = np.zeros(DIM), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m1, m2 = np.zeros(DIM + k), np.zeros(DIM + k)
    for step in range(1, steps + 1):
        _, g = loss_and_gradient(w, t, row, idx, val, grade, pull)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:DIM], t - move[DIM:]
    return w.astype(np.float32), thresholds(t)


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = SAMPLE_ROWS):
    """(weights, thresholds) from at most ``sample_rows`` rows (id, grade 0..grades-1); None without two grades among them.

    Null ids and grades, and grades out of range, are left out.
    """
    small_batches(docs.sparkSession)
    rows = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("y")).dropna().where(F.col("y").between(0, grades - 1)).distinct()
    rows = cut(first_by_hash(rows, sample_rows, "id", "y"), "ratings")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("y", "text")

    def each(batches):
        of = Hasher()
        for b in batches:
            got = [of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["y", "slots", "values"])

    data = found.mapInArrow(each, "y int, slots binary, values binary").toArrow()  # bounded by the sample
    data = data.sort_by([("y", "ascending"), ("slots", "ascending"), ("values", "ascending")])
    grade = np.array(data.column("y").to_pylist(), int)
    if len(set(grade.tolist())) < 2:
        return None
    slots, values = ([np.frombuffer(x.as_py(), t) for x in data.column(c)] for c, t in (("slots", np.int32), ("values", np.float32)))
    return fit_arrays(list(slots), list(values), grade, grades)


def score(docs: DataFrame, model, grades: int, tail: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, expected_grade, p_tail)`` of every row: the mean grade, and the probability of grade ``tail`` or better.

    Null texts are scored like empty ones. Without a model both are those of a coin: all grades alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model or (np.zeros(DIM, np.float32), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def each(batches):
        (w, theta), of = shipped.value, Hasher()
        for b in batches:
            s = np.array([float(w[i] @ v) for i, v in map(of, b.column(1).to_pylist())])
            up = probabilities(s, theta)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(up.sum(1)), pa.array(up[:, tail - 1])], ["id", "expected_grade", "p_tail"])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, expected_grade double, p_tail double")
