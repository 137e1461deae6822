"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0..G.  All grades share one weight vector w over hashed text
features and ordered thresholds t_1 < ... < t_G part the latent score:
P(grade >= g | text) = sigmoid(w.x - t_g).  The expected grade is the sum of
these tail probabilities over g; selection asks for a tail probability.

Features of the whole text: which words and word beginnings occur (case and
outer punctuation dropped) and the share of words of each shape (letters become
``a``/``A``, digits ``0``, runs of one class are joined).  An L1 penalty leaves
few of them with a weight, so long clean texts don't gather noise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from strandloom.llm.common import sliced, trimmed

BUCKETS = 1 << 18
TRAIN_ROWS = 6000
CACHE_WORDS = 1 << 17
BEGINNINGS = (3, 5)
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_OUTER = re.compile(r"\A[\W_]+|[\W_]+\Z")
_KIND = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"))


def shape(word: str) -> str:
    """Letters of a run as ``A`` (all capital) or ``a``, digits as ``0``; runs of one sign joined."""
    if word.isalpha():
        return "A" if word.isupper() else "a"
    if word[:-1].isalpha():
        return ("A" if word[:-1].isupper() else "a") + ("0" if word[-1].isdecimal() else word[-1])
    for pattern, by in _KIND:
        word = pattern.sub(by, word)
    return _RUN.sub(r"\1", word)[:12]


class Hashed(dict):
    """word -> (buckets of the word and its beginnings, bucket of its shape); emptied when full.

    With ``weights``, buckets of words without a weight are left out.
    """

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.used = None if weights is None else set(np.flatnonzero(weights).tolist())

    def __missing__(self, word: str) -> tuple[tuple[int, ...], int]:
        low = word.lower()
        bare = low if low.isalpha() else _OUTER.sub("", low) if not low[:-1].isalpha() else low[:-1]
        digest = xxhash.xxh3_64_intdigest
        buckets = [digest(bare[:n], n) % BUCKETS for n in BEGINNINGS if len(bare) > n]
        buckets.append(digest(bare, 1) % BUCKETS)
        if self.used is not None:
            buckets = [i for i in buckets if i in self.used]
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = (tuple(buckets), digest(shape(word), 2) % BUCKETS)
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their values."""
        words = Counter((text or "").split())
        total, seen, shapes = sum(words.values()), set(), {}
        for word, n in words.items():
            buckets, s = self[word]
            if buckets:
                seen.update(buckets)
            shapes[s] = shapes.get(s, 0) + n
        out = dict.fromkeys(seen, 1.0)
        for s, n in shapes.items():
            out[s] = out.get(s, 0.0) + 4.0 * n / total
        return np.fromiter(out.keys(), np.int32, len(out)), np.fromiter(out.values(), np.float32, len(out))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1..G (columns)."""
        return _sigmoid(score[:, None] - self.thresholds)


def fit_ordinal(index: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, buckets: int = BUCKETS, steps: int = 200, rate: float = 0.1, sparse: float = 4e-4) -> Ordinal:
    """Full-batch proximal Adam on the mean negative log-likelihood plus sparse |w|_1.

    index, value, row: the features in coordinate form.  Buckets on one or two
    rows get no weight.  The thresholds are
    t_1 and positive steps exp(s), so they stay ordered.
    """
    n, top = len(grade), int(grade.max(initial=0))
    if not top:
        return Ordinal(np.zeros(buckets, np.float32), np.full(0, 0.0))
    count = np.bincount(index, minlength=buckets)
    used, common = np.flatnonzero(count > 2), (count > 2)[index]
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    at, value, row = place[index[common]], value[common], row[common].astype(np.int32)
    # thresholds start at the grades' own odds, so that only telling features get weights
    share = np.clip([(grade >= g).mean() for g in range(1, top + 1)], 1e-3, 1 - 1e-3)
    odds = np.log(1 / share - 1)
    w, free = np.zeros(len(used)), np.concatenate((odds[:1], np.log(np.maximum(np.diff(odds), 0.1))))
    m, v = np.zeros(len(used) + top), np.zeros(len(used) + top)
    for step in range(1, steps + 1):
        score = np.bincount(row, value * w[at], n)
        t = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        tail = np.concatenate((np.ones((n, 1)), _sigmoid(score[:, None] - t), np.zeros((n, 1))), axis=1)
        k = np.arange(n)
        p = np.maximum(tail[k, grade] - tail[k, grade + 1], 1e-9)
        slope = tail * (1 - tail)  # of each tail in the score
        d_score = -(slope[k, grade] - slope[k, grade + 1]) / p / n
        d_t = np.zeros(top + 2)
        np.add.at(d_t, grade, slope[k, grade] / p / n)
        np.add.at(d_t, grade + 1, -slope[k, grade + 1] / p / n)
        d_t = d_t[1:-1]
        tails_t = np.cumsum(d_t[::-1])[::-1]
        d_free = np.concatenate(([d_t.sum()], tails_t[1:] * np.exp(free[1:])))
        g = np.concatenate((np.bincount(at, value * d_score[row], len(used)), d_free))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        eta = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-4)
        move = eta * m / (1 - 0.9**step)
        w -= move[: len(used)]
        w = np.sign(w) * np.maximum(np.abs(w) - eta[: len(used)] * sparse, 0)
        free -= np.clip(move[len(used) :], -rate, rate)
    weights = np.zeros(buckets, np.float32)
    weights[used] = w
    return Ordinal(weights, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def train(docs: DataFrame, ratings: DataFrame, rows: int = TRAIN_ROWS) -> Ordinal:
    """Fit on up to ``rows`` rated documents, those with the smallest hashes of their id.

    ``ratings`` has doc_id and grade (int, from 0); null ids and grades are left
    out, an id with several grades has the highest.  Where documents repeat an
    id, the text with the smallest hash is read, so a sampled id gives one row
    whatever the table.  Features are made on the executors from whole texts; the
    driver gets hashed features of ``rows`` rows.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for b in sliced(batches):
            both = [hashed.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([i.tobytes() for i, _ in both], pa.binary()), pa.array([v.tobytes() for _, v in both], pa.binary())], ["doc_id", "grade", "i", "v"])

    pairs = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    one = pairs.groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.select("doc_id", "grade", "text").mapInArrow(trimmed(run), "doc_id long, grade int, i binary, v binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["i"]))
    if not got:
        return Ordinal(np.zeros(BUCKETS, np.float32), np.zeros(0))
    index = [np.frombuffer(r["i"], np.int32) for r in got]
    row = np.repeat(np.arange(len(got)), [len(i) for i in index])
    return fit_ordinal(np.concatenate(index), np.concatenate([np.frombuffer(r["v"], np.float32) for r in got]), row, np.array([r["grade"] for r in got]))


def grade_documents(docs: DataFrame, model: Ordinal, at_least: int | None = None, sure: float = 0.5, names: tuple[str, str, str] = ("expected_grade", "tail", "keep")) -> DataFrame:
    """``docs`` with expected_grade, tail (P(grade >= at_least), default the top grade) and keep (tail >= sure).

    The new columns, called ``names``, replace columns of these names.  Null and empty texts have
    no features: their score is 0.  Without any rating above 0 to learn from,
    expected_grade is 0, tail 1 and every document is kept.  Rows that repeat a
    doc_id or a text are graded each; a text of any length is read whole; an
    empty table gives no rows.
    """
    weights, thresholds = docs.sparkSession.sparkContext.broadcast(model.weights), model.thresholds
    kept = [c for c in docs.columns if c not in names]
    g = (at_least or len(thresholds)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        hashed = Hashed(w)
        for b in sliced(batches):
            score = np.zeros(b.num_rows)
            for k, t in enumerate(b.column("text")):
                i, v = hashed.features(t.as_py())
                score[k] = float((w[i] * v).sum(dtype=np.float64))
            tails = Ordinal(w, thresholds).tails(score)
            tail = tails[:, g] if len(thresholds) else np.ones(len(score))
            new = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= sure)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, [*kept, *names])

    src = docs.select(*kept)
    schema = StructType([*src.schema, *(StructField(n, t()) for n, t in zip(names, (DoubleType, DoubleType, BooleanType), strict=True))])
    return src.mapInArrow(trimmed(run), schema)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades from two 0/1 labels: how many of 'good' and 'not toxic' hold (0, 1, 2); null where a label is."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
