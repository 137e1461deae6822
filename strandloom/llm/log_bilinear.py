"""Log-bilinear language model, trained with noise-contrastive estimation.

The two tokens before a token, as vectors scaled element by element, add up to a
prediction; its inner product with a token's vector, plus the token's bias, is
the score.  Outputs are the most frequent words (``SHORTLIST``), the end, and a
few kinds of other words (by last byte and by whether all is ASCII).  A word of a
kind has the kind's probability times (c + 1) / (all of the kind + different words
of the kind + 1), so probabilities add up to one over all known words and one
unknown word of each kind.

Counts of all training words come from all training texts by a shuffle.  Words
that make over 1 / ``COMMON`` of all training tokens, at most ``COMMON`` by that,
are looked up in the tasks, which write each document's outputs and its other
words once; those meet their counts in a join.  Every task trains on its
documents from the shared parameters and gives its parameters back; their mean,
weighted by tokens, starts the next round.  A document takes part in one round.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import save, trimmed

SHORTLIST = 1024
COMMON = 1 << 18
KINDS = 32
WIDTH = 16
#: Noise draws for each token; they are estimated by TURN outputs a step.
NOISE = 8
TURN = 48
BATCH = 2048
ROUNDS = 3
RATE = 0.1
#: Bytes of text that a task turns into tokens at once.
BYTES = 1 << 21
#: Partial counts that a task holds before it gives them out.
HELD = 200_000
PARTS = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_F = np.float32


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def words_of(raw: bytes, size: int = BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, A-Z lower-cased, in lists from about ``size`` bytes each."""
    at = 0
    while len(raw) - at > size:
        cut = _SEPARATOR.search(raw, at + size)
        to = cut.start() if cut else len(raw)
        yield raw[at:to].translate(_LOWER).split()
        at = to
    yield raw[at:].translate(_LOWER).split()


def kinds_of(words: list[bytes]) -> np.ndarray:
    """Kind of each word: the low bits of its last byte, 16 more if a byte is not ASCII."""
    if not words:
        return np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    raw = np.frombuffer(b"".join(words), np.uint8)
    starts = np.concatenate([[0], ends[:-1]])
    return (raw[ends - 1] & 15).astype(np.int64) | ((np.bitwise_or.reduceat(raw, starts) >> 7).astype(np.int64) << 4)


def texts_of(batches: Iterable[pa.RecordBatch], size: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches with about ``size`` bytes of text (one row at least), and their texts; null is empty."""
    for b in batches:
        raw = b.column("text").cast(pa.binary())
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(raw).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield b.slice(at, to - at), [t or b"" for t in raw.slice(at, to - at).to_pylist()]
            at = to


def count_words(docs: DataFrame) -> DataFrame:
    """(word, kind, n): all words of all texts; the end is the null word, once a document."""

    def rows(counts: Counter) -> pa.RecordBatch:
        ends = counts.pop(None, 0)
        words = [*counts, None]
        kinds = np.append(kinds_of(words[:-1]), KINDS)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(kinds, pa.int32()), pa.array([*counts.values(), ends], pa.int64())], ["word", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for _, texts in texts_of(batches):
            for raw in texts:
                for words in words_of(raw):
                    held.update(words)
            held[None] += len(texts)
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
        yield rows(held)

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "word string, kind int, n long")
    return parts.where("n > 0").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Common words with their place and count; outputs: places 0 .. end - 1 are the shortlist, then the end, then the kinds."""

    place: dict[bytes, int]
    count: np.ndarray
    output: np.ndarray
    end: int
    ends: int
    tokens: int
    different: int
    kind_tokens: np.ndarray
    kind_words: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, shortlist: int = SHORTLIST, common: int = COMMON) -> Vocabulary:
        """The driver gets at most ``common`` words."""
        by_kind = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        tokens, different = sum(r["n"] for r in by_kind), sum(r["v"] for r in by_kind)
        head = counts.where(F.col("word").isNotNull() & (F.col("n") * common > tokens)).select(F.col("word").cast("binary").alias("word"), "kind", "n").toPandas()
        head["word"] = head["word"].map(bytes)
        head = head.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
        end, n, kind = min(shortlist, len(head)), head["n"].to_numpy(np.int64), head["kind"].to_numpy(np.int64)
        kt, kw = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
        for r in by_kind:
            if r["kind"] < KINDS:
                kt[r["kind"]], kw[r["kind"]] = r["n"], r["v"]
        kt -= np.bincount(kind[:end], n[:end], KINDS).astype(np.int64)
        kw -= np.bincount(kind[:end], minlength=KINDS)
        output = np.where(np.arange(len(head)) < end, np.arange(len(head)), end + 1 + kind)
        return cls({w: i for i, w in enumerate(head["word"])}, n, output, end, sum(r["n"] for r in by_kind if r["kind"] == KINDS), tokens, different, kt, kw)

    @property
    def outputs(self) -> int:
        return self.end + 1 + KINDS

    def unigram(self) -> np.ndarray:
        """Probability of each output, one added to each count."""
        n = np.concatenate([self.count[: self.end], [self.ends], self.kind_tokens]) + 1.0
        return n / n.sum()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Place of each word (-1: not common), its output, and the words that are not common, in order."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        gone = np.flatnonzero(place < 0)
        rare = [words[i] for i in gone.tolist()]
        out = self.output[place] if len(self.output) else np.zeros(len(words), np.int64)
        out[gone] = kinds_of(rare) + self.end + 1
        return place, out, rare


def contexts(outputs: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token before, the one before that (``start`` before a text's first), and the token, of all texts."""
    w = np.concatenate(outputs)
    one, two = np.empty_like(w), np.empty_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    first = np.cumsum([0, *map(len, outputs[:-1])])
    one[first] = two[first] = start
    second = first[np.array([len(o) > 1 for o in outputs])] + 1
    two[second] = start
    return one, two, w


def _summed(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different places and the sums of their rows."""
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")  # short integers sort faster
    own = at[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[starts], np.add.reduceat(g[order], starts, axis=0)


@dataclass
class LogBilinear:
    """r: vectors of context tokens (the last: before the text); q, b: vectors and biases of outputs; c: scale of each context place."""

    p: dict[str, np.ndarray]
    noise: np.ndarray
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, unigram: np.ndarray, width: int = WIDTH, seed: int = 0) -> LogBilinear:
        """Starts at the unigram."""
        rng, m = np.random.default_rng(seed), len(unigram)
        p = {"r": rng.normal(0, 0.1, (m + 1, width)), "q": rng.normal(0, 0.1, (m, width)), "b": np.log(unigram), "c": np.ones((2, width)) * np.array([[1.0], [0.5]])}
        return cls({k: v.astype(_F) for k, v in p.items()}, unigram)

    def predictions(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.p["r"][one] * self.p["c"][0] + self.p["r"][two] * self.p["c"][1]

    def margins(self, h: np.ndarray, w: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores less the logarithm of how often noise draws the output: of w, and of each of the shared ``noise`` outputs."""
        p = self.p
        gap = p["b"] - np.log(NOISE * self.noise).astype(p["b"].dtype)
        return np.einsum("ij,ij->i", h, p["q"][w]) + gap[w], h @ p["q"][noise].T + gap[noise]

    def draws(self, noise: np.ndarray) -> np.ndarray:
        """What each noise output stands for when outputs take turns: ``NOISE`` draws for each token, by the unigram."""
        return (NOISE * len(self.noise) / len(noise) * self.noise[noise]).astype(self.p["b"].dtype)

    def loss(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, noise: np.ndarray) -> float:
        """Mean loss of telling each w from the noise."""
        own, other = self.margins(self.predictions(one, two), w, noise)
        return float((np.logaddexp(0, -own).sum() + (np.logaddexp(0, other) @ self.draws(noise)).sum()) / len(w))

    def gradients(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, noise: np.ndarray) -> dict[str, tuple]:
        """Gradients of the loss as (places, rows)."""
        p, n = self.p, len(w)
        h = self.predictions(one, two)
        own, other = self.margins(h, w, noise)
        gw, gn = -1 / (1 + np.exp(np.minimum(own, 60))) / n, self.draws(noise) / n / (1 + np.exp(-np.maximum(other, -60)))
        gh = gw[:, None] * p["q"][w] + gn @ p["q"][noise]
        gq = np.concatenate([gw[:, None] * h, gn.T @ h])
        gb = np.concatenate([gw, gn.sum(axis=0)])
        at, both = _summed(np.concatenate([w, noise]), np.column_stack([gq, gb]))
        g = {"q": (at, both[:, :-1]), "b": (at, both[:, -1]), "r": _summed(np.concatenate([one, two]), np.concatenate([gh * p["c"][0], gh * p["c"][1]]))}
        g["c"] = (np.arange(2), np.stack([(gh * p["r"][one]).sum(axis=0), (gh * p["r"][two]).sum(axis=0)]))
        return g

    def step(self, g: dict[str, tuple], rate: float = RATE) -> None:
        """AdaGrad on the rows that have a gradient."""
        for k, (at, rows) in g.items():
            acc = self.seen.setdefault(k, np.full_like(self.p[k], 1e-6))
            acc[at] += rows * rows
            self.p[k][at] -= rate * rows / np.sqrt(acc[at])

    def fit(self, one: np.ndarray, two: np.ndarray, w: np.ndarray, rng: np.random.Generator, batch: int = BATCH, turn: int = TURN) -> None:
        """Steps over the tokens in random order, so that a step doesn't follow one document.

        All outputs take turns as noise, ``turn`` a step, with the weight of the
        draws they stand for: drawn by chance, rare ones would go without for long.
        """
        order, m, waiting = rng.permutation(len(w)), len(self.noise), np.zeros(0, np.int64)
        for i in (order[at : at + batch] for at in range(0, len(w), batch)):
            if len(waiting) < min(turn, m):
                waiting = np.concatenate([waiting, rng.permutation(m)])
            noise, waiting = waiting[:turn], waiting[turn:]
            self.step(self.gradients(one[i], two[i], w[i], noise))


class Normaliser:
    """Log of the sum of exp scores, by context; a context is summed over once."""

    def __init__(self, model: LogBilinear, block: int = 1024) -> None:
        self.model, self.block, m = model, block, len(model.p["r"])
        self.known = np.full((m, m), np.nan, _F)

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of normalised probabilities."""
        m, p = len(self.known), self.model.p
        flat = self.known.ravel()
        code = one * m + two
        new = np.unique(code[np.isnan(flat[code])])
        for at in range(0, len(new), self.block):
            own = new[at : at + self.block]
            s = self.model.predictions(own // m, own % m) @ p["q"].T + p["b"]
            top = s.max(axis=1)
            flat[own] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        out = np.empty(len(w))
        for at in range(0, len(w), 1 << 16):
            i = slice(at, at + (1 << 16))
            out[i] = np.einsum("ij,ij->i", self.model.predictions(one[i], two[i]), p["q"][w[i]]) + p["b"][w[i]] - flat[code[i]]
        return out


def _mean(parts: DataFrame, like: LogBilinear) -> LogBilinear:
    """Parameters and AdaGrad sums of all tasks, weighted by tokens; added up in two levels."""
    schema = "part int, weight double, p binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf["weight"].sum()
        total = sum(np.frombuffer(p, np.float64) * (w / max(weight, 1.0)) for p, w in zip(pdf["p"], pdf["weight"], strict=True))
        return pd.DataFrame({"part": [0], "weight": [weight], "p": [total.tobytes()]})

    rows = parts.groupBy("part").applyInPandas(add, schema).toPandas()  # PARTS rows at most
    if not rows["weight"].sum():
        return like
    flat, at, out = np.frombuffer(add(rows)["p"].iloc[0], np.float64), 0, {}
    for side in ("p", "seen"):
        for k, v in like.p.items():
            out[side, k] = flat[at : at + v.size].reshape(v.shape).astype(_F)
            at += v.size
    return LogBilinear({k: out["p", k] for k in like.p}, like.noise, {k: out["seen", k] for k in like.p})


_ENCODED = "row long, doc_id long, held_out boolean, round int, n_tokens long, n_known long, counted double, spread double, outputs array<int>, rare array<struct<word:string,n:long>>"


def encode(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: its outputs, the end last, and its words that are not common with how often each occurs.

    ``counted``: log10 (c + 1) of its common tokens; ``spread``: log10 of what the
    kinds of its words give (common words: their share, others: one over all).
    """
    kind_cost = np.log10(np.maximum(voc.kind_tokens + voc.kind_words + 1.0, 1.0))
    log_count = np.log10(voc.count + 1.0)
    shared = np.where(voc.output > voc.end, log_count, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in texts_of(batches):
            outputs, known, counted, spread, rare = [], [], [], [], []
            for raw in texts:
                own, k, lc, sp, gone = [], int(voc.ends > 0), math.log10(voc.ends + 1), 0.0, Counter()
                for words in words_of(raw):
                    place, out, lost = voc.encode(words)
                    gone.update(lost)
                    there = place[place >= 0]
                    kinds = out[out > voc.end] - voc.end - 1
                    k, lc = k + len(there), lc + float(log_count[there].sum())
                    sp += float(shared[there].sum() - kind_cost[kinds].sum())
                    own.append(out)
                outputs.append(np.concatenate([*own, [voc.end]]))
                known, counted, spread, rare = [*known, k], [*counted, lc], [*spread, sp], [*rare, gone]
            offsets = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            words = pa.StructArray.from_arrays([pa.array([w for g in rare for w in g], pa.binary()).cast(pa.string()), pa.array([n for g in rare for n in g.values()], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "doc_id", "held_out", "round")), pa.array(list(map(len, outputs)), pa.int64()), pa.array(known, pa.int64()), pa.array(counted, pa.float64()), pa.array(spread, pa.float64()),
                 pa.ListArray.from_arrays(offsets(outputs), pa.array(np.concatenate(outputs), pa.int32())), pa.ListArray.from_arrays(offsets(rare), words)],
                ["row", "doc_id", "held_out", "round", "n_tokens", "n_known", "counted", "spread", "outputs", "rare"],
            )

    turn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)).cast("int")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), turn.alias("round"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(trimmed(run), _ENCODED)


def _documents(batches: Iterable[pa.RecordBatch], tokens: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of encoded rows with about ``tokens`` outputs (one row at least), and each row's outputs."""
    for b in batches:
        column = b.column("outputs")
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + tokens, side="right")))
            yield b.slice(at, to - at), np.split(flat[before : ends[to - 1]].astype(np.int64), ends[at : to - 1] - before)
            at = to


def train(encoded: DataFrame, voc: Vocabulary, rounds: int = ROUNDS, width: int = WIDTH) -> LogBilinear:
    """Fit on all encoded rows.

    A rerun over the same split of the table gives the same model; another split
    trains other parts alone and so gives slightly other parameters.
    """
    network = LogBilinear.fresh(voc.unigram(), width)

    def run_from(start: LogBilinear):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            net = LogBilinear({k: v.copy() for k, v in start.p.items()}, start.noise, {k: v.copy() for k, v in start.seen.items()})
            rng, tokens = np.random.default_rng(part), 0
            for _, outputs in _documents(batches):
                one, two, w = contexts(outputs, voc.outputs)
                net.fit(one, two, w, rng)
                tokens += len(w)
            if tokens:
                flat = np.concatenate([*(net.p[k].ravel() for k in net.p), *(net.seen[k].ravel() for k in net.p)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part % PARTS], pa.int32()), pa.array([float(tokens)]), pa.array([flat.tobytes()], pa.binary())], ["part", "weight", "p"])

        return trimmed(run)

    for turn in range(rounds if voc.tokens else 0):
        network = _mean(encoded.where(F.col("round") == turn).select("outputs").mapInArrow(run_from(network), "part int, weight double, p binary"), network)
    return network


def score(encoded: DataFrame, counts: DataFrame, voc: Vocabulary, network: LogBilinear) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each encoded row; logarithms are to base 10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normaliser(network)
        for b, outputs in _documents(batches):
            first = np.cumsum([0, *map(len, outputs[:-1])])
            neural = np.add.reduceat(normal.log_probabilities(*contexts(outputs, voc.outputs)), first) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(neural)], [*kept, "neural"])

    rare = encoded.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    j = rare.join(counts.where("word is not null").select("word", "n"), "word", "left")
    more = j.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("l"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("k"))
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "spread"]
    neural = encoded.select(*kept, "outputs").mapInArrow(trimmed(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, spread double, neural double")
    l, k = F.coalesce("l", F.lit(0.0)), F.coalesce("k", F.lit(0).cast("long"))
    denominator = math.log10(voc.tokens + voc.different + 1)
    return neural.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + k).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + l - F.col("n_tokens") * denominator).alias("base_score"), (F.col("neural") + F.col("spread") + l).alias("score"),
    )


def language_model(docs: DataFrame, rounds: int = ROUNDS, shortlist: int = SHORTLIST, common: int = COMMON, width: int = WIDTH) -> DataFrame:
    """Counts and network from the documents that are not held out, and the scores of all (see :func:`score`).

    Null texts are empty: the end alone is scored.  Rows that repeat are counted
    and scored each, null ids too; other columns are not read; an empty table
    gives no rows.  Without training tokens every count is 0 and the outputs are
    the end and the kinds, equally likely.
    """
    counts = save(count_words(docs.where(~is_held_out())), "lm-counts")
    voc = Vocabulary.of(counts, shortlist, common)
    encoded = save(encode(docs, voc, rounds), "lm-encoded")
    return score(encoded, counts, voc, train(encoded.where("not held_out"), voc, rounds, width))
