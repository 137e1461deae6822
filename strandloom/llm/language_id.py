"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions and gives every
position a distribution over the learned languages; a document's distribution
is the mean over all of its positions.  It is trained in numpy with
backpropagation through time.  Gates are piecewise linear (clip(x/4 + 1/2, 0, 1)
for sigmoids, clip(x, -1, 1) for the tangent), which costs a fraction of the
exponentials and trains as well here.

Arrays are laid out feature first: (features, sequences).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN_ROWS = 4000
LANGUAGES = 256
_SPACE = 1 << 40
WINDOWS = 4
WINDOW = 64
CHUNK = 128
BATCH = 2048
PART = 512
HIDDEN = 8
UNKNOWN = "und"
_F = np.float32


def _gates(table: np.ndarray, u: np.ndarray, x: np.ndarray, reverse: bool, keep: bool):
    """Run a gated recurrent layer over x (time, sequences) of byte values; states (time, hidden, sequences)."""
    steps, n = x.shape
    hid = u.shape[1]
    states, trace = np.empty((steps, hid, n), _F), []
    h, a, g = np.zeros((hid, n), _F), np.empty((3 * hid, n), _F), np.empty((3 * hid, n), _F)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        if keep:
            a, g = np.empty_like(a), np.empty_like(g)
        np.take(table, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        gate, q = a[: 2 * hid], g[2 * hid :]
        gate += g[: 2 * hid]
        gate *= _F(0.25)
        gate += _F(0.5)
        np.maximum(gate, 0, out=gate)
        np.minimum(gate, 1, out=gate)
        z, r, m = gate[:hid], gate[hid:], a[2 * hid :]
        m += r * q
        np.maximum(m, -1, out=m)
        np.minimum(m, 1, out=m)
        old, h = h, states[t]
        np.subtract(old, m, out=h)
        h *= z
        h += m
        if keep:
            trace.append((t, old, z, r, m, q))
    return states, trace


def _gates_back(u: np.ndarray, x: np.ndarray, trace: list, d_states: np.ndarray):
    """Gradients of the byte table and of u from the gradients of all states."""
    hid = u.shape[1]
    du, dh, d_in = np.zeros_like(u), np.zeros_like(d_states[0]), np.empty((len(x), 3 * hid, x.shape[1]), _F)
    for t, old, z, r, m, q in reversed(trace):
        dh += d_states[t]
        dm = dh * (1 - z) * (np.abs(m) < 1)
        dz = dh * (old - m) * ((z > 0) & (z < 1)) * _F(0.25)
        dr = dm * q * ((r > 0) & (r < 1)) * _F(0.25)
        dg = np.concatenate((dz, dr, dm * r))
        d_in[t, : 2 * hid], d_in[t, 2 * hid :] = dg[: 2 * hid], dm
        du += dg @ old.T
        dh = dh * z + u.T @ dg
    flat = x.ravel()
    table = np.stack([np.bincount(flat, d_in[:, i].ravel(), 256) for i in range(3 * hid)]).astype(_F)
    return table, du


@dataclass
class ByteGRU:
    langs: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> ByteGRU:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(_F)
        p = {k + d: v for d in "fb" for k, v in (("table", draw(3 * hidden, 256, scale=0.5)), ("u", draw(3 * hidden, hidden, scale=0.5 / hidden**0.5)))}
        return cls(langs, p | {"wf": draw(len(langs), hidden, scale=0.3), "wb": draw(len(langs), hidden, scale=0.3), "c": np.zeros((len(langs), 1), _F)})

    def positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities (time, languages, sequences) of every position of x (time, sequences)."""
        p = self.p
        (hf, tf), (hb, tb) = (_gates(p["table" + d], p["u" + d], x, d == "b", keep) for d in "fb")
        y = np.matmul(p["wf"], hf)
        y += np.matmul(p["wb"], hb)
        y += p["c"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return (y, hf, hb, tf, tb) if keep else y

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions (label per sequence) and its gradients."""
        y, hf, hb, tf, tb = self.positions(x, keep=True)
        cols = np.arange(x.shape[1])
        loss = float(-np.log(y[:, label, cols] + 1e-12).mean())
        dy = y.copy()
        dy[:, label, cols] -= 1
        dy /= _F(x.size)
        g = {"wf": np.einsum("tln,thn->lh", dy, hf), "wb": np.einsum("tln,thn->lh", dy, hb), "c": dy.sum(axis=(0, 2))[:, None]}
        for d, trace in (("f", tf), ("b", tb)):
            g["table" + d], g["u" + d] = _gates_back(self.p["u" + d], x, trace, np.matmul(self.p["w" + d].T, dy))
        return loss, g

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over random batches of the windows x (time, sequences)."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
            loss, g = self.gradients(x[:, pick], label[pick])
            losses.append(loss)
            eta = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, a in self.p.items():
                d = np.clip(g[k], -0.1, 0.1)
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                a -= (eta * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(_F)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text, over all of its bytes (empty texts: zeros).

        Texts are cut into chunks.  The last one is the text's last CHUNK bytes,
        of which only those not seen before count; a shorter text is repeated
        up to a chunk and counted once.
        """
        parts, owner, low, high = [], [], [], []
        for k, t in enumerate(texts):
            full, rest = divmod(len(t), CHUNK)
            parts.append(t[: full * CHUNK])
            if rest:
                parts.append(t[-CHUNK:] if full else (t * -(-CHUNK // rest))[:CHUNK])
            owner += [k] * (full + (rest > 0))
            low += [0] * full + [CHUNK - rest if full else 0] * (rest > 0)
            high += [CHUNK] * full + [CHUNK if full else rest] * (rest > 0)
        flat = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, CHUNK)
        own, low, high = np.array(owner, np.int64), np.array(low), np.array(high)
        out, step = np.zeros((len(texts), len(self.langs))), np.arange(CHUNK)[:, None]
        for at in range(0, len(own), BATCH):
            to = at + BATCH
            y = self.positions(np.ascontiguousarray(flat[at:to].T).astype(np.intp))
            counted = (step >= low[at:to]) & (step < high[at:to])
            sums = np.einsum("tln,tn->ln", y, counted.astype(_F))
            for lang, row in enumerate(sums):
                out[:, lang] += np.bincount(own[at:to], row, len(texts))
        return out / np.array([max(1, len(t)) for t in texts])[:, None]


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def training_windows(docs: DataFrame, rows: int = TRAIN_ROWS, windows: int = WINDOWS, window: int = WINDOW, languages: int = LANGUAGES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Byte windows (time, n), labels and languages of a bounded sample.

    The ``languages`` languages of the most rows (ties: first by name) are
    learned.  Of each up to rows / languages rows, those with the smallest
    hashes of id and text, give ``windows`` windows of ``window`` characters from
    hashed places of the whole text.  Rows that repeat id and text count once.
    The driver holds rows * windows short strings, whatever ids repeat.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    rank = F.xxhash64("doc_id", "text", F.lit(11))
    common = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(rank).alias("n")).orderBy(F.col("rows").desc(), "lang").limit(languages).collect()
    if not common:
        return np.zeros((window, 0), np.intp), np.zeros(0, np.int64), []
    langs, most = sorted(r["lang"] for r in common), max(1, rows // len(common))
    # about twice the rows needed pass the hash threshold of their language, then the smallest are taken
    share = {r["lang"]: min(1.0, (2 * most + 100) / max(1, r["n"])) for r in common}
    pass_ = F.create_map(*(F.lit(x) for r in common for x in (r["lang"], int(share[r["lang"]] * _SPACE))))
    n = F.length("text")
    at = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(100 + i)), F.greatest(n - window + 1, F.lit(1))).cast("int") + 1
    cut = F.array(*(F.substring(F.col("text"), at(i), F.lit(window)) for i in range(windows)))
    hashed = usable.select("lang", rank.alias("rank"), cut.alias("cut")).where(F.pmod("rank", F.lit(_SPACE)) < pass_[F.col("lang")])
    distinct = hashed.groupBy("lang", "rank").agg(F.min("cut").alias("cut"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    sample = distinct.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("lang", "nth").select("lang", "cut").collect()
    x, label = [], []
    for r in sample:
        for piece in r["cut"]:
            raw = piece.encode()
            raw = (raw * -(-window // len(raw)))[:window]
            x.append(np.frombuffer(raw, np.uint8))
            label.append(langs.index(r["lang"]))
    return np.ascontiguousarray(np.array(x).T).astype(np.intp), np.array(label), langs


def train(docs: DataFrame, rows: int = TRAIN_ROWS, steps: int = 300) -> ByteGRU:
    """Fit on rows that are not held out; lang is the label, text the only input."""
    x, label, langs = training_windows(docs.where(~is_held_out()), rows)
    model = ByteGRU.fresh(langs)
    if langs:
        model.fit(x, label, steps)
    return model


def identify(docs: DataFrame, model: ByteGRU) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is the language of the largest pooled probability (ties: first
    by name) and ``score`` that probability.  Null texts, texts without a letter
    and any text if no language was learned give ``und`` with score 0.  All bytes
    of a text of any length count, in chunks that each start from a fresh state.
    Rows that repeat a doc_id are predicted each; other columns are not read; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            for at in range(0, b.num_rows, PART):  # bounds the arrays
                part = [t or "" for t in texts.slice(at, PART).to_pylist()]
                letters = [any(map(str.isalpha, t)) and bool(model.langs) for t in part]
                raw = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(part, letters, strict=True)]
                pooled = model.documents(raw) if any(letters) else np.zeros((len(part), max(1, len(model.langs))))
                best = pooled.argmax(axis=1)
                pred = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                score = np.clip(pooled[np.arange(len(part)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, PART), b.column("held_out").slice(at, PART), pa.array(pred, pa.string()), pa.array(score.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
