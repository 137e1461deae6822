"""Gradient descent on sample factors that stay in a table.

A row of the state holds a sample's values (see ``factor.packed_rows``), its
factor ``x`` and what an optimiser remembers of it: AdaGrad's sums of squares, or
the gradient and the last steps and changes of gradient of L-BFGS.  A step maps
over the rows and writes them; Y, the size of the features, stays on the driver.
What a step needs of all rows is a sum: the loss, the gradient of Y and, for
L-BFGS, the inner products of steps, changes and gradient, since the two-loop
recursion can be run on coefficients of these vectors.  So the driver's memory
does not hang on the number of samples, and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import sums as U
from strandloom.operators.factor import Columns, _placing
from strandloom.operators.optimise import AdaGrad
from strandloom.operators.regularise import Prior, SamplePrior
from strandloom.sources.scratch import discard, save

#: Step sizes that one pass of a line search tries, each ``SHRINK`` times the last.
TRIES, SHRINK = 8, 0.8


def _lists(a: np.ndarray) -> pa.ListArray:
    width = a.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(a, np.float64).ravel()))


def _rows(b: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, *shape)


def with_state(rows: DataFrame, factors: DataFrame, **columns: int) -> DataFrame:
    """Rows with their factor ``x`` (zeros where ``factors``: sample_id, x has none), and arrays of so many zeros."""
    k = factors.agg(F.max(F.size("x"))).first()[0] or 0
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    own = rows.join(factors.select(F.col("sample_id").cast("string").alias("sample_id"), "x"), "sample_id", "left")
    return own.withColumn("x", F.coalesce("x", zeros(k))).withColumns({c: zeros(n) for c, n in columns.items()})


class Gradient:
    """Loss and gradients of rows at given factors."""

    def __init__(self, columns: Columns, prior: SamplePrior) -> None:
        self.columns, self.prior, self.places = columns, prior, _placing(columns.batches)
        self.k, self.n = columns.y.shape

    def at(self, b: pa.RecordBatch) -> tuple[Columns, np.ndarray, np.ndarray]:
        """The columns as these rows see them, their values, their ridges."""
        return self.columns.at(self.places(b)), U.dense(b, self.n), self.prior.weights(b.column("condition").to_pylist(), self.k)

    @staticmethod
    def loss(c: Columns, d: np.ndarray, ridge: np.ndarray, x: np.ndarray) -> float:
        return float((c.terms(x, d)[0] * c.weight).sum() + 0.5 * (ridge * x * x).sum())

    @staticmethod
    def slopes(c: Columns, d: np.ndarray, ridge: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's x, and of Y over these rows (K x N)."""
        g = c.terms(x, d)[1] * c.weight * c.scale
        return g @ c.y.T + ridge * x, x.T @ g


def _pieces(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    return (piece for whole in batches for piece in U.slices(whole, n))


def _replaced(b: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, b.column(c)) for c in b.schema.names], b.schema.names)


def _mapped(state: DataFrame, n: int, change: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """The state with some columns changed, written; the old one is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, n):
            yield _replaced(b, **change(b))

    out = save(state.mapInArrow(run, state.schema), "descent-state")
    discard(state)
    return out


def _summed(state: DataFrame, n: int, add: Callable[[pa.RecordBatch, dict], None]) -> dict[str, np.ndarray]:
    """Arrays that ``add`` adds up over the pieces of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in _pieces(batches, n):
            add(b, total)
        yield U.partial({key: v for name, a in total.items() for key, v in U.split_rows(name, a).items()})

    return U.add_up(state.mapInArrow(run, U.SCHEMA))


def _plus(total: dict[str, np.ndarray], name: str, value: np.ndarray) -> None:
    total[name] = total.get(name, 0) + value


def fit_adagrad(state: DataFrame, columns: Columns, x_prior: SamplePrior, y_prior: Prior | None = None, epochs: int = 100, rate: float = 1.0, tolerance: float = 1e-5, eps: float = 1e-8) -> tuple[DataFrame, np.ndarray, list[float]]:
    """AdaGrad steps on all x, and on Y unless ``y_prior`` is None: the state, Y and the losses before each step.

    ``state``: :func:`with_state` with ``acc`` of K zeros.  Stops when the loss
    changes by at most ``tolerance`` of itself.
    """
    n, k, y, losses = columns.y.shape[1], len(columns.y), {"y": columns.y.copy()}, []
    optimiser = AdaGrad(rate, eps)

    def moved(grad: Gradient):
        def change(b: pa.RecordBatch) -> dict[str, pa.Array]:
            c, d, ridge = grad.at(b)
            x, acc = _rows(b, "x", k), _rows(b, "acc", k)
            g, _ = grad.slopes(c, d, ridge, x)
            acc = acc + g * g
            return {"x": _lists(x - rate * g / (np.sqrt(acc) + eps)), "acc": _lists(acc)}

        return change

    def adding(grad: Gradient):
        def add(b: pa.RecordBatch, total: dict) -> None:
            c, d, ridge = grad.at(b)
            x = _rows(b, "x", k)
            _plus(total, "loss", np.array([[grad.loss(c, d, ridge, x)]]))
            if y_prior is not None:
                _plus(total, "gy", grad.slopes(c, d, ridge, x)[1].T)

        return add

    for _ in range(epochs):
        grad = Gradient(replace(columns, y=y["y"]), x_prior)
        got = _summed(state, n, adding(grad))
        losses.append(float(U.join_rows("loss", got, (1, 1))[0, 0]) + (y_prior.value(y["y"]) if y_prior else 0.0))
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) <= tolerance * abs(losses[-1]):
            break
        state = _mapped(state, n, moved(grad))
        if y_prior is not None:
            old = y["y"].copy()
            optimiser.step(y, {"y": U.join_rows("gy", got, (n, k)).T + y_prior.gradient(old)})
            y["y"] = y["y"].copy()
    return state, y["y"], losses


def direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the L-BFGS direction over (steps, changes of gradient, gradient), from their inner products."""
    q, kept = np.zeros(2 * pairs + 1), []
    q[-1] = 1.0
    for i in reversed(range(pairs)):
        a = gram[i] @ q / gram[i, pairs + i]
        q[pairs + i] -= a
        kept.append(a)
    if pairs:
        q *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for i, a in zip(range(pairs), reversed(kept), strict=True):
        q[i] += a - gram[pairs + i] @ q / gram[i, pairs + i]
    return -q


def fit_lbfgs(
    state: DataFrame, columns: Columns, x_prior: SamplePrior, y_prior: Prior | None = None, memory: int = 10, rounds: int = 200, rel_tol: float = 1e-9, abs_tol: float = 1e-12
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Limited-memory BFGS over all x, and Y unless ``y_prior`` is None: the state, Y and the loss of each round.

    ``state``: :func:`with_state` with ``g`` of K zeros and ``past`` of none.  A
    round takes three passes: sums at the present point, losses of several step
    sizes, the step.  The line search and the choice of pairs are those of
    :func:`strandloom.operators.optimise.lbfgs`.
    """
    n, k, free = columns.y.shape[1], len(columns.y), y_prior is not None
    y, past_y, pairs = columns.y.copy(), np.zeros((0, k * n)), 0

    def at(y: np.ndarray) -> Gradient:
        return Gradient(replace(columns, y=y), x_prior)

    def basis(b: pa.RecordBatch, pairs: int) -> np.ndarray:
        """Rows x (2 pairs + 1) x K."""
        return np.concatenate([_rows(b, "past", 2 * pairs, k), _rows(b, "g", 1, k)], axis=1)

    def measured(state: DataFrame, y: np.ndarray, pairs: int) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Loss, gradient of Y, inner products over the rows, sum of |g| over the rows."""
        grad = at(y)

        def add(b: pa.RecordBatch, total: dict) -> None:
            c, d, ridge = grad.at(b)
            x, own = _rows(b, "x", k), basis(b, pairs)
            _plus(total, "loss", np.array([[grad.loss(c, d, ridge, x), np.abs(own[:, -1]).sum()]]))
            _plus(total, "gram", np.einsum("rik,rjk->ij", own, own))
            if free:
                _plus(total, "gy", grad.slopes(c, d, ridge, x)[1].T)

        got = _summed(state, n, add)
        loss, size = U.join_rows("loss", got, (1, 2))[0]
        gy = U.join_rows("gy", got, (n, k)).T + y_prior.gradient(y) if free else np.zeros_like(y)
        return float(loss) + (y_prior.value(y) if free else 0.0), gy, U.join_rows("gram", got, (2 * pairs + 1,) * 2), float(size)

    def gradients(y: np.ndarray):
        grad = at(y)

        def change(b: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"g": _lists(grad.slopes(*grad.at(b), _rows(b, "x", k))[0])}

        return change

    state = _mapped(state, n, gradients(y))
    loss, gy, gram, size = measured(state, y, 0)
    losses = [loss]
    for _ in range(rounds):
        own = np.concatenate([past_y, gy.reshape(1, -1)])
        full = gram + own @ own.T
        coefficients = direction(full, pairs)
        slope = float(coefficients @ full[-1])
        if slope >= 0:  # no descent: forget the past
            coefficients = np.zeros(2 * pairs + 1)
            coefficients[-1], slope = -1.0, -float(full[-1, -1])
        if slope == 0:
            break
        step = 1.0 if coefficients[:-1].any() else min(1.0, 1.0 / max(size + float(np.abs(gy).sum()), 1e-12))
        dy = (coefficients @ own).reshape(k, n)
        while True:  # TRIES step sizes in one pass
            sizes = step * SHRINK ** np.arange(TRIES)
            grads = [Gradient(replace(columns, y=y + t * dy), x_prior) for t in sizes]

            def add(b: pa.RecordBatch, total: dict, grads=grads, sizes=sizes, coefficients=coefficients, pairs=pairs) -> None:
                x, d = _rows(b, "x", k), np.einsum("i,rik->rk", coefficients, basis(b, pairs))
                _plus(total, "loss", np.array([[g.loss(*g.at(b), x + t * d) for g, t in zip(grads, sizes, strict=True)]]))

            found = U.join_rows("loss", _summed(state, n, add), (1, TRIES))[0] + np.array([y_prior.value(y + t * dy) if free else 0.0 for t in sizes])
            good = np.flatnonzero((found <= loss + 1e-4 * sizes * slope) | (sizes < 1e-20))
            if len(good):
                step = float(sizes[good[0]])
                break
            step = float(sizes[-1] * SHRINK)
        new_y = y + step * dy
        keep = min(pairs, memory - 1)
        grad = at(new_y)

        def change(b: pa.RecordBatch, grad=grad, step=step, coefficients=coefficients, pairs=pairs, keep=keep) -> dict[str, pa.Array]:
            x, all_ = _rows(b, "x", k), basis(b, pairs)
            move = step * np.einsum("i,rik->rk", coefficients, all_)
            g = grad.slopes(*grad.at(b), x + move)[0]
            past = all_[:, :-1]
            past = np.concatenate([past[:, pairs - keep : pairs], move[:, None], past[:, 2 * pairs - keep :], (g - all_[:, -1])[:, None]], axis=1)
            return {"x": _lists(x + move), "g": _lists(g), "past": _lists(past.reshape(len(x), -1))}

        state = _mapped(state, n, change)
        old_gy, before = gy, loss
        loss, gy, gram, size = measured(state, new_y, keep + 1)
        change_y = (gy - old_gy).reshape(1, -1)
        past_y = np.concatenate([past_y[pairs - keep : pairs], step * dy.reshape(1, -1), past_y[2 * pairs - keep :], change_y])
        y, pairs = new_y, keep + 1
        together = gram[:-1, :-1] + past_y @ past_y.T
        if together[pairs - 1, -1] <= 1e-12 * together[-1, -1]:  # no curvature: start anew
            state, pairs, past_y, gram = _mapped(state, n, lambda b: {"past": _lists(np.zeros((b.num_rows, 0)))}), 0, past_y[:0], gram[-1:, -1:]
        losses.append(loss)
        if abs(before - loss) < abs_tol or abs(before - loss) < rel_tol * abs(before):
            break
    return state, y, losses

