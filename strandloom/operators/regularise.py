"""Priors on arrays of feature size (K x N), held by the driver during a fit.

Each has a value, a gradient and a diagonal curvature that majorises it: the
value never exceeds  value(y) + <gradient(y), d> + 1/2 <d, curvature(y) d>  at
y + d, so a step that uses the curvature never raises the prior.  ``reweight``
sets its weights by empirical Bayes from a fitted array.  Sums over long tables
of the same priors are in :mod:`strandloom.operators.priors`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from strandloom.operators.optimise import ista_nonnegative

_TINY = 1e-8


def _top_value(y: np.ndarray) -> float:
    """Largest squared singular value, from the K x K inner products."""
    return float(np.linalg.eigvalsh(y @ y.T)[-1]) if y.size else 0.0


class Prior:
    """No prior; also the base of the others."""

    def value(self, y: np.ndarray) -> float:
        return 0.0

    def gradient(self, y: np.ndarray) -> np.ndarray:
        return np.zeros_like(y)

    def curvature(self, y: np.ndarray) -> np.ndarray:
        return np.zeros_like(y)

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        return None

    def reorder(self, order: np.ndarray) -> None:
        return None


@dataclass
class Ridge(Prior):
    """1/2 sum_k w_k sum y^2."""

    weight: np.ndarray

    def value(self, y: np.ndarray) -> float:
        return 0.5 * float((self.weight[:, None] * y * y).sum())

    def gradient(self, y: np.ndarray) -> np.ndarray:
        return self.weight[:, None] * y

    def curvature(self, y: np.ndarray) -> np.ndarray:
        return np.repeat(self.weight[:, None], y.shape[1], axis=1)

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        top = _top_value(y)
        if top > 0:
            self.weight = np.full(len(y), share / top)

    def reorder(self, order: np.ndarray) -> None:
        self.weight = self.weight[order]


@dataclass
class GroupRidge(Prior):
    """1/2 sum over groups of columns and factors of w_{g,k} sum y^2."""

    labels: np.ndarray
    weight: dict[str, np.ndarray]

    @classmethod
    def of(cls, labels: np.ndarray, k: int, weight: float = 1.0) -> GroupRidge:
        return cls(np.asarray(labels), {g: np.full(k, float(weight)) for g in dict.fromkeys(labels)})

    def curvature(self, y: np.ndarray) -> np.ndarray:
        return np.stack([self.weight[g] for g in self.labels], axis=1) if len(self.labels) else np.zeros_like(y)

    def value(self, y: np.ndarray) -> float:
        return 0.5 * float((self.curvature(y) * y * y).sum())

    def gradient(self, y: np.ndarray) -> np.ndarray:
        return self.curvature(y) * y

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        for g in self.weight:
            top = _top_value(y[:, self.labels == g])
            if top > 0:
                self.weight[g] = np.full(len(y), share / top)

    def reorder(self, order: np.ndarray) -> None:
        self.weight = {g: w[order] for g, w in self.weight.items()}


@dataclass
class SelectiveL1(Prior):
    """sum_k w_k sum |y| over the columns outside the factor's graph (``outside``: K x N)."""

    outside: np.ndarray
    weight: np.ndarray

    def value(self, y: np.ndarray) -> float:
        return float((self.weight[:, None] * np.abs(y) * self.outside).sum())

    def gradient(self, y: np.ndarray) -> np.ndarray:
        return self.weight[:, None] * np.sign(y) * self.outside

    def curvature(self, y: np.ndarray) -> np.ndarray:
        # |y + d| <= |y| + sign(y) d + d^2 / (2 |y|)
        return self.weight[:, None] / np.maximum(np.abs(y), _TINY) * self.outside

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        """share sqrt(2 / variance) over the masked array, zeros inside the graph included."""
        var = np.var(y * self.outside, axis=1, ddof=1) if y.shape[1] > 1 else np.zeros(len(y))
        w = share * np.sqrt(np.divide(2.0, var, out=np.full(len(y), np.inf), where=var > 0))
        self.weight = np.where(np.isfinite(w), w, 1.0)

    def reorder(self, order: np.ndarray) -> None:
        self.outside, self.weight = self.outside[order], self.weight[order]


@dataclass
class Graph:
    """Signed Laplacian of one graph by edges: eps + sum |w| on the diagonal, -w beside it.

    The first ``observed`` nodes are columns of y (``column``), the others are virtual.
    """

    column: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    nodes: int
    epsilon: float
    u: np.ndarray | None = None

    @classmethod
    def of(cls, edges: list[tuple[str, str, float]], place: dict[str, int], epsilon: float = 0.1) -> Graph:
        """``place``: column of each observed node; the latest weight of an edge counts."""
        latest = {tuple(sorted((a, b))): w for a, b, w in edges}
        names = sorted({v for e in latest for v in e}, key=lambda v: (v not in place, v))
        at = {v: i for i, v in enumerate(names)}
        ends = np.array([(at[a], at[b]) for a, b in latest], int).reshape(-1, 2)
        return cls(np.array([place[v] for v in names if v in place], int), ends[:, 0], ends[:, 1], np.array(list(latest.values()), float), len(names), epsilon)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """L x."""
        n, (a, b, w) = self.nodes, (self.a, self.b, self.w)
        size = np.abs(w)
        return self.epsilon * x + np.bincount(a, size * x[a] - w * x[b], n) + np.bincount(b, size * x[b] - w * x[a], n)

    def diagonal(self) -> np.ndarray:
        loops = np.bincount(self.a, np.where(self.a == self.b, -2 * self.w, 0.0), self.nodes)
        return self.epsilon + np.bincount(self.a, np.abs(self.w), self.nodes) + np.bincount(self.b, np.abs(self.w), self.nodes) + loops

    def solve(self, values: np.ndarray, rounds: int = 1000, tolerance: float = 1e-20) -> tuple[float, np.ndarray]:
        """1/2 x'Lx with the virtual nodes at their best, and its gradient in the observed ones.

        The virtual values come from conjugate gradients that start where the
        last call ended.
        """
        m = len(values)
        x = np.concatenate((values, self.u if self.u is not None else np.zeros(self.nodes - m)))
        if self.nodes > m:
            r = -self.apply(x)[m:]
            p, rr = r.copy(), float(r @ r)
            for _ in range(rounds):
                if rr <= tolerance:
                    break
                q = self.apply(np.concatenate((np.zeros(m), p)))[m:]
                step = rr / float(p @ q)
                x[m:] += step * p
                r -= step * q
                rr, old = float(r @ r), rr
                p = r + rr / old * p
            self.u = x[m:].copy()
        lx = self.apply(x)
        return 0.5 * float(x @ lx), lx[:m]


@dataclass
class Network(Prior):
    """sum_k w_k times the quadratic form of the k-th graph (None: none)."""

    graphs: list[Graph | None]
    weight: np.ndarray

    def _each(self, y: np.ndarray):
        for k, g in enumerate(self.graphs):
            if g is not None and len(g.column):
                yield k, g

    def value(self, y: np.ndarray) -> float:
        return sum(float(self.weight[k]) * g.solve(y[k, g.column])[0] for k, g in self._each(y))

    def gradient(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros_like(y)
        for k, g in self._each(y):
            out[k, g.column] = self.weight[k] * g.solve(y[k, g.column])[1]
        return out

    def curvature(self, y: np.ndarray) -> np.ndarray:
        # a Laplacian is at most twice its diagonal, and less with virtual nodes at their best
        out = np.zeros_like(y)
        for k, g in self._each(y):
            out[k, g.column] = 2 * self.weight[k] * g.diagonal()[: len(g.column)]
        return out

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        var = np.var(y, axis=1, ddof=1) if y.shape[1] > 1 else np.zeros(len(y))
        w = np.divide(share, var, out=np.full(len(y), np.inf), where=var > 0)
        self.weight = np.where(np.isfinite(w), w, self.weight)

    def reorder(self, order: np.ndarray) -> None:
        self.graphs, self.weight = [self.graphs[i] for i in order], self.weight[order]


@dataclass
class Relevance(Prior):
    """Automatic relevance: sum (1/2 + alpha) ln(1 + y^2 / (2 beta)); beta a number or K x N."""

    alpha: float = 1.001
    beta: float | np.ndarray = 0.001

    def value(self, y: np.ndarray) -> float:
        return float((0.5 + self.alpha) * np.log1p(y * y / (2 * self.beta)).sum())

    def curvature(self, y: np.ndarray) -> np.ndarray:
        return (1 + 2 * self.alpha) / (2 * self.beta + y * y)

    def gradient(self, y: np.ndarray) -> np.ndarray:
        return self.curvature(y) * y

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        self.alpha = self.beta = 0.001


def gamma_normal(a: np.ndarray, s: np.ndarray, y: np.ndarray, alpha: float, alpha0: float, v0: float) -> tuple[float, np.ndarray]:
    """-sum alpha ln beta + sum (alpha + 1/2) ln(beta + y^2 / 2) with beta = (alpha0 - 1)(v0 + A'S), and its gradient in A (sets x K)."""
    beta, half = (alpha0 - 1) * (v0 + a.T @ s), 0.5 * y * y
    loss = float((-alpha * np.log(beta) + (alpha + 0.5) * np.log(beta + half)).sum())
    return loss, s @ ((alpha0 - 1) * (-alpha / beta + (alpha + 0.5) / (beta + half))).T


@dataclass
class FeatureSets(Relevance):
    """Relevance prior whose scales are mixes of feature sets: beta = (alpha0 - 1)(v0 + A'S) in each view.

    ``sets``: view -> (columns, S of sets x columns); ``assign``: view -> A (sets x K).
    """

    sets: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    names: dict[str, list[str]] = field(default_factory=dict)
    assign: dict[str, np.ndarray] = field(default_factory=dict)
    lam: dict[str, np.ndarray] = field(default_factory=dict)
    alpha0: float = 1.001
    v0: float = 0.8

    def start(self, k: int, n: int) -> None:
        self.alpha, self.beta = self.alpha0, np.full((k, n), self.alpha0 - 1)
        self.assign = {v: np.zeros((len(s), k)) for v, (_, s) in self.sets.items()}
        self.lam = {v: np.ones(k) for v in self.sets}

    def update(self, y: np.ndarray, rounds: int = 1000, patience: int = 50, least: float = 1e-5, rate: float = 0.05) -> float:
        """New assignments, from zero, by non-negative ISTA on the gamma-normal loss plus lam |A|; the relative change of beta.

        The best assignment is kept; a view ends after ``patience`` rounds that
        gain less than ``least``.
        """
        old = self.beta.copy()
        for view, (cols, s) in self.sets.items():
            a, lam = np.zeros_like(self.assign[view]), self.lam[view]
            total = lambda a, own=y[:, cols], s=s, lam=lam: gamma_normal(a, s, own, self.alpha, self.alpha0, self.v0)[0] + float((lam * np.abs(a)).sum())
            ssq, best, kept, stale = np.full_like(a, 1e-8), total(a), a, 0
            for _ in range(rounds):
                a = ista_nonnegative(a, gamma_normal(a, s, y[:, cols], self.alpha, self.alpha0, self.v0)[1], ssq, lam, rate)
                new = total(a)
                stale = 0 if best - new > least else stale + 1
                if new < best:
                    best, kept = new, a
                if stale >= patience:
                    break
            self.assign[view] = kept
            self.beta[:, cols] = (self.alpha0 - 1) * (self.v0 + kept.T @ s)
        return float(((old - self.beta) ** 2).sum() / (self.beta**2).sum())

    def update_penalties(self, y: np.ndarray) -> None:
        """lam_k = L mean(S) / (ms_k - min(least ms, v0) + 0.001), ms the mean square of a factor in the view."""
        for view, (cols, s) in self.sets.items():
            ms = (y[:, cols] ** 2).mean(axis=1)
            self.lam[view] = len(s) * s.mean() / (ms - min(ms.min(), self.v0) + 1e-3)

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        return None

    def reorder(self, order: np.ndarray) -> None:
        self.beta = self.beta[order]
        self.assign = {v: a[:, order] for v, a in self.assign.items()}
        self.lam = {v: w[order] for v, w in self.lam.items()}


@dataclass
class Mixture(Prior):
    """Weighted mean of priors; the shares are normalised, none gives no prior."""

    priors: list[Prior]
    shares: list[float]

    def __post_init__(self) -> None:
        total = sum(self.shares) or 1.0
        self.shares = [s / total for s in self.shares]

    def value(self, y: np.ndarray) -> float:
        return sum(s * p.value(y) for p, s in zip(self.priors, self.shares, strict=True))

    def gradient(self, y: np.ndarray) -> np.ndarray:
        return sum((s * p.gradient(y) for p, s in zip(self.priors, self.shares, strict=True)), np.zeros_like(y))

    def curvature(self, y: np.ndarray) -> np.ndarray:
        return sum((s * p.curvature(y) for p, s in zip(self.priors, self.shares, strict=True)), np.zeros_like(y))

    def reweight(self, y: np.ndarray, share: float = 1.0) -> None:
        for p, s in zip(self.priors, self.shares, strict=True):
            p.reweight(y, s * share)

    def reorder(self, order: np.ndarray) -> None:
        for p in self.priors:
            p.reorder(order)


@dataclass
class ColumnPrior(Prior):
    """1/2 sum w_g (v - c_g)^2 over a vector of column parameters in groups."""

    labels: np.ndarray
    centre: dict[str, float]
    weight: dict[str, float]

    @classmethod
    def of(cls, labels: np.ndarray, weight: float = 1.0) -> ColumnPrior:
        groups = list(dict.fromkeys(labels))
        return cls(np.asarray(labels), dict.fromkeys(groups, 0.0), dict.fromkeys(groups, float(weight)))

    def _spread(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.weight[g] for g in self.labels]), v - np.array([self.centre[g] for g in self.labels])

    def value(self, v: np.ndarray) -> float:
        w, d = self._spread(v)
        return 0.5 * float((w * d * d).sum())

    def gradient(self, v: np.ndarray) -> np.ndarray:
        w, d = self._spread(v)
        return w * d

    def curvature(self, v: np.ndarray) -> np.ndarray:
        return self._spread(v)[0]

    def _groups(self, v: np.ndarray):
        for g in self.weight:
            own = v[self.labels == g]
            yield g, own, float(own.var(ddof=1)) if len(own) > 1 else 0.0

    def reweight(self, v: np.ndarray, share: float = 1.0) -> None:
        """centre = mean, w = share (0.1 + 0.5) / (0.1 + 0.5 variance)."""
        for g, own, var in self._groups(v):
            self.centre[g], self.weight[g] = float(own.mean()), share * 0.6 / (0.1 + 0.5 * var)


class BatchPrior(ColumnPrior):
    """The same over batch values, a group for each (view, batch)."""

    def reweight(self, v: np.ndarray, share: float = 1.0) -> None:
        """centre = mean, w = share / variance, 1 + half the columns where that is not finite."""
        for g, own, var in self._groups(v):
            self.centre[g], self.weight[g] = float(own.mean()), share / var if var > 0 else 1 + 0.5 * len(own)


LAYERS = ("logsigma", "logdelta", "mu", "theta")


@dataclass
class LayerPriors:
    """A prior for each layer of the forward model; frozen ones count nothing and are not reweighted."""

    priors: dict[str, Prior]
    frozen: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, views: np.ndarray | None, batches: np.ndarray | None = None, weight: float = 1.0) -> LayerPriors:
        """Column priors by view and, with ``batches`` (a label for each batch value), batch priors."""
        out: dict[str, Prior] = dict.fromkeys(LAYERS, Prior())
        if views is not None:
            out |= {n: ColumnPrior.of(views, weight) for n in ("logsigma", "mu")}
        if batches is not None:
            out |= {n: BatchPrior.of(batches, weight) for n in ("logdelta", "theta")}
        return cls(out)

    def set(self, layer: str, prior: Prior) -> None:
        self.priors[layer] = prior

    def freeze(self, *layers: str) -> None:
        self.frozen |= set(layers or LAYERS)

    def unfreeze(self, *layers: str) -> None:
        self.frozen -= set(layers or LAYERS)

    def value(self, params: dict[str, np.ndarray]) -> float:
        return sum(self.priors[n].value(v) for n, v in params.items() if n not in self.frozen)

    def gradient(self, params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {n: np.zeros_like(v) if n in self.frozen else self.priors[n].gradient(v) for n, v in params.items()}

    def reweight(self, params: dict[str, np.ndarray], share: float = 1.0) -> None:
        for n, v in params.items():
            if n not in self.frozen:
                self.priors[n].reweight(v, share)


# -- choice of priors -------------------------------------------------------------------


def feature_prior(
    k: int,
    views: np.ndarray,
    ids: list[str],
    relevance: bool = False,
    sets: FeatureSets | None = None,
    l2: float | None = 1.0,
    selective_l1: float | None = None,
    network: float | None = None,
    graphs: list[list[tuple[str, str, float]]] | None = None,
) -> Prior:
    """The prior of Y: feature sets, else relevance, else a mixture of a ridge by view, a selective L1 and networks (whichever are given)."""
    if sets is not None:
        sets.start(k, len(ids))
        return sets
    if relevance:
        return Relevance()
    parts: list[Prior] = []
    if l2 is not None:
        parts.append(GroupRidge.of(views, k, l2))
    if graphs is not None:
        place = {f: i for i, f in enumerate(ids)}
        if selective_l1 is not None:
            outside = np.ones((k, len(ids)), bool)
            for i, g in enumerate(graphs[:k]):
                outside[i, [place[v] for a, b, _ in g for v in (a, b) if v in place]] = False
            parts.append(SelectiveL1(outside, np.full(k, float(selective_l1))))
        if network is not None:
            own = [Graph.of(g, place) for g in graphs[:k]]
            parts.append(Network([*own, *[None] * (k - len(own))], np.full(k, float(network))))
    return Mixture(parts, [1.0] * len(parts))


@dataclass
class SamplePrior:
    """Prior of X: 1/2 sum w_k x^2, and one more for each condition, each with its share of the mixture.

    X is of sample size, so only weights are held; they come from K x K inner products.
    """

    ridge: np.ndarray | None
    by_condition: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, k: int, l2: float | None = None, conditions: list[str] | None = None, condition: float = 1.0, relevance: bool = False) -> SamplePrior:
        """With a relevance prior on Y a ridge by condition, or a plain one where there are none; else a mixture of what is given."""
        groups = {c: np.full(k, float(condition)) for c in conditions or ()}
        if relevance:
            return cls(None if groups else np.ones(k), groups)
        return cls(None if l2 is None else np.full(k, float(l2)), groups)

    def weights(self, conditions: list[str | None], k: int) -> np.ndarray:
        """The ridge of each row."""
        parts = (self.ridge is not None) + bool(self.by_condition)
        out = np.zeros((len(conditions), k))
        if self.ridge is not None:
            out += self.ridge / parts
        if self.by_condition:
            none = np.zeros(k)
            out += np.array([self.by_condition.get(c, none) for c in conditions]).reshape(-1, k) / parts
        return out

    def reweight(self, grams: dict[str, np.ndarray]) -> None:
        """1 / largest squared singular value, of all rows and of each condition's (``grams``: inner products by condition)."""
        top = lambda g: float(np.linalg.eigvalsh(g)[-1])
        parts = (self.ridge is not None) + bool(self.by_condition)
        if self.ridge is not None and grams and (t := top(sum(grams.values()))) > 0:
            self.ridge = np.full(len(self.ridge), 1 / parts / t)
        for c in self.by_condition:
            if c in grams and (t := top(grams[c])) > 0:
                self.by_condition[c] = np.full(len(self.by_condition[c]), 1 / parts / t)

    def reorder(self, order: np.ndarray) -> None:
        self.ridge = None if self.ridge is None else self.ridge[order]
        self.by_condition = {c: w[order] for c, w in self.by_condition.items()}


def minimal_prior(kinds: np.ndarray, k: int, logsigma: np.ndarray, variance: np.ndarray, count: np.ndarray, samples: int) -> GroupRidge:
    """Ridge by noise model for a first fit: K mean(sigma^2) / (sum var_j n_j / M)."""
    out = GroupRidge.of(kinds, k)
    var = np.maximum(np.nan_to_num(variance), 1 / max(1, samples))
    for g in out.weight:
        own = kinds == g
        total = float((var[own] * count[own]).sum()) / max(1, samples)
        out.weight[g] = np.full(k, k * float(np.exp(2 * logsigma[own]).mean()) / total if total > 0 else 1.0)
    return out
