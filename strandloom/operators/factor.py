"""Regularised factor model of an incomplete sample-by-feature matrix.

Forward model:  z = (x_i . y_j) sigma_j delta_bj + mu_j + theta_bj, then the
inverse link of the feature's noise model.  Parameters of feature size (K x N)
live on the driver and are broadcast.  A sample's factor is the minimiser of its
own row given these, so it is never kept during a fit: a pass reads the rows
(written once, as sorted index and value lists), solves each row and returns
sums per feature, from which the driver takes a Newton step on Y that uses the
priors' gradients and curvatures.  With normal noise this is alternating least
squares.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.scalars import DISTRIBUTIONS, finite, impute
from strandloom.operators import sums as U
from strandloom.operators.batch import fit_batch_effects, remove_batch
from strandloom.operators.noise import THRESHOLDS, column_estimates, noise_terms
from strandloom.operators.regularise import LAYERS, FeatureSets, LayerPriors, Prior, Relevance, SamplePrior, feature_prior, minimal_prior
from strandloom.sources.files import load_tables, save_tables
from strandloom.sources.scratch import save

_LEAST_STEP, _MOST_STEP = 0.02, 8.0


@dataclass
class BatchLayers:
    """Batch values of the features of each view that has batches: B x N_view arrays; the last row is of samples without a batch, zeros."""

    views: list[str]
    columns: list[np.ndarray]
    names: list[list[str]]
    theta: list[np.ndarray]
    logdelta: list[np.ndarray]

    @classmethod
    def of(cls, batch: DataFrame, features: pd.DataFrame) -> BatchLayers:
        """From (view, batch, feature_id, theta, logdelta); a value for each batch and feature goes to the driver."""
        place, out = {f: j for j, f in enumerate(features["feature_id"])}, cls([], [], [], [], [])
        got = batch.select("view", F.col("batch").cast("string").alias("batch"), "feature_id", "theta", "logdelta").toPandas()
        for view, own in got.groupby("view"):
            cols = np.flatnonzero(features["view"] == view)
            names = sorted(own["batch"].unique())
            at = np.full(len(place), -1)
            at[cols] = np.arange(len(cols))
            j = own["feature_id"].map(place)
            own, j = own[j.notna()], j.dropna().astype(int).to_numpy()
            b = own["batch"].map({n: i for i, n in enumerate(names)}).to_numpy()
            tables = []
            for layer in ("theta", "logdelta"):
                table = np.zeros((len(names) + 1, len(cols)))
                table[b, at[j]] = own[layer].to_numpy()
                tables.append(table)
            out.views.append(view), out.columns.append(cols), out.names.append(names), out.theta.append(tables[0]), out.logdelta.append(tables[1])
        return out

    def frame(self, features: pd.DataFrame) -> pd.DataFrame:
        """The values as rows: view, batch, feature_id, theta, logdelta."""
        ids, rows = features["feature_id"].to_numpy(), []
        for v, cols, names, theta, logdelta in zip(self.views, self.columns, self.names, self.theta, self.logdelta, strict=True):
            rows += [pd.DataFrame({"view": v, "batch": n, "feature_id": ids[cols], "theta": theta[b], "logdelta": logdelta[b]}) for b, n in enumerate(names)]
        return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame({"view": [], "batch": [], "feature_id": [], "theta": [], "logdelta": []})

    def spread(self, places: list[np.ndarray], n: int, layer: str) -> np.ndarray:
        """Rows x N: the layer's value of each sample's batch."""
        out = np.zeros((len(places[0]) if places else 0, n))
        for cols, table, at in zip(self.columns, getattr(self, layer), places, strict=True):
            out[:, cols] = table[at]
        return out


def _placing(batches: BatchLayers | None) -> Callable[[pa.RecordBatch], list[np.ndarray]]:
    """Reads the places of the rows' batches, an array for each view that has batches."""
    views = len(batches.views) if batches else 0
    return lambda b: list(b.column("batches").flatten().to_numpy(zero_copy_only=False).reshape(-1, views).T) if views else []


def packed_rows(obs: DataFrame, ids: list[str], samples: DataFrame | None = None) -> DataFrame:
    """sample_id, condition and the finite values as sorted lists: idx (place in ``ids``) and vals."""
    place = obs.sparkSession.createDataFrame(pd.DataFrame({"feature_id": pd.Series(ids, dtype=object), "j": np.arange(len(ids), dtype=np.int32)}), "feature_id string, j int")
    at = obs.withColumn("value", finite(F.col("value"))).where("value is not null").join(F.broadcast(place), "feature_id")
    cells = at.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("j", F.col("value").cast("double").alias("value")))).alias("c"))
    out = cells.select(F.col("sample_id").cast("string").alias("sample_id"), F.transform("c", lambda s: s["j"]).alias("idx"), F.transform("c", lambda s: s["value"]).alias("vals"))
    if samples is not None and "condition" in samples.columns:
        return out.join(samples.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("condition").cast("string").alias("condition")), "sample_id", "left")
    return out.withColumn("condition", F.lit(None).cast("string"))


@dataclass
class Columns:
    """What a kernel needs to know about the features."""

    y: np.ndarray
    sigma: np.ndarray
    mu: np.ndarray
    weight: np.ndarray
    groups: list[tuple[str, np.ndarray]]
    cuts: tuple[np.ndarray, np.ndarray]
    batches: BatchLayers | None = None
    #: of the rows at hand: sigma delta and mu + theta, a row each or one for all
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None

    def at(self, places: list[np.ndarray]) -> Columns:
        """The columns as rows with these places of batches (an array for each view that has any) see them."""
        if self.batches is None:
            return replace(self, scale=self.sigma[None], shift=self.mu[None])
        n = len(self.sigma)
        return replace(self, scale=self.sigma * np.exp(self.batches.spread(places, n, "logdelta")), shift=self.mu + self.batches.spread(places, n, "theta"))

    @property
    def normal(self) -> bool:
        return all(kind == "normal" for kind, _ in self.groups)

    def terms(self, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, slope and curvature of each cell in z, without weights."""
        z = (x @ self.y) * self.scale + self.shift
        loss, g, h = np.zeros_like(d), np.zeros_like(d), np.zeros_like(d)
        for kind, cols in self.groups:
            loss[:, cols], g[:, cols], h[:, cols] = noise_terms(kind, z[:, cols], d[:, cols], tuple(c[cols] for c in self.cuts))
        return loss, g, h

    def solve(self, d: np.ndarray, ridge: np.ndarray, rounds: int = 25) -> np.ndarray:
        """The factor of each row: minimiser of its weighted loss plus 1/2 ridge x^2 (rows x K)."""
        k, n = self.y.shape
        pairs = (self.y[:, None, :] * self.y[None, :, :]).reshape(k * k, n).T
        scale = self.weight * self.scale**2
        diagonal = np.eye(k) * (ridge + 1e-8)[:, :, None]
        if self.normal:
            z = (d - self.shift) / self.scale
            w = np.isfinite(z) * scale
            b = (w * np.where(np.isfinite(z), z, 0.0)) @ self.y.T
            return np.linalg.solve((w @ pairs).reshape(-1, k, k) + diagonal, b[..., None])[..., 0]
        total = lambda x: (self.terms(x, d)[0] * self.weight).sum(axis=1) + 0.5 * (ridge * x * x).sum(axis=1)
        x = np.zeros((len(d), k))
        now = total(x)
        for _ in range(rounds):
            _, g, h = self.terms(x, d)
            slope = (g * self.weight * self.scale) @ self.y.T + ridge * x
            step = -np.linalg.solve(((h * scale) @ pairs).reshape(-1, k, k) + diagonal, slope[..., None])[..., 0]
            size = np.ones(len(d))
            for _ in range(12):  # halve the step of the rows that rise
                new = total(x + size[:, None] * step)
                worse = new > now + 1e-12 * np.abs(now)
                if not worse.any():
                    break
                size[worse] /= 2
            size[worse] = 0.0
            x = x + size[:, None] * step
            before, now = now, np.where(worse, now, new)
            if np.all(before - now <= 1e-9 * (1 + np.abs(now))):
                break
        return x


class Selection:
    """A ``keep`` callback of a fit: the model of the smallest loss among those whose scores pass.

    ``scores``: the scores of a model; their ``share`` quantile has to exceed ``least``.
    """

    def __init__(self, scores: Callable[[FactorModel], list[float]], least: float, share: float = 0.75) -> None:
        self.scores, self.least, self.share = scores, least, share
        self.loss, self.kept = np.inf, None

    def __call__(self, model: FactorModel, loss: float) -> None:
        if loss < self.loss and np.quantile(self.scores(model), self.share) > self.least:
            self.loss, self.kept = loss, (model.y.copy(), model.features.copy(), {v: a.copy() for v, a in model.assign.items()})


@dataclass
class Sums:
    """What a pass adds up: per feature the second moments a, slope b, loss, sums of slopes and curvatures in mu, squared slopes, values; of X; and slope and curvature in each layer."""

    a: np.ndarray
    b: np.ndarray
    loss: np.ndarray
    slope: np.ndarray
    curvature: np.ndarray
    squares: np.ndarray
    count: np.ndarray
    penalty: float
    grams: dict[str, np.ndarray]
    rows: float
    layers: dict[str, tuple[np.ndarray, np.ndarray]]


class RowSums:
    """Adds up :class:`Sums` over the rows of one task."""

    def __init__(self, columns: Columns, prior: SamplePrior) -> None:
        self.columns, self.prior = columns, prior
        k, n = columns.y.shape
        self.table, self.grams, self.penalty = np.zeros((n, k * k + k + 7)), {}, 0.0
        b = columns.batches
        self.batch = [np.zeros((*t.shape, 4)) for t in b.theta] if b else []

    def add(self, d: np.ndarray, conditions: list[str | None], places: list[np.ndarray] | None = None) -> None:
        """Solve the rows ``d`` and add what they give."""
        c, t = self.columns.at(places or []), self.table
        k = len(c.y)
        ridge = self.prior.weights(conditions, k)
        x = c.solve(d, ridge)
        loss, g, h = c.terms(x, d)
        pairs = (x[:, :, None] * x[:, None, :]).reshape(-1, k * k)
        t[:, : k * k] += (h * c.weight * c.scale**2).T @ pairs
        t[:, k * k : k * k + k] += (g * c.weight * c.scale).T @ x
        scaled = (x @ c.y) * c.scale  # how z grows with the logarithms of both scales
        slope, curvature = g * c.weight, h * c.weight
        own = (slope, curvature, slope * scaled, curvature * scaled * scaled)
        for i, v in enumerate((loss * c.weight, *own[:2], g * g, np.isfinite(d), *own[2:])):
            t[:, k * k + k + i] += v.sum(axis=0)
        for total, cols, at in zip(self.batch, c.batches.columns if c.batches else [], places or [], strict=True):
            for i, v in enumerate(own):
                np.add.at(total[:, :, i], at, v[:, cols])
        self.penalty += 0.5 * float((ridge * x * x).sum())
        for name in set(conditions):
            at = np.array([o == name for o in conditions])
            self.grams[name or ""] = self.grams.get(name or "", 0) + np.append(pairs[at].sum(axis=0), at.sum())

    def chunks(self) -> dict[str, np.ndarray]:
        batches = {k: v for i, b in enumerate(self.batch) for k, v in U.split_rows(f"batch{i}", b.reshape(-1, 4)).items()}
        return U.split_rows("column", self.table) | batches | {f"x:{name}": v for name, v in self.grams.items()} | {"penalty": np.array([self.penalty])}

    @staticmethod
    def gathered(got: dict[str, np.ndarray], k: int, n: int, batches: BatchLayers | None = None) -> Sums:
        t = U.join_rows("column", got, (n, k * k + k + 7))
        grams = {key[2:]: v for key, v in got.items() if key.startswith("x:")}
        penalty = float(got["penalty"][0]) if "penalty" in got else 0.0
        own = [U.join_rows(f"batch{i}", got, (b.size, 4)).reshape(*b.shape, 4)[:-1] for i, b in enumerate(batches.theta)] if batches else []
        flat = [np.concatenate([b[..., i].ravel() for b in own]) if own else np.zeros(0) for i in range(4)]
        mu = k * k + k
        layers = {"mu": (t[:, mu + 1], t[:, mu + 2]), "logsigma": (t[:, mu + 5], t[:, mu + 6]), "theta": (flat[0], flat[1]), "logdelta": (flat[2], flat[3])}
        return Sums(t[:, : k * k].reshape(n, k, k), t[:, k * k : mu], *t[:, mu : mu + 5].T, penalty, {c: v[:-1].reshape(k, k) for c, v in grams.items()}, sum(v[-1] for v in grams.values()), layers)


@dataclass
class FactorModel:
    """Fit, transform, impute, interpret, save and load.

    ``features`` (pandas): feature_id, view, distribution, mu, logsigma, weight,
    cut1, cut2 in model order; ``y``: K x N; ``factors`` (DataFrame): sample_id, x.

    ``prior`` of Y: 'l2' (a ridge by view, with ``selective_l1`` and ``network``
    and graphs a mixture), 'ard' or 'fsard'; of X: a ridge, and one by the
    samples' conditions where they have any.
    """

    k: int
    prior: str = "l2"
    ridge: float = 1.0
    alpha0: float = 1.001
    v0: float = 0.8
    selective_l1: float | None = None
    network: float | None = None
    features: pd.DataFrame | None = None
    y: np.ndarray | None = None
    factors: DataFrame | None = None
    batch: DataFrame | None = None
    batches: BatchLayers | None = None
    assign: dict[str, np.ndarray] = field(default_factory=dict)
    set_names: dict[str, list[str]] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    frozen: set[str] = field(default_factory=set)
    y_prior: Prior = field(default_factory=Prior)
    x_prior: SamplePrior | None = None
    started: float = field(default_factory=time.time)

    def note(self, name: str, **more: float) -> None:
        self.history.append({"name": name, "time": time.time() - self.started, **more})

    def freeze(self, *layers: str) -> None:
        """These layers keep their values in a joint refit; they are still applied."""
        self.frozen |= set(layers)

    def unfreeze(self, *layers: str) -> None:
        self.frozen -= set(layers or self.frozen)

    # -- data ------------------------------------------------------------------

    @staticmethod
    def validate(samples: DataFrame, features: DataFrame, batch_map: DataFrame | None = None) -> None:
        """Unique ids, known noise models, batches of known views only."""
        for df, key in ((samples, "sample_id"), (features, "feature_id")):
            if df.groupBy(key).count().where("count > 1").limit(1).count():
                raise ValueError(f"{key} is not unique")
        if (bad := features.where(~F.col("distribution").isin(*DISTRIBUTIONS)).select("distribution").first()) is not None:
            raise ValueError(f"unknown distribution {bad[0]!r}")
        if batch_map is not None and batch_map.select("view").distinct().join(features.select("view").distinct(), "view", "left_anti").limit(1).count():
            raise ValueError("batch_map names a view that no feature has")

    def rows(self, obs: DataFrame, samples: DataFrame | None = None, batch_map: DataFrame | None = None) -> DataFrame:
        """One row per sample: condition, sorted lists of model places and values, and the place of its batch in each view that has batches; features unknown to the model are dropped."""
        rows = packed_rows(obs, list(self.features["feature_id"]), samples)
        if self.batches is None:
            return rows
        if batch_map is None:
            return rows.withColumn("batches", F.array(*(F.lit(len(n)) for n in self.batches.names)))
        own = batch_map.select(F.col("sample_id").cast("string").alias("sample_id"), "view", F.col("batch").cast("string").alias("batch"))
        names = pd.DataFrame([(v, n, i) for v, names in zip(self.batches.views, self.batches.names, strict=True) for i, n in enumerate(names)], columns=["view", "batch", "place"])
        places = own.join(obs.sparkSession.createDataFrame(names, "view string, batch string, place int"), ["view", "batch"]).groupBy("sample_id", "view").agg(F.min("place").alias("place"))
        places = places.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("view", "place"))).alias("places"))
        return rows.join(places, "sample_id", "left").withColumn("batches", F.array(*(F.coalesce(F.col("places")[v], F.lit(len(n))) for v, n in zip(self.batches.views, self.batches.names, strict=True)))).drop("places")

    def _columns(self, y: np.ndarray | None = None) -> Columns:
        f = self.features
        kinds = f["distribution"].to_numpy()
        return Columns(self.y if y is None else y, np.exp(f["logsigma"].to_numpy(float)), f["mu"].to_numpy(float), f["weight"].to_numpy(float), [(d, np.flatnonzero(kinds == d)) for d in pd.unique(kinds)], (f["cut1"].to_numpy(float), f["cut2"].to_numpy(float)), self.batches)

    # -- one pass ----------------------------------------------------------------

    def _pass(self, rows: DataFrame, y: np.ndarray | None = None) -> Sums:
        """Solve all rows at ``y`` and add up what a step needs."""
        c, prior, places = self._columns(y), self.x_prior, _placing(self.batches)
        k, n = c.y.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = RowSums(c, prior)
            for b in (piece for whole in batches for piece in U.slices(whole, n)):
                sums.add(U.dense(b, n), b.column("condition").to_pylist(), places(b))
            yield U.partial(sums.chunks())

        return RowSums.gathered(U.add_up(rows.mapInArrow(run, U.SCHEMA)), k, n, self.batches)

    def _total(self, s: Sums, y: np.ndarray) -> float:
        return float(s.loss.sum()) + s.penalty + self.y_prior.value(y)

    def _descend(self, rows: DataFrame, epochs: int, tolerance: float, stage: str) -> Sums:
        """Newton steps on Y until the total loss changes by less than ``tolerance`` of itself.

        Steps grow while the loss falls (alternating minimisation moves along the
        same way for long) and are cut while it rises; the best Y is kept.
        """
        best, step, size, kept = np.inf, np.zeros_like(self.y), 1.0, None
        at = self.y
        for epoch in range(epochs + 1):
            s = self._pass(rows, at)
            total = self._total(s, at)
            self.note("epoch", stage=stage, epoch=epoch, total_loss=total, data_loss=float(s.loss.sum()), rate=size)
            if total > best:
                size = 1.0 if size > 1 else size / 2
                if size < _LEAST_STEP:
                    break
                at = self.y + size * step
                continue
            gain, best, self.y, kept = best - total, total, at, s
            if gain <= tolerance * abs(total):
                break
            curvature = s.a + np.eye(self.k) * (self.y_prior.curvature(at).T + 1e-10)[:, :, None]
            step = -np.linalg.solve(curvature, (s.b + self.y_prior.gradient(at).T)[..., None])[..., 0].T
            size = min(_MOST_STEP, 1.5 * size)
            at = self.y + size * step
        slope = kept.b.T + self.y_prior.gradient(self.y)
        self.note("descended", stage=stage, total_loss=best, gradient=float(np.abs(slope).max()), step=float(np.abs(step).max()))
        return kept

    # -- fit -------------------------------------------------------------------------

    def fit(
        self,
        obs: DataFrame,
        samples: DataFrame,
        features: DataFrame,
        batch_map: DataFrame | None = None,
        sets: DataFrame | None = None,
        graphs: list[list[tuple[str, str, float]]] | None = None,
        epochs: int = 200,
        outer: int = 10,
        tolerance: float = 1e-5,
        weights: str = "EB",
        joint: bool = False,
        rotate: bool = True,
        ordinal_start: bool = False,
        batch_rounds: int = 100,
        lbfgs_rounds: int = 0,
        seed: int = 0,
        keep: Callable[[FactorModel, float], None] | None = None,
    ) -> FactorModel:
        """Start values, batch effects, then the stages of the prior; whitened, reweighted and ordered at the end.

        'l2': with ``weights`` 'EB' a first fit under a minimal prior sets the
        priors' weights, else they stay as given.  'ard': a first fit under the
        minimal prior, then the relevance prior.  'fsard': that, then the
        assignment of ``sets`` (view, set_id, feature_id, weight) and Y by turns
        until the scales settle, at most ``outer`` times.  ``graphs``: an edge
        list for each factor.  ``keep`` is called with the model and its loss
        after each stage.  ``joint``: all layers that are not frozen (logsigma, mu and,
        with batches, logdelta and theta) are refitted with Y at the end.
        ``lbfgs_rounds``: so many rounds of L-BFGS over X, from zeros plus noise of
        the samples' ids, and Y under the minimal prior give the first Y.
        """
        if self.prior == "fsard" and sets is None:
            raise ValueError("the prior 'fsard' needs feature sets")
        self.validate(samples, features, batch_map)
        self.note("start")
        clean = obs
        if batch_map is not None:
            clean = self._without_batch_effects(obs, samples, features, batch_map, batch_rounds)
        self._start(clean, features, seed, ordinal_start)
        if self.batch is not None:
            self.batches = BatchLayers.of(self.batch, self.features)
        rows = save(self.rows(obs, samples, batch_map), "factor-rows")
        relevance = self.prior in ("ard", "fsard")
        conditions = sorted({r[0] for r in rows.select("condition").where("condition is not null").distinct().collect()})
        views, ids = self.features["view"].to_numpy(), list(self.features["feature_id"])
        x_prior = SamplePrior.of(self.k, self.ridge, conditions, self.ridge, relevance)
        y_prior = Relevance() if relevance else feature_prior(self.k, views, ids, l2=self.ridge, selective_l1=self.selective_l1, network=self.network, graphs=graphs)

        # at Y = 0: weights of the losses; values for the first prior
        self.x_prior = SamplePrior(np.ones(self.k))
        zero = self._pass(rows, np.zeros_like(self.y))
        self._reweight(zero)
        if relevance or weights == "EB":
            self.x_prior = SamplePrior(np.full(self.k, 1e-6 if relevance else 1.0))
            sigma = self.features["logsigma"].to_numpy(float)
            self.y_prior = minimal_prior(self.features["distribution"].to_numpy(), self.k, sigma, self._variance, zero.count, int(zero.rows))
            if lbfgs_rounds:
                self._start_lbfgs(rows, lbfgs_rounds)
            s = self._descend(rows, epochs, tolerance, "first")
            if rotate:
                u, d, v = np.linalg.svd(self.y, full_matrices=False)
                self.y = d[:, None] * v
                s.grams = {c: u.T @ g @ u for c, g in s.grams.items()}
            if relevance:
                self._whiten_columns(np.sqrt(np.maximum(sum(np.diag(g) for g in s.grams.values()) / max(1.0, s.rows), 0)))
                s = self._pass(rows)
            x_prior.reweight(s.grams)
            y_prior.reweight(self.y)
            self._reweight(s)
            self.note("reweight_eb")
        self.x_prior, self.y_prior = x_prior, y_prior
        s = self._descend(rows, epochs, tolerance, "fit")
        if keep is not None:
            keep(self, self._total(s, self.y))
        if self.prior == "fsard":
            self.y_prior = feature_prior(self.k, views, ids, sets=self._set_prior(sets))
            for turn in range(outer):
                change = self.y_prior.update(self.y)
                self.note("assignment", turn=turn, change=change)
                if change < tolerance or turn == outer - 1:
                    break
                s = self._descend(rows, epochs, tolerance, f"sets {turn}")
                if keep is not None:
                    keep(self, self._total(s, self.y))
            self.assign, self.set_names = self.y_prior.assign, self.y_prior.names
        if joint:
            s = self._joint(rows, epochs, tolerance)
        self.factors = save(self._factors(rows, self.x_prior), "factors")
        self.whiten()
        self._reweight(s)
        self.reorder()
        self.note("finish")
        return self

    def _without_batch_effects(self, obs: DataFrame, samples: DataFrame, features: DataFrame, batch_map: DataFrame, rounds: int) -> DataFrame:
        """Fits the batch effects of all features; gives the values to start from: those of normal features without their effects, others as they are."""
        self.batch, used = fit_batch_effects(obs, batch_map, samples, features, rounds=rounds)
        self.note("batch_effects", rounds=used)
        normal = features.where("distribution = 'normal'").select("feature_id")
        own = obs.join(normal, "feature_id", "left_semi")
        params = self.batch.join(own.groupBy("feature_id").agg(F.avg("value").alias("mu")), "feature_id")
        rest = obs.join(normal, "feature_id", "left_anti").select("sample_id", "feature_id", "view", "value")
        return remove_batch(own, batch_map, params).unionByName(rest)

    def _start(self, obs: DataFrame, features: DataFrame, seed: int, ordinal_start: bool) -> None:
        """Model order, shifts at the columns' own best, scales of normal columns, a random Y."""
        f = features.toPandas().sort_values(["distribution", "view", "feature_id"]).reset_index(drop=True)
        stats = obs.groupBy("feature_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.var_samp("value").alias("v")).toPandas().set_index("feature_id")
        m, s, v = (f["feature_id"].map(stats[c]) for c in ("m", "s", "v"))
        kind, inside = f["distribution"], m.fillna(0.5).clip(1e-3, 1 - 1e-3)
        f["cut1"], f["cut2"] = THRESHOLDS
        levels = self._levels(obs, f)
        if ordinal_start:
            for view, own in f[kind == "ordinal3"].groupby("view"):
                share = np.cumsum(1 + levels[own.index].sum(axis=0)) / (3 + levels[own.index].sum())
                f.loc[own.index, ["cut1", "cut2"]] = np.log(share[:2] / (1 - share[:2]))
        f["mu"] = np.where(kind == "bernoulli", np.log(inside / (1 - inside)), np.where(kind == "poisson", np.log(m.fillna(1.0).clip(lower=1e-3)), np.where(kind == "normal", m.fillna(0.0), 0.0)))
        for name in ("bernoulli_sq_hinge", "ordinal3", "ordinal_sq_hinge3"):
            own = np.flatnonzero(kind == name)
            f.loc[own, "mu"] = column_estimates(name, levels[own], (f["cut1"].to_numpy()[own], f["cut2"].to_numpy()[own]))
        f["logsigma"] = np.where(kind == "normal", np.log(s.where(s > 0, 1.0).fillna(1.0)), 0.0)
        f["weight"] = 1.0
        self.features, self._variance = f, v.to_numpy(float)
        self.y = np.random.default_rng(seed).standard_normal((self.k, len(f))) * 0.3

    def _start_lbfgs(self, rows: DataFrame, rounds: int) -> None:
        from strandloom.operators.descent import fit_lbfgs, with_state
        from strandloom.operators.simulate import gaussian

        noise = F.array(*(0.1 * gaussian(F.col("sample_id"), F.lit(k), seed=7) for k in range(self.k)))
        state = with_state(rows, rows.select("sample_id", noise.alias("x")), g=self.k, past=0)
        _, self.y, losses = fit_lbfgs(state, self._columns(), self.x_prior, self.y_prior, rounds=rounds, rel_tol=1e-5)
        self.note("lbfgs", rounds=len(losses) - 1, first_loss=losses[0], total_loss=losses[-1])

    @staticmethod
    def _levels(obs: DataFrame, f: pd.DataFrame) -> np.ndarray:
        """Counts of the three levels (0/1 noise: none, 0, 1) of each feature with discrete noise; zeros for others."""
        out = np.zeros((len(f), 3))
        some = f[f["distribution"].isin(["bernoulli_sq_hinge", "ordinal3", "ordinal_sq_hinge3"])]
        if len(some):
            kinds = obs.sparkSession.createDataFrame(pd.DataFrame({"feature_id": some["feature_id"], "place": some.index, "binary": some["distribution"] == "bernoulli_sq_hinge"}))
            level = F.when(F.col("binary"), F.when(F.col("value") > 0.5, 2).otherwise(1)).otherwise(F.least(F.greatest(F.round("value"), F.lit(1)), F.lit(3)) - 1).cast("int")
            for r in obs.where("value is not null").join(F.broadcast(kinds), "feature_id").groupBy("place", level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect():
                out[r["place"], r["level"]] = r["n"]
        return out

    def _reweight(self, s: Sums) -> None:
        """Weights of the losses: 1 / (root mean square slope over all samples * sigma), 1 where that is not finite."""
        size = np.sqrt(s.squares / max(1.0, s.rows)) * np.exp(self.features["logsigma"].to_numpy(float))
        self.features["weight"] = np.divide(1.0, size, out=np.ones_like(size), where=size > 1e-12)

    def layer_values(self) -> dict[str, np.ndarray]:
        """Every layer as one vector; batch values view by view, batch by batch."""
        out = {n: self.features[n].to_numpy(float, copy=True) for n in ("mu", "logsigma")}
        for n in ("theta", "logdelta"):
            out[n] = np.concatenate([t[:-1].ravel() for t in getattr(self.batches, n)]) if self.batches else np.zeros(0)
        return out

    def _set_layer(self, name: str, v: np.ndarray) -> None:
        if name in ("mu", "logsigma"):
            self.features[name] = v
            return
        at = 0
        for table in getattr(self.batches, name):
            size = (len(table) - 1) * table.shape[1]
            table[:-1] = v[at : at + size].reshape(-1, table.shape[1])
            at += size

    def _layer_priors(self) -> LayerPriors:
        """Priors of the layers, with centres and weights from their present values."""
        b = self.batches
        labels = np.concatenate([np.repeat([f"{v} {n}" for n in names], len(cols)) for v, names, cols in zip(b.views, b.names, b.columns, strict=True)]) if b else None
        out = LayerPriors.of(self.features["view"].to_numpy(), labels)
        out.reweight(self.layer_values())
        return out

    def _joint(self, rows: DataFrame, epochs: int, tolerance: float) -> Sums:
        """Layers and Y, block by block, until a turn changes the loss by less than ``tolerance`` of itself.

        A turn takes a Newton step in each layer that is not frozen, from the
        slopes and curvatures that a pass adds up by feature and by batch, and
        halves it while the loss rises; then one in Y.  Samples are solved anew
        in every pass, so the loss is always at their best.
        """
        priors = self.layer_priors = self._layer_priors()
        names = [n for n in LAYERS if n not in self.frozen and (self.batches or n in ("mu", "logsigma"))]
        total = lambda s: self._total(s, self.y) + priors.value(self.layer_values())
        s = self._pass(rows)
        now = last = total(s)
        for turn in range(epochs):
            for name in names:
                v = self.layer_values()[name]
                slope, curvature = s.layers[name]
                step = -(slope + priors.priors[name].gradient(v)) / (curvature + priors.priors[name].curvature(v) + 1e-9)
                for size in (1.0, 0.5, 0.25, 0.125, 0.0):
                    self._set_layer(name, v + size * step)
                    new = self._pass(rows)
                    if total(new) <= now or not size:
                        break
                s, now = new, total(new)
            s = self._descend(rows, 1, tolerance, "joint")
            now = total(s)
            gradient = max((float(np.abs(s.layers[n][0] + priors.priors[n].gradient(self.layer_values()[n])).max(initial=0)) for n in names), default=0.0)
            self.note("joint", turn=turn, total_loss=now, gradient=gradient)
            if last - now <= tolerance * abs(now):
                break
            last = now
        if self.batches:
            self.batch = rows.sparkSession.createDataFrame(self.batches.frame(self.features), "view string, batch string, feature_id string, theta double, logdelta double")
        return s

    def _set_prior(self, sets: DataFrame) -> FeatureSets:
        out = FeatureSets(alpha0=self.alpha0, v0=self.v0)
        for view, g in sets.toPandas().groupby("view"):
            cols = np.flatnonzero(self.features["view"] == view)
            place = {f: i for i, f in enumerate(self.features["feature_id"].to_numpy()[cols])}
            names = sorted(g["set_id"].unique(), key=str)
            at = {n: i for i, n in enumerate(names)}
            s = np.zeros((len(names), len(cols)))
            for sid, fid, w in zip(g["set_id"], g["feature_id"], g["weight"], strict=True):
                if fid in place:
                    s[at[sid], place[fid]] = w
            out.sets[view], out.names[view] = (cols, s), list(map(str, names))
        return out

    def _factors(self, rows: DataFrame, prior: SamplePrior | None) -> DataFrame:
        """(sample_id, x) of the rows at the present Y; without a prior the least squares factor."""
        c, places = self._columns(), _placing(self.batches)
        k, n = c.y.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (piece for whole in batches for piece in U.slices(whole, n)):
                ridge = prior.weights(b.column("condition").to_pylist(), k) if prior else np.zeros((b.num_rows, k))
                x = c.at(places(b)).solve(U.dense(b, n), ridge)
                yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.ravel()))], ["sample_id", "x"])

        return rows.mapInArrow(run, "sample_id string, x array<double>")

    # -- normal forms --------------------------------------------------------------------

    def _scale_factors(self, m: np.ndarray) -> None:
        """x <- m x for every sample."""
        rows = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, row))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in m]
        self.factors = self.factors.select("sample_id", F.array(*rows).alias("x"))

    def _whiten_columns(self, rms: np.ndarray) -> None:
        """Y takes the size of X; per view its largest row is scaled to one and its size goes to sigma."""
        self.y = self.y * rms[:, None]
        for view in self.features["view"].unique():
            cols = np.flatnonzero(self.features["view"] == view)
            top = np.sqrt((self.y[:, cols] ** 2).mean(axis=1)).max()
            if top > 0:
                self.y[:, cols] /= top
                self.features.loc[cols, "logsigma"] += np.log(top)
            else:
                self.features.loc[cols, "logsigma"] = -1e9

    def whiten(self) -> None:
        """Factors of unit root mean square; per view the largest row of Y to one, its size into sigma."""
        ms = self.factors.agg(*(F.sqrt(F.avg(F.col("x")[i] ** 2)).alias(f"r{i}") for i in range(self.k))).first()
        rms = np.array([r or 1.0 for r in ms])
        rms[rms == 0] = 1.0
        self._scale_factors(np.diag(1 / rms))
        self._whiten_columns(rms)

    def rotate(self) -> None:
        """Y = U S V': Y <- S V', x <- U'x."""
        u, s, v = np.linalg.svd(self.y, full_matrices=False)
        self.y = s[:, None] * v
        self._scale_factors(u.T)

    def reorder(self) -> None:
        """Factors by decreasing sum of squares of Y, in every parameter and prior."""
        order = np.argsort(-(self.y**2).sum(axis=1), kind="stable")
        self.y = self.y[order]
        self.y_prior.reorder(order)
        if self.x_prior is not None:
            self.x_prior.reorder(order)
        if isinstance(self.y_prior, FeatureSets):
            self.assign = self.y_prior.assign
        else:
            self.assign = {v: a[:, order] for v, a in self.assign.items()}
        self._scale_factors(np.eye(self.k)[order])

    # -- use -------------------------------------------------------------------------------

    def transform(self, obs: DataFrame, batch_map: DataFrame | None = None) -> DataFrame:
        """(sample_id, x) of new samples with Y, mu and sigma held and no prior; features align by id.

        Batch effects of new data are left alone; with ``batch_map`` those of
        batches that the model knows are part of the model of a row.  Rows are independent,
        so this also works on a stream's micro-batches.
        """
        return self._factors(self.rows(obs, batch_map=batch_map), None)

    def latent(self, factors: DataFrame | None = None) -> DataFrame:
        """(sample_id, feature_id, view, distribution, z, cut1, cut2): the forward model without batch terms, as a long table."""
        f = self.features.assign(y=[list(map(float, c)) for c in self.y.T])[["feature_id", "view", "distribution", "mu", "logsigma", "cut1", "cut2", "y"]]
        src = factors if factors is not None else self.factors
        feats = src.sparkSession.createDataFrame(f)
        dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return src.crossJoin(F.broadcast(feats)).select("sample_id", "feature_id", "view", "distribution", (dot * F.exp("logsigma") + F.col("mu")).alias("z"), "cut1", "cut2")

    def impute(self, factors: DataFrame | None = None, batch_map: DataFrame | None = None) -> DataFrame:
        """(sample_id, feature_id, value): expected values, with batch effects if ``batch_map`` is given."""
        z = self.latent(factors)
        if batch_map is not None and self.batch is not None:
            mu = z.sparkSession.createDataFrame(self.features[["feature_id", "mu"]])
            j = z.join(batch_map.withColumn("batch", F.col("batch").cast("string")), ["view", "sample_id"], "left").join(self.batch.withColumn("batch", F.col("batch").cast("string")), ["view", "batch", "feature_id"], "left").join(F.broadcast(mu), "feature_id")
            z = j.withColumn("z", (F.col("z") - F.col("mu")) * F.exp(F.coalesce("logdelta", F.lit(0.0))) + F.col("mu") + F.coalesce("theta", F.lit(0.0)))
        return z.select("sample_id", "feature_id", impute(F.col("distribution"), F.col("z"), (F.col("cut1"), F.col("cut2"))).alias("value"))

    def interpret(self, spark: SparkSession) -> DataFrame:
        """Report of the sets assigned to each factor, see ``interpret_report``."""
        from strandloom.operators.ordered import interpret_report

        rows = [(k, v, self.set_names[v][i], float(a[i, k])) for v, a in self.assign.items() for i, k in zip(*np.nonzero(a), strict=True)]
        return interpret_report(spark.createDataFrame([(int(k), v, s, x) for k, v, s, x in rows], "k int, view string, set_name string, score double"))

    # -- files -------------------------------------------------------------------------------

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """One table per parameter: features (mu, logsigma), Y, X, batch values, assignments."""
        out = {"features": spark.createDataFrame(self.features.reset_index(names="feature_idx"))}
        out["Y"] = spark.createDataFrame(pd.DataFrame({"feature_id": self.features["feature_id"], "y": [list(map(float, c)) for c in self.y.T]}))
        out["X"] = self.factors
        if self.batch is not None:
            out["batch"] = self.batch
        if self.assign:
            out["A"] = spark.createDataFrame([(v, self.set_names[v][i], int(k), float(a[i, k])) for v, a in self.assign.items() for i in range(a.shape[0]) for k in range(a.shape[1])], "view string, set_name string, k int, v double")
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        save_tables(path, self.tables(spark), {"k": self.k, "prior": self.prior, "ridge": self.ridge, "alpha0": self.alpha0, "v0": self.v0, "selective_l1": self.selective_l1, "network": self.network, "history": self.history})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FactorModel:
        t, meta = load_tables(spark, path)
        m = cls(meta["k"], meta["prior"], meta["ridge"], meta["alpha0"], meta["v0"], meta["selective_l1"], meta["network"], history=meta["history"])
        m.features = t["features"].orderBy("feature_idx").toPandas().drop(columns="feature_idx")
        ys = {r["feature_id"]: r["y"] for r in t["Y"].collect()}
        m.y, m.factors, m.batch = np.array([ys[f] for f in m.features["feature_id"]]).T, t["X"], t.get("batch")
        if m.batch is not None:
            m.batches = BatchLayers.of(m.batch, m.features)
        if "A" in t:
            for v, g in t["A"].toPandas().groupby("view"):
                wide = g.pivot(index="set_name", columns="k", values="v")
                m.assign[v], m.set_names[v] = wide.to_numpy(), list(wide.index)
        return m
