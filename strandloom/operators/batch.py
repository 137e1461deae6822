"""Batch effects: per (view, batch) shifts and scales, method of moments, EM.

All observations of a feature in one condition and batch have the same latent
value: the value of feature and condition plus the batch's shift.  So for every
noise model the data come down to a few sums per (view, batch, feature,
condition), made in one pass: count, sum, sum of squares, counts of levels.  All
rounds run on these.  A round gives, per (view, batch, feature), the slope and
curvature of the loss in the shift and the Pearson sum of squares; the shift
takes the Newton step that a normal prior over the batch's features shrinks, the
squared scale the mean of its inverse gamma posterior.  (View, batch) groups do
not depend on each other: one grouped call runs all rounds of a group, whose
size is that of its features' parameters, however many samples there are.

With normal noise a round is the closed form of :func:`em_round`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.noise import THRESHOLDS, column_estimates, noise_terms
from strandloom.sources.scratch import save

#: Noise whose sums of values are enough; others need counts of levels.
_BY_SUMS = ("normal", "bernoulli", "poisson")
_SUMS = ("n", "s", "q", "n1", "n2", "n3")


def residual_statistics(obs: DataFrame, batch_map: DataFrame, samples: DataFrame) -> DataFrame:
    """(view, batch, feature_id, n, s, q, sigma2): residuals after the mean of the sample's condition.

    sigma2 is the feature's residual variance (1 where it is missing or 0).
    """
    mean = obs.join(samples, "sample_id").groupBy("feature_id", "condition").agg(F.avg("value").alias("m"))
    res = obs.join(samples, "sample_id").join(mean, ["feature_id", "condition"]).withColumn("r", F.col("value") - F.col("m"))
    sigma2 = res.groupBy("feature_id").agg(F.coalesce(F.nullif(F.var_pop("r"), F.lit(0.0)), F.lit(1.0)).alias("sigma2"))
    stats = res.join(batch_map, ["view", "sample_id"]).groupBy("view", "batch", "feature_id").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    return stats.join(sigma2, "feature_id")


def least_squares_start(stats: DataFrame) -> DataFrame:
    """theta = batch mean of the residuals, delta2 = ratio of batch to feature variance (1 where missing)."""
    theta = F.try_divide(F.col("s"), F.col("n"))
    var = F.try_divide(F.col("q"), F.col("n")) - theta * theta
    delta2 = F.coalesce(F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0)) / F.col("sigma2"), F.lit(1.0))
    return stats.withColumn("theta_lsq", theta).withColumn("theta", theta).withColumn("delta2", delta2)


def em_round(state: DataFrame) -> DataFrame:
    """One round: priors by moments per (view, batch), then posterior means of theta and delta2."""
    prior = state.groupBy("view", "batch").agg(
        F.avg("theta").alias("tm"), F.coalesce(F.var_samp("theta"), F.lit(1.0)).alias("tv"), F.avg("delta2").alias("dm"), F.coalesce(F.var_samp("delta2"), F.lit(0.0)).alias("dv")
    )
    alpha = 2 + F.col("dm") ** 2 / (F.col("dv") + 1e-9)
    p = prior.withColumn("alpha", alpha).withColumn("beta", F.col("dm") * (F.col("alpha") - 1))
    j = state.join(p, ["view", "batch"])
    spread = F.col("delta2") * F.col("sigma2")
    theta = (F.col("tm") * spread + F.col("theta_lsq") * F.col("n") * F.col("tv")) / (spread + F.col("n") * F.col("tv"))
    j = j.withColumn("theta", theta)
    sse = F.col("q") - 2 * F.col("theta") * F.col("s") + F.col("n") * F.col("theta") * F.col("theta")
    delta2 = (F.col("beta") + 0.5 * sse / F.col("sigma2")) / (F.col("alpha") + 0.5 * F.col("n") - 1)
    return j.withColumn("delta2", delta2).select(*state.columns)


def cell_statistics(obs: DataFrame, batch_map: DataFrame, samples: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(view, batch, feature_id, condition, distribution, cut1, cut2, n, s, q, n1, n2, n3); batch is null for samples without one.

    ``features``: feature_id, distribution and, for ordinal noise, cut1 and cut2
    (default -1 and 1); without it all noise is normal.  Levels of 0/1 noise are
    counted as second and third.  Missing values and samples that ``samples``
    does not name are left out.
    """
    o = obs.select("sample_id", "feature_id", "view", "value").where("value is not null").join(samples.select("sample_id", F.coalesce(F.col("condition").cast("string"), F.lit("")).alias("condition")), "sample_id")
    if features is None:
        o = o.withColumns({"distribution": F.lit("normal"), "cut1": F.lit(THRESHOLDS[0]), "cut2": F.lit(THRESHOLDS[1])})
    else:
        cuts = [(F.col(c) if c in features.columns else F.lit(t)).alias(c) for c, t in zip(("cut1", "cut2"), THRESHOLDS, strict=True)]
        o = o.join(features.select("feature_id", "distribution", *cuts), "feature_id")
    level = F.when(F.col("distribution") == "bernoulli_sq_hinge", F.when(F.col("value") > 0.5, 3).otherwise(2)).when(~F.col("distribution").isin(*_BY_SUMS), F.least(F.greatest(F.round("value"), F.lit(1)), F.lit(3)))
    o = o.withColumn("level", level).join(batch_map.select("view", "sample_id", "batch"), ["view", "sample_id"], "left")
    v = F.col("value").cast("double")
    counts = [F.sum((F.col("level") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3)]
    keys = ["view", "batch", "feature_id", "condition", "distribution", "cut1", "cut2"]
    return o.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), *counts).fillna(0.0, ["n1", "n2", "n3"])


class Cells:
    """Cells as arrays, in the order of their features' places."""

    def __init__(self, pdf: pd.DataFrame, place: np.ndarray | None = None) -> None:
        self.place = np.arange(len(pdf)) if place is None else place
        self.starts = np.flatnonzero(np.diff(self.place, prepend=-1))
        self.sums = {c: pdf[c].to_numpy(float) for c in _SUMS}
        self.cuts = tuple(pdf[c].to_numpy(float) for c in ("cut1", "cut2"))
        kinds = pdf["distribution"].to_numpy()
        self.kinds = [(k, np.flatnonzero(kinds == k)) for k in pd.unique(kinds)]

    def working(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slope, curvature and Pearson sum of squares of each cell at the latent values z."""
        out = np.zeros((3, len(z)))
        for kind, at in self.kinds:
            n, s, q, *levels = (v[at] for v in self.sums.values())
            own = np.clip(z[at], -30, 30) if kind != "normal" else z[at]
            if kind in _BY_SUMS:
                mean = {"normal": lambda: own, "bernoulli": lambda: 1 / (1 + np.exp(-own)), "poisson": lambda: np.exp(own)}[kind]()
                spread = {"normal": np.ones_like(own), "bernoulli": mean * (1 - mean), "poisson": mean}[kind]
                out[:, at] = n * mean - s, n * spread, (q - 2 * mean * s + n * mean * mean) / spread
                continue
            cuts = tuple(c[at] for c in self.cuts)
            g, h, squares = np.zeros_like(own), np.zeros_like(own), np.zeros_like(own)
            for count, d in zip(levels, (0, 0, 1) if kind == "bernoulli_sq_hinge" else (1, 2, 3), strict=True):
                _, slope, bend = noise_terms(kind, own, np.full(len(own), float(d)), cuts)
                g, h, squares = g + count * slope, h + count * bend, squares + count * slope * slope
            out[:, at] = g, h, squares * n / np.maximum(h, 1e-9)
        return tuple(out)

    def by_feature(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.add.reduceat(v, self.starts) for v in self.working(z))

    def base(self) -> np.ndarray:
        """The best latent value of each cell alone; half an observation is added to counts, so that all are finite."""
        out = np.zeros(len(self.place))
        for kind, at in self.kinds:
            n, s = self.sums["n"][at], self.sums["s"][at]
            if kind == "normal":
                out[at] = s / n
            elif kind == "bernoulli":
                out[at] = np.log((s + 0.5) / (n - s + 0.5))
            elif kind == "poisson":
                out[at] = np.log((s + 0.5) / n)
            else:
                levels = np.stack([self.sums[f"n{i}"][at] for i in (1, 2, 3)], axis=1) + 0.5
                if kind == "bernoulli_sq_hinge":
                    levels[:, 0] = 0
                out[at] = column_estimates(kind, levels, tuple(c[at] for c in self.cuts))
        return out


def fit_group(pdf: pd.DataFrame, rounds: int, tolerance: float, newton: int, again: bool = True) -> pd.DataFrame:
    """theta, logdelta and the rounds run for the features of one (view, batch).

    First shifts without a prior, by ``newton`` steps at most, and raw scales;
    then rounds of priors by moments (only the first round's, unless ``again``)
    and posterior means.  Steps in shifts under other than normal noise are at
    most 1.
    """
    pdf = pdf.sort_values(["feature_id", "condition"], ignore_index=True)
    place = pd.factorize(pdf["feature_id"])[0]
    cells, base = Cells(pdf, place), pdf["base"].to_numpy(float)
    first = pdf.iloc[cells.starts]
    sigma2, n = first["sigma2"].to_numpy(float), np.add.reduceat(cells.sums["n"], cells.starts)
    most = np.where(first["distribution"] == "normal", np.inf, 1.0)
    theta = np.zeros(len(first))
    for _ in range(newton):
        g, h, _ = cells.by_feature(base + theta[place])
        step = np.clip(-g / np.maximum(h, 1e-9), -most, most)
        theta = theta + step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    raw = cells.by_feature(base + theta[place])[2] / n / sigma2
    delta2, used = np.where(raw > 0, raw, 1.0), 0
    for used in range(1, rounds + 1):
        if again or used == 1:
            tm, tv = theta.mean(), theta.var(ddof=1) if len(theta) > 1 else 1.0
            dm, dv = delta2.mean(), delta2.var(ddof=1) if len(delta2) > 1 else 0.0
            alpha = 2 + dm * dm / (dv + 1e-9)
            beta = dm * (alpha - 1)
        g, h, _ = cells.by_feature(base + theta[place])
        noise = delta2 * sigma2
        new = (tm * noise + (theta * h - g) * tv) / (noise + h * tv)
        new = theta + np.clip(new - theta, -most, most)
        q = cells.by_feature(base + new[place])[2]
        delta2 = (beta + 0.5 * q / sigma2) / (alpha + 0.5 * n - 1)
        change, theta = ((new - theta) ** 2).sum(), new
        if change <= tolerance * (new**2).sum():
            break
    return pd.DataFrame({"view": first["view"].to_numpy(), "batch": first["batch"].to_numpy(), "feature_id": first["feature_id"].to_numpy(), "theta": theta, "logdelta": 0.5 * np.log(delta2), "rounds": used})


def fit_batch_effects(
    obs: DataFrame, batch_map: DataFrame, samples: DataFrame, features: DataFrame | None = None, rounds: int = 100, tolerance: float = 1e-8, newton: int = 25, method: str = "EM"
) -> tuple[DataFrame, int]:
    """(view, batch, feature_id, theta, logdelta) under each feature's noise model, and the most rounds that a group ran.

    ``method``: 'EM' estimates the priors anew each round, 'EB' once, 'LS' uses none.
    A group stops when |change of theta|^2 <= tolerance |theta|^2.  Features
    whose observations are of one kind only have finite shifts through the
    prior.  An empty table gives no rows.
    """
    if method not in ("EM", "EB", "LS"):
        raise ValueError(f"unknown method {method!r}; known: EM, EB, LS")
    rounds = 0 if method == "LS" else rounds
    cells = save(cell_statistics(obs, batch_map, samples, features), "batch-cells")
    keys = ["feature_id", "condition"]
    condition = cells.groupBy(*keys, "distribution", "cut1", "cut2").agg(*(F.sum(c).alias(c) for c in _SUMS))
    base = condition.mapInPandas(lambda it: (p[keys].assign(base=Cells(p).base()) for p in it), "feature_id string, condition string, base double")
    cells = cells.withColumn("feature_id", F.col("feature_id").cast("string")).join(base, keys)
    squares = cells.mapInPandas(lambda it: (p[["feature_id", "n"]].assign(q=Cells(p).working(p["base"].to_numpy(float))[2]) for p in it), "feature_id string, n double, q double")
    sigma2 = squares.groupBy("feature_id").agg(F.coalesce(F.nullif(F.sum("q") / F.sum("n"), F.lit(0.0)), F.lit(1.0)).alias("sigma2"))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    ready = cells.where("batch is not null").join(sigma2, "feature_id")
    schema = f"view {kinds['view']}, batch {kinds['batch']}, feature_id string, theta double, logdelta double, rounds int"
    fitted = save(ready.groupBy("view", "batch").applyInPandas(lambda pdf: fit_group(pdf, rounds, tolerance, newton, method == "EM"), schema), "batch-effects")
    return fitted.drop("rounds"), fitted.agg(F.max("rounds")).first()[0] or 0


def batch_template(batch_map: DataFrame, features: DataFrame) -> DataFrame:
    """Zero value for every batch of a view and feature of that view."""
    return batch_map.select("view", "batch").distinct().join(features.select("view", "feature_id"), "view").withColumn("batch_value", F.lit(0.0))


def block(df: DataFrame, samples: tuple[int, int], features: tuple[int, int]) -> DataFrame:
    """Sub-matrix by inclusive ranges of sample_idx and feature_idx."""
    return df.where(F.col("sample_idx").between(*samples) & F.col("feature_idx").between(*features))


def remove_batch(obs: DataFrame, batch_map: DataFrame, params: DataFrame, mode: str = "exact") -> DataFrame:
    """Values without batch effects, in link space (normal noise).

    ``params``: view, batch, feature_id, theta, logdelta, mu.  'exact' inverts the
    model: (z - mu - theta) / delta + mu; 'literal' is (z - theta) / delta.
    """
    j = obs.join(batch_map, ["view", "sample_id"], "left").join(params, ["view", "batch", "feature_id"], "left")
    theta, delta, mu = F.coalesce("theta", F.lit(0.0)), F.exp(F.coalesce("logdelta", F.lit(0.0))), F.coalesce("mu", F.lit(0.0))
    if mode == "literal":
        mu = F.lit(0.0)
    return j.select("sample_id", "feature_id", "view", ((F.col("value") - mu - theta) / delta + mu).alias("value"))
