"""Regularisers: values, gradients and empirical-Bayes weights over long parameter tables.

Factors are long: y(k, feature_id, view, v), x(k, sample_id, condition, v).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalars import guarded


def l2(p: DataFrame, weights: DataFrame) -> DataFrame:
    """1/2 sum_k w_k sum v^2.  weights: k, w."""
    return p.join(weights, "k").agg((0.5 * F.sum(F.col("w") * F.col("v") ** 2)).alias("loss"))


def l1(p: DataFrame, weights: DataFrame) -> DataFrame:
    return p.join(weights, "k").agg(F.sum(F.col("w") * F.abs("v")).alias("loss"))


def selective_l1(y: DataFrame, mask: DataFrame, weights: DataFrame) -> DataFrame:
    """L1 on the entries (k, feature_id) in ``mask``, the features outside the factor's pathway."""
    return l1(y.join(mask, ["k", "feature_id"], "left_semi"), weights)


def group_l2(p: DataFrame, group: str, weights: DataFrame) -> DataFrame:
    """1/2 sum over groups and factors of w_{g,k} sum v^2.  weights: group, k, w."""
    return p.join(weights, [group, "k"]).agg((0.5 * F.sum(F.col("w") * F.col("v") ** 2)).alias("loss"))


def column_prior(params: DataFrame, by: str, priors: DataFrame) -> DataFrame:
    """1/2 sum w (v - centre)^2.  priors: by, centre, w."""
    return params.join(priors, by).agg((0.5 * F.sum(F.col("w") * (F.col("v") - F.col("centre")) ** 2)).alias("loss"))


def ard(y: DataFrame, alpha: float = 1.001, beta: float = 0.001) -> DataFrame:
    """(1/2 + alpha) sum ln(1 + v^2 / (2 beta))."""
    return y.agg(((0.5 + alpha) * F.sum(F.ln(1 + F.col("v") ** 2 / (2 * beta)))).alias("loss"))


def set_scales(assign: DataFrame, sets: DataFrame, y: DataFrame, alpha0: float = 1.001, v0: float = 0.8) -> DataFrame:
    """y with beta = (alpha0 - 1)(v0 + A'S); features in no set get v0 alone.

    assign: view, set_id, k, a; sets: view, set_id, feature_id, weight.
    """
    mix = assign.where("a <> 0").join(sets, ["view", "set_id"]).groupBy("k", "view", "feature_id").agg(F.sum(F.col("a") * F.col("weight")).alias("as"))
    return y.join(mix, ["k", "view", "feature_id"], "left").withColumn("beta", (alpha0 - 1) * (v0 + F.coalesce("as", F.lit(0.0)))).drop("as")


def feature_set_ard(y_beta: DataFrame, alpha: float = 1.001) -> DataFrame:
    """sum (1/2 + alpha) ln(1 + v^2 / (2 beta)) with a scale for each entry."""
    return y_beta.agg(F.sum((0.5 + alpha) * F.ln(1 + F.col("v") ** 2 / (2 * F.col("beta")))).alias("loss"))


def gamma_normal(y_beta: DataFrame, alpha: float = 1.001) -> DataFrame:
    """-sum alpha ln beta + sum (alpha + 1/2) ln(beta + v^2 / 2)."""
    return y_beta.agg((F.sum((alpha + 0.5) * F.ln(F.col("beta") + 0.5 * F.col("v") ** 2)) - F.sum(alpha * F.ln("beta"))).alias("loss"))


def gradients(y: DataFrame, kind: str, alpha: float = 1.001, beta: float = 0.001) -> DataFrame:
    """(k, feature_id, g) of l2 (w), l1 (w), ard or feature-set ard (beta column) penalties."""
    v = F.col("v")
    b = F.col("beta") if "beta" in y.columns else F.lit(beta)
    g = {"l2": lambda: F.col("w") * v, "l1": lambda: F.col("w") * F.signum(v), "ard": lambda: (1 + 2 * alpha) * v / (2 * b + v * v)}[kind]()
    return y.select("k", "feature_id", g.alias("g"))


def batch_prior(values: DataFrame, priors: DataFrame) -> DataFrame:
    """1/2 sum w_b (v - c_b)^2 over batch values.  priors: view, batch, centre, w."""
    return values.join(priors, ["view", "batch"]).agg((0.5 * F.sum(F.col("w") * (F.col("batch_value") - F.col("centre")) ** 2)).alias("loss"))


def eb_batch_prior(values: DataFrame, p: float = 1.0) -> DataFrame:
    """Centre = mean and weight = p / variance of each (view, batch); 1 + columns / 2 where that is not finite."""
    m = values.groupBy("view", "batch").agg(F.avg("batch_value").alias("centre"), F.var_samp("batch_value").alias("var"), F.count(F.lit(1)).alias("n"))
    return m.select("view", "batch", "centre", F.coalesce(F.try_divide(F.lit(p), F.col("var")), 1 + F.col("n") / 2).alias("w"))


def eb_l1(p: DataFrame, scale: float = 1.0) -> DataFrame:
    """(k, w): scale / variance of the factor."""
    return p.groupBy("k").agg(F.coalesce(F.try_divide(F.lit(scale), F.var_samp("v")), F.lit(1.0)).alias("w"))


def eb_selective_l1(y: DataFrame, mask: DataFrame, scale: float = 1.0) -> DataFrame:
    """(k, w): scale sqrt(2 / variance) over the masked matrix, zeros outside the mask included."""
    flagged = y.join(mask.select("k", "feature_id").distinct().withColumn("__m", F.lit(True)), ["k", "feature_id"], "left")
    v = F.when(F.col("__m"), F.col("v")).otherwise(0.0)
    return flagged.groupBy("k").agg(F.coalesce(scale * F.sqrt(F.try_divide(F.lit(2.0), F.var_samp(v))), F.lit(1.0)).alias("w"))


def eb_column_prior(params: DataFrame, by: str, p: float = 1.0) -> DataFrame:
    """centre = mean, w = p (0.1 + 0.5) / (0.1 + 0.5 variance) of each range."""
    m = params.groupBy(by).agg(F.avg("v").alias("centre"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"))
    return m.select(by, "centre", (p * 0.6 / (0.1 + 0.5 * F.col("var"))).alias("w"))


def gram(p: DataFrame, item: str, *by: str) -> DataFrame:
    """(by, k1, k2, v): inner products of factors over items."""
    a = p.select(*by, item, F.col("k").alias("k1"), F.col("v").alias("v1"))
    b = p.select(*by, item, F.col("k").alias("k2"), F.col("v").alias("v2"))
    return a.join(b, [*by, item]).groupBy(*by, "k1", "k2").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))


def gram_matrix(rows: list, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in rows:
        out[r["k1"], r["k2"]] = r["v"]
    return out


def eb_l2(p: DataFrame, item: str, k: int, scale: float = 1.0) -> float:
    """scale / (largest singular value)^2, from the K x K inner products."""
    top = np.linalg.eigvalsh(gram_matrix(gram(p, item).collect(), k))[-1]
    return scale / top if top > 0 else 1.0


def minimal_weights(variances: DataFrame, k: int, n_samples: int) -> DataFrame:
    """(distribution, w): K mean(sigma^2) / (sum var_j n_j / M).  variances: distribution, var, n, sigma2."""
    g = variances.groupBy("distribution").agg(F.avg("sigma2").alias("s"), (F.sum(F.col("var") * F.col("n")) / n_samples).alias("d"))
    return g.select("distribution", guarded(F.try_divide(k * F.col("s"), F.col("d")), 1.0).alias("w"))


def mixture(losses: list[DataFrame], weights: list[float]) -> DataFrame:
    """Weighted mean of one-row losses, weights normalised; no losses: 0."""
    total, out = sum(weights), None
    for df, w in zip(losses, weights, strict=True):
        part = df.select((F.col("loss") * (w / total)).alias("loss"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.sum("loss").alias("loss"))
