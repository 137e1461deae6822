"""Simulated parameters and data; every value depends only on its ids and the seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalars import discretise
from strandloom.operators.joins import batch_apply, matrix_product
from strandloom.operators.splits import batch_missingness, uniform


def gaussian(*cols: str, seed: int = 0) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    return F.sqrt(-2 * F.ln(uniform(*cols, seed=seed))) * F.cos(2 * math.pi * uniform(*cols, seed=seed + 7919))


def gamma_from(shape: float, normals: list[Column], uniforms: list[Column]) -> Column:
    """A gamma variate with scale 1: the first pair of draws that is accepted, by squeezed cubes of normals.

    Of shapes from 1 on a pair is accepted with probability 0.95 or more; the
    mode of the cube stands in where none is.  A shape below 1 takes the next
    larger one's variate and the last uniform, which no pair then uses.
    """
    if shape < 1:
        return gamma_from(shape + 1, normals[:-1], uniforms[:-1]) * F.pow(uniforms[-1], F.lit(1 / shape))
    d = shape - 1 / 3
    pairs = []
    for x, u in zip(normals, uniforms, strict=True):
        v = F.pow(1 + x / math.sqrt(9 * d), 3)
        pairs.append(F.when((v > 0) & (F.ln(u) < 0.5 * x * x + d - d * v + d * F.ln(v)), d * v))
    return F.coalesce(*pairs, F.lit(d))


def gamma(shape: float, *cols: str, seed: int = 0, tries: int = 16) -> Column:
    """Gamma variate with scale 1 from hashed draws, a fixed number of columns; the same under any split of the rows."""
    draw = lambda f, i: f(*cols, seed=seed + 104729 * (i + 1))
    return gamma_from(shape, [draw(gaussian, 2 * i) for i in range(tries)], [draw(uniform, 2 * i + 1) for i in range(tries)])


def relevance_values(items: DataFrame, item: str, k: int, alpha: float = 1.01, beta: float = 0.01, seed: int = 0) -> DataFrame:
    """(k, item, v): normal factors, each of a precision of its own drawn from a gamma distribution (shape alpha, rate beta)."""
    grid = items.select(item, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return grid.withColumn("v", gaussian(item, "k", seed=seed) / F.sqrt(gamma(alpha, item, "k", seed=seed + 1) / beta))


def factor_values(items: DataFrame, item: str, k: int, seed: int = 0) -> DataFrame:
    """(k, item, v): standard normal factors."""
    grid = items.select(item, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return grid.withColumn("v", gaussian(item, "k", seed=seed))


def set_factor_values(features: DataFrame, sets: DataFrame, k: int, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """(k, view, feature_id, v, set_id): +-1 on the members of one random set per view and factor, small noise elsewhere."""
    names = sets.select("view", "set_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draw = uniform("view", "set_id", "k", seed=seed)
    chosen = names.groupBy("view", "k").agg(F.min_by("set_id", draw).alias("set_id"))
    members = chosen.join(sets.select("view", "set_id", "feature_id"), ["view", "set_id"]).withColumn("member", F.lit(True))
    grid = features.select("view", "feature_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    sign = F.when(uniform("feature_id", "k", seed=seed + 1) < 0.5, -1.0).otherwise(1.0)
    joined = grid.join(members, ["view", "k", "feature_id"], "left")
    return joined.select("k", "view", "feature_id", F.when(F.col("member"), sign).otherwise(noise * gaussian("feature_id", "k", seed=seed + 2)).alias("v"), "set_id")


def corrupt_sets(sets: DataFrame, features: DataFrame, remove: float, add: float, seed: int = 0) -> DataFrame:
    """Each set loses round(remove n) members and gains round(add n) others of its view; weights 1/sqrt(size)."""
    from pyspark.sql import Window

    size = F.count(F.lit(1)).over(Window.partitionBy("view", "set_id"))
    by = Window.partitionBy("view", "set_id").orderBy(F.xxhash64("feature_id", "set_id", F.lit(seed)), "feature_id")
    own = sets.select("view", "set_id", "feature_id").distinct()
    sized = own.withColumn("n", size)
    kept = sized.withColumn("r", F.row_number().over(by)).where(F.col("r") > F.bround(remove * F.col("n"), 0)).select("view", "set_id", "feature_id")
    others = sized.select("view", "set_id", "n").distinct().join(features.select("view", "feature_id"), "view").join(own, ["view", "set_id", "feature_id"], "left_anti")
    new = others.withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.bround(add * F.col("n"), 0)).select("view", "set_id", "feature_id")
    return kept.unionByName(new).withColumn("weight", 1 / F.sqrt(size))


def batch_values(batch_map: DataFrame, features: DataFrame, mean: float = 0.0, between: float = 0.3, within: float = 0.1, seed: int = 0) -> DataFrame:
    """(view, batch, feature_id, batch_value): a batch centre plus noise per feature."""
    grid = batch_map.select("view", "batch").distinct().join(features.select("view", "feature_id"), "view")
    return grid.withColumn("batch_value", mean + between * gaussian("view", "batch", seed=seed) + within * gaussian("view", "batch", "feature_id", seed=seed + 1))


def column_values(features: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """features with mu and logsigma; logsigma less ln sqrt(K), so X'Y has unit scale."""
    return features.withColumn("mu", 0.5 * gaussian("feature_id", seed=seed)).withColumn("logsigma", 0.2 * gaussian("feature_id", seed=seed + 1) - math.log(math.sqrt(k)))


def simulate_data(x: DataFrame, y: DataFrame, features: DataFrame, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """obs of the forward model, made discrete for discrete noise.  x: k, sample_id, v; y: k, feature_id, v."""
    z = matrix_product(x.select(F.col("sample_id").alias("i"), "k", "v"), y.select("k", F.col("feature_id").alias("j"), "v"))
    at = z.select(F.col("i").alias("sample_id"), F.col("j").alias("feature_id"), F.col("v").alias("z")).join(features, "feature_id")
    latent = F.col("z") * F.exp("logsigma") + F.col("mu") + noise * gaussian("sample_id", "feature_id", seed=seed)
    return at.select("sample_id", "feature_id", "view", discretise(F.col("distribution"), latent).alias("value"))


def study(samples: DataFrame, features: DataFrame, k: int, batch_map: DataFrame | None = None, sets: DataFrame | None = None, noise: float = 0.1, missing: float = 0.0, seed: int = 0) -> dict[str, DataFrame]:
    """A simulated study on a template's samples and features: parameters, data, and what is hidden of it.

    Tables X, Y, features (with mu and logsigma), obs, and theta where there are
    batches.  ``missing``: the share of each view's samples that whole batches
    hide (see ``batch_missingness``).
    """
    y = set_factor_values(features.select("view", "feature_id"), sets, k, seed=seed + 2) if sets is not None else factor_values(features.select("feature_id"), "feature_id", k, seed + 2)
    out = {"X": factor_values(samples.select("sample_id"), "sample_id", k, seed + 1), "Y": y, "features": column_values(features, k, seed + 3)}
    obs = simulate_data(out["X"], y.select("k", "feature_id", "v"), out["features"], noise, seed + 4)
    if batch_map is not None:
        out["theta"] = batch_values(batch_map, features, seed=seed + 5)
        obs = batch_apply(obs, batch_map, out["theta"], "add").select("sample_id", "feature_id", "view", F.col("result").alias("value"))
        if missing:
            hidden = batch_missingness(batch_map, missing, F.xxhash64("view", "batch", F.lit(seed + 6)))
            obs = obs.join(hidden, ["view", "sample_id"], "left_anti").select("sample_id", "feature_id", "view", "value")
    return out | {"obs": obs}
