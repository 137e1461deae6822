"""Splits, folds, missingness masks and seeded sampling.

Randomness comes from hashes of ids and a seed, never from partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ranged import positions


def uniform(*cols: str, seed: int = 0) -> Column:
    """A value in (0, 1) that depends only on the columns and the seed."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def assign_groups(counts: dict[str, dict[str, int]], shares: list[float], seed: int = 0, tries: int = 10) -> dict[str, int]:
    """Group -> split: random order, split with probability by what its capacity for the group's classes has left.

    Stops early at an assignment in which every split got some of every class.
    """
    classes = sorted({c for g in counts.values() for c in g})
    n = np.array([[g.get(c, 0) for c in classes] for g in counts.values()], float)
    names, rng, out = list(counts), np.random.default_rng(seed), {}
    for _ in range(tries):
        capacity = np.outer(shares, n.sum(axis=0))
        got, out = np.zeros_like(capacity), {}
        for i in rng.permutation(len(names)):
            p = np.maximum(capacity @ n[i], 0)
            p = p / p.sum() if p.sum() > 0 else np.full(len(shares), 1 / len(shares))
            s = int(rng.choice(len(shares), p=p))
            capacity[s] = np.maximum(capacity[s] - n[i], 0)
            got[s] += n[i]
            out[names[i]] = s
        if (got > 0).all():
            break
    return out


def stratified_group_split(samples: DataFrame, group: str, label: str, shares: list[float], seed: int = 0) -> DataFrame:
    """samples with ``split``: groups stay whole.  Only (group, class) counts come to the driver."""
    counts: dict[str, dict[str, int]] = {}
    for r in samples.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).orderBy(group, label).collect():
        counts.setdefault(r[0], {})[r[1]] = r["n"]
    place = samples.sparkSession.createDataFrame(list(assign_groups(counts, shares, seed).items()), f"{group} {samples.schema[group].dataType.simpleString()}, split int")
    return samples.join(place, group)


def cv_folds(samples: DataFrame, n: int, label: str | None = None, seed: int = 0) -> DataFrame:
    """samples with ``fold``: equal parts, of each class if ``label`` is given; no task holds a class."""
    hashed = samples.withColumn("__hash", F.xxhash64("sample_id", F.lit(seed)))
    placed = positions(hashed, [label] if label else [], F.col("__hash"), F.col("sample_id"), name="__pos")
    return placed.withColumn("fold", F.pmod(F.col("__pos") - 1, F.lit(n)).cast("int")).drop("__hash", "__pos")


def batch_missingness(batch_map: DataFrame, fraction: float, order: Column) -> DataFrame:
    """(view, sample_id) to hide: whole batches in ``order`` until round(fraction M) samples, the last batch in part.

    ``order`` gives each (view, batch) its place; samples of a batch go by id.
    """
    size = batch_map.groupBy("view", "batch").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("view").orderBy("__order", "batch").rowsBetween(Window.unboundedPreceding, -1)
    total = F.bround(fraction * F.sum("size").over(Window.partitionBy("view")), 0)
    quota = size.withColumn("__order", order).withColumn("left", total - F.coalesce(F.sum("size").over(w), F.lit(0)))
    quota = quota.withColumn("quota", F.greatest(F.least(F.col("left"), F.col("size")), F.lit(0))).select("view", "batch", "quota")
    nth = F.row_number().over(Window.partitionBy("view", "batch").orderBy("sample_id"))
    return batch_map.withColumn("__nth", nth).join(quota, ["view", "batch"]).where("__nth <= quota").select("view", "sample_id")


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 0, weight: str | None = None) -> DataFrame:
    """``n`` rows without replacement, evenly or by weight (largest ln(u) / weight)."""
    u = uniform(*keys, seed=seed)
    return df.orderBy((F.ln(u) / F.col(weight)).desc() if weight else u, *keys).limit(n)


def feature_subset(features: DataFrame, genes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` features: those of ``genes`` first, whole genes in random order within each kind."""
    flagged = features.join(genes.select("gene").distinct().withColumn("__in", F.lit(0)), "gene", "left")
    return flagged.orderBy(F.coalesce("__in", F.lit(1)), F.xxhash64("gene", F.lit(seed)), "gene", "feature_id").limit(n).drop("__in")
