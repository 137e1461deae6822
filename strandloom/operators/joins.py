"""Key matching, alignment and join-aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keymatch(left: DataFrame, right: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """(left_pos, right_pos): left duplicates stay, of right duplicates the last counts."""
    last = right.groupBy(key).agg(F.max(pos).alias("right_pos"))
    return left.join(last, key).select(F.col(pos).alias("left_pos"), "right_pos")


def align_left(features: DataFrame, obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (sample, model feature); NULL where ``obs`` has no value, other features of ``obs`` dropped."""
    grid = samples.select("sample_id").crossJoin(features.select("feature_id"))
    return grid.join(obs.select("sample_id", "feature_id", "value"), ["sample_id", "feature_id"], "left")


def feature_sets_by_view(members: DataFrame, features: DataFrame) -> DataFrame:
    """(view, set_id, feature_id): all features of the genes of a set; sets without any in a view have no rows.

    ``members``: set_id, gene; ``features``: feature_id, view, gene.
    """
    return members.select("set_id", "gene").distinct().join(features, "gene").select("view", "set_id", "feature_id").distinct()


def set_weights(sets: DataFrame) -> DataFrame:
    """Membership matrix with entries 1 / sqrt(size of the set)."""
    size = F.count(F.lit(1)).over(Window.partitionBy("view", "set_id"))
    return sets.withColumn("weight", 1 / F.sqrt(size))


def outside_graphs(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(pathway_id, node): the nodes that no edge of the graph touches."""
    ends = edges.select("pathway_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graphs.select("pathway_id").crossJoin(nodes.select("node")).join(ends, ["pathway_id", "node"], "left_anti")


def batch_apply(obs: DataFrame, batch_map: DataFrame, batch_values: DataFrame, how: str, value: str = "value") -> DataFrame:
    """obs with ``result`` = value (+, -, *, /) the batch value of (view, batch of sample, feature).

    Unbatched views and features without a value are untouched.  The maps are
    joined on their keys; Spark broadcasts them while they are small.
    """
    joined = obs.join(batch_map, ["view", "sample_id"], "left").join(batch_values, ["view", "batch", "feature_id"], "left")
    v, b = F.col(value), F.col("batch_value")
    one = F.coalesce(b, F.lit(1.0))
    op = {"add": v + F.coalesce(b, F.lit(0.0)), "subtract": v - F.coalesce(b, F.lit(0.0)), "multiply": v * one, "divide": F.try_divide(v, one)}[how]
    return joined.withColumn("result", op).drop("batch_value")


def fill_group_weights(groups: DataFrame, weights: DataFrame) -> DataFrame:
    """Old weight of a known group, the mean of the old weights for a new one."""
    mean = weights.agg(F.avg("weight").alias("mean"))
    return groups.join(weights, "group", "left").crossJoin(F.broadcast(mean)).select("group", F.coalesce("weight", "mean").alias("weight"))


def multimap(features: DataFrame, key: str, value: str) -> DataFrame:
    """key -> sorted array of values."""
    return features.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


#: Slots that the rows of a product's first matrix are dealt to, and tasks that join them.
SLOTS, JOINERS = 256, 64


def product_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, va, vb): the terms of the product of a(i, k, v) and b(k, j, v).

    Rows i are dealt to slots and b goes to every slot: a join on k alone has a
    task for each k, which makes all pairs (i, j).  Both sides are dealt to a given
    number of tasks: Spark would size them by what they read, not by the pairs they
    make, and it may broadcast either side.
    """
    slot = F.pmod(F.xxhash64("i"), F.lit(SLOTS)).cast("int")
    left = a.select("i", "k", F.col("v").alias("va"), slot.alias("slot"))
    right = b.select("k", "j", F.col("v").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    dealt = [side.repartition(JOINERS, "slot", "k") for side in (left, right)]
    return dealt[0].join(dealt[1], ["slot", "k"]).select("i", "j", "va", "vb")


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a(i, k, v) times b(k, j, v)."""
    return product_pairs(a, b).groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one matching of rows to columns with the largest total score.

    Shortest augmenting paths with potentials; for the small square score
    matrices of factors (K x K), on the driver.
    """
    cost = -np.asarray(score, float)
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assignment(np.asarray(score).T))
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < low[free]
            low[free[better]], way[free[better]] = slack[better], j0
            j1 = free[low[free].argmin()]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def parameter_grid(dims: list[DataFrame]) -> DataFrame:
    """Cross join of the dimensions; a dimension with several columns is one zipped list."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out
