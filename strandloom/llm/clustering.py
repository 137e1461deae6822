"""k-means on integer vectors by sort-means, in exact arithmetic.

A round orders, for each centroid, the others by their distance from it.  A
vector starts at the centroid of its last assignment, at distance d, and looks
at the others in that order; one strictly farther than 2 d from the first can't
be as near as it, nor can any later one.  Ties at 2 d are still looked at, since
the smaller number wins.

Vectors and their assignments stay in tables, written once a round; sums and
counts by cluster are plain aggregates.  The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, save
from strandloom.llm.whitening import matrix

BLOCK = 8192
_STATE = "vec_id long, vector array<long>, cluster int, distance long"


def exact_type(most: int, dim: int) -> type:
    """The fastest number type in which squared distances of components up to ``most`` are exact."""
    bound = 4 * dim * (2 * most) ** 2  # four times a squared distance is compared too
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def assign(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and how many distances were computed.

    ``before``: the assignment that the scan of each row starts from; any gives the same result.
    """
    squared = lambda a, b: ((a - b) ** 2).sum(axis=1)
    cluster, distance, looked = before.copy(), squared(x, centroids[before]), len(x)
    for a in range(len(centroids)):
        own = np.flatnonzero(before == a)
        own = own[np.argsort(-distance[own], kind="stable")]  # farthest first: rows that still look are in front
        nearness = -4 * distance[own]
        between = squared(centroids, centroids[a])
        for c in np.argsort(between, kind="stable"):
            rows = own[: np.searchsorted(nearness, -between[c], side="right")]
            if not len(rows):
                break
            if c == a:
                continue
            d = squared(x[rows], centroids[c])
            looked += len(rows)
            better = (d < distance[rows]) | ((d == distance[rows]) & (c < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = c, d[better]
    return cluster, distance, looked


def sort_means(vectors: DataFrame, first: np.ndarray, rounds: int = 10) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, cluster, distance) of every row, and the centroids that these distances are to.

    ``vectors``: vec_id and vector (array<long> of the length of the centroids
    ``first``).  Each round assigns all rows and moves every centroid that has
    rows to the floor of their mean, component by component; at the end rows are
    assigned once more.  Rounds stop early only where no centroid moved, which
    changes nothing.  Rows with null or repeated ids count each.
    """
    size = vectors.agg(F.max(F.array_max("vector")).alias("high"), F.min(F.array_min("vector")).alias("low")).first()
    dim = first.shape[1]
    most = max(abs(v) for v in (size["high"] or 0, size["low"] or 0, *first.ravel().tolist()))
    number = exact_type(most, dim)

    def assigning(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                    x = matrix(b.column("vector"), dim).astype(number)
                    cluster, distance, _ = assign(x, centroids.astype(number), b.column("cluster").to_numpy(zero_copy_only=False).astype(np.intp))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(cluster, pa.int32()), pa.array(list(map(int, distance)), pa.int64())], ["vec_id", "vector", "cluster", "distance"])

        return run

    centroids, moved = first.astype(object), True
    state = vectors.select("vec_id", "vector", F.lit(0).alias("cluster"))
    for turn in range(rounds + 1):
        if not moved:
            break
        old, state = state, save(state.mapInArrow(assigning(centroids), _STATE), "means-state")
        discard(old)
        if turn == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("vector")[i]).alias(f"s{i}") for i in range(dim))).collect()  # a row for each centroid
        new = centroids.copy()
        for r in sums:
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
        moved, centroids = bool((new != centroids).any()), new
    return state, centroids


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, vector, cluster, distance, cluster_inertia, inertia, centroid_sha256; a row for each vector of ``dim`` components.

    Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed:vec_id`` (rows of one id: smaller vector first; null ids last; all
    rows, if fewer).  ``vectors``: vec_id and vector (array<long>); rows of
    another length or null are left out, other columns are not read.  Inertia is
    the sum of ``distance`` (squared) over the cluster, or all rows.  An empty
    table gives no rows.  Distances and sums have to fit a long.
    """
    kept = vectors.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).select("vec_id", "vector")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        empty = "vec_id long, vector array<long>, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return kept.sparkSession.createDataFrame([], empty)
    state, centroids = sort_means(kept, np.array([r["vector"] for r in first], object), rounds)
    own = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.array(*map(F.lit, values))[F.col("cluster")]
    return state.select(
        "vec_id", "vector", "cluster", "distance", of([own.get(c, 0) for c in range(len(shas))]).cast("long").alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), of(shas).alias("centroid_sha256")
    )
