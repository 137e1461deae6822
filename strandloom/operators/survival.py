"""Survival forests, grown level by level.

A level is one pass: each task walks its samples down the trees so far, and
counts those that leave each open node (dead or lost from sight) by feature,
bin of the feature and time; counts are added up by (tree, node, feature), where
all cuts are compared by the log-rank statistic.  The driver gets the best cut
of each node.  Trees are small (at most 2^depth nodes) and are broadcast; no
state of the samples is kept, and samples are not shuffled.  A leaf holds the
cumulative hazard (Nelson-Aalen) at the times; a prediction is the mean over
trees of the hazard summed over all times, the expected number of deaths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of counts that a task holds before it gives them out.
HELD = 1 << 26
_COUNTS = "tree int, node int, feature int, counts binary"


def log_rank(left: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The log-rank statistic of left against the rest, for each row of ``left``.

    ``left`` (cuts x 2 x times) and ``all_`` (2 x times): deaths, and all who leave, at each time.
    """
    at_risk = lambda leave: np.flip(np.cumsum(np.flip(leave, -1), -1), -1)
    d, y, dl, yl = all_[0], at_risk(all_[1]), left[:, 0], at_risk(left[:, 1])
    share = np.divide(yl, y, out=np.zeros_like(yl), where=y > 0)
    spread = np.divide(y - d, y - 1, out=np.zeros_like(y), where=y > 1) * d
    top, under = (dl - share * d).sum(axis=1), (share * (1 - share) * spread).sum(axis=1)
    return np.divide(top * top, under, out=np.zeros_like(top), where=under > 1e-12)


def hazard(counts: np.ndarray) -> np.ndarray:
    """Cumulative hazard at each time, from deaths and all who leave (2 x times)."""
    y = np.cumsum(counts[1][::-1])[::-1]
    return np.cumsum(np.divide(counts[0], y, out=np.zeros_like(y), where=y > 0))


@dataclass
class SurvivalForest:
    """edges: the upper edges of each feature's bins but the last; times: the times at which hazards step.

    ``splits``: for each tree (feature, last bin of the left side) by node, the
    root being 1 and the children of n being 2 n and 2 n + 1.
    """

    edges: list[np.ndarray]
    times: np.ndarray
    splits: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    statistics: list[dict[int, float]] = field(default_factory=list)
    leaves: list[dict[int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value; missing values go to the first."""
        return np.stack([np.where(np.isfinite(x[:, j]), np.searchsorted(e, x[:, j], "left"), 0) for j, e in enumerate(self.edges)], axis=1)

    def nodes(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row ends in."""
        out = np.ones(len(bins), np.int64)
        splits = self.splits[tree]
        top = max(splits, default=0) + 1
        feature, cut = np.full(top, -1), np.zeros(top, np.int64)
        for n, (j, b) in splits.items():
            feature[n], cut[n] = j, b
        while True:
            at = np.flatnonzero((out < top) & (feature[np.minimum(out, top - 1)] >= 0))
            if not len(at):
                return out
            j = feature[out[at]]
            out[at] = 2 * out[at] + (bins[at, j] > cut[out[at]])

    def risk(self, bins: np.ndarray) -> np.ndarray:
        """Expected deaths of each row: hazards summed over all times, mean over trees."""
        total = np.zeros(len(bins))
        for t, leaves in enumerate(self.leaves):
            sums = {n: float(h.sum()) for n, h in leaves.items()}
            total += np.array([sums.get(n, 0.0) for n in self.nodes(bins, t).tolist()])
        return total / max(1, len(self.leaves))

    def predict(self, rows: DataFrame) -> DataFrame:
        """(sample_id, risk) of rows (sample_id, x)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(self.risk(self.bins(_matrix(b, len(self.edges)))))], ["sample_id", "risk"])

        return rows.select(F.col("sample_id").cast("string").alias("sample_id"), "x").mapInArrow(run, "sample_id string, risk double")


def _matrix(b: pa.RecordBatch, p: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def draws(ids: list[str], tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often each sample is drawn for a tree: Poisson with mean 1, from the sample's id."""
    if not bootstrap:
        return np.ones(len(ids))
    u = np.array([xxhash.xxh64_intdigest(f"{seed}:{tree}:{i}") for i in ids], np.float64) / 2.0**64
    cumulative = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
    return np.searchsorted(cumulative, u, "right").astype(float)


def chosen(tree: int, node: int, p: int, tries: int, seed: int) -> np.ndarray:
    """The features that a node looks at."""
    return np.sort(np.random.default_rng([seed, tree, node]).choice(p, min(tries, p), replace=False))


def quantile_edges(rows: DataFrame, p: int, bins: int = 16) -> list[np.ndarray]:
    """Edges at (about) the quantiles of each feature, equal ones once."""
    long = rows.select(F.posexplode("x").alias("j", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    shares = [i / bins for i in range(1, bins)]
    got = {r["j"]: r["q"] for r in long.groupBy("j").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}  # a row for each feature
    return [np.unique(np.array(got.get(j) or [0.0], float)) for j in range(p)]


def quantile_times(rows: DataFrame, most: int = 64) -> np.ndarray:
    """At most so many times, at (about) the quantiles of the times of death."""
    got = rows.where("event = 1 AND time IS NOT NULL").agg(F.percentile_approx(F.col("time").cast("double"), [i / most for i in range(1, most + 1)], 10_000)).first()[0]
    return np.unique(np.array(got or [0.0], float))


def fit_survival_forest(rows: DataFrame, edges: list[np.ndarray] | None = None, times: np.ndarray | None = None, trees: int = 100, depth: int = 5, tries: int | None = None, least: int = 15, bootstrap: bool = True, seed: int = 0) -> SurvivalForest:
    """A forest on rows: sample_id, time, event (1 dead, 0 lost from sight), x (an array of numbers, all of one length).

    ``edges`` and ``times`` default to quantiles.  A death counts at the first
    of ``times`` that is not before it (those later at the last), a loss there
    too.  A node looks at ``tries`` features (default: root of their number) and
    is cut where both sides keep ``least`` draws, if that separates them at all;
    ties go to the first feature and cut.  Rows without time or event are left
    out; missing values count as the smallest.  An empty table gives trees whose
    risk is 0.
    """
    data = rows.where("time IS NOT NULL AND event IS NOT NULL").select(F.col("sample_id").cast("string").alias("sample_id"), F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), "x")
    p = data.agg(F.max(F.size("x"))).first()[0] or 0
    forest = SurvivalForest(edges if edges is not None else quantile_edges(data, p), times if times is not None else quantile_times(data), [{} for _ in range(trees)], [{} for _ in range(trees)], [{} for _ in range(trees)])
    tries, n_times = tries or max(1, int(np.ceil(np.sqrt(p)))), len(forest.times)
    bins = [len(e) + 1 for e in forest.edges]

    def given(total: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.int32()) for i in range(3)), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["tree", "node", "feature", "counts"])

    def counted(last: bool):
        """Counts of the open nodes by feature, or, of all end nodes, alone (feature -1)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int, int], np.ndarray] = {}
            for b in batches:
                if sum(v.nbytes for v in total.values()) > HELD:
                    yield given(total)
                    total = {}
                at, ids = forest.bins(_matrix(b, p)), b.column("sample_id").to_pylist()
                time = np.minimum(np.searchsorted(forest.times, b.column("time").to_numpy(), "left"), n_times - 1)
                dead = b.column("event").to_numpy() == 1
                for t in range(trees):
                    weight, node = draws(ids, t, seed, bootstrap), forest.nodes(at, t)
                    for n in np.unique(node).tolist():
                        if not last and n < 1 << level:
                            continue  # closed earlier
                        own = np.flatnonzero((node == n) & (weight > 0))
                        for j in [-1] if last else chosen(t, n, p, tries, seed).tolist():
                            size = 1 if last else bins[j]
                            place = (0 if last else at[own, j]) * n_times + time[own]
                            leave, die = (np.bincount(place, w, size * n_times) for w in (weight[own], weight[own] * dead[own]))
                            key = (t, n, j)
                            total[key] = total.get(key, 0) + np.stack([die, leave]).reshape(2, size, n_times)
            yield given(total)

        return data.mapInArrow(run, _COUNTS)

    def best_cut(pdf: pd.DataFrame) -> pd.DataFrame:
        j = int(pdf["feature"].iloc[0])
        counts = sum(np.frombuffer(c).reshape(2, bins[j], n_times) for c in pdf["counts"])
        left, all_ = np.cumsum(counts, axis=1).transpose(1, 0, 2)[:-1], counts.sum(axis=1)
        draws_left = left[:, 1].sum(axis=1)
        allowed = (draws_left >= least) & (all_[1].sum() - draws_left >= least)
        value = np.where(allowed, log_rank(left, all_), 0.0) if len(left) else np.zeros(1)
        cut = int(value.argmax())
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "node": [int(pdf["node"].iloc[0])], "feature": [j], "cut": [cut], "value": [float(value[cut])]})

    for level in range(depth if p else 0):
        cuts = counted(False).groupBy("tree", "node", "feature").applyInPandas(best_cut, "tree int, node int, feature int, cut int, value double").where("value > 0")
        best = cuts.groupBy("tree", "node").agg(F.max(F.struct("value", -F.col("feature"), -F.col("cut"))).alias("b")).collect()  # a row for each open node
        if not best:
            break
        for r in best:
            value, j, cut = r["b"]
            forest.splits[r["tree"]][r["node"]], forest.statistics[r["tree"]][r["node"]] = (-j, -cut), value
    if p:
        add = lambda pdf: pd.DataFrame({"tree": pdf["tree"].iloc[:1], "node": pdf["node"].iloc[:1], "feature": [-1], "counts": [sum(np.frombuffer(c) for c in pdf["counts"]).tobytes()]})
        for r in counted(True).groupBy("tree", "node").applyInPandas(add, _COUNTS).collect():  # a row for each leaf
            forest.leaves[r["tree"]][r["node"]] = hazard(np.frombuffer(r["counts"]).reshape(2, n_times))
    return forest
