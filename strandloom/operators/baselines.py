"""Baselines: principal components with missing data, raw features, forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import sums as U
from strandloom.operators.aggregates import column_params, median_impute, medians, standardise
from strandloom.operators.factor import packed_rows
from strandloom.operators.joins import align_left
from strandloom.operators.optimise import masked_least_squares
from strandloom.operators.select import composite_filter
from strandloom.sources.scratch import discard, save

#: Slots that samples are dealt to, and members of sets that a task lays out at once.
SLOTS, EXPANDED = 128, 1 << 20


def wide_rows(obs: DataFrame, ids: list[str]) -> DataFrame:
    """sample_id, and the values it has as sorted lists: idx (place in ``ids``) and vals."""
    return packed_rows(obs, ids).drop("condition")


def pca(rows: DataFrame, n: int, k: int, rounds: int = 50, tolerance: float = 1e-6, extra: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(Y: k x n, share of variance explained): components of standardised rows (idx, vals) with missing values.

    Subspace iteration inside expectation-maximisation: a round fills each row's
    gaps from its own least squares scores and adds up  Z'(Z B)  for a basis B of
    k + ``extra`` directions, n x (k + extra) numbers instead of n x n moments.
    Rows with k or fewer values take no part.
    """
    rows = save(rows, "pca-rows")  # each round reads them again
    q = min(n, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, q)))[0]
    y, share, last = np.zeros((0, n)), np.zeros(k), np.inf
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], y: np.ndarray = y, basis: np.ndarray = basis) -> Iterator[pa.RecordBatch]:
            table, size = np.zeros((n, q)), np.zeros(2)
            for b in (piece for whole in batches for piece in U.slices(whole, n)):
                z = U.dense(b, n)
                z = z[np.isfinite(z).sum(axis=1) > k]
                gaps = ~np.isfinite(z)
                z = np.where(gaps, masked_least_squares(z, y, 1e-6) @ y if len(y) and gaps.any() else 0.0, z)
                table += z.T @ (z @ basis)
                size += (float((z * z).sum()), len(z))
            yield U.partial(U.split_rows("moment", table) | {"size": size})

        got = U.add_up(rows.mapInArrow(run, U.SCHEMA))
        total, count = got.get("size", np.zeros(2))
        moment = U.join_rows("moment", got, (n, q)) / max(1.0, count)
        small = basis.T @ moment
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        y = (basis @ vectors[:, ::-1][:, :k]).T
        y = y * np.where(y[np.arange(len(y)), np.abs(y).argmax(axis=1)] < 0, -1, 1)[:, None]
        share = values[::-1][:k] / max(total / max(1.0, count), 1e-12)
        if abs(last - share.sum()) < tolerance:
            break
        last = share.sum()
        basis = np.linalg.qr(moment)[0]
    discard(rows)
    return y, share


def pca_columns(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(Y: k x n, share of variance explained): components of a few standardised columns of a wide table.

    Each row with all values is a sample; rows need no number.  The moments, one
    for each pair of columns, are partial aggregates of one pass, so a task
    gives one row.  Without rows there are no components; with a column that
    doesn't vary the shares are NaN.
    """
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    full = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna()
    got = full.agg(*(F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs)).first()
    if got is None or got[0] is None:
        return np.zeros((0, n)), np.zeros(0)
    moment = np.zeros((n, n))
    for (i, j), v in zip(pairs, got, strict=True):
        moment[i, j] = moment[j, i] = v
    deviation = np.sqrt(np.diag(moment))
    if not np.isfinite(moment).all() or not deviation.all():
        return np.zeros((k, n)), np.full(k, np.nan)
    values, vectors = np.linalg.eigh(moment / np.outer(deviation, deviation))
    y = vectors[:, ::-1][:, :k].T
    return y * np.where(y[np.arange(len(y)), np.abs(y).argmax(axis=1)] < 0, -1, 1)[:, None], values[::-1][:k] / n


def pca_baseline(obs: DataFrame, k: int, least: int = 1, fraction: float = 1.0) -> dict:
    """Filter, standardise, components per view, concatenated block by block, with all that a transform needs."""
    kept = obs.join(composite_filter(obs, least, fraction).select("feature_id"), "feature_id", "left_semi")
    params = column_params(kept)
    z = standardise(kept, params)
    out = {"ids": [], "views": [], "params": params, "blocks": []}
    for view in [r[0] for r in kept.select("view").distinct().orderBy("view").collect()]:
        own = z.where(F.col("view") == view)
        ids = [r[0] for r in own.select("feature_id").distinct().orderBy("feature_id").collect()]
        y, share = pca(wide_rows(own, ids), len(ids), min(k, len(ids)))
        out["ids"] += ids
        out["views"] += [view] * len(ids)
        out["blocks"].append((y, share))
    out["y"] = block_diagonal([y for y, _ in out["blocks"]])
    return out


def block_diagonal(blocks: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((sum(b.shape[0] for b in blocks), sum(b.shape[1] for b in blocks)))
    i = j = 0
    for b in blocks:
        out[i : i + b.shape[0], j : j + b.shape[1]] = b
        i, j = i + b.shape[0], j + b.shape[1]
    return out


def linear_transform(rows: DataFrame, y: np.ndarray, ridge: float = 0.0) -> DataFrame:
    """(sample_id, x): least squares scores of rows (idx, vals) with missing values on the components y."""
    k, n = y.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in U.slices(whole, n)):
            x = masked_least_squares(U.dense(b, n), y, ridge)
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.ravel()))], ["sample_id", "x"])

    return rows.mapInArrow(run, "sample_id string, x array<double>")


def raw_baseline(obs: DataFrame, samples: DataFrame, least: int, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(imputed grid, medians) of the filtered features; the medians serve new data too."""
    kept = composite_filter(obs, least, fraction).select("feature_id")
    own = obs.join(kept, "feature_id", "left_semi")
    med = medians(own)
    return median_impute(align_left(kept, own, samples), med), med


def random_forest(spark: SparkSession, train: DataFrame, label: str, features: str = "features", regression: bool = False, trees: int = 500, seed: int = 0):
    """Fitted forest on a vector column; labels are codes from ``label_codes`` for classification."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    cls = RandomForestRegressor if regression else RandomForestClassifier
    return cls(featuresCol=features, labelCol=label, numTrees=trees, seed=seed).fit(train)


def sample_rank_scores(obs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample_id, set_id, score): mean centred rank, in its sample, of a set's features (single-sample enrichment)."""
    seen = obs.where("value is not null")
    own, n = Window.partitionBy("sample_id").orderBy("value"), F.count(F.lit(1)).over(Window.partitionBy("sample_id"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("sample_id", "value"))
    ranked = seen.withColumn("r", (F.rank().over(own) + (ties - 1) / 2 - (n + 1) / 2) / n)
    return ranked.join(sets.select("set_id", "feature_id").distinct(), "feature_id").groupBy("sample_id", "set_id").agg(F.avg("r").alias("score"))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, to 1e-7, by a polynomial in 1 / (1 + 0.3275911 |x| / sqrt 2)."""
    a = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    # fixed values: coefficients of the approximation of erf
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-a * a)
    return np.where(x < 0, tail / 2, 1 - tail / 2)


def smoothed_distribution(obs: DataFrame, per_bandwidth: int = 4) -> DataFrame:
    """(sample_id, feature_id, z): each value's place in its feature's distribution, smoothed by a normal kernel.

    The bandwidth is a quarter of the feature's standard deviation.  Values are
    counted in bins of 1 / ``per_bandwidth`` of it; the counts, a row for each
    occupied bin, are convolved with the kernel feature by feature, and a value
    is read off between the edges of its bin.  Missing values are left out, and
    features without spread.
    """
    seen = obs.where("value is not null").select("sample_id", "feature_id", F.col("value").cast("double").alias("value"))
    scale = seen.groupBy("feature_id").agg(F.min("value").alias("low"), (F.stddev_samp("value") / 4 / per_bandwidth).alias("width")).where("width > 0")
    placed = seen.join(scale, "feature_id").withColumn("at", (F.col("value") - F.col("low")) / F.col("width")).withColumn("bin", F.floor("at")).drop("value", "low", "width")
    counts = placed.groupBy("feature_id", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, n = pdf["bin"].to_numpy(np.int64), pdf["n"].to_numpy(float)
        order = np.argsort(bins)
        bins, n, reach = bins[order], n[order], 6 * per_bandwidth
        edges, upto = np.unique(np.concatenate([bins, bins + 1])), np.concatenate([[0.0], np.cumsum(n)])
        # all bins further below count whole, all further above not at all
        first, last = np.searchsorted(bins, edges - reach, "left"), np.searchsorted(bins, edges + reach, "right")
        total = upto[first]
        for k in range(int((last - first).max(initial=0))):
            at = first + k
            there = at < last
            total[there] += n[at[there]] * normal_cdf((edges[there] - bins[at[there]] - 0.5) / per_bandwidth)
        f = dict(zip(edges.tolist(), (total / n.sum()).tolist(), strict=True))
        return pd.DataFrame({"feature_id": pdf["feature_id"].iloc[0], "bin": bins, "f0": [f[b] for b in bins.tolist()], "f1": [f[b + 1] for b in bins.tolist()]})

    kind = obs.schema["feature_id"].dataType.simpleString()
    edges = counts.groupBy("feature_id").applyInPandas(convolve, f"feature_id {kind}, bin long, f0 double, f1 double")
    return placed.join(edges, ["feature_id", "bin"]).select("sample_id", "feature_id", (F.col("f0") + (F.col("at") - F.col("bin")) * (F.col("f1") - F.col("f0"))).alias("z"))


def set_variation(places: DataFrame, sets: DataFrame, tau: float = 1.0, difference: bool = True, least: int = 1) -> DataFrame:
    """(sample_id, set_id, score): extremes of a weighted running sum over a sample's features, largest ``z`` first.

    A member adds its share of the members' weights |p / 2 - place + 1| ^ tau, any
    other feature takes off one over their number.  The sum is largest after and
    smallest before some member, so only members are looked at.  The score is
    the largest plus the smallest value (with 0 among both), or without
    ``difference`` the one farther from 0.  Ties go by feature_id.  Sets with
    less than ``least`` features of the sample give no row.  Samples are dealt to
    slots and the sets go to every slot, where the members of some samples at a
    time are laid out and put in order; they are neither shuffled nor spilled.
    """
    of_sample = Window.partitionBy("slot", "sample_id")
    place = F.row_number().over(of_sample.orderBy(F.col("z").desc(), "feature_id"))
    dealt = places.withColumn("slot", F.pmod(F.xxhash64("sample_id"), F.lit(SLOTS)).cast("int")).repartition(SLOTS, "slot")
    ranked = dealt.select("slot", "sample_id", "feature_id", place.alias("place"), F.count(F.lit(1)).over(of_sample).alias("p"))
    # names of their own: both sides may come from the same features
    everywhere = sets.select(F.col("set_id").alias("name"), F.col("feature_id").alias("member")).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))

    def scored(rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        names, set_of = np.unique(sets["name"].to_numpy(object), return_inverse=True)
        features, code = np.unique(sets["member"].to_numpy(object), return_inverse=True)
        set_of = set_of[np.argsort(code, kind="stable")]
        size = np.bincount(code, minlength=len(features))
        start = np.cumsum(size) - size
        rows = rows.assign(code=pd.Index(features).get_indexer(rows["feature_id"]), number=pd.factorize(rows["sample_id"])[0])
        rows = rows[rows["code"] >= 0].sort_values(["number", "place"])
        code, number, at, p = (rows[c].to_numpy() for c in ("code", "number", "place", "p"))
        # whole samples, about EXPANDED members at a time
        part = (np.cumsum(size[code]) // EXPANDED)[np.searchsorted(number, number, "left")]
        out = [pd.DataFrame({"sample_id": rows["sample_id"].iloc[:0], "set_id": sets["name"].iloc[:0], "score": np.zeros(0)})]
        for n in np.unique(part):
            low, high = np.searchsorted(part, [n, n + 1])
            each = size[code[low:high]]
            row = np.repeat(np.arange(low, high), each)
            own = set_of[np.repeat(start[code[low:high]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            key = number[row] * len(names) + own
            order = np.argsort(key, kind="stable")  # rows are in the order of their places
            key, row, own = key[order], row[order], own[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            m = np.diff(np.r_[first, len(key)])
            w = np.abs(p[row] / 2 - at[row] + 1) ** float(tau)
            k = np.arange(len(key)) - np.repeat(first, m) + 1
            total, upto = np.add.reduceat(w, first), np.cumsum(w)
            cum = upto - np.repeat(upto[first] - w[first], m)
            rest = p[row] - np.repeat(m, m)
            outside = np.where(rest > 0, (at[row] - k) / np.maximum(rest, 1), 0.0)
            share = np.repeat(np.where(total > 0, 1 / np.where(total > 0, total, 1.0), 0.0), m)
            up = np.maximum(np.maximum.reduceat(cum * share - outside, first), 0.0)
            down = np.minimum(np.minimum.reduceat((cum - w) * share - outside, first), 0.0)
            score = up + down if difference else np.where(up >= -down, up, down)
            kept = m >= least
            out.append(pd.DataFrame({"sample_id": rows["sample_id"].to_numpy()[row[first]][kept], "set_id": names[own[first]][kept], "score": score[kept]}))
        return pd.concat(out[1:] or out)

    schema = f"sample_id {places.schema['sample_id'].dataType.simpleString()}, set_id {sets.schema['set_id'].dataType.simpleString()}, score double"
    return ranked.groupBy("slot").cogroup(everywhere.groupBy("slot")).applyInPandas(scored, schema)


def gsva(obs: DataFrame, sets: DataFrame, per_bandwidth: int = 4, tau: float = 1.0, difference: bool = True, least: int = 1) -> DataFrame:
    """(sample_id, set_id, score): variation of ``sets`` (set_id, feature_id) over samples, see :func:`set_variation`."""
    return set_variation(smoothed_distribution(obs, per_bandwidth), sets, tau, difference, least)
