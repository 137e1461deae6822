"""Scores of fitted factors, predictions and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.scalars import guarded
from strandloom.operators.aggregates import recovery
from strandloom.operators.joins import assignment
from strandloom.operators.ordered import average_precision, roc_auc
from strandloom.operators.ranged import BUCKET, buckets


def classification_scores(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: accuracy, f1_micro, f1_macro (0 for a class never predicted and never right)."""
    cells = df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hit = cells.where(F.col(true) == F.col(pred)).select(F.col(true).alias("label"), F.col("n").alias("tp"))
    per = side(true, "t").join(side(pred, "p"), "label", "full").join(hit, "label", "left").na.fill(0)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), (2 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("f1_micro"), F.avg(f1).alias("f1_macro"))


def binary_scores(df: DataFrame, score: str, truth: str) -> DataFrame:
    """AUC, average precision and share of positives."""
    rate = df.agg(F.avg(F.col(truth).cast("double")).alias("base_rate"))
    return roc_auc(df, score, truth).crossJoin(average_precision(df, score, truth)).crossJoin(rate)


def multiclass_auc(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """One row: auc_ovr and auc_ovo over the classes that occur in ``truth`` (places in the array ``scores``).

    One against the rest: the mean over classes of the area of the class's score
    against all others.  One against one: for each pair of classes, among their
    rows, the mean of both scores' areas; then the mean over pairs.  NULL with
    fewer than two classes.  A row counts once for each class, or twice for each
    other class, whatever the number of rows.
    """
    d = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("int").alias("t"), F.col(scores).alias("s"))
    classes = sorted(r[0] for r in d.select("t").distinct().collect())
    all_ = F.array(*map(F.lit, classes)).cast("array<int>")
    rest = d.select("t", "s", F.explode(all_).alias("a")).select("a", (F.col("t") == F.col("a")).cast("int").alias("y"), F.col("s")[F.col("a")].alias("score"))
    # a row of class t meets each other class o: with the score of t as one of t, with that of o as not one of o
    others = d.select("t", "s", F.explode(all_).alias("o")).where("t <> o")
    both = others.select("t", "o", F.explode(F.array(F.struct(F.col("t").alias("a"), F.col("o").alias("b"), F.lit(1).alias("y"), F.col("s")[F.col("t")].alias("score")), F.struct(F.col("o").alias("a"), F.col("t").alias("b"), F.lit(0).alias("y"), F.col("s")[F.col("o")].alias("score")))).alias("c"))
    mean = lambda x, name: x.agg(F.when(F.lit(len(classes) > 1), F.avg("auc")).alias(name))
    return mean(roc_auc(rest, "score", "y", "a"), "auc_ovr").crossJoin(mean(roc_auc(both.select("c.*"), "score", "y", "a", "b"), "auc_ovo"))


def regression_scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    """mse, r2 and the mse of the mean."""
    e = F.avg((F.col(y) - F.col(pred)) ** 2)
    return df.agg(e.alias("mse"), (1 - e / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"), F.var_pop(y).alias("baseline_mse"))


def later_wins(r: np.ndarray, w: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each point, in the order given, the weight of later points with a smaller r, plus half of those with an equal one.

    Counted level by level: blocks of 1, 2, 4 ... points look up the sorted block
    beside them.  Points with ``own`` 0 are not asked.
    """
    n = len(r)
    rank = np.unique(r, return_inverse=True)[1].astype(np.int64)
    out, size, top = np.zeros(n), 1, int(rank.max(initial=0)) + 1
    at = np.arange(n)
    while size < n:
        pair, right = at // (2 * size), at // size % 2 == 1
        key = pair[right] * top + rank[right]
        order = np.argsort(key, kind="stable")
        key, upto = key[order], np.concatenate(([0.0], np.cumsum(w[right][order])))
        ask = ~right & (own > 0)
        want = pair[ask] * top + rank[ask]
        base = upto[np.searchsorted(key, pair[ask] * top, "left")]
        out[ask] += (upto[np.searchsorted(key, want, "left")] + upto[np.searchsorted(key, want, "right")]) / 2 - base
        size *= 2
    return out


def concordance(df: DataFrame, time: str, dead: str, risk: str) -> DataFrame:
    """Harrell's index: of the pairs whose order in time is known, the share in which the earlier death has the higher risk.

    Ties in risk count half; pairs with equal times count if only one died.
    Rows are first counted by distinct (time, risk), then ranged by time and by
    risk.  Pairs in one range of time, or of different times in one range of
    risk, are counted by sorting in a task; all others follow from counts by
    (range, range), so the work grows with n log n.
    """
    pts = df.groupBy(F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r")).agg(F.sum(F.col(dead).cast("int")).alias("d"), F.sum((~F.col(dead)).cast("int")).alias("c"))
    by_time = buckets(pts, "t").withColumnRenamed(BUCKET, "tb")
    held = buckets(by_time, "r").withColumnRenamed(BUCKET, "rb")

    def same_time(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs inside a range of time."""
        p = pdf.sort_values(["t", "r"], ignore_index=True)
        d, c, t = (p[x].to_numpy(float) for x in ("d", "c", "t"))
        won = later_wins(p["r"].to_numpy(), d + c, d)  # at equal times the others follow with a higher risk
        starts = np.searchsorted(t, t, "left")
        alive = np.concatenate(([0.0], np.cumsum(c)))
        won += alive[:-1] - alive[starts] + c / 2
        ends, weight = np.searchsorted(t, t, "right"), np.concatenate(([0.0], np.cumsum(d + c)))
        pairs = weight[-1] - weight[ends] + alive[ends] - alive[starts]
        return pd.DataFrame({"won": [float((d * won).sum())], "n": [float((d * pairs).sum())]})

    def same_risk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs inside a range of risk whose ranges of time differ: all later ones but those of the same range."""
        p = pdf.sort_values(["tb", "r", "t"], ignore_index=True)
        d, c = p["d"].to_numpy(float), p["c"].to_numpy(float)
        r, tb = p["r"].to_numpy(), p["tb"].to_numpy()
        won = later_wins(r, d + c, d)
        for i, j in zip(*(np.searchsorted(tb, np.unique(tb), side) for side in ("left", "right")), strict=True):
            won[i:j] -= later_wins(r[i:j], (d + c)[i:j], d[i:j])
        return pd.DataFrame({"won": [float((d * won).sum())], "n": [0.0]})

    parts = "won double, n double"
    # a row for each pair of ranges: what lies later, and later in lower ranges of risk
    grid = held.groupBy("tb", "rb").agg(F.sum("d").alias("d"), F.sum(F.col("d") + F.col("c")).alias("w"))
    full = held.select("tb").distinct().crossJoin(held.select("rb").distinct()).join(grid, ["tb", "rb"], "left").na.fill(0, ["d", "w"])
    lower = F.coalesce(F.sum("w").over(Window.partitionBy("tb").orderBy("rb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("lower", lower).withColumn("all", F.sum("w").over(Window.partitionBy("tb")))
    later = Window.partitionBy("rb").orderBy("tb").rowsBetween(1, Window.unboundedFollowing)
    full = full.withColumn("won", F.col("d") * F.coalesce(F.sum("lower").over(later), F.lit(0))).withColumn("n", F.col("d") * F.coalesce(F.sum("all").over(later), F.lit(0)))
    far = full.agg(F.coalesce(F.sum("won"), F.lit(0)).cast("double").alias("won"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
    near = held.groupBy("tb").applyInPandas(same_time, parts).unionByName(held.groupBy("rb").applyInPandas(same_risk, parts))
    return near.unionByName(far).agg(F.coalesce(F.try_divide(F.sum("won"), F.sum("n")), F.lit(0.5)).alias("concordance"))


def span_similarity(true: np.ndarray, fitted: np.ndarray) -> float:
    """|Yt Yf'|^2 over the sum of products of the leading squared singular values (K x N arrays)."""
    k = min(len(true), len(fitted))
    s, t = (np.linalg.svd(a, compute_uv=False)[:k] for a in (true, fitted))
    bound = float((s**2 * t**2).sum())
    return float(((true @ fitted.T) ** 2).sum() / bound) if bound else 0.0


def squared_cosines(true: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(true, axis=1)[:, None] * np.linalg.norm(fitted, axis=1)
    return np.divide((true @ fitted.T) ** 2, n * n, out=np.zeros((len(true), len(fitted))), where=n > 0)


def best_match(score: np.ndarray) -> float:
    """Mean score of the best one-to-one matching."""
    pairs = assignment(score)
    return float(np.mean([score[i, j] for i, j in pairs])) if pairs else 0.0


def long_to_array(df: DataFrame, item: str, k: int) -> np.ndarray:
    """K x N array of (k, item, v), items sorted; for parameters of feature size."""
    wide = df.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).orderBy(item).collect()
    return np.array([[r["m"].get(i, 0.0) for i in range(k)] for r in wide]).T


def permutation_p(spark: SparkSession, score: Callable[[np.ndarray, np.ndarray], float], true: np.ndarray, fitted: np.ndarray, n: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """(observed score, mean under permuted columns of ``fitted``, share of permutations at least as good)."""
    own = score(true, fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [score(true, fitted[:, np.random.default_rng([seed, int(i)]).permutation(fitted.shape[1])]) for i in pdf["id"]]
            yield pd.DataFrame({"s": s})

    r = spark.range(n).mapInPandas(run, "s double").agg(F.avg("s").alias("m"), F.avg((F.col("s") >= own).cast("double")).alias("p")).first()
    return own, r["m"], r["p"]


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b turned onto a: (U1 V1')(U2 V2')' b, from the decompositions of the two."""
    u1, _, v1 = np.linalg.svd(a, full_matrices=False)
    u2, _, v2 = np.linalg.svd(b, full_matrices=False)
    return (u1 @ v1) @ (u2 @ v2).T @ b


def column_scores(df: DataFrame, score: str, truth: str, column: str) -> DataFrame:
    """Mean over columns of AUC and average precision, columns of one class left out of the latter."""
    auc, ap = roc_auc(df, score, truth, column), average_precision(df, score, truth, column)
    return auc.join(ap, column).agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))


def pair_scores(true: DataFrame, fitted: DataFrame, item: str) -> DataFrame:
    """(i, j, auc): how well the values of fitted column j tell the positive items of true column i.

    true: (i, item, positive); fitted: (j, item, v).
    """
    pairs = true.join(fitted, item)
    return roc_auc(pairs, "v", "positive", "i", "j")


def best_pairs(scores: DataFrame, value: str, size: int) -> float:
    """Mean of the best one-to-one matching of (i, j, value) rows; factors of a model, so size x size numbers come to the driver."""
    grid = np.zeros((size, size))
    for r in scores.select("i", "j", value).collect():
        grid[r["i"], r["j"]] = r[value]
    return best_match(grid)


def recovery_scores(true: dict[str, DataFrame], fitted: dict[str, DataFrame], k: int) -> dict[str, float]:
    """How well a fit recovers simulated parameters.

    Tables by name: X (k, sample_id, v), Y (k, feature_id, v); A (k, set_id, v);
    mu, logsigma (feature_id, v); theta, logdelta (view, batch, feature_id, v).
    Spans of X and Y, AUC, average precision and base rate of A's entries after
    matching, and r2, Pearson and Spearman correlation of the others; a
    non-finite logdelta counts as 0.  Tables that either side lacks are left out.
    """
    out: dict[str, float] = {}
    for name, item in (("X", "sample_id"), ("Y", "feature_id")):
        if name in true and name in fitted:
            out[f"{name}_span"] = span_from_products(*(_products(a, b, item, k) for a, b in ((true[name], fitted[name]), (true[name], true[name]), (fitted[name], fitted[name]))))
    if "A" in true and "A" in fitted:
        t = true["A"].select(F.col("k").alias("i"), "set_id", (F.col("v") > 0).alias("positive"))
        pairs = pair_scores(t, fitted["A"].select(F.col("k").alias("j"), "set_id", "v"), "set_id")
        out["A_auc"] = best_pairs(pairs, "auc", k)
        ap = average_precision(t.join(fitted["A"].select(F.col("k").alias("j"), "set_id", "v"), "set_id"), "v", "positive", "i", "j")
        out["A_ap"] = best_pairs(ap.na.fill(0.0, ["ap"]), "ap", k)
        out["A_base"] = t.agg(F.avg(F.col("positive").cast("double"))).first()[0]
    for name in ("mu", "logsigma", "theta", "logdelta"):
        if name in true and name in fitted:
            keys = [c for c in true[name].columns if c != "v"]
            f = guarded(F.col("f"), 0.0) if name == "logdelta" else F.col("f")
            both = true[name].withColumnRenamed("v", "t").join(fitted[name].select(*keys, F.col("v").alias("f")), keys).withColumn("f", f)
            r = recovery(both.select("t", "f")).first()
            out |= {f"{name}_{c}": r[c] for c in ("r2", "pearson", "spearman")}
    return out


def _products(a: DataFrame, b: DataFrame, item: str, k: int) -> np.ndarray:
    """k x k inner products of two long factor tables over their items."""
    left, right = a.select(item, F.col("k").alias("i"), F.col("v").alias("a")), b.select(item, F.col("k").alias("j"), F.col("v").alias("b"))
    out = np.zeros((k, k))
    for r in left.join(right, item).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("p")).collect():
        out[r["i"], r["j"]] = r["p"]
    return out


def span_from_products(cross: np.ndarray, true: np.ndarray, fitted: np.ndarray) -> float:
    """:func:`span_similarity` from K x K inner products, for factors of any number of items."""
    s, t = (np.sort(np.maximum(np.linalg.eigvalsh(g), 0))[::-1] for g in (true, fitted))
    bound = float((s * t).sum())
    return float((cross**2).sum() / bound) if bound else 0.0
