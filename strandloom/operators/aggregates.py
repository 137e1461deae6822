"""Column and batch aggregates, moments, imputation, standardisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scalars import ratio
from strandloom.operators.ranged import BUCKET, buckets, carried, joined, quantile

AGGREGATES = {"mean": F.avg, "var": F.var_samp, "median": F.median, "count": F.count, "std": F.stddev_samp}


def column_stats(obs: DataFrame, *by: str) -> DataFrame:
    """n, total, mean, sample and population variance, root mean square of the finite values."""
    v = F.col("value")
    return obs.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_samp(v).alias("var_samp"), F.var_pop(v).alias("var_pop"), F.sqrt(F.avg(v * v)).alias("rms")
    )


def floored_variance(obs: DataFrame, n_samples: int) -> DataFrame:
    """Column variance, at least 1 / number of samples."""
    return obs.groupBy("feature_id").agg(F.greatest(F.var_samp("value"), F.lit(1.0 / n_samples)).alias("variance"))


def batch_sums(obs: DataFrame, batch_map: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """(view, batch, feature_id, total): sums of f(value) over each batch; views without batches have none."""
    joined = obs.join(batch_map, ["view", "sample_id"])
    return joined.groupBy("view", "batch", "feature_id").agg(F.sum(f(F.col("value"))).alias("total"))


def theta_moments(batch_values: DataFrame) -> DataFrame:
    """Mean and sample variance across columns of each (view, batch)."""
    return batch_values.groupBy("view", "batch").agg(F.avg("batch_value").alias("mean"), F.var_samp("batch_value").alias("variance"))


def inverse_gamma_moments(batch_values: DataFrame) -> DataFrame:
    """Shape and scale of each (view, batch) by matching moments."""
    m = theta_moments(batch_values)
    alpha = 2 + F.col("mean") ** 2 / (F.col("variance") + 1e-9)
    return m.withColumn("alpha", alpha).withColumn("beta", F.col("mean") * (F.col("alpha") - 1)).drop("mean", "variance")


def gamma_moments(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Closed-form gamma estimates from E[x], E[ln x] and E[x ln x]."""
    c = F.col(x)
    m = df.groupBy(*by).agg(F.avg(c).alias("m"), F.avg(F.ln(c)).alias("ml"), F.avg(c * F.ln(c)).alias("mxl"))
    beta = F.col("mxl") - F.col("m") * F.col("ml")
    return m.select(*by, beta.alias("beta"), (F.col("m") / (beta + 1e-12)).alias("alpha"))


def replicate_aggregate(df: DataFrame, over: list[str], value: str, op: str) -> DataFrame:
    """``op`` of ``value`` grouped by all columns but ``over``."""
    if op not in AGGREGATES:
        raise ValueError(f"unknown aggregate {op!r}; known: {sorted(AGGREGATES)}")
    return df.groupBy(*[c for c in df.columns if c not in {*over, value}]).agg(AGGREGATES[op](value).alias(value))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares of values."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(col, "n", (F.col("n") / F.col("total")).alias("share"))


def mode(df: DataFrame, col: str) -> DataFrame:
    """One row: the most frequent value, of ties the smallest."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), col).limit(1).select(F.col(col).alias("mode"))


def mode_accuracy(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    return test.crossJoin(F.broadcast(mode(train, label))).agg(F.avg((F.col(label) == F.col("mode")).cast("double")).alias("accuracy"))


def mean_baseline_mse(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    mean = train.agg(F.avg(y).alias("mean"))
    return test.crossJoin(F.broadcast(mean)).agg(F.avg((F.col(y) - F.col("mean")) ** 2).alias("mse"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))


def first_seen(df: DataFrame, col: str, pos: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(col).agg(F.min(pos).alias("first_pos"))


def medians(obs: DataFrame) -> DataFrame:
    return quantile(obs, "value", 0.5, "feature_id", name="median")


def median_impute(grid: DataFrame, med: DataFrame) -> DataFrame:
    """Missing values replaced by the (training) median of their feature."""
    return grid.join(med, "feature_id", "left").select("sample_id", "feature_id", F.coalesce("value", "median").alias("value"))


def standardise(obs: DataFrame, params: DataFrame | None = None, population: bool = True) -> DataFrame:
    """(value - mean) / deviation of the feature; NULL for constant features.

    ``params``: feature_id, mean, deviation from other data; by default from ``obs``.
    """
    if params is None:
        params = column_params(obs, population)
    return obs.join(params, "feature_id").withColumn("value", ratio(F.col("value") - F.col("mean"), F.col("deviation"))).drop("mean", "deviation")


def column_params(obs: DataFrame, population: bool = True) -> DataFrame:
    return obs.groupBy("feature_id").agg(F.avg("value").alias("mean"), (F.stddev_pop if population else F.stddev_samp)("value").alias("deviation"))


def factor_norms(y: DataFrame) -> DataFrame:
    """Sum of squares of each factor, in total (view NULL) and per view, in one pass.  y: k, view, v."""
    y.createOrReplaceTempView("strandloom_factor_values")
    return y.sparkSession.sql("SELECT k, view, sum(v * v) AS ssq FROM strandloom_factor_values GROUP BY GROUPING SETS ((k), (k, view))")


def scale_from_errors(errors: DataFrame) -> DataFrame:
    """ln of the root mean squared error of each feature; NULL where it is 0.  errors: feature_id, e."""
    ms = F.sum(F.col("e") ** 2) / F.nullif(F.count("e"), F.lit(0))
    return errors.groupBy("feature_id").agg(F.ln(F.sqrt(F.nullif(ms, F.lit(0.0)))).alias("logsigma"))


def loss_weights(grads: DataFrame, n_samples: int) -> DataFrame:
    """1 / (root of squared gradients over ALL samples * sigma), 1 where that is not finite.

    grads: feature_id, g, sigma.
    """
    s = grads.groupBy("feature_id").agg(F.sqrt(F.sum(F.col("g") ** 2) / n_samples).alias("s"), F.first("sigma").alias("sigma"))
    return s.select("feature_id", F.coalesce(F.try_divide(F.lit(1.0), F.col("s") * F.col("sigma")), F.lit(1.0)).alias("weight"))


def ordinal_thresholds(df: DataFrame, by: str, level: str, levels: list[int]) -> DataFrame:
    """(by, level, threshold): logit of the smoothed cumulative share up to each level but the last."""
    grid = df.select(by).distinct().crossJoin(df.sparkSession.createDataFrame([(x,) for x in levels], f"{level} int"))
    counts = grid.join(df.groupBy(by, level).agg(F.count(F.lit(1)).alias("n")), [by, level], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(level)) / F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("p", upto).where(F.col(level) < max(levels)).select(by, level, F.ln(F.col("p") / (1 - F.col("p"))).alias("threshold"))


def m_estimates(obs: DataFrame) -> DataFrame:
    """Location of each column in link space: mean, logit of the mean or ln of the mean.  obs has distribution."""
    m = obs.groupBy("feature_id", "distribution").agg(F.avg("value").alias("m"))
    logit = F.when((F.col("m") > 0) & (F.col("m") < 1), F.ln(F.col("m") / (1 - F.col("m"))))
    return m.select("feature_id", F.when(F.col("distribution") == "bernoulli", logit).when(F.col("distribution") == "poisson", F.ln(F.col("m"))).otherwise(F.col("m")).alias("mu"))


def weighted_mean(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg((F.sum(F.col("score") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("score"))


def with_average_rank(df: DataFrame, col: str, name: str, *by: str) -> DataFrame:
    """``df`` with the rank of ``col`` in its group from 1, ties get their mean rank; nulls come last.

    Distinct values with their counts are ranged and joined back, so no task
    holds a group or sorts its rows.
    """
    keys = [F.col(c).alias(f"__{c}") for c in (*by, col)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    names, value = [f"__{c}" for c in by], F.col(f"__{col}").asc_nulls_last()
    held = buckets(counts, *names, value)
    placed = joined(held, carried(held, names, __before=F.col("__n")), names)
    own = F.sum("__n").over(Window.partitionBy(*names, BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("__before") + own - (F.col("__n") - 1) / 2
    ranks = placed.select(*names, f"__{col}", rank.alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, col)]
    return df.join(ranks, on).drop(*names, f"__{col}")


def recovery(df: DataFrame, *by: str) -> DataFrame:
    """R2, Pearson and Spearman correlation of fitted (f) against true (t) values."""
    ranked = with_average_rank(with_average_rank(df, "t", "rt", *by), "f", "rf", *by)
    spread = F.var_pop("t") * F.count("t")  # the sum of squares about the mean
    return ranked.groupBy(*by).agg((1 - F.sum((F.col("t") - F.col("f")) ** 2) / F.nullif(spread, F.lit(0.0))).alias("r2"), F.corr("t", "f").alias("pearson"), F.corr("rt", "rf").alias("spearman"))


def relative_gain(scores: DataFrame, *by: str) -> DataFrame:
    """Mean of 100 (score - baseline) / baseline."""
    return scores.groupBy(*by).agg(F.avg(100 * (F.col("score") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0))).alias("gain"))


def positive_rate(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(value) > 0).cast("double")).alias("rate"))
