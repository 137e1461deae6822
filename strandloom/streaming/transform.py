"""Projection of a stream of new samples with a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.operators.factor import FactorModel

FACTORS = "sample_id string, x array<double>, n long"


def transform_stream(model: FactorModel, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the factors of the samples in each micro-batch of (sample_id, feature_id, value) to Parquet.

    A sample's values have to arrive in one micro-batch: rows are projected as
    they come and no state is kept between batches.  Each batch writes to a
    folder of its own number, so a batch that is run again replaces its output.
    """

    def sink(batch: DataFrame, number: int) -> None:
        model.transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def transform_split_stream(model: FactorModel, stream: DataFrame, path: str, checkpoint: str, time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """The same for samples whose values arrive over several micro-batches: after each, the factors of the samples it touched.

    The state of a sample is what its least squares problem needs, K x K and K
    sums and a count, so values are not kept.  That takes normal noise: a model
    with other noise is an error.  A sample is to send a feature once; missing
    values and unknown features are skipped.  With ``time``, a column of event
    times, a sample's state is dropped once the watermark, ``late`` behind the
    latest time seen, passes the sample's own latest time; without, states stay
    and are plain sums of Spark's own, solved for all samples of a batch together.
    :func:`latest_factors` reads what was written.
    """
    f = model.features
    if (f["distribution"] != "normal").any():
        raise ValueError("samples that come in parts need normal noise")
    k, place = model.k, pd.Index(f["feature_id"])
    scale, mu, y = np.exp(f["logsigma"].to_numpy(float)), f["mu"].to_numpy(float), model.y
    weight = f["weight"].to_numpy(float) * scale**2
    own = stream.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("feature_id").cast("string").alias("feature_id"), F.col("value").cast("double").alias("value"), *([F.col(time).cast("timestamp").alias("time")] if time else []))
    if not time:
        table = stream.sparkSession.createDataFrame(pd.DataFrame({"feature_id": place.astype(str), "mu": mu, "scale": scale, "w": weight, "y": y.T.tolist()}), "feature_id string, mu double, scale double, w double, y array<double>")
        return _append(_sums(own, table, k), path, checkpoint, lambda batch: batch.mapInPandas(_solver(k), FACTORS))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sums, n = (np.array(state.get[0]), state.get[1]) if state.exists else (np.zeros(k * k + k), 0)
        latest = 0
        for pdf in parts:
            j, v = place.get_indexer(pdf["feature_id"]), pdf["value"].to_numpy(float)
            there = (j >= 0) & np.isfinite(v)
            j, v = j[there], v[there]
            own, z = y[:, j], (v - mu[j]) / scale[j]
            sums[: k * k] += ((own * weight[j]) @ own.T).ravel()
            sums[k * k :] += own @ (weight[j] * z)
            n += len(j)
            latest = max(latest, int(pdf["time"].max().timestamp() * 1000))
        state.update((sums.tolist(), n))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        x = np.linalg.solve(sums[: k * k].reshape(k, k) + 1e-8 * np.eye(k), sums[k * k :])
        yield pd.DataFrame({"sample_id": [key[0]], "x": [x.tolist()], "n": [n]})

    own = own.withWatermark("time", late)
    factors = own.groupBy("sample_id").applyInPandasWithState(update, FACTORS, "sums array<double>, n long", "update", GroupStateTimeout.EventTimeTimeout)
    return _append(factors, path, checkpoint)


def _sums(own: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(sample_id, n, k * k and k sums): the least squares problem of each sample, from what has come of it."""
    at = own.join(F.broadcast(table), "feature_id", "left")
    v = F.col("value")
    there = F.col("w").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    total = lambda c: F.sum(F.when(there, c).otherwise(0.0))
    y = [F.col("y")[i] for i in range(k)]
    z = (v - F.col("mu")) / F.col("scale")
    left = [total(F.col("w") * y[i] * y[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    right = [total(F.col("w") * y[i] * z).alias(f"b{i}") for i in range(k)]
    return at.groupBy("sample_id").agg(F.sum(there.cast("long")).alias("n"), *left, *right)


def _solver(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}_{j}"].to_numpy(float)
            b = pdf[[f"b{i}" for i in range(k)]].to_numpy(float)
            x = np.linalg.solve(a + 1e-8 * np.eye(k), b[:, :, None])[:, :, 0]
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "x": list(x), "n": pdf["n"]})

    return solve


def _append(factors: DataFrame, path: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Each micro-batch of ``factors``, finished, into a folder of its own number."""

    def sink(batch: DataFrame, number: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return factors.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).start()


def latest_factors(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, x, n) of each sample after the last micro-batch that touched it."""
    rows = spark.read.schema("sample_id string, x array<double>, n long, batch long").parquet(path)
    return rows.groupBy("sample_id").agg(F.max_by(F.struct("x", "n"), "batch").alias("last")).select("sample_id", "last.*")
