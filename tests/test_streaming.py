"""Samples that arrive in parts: the same factors as in one batch, restarts included."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.operators.factor import FactorModel
from strandloom.streaming.transform import latest_factors, transform_split_stream

K, N = 2, 8
SCHEMA = "sample_id string, feature_id string, value double, at timestamp"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    f = pd.DataFrame({"feature_id": [f"f{j}" for j in range(N)], "view": "v", "distribution": "normal", "mu": rng.normal(size=N), "logsigma": rng.normal(0, 0.3, N), "weight": rng.uniform(0.5, 2, N), "cut1": -1.0, "cut2": 1.0})
    return FactorModel(K, features=f, y=rng.normal(size=(K, N)))


def _values(day=0):
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    return [(f"s{i}", f"f{j}", float(rng.normal()) if (i + j) % 5 else None, start + dt.timedelta(minutes=j)) for j in range(N) for i in range(6)] + [("s0", "unknown", 3.0, start)]


def _run(spark, model, tmp_path, parts, **options):
    """Each part is a file that its own run of the query reads, from the checkpoint of the run before."""
    src = tmp_path / "in"
    src.mkdir()
    for n, rows in enumerate(parts):
        pd.DataFrame(rows, columns=["sample_id", "feature_id", "value", "at"]).astype({"at": "datetime64[us]"}).to_parquet(src / f"{n}.parquet")
        q = transform_split_stream(model, spark.readStream.schema(SCHEMA).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), **options)
        q.processAllAvailable()
        q.stop()
    return {r.sample_id: (r.x, r.n) for r in latest_factors(spark, str(tmp_path / "out")).collect()}


def test_parts_give_the_factors_of_the_whole(spark, model, tmp_path):
    rows = _values()
    got = _run(spark, model, tmp_path, [rows[:20], rows[20:23], rows[23:]])
    want = {r.sample_id: r.x for r in model.transform(spark.createDataFrame(rows, SCHEMA).withColumn("view", F.lit("v"))).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[s][0], want[s], atol=1e-8) for s in want)
    assert {s: n for s, (_, n) in got.items()} == {f"s{i}": sum((i + j) % 5 > 0 for j in range(N)) for i in range(6)}


def test_state_goes_behind_the_watermark(spark, model, tmp_path):
    """Long after its last value a sample starts anew; one that keeps sending goes on."""
    first = [r for r in _values() if r[0] in ("s0", "s1")][:6]
    later = [("s9", "f0", 1.0, dt.datetime(2024, 2, 1))]
    again = [("s0", "f1", 1.0, dt.datetime(2024, 2, 2)), ("s9", "f1", 1.0, dt.datetime(2024, 2, 2))]
    got = _run(spark, model, tmp_path, [first, later, again], time="at", late="1 hour")
    assert got["s0"][1] == 1 and got["s9"][1] == 2 and got["s1"][1] >= 2


def test_other_noise_is_an_error(spark, model):
    other = FactorModel(K, features=model.features.assign(distribution="poisson"), y=model.y)
    with pytest.raises(ValueError, match="normal noise"):
        transform_split_stream(other, spark.createDataFrame([], SCHEMA), "x", "y")


def test_states_without_times_are_sums_of_spark(spark, model, tmp_path):
    """No Python call for each sample; a sample without any known value has factors of 0."""
    src = tmp_path / "in"
    spark.createDataFrame([("s0", "f1", 2.0, None), ("s1", "unknown", 2.0, None), ("s2", "f1", float("inf"), None)], SCHEMA).write.parquet(str(src))
    q = transform_split_stream(model, spark.readStream.schema(SCHEMA).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    plan = q._jsq.explainInternal(False)
    q.stop()
    got = {r.sample_id: (r.n, r.x) for r in latest_factors(spark, str(tmp_path / "out")).collect()}
    assert "StateStoreSave" in plan and "FlatMapGroupsInPandasWithState" not in plan
    assert got["s0"][0] == 1 and got["s1"] == got["s2"] == (0, [0.0] * K)
