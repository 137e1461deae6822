"""Positions, quantiles and concordance against plain forms; the scratch folder; the end-to-end fit."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import evaluate as E
from strandloom.operators import simulate as SM
from strandloom.operators.factor import FactorModel
from strandloom.operators.ranged import positions, quantile
from strandloom.plans.fit import fit_study
from strandloom.sources.scratch import discard, discard_all, save, shared_dir


def test_positions_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 2.5, rng.random() * 9, None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(3)
    got = positions(df, ["g"], F.col("v"), F.col("i")).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {r.i: r.pos for r in got if r.g == g} == {r[2]: n + 1 for n, r in enumerate(own)}
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {g: np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None], share) for g in ("a", "b", None)}
        assert {r.g: r["quantile"] for r in quantile(df, "v", share, "g").collect()} == pytest.approx(want)
    assert quantile(df, "v", 0.5).first()[0] == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))
    assert quantile(df.where("false"), "v", 0.5).first()[0] is None and quantile(df.where("false"), "v", 0.5, "g").count() == 0


def test_later_wins():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 100):
        r, w, own = rng.integers(0, 6, n).astype(float), rng.random(n), rng.integers(0, 2, n)
        want = [sum(w[j] * ((r[j] < r[i]) + 0.5 * (r[j] == r[i])) for j in range(i + 1, n)) if own[i] else 0 for i in range(n)]
        assert E.later_wins(r, w, own) == pytest.approx(want)


def test_concordance_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 12), rng.random() < 0.5, rng.randint(0, 9)) for _ in range(150)]
    won = n = 0
    for ta, da, ra in rows:
        for tb, db, rb in rows:
            if da and (tb > ta or (tb == ta and not db)):
                n += 1
                won += (ra > rb) + 0.5 * (ra == rb)
    df = spark.createDataFrame(rows, "t int, dead boolean, risk int")
    assert E.concordance(df, "t", "dead", "risk").first()[0] == pytest.approx(won / n)
    assert E.concordance(df.where("false"), "t", "dead", "risk").first()[0] == 0.5


def test_scratch_tables(spark):
    df = save(spark.range(5), "test")
    assert df.count() == 5 and shared_dir(spark) in df._saved_at
    discard(df, spark.range(1))
    assert not spark._jvm.java.io.File(df._saved_at).exists()
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="all executors share"):
        shared_dir(unset)
    assert callable(discard_all)


def test_fit_study(spark, tmp_path):
    path = str(tmp_path)
    samples = spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), (F.col("id") % 2).cast("string").alias("condition"))
    features = spark.range(10).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature_id"), F.lit("a").alias("view"), F.lit("normal").alias("distribution"))
    tables = SM.study(samples, features, 2, seed=1)
    for name, df in (("obs", tables["obs"]), ("samples", samples), ("features", features)):
        df.write.parquet(f"{path}/{name}")
    m = fit_study(spark, path, configuration="basic", k=2, var_filter=0.6, epochs=2)
    assert len(m.features) == 6 and m.history[-1]["name"] == "finish"
    m.save(spark, f"{path}/model")
    assert np.allclose(FactorModel.load(spark, f"{path}/model").y, m.y)
    with pytest.raises(ValueError, match="unknown options"):
        fit_study(spark, path, colour=1)
