"""Fits: recovery on simulated data, invariances, persistence, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import baselines as BL
from strandloom.operators import evaluate as E
from strandloom.operators import simulate as SM
from strandloom.operators.factor import FactorModel
from strandloom.streaming.transform import transform_stream

K = 3


@pytest.fixture(scope="module")
def toy(spark):
    samples = spark.range(80).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), (F.col("id") % 2).cast("string").alias("condition"))
    features = spark.range(24).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature_id"), F.when(F.col("id") < 12, "a").otherwise("b").alias("view"), F.lit("normal").alias("distribution"))
    x, y = SM.factor_values(samples, "sample_id", K, 1), SM.factor_values(features, "feature_id", K, 2)
    obs = SM.simulate_data(x, y, SM.column_values(features, K, 3), noise=0.1, seed=4)
    gaps = obs.where(F.pmod(F.xxhash64("sample_id", "feature_id"), F.lit(10)) > 0).cache()
    return samples, features, x, y, obs.cache(), gaps


@pytest.fixture(scope="module")
def model(toy):
    samples, features, *_, gaps = toy
    return FactorModel(K, ridge=0.05).fit(gaps, samples, features)


def test_recovery_and_loss(toy, model):
    _, _, _, y, obs, gaps = toy
    losses = [h["total_loss"] for h in model.history if h["name"] == "epoch"]
    assert losses[-1] < 0.2 * losses[0]
    ids = sorted(model.features["feature_id"])
    place = {f: i for i, f in enumerate(model.features["feature_id"])}
    fitted = model.y[:, [place[f] for f in ids]] * np.exp(model.features["logsigma"].to_numpy()[[place[f] for f in ids]])
    true = E.long_to_array(y, "feature_id", K)
    scale = np.exp([0.0] * len(ids))
    assert E.span_similarity(np.linalg.qr((true * scale).T)[0].T, np.linalg.qr(fitted.T)[0].T) > 0.9
    hidden = obs.join(gaps.select("sample_id", "feature_id"), ["sample_id", "feature_id"], "left_anti")
    r = model.impute().withColumnRenamed("value", "p").join(hidden, ["sample_id", "feature_id"]).agg(F.corr("p", "value")).first()[0]
    assert r > 0.95


def test_normal_forms_leave_the_fit_unchanged(model):
    grid = lambda: {(r.sample_id, r.feature_id): r.z for r in model.latent().collect()}
    before = grid()
    rms = model.factors.agg(*(F.sqrt(F.avg(F.col("x")[i] ** 2)) for i in range(K))).first()
    assert np.allclose(list(rms), 1, atol=1e-6)
    assert (np.diff((model.y**2).sum(axis=1)) <= 1e-9).all()
    y, factors = model.y.copy(), model.factors
    model.rotate()
    after = grid()
    model.y, model.factors = y, factors
    assert max(abs(before[k] - after[k]) for k in before) < 1e-8


def test_transform_equals_the_fit_on_the_same_rows(toy, model):
    own = {r.sample_id: np.array(r.x) for r in model.factors.collect()}
    got = {r.sample_id: np.array(r.x) for r in model.transform(toy[-1]).collect()}
    c = np.corrcoef(np.array([own[s] for s in own]).ravel(), np.array([got[s] for s in own]).ravel())[0, 1]
    assert set(got) == set(own) and c > 0.98
    extra = toy[-1].unionByName(toy[-1].limit(1).withColumn("feature_id", F.lit("unknown")))
    assert model.transform(extra).count() == len(own)


def test_save_and_load(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    back = FactorModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.y, model.y) and back.k == K and back.history == model.history
    assert back.features.equals(model.features) or np.allclose(back.features["mu"], model.features["mu"])
    assert back.factors.count() == model.factors.count()


def test_streaming_transform(spark, toy, model, tmp_path):
    src = str(tmp_path / "in")
    toy[-1].select("sample_id", "feature_id", "value").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("sample_id string, feature_id string, value double").parquet(src)
    q = transform_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_feature_set_prior_and_report(spark, toy):
    samples, features, *_ = toy
    sets = features.withColumn("set_id", F.concat(F.lit("set"), F.floor(F.regexp_extract("feature_id", r"\d+", 0).cast("int") / 4).cast("string"))).select("view", "set_id", "feature_id", F.lit(0.5).alias("weight"))
    y = SM.set_factor_values(features.select("view", "feature_id"), sets, K, seed=5).select("k", "feature_id", "v")
    obs = SM.simulate_data(toy[2], y, SM.column_values(features, K, 3), noise=0.1, seed=6)
    m = FactorModel(K, prior="fsard").fit(obs, samples, features, sets=sets, epochs=6, outer=2)
    assert [h["name"] for h in m.history].count("assignment") == 2
    assert set(m.assign) == {"a", "b"} and all((a >= 0).all() and a.any() for a in m.assign.values())
    report = m.interpret(spark).collect()
    assert report and all(r.factor == ("" if r.pos > 1 else f"Factor {r.k}") for r in report)


def test_mixed_noise_models_lower_the_loss(spark, toy):
    samples, features, x, y, *_ = toy
    kinds = ["normal", "bernoulli", "bernoulli_sq_hinge", "poisson", "ordinal3", "ordinal_sq_hinge3"]
    n = F.regexp_extract("feature_id", r"\d+", 0).cast("int")
    f = features.withColumn("distribution", F.array(*map(F.lit, kinds))[n % 6])
    raw = SM.simulate_data(x, y, SM.column_values(f, K, 3), noise=0.1, seed=9)
    counts = F.when(n % 6 == 3, F.floor(F.exp(F.least("value", F.lit(2.0))))).otherwise(F.col("value"))
    m = FactorModel(K).fit(raw.withColumn("value", counts), samples, f, epochs=8)
    losses = [h["total_loss"] for h in m.history if h["name"] == "epoch" and h["stage"] == "first"]
    assert losses[-1] < 0.9 * losses[0]
    assert m.transform(raw.withColumn("value", counts)).count() == 80 and m.impute().where("value is null").count() == 0


def test_batch_effects_in_the_model(spark, toy):
    samples, features, *_, gaps = toy
    n = F.regexp_extract("sample_id", r"\d+", 0).cast("int") % 3
    bmap = samples.select(F.lit("a").alias("view"), "sample_id", n.alias("batch"))
    shifted = gaps.withColumn("value", F.col("value") + F.when(F.col("view") == "a", 3 * n).otherwise(0))
    m = FactorModel(K).fit(shifted, samples, features, batch_map=bmap, epochs=8, batch_rounds=20)
    got = {r.batch: r.t for r in m.batch.groupBy("batch").agg(F.avg("theta").alias("t")).collect()}
    assert got[2] - got[0] == pytest.approx(6, abs=1.0)
    r = m.impute(batch_map=bmap).withColumnRenamed("value", "p").join(shifted, ["sample_id", "feature_id"]).agg(F.corr("p", "value")).first()[0]
    assert r > 0.95


def test_validation(spark, toy):
    samples, features, *_, gaps = toy
    with pytest.raises(ValueError, match="not unique"):
        FactorModel(K).fit(gaps, samples.unionByName(samples.limit(1)), features)
    with pytest.raises(ValueError, match="unknown distribution"):
        FactorModel(K).fit(gaps, samples, features.withColumn("distribution", F.lit("cauchy")))
    with pytest.raises(ValueError, match="needs feature sets"):
        FactorModel(K, prior="fsard").fit(gaps, samples, features)


def test_pca_baseline(toy):
    gaps = toy[-1]
    out = BL.pca_baseline(gaps, K)
    assert out["y"].shape == (2 * K, 24) and all(share.sum() > 0.9 for _, share in out["blocks"])
    z = BL.standardise(gaps, out["params"])
    x = BL.linear_transform(BL.wide_rows(z, out["ids"]), out["y"])
    assert x.count() == 80 and len(x.first().x) == 2 * K


def test_other_baselines(spark, toy):
    samples, features, *_, gaps = toy
    grid, med = BL.raw_baseline(gaps, samples, 1, 0.5)
    assert grid.where("value is null").count() == 0 and grid.count() == 80 * med.count()
    sets = features.select(F.col("view").alias("set_id"), "feature_id")
    assert BL.sample_rank_scores(gaps, sets).count() == 160
    from pyspark.ml.functions import array_to_vector

    rows = BL.wide_rows(grid, [r[0] for r in med.select("feature_id").orderBy("feature_id").collect()]).join(samples, "sample_id")
    train = rows.select(array_to_vector("vals").alias("features"), F.col("condition").cast("double").alias("label"))
    assert BL.random_forest(spark, train, "label", trees=5).transform(train).count() == 80


def test_scores(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((3, 20))
    assert E.span_similarity(a, a[[2, 0, 1]]) == pytest.approx(1, abs=1e-9) or E.span_similarity(a, a[[2, 0, 1]]) <= 1 + 1e-9
    assert E.best_match(E.squared_cosines(a, -2 * a[[2, 0, 1]])) == pytest.approx(1)
    own, null, p = E.permutation_p(spark, lambda t, f: E.best_match(E.squared_cosines(t, f)), a, a, n=40)
    assert own == pytest.approx(1) and null < 0.7 and p == 0
    q = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    assert E.procrustes(a, a).shape == a.shape and np.allclose(E.procrustes(a, a), a) and q.shape == (3, 3)
    # area under the curve from all pairs
    df = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(rng.integers(0, 6, 60), rng.integers(0, 2, 60), strict=True)], "s double, t boolean")
    rows = df.collect()
    pairs = [(p_.s > n_.s) + 0.5 * (p_.s == n_.s) for p_ in rows if p_.t for n_ in rows if not n_.t]
    assert E.binary_scores(df, "s", "t").first().auc == pytest.approx(np.mean(pairs))


def test_pieces_of_a_batch_hold_a_bounded_number_of_rows():
    import pyarrow as pa

    from strandloom.operators import sums as U
    from strandloom.operators.factor import Columns, RowSums
    from strandloom.operators.regularise import SamplePrior

    rng = np.random.default_rng(4)
    n, rows = 8, 5000
    d = rng.normal(size=(rows, n))
    b = pa.table({"idx": [list(range(n))] * rows, "vals": d.tolist()}).combine_chunks().to_batches()[0]
    pieces = list(U.slices(b, n))
    assert max(p.num_rows for p in pieces) <= 2048 and sum(p.num_rows for p in pieces) == rows
    assert max(p.num_rows for p in U.slices(b, 1 << 14)) == 128  # many features: as many cells as before
    assert np.array_equal(np.concatenate([U.dense(p, n) for p in pieces]), d)
    c = Columns(rng.normal(size=(2, n)), np.ones(n), np.zeros(n), np.ones(n), [("normal", np.arange(n))], (np.zeros(n), np.zeros(n)))
    whole, parts = (RowSums(c, SamplePrior(np.ones(2))) for _ in range(2))
    whole.add(d, [None] * rows)
    for p in pieces:
        parts.add(U.dense(p, n), [None] * p.num_rows)
    assert np.allclose(whole.table, parts.table, rtol=1e-12, atol=1e-8)
