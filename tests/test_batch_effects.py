"""Batch effects under every noise model, and the joint refit of all layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import batch as B
from strandloom.operators.factor import BatchLayers, FactorModel
from strandloom.operators.regularise import LAYERS


def _draw(rng, kind, z):
    if kind == "normal":
        return z + rng.normal()
    if kind == "poisson":
        return float(rng.poisson(np.exp(z)))
    p = 1 / (1 + np.exp(-z))
    if kind.startswith("bernoulli"):
        return float(rng.random() < p)
    u = rng.logistic()
    return 1.0 + (z + u > -1) + (z + u > 1)


def _planted(spark, kind, samples=600, features=8, batches=3, seed=0):
    rng = np.random.default_rng(seed)
    shift = rng.normal(0, 0.8, (batches, features))
    shift -= shift.mean(axis=0)
    mean = rng.normal(0, 0.4, (2, features))
    rows = [(f"s{i}", f"f{j}", "v", float(_draw(rng, kind, mean[i // 3 % 2, j] + shift[i % 3, j]))) for i in range(samples) for j in range(features)]
    obs = spark.createDataFrame(rows, "sample_id string, feature_id string, view string, value double")
    who = spark.createDataFrame([(f"s{i}", f"c{i // 3 % 2}") for i in range(samples)], "sample_id string, condition string")
    bmap = spark.createDataFrame([("v", f"s{i}", i % 3) for i in range(samples)], "view string, sample_id string, batch int")
    feats = spark.createDataFrame([(f"f{j}", "v", kind) for j in range(features)], "feature_id string, view string, distribution string")
    return obs, who, bmap, feats, shift


@pytest.mark.parametrize("kind", ["normal", "bernoulli", "poisson", "ordinal3", "bernoulli_sq_hinge", "ordinal_sq_hinge3"])
def test_planted_shifts_are_found(spark, kind):
    obs, who, bmap, feats, shift = _planted(spark, kind)
    fit, rounds = B.fit_batch_effects(obs, bmap, who, feats)
    got = np.zeros_like(shift)
    for r in fit.collect():
        got[r.batch, int(r.feature_id[1:])] = r.theta
        assert np.isfinite(r.logdelta)
    assert 1 <= rounds <= 100 and np.corrcoef(got.ravel(), shift.ravel())[0, 1] > 0.93
    if "hinge" not in kind:  # those scales are the loss's own
        assert np.abs(got - shift).max() < 0.6 and np.abs(got - shift).mean() < 0.2


def test_normal_rounds_are_the_closed_form(spark):
    obs, who, bmap, feats, _ = _planted(spark, "normal", samples=60)
    state = B.em_round(B.least_squares_start(B.residual_statistics(obs, bmap, who)))
    state = B.em_round(state)
    want = {(r.batch, r.feature_id): (r.theta, r.delta2) for r in state.collect()}
    for r in B.fit_batch_effects(obs, bmap, who, rounds=2, tolerance=-1.0)[0].collect():
        assert (r.theta, np.exp(2 * r.logdelta)) == pytest.approx(want[r.batch, r.feature_id], rel=1e-7)


def test_methods_of_batch_effects(spark):
    obs, who, bmap, feats, _ = _planted(spark, "bernoulli", samples=90)
    fits = {m: {(r.batch, r.feature_id): r.theta for r in B.fit_batch_effects(obs, bmap, who, feats, method=m)[0].collect()} for m in ("EM", "EB", "LS")}
    spread = {m: np.var(list(f.values())) for m, f in fits.items()}
    assert spread["EM"] < spread["EB"] < spread["LS"]  # once-estimated priors shrink less
    with pytest.raises(ValueError, match="unknown method"):
        B.fit_batch_effects(obs, bmap, who, feats, method="x")


def test_newton_start_has_no_slope(spark):
    """Without rounds the shifts are those of least loss, from the rows themselves."""
    obs, who, bmap, feats, _ = _planted(spark, "poisson", samples=90, features=3)
    got = {(r.batch, r.feature_id): r.theta for r in B.fit_batch_effects(obs, bmap, who, feats, rounds=0)[0].collect()}
    own = obs.join(who, "sample_id").join(bmap, ["view", "sample_id"]).toPandas()
    base = own.groupby(["feature_id", "condition"])["value"].agg(lambda v: np.log((v.sum() + 0.5) / len(v)))
    for (b, f), g in own.groupby(["batch", "feature_id"]):
        z = np.array([base[f, c] for c in g["condition"]]) + got[b, f]
        assert abs((np.exp(z) - g["value"]).sum()) < 1e-6


def test_edges_of_batch_effects(spark):
    rows = [("s0", "f0", "v", 1.0), ("s1", "f0", "v", 1.0), ("s2", "f0", "v", None), ("s3", "f0", "v", 0.0), ("s4", "f0", "w", 1.0), ("s9", "f0", "v", 1.0)]
    obs = spark.createDataFrame(rows, "sample_id string, feature_id string, view string, value double").withColumn("n", F.lit(1)).withColumn("batch", F.lit(7))
    who = spark.createDataFrame([(f"s{i}", None if i else "c") for i in range(5)], "sample_id string, condition string")
    bmap = spark.createDataFrame([("v", "s0", 1), ("v", "s1", 1), ("v", "s3", 2)], "view string, sample_id string, batch int")
    feats = spark.createDataFrame([("f0", "v", "bernoulli")], "feature_id string, view string, distribution string")
    got = {r.batch: r for r in B.fit_batch_effects(obs, bmap, who, feats)[0].collect()}
    assert set(got) == {1, 2} and all(np.isfinite([r.theta, r.logdelta]).all() for r in got.values())  # all of a batch alike
    none = B.fit_batch_effects(obs.where("false"), bmap, who, feats)
    assert none[0].count() == 0 and none[1] == 0


@pytest.fixture(scope="module")
def mixed(spark):
    """A factor, batch shifts in view a (0/1) and c (normal, also scaled), none in b."""
    rng = np.random.default_rng(5)
    n, per = 150, 6
    x, kinds = rng.normal(size=n), {"a": "bernoulli", "b": "poisson", "c": "normal"}
    shift = {"a": rng.normal(0, 1, (2, per)), "c": rng.normal(0, 1, (2, per)), "b": np.zeros((2, per))}
    rows = []
    for v, kind in kinds.items():
        y = rng.normal(0, 0.7, per)
        rows += [(f"s{i}", f"{v}{j}", v, float(_draw(rng, kind, x[i] * y[j] * (1.5 if v == "c" and i % 2 else 1.0) + shift[v][i % 2, j]))) for i in range(n) for j in range(per)]
    obs = spark.createDataFrame(rows, "sample_id string, feature_id string, view string, value double")
    who = spark.createDataFrame([(f"s{i}",) for i in range(n)], "sample_id string").withColumn("condition", F.lit("c"))
    feats = spark.createDataFrame([(f"{v}{j}", v, k) for v, k in kinds.items() for j in range(per)], "feature_id string, view string, distribution string")
    bmap = spark.createDataFrame([(v, f"s{i}", f"b{i % 2}") for v in "ac" for i in range(n)], "view string, sample_id string, batch string")
    return obs.cache(), who, feats, bmap, shift


def test_layer_slopes_are_derivatives(spark, mixed):
    obs, who, feats, bmap, _ = mixed
    m = FactorModel(1).fit(obs.where("sample_id like 's1%'"), who.where("sample_id like 's1%'"), feats, batch_map=bmap, epochs=2, batch_rounds=3)
    rows = m.rows(obs.where("sample_id like 's1%'"), who, bmap)
    s = m._pass(rows)
    rng = np.random.default_rng(0)
    for name in LAYERS:
        v = m.layer_values()[name].copy()
        for i in rng.choice(len(v), 2, replace=False):
            losses = []
            for e in (1e-4, -1e-4):
                w = v.copy()
                w[i] += e
                m._set_layer(name, w)
                t = m._pass(rows)
                losses.append(t.loss.sum() + t.penalty)  # samples are at their best, so this is the slope too
            m._set_layer(name, v)
            assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(s.layers[name][0][i], rel=2e-2, abs=2e-3)


def test_joint_refit_leaves_no_slope(spark, mixed):
    obs, who, feats, bmap, shift = mixed
    m = FactorModel(1)
    m.freeze("logsigma")
    kept = []
    real = m._joint

    def joint(rows, epochs, tolerance):
        kept.append(m.layer_values()["logsigma"].copy())
        s = real(rows, 40, 1e-9)
        kept.extend([m.layer_values(), m.layer_priors, s])
        return s

    m._joint = joint
    m.fit(obs, who, feats, batch_map=bmap, epochs=15, batch_rounds=20, joint=True)
    before, values, priors, s = kept
    assert np.array_equal(before, values["logsigma"])
    for name in ("mu", "theta", "logdelta"):
        slope = s.layers[name][0] + priors.priors[name].gradient(values[name])
        assert np.abs(slope).max() < 0.05 * np.sqrt(np.abs(s.layers[name][1]).max()), name
    turns = [h for h in m.history if h["name"] == "joint"]
    losses = [h["total_loss"] for h in turns]
    assert len(turns) > 1 and all(b <= a + 1e-6 for a, b in zip(losses, losses[1:], strict=False)) and turns[-1]["gradient"] < 0.2 * turns[0]["gradient"] + 0.05
    got = {(r.view, r.batch, r.feature_id): r.theta for r in m.batch.collect()}
    for v in "ac":
        gap = np.array([got[v, "b1", f"{v}{j}"] - got[v, "b0", f"{v}{j}"] for j in range(6)])
        assert np.corrcoef(gap, shift[v][1] - shift[v][0])[0, 1] > 0.9


def test_model_with_batches_keeps_its_values(spark, mixed, tmp_path):
    obs, who, feats, bmap, _ = mixed
    m = FactorModel(1).fit(obs, who, feats, batch_map=bmap, epochs=4, batch_rounds=5)
    m.save(spark, str(tmp_path / "m"))
    again = FactorModel.load(spark, str(tmp_path / "m"))
    assert isinstance(again.batches, BatchLayers) and again.batches.names == [["b0", "b1"], ["b0", "b1"]]
    a, b = ({r.sample_id: r.x[0] for r in k.transform(obs.where("sample_id < 's2'"), bmap).collect()} for k in (m, again))
    assert a == pytest.approx(b)
    corr = m.impute(batch_map=bmap).withColumnRenamed("value", "p").join(obs.where("view = 'c'"), ["sample_id", "feature_id"]).agg(F.corr("p", "value")).first()[0]
    assert corr > 0.7
