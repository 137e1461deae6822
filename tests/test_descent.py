"""Optimisers whose state sits beside the rows, against dense runs on driver arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import descent as D
from strandloom.operators import optimise as O
from strandloom.operators.factor import FactorModel
from strandloom.operators.regularise import GroupRidge, SamplePrior

K = 2


@pytest.fixture(scope="module")
def problem(spark):
    """A small model with three noise kinds, values missing, and its dense loss."""
    rng = np.random.default_rng(0)
    kinds = ["normal"] * 4 + ["bernoulli"] * 3 + ["poisson"] * 2
    z = rng.normal(size=(30, K)) @ rng.normal(0, 0.6, (K, 9))
    d = np.where(np.array(kinds) == "normal", z + rng.normal(size=z.shape), np.where(np.array(kinds) == "bernoulli", rng.random(z.shape) < 1 / (1 + np.exp(-z)), rng.poisson(np.exp(np.minimum(z, 2)))))
    d[rng.random(d.shape) < 0.2] = np.nan
    rows = [(f"s{i:02d}", f"f{j}", kinds[j], float(d[i, j])) for i in range(30) for j in range(9) if np.isfinite(d[i, j])]
    obs = spark.createDataFrame(rows, "sample_id string, feature_id string, view string, value double")
    who = spark.createDataFrame([(f"s{i:02d}", "ab"[i % 2]) for i in range(30)], "sample_id string, condition string")
    m = FactorModel(K)
    m._start(obs, spark.createDataFrame([(f"f{j}", k, k) for j, k in enumerate(kinds)], "feature_id string, view string, distribution string"), 1, False)
    order = [int(f[1:]) for f in m.features["feature_id"]]
    prior, y_prior = SamplePrior.of(K, 0.3, ["a", "b"], 0.5), GroupRidge.of(m.features["view"].to_numpy(), K, 0.7)
    c = m._columns().at([])
    ridge = prior.weights(["ab"[i % 2] for i in range(30)], K)
    x0 = np.random.default_rng(2).normal(size=(30, K))

    def dense(v):
        x, y = v[: 30 * K].reshape(30, K), v[30 * K :].reshape(K, 9)
        own = D.replace(c, y=y)
        gx, gy = D.Gradient.slopes(own, d[:, order], ridge, x)
        return D.Gradient.loss(own, d[:, order], ridge, x) + y_prior.value(y), np.concatenate([gx.ravel(), (gy + y_prior.gradient(y)).ravel()])

    factors = spark.createDataFrame([(f"s{i:02d}", x0[i].tolist()) for i in range(30)], "sample_id string, x array<double>")
    rows = m.rows(obs, who)
    state = lambda **columns: D.with_state(rows, factors, **columns)
    return m, prior, y_prior, state, dense, np.concatenate([x0.ravel(), m.y.ravel()])


def _x(state):
    return np.array([r.x for r in state.orderBy("sample_id").collect()])


def test_gradient(problem):
    *_, dense, start = problem
    _, g = dense(start)
    for i in (0, 7, 59, 60, 70, 77):
        e = np.zeros_like(start)
        e[i] = 1e-6
        assert (dense(start + e)[0] - dense(start - e)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-6)


def test_adagrad_equals_a_dense_run(problem):
    m, prior, y_prior, state, dense, start = problem
    got, y, losses = D.fit_adagrad(state(acc=K), m._columns(), prior, y_prior, epochs=4, rate=0.2, tolerance=0)
    p, opt = {"v": start.copy()}, O.AdaGrad(0.2)
    want = []
    for _ in range(4):
        f, g = dense(p["v"])
        want.append(f)
        opt.step(p, {"v": g})
    assert losses == pytest.approx(want, rel=1e-9)
    assert np.allclose(_x(got), p["v"][:60].reshape(30, K)) and np.allclose(y, p["v"][60:].reshape(K, 9))


@pytest.mark.parametrize("memory", [2, 10])
def test_lbfgs_equals_a_dense_run(problem, memory):
    m, prior, y_prior, state, dense, start = problem
    got, y, losses = D.fit_lbfgs(state(g=K, past=0), m._columns(), prior, y_prior, memory=memory, rounds=5)
    v, want = O.lbfgs(dense, start, memory=memory, rounds=5)
    assert losses == pytest.approx(want, rel=1e-8)
    assert np.allclose(_x(got), v[:60].reshape(30, K), atol=1e-6) and np.allclose(y, v[60:].reshape(K, 9), atol=1e-6)


def test_lbfgs_with_fixed_features(problem):
    """Rows are then independent: every factor is its row's own best."""
    m, prior, _, state, _, _ = problem
    got, y, losses = D.fit_lbfgs(state(g=K, past=0), m._columns(), prior, None, rounds=25, rel_tol=1e-12)
    m.x_prior = prior
    best = {r.sample_id: r.x for r in m._factors(got, prior).collect()}
    assert np.array_equal(y, m.y) and np.allclose(_x(got), [best[s] for s in sorted(best)], atol=1e-3)
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:], strict=False))


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(3)
    for pairs in (0, 1, 4):
        a = rng.normal(size=(9, 9))
        a = a @ a.T + np.eye(9)
        s = rng.normal(size=(pairs, 9))
        basis = np.concatenate([s, s @ a, rng.normal(size=(1, 9))])
        d = D.direction(basis @ basis.T, pairs) @ basis
        h = np.eye(9) * ((s[-1] @ a @ s[-1]) / (s[-1] @ a @ a @ s[-1]) if pairs else 1.0)
        for v in s:
            y, rho = a @ v, 1 / (v @ a @ v)
            h = (np.eye(9) - rho * np.outer(v, y)) @ h @ (np.eye(9) - rho * np.outer(y, v)) + rho * np.outer(v, v)
        assert np.allclose(d, -h @ basis[-1])


def test_samples_without_a_factor_start_at_zero(spark, problem):
    m, prior, _, state, _, _ = problem
    rows = state().drop("x")
    some = spark.createDataFrame([("s03", [1.0, 2.0])], "sample_id string, x array<double>")
    x = {r.sample_id: r.x for r in D.with_state(rows, some, acc=K).collect()}
    assert x["s03"] == [1.0, 2.0] and x["s04"] == [0.0, 0.0] and len(x) == 30
    none, y, losses = D.fit_adagrad(D.with_state(rows.where("false"), some, acc=K), m._columns(), prior, epochs=3)
    assert none.count() == 0 and losses[0] == 0
    assert rows.agg(F.count("*")).first()[0] == 30


def test_fit_may_start_by_lbfgs(spark, problem):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(40, 1)) @ rng.normal(size=(1, 6))
    obs = spark.createDataFrame([(f"s{i}", f"f{j}", "v", float(z[i, j] + 0.1 * rng.normal())) for i in range(40) for j in range(6)], "sample_id string, feature_id string, view string, value double")
    feats = spark.createDataFrame([(f"f{j}", "v", "normal") for j in range(6)], "feature_id string, view string, distribution string")
    who = obs.select("sample_id").distinct()
    m = FactorModel(1).fit(obs, who, feats, epochs=10, lbfgs_rounds=6)
    note = next(h for h in m.history if h["name"] == "lbfgs")
    first = next(h for h in m.history if h.get("stage") == "first")
    assert note["total_loss"] < note["first_loss"] and first["total_loss"] <= note["total_loss"] * 1.001
