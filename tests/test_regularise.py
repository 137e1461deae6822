"""Priors and fits on driver arrays: derivatives, majorisers, stationary points."""

import numpy as np
import pandas as pd
import pytest

from strandloom.functions.strings import option_value, options
from strandloom.operators import graph as G
from strandloom.operators import regularise as P
from strandloom.operators.factor import FactorModel, RowSums, Selection, column_estimates, noise_terms
from strandloom.operators.sums import join_rows, split_rows

K, N = 3, 8
VIEWS = np.array(["a"] * 5 + ["b"] * 3)
IDS = [f"f{i}" for i in range(N)]
GRAPHS = [[("f0", "f1", 1.0), ("f1", "v", -1.0), ("v", "w", 1.0), ("w", "f4", 2.0)], [("f2", "f3", 1.0)], []]


def _sets():
    rng = np.random.default_rng(1)
    prior = P.FeatureSets(sets={"a": (np.arange(5), rng.random((4, 5))), "b": (np.arange(5, 8), rng.random((2, 3)))}, names={"a": list("pqrs"), "b": list("tu")})
    prior.start(K, N)
    prior.assign = {v: rng.random(a.shape) for v, a in prior.assign.items()}
    for view, (cols, s) in prior.sets.items():
        prior.beta[:, cols] = (prior.alpha0 - 1) * (prior.v0 + prior.assign[view].T @ s)
    return prior


def _priors():
    place = {f: i for i, f in enumerate(IDS)}
    return {
        "ridge": P.Ridge(np.array([1.0, 0.5, 2.0])),
        "group": P.GroupRidge(VIEWS, {"a": np.array([1.0, 2.0, 3.0]), "b": np.array([0.1, 0.2, 0.3])}),
        "l1": P.SelectiveL1(np.arange(K * N).reshape(K, N) % 2 == 0, np.array([1.0, 0.5, 2.0])),
        "network": P.Network([P.Graph.of(g, place) for g in GRAPHS], np.array([1.0, 0.5, 2.0])),
        "relevance": P.Relevance(1.001, 0.3),
        "sets": _sets(),
        "mixture": P.feature_prior(K, VIEWS, IDS, l2=1.0, selective_l1=0.5, network=0.7, graphs=GRAPHS),
    }


@pytest.mark.parametrize("name", sorted(_priors()))
def test_gradients_and_majorisers(name):
    prior, rng = _priors()[name], np.random.default_rng(2)
    y = rng.standard_normal((K, N)) + 0.1
    g = prior.gradient(y)
    for i in np.ndindex(K, N):
        up, down = y.copy(), y.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert (prior.value(up) - prior.value(down)) / 2e-6 == pytest.approx(g[i], abs=2e-4, rel=1e-4)
    c = prior.curvature(y)
    for size in (0.01, 0.3, 2.0):
        d = size * rng.standard_normal((K, N))
        assert prior.value(y + d) <= prior.value(y) + (g * d).sum() + 0.5 * (c * d * d).sum() + 1e-9


def test_reweighting():
    y = np.random.default_rng(3).standard_normal((K, N))
    p = _priors()
    for prior in p.values():
        prior.reweight(y)
    assert p["ridge"].weight == pytest.approx(1 / np.linalg.svd(y, compute_uv=False)[0] ** 2)
    assert p["group"].weight["b"] == pytest.approx(1 / np.linalg.svd(y[:, 5:], compute_uv=False)[0] ** 2)
    mask = np.arange(K * N).reshape(K, N) % 2 == 0
    assert p["l1"].weight == pytest.approx(np.sqrt(2 / np.var(y * mask, axis=1, ddof=1)))
    assert p["network"].weight == pytest.approx(1 / np.var(y, axis=1, ddof=1))
    assert (p["relevance"].alpha, p["relevance"].beta) == (0.001, 0.001)
    order = np.array([2, 0, 1])
    for prior in _priors().values():
        before = prior.value(y)
        prior.reorder(order)
        assert prior.value(y[order]) == pytest.approx(before)


def test_graph_equals_the_dense_form():
    edges = [("a", "b", 1.0), ("b", "c", -2.0), ("c", "d", 1.0), ("d", "d", -1.0), ("d", "e", 0.5)]
    seen = ["a", "c", "e"]
    aa, ab, bb, _ = G.laplacian_blocks(edges, seen, 0.1)
    x = np.array([0.3, -1.2, 0.7])
    want = G.quadratic_with_virtual(aa, ab, bb, x)
    graph = P.Graph.of(edges, {v: i for i, v in enumerate(seen)})
    loss, grad = graph.solve(x[graph.column])
    assert loss == pytest.approx(want[0]) and grad == pytest.approx(want[1][graph.column])
    assert graph.diagonal()[: len(graph.column)] == pytest.approx(np.diag(aa)[graph.column])


def test_assignment_finds_the_sets():
    rng = np.random.default_rng(4)
    s = np.kron(np.eye(5), np.ones(6)) / np.sqrt(6)
    y = np.zeros((2, 30))
    y[0, :6], y[1, 12:18] = rng.choice([-1, 1], 6), rng.choice([-1, 1], 6)
    y += 0.01 * rng.standard_normal(y.shape)
    prior = P.FeatureSets(sets={"v": (np.arange(30), s)}, names={"v": list("abcde")})
    prior.start(2, 30)
    assert prior.update(y) > 0
    a = prior.assign["v"]
    assert (a >= 0).all() and a[:, 0].argmax() == 0 and a[:, 1].argmax() == 2 and a[0, 0] > 0 and a[2, 1] > 0
    assert P.gamma_normal(a, s, y, prior.alpha, prior.alpha0, prior.v0)[0] < P.gamma_normal(0 * a, s, y, prior.alpha, prior.alpha0, prior.v0)[0]


def test_column_estimates_are_stationary():
    for kind, levels in (("bernoulli_sq_hinge", [[0, 3, 9], [0, 5, 5]]), ("ordinal3", [[4, 5, 6], [1, 9, 2]]), ("ordinal_sq_hinge3", [[4, 5, 6], [7, 1, 2]])):
        n, cuts = np.array(levels, float), (np.full(2, -1.0), np.full(2, 1.0))
        mu = column_estimates(kind, n, cuts)
        values = [0.0, 0.0, 1.0] if kind == "bernoulli_sq_hinge" else [1.0, 2.0, 3.0]
        slope = sum(n[:, i] * noise_terms(kind, mu, np.full(2, v), cuts)[1] for i, v in enumerate(values))
        assert slope == pytest.approx(0, abs=1e-6)


class Local(FactorModel):
    """Passes over an array in this process."""

    def _pass(self, rows, y=None):
        sums = RowSums(self._columns(y), self.x_prior)
        for part, conditions in rows:
            sums.add(part, conditions)
        return RowSums.gathered(sums.chunks(), *self.y.shape)


def _local(kinds, prior, x_prior, seed=0, k=4):
    rng = np.random.default_rng(seed)
    n, m = len(kinds), 60
    z = rng.standard_normal((m, 2)) @ rng.standard_normal((2, n))
    d = z + 0.1 * rng.standard_normal((m, n))
    for j, kind in enumerate(kinds):
        d[:, j] = {"bernoulli": d[:, j] > 0, "poisson": np.floor(np.exp(np.clip(d[:, j], -3, 2))), "bernoulli_sq_hinge": d[:, j] > 0, "ordinal3": 1 + (d[:, j] > -1) + (d[:, j] > 1), "ordinal_sq_hinge3": 1 + (d[:, j] > -1) + (d[:, j] > 1)}.get(kind, d[:, j])
    d[rng.random(d.shape) < 0.1] = np.nan
    f = pd.DataFrame({"feature_id": [f"f{j}" for j in range(n)], "view": "a", "distribution": kinds, "mu": 0.0, "logsigma": 0.0, "weight": 1.0, "cut1": -1.0, "cut2": 1.0})
    model = Local(k, features=f, y=0.3 * rng.standard_normal((k, n)), y_prior=prior, x_prior=x_prior)
    return model, [(d[:30], ["p"] * 30), (d[30:], ["q", None] * 15)]


KINDS = ["normal"] * 6 + ["bernoulli", "poisson", "bernoulli_sq_hinge", "ordinal3", "ordinal_sq_hinge3"]


@pytest.mark.parametrize("kinds", [["normal"] * 10, KINDS])
@pytest.mark.parametrize("prior", [P.Ridge(np.full(4, 0.5)), P.Relevance()])
def test_fits_end_where_the_gradient_is_zero(kinds, prior):
    model, rows = _local(kinds, prior, P.SamplePrior(np.ones(4), {"p": np.full(4, 0.5), "q": np.full(4, 2.0)}))
    s = model._descend(rows, 3000, 1e-13, "fit")
    totals = [h["total_loss"] for h in model.history if h["name"] == "epoch"]
    slope = s.b.T + model.y_prior.gradient(model.y)
    assert min(totals) < totals[0] and np.abs(slope).max() < 2e-2
    # the slope is that of the total loss with every sample's factor at its best
    at = model.y + 0.2 * np.random.default_rng(5).standard_normal(model.y.shape)
    s = model._pass(rows, at)
    slope = s.b.T + model.y_prior.gradient(at)
    total = lambda y: model._total(model._pass(rows, y), y)
    for i in [(0, 0), (1, 6), (3, len(kinds) - 1)]:
        step = np.zeros_like(at)
        step[i] = 1e-5
        assert (total(at + step) - total(at - step)) / 2e-5 == pytest.approx(slope[i], rel=2e-2, abs=2e-3)


def test_relevance_prior_leaves_few_entries():
    small = {}
    for name, prior in (("ridge", P.Ridge(np.full(4, 1e-3))), ("relevance", P.Relevance(0.001, 0.001))):
        model, rows = _local(["normal"] * 12, prior, P.SamplePrior(np.full(4, 0.1)))
        model._descend(rows, 400, 1e-9, "fit")
        small[name] = (np.abs(model.y) < 0.02 * np.abs(model.y).max()).mean()
    assert small["relevance"] > 2 * small["ridge"] + 0.1


def test_frozen_layers_and_selection():
    prior = P.LayerPriors.of(VIEWS, np.array(["x", "x", "y"]), 2.0)
    params = {"mu": np.arange(8.0), "logsigma": np.ones(8), "theta": np.array([1.0, 2.0, 3.0]), "logdelta": np.zeros(3)}
    whole = prior.value(params)
    prior.freeze("mu")
    assert prior.value(params) == pytest.approx(whole - (np.arange(8.0) ** 2).sum()) and not prior.gradient(params)["mu"].any()
    prior.reweight(params)
    assert prior.priors["mu"].centre["a"] == 0 and prior.priors["theta"].weight["y"] == 1.5 and prior.priors["theta"].weight["x"] == pytest.approx(2.0)
    prior.unfreeze()
    assert prior.gradient(params)["mu"].any()
    model = FactorModel(2, features=pd.DataFrame({"a": [1]}), y=np.ones((2, 3)))
    pick = Selection(lambda m: [0.9, 0.8], 0.7)
    pick(model, 5.0)
    model.y = model.y * 2
    pick(model, 6.0)
    assert pick.loss == 5.0 and (pick.kept[0] == 1).all()


def test_chunks_of_a_table():
    table = np.random.default_rng(0).random((1000, 30))
    assert (join_rows("t", split_rows("t", table), table.shape) == table).all() and len(split_rows("t", table)) > 1


def test_options():
    assert [option_value(v) for v in ("1", "0.5", "true", "a", "1:2.5:b", "nothing")] == [1, 0.5, True, "a", [1, 2.5, "b"], None]
    assert options({"k": 1, "rate": 2}, ["--k=5"]) == {"k": 5, "rate": 2}
    with pytest.raises(ValueError, match="unknown option"):
        options({"k": 1}, ["j=5"])
