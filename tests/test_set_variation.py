"""Gene set variation and areas of many classes, against brute force."""

import math

import numpy as np
import pytest

from strandloom.operators import baselines as BL
from strandloom.operators import evaluate as E


def _exact(values: np.ndarray, sets: dict, tau: float, difference: bool) -> dict:
    """From the definition: all features walked, kernel sums over all samples."""
    n, p = values.shape
    h = values.std(axis=0, ddof=1) / 4
    phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    z = np.stack([phi((values[:, None, j] - values[None, :, j]) / h[j]).mean(axis=1) for j in range(p)], axis=1)
    out = {}
    for i in range(n):
        order = np.argsort(-z[i], kind="stable")
        weight = np.abs(p / 2 - np.arange(p)) ** tau
        for name, members in sets.items():
            inside = np.isin(order, members)
            walk = np.cumsum(np.where(inside, weight, 0)) / weight[inside].sum() - np.cumsum(~inside) / max(1, (~inside).sum())
            high, low = max(walk.max(), 0), min(walk.min(), 0)
            out[f"s{i}", name] = high + low if difference else (high if high >= -low else low)
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(40, 30)) * rng.uniform(0.5, 20, 30) + rng.normal(0, 50, 30)
    spread = values.std(axis=0)
    values[:20, :6] += 2 * spread[:6]  # the first set is up in the first half
    sets = {"up": list(range(6)), "mixed": [1, 9, 17, 25], "one": [12]}
    obs = spark.createDataFrame([(f"s{i}", f"f{j:02d}", float(values[i, j])) for i in range(40) for j in range(30)], "sample_id string, feature_id string, value double")
    members = spark.createDataFrame([(s, f"f{j:02d}") for s, js in sets.items() for j in js] * 2, "set_id string, feature_id string")
    return obs, members, values, sets


@pytest.mark.parametrize(("tau", "difference"), [(1.0, True), (0.5, False)])
def test_scores_approach_the_definition(planted, tau, difference):
    obs, members, values, sets = planted
    got = {(r.sample_id, r.set_id): r.score for r in BL.gsva(obs, members, per_bandwidth=64, tau=tau, difference=difference).collect()}
    want = _exact(values, sets, tau, difference)
    assert got.keys() == want.keys()
    gaps = np.abs([got[k] - want[k] for k in want])
    assert np.quantile(gaps, 0.95) < 0.02 and gaps.mean() < 0.01  # a tie of two places may turn


def test_planted_set_stands_out(planted):
    obs, members, *_ = planted
    got = {r.sample_id: r.score for r in BL.gsva(obs, members.where("set_id = 'up'")).collect()}
    first, second = ([got[f"s{i}"] for i in own] for own in (range(20), range(20, 40)))
    assert min(np.median(first), 0.3) > 0 > np.median(second)


def test_walk_by_members_is_the_walk_over_all(spark):
    """Given places, the score is exact; also for a set of all features, of none and with repeated members."""
    rng = np.random.default_rng(1)
    z = rng.permutation(12) / 12.0
    places = spark.createDataFrame([("s", f"f{j:02d}", float(z[j])) for j in range(12)], "sample_id string, feature_id string, z double")
    sets = {"a": [0, 3, 4], "all": list(range(12)), "b": [11, 2]}
    members = spark.createDataFrame([(s, f"f{j:02d}") for s, js in sets.items() for j in js] + [("none", "x"), ("a", "f00")], "set_id string, feature_id string")
    got = {r.set_id: r.score for r in BL.set_variation(places, members).collect()}
    order = np.argsort(-z)
    for name, own in sets.items():
        inside, w = np.isin(order, own), np.abs(6.0 - np.arange(12))
        walk = np.cumsum(np.where(inside, w, 0)) / w[inside].sum() - np.cumsum(~inside) / max(1, (~inside).sum())
        assert got[name] == pytest.approx(max(walk.max(), 0) + min(walk.min(), 0))
    assert set(got) == set(sets)
    assert {r.set_id for r in BL.set_variation(places, members, least=3).collect()} == {"a", "all"}


def test_smoothing_of_odd_columns(spark):
    rows = [(f"s{i}", "same", 1.0) for i in range(4)] + [("s0", "once", 2.0), ("s0", "gap", None), ("s1", "gap", 5.0), ("s2", "gap", 7.0), ("s3", "far", 1e12), ("s2", "far", 0.0), ("s1", "far", 1.0)]
    got = BL.smoothed_distribution(spark.createDataFrame(rows, "sample_id string, feature_id string, value double")).collect()
    z = {(r.feature_id, r.sample_id): r.z for r in got}
    assert set(z) == {("gap", "s1"), ("gap", "s2"), ("far", "s1"), ("far", "s2"), ("far", "s3")}
    assert z["gap", "s1"] < 0.5 < z["gap", "s2"] and z["far", "s3"] > 0.6 and all(0 <= v <= 1 for v in z.values())
    assert BL.gsva(spark.createDataFrame([], "sample_id string, feature_id string, value double"), spark.createDataFrame([], "set_id string, feature_id string")).count() == 0


def test_normal_cdf():
    x = np.linspace(-8, 8, 401)
    assert np.abs(BL.normal_cdf(x) - np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))(x)).max() < 1.5e-7


def _area(positive, negative):
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in positive for b in negative]))


def test_areas_of_many_classes(spark):
    rng = np.random.default_rng(2)
    y = rng.choice([0, 1, 3], 60)  # class 2 does not occur
    s = np.round(rng.random((60, 4)) + 0.4 * (y[:, None] == np.arange(4)), 1)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, s, strict=True)] + [(None, [0.0] * 4)], "y int, s array<double>")
    got = E.multiclass_auc(df, "y", "s").first()
    classes = [0, 1, 3]
    assert got.auc_ovr == pytest.approx(np.mean([_area(s[y == c, c], s[y != c, c]) for c in classes]))
    pairs = [(_area(s[y == a, a], s[y == b, a]) + _area(s[y == b, b], s[y == a, b])) / 2 for i, a in enumerate(classes) for b in classes[i + 1 :]]
    assert got.auc_ovo == pytest.approx(np.mean(pairs))
    one = E.multiclass_auc(df.where("y = 1"), "y", "s").first()
    assert one.auc_ovr is None and one.auc_ovo is None


def test_members_of_sets_are_not_sorted_by_spark(spark):
    """Each sample with each member of each set is the largest table of the job; it is laid out in the tasks only."""
    rows = [(s, f"f{f}", float((s * 7 + f * 3) % 11)) for s in range(5) for f in range(6)]
    places = spark.createDataFrame([*rows, (0, "f1", 2.5)], "sample_id int, feature_id string, z double")  # one feature twice
    sets = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f9"), ("all", "f0"), *(("all", f"f{f}") for f in range(6))], "set_id string, feature_id string")
    out = BL.set_variation(places, sets)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [w for w in plan.split("windowspecdefinition(")[1:] if "set_id" in w.split("specifiedwindowframe")[0]]
    got = {(r.sample_id, r.set_id): r.score for r in out.collect()}
    assert set(got) == {(s, n) for s in range(5) for n in ("a", "all")} and got[0, "all"] == 1.0
