"""Survival forests: statistic and hazard by hand, one tree by brute force, risks that are not linear."""

import numpy as np
import pytest

from strandloom.operators import survival as V


def _rank(time, dead, left):
    """Log-rank statistic from the rows."""
    top = under = 0.0
    for t in np.unique(time[dead]):
        y, yl, d, dl = (time >= t).sum(), ((time >= t) & left).sum(), ((time == t) & dead).sum(), ((time == t) & dead & left).sum()
        top += dl - yl * d / y
        if y > 1:
            under += yl / y * (1 - yl / y) * (y - d) / (y - 1) * d
    return top * top / under if under > 1e-12 else 0.0


def _table(spark, x, time, dead):
    return spark.createDataFrame([(f"s{i}", float(time[i]), int(dead[i]), x[i].tolist()) for i in range(len(x))], "sample_id string, time double, event int, x array<double>")


def test_statistic_equals_the_rows():
    rng = np.random.default_rng(0)
    time, dead, side = rng.integers(0, 6, 50), rng.random(50) < 0.7, rng.integers(0, 3, 50)
    counts = np.zeros((2, 3, 6))
    np.add.at(counts[1], (side, time), 1)
    np.add.at(counts[0], (side, time), dead)
    left = np.cumsum(counts, axis=1).transpose(1, 0, 2)[:-1]
    got = V.log_rank(left, counts.sum(axis=1))
    assert got == pytest.approx([_rank(time, dead, side <= c) for c in (0, 1)])
    assert V.hazard(np.array([[1.0, 0.0, 2.0], [1.0, 1.0, 3.0]])) == pytest.approx([1 / 5, 1 / 5, 1 / 5 + 2 / 3])


def test_one_tree_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 3)), 1)
    time, dead = rng.integers(1, 9, 120), rng.random(120) < 0.8
    time[x[:, 1] > 0.3] = np.maximum(1, time[x[:, 1] > 0.3] // 2)
    edges = [np.array([-0.75, -0.05, 0.35, 0.85])] * 3
    f = V.fit_survival_forest(_table(spark, x, time, dead).repartition(3), edges, np.arange(1.0, 9.0), trees=1, depth=2, tries=3, least=10, bootstrap=False)

    def best(rows):
        found = [(_rank(time[rows], dead[rows], x[rows, j] <= e), -j, -c) for j in range(3) for c, e in enumerate(edges[j]) if 10 <= (x[rows, j] <= e).sum() <= len(rows) - 10]
        value, j, c = max(found)
        return value, -j, -c

    rows, want = {1: np.arange(120)}, {}
    for node in (1, 2, 3):
        value, j, c = best(rows[node])
        want[node] = (j, c)
        assert f.statistics[0][node] == pytest.approx(value)
        inside = x[rows[node], j] <= edges[j][c]
        rows[2 * node], rows[2 * node + 1] = rows[node][inside], rows[node][~inside]
    assert f.splits[0] == want and set(f.leaves[0]) == {4, 5, 6, 7}
    own = rows[5]
    h = np.cumsum([((time[own] == t) & dead[own]).sum() / max(1, (time[own] >= t).sum()) for t in range(1, 9)])
    assert f.leaves[0][5] == pytest.approx(h)
    risk = {r.sample_id: r.risk for r in f.predict(_table(spark, x, time, dead)).collect()}
    assert all(risk[f"s{i}"] == pytest.approx(h.sum()) for i in own)


def test_forest_finds_a_risk_that_is_not_linear(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import AFTSurvivalRegression

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    rate = np.exp(2.0 * (np.abs(x[:, 0]) > 0.8) + 0.2 * x[:, 1])
    life, lost = rng.exponential(1 / rate), rng.exponential(3.0, 500)
    time, dead = np.minimum(life, lost), life <= lost
    train, test = _table(spark, x[:300], time[:300], dead[:300]), _table(spark, x[300:], time[300:], dead[300:])
    forest = V.fit_survival_forest(train, trees=20, depth=3)
    risk = {r.sample_id: r.risk for r in forest.predict(test).collect()}
    vectors = lambda d: d.select("sample_id", "time", "event", array_to_vector("x").alias("features"))
    aft = AFTSurvivalRegression(labelCol="time", censorCol="event").fit(vectors(train).withColumn("event", vectors(train)["event"].cast("double")))
    linear = {r.sample_id: -r.prediction for r in aft.transform(vectors(test)).collect()}

    def agree(score):
        s, t, d = np.array([score[f"s{i}"] for i in range(200)]), time[300:], dead[300:]
        first = d[:, None] & (t[:, None] < t[None, :])
        return ((s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :]))[first].mean()

    assert agree(risk) > 0.65 and agree(risk) > agree(linear) + 0.08


def test_edges_of_forests(spark):
    schema = "sample_id string, time double, event int, x array<double>"
    none = V.fit_survival_forest(spark.createDataFrame([], schema), trees=2)
    assert none.splits == [{}, {}]
    rows = spark.createDataFrame([("a", 1.0, 1, [1.0, None]), ("b", None, 1, [2.0, 1.0]), ("a", 1.0, 1, [1.0, None]), ("c", 3.0, None, [0.0, 0.0]), (None, 2.0, 0, [float("nan"), 2.0])], schema)
    f = V.fit_survival_forest(rows, trees=3, depth=2, least=1)
    got = f.predict(rows).collect()
    assert len(got) == 5 and all(np.isfinite(r.risk) for r in got)
    again = V.fit_survival_forest(rows.repartition(4), trees=3, depth=2, least=1)
    assert again.splits == f.splits  # draws hang on ids, not on tasks
    drawn = V.draws([str(i) for i in range(4000)], 0, 1, True)
    assert abs(drawn.mean() - 1) < 0.06 and abs(drawn.var() - 1) < 0.12
