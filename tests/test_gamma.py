"""Gamma variates and factors with precisions of their own: moments, and the same values under any split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import simulate as SM


@pytest.mark.parametrize("shape", [0.4, 1.01, 3.0])
def test_moments(spark, shape):
    n = 20_000
    r = spark.range(n).select(SM.gamma(shape, "id", seed=3).alias("g")).agg(F.avg("g"), F.var_samp("g"), F.skewness("g"), F.min("g")).first()
    assert abs(r[0] - shape) < 5 * np.sqrt(shape / n)
    assert abs(r[1] / shape - 1) < 5 * np.sqrt((2 + 6 / shape) / n)
    assert r[2] == pytest.approx(2 / np.sqrt(shape), rel=0.25) and r[3] > 0


def test_values_hang_on_ids_alone(spark):
    items = spark.range(50).select(F.col("id").cast("string").alias("f"))
    a = {(r.f, r.k): r.v for r in SM.relevance_values(items, "f", 3, seed=1).collect()}
    b = {(r.f, r.k): r.v for r in SM.relevance_values(items.repartition(7, "f"), "f", 3, seed=1).collect()}
    assert a == b and len(a) == 150 and len(set(a.values())) == 150


def test_factors_have_precisions_of_their_own(spark):
    """v sqrt(alpha / beta) is Student's t with 2 alpha degrees of freedom: half of it within 0.72 for alpha 2."""
    alpha, beta = 2.0, 0.5
    v = np.array([r.v for r in SM.relevance_values(spark.range(6000), "id", 2, alpha, beta, seed=2).collect()]) * np.sqrt(alpha / beta)
    assert np.median(np.abs(v)) == pytest.approx(0.7407, abs=0.03)  # quartile of t with 4 degrees of freedom
    assert np.mean(np.abs(v) > 2.776) == pytest.approx(0.05, abs=0.012)


def test_no_accepted_pair_has_a_defined_result(spark):
    got = spark.range(1).select(SM.gamma_from(2.0, [F.lit(-50.0)], [F.lit(0.5)]).alias("g")).first().g
    assert got == pytest.approx(2 - 1 / 3)
