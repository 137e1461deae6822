"""Scalar column expressions: encodings, links, losses and their gradients.

Everything here is a plain Column expression, so it stays in generated code.
Missing values are NULL; :func:`finite` makes them so at ingest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Noise models that a feature can have.
DISTRIBUTIONS = ("normal", "bernoulli", "bernoulli_sq_hinge", "poisson", "ordinal3", "ordinal_sq_hinge3")


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def guarded(x: Column, value: float) -> Column:
    """``value`` where x is missing or not finite."""
    return F.coalesce(finite(x), F.lit(value))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (also in ANSI mode)."""
    return F.try_divide(a, b)


def case(on: Column, branches: dict[str, Column], otherwise: Column | None = None) -> Column:
    """Value of the branch whose key equals ``on``."""
    out = reduce(lambda c, kv: c.when(on == kv[0], kv[1]), list(branches.items())[1:], F.when(on == next(iter(branches)), next(iter(branches.values()))))
    return out if otherwise is None else out.otherwise(otherwise)


def shrunken_logit(a: Column, shrink: float = 0.99) -> Column:
    x = F.lit(0.5) + (a - 0.5) * shrink
    return F.ln(x / (1 - x))


def three_level(x: Column, low: Column | float = -0.5, high: Column | float = 0.5) -> Column:
    """1 up to ``low``, 3 above ``high``, else 2; NULL stays."""
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    return F.when(x <= low, 1.0).when(x > high, 3.0).when(x.isNotNull(), 2.0)


def binarise(x: Column, above: float) -> Column:
    """1 above the threshold; other values are unchanged."""
    return F.when(x > above, F.lit(1.0)).otherwise(x)


def assay_transform(assay: Column, x: Column) -> Column:
    """Encoding by assay: logit for methylation, levels for copy numbers, 0/1 for mutations."""
    return case(assay, {"methylation": shrunken_logit(x), "cna": three_level(x), "mutation": binarise(x, 0.0)}, x)


def bernoulli_variance(m: Column, v: Column) -> Column:
    """Starting variance of a 0/1 column from its mean and variance, at most 9."""
    return F.when((m == 0) | (m == 1), 0.0).otherwise(F.least((v / (m * (1 - m))) ** 2, F.lit(9.0)))


def discretise(distribution: Column, z: Column, thresholds: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Simulated observation of a latent value."""
    level = F.when(z <= thresholds[0], 1.0).when(z <= thresholds[1], 2.0).otherwise(3.0)
    binary = F.when(z > 0, 1.0).otherwise(0.0)
    return case(distribution, {"bernoulli": binary, "bernoulli_sq_hinge": binary, "ordinal3": level, "ordinal_sq_hinge3": level}, z)


def soft_threshold(x: Column, by: Column | float) -> Column:
    return F.greatest(F.abs(x) - by, F.lit(0.0))


def ard_curve(x: Column, alpha: float, beta: float) -> Column:
    """Penalty of a value under an automatic-relevance prior, 0 at 0."""
    return F.lit(alpha + 0.5) * (F.ln(F.lit(beta) + 0.5 * x * x) - F.ln(F.lit(beta)))


def link(distribution: Column, x: Column) -> Column:
    return case(distribution, {"bernoulli": F.ln(x / (1 - x)), "poisson": F.ln(x)}, x)


def inverse_link(distribution: Column, z: Column) -> Column:
    return case(distribution, {"bernoulli": 1 / (1 + F.exp(-z)), "poisson": F.exp(z)}, z)


def impute(distribution: Column, z: Column, thresholds: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Expected observation for continuous noise, the class for hinge and ordinal noise."""
    level = F.when(z <= thresholds[0], 1.0).when(z <= thresholds[1], 2.0).otherwise(3.0)
    return case(
        distribution,
        {"bernoulli": 1 / (1 + F.exp(-z)), "poisson": F.exp(z), "bernoulli_sq_hinge": F.when(z > 0, 1.0).otherwise(0.0), "ordinal3": level, "ordinal_sq_hinge3": level},
        z,
    )


def _hinge(z: Column, sign: Column) -> Column:
    return F.greatest(1 - sign * z, F.lit(0.0))


def data_loss(distribution: Column, z: Column, d: Column, thresholds: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Negative log-likelihood (up to constants) of d at the latent value z; NULL where d is."""
    sign = 2 * d - 1
    hinges = sum((_hinge(z - t, F.when(d > i + 1, 1.0).otherwise(-1.0)) ** 2 for i, t in enumerate(thresholds)), F.lit(0.0)) / 2
    below = [F.lit(0.0), *(1 / (1 + F.exp(-(F.lit(t) - z))) for t in thresholds), F.lit(1.0)]
    chosen = F.when(d == 1, below[1] - below[0]).when(d == 2, below[2] - below[1]).otherwise(below[3] - below[2])
    return F.when(
        d.isNotNull(),
        case(
            distribution,
            {
                "bernoulli": F.ln(1 + F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - d * z,
                "poisson": F.exp(z) - d * z,
                "bernoulli_sq_hinge": 0.5 * _hinge(z, sign) ** 2,
                "ordinal3": -F.ln(F.greatest(chosen, F.lit(1e-12))),
                "ordinal_sq_hinge3": hinges,
            },
            0.5 * (z - d) ** 2,
        ),
    )


def data_gradient(distribution: Column, z: Column, d: Column, thresholds: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Derivative of :func:`data_loss` in z."""
    sign = 2 * d - 1
    side = [F.when(d > i + 1, 1.0).otherwise(-1.0) for i in range(len(thresholds))]
    hinges = sum((-s * _hinge(z - t, s) for s, t in zip(side, thresholds, strict=True)), F.lit(0.0))
    below = [F.lit(0.0), *(1 / (1 + F.exp(-(F.lit(t) - z))) for t in thresholds), F.lit(1.0)]
    # of -ln(s(b) - s(a)) in z:  1 - s(a) - s(b), by the logistic's derivative s(1 - s)
    ordinal = F.when(d == 1, 1 - below[0] - below[1]).when(d == 2, 1 - below[1] - below[2]).otherwise(1 - below[2] - below[3])
    return F.when(
        d.isNotNull(),
        case(
            distribution,
            {"bernoulli": 1 / (1 + F.exp(-z)) - d, "poisson": F.exp(z) - d, "bernoulli_sq_hinge": -sign * _hinge(z, sign), "ordinal3": ordinal, "ordinal_sq_hinge3": hinges},
            z - d,
        ),
    )


def survival_dead(days_to_death: Column) -> Column:
    return days_to_death.isNotNull()


def survival_time(days_to_death: Column, days_to_followup: Column) -> Column:
    return F.coalesce(days_to_death, days_to_followup)


def survival_stratum(days_to_death: Column, days_to_followup: Column, median_death: Column, median_followup: Column) -> Column:
    """0/1 for deaths up to/after the median, 2/3 for the living likewise."""
    return F.when(days_to_death.isNotNull(), F.when(days_to_death > median_death, 1).otherwise(0)).otherwise(F.when(days_to_followup > median_followup, 3).otherwise(2))


def stratum(kind: str, *cols: Column) -> Column:
    """The class to stratify by: of survival (four columns), of a stage, or the value itself."""
    if kind == "survival":
        return survival_stratum(*cols)
    return stage_code(cols[0]) if kind == "stage" else cols[0]


def stage_code(stage: Column) -> Column:
    """'stage i'..'stage v' as 0..4, sub-stage letters dropped; else NULL."""
    s = F.regexp_replace(F.lower(F.trim(stage)), "[^iv]$", "")
    # fixed values: stage names in order
    return case(s, {"stage i": F.lit(0), "stage ii": F.lit(1), "stage iii": F.lit(2), "stage iv": F.lit(3), "stage v": F.lit(4)})
