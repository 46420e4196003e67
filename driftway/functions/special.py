"""Log-gamma and the hypergeometric projection weights as plain column arithmetic.

Spark has no ``lgamma``. A Stirling series on a shifted argument keeps these
functions inside generated code for any sample size, with no lookup table to
build, order or broadcast.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import mul
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHIFT = 8


def log_gamma1p(x: Column) -> Column:
    """ln Gamma(x + 1) for x >= 0, i.e. the log factorial at whole numbers."""
    x = x.cast("double")
    z = x + float(_SHIFT)
    inverse = 1.0 / z
    square = inverse * inverse
    # Stirling series, coefficients B(2n) / (2n (2n - 1)).
    series = inverse * (
        1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square * (1 / 1188))))
    )
    shifted = (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    return shifted - F.log(reduce(mul, [x + float(step) for step in range(1, _SHIFT + 1)]))


def _number(value: float) -> str:
    return f"{value!r}D"


def _numbers(values) -> str:
    return "array(" + ", ".join(_number(v) for v in values) + ")"


def _log_factorial(n: str) -> str:
    """SQL text of ln n! for whole n >= 0: exact values below 16, the Stirling series above."""
    square = f"({n} * {n})"
    series = (
        f"({_number(1 / 12)} - ({_number(1 / 360)} - ({_number(1 / 1260)} - {_number(1 / 1680)} / {square})"
        f" / {square}) / {square}) / {n}"
    )
    exact = _numbers(math.lgamma(k + 1) for k in range(16))
    stirling = f"({n} + 0.5D) * ln({n}) - {n} + {_number(0.5 * math.log(2 * math.pi))} + {series}"
    return f"CASE WHEN {n} < 16 THEN get({exact}, cast({n} as int)) ELSE {stirling} END"


def sum_log_factorials(*numbers: str) -> str:
    """SQL text of the summed ln n!.

    The lambda states the formula once for all of them. Written out per term it
    would exceed the method size the JIT compiles, and run interpreted.
    """
    return f"aggregate(array({', '.join(numbers)}), 0D, (total, n) -> total + ({_log_factorial('n')}))"


def project_side(df: DataFrame, called: str, alt: str, target: int, k: str, p: str) -> DataFrame:
    """One row per possible count ``k`` of alternate alleles among ``target`` drawn, with its probability ``p``.

    Hypergeometric: ``target`` chromosomes drawn without replacement from ``called``
    of which ``alt`` are alternate; ``target`` must not exceed ``called``. Counts of
    probability 0 have no row. What does not depend on k is computed before the
    rows multiply.
    """
    reference = f"({called} - {alt})"
    spread = df.selectExpr(
        "*",
        f"{sum_log_factorials(alt, reference, f'{called} - {target}')} - {sum_log_factorials(called)} AS _fixed",
        f"explode(sequence(greatest(0L, {target} - {reference}), least({alt}, {target}L))) AS {k}",
    )
    choices = _numbers(math.log(math.comb(target, j)) for j in range(target + 1))
    rest = sum_log_factorials(f"{alt} - {k}", f"{reference} - {target} + {k}")
    return spread.selectExpr(
        *[f"`{c}`" for c in df.columns], k, f"exp(_fixed + get({choices}, cast({k} as int)) - {rest}) AS {p}"
    )


def project_counts(called: np.ndarray, alt: np.ndarray, target: int) -> np.ndarray:
    """The probabilities of ``project_side`` for arrays: a row per (called, alt), a column per count from 0 to ``target``."""
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, called.max() + 1)))])
    k, alt, called = np.arange(target + 1), alt[:, None], called[:, None]
    reference = called - alt
    there = (k <= alt) & (target - k <= reference)

    def log_choose(n, m):
        m = np.where(there, m, 0)
        return factorials[n] - factorials[m] - factorials[np.where(there, n - m, n)]

    logs = log_choose(alt, k) + log_choose(reference, target - k) - log_choose(called, np.full_like(k, target))
    return np.where(there, np.exp(logs), 0.0)


def hypergeom_table(sizes: DataFrame, target: int) -> DataFrame:
    """Rows (called, alt, k, p) for every distinct (called, alt) with enough called chromosomes."""
    keyed = sizes.select("called", "alt").distinct().filter(F.col("called") >= target)
    return project_side(keyed, "called", "alt", target, "k", "p")


def chi2_one_quantile(confidence: float) -> float:
    """Quantile of chi-square with one degree of freedom: a squared normal quantile."""
    return NormalDist().inv_cdf(0.5 + confidence / 2) ** 2


def profile_grid(
    estimates: DataFrame,
    *,
    lower: float,
    upper: float,
    points: int = 15,
    fold_range: float = 10.0,
    estimate: str = "mle",
) -> DataFrame:
    """Log-spaced values around each estimate plus the estimate itself, without repeats."""
    if not 0 < lower < upper:
        raise ValueError("a profile runs from a lower bound above 0 to a larger one.")
    if points < 5:
        raise ValueError("a profile has five points or more.")
    if fold_range <= 1:
        raise ValueError("fold_range has to be above 1.")
    mle = F.when(F.col(estimate) > 0, F.col(estimate)).otherwise(
        F.raise_error(F.lit("an estimate to profile around has to be above zero.")).cast("double")
    )
    low = F.log(F.greatest(F.lit(float(lower)), mle / fold_range))
    high = F.log(F.least(F.lit(float(upper)), mle * fold_range))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda step: F.exp(low + (high - low) * step / float(points - 1)),
    )
    values = F.array_distinct(F.concat(grid, F.array(mle)))
    return estimates.select("*", F.explode(values).alias("fixed_value"))
