"""Statistics as column expressions."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int, *, strict: bool = False) -> Column:
    """The unbiased pass@k of c passes among n samples: 0 for n = 0, 1 whenever fewer than k fail. strict: null if n < k."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * ((n - c - i) / (n - i)))
    value = F.when(n == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)
    return F.when(n < k, F.lit(None)).otherwise(value).cast("double") if strict else value.cast("double")


def _pair_sum(size: Column, term) -> Column:
    """The sum of term(i, j) over 0 <= i < j < size."""
    index = F.sequence(F.lit(0), size - 1)
    return F.aggregate(index, F.lit(0.0), lambda acc, i: acc + F.aggregate(F.filter(index, lambda j: j > i), F.lit(0.0), lambda s, j: s + term(i, j)))


def kendall_tau_b(a: Column, b: Column, *, guarded: bool = True) -> Column:
    """Kendall's tau-b of two arrays of one length. guarded: 1 if both are constant, 0 if one is; else NaN for either.

    Pairs of positions are counted, so this is for vectors over a dimension (models, tasks), not over facts.
    """
    sign = lambda x, i, j: F.signum(F.get(x, j) - F.get(x, i))
    size = F.size(a)
    both = _pair_sum(size, lambda i, j: sign(a, i, j) * sign(b, i, j))
    in_a, in_b = (_pair_sum(size, lambda i, j, x=x: F.abs(sign(x, i, j))) for x in (a, b))
    tau = both / F.sqrt(in_a * in_b)
    if guarded:
        return F.when(size < 1, 1.0).when((in_a == 0) & (in_b == 0), 1.0).when((in_a == 0) | (in_b == 0), 0.0).otherwise(tau)
    return F.when((size < 1) | (in_a == 0) | (in_b == 0), F.lit(float("nan"))).otherwise(tau)


def draw_table(size: int, *, draws: int = 1000, seed: int = 42, generator: str = "stdlib") -> list[list[int]]:
    """Which positions each bootstrap draw takes. Draws depend on the size and the seed only, not on the values."""
    if generator == "stdlib":
        rng = random.Random(seed)
        return [rng.choices(range(size), k=size) for _ in range(draws)]
    rng = np.random.default_rng(seed)
    return [rng.integers(0, size, size=size).tolist() for _ in range(draws)]


def bootstrap_interval(values: Column, size: int, *, draws: int = 1000, alpha: float = 0.05, seed: int = 42, generator: str = "stdlib", statistic=None) -> Column:
    """The percentile bootstrap interval (lower, upper) of an array column of the given size; nulls for size 0.

    statistic maps an array column to a number (default: the mean). The draw table is a constant of the plan.
    """
    if not size:
        return F.struct(F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    statistic = statistic or (lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))
    table = F.from_json(F.lit(str(draw_table(size, draws=draws, seed=seed, generator=generator))), "array<array<int>>")
    boots = F.array_sort(F.transform(table, lambda at: statistic(F.transform(at, lambda i: F.get(values, i)))))
    return F.struct(F.get(boots, F.lit(int(alpha / 2 * draws))).alias("lower"), F.get(boots, F.lit(int((1 - alpha / 2) * draws))).alias("upper"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def student_tails(t: Column, freedom: Column) -> Column:
    """P(|T| > t) for t >= 0 and a whole number of degrees of freedom, by the finite series in the angle whose tangent is t / sqrt(freedom); beyond 2,000 degrees by the
    normal distribution."""
    angle = F.atan(t / F.sqrt(freedom))
    square, odd = F.pow(F.cos(angle), 2), freedom % 2 == 1
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(2000), F.floor((freedom - 1) / 2)).cast("int")))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        factor = F.when(odd, 2.0 * i / (2.0 * i + 1.0)).otherwise((2.0 * i - 1.0) / (2.0 * i))
        last = F.floor((freedom - F.when(odd, 3).otherwise(2)) / 2)
        term = F.when(i <= last, state["term"] * factor * square).otherwise(0.0)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    series = F.aggregate(steps, start, add, lambda state: state["sum"])
    inside = F.when(freedom == 1, 2 * angle / F.lit(math.pi)).when(odd, 2 / F.lit(math.pi) * (angle + F.sin(angle) * F.cos(angle) * series)).otherwise(F.sin(angle) * series)
    return F.when(freedom > 2000, 2 * normal_tail(t)).otherwise(F.greatest(F.lit(0.0), 1 - inside))


NORMAL_TAIL_SQL = """(CASE WHEN {z} >= 0 THEN 1 ELSE 0 END + CASE WHEN {z} >= 0 THEN -1 ELSE 1 END * (1 - 0.5E0 * exp(-({z}) * ({z}) / 2E0)
 * (1E0 / (1 + 0.3275911E0 * abs({z}) / sqrt(2E0))) * (0.254829592E0 + (1E0 / (1 + 0.3275911E0 * abs({z}) / sqrt(2E0))) * (-0.284496736E0 + (1E0 / (1 + 0.3275911E0 * abs({z}) / sqrt(2E0)))
 * (1.421413741E0 + (1E0 / (1 + 0.3275911E0 * abs({z}) / sqrt(2E0))) * (-1.453152027E0 + (1E0 / (1 + 0.3275911E0 * abs({z}) / sqrt(2E0))) * 1.061405429E0))))))"""
