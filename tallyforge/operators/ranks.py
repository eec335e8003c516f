"""Rank statistics of whole columns: inversions by range, exact null distributions, and a bootstrap by hashed weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of a bucket, on average, and the fewest buckets an axis.
BUCKET_ROWS, BUCKETS = 500_000, 16
#: The most values for which p-values are exact, where no values tie.
EXACT_TAU, EXACT_SIGNED = 33, 50


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """The sum of weight products over pairs of places i < j with y[i] > y[j], by merging sorted halves."""
    if len(y) <= 48:
        return int((np.triu(y[:, None] > y[None, :], 1) * weight[:, None] * weight[None, :]).sum())
    middle = len(y) // 2
    order = np.argsort(y[:middle], kind="stable")
    upto = np.concatenate([[0], np.cumsum(weight[:middle][order])])
    below = upto[np.searchsorted(y[:middle][order], y[middle:], side="right")]
    return inversions(y[:middle], weight[:middle]) + inversions(y[middle:], weight[middle:]) + int(((upto[-1] - below) * weight[middle:]).sum())


def _bucket(value: str, cuts: Sequence[float]) -> Column:
    """Even numbers between cuts, and an odd one for the values that equal a cut, so that a very common value has a bucket of its own."""
    all_cuts = F.array(*map(F.lit, cuts)).cast("array<double>")
    return 2 * F.size(F.filter(all_cuts, lambda c: F.col(value) > c)) + F.array_contains(all_cuts, F.col(value)).cast("int")


def discordant(points: DataFrame, n: int, buckets: int | None = None) -> int:
    """Pairs of points (x, y, c: how many such points) whose x and y go in opposite directions; n: all points.

    Both axes are cut into buckets. Pairs that differ in both buckets follow from the counts of cells; those that share a bucket of x, or one of y, are counted as inversions in
    that bucket, and those that share a cell, which are in both, are taken off once. A bucket is one task; one that holds a single value of its axis has no such pairs.
    """
    buckets = buckets or max(BUCKETS, -(-n // BUCKET_ROWS))
    steps = [i / buckets for i in range(1, buckets)]
    found = points.agg(*[F.percentile_approx(v, steps, 20 * buckets).alias(v) for v in ("x", "y")]).first()
    cuts = {v: sorted(set(found[v] or [])) for v in ("x", "y")}
    placed = written(points.select("x", "y", "c", _bucket("x", cuts["x"]).alias("a"), _bucket("y", cuts["y"]).alias("b")), "placed")

    def inside(*by: str) -> int:
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["x", "y"])
            return pd.DataFrame({"d": [inversions(pdf["y"].to_numpy(), pdf["c"].to_numpy())]})

        several = placed.where(reduce(Column.__and__, [F.col(k) % 2 == 0 for k in by]))
        return int(several.groupBy(*by).applyInPandas(count, "d decimal(38,0)").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d")).first().d)

    rows, columns = (2 * len(cuts[v]) + 1 for v in ("x", "y"))
    grid = points.sparkSession.range(rows * columns).select((F.col("id") / columns).cast("int").alias("a"), (F.col("id") % columns).cast("int").alias("b"))
    grid = grid.join(placed.groupBy("a", "b").agg(F.sum("c").alias("c")), ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    greater = F.sum("c").over(Window.partitionBy("a").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("greater").over(Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    across = grid.withColumn("greater", F.coalesce(greater, F.lit(0))).withColumn("before", F.coalesce(before, F.lit(0)))
    return int(across.agg(F.sum(F.col("c").cast("decimal(19,0)") * F.col("before")).alias("d")).first().d or 0) + inside("a") + inside("b") - inside("a", "b")


def tau_table(spark: SparkSession, most: int = EXACT_TAU) -> DataFrame:
    """The exact two-sided p of d discordant pairs among n values without ties (n, d, exact): the number of permutations by inversions, from those of one value less."""
    rows, ways = [], [1]
    for n in range(1, most + 1):
        if n > 1:
            ways = [sum(ways[max(0, k - n + 1) : k + 1]) for k in range(len(ways) + n - 1)]
        upto, pairs = list(accumulate(ways)), n * (n - 1) // 2
        rows += [(n, d, min(1.0, 2 * upto[min(d, pairs - d)] / factorial(n))) for d in range(pairs + 1)]
    return spark.createDataFrame(rows, "n long, d long, exact double")


def signed_rank_table(spark: SparkSession, most: int = EXACT_SIGNED) -> DataFrame:
    """The exact two-sided p of the lesser rank sum w of n differences without ties or zeros (n, w, exact): the number of sign choices by their sum."""
    rows, ways = [], [1]
    for n in range(1, most + 1):
        ways = [(ways[k] if k < len(ways) else 0) + (ways[k - n] if k >= n else 0) for k in range(len(ways) + n)]
        upto = list(accumulate(ways))
        rows += [(n, float(w), min(1.0, 2 * upto[w] / 2**n)) for w in range(n * (n + 1) // 4 + 1)]
    return spark.createDataFrame(rows, "n long, w double, exact double")


def poisson_bootstrap(df: DataFrame, value: str, key: Sequence[str], *, by: Sequence[str] = (), draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The percentile bootstrap interval of the mean of a column, for any number of rows, in each group of `by`: n, mean, lower, upper.

    Every row weighs Poisson(1) in a draw, by a hash of its key and the draw, so that draws need no positions and one aggregate with partial sums makes them all. key must tell
    rows apart; rows whose value is null are left out. A draw in which nothing weighs has no mean.
    """
    limits, term, total = [], exp(-1), 0.0
    for k in range(1, 13):
        total += term
        limits.append(total)
        term /= k
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key, F.col("draw")), 11) / F.lit(float(1 << 53))
    weight = reduce(Column.__add__, [(F.col("u") >= limit).cast("int") for limit in limits])
    drawn = df.where(F.col(value).isNotNull()).select(*by, *[k for k in key if k not in by], F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    drawn = drawn.withColumn("u", unit).withColumn("w", F.when(F.col("draw") == draws, 1).otherwise(weight))  # the last weighs all rows alike
    means = drawn.groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col("_v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"), F.count(F.lit(1)).alias("n"))
    boots = F.array_sort(F.collect_list(F.when(F.col("draw") < draws, F.col("m"))))
    place = lambda share: F.get("boots", F.least(F.floor(F.lit(share) * F.size("boots")), F.size("boots") - 1).cast("int"))
    got = means.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("draw") == draws, F.col("m"))).alias("mean"), boots.alias("boots"))
    return got.select(*by, "n", "mean", place(alpha / 2).alias("lower"), place(1 - alpha / 2).alias("upper"))
