import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ranks
from tallyforge.operators import tests as T


def sign(x):
    return (x > 0) - (x < 0)


def brute_tau(rows):
    """tau-b by all pairs."""
    both = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a, b in itertools.combinations(rows, 2)]
    x, y = sum(p != 0 for p, _ in both), sum(q != 0 for _, q in both)
    return sum(p * q for p, q in both) / math.sqrt(x * y) if x and y else math.nan


def frame(spark, rows):
    return spark.createDataFrame([(float(x), float(y)) for x, y in rows], "x double, y double")


@pytest.mark.parametrize("kind", ["plain", "ties", "common", "constant"])
def test_tau_equals_all_pairs(spark, kind):
    """2,000 rows: all different, many ties, a third of rows in one value of x and another third in one point, and a constant."""
    rng = random.Random(6)
    rows = {
        "plain": [(rng.random(), rng.random()) for _ in range(2000)],
        "ties": [(rng.randrange(40), rng.randrange(9)) for _ in range(2000)],
        "common": [(5 if i % 3 == 0 else rng.randrange(300), rng.randrange(300)) if i % 3 < 2 else (7, 7) for i in range(2000)],
        "constant": [(1, i) for i in range(50)],
    }[kind]
    got = T.kendall(frame(spark, rows), buckets=6).first()
    want = brute_tau(rows)
    assert math.isnan(got.tau_b) and math.isnan(got.p_value) if math.isnan(want) else got.tau_b == pytest.approx(want, abs=1e-12)


def test_tau_of_a_million_rows(spark):
    """y goes up with x, but neighbours change places."""
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select((F.col("id")).cast("double").alias("x"), F.col("id").bitwiseXOR(F.lit(1)).cast("double").alias("y"))
    d = n // 2
    assert T.kendall(rows).first().tau_b == pytest.approx(1 - 4 * d / (n * (n - 1)), abs=1e-15)


def test_nulls_and_few_rows(spark):
    rows = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 1.0)], "x double, y double")
    assert math.isnan(T.kendall(rows).first().tau_b) and math.isnan(T.kendall(rows.limit(0)).first().tau_b)


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 47, 49, 400):
        y, w = rng.integers(0, 30, n), rng.integers(1, 5, n)
        assert ranks.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


def test_exact_tau_equals_enumeration(spark):
    table = {(r.n, r.d): r.exact for r in ranks.tau_table(spark, 8).collect()}
    for n in range(1, 8):
        counts = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        pairs = n * (n - 1) // 2
        for d in range(pairs + 1):
            m = min(d, pairs - d)
            assert table[n, d] == pytest.approx(min(1.0, 2 * sum(c <= m for c in counts) / len(counts)))
    rows = list(zip(range(10), (0, 2, 1, 3, 4, 7, 5, 6, 9, 8)))
    assert T.kendall(frame(spark, rows)).first().p_value == pytest.approx({r.d: r.exact for r in ranks.tau_table(spark, 10).where("n = 10").collect()}[4])


def test_exact_signed_ranks_equal_enumeration(spark):
    table = {(r.n, r.w): r.exact for r in ranks.signed_rank_table(spark, 10).collect()}
    for n in range(1, 11):
        sums = [sum(k + 1 for k in range(n) if bits >> k & 1) for bits in range(1 << n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert table[n, float(w)] == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / len(sums)))
    rows = [(3.1, 1.0), (2.0, 2.5), (5.0, 1.3), (9.0, 2.0), (4.0, 4.9)]
    got = T.wilcoxon(frame(spark, rows)).first()
    assert (got.n, got.w, got.p_value) == (5, 3.0, pytest.approx(table[5, 3.0]))
    tied = T.wilcoxon(frame(spark, [*rows, (1, 1)])).first()  # an equal pair: the approximation
    assert tied.w == 3.0 and tied.p_value != pytest.approx(table[5, 3.0])


def test_paired_test(spark):
    got = T.paired_test(frame(spark, [(1, 1), (2, 2)])).first()
    assert tuple(got) == (0.0, 1.0, 0.0, "all differences zero")
    got = T.paired_test(frame(spark, [(3, 1), (5, 2), (9, 4.5)])).first()
    assert (got.statistic, got.p_value, got.note) == (0.0, 0.25, None) and got.cliffs_delta == pytest.approx(7 / 9)
    with pytest.raises(ValueError):
        T.paired_test(spark.createDataFrame([(1.0, None)], "x double, y double"))


def test_bootstrap_covers_the_mean(spark):
    """400 samples of 60 rows each: a 90 % interval holds the true mean about nine times in ten; reruns agree however rows are dealt."""
    rng = random.Random(9)
    rows = spark.createDataFrame([(g, i, rng.gauss(3, 2)) for g in range(400) for i in range(60)], "g int, i int, v double")
    got = ranks.poisson_bootstrap(rows, "v", ["g", "i"], by=["g"], draws=300, alpha=0.1).collect()
    assert len(got) == 400 and all(r.n == 60 and r.lower < r.mean < r.upper for r in got)
    assert 0.84 < sum(r.lower <= 3 <= r.upper for r in got) / 400 < 0.95
    again = ranks.poisson_bootstrap(rows.repartition(3).where("g < 5"), "v", ["g", "i"], by=["g"], draws=300, alpha=0.1).collect()
    first = {r.g: r for r in got}
    assert all(r.lower == pytest.approx(first[r.g].lower) for r in again)


def test_bootstrap_of_a_million_rows(spark):
    rows = spark.range(1_000_000, numPartitions=8).select("id", (F.col("id") % 2).cast("double").alias("v"))
    got = ranks.poisson_bootstrap(rows, "v", ["id"], draws=40).first()
    assert got.mean == 0.5 and got.upper - got.lower == pytest.approx(4 * 0.0005, rel=0.5)
    assert ranks.poisson_bootstrap(rows.limit(0), "v", ["id"], draws=10).collect()[0].n is None
