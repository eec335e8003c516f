"""Paired and two-sample tests over (x, y) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_tail, student_tails
from ..session import written
from .ranks import discordant, signed_rank_table, tau_table


def counts_below(sizes: DataFrame, value: str, counts: Sequence[str], *partition: str, buckets: int = 64) -> DataFrame:
    """sizes (one row a distinct value) with _below_<c> for each count: its sum over lesser values.

    Without a partition, values are cut into buckets at approximate quantiles, which are constants of the plan: each bucket is one task of the window, and only
    sums by bucket meet in one.
    """
    upto = lambda w: w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    if partition:
        return sizes.withColumns({f"_below_{c}": none(F.sum(c).over(upto(Window.partitionBy(*partition)))) for c in counts})
    sizes = written(sizes, "sizes")  # read three times
    cuts = sizes.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)])).first()[0] or []
    sizes = sizes.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: F.col(value) > x)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts]).select("_b", *[none(F.sum(f"_t_{c}").over(before)).alias(f"_o_{c}") for c in counts])
    placed = sizes.join(F.broadcast(totals), "_b")
    return placed.withColumns({f"_below_{c}": none(F.sum(c).over(upto(Window.partitionBy("_b")))) + F.col(f"_o_{c}") for c in counts}).drop("_b", *[f"_o_{c}" for c in counts])


def average_ranks(df: DataFrame, value: str, out: str, *partition: str) -> DataFrame:
    """Adds ranks from 1, ties sharing their mean. Ranks come from counts of distinct values, so equal rows combine before the window."""
    sizes = df.groupBy(*partition, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = counts_below(sizes, value, ["_c"], *partition).withColumn(out, F.col("_below__c") + (F.col("_c") + 1) / 2).drop("_c", "_below__c")
    return df.join(ranks, [*partition, value])


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """The signed-rank test of columns x and y: n (pairs that differ), w (the lesser rank sum), p_value: exact for up to 50 pairs, none of them equal or tied in their
    difference, else by the normal approximation with tie correction; 1 with w = 0 if no pair differs."""
    whole = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select((F.col("x") - F.col("y")).alias("d"))
    equal = whole.agg(F.count_if(F.col("d") == 0).alias("equal"))
    ranked = average_ranks(whole.where("d <> 0").withColumn("a", F.abs("d")), "a", "r")
    sums = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("down"),
    )
    ties = ranked.groupBy("a").agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.expr("t * t * t - t")), F.lit(0)).alias("ties"))
    n = F.col("n").cast("double")
    w = F.least("up", "down")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    normal = F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(F.abs(z))))
    got = sums.join(F.broadcast(ties)).join(F.broadcast(equal)).select("n", w.alias("w"), normal.alias("_p"), ((F.col("ties") == 0) & (F.col("equal") == 0)).alias("_plain"))
    exact = F.broadcast(signed_rank_table(pairs.sparkSession))
    return got.join(exact, ["n", "w"], "left").select("n", "w", F.when(F.col("_plain"), F.coalesce("exact", "_p")).otherwise(F.col("_p")).alias("p_value"))


def paired_test(pairs: DataFrame) -> DataFrame:
    """The signed-rank test and Cliff's delta of columns x and y as one row: statistic, p_value, cliffs_delta, note. Unpaired rows, where one side is null, raise ValueError."""
    if pairs.where(F.col("x").isNull() != F.col("y").isNull()).limit(1).count():
        raise ValueError("x and y must be paired")
    delta = cliffs_delta(*(pairs.select(F.col(c).alias("v")) for c in "xy"))
    note = F.when(F.col("n") == 0, F.lit("all differences zero"))
    return wilcoxon(pairs).join(F.broadcast(delta)).select(F.col("w").alias("statistic"), "p_value", F.when(F.col("n") == 0, 0.0).otherwise(F.col("delta")).alias("cliffs_delta"), note.alias("note"))


def cliffs_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """P(x > y) - P(x < y) for the column v of a and of b: from counts by value, without pairing rows. NaN if either is empty."""
    both = a.select("v", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select("v", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    values = both.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    values = counts_below(values, "v", ["a", "b"])
    # P(x > y) counts lesser y for each x, P(x < y) lesser x for each y
    sums = values.withColumn("s", F.col("a") * F.col("_below_b") - F.col("b") * F.col("_below_a")).agg(F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("s") / (F.col("a") * F.col("b"))).otherwise(F.lit(float("nan"))).alias("delta"))


def kendall(pairs: DataFrame, *, exact: bool = True, buckets: int | None = None) -> DataFrame:
    """tau-b of x and y over all rows without nulls and its p_value: exact for up to 33 rows without ties (unless exact is False), else by the normal approximation with ties corrected; NaN if
    either is constant. Equal rows are counted first; discordant pairs are inversions in ranges of x and of y."""
    spark = pairs.sparkSession
    points = written(pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")), "points")
    tied = lambda *by: points.groupBy(*by).agg(F.sum("c").cast("double").alias("t")).agg(
        *[F.coalesce(F.sum(F.expr(e)), F.lit(0.0)).alias(f"{''.join(by)}{i}") for i, e in enumerate(("t", "t * (t - 1) / 2", "t * (t - 1) * (t - 2)", "t * (t - 1) * (2 * t + 5)"))]
    )
    sums = {k: v for by in (("x",), ("y",), ("x", "y")) for k, v in tied(*by).first().asDict().items()}
    d = discordant(points, int(sums["x0"]), buckets)
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in sums.items()], F.lit(float(d)).alias("d"))
    n, pairs_ = F.col("x0"), F.col("x0") * (F.col("x0") - 1)
    score = pairs_ / 2 - F.col("x1") - F.col("y1") + F.col("xy1") - 2 * F.col("d")
    scale = F.sqrt((pairs_ / 2 - F.col("x1")) * (pairs_ / 2 - F.col("y1")))
    third = F.when(n > 2, F.col("x2") * F.col("y2") / (9 * pairs_ * F.nullif(n - 2, F.lit(0.0)))).otherwise(0.0)
    spread = (pairs_ * (2 * n + 5) - F.col("x3") - F.col("y3")) / 18 + 2 * F.col("x1") * F.col("y1") / F.nullif(pairs_, F.lit(0.0)) + third
    normal = F.least(F.lit(1.0), 2 * normal_tail(F.abs(score) / F.sqrt(F.nullif(spread, F.lit(0.0)))))
    nan = F.lit(float("nan"))
    got = row.select(
        n.cast("long").alias("n"), F.col("d").cast("long").alias("d"), F.when(F.coalesce(scale, F.lit(0.0)) == 0, nan).otherwise(score / F.nullif(scale, F.lit(0.0))).alias("tau_b"), normal.alias("_p"), ((F.col("x1") == 0) & (F.col("y1") == 0) & F.lit(exact)).alias("_plain")
    )
    p = F.when(F.isnan("tau_b"), nan).when(F.col("_plain"), F.coalesce("exact", "_p")).otherwise(F.col("_p"))
    return got.join(F.broadcast(tau_table(spark)), ["n", "d"], "left").select("tau_b", p.alias("p_value"))


def spearman(pairs: DataFrame) -> DataFrame:
    """rho of the ranks of x and y and its p_value (Student's t with n - 2 degrees of freedom); NaN if either is constant."""
    ranked = average_ranks(average_ranks(pairs, "x", "rx"), "y", "ry")
    got = ranked.agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    p = F.when(F.isnan("rho") | (F.col("n") < 3), F.lit(float("nan"))).when(t.isNull(), 0.0).otherwise(student_tails(F.abs(t), F.col("n") - 2))
    return got.select("rho", p.alias("p_value"))
