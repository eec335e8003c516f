"""Operators over the fact table of attempts: (task, relation, model, sample_ix, passed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bootstrap_interval, kendall_tau_b, normal_tail, pass_at_k

CELL = ("task", "relation", "model")


def attempt_counts(attempts: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """n and correct of each cell; an attempt without an outcome counts as failed."""
    return attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("correct"))


def pass_rates(counts: DataFrame, ks: Sequence[int] = (1, 5, 10), *, strict: bool = False) -> DataFrame:
    return counts.withColumns({f"pass_at_{k}": pass_at_k(F.col("n"), F.col("correct"), k, strict=strict) for k in ks})


def best_attempt(attempts: DataFrame, keys: Sequence[str] = CELL, payload: Sequence[str] = ()) -> DataFrame:
    """The first passing attempt of each cell, else the first: a combinable minimum instead of a sort."""
    order = F.struct((~F.coalesce("passed", F.lit(False))).alias("failed"), "sample_ix", *payload)
    return attempts.groupBy(*keys).agg(F.min(order).alias("b")).select(*keys, "b.sample_ix", (~F.col("b.failed")).alias("passed"), *[f"b.{c}" for c in payload])


def first_attempt(attempts: DataFrame, keys: Sequence[str] = CELL, payload: Sequence[str] = ()) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.min(F.struct("sample_ix", *payload)).alias("b")).select(*keys, "b.*")


def score_vectors(scores: DataFrame, value: str, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One array of scores in the order of models for each key; a missing model scores 0."""
    pick = [F.coalesce(F.max(F.when(F.col("model") == m, F.col(value))), F.lit(0.0)) for m in models]
    return scores.groupBy(*keys).agg(F.array(*pick).alias("vector"))


def rank_agreement(scores: DataFrame, *, value: str, models: Sequence[str], relations: Sequence[str], baseline: str, keys: Sequence[str] = ("task",)) -> DataFrame:
    """tau-b between each relation's model scores and the baseline's: keys, relation, tau_b.

    Every key is paired with every relation, and a missing cell scores 0. The result holds for each model alike, so it is computed once a task.
    """
    vectors = score_vectors(scores, value, models, [*keys, "relation"])
    zero = F.array(*[F.lit(0.0) for _ in models])
    by = vectors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("relation", "vector"))).alias("v"))
    grid = by.select(*keys, "v", F.explode(F.array(*[F.lit(r) for r in relations if r != baseline])).alias("relation"))
    base, variant = (F.coalesce(F.try_element_at("v", x), zero) for x in (F.lit(baseline), F.col("relation")))
    return grid.select(*keys, "relation", kendall_tau_b(base, variant).alias("tau_b"))


def mean_agreement(taus: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """The mean over variants; NaN where all are null."""
    return taus.groupBy(*keys).agg(F.coalesce(F.avg("tau_b"), F.lit(float("nan"))).alias("mean_tau_b"))


def agreement_interval(taus: DataFrame, relations: int, keys: Sequence[str] = ("task",), *, seed: int = 42) -> DataFrame:
    """mean_tau_b and the bootstrap interval of a key's tau_b values, in the order of relations; `relations` is how many there are."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("relation", "tau_b"))), lambda x: x["tau_b"])
    got = taus.groupBy(*keys).agg(values.alias("t"))
    interval = bootstrap_interval(F.col("t"), relations, seed=seed)
    return got.select(*keys, (F.aggregate("t", F.lit(0.0), lambda s, x: s + x) / F.size("t")).alias("mean_tau_b"), interval.alias("i")).select(*keys, "mean_tau_b", F.col("i.lower").alias("ci_lower"), F.col("i.upper").alias("ci_upper"))


def pairwise_disagreement(outputs: DataFrame) -> DataFrame:
    """How often two solutions of a task differ on an input: from (task, sol, inp, out).

    A pair agrees where both have an output and it is equal, so agreeing pairs are counted from class sizes; no solutions are paired. Rows repeat
    no (task, sol, inp). A task with fewer than two solutions has no comparisons and rate 0.
    """
    classes = outputs.groupBy("task", "inp", "out").agg(F.count(F.lit(1)).alias("c"))
    half = lambda x: F.floor(x * (x - 1) / 2)
    inputs = classes.groupBy("task", "inp").agg(half(F.sum("c")).alias("pairs"), F.sum(half(F.col("c"))).alias("same"))
    totals = inputs.groupBy("task").agg(F.count(F.lit(1)).alias("n_inputs"), F.sum("pairs").cast("long").alias("total_comparisons"), F.sum(F.col("pairs") - F.col("same")).cast("long").alias("disagreements"))
    solutions = outputs.groupBy("task").agg(F.countDistinct("sol").alias("n_solutions"))
    rate = F.when(F.col("total_comparisons") > 0, F.col("disagreements") / F.col("total_comparisons")).otherwise(0.0)
    return solutions.join(totals, "task").withColumn("rate", rate)


def consistency_gate(divergence: DataFrame, threshold: float | None = None) -> DataFrame:
    """Whether a task's suite would be augmented: at least two solutions that differ at least as often as the threshold (default 0.1)."""
    return divergence.withColumn("augment", (F.col("rate") >= (0.1 if threshold is None else threshold)) & (F.col("n_solutions") >= 2))


def page_trend(levels: DataFrame, keys: Sequence[str], *, strict: bool = False) -> DataFrame:
    """Page's L over the mean_tau_b of each key's rising levels: L, z, p_value, decreasing, note.

    The default weighs the negated values themselves and takes the variance with (k + 2), as the engine that this one replaces does, so
    z is negative for any input; strict ranks them and takes the textbook's variance. Under three levels only a note is given.
    """
    pair = F.array_sort(F.collect_list(F.struct(F.col("level").alias("l"), (-F.col("mean_tau_b")).alias("v"))))
    got = levels.groupBy(*keys).agg(pair.alias("x")).withColumn("k", F.size("x").cast("double"))
    k = F.col("k")
    value = lambda i: F.get(F.col("x"), i)["v"]
    if strict:
        below = lambda i: F.size(F.filter("x", lambda y: y["v"] < value(i)))
        equal = lambda i: F.size(F.filter("x", lambda y: y["v"] == value(i)))
        score = lambda i: below(i) + (equal(i) + 1) / 2
    else:
        score = value
    total = F.aggregate(F.sequence(F.lit(0), F.size("x") - 1), F.lit(0.0), lambda acc, i: acc + (i + 1) * score(i))
    mean = k * (k + 1) * (k + 1) / 4
    variance = k * k * (k + 1) * (k * k - 1) / 144 if strict else k * k * (k * k - 1) * (k + 2) / 144
    z = (F.col("L") - mean) / F.sqrt(variance)
    out = got.withColumn("L", F.when(k >= 3, total)).withColumn("z", F.when(k >= 3, z)).withColumn("p_value", normal_tail(F.col("z")))
    note = F.when(k < 3, F.lit("fewer than 3 levels"))
    return out.select(*keys, "L", "z", "p_value", (F.col("p_value") < 0.05).alias("decreasing"), note.alias("note"))


def trend_summary(trends: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    hit = F.count_if(F.coalesce("decreasing", F.lit(False)))
    return trends.agg(n.alias("n_tasks"), hit.alias("n_significant"), (hit / F.greatest(n, F.lit(1))).alias("fraction"))


def keep_share(rows: DataFrame, group: str, order: Sequence[Column], levels: Sequence[float]) -> DataFrame:
    """Rows that remain of each group when the first floor(n * level) in the given order go, for every level."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    ranked = rows.withColumn("rk", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).where(F.col("rk") > F.floor(F.col("n") * F.col("level")))
