"""Tables of mutants, verdicts and kills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT = "__timeout__"


def not_equivalent(mutants: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("task", "mutant_id")) -> DataFrame:
    """Mutants without an equivalent verdict; an unjudged one stays."""
    return mutants.join(verdicts.where("is_equivalent").select(*keys), list(keys), "left_anti")


def all_mutants(traditional: DataFrame, generated: DataFrame | None) -> DataFrame:
    return traditional if generated is None else traditional.unionByName(generated, allowMissingColumns=True)


def kill_rates(kills: DataFrame, keys: Sequence[str] = ("operator",)) -> DataFrame:
    total, killed = F.count(F.lit(1)), F.count_if("is_killed")
    return kills.groupBy(*keys).agg(total.alias("total"), killed.alias("killed"), (total - killed).alias("survived"), (killed / total).alias("kill_rate"))


def first_valid(candidates: DataFrame, valid: str, n: int, *, task: str = "task", order: str = "raw_ix") -> DataFrame:
    """The first n valid candidates of each task, named by their place among all."""
    w = Window.partitionBy(task).orderBy(order)
    return candidates.where(valid).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).withColumn("mutant_id", F.concat(F.lit("LLM_"), F.col(order))).drop("rn")


def verdicts(canonical: DataFrame, mutants: DataFrame, runs: DataFrame) -> DataFrame:
    """Equivalence by differential execution: canonical (task, ix, out), mutants (task, mutant), runs (task, mutant, ix, out).

    Inputs on which the canonical program timed out say nothing. A mutant that times out or differs on another has diverged at the first such; its count of tested
    inputs is that input's place, skipped ones included, and the number of inputs compared otherwise. Without any it passes as equivalent.
    """
    usable = canonical.where(F.col("out") != TIMEOUT).select("task", "ix", F.col("out").alias("want"))
    seen = runs.join(usable, ["task", "ix"])
    bad = (F.col("out") == TIMEOUT) | (F.col("out") != F.col("want"))
    tally = seen.groupBy("task", "mutant").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.col("ix"))).alias("first"))
    n, first = F.coalesce("n", F.lit(0)), F.col("first")
    reason = F.when(first.isNotNull(), "diverged").when(n == 0, "no_testable_inputs").otherwise("no_divergence")
    tested = F.when(first.isNotNull(), first + 1).otherwise(n)
    return mutants.join(tally, ["task", "mutant"], "left").select("task", "mutant", first.isNull().alias("is_equivalent"), reason.alias("reason"), tested.cast("long").alias("n_inputs_tested"))
