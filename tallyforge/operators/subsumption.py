"""Which mutants are subsumed: killed by every input that kills another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def kill_sets(kills: DataFrame) -> DataFrame:
    """(task, mutant, inp) of kills as one row for each different set of inputs: task, class (the least mutant), members, inputs in order."""
    sets = kills.groupBy("task", "mutant").agg(F.array_sort(F.collect_set("inp")).alias("inputs"))
    return sets.groupBy("task", "inputs").agg(F.min("mutant").alias("class"), F.array_sort(F.collect_list("mutant")).alias("members"))


def subsumes(sets: DataFrame) -> DataFrame:
    """Pairs of a task's classes where every input that kills `strong` kills `weak` as well, but not the other way: task, strong, weak.

    A set is looked for only among those that hold its rarest input, so that no task's mutants are all paired.
    """
    sets = written(sets.select("task", "class", "inputs"), "kill-sets")
    entries = sets.select("task", "class", F.explode("inputs").alias("inp"))
    often = entries.groupBy("task", "inp").agg(F.count(F.lit(1)).alias("times"))
    rarest = entries.join(often, ["task", "inp"]).groupBy("task", "class").agg(F.min(F.struct("times", "inp")).alias("r"))
    strong = sets.join(rarest, ["task", "class"]).select("task", F.col("r.inp").alias("inp"), F.col("class").alias("strong"), F.col("inputs").alias("_s"))
    weak = sets.select("task", F.explode("inputs").alias("inp"), F.col("class").alias("weak"), F.col("inputs").alias("_w"))
    pairs = strong.join(weak, ["task", "inp"]).where((F.size("_s") < F.size("_w")) & (F.size(F.array_except("_s", "_w")) == 0))
    return pairs.select("task", "strong", "weak")


def minimal_mutants(kills: DataFrame) -> DataFrame:
    """Every killed mutant with its class and whether it is needed: no other class of its task subsumes it: task, mutant, class, n_inputs, subsumed_by, minimal."""
    sets = written(kill_sets(kills), "classes")
    by = subsumes(sets).groupBy("task", F.col("weak").alias("class")).agg(F.count(F.lit(1)).alias("subsumed_by"))
    rows = sets.join(by, ["task", "class"], "left").withColumn("subsumed_by", F.coalesce("subsumed_by", F.lit(0)))
    return rows.select("task", F.explode("members").alias("mutant"), "class", F.size("inputs").cast("long").alias("n_inputs"), "subsumed_by", (F.col("subsumed_by") == 0).alias("minimal"))


def robust_slopes(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Theil and Sen's slope of y against x in each group, the median over all pairs of its points: by, n, slope. For few points a group, such as levels; points with nulls are left
    out, and a group without two different x has no slope."""
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y))).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.filter(F.slice("p", i + 2, F.size("p")), lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    s = F.array_sort(pairs)
    got = points.select(*by, F.size("p").cast("long").alias("n"), s.alias("s"))
    middle = lambda k: F.get("s", F.floor((F.size("s") - k) / 2).cast("int"))
    return got.select(*by, "n", F.when(F.size("s") > 0, (middle(1) + middle(0)) / 2).alias("slope"))
