"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: The sampling key's space is cut into FAN * FAN ranges. Sizes are summed by range in two steps, so no window holds more than FAN rows
#: of a source, and rows are ordered only within the one range where a source's budget ends.
FAN = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Adds target to (source, source_size), one row a source: each source's share of all sizes by weight, at most
    max_epochs times its size, the excess going to the others by weight.

    The level that all uncapped sources reach, in size a unit of weight, is the largest of those got by capping
    the j sources of the least size a unit of weight, for any j. The windows order one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "_weight"
    ).over(by_room.rowsBetween(0, Window.unboundedFollowing))
    return (
        totals.withColumn("_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("_room", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("target", F.round(F.least("_cap", F.col("_weight") * F.max("_level").over(Window.partitionBy())), 6))
        .select("source", "source_size", "target")
    )


def _crossing(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of each source, the step at which the sizes summed by _step pass its budget _left: _source, _at, and what is left there."""
    run = Window.partitionBy("_source").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    sums = sized.groupBy("_source", "_step").agg(F.sum("size").alias("_n")).withColumn("_upto", F.sum("_n").over(run))
    return (
        sums.join(budgets, "_source")
        .where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_n") <= F.col("_left")))
        .select("_source", F.col("_step").alias("_at"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"))
    )


def mix_sources(
    docs: DataFrame, quality: DataFrame | None = None, *, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", few_sources: int = 10_000
) -> DataFrame:
    """How many words of each document a mix to target weights takes: doc_id, size, source_size, target, taken.

    A document's key is -ln(u) / quality, with u in (0, 1] from the MD5 of seed and doc_id: ascending keys sample
    without replacement in proportion to quality. A source first gives whole epochs, then documents by ascending key
    until the rounded target is met; the one that crosses it gives the words still wanted, so a source meets its
    rounded target exactly.

    quality holds a positive weight for some documents (doc_id, weight); of several the largest counts, and without one the weight is 1.
    A null text has size 0, a null source is a source of its own, ordered last; an empty table gives an empty
    result; equal keys go by doc_id and then size; repeated rows are taken one by one; other columns are ignored.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    sized = docs.select("doc_id", "source", key.alias("_source"), word_count(F.col("text")).alias("size"), (-F.ln(unit)).alias("_key"))
    if quality is not None:  # after the texts are reduced to sizes, so that these alone are shuffled
        best = quality.where(F.col("doc_id").isNotNull() & (F.col("weight") > 0)).groupBy("doc_id").agg(F.max("weight").alias("_weight"))
        sized = materialize(sized, "sizes").join(best, "doc_id", "left").withColumn("_key", F.col("_key") / F.coalesce("_weight", F.lit(1.0))).drop("_weight")
    sized = materialize(sized.withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * (FAN * FAN)).cast("int")), "sized")
    totals = sized.groupBy("source", "_source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs).withColumn("_source", key)
    wanted = F.round("target").cast("long")
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "_rest", wanted - F.col("_epochs") * F.col("source_size")
    )
    targets = materialize(targets, "targets")
    rest = targets.select("_source", F.col("_rest").alias("_left"))
    coarse = _crossing(sized.withColumn("_step", F.floor(F.col("_range") / FAN).cast("int")), rest).withColumnRenamed("_at", "_step")
    coarse = materialize(coarse, "mix-coarse")
    inner = sized.withColumn("_step", F.floor(F.col("_range") / FAN).cast("int")).join(small_side(coarse.drop("_left"), few_sources), ["_source", "_step"]).withColumn("_step", F.col("_range"))
    cut = _crossing(inner, coarse.select("_source", "_left")).withColumnRenamed("_at", "_cut")
    plan = materialize(targets.drop("source", "_rest").join(cut, "_source", "left"), "mix-plan")
    rows = sized.join(small_side(plan, few_sources), "_source")
    crossing = F.coalesce(F.col("_range") == F.col("_cut"), F.lit(False))
    whole = rows.where(~crossing).withColumn("_more", F.when(F.col("_range") < F.col("_cut"), F.col("size")).otherwise(0))
    before = F.sum("size").over(Window.partitionBy("_source").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = rows.where(crossing).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - before)))
    return whole.unionByName(part).select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_more")).cast("long").alias("taken"), "source")


def label_quality(labels: DataFrame) -> DataFrame:
    """Weights for mix_sources: 2 for documents that a label calls good, 1 for other labelled ones."""
    return labels.select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(1.0).alias("weight"))
