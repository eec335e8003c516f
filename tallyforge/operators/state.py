"""Checkpoints, request keys, rate limits and progress."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages of a run, their phases and names.
STAGES = (
    ("stage0", None, "equivalence filter"),
    ("rq1", "generate", "mutant generation"),
    ("rq1", "evaluate", "kill rate"),
    ("rq2", "generate", "completions"),
    ("rq2", "evaluate", "pass@k and rank agreement"),
    ("rq3", "execute", "divergence"),
    ("rq3", "score", "overlap scores"),
    ("rq4", "degrade", "degradation"),
    ("rq4", "augment", "augmentation"),
)


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks that no completed run has."""
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def escaped(text: Column) -> Column:
    """ASCII text as the inside of a JSON string."""
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def request_json(model: Column, content: Column, *, role: str = "user", temperature: float = 0.8, max_tokens: int = 1024, n: int = 1) -> Column:
    """A request of one message with sorted keys, as Python's json writes it. For ASCII content; else use canonical_json."""
    return F.concat(
        F.lit(f'{{"max_tokens": {max_tokens}, "messages": [{{"content": "'), escaped(content), F.lit(f'", "role": "{role}"}}], "model": "'), escaped(model), F.lit(f'", "n": {n}, "temperature": {temperature}}}')
    )


def request_key(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def key_of(model: str, messages: list[dict], **params) -> str:
    """The same key for one request on the driver."""
    return hashlib.sha256(json.dumps({"model": model, "messages": messages} | params, sort_keys=True).encode()).hexdigest()


def canonical_json(document: Column) -> Column:
    """Any JSON text with sorted keys and escaped non-ASCII characters. Null for text that isn't JSON."""

    def sort(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True)
            except ValueError:
                return None

        return s.map(one)

    return F.pandas_udf(sort, "string")(document)


def cache_misses(requests: DataFrame, responses: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(responses.select(key), key, "left_anti")


def token_slots(requests: DataFrame, *, arrival: str, order: Sequence[str], per_minute: float, bucket_us: int = 3_600_000_000) -> DataFrame:
    """When each request is sent under a minimum interval: slot_us, wait_us, from arrivals in microseconds.

    The i-th slot is i * interval plus the running maximum of arrival_j - j * interval. Rows are ranked within time buckets; each bucket's count and maximum
    come from an aggregate, and only the buckets themselves are ordered in one window. Rows with a null arrival are left out.
    """
    step = F.lit(int(round(60_000_000 / max(per_minute, 0.1))))
    rows = requests.where(F.col(arrival).isNotNull()).withColumn("_b", F.floor(F.col(arrival) / bucket_us))
    inside = Window.partitionBy("_b").orderBy(arrival, *order)
    rows = rows.withColumn("_i", F.row_number().over(inside).cast("long") - 1)
    early = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(arrival) - F.col("_i") * step).alias("_m"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    early = early.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    early = early.withColumn("_top", F.max(F.col("_m") - F.col("_off") * step).over(before)).select("_b", "_off", "_top")
    rows = rows.join(early, "_b")
    place = F.col("_off") + F.col("_i")
    own = F.max(F.col(arrival) - place * step).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot_us", place * step + F.greatest(own, F.coalesce("_top", own))).withColumn("wait_us", F.col("slot_us") - F.col(arrival)).drop("_b", "_i", "_off", "_top")


def backoff(attempts: int, base: float) -> Column:
    """Seconds slept after each failed attempt but the last, which raises."""
    if attempts < 2:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 2)), lambda i: F.lit(float(base)) * F.pow(F.lit(2.0), i))


def progress(done: DataFrame, n_tasks: int, stages: Sequence[tuple] = STAGES, width: int = 20) -> DataFrame:
    """done (stage, phase, task) as count, percent and bar of each stage; 0 % if there are no tasks. A null phase matches a null phase."""
    spark = done.sparkSession
    dim = spark.createDataFrame([(i, s, p, name) for i, (s, p, name) in enumerate(stages)], "ix int, stage string, phase string, name string")
    counts = done.groupBy("stage", "phase").agg(F.countDistinct("task").alias("done"))
    both = dim.alias("d").join(counts.alias("c"), (F.col("d.stage") == F.col("c.stage")) & F.col("d.phase").eqNullSafe(F.col("c.phase")), "left")
    n = F.coalesce("c.done", F.lit(0))
    percent = n * 100.0 / n_tasks if n_tasks else F.lit(0.0)
    filled = F.floor(percent * width / 100).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
    return both.select("ix", "d.stage", "d.phase", "name", n.alias("done"), F.lit(n_tasks).cast("long").alias("n_tasks"), percent.alias("percent"), bar.alias("bar"))
