"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_batches(spark: SparkSession, megabytes: int = 8, rows: int = 2_000) -> None:
    """Bounds the Arrow batches that go to Python workers, unless the session has set them: by default 10,000 texts meet in one, in the JVM and in Python."""
    for key, value in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", f"{megabytes}m")):
        key = f"spark.sql.execution.arrow.{key}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that its lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes what materialize wrote for tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1] if df is not None else ():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def in_training(doc_id: Column) -> Column:
    """True for rows that models may learn from: crc32(doc_id as text) mod 4 is not 2. A null doc_id is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows; beyond that Spark plans a shuffled join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse powers modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (values[t] + 1) * BASE**t for i <= t < j."""
    p, _ = powers(len(values) + 1)
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], out=h[1:])
    return h


def gram_hash(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n values; equal runs have equal hashes."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    h = prefix_hash(values)
    _, inverse = powers(len(values) + 1)
    return mix64((h[n:] - h[:-n]) * inverse[: len(h) - n])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each whitespace-separated word, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    h = prefix_hash(raw)
    _, inverse = powers(len(raw) + 1)
    return mix64((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


def hash_unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def label_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About per_label rows of each label (all, if it has fewer), chosen by a hash of key: for fitting models only."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg((F.lit(float(per_label)) / F.count(F.lit(1))).alias("_rate"))
    return rows.join(small_side(counts, 10_000), label).where(hash_unit(F.lit("sample"), F.col(key)) < F.col("_rate")).drop("_rate")
