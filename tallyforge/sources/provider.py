"""Completions: providers, the request grid, the response cache, and retries."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, written

#: A provider: (model, messages, temperature, max_tokens, n) -> completions.
Provider = Callable[[str, list[dict], float, int, int], list[str]]


# The stub's text before and after the model.
MOCK = ("# mock [", "]\ndef solution():\n    pass\n")


class Busy(RuntimeError):
    """The provider asks for a later try (HTTP 429 or 5xx)."""


def request_grid(tasks: DataFrame, relations: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Every task with every relation and model. The two dimensions are constants, so no join is needed."""
    return tasks.withColumn("relation", F.explode(F.array(*map(F.lit, relations)))).withColumn("model", F.explode(F.array(*map(F.lit, models))))


def mock_completions(requests: DataFrame, n: int) -> DataFrame:
    """n equal stubs a request, for runs without a provider; they are never cached."""
    stub = F.concat(F.lit(MOCK[0]), F.col("model"), F.lit(MOCK[1]))
    return requests.select("*", F.posexplode(F.array_repeat(stub, n)).alias("sample_ix", "completion"))


def retried(call: Callable[[], list[str]], *, attempts: int = 5, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Calls until it isn't Busy, sleeping base * 2 ** attempt between; the last failure is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except Busy:
            if attempt == attempts - 1:
                raise
            sleep(base * 2**attempt)
    raise ValueError("attempts must be positive")


def complete(
    requests: DataFrame,
    provider: Provider,
    *,
    temperature: float = 0.8,
    max_tokens: int = 1024,
    n: int = 1,
    in_flight: int = 5,
    requests_per_minute: float | None = None,
    lanes: int = 1,
    attempts: int = 5,
    rested: bool = True,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """requests (key, model, messages as JSON) with choices; a failed request has no choices.

    Requests are dealt to `lanes` partitions, each with its share of the calls in flight and of the rate, so both caps hold for the whole run: at most in_flight
    calls (one a lane at least) and one every 60 / requests_per_minute seconds. A lane starts its calls in turn. rested: the last call before these is long ago, so that
    each lane's first need not wait.
    """
    width, interval = max(1, in_flight // lanes), 60.0 * lanes / max(requests_per_minute, 0.1) if requests_per_minute else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lock, last = Lock(), [clock() - interval if rested else clock()]

        def paced() -> None:
            with lock:
                if (wait := last[0] + interval - clock()) > 0:
                    sleep(wait)
                last[0] = clock()

        def one(row) -> list[str]:
            paced()
            try:
                return retried(lambda: provider(row.model, json.loads(row.messages), temperature, max_tokens, n), attempts=attempts)
            except Exception:  # noqa: BLE001  the provider's failure is this row's result
                return []

        with ThreadPoolExecutor(width) as pool:
            for pdf in batches:
                yield pd.DataFrame({"key": pdf["key"], "choices": list(pool.map(one, pdf.itertuples()))})

    return requests.select("key", "model", "messages").repartition(lanes).mapInPandas(run, "key string, choices array<string>")


CACHED = "key string, choices array<string>"


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache in a folder of JSON lines; empty if there is none. A corrupt entry, or one without key or choices, is a miss; of several for one key one counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHED)
    rows = spark.read.text(folder).select(F.from_json("value", CACHED).alias("e")).select("e.*")
    return rows.where(F.col("key").isNotNull() & F.col("choices").isNotNull()).dropDuplicates(["key"])


def write_cache(fresh: DataFrame, folder: str) -> None:
    """Adds entries; requests that failed aren't kept."""
    fresh.where(F.size("choices") > 0).select("key", "choices").write.mode("append").json(folder)


def _misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.select("key", "model", "messages").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def through_cache(requests: DataFrame, cache: DataFrame, provider: Provider, **options) -> tuple[DataFrame, DataFrame]:
    """All requests' choices and the rows to add to the cache (key, choices): hits are joined, and only misses reach the provider, once a key. The answers are written to
    the shared folder before both tables are made of them."""
    fresh = written(complete(_misses(requests, cache), provider, **options), "answers")
    return requests.select("key").join(cache.unionByName(fresh), "key", "left"), fresh


def answer(requests: DataFrame, folder: str, provider: Provider, *, batch: int = 100, lanes: int = 1, **options) -> DataFrame:
    """All requests' choices (key, choices; null for those that failed), through the cache in `folder`, which keeps answers as they come.

    Misses, once a key, are queued as files of at most `batch` requests. A stream takes `lanes` files at a time and appends their answers to the cache before it takes
    the next, so a run that is stopped loses the calls of one step at most: the next run asks only for what the cache still lacks. Both caps of `complete` hold
    over the whole run.
    """
    spark = requests.sparkSession
    work = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    _misses(requests, read_cache(spark, folder)).repartition(lanes).write.option("maxRecordsPerFile", batch).parquet(f"{work}/requests")

    def ask(misses: DataFrame, step: int) -> None:
        write_cache(complete(misses, provider, lanes=lanes, rested=step == 0, **options), folder)

    queue = spark.readStream.schema("key string, model string, messages string").option("maxFilesPerTrigger", lanes).parquet(f"{work}/requests")
    queue.writeStream.option("checkpointLocation", f"{work}/steps").foreachBatch(ask).trigger(availableNow=True).start().awaitTermination()
    return requests.select("key").join(read_cache(spark, folder), "key", "left")


def table_provider(rows: dict[tuple[str, str], list[str]]) -> Provider:
    """A provider that looks replies up by model and last message."""
    return lambda model, messages, temperature, max_tokens, n: rows.get((model, messages[-1]["content"]), [])[:n]
