"""Incremental runs: attempts arrive as files, and each batch updates the counts that all rates derive from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.attempts import CELL, attempt_counts, pass_rates


def follow_attempts(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the attempts written to a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_rates(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps pass rates by cell below `out`. The counts are the stream's keyed state; a micro-batch writes the cells that it changed, with all their attempts so far, to a
    folder of its own. A batch that is repeated replaces its folder by the same rows. latest_rates reads the last row of each cell, compact folds old folders."""

    def changed(batch: DataFrame, batch_id: int) -> None:
        pass_rates(batch).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/step={batch_id}")

    return attempt_counts(stream, CELL).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(changed).trigger(availableNow=True).start()


def _finished(spark: SparkSession, out: str, kind: str) -> list[int]:
    """The numbers of the folders of a kind that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def _rows(spark: SparkSession, out: str) -> tuple[DataFrame, list[int], int]:
    """The last row of each cell, the steps since the last folding, and the number of that."""
    upto = max(_finished(spark, out, "upto"), default=-1)
    steps = [s for s in _finished(spark, out, "step") if s > upto]
    folders = [f"{out}/upto={upto}"] * (upto >= 0) + [f"{out}/step={s}" for s in steps]
    rows = spark.read.parquet(*folders)
    values = [c for c in rows.columns if c not in CELL]
    last = rows.groupBy(*CELL).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*CELL, "v.*"), steps, upto


def latest_rates(spark: SparkSession, out: str) -> DataFrame:
    """The rates of every cell as of the last finished batch."""
    return _rows(spark, out)[0].drop("batch")


def compact(spark: SparkSession, out: str) -> None:
    """Folds all finished steps into one folder and deletes them. Until that folder is whole, the steps count."""
    rows, steps, upto = _rows(spark, out)
    if not steps:
        return
    rows.write.mode("overwrite").parquet(f"{out}/upto={steps[-1]}")
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    for name in [f"upto={upto}"] * (upto >= 0) + [f"step={s}" for s in steps]:
        path(name).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(name), True)
