"""Sessions, and sending this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cpus: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session in one process, for tests and the bench."""
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tallyforge")
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="tallyforge-ship-")) / "tallyforge.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(HERE.rglob("*.py")):
                z.write(source, source.relative_to(HERE.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark


def shipped(query):
    """A query that ships the package before it builds its plan."""

    @wraps(query)
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else a warehouse that isn't on each machine's own disk. Where the executors are this process, a temporary
    one serves; a cluster without either raises."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if context.master.startswith("local[") or context.master == "local":
        if context.applicationId not in _own_folder:
            _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="tallyforge-")
        return _own_folder[context.applicationId]
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") or ":" not in warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: what it took isn't done again, and its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
