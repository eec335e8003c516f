"""Task corpora: files, selection, export and result documents."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "task_id string, prompt string, canonical_solution string, test string, entry_point string"
VARIABLE = "TALLYFORGE_CORPUS"
RESULT = "map<string,map<string,array<string>>>"


class CorpusNotFound(RuntimeError):
    """No corpus file is where one is looked for."""


class UnknownTasks(ValueError):
    """Task indexes that the corpus lacks."""


def candidates(name: str = "HumanEval", roots: Sequence[str | Path] | None = None) -> list[Path]:
    """Where the corpus may be, best first: the file that $TALLYFORGE_CORPUS names, then `data` under the working folder and the package, plain before gzipped."""
    named = [Path(v)] if (v := os.environ.get(VARIABLE)) else []
    here = Path(__file__).resolve().parents[2]
    return named + [Path(r) / "data" / f"{name}{end}" for r in roots or (here, Path.cwd(), here / "tallyforge") for end in (".jsonl", ".jsonl.gz")]


def locate(name: str = "HumanEval", roots: Sequence[str | Path] | None = None) -> Path:
    for path in (tried := candidates(name, roots)):
        if path.exists():
            return path
    raise CorpusNotFound(f"no corpus among {', '.join(map(str, tried))}")


def indexed(tasks: DataFrame) -> DataFrame:
    """Adds task_index, the number after the slash of task_id, so that selections become predicates on an integer."""
    return tasks.withColumn("task_index", F.try_element_at(F.split("task_id", "/"), F.lit(2)).cast("int"))


def read_tasks(spark: SparkSession, path: str | Path) -> DataFrame:
    """A JSON-lines corpus, gzipped or not; blank lines are skipped. A gzipped file is one split, so it is dealt out again."""
    rows = spark.read.schema(TASK).json(str(path)).where("task_id is not null")
    return indexed(rows.repartition(spark.sparkContext.defaultParallelism) if str(path).endswith(".gz") else rows)


def missing(tasks: DataFrame, wanted: Sequence[int]) -> DataFrame:
    ask = tasks.sparkSession.createDataFrame([(int(i),) for i in wanted], "task_index int")
    return ask.join(tasks, "task_index", "left_anti")


def select_tasks(tasks: DataFrame, wanted: Sequence[int] | None = None, *, check: bool = True) -> DataFrame:
    """The wanted tasks (all for None) by index; UnknownTasks names those that are missing."""
    if wanted is not None:
        if check and (gone := sorted(r.task_index for r in missing(tasks, wanted).collect())):
            raise UnknownTasks(f"no tasks {gone}")
        tasks = tasks.where(F.col("task_index").isin([int(i) for i in wanted]))
    return tasks.orderBy("task_index")


@dataclass(frozen=True)
class TaskFilter:
    """One index, else an inclusive range, else a list; all tasks without any. Index 0 counts as given."""

    index: int | None = None
    first: int | None = None
    last: int | None = None
    listed: tuple[int, ...] | None = None

    def predicate(self) -> Column:
        i = F.col("task_index")
        if self.index is not None:
            return i == self.index
        if self.first is not None or self.last is not None:
            low = i >= self.first if self.first is not None else F.lit(True)
            return low & (i <= self.last) if self.last is not None else low
        return i.isin(list(self.listed)) if self.listed is not None else F.lit(True)


def label(task_id: Column) -> Column:
    return F.replace(task_id, F.lit("/"), F.lit("_"))


def export_tasks(tasks: DataFrame, folder: str) -> None:
    """Writes the corpus as gzipped JSON lines."""
    tasks.select(*[c.split()[0] for c in TASK.split(", ")]).write.mode("overwrite").option("compression", "gzip").json(folder)


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, one a file: relation -> model -> completions, as rows (path, relation, model, sample_ix, completion). An empty list gives a row with nulls."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", RESULT).alias("v"))
    models = docs.select("path", F.explode("v").alias("relation", "m")).select("path", "relation", F.explode("m").alias("model", "c"))
    return models.select("path", "relation", "model", F.posexplode_outer("c").alias("sample_ix", "completion"))


def write_results(rows: DataFrame, path: str, partition: str = "task_label") -> None:
    """Results by task; Spark's commit protocol leaves a task's folder whole or absent."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def export_results(rows: DataFrame, path: str, partition: str = "task_label") -> None:
    """The same as JSON rows, for readers without Parquet."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(path)


def result_documents(rows: DataFrame, partition: str = "task_label") -> DataFrame:
    """One document a task, relation -> model -> completions in order of sample_ix, of rows (relation, model, sample_ix, completion) and the partition column. A row with
    a null sample_ix stands for an empty list, as read_completions gives it."""
    entry = F.when(F.col("sample_ix").isNotNull(), F.struct("sample_ix", "completion"))
    lists = rows.groupBy(partition, "relation", "model").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["completion"]).alias("c"))
    models = lists.groupBy(partition, "relation").agg(F.map_from_entries(F.collect_list(F.struct("model", "c"))).alias("m"))
    return models.groupBy(partition).agg(F.map_from_entries(F.collect_list(F.struct("relation", "m"))).alias("v")).select(partition, F.to_json("v", {"ignoreNullFields": "false"}).alias("value"))


def export_documents(rows: DataFrame, path: str, partition: str = "task_label") -> None:
    """Writes result_documents as read_completions reads them: a folder a task, with one file. A task written again is replaced, others stay."""
    result_documents(rows, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).text(path)
