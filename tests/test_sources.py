import gzip
import json

import pytest

from tallyforge.config import load_config
from tallyforge.sources import corpus, provider

ROWS = [{"task_id": f"Bench/{i}", "prompt": f"def f{i}():\n", "canonical_solution": "    pass\n", "test": "def check(c): pass\n", "entry_point": f"f{i}"} for i in range(5)]
TEXT = "\n\n".join(json.dumps(r) for r in ROWS)


@pytest.fixture(params=["plain", "gz"])
def path(request, tmp_path):
    p = tmp_path / ("c.jsonl" + (".gz" if request.param == "gz" else ""))
    p.write_bytes(gzip.compress(TEXT.encode()) if request.param == "gz" else TEXT.encode())
    return p


def test_read_and_select(spark, path):
    tasks = corpus.read_tasks(spark, path)
    assert tasks.count() == 5
    assert [r.task_index for r in corpus.select_tasks(tasks, [3, 1]).collect()] == [1, 3]
    with pytest.raises(corpus.UnknownTasks):
        corpus.select_tasks(tasks, [1, 99])
    assert tasks.where(corpus.TaskFilter(index=0).predicate()).count() == 1
    assert tasks.where(corpus.TaskFilter(first=1, last=2, listed=(4,)).predicate()).count() == 2


def test_locate(monkeypatch, tmp_path):
    monkeypatch.delenv(corpus.VARIABLE, raising=False)
    with pytest.raises(corpus.CorpusNotFound):
        corpus.locate(roots=[tmp_path])
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "HumanEval.jsonl.gz").write_bytes(gzip.compress(b""))
    assert corpus.locate(roots=[tmp_path]).suffix == ".gz"
    monkeypatch.setenv(corpus.VARIABLE, str(tmp_path / "data" / "HumanEval.jsonl.gz"))
    assert corpus.locate() == tmp_path / "data" / "HumanEval.jsonl.gz"


def test_export_round_trip(spark, path, tmp_path):
    tasks = corpus.read_tasks(spark, path)
    corpus.export_tasks(tasks, str(tmp_path / "out"))
    assert sorted(corpus.read_tasks(spark, tmp_path / "out").collect()) == sorted(tasks.collect())


def test_completions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"original": {"m": ["x", "y"], "n": []}}))
    got = corpus.read_completions(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r.model, r.sample_ix, r.completion) for r in got if r.completion) == [("m", 0, "x"), ("m", 1, "y")]
    assert any(r.model == "n" and r.completion is None for r in got)


def test_cache_and_provider(spark):
    requests = spark.createDataFrame([("k1", "m", json.dumps([{"role": "user", "content": "a"}])), ("k2", "m", json.dumps([{"role": "user", "content": "b"}]))], "key string, model string, messages string")
    cache = spark.createDataFrame([("k1", ["old"])], "key string, choices array<string>")
    got, fresh = provider.through_cache(requests, cache, provider.table_provider({("m", "b"): ["new"]}))
    assert {r.key: r.choices for r in got.collect()} == {"k1": ["old"], "k2": ["new"]}
    assert [r.key for r in fresh.collect()] == ["k2"]


def test_retries():
    slept, calls = [], []

    def busy():
        calls.append(1)
        raise provider.Busy

    with pytest.raises(provider.Busy):
        provider.retried(busy, sleep=slept.append)
    assert slept == [2, 4, 8, 16] and len(calls) == 5


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("llm:\n  models:\n    - id: a\n    - id: b\nbenchmark:\n  tasks: [0, 1]\n")
    c = load_config(p)
    assert c.llm.models == ("a", "b") and c.benchmark.tasks == (0, 1) and c.execution.timeout_s == 10.0
    p.write_text("llm:\n  modls: []\n")
    with pytest.raises(ValueError):
        load_config(p)


def test_incremental(spark, tmp_path):
    from tallyforge.streaming.incremental import follow_attempts, latest_rates, running_rates

    rows = spark.createDataFrame([(1, "r", "m", 0, True), (1, "r", "m", 1, False)], "task int, relation string, model string, sample_ix int, passed boolean")
    for turn in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        running_rates(follow_attempts(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        got = latest_rates(spark, str(tmp_path / "out")).first()
        assert (got.n, got.correct, got.pass_at_1) == (2 * (turn + 1), turn + 1, 0.5)


def test_batches_write_what_they_change(spark, tmp_path):
    """Cells that a batch doesn't touch aren't written again; a batch repeated after a crash changes nothing; folding keeps every cell."""
    from tallyforge.streaming import incremental as I

    schema = "task int, relation string, model string, sample_ix int, passed boolean"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows, checkpoint="cp"):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        I.running_rates(I.follow_attempts(spark, path, spark.createDataFrame([], schema).schema), out, str(tmp_path / checkpoint)).awaitTermination(60)

    state = lambda: {r.task: (r.n, r.correct) for r in I.latest_rates(spark, out).collect()}
    run([(t, "r", "m", 0, t % 2 == 0) for t in range(50)])
    run([(7, "r", "m", 1, True)])
    steps = sorted((tmp_path / "out").glob("step=*"), key=lambda p: int(p.name[5:]))
    assert spark.read.parquet(str(steps[-1])).count() == 1
    want = {t: (2, 1) if t == 7 else (1, int(t % 2 == 0)) for t in range(50)}
    assert state() == want
    run([])  # nothing new
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver had died before it noted the batch
    (tmp_path / "cp" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run([])
    assert state() == want
    (tmp_path / "out" / "step=99").mkdir()  # a step that was never finished
    I.compact(spark, out)
    I.compact(spark, out)
    assert state() == want and sorted(p.name[:4] for p in (tmp_path / "out").glob("*=*")) == ["step", "upto"]
    run([(7, "r", "m", 2, False), (60, "r", "m", 0, True)])
    assert state() == want | {7: (3, 1), 60: (1, 1)}
