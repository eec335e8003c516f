"""Completions, divergence, generated mutants and reverse scores composed from their parts; rank statistics; caches and rates."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import programs as P
from tallyforge.operators import tests as T
from tallyforge.plans.runs import task_frame
from tallyforge.sources import corpus, provider


def test_completions_pass_or_fail(spark):
    tasks = task_frame(spark)
    rows = [("Bench/0", 0, "    return a + b\n"), ("Bench/0", 1, "```python\ndef add(a, b):\n    return a + b\n```"), ("Bench/0", 2, "    return a - b\n"), ("Bench/0", 3, None), ("Bench/9", 0, "x")]
    got = P.run_completions(spark.createDataFrame(rows, "task_id string, sol int, completion string"), tasks).collect()
    assert {(r.sol, r.passed) for r in got} == {(0, True), (1, True), (2, False), (3, False)}


def test_divergence_counts_differing_outputs(spark):
    rows = [("Bench/0", 0, "    return a + b\n"), ("Bench/0", 1, "    return b + a\n"), ("Bench/0", 2, "    raise ValueError\n"), ("Bench/0", 3, "    while True: pass\n"), ("Bench/1", 0, "    return x\n")]
    got = P.shared_divergence(spark.createDataFrame(rows, "task_id string, sol int, completion string"), task_frame(spark), n_inputs=2, timeout=0.7).collect()
    by = {r.task: r for r in got}
    assert (by["Bench/0"].total_comparisons, by["Bench/0"].disagreements) == (12, 8)  # errors and timeouts are one output
    assert by["Bench/1"].rate == 0.0


def test_generated_mutants(spark):
    tasks = task_frame(spark).where("task_id = 'Bench/0'")
    asked = P.mutation_requests(tasks, ["m", "n"], 3).collect()
    assert len(asked) == 2 and all(r.n == 5 and "return a + b" in r.messages[1].content for r in asked)
    canon = tasks.first()
    choices = [canon.prompt + canon.canonical_solution + "\n", "def add(", "```\ndef add(a, b):\n    return a - b\n```", "def add(a, b):\n    return b\n"]
    got = P.generated_mutants(spark.createDataFrame([("Bench/0", "m", choices)], "task_id string, model string, choices array<string>"), tasks, 1).collect()
    assert [(r.mutant_id, r.operator, r.code) for r in got] == [("LLM_2", "LLM", "def add(a, b):\n    return a - b")]


def test_reverse_scores(spark):
    tasks = spark.createDataFrame([("t", 'def f():\n    """Return the larger number of both"""\n', "", "", "f")], corpus.TASK)
    replies = spark.createDataFrame([("t", 0, ["the larger number wins"]), ("t", 1, [])], "task_id string, sol int, choices array<string>")
    got = {r.sol: r for r in P.reverse_scores(replies, tasks).collect()}
    assert (got[0].semantic_score, got[0].bleu_score, got[0].completeness_score, got[0].sbc_score) == (0.6667, 0.75, 0.5, 0.6389)
    assert (got[1].inferred_spec, got[1].sbc_score) == ("", 0.0)


def test_ranks_in_buckets_equal_plain_ranks(spark):
    values = [float((i * 7919) % 503) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.r for r in T.average_ranks(df, "v", "r").collect()}
    ordered = sorted(values)
    assert all(got[v] == ordered.index(v) + (ordered.count(v) + 1) / 2 for v in set(values))
    assert T.average_ranks(df.limit(0), "v", "r").count() == 0


def test_p_values(spark):
    """Known values: t tables, and the permutation-free formulas on a small sample."""
    for t, freedom, p in ((12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.962, 1000, 0.05), (0.0, 7, 1.0)):
        got = spark.range(1).select(stats.student_tails(F.lit(t), F.lit(freedom)).alias("p")).first().p
        assert got == pytest.approx(p, abs=2e-4)
    pairs = spark.createDataFrame([(float(x), float(y)) for x, y in zip(range(8), (1, 2, 4, 3, 6, 5, 8, 7))], "x double, y double")
    k, s = T.kendall(pairs, exact=False).first(), T.spearman(pairs).first()
    assert k.tau_b == pytest.approx(22 / 28) and k.p_value == pytest.approx(math.erfc(22 / math.sqrt(8 * 7 * 21 / 18) / math.sqrt(2)), abs=1e-6)
    assert s.rho == pytest.approx(1 - 6 * 6 / (8 * 63)) and 0 < s.p_value < 0.001


def test_rate_and_cache(spark, tmp_path):
    asked = spark.createDataFrame([(f"k{i}", "m", json.dumps([{"role": "user", "content": str(i)}])) for i in range(4)], "key string, model string, messages string")

    def answer(model, messages, temperature, max_tokens, n):
        import time

        return [] if messages[-1]["content"] == "3" else [repr(time.monotonic())]

    got = provider.complete(asked, answer, requests_per_minute=300.0, in_flight=4).collect()
    at = sorted(float(r.choices[0]) for r in got if r.choices)
    assert len(at) == 3 and at[2] - at[0] >= 0.35  # 0.2 s apart, in one lane for the whole run
    folder = str(tmp_path / "cache")
    provider.write_cache(spark.createDataFrame([(r.key, r.choices) for r in got], provider.CACHED), folder)
    (tmp_path / "cache" / "part-x.json").write_text('not valid json\n{"key": "k9"}\n')
    assert {r.key for r in provider.read_cache(spark, folder).collect()} == {"k0", "k1", "k2"}  # corrupt and failed entries are misses


def test_result_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "task_label string, n int")
    for write, read in ((corpus.write_results, spark.read.parquet), (corpus.export_results, spark.read.json)):
        path = str(tmp_path / write.__name__)
        write(rows, path)
        write(rows.where("n = 2").selectExpr("task_label", "n + 1 as n"), path)  # replaces that task only
        assert {(r.task_label, r.n) for r in read(path).collect()} == {("a", 1), ("b", 3)}


def asked(spark, n):
    return spark.createDataFrame([(f"k{i}", "m", json.dumps([{"role": "user", "content": str(i)}])) for i in range(n)], "key string, model string, messages string")


def counting(folder):
    """A provider that leaves a file for each call."""

    def call(model, messages, temperature, max_tokens, n):
        import os
        import uuid

        text = messages[-1]["content"]
        open(f"{folder}/{text}-{uuid.uuid4().hex}", "w").close()
        if os.path.exists(f"{folder}/stop") and int(text) % 10 == 7:
            os._exit(1)  # the worker is lost
        return [] if text == "3" else [f"answer {text}"]

    return call


def test_each_miss_is_asked_once(spark, tmp_path):
    requests = asked(spark, 20).union(asked(spark, 20))
    old = spark.createDataFrame([("k1", ["old"])], provider.CACHED)
    got, fresh = provider.through_cache(requests, old, counting(tmp_path))
    provider.write_cache(fresh, str(tmp_path / "cache"))
    answers = {r.key: r.choices for r in got.collect()}
    assert got.count() == 40 and answers["k1"] == ["old"] and answers["k3"] == [] and answers["k5"] == ["answer 5"]
    assert len(list(tmp_path.glob("*-*"))) == 19
    kept = {r.key: r.choices for r in provider.read_cache(spark, str(tmp_path / "cache")).collect()}
    assert kept == {k: v for k, v in answers.items() if k not in ("k1", "k3")}


def test_answers_are_kept_as_they_come(spark, tmp_path):
    """A run that loses its worker keeps what it had been told; the next asks for the rest only, and a third for nothing but the failed one."""
    (calls := tmp_path / "calls").mkdir()
    (calls / "stop").touch()
    requests, cache = asked(spark, 30), str(tmp_path / "cache")
    with pytest.raises(Exception):  # noqa: B017
        provider.answer(requests, cache, counting(calls), batch=2)
    before, kept = len(list(calls.glob("*-*"))), provider.read_cache(spark, cache).count()
    assert kept >= before - 2 - 1  # a step of two at most, and the one that fails
    (calls / "stop").unlink()
    got = {r.key: r.choices for r in provider.answer(requests, cache, counting(calls), batch=7, lanes=2, in_flight=4).collect()}
    assert got == {f"k{i}": None if i == 3 else [f"answer {i}"] for i in range(30)}
    assert len(list(calls.glob("*-*"))) == before + 30 - kept
    provider.answer(requests, cache, counting(calls))
    assert len(list(calls.glob("*-*"))) == before + 31 - kept


def test_documents_round_trip(spark, tmp_path):
    rows = [("T_0", "original", "m", i, f"c{i}\n\"é\"") for i in range(12)] + [("T_0", "terse", "n", None, None), ("T_1", "original", "m", 0, None), ("T_1", "original", "n", 0, "x")]
    frame = spark.createDataFrame(rows, "task_label string, relation string, model string, sample_ix int, completion string")
    corpus.export_documents(frame, str(tmp_path / "out"))
    corpus.export_documents(frame.where("task_label = 'T_1' and model = 'n'"), str(tmp_path / "out"))
    got = corpus.read_completions(spark, str(tmp_path / "out" / "*" / "*.txt")).select(F.regexp_extract("path", "task_label=([^/]*)/", 1), "relation", "model", "sample_ix", "completion")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[:3] != ("T_1", "original", "m")), key=str)
