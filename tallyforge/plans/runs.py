"""Queries over tasks, requests and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutants as M
from ..operators import programs as P
from ..operators import state as S
from ..sources import corpus, provider
from . import views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_TASKS = "tasks AS (SELECT 'Bench/' || p_partkey AS task_id, CAST(p_partkey AS INTEGER) AS task_index, p_name, p_size FROM part)"


def _tasks(spark, sf_dir):
    part = V.read(spark, sf_dir, "part")
    return corpus.indexed(part.select(F.concat(F.lit("Bench/"), F.col("p_partkey")).alias("task_id"), "p_name", "p_size"))


@query(f"WITH {_TASKS} SELECT * FROM tasks WHERE task_index IN (1, 5, 17, 42, 100)")
def scan_filter_sort(spark, sf_dir):
    return corpus.select_tasks(_tasks(spark, sf_dir), [1, 5, 17, 42, 100], check=False)


@query(f"WITH {_TASKS} SELECT CAST(x AS INTEGER) AS task_index FROM (SELECT unnest([1, 5, 999999, 17, 888888]) AS x) WHERE x NOT IN (SELECT task_index FROM tasks)")
def missing_keys(spark, sf_dir):
    return corpus.missing(_tasks(spark, sf_dir), [1, 5, 999999, 17, 888888])


@query(f"WITH {_TASKS} SELECT * FROM tasks WHERE task_index BETWEEN 10 AND 60")
def task_range(spark, sf_dir):
    return _tasks(spark, sf_dir).where(corpus.TaskFilter(first=10, last=60).predicate())


@query(f"WITH {_TASKS} SELECT task_index, replace(task_id, '/', '_') AS label FROM tasks")
def task_label(spark, sf_dir):
    return _tasks(spark, sf_dir).select("task_index", corpus.label(F.col("task_id")).alias("label"))


@query("SELECT item_id, i AS sample_ix, E'# mock [m]\\ndef solution():\\n    pass\\n' AS completion FROM benchmark, range(3) r(i)")
def mock_completions(spark, sf_dir):
    requests = V.read(spark, sf_dir, "benchmark").select("item_id", F.lit("m").alias("model"))
    return provider.mock_completions(requests, 3).select("item_id", F.col("sample_ix").cast("long").alias("sample_ix"), "completion")


@query("SELECT item_id, relation, model FROM benchmark, (SELECT unnest(['original', 'persona', 'formal', 'reorder', 'terse']) AS relation), (SELECT unnest(['F', 'O', 'P']) AS model)")
def request_grid(spark, sf_dir):
    from ..functions.text import RELATIONS

    return provider.request_grid(V.read(spark, sf_dir, "benchmark").select("item_id"), RELATIONS, V.MODELS)


_DONE = "done AS (SELECT event_id FROM events WHERE event_type = 'purchase' OR event_id % 7 = 0)"


@query(f"WITH {_DONE} SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM done)")
def pending_tasks(spark, sf_dir):
    e = V.read(spark, sf_dir, "events").select("event_id", "event_type")
    return S.pending(e.select("event_id"), e.where("event_type = 'purchase' or event_id % 7 = 0"), ["event_id"])


_KEY = r"""keys AS (SELECT event_id, sha256('{"max_tokens": 1024, "messages": [{"content": "' || replace(replace(coalesce(props, ''), '\', '\\'), '"', '\"') || '", "role": "user"}], "model": "' || event_type || '", "n": 1, "temperature": 0.8}') AS key FROM events)"""


def _keys(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return r.select("event_id", S.request_key(S.request_json(F.col("event_type"), F.coalesce("props", F.lit("")))).alias("key"))


@query(f"WITH {_KEY} SELECT event_id, key FROM keys")
def cache_key(spark, sf_dir):
    return _keys(spark, sf_dir)


@query(f"WITH {_KEY} SELECT event_id, key FROM keys WHERE key NOT IN (SELECT key FROM keys WHERE event_id % 3 = 0)")
def cache_miss(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    return S.cache_misses(keys, keys.where("event_id % 3 = 0"))


@query(f"""WITH {V.SQL_REQUESTS}, o AS (SELECT event_id, arrival_us, row_number() OVER (ORDER BY arrival_us, event_id) - 1 AS i FROM requests)
SELECT event_id, arrival_us, CAST(i * 600000000 + max(arrival_us - i * 600000000) OVER (ORDER BY i) AS BIGINT) AS slot_us FROM o""")
def token_bucket(spark, sf_dir):
    r = V.requests(spark, sf_dir).select("event_id", "arrival_us")
    return S.token_slots(r, arrival="arrival_us", order=["event_id"], per_minute=0.1).select("event_id", "arrival_us", "slot_us")


@query("SELECT CAST(i AS INTEGER) AS attempt, 2.0E0 * power(2.0E0, i) AS seconds FROM range(4) r(i)")
def backoff_schedule(spark, sf_dir):
    return spark.range(1).select(F.posexplode(S.backoff(5, 2.0)).alias("attempt", "seconds"))


_STAGES = ", ".join(f"({i}, '{s}', {'NULL' if p is None else repr(p)}, '{n}')" for i, (s, p, n) in enumerate(S.STAGES))
_RUN = ("stage0", "rq1", "rq2", "rq3", "rq4")


@query(f"""WITH stages(ix, stage, phase, name) AS (VALUES {_STAGES}), d AS (SELECT ['stage0', 'rq1', 'rq2', 'rq3', 'rq4'][CAST(event_id % 5 + 1 AS INTEGER)] AS stage, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'generate' ELSE 'evaluate' END AS phase, user_id FROM events),
c AS (SELECT stage, phase, count(DISTINCT user_id) AS n FROM d GROUP BY 1, 2), p AS (SELECT s.*, coalesce(n, 0) AS done, coalesce(n, 0) * 100.0E0 / 20000 AS percent FROM stages s LEFT JOIN c ON s.stage = c.stage AND s.phase IS NOT DISTINCT FROM c.phase)
SELECT ix, stage, coalesce(phase, '') AS phase, name, done, CAST(20000 AS BIGINT) AS n_tasks, percent, repeat('█', CAST(floor(percent / 5) AS INTEGER)) || repeat('░', 20 - CAST(floor(percent / 5) AS INTEGER)) AS bar FROM p""")
def progress(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    phase = F.when(F.col("event_id") % 3 == 1, "generate").when(F.col("event_id") % 3 == 2, "evaluate")
    done = e.select(F.get(F.array(*map(F.lit, _RUN)), (F.col("event_id") % 5).cast("int")).alias("stage"), phase.alias("phase"), F.col("user_id").alias("task"))
    return S.progress(done, 20000).withColumn("phase", F.coalesce("phase", F.lit("")))


# Programs: kinds of tasks as a corpus has them.
TASKS = [
    ("Bench/0", "def add(a: int, b: int) -> int:\n    \"\"\"Add.\"\"\"\n", "    return a + b\n", "def check(candidate):\n    assert candidate(1, 2) == 3\n    assert candidate(-1, 1) == 0\n", "add"),
    ("Bench/1", "def clamp(x: int, low: int, high: int) -> int:\n    \"\"\"Clamp x.\"\"\"\n", "    if x < low:\n        return low\n    if x > high:\n        return high\n    return x\n", "def check(candidate):\n    assert candidate(5, 0, 3) == 3\n    assert candidate(-5, 0, 3) == 0\n    assert clamp(1, 0, 3) == 1\n", "clamp"),
    ("Bench/2", "from typing import List\n\n\ndef total(xs: List[int]) -> int:\n    \"\"\"Sum of squares, modulo 97.\"\"\"\n", "    s = 0\n    for x in xs:\n        s = (s + x * x) % 97\n    return s\n", "def check(candidate):\n    assert candidate([1, 2]) == 5\n    assert candidate([]) == 0\n", "total"),
    ("Bench/3", "def shout(s: str) -> str:\n    \"\"\"Upper case.\"\"\"\n", "    t = s.upper()\n    return t\n", "def check(candidate):\n    assert candidate('a') == 'A'\n", "shout"),
]


def task_frame(spark):
    return spark.createDataFrame(TASKS, corpus.TASK)


def task_corpus(spark, sf_dir):
    """A task for each benchmark item: its kind, the function's name and constants follow from the item."""
    kinds = F.array(*[F.struct(*[F.lit(x).alias(c.split()[0]) for x, c in zip(t, corpus.TASK.split(", "), strict=True)]) for t in TASKS])
    items = V.read(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"), F.get(kinds, (F.col("item_id") % len(TASKS)).cast("int")).alias("t"))
    name = F.concat("t.entry_point", F.lit("_"), "item_id")
    code = lambda c: F.replace(F.replace(F.col(f"t.{c}"), F.concat("t.entry_point", F.lit("(")), F.concat(name, F.lit("("))), F.lit("% 97"), F.concat(F.lit("% "), (F.col("n") % 89 + 11).cast("string")))
    return items.select(F.concat(F.lit("Bench/"), "item_id").alias("task_id"), *[code(c).alias(c) for c in ("prompt", "canonical_solution", "test")], name.alias("entry_point"))


def _mutants(operator):
    def run(spark, sf_dir):
        return P.mutant_table(task_corpus(spark, sf_dir), [operator]).select("task_id", "mutant_id", "description", "code")

    return run


for _operator in P.OPERATORS:
    QUERIES[f"mutants_{_operator.lower()}"] = _mutants(_operator)


@query()
def mutant_counts(spark, sf_dir):
    return P.mutant_table(task_corpus(spark, sf_dir)).groupBy("task_id", "operator").agg(F.count(F.lit(1)).alias("n"))


def _programs(spark, sf_dir):
    tasks = task_corpus(spark, sf_dir)
    whole = tasks.select("task_id", F.lit("").alias("mutant_id"), F.concat("prompt", "canonical_solution").alias("code"))
    return whole.unionByName(P.mutant_table(tasks).select("task_id", "mutant_id", "code"))


# By hand, for each of TASKS in turn: nodes, depth and cyclomatic complexity.
@query("""SELECT 'Bench/' || item_id AS task_id, '' AS mutant_id, CAST(n AS BIGINT) AS n_nodes, CAST(d AS BIGINT) AS depth, CAST(c AS BIGINT) AS cyclomatic
FROM benchmark JOIN (VALUES (0, 15, 4, 1), (1, 28, 4, 3), (2, 32, 7, 2), (3, 15, 5, 1)) k(kind, n, d, c) ON item_id % 4 = kind""")
def program_complexity(spark, sf_dir):
    from ..operators.trees import complexity, syntax_nodes

    return complexity(syntax_nodes(_programs(spark, sf_dir).where("mutant_id = ''")))


@query()
def kills_by_complexity(spark, sf_dir):
    from ..operators.trees import rates_by_complexity

    return rates_by_complexity(kill_matrix(spark, sf_dir), program_complexity(spark, sf_dir))


@query()
def mutant_distances(spark, sf_dir):
    """A task's program and mutants that are at most three edits apart."""
    from ..operators.trees import near_programs, syntax_nodes

    return near_programs(syntax_nodes(_programs(spark, sf_dir)), 3)


@query()
def mutants_fallback(spark, sf_dir):
    return P.fallback_table(task_corpus(spark, sf_dir))


@query()
def fuzz_inputs(spark, sf_dir):
    return P.input_table(task_corpus(spark, sf_dir), 500)


@query()
def sandbox_run(spark, sf_dir):
    """Kill tests: every mutant against its task's suite."""
    tasks = task_corpus(spark, sf_dir)
    programs = P.mutant_table(tasks).join(tasks.select("task_id", F.concat("test", F.lit("\ncheck("), "entry_point", F.lit(")\n")).alias("test")), "task_id")
    ran = P.run_programs(programs.withColumnRenamed("code", "solution").repartition(8, "task_id", "mutant_id"), timeout=5.0)
    return ran.select("task_id", "mutant_id", "operator", (~F.col("passed")).alias("is_killed"), "timed_out")


@query()
def degraded_suites(spark, sf_dir):
    return P.degraded_suites(task_corpus(spark, sf_dir), V.LEVELS)


@query()
def mutant_equivalence(spark, sf_dir):
    tasks = task_corpus(spark, sf_dir)
    return P.judge_mutants(tasks, P.mutant_table(tasks), timeout=5.0)


# By hand, for each of TASKS in turn: the mutants that aren't equivalent. The suites kill them all; deleting a docstring is the one equivalent change.
_KILLS = {
    0: "AOR_0 SDL_2 AST_off_by_one AST_return_none", 1: "ROR_0 ROR_1 SDL_3 SDL_4 SDL_5 AST_flip_cond AST_return_none", 2: "AOR_0 AOR_1 AOR_2 SDL_4 SDL_5 SDL_6 AST_off_by_one AST_return_none", 3: "SDL_1 SDL_2 AST_return_none",
}
_MATRIX = ", ".join(f"({kind}, '{m}')" for kind, names in _KILLS.items() for m in names.split())
_MATRIX = f"""SELECT 'Bench/' || item_id AS task_id, mutant_id, CASE WHEN starts_with(mutant_id, 'AST') THEN 'LLM' ELSE split_part(mutant_id, '_', 1) END AS operator,
true AS is_killed, false AS timed_out FROM benchmark JOIN (VALUES {_MATRIX}) k(kind, mutant_id) ON item_id % 4 = kind"""


@query(_MATRIX)
def kill_matrix(spark, sf_dir):
    """Traditional and generated mutants, without those that 500 inputs find equivalent, against their tasks' suites."""
    tasks = task_corpus(spark, sf_dir)
    mutants = M.all_mutants(P.mutant_table(tasks), P.fallback_table(tasks))
    return P.kill_matrix(tasks, mutants, P.judge_mutants(tasks, mutants, timeout=5.0), timeout=5.0)


@query(f"SELECT operator, count(*) AS total, count(*) FILTER (is_killed) AS killed, count(*) FILTER (NOT is_killed) AS survived, round(count(*) FILTER (is_killed) / count(*)::DOUBLE, 6) AS kill_rate FROM ({_MATRIX}) GROUP BY operator")
def kill_summary(spark, sf_dir):
    return M.kill_rates(kill_matrix(spark, sf_dir)).withColumn("kill_rate", F.round("kill_rate", 6))


def _solutions(spark, sf_dir):
    """Three completions of each task: the canonical body, a fenced whole program and a body that returns nothing. A body is taken from its definition on, so the fenced
    program of the kind that imports before it fails."""
    tasks = task_corpus(spark, sf_dir)
    fenced = F.concat(F.lit("Here:\n```python\n"), "prompt", "canonical_solution", F.lit("```\n"))
    return tasks, tasks.select("task_id", F.posexplode(F.array("canonical_solution", fenced, F.lit("    return None\n"))).alias("sol", "completion"))


@query("SELECT 'Bench/' || item_id AS task_id, CAST(sol AS INTEGER) AS sol, sol = 0 OR (sol = 1 AND item_id % 4 <> 2) AS passed, false AS timed_out FROM benchmark, range(3) s(sol)")
def completion_runs(spark, sf_dir):
    tasks, solutions = _solutions(spark, sf_dir)
    return P.run_completions(solutions, tasks, deal=8).drop("completion")


@query("SELECT 'Bench/' || item_id AS task, CAST(3 AS BIGINT) AS n_solutions, CAST(500 AS BIGINT) AS n_inputs, CAST(1500 AS BIGINT) AS total_comparisons, CAST(CASE item_id % 4 WHEN 2 THEN 1500 ELSE 1000 END AS BIGINT) AS disagreements, CASE item_id % 4 WHEN 2 THEN 1E0 ELSE round(2 / 3::DOUBLE, 6) END AS rate FROM benchmark")
def solution_divergence(spark, sf_dir):
    tasks, solutions = _solutions(spark, sf_dir)
    return P.shared_divergence(solutions, tasks).withColumn("rate", F.round("rate", 6))


@query("SELECT 'Bench/' || item_id AS task_id, 'LLM_' || i AS mutant_id FROM benchmark, (VALUES (1), (3), (4)) v(i)")
def llm_mutants(spark, sf_dir):
    """Replies to the mutation requests: the canonical program, a fenced fault, one that doesn't parse, and three more faults; the first three that do are taken."""
    tasks = task_corpus(spark, sf_dir)
    program = F.concat("prompt", "canonical_solution")
    fault = F.concat(F.lit("```python\n"), F.replace(program, F.lit("return "), F.lit("return not ")), F.lit("\n```"))
    choices = F.array(program, fault, F.lit("def broken("), *[F.concat(program, F.lit(f"\nx = {i}\n")) for i in range(3)])
    asked = P.mutation_requests(tasks, ["m"]).select("task_id", "model")
    return P.generated_mutants(asked.join(tasks.select("task_id", choices.alias("choices")), "task_id"), tasks).select("task_id", "mutant_id")


@query("""SELECT 'Bench/' || item_id AS task_id, CAST(0 AS INTEGER) AS sol, round(CASE item_id % 4 WHEN 2 THEN 1.0E0 / 3 WHEN 3 THEN 0.5E0 ELSE 0.0E0 END, 4) AS semantic_score FROM benchmark""")
def reverse_semantics(spark, sf_dir):
    """Bigram overlap of inferred specs with the docstrings of four kinds of tasks."""
    tasks = task_corpus(spark, sf_dir)
    specs = F.array(F.lit("add two numbers"), F.lit("limits x"), F.lit("the sum of digits"), F.lit("to upper case."))
    kind = (F.substring_index("task_id", "/", -1).cast("int") % 4).cast("int")
    replies = tasks.select("task_id", F.lit(0).alias("sol"), F.array(F.get(specs, kind)).alias("choices"))
    return P.reverse_scores(replies, tasks).select("task_id", "sol", "semantic_score")
