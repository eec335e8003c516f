import ast
import random

import pytest

from tallyforge.operators import programs as P
from tallyforge.plans.runs import TASKS

ODD = {
    "err": "def f(x):\n    return 1 // x\n", "state": "G = []\nprint('hi')\ndef f(x):\n    G.append(x)\n    print('in')\n    return G\n", "exit": "import sys\ndef f(x):\n    sys.exit('no')\n",
    "quiet": "import sys\ndef f(x):\n    sys.exit(0)\n", "syntax": "def f(x:\n", "loop": "def f(x):\n    while x == 2: pass\n    return x\n", "deep": "def f(x):\n    return f(x)\n",
    "long": "def f(x):\n    return 'x' * 100000\n", "word": "def f(x):\n    raise ValueError('é')\n", "ask": "def f(x):\n    return input()\n", "memory": "def f(x):\n    return len('a' * (1 << 33))\n",
}
ADD = "def add(a, b):\n    return a + b\n"
THREE = "def foo(x):\n    y = x + 1\n    z = y * 2\n    return z\n"


def test_mutants_parse_and_have_unique_ids():
    for _, prompt, solution, _, name in TASKS:
        found = P.mutate(prompt + solution, name)
        assert found and len({m[0] for m in found}) == len(found)
        for kind in P.OPERATORS:
            assert sum(m[1] == kind for m in found) <= 5
        for m in found:
            ast.parse(m[3])


def test_operator_filter_and_sizes():
    assert {m[1] for m in P.mutate(THREE, "foo", ["SDL"])} == {"SDL"}
    assert len(P.mutate(THREE, "foo", ["SDL"])) == 3
    assert P.mutate("", "foo") == []
    assert P.mutate("def broken(", "broken") == []
    assert [m[0] for m in P.mutate(ADD, "add", ["SDL"])] == []  # a single statement stays


def test_one_generator_serves_all_operators():
    rng = random.Random(42)
    sites = [0]
    rng.shuffle(sites)
    want = rng.choice(["Sub", "Mult", "FloorDiv"]).lower()
    assert P.mutate(ADD, "add", ["AOR"])[0][2] == f"Replace add with {want}"


def test_relational_compat_and_strict():
    source = "def f(x):\n    return x < 1 or x < 2 or x < 3\n"
    compat = P.mutate(source, "f", ["ROR"])
    assert all("x < 2" in m[3] and "x < 3" in m[3] for m in compat)  # always the first comparison
    strict = P.mutate(source, "f", ["ROR"], strict=True)
    assert len({tuple(t in m[3] for t in ("x < 1", "x < 2", "x < 3")) for m in strict}) == 3


def test_fallback():
    names = {m[0] for m in P.fallback_mutants("def f(x):\n    if x:\n        return x - 1\n    return 0\n")}
    assert names == {"AST_off_by_one", "AST_return_none", "AST_flip_cond"}
    assert P.fallback_mutants("def f():\n    return 0\n") == []
    assert P.fallback_mutants("def f(") == []


def test_degrade():
    suite = "def check(c):\n" + "".join(f"    assert c({i}) == {i}\n" for i in range(5))
    assert P.degrade(suite, 0.0) == suite
    assert P.degrade(suite, 0.5).count("assert") == 3
    assert P.degrade(suite, 1.0).strip().endswith("pass")
    assert P.degrade("def check(", 0.5) == "def check("


def test_inputs():
    assert P.inputs_for(ADD, "assert add(1, 2) == 3", "add", 3)[0] == (1, 2)
    assert P.inputs_for(ADD, "assert add(__import__('os'), 2) == 3", "add", 0) == []
    rng = random.Random(42)
    assert P.inputs_for(ADD, "", "add", 1) == [(rng.randint(-100, 100), rng.randint(-100, 100))]
    assert P.inputs_for(ADD, "candidate(4, 5)", "add", 1, strict=True) == [(4, 5)]
    assert P.annotations("def f(a: List[str], b): ...", "f") == ["List[str]", "int"]
    assert P.annotations("x = 1", "f") == ["int"]


def test_sandbox():
    assert P.execute("x = 1", "assert x == 1")[0]
    assert not P.execute("x = 1", "assert x == 2")[0]
    assert not P.execute("def f(", "")[0]
    assert P.execute("while True: pass", "", 0.5)[3]
    assert "HOME" in P.execute("import os; print(sorted(os.environ))", "")[1]
    assert "SECRET" not in P.execute("import os; print(sorted(os.environ))", "")[1]
    assert P.output_of(ADD, "add", "(1, 2)", 5) == "3"
    assert P.output_of(ADD, "add", "(1,)", 5).startswith("__error__:")
    assert P.shared_output("def f(x):\n    while True: pass", "f", "(1,)", 0.5) == "__error__"


def test_equivalence(spark):
    from tallyforge.plans.runs import task_frame

    tasks = task_frame(spark)
    rows = [("Bench/0", "same", "def add(a: int, b: int) -> int:\n    'Add.'\n    return a + b"), ("Bench/0", "swapped", "def add(a, b):\n    return b + a\n"), ("Bench/0", "wrong", "def add(a, b):\n    return a - b\n")]
    got = P.judge_mutants(tasks, spark.createDataFrame(rows, "task_id string, mutant_id string, code string"), n_inputs=4, timeout=5).collect()
    assert {r.mutant_id: r.reason for r in got} == {"same": "ast_identical", "swapped": "no_divergence", "wrong": "diverged"}


def test_consistency_suite():
    assert P.consistency_suite("t", 0.05, [(1,)], 3) == ""
    assert P.consistency_suite("t", 0.5, [(1,)], 1) == ""
    space: dict = {}
    exec(P.consistency_suite("t", 0.5, [(1,), (2,)], 2), space)  # noqa: S102
    space["_check_consistency"](abs, abs)


def test_valid_code():
    assert P.valid_code("```python\nx = 1\n```") == "x = 1"
    assert P.valid_code("def f(") is None


@pytest.mark.parametrize("name", ODD)
def test_a_block_equals_one_process_an_input(name):
    calls = ["(1,)", "(2,)", "(0,)"]
    assert P.outputs_of(ODD[name], "f", calls, 0.7) == [P.output_of(ODD[name], "f", c, 0.7) for c in calls]


def test_blocks_end_at_the_first_difference_and_survive_their_process():
    code = "import os\ndef f(x):\n    if x == 2: os.kill(os.getppid(), 9)\n    return x\n"
    assert P.outputs_of(code, "f", ["(1,)", "(2,)", "(0,)"], 1.0) == ["1", "__error__:", "0"]
    assert P.outputs_of(code, "f", ["(1,)", "(0,)", "(5,)"], 1.0, ["1", "7", "5"]) == ["1", "0"]
    assert P.outputs_of(code, "f", [], 1.0) == []


def slow_verdict(task, code, n, timeout):
    """One process an input, one after another."""
    _, prompt, solution, test, name = task
    if P.same_tree(prompt + solution, code):
        return True, "ast_identical", 0
    tested = 0
    for i, args in enumerate(P.inputs_for(prompt + solution, test, name, n)):
        want = P.output_of(prompt + solution, name, repr(args), timeout)
        if want == "__timeout__":
            continue
        tested += 1
        if P.output_of(code, name, repr(args), timeout) != want:
            return False, "diverged", i + 1
    return True, "no_divergence" if tested else "no_testable_inputs", tested


def test_rounds_equal_one_process_an_input(spark, monkeypatch):
    """Blocks of 4 and rounds ending at 4 and 8, so that mutants diverge in every one; a canonical program that runs out of time on some inputs, one on all."""
    monkeypatch.setattr(P, "ROUNDS", (4, 8))
    blocks = P.input_blocks
    monkeypatch.setattr(P, "input_blocks", lambda *a, **k: blocks(*a, **k, block=4))
    tasks = [
        ("T/0", "def f(x: int) -> int:\n", "    while x == 1: pass\n    return x\n", "def check(c):\n    " + "\n    ".join(f"f({i})" for i in range(12)) + "\n", "f"),
        ("T/1", "def g(x: int) -> int:\n", "    while True: pass\n", "def check(c):\n    g(1)\n", "g"),
    ]
    mutants = [("T/0", f"at{k}", f"def f(x):\n    return -1 if x == {k} else x\n") for k in (0, 1, 3, 5, 9, 11)]
    mutants += [("T/0", "late", "def f(x):\n    while x == 7: pass\n    return x\n"), ("T/0", "same", "def f(x: int) -> int:\n    while x == 1:\n        pass\n    return x"), ("T/1", "any", "def g(x):\n    return 1\n"), ("T/9", "lost", "x")]
    frame = spark.createDataFrame(tasks, "task_id string, prompt string, canonical_solution string, test string, entry_point string")
    got = P.judge_mutants(frame, spark.createDataFrame(mutants, "task_id string, mutant_id string, code string"), n_inputs=12, timeout=0.6).collect()
    by = {t[0]: t for t in tasks}
    want = {m: slow_verdict(by[t], code, 12 if t == "T/0" else 2, 0.6) for t, m, code in mutants if t in by}
    want["any"] = (True, "no_testable_inputs", 0)
    assert {r.mutant_id: (r.is_equivalent, r.reason, r.n_inputs_tested) for r in got} == want


def test_kill_matrix_leaves_out_equivalent_mutants(spark):
    """The given corpus: every mutant by hand. What 500 inputs can't tell from the program isn't run; a mutant that the suite misses survives."""
    from tallyforge.operators import mutants as M
    from tallyforge.plans.runs import task_frame

    tasks = task_frame(spark)
    rows = [
        ("Bench/0", "swapped", "AOR", "def add(a, b):\n    return b + a\n"), ("Bench/0", "minus", "AOR", "def add(a, b):\n    return a - b\n"), ("Bench/0", "lucky", "LLM", "def add(a, b):\n    return a + b if abs(a) < 50 else 0\n"),
        ("Bench/1", "loop", "ROR", "def clamp(x, low, high):\n    while True: pass\n"), ("Bench/1", "broken", "LLM", "def clamp("),
    ]
    mutants = spark.createDataFrame(rows, "task_id string, mutant_id string, operator string, code string")
    verdicts = P.judge_mutants(tasks, mutants, n_inputs=60, timeout=1.0)
    matrix = P.kill_matrix(tasks, mutants, verdicts, timeout=2.0).collect()
    assert {r.mutant_id: (r.is_killed, r.timed_out) for r in matrix} == {"minus": (True, False), "lucky": (False, False), "loop": (True, True), "broken": (True, False)}
    rates = {r.operator: (r.total, r.killed, r.survived) for r in M.kill_rates(spark.createDataFrame(matrix)).collect()}
    assert rates == {"AOR": (1, 1, 0), "LLM": (2, 1, 1), "ROR": (1, 1, 0)}
    assert P.kill_matrix(tasks, mutants.limit(0)).count() == 0
