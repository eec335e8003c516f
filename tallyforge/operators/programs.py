"""Operators that need a program's syntax tree or run it: mutants, degraded suites, inputs, sandboxed runs."""

from __future__ import annotations

import ast
import inspect
import json
import os
import random
import re
import resource
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import child
from .attempts import pairwise_disagreement
from .mutants import TIMEOUT, first_valid, not_equivalent

# What each operator may become, in the order that seeded choices depend on.
ARITHMETIC = {
    "Add": ["Sub", "Mult", "FloorDiv"],
    "Sub": ["Add", "Mult", "FloorDiv"],
    "Mult": ["Add", "Sub", "FloorDiv"],
    "FloorDiv": ["Add", "Sub", "Mult"],
    "Div": ["Sub", "Mult", "FloorDiv"],
    "Mod": ["Add", "Sub", "Mult"],
}
RELATIONAL = {
    "Lt": ["LtE", "Gt", "GtE", "Eq", "NotEq"],
    "LtE": ["Lt", "Gt", "GtE", "Eq", "NotEq"],
    "Gt": ["Lt", "LtE", "GtE", "Eq", "NotEq"],
    "GtE": ["Lt", "LtE", "Gt", "Eq", "NotEq"],
    "Eq": ["Lt", "LtE", "Gt", "GtE", "NotEq"],
    "NotEq": ["Lt", "LtE", "Gt", "GtE", "Eq"],
}
LETTERS = "abcdefghijklmnopqrstuvwxyz 0123456789"
OPERATORS = ("AOR", "ROR", "SDL")
MUTANT = "task_id string, mutant_id string, operator string, description string, code string"
Found = list[tuple[str, str, str, str]]


def name_of(node: ast.AST) -> str:
    return type(node).__name__


def parsed(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError):
        return None


class Edit:
    """A change to a tree that is undone on leaving."""

    def __init__(self, get: Callable, put: Callable, value) -> None:
        self.put, self.value, self.old = put, value, get()

    def __enter__(self) -> None:
        self.put(self.value)

    def __exit__(self, *_) -> None:
        self.put(self.old)


def function_named(tree: ast.AST, name: str) -> ast.FunctionDef | None:
    return next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name == name), None)


def mutate(source: str, entry_point: str, operators: Sequence[str] = OPERATORS, *, limit: int = 5, seed: int = 42, strict: bool = False) -> Found:
    """First-order mutants (id, operator, description, code), at most `limit` an operator; none for source that doesn't parse.

    One seeded generator shuffles the sites of each operator and picks replacements; one counter numbers all mutants. A relational mutant changes the first
    comparison that has the chosen operator at the chosen place in its chain, which may not be the chosen one; strict changes that one.
    """
    tree = parsed(source)
    if tree is None:
        return []
    rng, out = random.Random(seed), []

    def add(kind: str, description: str, edit: Edit) -> None:
        with edit:
            out.append((f"{kind}_{len(out)}", kind, description, ast.unparse(tree)))

    if "AOR" in operators:
        sites = [n for n in ast.walk(tree) if isinstance(n, ast.BinOp) and name_of(n.op) in ARITHMETIC]
        rng.shuffle(sites)
        for node in sites[:limit]:
            old = name_of(node.op)
            new = rng.choice(ARITHMETIC[old])
            add("AOR", f"Replace {old.lower()} with {new.lower()}", Edit(lambda n=node: n.op, lambda v, n=node: setattr(n, "op", v), getattr(ast, new)()))
    if "ROR" in operators:
        compares = [n for n in ast.walk(tree) if isinstance(n, ast.Compare)]
        sites = [(n, i) for n in compares for i, op in enumerate(n.ops) if name_of(op) in RELATIONAL]
        rng.shuffle(sites)
        for node, i in sites[:limit]:
            old = name_of(node.ops[i])
            new = rng.choice(RELATIONAL[old])
            target = node if strict else next(n for n in compares if i < len(n.ops) and name_of(n.ops[i]) == old)
            add("ROR", f"Replace {old} with {new}", Edit(lambda n=target, i=i: n.ops[i], lambda v, n=target, i=i: n.ops.__setitem__(i, v), getattr(ast, new)()))
    if "SDL" in operators and (node := function_named(tree, entry_point)) and len(node.body) > 1:
        for i in range(min(limit, len(node.body))):
            rest = node.body[:i] + node.body[i + 1 :]
            add("SDL", f"Delete statement {i} in {entry_point}", Edit(lambda n=node: n.body, lambda v, n=node: setattr(n, "body", v), rest))
    return out


def in_order(tree: ast.AST) -> Iterator[ast.AST]:
    """Nodes depth first, each before its children."""
    stack = [tree]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(list(ast.iter_child_nodes(node)))


def fallback_mutants(source: str) -> Found:
    """Stand-ins for generated mutants: the first sum's right side off by one, the first computed return emptied, the first condition negated."""
    tree = parsed(source)
    if tree is None:
        return []
    plain, out = ast.unparse(tree), []
    sums = next((n for n in in_order(tree) if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Sub))), None)
    returns = next((n for n in in_order(tree) if isinstance(n, ast.Return) and n.value is not None and not isinstance(n.value, ast.Constant)), None)
    tests = next((n for n in in_order(tree) if isinstance(n, ast.If)), None)
    plans = []  # the names and descriptions are fixed values
    if sums:
        shift = ast.Add() if isinstance(sums.op, ast.Sub) else ast.Sub()
        plans.append(("off_by_one", "Off-by-one error in arithmetic", sums, "right", ast.BinOp(sums.right, shift, ast.Constant(1))))
    if returns:
        plans.append(("return_none", "Replace return value with None", returns, "value", ast.Constant(None)))
    if tests:
        plans.append(("flip_cond", "Negate first if-condition", tests, "test", ast.UnaryOp(ast.Not(), tests.test)))
    for name, description, node, field, value in plans:
        with Edit(lambda n=node, f=field: getattr(n, f), lambda v, n=node, f=field: setattr(n, f, v), value):
            code = ast.unparse(tree)
        if code.strip() != plain.strip():
            out.append((f"AST_{name}", "LLM", description, code))
    return out


def expand(tasks: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """The rows that a function of one task's row makes, by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([r for t in pdf.itertuples(index=False) for r in rows(t)], columns=names)

    return tasks.mapInPandas(run, schema)


def mutant_table(tasks: DataFrame, operators: Sequence[str] = OPERATORS, *, limit: int = 5, seed: int = 42, strict: bool = False) -> DataFrame:
    return expand(tasks, MUTANT, lambda t: [(t.task_id, *m) for m in mutate(t.prompt + t.canonical_solution, t.entry_point, operators, limit=limit, seed=seed, strict=strict)])


def fallback_table(tasks: DataFrame) -> DataFrame:
    return expand(tasks, MUTANT, lambda t: [(t.task_id, *m) for m in fallback_mutants(t.prompt + t.canonical_solution)])


def degrade(test: str, fraction: float, seed: int = 42) -> str:
    """A suite without int(n * fraction) of the n top-level assertions of `check`, drawn by the seed; as it is for no fraction or code that doesn't parse."""
    tree = parsed(test) if fraction > 0 else None
    if tree is None:
        return test
    if check := function_named(tree, "check"):
        places = [i for i, s in enumerate(check.body) if isinstance(s, ast.Assert)]
        gone = set(random.Random(seed).sample(places, min(int(len(places) * fraction), len(places))))
        check.body = [s for i, s in enumerate(check.body) if i not in gone] or [ast.Pass()]
    return ast.unparse(tree)


def degraded_suites(tasks: DataFrame, levels: Sequence[float], seed: int = 42) -> DataFrame:
    return expand(tasks, "task_id string, level double, test string", lambda t: [(t.task_id, float(x), degrade(t.test, x, seed)) for x in levels])


def annotations(source: str, entry_point: str) -> list[str]:
    """The parameters' annotations, `int` for one without or for a function that isn't there."""
    tree = parsed(source)
    node = function_named(tree, entry_point) if tree else None
    return ["int"] if node is None else [ast.unparse(a.annotation) if a.annotation else "int" for a in node.args.args]


def literal_calls(test: str, names: Sequence[str]) -> list[tuple]:
    """Arguments of calls with literals only; nothing is evaluated."""
    out = []
    for name in names:
        for found in re.finditer(rf"{re.escape(name)}\(([^)]*)\)", test):
            try:
                out.append(ast.literal_eval(f"({found[1]},)"))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
    return out


def random_value(kind: str, rng: random.Random):
    kind = kind.lower().strip()
    number = lambda: rng.randint(-100, 100)
    if kind == "float":
        return rng.uniform(-100.0, 100.0)
    if kind == "str":
        return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 10)))
    if kind != "int" and "list" in kind:
        return [number() for _ in range(rng.randint(0, 8))]
    return rng.choice([True, False]) if kind == "bool" else number()


def inputs_for(source: str, test: str, entry_point: str, n: int, seed: int = 42, *, strict: bool = False) -> list[tuple]:
    """n argument tuples: those of the suite's literal calls first, then random ones. strict also reads calls of `candidate`."""
    found = literal_calls(test, [entry_point, "candidate"] if strict else [entry_point])
    rng, kinds = random.Random(seed), annotations(source, entry_point)
    while len(found) < n:
        found.append(tuple(random_value(k, rng) for k in kinds))
    return found[:n]


def input_table(tasks: DataFrame, n: int, seed: int = 42, *, strict: bool = False) -> DataFrame:
    return expand(tasks, "task_id string, ix bigint, args string", lambda t: [(t.task_id, i, repr(a)) for i, a in enumerate(inputs_for(t.prompt + t.canonical_solution, t.test, t.entry_point, n, seed, strict=strict))])


def _limits() -> None:
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    resource.setrlimit(resource.RLIMIT_AS, (1 << 31, 1 << 31))
    resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 24, 1 << 24))


def _start(folder: str, program: str, stdin: int = subprocess.DEVNULL) -> subprocess.Popen:
    """A child process of its own session: isolated mode, an empty working folder, no inherited environment, limits on memory and file size."""
    return subprocess.Popen(
        [sys.executable, "-I", "-B", "-c", program],
        stdin=stdin, stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=folder, env={"PATH": os.defpath, "HOME": folder, "LANG": "C.UTF-8"}, preexec_fn=_limits, start_new_session=True,
    )


def execute(solution: str, test: str, timeout: float = 10.0) -> tuple[bool, str, str, bool]:
    """(passed, stdout, stderr, timed_out) of a program in a child process. It passes if it ends with status 0 in time."""
    with tempfile.TemporaryDirectory() as folder:
        run = _start(folder, f"{solution}\n{test}")
        try:
            out, err = run.communicate(timeout=timeout)
        except subprocess.TimeoutExpired:
            os.killpg(run.pid, 9)
            run.communicate()
            return False, "", "", True
    return run.returncode == 0, out.decode(errors="replace"), err.decode(errors="replace"), False


RAN = "passed boolean, stdout string, stderr string, timed_out boolean"


def run_programs(programs: DataFrame, *, timeout: float = 10.0) -> DataFrame:
    """programs (solution, test) with passed, stdout, stderr and timed_out. Deal the rows out before: each takes up to `timeout` seconds."""

    @F.pandas_udf(RAN)
    def run(solutions: pd.Series, tests: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([execute(s or "", t or "", timeout) for s, t in zip(solutions, tests, strict=True)], columns=[c.split()[0] for c in RAN.split(", ")])

    got = programs.withColumn("_r", run.asNondeterministic()("solution", "test"))
    return got.select("*", "_r.*").drop("_r")


def _call(entry_point: str, args: str) -> str:
    return f"\n__result__ = {entry_point}(*{args})\nprint(repr(__result__))"


def output_of(code: str, entry_point: str, args: str, timeout: float) -> str:
    """What a call prints as its result; TIMEOUT, or `__error__:` and the start of the message."""
    ok, out, err, late = execute(code, _call(entry_point, args), timeout)
    return TIMEOUT if late else out.strip() if ok else f"__error__:{err[:60]}"


#: Jobs of one child process.
JOBS = 32


def run_blocks(jobs: Sequence[tuple[str, str, Sequence[str], Sequence[str] | None]], timeout: float) -> list[list[str]]:
    """output_of for the calls of each job (code, entry point, calls, wanted outputs or None), in a child process that forks, so that no call sees what another did and each
    has its own time limit.

    With wanted outputs, a job ends after the first that differs. A call that takes the child process along is an error; the rest go on in another.
    """
    found: list[list[str]] = [[] for _ in jobs]
    left = [k for k, job in enumerate(jobs) if len(job[2])]
    while left:
        asked, starts = left[:JOBS], [len(x) for x in found]
        part = [(jobs[k], found[k]) for k in asked]
        work = [{"code": code + "\n", "sources": [_call(name, x) for x in calls[len(done) :]], "wanted": list(wanted[len(done) :]) if wanted else None} for (code, name, calls, wanted), done in part]
        with tempfile.TemporaryDirectory() as folder:
            run = _start(folder, inspect.getsource(child), subprocess.PIPE)
            try:
                lines = run.communicate(json.dumps({"timeout": timeout, "jobs": work}).encode(), timeout=(timeout + 1) * sum(len(w["sources"]) for w in work) + 10)[0]
            except subprocess.TimeoutExpired:
                os.killpg(run.pid, 9)
                lines = run.communicate()[0]
        ended = set()
        for line in lines.split(b"\n")[:-1]:
            k, *result = json.loads(line)
            if result:
                late, ok, out, err = result
                found[asked[k]].append(TIMEOUT if late else out.strip() if ok else f"__error__:{err[:60]}")
            else:
                ended.add(asked[k])
        left = [k for k in left if k not in ended]
        if left and left[0] in asked:  # the one at which the child process ended
            k = left[0]
            if len(found[k]) == starts[k]:
                found[k].append("__error__:")
            calls, wanted = jobs[k][2:]
            if len(found[k]) == len(calls) or (wanted and found[k][-1] != wanted[len(found[k]) - 1]):
                left = left[1:]
    return found


def outputs_of(code: str, entry_point: str, calls: Sequence[str], timeout: float, wanted: Sequence[str] | None = None) -> list[str]:
    return run_blocks([(code, entry_point, calls, wanted)], timeout)[0]


def shared(output: str) -> str:
    """An output as solutions are compared: every error and timeout is `__error__`."""
    return "__error__" if output == TIMEOUT or output.startswith("__error__:") else output


def shared_output(code: str, entry_point: str, args: str, timeout: float) -> str:
    return shared(output_of(code, entry_point, args, timeout))


#: Calls of one program that one child process runs, and that one row carries.
BLOCK = 100


def input_blocks(tasks: DataFrame, n: int, seed: int = 42, *, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """The inputs of input_table by blocks: task_id, first (the place of a block's first input) and args."""

    def rows(t) -> list[tuple]:
        found = [repr(a) for a in inputs_for(t.prompt + t.canonical_solution, t.test, t.entry_point, n, seed, strict=strict)]
        return [(t.task_id, i, found[i : i + block]) for i in range(0, len(found), block)]

    return expand(tasks, "task_id string, first bigint, args array<string>", rows)


def output_table(programs: DataFrame, *, timeout: float = 5.0) -> DataFrame:
    """programs (code, entry_point, args: an array of calls) with outs, an output for each call."""

    @F.pandas_udf("array<string>")
    def run(code: pd.Series, entry_point: pd.Series, args: pd.Series) -> pd.Series:
        return pd.Series(run_blocks([(c, e, list(a), None) for c, e, a in zip(code, entry_point, args, strict=True)], timeout), dtype=object)

    return programs.withColumn("outs", run.asNondeterministic()("code", "entry_point", "args"))


def same_tree(a: str, b: str) -> bool:
    x, y = parsed(a), parsed(b)
    return x is not None and y is not None and ast.unparse(x) == ast.unparse(y)


#: Places of inputs at which a round of judge_mutants ends: most mutants that diverge do so early.
ROUNDS = (100,)


def judge_mutants(tasks: DataFrame, mutants: DataFrame, *, n_inputs: int = 500, timeout: float = 5.0, seed: int = 42) -> DataFrame:
    """Equivalence of mutants (task_id, mutant_id, code): is_equivalent, reason, n_inputs_tested.

    Canonical outputs are computed once a task, by blocks of inputs. A mutant with the canonical tree isn't run. The others are run in rounds: each joins the mutants that
    haven't diverged with the next blocks of inputs, a row and a child process for each mutant and block, and writes what it found to the shared folder, so that lost
    executors repeat the blocks they had at most. Mutants of unknown tasks are left out.
    """
    spark = tasks.sparkSession
    deal = spark.sparkContext.defaultParallelism * 2
    canon = tasks.select("task_id", "entry_point", F.concat("prompt", "canonical_solution").alias("code"))
    blocks = input_blocks(tasks, n_inputs, seed).join(canon, "task_id").repartition(deal, "task_id", "first")
    calls = F.filter(F.transform("args", lambda a, i: F.struct(a.alias("args"), (F.col("first") + i).alias("ix"), F.get(F.col("outs"), i).alias("out"))), lambda c: c["out"] != TIMEOUT)
    wanted = written(output_table(blocks, timeout=timeout).select("task_id", "first", calls.alias("calls")), "canonical")
    same = F.pandas_udf(lambda a, b: pd.Series([same_tree(x, y) for x, y in zip(a, b, strict=True)]), "boolean")
    rows = mutants.select("task_id", "mutant_id", F.col("code").alias("mutant")).join(canon, "task_id")
    judged = written(rows.select("task_id", "mutant_id", "mutant", "entry_point", same(F.col("code").cast("string"), F.col("mutant").cast("string")).alias("same")), "mutants")

    @F.pandas_udf("bigint")
    def diverged(code: pd.Series, entry_point: pd.Series, args: pd.Series, outs: pd.Series) -> pd.Series:
        """How many outputs agree before the first that doesn't; null if all do."""
        got = run_blocks([(c, e, list(a), list(w)) for c, e, a, w in zip(code, entry_point, args, outs, strict=True)], timeout)
        return pd.Series([next((i for i, (x, y) in enumerate(zip(g, w, strict=False)) if x != y), None) for g, w in zip(got, outs, strict=True)], dtype="Int64")

    ends = [e for e in ROUNDS if e < n_inputs] + [n_inputs]
    alive, found, start = judged.where(~F.col("same")), None, 0
    for end in ends:
        if found is not None:
            alive = alive.join(found.where("at is not null"), ["task_id", "mutant_id"], "left_anti")
        work = alive.join(wanted.where((F.col("first") >= start) & (F.col("first") < end)), "task_id").repartition(deal, "task_id", "mutant_id", "first")
        at = diverged.asNondeterministic()("mutant", "entry_point", F.col("calls.args"), F.col("calls.out"))
        ran = work.select("task_id", "mutant_id", "calls", at.alias("_at")).select("task_id", "mutant_id", F.size("calls").alias("n"), F.get(F.col("calls.ix"), F.col("_at").cast("int")).alias("at"))
        ran = written(ran, "round")
        found, start = ran if found is None else found.unionByName(ran), end
    tally = found.groupBy("task_id", "mutant_id").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    reason = F.when(F.col("same"), "ast_identical").when(F.col("at").isNotNull(), "diverged").when(F.coalesce("n", F.lit(0)) == 0, "no_testable_inputs").otherwise("no_divergence")
    tested = F.when(F.col("same"), F.lit(0)).otherwise(F.coalesce(F.col("at") + 1, "n", F.lit(0))).cast("long")
    return judged.join(tally, ["task_id", "mutant_id"], "left").select("task_id", "mutant_id", F.col("at").isNull().alias("is_equivalent"), reason.alias("reason"), tested.alias("n_inputs_tested"))


def kill_matrix(tasks: DataFrame, mutants: DataFrame, verdicts: DataFrame | None = None, *, timeout: float = 10.0, deal: int | None = None) -> DataFrame:
    """Every mutant (task_id, mutant_id, operator, code) that no verdict calls equivalent against its task's suite: is_killed, timed_out. One that fails or runs out of
    time is killed. Mutants of unknown tasks are left out."""
    if verdicts is not None:
        mutants = not_equivalent(mutants, verdicts, ("task_id", "mutant_id"))
    known = mutants.join(tasks.select("task_id", T.test_driver(F.col("test"), F.col("entry_point")).alias("test")), "task_id").withColumnRenamed("code", "solution")
    ran = run_programs(known.repartition(deal or known.sparkSession.sparkContext.defaultParallelism * 4, "task_id", "mutant_id"), timeout=timeout)
    return ran.select("task_id", "mutant_id", "operator", (~F.col("passed")).alias("is_killed"), "timed_out")


def valid_code(raw: str | None) -> str | None:
    """A reply's code without its fence, if it parses."""
    text = (raw or "").strip()
    if fence := re.match(r"```(?:python)?\s*(.*?)```", text, re.DOTALL):
        text = fence[1].strip()
    return text if parsed(text) is not None else None


def consistency_suite(task_id: str, rate: float, inputs: Sequence[tuple], n_solutions: int, threshold: float | None = None) -> str:
    """Code that asserts equal outputs of all solutions on up to 20 inputs; empty where the consistency gate is shut."""
    bar = 0.1 if threshold is None else threshold
    if rate < bar or n_solutions < 2:
        return ""
    return f"""# Consistency of solutions of {task_id}: divergence {rate:.3f}, threshold {bar}
def _check_consistency(*solutions):
    for args in {list(inputs[:20])!r}:
        outputs = [f(*args) for f in solutions]
        assert all(x == outputs[0] for x in outputs), f"solutions differ on {{args!r}}"
"""


def program_of(raw: Column, prompt: Column, entry_point: Column) -> Column:
    """The program that a completion makes: its body, after the prompt if it defines nothing."""
    return T.let(T.extract_body(raw, entry_point), lambda body: T.assemble(prompt, body))


def run_completions(completions: DataFrame, tasks: DataFrame, *, timeout: float = 10.0, deal: int | None = None) -> DataFrame:
    """completions (task_id, completion and more) with passed and timed_out: each is run against its task's suite. Those without a task are left out; a null
    completion fails. deal spreads the runs over so many partitions."""
    known = completions.join(tasks.select("task_id", "prompt", "entry_point", "test"), "task_id")
    program = F.coalesce(program_of(F.col("completion"), F.col("prompt"), F.col("entry_point")), F.lit("raise SystemExit(1)"))
    programs = known.select(*completions.columns, program.alias("solution"), T.test_driver(F.col("test"), F.col("entry_point")).alias("test"))
    ran = run_programs(programs.repartition(deal) if deal else programs, timeout=timeout)
    return ran.select(*completions.columns, "passed", "timed_out")


def shared_divergence(solutions: DataFrame, tasks: DataFrame, *, n_inputs: int = 500, timeout: float = 5.0, seed: int = 42, deal: int | None = None) -> DataFrame:
    """How often a task's solutions (task_id, sol, completion) differ on shared inputs: task, n_solutions, n_inputs, total_comparisons, disagreements, rate.

    Every solution and block of inputs is a row of its own, so the runs spread evenly. Errors and timeouts count as one output.
    """
    code = solutions.join(tasks.select("task_id", "prompt", "entry_point"), "task_id").select("task_id", "sol", "entry_point", program_of(F.col("completion"), F.col("prompt"), F.col("entry_point")).alias("code"))
    calls = code.where(F.col("code").isNotNull()).join(input_blocks(tasks, n_inputs, seed), "task_id")
    calls = calls.repartition(deal or calls.sparkSession.sparkContext.defaultParallelism * 2, "task_id", "sol", "first")
    ran = output_table(calls, timeout=timeout).select("task_id", "sol", "first", F.posexplode("outs").alias("i", "out"))
    failed = (F.col("out") == TIMEOUT) | F.startswith("out", F.lit("__error__:"))
    ran = ran.withColumn("out", F.when(failed, "__error__").otherwise(F.col("out")))
    return pairwise_disagreement(ran.select(F.col("task_id").alias("task"), "sol", (F.col("first") + F.col("i")).alias("inp"), "out"))


MUTATOR = "You test test suites. Change one detail of the Python function so that it is wrong in a way a programmer might get it wrong. Keep it valid and answer with the whole function only."
REVERSE = "Describe in plain words what the Python function does: its inputs, its result and its special cases. Answer with the description only."


def mutation_requests(tasks: DataFrame, models: Sequence[str], n: int = 3) -> DataFrame:
    """One request a task and model for n mutants: task_id, model, messages, temperature, max_tokens, n. Two more are asked for, as some replies won't do."""
    ask = F.concat(F.lit("Put one fault into this function:\n\n"), "prompt", "canonical_solution")
    grid = tasks.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return grid.select("task_id", "model", T.messages(MUTATOR, ask).alias("messages"), F.lit(0.9).alias("temperature"), F.lit(1024).alias("max_tokens"), F.lit(n + 2).alias("n"))


def generated_mutants(replies: DataFrame, tasks: DataFrame, n: int = 3) -> DataFrame:
    """The first n replies (task_id, model, choices) of each task that parse and aren't the canonical program, as mutants named by their place among all."""
    valid = F.pandas_udf(lambda raw: raw.map(valid_code), "string")
    rows = replies.select("task_id", "model", F.posexplode("choices").alias("raw_ix", "raw")).withColumn("code", valid("raw"))
    canon = tasks.select("task_id", T.strip(F.concat("prompt", "canonical_solution")).alias("_canon"))
    fit = F.col("code").isNotNull() & (T.strip(F.col("code")) != F.col("_canon"))
    picked = first_valid(rows.join(canon, "task_id").withColumn("_fit", fit).withColumn("task", F.concat_ws("\n", "task_id", "model")), "_fit", n)
    return picked.select("task_id", "mutant_id", F.lit("LLM").alias("operator"), F.concat(F.lit("LLM-generated semantic mutant (model="), "model", F.lit(")")).alias("description"), "code")


def reverse_requests(solutions: DataFrame, model: str) -> DataFrame:
    """A request to describe each solution (task_id, sol, code)."""
    ask = F.concat(F.lit("Function:\n\n"), "code")
    return solutions.select("task_id", "sol", F.lit(model).alias("model"), T.messages(REVERSE, ask).alias("messages"), F.lit(0.3).alias("temperature"), F.lit(256).alias("max_tokens"), F.lit(1).alias("n"))


def reverse_scores(replies: DataFrame, tasks: DataFrame) -> DataFrame:
    """replies (task_id, sol, choices) with inferred_spec (the first choice, empty without any) and how it overlaps with the task's docstring, rounded to four places."""
    both = replies.join(tasks.select("task_id", T.docstring_of(F.col("prompt")).alias("_doc")), "task_id").withColumn("inferred_spec", F.coalesce(F.get("choices", F.lit(0)), F.lit("")))
    scores = {"semantic_score": T.bigram_precision, "bleu_score": T.unigram_precision, "completeness_score": T.completeness, "sbc_score": T.sbc}
    return both.select("task_id", "sol", "inferred_spec", *[F.round(f(F.col("_doc"), F.col("inferred_spec")), 4).alias(name) for name, f in scores.items()])
