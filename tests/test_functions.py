import math

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import stats, text
from tallyforge.operators import attempts, state, tests


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("v")).first().v


@pytest.mark.parametrize("n,c,k", [(0, 0, 1), (3, 0, 5), (5, 5, 1), (10, 3, 1), (10, 3, 5), (10, 0, 10), (20, 7, 10)])
def test_pass_at_k(spark, n, c, k):
    want = 0.0 if n == 0 else 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
    assert one(spark, stats.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c) == pytest.approx(want)
    assert (one(spark, stats.pass_at_k(F.col("n"), F.col("c"), k, strict=True), n=n, c=c) is None) == (n < k)


@pytest.mark.parametrize("a,b,want", [([1, 2, 3], [1, 2, 3], 1), ([1, 2, 3], [3, 2, 1], -1), ([1, 1, 1], [2, 2, 2], 1), ([1, 1, 1], [1, 2, 3], 0), ([1, 2, 2], [1, 2, 3], 2 / math.sqrt(6))])
def test_tau_b(spark, a, b, want):
    array = lambda x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, stats.kendall_tau_b(array(a), array(b))) == pytest.approx(want)


def test_unguarded_tau_is_nan(spark):
    array = F.array(F.lit(1.0), F.lit(1.0))
    assert math.isnan(one(spark, stats.kendall_tau_b(array, array, guarded=False)))


def test_normal_tail(spark):
    for z in (-3.0, -0.5, 0.0, 1.0, 2.5, 6.0):
        assert one(spark, stats.normal_tail(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-6)


def test_bootstrap(spark):
    values = [0.5, -1.0, 1.0, 0.25]
    for generator in ("stdlib", "numpy"):
        boots = sorted(sum(values[i] for i in d) / 4 for d in stats.draw_table(4, generator=generator))
        got = one(spark, stats.bootstrap_interval(F.array(*map(F.lit, values)), 4, generator=generator))
        assert (got.lower, got.upper) == (pytest.approx(boots[25]), pytest.approx(boots[975]))
    assert one(spark, stats.bootstrap_interval(F.array().cast("array<double>"), 0)).lower is None


PROMPT = 'def f(x):\n    """ Return x.\n    More.\n    >>> f(1)\n    1\n    """\n'


def test_relations(spark):
    got = one(spark, text.relations(F.col("p")), p=PROMPT)
    assert got["original"] == PROMPT
    assert got["persona"].endswith(PROMPT) and got["persona"] != PROMPT
    assert got["formal"].startswith('def f(x):\n    """\n    [Specification]')
    assert got["reorder"] == 'def f(x):\n    """\n    >>> f(1)\n    1\n    """\nReturn x.\n    More.\n'
    assert one(spark, text.relation(F.col("p"), "terse"), p="Please complete. Note that it is.\n\n\n\nX") == " complete.  it is.\n\nX"
    with pytest.raises(ValueError):
        text.relation(F.lit(""), "nonsense")


def test_split_without_docstring(spark):
    got = one(spark, text.split_docstring(F.col("p")), p="def f(x):\n    pass\n")
    assert (got.signature, got.description, got.examples) == ("def f(x):\n    pass\n", "", "")


def test_code_extraction(spark):
    body = lambda raw: one(spark, text.extract_body(F.lit(raw), F.lit("f")))
    assert body("```python\n    x = 1\n    return x\n```") == "x = 1\n    return x\n"  # the fence takes the first indent
    assert body("import math\ndef f(x):\n    return x") == "def f(x):\n    return x"
    assert body("    return x") == "    return x"
    assert one(spark, text.assemble(F.lit("P\n"), F.lit("  def f(): pass"))) == "  def f(): pass"


def test_scores(spark):
    assert one(spark, text.unigram_precision(F.lit("a b"), F.lit("A a c"))) == pytest.approx(2 / 3)
    assert one(spark, text.unigram_precision(F.lit("a b"), F.lit("  "))) == 0.0
    assert one(spark, text.bigram_precision(F.lit("a b c"), F.lit("a b b c"))) == pytest.approx(2 / 3)
    assert one(spark, text.completeness(F.lit("of the"), F.lit("x"))) == 1.0
    assert one(spark, text.completeness(F.lit("Return sorted (list)."), F.lit("sorted lists"))) == pytest.approx(2 / 3)


def test_two_sample_tests(spark):
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0), (5.0, 4.0)], "x double, y double")
    got = tests.wilcoxon(pairs).first()
    assert (got.n, got.w) == (3, 1.5)
    same = tests.wilcoxon(pairs.select("x", F.col("x").alias("y"))).first()
    assert (same.n, same.w, same.p_value) == (0, 0.0, 1.0)
    a, b = (pairs.select(F.col(c).alias("v")) for c in "xy")
    assert tests.cliffs_delta(a, b).first().delta == pytest.approx(sum((x > y) - (x < y) for x in (1, 2, 3, 5) for y in (2, 2, 1, 4)) / 16)
    assert math.isnan(tests.cliffs_delta(a.where("false"), b).first().delta)


def test_trend_needs_three_levels(spark):
    rows = spark.createDataFrame([("t", 0.0, 1.0), ("t", 0.5, 0.5)], "task string, level double, mean_tau_b double")
    assert attempts.page_trend(rows, ["task"]).first().note is not None
    more = rows.union(spark.createDataFrame([("t", 0.8, 0.1), ("t", 0.9, 0.0)], rows.schema))
    compat, strict = (attempts.page_trend(more, ["task"], strict=s).first() for s in (False, True))
    assert compat.z < 0 and not compat.decreasing
    assert strict.L == 30.0 and strict.decreasing


def test_divergence_edges(spark):
    one_solution = spark.createDataFrame([(1, 0, 0, "a")], "task int, sol int, inp int, out string")
    got = attempts.pairwise_disagreement(one_solution).first()
    assert (got.n_solutions, got.total_comparisons, got.rate) == (1, 0, 0.0)


def test_request_keys(spark):
    content = 'say "hi"\n\\ twice'
    want = state.key_of("m", [{"role": "user", "content": content}], temperature=0.8, max_tokens=1024, n=1)
    assert one(spark, state.request_key(state.request_json(F.lit("m"), F.lit(content)))) == want
    assert one(spark, state.canonical_json(F.lit('{"b": "é", "a": 1}'))) == '{"a": 1, "b": "\\u00e9"}'


def test_token_slots_across_buckets(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([0, 0, 0, 10, 90, 91, 400])], "id int, t long")
    got = {r.id: r.slot_us for r in state.token_slots(rows, arrival="t", order=["id"], per_minute=60_000_000 / 30, bucket_us=50).collect()}
    slot, want = -30, {}
    for i, t in enumerate([0, 0, 0, 10, 90, 91, 400]):
        slot = max(t, slot + 30)
        want[i] = slot
    assert got == want


def test_progress_without_tasks(spark):
    done = spark.createDataFrame([], "stage string, phase string, task string")
    assert {r.percent for r in state.progress(done, 0).collect()} == {0.0}


def split_by_pattern(prompt):
    """The split as a pattern over lines: slow, and only for short prompts."""
    found = re.match(r"((?:[^\n]*\n)*?)([^\n]*(?:\"\"\"|''')[^\n]*\n?)", prompt)
    if not found:
        return prompt, "", ""
    before, line = found.groups()
    rest, quote = prompt[found.end() :], '"""' if '"""' in line else "'''"
    after = line[line.index(quote) + 3 :].strip()
    if after and after != quote:
        signature, body = before + line[: line.index(quote) + 3] + "\n", f"{after}\n{rest}"
    else:
        signature, body = before + line, rest
    shown = re.match(r"(?s)((?:[^\n]*\n)*?)([ \t]*>>>.*)\Z", body)
    return (signature, *shown.groups()) if shown else (signature, body, "")


def test_split_equals_the_pattern(spark):
    rng = random.Random(4)
    parts = ['"""', "'''", "\n", "    ", "x", ">>> f()", "\t>>>", "é\U00010400", "\r", "def f():\n", "a b", "\n\n"]
    prompts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(600)]
    rows = spark.createDataFrame([(p,) for p in prompts], "p string").select("p", text.split_docstring(F.col("p")).alias("s")).collect()
    for r in rows:
        assert (r.s.signature, r.s.description, r.s.examples) == split_by_pattern(r.p), repr(r.p)


def test_split_of_a_hundred_thousand_lines(spark):
    """Lines before the docstring, in it and before its examples."""
    many = "# line\n" * 100_000
    prompt = f'{many}def f(x):\n    """\n{many}    >>> f(1)\n{many}    """\n'
    got = one(spark, text.split_docstring(F.col("p")), p=prompt)
    assert got.signature == f'{many}def f(x):\n    """\n' and got.description == many and got.examples == f'    >>> f(1)\n{many}    """\n'
    assert one(spark, text.relation(F.col("p"), "reorder"), p=prompt) == got.signature + got.examples + got.description
    assert one(spark, text.relation(F.col("p"), "formal"), p=prompt).startswith(got.signature + text.FORMAL)
