import ast
import functools
import random

import pytest

from tallyforge.operators import subsumption, trees

SIMPLE = "def f(x):\n    if x > 0 and x:\n        return x\n    return [i for i in x]\n"


def as_tree(code):
    return [(p, k) for _, p, _, k in trees.numbered(ast.parse(code))]


def random_tree(rng, n):
    """Depth first, as numbered gives them."""
    parents, path = [-1], [0]
    for i in range(1, n):
        path = path[: rng.randrange(1, len(path) + 1)]
        parents.append(path[-1])
        path.append(i)
    return [(p, rng.choice("abc")) for p in parents]


def plain_distance(a, b):
    """The recursion over forests, a node at a time."""

    def nested(tree, i):
        return (tree[i][1], tuple(nested(tree, j) for j in range(len(tree)) if tree[j][0] == i))

    @functools.cache
    def forest(x, y):
        if not x or not y:
            size = lambda f: sum(1 + size(c) for _, c in f)
            return size(x) + size(y)
        (k, c), (m, d) = x[-1], y[-1]
        return min(forest(x[:-1] + c, y) + 1, forest(x, y[:-1] + d) + 1, forest(c, d) + forest(x[:-1], y[:-1]) + (k != m))

    return forest((nested(a, 0),), (nested(b, 0),))


def test_distance_equals_the_recursion():
    rng = random.Random(8)
    for _ in range(120):
        a, b = (random_tree(rng, rng.randrange(1, 9)) for _ in range(2))
        assert trees.tree_distance(a, b) == plain_distance(a, b)
    assert trees.tree_distance([], random_tree(rng, 4)) == 4


def test_complexity_of_a_program_by_hand(spark):
    rows = spark.createDataFrame([("t", "", SIMPLE), ("t", "bad", "def f("), ("t", "none", None), ("u", "", "x = 1")], "task_id string, mutant_id string, code string")
    got = {r.task_id: (r.n_nodes, r.depth, r.cyclomatic) for r in trees.complexity(trees.syntax_nodes(rows)).collect()}
    # Module, Assign, Name, Constant; and If, BoolOp and the comprehension of the other
    assert got["u"] == (4, 2, 1) and got["t"][2] == 4 and len(got) == 2


@pytest.mark.parametrize("most", [0, 1, 3, 8])
def test_near_programs_equal_all_pairs(spark, monkeypatch, most):
    codes = {"a": SIMPLE, "b": SIMPLE.replace(">", "<"), "c": SIMPLE.replace("x > 0 and x", "x"), "d": SIMPLE, "e": "def g():\n    pass\n", "f": "x = 1", "g": "y = 2", "h": "pass", "i": "def g():\n    return 1\n"}
    rows = spark.createDataFrame([("t", k, v) for k, v in codes.items()] + [("u", "a", SIMPLE)], "task_id string, mutant_id string, code string")
    got = {(r.a, r.b): r.distance for r in trees.near_programs(trees.syntax_nodes(rows), most).collect()}
    every = {(x, y): trees.tree_distance(as_tree(codes[x]), as_tree(codes[y])) for x in codes for y in codes if x < y}
    assert got == {k: d for k, d in every.items() if d <= most}


def test_an_edit_changes_five_grams_at_most(spark):
    """The bound that the join rests on, on random trees and one random edit each."""
    from collections import Counter

    def bag(tree):
        kids = [[j for j, (p, _) in enumerate(tree) if p == i] for i in range(-1, len(tree))]
        out = Counter()
        for family in kids:
            for n, i in enumerate(family):
                out[tree[i][1], tree[kids[i + 1][0]][1] if kids[i + 1] else "", tree[family[n + 1]][1] if n + 1 < len(family) else ""] += 1
        return out

    rng = random.Random(1)
    for _ in range(200):
        a, b = (random_tree(rng, rng.randrange(2, 9)) for _ in range(2))
        x, y = bag(a), bag(b)
        assert sum(((x - y) + (y - x)).values()) <= trees.GRAMS_AN_EDIT * trees.tree_distance(a, b)


def test_subsumption_equals_pairwise_containment(spark):
    rng = random.Random(3)
    kills = {(t, m): frozenset(i for i in range(8) if rng.random() < 0.1 + 0.1 * (m % 7)) for t in range(3) for m in range(40)}
    rows = spark.createDataFrame([(t, m, i) for (t, m), s in kills.items() for i in s] * 2, "task int, mutant int, inp int")
    got = {(r.task, r.mutant): (r["class"], r.n_inputs, r.subsumed_by, r.minimal) for r in subsumption.minimal_mutants(rows).collect()}
    want = {}
    for (t, m), s in kills.items():
        if s:
            others = {x for (u, _), x in kills.items() if u == t and x and x < s}
            want[t, m] = (min(k for (u, k), x in kills.items() if u == t and x == s), len(s), len(others), not others)
    assert got == want
    assert subsumption.minimal_mutants(rows.limit(0)).count() == 0


def test_robust_slopes(spark):
    rows = [("a", x, 2.0 * x + (100 if x == 3 else 0)) for x in range(8)] + [("b", 1, 1.0), ("c", 0, 1.0), ("c", 0, 3.0), ("c", 2, 5.0), ("d", 0, float("nan")), ("d", 1, None)]
    got = {r.g: (r.n, r.slope) for r in subsumption.robust_slopes(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", ["g"]).collect()}
    assert got == {"a": (8, 2.0), "b": (1, None), "c": (3, 1.5)}
