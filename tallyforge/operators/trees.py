"""Syntax trees as tables: a row a node, complexity by task, and edit distances between programs of a task."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .programs import expand, parsed

NODE = "task_id string, mutant_id string, node bigint, parent bigint, depth bigint, kind string"
#: Kinds of nodes at which a path divides.
BRANCHES = ("If", "For", "While", "IfExp", "ExceptHandler", "BoolOp", "comprehension", "Assert", "match_case")
#: An edit changes at most so many grams of a tree.
GRAMS_AN_EDIT = 5


def numbered(tree: ast.AST) -> list[tuple[int, int, int, str]]:
    """(node, parent, depth, kind) of every node, depth first; the root's parent is -1. Expression contexts are left out, names and constants carry their value."""
    out, stack = [], [(tree, -1, 0)]
    while stack:
        node, parent, depth = stack.pop()
        value = next((repr(getattr(node, f)) for f in ("id", "arg", "attr", "name", "value") if isinstance(getattr(node, f, None), (str, int, float, bool, bytes)) or (isinstance(node, ast.Constant) and f == "value")), None)
        out.append((len(out), parent, depth, type(node).__name__ + (f" {value}" if value is not None else "")))
        children = [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]
        stack += [(c, out[-1][0], depth + 1) for c in reversed(children)]
    return out


def syntax_nodes(programs: DataFrame) -> DataFrame:
    """The nodes of programs (task_id, mutant_id, code): task_id, mutant_id, node, parent, depth, kind. Code that is null or doesn't parse has none."""

    def rows(t) -> list[tuple]:
        tree = parsed(t.code) if t.code is not None else None
        return [(t.task_id, t.mutant_id, *n) for n in numbered(tree)] if tree is not None else []

    return expand(programs.select("task_id", "mutant_id", "code"), NODE, rows)


def complexity(nodes: DataFrame) -> DataFrame:
    """Of each program: its nodes, its depth, and its cyclomatic complexity, one more than the nodes at which a path divides."""
    branch = F.substring_index("kind", " ", 1).isin(*BRANCHES)
    return nodes.groupBy("task_id", "mutant_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("depth"), (F.count_if(branch) + 1).alias("cyclomatic"))


def rates_by_complexity(kills: DataFrame, programs: DataFrame) -> DataFrame:
    """Kill rates of mutants (task_id, is_killed) by the cyclomatic complexity of their task's program (task_id, cyclomatic)."""
    both = kills.join(programs.select("task_id", "cyclomatic"), "task_id")
    return both.groupBy("cyclomatic").agg(F.countDistinct("task_id").alias("n_tasks"), F.count(F.lit(1)).alias("total"), F.count_if("is_killed").alias("killed"), F.avg(F.col("is_killed").cast("double")).alias("kill_rate"))


def tree_distance(a: list[tuple[int, str]], b: list[tuple[int, str]], most: int | None = None) -> int:
    """The least number of nodes to insert, delete or rename between ordered trees, given as (parent, kind) depth first: Zhang and Shasha's recurrence over key roots."""

    def postorder(tree: list[tuple[int, str]]) -> tuple[list[str], list[int], list[int]]:
        children: list[list[int]] = [[] for _ in tree]
        for i, (parent, _) in enumerate(tree):
            if parent >= 0:
                children[parent].append(i)
        order, left, stack, at = [], [], [(0, False)] if tree else [], {}
        while stack:
            i, done = stack.pop()
            if done:
                at[i] = len(order)
                left.append(left[at[children[i][0]]] if children[i] else len(order))
                order.append(tree[i][1])
            else:
                stack += [(i, True), *((c, False) for c in reversed(children[i]))]
        return order, left, sorted({x: k for k, x in enumerate(left)}.values())

    (one, l1, k1), (two, l2, k2) = postorder(a), postorder(b)
    if not one or not two:
        return len(one) + len(two)
    done = [[0] * len(two) for _ in one]
    for i in k1:
        for j in k2:
            n, m = i - l1[i] + 2, j - l2[j] + 2
            d = [[0] * m for _ in range(n)]
            for x in range(1, n):
                d[x][0] = x
            d[0] = list(range(m))
            for x in range(1, n):
                p = l1[i] + x - 1
                for y in range(1, m):
                    q = l2[j] + y - 1
                    least = min(d[x - 1][y], d[x][y - 1]) + 1
                    if l1[p] == l1[i] and l2[q] == l2[j]:
                        d[x][y] = done[p][q] = min(least, d[x - 1][y - 1] + (one[p] != two[q]))
                    else:
                        d[x][y] = min(least, d[l1[p] - l1[i]][l2[q] - l2[j]] + done[p][q])
    return done[-1][-1]


def grams(nodes: DataFrame) -> DataFrame:
    """The grams of each tree: a node's kind with those of its first child and its next sibling, and how often each occurs."""
    from pyspark.sql import Window

    own = ["task_id", "mutant_id"]
    siblings = Window.partitionBy(*own, "parent").orderBy("node")
    placed = nodes.withColumn("next", F.lead("kind").over(siblings)).withColumn("rank", F.row_number().over(siblings))
    first = placed.where("rank = 1 and parent >= 0").select(*own, F.col("parent").alias("node"), F.col("kind").alias("first"))
    whole = placed.join(first, [*own, "node"], "left")
    gram = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in ("kind", "first", "next")]))
    return whole.groupBy(*own, gram.alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def near_programs(nodes: DataFrame, most: int) -> DataFrame:
    """Pairs of a task's programs whose trees are at most `most` edits apart: task_id, a, b (mutant_id of each, a < b), distance.

    An edit changes at most five grams, so trees within k edits differ in at most 5 * k of them. Pairs come from a join by gram; only those within that bound are aligned. Trees of up
    to 5 * k nodes may share none, so each of them has one gram more, which they share.
    """
    counts = grams(nodes)
    sizes = counts.groupBy("task_id", "mutant_id").agg(F.sum("n").alias("size"))
    own = sizes.where(F.col("size") <= GRAMS_AN_EDIT * most).select("task_id", "mutant_id", F.lit("").alias("gram"), F.lit(0).cast("long").alias("n"))
    rows = counts.unionByName(own)
    left, right = (rows.select("task_id", "gram", F.col("mutant_id").alias(side), F.col("n").alias(f"n_{side}")) for side in "ab")
    shared = left.join(right, ["task_id", "gram"]).where("a < b").groupBy("task_id", "a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    for side in "ab":
        shared = shared.join(sizes.select("task_id", F.col("mutant_id").alias(side), F.col("size").alias(f"size_{side}")), ["task_id", side])
    close = shared.where(F.col("size_a") + F.col("size_b") - 2 * F.col("common") <= GRAMS_AN_EDIT * most)
    trees = nodes.groupBy("task_id", "mutant_id").agg(F.array_sort(F.collect_list(F.struct("node", "parent", "kind"))).alias("t"))
    for side in "ab":
        close = close.join(trees.select("task_id", F.col("mutant_id").alias(side), F.col("t").alias(f"t_{side}")), ["task_id", side])

    @F.pandas_udf("bigint")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tree_distance(*([(n["parent"], n["kind"]) for n in t] for t in pair)) for pair in zip(a, b, strict=True)], dtype="Int64")

    return close.select("task_id", "a", "b", distance("t_a", "t_b").alias("distance")).where(F.col("distance") <= most)
