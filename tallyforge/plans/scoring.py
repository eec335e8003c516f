"""Queries over attempts, outputs and mutants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import NORMAL_TAIL_SQL, draw_table
from ..operators import attempts as A
from ..operators import mutants as M
from ..operators import tests as T
from . import views as V

QUERIES, SQL = {}, {}


def rounded(x, digits: int):
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rates(spark, sf_dir):
    return A.pass_rates(A.attempt_counts(V.attempts(spark, sf_dir)))


COUNTS = f"WITH {V.SQL_ATTEMPTS}, counts AS (SELECT task, relation, model, count(*) AS n, count(*) FILTER (passed) AS correct FROM attempts GROUP BY 1, 2, 3)"


@query(COUNTS + " SELECT * FROM counts")
def attempt_counts(spark, sf_dir):
    return A.attempt_counts(V.attempts(spark, sf_dir))


def _pass_sql(k: int, n: str = "n", c: str = "correct") -> str:
    return f"CASE WHEN {n} = 0 THEN 0E0 WHEN {n} - {c} < {k} THEN 1E0 ELSE 1E0 - list_product(list_transform(range({k}), lambda i: CAST({n} - {c} - i AS DOUBLE) / ({n} - i))) END"


def _pass_query(k: int):
    def run(spark, sf_dir):
        return _rates(spark, sf_dir).select("task", "relation", "model", "n", "correct", rounded(f"pass_at_{k}", 6).alias(f"pass_at_{k}"))

    run.__name__ = f"pass_at_{k}"
    query(f"{COUNTS} SELECT *, round({_pass_sql(k)}, 6) AS pass_at_{k} FROM counts")(run)


for _k in (1, 5, 10):
    _pass_query(_k)


@query(f"WITH {V.SQL_ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY task, relation, model ORDER BY passed DESC, sample_ix) AS rn FROM attempts) SELECT task, relation, model, sample_ix, passed FROM r WHERE rn = 1")
def best_completion(spark, sf_dir):
    return A.best_attempt(V.attempts(spark, sf_dir))


@query(f"WITH {V.SQL_ATTEMPTS} SELECT task, relation, model, min(sample_ix) AS sample_ix FROM attempts GROUP BY 1, 2, 3")
def first_completion(spark, sf_dir):
    return A.first_attempt(V.attempts(spark, sf_dir))


# agreement: as a self-join of models in SQL, as arrays in the plan
_TAU = """scores AS (SELECT {keys}, relation, model, CASE WHEN count(*) = 0 THEN 0E0 ELSE count(*) FILTER (passed) / count(*)::DOUBLE END AS p FROM {source} GROUP BY ALL),
models AS (SELECT unnest(['F', 'O', 'P']) AS model), variants AS (SELECT unnest(['2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS relation),
dims AS (SELECT DISTINCT {keys} FROM {source}),
grid AS (SELECT {dkeys}, v.relation, m.model, coalesce(b.p, 0E0) AS b, coalesce(s.p, 0E0) AS s FROM dims d CROSS JOIN variants v CROSS JOIN models m
  LEFT JOIN scores b ON {bon} AND b.relation = '1-URGENT' AND b.model = m.model LEFT JOIN scores s ON {son} AND s.relation = v.relation AND s.model = m.model),
sums AS (SELECT {xkeys}, x.relation, sum(sign(y.b - x.b) * sign(y.s - x.s)) AS num, sum(abs(sign(y.b - x.b))) AS db, sum(abs(sign(y.s - x.s))) AS ds
  FROM grid x JOIN grid y ON {xon} AND x.relation = y.relation AND x.model < y.model GROUP BY ALL),
taus AS (SELECT {keys}, relation, CASE WHEN db = 0 AND ds = 0 THEN 1E0 WHEN db = 0 OR ds = 0 THEN 0E0 ELSE num / sqrt(CAST(db * ds AS DOUBLE)) END AS tau_b FROM sums)"""


def _tau(keys, source):
    each = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return _TAU.format(keys=", ".join(keys), source=source, dkeys=each("d"), bon=on("b", "d"), son=on("s", "d"), xkeys=each("x"), xon=on("x", "y"))


TAUS = f"WITH {V.SQL_ATTEMPTS}, {_tau(['task'], 'attempts')}"
BY_LEVEL = f"""WITH {V.SQL_ATTEMPTS}, leveled AS (SELECT task, relation, model, level, passed OR draw < level AS passed FROM attempts CROSS JOIN (SELECT unnest([0.0E0, 0.2E0, 0.5E0, 0.8E0]) AS level)),
{_tau(['task', 'level'], 'leveled')}, means AS (SELECT task, level, avg(tau_b) AS mean_tau_b FROM taus GROUP BY 1, 2)"""


def _agreement(rates, keys=("task",)):
    return A.rank_agreement(rates, value="pass_at_1", models=V.MODELS, relations=V.RELATIONS, baseline=V.BASELINE, keys=keys)


@query(f"{TAUS} SELECT task, relation, round(tau_b, 6) + 0 AS tau_b FROM taus")
def tau_b_variant(spark, sf_dir):
    return _agreement(_rates(spark, sf_dir)).withColumn("tau_b", rounded("tau_b", 6))


@query(f"{TAUS} SELECT task, m.model, round(avg(tau_b), 6) + 0 AS mean_tau_b FROM taus CROSS JOIN models m GROUP BY ALL")
def tau_b_mean(spark, sf_dir):
    means = A.mean_agreement(_agreement(_rates(spark, sf_dir)))
    return means.select("task", F.explode(F.array(*map(F.lit, V.MODELS))).alias("model"), rounded("mean_tau_b", 6).alias("mean_tau_b"))


_DRAWS = ", ".join(f"({i}, {d})" for i, d in enumerate(draw_table(len(V.RELATIONS) - 1)))


@query(f"""{TAUS}, draws(i, pick) AS (VALUES {_DRAWS}), lists AS (SELECT task, list(tau_b ORDER BY relation) AS t FROM taus GROUP BY task),
boots AS (SELECT task, i, (t[pick[1] + 1] + t[pick[2] + 1] + t[pick[3] + 1] + t[pick[4] + 1]) / 4 AS b FROM lists CROSS JOIN draws),
sorted AS (SELECT task, list(b ORDER BY b) AS b FROM boots GROUP BY task)
SELECT task, round((t[1] + t[2] + t[3] + t[4]) / 4, 6) + 0 AS mean_tau_b, round(b[26], 6) + 0 AS ci_lower, round(b[976], 6) + 0 AS ci_upper FROM lists JOIN sorted USING (task)""")
def bootstrap_ci(spark, sf_dir):
    got = A.agreement_interval(_agreement(_rates(spark, sf_dir)), len(V.RELATIONS) - 1)
    return got.select("task", *[rounded(c, 6).alias(c) for c in ("mean_tau_b", "ci_lower", "ci_upper")])


@query(f"""WITH {V.SQL_OUTPUTS}, p AS (SELECT a.task, count(*) AS total_comparisons, count(*) FILTER (a.out <> b.out) AS disagreements FROM outputs a JOIN outputs b
  ON a.task = b.task AND a.inp = b.inp AND a.sol < b.sol GROUP BY 1), s AS (SELECT task, count(DISTINCT sol) AS n_solutions, count(DISTINCT inp) AS n_inputs FROM outputs GROUP BY 1)
SELECT s.*, coalesce(total_comparisons, 0) AS total_comparisons, coalesce(disagreements, 0) AS disagreements,
  round(CASE WHEN total_comparisons > 0 THEN disagreements / total_comparisons::DOUBLE ELSE 0 END, 6) AS rate FROM s LEFT JOIN p USING (task)""")
def pairwise_divergence(spark, sf_dir):
    return A.pairwise_disagreement(V.outputs(spark, sf_dir)).withColumn("rate", rounded("rate", 6))


@query(SQL["pairwise_divergence"].replace("SELECT s.*,", "SELECT s.task, n_solutions,").replace("coalesce(total_comparisons, 0) AS total_comparisons, coalesce(disagreements, 0) AS disagreements,", "").replace(
    " FROM s LEFT JOIN p", ", n_solutions >= 2 AND coalesce(disagreements / total_comparisons::DOUBLE, 0) >= 0.6E0 AS augment FROM s LEFT JOIN p"))
def consistency_gate(spark, sf_dir):
    gate = A.consistency_gate(A.pairwise_disagreement(V.outputs(spark, sf_dir)), 0.6)
    return gate.select("task", "n_solutions", rounded("rate", 6).alias("rate"), "augment")


def _leveled(spark, sf_dir):
    """Attempts at each level of degradation: a weaker suite lets failing ones pass."""
    levels = F.explode(F.array(*map(F.lit, V.LEVELS)))
    return V.attempts(spark, sf_dir).withColumn("level", levels).withColumn("passed", F.col("passed") | (F.col("draw") < F.col("level")))


def _by_level(spark, sf_dir):
    rates = A.pass_rates(A.attempt_counts(_leveled(spark, sf_dir), ("task", "level", "relation", "model")), (1,))
    return A.mean_agreement(_agreement(rates, ("task", "level")), ("task", "level"))


@query(f"{BY_LEVEL} SELECT task, level, relation, model, count(*) AS n, count(*) FILTER (passed) AS correct FROM leveled GROUP BY ALL")
def degraded_pass(spark, sf_dir):
    return A.attempt_counts(_leveled(spark, sf_dir), ("task", "level", "relation", "model"))


@query(f"{BY_LEVEL} SELECT task, level, round(mean_tau_b, 6) + 0 AS mean_tau_b FROM means")
def tau_by_level(spark, sf_dir):
    return _by_level(spark, sf_dir).withColumn("mean_tau_b", rounded("mean_tau_b", 6))


_PAGE = f"""{BY_LEVEL}, ranked AS (SELECT task, -mean_tau_b AS v, row_number() OVER (PARTITION BY task ORDER BY level) AS i FROM means),
l AS (SELECT task, sum(i * v) AS L, count(*)::DOUBLE AS k FROM ranked GROUP BY task),
z AS (SELECT task, L, (L - k * (k + 1) * (k + 1) / 4) / sqrt(k * k * (k * k - 1) * (k + 2) / 144) AS z FROM l WHERE k >= 3),
page AS (SELECT task, L, z, {NORMAL_TAIL_SQL.format(z="z")} AS p_value FROM z)"""


@query(f"{_PAGE} SELECT task, round(L, 6) + 0 AS L, round(z, 6) AS z, round(p_value, 6) AS p_value, p_value < 0.05 AS decreasing FROM page")
def pages_l(spark, sf_dir):
    return A.page_trend(_by_level(spark, sf_dir), ["task"]).select("task", *[rounded(c, 6).alias(c) for c in ("L", "z", "p_value")], "decreasing")


@query(f"{_PAGE} SELECT count(*) AS n_tasks, count(*) FILTER (p_value < 0.05) AS n_significant, count(*) FILTER (p_value < 0.05) / greatest(count(*), 1)::DOUBLE AS fraction FROM page")
def analyze_summary(spark, sf_dir):
    return A.trend_summary(A.page_trend(_by_level(spark, sf_dir), ["task"]))


@query(f"{BY_LEVEL}, d AS (SELECT task, round(n_dis / total, 6) AS rate FROM (SELECT task, sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END)::DOUBLE AS n_dis, count(*)::DOUBLE AS total FROM (SELECT l_partkey % 164 AS task, l_linenumber, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY 1, 2) GROUP BY 1)) SELECT t.task, round(m.mean_tau_b, 6) + 0 AS intact, round(n.mean_tau_b, 6) + 0 AS degraded, d.rate FROM (SELECT unnest(range(170)) AS task) t LEFT JOIN means m ON m.task = t.task AND m.level = 0 LEFT JOIN means n ON n.task = t.task AND n.level = 0.8E0 LEFT JOIN d ON d.task = t.task")
def task_summaries(spark, sf_dir):
    """One row a task with what each stage has for it; stages that lack it leave nulls."""
    means = _by_level(spark, sf_dir)
    side = lambda level, name: means.where(F.col("level") == level).select("task", rounded("mean_tau_b", 6).alias(name))
    flags = V.read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % V.TASKS).alias("task"), "l_linenumber").agg((F.min("l_returnflag") != F.max("l_returnflag")).alias("differ"))
    rate = flags.groupBy("task").agg(rounded(F.avg(F.col("differ").cast("double")), 6).alias("rate"))
    tasks = spark.range(170).select(F.col("id").alias("task"))
    return tasks.join(side(0.0, "intact"), "task", "left").join(side(0.8, "degraded"), "task", "left").join(rate, "task", "left")


_ASSERT_ORDER = "md5(l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey), " + ", ".join(V.LINE_ORDER[2:])
_ASSERTS = f"WITH a AS (SELECT l_orderkey AS suite, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ASSERT_ORDER}) AS rk, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def _asserts(spark, sf_dir, levels):
    lines = V.read(spark, sf_dir, "lineitem").withColumn("suite", F.col("l_orderkey"))
    order = [F.md5(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), *map(F.col, V.LINE_ORDER[2:])]
    return A.keep_share(lines, "suite", order, levels)


@query(f"{_ASSERTS} SELECT suite, l_linenumber, l_partkey FROM a WHERE rk > floor(n * 0.5E0)")
def degrade_rows(spark, sf_dir):
    return _asserts(spark, sf_dir, [0.5]).select("suite", "l_linenumber", "l_partkey")


@query(f"{_ASSERTS} SELECT suite, level, count(*) AS kept, min(rk) AS first FROM a CROSS JOIN (SELECT unnest([0.0E0, 0.2E0, 0.5E0, 0.8E0]) AS level) WHERE rk > floor(n * level) GROUP BY ALL")
def degrade_levels(spark, sf_dir):
    return _asserts(spark, sf_dir, V.LEVELS).groupBy("suite", "level").agg(F.count(F.lit(1)).alias("kept"), F.min("rk").cast("long").alias("first"))


@query(f"WITH {V.SQL_MUTANTS} SELECT operator, count(*) AS total, count(*) FILTER (is_killed) AS killed, count(*) - count(*) FILTER (is_killed) AS survived, round(count(*) FILTER (is_killed) / count(*)::DOUBLE, 6) AS kill_rate FROM mutants WHERE is_equivalent IS DISTINCT FROM TRUE GROUP BY 1")
def kill_rate(spark, sf_dir):
    mutants = V.mutants(spark, sf_dir)
    return M.kill_rates(M.not_equivalent(mutants, mutants)).withColumn("kill_rate", rounded("kill_rate", 6))


@query(f"WITH {V.SQL_MUTANTS} SELECT task, mutant_id, operator FROM mutants m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.mutant_id AND l.toxic = 1)")
def nonequiv_mutants(spark, sf_dir):
    mutants = V.mutants(spark, sf_dir)
    return M.not_equivalent(mutants.select("task", "mutant_id", "operator"), mutants)


@query(f"WITH {V.SQL_MUTANTS} SELECT task, mutant_id, operator, n_chars FROM mutants WHERE operator <> 'en' UNION ALL SELECT task, mutant_id, 'LLM', -1 FROM mutants WHERE operator = 'en'")
def mutant_union(spark, sf_dir):
    m = V.mutants(spark, sf_dir)
    return M.all_mutants(m.where("operator <> 'en'").select("task", "mutant_id", "operator", "n_chars"), m.where("operator = 'en'").select("task", "mutant_id", F.lit("LLM").alias("operator"))).withColumn("n_chars", F.coalesce("n_chars", F.lit(-1)))


@query(f"WITH {V.SQL_MUTANTS} SELECT coalesce(CAST(is_equivalent AS VARCHAR), 'unjudged') AS reason, count(*) AS n FROM mutants GROUP BY 1")
def equiv_tally(spark, sf_dir):
    return V.mutants(spark, sf_dir).groupBy(F.coalesce(F.col("is_equivalent").cast("string"), F.lit("unjudged")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.SQL_MUTANTS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY mutant_id) - 1 AS raw_ix FROM mutants),
v AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY raw_ix) AS rn FROM r WHERE raw_ix < 12 AND n_chars > 1000) SELECT task, raw_ix, 'LLM_' || raw_ix AS mutant_id FROM v WHERE rn <= 3""")
def first_n_valid(spark, sf_dir):
    from pyspark.sql import Window

    raw = V.mutants(spark, sf_dir).select("task", "mutant_id", "n_chars").withColumn("raw_ix", F.row_number().over(Window.partitionBy("task").orderBy("mutant_id")).cast("long") - 1)
    return M.first_valid(raw.where("raw_ix < 12"), "n_chars > 1000", 3).select("task", "raw_ix", "mutant_id")


_VERDICT = f"""WITH {V.SQL_OUTPUTS}, o AS (SELECT task, sol, inp, CASE WHEN out = 'R' THEN '__timeout__' ELSE out END AS out FROM outputs),
c AS (SELECT task, inp, out AS want, row_number() OVER (PARTITION BY task ORDER BY inp) - 1 AS ix FROM o WHERE sol = 0), m AS (SELECT DISTINCT task, sol AS mutant FROM o WHERE sol > 0),
t AS (SELECT o.task, o.sol AS mutant, ix, out = '__timeout__' OR out <> want AS bad FROM o JOIN c ON o.task = c.task AND o.inp = c.inp AND want <> '__timeout__' WHERE sol > 0),
g AS (SELECT task, mutant, count(*) AS n, min(ix) FILTER (bad) AS first FROM t GROUP BY 1, 2)
SELECT m.task, m.mutant, first IS NULL AS is_equivalent, CASE WHEN first IS NOT NULL THEN 'diverged' WHEN n IS NULL THEN 'no_testable_inputs' ELSE 'no_divergence' END AS reason,
  CAST(CASE WHEN first IS NOT NULL THEN first + 1 ELSE coalesce(n, 0) END AS BIGINT) AS n_inputs_tested FROM m LEFT JOIN g ON m.task = g.task AND m.mutant = g.mutant"""


@query(_VERDICT)
def equivalence_verdict(spark, sf_dir):
    from pyspark.sql import Window

    out = V.outputs(spark, sf_dir).withColumn("out", F.when(F.col("out") == "R", M.TIMEOUT).otherwise(F.col("out")))
    canonical = out.where("sol = 0").select("task", "inp", "out").withColumn("ix", F.row_number().over(Window.partitionBy("task").orderBy("inp")).cast("long") - 1)
    runs = out.where("sol > 0").withColumnRenamed("sol", "mutant")
    placed = runs.join(canonical.select("task", "inp", "ix"), ["task", "inp"]).select("task", "mutant", "ix", "out")
    return M.verdicts(canonical.select("task", "ix", "out"), runs.select("task", "mutant").distinct(), placed)


# paired tests: pass@1 of each task under two relations
_XY = f"WITH {V.SQL_ATTEMPTS}, ps AS (SELECT task, relation, count(*) FILTER (passed) / count(*)::DOUBLE AS p FROM attempts GROUP BY 1, 2), xy AS (SELECT a.task, a.p AS x, b.p AS y FROM ps a JOIN ps b ON a.task = b.task AND a.relation = '1-URGENT' AND b.relation = '2-HIGH')"


def _xy(spark, sf_dir):
    two = V.attempts(spark, sf_dir).where(F.col("relation").isin("1-URGENT", "2-HIGH"))
    p = lambda r: F.count_if((F.col("relation") == r) & F.col("passed")) / F.nullif(F.count_if(F.col("relation") == r), F.lit(0))
    return two.groupBy("task").agg(p("1-URGENT").alias("x"), p("2-HIGH").alias("y")).where("x is not null and y is not null")


@query(f"""{_XY}, d AS (SELECT x - y AS d FROM xy WHERE x <> y), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2E0 AS r FROM d),
t AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))), s AS (SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r),
z AS (SELECT n, w, abs((w - n * (n + 1) / 4E0) / sqrt(n * (n + 1) * (2 * n + 1) / 24E0 - ties / 48E0)) AS z FROM s, t)
SELECT n, CAST(w AS DOUBLE) AS w, round(least(1E0, 2 * {NORMAL_TAIL_SQL.format(z="z")}), 6) AS p_value FROM z""")
def wilcoxon_w(spark, sf_dir):
    return T.wilcoxon(_xy(spark, sf_dir)).withColumn("p_value", rounded("p_value", 6)).withColumn("w", F.col("w").cast("double"))


@query(f"{_XY} SELECT round(sum(sign(a.x - b.y)) / count(*), 6) AS delta FROM xy a CROSS JOIN xy b")
def cliffs_delta(spark, sf_dir):
    xy = _xy(spark, sf_dir)
    return T.cliffs_delta(xy.select(F.col("x").alias("v")), xy.select(F.col("y").alias("v"))).select(rounded("delta", 6).alias("delta"))


@query(f"SELECT w AS statistic, p_value, delta AS cliffs_delta, CAST(NULL AS VARCHAR) AS note FROM ({SQL['wilcoxon_w']}), ({SQL['cliffs_delta']})")
def paired_test(spark, sf_dir):
    got = T.paired_test(_xy(spark, sf_dir))
    return got.select(F.col("statistic").cast("double").alias("statistic"), rounded("p_value", 6).alias("p_value"), rounded("cliffs_delta", 6).alias("cliffs_delta"), "note")


_KILLED = f"""WITH {V.SQL_OUTPUTS}, k AS (SELECT o.task, o.sol AS mutant, o.inp FROM outputs o JOIN outputs c ON o.task = c.task AND o.inp = c.inp AND c.sol = 0 WHERE o.sol > 0 AND o.out <> c.out),
s AS (SELECT task, mutant, list_sort(list(DISTINCT inp)) AS inputs FROM k GROUP BY 1, 2), c AS (SELECT task, inputs, min(mutant) AS class FROM s GROUP BY 1, 2)"""


@query(f"""{_KILLED}, b AS (SELECT w.task, w.class, count(*) FILTER (len(x.inputs) < len(w.inputs) AND list_has_all(w.inputs, x.inputs)) AS subsumed_by FROM c w JOIN c x ON w.task = x.task GROUP BY 1, 2)
SELECT s.task, s.mutant, c.class, len(s.inputs) AS n_inputs, subsumed_by, subsumed_by = 0 AS minimal FROM s JOIN c ON s.task = c.task AND s.inputs = c.inputs JOIN b ON b.task = c.task AND b.class = c.class""")
def minimal_mutants(spark, sf_dir):
    """Solutions as mutants of each task's first, killed by the inputs on which they differ."""
    from ..operators.subsumption import minimal_mutants as minimal

    out = V.outputs(spark, sf_dir)
    canonical = out.where("sol = 0").select("task", "inp", F.col("out").alias("want"))
    return minimal(out.where("sol > 0").join(canonical, ["task", "inp"]).where("out <> want").select("task", F.col("sol").alias("mutant"), "inp"))


@query(f"{BY_LEVEL} SELECT a.task, any_value(n) AS n, round(median((b.mean_tau_b - a.mean_tau_b) / (b.level - a.level)), 6) + 0 AS slope FROM means a JOIN means b ON a.task = b.task AND a.level < b.level JOIN (SELECT task, count(*) AS n FROM means GROUP BY 1) c ON c.task = a.task GROUP BY a.task")
def tau_slopes(spark, sf_dir):
    from ..operators.subsumption import robust_slopes

    return robust_slopes(_by_level(spark, sf_dir), "level", "mean_tau_b", ["task"]).withColumn("slope", rounded("slope", 6))


@query()
def slope_interval(spark, sf_dir):
    """The mean slope of rank agreement against the level of degradation, with its bootstrap interval over tasks."""
    from ..operators.ranks import poisson_bootstrap
    from ..operators.subsumption import robust_slopes

    return poisson_bootstrap(robust_slopes(_by_level(spark, sf_dir), "level", "mean_tau_b", ["task"]), "slope", ["task"])


@query()
def mean_interval(spark, sf_dir):
    """Bootstrap intervals of the mean pass rate over all tasks, by relation: weights by hash, so any number of tasks will do."""
    from ..operators.ranks import poisson_bootstrap

    rates = V.attempts(spark, sf_dir).groupBy("task", "relation").agg((F.count_if("passed") / F.count(F.lit(1))).alias("p"))
    return poisson_bootstrap(rates, "p", ["task", "relation"], by=["relation"])


@query(f"{_XY} SELECT round(sum(sign(b.x - a.x) * sign(b.y - a.y)) / sqrt(CAST(sum(abs(sign(b.x - a.x))) * sum(abs(sign(b.y - a.y))) AS DOUBLE)), 6) AS tau_b FROM xy a JOIN xy b ON a.task < b.task")
def kendall_raw(spark, sf_dir):
    return T.kendall(_xy(spark, sf_dir)).select(rounded("tau_b", 6).alias("tau_b"))


_TIED = ", ".join(f"{c} AS (SELECT sum(t * (t - 1) / 2E0) AS {c}1, sum(t * (t - 1E0) * (t - 2)) AS {c}2, sum(t * (t - 1E0) * (2 * t + 5)) AS {c}3 FROM (SELECT count(*) AS t FROM xy GROUP BY {c[1]}))" for c in ("tx", "ty"))


@query(f"""{_XY}, {_TIED}, s AS (SELECT sum(sign(b.x - a.x) * sign(b.y - a.y))::DOUBLE AS s FROM xy a JOIN xy b ON a.task < b.task), n AS (SELECT count(*)::DOUBLE AS n FROM xy),
z AS (SELECT abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - tx3 - ty3) / 18E0 + 2 * tx1 * ty1 / (n * (n - 1)) + tx2 * ty2 / (9 * n * (n - 1) * (n - 2))) AS z FROM s, n, tx, ty)
SELECT round(least(1E0, 2 * {NORMAL_TAIL_SQL.format(z="z")}), 6) AS p_value FROM z""")
def kendall_p(spark, sf_dir):
    return T.kendall(_xy(spark, sf_dir)).select(rounded("p_value", 6).alias("p_value"))


@query(f"{_XY}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2E0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2E0 AS ry FROM xy) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def spearman_rho(spark, sf_dir):
    return T.spearman(_xy(spark, sf_dir)).select(rounded("rho", 6).alias("rho"))


@query(f"""{_XY}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2E0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2E0 AS ry FROM xy),
t AS (SELECT count(*) - 2 AS f, abs(corr(rx, ry)) * sqrt((count(*) - 2) / (1 - corr(rx, ry) * corr(rx, ry))) AS t FROM r), a AS (SELECT f, f % 2 AS odd, atan(t / sqrt(f)) AS a FROM t),
k AS (SELECT a.*, j, CASE WHEN j = 0 THEN 0E0 WHEN odd = 1 THEN ln(2E0 * j / (2 * j + 1)) ELSE ln((2E0 * j - 1) / (2 * j)) END AS l FROM a, range(0, 1000) s(j) WHERE j <= (f - CASE WHEN odd = 1 THEN 3 ELSE 2 END) // 2),
c AS (SELECT *, exp(sum(l) OVER (ORDER BY j)) * power(cos(a), 2 * j) AS term FROM k), s AS (SELECT any_value(odd) AS odd, any_value(a) AS a, sum(term) AS s FROM c)
SELECT round(1 - CASE WHEN odd = 1 THEN 2 / pi() * (a + sin(a) * cos(a) * s) ELSE sin(a) * s END, 6) AS p_value FROM s""")
def spearman_p(spark, sf_dir):
    return T.spearman(_xy(spark, sf_dir)).select(rounded("p_value", 6).alias("p_value"))


@query(f"{BY_LEVEL}, f AS (SELECT model, level, count(*) FILTER (passed) * 100.0E0 / count(*) AS p FROM leveled GROUP BY 1, 2) SELECT model, " + ", ".join(f"round(max(p) FILTER (level = {x}E0), 6) AS level_{int(x * 100)}" for x in V.LEVELS) + " FROM f GROUP BY 1")
def fig_heatmap(spark, sf_dir):
    got = _leveled(spark, sf_dir).groupBy("model").pivot("level", list(V.LEVELS)).agg(rounded(F.count_if("passed") * 100.0 / F.count(F.lit(1)), 6))
    return got.select("model", *[F.col(f"`{x}`").alias(f"level_{int(x * 100)}") for x in V.LEVELS])


@query(f"{TAUS} SELECT relation, round(min(tau_b), 6) + 0 AS low, round(quantile_cont(tau_b, 0.25), 6) + 0 AS q1, round(quantile_cont(tau_b, 0.5), 6) + 0 AS median, round(quantile_cont(tau_b, 0.75), 6) + 0 AS q3, round(max(tau_b), 6) + 0 AS high FROM taus GROUP BY 1")
def fig_box(spark, sf_dir):
    q = lambda p: F.percentile("tau_b", F.lit(p))
    parts = {"low": F.min("tau_b"), "q1": q(0.25), "median": q(0.5), "q3": q(0.75), "high": F.max("tau_b")}
    return _agreement(_rates(spark, sf_dir)).groupBy("relation").agg(*[rounded(e, 6).alias(n) for n, e in parts.items()])


@query(SQL["kill_rate"].replace("SELECT operator, count(*) AS total, count(*) FILTER (is_killed) AS killed, count(*) - count(*) FILTER (is_killed) AS survived, round(count(*) FILTER (is_killed) / count(*)::DOUBLE, 6) AS kill_rate", "SELECT operator, round(100 * count(*) FILTER (is_killed) / count(*)::DOUBLE, 6) AS percent"))
def fig_kill_bars(spark, sf_dir):
    mutants = V.mutants(spark, sf_dir)
    return M.kill_rates(M.not_equivalent(mutants, mutants)).select("operator", rounded(F.col("kill_rate") * 100, 6).alias("percent"))
