"""The tables as the engine's fact tables and dimensions, and the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = 164
MODELS = ("F", "O", "P")
RELATIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BASELINE = RELATIONS[0]
LEVELS = (0.0, 0.2, 0.5, 0.8)
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_partkey") % TASKS).alias("task"),
        F.col("o_orderpriority").alias("relation"),
        F.col("o_orderstatus").alias("model"),
        (F.col("l_returnflag") == "N").alias("passed"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("sample_ix"),
        hex_unit(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("draw"),
    )


SQL_ATTEMPTS = """attempts AS (SELECT l_partkey % 164 AS task, o_orderpriority AS relation, o_orderstatus AS model, l_returnflag = 'N' AS passed,
  l_orderkey * 1000 + l_linenumber AS sample_ix,
  CAST(('0x' || substr(md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey), 1, 8)) AS BIGINT) / 4294967296.0E0 AS draw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of 15 solutions of each task on its inputs, one a (task, sol, inp)."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)  # small integers keep the aggregate hashed
    got = lines.groupBy((F.col("l_partkey") % TASKS).alias("task"), (F.col("l_suppkey") % 15).alias("sol"), F.col("l_linenumber").alias("inp")).agg(F.min(code).alias("code"))
    return got.select("task", "sol", "inp", F.when(F.col("code") == 1, "A").when(F.col("code") == 2, "N").otherwise("R").alias("out"))


SQL_OUTPUTS = "outputs AS (SELECT l_partkey % 164 AS task, l_suppkey % 15 AS sol, l_linenumber AS inp, min(l_returnflag) AS out FROM lineitem GROUP BY 1, 2, 3)"


def mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("task"), F.col("doc_id").alias("mutant_id"), F.col("lang").alias("operator"), (F.col("quality") == 1).alias("is_killed"), (F.col("toxic") == 1).alias("is_equivalent"), "n_chars"
    )


SQL_MUTANTS = """mutants AS (SELECT source AS task, doc_id AS mutant_id, lang AS operator, quality = 1 AS is_killed, toxic = 1 AS is_equivalent, n_chars
  FROM documents LEFT JOIN labels USING (doc_id))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as reference and the assistant's next one as hypothesis."""
    talk = read(spark, sf_dir, "conversations")
    user = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    reply = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return user.join(reply, ["conv_id", "turn"])


SQL_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS reference, a.text AS hypothesis FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as prompts in four shapes, by item_id modulo 4."""
    t, name = F.col("text"), F.concat(F.lit("f_"), F.col("item_id"))
    head = F.concat(F.lit("from typing import List\n\ndef "), name, F.lit("(x: int) -> int:\n"))
    shape = F.col("item_id") % 4
    prompt = (
        F.when(shape == 0, F.concat(head, F.lit('    """ Please help. '), t, F.lit("\n    Note that it is small.\n    >>> "), name, F.lit('(2)\n    3\n    """\n')))
        .when(shape == 1, F.concat(head, F.lit('    """\n    '), t, F.lit('\n    Make sure, for example, it works.\n\n\n\n    Keep in mind the rest.\n    """\n')))
        .when(shape == 2, F.concat(head, F.lit("    # Remember: no docstring. You should read on.\n")))
        .otherwise(F.concat(head, F.lit("    '''\n    "), t, F.lit("\n    >>> "), name, F.lit("(1)\n    2\n    '''\n")))
    )
    raw = (
        F.when(shape == 0, F.concat(F.lit("Here it is:\n```python\n    y = x + 1\n    return y\n```\n"), t))
        .when(shape == 1, F.concat(F.lit("import math\ndef "), name, F.lit("(x):\n    return x + 1\n")))
        .when(shape == 2, F.concat(F.lit("```\nimport math\n\ndef "), name, F.lit(" (x):\n    return x\n```")))
        .otherwise(F.lit("    return x + 1\n"))
    )
    return read(spark, sf_dir, "benchmark").select("item_id", prompt.alias("prompt"), name.alias("entry_point"), raw.alias("raw"), F.concat(F.lit("def check(candidate):\n    assert candidate(1) == "), F.col("item_id")).alias("test"))


SQL_PROMPTS = r"""b AS (SELECT item_id, text, 'f_' || item_id AS entry_point, E'from typing import List\n\ndef f_' || item_id || E'(x: int) -> int:\n' AS head FROM benchmark),
prompts AS (SELECT item_id, entry_point, CASE item_id % 4
    WHEN 0 THEN head || '    QUOTES Please help. ' || text || E'\n    Note that it is small.\n    >>> ' || entry_point || E'(2)\n    3\n    QUOTES\n'
    WHEN 1 THEN head || E'    QUOTES\n    ' || text || E'\n    Make sure, for example, it works.\n\n\n\n    Keep in mind the rest.\n    QUOTES\n'
    WHEN 2 THEN head || E'    # Remember: no docstring. You should read on.\n'
    ELSE head || E'    \'\'\'\n    ' || text || E'\n    >>> ' || entry_point || E'(1)\n    2\n    \'\'\'\n' END AS prompt,
  CASE item_id % 4 WHEN 0 THEN E'Here it is:\n```python\n    y = x + 1\n    return y\n```\n' || text
    WHEN 1 THEN E'import math\ndef ' || entry_point || E'(x):\n    return x + 1\n'
    WHEN 2 THEN E'```\nimport math\n\ndef ' || entry_point || E' (x):\n    return x\n```'
    ELSE E'    return x + 1\n' END AS raw, E'def check(candidate):\n    assert candidate(1) == ' || item_id AS test FROM b)""".replace("QUOTES", '"""')


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"))


SQL_REQUESTS = "requests AS (SELECT event_id, user_id, event_type, props, epoch_us(ts) AS arrival_us FROM events)"
