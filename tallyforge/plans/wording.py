"""Queries over prompts, completions and reply pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_text(x: str) -> str:
    return "E'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# the parts of a prompt, found by positions of lines here and by expressions over matches in the plan
_LINES = f"""WITH {V.SQL_PROMPTS},
o AS (SELECT *, least(CASE WHEN instr(prompt, QQQ) > 0 THEN instr(prompt, QQQ) ELSE 1000000 END, CASE WHEN instr(prompt, APO) > 0 THEN instr(prompt, APO) ELSE 1000000 END) AS spot FROM prompts),
l AS (SELECT *, spot < 1000000 AS has, length(regexp_replace(substr(prompt, 1, spot - 1), '[^\\n]*$', '')) AS before FROM o),
n AS (SELECT *, substr(prompt, before + 1) AS tail FROM l),
m AS (SELECT *, CASE WHEN instr(tail, chr(10)) > 0 THEN substr(tail, 1, instr(tail, chr(10))) ELSE tail END AS line FROM n),
q AS (SELECT *, CASE WHEN contains(line, QQQ) THEN QQQ ELSE APO END AS quote, substr(tail, length(line) + 1) AS rest FROM m),
a AS (SELECT *, regexp_replace(substr(line, instr(line, quote) + 3), '^\\s+|\\s+$', '', 'g') AS after FROM q),
s AS (SELECT *, after <> '' AND after <> quote AS inl FROM a),
d AS (SELECT *, substr(prompt, 1, before) || CASE WHEN inl THEN substr(line, 1, instr(line, quote) + 2) || chr(10) ELSE line END AS sig, CASE WHEN inl THEN after || chr(10) || rest ELSE rest END AS body FROM s),
e AS (SELECT *, regexp_extract(chr(10) || body, '(?s)(\\n[ \\t]*>>>.*)$', 1) AS found FROM d),
p AS (SELECT item_id, prompt, CASE WHEN has THEN sig ELSE prompt END AS signature,
  CASE WHEN NOT has THEN '' WHEN found <> '' THEN substr(body, 1, length(body) - length(found) + 1) ELSE body END AS description,
  CASE WHEN has AND found <> '' THEN substr(found, 2) ELSE '' END AS examples FROM e)""".replace("QQQ", "'\"\"\"'").replace("APO", "''''''''")


@query(f"{_LINES} SELECT item_id, signature, description, examples FROM p")
def split_docstring(spark, sf_dir):
    return V.prompts(spark, sf_dir).select("item_id", T.split_docstring(F.col("prompt")).alias("p")).select("item_id", "p.*")


_TERSE = "prompt"
for _filler in T.FILLERS:
    _TERSE = f"regexp_replace({_TERSE}, {_sql_text('(?i)' + _filler)}, '', 'g')"


@query(f"""{_LINES} SELECT item_id, 'original' AS relation, prompt FROM p UNION ALL SELECT item_id, 'persona', {_sql_text(T.PERSONA)} || prompt FROM p
UNION ALL SELECT item_id, 'formal', signature || {_sql_text(T.FORMAL)} || description || examples FROM p
UNION ALL SELECT item_id, 'reorder', CASE WHEN examples <> '' THEN signature || examples || description ELSE prompt END FROM p
UNION ALL SELECT item_id, 'terse', regexp_replace({_TERSE}, E'\\\\n{{3,}}', E'\\n\\n', 'g') FROM p""")
def relations_long(spark, sf_dir):
    return V.prompts(spark, sf_dir).select("item_id", F.explode(T.relations(F.col("prompt"))).alias("relation", "prompt"))


_BODY = rf"""WITH {V.SQL_PROMPTS}, f AS (SELECT *, CASE WHEN regexp_matches(raw, '(?s)```(?:python)?\s*(.*?)```') THEN regexp_extract(raw, '(?s)```(?:python)?\s*(.*?)```', 1) ELSE raw END AS code FROM prompts),
g AS (SELECT *, regexp_extract(code, '(?s)(def\s+f_[0-9]+\s*\(.*)', 1) AS fn FROM f), body AS (SELECT *, CASE WHEN fn <> '' THEN fn ELSE code END AS body FROM g)"""


@query(f"{_BODY} SELECT item_id, body FROM body")
def extract_body(spark, sf_dir):
    return V.prompts(spark, sf_dir).select("item_id", T.extract_body(F.col("raw"), F.col("entry_point")).alias("body"))


@query(rf"{_BODY} SELECT item_id, CASE WHEN regexp_matches(body, '^\s*def\s+') THEN body ELSE prompt || body END AS program FROM body")
def assemble_solution(spark, sf_dir):
    p = V.prompts(spark, sf_dir).withColumn("body", T.extract_body(F.col("raw"), F.col("entry_point")))
    return p.select("item_id", T.assemble(F.col("prompt"), F.col("body")).alias("program"))


@query(f"WITH {V.SQL_PROMPTS} SELECT item_id, test || E'\\ncheck(' || entry_point || E')\\n' AS driver FROM prompts")
def test_driver(spark, sf_dir):
    return V.prompts(spark, sf_dir).select("item_id", T.test_driver(F.col("test"), F.col("entry_point")).alias("driver"))


@query(rf"""WITH {V.SQL_PROMPTS} SELECT item_id, CASE WHEN regexp_matches(prompt, '(?s)QQQ(.*?)QQQ') THEN regexp_replace(regexp_extract(prompt, '(?s)QQQ(.*?)QQQ', 1), '^\s+|\s+$', '', 'g') ELSE prompt END AS docstring FROM prompts""".replace("QQQ", '"""'))
def docstring_extract(spark, sf_dir):
    return V.prompts(spark, sf_dir).select("item_id", T.docstring_of(F.col("prompt")).alias("docstring"))


_WORDS = r"""list_filter(string_split_regex(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')"""
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_PAIRS = rf"""WITH {V.SQL_PAIRS}, w AS (SELECT conv_id, turn, hypothesis, {_WORDS.format(x="lower(reference)")} AS r, {_WORDS.format(x="lower(hypothesis)")} AS h, {_WORDS.format(x="reference")} AS raw FROM pairs),
b AS (SELECT *, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS rb, list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1]) AS hb,
  list_distinct(list_transform(list_filter(raw, lambda x: length(x) > 3 AND NOT list_contains([{_STOP}], lower(x))), lambda x: trim(lower(x), '{T.PUNCTUATION}'))) AS wanted FROM w),
v AS (SELECT conv_id, turn, CASE WHEN len(h) = 0 THEN 0E0 ELSE len(list_filter(h, lambda x: list_contains(r, x))) / len(h)::DOUBLE END AS bleu,
  CASE WHEN len(hb) = 0 THEN 0E0 ELSE len(list_filter(hb, lambda x: list_contains(rb, x))) / len(hb)::DOUBLE END AS semantic,
  CASE WHEN len(wanted) = 0 THEN 1E0 ELSE len(list_filter(wanted, lambda x: contains(lower(hypothesis), x))) / len(wanted)::DOUBLE END AS completeness FROM b)"""


def _score(expression, name):
    def run(spark, sf_dir):
        return V.pairs(spark, sf_dir).select("conv_id", "turn", F.round(expression(F.col("reference"), F.col("hypothesis")), 6).alias(name))

    return run


QUERIES["bleu1"], SQL["bleu1"] = _score(T.unigram_precision, "bleu"), f"{_PAIRS} SELECT conv_id, turn, round(bleu, 6) AS bleu FROM v"
QUERIES["bigram_precision"], SQL["bigram_precision"] = _score(T.bigram_precision, "semantic"), f"{_PAIRS} SELECT conv_id, turn, round(semantic, 6) AS semantic FROM v"
QUERIES["completeness"], SQL["completeness"] = _score(T.completeness, "completeness"), f"{_PAIRS} SELECT conv_id, turn, round(completeness, 6) AS completeness FROM v"
QUERIES["sbc_score"], SQL["sbc_score"] = _score(T.sbc, "sbc"), f"{_PAIRS} SELECT conv_id, turn, round((semantic + bleu + completeness) / 3E0, 6) AS sbc FROM v"
