"""URL rules and a weighted URL vocabulary matched by an Aho-Corasick automaton.

A vocabulary is a table of terms (term, weight, strict); read_vocabulary takes one of any source. STRICT and SOFT are a small default for tests and first runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One of these rejects a url.
STRICT = ("cheap-pills", "spam-farm", "porn", "xxx", "casino", "viagra", "warez", "malware", "phishing", "escort")
#: Soft terms and their weights: words that plain pages use as well weigh half.
SOFT = {
    "cheap": 1.0, "free": 0.5, "pills": 1.5, "spam": 1.5, "farm": 0.5, "bonus": 1.0, "win": 0.5, "prize": 1.0, "deal": 0.5, "click": 0.5, "loan": 1.0, "bet": 1.0, "crypto": 1.0, "sale": 0.5,
    "adult": 1.0, "dating": 1.0, "torrent": 1.5, "crack": 1.5,
}
#: What the different soft terms of a url must weigh together, in the query.
SOFT_WEIGHT = 1.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Term:
    text: str
    weight: float = 1.0
    strict: bool = False


DEFAULT = tuple(Term(t, 2.0, True) for t in STRICT) + tuple(Term(t, w) for t, w in SOFT.items())
#: Terms of a vocabulary, which goes to every worker.
MOST_TERMS = 200_000


def vocabulary_table(spark: SparkSession, terms: Sequence[Term] = DEFAULT) -> DataFrame:
    """Terms as the table that read_vocabulary takes, to be stored, joined or extended."""
    return spark.createDataFrame([(t.text, t.weight, t.strict) for t in terms], "term string, weight double, strict boolean")


def read_vocabulary(table: DataFrame) -> tuple[Term, ...]:
    """The vocabulary of a table (term, weight, strict): lower-cased; null or empty terms are left out, a null weight is 1, and a term listed twice is strict if it
    is so once and has its largest weight. More than MOST_TERMS raise ValueError."""
    rows = table.select(F.translate("term", UPPER, LOWER).alias("term"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("strict", F.lit(False)).alias("strict")).where("term <> ''")
    found = rows.groupBy("term").agg(F.max("weight").alias("weight"), F.max("strict").alias("strict")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(Term(r.term, float(r.weight), bool(r.strict)) for r in sorted(found))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one. Cut by position, so that a later `://` in a path or query never counts."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))


def vocabulary_hits(vocabulary: Sequence[Term]):
    """A pandas UDF: numbers of occurrences of strict terms, of soft terms and of different soft terms in a text, and the weight of its different terms.

    A term counts where no ASCII letter or digit touches it. The automaton is built once in each Python worker.
    """
    terms = {t.text: t for t in sorted(vocabulary, key=lambda t: t.strict)}

    @F.pandas_udf("strict long, soft long, distinct_soft long, weight double")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in terms.values():
            automaton.add_word(term.text, term)
        automaton.make_automaton()
        touches = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in texts:
            out = []
            for text in batch:
                found = []
                for end, term in automaton.iter(text or "") if terms else ():
                    start = end - len(term.text)
                    if (start < 0 or text[start] not in touches) and (end + 1 == len(text) or text[end + 1] not in touches):
                        found.append(term)
                n_strict, distinct = sum(t.strict for t in found), set(found)
                out.append((n_strict, len(found) - n_strict, sum(not t.strict for t in distinct), sum(sorted(t.weight for t in distinct))))
            yield pd.DataFrame(out, columns=["strict", "soft", "distinct_soft", "weight"]).astype({"weight": "float64"})

    return hits


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, vocabulary: Sequence[Term] = DEFAULT, soft_hits: int = 2, soft_weight: float | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and the vocabulary's counts and weight.

    The longest fitting rule decides; else one strict term or soft_hits different soft terms block; with soft_weight, their different terms must weigh as much as well. A url that is null
    or has no `://` has an empty host and path; its text is still searched (null: no hits), so it is allowed unless
    the vocabulary blocks it. Rows are judged one by one: repeated rows stay, urls of any length are searched whole, empty tables give empty results. Columns of pages
    of the names added here are replaced.
    """
    out = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    found = None
    for rule in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = rule_fits(rule, F.col("host"), F.col("path"))
        hit = F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    out = out.withColumn("_rule", F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found)
    out = out.withColumn("_hits", vocabulary_hits(vocabulary)(F.translate(F.col("url"), UPPER, LOWER)))
    several = F.col("_hits.distinct_soft") >= soft_hits
    if soft_weight is not None:
        several &= F.col("_hits.weight") >= soft_weight
    blocked = (F.col("_hits.strict") > 0) | several
    return (
        out.withColumn("rule", F.col("_rule.rule"))
        .withColumn("verdict", F.coalesce(F.col("_rule.verdict"), F.when(blocked, "block").otherwise("allow")))
        .withColumn("strict_hits", F.col("_hits.strict"))
        .withColumn("soft_hits", F.col("_hits.soft"))
        .withColumn("distinct_soft_hits", F.col("_hits.distinct_soft"))
        .withColumn("weight", F.col("_hits.weight"))
        .drop("_rule", "_hits")
    )
