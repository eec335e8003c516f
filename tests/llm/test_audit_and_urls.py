import hashlib
import random

import duckdb
import pytest

import oracle
from tallyforge.llm import fixity, language, queries, urls

from test_operators import RULES, frame, pages


def stored(url, html):
    size = lambda x: "-" if x is None else str(len(x.encode()))
    return f"WARC/1.1\r\n{size(url)}\r\n{size(html)}\r\n{url or ''}\r\n{html or ''}\r\n\r\n".encode()


def test_nodes_cover_their_children_in_order_with_offsets(spark):
    rows = [(i, f"u{i}", "b" * (i % 7)) for i in (3, 1, 30, 40, 41)]
    leaves = fixity.leaves(pages(spark, [(*r, None, None) for r in rows]), "page_id", "url", "html")
    digest = {r.slot: r.digest for r in leaves.collect()}
    got = {r.range: (r.n_bytes, r.digest) for r in fixity.chained(leaves, ["shard", "range"], "slot").collect()}
    for node, ids in ((0, (1, 3, 30)), (1, (40, 41))):
        text, at = "", 0
        for i in ids:
            end = at + len(stored(f"u{i}", "b" * (i % 7)))
            text += f"{i}@{at}-{end}:{digest[i]}\n"
            at = end
        assert got[node] == (at, hashlib.sha256(text.encode()).hexdigest())


def test_damage_below_equal_lengths_and_a_very_long_record(spark):
    """Two records that change places keep all lengths and sums, and a long one differs in its last byte."""
    rows = [(i, f"u{i}", f"body {i:04d}") for i in range(200)] + [(300, "long", "x" * 3_000_000)]
    worse = [(i, u, rows[11 if i == 10 else 10 if i == 11 else k][2]) for k, (i, u, _) in enumerate(rows[:-1])] + [(300, "long", "x" * 2_999_999 + "y")]
    left, right = (pages(spark, [(*r, None, None) for r in side]) for side in (rows, worse))
    assert {(r.slot, r.status) for r in fixity.merkle_audit(left, right)[1].collect()} == {(10, "corrupt"), (11, "corrupt"), (300, "corrupt")}


def test_letters(spark):
    docs = frame(spark, ["²½ ³", "٣ 12", "a", "\U00010400", "", None])
    model = language.fit_languages(frame(spark, ["abc", "xyz"], lang=["en", "de"]))
    assert [r.lang_pred == language.UNKNOWN for r in sorted(language.predict_languages(docs, model).collect())] == [True, True, False, False, True, True]


def slow_hits(text, vocabulary):
    word = set("abcdefghijklmnopqrstuvwxyz0123456789")
    found = []
    for t in vocabulary:
        for i in range(len(text) - len(t.text) + 1):
            if text.startswith(t.text, i) and (not i or text[i - 1] not in word) and (i + len(t.text) == len(text) or text[i + len(t.text)] not in word):
                found.append(t)
    return sum(t.strict for t in found), sum(not t.strict for t in found), len({t for t in found if not t.strict}), sum(t.weight for t in set(found))


def test_weighted_vocabulary_equals_brute_force(spark):
    table = spark.createDataFrame([("Bad", None, True), ("ab", 0.5, False), ("b-a", 2.0, None), ("ab", 1.5, None), ("", 1.0, True), (None, 1.0, True)], "term string, weight double, strict boolean")
    vocabulary = urls.read_vocabulary(table)
    assert vocabulary == (urls.Term("ab", 1.5, False), urls.Term("b-a", 2.0, False), urls.Term("bad", 1.0, True))
    rng = random.Random(3)
    texts = ["".join(rng.choice("abd-/") for _ in range(12)) for _ in range(300)] + ["ab/" * 50_000 + "bad", None, "ab-a", "ab-a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(rows, RULES, vocabulary=vocabulary).collect()}
    heavy = {r.page_id: r.verdict for r in urls.judge_urls(rows, RULES, vocabulary=vocabulary, soft_weight=3.4).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t and len(t) > 1000:
            assert got[i].strict_hits == 1 and got[i].soft_hits == 50_000
            continue
        want = slow_hits(t or "", vocabulary)
        assert (got[i].strict_hits, got[i].soft_hits, got[i].distinct_soft_hits) == want[:3] and got[i].weight == pytest.approx(want[3])
        assert (got[i].verdict == "block") == (want[0] > 0 or want[2] >= 2)
        assert (heavy[i] == "block") == (want[0] > 0 or (want[2] >= 2 and want[3] >= 3.4))


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://a.net?u=http://b.net/es/", "a.net", "", None, "allow"), ("http://a.com?x=http://b.net/es/z", "a.com", "", None, "allow"), ("http://a.net#://b.net/es/", "a.net", "", None, "allow"),
    ("http://b.net/es/?u=http://a.com/", "b.net", "/es/", "net/es/", "block"), ("://a\nb.net/es/x\ny", "a\nb.net", "/es/x\ny", "net/es/", "block"), ("http://B.NET/ES/" + "x" * 100_000, "b.net", "/ES/" + "x" * 100_000, None, "allow"),
])
def test_only_the_first_scheme_counts(spark, url, host, path, rule, verdict):
    rules = [urls.Rule("block", "net", "/es/")]
    got = urls.judge_urls(spark.createDataFrame([(1, url), (1, url)], "page_id long, url string"), rules).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [(host, path, rule, verdict)] * 2


def test_query_equals_sql_on_odd_urls(spark, tmp_path):
    """The statement is written without the query's patterns: hosts by splitting, words by tokens."""
    texts = [None, "", "http://a.net?u=http://b.net/es/", "http://a.com?x=http://b.net/es/z", "x://y://net/es/", "http://a.org/free/win", "http://a.org/free/crack", "http://a.org/cheap-pills-cheap-pills"]
    texts += ["HTTP://WWW.EXAMPLE.COM/en/#a", "http://example.com/en/?b", "http://a.org/bet/loan", "http://a.org/cheap/pills?cheap", "http://net/fr/", "http://", "a.org/casino"]
    spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    oracle.check(queries.QUERIES["op6_url_filter"], queries.SQL["op6_url_filter"], spark, str(tmp_path), con)
    verdicts = {r.page_id: r.verdict for r in queries.QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()}
    assert [verdicts[i] for i in (2, 3, 5, 6, 10, 14)] == ["allow", "allow", "allow", "block", "block", "block"]
