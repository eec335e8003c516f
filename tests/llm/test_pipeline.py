import os

import pytest

import corpus_pipeline
from tallyforge.llm import decontamination

from test_operators import DOCS, PRIVATE, edited, frame, odd, prose


@pytest.fixture
def corpus(spark, tmp_path):
    texts = [prose(i, 60) for i in range(30)]
    texts += [edited(texts[0], 3, 1), texts[1], prose(90, 20) + " " + prose(500, 15) + " " + prose(91, 20), "12 34 !!", None, "", prose(92, 20) + " " + PRIVATE]
    docs = frame(spark, texts, source=["a", "b"] * 18 + ["a"])
    for name, df in {
        "documents": docs,
        "benchmark": spark.createDataFrame([(1, prose(500, 15))], "item_id long, text string"),
        "labels": spark.createDataFrame([(0, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path), texts


def test_stages_keep_what_they_should(spark, corpus):
    sf_dir, texts = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "private data", "mixing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    everything = set(range(len(texts)))
    docs = stage["language"](spark, docs, sf_dir)
    assert tuple(docs.columns) == corpus_pipeline.COLUMNS and ids(docs) == everything - {33, 34, 35}
    docs = stage["near duplicates"](spark, docs, sf_dir)
    assert tuple(docs.columns) == corpus_pipeline.COLUMNS and ids(docs) == everything - {33, 34, 35, 30, 31}
    docs = stage["decontamination"](spark, docs, sf_dir)
    assert tuple(docs.columns) == corpus_pipeline.COLUMNS and ids(docs) == everything - {33, 34, 35, 30, 31, 32}
    docs = stage["private data"](spark, docs, sf_dir)
    kept = {r.doc_id: r for r in docs.collect()}
    assert "<EMAIL>" in kept[36].text and "@" not in kept[36].text and kept[36].n_chars == len(kept[36].text)
    assert all(kept[i].text == texts[i] for i in kept if i != 36)
    mixed = stage["mixing"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= set(kept) and all(0 < r.taken <= 3 * r.size for r in mixed)


def test_run(spark, corpus):
    sf_dir, _ = corpus
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} <= set(range(30)) | {36}


def test_odd_rows_pass_through(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd(spark), spark.createDataFrame([], DOCS)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() <= n
    # of repeated rows one stays, and rows without text are classes of their own
    left = corpus_pipeline.drop_near_duplicates(spark, odd(spark), str(tmp_path))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.select("doc_id").collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_registered_queries_equal_sql(spark):
    import oracle
    from tallyforge.llm import queries

    con = oracle.connection(SF)
    for name, sql in queries.SQL.items():
        oracle.check(queries.QUERIES[name], sql, spark, SF, con)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_decontamination_catches_verbatim_items(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    for r in decontamination.find_contamination(docs, bench).select("text", "hits").collect():
        assert {i for i, t in items if t.lower() in (r.text or "").lower()} <= {h.item_id for h in r.hits}
