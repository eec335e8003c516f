import random

import numpy as np

from tallyforge.llm import decontamination

from test_operators import brute_edits, frame, odd, prose


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Pi is 3"), (2, "pi"), (3, "--"), (4, ""), (5, "PI-IS 3")], "item_id long, text string")
    texts = ["We know pi is 3.", "pi!", "pie is 33", "", None, "x PI", "api is 3"]
    got = decontamination.find_contamination(frame(spark, texts), bench).collect()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in got} == {0: [1, 2, 5], 1: [2], 2: [], 3: [], 4: [], 5: [2], 6: []}
    assert [(h.start, h.end, h.edits) for r in got if r.doc_id == 5 for h in r.hits] == [(2, 4, 0)]


def test_pieces_count_like_the_whole(monkeypatch):
    """A q-gram that many items share is expanded in pieces; the bands are the same."""
    stem = prose(1, 10)
    index = decontamination.Items([(i, f"{stem} {prose(50 + i, 8)}") for i in range(60)], 10, 0.08)
    doc = decontamination.normalise(f"{prose(2, 30)} {stem} {prose(55, 8)} {prose(3, 300)} {stem}")[0]
    whole = index.bands(doc)
    monkeypatch.setattr(decontamination, "CHUNK", 97)
    pieces = index.bands(doc)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))


def test_blocks_one_after_another(spark):
    """Several blocks: one search in the plan, clashing column replaced, repeated rows kept, a very long text searched to its end."""
    items = [(i, prose(100 + i, 12)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(200, 30_000) + " " + items[5][1], items[2][1], items[2][1]]
    found = decontamination.find_contamination(frame(spark, texts), bench, block_chars=150)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted([h.item_id for h in r.hits] for r in found.collect()) == [[2], [2], [5]]
    assert decontamination.find_contamination(odd(spark), bench, block_chars=150).count() == 7


def test_short_items_have_their_whole_budget(spark):
    """Items of 10 to 60 characters with up to one edit more than 8 %, substituted, inserted or deleted, against brute force."""
    rng = random.Random(5)
    items = [(n, prose(500 + n, 40)[:n].strip().ljust(n, "k")) for n in range(10, 61)]
    texts, planted = [], []
    for n, item in items:
        for edits in range(int(0.08 * n) + 2):
            s = list(item)
            for _ in range(edits):
                at = rng.randrange(1, len(s) - 1)
                s[at : at + 1] = rng.choice([["q"], [], ["j", s[at]]])
            texts.append(f"{prose(n, 6)} {''.join(s)} {prose(n + 1, 6)}")
            planted.append((n, item))
    found = decontamination.find_contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: {h.item_id: h.edits for h in r.hits} for r in found.collect()}
    plain = lambda x: "".join(map(chr, decontamination.normalise(x)[0]))
    caught = 0
    for i, (n, item) in enumerate(planted):
        d = brute_edits(plain(item), plain(texts[i]))
        assert got[i].get(n) == (d if d <= int(0.08 * n) else None), (item, texts[i])
        caught += n < 40 and 0 < d <= int(0.08 * n)
    assert caught > 20


def test_several_texts_of_one_item(spark):
    a, b = prose(31, 10), prose(32, 10)
    bench = spark.createDataFrame([(1, a), (1, b)], "item_id long, text string")
    for chars in (2_000_000, 40):
        (r,) = decontamination.find_contamination(frame(spark, [f"{a[:10]}q{a[11:]} and {b}"]), bench, block_chars=chars).collect()
        assert [(h.item_id, h.edits) for h in r.hits] == [(1, 0)]


def test_repeated_and_null_texts_over_blocks(spark):
    """Hits are kept by text between blocks: copies, nulls and rows without doc_id all get theirs."""
    items = [(i, prose(100 + i, 12)) for i in range(6)]
    text = f"{items[0][1]} {items[3][1]} {items[5][1]}"
    rows = spark.createDataFrame([(1, text, 5), (None, text, 6), (1, text, 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, hits int")
    found = decontamination.find_contamination(rows, spark.createDataFrame(items, "item_id long, text string"), block_chars=100)
    assert sorted(map(str, ([h.item_id for h in r.hits] for r in found.collect()))) == ["[0, 3, 5]"] * 3 + ["[]"] * 2
    assert found.where("size(hits) > 0").count() == 3
