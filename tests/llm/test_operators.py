import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, fixity, language, mixing, near_dup, neighbours, pii, suffix_dedup, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, score string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "ru", "se") for b in ("lan", "dor", "vex", "nim") for c in ("a", "o", "is", "et")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or ""), "h", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls in every column, empty texts, repeated rows, a very long text, columns with clashing names."""
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "h", None), (2, prose(1, 60), None, None, 1, None, "s"), (2, prose(1, 60), None, None, 1, None, "s"), (3, prose(2, 30_000), "en", "a", 1, "h", "s"), (None, prose(3, 20), "en", "b", 1, "h", "s"), (4, "\x00 é ß 12", "de", "b", 1, "h", "s")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, slot string, digest string")


def test_audit_finds_damage_only(spark):
    rows = [(i, f"u{i}", f"body {i}", "x", "y") for i in range(3000)] + [(7, "again", None, "x", "y"), (None, None, None, None, None)]
    left = pages(spark, rows)
    assert fixity.merkle_audit(left, left)[1].count() == 0
    worse = [(i, u, "changed" if i == 40 else h, a, b) for i, u, h, a, b in rows if i != 2999] + [(8, "new", "", "x", "y"), (5000, "far", "", "x", "y")]
    leaves, damage = fixity.merkle_audit(left, pages(spark, worse))
    assert {(r.slot, r.status) for r in damage.collect()} == {(40, "corrupt"), (2999, "missing"), (8, "extra"), (5000, "extra")}
    assert leaves.count() == 3001
    first = leaves.where("shard = 0").orderBy("slot").collect()
    assert first[0].start_offset == 0 and all(a.end_offset == b.start_offset for a, b in zip(first, first[1:]))


def test_audit_of_nulls_and_nothing(spark):
    none, some = pages(spark, []), pages(spark, [(None, None, None, None, None), (None, "", "", None, None)])
    assert fixity.merkle_audit(none, none)[1].count() == 0
    assert [(r.slot, r.status) for r in fixity.merkle_audit(some, none)[1].collect()] == [(None, "missing")]
    # null and empty differ
    assert fixity.merkle_audit(pages(spark, [(1, None, None, None, None)]), pages(spark, [(1, "", "", None, None)]))[1].first().status == "corrupt"


# 2


def brute_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - size + 1):
            count[b[i : i + size]] = count.get(b[i : i + size], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    shared = prose(5, 120)
    texts = [prose(6, 150), shared, prose(7, 40) + shared + prose(8, 40), shared[:399], prose(9, 80) + shared[100:600] + "é" * 30 + shared[50:460], None, "", "ab" * 1500, "ab" * 300 + prose(6, 150)[20:500], prose(10, 90), prose(10, 90)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    want = brute_repeats(texts, suffix_dedup.SIZE)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("common_rows", [3, 12, 10_000])
def test_repeats_of_common_passages(spark, common_rows):
    """Passages just under and over the length, with other neighbours in every text: split strings give what unsplit ones do."""
    exact, under, over, long = prose(20, 90)[:400], prose(21, 90)[:399], prose(22, 90)[:430], prose(23, 200)
    texts = [prose(1000 + i, 5 + i % 7) + p + prose(2000 + i, 9) for i in range(14) for p in (exact, under, over, long)]
    texts += [prose(3000 + i, 60) + over[i : 380 + i] + prose(4000 + i, 60) for i in range(40)] + [texts[5], None, ""]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts), common_rows=common_rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, suffix_dedup.SIZE)


def test_repeated_rows_of_common_passages(spark):
    rows = frame(spark, [prose(20, 90)] * 6 + [prose(20, 60) + prose(i, 30) for i in range(6)])
    again = rows.unionByName(rows)
    want = brute_repeats([r.text for r in again.collect()], suffix_dedup.SIZE)
    got = suffix_dedup.remove_repeats(again, common_rows=2).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_repeats_of_odd_rows(spark):
    got = suffix_dedup.remove_repeats(odd(spark)).collect()
    want = brute_repeats([r.text for r in odd(spark).collect() if len(r.text or "") < 10_000], suffix_dedup.SIZE)
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.n_bytes < 10_000) == sorted(w[:2] for w in want)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def brute_shared_words(texts, n):
    words = [(t or "").split() for t in texts]
    holders = {}
    for i, w in enumerate(words):
        for at in range(len(w) - n + 1):
            holders.setdefault(tuple(w[at : at + n]), set()).add(i)
    out = []
    for w in words:
        hit = {k for at in range(len(w) - n + 1) if len(holders[tuple(w[at : at + n])]) > 1 for k in range(at, at + n)}
        out.append(len(hit))
    return out


def test_planted_passages_are_told_from_clean_documents(spark):
    """Passages of 51 words and some 300 bytes in pairs of documents: too short to remove, but counted; 50 words, or repeats within one document, aren't."""
    planted = [prose(100 + i, 30 + i) + " " + prose(200 + i // 2, 51) + " " + prose(300 + i, 40) for i in range(12)]
    clean = [prose(400 + i, 90) for i in range(8)] + [prose(500 + i, 30) + " " + prose(600, 50) + " " + prose(700 + i, 30) for i in range(2)] + [prose(800, 120) + " " + prose(801, 9) + " " + prose(800, 120)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, planted + clean)).collect()}
    assert all(got[i].n_removed == 0 and got[i].n_shared_words >= 51 for i in range(12))
    assert all(got[12 + i].n_shared_words == 0 for i in range(len(clean))) and got[22].n_removed > 0


def test_shared_words_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [prose(900 + i, 160) for i in range(4)]
    texts = []
    for i in range(60):
        cut = rng.choice(pool).split()
        at, n = rng.randrange(100), rng.randrange(45, 100)
        texts.append(" ".join([prose(1000 + i, rng.randrange(40)), *cut[at : at + n], prose(2000 + i, rng.randrange(40)), *cut[: rng.randrange(70)]]))
    texts += [texts[3], texts[3].replace(" ", "\n "), "a " * 300, "a " * 51 + "b", prose(1, 51), prose(1, 51) + " é" * 60, None, "", "x" * 900]
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_shared_words(texts, suffix_dedup.WORDS)
    assert {r.n_shared_words for r in suffix_dedup.remove_repeats(odd(spark)).collect()} == {0}  # a repeated row is no other document


def test_loser_tree_keeps_order_and_prefixes():
    rng = random.Random(0)
    for _ in range(100):
        runs = [sorted(bytes(rng.randrange(3) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 7))]
        got = list(suffix_dedup.merged([suffix_dedup.front_decoded(*suffix_dedup.front_code(r)) for r in runs]))
        assert [s for _, _, s in got] == sorted(s for r in runs for s in r)
        before = b""
        for _, n, s in got:
            assert n == suffix_dedup.common(before, s, 0)
            before = s


# 3

PRIVATE = "Write to a.b+c@mail.example.org or call +49 30 1234567; host 10.0.0.255, card 4111 1111 1111 1111, not 4111 1111 1111 1112 nor 1.2.3.400."


def slow_base(text):
    """The patterns as they are written."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if fine[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_patterns():
    assert pii.listed(pii.base_spans(PRIVATE)) == slow_base(PRIVATE)
    rng = random.Random(4)
    for _ in range(4000):
        s = "".join(rng.choice("a1.@-_ +4()") for _ in range(rng.randrange(40)))
        assert pii.listed(pii.base_spans(s)) == slow_base(s), s


def test_gradients():
    tagger = pii.Tagger.new(3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, pii.CLASSES, (2, 5)), np.array([[0, 1, 2, 0, 3], [5, 6, 0, 7, 8]])
    _, g = tagger.gradients(x, y)
    for name, value in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        old, loss = value[at], []
        for step in (1e-4, -1e-4):
            value[at] = old + step
            loss.append(tagger.gradients(x, y)[0])
        value[at] = old
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, abs=2e-3)


def test_tagger_learns_held_out_spans():
    rng = random.Random(6)

    def text(i):
        phone = f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(1000000, 9999999)}"
        return f"{prose(i, 12)} {phone} {prose(i + 1000, 8)} {rng.choice(WORDS)}{i}@{rng.choice(WORDS)}.org {prose(i + 2000, 9)} {rng.randrange(1900, 2030)}"

    texts = [text(i) for i in range(120)]
    tagger = pii.Tagger.new()
    losses = tagger.fit(*pii.training_windows(texts[:90], 300), steps=150)
    assert losses[-1] < losses[0] / 5
    x, y = pii.training_windows(texts[90:], 300)
    assert (tagger.decode(x) == y).mean() > 0.97


def test_private_of_odd_rows(spark):
    got = pii.find_private(odd(spark), None)
    assert got.count() == 7 and got.where("base_sha256 = sha2('', 256)").count() == 7
    assert pii.find_private(empty(spark), None).count() == 0
    assert pii.fit_tagger(empty(spark)) is None
    tagger = pii.fit_tagger(frame(spark, [PRIVATE] * 5), steps=30)
    r = pii.find_private(frame(spark, [PRIVATE]), tagger).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert set(slow_base(PRIVATE).split(",")) <= set(r.spans.split(","))
    assert r.base_sha256 == hashlib.sha256(slow_base(PRIVATE).encode()).hexdigest()
    assert pii.redact_private(frame(spark, [PRIVATE]), tagger).first().text.startswith("Write to <EMAIL> or call <PHONE>; host <IP>, card <CARD>, not")


# 4


def brute_edits(item, text):
    """The least edit distance of item to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(100 + i, 12)) for i in range(4)] + [(9, None), (None, "x" * 40), (10, "short"), (4, prose(100, 12))]
    texts = [None, "", prose(200, 40)]
    for edits in range(0, 14):
        s = list(items[edits % 4][1])
        for _ in range(edits):
            s[rng.randrange(len(s))] = rng.choice("qzj")
        texts.append(prose(300 + edits, 15) + "!! " + "".join(s).upper() + " - " + prose(400 + edits, 15))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (16_000_000, 100):  # one block, several blocks
        got = {r.doc_id: sorted((h.item_id, h.edits) for h in r.hits) for r in decontamination.find_contamination(frame(spark, texts), bench, block_chars=chars).collect()}
        for i, t in enumerate(texts):
            want = []
            for item_id, item in items:
                if item_id is not None and item and len(item) >= 10:
                    a, b = ("".join(map(chr, decontamination.normalise(x or "")[0])) for x in (item, t))
                    if (d := brute_edits(a, b)) <= int(0.08 * len(a)):
                        want.append((item_id, d))
            assert got[i] == sorted(want), t


def test_contamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string")
    assert sorted(len(r.hits) for r in decontamination.find_contamination(odd(spark), bench).collect()) == [0] * 5 + [1, 1]
    assert decontamination.find_contamination(empty(spark), bench).count() == 0
    assert decontamination.find_contamination(odd(spark), bench.limit(0)).where("size(hits) > 0").count() == 0


# 5


def test_language_held_out(spark):
    words = {"aa": ["kar", "lom", "tiv", "zun"], "bb": ["ösa", "lenü", "tir", "mäk"], "cc": ["qui", "ção", "nou", "lez"]}
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(words[k]) for _ in range(30)), k) for _ in range(80) for k in words]
    docs = frame(spark, [t for t, _ in rows], lang=[k for _, k in rows])
    model = language.fit_languages(docs.where("doc_id < 150"), n_landmarks=40)
    got = language.predict_languages(docs.where("doc_id >= 150"), model).select("lang", "lang_pred", F.col("score").cast("double").alias("score")).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    model = language.fit_languages(odd(spark))
    got = language.predict_languages(odd(spark), model).collect()
    assert len(got) == 7 and sorted(r.lang_pred for r in got if not r.text) == ["und", "und"]
    assert language.fit_languages(empty(spark)) is None
    assert language.predict_languages(odd(spark), None).where("lang_pred <> 'und'").count() == 0
    assert language.predict_languages(empty(spark), model).count() == 0


# 6

RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("block", "net", "/fr/")]


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("HTTP://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "example.com/en/", "block"), ("http://example.com/de", "example.com", "/de", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://a.net/fr", "a.net", "/fr", None, "allow"), ("x://y://a.net/fr/", "y:", "//a.net/fr/", None, "allow"),
    ("http://a.org/porn", "a.org", "/porn", None, "block"), ("http://a.org/pornography", "a.org", "/pornography", None, "allow"), ("http://a.org/win-win", "a.org", "/win-win", None, "allow"),
    ("http://a.org/win/bonus", "a.org", "/win/bonus", None, "block"), ("http://a.com?q=/en/", "a.com", "", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    page = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, host string, verdict string")
    r = urls.judge_urls(page, RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_no_urls(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


# 7


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(400):
        bad = rng.random() < 0.3
        words = [rng.choice(WORDS) for _ in range(20)]
        if bad:
            words[rng.randrange(20)] = rng.choice(["vile", "nasty"])
        rows.append((" ".join(words), int(bad)))
    docs = frame(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i < 200], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs.where("doc_id < 300"), labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()}
    right = sum(got[i].predicted == rows[i][1] for i in range(300, 400))
    assert right >= 95


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd(spark), labels)
    got = toxicity.score_toxicity(odd(spark).select("doc_id", "text"), model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.fit_toxicity(empty(spark), labels.limit(0)).weights == {}
    assert toxicity.score_toxicity(empty(spark).select("doc_id", "text"), model).count() == 0


def test_negative_risk_is_corrected():
    # unlabelled data are all positives: the plain risk would fall without bound
    x = np.ones((50, 1), np.float32)
    w, b = toxicity.fit_nnpu(x, x, 0.5, steps=200)
    assert abs(w[0] + b) < 5


# 8


def edited(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words = words or ["other"]
        k, i = rng.randrange(3), rng.randrange(len(words))
        words[i : i + 1] = [[], [words[i], "new"], ["other"]][k]
    return " ".join(words)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(25))]
        b = edited(" ".join(map(str, a)), rng.randrange(6), rng.random()).replace("new", "7").replace("other", "8").split() if a else []
        a, b = np.array(a, np.uint32), np.array([int(x) for x in b], np.uint32)
        d = lev(a.tolist(), b.tolist())
        for bound in (d, d + 2):
            assert near_dup.edit_distance(a, b, bound) == d
        assert d == 0 or near_dup.edit_distance(a, b, d - 1) is None
        assert near_dup.anchored_edits(a, b) >= d


def test_long_edit_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1000, 30_000).astype(np.uint32)
    b = np.delete(a, rng.permutation(30_000)[:40])
    assert near_dup.edit_distance(a, b, 6000) == 40


def test_classes_equal_brute_force(spark):
    texts = [prose(i, 80) for i in range(8)]
    texts += [edited(texts[i % 8], 1 + i % 4, i) for i in range(24)] + [texts[0].upper(), "  ".join(texts[1].split()), "tiny text", "tiny  TEXT", "another", None, None, "", " \n"]
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    words = [(t or "").lower().split() for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if words[i] and words[j] and lev(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])):
                root = [parent[i], parent[j]]
                parent = [min(root) if p in root else p for p in parent]
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(parent))
    assert all(r.class_size == parent.count(r.class_id) for r in got.values())


def sketched_classes(texts):
    """Classes by brute force over all pairs of texts that share a sketch."""
    words = [near_dup.word_hashes(t.lower()) for t in texts]
    sketches = [set(near_dup.order_sketches(w)) for w in words]  # a sketch tells its hash function
    short = [(w >> np.uint64(32)).astype(np.uint32).tobytes() for w in words]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if parent[i] != parent[j] and sketches[i] & sketches[j] and near_dup.alike([short[i]], [short[j]])[0]:
                root = [parent[i], parent[j]]
                parent = [min(root) if p in root else p for p in parent]
    return dict(enumerate(parent))


def substituted(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


def test_classes_of_texts_that_share_a_passage(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 64)  # several blocks
    passage = prose(1, 156)
    own = [" ".join(f"o{i}x{k}" for k in range(44)) for i in range(200)]
    texts = [f"{passage} {o}" for o in own] + [f"{passage} {substituted(o, 8, i)}" for i, o in enumerate(own)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert got == sketched_classes(texts)
    assert len(set(got.values())) == 200


def test_classes_of_a_star_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    middle = prose(2, 200)
    star = [middle] + [substituted(middle, 24, i) for i in range(100)]
    link = " ".join(f"c{i}" for i in range(100))
    chain = [link]
    for i in range(12):  # each step alters the next 12 words: neighbours are alike, others are not
        words = chain[-1].split()
        words[8 * i : 8 * i + 12] = [f"d{i}x{k}" for k in range(12)]
        chain.append(" ".join(words))
    texts = star + chain
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert got == sketched_classes(texts)
    assert sum(got[i] == got[0] for i in range(101)) > 85


def test_shared_words():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 30, n).astype(np.uint32) for n in (5, 17, 40, 61)]
    want = [[near_dup.common(a, b) for b in rows] for a in rows]
    labels = [near_dup.occurrence_labels(r.astype(np.uint64)) for r in rows]
    assert near_dup.shared_counts(labels, labels, 7).tolist() == near_dup.shared_counts(labels, labels).tolist() == want


def test_classes_of_odd_rows(spark):
    got = near_dup.near_duplicates(odd(spark)).collect()
    assert len(got) == 7 and sorted(r.class_size for r in got) == [1] * 5 + [2, 2]
    assert near_dup.near_duplicates(empty(spark)).count() == 0


# 9


def brute_neighbours(rows, k):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for q, x in fine:
        if q % 20 == 0:
            near = sorted((-float((x * v).sum()), i) for i, v in fine if i != q)[:k]
            out |= {(q, n + 1, i) for n, (_, i) in enumerate(near)}
    return out


def test_neighbours_equal_brute_force_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 340)]  # one common vector, also a query's
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [float("inf")] * 8), (None, [1.0] * 8)]
    data = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    got = neighbours.search(data, F.col("vec_id") % 20 == 0, k=20, part_rows=50, query_rows=7, recall=1.0).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == brute_neighbours(rows, 20)


def test_few_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    got = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, -1.0]), (3, [1.0])], schema), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 0.5), (2, 2, 0.5)]


# 10


def test_mix_meets_targets(spark):
    texts = [prose(i, 5 + i % 40) for i in range(200)] + [None, "", prose(1, 900)]
    source = ["a" if i < 100 else "b" if i < 190 else "c" for i in range(200)] + [None, "d", "c"]
    quality = spark.createDataFrame([(3, 2.0), (3, 5.0), (4, None), (5, -1.0), (None, 9.0)], "doc_id long, weight double")
    docs = frame(spark, texts, source=source)
    got = mixing.mix_sources(docs, quality).collect()
    assert len(got) == len(texts)
    by, size = {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.target), 0)
        by[r.source, r.target] += r.taken
        size[r.source] = r.source_size
    for (_, target), taken in by.items():
        assert taken == round(target)
    # water filling: weights 5, 2, 1, 5, 2 for a, b, c, d, null
    weight = dict(zip(("a", "b", "c", "d", None), (5, 2, 1, 5, 2), strict=True))
    left, free, want = float(sum(size.values())), set(weight), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * size[s]}
        if not full:
            break
        want |= {s: 3.0 * size[s] for s in full}
        left -= sum(want[s] for s in full)
        free -= full
    want |= {s: weight[s] * level for s in free}
    assert {s: t for s, t in by} == pytest.approx(want)
    again = mixing.mix_sources(docs.repartition(7), quality)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again.collect())


def test_quality_is_preferred(spark):
    docs = frame(spark, [prose(i, 10) for i in range(2000)], source=["a"] * 1500 + ["b"] * 500)
    quality = spark.createDataFrame([(i, 8.0) for i in range(0, 2000, 2)], "doc_id long, weight double")
    cut = [r for r in mixing.mix_sources(docs, quality, weights=(1, 1)).collect() if r.source == "a"]
    taken = [sum(r.taken for r in cut if r.doc_id % 2 == k) for k in (0, 1)]
    assert taken[0] > 1.5 * taken[1]


def test_mix_of_odd_rows(spark):
    got = mixing.mix_sources(odd(spark)).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(empty(spark)).count() == 0
