import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import ngram_model

from test_operators import empty, frame, odd, prose


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    """Counts, base scores and exact scores of (doc_id, text)."""
    docs = [(i, words(t), i is not None and zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    one = Counter(w for _, ws, train in docs if train for w in ws)
    two = Counter(p for _, ws, train in docs if train for p in zip([None, *ws], ws))
    kinds = Counter(c for c, _ in two)
    n, v = sum(one.values()), len(one)
    base = lambda w: math.log10((one[w] + 1) / (n + v + 1))

    def score(c, w):
        if two[c, w]:
            return math.log10((two[c, w] - 0.75) / one[c])
        return base(w) + (math.log10(0.75 * kinds[c] / one[c]) if one[c] else 0)

    return [(i, len(ws), sum(one[w] > 0 for w in ws), n, sum(map(base, ws)), sum(map(score, [None, *ws], ws))) for i, ws, _ in docs]


def check(spark, texts, **options):
    ids = [*range(len(texts) - 2), None, 3]  # one doc_id is null, one comes twice
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_model.score_texts(rows.repartition(3), **options).collect()]
    want = brute(list(zip(ids, texts, strict=True)))
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-6)
        assert abs(g[5] - w[5]) <= w[1] * 0.51 * 2 / ngram_model.STEPS + 1e-6
    return got


def corpus():
    rng = random.Random(11)
    odd_ones = ["", None, "  \t\n", "A a Á á", "x y z", "\U00010400 b", "one", "one", "q" * 5000]
    return [prose(i % 40, rng.randrange(1, 120)).title() for i in range(120)] + odd_ones + [prose(3, 4000), prose(1, 5), "the end"]


@pytest.mark.parametrize("shard_bytes", [10**9, 2_000, 300])
def test_scores_equal_brute_force(spark, shard_bytes):
    """One shard, several and many; with many, common words and pairs are counted beforehand."""
    check(spark, corpus(), shard_bytes=shard_bytes)


def test_common_words_pairs_and_lines(spark, monkeypatch):
    """A third of all tokens is one word, another third one line; tokens are gathered and lists cut in small steps."""
    monkeypatch.setattr(ngram_model, "GATHERED", 300)
    monkeypatch.setattr(ngram_model, "LISTED", 3)
    monkeypatch.setattr(ngram_model, "HASHED", 64)
    texts = [prose(i, 10) + " hot" * 10 + " a common line of words that all of them hold" for i in range(80)] + ["hot line", "unseen things only"]
    check(spark, texts, shard_bytes=1_500)


def test_reruns_agree(spark):
    rows = frame(spark, corpus())
    score = lambda n: sorted((r.doc_id, r.score) for r in ngram_model.score_texts(rows.repartition(n), shard_bytes=3_000).collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(score(2), score(5), strict=True))


def test_the_model_beats_the_base_on_what_it_has_seen(spark):
    """Copies of training texts are likelier than their words alone say, held out or not."""
    rows = ngram_model.score_texts(frame(spark, [prose(i % 10, 200) for i in range(70)])).collect()
    assert sum(r.held_out for r in rows) > 3 and all(r.score > r.base_score + 50 for r in rows)


def test_scores_of_odd_rows(spark):
    assert ngram_model.score_texts(odd(spark)).count() == 7
    assert ngram_model.score_texts(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = ngram_model.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("universe", [1, 5, 1000, 10**6, 1 << 40])
def test_elias_fano(universe):
    rng = np.random.default_rng(universe)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        ef = ngram_model.EliasFano(values, universe)
        assert np.array_equal(ef[np.arange(n)], values)
        wanted = rng.integers(0, universe + 1, 300).astype(np.uint64)
        start = rng.integers(0, n + 1, 300)
        end = np.minimum(start + rng.integers(0, n + 1, 300), n)
        want = [s + int(np.searchsorted(values[s:e], w)) for w, s, e in zip(wanted, start, end, strict=True)]
        assert ef.successor(wanted, start, end).tolist() == want


def test_trie_is_compact():
    """Followers take some bits each, not words."""
    rng = np.random.default_rng(1)
    place = np.sort(rng.integers(0, 2000, 50_000))
    follower = rng.integers(0, 20_000, 50_000).astype(np.uint64)
    pairs = np.unique(np.stack([place.astype(np.uint64), follower]), axis=1)
    place, follower = pairs[0].astype(np.int64), pairs[1]
    totals = np.bincount(place, minlength=2000)
    trie = ngram_model.Trie(np.arange(2000, dtype=np.uint64), totals, totals, place, follower, np.ones(len(place), np.int64))
    ef = trie.followers
    assert (ef.low.nbytes + ef.high.nbytes + ef.ones.nbytes) * 8 / len(place) < 14
    steps, found = trie.query(place.astype(np.uint64), follower)
    assert found.all() and np.allclose(steps / ngram_model.STEPS, -np.log10(0.25 / totals[place]), atol=1e-3)
