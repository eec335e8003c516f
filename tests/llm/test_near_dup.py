"""Recall of Order MinHash candidates at and above the similarity of a link, and the bounds that spare alignments."""

import random

import numpy as np
import pytest

from tallyforge.llm import near_dup

from test_operators import frame, lev, substituted


def fresh(rng, n):
    return " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))


def scattered(text, edits, rng):
    """edits words replaced, dropped or put in, at different places."""
    words = text.split()
    for i in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            words[i] = f"e{rng.randrange(10**9)}"
        elif kind == 1:
            del words[i]
        else:
            words.insert(i, f"e{rng.randrange(10**9)}")
    return " ".join(words)


def recall(n, share, times=300):
    rng, hit = random.Random(n), 0
    for _ in range(times):
        a = fresh(rng, n)
        b = scattered(a, int(share * n), rng)
        x, y = (near_dup.order_sketches(near_dup.word_hashes(t)) for t in (a, b))
        hit += bool(set(x) & set(y))
    return hit / times


@pytest.mark.parametrize("n", [50, 100, 300])
@pytest.mark.parametrize("share, least", [(0.05, 0.999), (0.1, 0.99), (0.15, 0.96), (0.18, 0.92), (0.2, 0.85)])
def test_recall_of_scattered_edits(n, share, least):
    assert recall(n, share) >= least


@pytest.mark.parametrize("n", [5, 6, 8, 9, 10, 14, 20, 50, 100, 120, 121, 149])
def test_recall_of_short_texts(n):
    """As many edits as a link allows."""
    assert recall(n, 0.2) >= 0.97


@pytest.mark.parametrize("n", [151, 160, 200, 300])
def test_recall_of_long_texts(n):
    assert recall(n, 0.2) >= 0.9


@pytest.mark.parametrize("n", [4, 5, 119, 120, 121, 149, 150, 151])
def test_texts_that_differ_in_length_share_a_kind_of_sketch(n):
    rng = random.Random(n)
    a = fresh(rng, n)
    for longer in range(n + 1, n + n // 4 + 1):
        x, y = (set(near_dup.order_sketches(near_dup.word_hashes(t))) for t in (a, a + " " + fresh(rng, longer - n)))
        assert x & y, longer


def test_classes_of_short_texts_equal_all_pairs(spark):
    """Originals of 3 to 160 words with up to a fifth of their words edited and one edit too many, over few different words: all pairs by plain edit distances."""
    rng, texts = random.Random(11), []
    for n in (3, 4, 5, 6, 8, 9, 10, 14, 19, 20, 33, 60, 118, 122, 148, 152, 160):
        base = " ".join(f"w{rng.randrange(60)}" for _ in range(n))
        edits = [0, 1, max(1, n // 10), n // 6, n // 5 + 1]
        texts += [base] + [scattered(base, e, rng) for e in edits]
    words = [t.split() for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if parent[i] != parent[j] and words[i] and words[j] and 5 * abs(len(words[i]) - len(words[j])) <= longer and 5 * lev(words[i], words[j]) <= longer:
                both = {parent[i], parent[j]}
                parent = [min(both) if p in both else p for p in parent]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert got == dict(enumerate(parent))
    assert len(set(parent)) < len(texts) - 40


def test_appended_and_shared_shingles():
    """A fifth put at the end leaves a shingle similarity of 0.8: found practically always."""
    rng = random.Random(3)
    for _ in range(200):
        a = fresh(rng, 160)
        x, y = (set(near_dup.order_sketches(near_dup.word_hashes(t))) for t in (a, a + " " + fresh(rng, 40)))
        assert x & y


def test_bounds_never_lose_a_link():
    rng = random.Random(5)
    for i in range(300):
        words = [str(rng.randrange(6)) for _ in range(rng.randrange(5, 40))]
        other = scattered(" ".join(words), min(len(words), rng.randrange(9)), rng).split()
        a, b = (np.array([int(w) if w.isdigit() else 100 + hash(w) % 1000 for w in side], np.uint32) for side in (words, other))
        bound = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert near_dup.linked(a, b, bound) == (lev(a.tolist(), b.tolist()) <= bound), i


def test_each_pair_is_judged_in_one_group():
    texts = [fresh(random.Random(1), 60)]
    texts += [substituted(texts[0], 3, i) for i in range(4)]
    words = [near_dup.word_hashes(t) for t in texts]
    sketches = np.array([near_dup.order_sketches(w) for w in words])
    short = [(w >> np.uint64(32)).astype(np.uint32) for w in words]
    for i in range(5):
        for j in range(i):
            one, other = (([bytes([k])], [short[k]], sketches[k : k + 1]) for k in (i, j))
            assert sum(len(near_dup.block_links(s, one, other, False)) for s in set(sketches.ravel())) == 1


@pytest.mark.parametrize("n, kinds", [(5, 3), (40, 4), (158, 2), (165, 1000), (400, 50), (700, 1000)])
def test_alignments_of_many_pairs_at_once(n, kinds):
    """Pairs around the bound, whose bits fill one 64-bit word or several, against the alignment of one pair."""
    rng = random.Random(n * kinds)
    left, right = [], []
    while len(left) < 60:
        a = [rng.randrange(kinds) for _ in range(rng.randint(max(1, n - n // 10), n))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) * 3 // 10))):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randrange(kinds)] * rng.randint(0, 2)
            b = b or [0]
        if abs(len(a) - len(b)) <= int(0.2 * max(len(a), len(b))):
            left.append(np.array(a, np.uint32)), right.append(np.array(b, np.uint32))
    bounds = np.array([int(0.2 * max(len(a), len(b))) for a, b in zip(left, right, strict=True)])
    want = [bool(lev(a.tolist(), b.tolist()) <= k) for a, b, k in zip(left, right, bounds, strict=True)]
    assert near_dup.within(left, right, bounds).tolist() == want
    assert near_dup.within(left[::-1], right[::-1], bounds[::-1]).tolist() == want[::-1]
    assert [near_dup.linked(a, b, int(k)) for a, b, k in zip(left, right, bounds, strict=True)] == want
    assert near_dup.within(left[:1], right[:1], bounds[:1]).tolist() == want[:1]
