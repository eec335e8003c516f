import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyforge.llm import alignment

from test_operators import empty, frame, odd, prose


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as their files define them, with each token's bytes."""
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    vocab = {i: t for t, i in json.load(open(f"{alignment.FOLDER}/{alignment.A_FILE}"))["model"]["vocab"].items()}
    back = alignment.byte_of()

    def spelt(text):
        left = [(i, bytes(back[c] for c in vocab[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return left, right

    return spelt


def brute(texts, plain):
    """The contract's columns by byte offsets, pair by pair."""
    found, links, most = [], [], Counter()
    for text in texts:
        left, right = plain(text) if text else ([], [])
        raw = f" {text}".encode()
        if not text or b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            found.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side if low < e <= cut) for side in ends))
            low = cut
        own = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f]
        links.append(own)
        found.append((len(left), len(right), len(cuts), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for own in links for x in own)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(*f[:4], sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), f[4]) for f, own in zip(found, links, strict=True)]


def texts():
    rng = random.Random(13)
    pools = ["abc", "éüñ", "漢字", "\U0001f600\U00010400", " \t\n\r 　", "\u0000́▁﻿", "0123.,!?'"]
    some = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return [prose(i, 80) for i in range(20)] + some + [None, "", " ", "  x", "<|endoftext|> <s> <unk> </s>", "<0x41> ▁", prose(1, 80), prose(1, 80), "a" * 300, " " * 300]


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 0])
def test_columns_equal_brute_force(spark, plain, monkeypatch, most):
    """Counts sent to the workers, and joined."""
    monkeypatch.setattr(alignment, "GATHERED", 50)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r.doc_id: tuple(r[c] for c in names) for r in alignment.align_corpus(frame(spark, texts()), broadcast_pairs=most).collect()}
    for i, want in enumerate(brute(texts(), plain)):
        assert got[i] == want, repr(texts()[i])


def test_groups_are_the_operators_own_output(spark, plain):
    for r in alignment.align_tokens(frame(spark, texts()[15:60])).collect():
        left, right = plain(r.text)
        if r.a_ids:
            assert r.a_ids == [i for i, _ in left] and r.b_ids == [i for i, _ in right]
            cut = lambda side, cuts: [b"".join(x for _, x in side[a:b]) for a, b in zip([0, *cuts], cuts)]
            assert cut(left, r.a_cuts) == cut(right, r.b_cuts)
    assert alignment.align_tokens(frame(spark, ["", None, "▁"])).where("size(a_ids) + size(b_ids) + size(a_cuts) + size(b_cuts) > 0").count() == 0


def test_stabs_list_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)), [n]])) if n > 1 else np.array([1]) for _ in range(2))
        x = alignment.align(np.arange(len(a)), np.arange(len(b)), a, b)
        span = lambda v, i: (v[:i].sum(), v[: i + 1].sum())
        for i in range(len(a)):
            want = [j for j in range(len(b)) if span(a, i)[0] < span(b, j)[1] and span(b, j)[0] < span(a, i)[1]]
            assert (x.first[i], x.last[i]) == (want[0], want[-1])
        assert [a[:c].sum() for c in x.a_cuts] == [b[:c].sum() for c in x.b_cuts] == sorted(set(np.cumsum(a)) & set(np.cumsum(b)))


def test_both_engines_make_the_same_tokens():
    one, _ = alignment.tokenizers(alignment.FOLDER)
    assert one.fast
    for code in [*range(0, 0xD800, 7), *range(0xE000, 0x11000), *range(0x11000, 0x110000, 97)]:
        t = f" a{chr(code)}1{chr(code)}! {chr(code)} "
        assert one.fast.encode_ordinary(t) == one.own.encode(t, add_special_tokens=False).ids


def test_alignment_of_odd_rows(spark):
    rows = alignment.align_corpus(odd(spark)).collect()
    assert len(rows) == 7 and sum(r.n_a == 0 for r in rows) >= 2 and all((r.groups_sha256 == "") == (r.n_a == 0) for r in rows)
    assert alignment.align_corpus(empty(spark)).count() == 0
    (r,) = alignment.align_corpus(frame(spark, [prose(1, 60_000)])).collect()
    assert r.n_groups == r.n_links > 10_000
