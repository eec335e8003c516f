import itertools
import random

import numpy as np
import pytest

from tallyforge.llm import pii

from test_operators import WORDS, frame, odd, prose


def luhned(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def private(i):
    """A text with labelled spans of every kind."""
    rng = random.Random(i)
    parts = [
        f"{rng.choice(WORDS)}{i}@{rng.choice(WORDS)}.example.com",
        ".".join(str(rng.randrange(256)) for _ in range(4)),
        luhned(rng),
        f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}",
        'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
    ]
    return " ".join(f"{prose(1000 * i + j, 12)} {p}" for j, p in enumerate(parts)) + f" {prose(i, 9)} {rng.randrange(1900, 2030)}"


@pytest.fixture(scope="module")
def tagger():
    model = pii.Tagger.new()
    model.fit(*pii.training_windows([private(i) for i in range(300)], 600), steps=400)
    return model


def test_network_adds_spans_that_no_pattern_finds(tagger):
    """Held-out texts whose spans are written otherwise, and secrets: found exactly, and little else."""
    wanted, found, right = 0, 0, 0
    for i in range(400, 480):
        text, spans = pii.altered(private(i), pii.labelled_spans(private(i)), i)
        base = pii.base_spans(text)
        more = set(pii.added_spans([text], [base], tagger)[0])
        left = {s for s in spans if s not in base}
        wanted, found, right = wanted + len(left), found + len(more), right + len(left & more)
    assert wanted > 150 and right / wanted > 0.85 and right / found > 0.85


def test_prose_has_no_spans(tagger):
    texts = [f"{prose(i, 40)} {i} {prose(i + 1, 30)} in {1900 + i} {prose(i + 2, 10)}" for i in range(50)]
    assert pii.added_spans(texts, [[] for _ in texts], tagger) == [[] for _ in texts]


class Marker:
    """Tags each letter run that holds a digit as one email span, as far as the window shows it."""

    def decode(self, x):
        out = np.zeros(x.shape, np.int8)
        inside = ~np.isin(x, (pii.BLANK, pii.LINE, 0))
        out[inside] = 2
        out[inside & ~np.concatenate([np.zeros((len(x), 1), bool), inside[:, :-1]], axis=1)] = 1
        return out


@pytest.mark.parametrize("size", [40, 60, 90])
def test_windows_are_reconciled(size):
    """A span that windows cut is put together again, wherever it stands."""
    half = size // 2
    address = "a" * (half - 8) + "1(@)2" + "b" * (size - half - 1) + ".org"
    for offset in range(0, 2 * pii.WINDOW, 7):
        text = " " * offset + address + " " * 150
        assert pii.added_spans([text], [[]], Marker()) == [[(0, offset, offset + len(address))]]


def test_parts_are_joined_within_a_kind_only():
    assert pii.joined({(0, 1, 5), (0, 4, 9), (1, 8, 12), (0, 11, 12)}) == {(0, 1, 5), (0, 4, 9), (1, 8, 12), (0, 11, 12), (0, 1, 9)}
    assert pii.joined({(0, 1, 5), (0, 5, 9), (0, 9, 11)}) >= {(0, 1, 11)}


def test_decoding_equals_brute_force():
    tagger = pii.Tagger.new(3)
    rng = np.random.default_rng(5)
    tagger.p["trans"] = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    x = rng.integers(1, pii.CLASSES, (3, 4))
    e, trans = tagger.emissions(x), tagger.transitions()
    for row in range(len(x)):
        def score(path):
            first = 0 if pii.ALLOWED[0][path[0]] else -1e4
            return tagger.p["start"][path[0]] + first + sum(e[t, row, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(pii.TAGS), repeat=x.shape[1]), key=score)
        assert tuple(tagger.decode(x)[row]) == best


def test_long_runs_of_digits():
    zeros = "0" * 5000
    assert pii.base_spans(f"1.{zeros}.2.3") == [(1, 0, 5006)]
    assert pii.base_spans(f"1.{zeros}9999.2.3") == []
    assert pii.base_spans("9" * 20_000) == []
    assert not pii.plausible(1, f"1,{'9' * 6000},2,3", 0, 6006)


def test_fitting_is_repeatable_and_bounded(spark):
    texts = [private(i) for i in range(40)] + [private(0)] * 20
    docs = frame(spark, texts).selectExpr("doc_id % 7 as doc_id", "text")
    first, again = (pii.fit_tagger(docs.repartition(n), sample=16, windows=50, steps=3) for n in (1, 5))
    assert all(np.array_equal(first.p[k], again.p[k]) for k in first.p)


def test_redaction_equals_finding(spark, tagger):
    docs = frame(spark, [private(i) for i in range(5)] + [None, "", "no digits"])
    spans = {r.doc_id: r for r in pii.find_private(docs, tagger).collect()}
    for r in pii.redact_private(docs, tagger).collect():
        found = sorted((f["start"], f["end"], pii.KINDS.index(f["kind"])) for f in spans[r.doc_id].found)
        assert r.n_spans == len(found) == spans[r.doc_id].n_spans
        assert r.text == pii.redacted(spans[r.doc_id].text, [(k, a, b) for a, b, k in found])
    assert spans[0].n_spans >= 5 and "secret" in spans[0].spans
    assert pii.redact_private(odd(spark), tagger).count() == 7
