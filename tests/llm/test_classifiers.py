"""Language and toxicity: results against plain versions of the same models."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import language, toxicity

from test_operators import frame, prose

WORDS = {"aa": ["kar", "lom", "tiv", "zun"], "bb": ["ösa", "lenü", "tir", "mäk"], "cc": ["qui", "ção", "nou", "lez"]}


def written(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def grams(text):
    """Hashes of all 1- to 3-grams, one character and one n-gram at a time."""
    low = [ord(c) if (ord(c) > 0xFFFF or c.isalpha()) else 32 for c in text.lower()]
    cut = 1 << 32
    mixed = lambda h: (((h ^ (h >> 15)) * 0x2C1B3C6D) % cut) >> (32 - language.BITS)
    out = set()
    for i in range(len(low)):
        one = low[i] * 0x9E3779B1 % cut
        out.add(mixed(one))
        if i + 1 < len(low):
            two = one ^ ((low[i + 1] + 7) * 0x85EBCA77 % cut)
            out.add(mixed(two))
            if i + 2 < len(low):
                out.add(mixed((two + (low[i + 2] + 13) * 0xC2B2AE3D) % cut))
    return out


def test_language_equals_a_plain_kernel_machine(spark):
    """Every score from set intersections with the landmarks and a plain sum."""
    rows = [(written(lang, 100 * k + i, 4 + i % 9), lang) for k, lang in enumerate(WORDS) for i in range(25)]
    model = language.fit_languages(frame(spark, [t for t, _ in rows], lang=[x for _, x in rows]), n_landmarks=20)
    marks = [set(np.flatnonzero(m).tolist()) for m in model.landmarks]
    texts = [written(lang, 999 + i, n) for i, (lang, n) in enumerate([("aa", 1), ("bb", 3), ("cc", 40), ("aa", 2000)])] + ["kar ösa nou", "\U00010400x", "", None, "12", "kar ösa nou"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_languages(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        own = grams(t)
        k = [len(own & m) / math.sqrt(len(own) * max(len(m), 1)) for m in marks]
        f = [sum(x * float(w) for x, w in zip(k, model.weights[:, j], strict=True)) for j in range(len(model.languages))]
        e = [math.exp(6 * (x - max(f))) for x in f]
        assert got[i] == (model.languages[f.index(max(f))], pytest.approx(max(e) / sum(e), abs=1e-4))


def test_ridge_solution_is_the_least(spark):
    """The weights minimise the weighted squared error with the ridge: any other weights in the landmarks' space do worse."""
    rng = np.random.default_rng(4)
    x = (rng.random((40, 60)) < 0.3).astype(np.float32)
    y = ["a" if r[:20].sum() > r[20:40].sum() else "b" for r in x]
    model = language.fit(x, y, 12, 0.01)
    marks = model.landmarks
    value, vector = np.linalg.eigh(language.kernel(marks, marks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi, beta = language.kernel(x, marks) @ root, np.linalg.lstsq(root, model.weights.astype(float), rcond=None)[0]
    weight = np.array([40 / 2 / y.count(v) for v in y])
    target = np.where(np.array(y)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    loss = lambda b: float((weight[:, None] * (phi @ b - target) ** 2).sum() + 0.01 * 40 / 100 * (b**2).sum())
    assert all(loss(beta) <= loss(beta + rng.normal(0, s, beta.shape)) + 1e-4 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(20))


def test_toxicity_scores_equal_a_plain_sum(spark):
    texts = [prose(i, 30) + (" vile nasty" if i % 4 == 0 else "") for i in range(200)] + ["", None, "VILE", "vile " * 5000]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 2)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    model = toxicity.fit_toxicity(docs, labels)
    assert "vile" in model.weights
    for r in toxicity.score_toxicity(docs, model).collect():
        z = model.bias + sum(model.weights.get(w, 0.0) for w in Counter(toxicity.WORDS.findall((r.text or "").lower())))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6) and r.predicted == int(r.score >= 0.3)
    assert re.match(toxicity.WORDS, "vile")


def test_the_non_negative_risk_is_near_its_least():
    """No weights drawn around the solution have a risk that is clearly lower."""
    rng = np.random.default_rng(5)
    pos, unl = (rng.random((60, 6)) < [0.8, 0.7, 0.3, 0.3, 0.5, 0.1]) * 1.0, (rng.random((300, 6)) < [0.3, 0.3, 0.4, 0.3, 0.5, 0.2]) * 1.0

    def risk(w, b):
        loss = lambda z: np.logaddexp(0, -z).mean()
        return 0.2 * loss(pos @ w + b) + max(0.0, loss(-(unl @ w + b)) - 0.2 * loss(-(pos @ w + b))) + 0.5e-4 * (w**2).sum()

    w, b = toxicity.fit_nnpu(pos, unl, 0.2, steps=2000)
    assert all(risk(w, b) <= risk(w + rng.normal(0, s, 6), b + rng.normal(0, s)) + 0.003 for s in (0.01, 0.1, 0.5, 1) for _ in range(50))
