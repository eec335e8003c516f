"""Language identification by string kernels.

A text's features are the presence of its blended spectrum: character 1-, 2- and 3-grams of the lower-cased text, each run of non-letters read
as spaces. The kernel of two texts is the number of n-grams they share over the geometric mean of their numbers; n-grams are
told apart by a hash of BITS bits. Nyström landmarks stand for the training texts and one-versus-rest kernel ridge regression gives a
weight for each landmark and language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import label_sample, lean_batches

BITS = 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_letters: list[np.ndarray] = []


def has_letters(text: str) -> bool:
    """Whether any character is a letter; numerals like superscripts and fractions aren't."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def letter_table() -> np.ndarray:
    """Which code points of the first plane are letters. Those beyond it all count as letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _letters[0]


def presence(text: str, out: np.ndarray) -> None:
    """Sets out[g] for the hash g of every n-gram of the text."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[np.minimum(cp, 0xFFFF)] | (cp > 0xFFFF)
    cp = np.where(letter, cp, np.uint32(32))
    shift = np.uint32(32 - BITS)
    one = cp * np.uint32(0x9E3779B1)
    two = (cp[1:] + np.uint32(7)) * np.uint32(0x85EBCA77)
    three = (cp[2:] + np.uint32(13)) * np.uint32(0xC2B2AE3D)
    for h in (one, one[:-1] ^ two, (one[:-2] ^ two[:-1]) + three):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[h >> shift] = 1


def feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        packed = []
        for text in pdf["text"]:
            out = np.zeros(1 << BITS, np.uint8)
            presence(text, out)
            packed.append(np.packbits(out).tobytes())
        yield pd.DataFrame({"lang": pdf["lang"], "grams": packed})


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability-like scores, one row a text and one column a language, from presence rows."""
        f = kernel(x, self.landmarks) @ self.weights
        e = np.exp(6 * (f - f.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    size = lambda z: np.sqrt(np.maximum(z.sum(axis=1), 1))
    return (x @ y.T) / np.outer(size(x), size(y))


def fit(x: np.ndarray, y: list[str], n_landmarks: int, ridge: float) -> Model:
    languages = sorted(set(y))
    target = np.where(np.array(y)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    chosen: list[int] = []  # as many of each language as possible
    by = [[i for i, v in enumerate(y) if v == lang] for lang in languages]
    for k in range(max(map(len, by), default=0)):
        chosen += [v[k] for v in by if k < len(v)]
    marks = x[chosen[:n_landmarks]]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = kernel(x, marks) @ root
    # each language weighs the same, however many texts it has
    w = np.array([1 / y.count(v) for v in y])[:, None] * len(y) / len(languages)
    beta = np.linalg.solve(phi.T @ (w * phi) + ridge * len(y) * np.eye(phi.shape[1]) / 100, phi.T @ (w * target))
    return Model(languages, marks.astype(np.float32), (root @ beta).astype(np.float32))


def fit_languages(docs: DataFrame, *, per_language: int = 400, n_landmarks: int = 192, ridge: float = 1e-2) -> Model | None:
    """Learns from about per_language documents of each language: those of docs with text (with letters) and lang. None if there are none."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = label_sample(usable.select("doc_id", "text", "lang"), "lang", "doc_id", per_language)
    rows = sample.select("text", "lang").mapInPandas(feature_rows, "lang string, grams binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.grams)))
    order = np.random.default_rng(0).permutation(len(rows))
    x = np.unpackbits(np.frombuffer(b"".join(rows[i].grams for i in order), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    return fit(x, [rows[i].lang for i in order], n_landmarks, ridge)


def predict_languages(docs: DataFrame, model: Model | None, *, block: int = 128) -> DataFrame:
    """docs with lang_pred and score (0 to 1), from whole texts.

    A null text, one without letters and any text when there is no model get `und` and score 0. Equal texts get equal results, whatever
    else their rows hold; texts of any length are read whole; ties go to the first language by name. An empty table gives an empty result; columns of the names added are replaced.
    """
    lean_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            name, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None and model and has_letters(t)]
            for k in range(0, len(at), block):
                part = at[k : k + block]
                x = np.zeros((len(part), 1 << BITS), np.float32)
                for row, i in zip(x, part, strict=True):
                    presence(texts.iat[i], row)
                p = model.predict(x)
                best = p.argmax(axis=1)
                name[part] = np.array(model.languages, object)[best]
                score[part] = p[np.arange(len(part)), best]
            yield pd.DataFrame({"lang_pred": name, "score": np.round(score, 6)})

    return docs.withColumn("_p", predict(F.col("text"))).withColumn("lang_pred", F.col("_p.lang_pred")).withColumn("score", F.col("_p.score").cast("double")).drop("_p")
