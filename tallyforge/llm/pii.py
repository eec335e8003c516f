"""Personal data: fixed patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The network is written and trained in numpy. Its labelled spans are those that the patterns find in a bounded sample of documents, secrets (values that
follow a word like token or password there), and altered copies of both: a phone number without its plus sign, other separators, spaces around an at
sign, other words and quotes before a secret. It so adds what the patterns don't admit, and secrets, which have no pattern in the result. Texts are cut into
overlapping windows. Each kind's spans hold a digit or an at sign, and a decoded span without one is dropped, so windows without either need no decoding.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches

KINDS = ("email", "ip", "card", "phone", "secret")
#: The first BASE kinds have patterns; the network alone finds the others.
BASE = 4
SECRET = 4
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit run is entered in its middle: what follows it is the same from any of its digits
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
CUE = re.compile("[0-9@]")
#: Labels secrets in the training sample; results come from the network.
LABELLED = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9+/_-]{12,80})(?![A-Za-z0-9])""")
WINDOW, STRIDE = 96, 48
#: Shorter spans aren't added.
LEAST = 7
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's leftmost matches, found from the at signs outwards so that long runs of letters cost no more than their length."""
    out, done, low, at = [], 0, 0, text.find("@")
    while at >= 0:
        part = text[max(done, low) : at]
        start = at - len(part) + len(part.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        low, at = at + 1, text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by kind and start."""
    if not text:
        return []
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
        for kind, pattern, low, high in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                    out.append((kind, *m.span()))
    return out


def labelled_spans(text: str) -> list[Span]:
    """The base spans and labelled secrets outside them."""
    base = base_spans(text)
    secrets = [(SECRET, *m.span(1)) for m in LABELLED.finditer(text) if mixed(m[1])]
    return base + [s for s in secrets if not any(a < s[2] and s[1] < b for _, a, b in base)]


def mixed(value: str) -> bool:
    """Whether a value looks drawn: letters and at least three digits."""
    return sum(c.isdigit() for c in value) >= 3 and any(c.isalpha() for c in value)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


#: Classes of characters: the special ones by themselves, then other, digit, lower, upper, space, newline; 0 is padding.
SPECIAL = "@.-+()_%:/,"
OTHER, NUMBER, SMALL, LARGE, BLANK, LINE = range(len(SPECIAL) + 1, len(SPECIAL) + 7)
CLASSES = LINE + 1
_classes: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _classes:
        table = np.full(1 << 16, OTHER, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            table[i] = SMALL if c.islower() else LARGE if c.isalpha() else NUMBER if "0" <= c <= "9" else LINE if c in "\r\n" else BLANK if c.isspace() else OTHER
        for i, c in enumerate(SPECIAL):
            table[ord(c)] = i + 1
        _classes.append(table)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes[0][np.minimum(cp, 0xFFFF)]


TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
ALLOWED = np.array([[not (b and b % 2 == 0) or a in (b - 1, b) for b in range(TAGS)] for a in range(TAGS)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    @staticmethod
    def new(hidden: int = 16) -> Tagger:
        rng = np.random.default_rng(0)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        p = {"out": draw(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for side in "fb":
            p |= {f"x{side}": draw(CLASSES, 4 * hidden), f"h{side}": draw(hidden, 4 * hidden), f"c{side}": np.zeros(4 * hidden, np.float32)}
            p[f"c{side}"][hidden : 2 * hidden] = 1
        return Tagger(p)

    def lstm(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, unit) in text order. Gates: input, forget, output, candidate."""
        wx, wh, c0 = self.p[f"x{side}"], self.p[f"h{side}"], self.p[f"c{side}"]
        n = wh.shape[0]
        times = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        h, c = np.zeros((len(x), n), np.float32), np.zeros((len(x), n), np.float32)
        out = np.empty((x.shape[1], len(x), n), np.float32)
        for t in times:
            z = wx[x[:, t]] + h @ wh + c0
            gate, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, c_before = h, c
            c = gate[:, n : 2 * n] * c + gate[:, :n] * g
            tanh_c = np.tanh(c)
            h = gate[:, 2 * n :] * tanh_c
            out[t] = h
            if keep is not None:
                keep.append((t, gate, g, before, c_before, tanh_c))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        steps = {s: [] if keep is not None else None for s in "fb"}
        h = np.concatenate([self.lstm(x, s, steps[s]) for s in "fb"], axis=2)
        if keep is not None:
            keep |= {"h": h, "steps": steps}
        return h @ self.p["out"] + self.p["bias"]

    def transitions(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["trans"], -1e4)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of tag sequences y, and its gradients: forward-backward for the CRF, then back through time."""
        keep: dict = {}
        e, trans, (rows, length) = self.emissions(x, keep), self.transitions(), x.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = self.p["start"] + np.where(ALLOWED[0], 0, -1e4) + e[0]
        for t in range(1, length):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = log_sum(alpha[-1], 1)
        marginal = np.exp(alpha + beta - z[:, None])
        one = np.eye(TAGS, dtype=np.float32)[y.T]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        score = (self.p["start"] * one[0]).sum(1) + (e * one).sum((0, 2))
        for t in range(1, length):
            both = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            real = one[t - 1][:, :, None] * one[t][:, None, :]
            g["trans"] += (both - real).sum(0) * ALLOWED
            score = score + (real * trans).sum((1, 2))
        de = ((marginal - one) / rows).astype(np.float32)
        g["trans"] /= rows
        g["start"] = de[0].sum(0)
        g["bias"] = de.sum((0, 1))
        h, n = keep["h"], self.p["hf"].shape[0]
        g["out"] = np.einsum("trh,trk->hk", h, de)
        dh_all = de @ self.p["out"].T
        for s, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            wh = self.p[f"h{s}"]
            dh_next, dc_next = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            for t, gate, cand, before, c_before, tanh_c in reversed(keep["steps"][s]):
                i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
                dh = dh_all[t][:, part] + dh_next
                dc = dc_next + dh * o * (1 - tanh_c**2)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * c_before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - cand**2)], axis=1)
                np.add.at(g[f"x{s}"], x[:, t], dz)
                g[f"h{s}"] += before.T @ dz
                g[f"c{s}"] += dz.sum(0)
                dh_next, dc_next = dz @ wh.T, dc * f
        return float((z - score).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, *, steps: int, batch: int = 48, rate: float = 0.04) -> list[float]:
        rng = np.random.default_rng(1)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for t in range(1, steps + 1):
            at = rng.permutation(len(x))[:batch]
            loss, g = self.gradients(x[at], y[at])
            losses.append(loss)
            for k, d in g.items():
                d = np.clip(d, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                self.p[k] = (self.p[k] - rate * (1 - t / (1.2 * steps)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags of each row (Viterbi)."""
        e, trans = self.emissions(x), self.transitions().astype(np.float32)
        best = self.p["start"] + np.where(ALLOWED[0], 0, -1e4).astype(np.float32) + e[0]
        back = np.empty((x.shape[1], len(x), TAGS), np.int8)
        for t in range(1, x.shape[1]):
            step = best[:, :, None] + trans
            back[t] = step.argmax(1)
            best = step.max(1) + e[t]
        tags = np.empty(x.shape, np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(x.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(len(x)), tags[:, t]]
        return tags


def window_starts(code: np.ndarray) -> list[int]:
    """Starts of the windows that hold a digit or an at sign. Each character but those at the text's ends is in two windows."""
    cue = np.flatnonzero((code == NUMBER) | (code == 1))
    block = np.unique(cue // STRIDE)
    return np.unique(np.concatenate([block, block - 1])).clip(-1).astype(int).tolist() if len(block) else []


def cut(code: np.ndarray, block: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.uint8)
    start = block * STRIDE
    part = code[max(start, 0) : start + WINDOW]
    out[max(-start, 0) : max(-start, 0) + len(part)] = part
    return out


def tagged(tags: np.ndarray) -> list[Span]:
    """Spans of one window's tags."""
    out, t = [], 0
    while t < len(tags):
        if tags[t] % 2 == 1:
            kind, start = (int(tags[t]) - 1) // 2, t
            t += 1
            while t < len(tags) and tags[t] == 2 * kind + 2:
                t += 1
            out.append((kind, start, t))
        else:
            t += 1
    return out


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a decoded span stands by itself and holds what its kind's spans hold: the checks of the patterns, for any separators."""
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    body = text[start:end]
    parts = re.findall("[0-9]+", body)
    digits = "".join(parts)
    if kind == 0:
        return "@" in body and "." in body.partition("@")[2]
    if kind == 1:
        return len(parts) == 4 and all(octet(p) for p in parts)
    if kind == SECRET:
        return len(body) >= 12 and mixed(body) and not re.search(r"[^A-Za-z0-9+/_-]", body)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def joined(spans: set[Span]) -> set[Span]:
    """Spans of one kind that overlap or touch, as they come from windows that cut them, and what they are together."""
    out, last = set(spans), None
    for k, a, e in sorted(spans):
        if last and last[0] == k and a <= last[2]:
            last = (k, last[1], max(e, last[2]))
            out.add(last)
        else:
            last = (k, a, e)
    return out


def added_spans(texts: list[str | None], base: list[list[Span]], tagger: Tagger, block: int = 1024) -> list[list[Span]]:
    """The network's spans that overlap no base span and pass their kind's checks.

    Windows overlap, so a span that one window cuts is found by the window beside it, or in parts by both; parts that overlap or touch are joined. Of the joined
    spans and the parts, in one pass over the whole text, longer ones go first, then those further left; what overlaps a span that stays is dropped.
    """
    code = [classes(t) if t and CUE.search(t) else None for t in texts]
    where = [(i, b) for i, c in enumerate(code) if c is not None for b in window_starts(c)]
    found: list[set[Span]] = [set() for _ in texts]
    for at in range(0, len(where), block):
        part = where[at : at + block]
        x, same = np.unique(np.stack([cut(code[i], b) for i, b in part]), axis=0, return_inverse=True)
        spans = [tagged(row) for row in tagger.decode(x)]
        for (i, b), w in zip(part, same.reshape(-1), strict=True):
            found[i].update((k, b * STRIDE + a, b * STRIDE + e) for k, a, e in spans[w])
    out = []
    for i, spans in enumerate(found):
        kept: list[Span] = []
        taken = np.zeros(len(code[i]) if spans else 0, bool)
        for _, a, e in base[i] if spans else ():
            taken[a:e] = True
        for k, a, e in sorted(joined(spans), key=lambda s: (s[1] - s[2], s[1], s[0])):
            a, e = max(a, 0), min(e, len(taken))
            body = texts[i][a:e]
            a, e = a + len(body) - len(body.lstrip()), e - len(body) + len(body.rstrip())
            if e - a >= LEAST and not taken[a:e].any() and CUE.search(texts[i], a, e) and plausible(k, texts[i], a, e):
                kept.append((k, a, e))
                taken[a:e] = True
        out.append(kept)
    return out


def altered(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """A copy whose spans are written otherwise."""
    out, where, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        body = text[a:b]
        if kind == 0:
            body = body.replace("@", (" @ ", "(@)")[turn % 2])
        elif kind == 3:
            body = (body[1:], body[1:].replace("-", "."), body[1:].replace(" ", "-"))[turn % 3]
        elif kind == 2:
            body = re.sub("[ -]", (".", "/")[turn % 2], body)
        before = text[at:a]
        if kind == SECRET:
            before = re.sub(r"""[A-Za-z_-]+(\s*)[=:](\s*)["']?$""", lambda m: ("api_key", "PASSWORD", "secret", "auth token")[turn % 4] + m[1] + "=:"[turn // 2 % 2] + m[2], before)
            body = (body.upper(), body.lower(), body)[turn % 3]
        out += before
        where.append((kind, len(out), len(out) + len(body)))
        out += body
        at = b
    return out + text[at:], where


def training_windows(texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from labelled spans, from altered copies, and as many of other windows with a digit or an at sign."""
    y, plain = [], []
    for turn, text in enumerate(texts):
        spans = labelled_spans(text)
        for copy, where in [(text, spans), altered(text, spans, turn)] if spans else [(text, spans)]:
            code = classes(copy)
            tag = np.zeros(len(code), np.int8)
            for k, a, b in where:
                tag[a:b] = 2 * k + 2
                tag[a] = 2 * k + 1
            for b in window_starts(code):
                w, t = cut(code, b), cut(tag.view(np.uint8), b)
                if t[0] and t[0] % 2 == 0:  # a span cut by the window's start begins there
                    t[0] -= 1
                (y if t.any() else plain).append((w, t))
    rng = np.random.default_rng(2)
    y = [y[i] for i in rng.permutation(len(y))[:limit]]
    plain = [plain[i] for i in rng.permutation(len(plain))[: max(limit // 4, len(y))]]
    rows = y + plain
    if not y:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int8)
    return np.stack([w for w, _ in rows]), np.stack([t for _, t in rows]).astype(np.int8)


def fit_tagger(docs: DataFrame, *, sample: int = 400, windows: int = 600, steps: int = 400, most_chars: int = 20_000) -> Tagger | None:
    """Learns from at most `sample` documents with digits or at signs and at most most_chars characters. None without spans.

    Documents are dealt to `sample` buckets by a hash of doc_id and text, and each bucket gives the one with the least hash: the same ones on every run, however many
    rows are repeated. Only hashes are gathered first, then the chosen texts.
    """
    own = F.xxhash64("doc_id", "text")
    usable = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= most_chars)).withColumn("_h", own)
    chosen = [r.h for r in usable.groupBy(F.pmod("_h", F.lit(sample))).agg(F.min("_h").alias("h")).collect()]
    if not chosen:
        return None
    rows = usable.where(F.col("_h").isin(chosen)).groupBy("_h").agg(F.min("text").alias("text")).collect()
    x, y = training_windows(sorted(r.text for r in rows), windows)
    if not len(x):
        return None
    tagger = Tagger.new()
    tagger.fit(x, y, steps=steps)
    return tagger


COUNTS = tuple(f"n_{k}" for k in KINDS[:BASE])
RESULT = ", ".join(f"{c} bigint" for c in COUNTS) + ", n_spans bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>"


def all_spans(texts: list[str | None], tagger: Tagger | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """The base spans of each text, and the network's."""
    base = [base_spans(t) for t in texts]
    return base, added_spans(texts, base, tagger) if tagger else [[] for _ in texts]


def find_private(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), n_spans (all spans), base_sha256, spans (all, as kind:start:end) and found (all, as an array).

    A null or empty text has no spans; a text of any length is read whole, in windows. Without a tagger only base spans are found. Rows are handled one by one: repeated
    rows stay, an empty table gives an empty result, and columns of the names added are replaced. Ties between overlapping added spans go to the one further left.
    """
    lean_batches(docs.sparkSession)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for b, m in zip(*all_spans(texts.tolist(), tagger), strict=True):
                both = sorted(b + m)
                n = [sum(k == i for k, _, _ in b) for i in range(BASE)]
                rows.append((*n, len(both), hashlib.sha256(listed(b).encode()).hexdigest(), listed(both), [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in both]))
            yield pd.DataFrame(rows, columns=names)

    out = docs.withColumn("_found", F.pandas_udf(find, RESULT)(F.col("text")))
    for name in names:
        out = out.withColumn(name, F.col(f"_found.{name}"))
    return out.drop("_found")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_private(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with their spans replaced and n_spans: found and replaced in one pass, so that a task needs one Python worker. Rows are handled as by find_private."""
    lean_batches(docs.sparkSession)

    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = [b + m for b, m in zip(*all_spans(texts.tolist(), tagger), strict=True)]
            yield pd.DataFrame({"text": [redacted(t, s) for t, s in zip(texts, both, strict=True)], "n_spans": [len(s) for s in both]})

    out = docs.withColumn("_new", F.pandas_udf(replace, "text string, n_spans bigint")(F.col("text")))
    return out.withColumn("text", F.col("_new.text")).withColumn("n_spans", F.col("_new.n_spans")).drop("_new")
