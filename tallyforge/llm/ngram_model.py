"""Scores of texts under an n-gram model of the corpus, held in Elias-Fano tries.

Words go by 64-bit hashes. Every pair of a context word and its follower is sent to the context's shard, where all that the model needs of that context meets: its count, its
followers and theirs. A shard builds its part of the trie from the training pairs: the contexts, monotone pointers to their followers, and the followers as a monotone
sequence relative to the context, both Elias-Fano coded, with quantised probabilities beside them. The levels are written to a file and mapped, and every different pair of the
shard is looked up by a successor search among its context's followers.

A follower seen c2 times after a context seen c times has the probability (c2 - D) / c; another has D * followers / c times its base probability, (count + 1) / (N + V + 1). So
the training pairs need no count of the follower, and only what falls back is joined with the vocabulary.

Contexts that hold more than 1 / (2 * shards) of all tokens, at most 2 * shards, are counted beforehand. Their pairs go to shards by both words, and pairs that are as common
themselves are scored where they are read, so no shard gets more than its share of a common word, pair or line.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, lean_batches, materialize, mix64, prefix_hash, powers

DISCOUNT = 0.75
#: Steps of a quantised log10 probability a unit; 16 bits reach down to -32.
STEPS = 2048
#: The end of a text, and what stands before its first word.
END = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose pairs one shard holds on average, and tokens that a task gathers before it sends them.
SHARD_BYTES, GATHERED = 16_000_000, 1 << 21
#: Bytes that are hashed at once; cut between words.
HASHED = 1 << 20
#: Pairs that are looked up at once.
ASKED = 1 << 18
#: So many texts of one row that says which fell back to a word.
LISTED = 5_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trained(doc_id: Column) -> Column:
    """True for rows that the model learns from: crc32(doc_id as text) mod 7 is not 2. A null doc_id is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


class EliasFano:
    """A monotone sequence below `universe`: the low bits of each value packed, the high bits in unary, and the number of ones before each word of these."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        n = len(values)
        self.n, self.bits = n, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        width = np.uint64(self.bits)
        self.low = np.zeros(n * self.bits // 64 + 2, np.uint64)
        if self.bits:
            at = np.arange(n, dtype=np.uint64) * width
            low, shift, word = values & ((np.uint64(1) << width) - np.uint64(1)), at & np.uint64(63), (at >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(self.low, word, low << shift)
            over = shift + width > 64
            np.bitwise_or.at(self.low, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        one = (values >> width) + np.arange(n, dtype=np.uint64)
        self.high = np.zeros(((max(universe, 1) >> self.bits) + n) // 64 + 2, np.uint64)
        np.bitwise_or.at(self.high, (one >> np.uint64(6)).astype(np.int64), np.uint64(1) << (one & np.uint64(63)))
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high))]).astype(np.uint32)

    def mapped(self, keep) -> EliasFano:
        """The same with its arrays where `keep` puts them."""
        self.low, self.high, self.ones = keep(self.low), keep(self.high), keep(self.ones)
        return self

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        shift, word = at & np.uint64(63), (at >> np.uint64(6)).astype(np.int64)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | over) & ((np.uint64(1) << np.uint64(self.bits)) - np.uint64(1))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values by place: the i-th one is found by its word, then by halves of this."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        rest, bits, place = i - self.ones[word].astype(np.int64), self.high[word], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << half) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            right = rest >= count
            rest, place = np.where(right, rest - count, rest), place + half * right
            bits = np.where(right, bits >> np.uint64(half), part)
        high = (word * 64 + place - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i)

    def successor(self, wanted: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each wanted value the first place in [start, end) whose value is no less; end if there is none."""
        low, high = start.astype(np.int64).copy(), end.astype(np.int64).copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self[middle] < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


class Trie:
    """A shard's part of the model, of the contexts' sorted hashes, counts and numbers of followers, and its training pairs in order: their context's place, follower and count."""

    def __init__(self, contexts: np.ndarray, totals: np.ndarray, kinds: np.ndarray, place: np.ndarray, follower: np.ndarray, count: np.ndarray, keep=lambda x: x) -> None:
        self.contexts, self.words = keep(contexts), keep(np.unique(follower))
        begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(contexts)))])
        self.pointers = EliasFano(begin, len(place) + 1).mapped(keep)
        ids = place * len(self.words) + np.searchsorted(self.words, follower)
        self.followers = EliasFano(ids, len(contexts) * len(self.words) + 1).mapped(keep)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.seen = keep(quantised(np.log10((count - DISCOUNT) / totals[place])))
            self.fallback = keep(np.where(totals > 0, quantised(np.nan_to_num(np.log10(DISCOUNT * kinds / totals))), 0).astype(np.uint16))

    def query(self, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps below zero, found) of pairs; of a pair that isn't found, what its context gives to its follower's base probability."""
        if not len(self.contexts):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[at] == context
        word = np.minimum(np.searchsorted(self.words, follower), max(len(self.words) - 1, 0))
        possible = np.flatnonzero(known & (self.words[word] == follower)) if len(self.words) else np.zeros(0, np.int64)
        wanted = (at[possible] * len(self.words) + word[possible]).astype(np.uint64)
        start, end = self.pointers[at[possible]].astype(np.int64), self.pointers[at[possible] + 1].astype(np.int64)
        place = self.followers.successor(wanted, start, end)
        hit = place < end
        hit[hit] = self.followers[place[hit]] == wanted[hit]
        steps, found = np.where(known, self.fallback[at], 0).astype(np.int64), np.zeros(len(context), bool)
        steps[possible[hit]], found[possible[hit]] = self.seen[place[hit]], True
        return steps, found


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts, each with its END, and the text of each."""
    raw = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])[:-1]
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    found, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASHED, side="right")))
        low = start[i]
        part = _LOWER[raw[low : end[j - 1]]]
        h = prefix_hash(part)
        _, inverse = powers(len(part) + 1)
        s, e = start[i:j] - low, end[i:j] - low
        found.append(mix64((h[e] - h[s]) * inverse[s] + (e - s).astype(np.uint64)))
        i = j
    words = np.concatenate([np.zeros(0, np.uint64), *found])
    owner = np.searchsorted(begin, start, side="right") - 1
    last = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return np.insert(words, last, END), np.insert(owner, last, np.arange(len(texts)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(first row, doc_ids, trained, followers, contexts, text of each) of about GATHERED tokens at a time. Rows are numbered one after another."""
    held, n = [], 0

    def joined() -> tuple:
        size = np.cumsum([0, *(len(h[1]) for h in held)])
        tokens = np.concatenate([h[3] for h in held])
        owner = np.concatenate([h[4] + np.int32(k) for h, k in zip(held, size, strict=False)])
        out = held[0][0], *(np.concatenate([h[i] for h in held]) for i in (1, 2)), tokens, np.concatenate(([END], tokens[:-1])), owner
        held.clear()
        return out

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for at in range(0, len(texts), 500):
            tokens, owner = token_hashes(texts[at : at + 500])
            ids = np.array(batch.column("doc_id")[at : at + 500].to_pylist(), object)
            held.append((batch.column("row")[at].as_py(), ids, batch.column("train")[at : at + 500].to_numpy(zero_copy_only=False).astype(bool), tokens, owner.astype(np.int32)))
            n += len(tokens)
            del tokens, owner
            if n >= GATHERED:
                n = 0
                yield joined()
    if held:
        yield joined()


def _common(shards: int):
    """Tokens that are common among those gathered, and under a null word how many were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, tokens, _, _ in _gathered(batches):
            words, counts = np.unique(tokens, return_counts=True)
            often = counts * 2 * shards >= len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([len(tokens), *counts[often].tolist()], pa.int64())], names=["word", "n"])

    return run


def _pairs_after(common: np.ndarray):
    """Pairs whose context is common, with their occurrences and those to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, train, follower, context, owner in _gathered(batches):
            at = np.flatnonzero(np.isin(context, common))
            order = at[np.lexsort((follower[at], context[at]))]
            c, f, learnt = context[order], follower[order], train[owner[order]].astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (f[1:] != f[:-1])))[: len(c)])
            counts = [np.add.reduceat(v, new) if len(new) else v for v in (np.ones(len(c), np.int64), learnt)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[new].view(np.int64), f[new].view(np.int64), *counts)], names=["context", "follower", "n", "learnt"])

    return run


class Common:
    """What is known beforehand of common contexts (hash, count, followers) and common pairs (context, follower, training count)."""

    def __init__(self, contexts: list[tuple], pairs: list[tuple]) -> None:
        contexts = sorted((x & (1 << 64) - 1, c, k) for x, c, k in contexts)
        self.words = np.array([x for x, *_ in contexts], np.uint64)
        self.totals, self.kinds = (np.array([r[i] for r in contexts], np.int64) for i in (1, 2))
        self.pairs = {(x & (1 << 64) - 1, y & (1 << 64) - 1): n for x, y, n in pairs}

    def at(self, words: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


SENT = "shard int, contexts binary, runs binary, words binary, followers binary, owners binary, row bigint, texts array<struct<row:bigint,doc_id:bigint,n_tokens:bigint,n_known:bigint,base:double,steps:bigint>>"
SENT_TYPES = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.list_(pa.struct([(n, pa.float64() if n == "base" else pa.int64()) for n in ("row", "doc_id", "n_tokens", "n_known", "base", "steps")]))]


def _small(x: np.ndarray) -> bytes:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _sender(shards: int, known: Common):
    names = [c.split()[0] for c in SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, train, follower, context, owner in _gathered(batches):
            size, place = len(ids), known.at(context).astype(np.int32)
            hot = np.flatnonzero(place >= 0)
            total = known.totals[place[hot]]
            base = np.bincount(owner[hot], np.log10(total + 1.0), size)
            n_known = np.bincount(owner[hot], total > 0, size).astype(np.int64)
            steps, stays = np.zeros(size, np.int64), np.ones(len(context), bool)
            for (c, f), n in known.pairs.items():
                here = hot[(context[hot] == np.uint64(c)) & (follower[hot] == np.uint64(f))]
                if n and len(here):  # one that is common among texts held out only falls back in its shard
                    p = quantised(np.log10(np.array([(n - DISCOUNT) / known.totals[place[here[0]]]])))[0]
                    steps += np.bincount(owner[here], minlength=size) * int(p)
                    stays[here] = False
            own = np.bincount(owner, minlength=size)
            names_ = ("row", "doc_id", "n_tokens", "n_known", "base", "steps")
            texts = [dict(zip(names_, r, strict=True)) for r in zip(range(row, row + size), ids.tolist(), own.tolist(), n_known.tolist(), base.tolist(), steps.tolist(), strict=True)]
            del hot, total
            at = np.flatnonzero(stays)
            c, f, o = context[at], follower[at], owner[at] * 2 + train[owner[at]]
            to = (mix64(np.where(place[at] >= 0, c * np.uint64(3) + mix64(f), c)) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)
            del at, place, stays, context, follower, owner
            order = np.lexsort((f, c))
            order = order[np.argsort(to[order], kind="stable")]
            c, f, o, to = c[order], f[order], o[order], to[order]
            del order
            cuts, out = np.searchsorted(to, np.arange(shards + 1)), []
            target = row % shards
            for shard in range(shards):
                a, b = cuts[shard], cuts[shard + 1]
                if a == b and shard != target:
                    continue
                new = np.flatnonzero(np.concatenate(([True], c[a + 1 : b] != c[a : b - 1]))[: b - a])
                words, which = np.unique(f[a:b], return_inverse=True)
                out.append((shard, c[a:b][new].tobytes(), np.diff(np.append(new, b - a)).astype(np.uint32).tobytes(), words.tobytes(), _small(which), _small(o[a:b]), row, texts if shard == target else []))
            del c, f, o, to
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SENT_TYPES, strict=True)], names=names)

    return run


FOUND = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, steps bigint, fell bigint, back double, word bigint, count bigint, rows array<bigint>"
FOUND_TYPES = {n: {"double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}.get(t, pa.int64()) for n, t in (c.split() for c in FOUND.split(", "))}


def _table(n: int, **columns) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in FOUND_TYPES.items()})


def _judge(known: Common):
    def run(sent: pa.Table) -> pa.Table:
        contexts, followers, owners, train, rows, size = [], [], [], [], [], 0
        out = []
        for r in (r for batch in sent.to_batches(max_chunksize=1) for r in batch.to_pylist()):
            if r["texts"]:
                out.append(_table(len(r["texts"]), **{k: [t[k] for t in r["texts"]] for k in r["texts"][0]}))
            runs, words = np.frombuffer(r["runs"], np.uint32), np.frombuffer(r["words"], np.uint64)
            n = int(runs.sum())
            contexts.append(np.repeat(np.frombuffer(r["contexts"], np.uint64), runs))
            followers.append(words[_numbers(r["followers"], n)])
            who = _numbers(r["owners"], n)
            train.append((who & 1).astype(bool))
            own = int(who.max()) // 2 + 1 if n else 0
            owners.append((who >> 1).astype(np.int32) + np.int32(size))
            rows.append(np.arange(r["row"], r["row"] + own))
            size += own
        context = np.concatenate(contexts)
        del contexts
        follower = np.concatenate(followers)
        del followers
        owner, rows, train = (np.concatenate(x) for x in (owners, rows, train))
        del owners, sent
        if not len(context):
            return pa.concat_tables([*out, _table(0)])
        order = np.lexsort((follower, context))
        context, follower, owner, train = context[order], follower[order], owner[order], train[order]
        del order
        new = np.concatenate(([True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])))
        first = np.flatnonzero(new)
        pair = np.cumsum(new, dtype=np.int32) - 1
        learnt = np.add.reduceat(train.astype(np.int64), first)
        context, follower = context[first], follower[first]
        words, place = np.unique(context, return_inverse=True)
        totals, kinds = (np.bincount(place, v, len(words)).astype(np.int64) for v in (learnt, learnt > 0))
        hot = known.at(words)
        totals, kinds = (np.where(hot >= 0, v[hot], own) if len(v) else own for v, own in ((known.totals, totals), (known.kinds, kinds)))
        taught = learnt > 0
        with tempfile.NamedTemporaryFile() as file:  # of this task only; gone when it ends

            def keep(x: np.ndarray) -> np.ndarray:
                at = file.tell()
                file.write(x.tobytes() + bytes(-x.nbytes % 8))
                file.flush()
                return np.memmap(file.name, x.dtype, "r", at, x.shape) if x.size else x

            trie = Trie(words, totals, kinds, place[taught], follower[taught], learnt[taught], keep)
            blocks = range(0, len(context), ASKED)
            steps, found = (np.concatenate(x) for x in zip(*(trie.query(context[i : i + ASKED], follower[i : i + ASKED]) for i in blocks), strict=True))
            del trie
        # by text: what its pairs come to
        plain = hot[place] < 0  # of common contexts the sender counts
        logs = np.where(plain, np.log10(totals[place] + 1.0), 0.0)
        at = known.at(follower)
        easy = ~found & (at >= 0)  # falls back to a common word, whose count is known
        backs = np.where(easy, np.log10((known.totals[at] if len(known.totals) else np.zeros(len(at))) + 1.0), 0.0)
        sums = {"n_known": plain & (totals[place] > 0), "base": logs, "steps": steps, "fell": ~found, "back": backs}
        sums = {k: np.bincount(owner, v[pair], len(rows)) for k, v in sums.items()}
        touched = np.flatnonzero(np.bincount(owner, minlength=len(rows)))
        out.append(_table(len(touched), row=rows[touched], **{k: v[touched] if k in ("base", "back") else v[touched].astype(np.int64) for k, v in sums.items()}))
        counted = (hot < 0) & (totals > 0)
        out.append(_table(int(counted.sum()), word=words[counted].view(np.int64), count=totals[counted]))
        # pairs that fall back to other words: which texts, by word
        far = (~found & ~easy)[pair]
        word, who = follower[pair[far]].view(np.int64), rows[owner[far]]
        order = np.argsort(word, kind="stable")
        word, who = word[order], who[order]
        cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))[: len(word)])
        run = np.arange(len(word)) - np.repeat(cut, np.diff(np.append(cut, len(word))))
        cut = np.flatnonzero(run % LISTED == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(word)).astype(np.int32)), pa.array(who))
        out.append(_table(len(cut), word=word[cut], rows=lists))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text of docs (doc_id, text), and vocabulary, the number of different training tokens.

    Texts are lower-cased (A to Z) and cut into words of anything but ASCII white space, and one end; the model learns from rows that `trained` picks. A null text is
    empty and has its end only; texts of any length are scored whole; repeated rows are learnt from and scored each; rows with a null doc_id are scored, not learnt from, and not called
    held out; other columns are ignored; an empty table gives an empty result, and without training rows every probability is 1 / (0 + 1). Scores are sums of quantised logarithms, steps
    of 1 / STEPS, and of exact ones for what falls back.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", trained(F.col("doc_id")).alias("train"), F.monotonically_increasing_id().alias("row"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    often = rows.mapInArrow(_common(shards), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = materialize(often, "common-words")
    tokens = (often.where("word is null").first() or [0, 0])[1]
    is_common = F.col("n") * 2 * shards >= tokens
    words = [r.word for r in often.where("word is not null").where(is_common).select("word").collect()]  # at most 2 * shards
    known = Common([], [])
    if words:
        pairs = rows.mapInArrow(_pairs_after(np.array(words, np.int64).view(np.uint64)), "context bigint, follower bigint, n bigint, learnt bigint")
        pairs = materialize(pairs.groupBy("context", "follower").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")), "common-pairs")
        stats = pairs.groupBy("context").agg(F.sum("learnt").alias("c"), F.count_if(F.col("learnt") > 0).alias("k")).collect()
        known = Common([tuple(r) for r in stats], [(r.context, r.follower, r.learnt) for r in pairs.where(is_common).collect()])
        discard(pairs)
    discard(often)
    sent = rows.mapInArrow(_sender(shards, known), SENT)
    found = materialize(sent.groupBy("shard").applyInArrow(_judge(known), FOUND), "scored")
    vocabulary = found.where(F.col("count").isNotNull()).select("word", "count")
    seen = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = seen.n + int(known.totals.sum()), seen.v + int((known.totals > 0).sum())
    none = F.lit(0.0)
    far = found.where(F.col("rows").isNotNull()).select("word", "rows").join(vocabulary, "word", "left")
    far = far.select(F.explode("rows").alias("row"), F.log10(F.coalesce("count", F.lit(0)) + 1.0).alias("back"))
    names = ("n_tokens", "n_known", "base", "steps", "fell", "back")
    sums = found.where(F.col("row").isNotNull()).select("row", "doc_id", *names).unionByName(far, allowMissingColumns=True)
    sums = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    norm = F.log10(F.lit(float(n + v + 1)))
    return sums.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        F.lit(v).cast("long").alias("vocabulary"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        (F.coalesce("back", none) - F.col("fell") * norm - F.col("steps") / F.lit(float(STEPS))).alias("score"),
    )
