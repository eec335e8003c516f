"""Removal of repeated byte strings with a distributed, common-prefix-aware merge sort of suffixes.

A string of SIZE bytes repeats if it starts at two places of the corpus. Each window of SIZE bytes has one anchor, the least (by hash) of the
GRAM-byte strings in it, so equal windows have equal anchors at equal offsets. The windows of one anchor are those that begin d bytes before
it, for d in a range; a window repeats iff another anchor agrees in the d bytes before and the SIZE - d bytes from it on. All windows of an anchor hold
its place, so what they cover is one run of bytes, fixed by the largest and the least repeating d.

1. Anchors whose GRAM bytes occur once are dropped (a count by hash; a collision keeps an anchor too many, no more).
2. The suffixes that begin at the other anchors are sorted within each batch of documents and front-coded: each with the length of the
   prefix it shares with the one before and the rest. Equal ones are stored once. These runs are exchanged by their first GRAM bytes.
3. A loser tree merges the runs of a part. It compares two heads only beyond the prefixes known to be shared, and gives each suffix with
   its common prefix with the one before. From these, and from the sorted bytes before the anchors, come the classes of equal windows for every d.

A string that anchors windows at very many places would send all of them to one part. Its contexts (all bytes of an anchor's windows) are first counted by
digest: where one occurs twice, all its windows repeat, and one of its places stands for the rest. The windows of those are cut by d into pieces of STEP.
All windows of a piece hold the same bytes around the anchor, which become the key of exchange in place of the GRAM bytes: a piece whose key occurs
once is settled, others are merged as above, and where even a piece's key is that common its windows are counted by digest, one by one.

A passage of a few more than 50 words is often shorter than SIZE bytes. Runs of WORDS words that another document holds too are found by anchors of the same kind, in words
(shared_words): they are counted beside the removed bytes and change nothing of them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, gram_hash, materialize, mix64, powers, prefix_hash, word_hashes

SIZE = 400
GRAM = 240
SPAN = SIZE - GRAM + 1
STEP = 20
WORDS = 51
WORD_GRAM = 16


def to_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def anchors(grams: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leftmost least of each run of `span` hashes: its place, and the first and last window (run) that has it.

    Blocks of `span` are scanned forwards and backwards; a run is the end of one block and the start of the next. The low 8 bits of a
    hash give way to the place in its block, so the hashes count without them.
    """
    n = len(grams)
    windows = n - span + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3
    blocks = -(-n // span)
    key = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:n] = (grams & ~np.uint64(255)) | (np.arange(n) % span).astype(np.uint64)
    table = key.reshape(blocks, span)
    forwards = np.minimum.accumulate(table, axis=1).reshape(-1)
    backwards = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    start = np.arange(windows)
    end = start + span - 1
    a, b = backwards[start], forwards[end]
    low = (a >> np.uint64(8)) <= (b >> np.uint64(8))
    place = np.where(low, (start // span) * span + (a & np.uint64(255)).astype(np.int64), (end // span) * span + (b & np.uint64(255)).astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.append(first[1:], windows) - 1


ANCHOR = "doc bigint, text_hash bigint, gram bigint, place int, least smallint, most smallint"


def anchor_rows(values: Callable[[str], np.ndarray], size: int, gram: int, context: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(doc, text_hash, gram, place, least, most) of each anchor of the windows of `size` of a text's values; its windows begin least to most before it.

    context adds a 64-bit hash of all values of these windows, and of where the anchor is among them.
    """
    span = size - gram + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                parts = []
                for doc, text_hash, text in pdf.iloc[at : at + 500].itertuples(index=False):
                    own = values(text)
                    grams = gram_hash(own, gram)
                    place, first, last = anchors(grams, span)
                    if n := len(place):
                        part = [np.full(n, doc), np.full(n, text_hash), grams[place].view(np.int64), place.astype(np.int32), (place - last).astype(np.int16), (place - first).astype(np.int16)]
                        if context:
                            h, (_, inverse) = prefix_hash(own), powers(len(own) + 1)
                            where = ((place - last) * 256 + place - first).astype(np.uint64)
                            part.append(mix64((h[last + size] - h[first]) * inverse[first] + where).view(np.int64))
                        parts.append(part)
                if parts:
                    names = ["doc", "text_hash", "gram", "place", "least", "most", *["context"] * context]
                    yield pd.DataFrame({name: np.concatenate(x) for name, x in zip(names, zip(*parts, strict=True), strict=True)})

    return rows


def byte_values(text: str) -> np.ndarray:
    return np.frombuffer(to_bytes(text), np.uint8)


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of a and b, of which `known` bytes need no comparison."""
    n = min(len(a), len(b))
    at, step = known, 32
    while at < n:
        x, y = a[at : at + step], b[at : at + step]
        if x == y:
            at = min(n, at + step)
            step *= 2
        elif step == 1:
            return at
        else:
            m = min(len(x), len(y))
            diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            if not diff:
                at += m
                continue
            return at + m - (diff.bit_length() + 7) // 8
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Sorted strings as shared prefix lengths, the rests joined, and the rests' lengths."""
    shared, rests, before = [], [], b""
    for s in strings:
        k = common(before, s, 0)
        shared.append(k)
        rests.append(s[k:])
        before = s
    return np.array(shared, np.int32), b"".join(rests), np.array([len(r) for r in rests], np.int32)


def front_decoded(shared: np.ndarray, rests: bytes, lengths: np.ndarray) -> Iterator[tuple[int, bytes]]:
    at, before = 0, b""
    for k, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:k] + rests[at : at + n]
        at += n
        yield k, before


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Merges sorted front-coded runs with a loser tree: (run, prefix shared with the string before, string) in order.

    known[r] is the prefix that run r's head shares with the string given last or, in the tree, with the one that beat it. Of two heads the one with
    the longer known prefix is less, whatever follows; only at equal lengths are bytes compared, from there on.
    """
    k = len(runs)
    head: list[bytes | None] = []
    known = [0] * k
    for r in runs:
        head.append(next(r, (0, None))[1])

    def less(x: int, y: int) -> bool:
        """Whether x beats y; the loser's known prefix becomes that with the winner."""
        a, b = head[x], head[y]
        if a is None or b is None:
            return b is None if a is not None else False
        if known[x] != known[y]:
            return known[x] > known[y]
        n = common(a, b, known[x])
        won = len(a) < len(b) if n == min(len(a), len(b)) else a[n] < b[n]
        if n == len(a) == len(b):
            won = x < y
        known[y if won else x] = n
        return won

    loser = [-1] * k
    for r in range(k):
        node, now = (r + k) // 2, r
        while node:
            if loser[node] < 0:
                loser[node] = now
                break
            if less(loser[node], now):
                now, loser[node] = loser[node], now
            node //= 2
        else:
            loser[0] = now
    while (w := loser[0]) >= 0 and head[w] is not None:
        yield w, known[w], head[w]
        known[w], head[w] = next(runs[w], (0, None))
        node = (w + k) // 2
        while node:
            if less(loser[node], w):
                w, loser[node] = loser[node], w
            node //= 2
        loser[0] = w


RUN = "part int, shared binary, rests binary, lengths binary, right binary, least binary, most binary, times binary, doc binary, text_hash binary, place binary"
#: Context of an anchor in a run: its suffix (`right` bytes), then the bytes before it backwards.
FIELDS = (("shared", np.int32), ("lengths", np.int32), ("right", np.int32), ("least", np.int32), ("most", np.int32), ("times", np.int32))


def run_rows(parts: int, batch: int = 4 << 20):
    """Sorted, front-coded runs of the anchors' suffixes: a run for about `batch` bytes of text, one row for each part of it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size = 0
        for pdf in batches:
            for doc, text_hash, text, found in pdf.itertuples(index=False):
                raw = to_bytes(text)
                size += len(raw)
                for place, least, most, piece in sorted({(x["place"], x["least"], x["most"], x["piece"]) for x in found}):
                    suffix = raw[place : place + SIZE - least]
                    key = kernel(raw, place, least) if piece else suffix[:GRAM]
                    held.setdefault((suffix + raw[place - most : place][::-1], len(suffix), least, most, zlib.crc32(key)), []).append((doc, text_hash, place))
                if size >= batch:
                    yield encode(held)
                    held, size = {}, 0
        if held:
            yield encode(held)

    def encode(held: dict[tuple, list]) -> pd.DataFrame:
        by: dict[int, list] = {}
        for key in sorted(held):
            by.setdefault(key[4] % parts, []).append(key)
        out = []
        for part, keys in by.items():
            shared, rests, lengths = front_code([k[0] for k in keys])
            columns = {"shared": shared, "lengths": lengths, "right": [k[1] for k in keys], "least": [k[2] for k in keys], "most": [k[3] for k in keys], "times": [len(held[k]) for k in keys]}
            where = np.array([w for k in keys for w in held[k]], np.int64)
            out.append({"part": part, "rests": zlib.compress(rests, 1)} | {c: np.asarray(columns[c], kind).tobytes() for c, kind in FIELDS} | {c: where[:, i].tobytes() for i, c in enumerate(("doc", "text_hash", "place"))})
        return pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")])

    return rows


def kernel(raw: bytes, place: int, d: int) -> bytes:
    """The bytes that all windows of d's piece hold around the anchor at `place`."""
    low = d - d % STEP
    return raw[place - low : place + SIZE - min(low + STEP, SPAN) + 1]


INTERVAL = "doc bigint, text_hash bigint, start bigint, end bigint"
CONTEXT = "batch string, context binary, least smallint, most smallint, pieces array<struct<least:smallint,most:smallint,key:binary>>, places array<struct<doc:bigint,text_hash:bigint,place:int>>"


def context_rows(batches: Iterator[pd.DataFrame], batch: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Digests of the anchors' contexts and of the kernels of their pieces: one row for each context of about `batch` bytes of text, with its places."""
    held: dict[bytes, tuple] = {}
    size = 0

    def rows() -> pd.DataFrame:
        name = uuid.uuid4().hex
        return pd.DataFrame([(name, digest, *of) for digest, of in held.items()], columns=["batch", "context", "least", "most", "pieces", "places"])

    for pdf in batches:
        for doc, text_hash, text, found in pdf.itertuples(index=False):
            raw = to_bytes(text)
            size += len(raw)
            for place, least, most in sorted({(x["place"], x["least"], x["most"]) for x in found}):
                digest = hashlib.md5(b"%d:%d:" % (least, most) + raw[place - most : place + SIZE - least]).digest()
                if digest not in held:
                    pieces = [
                        {"least": max(low, least), "most": min(low + STEP - 1, most), "key": hashlib.md5(b"%d:" % low + kernel(raw, place, low)).digest()}
                        for low in range(least - least % STEP, most + 1, STEP)
                    ]
                    held[digest] = least, most, pieces, []
                held[digest][3].append({"doc": doc, "text_hash": text_hash, "place": place})
            if size >= batch:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The intervals around the places of a batch's contexts, those of a document that touch made one."""
    found: dict[tuple, list] = {}
    for least, most, places in zip(pdf["least"], pdf["most"], pdf["places"], strict=True):
        for p in places:
            found.setdefault((p["doc"], p["text_hash"]), []).append((p["place"] - most, p["place"] + SIZE - least))
    return pd.DataFrame([(*key, a, b) for key, spans in found.items() for a, b in united(spans)], columns=["doc", "text_hash", "start", "end"])


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals in order, those that touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(window, doc, text_hash, start) of each window of the pieces found, by digest."""
    for pdf in batches:
        out = []
        for doc, text_hash, text, found in pdf.itertuples(index=False):
            raw = to_bytes(text)
            starts = {x["place"] - d for x in found for d in range(x["least"], x["most"] + 1)}
            out += [(hashlib.md5(raw[at : at + SIZE]).digest(), doc, text_hash, at) for at in sorted(starts)]
        yield pd.DataFrame(out, columns=["window", "doc", "text_hash", "start"])


def with_texts(long: DataFrame, anchors: DataFrame) -> DataFrame:
    """The texts that have any of the anchors, with these as found."""
    fields = [c for c in ("gram", "context", "place", "least", "most", "piece", "low", "high") if c in anchors.columns]
    by_doc = anchors.groupBy("doc", "text_hash").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return long.join(by_doc, ["doc", "text_hash"]).select("doc", "text_hash", "text", "found")


def split_common(long: DataFrame, common: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of anchors whose GRAM bytes are common: the pieces that are left to merge, at most `limit` different contexts a key, and the intervals settled already.

    Counts are taken by 128-bit digest and combined before they are exchanged; they are written, so that the joins with them can split a common key's rows.
    """
    places = materialize(with_texts(long, common).mapInPandas(context_rows, CONTEXT), "contexts")
    contexts = places.select("context", F.size("places").alias("n"), F.array_min("places").alias("one"), "pieces")
    contexts = materialize(contexts.groupBy("context").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.first("pieces").alias("pieces")), "distinct-contexts")
    again = contexts.where("n > 1").select("context")
    equal = places.join(again, "context", "left_semi").select("batch", "least", "most", "places").groupBy("batch").applyInPandas(joined, INTERVAL)
    equal = materialize(equal, "equal-contexts")
    discard(places)
    pieces = contexts.select("one.*", F.explode("pieces").alias("p")).select("doc", "text_hash", "place", "p.*")
    keys = materialize(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "piece-keys")
    shared = pieces.join(keys, "key").select("doc", "text_hash", "place", "least", "most", "_n")
    merge = shared.where(F.col("_n") <= limit).drop("_n")
    windows = materialize(with_texts(long, shared.where(F.col("_n") > limit)).mapInPandas(window_rows, "window binary, doc bigint, text_hash bigint, start bigint"), "windows")
    twice = materialize(windows.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("window"), "repeated-windows")
    single = materialize(windows.join(twice, "window", "left_semi").select("doc", "text_hash", "start", (F.col("start") + SIZE).alias("end")), "single-windows")
    discard(windows, twice)
    merge = materialize(merge, "pieces-to-merge")
    discard(contexts, keys)
    return merge, equal.unionByName(single)


def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs of one part: (doc, text_hash, start, end) of the bytes that repeating windows cover around each anchor."""
    data = [{c: np.frombuffer(row[c], kind) for c, kind in FIELDS} | {c: np.frombuffer(row[c], np.int64) for c in ("doc", "text_hash", "place")} for row in pdf.to_dict("records")]
    at = [0] * len(data)
    run, index, shared, strings = [], [], [], []
    for r, n, s in merged([front_decoded(d["shared"], rests, d["lengths"]) for d, rests in zip(data, map(zlib.decompress, pdf["rests"]), strict=True)]):
        run.append(r)
        index.append(at[r])
        at[r] += 1
        shared.append(n)
        strings.append(s)
    run, index, shared = np.array(run), np.array(index), np.array(shared, np.int64)
    base = np.cumsum([0, *[len(d["shared"]) for d in data]])[run] + index
    field = {c: np.concatenate([d[c] for d in data])[base].astype(np.int64) for c in ("right", "least", "most", "times")}
    # equal contexts of several runs become one
    length = np.array([len(s) for s in strings])
    same = np.concatenate(([False], (shared[1:] == length[1:]) & (length[1:] == length[:-1])))
    for c in ("right", "least", "most"):
        same[1:] &= field[c][1:] == field[c][:-1]
    own = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)
    times = np.bincount(own, field["times"]).astype(np.int64)
    least, most, right = (field[c][first] for c in ("least", "most", "right"))
    # the common prefix with the context before: the least over those merged away is that of the first
    shared = shared[first]
    low, high = np.where(times > 1, least, SIZE), np.where(times > 1, most, -1)
    # contexts whose anchor's bytes no other context has are settled
    alone = (shared < GRAM) & (np.append(shared[1:], 0) < GRAM)
    keep = np.flatnonzero(~alone)
    if len(keep):
        group_shared = shared[keep]
        group_shared[np.concatenate(([True], np.diff(keep) > 1))] = 0
        n = len(keep)
        before = np.zeros((n, SPAN), np.uint8)
        k_least, k_most = least[keep], most[keep]
        for row, i in zip(before, keep, strict=True):
            b = strings[first[i]][right[i] :]
            row[: len(b)] = np.frombuffer(b, np.uint8)
        order = np.lexsort(before.T[::-1])
        differ = before[order][1:] != before[order][:-1]
        left_shared = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)))
        many = times[keep] > 1
        k_low, k_high = low[keep], high[keep]
        for d in range(int(k_least.min()), int(k_most.max()) + 1):
            valid = np.flatnonzero((k_least <= d) & (d <= k_most))
            if len(valid) < 2:
                continue
            right_class = np.cumsum(group_shared < SIZE - d)
            left_class = np.empty(n, np.int64)
            left_class[order] = np.cumsum(left_shared < d)
            key = right_class[valid] * (n + 1) + left_class[valid]
            _, at_key, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = valid[(count[at_key] > 1) | many[valid]]
            k_low[hit] = np.minimum(k_low[hit], d)
            k_high[hit] = np.maximum(k_high[hit], d)
        low[keep], high[keep] = k_low, k_high
    # back to every occurrence
    everywhere = np.zeros(sum(len(d["shared"]) for d in data), np.int64)
    everywhere[base] = own
    entry = np.repeat(everywhere, np.concatenate([d["times"] for d in data]))
    doc, text_hash, place = (np.concatenate([d[c] for d in data]) for c in ("doc", "text_hash", "place"))
    hit = high[entry] >= 0
    entry, place = entry[hit], place[hit]
    return pd.DataFrame({"doc": doc[hit], "text_hash": text_hash[hit], "start": place - high[entry], "end": place + SIZE - low[entry]})


def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """n_bytes, n_removed, n_spans, spans and the rest's SHA-256 of texts and the intervals to remove."""
    for texts, intervals in batches:
        out = []
        for text, found in zip(texts, intervals, strict=True):
            raw = to_bytes(text)
            spans = united([(x["start"], x["end"]) for x in (found if found is not None else ())])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], digest.hexdigest()))
        yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])


def passage_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(window, context, d, low, high) of each window of the contexts found: its 64-bit hash, and how far before the anchor it begins."""
    for pdf in batches:
        parts = []
        for text, found in zip(pdf["text"], pdf["found"], strict=True):
            hashes = gram_hash(word_hashes(text), WORDS).view(np.int64)
            place, least, most, context, low, high = (np.array([x[c] for x in found], np.int64) for c in ("place", "least", "most", "context", "low", "high"))
            n = most - least + 1
            d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - least, n)
            parts.append((hashes[np.repeat(place, n) - d], np.repeat(context, n), d.astype(np.int16), np.repeat(low, n), np.repeat(high, n)))
        if parts:
            yield pd.DataFrame(dict(zip(("window", "context", "d", "low", "high"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def shared_words(keyed: DataFrame) -> DataFrame:
    """(doc, text_hash, n_shared_words): how many words lie in runs of WORDS words that another document holds too; documents without any are left out.

    Words are what ASCII white space divides, compared byte by byte; strings of words go by 64-bit hashes. Rows of one id (or of none) with one text are one document. A context
    that two documents hold is settled; where an anchor has several, the windows of one place of each are counted. low and high are the least and the largest 64-bit key of
    the documents that hold a string.
    """
    long = keyed.where(F.octet_length("text") >= 2 * WORDS - 1).select("doc", "text_hash", "text")
    own = F.xxhash64("doc", "text_hash")
    found = materialize(long.mapInPandas(anchor_rows(word_hashes, WORDS, WORD_GRAM, True), f"{ANCHOR}, context bigint"), "word-anchors")
    several = materialize(found.groupBy("gram").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select("gram"), "word-grams")
    places = materialize(found.join(several, "gram"), "passages")
    discard(found, several)
    one = F.min(F.struct("doc", "text_hash", "place", "least", "most")).alias("one")
    contexts = materialize(places.groupBy("gram", "context").agg(F.min(own).alias("low"), F.max(own).alias("high"), one), "passage-contexts")
    mixed = materialize(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "mixed-grams")
    unlike = materialize(contexts.join(mixed, "gram").select("one.*", "context", "low", "high"), "unlike-contexts")
    windows = materialize(with_texts(long, unlike).mapInPandas(passage_windows, "window bigint, context bigint, d smallint, low bigint, high bigint"), "passage-windows")
    again = materialize(windows.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("window"), "shared-windows")
    partly = windows.where("low = high").join(again, "window", "left_semi").groupBy("context").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    reach = materialize(contexts.where("low <> high").select("context", "one.least", "one.most").unionByName(partly), "reach")
    discard(mixed, unlike, windows, again, contexts)
    spans = places.select("doc", "text_hash", "place", "context").join(reach, "context")
    spans = spans.select("doc", "text_hash", F.struct((F.col("place") - F.col("most")).cast("long").alias("start"), (F.col("place") - F.col("least") + WORDS).cast("long").alias("end")).alias("span"))
    length = F.aggregate(
        F.array_sort(F.collect_list("span")),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    out = materialize(spans.groupBy("doc", "text_hash").agg(length.alias("n_shared_words")), "shared-words")
    discard(places, reach)
    return out


def remove_repeats(docs: DataFrame, *, part_rows: int = 30_000, common_rows: int = 3_000) -> DataFrame:
    """Every byte covered by a SIZE-byte string that starts at another place of the corpus too, by document.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), spans (start and end in bytes), kept_sha256 and n_shared_words (words in runs of
    WORDS words that another document holds too, whatever their bytes; they aren't removed for it), one row a row of docs.
    A null text is empty; texts under SIZE bytes keep all; overlapping occurrences count; repeated rows are places of their own; an
    empty table gives an empty result; a null doc_id is allowed; other columns are ignored. A very long text is held whole by one task, with 8 bytes or so a byte.

    A part of the merge holds about part_rows anchors; strings at more than common_rows anchors are split before (split_common), with the same result.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    passages = shared_words(keyed)
    long = keyed.where(F.octet_length("text") >= SIZE)
    found = materialize(long.select("doc", "text_hash", "text").mapInPandas(anchor_rows(byte_values, SIZE, GRAM), ANCHOR), "anchors")
    # written first, so that the join below reads plain exchanges and can split a common gram's rows
    twice = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram", (F.col("_n") > common_rows).alias("common")), "grams")
    candidates = materialize(found.join(twice, "gram").select("doc", "text_hash", "place", "least", "most", "common"), "candidates")
    discard(found, twice)
    n, n_common = candidates.agg(F.count(F.lit(1)), F.count_if("common")).first()
    anchors_left, settled = candidates.where("NOT common").select("doc", "text_hash", "place", "least", "most", F.lit(False).alias("piece")), None
    if n_common:
        pieces, settled = split_common(long, candidates.where("common").drop("common"), common_rows)
        anchors_left = anchors_left.unionByName(pieces.withColumn("piece", F.lit(True)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // part_rows))
    runs = with_texts(long, anchors_left).mapInPandas(run_rows(parts), RUN)
    intervals = materialize(runs.groupBy("part").applyInPandas(repeats, INTERVAL), "intervals")
    discard(candidates)
    if settled is not None:
        intervals = intervals.unionByName(settled)
    removed = intervals.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    cut = F.pandas_udf(without, "n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    cuts = keyed.join(removed, ["doc", "text_hash"], "left").join(passages, ["doc", "text_hash"], "left")
    return cuts.select("doc_id", cut("text", "found").alias("c"), F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words")).select("doc_id", "c.*", "n_shared_words")
