"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are compared as lower-case letters and digits, each run of other characters read as one space. If an item of m
characters occurs with at most k edits, some diagonal band of k + 1 diagonals holds at least m - q + 1 - q * k of its q-grams. Bands of twice that
width overlap by half, so one of them holds every such band; those that reach the bound are aligned. The bound says something only while q * (k + 1) <= m, so
short items go by shorter q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, gram_hash, lean_batches, materialize

HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"
_word: list[np.ndarray] = []


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points as they are compared, and where each stands in the text as lower-cased."""
    if not _word:
        _word.append(np.array([chr(i).isalnum() for i in range(1 << 16)]))
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word[0][np.minimum(cp, 0xFFFF)] | (cp > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    out = np.where(word[at], cp[at], np.uint32(32))
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


#: So many q-gram matches are expanded at once.
CHUNK = 1 << 20
OFFSET = 1 << 40


class Items:
    """An index of benchmark items: their q-grams, sorted by hash, with item and position; q shrinks to m // (k + 1) for items whose budget of k edits needs it, and the
    hashes of all lengths share one index. Items of fewer than q characters are found as whole words, unchanged."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float) -> None:
        self.ids, self.text, self.budget, own = [], [], [], []
        grams, owner, place = [], [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in items:
            cp = normalise(text)[0]
            if len(cp) < q:
                if len(cp):
                    self.short.setdefault(len(cp), {}).setdefault(cp.tobytes(), []).append(item_id)
                continue
            budget = int(edits * len(cp))
            size = max(1, min(q, len(cp) // (budget + 1)))
            n = len(cp) - size + 1
            for values, value in ((grams, gram_hash(cp, size)), (owner, np.full(n, len(self.ids), np.int32)), (place, np.arange(n, dtype=np.int32))):
                values.append(value)
            self.ids.append(item_id)
            self.text.append(cp)
            self.budget.append(budget)
            own.append(size)
        none = np.zeros(0, np.int32)
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate([none, *owner])[order], np.concatenate([none, *place])[order]
        self.hash, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hash >> np.uint64(44)] = True
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.budgets = np.array(self.budget, np.int64)
        sizes = np.array(own, np.int64)
        self.least = np.maximum(1, self.length - sizes + 1 - sizes * self.budgets)
        self.sizes = sorted(set(own))

    def search(self, text: str | None) -> list[dict]:
        """The best alignment of each item that occurs within its budget of edits."""
        if not text or not (self.ids or self.short):
            return []
        doc, at = normalise(text)
        found = self.exact(doc)
        for i, span in self.aligned(doc).items():  # of several texts of one item the best counts
            found[self.ids[i]] = min(span, found.get(self.ids[i], span), key=lambda x: (x[2], x[0]))
        return [{"item_id": i, "start": int(at[s]), "end": int(at[e - 1]) + 1, "edits": d} for i, (s, e, d) in sorted(found.items())]

    def exact(self, doc: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The first place of each short item that stands as words of its own."""
        found: dict[int, tuple[int, int, int]] = {}
        words = np.concatenate([[np.uint32(32)], doc, [np.uint32(32)]]).astype(np.uint32)
        for n, items in self.short.items():
            if len(doc) < n:
                continue
            wanted = {k: np.frombuffer(k, np.uint32) for k in items}
            hashes = gram_hash(words, n + 2)
            for key, cp in wanted.items():
                hit = np.flatnonzero(hashes == gram_hash(np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]]).astype(np.uint32), n + 2)[0])
                if len(hit):
                    found |= {i: (int(hit[0]), int(hit[0]) + n, 0) for i in items[key]}
        return found

    def bands(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands of items that share q-grams with the text, as keys of item and band, and how many. A q-gram of many items is expanded in pieces."""
        keys, counts = [], []
        for size in self.sizes:
            h = gram_hash(doc, size)
            hit = np.flatnonzero(self.seen[h >> np.uint64(44)])
            where = np.minimum(np.searchsorted(self.hash, h[hit]), len(self.hash) - 1)
            same = self.hash[where] == h[hit]
            hit, where = hit[same], where[same]
            ends = np.cumsum(self.times[where])
            total, start = ends[-1] if len(ends) else 0, 0
            while start < total:
                entry = np.arange(start, min(start + CHUNK, total))
                of = np.searchsorted(ends, entry, side="right")
                at = self.first[where[of]] + entry - (ends[of] - self.times[where[of]])
                item = self.owner[at].astype(np.int64)
                band = np.floor_divide(hit[of] - self.place[at], self.budgets[item] + 1)
                key, count = np.unique(np.concatenate([item * OFFSET + (band + OFFSET // 2), item * OFFSET + (band - 1 + OFFSET // 2)]), return_counts=True)
                keys.append(key)
                counts.append(count)
                start += CHUNK
        if len(keys) < 2:
            return (keys[0], counts[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    def aligned(self, doc: np.ndarray) -> dict[int, tuple[int, int, int]]:
        found: dict[int, tuple[int, int, int]] = {}
        if not self.ids or len(doc) < self.sizes[0]:
            return found
        key, count = self.bands(doc)
        for k in key[count >= self.least[key // OFFSET]]:
            i, b = int(k // OFFSET), int(k % OFFSET) - OFFSET // 2
            best = banded(self.text[i], doc, b * (self.budget[i] + 1), (b + 2) * (self.budget[i] + 1), self.budget[i])
            if best and (i not in found or (best[2], best[0]) < (found[i][2], found[i][0])):
                found[i] = best
        return found


def banded(item: np.ndarray, doc: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best occurrence of item in doc that begins on a diagonal from low to high, as (start, end, edits): None beyond budget edits.

    cost[d] is the least cost at the current row of the item on diagonal low - budget + d; the start comes along with it.
    """
    first, width = low - budget, high - low + 2 * budget + 1
    diagonals = first + np.arange(width)
    big = 1 << 20
    cost = np.where((diagonals >= max(low, 0)) & (diagonals <= min(high, len(doc))), 0, big)
    start = np.maximum(diagonals, 0)
    ramp = np.arange(width)
    padded = np.concatenate([np.zeros(max(0, -first), np.uint32), doc[max(first, 0) : first + width + len(item) + 1], np.zeros(max(0, first + width + len(item) + 1 - len(doc)), np.uint32)])
    for i, c in enumerate(item):
        column = diagonals + i  # of the doc's character that this row may match
        match = cost + (padded[i : i + width] != c)
        match[(column < 0) | (column >= len(doc))] = big
        skip = np.append(cost[1:] + 1, big)
        skip_start = np.append(start[1:], 0)
        take = skip < match
        now, begun = np.where(take, skip, match), np.where(take, skip_start, start)
        # doc characters between: the least of now[e] + (d - e) for e <= d
        rest = now - ramp
        least = np.minimum.accumulate(rest)
        source = np.maximum.accumulate(np.where(rest == least, ramp, 0))
        cost, start = least + ramp, begun[source]
        if cost.min() > budget:
            return None
    d = int(np.argmin(cost))
    end = first + d + len(item)
    return (int(start[d]), int(end), int(cost[d])) if cost[d] <= budget and 0 <= start[d] < end <= len(doc) else None


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, q: int = 10, edits: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """docs with hits: the benchmark items that occur in the text within edits * length edits, with place and edits.

    benchmark (item_id, text) is searched in blocks of about block_chars characters, whose index takes some 32 bytes a character, so that one block's index is in memory
    at a time. Each block reads the texts once and writes only hits, by a digest of the text; the last block's search and a join with the hits of the others make the result.
    Null and empty texts have no hits; texts of any length are searched whole. Null items and those without letters or digits are left out; items of fewer than q
    characters as compared are found as whole words, unchanged; equal items are all named, and of several texts under one item_id the best occurrence is given; repeated
    rows stay; empty tables give empty results or no hits; a column named hits is replaced. Of an item's occurrences the one with the fewest edits is given, then the
    leftmost. Starts and ends count code points of the lower-cased text.
    """
    lean_batches(docs.sparkSession)
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    docs, digest, written = docs.drop("hits"), F.sha2("text", 256).alias("__text"), []
    for block in range(blocks):
        part = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block))
        search = _searcher(Items(sorted((r.item_id, r.text) for r in part.select("item_id", "text").collect()), q, edits))
        if block < blocks - 1:
            hits = docs.select("text", search(F.col("text")).alias("hits")).where(F.size("hits") > 0)
            written.append(materialize(hits.select(digest, "hits").groupBy("__text").agg(F.first("hits").alias("hits")), "hits"))
    if not written:
        return docs.withColumn("hits", search(F.col("text")))
    before = materialize(reduce(DataFrame.unionByName, written).groupBy("__text").agg(F.flatten(F.collect_list("hits")).alias("__before")), "hits")
    discard(*written)
    joined = docs.withColumn("__text", digest).join(before, "__text", "left")
    both = F.concat(F.coalesce("__before", F.array().cast(HITS)), search(F.col("text")))
    return joined.withColumn("hits", both).withColumn("hits", _best(F.col("hits"))).drop("__text", "__before")


def _best(hits: Column) -> Column:
    """One hit an item: of those with the fewest edits the leftmost. A document's hits are few."""
    rivals = lambda x: F.exists(hits, lambda y: (y.item_id == x.item_id) & (F.struct(y.edits, y.start, y.end) < F.struct(x.edits, x.start, x.end)))
    return F.array_sort(F.array_distinct(F.filter(hits, lambda x: ~rivals(x))))


def _searcher(index: Items):
    @F.pandas_udf(HITS)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([index.search(t) for t in s])

    return search.asNondeterministic()  # a filter on the hits must not search twice
