"""Near-duplicate classes by Order MinHash.

A text is its whitespace-separated lower-case words. Its k-mers are runs of five words, each labelled with how often it has occurred before, so that a
multiset of k-mers becomes a set. A sketch takes the ELL k-mers least under one hash function and keeps them in text order: two texts agree in
it only if they share these k-mers in the same order, so the sketch is sensitive to edit similarity. A few edits leave a short text hardly any run of five
words, so texts of up to SHORT words are sketched by SHORT_ELL single words in order instead, and texts long enough for a link with such a one by
both. Texts that agree in any sketch are candidates; a banded alignment of their words decides.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, gram_hash, lean_batches, materialize, mix64, word_hashes

SHINGLE = 5
ELL = 2
SHORT = 120
SHORT_ELL = 4
#: A power of two.
SKETCHES = 64
SIMILARITY = 0.8
#: The most words of a text that may be linked with one of SHORT words.
NEAR_SHORT = int(SHORT / SIMILARITY + 1e-9)
#: Texts of a block, and of a tile within it, when a group's texts are judged all with all.
BLOCK = 2048
TILE = 128
PART = 1024
#: Pairs of a tile that are aligned at once, the bits of a column that they may have, and the words up to which texts are.
PAIRS = 1024
ROW_BITS = 1 << 18
LONG = 2048
_seeds = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def occurrence_labels(grams: np.ndarray) -> np.ndarray:
    """A hash of each k-mer and the number of equal ones before it."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(len(grams))
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix64(grams + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def order_sketches(words: np.ndarray) -> list[int]:
    """SKETCHES hashes of ELL ordered k-mers for texts over SHORT words, then as many of SHORT_ELL ordered words for those up to NEAR_SHORT words. The last
    bit tells the two apart. Texts under SHORT_ELL words have none: no edit leaves them alike enough for a link."""
    out = []
    if len(words) > SHORT:
        out += ordered_minima(occurrence_labels(gram_hash(words, SHINGLE)), ELL, 0)
    if SHORT_ELL <= len(words) <= NEAR_SHORT:
        out += ordered_minima(occurrence_labels(words), SHORT_ELL, 1)
    return out


def of_kind(sketches: np.ndarray, kind: int) -> np.ndarray:
    """Those of a text's sketches whose last bit is kind, in the order of the hash functions."""
    return sketches[-SKETCHES:] if kind else sketches[:SKETCHES]


def ordered_minima(labels: np.ndarray, ell: int, kind: int) -> list[int]:
    """For each hash function a hash of the ell least labels in text order, whose last bit is kind."""
    step = max(1, (1 << 18) // len(labels))
    out = np.zeros(SKETCHES, np.uint64)
    for i in range(0, SKETCHES, step):
        h = labels[None, :] * _seeds[i : i + step, None]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.empty((len(h), ell), np.int64)
        for j in range(ell):
            at[:, j] = h.argmin(axis=1)
            h[np.arange(len(h)), at[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        acc = np.zeros(len(h), np.uint64)
        for j in range(ell):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + labels[at[:, j]])
        out[i : i + step] = mix64(acc + _seeds[i : i + step])  # equal under one hash function only
    return (out & ~np.uint64(1) | np.uint64(kind)).view(np.int64).tolist()


def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            low = text.lower() if text else ""
            words = word_hashes(low)
            if not len(words):
                rows.append((None, None, None))
                continue
            digest = hashlib.md5(words.tobytes(), usedforsecurity=False).digest()
            rows.append((digest, (words >> np.uint64(32)).astype(np.uint32).tobytes(), order_sketches(words)))
        yield pd.DataFrame(rows, columns=["digest", "words", "sketches"])


def edit_distance(a: np.ndarray, b: np.ndarray, bound: int) -> int | None:
    """The number of word edits between a and b, None above bound. What both begin and end with is left out; bands widen fourfold up to the bound."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = (a[len(a) - n :] == b[len(b) - n :])[::-1]
    tail = n if same.all() else int(np.argmin(same))
    left, right = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not left or not right:
        d = max(len(left), len(right))
        return d if d <= bound else None
    band = min(bound, max(256, abs(len(left) - len(right))))
    while (d := banded(left, right, band)) is None and band < bound:
        band = min(bound, 4 * band)
    return d


def banded(a: list[int], b: list[int], band: int) -> int | None:
    """The edit distance if it is at most band: an alignment within the diagonals from -band to band, one column of them at a time.

    A column is held as two integers whose bits say where its values rise or fall by one from row to row (Hyyrö's banded form of Myers' algorithm), so a step is a
    few operations on 2 * band + 1 bits. Bit t of the column of b[j] is row j - band + t.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    full, top = (1 << (2 * band + 1)) - 1, 2 * band
    rows: dict[int, tuple[int, int]] = {}  # the rows in the band so far that hold a word, as bits counted from a base

    def enter(i: int) -> None:
        bits, base = rows.get(a[i], (0, i))
        rows[a[i]] = bits | 1 << (i - base), base

    for i in range(min(band, n)):
        enter(i)
    rise, fall, cost = full ^ ((1 << band) - 1), 0, min(band, n)
    for j, word in enumerate(b):
        if j + band < n:
            enter(j + band)
        low, equal = j - band, 0
        if found := rows.get(word):
            bits, base = found
            if base < low:
                bits, base = bits >> (low - base), low
                rows[word] = bits, base
            equal = bits << (base - low)
        flat = ((((equal & rise) + rise) ^ rise) | equal | fall) & full  # no change along the diagonal
        right_rise, right_fall = fall | (full & ~(flat | rise)), flat & rise
        if j + band < n:
            cost += not flat >> top & 1
            if cost > 2 * band + m - n:
                return None
        else:
            last = n - 1 - low
            cost += (right_rise >> last & 1) - (right_fall >> last & 1)
        flat >>= 1
        rise, fall = right_fall | (full & ~(flat | right_rise)), flat & right_rise
    return cost if cost <= band else None


def within(a: list[np.ndarray], b: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """Whether each of a and its partner in b are at most their bound of edits apart: the alignments of banded for all pairs at once, a column of each at a time.

    The columns' bits lie in 64-bit words, in a band as wide as the largest bound needs. Where a pair ends is on one diagonal from its start, along which values
    never fall: they are counted up there, and pairs beyond their bound are left out from time to time. No two lengths may differ by more than their bound.
    """
    a, b = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    n, m = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    band = int(bounds.max())
    width = 64 * (band // 32 + 1)
    columns = int(m.max())
    short = np.zeros((columns, len(b)), np.uint32)
    for k, y in enumerate(b):
        short[: len(y), k] = y
    before = next(v for v in range(columns * len(b) + 1) if not (short == v).any())  # equal to no word of b
    long = np.full((len(a), band + int(n.max()) + width), before, np.uint32)
    for row, x in zip(long, a, strict=True):
        row[band : band + len(x)] = x
    rise = np.tile(np.packbits(np.arange(width) >= band, bitorder="little").view(np.uint64), (len(a), 1))
    fall = np.zeros_like(rise)
    one, top = np.uint64(1), np.uint64(63)
    cost, place, live = n - m, n - m + band, np.arange(len(a))
    out = np.zeros(len(a), bool)
    for j in range(columns):
        equal = np.packbits(long[:, j : j + width] == short[j][:, None], axis=1, bitorder="little").view(np.uint64)
        hit = equal & rise
        flat, carry = hit + rise, np.zeros(len(hit), np.uint64)
        for k in range(flat.shape[1]):
            flat[:, k] += carry
            carry = (hit[:, k] | (rise[:, k] & ~flat[:, k])) >> top
        flat ^= rise
        flat |= equal
        flat |= fall
        right_rise, right_fall = fall | ~(flat | rise), flat & rise
        cost = cost + ((flat[np.arange(len(flat)), place >> 6] >> (place & 63).astype(np.uint64) & one == 0) & (j < m))
        onward = flat >> one
        onward[:, :-1] |= flat[:, 1:] << top
        rise, fall = right_fall | ~(onward | right_rise), onward & right_rise
        if j % 16 == 15 and np.count_nonzero(keep := cost <= bounds) < 0.75 * len(keep):
            long, rise, fall, short = long[keep], rise[keep], fall[keep], short[:, keep]
            cost, place, live, m, bounds = cost[keep], place[keep], live[keep], m[keep], bounds[keep]
            if not len(live):
                break
    out[live[cost <= bounds]] = True
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the multisets' intersection."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(values)
    return int(np.minimum(np.bincount(at[: len(a)], minlength=n), np.bincount(at[len(a) :], minlength=n)).sum())


def may_align(a: np.ndarray, b: np.ndarray, bound: int) -> bool:
    """False only if more than bound edits are needed: an edit changes at most q of the longer text's runs of q words, so the others are in both texts.

    Long texts of one language have most words in common by chance, but few runs of words.
    """
    longer = max(len(a), len(b))
    for q in (4, 3, 1):
        need = longer - q + 1 - q * bound
        if need > 0 and (min(len(a), len(b)) < q or common(a if q == 1 else gram_hash(a, q), b if q == 1 else gram_hash(b, q)) < need):
            return False
    return True


def anchored_edits(a: np.ndarray, b: np.ndarray) -> int:
    """The edits of an alignment through the five-word runs that both texts have, the n-th of one kind with the n-th, as far as they rise together: no
    less than the edit distance."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < SHINGLE:
        return longer
    x, y = occurrence_labels(gram_hash(a, SHINGLE)), occurrence_labels(gram_hash(b, SHINGLE))
    _, at_a, at_b = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    if not len(at_a):
        return longer
    if (np.diff(at_b) < 0).any():
        rising = longest_rising(at_b.tolist())
        at_a, at_b = at_a[rising], at_b[rising]
    step_a, step_b = np.diff(at_a, append=len(a)), np.diff(at_b, append=len(b))
    between = np.maximum(step_a, step_b) - np.minimum(np.minimum(step_a, step_b), SHINGLE)
    return int(max(at_a[0], at_b[0]) + between.sum())


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence (patience sorting)."""
    tops, places, before = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        before.append(places[k - 1] if k else -1)
        tops[k : k + 1], places[k : k + 1] = [v], [i]
    out, i = [], places[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def alike(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two word sequences align with at most (1 - SIMILARITY) * the longer one's length edits."""
    out = []
    for x, y in zip(left, right, strict=True):
        a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        out.append(linked(a, b, int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)))
    return pd.Series(out, dtype=bool)


def linked(a: np.ndarray, b: np.ndarray, bound: int) -> bool:
    """An alignment through common runs settles most pairs within the bound; the others are aligned in bands."""
    if abs(len(a) - len(b)) > bound:
        return False
    return anchored_edits(a, b) <= bound or (may_align(a, b, bound) and edit_distance(a, b, bound) is not None)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """The number of common labels of each of left with each of right; occurrence labels give common."""
    sides = [(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])) for rows in (left, right)]
    both = np.intersect1d(*(np.unique(x) for x, _ in sides), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out.astype(np.int64)
    places = []
    for x, row in sides:
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        known = both[at] == x
        places.append((at[known], row[known]))
    for start in range(0, len(both), columns):
        width = min(columns, len(both) - start)
        marks = []
        for rows, (at, row) in zip((left, right), places, strict=True):
            mark = np.zeros((len(rows), width), np.float32)
            here = (at >= start) & (at < start + width)
            mark[row[here], at[here] - start] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out.astype(np.int64)


def labelled(words: np.ndarray, q: int) -> np.ndarray:
    return occurrence_labels(gram_hash(words, q)) if len(words) >= q else np.zeros(0, np.uint64)


#: Texts of a block: roots, words and a row of sketches of one kind each.
Side = tuple[list[bytes], list[np.ndarray], np.ndarray]


def block_links(sketch: int, left: Side, right: Side, same: bool) -> list[tuple[bytes, bytes]]:
    """Links (roots) between texts of two blocks, or within one, whose pair belongs to this sketch: of the sketches that two texts share, a hash of both
    picks the one in whose group they are judged, so that groups of the same texts divide the pairs. All pairs are judged but those that links connect already.

    Pairs are taken by tiles, in which the counts of may_align are matrix products over the runs of words that both sides have: runs of four, which few texts
    have in common by chance, then runs of three for the pairs that are left.
    """
    numbers: dict[bytes, int] = {}
    at = [np.array([numbers.setdefault(r, len(numbers)) for r in side[0]], np.int64) for side in (left, right)]
    roots, label = list(numbers), np.arange(len(numbers))
    words, sketches = (left[1], right[1]), (left[2], right[2])
    known: dict[tuple[int, int, int], np.ndarray] = {}

    def runs(side: int, text: int, q: int) -> np.ndarray:
        if (side, text, q) not in known:
            known[side, text, q] = labelled(words[side][text], q)
        return known[side, text, q]

    found = []
    for i in range(0, len(words[0]), TILE):
        for j in range(i if same else 0, len(words[1]), TILE):
            a, b = words[0][i : i + TILE], words[1][j : j + TILE]
            root_a, root_b = at[0][i : i + TILE], at[1][j : j + TILE]
            size_a, size_b = np.array([len(w) for w in a])[:, None], np.array([len(w) for w in b])[None, :]
            longer = np.maximum(size_a, size_b)
            bound = ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
            fit = (np.abs(size_a - size_b) <= bound) & (label[root_a][:, None] != label[root_b][None, :])
            if same and i == j:
                fit = np.triu(fit, 1)
            if fit.any():
                x, y = sketches[0][i : i + TILE], sketches[1][j : j + TILE]
                turn = ((x[:, 0, None] ^ y[None, :, 0]) >> 1 & (SKETCHES - 1)).astype(np.uint8)
                rank = np.where(x[:, None, :] == y[None, :, :], np.arange(SKETCHES, dtype=np.uint8) ^ turn[:, :, None], np.uint8(255))
                fit &= np.take_along_axis(np.broadcast_to(x[:, None, :], rank.shape), rank.argmin(axis=2)[:, :, None], axis=2)[:, :, 0] == sketch
            for q in (4, 3):
                rows, columns = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
                if len(rows):
                    need = (longer - q + 1 - q * bound)[np.ix_(rows, columns)]
                    fit[np.ix_(rows, columns)] &= shared_counts([runs(0, i + m, q) for m in rows], [runs(1, j + n, q) for n in columns]) >= need
            rows, columns = np.nonzero(fit)
            at_once = max(1, min(PAIRS, ROW_BITS // max(1, int(bound.max()))))
            for start in range(0, len(rows), at_once):
                m, n = rows[start : start + at_once], columns[start : start + at_once]
                apart = label[root_a[m]] != label[root_b[n]]
                m, n = m[apart], n[apart]
                if not len(m):
                    continue
                if longer[m, n].max() <= LONG:
                    ok = within([a[k] for k in m], [b[k] for k in n], bound[m, n])
                else:
                    ok = np.array([linked(a[k], b[l], int(bound[k, l])) for k, l in zip(m, n, strict=True)])
                for k, l in zip(m[ok], n[ok], strict=True):
                    if label[root_a[k]] != label[root_b[l]]:
                        found.append((roots[root_a[k]], roots[root_b[l]]))
                        label[label == label[root_b[l]]] = label[root_a[k]]
    return found


def remaining_links(grouped: DataFrame, roots: DataFrame, tokens: DataFrame) -> DataFrame:
    """The links that heads leave out: columns a and b, roots of different components. grouped: sketch, head, node, without the heads' own rows.

    A group's texts outside its head's component are judged with each other and with those inside, the head excepted, which has been judged with all. A link's lengths
    differ by a fifth at most, so texts go by classes of length, each a quarter wider than the one below: a group is split into the texts of one class, with those
    of the class below. Both kinds, apart and inside, are dealt out in blocks of about BLOCK texts, and each pair of blocks is one group of rows, so rows grow by one for each
    further block and not by pairs of texts.
    """
    key = ["sketch", "class"]
    of_node = roots.select("node", F.col("root").alias("_of_node"))
    of_head = roots.select(F.col("node").alias("head"), F.col("root").alias("_of_head"))
    sizes = tokens.select(F.col("digest").alias("node"), F.floor(F.log(F.octet_length("words") / 4 + 0.5) / F.log(F.lit(1 / SIMILARITY))).cast("int").alias("_own"))
    root = F.coalesce("_of_node", "node")
    members = grouped.join(of_node, "node", "left").join(of_head, "head", "left").join(sizes, "node")
    members = members.select("sketch", "node", root.alias("root"), (root != F.coalesce("_of_head", "head")).alias("apart"), F.posexplode(F.array("_own", F.col("_own") + 1)).alias("lower", "class"))
    members = materialize(members, "members")
    n_apart, n_inside = F.count_if("apart"), F.count_if(~F.col("apart"))
    sizes = members.groupBy(*key).agg(n_apart.alias("_apart"), n_inside.alias("_inside"), F.count_if(F.col("lower") == 0).alias("_upper")).where("_apart > 0 and _upper > 0 and _apart + _inside > 1")
    # a group of at most BLOCK texts is one block; in others, blocks of texts apart come first, and two blocks meet unless both hold texts inside
    whole = F.col("_apart") + F.col("_inside") <= BLOCK
    apart = F.when(whole, 1).otherwise(F.ceil(F.col("_apart") / BLOCK)).cast("int")
    inside = F.when(whole, 0).otherwise(F.ceil(F.col("_inside") / BLOCK)).cast("int")
    place = F.xxhash64("node")
    dealt = members.join(sizes, key).withColumn("block", F.when(F.col("apart") | whole, F.pmod(place, apart)).otherwise(apart + F.pmod(place, inside)).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("apart") | whole, apart + inside).otherwise(apart) - 1)
    others = F.transform(others, lambda j: F.struct(F.least(j, "block").alias("x"), F.greatest(j, "block").alias("y")))
    columns = ("sketch", "class", "x", "y", "block", "lower", "root", "words", "sketches")
    tasks = dealt.withColumn("_task", F.explode(others)).withColumn("x", F.col("_task.x")).withColumn("y", F.col("_task.y"))
    # many groups are small: about PART rows are judged in one call
    total = sizes.agg(F.sum((F.col("_apart") + F.col("_inside")) * (apart + inside))).first()[0]
    texts = tasks.join(tokens, tasks.node == tokens.digest).withColumn("part", F.pmod(F.xxhash64("sketch", "class", "x", "y"), F.lit((total or 0) // PART + 1))).select("part", *columns)

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.stack([rows[c].to_numpy(np.int64) for c in columns[:4]])
        block, lower = rows["block"].to_numpy(), rows["lower"].to_numpy()
        root, words, sketches = list(rows["root"]), [np.frombuffer(w, np.uint32) for w in rows["words"]], np.stack([of_kind(s, k & 1) for s, k in zip(rows["sketches"], keys[0].tolist(), strict=True)])
        order = np.lexsort(keys)
        edges = np.flatnonzero((np.diff(keys[:, order], axis=1) != 0).any(axis=0)) + 1
        found = []
        for group in np.split(order, edges):
            sketch, _, x, y = keys[:, group[0]]
            sides = {}
            for at in {int(x), int(y)}:
                for k in (0, 1):
                    own = group[(block[group] == at) & (lower[group] == k)]
                    sides[at, k] = [root[i] for i in own], [words[i] for i in own], sketches[own]
            found += block_links(sketch, sides[x, 0], sides[y, 0], x == y) + block_links(sketch, sides[x, 0], sides[y, 1], False)
            if x != y:
                found += block_links(sketch, sides[x, 1], sides[y, 0], False)
        return pd.DataFrame(found, columns=["a", "b"])

    return texts.groupBy("part").applyInPandas(judge, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """A root for each linked node, the same throughout its component: node, root. links has columns a and b.

    Each round a node takes the least of itself and its neighbours (an aggregate) and then that node's choice; links are carried over to the chosen nodes and those within one
    are dropped, so they dwindle from round to round. Every round is written to the shared folder; nothing is gathered on the driver.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    found = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = materialize(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "step")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = materialize(step.join(up, "root").select("node", F.col("up").alias("root")), "step")
        if found is None:
            found = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = materialize(found.join(onward, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        left, right = step.select(F.col("node").alias("a"), F.col("root").alias("x")), step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        carried = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = materialize(carried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of near-duplicates: doc_id, class_id (the least doc_id of the class), class_size; one row a row of docs.

    Texts with the same words are copies and count once from there on. Candidates are linked if their words align with an edit similarity of 0.8 or more (at
    most 0.2 edits a word of the longer text); a class is a component of links. Texts over 120 words that share a part J of their five-word shingles are candidates
    with a probability of about 1 - (1 - J**2)**64: all but one in 10**28 at J = 0.8, and 0.92 at J = 0.2, which is about what edits of single words leave at
    the similarity of 0.8. Shorter ones that share a part J of their words, in one order, are with about 1 - (1 - J**4)**64: 0.98 and more at J = 0.5, the least that
    a link of five words leaves. A group of one sketch is compared with the text that a hash puts first. What these links leave in
    different components is then judged exactly (remaining_links), so no link between texts that share a sketch is lost.

    A text that is null or has no words is a class of its own row; one of fewer than four words has only copies, as any edit leaves it less alike, and one of four is linked with texts of five that add a word. Texts of any length are aligned
    whole: in bands of bits, a text of n words in n steps on at most 0.4 n bits, and only where counts of words and of runs of three and four allow a link. A null
    doc_id counts as the largest; repeated rows are copies; an empty table gives an empty result; other columns are ignored.
    """
    lean_batches(docs.sparkSession)
    base = materialize(docs.select("doc_id", F.pandas_udf(sketched, "digest binary, words binary, sketches array<bigint>")(F.col("text")).alias("s")).select("doc_id", "s.digest", "s.words", "s.sketches"), "sketched")
    texts = base.where(F.size("sketches") > 0).groupBy(F.col("digest").alias("node")).agg(F.first("sketches").alias("sketches"))
    members = materialize(texts.select("node", F.explode("sketches").alias("sketch")), "sketches")
    twice = members.groupBy("sketch").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sketch")
    shared = materialize(members.join(twice, "sketch", "left_semi"), "shared")
    place = F.struct(F.xxhash64("node"), "node")
    first = shared.groupBy("sketch").agg(F.min(place).alias("_first")).select("sketch", F.col("_first.node").alias("head"))
    grouped = materialize(shared.join(first, "sketch").where(F.col("node") != F.col("head")), "grouped")
    needed = grouped.select("node").union(grouped.select("head")).distinct()
    tokens = base.select("digest", F.struct("words", "sketches").alias("t")).join(needed, base.digest == needed.node, "left_semi")
    tokens = materialize(tokens.groupBy("digest").agg(F.first("t").alias("t")).select("digest", "t.*"), "tokens")
    judged = materialize(_judge(grouped.select("head", "node").distinct(), tokens), "judged")
    roots = components(judged.where("ok").select(F.col("head").alias("a"), F.col("node").alias("b")))
    further = materialize(remaining_links(grouped, roots, tokens), "links")
    placed = base.select("doc_id", "digest").join(roots, base.digest == roots.node, "left").select("doc_id", F.coalesce("root", "digest").alias("_class"))
    if further.limit(1).count():
        onward = components(further).select(F.col("node").alias("_class"), "root")
        placed = placed.join(onward, "_class", "left").select("doc_id", F.coalesce("root", "_class").alias("_class"))
    placed = materialize(placed, "placed")
    discard(base, members, shared, grouped, tokens, judged, further)
    classes = placed.where(F.col("_class").isNotNull()).groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(classes, "_class", "left").select("doc_id", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _judge(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """pairs with ok. Heads may have many pairs, which the first join splits; nodes are spread evenly."""
    left = tokens.select(F.col("digest").alias("head"), F.col("words").alias("_left"))
    right = tokens.select(F.col("digest").alias("node"), F.col("words").alias("_right"))
    return pairs.join(left, "head").join(right, "node").select("head", "node", F.pandas_udf(alike, "boolean")("_left", "_right").alias("ok"))
