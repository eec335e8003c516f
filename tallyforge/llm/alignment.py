"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of either side tile a text's bytes. B's tokens make a static interval index, their sorted starts and ends; each A token stabs it by bisection, which lists the B tokens that
it overlaps. A gap between A tokens that no B token spans ends a group. Token pairs that end together are links; their counts over all documents are combined in each task before
they are shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches, materialize

#: Where the public vocabularies are on every machine.
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: the pattern that cuts a text before A's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pair counts go to every worker while there are at most so many, at 17 bytes each; beyond, they are joined.
BROADCAST_PAIRS = 4_000_000
#: So many links are gathered in a task before they are combined.
GATHERED = 1 << 21

ALIGNED = "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin characters stand for themselves, the other bytes are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """A vocabulary's tokens as bytes, and their lengths by id."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)

    def whole(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == raw


class ByteLevel(Tokens):
    """A byte-level BPE file. Where its ids are the ranks of its merges, a faster engine makes the same tokens from them; else, and for a text that this engine refuses, the file's own."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to = byte_of()
        ranks = {bytes(to[c] for c in token): i for token, i in model["vocab"].items()}
        pieces = [b""] * self.own.get_vocab_size()
        for piece, i in ranks.items():
            pieces[i] = piece
        super().__init__(pieces)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        self.fast = None
        if [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))):
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text) if self.fast else self.own.encode(text, add_special_tokens=False).ids
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  the engine's panics are no Exceptions
            return self.own.encode(text, add_special_tokens=False).ids


class Pieces(Tokens):
    """A sentence-piece file; it adds the leading space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        super().__init__([bytes([int(p[3:-1], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(f"{folder}/{A_FILE}"), Pieces(f"{folder}/{B_FILE}")


@dataclass(frozen=True)
class Alignment:
    """Ids of either side; for each A token the first and last B token that it overlaps; where groups end, in tokens of either side."""

    a: np.ndarray
    b: np.ndarray
    first: np.ndarray
    last: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    together: np.ndarray

    def links(self) -> np.ndarray:
        """The id pairs of tokens that end together, A's in the upper half."""
        return (self.a[self.together] << 32) | self.b[self.last[self.together]]


def align(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """Aligns tokens that tile the same bytes; none of them is empty."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    a_starts, b_starts = a_ends - a_lengths, b_ends - b_lengths
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left") - 1
    unspanned = np.append(first[1:] > last[:-1], np.ones(min(1, len(a)), bool))
    cuts = np.flatnonzero(unspanned)
    together = np.flatnonzero(b_ends[last] == a_ends)
    return Alignment(a, b, first, last, cuts + 1, last[cuts] + 1, together)


def align_text(text: str | None, folder: str = FOLDER) -> Alignment | None:
    """The alignment of space and text; None for a text that is null, empty or not what either side's tokens spell."""
    if not text:
        return None
    one, two = tokenizers(folder)
    raw = f" {text}".encode()
    a, b = one.encode(f" {text}"), two.encode(text)
    if not a or not b or not one.whole(a, raw) or not two.whole(b, raw):
        return None
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return align(a, b, one.lengths[a], two.lengths[b])


@lru_cache(maxsize=1)
def _written_ids() -> tuple[np.ndarray, np.ndarray]:
    """Every id of up to 16 bits with each separator, as bytes of one width, and their lengths."""
    text = [f"{i}{s}" for i in range(1 << 16) for s in ",|;"]
    lengths = np.array([len(t) for t in text])
    return np.frombuffer("".join(t.ljust(6) for t in text).encode(), np.uint8).reshape(-1, 6), lengths


def written_groups(x: Alignment) -> bytes:
    """Groups as `a1,a2|b1;a3|b2,b3`."""
    a_sizes, b_sizes = np.diff(x.a_cuts, prepend=0), np.diff(x.b_cuts, prepend=0)
    group = np.arange(len(x.a_cuts))
    a_group, b_group = np.repeat(group, a_sizes), np.repeat(group, b_sizes)
    a_at, b_at = np.arange(len(x.a)) + (x.b_cuts - b_sizes)[a_group], np.arange(len(x.b)) + x.a_cuts[b_group]
    rows = np.empty(len(x.a) + len(x.b), np.int64)
    rows[a_at], rows[b_at] = x.a * 3, x.b * 3
    rows[a_at[x.a_cuts - 1]] += 1
    rows[b_at[x.b_cuts - 1]] += 2
    table, lengths = _written_ids()
    return table[rows][np.arange(6) < lengths[rows][:, None]].tobytes()[:-1]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _aligner(folder: str):
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, pairs, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                x = align_text(text, folder)
                links, n = np.unique(x.links(), return_counts=True) if x else (np.zeros(0, np.int64),) * 2
                pairs.append(links)
                times.append(n)
                counts.append((len(x.a), len(x.b), len(x.a_cuts), len(x.together), int((x.last - x.first + 1).sum())) if x else (0,) * 5)
                digests.append(hashlib.sha256(written_groups(x)).hexdigest() if x else "")
            own = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [()] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *own, pa.array(digests, pa.string()), _lists(pairs), _lists(times)], names=names)

    return run


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in order of keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[at], np.add.reduceat(values[order], at) if len(at) else values[:0]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links by pair."""
    held, rest, n = (np.zeros(0, np.int64),) * 2, [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate([held[i], *(r[i] for r in rest)]) for i in (0, 1)))

    for batch in batches:
        rest.append((_values(batch.column("pairs")), _values(batch.column("times"))))
        n += len(rest[-1][0])
        if n > GATHERED:
            held, rest, n = fold(), [], 0
        if len(held[0]) > GATHERED:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])
            held = (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in fold()], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """The corpus-wide count of each linked id pair, and whether it is its B id's highest: pair, n, best."""
    counts = aligned.select("pairs", "times").mapInArrow(_combined, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("_b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    most = counts.groupBy("_b").agg(F.max("n").alias("_most"))
    return counts.join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, n_best bigint, count_sum bigint"


def _scorer(counts):
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = counts.value
        for batch in batches:
            at, times = np.searchsorted(keys, _values(batch.column("pairs"))), _values(batch.column("times"))
            ends = np.cumsum(pa.compute.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False))
            sums = [np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])] for v in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), *(pa.array(np.diff(s).astype(np.int64)) for s in sums)], names=names)

    return run


def align_tokens(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """docs (text) with a_ids, b_ids and where their groups end, a_cuts and b_cuts; all empty for texts without tokens."""

    @F.pandas_udf("a_ids array<bigint>, b_ids array<bigint>, a_cuts array<bigint>, b_cuts array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [align_text(t, folder) for t in texts]
        none = np.zeros(0, np.int64)
        return pd.DataFrame({f"{name}{end}": [getattr(x, f"{name}{kind}") if x else none for x in found] for kind, end in (("", "_ids"), ("_cuts", "_cuts")) for name in ("a", "b")})[["a_ids", "b_ids", "a_cuts", "b_cuts"]]

    return docs.withColumn("_t", run("text")).select(*[c for c in docs.columns if c not in ("a_ids", "b_ids", "a_cuts", "b_cuts")], "_t.*")


def align_corpus(docs: DataFrame, *, folder: str = FOLDER, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """How two tokenizers' tokens meet in each document (doc_id, text), with the links' counts over all documents.

    Texts are encoded once; what the second pass needs, a document's linked pairs, is written to the shared folder. Texts that are null, empty or not spelt by either side's tokens have zeros and
    an empty digest. Texts of any length are encoded whole, repeated rows and null doc_ids stay, other columns are ignored, and an empty table gives an empty result. The
    vocabularies are read from `folder` on every machine. Up to broadcast_pairs different pairs go to every worker; beyond, documents' pairs are joined with the counts.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    aligned = materialize(rows.mapInArrow(_aligner(folder), ALIGNED), "aligned")
    counts = materialize(pair_counts(aligned), "counts")
    if counts.count() <= broadcast_pairs:
        table = counts.toArrow().sort_by("pair")
        arrays = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
        return aligned.drop("row").mapInArrow(_scorer(spark.sparkContext.broadcast(arrays)), SCORED)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("t"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")}).select(*[c.split()[0] for c in SCORED.split(", ")])
