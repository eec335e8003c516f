"""A trie of conversations' shared beginnings by family-first merging.

A family is a base conversation and those whose ids name it as their base. Turns are reduced to digests and lengths first, so no text is shuffled. Families are cogrouped with
the first turns of their base, rebuilt and built into small tries, and only these tries' nodes are shuffled again and merged by the digest of what leads to them.

Sums over subtrees need no walk over the merged trie. A node belongs to the family of its smallest member, which has all nodes above it in its own trie: each family sums what
belongs to it, and the families' sums are added by node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: A rebuilt conversation takes fewer of its base's turns than this; ids of one base share all but their last two digits.
HEADS, FAMILY = 6, 100
ROOT = bytes(16)
NODE = "family bigint, key binary, parent binary, depth bigint, length bigint, conv_id bigint, n_convs bigint, text_sum bigint, ends array<bigint>"
#: So many ids of one node are joined into one string.
CHUNK = 10_000


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def head_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turn_digests(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, turn, digest of role and text, code points of the text). Null roles and texts are empty; rows without conv_id are left out."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(whole, 1, 32)).alias("digest"), F.length(text).cast("long").alias("length"))


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["conv_id", "turn", "digest"], na_position="first", kind="stable")


def family_trie(key: tuple, own: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one family. text_sum: over the members, the code points of their turns from this one on."""
    own, heads = _in_order(own), _in_order(heads)
    first = list(zip(heads["digest"], heads["length"], strict=True))
    at, rows, parents = {ROOT: 0}, [[ROOT, None, 0, 0, None, 0, 0, []]], [-1]
    digests, lengths = own["digest"].to_numpy(), own["length"].to_numpy()
    ids = own["conv_id"].to_numpy()
    starts = np.concatenate([np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))[: len(ids)], [len(ids)]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        conv_id = int(ids[a])
        h = head_turns(conv_id)
        turns = first[:h] + list(zip(digests[a + h : b], lengths[a + h : b], strict=True))
        here, path = ROOT, [0]
        for depth, (digest, length) in enumerate(turns, 1):
            here, above = hashlib.blake2b(here + digest, digest_size=16).digest(), here
            if here not in at:
                at[here] = len(rows)
                rows.append([here, above, depth, int(length), None, 0, 0, []])
            path.append(at[here])
        left = 0
        for i in reversed(path):
            row = rows[i]
            left += row[3]
            row[4] = conv_id if row[4] is None else row[4]  # members come in ascending order
            row[5] += 1
            row[6] += left
        rows[path[-1]][7].append(conv_id)
    names = [c.split()[0] for c in NODE.split(", ")]
    return pd.DataFrame([(int(key[0]), *r) for r in rows] if len(own) else [], columns=names)


def _owned_below(nodes: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
    """For each node of a family's trie, the childless nodes and the code points of nodes at or below it that belong to the family."""
    childless = dict(zip(owned["key"], owned["childless"], strict=True))
    nodes = nodes.sort_values("depth", ascending=False)
    leaves = {k: int(bool(childless.get(k, False))) for k in nodes["key"]}
    chars = {k: int(n) if k in childless else 0 for k, n in zip(nodes["key"], nodes["length"], strict=True)}
    for k, parent, depth in zip(nodes["key"], nodes["parent"], nodes["depth"], strict=True):
        if depth:
            leaves[parent] += leaves[k]
            chars[parent] += chars[k]
    return pd.DataFrame({"key": list(leaves), "leaves": list(leaves.values()), "chars": [chars[k] for k in leaves]})


def prefix_trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations (conv_id, turn, role, text) as two tables: its nodes (key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens) and where each rebuilt conversation ends (key, conv_id).

    Turns go by turn, null first, and those of one turn by their digest; repeated rows are turns of their own. Null roles and texts are empty, texts of any length are
    digested whole, rows without conv_id are left out, an empty table gives empty tables, and other columns are ignored. conv_id is a node's smallest member; the
    root has depth 0, no parent and no text. saved_tokens sums over the subtree what storing each node once saves in code points.

    A task holds the digests of one family, some 100 bytes a turn: at most 199 conversations, each of them whole. Common beginnings are combined within families, then before the
    shuffle; joins on a node's parent are plain equi-joins, whose large keys Spark splits.
    """
    turns = turn_digests(conversations).withColumn("family", base_of(F.col("conv_id")))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    heads = turns.where(F.col("conv_id") == F.col("family")).withColumn("_n", nth).where(F.col("_n") < HEADS).drop("_n")
    nodes = turns.groupBy("family").cogroup(heads.groupBy("family")).applyInPandas(family_trie, NODE)
    nodes = materialize(nodes, "family-nodes")
    merged = nodes.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "length")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "text_sum")]
    )
    merged = materialize(merged, "merged-nodes")
    children = merged.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialize(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted-nodes")
    owned = counted.select(base_of(F.col("conv_id")).alias("family"), "key", (F.col("n_children") == 0).alias("childless"))
    below = nodes.select("family", "key", "parent", "depth", "length").groupBy("family").cogroup(owned.groupBy("family")).applyInPandas(_owned_below, "key binary, leaves bigint, chars bigint")
    below = below.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("chars").alias("_chars"))
    rows = counted.join(below, "key").withColumn("saved_tokens", F.col("text_sum") - F.col("_chars"))
    above = counted.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    root = counted.agg(F.min("conv_id")).first()[0]  # of the one node that has very many children
    top = rows.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).cast("long"))
    rows = top.unionByName(rows.where("depth >= 2").join(above, "parent"))
    ends = nodes.where(F.size("ends") > 0).select("key", F.explode("ends").alias("conv_id"))
    return rows.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, conv_id) as strings of up to CHUNK ids of one key."""
    names = ["key", "first", "ids"]
    key, ids, done = None, [], []
    for pdf in batches:
        for k, i in zip(pdf["key"], pdf["conv_id"], strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                done.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(int(i))
        yield pd.DataFrame(done, columns=names)
        done = []
    if ids:
        yield pd.DataFrame([(key, ids[0], ",".join(map(str, ids)))], columns=names)


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each key's strings, which come in order; only the running digest is kept."""
    key, digest, done = None, None, []
    for pdf in batches:
        for k, ids in zip(pdf["key"], pdf["ids"], strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(done, columns=["key", "sha256"])
        done = []
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "sha256"])


def end_digests(ends: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, sha256): the SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are sorted by range, so those of one common node spread over tasks, and joined into strings there; a task then digests a node's strings one after another.
    """
    count = (partitions,) if partitions else ()
    chunks = ends.repartitionByRange(*count, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(_joined, "key binary, first bigint, ids string")
    return chunks.repartition(*count, "key").sortWithinPartitions("key", "first").mapInPandas(_digested, "key binary, sha256 string")
