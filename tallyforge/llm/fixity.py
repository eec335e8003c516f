"""Merkle fixity audit of archive records: replicas are compared root first, descending into mismatching ranges only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Slots of a leaf range and ranges of a shard: a shard covers FANOUT * FANOUT consecutive record ids.
FANOUT = 32
PARTS = 4


def record_bytes(url: Column, body: Column) -> Column:
    """A record as it is stored: a header line for each field with its length, then the fields. Null and empty differ."""
    field = lambda c: F.concat(F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit("\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), field(url), field(body), F.coalesce(url, F.lit("")), F.lit("\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"))


def combined(digest: str) -> list[Column]:
    """Aggregates that sum a group's SHA-256 digests in PARTS pieces; they don't depend on the order and combine before a shuffle."""
    piece = lambda i: F.conv(F.substring(F.col(digest), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    return [F.sum(piece(i)).cast("decimal(38,0)").alias(f"_p{i}") for i in range(PARTS)]


def sealed(count: str) -> Column:
    """The digest of a group from its count and sums."""
    return F.sha2(F.concat_ws(":", F.col(count).cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(PARTS)]), 256)


def leaves(records: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """One row a record id (a slot): shard, range, slot, n, n_bytes, digest.

    A slot's place in the tree follows from its id alone, so a lost record doesn't move the ones after it. Records that share an
    id share a slot, whose digest covers all of them; those with a null id share one slot in a shard of their own (null).
    """
    data = record_bytes(F.col(url_col), F.col(body_col))
    rows = records.select(F.col(id_col).cast("long").alias("slot"), F.sha2(data, 256).alias("_h"), F.octet_length(data).cast("long").alias("_b"))
    slots = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("_b").alias("n_bytes"), *combined("_h"))
    return slots.select(
        F.floor(F.col("slot") / (FANOUT * FANOUT)).cast("long").alias("shard"), F.floor(F.col("slot") / FANOUT).cast("long").alias("range"), "slot", "n", "n_bytes", sealed("n").alias("digest")
    )


def chained(children: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The level above at most FANOUT children: their digests in order, each with its place and the byte offsets that it takes up below this node."""
    kids = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "n_bytes", "digest")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def link(state: Column, kid: Column) -> Column:
        end = state["at"] + kid["n_bytes"]
        line = F.concat(F.coalesce(kid["place"].cast("string"), F.lit("null")), F.lit("@"), state["at"].cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), kid["digest"], F.lit("\n"))
        return F.struct(end.alias("at"), F.concat(state["text"], line).alias("text"))

    chain = children.groupBy(*keys).agg(F.aggregate(kids, start, link).alias("_c"))
    return chain.select(*keys, F.col("_c.at").alias("n_bytes"), F.sha2("_c.text", 256).alias("digest"))


def root_of(shards: DataFrame) -> DataFrame:
    """The root over any number of shards: each digest is bound to its shard and length, then they are summed."""
    bound = shards.withColumn("_h", F.sha2(F.concat_ws("@", F.coalesce(F.col("shard").cast("string"), F.lit("null")), F.col("n_bytes").cast("string"), F.col("digest")), 256))
    return bound.groupBy(F.lit("/").alias("root")).agg(F.count(F.lit(1)).alias("n"), *combined("_h")).select("root", sealed("n").alias("digest"))


def descend(keys: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    pairs = left.alias("l").join(right.alias("r"), same, "full")
    return pairs.where(~F.col("l.digest").eqNullSafe(F.col("r.digest"))).select(
        *[F.when(F.col("l.digest").isNotNull(), F.col(f"l.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys]
    )


def within(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows below the given nodes. There are as many nodes as mismatches; Spark broadcasts them if they are few."""
    return rows.alias("x").join(keys.alias("k"), [F.col(f"x.{k}").eqNullSafe(F.col(f"k.{k}")) for k in on], "left_semi")


def merkle_audit(primary: DataFrame, replica: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Audits a replica of a record collection.

    Returns the primary's leaves with the byte offsets of their slots within the shard, and the damaged slots:
    slot, n_primary, n_replica, status (`corrupt`: as many records with other bytes; `missing`: fewer; `extra`: more).

    Each side is a tree: record digests in slots, slots in ranges of 32 ids, ranges in shards of 1,024, shards in a root. A range's and a shard's digest covers its
    children in order with their byte offsets, counted from where it begins, so that damage changes the nodes above it only. Roots are compared first; shards only if the roots differ, ranges in differing shards, slots in differing ranges. Null fields, empty
    records, repeated rows, several records of one id and empty tables have defined digests; other columns are ignored.
    """
    sides = [materialize(leaves(t, id_col, url_col, body_col), "leaves") for t in (primary, replica)]
    ranges = [materialize(chained(x, ["shard", "range"], "slot"), "ranges") for x in sides]
    shards = [materialize(chained(x, ["shard"], "range"), "shards") for x in ranges]
    roots = [root_of(x).collect() for x in shards]  # a row each
    sides_differ = roots[0] != roots[1]
    bad_shards = materialize(descend(["shard"], *[x if sides_differ else x.limit(0) for x in shards]), "bad-shards")
    bad_ranges = materialize(descend(["shard", "range"], *[within(x, bad_shards, ["shard"]) for x in ranges]), "bad-ranges")
    left, right = (within(x, bad_ranges, ["shard", "range"]) for x in sides)
    pairs = left.alias("l").join(right.alias("r"), F.col("l.slot").eqNullSafe(F.col("r.slot")), "full").where(~F.col("l.digest").eqNullSafe(F.col("r.digest")))
    n_left, n_right = F.coalesce(F.col("l.n"), F.lit(0)), F.coalesce(F.col("r.n"), F.lit(0))
    damage = pairs.select(
        F.when(n_left > 0, F.col("l.slot")).otherwise(F.col("r.slot")).alias("slot"),
        n_left.alias("n_primary"),
        n_right.alias("n_replica"),
        F.when(n_left > n_right, "missing").when(n_left < n_right, "extra").otherwise("corrupt").alias("status"),
    )
    upto = F.sum("n_bytes").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return sides[0].withColumn("start_offset", upto - F.col("n_bytes")).withColumn("end_offset", upto), damage
