"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a cell is a pair of centroids. For each query the centroids of a half are ranked by nearness and taken in
runs of RUN. Pairs of runs are visited by the sum of their mean nearness, taken from a heap, until their cells hold enough vectors, and only these vectors are
ranked by their true inner product. How many are enough is measured on vectors that the centroids weren't fitted to.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def usable(vector: Column) -> Column:
    """Not null or zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


#: Centroids of a run; runs of a half are numbered in one byte.
RUN = 16


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means with seeded starts, ordered along the centroids' main direction, so that neighbours tend to be near each other."""
    rng = np.random.default_rng(0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        held = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[held > 0] = sums[held > 0] / held[held > 0, None]
    return c[np.argsort(c @ np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0], kind="stable")]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin((c * c).sum(axis=1)[None, :] - 2 * x[at : at + 4096] @ c.T, axis=1)
    return out


def runs_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids from near to far, the number of each one's run, and the runs' mean nearness."""
    order = np.argsort(-near, kind="stable")
    run = np.empty(len(near), np.uint8)
    run[order] = np.arange(len(near)) // RUN
    starts = np.arange(0, len(near), RUN)
    return order, run, np.add.reduceat(near[order], starts) / np.diff(np.append(starts, len(near)))


def visit(near1: np.ndarray, near2: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visits pairs of runs by falling sum of mean nearness until their cells hold wanted vectors. counts[i, j] is the size of cell (i, j).

    Returns the run of each first centroid, that of each second one, and for each first run how many second runs are visited with it.
    """
    (a, run1, mean1), (b, run2, mean2) = runs_of(near1), runs_of(near2)
    size = np.add.reduceat(np.add.reduceat(counts[a][:, b], np.arange(0, len(b), RUN), axis=1), np.arange(0, len(a), RUN), axis=0).tolist()
    first, second = mean1.tolist(), mean2.tolist()
    reach = np.zeros(len(first), np.uint8)
    heap, held = [(-(first[0] + second[0]), 0, 0)], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        held += size[i][j]
        reach[i] = j + 1
        if j + 1 < len(second):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
    return run1, run2, reach


def share_for(recall: float, x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, queries: int = 400) -> float:
    """The share of vectors nearest by their cells that holds `recall` of the k nearest of each of some queries: measured on x."""
    half, n = c1.shape[1], len(x)
    cell1, cell2 = nearest(x[:, :half], c1), nearest(x[:, half:], c2)
    places = []
    for i in range(min(queries, n)):
        exact, by_cell = x @ x[i], (c1 @ x[i, :half])[cell1] + (c2 @ x[i, half:])[cell2]
        exact[i] = -np.inf
        top = np.argpartition(-exact, min(k, n - 1) - 1)[: min(k, n - 1)]
        places.append((by_cell[None, :] >= by_cell[top, None]).mean(axis=1))
    return float(np.quantile(np.concatenate(places), recall)) if places and n > 1 else 1.0


def best(scores: np.ndarray, slack: float, vectors: np.ndarray, at: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k best of the rows `at`, by the exact product, one row like another, so that equal vectors tie. Their scores are in single precision and may be off by slack,
    so all rows that may belong to the best are computed anew."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = at[~(scores < bar - 2 * slack)]
    exact = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return [(float(exact[o]), int(ids[at[o]])) for o in order]


def search(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    n_centroids: int = 512,
    sample: int = 20_000,
    recall: float = 0.92,
    part_rows: int = 65_536,
    query_rows: int = 16_384,
) -> DataFrame:
    """The k rows with the largest inner product for each row that `queries` selects, its own id excepted: query_id, rank, vec_id, score.

    Every row is indexed. About `sample` rows chosen by a hash of the id serve for fitting: three quarters for the centroids of both halves (n_centroids, at most one for
    eight of these rows), the others to measure the share of the rows that a query must visit for the wanted recall (all for a recall of 1). That share falls as tables grow, for the k nearest
    are then nearer.

    Rows lie on shelves of consecutive first centroids. A shelf is dealt out in parts of at most about part_rows rows, and a query goes to the shelves that it visits, in blocks of
    query_rows queries, so that neither one common vector nor many queries fill a task. Of a part only the vectors of visited cells are multiplied; each part keeps its k
    best for a query.

    Rows with a null id, an unusable vector or a length other than the commonest (with which there is no inner product) take no part. Of several rows with one id each is a
    candidate, and the least vector is the query. Ties go to the smaller id; with fewer than k candidates all that are visited are returned; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == d)
    own = F.xxhash64(F.lit("centroids"), "vec_id", "v")
    drawn = rows.withColumn("_h", own).where(F.shiftrightunsigned("_h", 11) / float(1 << 53) < sample / total).groupBy("_h").agg(F.min("v").alias("v")).collect()
    drawn = sorted((r["_h"], r.v) for r in drawn) or [(0, rows.agg(F.min("v")).first()[0])]
    x = np.array([v for _, v in drawn])
    half = d // 2 or 1
    fit, test = (x[np.arange(len(x)) % 4 != 3], x[np.arange(len(x)) % 4 == 3]) if len(x) > 3 else (x, x)
    wide = min(n_centroids, 255 * RUN, max(1, len(fit) // 8))
    c1, c2 = centroids(fit[:, :half], wide), centroids(fit[:, half:] if d > 1 else np.zeros((len(fit), 1)), wide)
    share = 1.0 if recall >= 1 else share_for(recall, test if d > 1 else np.pad(test, ((0, 0), (0, 1))), c1, c2, max(1, round(k * len(test) / total)))

    def halves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m[:, :half], m[:, half:] if d > 1 else np.zeros((len(m), 1))

    @F.pandas_udf("c1 int, c2 int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            left, right = halves(np.array(s.tolist(), np.float64).reshape(len(s), d))
            yield pd.DataFrame({"c1": nearest(left, c1), "c2": nearest(right, c2)})

    index = materialize(rows.withColumn("cell", cell("v")).select("vec_id", "v", "q", "cell.c1", "cell.c2"), "multi-index")
    counts = np.zeros((len(c1), len(c2)), np.int32)
    for r in index.groupBy("c1", "c2").count().collect():  # at most n_centroids ** 2 rows
        counts[r.c1, r.c2] = r["count"]
    wanted = max(int(np.ceil(share * total)), k + 1)
    target = min(part_rows, max(1, -(-total // spark.sparkContext.defaultParallelism)))
    shelf_of = (np.cumsum(counts.sum(axis=1, dtype=np.int64)) - 1).clip(0) // target
    shelf_of = np.unique(shelf_of, return_inverse=True)[1]
    parts_of = np.maximum(1, -(-np.bincount(shelf_of, counts.sum(axis=1)).astype(np.int64) // part_rows))

    asked = index.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    n_asked = asked.count()
    query_parts = max(1, -(-n_asked // query_rows))

    @F.pandas_udf("shelves array<int>, visits binary")
    def probes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            left, right = halves(np.array(s.tolist(), np.float64).reshape(len(s), d))
            out = []
            for a, b in zip(left @ c1.T, right @ c2.T, strict=True):
                run1, run2, reach = visit(a, b, counts, wanted)
                out.append((np.unique(shelf_of[reach[run1] > 0]).tolist(), run1.tobytes() + run2.tobytes() + reach.tobytes()))
            yield pd.DataFrame(out, columns=["shelves", "visits"])

    shelf, parts = F.array(*map(F.lit, shelf_of.tolist())), F.array(*map(F.lit, parts_of.tolist()))
    probing = (
        asked.repartition(min(10_000, max(1, -(-n_asked // 256))), "vec_id")
        .select("vec_id", "v", probes("v").alias("p"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_parts)).cast("int").alias("qp"))
        .select("vec_id", "v", "p.visits", "qp", F.explode("p.shelves").alias("shelf"))
        .withColumn("ep", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("shelf")) - 1)))
    )
    entries = (
        index.select("vec_id", "v", "c1", "c2", F.get(shelf, F.col("c1")).alias("shelf"))
        .withColumn("ep", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.get(parts, F.col("shelf"))).cast("int"))
        .withColumn("qp", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    )

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            e, ids, at1, at2 = np.array(right["v"].tolist(), np.float64), right["vec_id"].to_numpy(), right["c1"].to_numpy(), right["c2"].to_numpy()
            light, longest = e.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", e, e).max())
            for own, v, visits in zip(left["vec_id"], left["v"], left["visits"], strict=True):
                code, v = np.frombuffer(visits, np.uint8), np.asarray(v, np.float64)
                run1, run2, reach = code[: len(c1)], code[len(c1) : len(c1) + len(c2)], code[len(c1) + len(c2) :]
                at = np.flatnonzero((run2[at2] < reach[run1][at1]) & (ids != own))
                score, slack = light[at] @ v.astype(np.float32), 1e-6 * longest * np.linalg.norm(v)
                out += [(own, other, exact) for exact, other in best(score, slack, e, at, ids, v, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["shelf", "ep", "qp"]
    found = probing.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
