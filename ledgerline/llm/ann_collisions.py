"""Approximate nearest neighbours by counting collisions of one-dimensional projections.

Every vector is scaled to length one and projected onto PROJECTIONS random directions; a
block of at most BLOCK vectors keeps, per direction, its projections in sorted order. A
query opens a window around its own projection in every sorted array; a vector inside is a
collision. The windows widen by virtual rehashing (radius times WIDEN) until at least SHARE
of the block, and K vectors, collide in THRESHOLD of all directions; those vectors are
verified with the exact cosine on the original components, in double precision.

The query set is taken against all rows in blocks: groups of at most QUERIES queries meet
each block in one task, so no task holds more than a block and a group, however the data
are spread. Blocks keep their K best; the best of those are the result.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and rows with a null id, take no part; vectors of another length than the query's are no
candidates. Rows that share an id and differ in the vector are rows of their own, as
candidates and as queries (each has ranks from 1). Rows equal in both are the same query,
answered once, and no candidates of it; for other queries each of them is a candidate. Equal
scores go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
QUERIES = 4096
PROJECTIONS = 64
THRESHOLD = 0.6
SHARE = 0.2
FIRST_RADIUS = 0.4
WIDEN = 1.3
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def directions(dim: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _unit(vectors: np.ndarray) -> np.ndarray:
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / peak
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Block:
    """Sorted projections of a block of vectors. The arrays of all directions lie one after
    another, kept apart by a shift, so that one search finds a window's ends in all."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.copies = ids[order], vectors[order], copies[order]
        self.unit = _unit(self.vectors)
        projected = self.unit @ directions(vectors.shape[1])
        self.reach = 2 * float(np.abs(projected).max()) + 1
        self.count = projected.shape[1]
        # A query may lie further out than every row; windows are clipped to an array's range.
        self.shift = np.arange(self.count) * (2 * self.reach)
        places = np.argsort(projected, axis=0, kind="stable")
        self.sorted = (np.take_along_axis(projected, places, axis=0) + self.shift).T.ravel()
        self.places = np.ascontiguousarray(places.T).ravel()

    def candidates(self, projected: np.ndarray, wanted: int) -> np.ndarray:
        """Places of the vectors that collide often enough with one query."""
        need = int(np.ceil(THRESHOLD * self.count))
        size = len(self.ids)
        collisions = np.zeros(size, np.int64)
        middle = np.searchsorted(self.sorted, np.clip(projected, -self.reach, self.reach) + self.shift)
        low = high = middle
        radius = FIRST_RADIUS
        while True:
            a = np.searchsorted(self.sorted, np.clip(projected - radius, -self.reach, self.reach) + self.shift, "left")
            b = np.searchsorted(self.sorted, np.clip(projected + radius, -self.reach, self.reach) + self.shift, "right")
            fresh = [self.places[x:y] for x, y in zip(a, low)] + [self.places[x:y] for x, y in zip(high, b)]
            collisions += np.bincount(np.concatenate(fresh), minlength=size)
            low, high = a, b
            found = np.flatnonzero(collisions >= need)
            if len(found) >= wanted or len(found) == size:
                return found
            radius *= WIDEN

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
        """Of each query: its place, and id, score and number of rows of those found."""
        unit = _unit(queries)
        projected = unit @ directions(queries.shape[1])
        # One of the vectors may be the query itself.
        wanted = min(len(self.ids), max(k + 1, int(np.ceil(SHARE * len(self.ids)))))
        rows = []
        for q in range(len(query_ids)):
            at = self.candidates(projected[q], wanted)
            same = np.flatnonzero(self.ids[at] == query_ids[q])
            at = np.delete(at, same[(self.vectors[at[same]] == queries[q]).all(axis=1)])
            if not len(at):
                continue
            # Unit vectors tell which can be among the best; those are verified as stored.
            rough = self.unit[at] @ unit[q]
            if len(at) > k:
                at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
            score = cosine(self.vectors[at], queries[q])
            best = np.lexsort((self.ids[at], -score))[:k]
            rows += [(q, int(self.ids[at[i]]), float(score[i]), min(int(self.copies[at[i]]), k)) for i in best]
        return rows


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """dot / (length * length), with each vector scaled first so that nothing overflows.
    Equal vectors get equal scores wherever they lie."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    q = query / np.abs(query).max()
    dot = (v * q).sum(axis=1)
    return dot / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def search(
    rows: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
) -> DataFrame:
    """The k nearest of rows for every row of queries: query_id, rank, vec_id, score."""

    def clean(df: DataFrame, name: str) -> DataFrame:
        vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
        return (
            df.select(F.col(f"`{id_col}`").cast("long").alias(name), vector.alias("v"))
            .where(F.col(name).isNotNull() & usable(F.col("v")))
            .groupBy(name, "v")
            .agg(F.count("*").alias("copies"))
            .withColumn("row", F.xxhash64("v"))
        )

    n_rows, n_queries = rows.count(), queries.count()
    blocks, groups = n_rows // BLOCK + 1, n_queries // QUERIES + 1
    # A block is also cut by dimension, so that its vectors form a matrix.
    base = clean(rows, "vec_id").select(
        "vec_id", "v", "copies", F.size("v").alias("dim"),
        F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
    )
    asked = clean(queries, "query_id").select(
        "query_id", "row", "v", F.size("v").alias("dim"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("query_id", "row"), F.lit(groups)).cast("int").alias("part"),
    )
    keys = ["dim", "block", "part"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), left["copies"].to_numpy())
            right = right.sort_values(["query_id", "row"])
            found = block.nearest(right["query_id"].to_numpy(), np.stack(right["v"].to_numpy()), k)
        out = pd.DataFrame(found, columns=["at", "vec_id", "score", "found"])
        asked_by = right.iloc[out["at"].to_numpy(dtype=np.int64)]
        return out.assign(**{c: asked_by[c].to_numpy() for c in ("query_id", "row")}).drop(columns="at")

    near = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        meet, "query_id long, row long, vec_id long, score double, found long"
    )
    # Equal rows take as many ranks as there are; the best k entries hold the best k rows.
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "found")))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
