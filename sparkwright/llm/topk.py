"""Exact top-k search by MaxScore over integer vectors, in shards.

A query's terms are its non-zero dimensions. A shard of candidates holds postings for every term: which of its rows
have a positive component there and which a negative one, in chunks of CHUNK rows, and the largest and smallest
component of each chunk, which bound what the term can add. A query visits the chunks from the largest bound down. With
the k-th best score so far, theta, the terms of the smallest bounds, whose sum cannot reach it, are non-essential: only
rows that an essential term lists are traversed, and the other terms are probed only for rows that can still reach
theta. Theta rises after each chunk, and when a chunk's bound falls short of it the rest are skipped. Each shard gives
its k best rows to each query, and a merge of the shards keeps k. Where vectors are dense and alike, bounds are loose and most rows are traversed, which costs time, not exactness.

Queries and candidates are dealt into blocks of about CELLS components and every query block meets every candidate
block, so the work is that of an exact search of the stated queries against all rows, and a task holds two blocks.

Scores are exact for all finite components: sums of products that fit 53 bits are taken in floating point, where they
are exact, and those of larger vectors in whole numbers without bounds. A score beyond 64 bits is ranked by its value and
reported as the nearest 64-bit number. Query rows of one id and different vectors give the id the k best rows of both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.shipping import ship

#: Components of a block, about; rows of a chunk of postings.
CELLS, CHUNK = 1 << 21, 1024
#: Integers that are exact in floating point lie below this.
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf))
    return vector.isNotNull() & ~F.exists(vector, bad)


def floor_256(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): as floating point numbers where these are exact, else as whole numbers of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * 256)
    if not len(scaled) or np.abs(scaled).max() < EXACT:
        return scaled
    return np.array([[int(v) * 256 if abs(v) >= EXACT else math.floor(v * 256) for v in row] for row in x.tolist()], object)


class Shard:
    """Postings of rows, with ids in ascending order, so that ties fall to the earlier row."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.traversed = ids[order], rows[order], 0
        self.chunks = [slice(at, at + CHUNK) for at in range(0, len(rows), CHUNK)]
        self.above, self.below = self.rows > 0, self.rows < 0
        self.high = np.array([self.rows[c].max(0) for c in self.chunks])
        self.low = np.array([self.rows[c].min(0) for c in self.chunks])

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows of other ids than the query's; ties to the smaller id."""
        bounds = np.maximum(0, np.where(q > 0, q * self.high, q * self.low))  # of each term in each chunk
        reach = bounds.sum(1)
        best_ids, best = self.ids[:0], self.rows[:0, 0] if self.rows.shape[1] else np.zeros(0)
        theta = None
        for c in np.argsort(-reach, kind="stable").tolist():
            if theta is not None and reach[c] < theta:
                break  # so do all chunks after it
            part = self.chunks[c]
            alive = np.flatnonzero(self.ids[part] != query_id) + part.start
            rest = np.flatnonzero(q != 0)
            scores = np.zeros(len(alive), self.rows.dtype)
            if theta is not None and theta > 0:
                dims = rest[np.argsort(bounds[c][rest], kind="stable")]
                minor = np.cumsum(bounds[c][dims]) < theta
                essential, rest = dims[~minor], dims[minor]
                up, down = essential[q[essential] > 0], essential[q[essential] < 0]
                listed = self.above[alive][:, up].any(1) | self.below[alive][:, down].any(1)
                alive = alive[listed]
                self.traversed += len(alive)
                scores = self.rows[alive][:, essential] @ q[essential]
                good = scores + bounds[c][rest].sum() >= theta
                alive, scores = alive[good], scores[good]
            else:
                self.traversed += len(alive)
            if len(rest) and len(alive):
                scores = scores + self.rows[alive][:, rest] @ q[rest]
            ids, values = np.concatenate([best_ids, self.ids[alive]]), np.concatenate([best, scores])
            first = np.lexsort((ids, -values))[:k]
            best_ids, best = ids[first], values[first]
            theta = best[-1] if len(best) == k else None
        return [(int(i), int(s)) for i, s in zip(best_ids.tolist(), best.tolist(), strict=True)]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of the k best rows for each query, its own id left out; ties to the smaller id.

    Rows and queries whose scores could pass what is exact in floating point are searched on their own in whole numbers.
    """
    out: list[tuple[int, int, int]] = []
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    size = lambda x: np.array([max(map(abs, r), default=0) for r in x.tolist()], object) if x.dtype == object else np.abs(x).max(1, initial=0)
    limit = math.sqrt(EXACT / max(1, rows.shape[1])) / 2
    big_rows, big_queries = np.asarray(size(rows) >= limit, bool), np.asarray(size(queries) >= limit, bool)
    for r in (False, True):
        for q in (False, True):
            of_rows, of_queries = np.flatnonzero(big_rows == r), np.flatnonzero(big_queries == q)
            if len(of_rows) and len(of_queries):
                cast = whole if r or q else lambda x: x.astype(float)
                shard, asked = Shard(ids[of_rows], cast(rows[of_rows])), cast(queries[of_queries])
                out += [(int(i), *found) for i, v in zip(query_ids[of_queries].tolist(), asked, strict=True) for found in shard.search(i, v, k)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query row, exact.

    Vectors that are null, hold null or non-finite components, or have a null id take no part. Vectors of other
    lengths than the query's have no score with it. A repeated id is a row of its own; a query leaves out all rows
    of its id. An empty table gives no rows; other columns may have any names.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", "asks", F.size("v").alias("dim"), F.col("v").cast("array<double>").alias("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("dim").alias("dim")).first()
    held = max(1, CELLS // max(1, n["dim"] or 1))
    n_query, n_cand = math.ceil(n["q"] / (query_block or held)) or 1, math.ceil(n["n"] / (candidate_block or held)) or 1
    deal = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts))
    queries = rows.where("asks").distinct().withColumn("qb", deal(n_query, 1)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1)).cast("array<long>")))
    candidates = rows.withColumn("cb", deal(n_cand, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)).cast("array<long>")))
    names = ["qb", "cb", "dim", "vec_id", "v"]
    candidates = candidates.select("qb", "cb", "dim", F.col("vec_id").alias("row_id"), F.col("v").alias("row"))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if asked.num_rows and held.num_rows:
            shape = lambda t, v: floor_256(np.asarray(t[v].combine_chunks().flatten(), dtype=float).reshape(t.num_rows, -1))
            order = np.argsort(np.asarray(asked["vec_id"]), kind="stable")
            found = search_block(np.asarray(asked["vec_id"])[order], shape(asked, "v")[order], np.asarray(held["row_id"]), shape(held, "row"), k)
        texts = pa.array([str(f[2]) for f in found], pa.string())
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([max(-(2**63), min(2**63 - 1, f[2])) for f in found], pa.int64()), "exact": texts})

    blocks = queries.select(*names).groupBy("qb", "cb", "dim").cogroup(candidates.groupBy("qb", "cb", "dim"))
    best = blocks.applyInArrow(meet, "query_id long, vec_id long, score long, exact string")
    # by value: among scores beyond 64 bits, those of more digits are larger if positive, smaller if negative
    digits = F.length("exact") * F.when(F.col("exact").startswith("-"), -1).otherwise(1)
    text = F.when(F.col("exact").startswith("-"), F.translate("exact", "0123456789", "9876543210")).otherwise(F.col("exact"))
    beyond = F.col("score").isin(2**63 - 1, -(2**63))
    order = [F.desc("score"), F.desc(F.when(beyond, digits)), F.desc(F.when(beyond, text)), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
