"""Approximate nearest neighbours by collision counting over single projections.

Vectors of unit length are projected to PROJECTIONS random lines. In each block of vectors every line
is one sorted array. A query's windows on all lines are centred at its own projections and grow
together (virtual rehashing: the width grows by WIDER, no bucket is fixed, and each step counts only what
it adds); a vector met on COLLIDE or more of the lines is verified by its exact cosine. A query stops when the best ``k`` verified lie so near that
farther windows would hold a nearer vector only with small probability, or all have been verified.

Queries meet all rows block by block: each task holds a block of BLOCK vectors and one of QUERIES
queries; the block's best k go on, and the best k of these are the result.

Cases: vectors that are null, zero or hold null or non-finite components take no part, neither as
query nor as candidate; an empty table gives no rows; repeated rows with one id are one vector (the
first by content); ties go to the smaller id; a query without candidates has no rows; vectors of several
dimensions are searched each among its own; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS, COLLIDE, SEED = 128, 0.69, 11
WIDTH, WIDER, NEAR = 0.5, 1.1, 1.12
BLOCK, QUERIES = 16_384, 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), of the vectors that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    return vectors.filter(fine).groupBy("vec_id").agg(F.min("embedding").cast("array<double>").alias("embedding"))


def _unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int):
    """(query, id, score, verified) arrays: for each query its best k verified vectors of this block, its own
    id left out, and how many were verified."""
    n, lines = len(x), np.random.default_rng(SEED).normal(size=(x.shape[1], PROJECTIONS))
    px, pq = x @ lines, q @ lines
    # The sorted arrays of all lines lie one after another, told apart by a shift that no window spans.
    first = np.arange(PROJECTIONS) * n
    shift = np.arange(PROJECTIONS) * 4 * (1 + max(np.abs(px).max(initial=0), np.abs(pq).max(initial=0)))
    order = np.argsort(px, axis=0, kind="stable")
    value = (np.take_along_axis(px, order, axis=0) + shift).T.ravel()
    order = order.T.ravel()
    need, out = int(np.ceil(COLLIDE * PROJECTIONS)), []
    for i in range(len(q)):
        centre = pq[i] + shift
        low = high = np.searchsorted(value, centre)
        count, seen = np.zeros(n, np.int64), ids == qids[i]
        found, score, half = np.zeros(0, np.int64), np.zeros(0), WIDTH
        while True:
            # Only what the wider windows add is counted.
            a, b = np.searchsorted(value, centre - half), np.searchsorted(value, centre + half, "right")
            a, b = np.maximum(np.minimum(a, low), first), np.minimum(np.maximum(b, high), first + n)
            ring = [order[s:e] for s, e in zip(np.concatenate([a, high]), np.concatenate([low, b]))]
            count += np.bincount(np.concatenate(ring), minlength=n)
            low, high = a, b
            new = np.flatnonzero((count >= need) & ~seen)
            if len(new):
                seen[new] = True
                found, score = np.append(found, new), np.append(score, (x[new] * q[i]).sum(axis=1))
            if (high - low).min() == n:
                break  # every window holds the whole block
            if len(found) >= k:
                kth = np.partition(score, -k)[-k]
                # A vector at distance d meets a line's window of half width h with probability erf(h / d / sqrt 2);
                # at h = NEAR * d that lies above COLLIDE by more than the lines' scatter.
                if half >= NEAR * np.sqrt(max(2 - 2 * kth, 0)):
                    break
            half *= WIDER
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), qids[i]), ids[found[best]], score[best], np.full(len(best), len(found))))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else ((), (), (), ())


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score; queries: vec_id, embedding, both of usable vectors."""
    # Counts alone come to the driver.
    blocks = max(1, -(-vectors.count() // BLOCK))
    chunks = max(1, -(-queries.count() // QUERIES))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    base = vectors.select(deal(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(chunks, 2).alias("chunk"), "vec_id", "embedding")

    def task(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        b, q = b.sort_values("vec_id"), q.sort_values("vec_id")
        # A query meets the vectors of its own dimension.
        for width, own in q.groupby(q["embedding"].map(len)):
            like = b[b["embedding"].map(len) == width]
            if len(like):
                found.append(pd.DataFrame(dict(zip(found[0].columns, search_block(like["vec_id"].to_numpy(), _unit(like["embedding"]), own["vec_id"].to_numpy(), _unit(own["embedding"]), k)[:3]))))
        return pd.concat(found)

    near = base.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(task, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
