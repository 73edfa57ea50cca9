"""Exact nearest neighbours of dense vectors: queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the vectors serves; more are served in further passes.
QUERY_BLOCK = 4096


def top_cosine(vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """(query_id, vec_id, score, rank): the `k` nearest others of every row whose id is divisible by `every`.

    A block of queries, of bounded size, goes to every task, which multiplies it with its vectors and keeps `k` for each
    query, so that what is shuffled is `k` rows a query and task, not a row for each pair.
    """
    queries = vectors.filter((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull()).select("vec_id", "embedding")
    parts, low = [], None
    while True:
        block = queries if low is None else queries.filter(F.col("vec_id") > low)
        rows = block.orderBy("vec_id").limit(QUERY_BLOCK).collect()
        if not rows and parts:
            break
        parts.append(_block(vectors, rows, k))
        if len(rows) < QUERY_BLOCK:
            break
        low = rows[-1][0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _block(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], np.float64) if rows else np.zeros((0, 1))
    norms = np.linalg.norm(q, axis=1, keepdims=True) if len(rows) else np.ones((0, 1))
    q = np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(ids) or not b.num_rows:
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            score = np.round(q @ np.divide(x, n, out=np.zeros_like(x), where=n > 0).T, 6)
            score[ids[:, None] == own[None, :]] = -np.inf
            take = min(k, b.num_rows)
            order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :take]
            s = np.take_along_axis(score, order, 1)
            ok = np.isfinite(s).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)[ok]), pa.array(own[order].ravel()[ok]), pa.array(s.ravel()[ok])], ["query_id", "vec_id", "score"])

    return vectors.filter("embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
