"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A term is a vector component. Queries and candidates are dealt into blocks of bounded size and every
pair of blocks meets in one task. There each term's posting list (the block's weights for it) is
scattered, weighted by the query rows that have the term, into dense score arrays; a partition
selection keeps each query's best, and a ranked merge joins the blocks.

Scale: the work is queries times rows by nature; a task holds one block of each side (``BLOCK_CELLS``
components at most, whatever the dimension) and a few score rows, and blocks are dealt by a hash of
the row's number, so neither a common vector nor a repeated id makes a block larger than others. The
merge is a rank limit, which Spark applies before its shuffle too.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; missing components of a shorter vector count as 0; a row's own id is never its
candidate; repeated query rows are answered one by one; ties go to the smaller id. A term beyond 64 bits is the nearest 64-bit number, and so is a score, whose sum is
made of whole numbers of any length where 64 bits could overflow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut, table

SCALE = 64
EVERY = 20
K = 20
BLOCK_CELLS = 1 << 19  # components of a candidate block
QUERY_CELLS = 1 << 16
SCORES = 1 << 19  # scores that are held at once


def quantise(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, id and the integer terms of every row that takes part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    terms = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col(key).isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), terms.alias("terms")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(column) and (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)])] = flat
    return out


def _largest(matrix: np.ndarray) -> int:
    return max(-int(matrix.min(initial=0)), int(matrix.max(initial=0)))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of each query with each candidate, one term at a time."""
    bound = _largest(queries) * _largest(candidates) * queries.shape[1]
    kind = np.int32 if bound < 1 << 30 else np.int64 if bound < 1 << 63 else object
    weights, postings = queries.T.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    scores = np.zeros((len(queries), len(candidates)), kind)
    part = np.empty_like(scores)
    for weight, posting in zip(weights, postings, strict=True):
        rows = np.flatnonzero(weight)
        if 2 * len(rows) > len(weight):
            scores += np.multiply.outer(weight, posting, out=part)
        elif len(rows):
            columns = np.flatnonzero(posting)
            scores[np.ix_(rows, columns)] += np.multiply.outer(weight[rows], posting[columns])
    return scores if kind is not object else np.clip(scores, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def select(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) indices of each query's k best, ties to the smaller index; ``ids`` ascend."""
    none = np.iinfo(scores.dtype).min
    q, c = [], []
    low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    for i, row in enumerate(scores):
        row[low[i] : high[i]] = none
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > least)
            best = np.concatenate([above, np.flatnonzero(row == least)[: k - len(above)]])
        else:
            best = np.arange(len(row))
        best = best[row[best] != none]
        q.append(np.full(len(best), i))
        c.append(best)
    return np.concatenate(q or [np.zeros(0, int)]), np.concatenate(c or [np.zeros(0, int)])


def _block(k: int, width: int):
    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        queries, candidates = queries.combine_chunks(), candidates.combine_chunks().sort_by("id")
        get = lambda t, c: t[c].combine_chunks().to_numpy() if len(t) else np.zeros(0, np.int64)
        ids, rows, qids = get(candidates, "id"), get(queries, "row"), get(queries, "id")
        out = [[], [], [], []]
        if len(ids) and len(rows):
            c, q = _matrix(candidates["terms"].combine_chunks(), width), _matrix(queries["terms"].combine_chunks(), width)
            step = max(1, SCORES // len(ids))
            for at in range(0, len(rows), step):
                scores = accumulate(q[at : at + step], c)
                i, j = select(scores, qids[at : at + step], ids, k)
                for column, values in zip(out, (rows[at + i], qids[at + i], ids[j], scores[i, j].astype(np.int64)), strict=True):
                    column.append(values)
        return pa.table([np.concatenate(x) if x else np.zeros(0, np.int64) for x in out], names=["row", "query_id", "vec_id", "score"])

    return meet


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row for which ``is_query`` (a condition on ``id``) holds."""
    rows = cut(vectors)
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("terms"))).first()
    width = max(1, width or 1)
    c_blocks = max(1, math.ceil(n / max(64, BLOCK_CELLS // width)))
    q_blocks = max(1, math.ceil(n_queries / max(16, QUERY_CELLS // width)))
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.filter(is_query).withColumn("q", deal(q_blocks)).withColumn("c", every(c_blocks))
    candidates = rows.withColumn("c", deal(c_blocks)).withColumn("q", every(q_blocks))
    best = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(_block(k, width), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row of ``embeddings`` whose vec_id is divisible by 20."""
    return top_k(quantise(table(spark, sf_dir, "embeddings")), F.col("id") % EVERY == 0)


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
