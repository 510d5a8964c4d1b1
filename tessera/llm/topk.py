"""Exact top-k search by inner product with MaxScore.

Vectors become integers. Candidates are dealt into shards and queries into blocks, both of bounded size; a task holds one shard
against one block. A shard's rows are ordered by falling norm and cut into steps; every dimension of a query is a term, with a score bound in each step. The
terms are taken by falling weight. What the terms from some place on can add at most is bounded twice, by the sum of their bounds and by the product of norms
(their weights' and the step's rows'); a step whose terms together stay below the k-th score so far is skipped. The first terms without which that
score is out of reach are the essential ones: only their postings are multiplied for all rows of a step. The others are probed some at a time for the
rows that stay competitive. The k best of all shards are merged by query.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; shorter vectors count
as padded with zeros; a query never meets rows of its own id; equal scores go to the smaller id; repeated candidates each count, but are summed before they
are dealt and only k of them, which is all that can be among the k best, reach a shard; repeated queries ask once,
and different query vectors of one id are queries of their own, each with its ranks;
fewer than k candidates give all; an empty table gives an empty result; other columns are not looked at. Sums of products must
stay below 2^53, which is checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE = 20, 64
#: Rows of a shard and of a query block at most, of the steps in which a shard is searched. Smaller inputs are dealt over all cores, in shards of a step or more.
SHARD_ROWS, QUERY_ROWS, STRIDE = 65_536, 8_192, 4_096
#: Rows of the first step, all of whose products are made, and terms that are probed at a time.
FIRST_ROWS, PROBED = 512, 8


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and the vector as whole numbers floor(scale * x), of the rows that take part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.col(vec_id).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return df.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("v"))


def matrix(rows: pa.Table, width: int) -> np.ndarray:
    """A table's vectors, one a row, padded with zeros."""
    column = rows.column("v").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def steps(rows: int) -> list[tuple[int, int]]:
    """Where the steps of a shard begin and end."""
    edges = [0, *range(min(FIRST_ROWS, STRIDE), rows, STRIDE), rows]
    return list(zip(edges, edges[1:], strict=False)) if rows else []


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, norms: np.ndarray | None = None, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of one shard. postings: one row for each dimension; high, low: its bounds, of all rows or by step; norms: the largest
    norm in each step; counted gets the number of products made."""
    order = np.argsort(-np.abs(query), kind="stable")
    weights = query[order]
    tail = np.sqrt(np.append(np.cumsum((weights**2)[::-1])[::-1], 0.0))
    best_ids, best, floor, made = np.empty(0, np.int64), np.empty(0), -np.inf, 0
    for step, (at, to) in enumerate(steps(len(ids))):
        top, bottom = (high, low) if high.ndim == 1 else (high[step], low[step])
        most = np.where(weights > 0, weights * top[order], weights * bottom[order])
        # left[i]: what the terms from i on can add at most. Rounding must not make a bound too small: scores are whole numbers.
        left = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        if norms is not None:
            left = np.minimum(left, np.floor(tail * norms[step] * (1 + 1e-9) + 1))
        if left[0] < floor:
            continue
        n = int(np.argmax(left < floor)) if floor > left[-1] else len(weights)
        score = weights[:n] @ postings[order[:n], at:to]
        alive, made = np.arange(at, to), made + n * (to - at)
        while n < len(weights):
            keep = score + left[n] >= floor
            alive, score = alive[keep], score[keep]
            if not len(alive):
                break
            more = min(n + PROBED, len(weights))
            score = score + weights[n:more] @ postings[order[n:more, None], alive]
            made, n = made + (more - n) * len(alive), more
        keep = (score >= floor) & (ids[alive] != own)
        if keep.any():
            best_ids, best = best_of(np.concatenate((best_ids, ids[alive[keep]])), np.concatenate((best, score[keep])), k)
            if len(best) == k:
                floor = best[-1]
    if counted is not None:
        counted.append(made)
    return best_ids, best


def by_norm(ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's rows by falling norm: ids, postings, and by step the bounds of each dimension and the largest norm."""
    norms = np.sqrt((data**2).sum(1))
    order = np.lexsort((ids, -norms))
    ids, data, norms = ids[order], data[order], norms[order]
    cuts = steps(len(ids))
    high, low = (np.array([f(data[a:b], axis=0) for a, b in cuts]) for f in (np.max, np.min))
    return ids, np.ascontiguousarray(data.T), high, low, np.array([norms[a] for a, _ in cuts])


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, best first, ties to the smaller id."""
    if len(ids) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    first = np.lexsort((ids, -scores))[:k]
    return ids[first], scores[first]


def search(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; both frames as integers() gives them."""
    width_of = F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")
    # Rows alike in id and vector share a hash and so a shard: collapsed first, they can't outgrow it.
    copies = candidates.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    candidates = copies.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
    n, width = candidates.agg(F.count("*"), width_of).first()
    n_queries, query_width = queries.agg(F.count("*"), width_of).first()
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    shards, blocks, width = max(1, -(-n // shard_rows), min(cores, n // STRIDE)), max(1, -(-n_queries // query_rows)), max(1, width, query_width)
    shard, block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    left = candidates.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = queries.distinct().withColumn("key", F.xxhash64("v")).withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def probe(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if rows.num_rows and asked.num_rows:
            ids, postings, high, low, norms = by_norm(rows.column("vec_id").to_numpy(), matrix(rows, width))
            weights = matrix(asked, width)
            if np.abs(weights).sum(1).max() * max(abs(high).max(), abs(low).max()) >= 2.0**53:
                raise OverflowError("scores leave the range of exact integers")
            for own, query, key in zip(asked.column("vec_id").to_numpy(), weights, asked.column("key").to_numpy(), strict=True):
                best_ids, best = maxscore(query, own, ids, postings, high, low, k, norms)
                found.append((np.full(len(best), own), best_ids, best, np.full(len(best), key)))
        query_ids, best_ids, scores, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(best_ids, pa.int64()), "score": pa.array(scores).cast(pa.int64()), "key": pa.array(keys, pa.int64())})

    part = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(probe, "query_id long, vec_id long, score long, key long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same search in DuckDB SQL, over all pairs.
ORACLE = f"""
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= {K}"""
