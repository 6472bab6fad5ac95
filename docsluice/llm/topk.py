"""Exact top-k by inner product with block-at-a-time pruning.

Rows of an index shard are put in an order that keeps similar rows together and cut into ranges (blocks).
A block keeps each dimension's largest and smallest value (the term maxima, for either sign of a query's
weight) and its rows (the forward index). A query sums its weights times these maxima into a bound for
each block, takes blocks in order of the bounds and scores their rows, until the next bound is below its
k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import named, pieces

BLOCK_ROWS = 64
SHARD_ROWS = 20_000
QUERY_ROWS = 2_000
#: Blocks whose rows are scored in one step.
STEP_BLOCKS = 8


def similar_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows: halves by the median of the widest dimension, again and again down to `leaf` rows."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf or x.shape[1] == 0:
            out.append(rows)
            continue
        widest = int(np.argmax(np.ptp(x[rows], axis=0)))
        half = -(-len(rows) // (2 * leaf)) * leaf
        rows = rows[np.argpartition(x[rows, widest], half - 1)]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class BlockIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block_rows: int = BLOCK_ROWS):
        order = similar_order(vectors, block_rows)
        self.ids, self.rows = ids[order], vectors[order]
        self.starts = np.arange(0, len(order), block_rows)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.rows, self.starts) if len(order) else self.rows
        self.least = np.minimum.reduceat(self.rows, self.starts) if len(order) else self.rows
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows without those of id `own`; of equal scores smaller ids first."""
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        for a in range(0, len(order), STEP_BLOCKS):
            blocks = order[a : a + STEP_BLOCKS]
            if len(ids) >= k:
                # a block whose bound equals the k-th score may hold an equal score under a smaller id
                blocks = blocks[bound[blocks] >= scores[-1]]
                if not len(blocks):
                    break
            at = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in blocks])
            self.scored += len(at)
            new_ids, new = self.ids[at], self.rows[at] @ query
            keep = new_ids != own
            if len(ids) >= k:
                keep &= new >= scores[-1]
            if keep.any():
                ids, scores = np.concatenate((ids, new_ids[keep])), np.concatenate((scores, new[keep]))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
        return ids, scores


def _matrix(column: pa.ChunkedArray, exact_in_float: bool, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.float64 if exact_in_float else np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For every query row its `k` best other rows: query_id, rank (int from 1), vec_id, score (long).

    Components become floor(scale * x); scores are integer inner products, ties go to the smaller id.
    `is_query` chooses queries from the rows. Rows that take no part: a null id or vector, or one with a
    null or non-finite component. A shorter vector counts as filled up with zeros. Rows that share an id
    are all candidates, but never for a query of that id; equal query rows count once, and different
    vectors under one query id each get their own ranks. Fewer than k others give fewer rows.

    An id that is no number is a null one. Scores that don't fit a long (components so large that their squares add up
    to 2 ** 63) raise ValueError. Names may have dots; other columns are left out. A table without rows gives none.

    Rows are dealt to index shards by a hash, queries to chunks; each shard meets each chunk in one task
    of bounded size, and the shards' best k of a query are merged.
    """
    value, number = named(vector_col), named(id_col).try_cast("long")
    usable = number.isNotNull() & value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(number.alias("id"), F.when(usable, F.transform(value, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))).alias("v"), is_query.alias("asks")).where("v is not null")
    count, asking, width, largest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))).first()
    shards, chunks, width = pieces(count, shard_rows), pieces(asking, query_rows), width or 0
    if width * (largest or 0) ** 2 >= 1 << 63:
        raise ValueError(f"scores of components up to {largest} in {width} dimensions don't fit a long")
    in_float = width * (largest or 0) ** 2 < 1 << 53
    spread = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    code = F.xxhash64("id", "v")
    indexed = rows.select("id", "v", F.pmod(code, F.lit(shards)).cast("int").alias("shard"), F.explode(spread(chunks)).alias("chunk"))
    asked = rows.where("asks").select("id", "v").distinct().select("id", "v", code.alias("code")).select("*", F.pmod(F.xxhash64(F.lit(7), "code"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(spread(shards)).alias("shard"))

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(index) and len(queries):
            own, q = queries["id"].to_numpy(), _matrix(queries["v"], in_float, width)
            blocks = BlockIndex(index["id"].to_numpy(), _matrix(index["v"], in_float, width))
            bounds = blocks.bounds(q)
            for i, code in enumerate(queries["code"].to_numpy()):
                ids, scores = blocks.search(own[i], q[i], bounds[i], k)
                for x, y in zip(out, (np.full(len(ids), own[i]), np.full(len(ids), code), ids, scores), strict=True):
                    x.append(y.astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "code", "vec_id", "score"), out, strict=True)})

    best = indexed.groupBy("shard", "chunk").cogroup(asked.groupBy("shard", "chunk")).applyInArrow(search, "query_id long, code long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
