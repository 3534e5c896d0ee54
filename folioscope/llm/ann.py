"""Nearest neighbours by a block matrix join over int8 product tiles.

Queries and candidates are packed into blocks; a tile is one query block times one candidate block. In a
tile every vector is x = s * q + e with q in int8, so that x.y = s s' (q.q') + s q.e' + e.y, and the exact
product lies within |s q| |e'| + |e| |y| of the integer product. The k-th best lower bound of a query is a
threshold; only pairs whose upper bound reaches it are recomputed from the original vectors in
double precision. Heaps of k per query merge the tiles. Nothing is lost: the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Queries of a tile that are multiplied at once, which bounds the size of the product.
STRIP = 256


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, in which their products are exact), scales, |s q|, |e|, |x|."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1), np.linalg.norm(x, axis=1)


def _int_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: float32 holds sums of 1024 products of int8 exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return out


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from left to right, so that equal vectors give equal scores."""
    return np.cumsum(a * b, axis=1)[:, -1]


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores): for each query what of this block can be among its k nearest.

    Equal candidates count once here and bring their k + 1 smallest ids: ties go to smaller ids, and one
    may be the query itself, so no other copy can be among the k nearest.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], np.ascontiguousarray(c[order])
    if not len(c):
        return
    _, first, group = np.unique(c.view(np.dtype((np.void, c.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    group = group.ravel()
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    copies = [np.unique(c_ids[by_group[a:b]])[: k + 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    c = c[first]
    cq, cs, cn, ce, cx = _quantise(c)
    for at in range(0, len(q), STRIP):
        part = q[at : at + STRIP]
        qq, qs, qn, qe, qx = _quantise(part)
        about = _int_product(qq, cq) * qs[:, None] * cs[None, :]
        # the last term covers the rounding of sums of that many products
        bound = (qn[:, None] * ce[None, :] + qe[:, None] * cx[None, :]) * (1 + 1e-9) + 4 * (c.shape[1] + 8) * np.finfo(float).eps * qx[:, None] * cx[None, :]
        keep = min(k + 1, len(c))
        low = about - bound
        floor = np.partition(low, len(c) - keep, axis=1)[:, len(c) - keep] if keep == k + 1 else np.full(len(part), -np.inf)
        for i in range(len(part)):
            near = np.flatnonzero(about[i] + bound[i] >= floor[i])
            score = exact_dot(c[near], np.broadcast_to(part[i], (len(near), c.shape[1])))
            best = np.argsort(-score, kind="stable")
            if len(best) > k + 1:
                best = np.flatnonzero(score >= score[best[k]])
            ids = np.concatenate([copies[g] for g in near[best]])
            scores = np.repeat(score[best], [len(copies[g]) for g in near[best]])
            other = ids != q_ids[at + i]
            ids, scores = ids[other], scores[other]
            pick = np.lexsort((ids, -scores))[:k]
            yield int(q_ids[at + i]), ids[pick], scores[pick]


class Heaps:
    """The k best (score, smaller id first) of each query, each id once."""

    def __init__(self, k: int):
        self.k, self.heaps, self.inside = k, {}, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        heap, inside = self.heaps.setdefault(query, []), self.inside.setdefault(query, {})
        for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
            if i in inside:
                if inside[i] >= s:
                    continue
                heap.remove((inside[i], -i))
                heapq.heapify(heap)
                del inside[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                del inside[-heapq.heapreplace(heap, (s, -i))[1]]
            else:
                continue
            inside[i] = s

    def best(self, query: int) -> list[tuple[float, int]]:
        return [(s, -i) for s, i in sorted(self.heaps[query], reverse=True)]


def _pack(df: DataFrame, block: str, size: str) -> DataFrame:
    """One row a block: ids and vectors as packed bytes. A block has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, dim, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([r["id"] for r in rows], "<i8").tobytes()
                x = np.array([r["x"] for r in rows], "<f8").tobytes()
                yield pa.record_batch([pa.array([b], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids], pa.binary()), pa.array([x], pa.binary())], [block, "dim", "ids", "xs"])

    grouped = df.groupBy(block, "dim").agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    return grouped.mapInArrow(run, f"{block} long, dim int, ids binary, xs binary")


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest candidates of each query by inner product.

    is_query: condition on key. Every other vector is a candidate; fewer than k give fewer rows. Vectors
    that are null, all zero or hold null or non-finite components take no part, nor do null keys;
    vectors of different lengths are never compared. Of repeated keys each query counts the best once. Ties go to the
    smaller key. Other columns do not matter; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.transform(vectors[vector], lambda v: v.cast("double"))
    rows = vectors.select(vectors[key].cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null")
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    rows = rows.select("id", "x", F.size("x").alias("dim"))
    asked = is_query(F.col("id"))
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    candidates = _pack(rows.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks))), "cb", "dim")
    queries = _pack(rows.filter(asked).withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(q_blocks))), "qb", "dim")
    left = queries.select("qb", "dim", F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"))
    right = candidates.select("cb", "dim", "ids", "xs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"))
    tiles = left.join(right.hint("shuffle_hash"), ["qb", "cb", "dim"]).select("qb", "dim", "q_ids", "q_xs", "ids", "xs")
    # a task takes its tiles query block by query block, so that it holds the heaps of one block only
    tiles = tiles.sortWithinPartitions("qb")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, at = Heaps(k), None
        for batch in batches:
            for i in range(batch.num_rows):
                qb, dim, q_ids, q_xs, ids, xs = (c[i].as_py() for c in batch.columns)
                if qb != at:
                    yield from _rows(heaps)
                    heaps, at = Heaps(k), qb
                for query, near, scores in tile(np.frombuffer(q_ids, "<i8"), np.frombuffer(q_xs, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8"), np.frombuffer(xs, "<f8").reshape(-1, dim), k):
                    heaps.add(query, near, scores)
        yield from _rows(heaps)

    def _rows(heaps: Heaps) -> Iterator[pa.RecordBatch]:
        todo = list(heaps.heaps)
        for at in range(0, len(todo), 4096):
            some = [(q, r + 1, i, s) for q in todo[at : at + 4096] for r, (s, i) in enumerate(heaps.best(q))]
            q, r, i, s = zip(*some, strict=True) if some else ((), (), (), ())
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "rank", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for batch in batches:
            q, _, i, s = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(q)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(q)], strict=True):
                if b > a:
                    query = int(q[a])
                    if query not in heaps.heaps and len(heaps.heaps) >= 4096:
                        yield from _rows(heaps)
                        heaps = Heaps(k)
                    heaps.add(query, i[a:b], s[a:b])
        yield from _rows(heaps)

    schema = "query_id long, rank int, vec_id long, score double"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = tiles.mapInArrow(multiply, schema).repartition(parts, "query_id").sortWithinPartitions("query_id")
    return found.mapInArrow(merge, schema)
