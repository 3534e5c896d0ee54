"""Nearest vectors of the same label by cosine: exact, in tiles of one block of queries and a stream of candidates.

Equal vectors meet in one task and count once. float32 products only rule pairs out, by more than their error; what is left is
computed in double precision from left to right, rounded to 9 digits and ranked, ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a task holds as queries, and those of one product.
BLOCK, STRIP = 1 << 17, 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _widen(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of equal ones, and each row's number among those."""
    if not x.shape[1]:
        return np.zeros(min(1, len(x)), np.int64), np.zeros(len(x), np.int64)
    _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    return first, group.ravel()


def _few(ids: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Rows of the smallest ids of each group: at most k of an id, and 2 k in all, so that k are left without any one id."""
    order = np.lexsort((ids, group))
    for keys, most in (((group, ids), k), ((group,), 2 * k)):
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
        at = np.arange(len(order))
        order = order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]
    return order


class Block:
    """The nearest of each of a block's distinct vectors, among all candidates seen so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        first, self.group = _groups(x)
        self.ids, self.x, self.k, self.keep = ids, x[first], k, 2 * k
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in first]
        self.floor = np.full(len(first), -np.inf)

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        dim = max(self.x.shape[1], x.shape[1])
        self.x, x = _widen(self.x, dim), _widen(x, dim)
        first, group = _groups(x)
        some = _few(ids, group, self.k)
        members = ids[some], np.searchsorted(group[some], np.arange(len(first) + 1))
        x = x[first]
        norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if dim else np.zeros(len(x))
        with np.errstate(all="ignore"):
            unit = (x / norm[:, None]).astype(np.float32)
            for at in range(0, len(self.x), STRIP):
                part = self.x[at : at + STRIP]
                norms = np.sqrt(np.cumsum(part * part, axis=1)[:, -1]) if dim else np.zeros(len(part))
                about = (part / norms[:, None]).astype(np.float32) @ unit.T
                # the error of a float32 sum, and of the rounding to 9 digits
                slack = 1e-6 + 2 * (dim + 8) * float(np.finfo(np.float32).eps)
                floor = self.floor[at : at + len(part)].copy()
                if len(x) > self.keep:
                    known = np.where(np.isnan(about), np.float32(np.inf), about)
                    fresh = np.flatnonzero(~np.isfinite(floor))
                    floor[fresh] = np.partition(known[fresh], len(x) - self.keep, axis=1)[:, len(x) - self.keep]
                q, c = np.nonzero(~(about < (floor - slack)[:, None].astype(np.float32)))
                for lo in range(0, len(q), 1 << 16):
                    self._add(at, part, norms, x, norm, q[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)], members)

    def _add(self, at: int, part: np.ndarray, norms: np.ndarray, x: np.ndarray, norm: np.ndarray, q: np.ndarray, c: np.ndarray, members: tuple) -> None:
        ids, starts = members
        dot = np.cumsum(part[q] * x[c], axis=1)[:, -1] if x.shape[1] else np.zeros(len(q))
        cosine = dot / (norms[q] * norm[c])
        key = np.where(np.isnan(cosine), 1 << 40, np.nan_to_num(np.sign(cosine) * np.floor(np.abs(cosine) * 1e9 + 0.5))).astype(np.int64)
        for a, b in _runs(q):
            i = at + int(q[a])
            mine = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in c[a:b]])
            times = starts[c[a:b] + 1] - starts[c[a:b]]
            old = self.best[i]
            near, score, keys = np.append(old[0], ids[mine]), np.append(old[1], np.repeat(cosine[a:b], times)), np.append(old[2], np.repeat(key[a:b], times))
            order = np.lexsort((near, -keys))
            # at most k of an id
            seen: dict[int, int] = {}
            pick = []
            for j in order.tolist():
                n = seen[near[j]] = seen.get(near[j], 0) + 1
                if n <= self.k:
                    pick.append(j)
                    if len(pick) == self.keep:
                        break
            self.best[i] = near[pick], score[pick], keys[pick]
            if len(pick) == self.keep:
                self.floor[i] = min(keys[pick[-1]] / 1e9, 2.0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        out = []
        for own, g in zip(self.ids.tolist(), self.group.tolist(), strict=True):
            near, score, keys = self.best[g]
            some = np.flatnonzero(near != own)[: self.k]
            out += [(own, int(near[j]), float(score[j]), int(keys[j])) for j in some]
            if len(out) >= 30_000:
                yield _batch(out)
                out = []
        yield _batch(out)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(x)) + 1
    return [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True) if b > a]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, cosine, key = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cosine, pa.float64(), from_pandas=False), pa.array(key, pa.int64())], ["a", "b", "cosine", "key"])


def nearest_of_label(vectors: DataFrame, k: int = 3) -> DataFrame:
    """a, b, k (from 1), cosine of the k nearest others of each vector's label; vectors are not null and hold no null."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("x")).filter("id is not null and label is not null")
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.count()
    # candidates are split where there are fewer blocks than cores can take
    split = max(1, -(-3 * spark.sparkContext.defaultParallelism // max(1, labels)))
    v = v.join(sizes.withColumnRenamed("label", "l"), F.col("label") == F.col("l"))
    v = v.select("id", "label", "x", F.expr(f"CAST(ceil(n / {BLOCK}) AS INT)").alias("qn"), F.expr(f"CAST(least({split}, greatest(1, ceil(n / {2 * STRIP}))) AS INT)").alias("cn"))
    mark = F.xxhash64("x")
    qb, cb = F.pmod(mark, "qn").cast("int"), F.pmod(F.xxhash64(F.lit(1), "x"), "cn").cast("int")
    queries = v.select("label", qb.alias("qb"), F.explode(F.expr("sequence(0, cn - 1)")).alias("cb"), F.lit(0).alias("role"), mark.alias("mark"), "id", "x")
    candidates = v.select("label", F.explode(F.expr("sequence(0, qn - 1)")).alias("qb"), cb.alias("cb"), F.lit(1).alias("role"), mark.alias("mark"), "id", "x")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tiles = queries.unionByName(candidates).repartition(parts, "label", "qb", "cb").sortWithinPartitions("label", "qb", "cb", "role", "mark", "id")
    tiles = tiles.select(F.xxhash64("label", "qb", "cb").alias("tile"), "role", "id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, block, waiting = None, None, []
        for batch in batches:
            keys, role, ids = (batch.column(i).to_numpy() for i in range(3))
            for a, b in _runs(keys):
                if keys[a] != tile:
                    if block:
                        yield from block.rows()
                    tile, block, waiting = keys[a], None, []
                for c, d in ((a + s, a + t) for s, t in _runs(role[a:b])):
                    x = _matrix(batch.column(3).slice(c, d - c))
                    if not role[c]:
                        waiting.append((ids[c:d], x))
                        continue
                    if block is None and waiting:
                        dim = max(y.shape[1] for _, y in waiting)
                        block = Block(np.concatenate([i for i, _ in waiting]), np.concatenate([_widen(y, dim) for _, y in waiting]), k)
                        waiting = []
                    if block:
                        block.see(ids[c:d], x)
        if block:
            yield from block.rows()

    found = tiles.mapInArrow(run, "a long, b long, cosine double, key long")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("key"), "b"))
    return found.withColumn("k", place).filter(F.col("k") <= k).select("a", "b", "k", F.round("cosine", 6).alias("cosine"))
