"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has t bins. In round i every shingle throws itself into one bin by a hash of its own; bins keep the
least (round, hash). Rounds stop as soon as every bin is filled; after t rounds, round t + j offers all
shingles to bin j alone, so 2t rounds always fill every bin. Two sets agree in a bin with
the probability of their Jaccard similarity, and the share of agreeing bins is as concentrated as
that of t independent samples.

Documents of equal sets are one class. Bands of the sketch bring classes together; within a band's group all are
compared with one centre, never all with all. Links are confirmed on full shingle sets. Where
a group still spans several components afterwards, other centres follow, and at last the groups that hang
together are compared block by block between components, inside the tasks, so that no link is lost but with the
probability that banding itself misses it: (1 - s^4)^32 at similarity s, 5e-8 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cache, discard, enter, map_slices, words, written
from folioscope.llm.graph import components

BINS, BANDS = 128, 32
#: Agreeing bins that a pair needs in order to be verified: at similarity 0.8, fewer have probability 1e-7.
LEAST_AGREE = 76
#: Classes in a block of the last, blockwise comparison, and bytes of their sets, on average.
BLOCK, BLOCK_BYTES = 2048, 24 << 20
STAR_ROUNDS = 1

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = _Hashes()
cache("minhash", _hashes.clear)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if there are fewer words."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _M1 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The filled bins of a non-empty set, 16 bits each."""
    out = np.zeros(bins, np.uint64)
    open_ = np.ones(bins, bool)
    none = np.uint64(2**64 - 1)
    for i in range(2 * bins):
        h = _mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < bins:
            best = np.full(bins, none)
            np.minimum.at(best, (h & np.uint64(bins - 1)).astype(np.intp), h >> np.uint64(8))
        else:
            best = np.full(bins, none)
            best[i - bins] = (h >> np.uint64(8)).min()
        fill = open_ & (best != none)
        out[fill] = best[fill] + np.uint64(i * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF)
        open_ &= ~fill
        if not open_.any():
            break
    return (_mix(out) >> np.uint64(48)).astype(np.uint16)


def _describe(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """id, n (set size), same (16 bytes that name the set; null if empty), sketch."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n, same, marks = [], [], []
        for t in part.column(1).to_pylist():
            s = shingles(t, k)
            n.append(len(s))
            same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            marks.append(sketch(s).tobytes() if len(s) else None)
        return pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(marks, pa.binary())], ["id", "n", "same", "sketch"])

    return map_slices(docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")), run, "id long, n long, same binary, sketch binary", "minhash")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """id, same, items (packed shingle hashes) of the wanted (id, same)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in part.column(1).to_pylist()]
        same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        return pa.record_batch([part.column(0), same, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "same", "items"])

    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    rows = rows.join(wanted.select("id").distinct(), "id", "left_semi")
    return map_slices(rows, run, "id long, same binary, items binary", "minhash").join(wanted, ["id", "same"], "left_semi").dropDuplicates(["id"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        good = [_overlap(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(part.column(2), part.column(3), strict=True)]
        mask = pa.array(good, pa.bool_())
        return pa.record_batch([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return map_slices(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y"), run, "a long, b long", "minhash")


def _overlap(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _tiles(families: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between components of one family, block against block.

    families: id, comp, family. A block has BLOCK classes or BLOCK_BYTES of sets, about. What the sketches rule out is not
    verified, nor what a tile has linked already; only links leave a tile.
    """
    held = families.join(sets.select("id", "items"), "id").join(marks.select("id", "sketch"), "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("items")) / BLOCK_BYTES)).cast("int")
    dealt = held.join(held.groupBy("family").agg(blocks.alias("blocks")), "family")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sided = dealt.select("family", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"), "id", "comp", "sketch", "items")
    sided = sided.select("family", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "comp", "sketch", "items")

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        enter("minhash")
        batch = batch.combine_chunks()
        i, j = key[1].as_py(), key[2].as_py()
        ids, block, comp = batch["id"].to_numpy(), batch["block"].to_numpy(), batch["comp"].to_numpy().copy()
        x = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(len(ids), BINS)
        items = [np.frombuffer(v.as_buffer(), "<u8") for v in batch["items"]]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for u in left:
            far = right[comp[right] != comp[u]]
            if i == j:
                far = far[ids[far] > ids[u]]
            for v in far[(x[far] == x[u]).sum(axis=1) >= LEAST_AGREE]:
                if comp[u] != comp[v] and _overlap(items[u], items[v], percent):
                    low, high = sorted((comp[u], comp[v]))
                    comp[comp == high] = low
                    a.append(min(ids[u], ids[v]))
                    b.append(max(ids[u], ids[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sided.groupBy("family", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept of every row.

    Rows are linked if 100 * |intersection| >= percent * |union| of their k-word shingle sets; component_id is
    the least key reachable, kept says whether it is the row's own. A row of fewer words has its whole
    sequence as one shingle. Null, empty and blank texts have no shingles, link with nothing and are kept. A row of
    null key takes its class's component if other rows share its set, else it has none and is kept. Repeated keys are
    rows of their own; exact repeats of one row share key and component, so all are kept. Other columns do not matter.
    """
    sketched = written(_describe(docs, key, text, k), "sketches")
    rows = written(sketched.select("id", "n", "same"), "sizes")
    classes = rows.filter("n > 0").groupBy("same").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    reps = sketched.filter("n > 0").select("id", "same", "sketch").join(classes.filter("rep is not null").select(F.col("rep").alias("id"), "same"), ["id", "same"])
    marks = written(reps.dropDuplicates(["id"]).select("id", "same", "sketch"), "reps")
    discard(sketched)
    size = 2 * BINS // BANDS

    def band(i: int) -> Column:
        return F.xxhash64(F.lit(i), F.substring("sketch", i * size + 1, size))

    bands = marks.select("id", F.explode(F.array(*(band(i) for i in range(BANDS)))).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).filter("n > 1").select("band", "centre")
    groups = written(bands.join(shared, "band").select("band", "id", "centre"), "groups")
    involved = groups.select("id").distinct().join(marks.select("id", "same"), "id")
    sets = written(_sets(docs, involved, key, text, k), "sets")
    tried = pairs = written(groups.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = written(_verify(pairs, sets, percent), "links")
    comps = components(links)
    for turn in range(STAR_ROUNDS + 1):
        labelled = groups.select("band", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
        # every band takes a centre of its own, so that a wide group is seen from many sides in one turn
        centre = F.min(F.struct(F.xxhash64(F.lit(turn), "band", "id").alias("h"), F.col("id").alias("id"), F.col("comp").alias("comp")))
        mixed = labelled.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), centre.alias("centre")).filter("low <> high")
        mixed = written(mixed.select("band", F.col("centre.id").alias("centre"), F.col("centre.comp").alias("centre_comp")), "mixed")
        if mixed.isEmpty():
            break
        open_ = labelled.join(mixed, "band")
        if turn == STAR_ROUNDS:
            near = components(open_.select(F.col("centre").alias("a"), F.col("id").alias("b")))
            families = open_.select("id", "comp").distinct().join(near.select(F.col("node").alias("id"), F.col("comp").alias("family")), "id")
            more = written(_tiles(written(families, "families"), marks, sets, percent), "more")
            comps = components(links.unionByName(more))
            break
        pairs = open_.filter("comp <> centre_comp").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = written(links.unionByName(_verify(pairs, sets, percent)), "links")
        comps = components(links)
    for done in (marks, groups, sets):
        discard(done)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("comp", "rep").alias("component"))
    out = rows.select("id", "n", "same").join(named, "same", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
