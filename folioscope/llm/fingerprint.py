"""Document fingerprints by consistent weighted sampling.

Every term (word) and sample k has its own r and c, drawn from Gamma(2, 1), and b from (0, 1), all by
hashing. A term of weight w proposes y = exp(r * (floor(ln w / r + b) - b)) and the value c / (y * exp(r));
the sample is the term of least value with its floor. Two documents agree in a sample with probability
sum(min(w)) / sum(max(w)), the generalised Jaccard similarity of their weighted terms. Weights are
the counts of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cache, enter, slices, words

#: Bytes of text that one task sorts and streams through, roughly.
RANGE_BYTES = 8 << 20


class WeightedSampler:
    """Signatures of many texts at once; the draws of recent (term, weight) pairs are kept, within a bound."""

    def __init__(self, samples: int = 64, seed: int = 9, max_terms: int = 120_000):
        self.samples, self.seed, self.max_terms = samples, seed, max_terms
        self.salts = (np.arange(1, 4 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(4, samples)
        self.row: dict[tuple[bytes, int], int] = {}
        self.cost = np.empty((max_terms, samples), np.float32)
        self.tag = np.empty((max_terms, samples), np.uint16)

    def _uniform(self, terms: np.ndarray, which: int) -> np.ndarray:
        """Uniform numbers in (0, 1) for each term and sample: a mix of the term's hash and the sample's salt."""
        h = terms[:, None] ^ self.salts[which]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
        return ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

    def _draw(self, pairs: list[tuple[bytes, int]], at: int) -> None:
        for lo in range(0, len(pairs), 4096):
            part = pairs[lo : lo + 4096]
            terms = np.array([xxhash.xxh64_intdigest(t, self.seed) for t, _ in part], np.uint64)
            log_w = np.log(np.array([w for _, w in part], np.float32))[:, None]
            u = [self._uniform(terms, i) for i in range(4)]
            r = -np.log(u[0] * u[1])
            beta = (terms[:, None] ^ self.salts[0]) * np.uint64(0xD6E8FEB86659FD93)
            beta ^= beta >> np.uint64(32)
            beta = (beta >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(log_w / r + beta)
            self.cost[at + lo : at + lo + len(part)] = np.log(-np.log(u[2] * u[3])) - r * (t - beta) - r
            kind = (terms[:, None] + self.salts[1]) ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            kind *= np.uint64(0xC4CEB9FE1A85EC53)
            self.tag[at + lo : at + lo + len(part)] = (kind >> np.uint64(48)).astype(np.uint16)

    def _rows(self, pairs: list[tuple[bytes, int]]) -> np.ndarray:
        new = [p for p in pairs if p not in self.row]
        if len(self.row) + len(new) > self.max_terms:
            self.row.clear()
            new = pairs
        at = len(self.row)
        self._draw(new, at)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, pairs), np.int64, len(pairs))

    def signature(self, text: str) -> np.ndarray | None:
        """16 bits of each sample's (term, floor); None without words."""
        counts: dict[bytes, int] = {}
        for w in words(text):
            counts[w] = counts.get(w, 0) + 1
        if not counts:
            return None
        best, tag = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint16)
        items, every = list(counts.items()), np.arange(self.samples)
        for lo in range(0, len(items), self.max_terms // 2):
            rows = self._rows(items[lo : lo + self.max_terms // 2])
            cost = self.cost[rows]
            pick = cost.argmin(axis=0)
            low = cost[pick, every]
            tag = np.where(low < best, self.tag[rows[pick], every], tag)
            best = np.minimum(low, best)
        return tag


def fingerprint_hex(sampler: WeightedSampler, text: str) -> str:
    """Hex of the signature, 16 bits a sample; '' without words."""
    tag = sampler.signature(text)
    return "" if tag is None else tag.astype("<u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of agreeing samples; two texts without words are alike (1), one without words is unlike (0)."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x, y = (np.frombuffer(bytes.fromhex(v), "<u2") for v in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    n = len(text)
    cut = n // 4
    return text[: n - cut] + following[:cut]


_samplers: dict[tuple[int, int], WeightedSampler] = {}
cache("fingerprint", _samplers.clear)


def _sampler(samples: int, seed: int) -> WeightedSampler:
    return _samplers.setdefault((samples, seed), WeightedSampler(samples, seed))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 64, seed: int = 9) -> DataFrame:
    """key, fingerprint of every row's whole text; null counts as empty, and an empty text gives ''.

    Equal texts have equal fingerprints. Repeated and null keys keep their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("fingerprint")
        sampler = _sampler(samples, seed)
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array([fingerprint_hex(sampler, t or "") for t in part.column(1).to_pylist()])], ["key", "fingerprint"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)


def with_next(df: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    """Rows dealt into ranges of ascending key, each range followed by a copy of the next range's first row.

    Bounds of the ranges and their least keys are found from the keys alone: two small jobs. One range
    holds about RANGE_BYTES of text. Returns key, text, part, copy, with the rows of a partition sorted
    by part, copy, key and text. After the last range comes the first row. Null keys come first.
    """
    low = -(2**63)
    rows = df.select(F.coalesce(df[key].cast("long"), F.lit(low)).alias("order"), df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    parts = max(1, int((rows.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_BYTES))
    bounds = sorted(set(rows.agg(F.percentile_approx("order", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []))
    part = F.lit(0)
    if bounds:
        part = F.when(F.col("order") >= bounds[-1], F.lit(len(bounds))).otherwise(F.aggregate(F.array(*(F.lit(b) for b in bounds)), F.lit(0), lambda n, b: n + (b <= F.col("order")).cast("int")))
    rows = rows.withColumn("part", part)
    first = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.min("order")).collect())
    before = [(least, first[i - 1][0]) for i, (_, least) in enumerate(first)]
    if before:
        mapping = F.create_map(*(F.lit(x) for pair in before for x in pair))
        target = F.element_at(mapping, F.col("order")).cast("int")
        goes = F.when(target.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")), F.struct(target.alias("part"), F.lit(1).alias("copy"))))
    else:
        goes = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")))
    dealt = rows.select("order", "key", "text", F.explode(goes).alias("goes")).select("order", "key", "text", "goes.part", "goes.copy")
    return dealt.repartition(max(2, parts), "part").sortWithinPartitions("part", "copy", "order", "text")


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 64, seed: int = 9) -> DataFrame:
    """key, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next row is the next in ascending key (equal keys: by text), after the last the first. Null
    texts are empty. A table of one row is its own next.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("fingerprint")
        sampler = _sampler(samples, seed)
        held: tuple | None = None

        def out(row: tuple, following: tuple | None) -> tuple:
            _, k, t, mark = row
            other, other_mark = (t, mark) if following is None else (following[2], following[3])
            new = edited(t, other)
            new_mark = fingerprint_hex(sampler, new)
            return k, len(t), new, mark, new_mark, likeness(mark, new_mark), likeness(mark, other_mark)

        def batch(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        names = ["key", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        key_type = None
        for slice_ in slices(batches):
            key_type = slice_.schema.field(0).type
            done = []
            for k, t, part, copy in zip(*(c.to_pylist() for c in slice_.columns), strict=True):
                row = (part, k, t, fingerprint_hex(sampler, t))
                if held is not None and held[0] == part:
                    done.append(out(held, row))
                elif held is not None:
                    done.append(out(held, None))
                held = None if copy else row
            if done:
                yield batch(done)
        if held is not None:
            yield batch([out(held, None)])

    rows = with_next(df, key, text).select("key", "text", "part", "copy")
    schema = f"key {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
