"""Results that each document gives alone, made within its row: no word, phrase or gram is shuffled.

The caller sees to it that no two rows share a doc_id (catalog.by_document).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import profiles
from folioscope.operators import canonical
from folioscope.operators.tokens import K
from folioscope.plans.dialect import SPARK

#: Buckets of hash_embedding.
BUCKETS = 512
#: Bytes of words that become Python objects at once.
SLICE_BYTES = 1 << 20


def _by_slices(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """run over record batches of bounded size; the first field of schema gets the type of df's doc_id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SLICE_BYTES // max(1, batch.nbytes // max(1, batch.num_rows)))
            for at in range(0, batch.num_rows, step):
                yield run(batch.slice(at, step))

    return df.mapInArrow(each, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}")


def _with_ids(part: pa.RecordBatch, at: list[int], **columns: pa.Array) -> pa.RecordBatch:
    """columns beside the doc_id of the rows named by at."""
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns.values()], ["doc_id", *columns])


def repeated_phrases(docs: DataFrame, stop: list[str], sizes: range, content: int, passages: int) -> DataFrame:
    """doc_id, n, phrase, passages: phrases of n words, `content` of them no stop words at least, in so many passages.

    A passage is a line. A phrase can only stand where its first words, as many as the shortest has, stand in enough passages.
    """
    canonical_words = f"array_join(transform({SPARK.rall(canonical.display(SPARK, 'l'), profiles.WORD)}, t -> {canonical.canonical(SPARK, 't')}), ' ')"
    rows = docs.select("doc_id", F.expr(f"transform({SPARK.split('text', chr(10))}, l -> {canonical_words})").alias("lines")).filter("lines is not null")
    least, stop_set = sizes[0], frozenset(stop)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at, ns, phrases, found = [], [], [], []
        for i, lines in enumerate(part.column(1).to_pylist()):
            split = [x for x in (line.split(" ") for line in lines) if len(x) >= least]
            if len(split) < passages:
                continue
            starts = [list(zip(*(x[k:] for k in range(least)))) for x in split]
            frequent: Counter = Counter()
            for x in starts:
                frequent.update(set(x))
            frequent = {x for x, c in frequent.items() if c >= passages}
            if not frequent:
                continue
            seen: dict[tuple[int, str], list[int]] = {}
            for k, (x, grams) in enumerate(zip(split, starts, strict=True)):
                for p, gram in enumerate(grams):
                    if gram not in frequent:
                        continue
                    for n in sizes:
                        words = x[p : p + n]
                        if len(words) == n and sum(w not in stop_set for w in words) >= content:
                            last = seen.setdefault((n, " ".join(words)), [-1, 0])
                            if last[0] != k:
                                last[:] = k, last[1] + 1
            for (n, phrase), (_, c) in seen.items():
                if c >= passages:
                    at.append(i)
                    ns.append(n)
                    phrases.append(phrase)
                    found.append(c)
        return _with_ids(part, at, n=pa.array(ns, pa.int32()), phrase=pa.array(phrases, pa.string()), passages=pa.array(found, pa.int64()))

    return _by_slices(rows, run, "n int, phrase string, passages long")


class _Grams(dict):
    """Gram: bucket. New words are mostly of old grams; a worker keeps so many of them."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        got = self[gram] = (int.from_bytes(md5(gram.encode()).digest()[:8], "big") >> 4) % BUCKETS
        return got


class _Buckets(dict):
    """Word: buckets of its grams. A worker keeps those of so many words."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= 100_000:
            self.clear()
        x = f" {word} "
        grams = [x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1)]
        got = self[word] = np.fromiter(map(_grams.__getitem__, grams), np.int16, len(grams))
        return got


_grams = _Grams()
_buckets = _Buckets()


def hash_embedding(docs: DataFrame) -> DataFrame:
    """doc_id, bucket, x: counts of the 3- to 5-grams of spaced words in 512 buckets of their md5, as a unit vector."""
    rows = docs.select("doc_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(profiles.WORD), 0), " ").alias("words")).filter("words <> ''")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at, buckets, xs = [], [np.empty(0, np.int64)], [np.empty(0)]
        for i, words in enumerate(part.column(1).to_pylist()):
            times = Counter(words.split(" "))
            grams = [_buckets[w] for w in times]
            counts = np.repeat(np.fromiter(times.values(), np.float64, len(times)), [len(x) for x in grams])
            c = np.bincount(np.concatenate(grams), counts, BUCKETS)
            some = np.flatnonzero(c)
            at.append(np.full(len(some), i))
            buckets.append(some)
            xs.append(c[some] / np.sqrt((c * c).sum()))
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        return _with_ids(part, at, bucket=pa.array(np.concatenate(buckets), pa.int64()), x=pa.array(np.concatenate(xs), pa.float64()))

    return _by_slices(rows, run, "bucket long, x double").select("doc_id", "bucket", F.round("x", 6).alias("x"))


def shingle_summary(docs: DataFrame, stop: list[str]) -> DataFrame:
    """doc_id, n, n_distinct, least, most of the hashes of the shingles of compared words (see tokens.shingles)."""
    # a line is its mark, whether it is left out whatever its section (x), and its words
    line = F.expr(f"transform(filter(transform({SPARK.split('text', chr(10))}, l -> trim(l)), l -> l <> ''), l -> {canonical.marked_line(SPARK, 'l')})")
    rows = docs.select("doc_id", line.alias("lines")).filter("lines is not null")
    stop_set = frozenset(stop)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for i, lines in enumerate(part.column(1).to_pylist()):
            words, references = [], False
            for x in lines:
                if x[0] != " ":
                    references = x[0] == "r"
                if not references and x[1] == " " and len(x) > 2:
                    words += x[3:].split(" ")
            if len(words) < K:
                continue
            good = np.cumsum([0, *(w not in stop_set and len(w) > 1 for w in words)])
            packed = [w.encode() for w in words]
            ends = np.cumsum([len(w) + 1 for w in packed])
            text, starts = b" ".join(packed), ends - [len(w) + 1 for w in packed]
            some = np.flatnonzero(good[K:] - good[:-K] >= 2)
            if not len(some):
                continue
            digests = b"".join([md5(text[a:b]).digest()[:8] for a, b in zip(starts[some].tolist(), (ends[some + K - 1] - 1).tolist(), strict=True)])
            h = (np.frombuffer(digests, ">u8") >> np.uint64(4)).astype(np.int64)
            at.append(i)
            out.append((len(h), len(np.unique(h)), int(h.min()), int(h.max())))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return _with_ids(part, at, **{name: pa.array(x, pa.int64()) for name, x in zip(("n", "n_distinct", "least", "most"), columns, strict=True)})

    return _by_slices(rows, run, "n long, n_distinct long, least long, most long")
