"""Toxicity by compression distance: one zstandard dictionary per class, calibrated thresholds.

A window is one word between fixed marks, followed by a constant tail (without it zstandard stores
short inputs uncompressed and all lengths are equal). zstandard trains both dictionaries on texts of
framed words: the ordinary one on whole ordinary texts, the toxic one on toxic texts without the words that
are not far more frequent there than in ordinary texts. A window counts as toxic if the toxic dictionary compresses it to at most `length` bytes and at
least `gain` bytes shorter than the ordinary one does. Both thresholds, and the share of toxic texts
for each number of such windows, come from labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import common
from folioscope.llm.common import cache, enter, slices

#: Labelled rows of either class that are collected for fitting, at most.
MAX_PER_CLASS = 3000
DICTIONARY_BYTES = 32768
#: How many times likelier a word is in toxic texts than in ordinary ones, to be trained on: what separates
#: the set-aside usable rows best is taken.
RATIOS = (5.0, 10.0, 20.0, 40.0)
OPEN, CLOSE, TAIL = b"\x01\x02\x03", b"\x04\x05\x06", b"\n" * 64
#: Counts of toxic windows that are told apart.
STEPS = 6


def words(text: str | None) -> list[bytes]:
    """Words without punctuation around them."""
    return [w for w in (x.strip(b".,;:!?()[]\"'|") for x in common.words(text)) if w]


def _frame(sample: list[bytes]) -> bytes:
    return b"".join(OPEN + w + CLOSE for w in sample)


def _train(samples: list[list[bytes]]) -> bytes:
    """A trained dictionary, as raw content; samples too few for zstandard to train on are their own dictionary."""
    framed = [_frame(x) for x in samples if x]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, framed)) // 8))
    try:
        return zstandard.train_dictionary(size, framed, k=32, d=8, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        common = [_frame([w]) for w, _ in Counter(w for x in samples for w in x).most_common()][::-1]
        return (b"".join(common) or OPEN + CLOSE + TAIL)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    length: int = 0
    gain: int = 1
    shares: tuple[float, ...] = (0.0,) * (STEPS + 1)

    def lengths(self) -> tuple:
        def compressor(content: bytes):
            parameters = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, write_checksum=False
            )
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)

        def one(compress):
            return lambda word: len(compress(OPEN + word + CLOSE + TAIL))

        return one(compressor(self.toxic).compress), one(compressor(self.ordinary).compress)


class Scorer:
    """Scores texts; the verdict on recent words is kept, within a bound."""

    def __init__(self, model: Model, max_words: int = 200_000):
        toxic, ordinary = model.lengths()
        length, gain = model.length, model.gain

        class Verdicts(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= max_words:
                    self.clear()
                n = toxic(word)
                got = self[word] = int(n <= length and ordinary(word) - n >= gain)
                return got

        self.shares, self.verdicts = model.shares, Verdicts()

    def score(self, text: str | None) -> float:
        hits = sum(map(self.verdicts.__getitem__, words(text)))
        return self.shares[min(hits, STEPS)]


def _outstanding(mine: list[list[bytes]], others: list[list[bytes]], least: int, ratio: float) -> list[list[bytes]]:
    """The texts of mine, reduced to the words that stand out against the other class."""
    here, there = (Counter(w for t in texts for w in set(t)) for texts in (mine, others))
    n, m = max(1, len(mine)), max(1, len(others))
    keep = {w for w, c in here.items() if c >= least and c / n > ratio * (there[w] + 0.5) / m and len(w) <= 64}
    return [[w for w in t if w in keep] for t in mine]


def _hits(model: Model, texts: list[list[bytes]]) -> np.ndarray:
    """hits[text, length, gain]: windows that thresholds of length and gain would count."""
    toxic, ordinary = model.lengths()
    known: dict[bytes, tuple[int, int]] = {}
    out = np.zeros((len(texts), 48, 24), np.int32)
    for grid, text in zip(out, texts, strict=True):
        for w in text:
            if w not in known:
                n = toxic(w)
                known[w] = (min(n, 47), min(max(ordinary(w) - n, 0), 23))
            grid[known[w]] += 1
    return out[:, :, ::-1].cumsum(axis=2, dtype=np.int32)[:, :, ::-1].cumsum(axis=1, dtype=np.int32)


def fit(toxic: list[str], ordinary: list[str], base_rate: float) -> Model:
    """Two thirds of each class train the dictionaries, the rest sets thresholds and shares."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    cut = {id(c): [[x for i, x in enumerate(c) if (i % 3 < 2) == train] for train in (True, False)] for c in (toxic, ordinary)}
    (t_fit, t_set), (o_fit, o_set) = cut[id(toxic)], cut[id(ordinary)]
    if not t_fit or not o_fit:
        return Model(b"", b"", shares=(base_rate,) * (STEPS + 1))
    least = max(2, min(4, len(t_fit) // 100))
    t_words, o_words = ([words(x) for x in texts] for texts in (t_fit, o_fit))
    t_set, o_set = ([words(x) for x in texts] for texts in (t_set or t_fit, o_set or o_fit))
    plain, best = _train(o_words), None
    for ratio in RATIOS:
        model = Model(_train(_outstanding(t_words, o_words, least, ratio)), plain)
        t_hits, o_hits = _hits(model, t_set), _hits(model, o_set)
        right = (t_hits > 0).mean(axis=0) - (o_hits > 0).mean(axis=0)
        right[:, 0] = -1
        length, gain = map(int, np.unravel_index(right.argmax(), right.shape))
        if best is None or right[length, gain] > best[0]:
            best = right[length, gain], model, length, gain, t_hits[:, length, gain], o_hits[:, length, gain]
    _, model, length, gain, a, b = best
    shares, top = [], 0.0
    for k in range(STEPS + 1):
        t = ((a >= k) if k == STEPS else (a == k)).mean() * base_rate + 0.5 / len(a) * base_rate
        o = ((b >= k) if k == STEPS else (b == k)).mean() * (1 - base_rate) + 0.5 / len(b) * (1 - base_rate)
        top = max(top, float(t / (t + o)))
        shares.append(top)
    return Model(model.toxic, model.ordinary, length, gain, tuple(shares))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits a model on at most MAX_PER_CLASS labelled rows of either class, chosen by a hash of the key.

    usable: condition on key for rows whose labels may be seen. Rows without a label or a text are not used.
    A key with several labels counts as toxic if one of them is.
    """
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).filter("key is not null and label in (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    known = known.withColumnRenamed("key", key).filter(usable).withColumnRenamed(key, "key")
    counts = dict(known.groupBy("label").count().collect())
    total = sum(counts.values())
    wanted = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64(F.lit(3), "key"), "key").limit(MAX_PER_CLASS)
        wanted = part if wanted is None else wanted.unionByName(part)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).filter("text is not null").join(F.broadcast(wanted), "key")
    got = sorted((r["label"], r["text"]) for r in rows.select("label", "text").toLocalIterator())
    return fit([t for v, t in got if v == 1], [t for v, t in got if v == 0], counts.get(1, 0) / total if total else 0.0)


_scorers: dict[tuple, Scorer] = {}
cache("toxicity", _scorers.clear)


def _scorer(model: Model) -> Scorer:
    key = (model.toxic, model.ordinary, model.length, model.gain, model.shares)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, and score (0 to 1) of every row's whole text.

    Null and empty texts have no windows and get the score of texts without toxic windows. Every row
    stays, with repeated and null keys. A column of keep that is named score gives way to the score.
    """
    columns = [c for c in dict.fromkeys([key, *keep]) if c != "score"]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(docs[c] for c in dict.fromkeys([*columns, text])))
    at, schema = rows.columns.index(text), rows.select(*columns).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        scorer = _scorer(shipped.value)
        for part in slices(batches):
            scores = pa.array([scorer.score(t) for t in part.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], scores], [*columns, "score"])

    return rows.mapInArrow(run, schema)
