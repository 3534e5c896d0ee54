"""Language-model scores of a hierarchical Pitman-Yor model, trained and applied in a distributed way.

Restaurants: one per context, which is the token before (or the begin of the text), so their number grows with the
corpus; all share the root restaurant as parent, whose base is uniform over the vocabulary and one unknown
word. Every table of a context restaurant is a customer of the root.

A Gibbs sweep reseats, for every (context, word), the customers one after the other: a customer opens a table
with probability a / (a + i - d t), a = (theta + d T) p0(word). T, the tables of the whole context, and the
root's totals are those of the sweep before. Seats are drawn with generators seeded by sweep and part,
so any task can repeat them. Predictive probabilities are averaged over the sampled sweeps.

Heavy words are those of more than 1 / HEAVY of all tokens, HEAVY of them at most, and the marks of a text's begin and
end. A token goes to the part of its word's hash, or, if the word is heavy, to that of its context; tokens with
both heavy are counted before the shuffle and scored where the texts are, from a table of HEAVY^2 numbers at most.
Tokens travel as numbers within their batch of rows (a row's place, a context's place among the COMMON words), so that
what a token takes does not grow with the number of parts. Sums come back by batch and are named there by row.
So what a light word needs of the root is in its part, and what heavy words and heavy contexts need in
total comes through the driver, a few numbers each. Totals of light contexts, any number of them, are
exchanged between parts by hash: every part sends its tables per context to the context's part and gets the sums
back, after the first sweep only for contexts with a word seen twice, since no other can change. Parts
and the messages to them are bucketed, so that a message is shuffled once on either way. With them every part gets its own
seats of the sweeps before, so that no sweep is done again. Only sums per text come back in the end.
"""

from __future__ import annotations

import atexit
import struct
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, discard, remove, shared_dir, slices, words, written

HEAVY = 2000
HEAVY_GROUP = 16
#: Words whose contexts are sent by number, of those that some batch has COMMON_TIMES times; a matter of coding alone.
COMMON, COMMON_TIMES = 60_000, 8
#: Steps in which sums of base logarithms and of log10 probabilities are sent back.
BASE_STEP, LOG_STEP = 2.0**-30, 2.0**-20
BURN_IN, SAMPLES = 1, 3
D0, THETA0, D1, THETA1 = 0.5, 1.0, 0.75, 1.0
#: Text bytes of one part, and tokens that a task sorts at once.
PART_BYTES, BATCH_TOKENS = 10 << 20, 600_000
NOTHING = np.zeros(0, np.uint64)
#: The end of a text and the context of its first token; no word holds a space.
END, BEGIN = xxhash.xxh3_64_intdigest(b" "), xxhash.xxh3_64_intdigest(b"  ")


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers as differences if they do not fall, in as few bytes as they need, the like bytes together."""
    head, body = [struct.pack("<B", len(arrays))], []
    for name, x in arrays.items():
        kind, y, rising = x.dtype.str.encode(), x, 0
        if x.dtype.kind in "iu" and len(x) and (x.dtype.kind == "u" or x.min() >= 0):
            if rising := int(bool((x[1:] >= x[:-1]).all())):
                y = np.diff(x, prepend=x.dtype.type(0))
            y = y.astype(np.min_scalar_type(y.max()), copy=False)
        stored = y.dtype.str.encode()
        head.append(struct.pack("<B3sB3sI", len(name), kind, rising, stored, len(x)) + name.encode())
        body.append(np.ascontiguousarray(y).view(np.uint8).reshape(len(y), -1).T.tobytes() if len(y) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, fields, out = 1, [], {}
    for _ in range(raw[0]):
        long_, kind, rising, stored, n = struct.unpack_from("<B3sB3sI", raw, at)
        at += struct.calcsize("<B3sB3sI")
        fields.append((raw[at : at + long_].decode(), np.dtype(kind.decode()), rising, np.dtype(stored.decode()), n))
        at += long_
    for name, kind, rising, stored, n in fields:
        size = n * stored.itemsize
        y = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(stored.itemsize, n).T).view(stored).reshape(n)
        out[name] = np.cumsum(y, dtype=kind) if rising else y.astype(kind)
        at += size
    return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = _Hashes()


def _tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's tokens, the end included, and of the tokens before them."""
    tokens = words(text)
    h = np.empty(len(tokens) + 1, np.uint64)
    h[:-1] = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    h[-1] = END
    context = np.empty(len(h), np.uint64)
    context[0] = BEGIN
    context[1:] = h[:-1]
    return h, context


def _row_key(key: int | None, text: str | None) -> int:
    """Names a row; rows that repeat key and text share the name, and also their scores."""
    return xxhash.xxh3_64_intdigest(f"{key} {'' if text is None else text}".encode("utf-8", "surrogatepass"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(key, text, train, hashes, contexts) of rows, about BATCH_TOKENS at a time."""
    out, n = [], 0
    for part in slices(batches):
        for key, text, train in zip(*(c.to_pylist() for c in part.columns[:3]), strict=True):
            h, context = _tokens(text)
            out.append((key, text, train, h, context))
            n += len(h)
            if n >= BATCH_TOKENS:
                yield out
                out, n = [], 0
    if out:
        yield out


def frequent_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all tokens that are more than 1 / HEAVY of the training tokens, and of BEGIN and END; hashes of common tokens, the most frequent first.

    A token that frequent is so in one batch at least; each batch names those, and their sums are kept if large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for part in slices(batches):
            for text, train in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if train:
                    tokens = words(text)
                    counts.update(tokens)
                    counts[b" "] += 1
                    total += len(tokens) + 1
            if total >= BATCH_TOKENS:
                yield emit(counts, total)
                counts, total = Counter(), 0
        if total:
            yield emit(counts, total)

    def emit(counts: Counter, total: int) -> pa.RecordBatch:
        much = [(xxhash.xxh3_64_intdigest(w), c) for w, c in counts.items() if c >= COMMON_TIMES or c * HEAVY >= total]
        much.append((-1, total))
        return pa.record_batch([pa.array([np.uint64(w).astype(np.int64) if w >= 0 else None for w, _ in much], pa.int64()), pa.array([c for _, c in much], pa.int64())], ["w", "c"])

    sums = checkpoint(rows.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    total = sums.filter("w is null").agg(F.sum("c")).first()[0] or 0
    got = sums.filter(F.col("w").isNotNull() & (F.col("c") * HEAVY >= total)).select("w").collect()
    common = sums.filter("w is not null").orderBy(F.desc("c"), "w").limit(COMMON).select("w").collect()
    heavy, common = (np.array([r[0] for r in x], np.int64).view(np.uint64) for x in (got, common))
    return np.unique(np.append(heavy, np.array([BEGIN, END], np.uint64))), common


def _index(heavy: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in heavy, -1 for what is not there."""
    at = np.searchsorted(heavy, h)
    at[at == len(heavy)] = 0
    return np.where(heavy[at] == h, at, -1)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash; it does not fall as the hash grows."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _cuts(groups: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(group, from, to) of the groups 0 to n - 1 that occur in a sorted array."""
    cuts = np.searchsorted(groups, np.arange(n + 1))
    return ((g, int(a), int(b)) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a)


def _emit(out: list[tuple[int, bytes]], name: str, kind: pa.DataType = pa.int32()) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(out), 64):
        some = out[lo : lo + 64]
        yield pa.record_batch([pa.array([p for p, _ in some], kind), pa.array([d for _, d in some], pa.binary())], [name, "data"])


def _route(rows: DataFrame, heavy: np.ndarray, parts: int, common: np.ndarray = NOTHING) -> DataFrame:
    """part, data: training counts of heavy words after heavy ones (part < 0), and all other tokens with their rows.

    The rows of a batch are numbered, those of training first; one part, the batch's home, gets their names. Contexts are numbered, too:
    the common words first, then the piece's other contexts.
    """
    order_ = np.argsort(common)
    sorted_ = common[order_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, rows_ in enumerate(_batches(batches)):
            rows_.sort(key=lambda r: not r[2])
            keys = np.array([_row_key(r[0], r[1]) for r in rows_], np.uint64)
            batch, first = xxhash.xxh3_64_intdigest(struct.pack("<qq", task, number) + keys.tobytes()), sum(r[2] for r in rows_)
            h = np.concatenate([r[3] for r in rows_])
            context = np.concatenate([r[4] for r in rows_])
            row = np.repeat(np.arange(len(rows_), dtype=np.uint32), [len(r[3]) for r in rows_])
            del rows_
            word_at, context_at = _index(heavy, h), _index(heavy, context)
            both = (word_at >= 0) & (context_at >= 0)
            seen = both & (row < first)
            out: list[tuple[int, bytes]] = []
            code, count = np.unique(word_at[seen] * len(heavy) + context_at[seen], return_counts=True)
            for g, a, b in _cuts(code // (HEAVY_GROUP * len(heavy)), -(-len(heavy) // HEAVY_GROUP)):
                out.append((-1 - g, _pack(code=code[a:b], count=count[a:b])))
            rest = ~both
            part = _part(np.where(word_at < 0, h, context)[rest], parts)
            h, context, row = h[rest], context[rest], row[rest]
            order = np.lexsort((h, part))
            h, context, row, part = h[order], context[order], row[order], part[order]
            place = _index(sorted_, context) if len(common) else np.full(len(context), -1)
            place = np.where(place >= 0, order_[place], -1) if len(common) else place
            about, home = {"batch": np.array([batch], np.uint64), "first": np.array([first])}, batch % parts
            sent = False
            for p, a, b in _cuts(part, parts):
                word, times = np.unique(h[a:b], return_counts=True)
                code = place[a:b]
                rare = code < 0
                before, code[rare] = np.unique(context[a:b][rare], return_inverse=True)
                code[rare] += len(common)
                sent |= p == home
                out.append((p, _pack(**about, word=word, times=times, before=before, code=code, row=row[a:b], **({"keys": keys} if p == home else {}))))
            if not sent:
                none = np.zeros(0, np.int64)
                out.append((home, _pack(**about, word=NOTHING, times=none, before=NOTHING, code=none, row=none.astype(np.uint32), keys=keys)))
            yield from _emit(out, "part")

    return rows.mapInArrow(run, "part int, data binary")


def _gather(routed: DataFrame, heavy: np.ndarray, common: np.ndarray = NOTHING) -> DataFrame:
    """part, counts (of (word, context) pairs), tokens (pair and row of every token): one row a part."""

    def pairs(word: np.ndarray, word_at: np.ndarray, context: np.ndarray, context_at: np.ndarray) -> tuple:
        code, pair = np.unique(word_at.astype(np.int64) * len(context) + context_at, return_inverse=True)
        return pair, {"word": word, "context": context, "pair_word": (code // len(context)).astype(np.uint32), "pair_context": (code % len(context)).astype(np.uint32)}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        pieces = [_unpack(x.as_py()) for x in table["data"]]
        if part < 0:
            code = np.concatenate([p["code"] for p in pieces])
            code, at = np.unique(code, return_inverse=True)
            c = np.bincount(at, np.concatenate([p["count"] for p in pieces]), len(code)).astype(np.int64)
            word, word_at = np.unique(code // len(heavy), return_inverse=True)
            _, counts = pairs(heavy[word], word_at, heavy, code % len(heavy))
            return pa.table({"part": pa.array([part], pa.int32()), "counts": [_pack(**counts, c=c)], "tokens": pa.array([None], pa.binary())})
        pieces.sort(key=lambda p: p["batch"][0])
        batch, first = (np.concatenate([p[x] for p in pieces]) for x in ("batch", "first"))
        names = [p["keys"] if "keys" in p else NOTHING for p in pieces]
        n = np.array([len(p["row"]) for p in pieces])
        ends = np.cumsum(n)
        start = np.cumsum([0, *(len(p["before"]) for p in pieces[:-1])])
        row = np.concatenate([p["row"] for p in pieces])
        code = np.concatenate([np.where(p["code"] >= len(common), p["code"] + s, p["code"]) for p, s in zip(pieces, start, strict=True)])
        words_, times, before = (np.concatenate([p[x] for p in pieces]) for x in ("word", "times", "before"))
        del pieces
        used = np.zeros(len(common), bool)
        used[code[code < len(common)]] = True
        word, context = np.unique(words_), np.unique(np.concatenate([common[used], before]))
        word_at = np.repeat(np.searchsorted(word, words_), times)
        context_at = np.searchsorted(context, np.concatenate([common, before]))[code]
        del words_, times, before, code
        pair, counts = pairs(word, word_at, context, context_at)
        del word_at, context_at
        c = np.bincount(pair, row < np.repeat(first, n), len(counts["pair_word"])).astype(np.int64)
        pair, of, place, k = pair.astype(np.uint32), row, [], 0
        for i, b in enumerate(ends):
            a = b - n[i]
            order = np.argsort(pair[a:b])
            pair[a:b] = pair[a:b][order]
            mine, short = np.unique(row[a:b][order], return_inverse=True)
            of[a:b] = short + k
            place.append(mine)
            k += len(mine)
        tokens = _pack(
            batch=batch, rows=np.array([len(x) for x in place]), place=np.concatenate(place), pair=np.diff(pair, prepend=np.uint32(0)), row=of, names=np.array([len(x) for x in names]), keys=np.concatenate(names)
        )
        return pa.table({"part": pa.array([part], pa.int32()), "counts": [_pack(**counts, c=c)], "tokens": [tokens]})

    return routed.groupBy("part").applyInArrow(run, "part int, counts binary, tokens binary")


def seat(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers each, seated one after the other; a is the weight of the parent.

    Beyond the 64th customer, those of a run of i / 16 are drawn at once with the chances of its middle.
    """
    t = np.minimum(c, 1).astype(np.float64)
    live = np.flatnonzero(c > 1)
    i = 1
    while len(live):
        run = 1 if i < 64 else i // 16
        n = np.minimum(run, c[live] - i)
        chance = a[live] / (a[live] + np.maximum(i + (n - 1) / 2 - d * t[live], 1e-9))
        t[live] += rng.random(len(live)) < chance if run == 1 else rng.binomial(n, chance)
        i += run
        live = live[c[live] > i]
    return t


def _root_weight(totals: dict) -> float:
    """What the root gives to any word of the vocabulary, or an unknown one, beside its own customers."""
    return (THETA0 + D0 * totals["root_t"]) / (totals["vocabulary"] + 1)


class Seating:
    """The chain of sweeps over one part's counts, given the totals before each sweep.

    totals: of heavy words and contexts, and of the root (see _totals). replies: (sweep, owner, data) messages with the
    totals of the light contexts, in the order of their hashes, and (owner < 0) the seats after a sweep done before.
    """

    def __init__(self, part: int, counts: dict[str, np.ndarray], heavy: np.ndarray, replies: list[tuple[int, int, bytes]] = ()):
        self.part, self.word, self.context = part, counts["word"], counts["context"]
        self.pair_word, self.pair_context, self.c = counts["pair_word"].astype(np.intp), counts["pair_context"].astype(np.intp), counts["c"]
        word_at, context_at = _index(heavy, self.word), _index(heavy, self.context)
        self.heavy_words, self.heavy_contexts, self.light = np.flatnonzero(word_at >= 0), np.flatnonzero(context_at >= 0), np.flatnonzero(context_at < 0)
        self.heavy_word_at, self.heavy_context_at = word_at[self.heavy_words], context_at[self.heavy_contexts]
        self.word_c = np.bincount(self.pair_word, self.c, len(self.word))
        self.tables = (self.c > 0).astype(np.float64)
        self.twice = np.bincount(self.pair_context, self.c > 1, len(self.context)) > 0
        self.alive, self.context_c, self.context_t = np.ones(len(self.light), bool), np.zeros(len(self.context)), np.zeros(len(self.context))
        self.replies: dict[int, list[dict]] = {}
        self.seats: dict[int, bytes] = {}
        for sweep, owner, data in sorted(replies, key=lambda r: r[:2]):
            if owner < 0:
                self.seats[sweep] = data
            else:
                self.replies.setdefault(sweep, []).append(_unpack(data))
        self._root(None, 0)

    def _root(self, totals: dict | None, sweep: int) -> None:
        self.root_c = np.bincount(self.pair_word, self.tables, len(self.word))
        if totals is None:
            self.root_t = (self.root_c > 0).astype(np.float64)
        else:
            a = np.full(len(self.word), _root_weight(totals))
            # customers of heavy words sit in many parts, so their tables are drawn with the totals
            mine = self.root_c.astype(np.int64)
            mine[self.heavy_words] = 0
            self.root_t = seat(mine, a, D0, np.random.default_rng([7, sweep, self.part & 0xFFFFFFFF]))

    def see(self, number: int, totals: dict) -> None:
        """Takes the totals after sweep number - 1 of all contexts of this part."""
        self.context_c[self.heavy_contexts] = totals["context_c"][self.heavy_context_at]
        self.context_t[self.heavy_contexts] = totals["context_t"][self.heavy_context_at]
        got = self.replies.get(number, [])
        if got:
            self.context_t[self.light[self.alive]] = np.concatenate([x["t"] for x in got])
            if number == 0:
                self.context_c[self.light] = np.concatenate([x["c"] for x in got])
                self.alive = np.concatenate([x["alive"] for x in got])

    def parent(self, totals: dict) -> np.ndarray:
        c, t = self.root_c.copy(), self.root_t.copy()
        c[self.heavy_words], t[self.heavy_words] = totals["heavy_c"][self.heavy_word_at], totals["heavy_t"][self.heavy_word_at]
        return (c - D0 * t + _root_weight(totals)) / (THETA0 + totals["root_c"])

    def seated(self) -> bytes:
        """The seats after a sweep, where there was a choice."""
        return _pack(tables=_small(self.tables[self.c > 1]), root=_small(self.root_t[self.root_c > 1]))

    def sweep(self, number: int, totals: dict) -> None:
        self.see(number, totals)
        if number in self.seats:
            seats = _unpack(self.seats[number])
            self.tables = (self.c > 0).astype(np.float64)
            self.tables[self.c > 1] = seats["tables"]
            self.root_c = np.bincount(self.pair_word, self.tables, len(self.word))
            self.root_t = (self.root_c > 0).astype(np.float64)
            self.root_t[self.heavy_words] = 0
            self.root_t[self.root_c > 1] = seats["root"]
            return
        a = (THETA1 + D1 * self.context_t[self.pair_context]) * self.parent(totals)[self.pair_word]
        self.tables = seat(self.c, a, D1, np.random.default_rng([3, number, self.part & 0xFFFFFFFF]))
        self._root(totals, number)

    def own(self) -> np.ndarray:
        """What each pair's word has of its own in its context, once the totals of this sweep were seen."""
        return np.maximum(self.c - D1 * self.tables, 0) / (THETA1 + self.context_c[self.pair_context])

    def predictive(self, number: int, totals: dict) -> np.ndarray:
        """Probability of each pair's word in its context, with the totals of this very sweep."""
        self.see(number, totals)
        context = self.pair_context
        return self.own() + (THETA1 + D1 * self.context_t[context]) / (THETA1 + self.context_c[context]) * self.parent(totals)[self.pair_word]


@contextmanager
def _one_row_batches(spark: SparkSession) -> Iterator[None]:
    """A bucket may hold several parts; sent to Python one by one, they do not stand in memory together."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Chain:
    """The parts, bucketed by part, with the totals after each sweep and the replies to each part."""

    def __init__(self, gathered: DataFrame, heavy: np.ndarray, parts: int):
        self.heavy, self.parts = heavy, parts
        self.table, self.history, self.replies = self.bucketed(gathered, "pylm"), [], None

    def bucketed(self, df: DataFrame, name: str) -> DataFrame:
        """df, dealt by part, in buckets of parts; the shuffle files of its plan may go, as with written()."""
        spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{name}"
        df.write.bucketBy(self.parts, "part").option("path", path).saveAsTable(name)
        atexit.register(remove, spark, path)
        spark.sparkContext._jvm.System.gc()
        return spark.table(name)

    def rows(self, *columns: str) -> DataFrame:
        """part, columns and replies, one row a part; both are in buckets already."""
        own = self.table.select("part", *columns)
        if self.replies is None:
            return own.withColumn("replies", F.lit(None).cast("array<struct<sweep:int,owner:int,data:binary>>"))
        return own.join(self.replies.hint("merge"), "part", "left")

    def seatings(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
        """Reads batches of rows(): (seating, further columns) one part at a time."""
        heavy = self.heavy

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {name: column[at] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                    some = row.pop("replies").values
                    replies = [] if some is None else [(i, o, d.as_buffer()) for i, o, d in zip(some.field(0).to_pylist(), some.field(1).to_pylist(), some.field(2), strict=True)]
                    del some
                    yield Seating(row.pop("part").as_py(), _unpack(row.pop("counts").as_buffer()), heavy, replies), row
                    del row, replies
                pa.default_memory_pool().release_unused()

        return read

    def sweep(self) -> None:
        """Adds the totals after one sweep more than before (at first: one table a pair), and the replies about light contexts."""
        read, history, heavy, parts = self.seatings(), self.history, self.heavy, self.parts
        n, now = len(heavy), len(history)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(4 * n + 4)
            for s, _ in read(batches):
                for number, totals in enumerate(history):
                    s.sweep(number, totals)
                if now:
                    yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([s.part], pa.int32()), pa.array([s.seated()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64())], ["owner", "src", "data", "i", "v"])
                t = np.bincount(s.pair_context, s.tables, len(s.context))
                c = np.bincount(s.pair_context, s.c, len(s.context))
                np.add.at(sums, s.heavy_context_at, c[s.heavy_contexts])
                np.add.at(sums, n + s.heavy_context_at, t[s.heavy_contexts])
                np.add.at(sums, 2 * n + s.heavy_word_at, s.root_c[s.heavy_words])
                np.add.at(sums, 3 * n + s.heavy_word_at, s.word_c[s.heavy_words])
                light = np.ones(len(s.word), bool)
                light[s.heavy_words] = False
                sums[4 * n :] += [s.root_c[light].sum(), s.root_t[light].sum(), (s.word_c[light] > 0).sum(), s.word_c[light].sum()]
                some = s.light[s.alive]
                ups = []
                for owner, a, b in _cuts(_part(s.context[some], parts), parts):
                    mine = some[a:b]
                    ups.append((owner, _pack(context=s.context[mine], t=_small(t[mine]), **({"c": _small(c[mine]), "twice": s.twice[mine]} if now == 0 else {}))))
                for lo in range(0, len(ups), 64):
                    out, k = ups[lo : lo + 64], len(ups[lo : lo + 64])
                    yield pa.record_batch([pa.array([o for o, _ in out], pa.int32()), pa.array([s.part] * k, pa.int32()), pa.array([d for _, d in out], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.float64())], ["owner", "src", "data", "i", "v"])
            i = np.flatnonzero(sums)
            yield pa.record_batch([pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.binary()), pa.array(i, pa.int32()), pa.array(sums[i])], ["owner", "src", "data", "i", "v"])

        def reply(key: tuple, table: pa.Table) -> pa.Table:
            src = table["src"].to_pylist()
            asked = [_unpack(x.as_py()) for x in table["data"]]
            context, at = np.unique(np.concatenate([x["context"] for x in asked]), return_inverse=True)

            def total(name: str) -> np.ndarray:
                return np.bincount(at, np.concatenate([x[name] for x in asked]), len(context))

            sums = {name: total(name) for name in asked[0] if name != "context"}
            ends, out = np.cumsum([len(x["context"]) for x in asked])[:-1], []
            for mine in np.split(at, ends):
                got = {"t": _small(sums["t"][mine])}
                if "c" in sums:
                    got |= {"c": _small(sums["c"][mine]), "alive": sums["twice"][mine] > 0}
                out.append(_pack(**got))
            k = len(src)
            return pa.table({"part": pa.array(src, pa.int32()), "sweep": pa.array([now] * k, pa.int32()), "owner": pa.array([key[0].as_py()] * k, pa.int32()), "data": pa.array(out, pa.binary())})

        with _one_row_batches(self.table.sparkSession):
            ups = written(self.rows("counts").mapInArrow(run, "owner int, src int, data binary, i int, v double"), "ups")
        sums = np.zeros(4 * n + 4)
        for i, v in ups.filter("i is not null").groupBy("i").agg(F.sum("v")).collect():
            sums[i] = v
        context_c, context_t, heavy_c, word_c = sums[: 4 * n].reshape(4, n)
        light_c, light_t, light_words, light_tokens = sums[4 * n :]
        if history:
            heavy_t = seat(heavy_c.astype(np.int64), np.full(n, _root_weight(history[-1])), D0, np.random.default_rng([11, now]))
        else:
            heavy_t = (heavy_c > 0).astype(np.float64)
        self.history.append(
            {"context_c": context_c, "context_t": context_t, "heavy_c": heavy_c, "heavy_t": heavy_t, "word_c": word_c, "root_c": light_c + heavy_c.sum(), "root_t": light_t + heavy_t.sum(), "vocabulary": int(light_words + (word_c > 0).sum()), "tokens": int(light_tokens + word_c.sum())}
        )
        got = ups.filter("owner >= 0").select("owner", "src", "data").groupBy("owner").applyInArrow(reply, "part int, sweep int, owner int, data binary")
        seats = ups.filter("owner < 0").select(F.col("src").alias("part"), F.lit(now - 1).alias("sweep"), "owner", "data")
        new = got.union(seats).groupBy("part").agg(F.collect_list(F.struct("sweep", "owner", "data")).alias("new"))
        old = self.replies
        if old is None:
            self.replies = self.bucketed(new.withColumnRenamed("new", "replies"), "replies")
        else:
            none = F.array().cast("array<struct<sweep:int,owner:int,data:binary>>")
            both = old.hint("merge").join(new, "part", "full").select("part", F.concat(F.coalesce("replies", none), F.coalesce("new", none)).alias("replies"))
            self.replies = self.bucketed(both, "replies")
            discard(old)
        discard(ups)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they all need."""
    top = x.max() if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint64)


def _heavy_table(chain: Chain) -> np.ndarray:
    """log10 probabilities [word, context] of the heavy words after heavy ones: HEAVY^2 numbers at most."""
    heavy, read, history = chain.heavy, chain.seatings(), chain.history

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _ in read(batches):
            own = np.zeros(len(s.c))
            for number in range(len(history) - 1):
                s.sweep(number, history[number])
                if number >= BURN_IN:
                    s.see(number + 1, history[number + 1])
                    own += s.own()
            code = _index(heavy, s.word)[s.pair_word] * len(heavy) + s.pair_context
            yield pa.record_batch([pa.array([_pack(code=code, own=own)], pa.binary())], ["data"])

    table = np.zeros((len(heavy), len(heavy)))
    for t in history[1 + BURN_IN :]:
        parent = (t["heavy_c"] - D0 * t["heavy_t"] + _root_weight(t)) / (THETA0 + t["root_c"])
        table += parent[:, None] * ((THETA1 + D1 * t["context_t"]) / (THETA1 + t["context_c"]))[None, :]
    with _one_row_batches(chain.table.sparkSession):
        own = written(chain.rows("counts").filter("part < 0").mapInArrow(run, "data binary"), "own")
    for (data,) in own.toLocalIterator():
        some = _unpack(data)
        table.reshape(-1)[some["code"]] += some["own"]
    return np.log10(table / (len(history) - 1 - BURN_IN)).astype(np.float32)


def _light_sums(chain: Chain, buckets: int) -> DataFrame:
    """bucket, data: per row, of its tokens in all parts, the known ones and the sums of log10(c + 1) and of log10 probabilities."""
    read, history = chain.seatings(), chain.history

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, more in read(batches):
            part, sum_ = s.part, np.zeros(len(s.c))
            for number in range(len(history) - 1):
                s.sweep(number, history[number])
                if number >= BURN_IN:
                    sum_ += s.predictive(number + 1, history[number + 1])
            logs = np.log10(sum_ / (len(history) - 1 - BURN_IN))
            s.word_c[s.heavy_words] = history[-1]["word_c"][s.heavy_word_at]
            c = s.word_c[s.pair_word]
            del s, sum_
            known, base = (c > 0).astype(np.float64), np.log10(c + 1.0)
            t = _unpack(more.pop("tokens").as_buffer())
            row, pair, n = t["row"], np.cumsum(t["pair"], dtype=np.uint32), len(t["place"])
            known, base, logs = (np.bincount(row, x[pair], n) for x in (known, base, logs))
            known, base, logs = known.astype(np.int64), np.round(base / BASE_STEP).astype(np.int64), np.round(-logs / LOG_STEP).astype(np.int64)
            ends, named = np.cumsum(t["rows"]), np.cumsum(t["names"])
            out = []
            for i, batch in enumerate(t["batch"].view(np.int64).tolist()):
                a, b = ends[i] - t["rows"][i], ends[i]
                keys = {"keys": t["keys"][named[i] - t["names"][i] : named[i]]} if t["names"][i] else {}
                out.append((batch, _pack(part=np.array([part]), place=t["place"][a:b], known=known[a:b], base=base[a:b], logs=logs[a:b], **keys)))
            yield from _emit(out, "batch", pa.int64())

    def name(group: tuple, batch: pa.Table) -> pa.Table:
        pieces = sorted((_unpack(x.as_py()) for x in batch["data"]), key=lambda p: p["part"][0])
        (keys,) = (p["keys"] for p in pieces if "keys" in p)
        at = np.concatenate([p["place"] for p in pieces])
        known, base, logs = (np.bincount(at, np.concatenate([p[x] for p in pieces]), len(keys)) for x in ("known", "base", "logs"))
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        split = [(b, order[x:y]) for b, x, y in _cuts(bucket[order], buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in split], pa.int32()), "data": pa.array([_pack(keys=keys[o], known=known[o], base=base[o] * BASE_STEP, logs=logs[o] * -LOG_STEP) for _, o in split], pa.binary())})

    sums = chain.rows("counts", "tokens").filter("part >= 0").mapInArrow(run, "batch long, data binary")
    with _one_row_batches(chain.table.sparkSession):
        return written(sums.groupBy("batch").applyInArrow(name, "bucket int, data binary"), "sums")


def _heavy_sums(rows: DataFrame, heavy: np.ndarray, table: np.ndarray, count: np.ndarray, buckets: int) -> DataFrame:
    """The same for heavy tokens after heavy ones, where the texts are; also names every row."""
    shipped = rows.sparkSession.sparkContext.broadcast((heavy, table, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, table, count = shipped.value
        log_c = np.log10(count + 1.0)
        for rows_ in _batches(batches):
            keys = np.array([_row_key(r[0], r[1]) for r in rows_], np.uint64)
            known, base, logs = np.zeros((3, len(rows_)))
            for i, (_, _, _, h, context) in enumerate(rows_):
                at, before = _index(heavy, h), _index(heavy, context)
                hit = (at >= 0) & (before >= 0)
                at, before = at[hit], before[hit]
                known[i], base[i], logs[i] = (count[at] > 0).sum(), log_c[at].sum(), table[at, before].sum(dtype=np.float64)
            ids = np.array([0 if r[0] is None else r[0] for r in rows_], np.int64)
            null, train, n = np.array([r[0] is None for r in rows_], bool), np.array([r[2] for r in rows_], bool), np.array([len(r[3]) for r in rows_])
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            split = ((b, order[x:y]) for b, x, y in _cuts(bucket[order], buckets))
            out = [(b, _pack(keys=keys[o], known=known[o], base=base[o], logs=logs[o], ids=ids[o], null=null[o], train=train[o], n=n[o])) for b, o in split]
            yield from _emit(out, "bucket")

    return rows.mapInArrow(run, "bucket int, data binary")


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text.

    train: condition on docs for the rows that the model learns from (null counts as true). Null texts are
    empty: their only token is the end. Repeated rows are scored alike and each gives a row; with train false
    everywhere all words are unknown. Other columns do not matter; no rows give no rows.
    """
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(size // PART_BYTES))
    heavy, common = frequent_words(rows)
    chain = Chain(_gather(_route(rows, heavy, parts, common), heavy, common), heavy, parts)
    for _ in range(1 + BURN_IN + SAMPLES):
        chain.sweep()
    last = chain.history[-1]
    table = _heavy_table(chain)
    sums = _light_sums(chain, parts).unionByName(_heavy_sums(rows, heavy, table, last["word_c"], parts))
    tokens, vocabulary = last["tokens"], last["vocabulary"]

    def merge(group: tuple, batch: pa.Table) -> pa.Table:
        pieces = sorted((_unpack(x.as_py()) for x in batch["data"]), key=lambda p: (p["keys"].tobytes(), p["logs"].tobytes()))
        keys, at = np.unique(np.concatenate([p["keys"] for p in pieces]), return_inverse=True)
        names = [p for p in pieces if "ids" in p]
        own = np.searchsorted(keys, np.concatenate([p["keys"] for p in names]))
        times = np.bincount(own, minlength=len(keys))[own]
        known, base, logs = (np.bincount(at, np.concatenate([p[x] for p in pieces]), len(keys))[own] / times for x in ("known", "base", "logs"))
        known, n = np.round(known), np.concatenate([p["n"] for p in names])
        ids = pa.array(np.concatenate([p["ids"] for p in names]), mask=np.concatenate([p["null"] for p in names]))
        base = base - n * np.log10(tokens + vocabulary + 1.0)
        return pa.table(
            {"key": ids, "held_out": ~np.concatenate([p["train"] for p in names]), "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": np.full(len(own), tokens, np.int64), "base_score": base, "score": logs, "perplexity": 10 ** (-logs / n)}
        )

    schema = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return sums.groupBy("bucket").applyInArrow(merge, schema).withColumnRenamed("key", key)
