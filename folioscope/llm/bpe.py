"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges define a nondeterministic transducer: after any prefix it may be inside a token, at any
node of the trie of tokens, from any earlier position. Reading a byte moves all of these at
once. The set of nodes that are alive is fixed by its longest member (the others spell its suffixes),
so the determinised states are trie nodes; their moves are worked out when first needed and kept.
A state lists the tokens that can end there. A prefix has exactly one BPE encoding, and its last token is
the one that may follow the encoding of what stands before it: two tokens may stand side by side if
merging their bytes gives just these two. So each position gets one last token. Tokens
are emitted once every live node starts behind them, which is at most the longest token's length
later; that bounds the lookahead and what has to be remembered.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscope.llm.common import cache, map_slices

_ROOT = 0


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Reads a rank file: one 'base64 rank' pair a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class MergeTransducer:
    """Encodes pieces of bytes by merge ranks, as a deterministic transducer built while it runs."""

    #: Positions after which settled tokens are emitted and forgotten.
    STRIDE = 4096

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = 600_000, max_moves: int = 400_000):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 2
        self.spelling = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.max_pairs, self.max_moves = max_pairs, max_moves
        self.child: dict[int, int] = {}
        self.text_of = [b""]
        self.node_of = {b"": _ROOT}
        for tok in ranks:
            at = _ROOT
            for k, b in enumerate(tok):
                nxt = self.child.get(at << 8 | b)
                if nxt is None:
                    nxt = self.child[at << 8 | b] = len(self.text_of)
                    self.text_of.append(tok[: k + 1])
                    self.node_of[tok[: k + 1]] = nxt
                at = nxt
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self.ending: dict[int, tuple[tuple[int, int], ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The plain merge loop: the pair of lowest rank first, the leftmost of equals; ends at stop parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, tok: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of tok joins; None for one byte; (-1, -1) if no merges give it."""
        if tok not in self.halves:
            data = self.spelling[tok]
            parts = self.merged(data, 2) if len(data) > 1 else None
            self.halves[tok] = None if parts is None else (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
        return self.halves[tok]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens merge into just these two.

        Takes the merges inside them back, latest first; a merge across the border must not have
        come before the merge taken back last (of equal ranks the left one comes first).
        """
        limit = self.size
        while True:
            cross = self.ranks.get(self.spelling[left] + self.spelling[right])
            if cross is not None and cross < limit:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                if a[0] < 0:
                    return False
                limit, left = left, a[1]
            else:
                if b[0] < 0:
                    return False
                limit, right = right + 1, b[0]

    def _pair(self, key: int) -> bool:
        left, right = divmod(key, self.size)
        half = self._halves(right)
        ok = (half is None or half[0] >= 0) and (left == self.size - 1 or self.may_follow(left, right))
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Determinises one move: the longest suffix of what was read that is a node."""
        text = self.text_of[state] + bytes((byte,))
        at = 0
        while text[at:] not in self.node_of:
            at += 1
        nxt = self.node_of[text[at:]]
        if nxt not in self.ending:
            full = self.text_of[nxt]
            self.ending[nxt] = tuple((len(full) - k, self.ranks[full[k:]]) for k in range(len(full)) if full[k:] in self.ranks)
        if len(self.moves) >= self.max_moves:
            self.moves.clear()
        move = self.moves[state << 8 | byte] = (nxt << 8, self.ending[nxt])
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece. A piece that is a token is that token, even if no merges give it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        size, state, at = self.size, _ROOT, 0
        last = [size - 1]
        add, move_of, known = last.append, self.moves.get, self.pairs.get
        for b in piece:
            move = move_of(state | b)
            if move is None:
                move = self._move(state >> 8, b)
            state, ends = move
            at += 1
            for n, tok in ends:
                if n <= at:
                    key = last[at - n] * size + tok
                    ok = known(key)
                    if ok or ok is None and self._pair(key):
                        add(tok)
                        break
            if at > self.STRIDE:
                last = self._settle(out, last)
                at, add = len(last) - 1, last.append
        out += self._path(last, at)
        return out

    def _path(self, last: list[int], at: int) -> list[int]:
        tokens = []
        while at > 0:
            tokens.append(last[at])
            at -= len(self.spelling[last[at]])
        return tokens[::-1]

    def _settle(self, out: list[int], last: list[int]) -> list[int]:
        """Emits what all positions that a token may still start from have in common, and forgets it."""
        ways = set(range(max(0, len(last) - 1 - self.longest), len(last)))
        while len(ways) > 1:
            top = max(ways)
            ways.remove(top)
            ways.add(top - len(self.spelling[last[top]]))
        keep = ways.pop()
        out += self._path(last, keep)
        return last[keep:]


class Utf8Decoder:
    """Incremental UTF-8 state machine: bytes in, text out, an unfinished character is carried over.

    The state is (continuation bytes awaited, allowed range of the next one). It is run over the last
    few bytes of a chunk to find where the last whole character ends; bytes that can never
    form a character become U+FFFD.
    """

    def __init__(self) -> None:
        self.carried = b""

    @staticmethod
    def _start(b: int) -> tuple[int, int, int]:
        """State after a first byte: bytes awaited and the range of the next."""
        if 0xC2 <= b <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= b <= 0xEF:
            return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        if 0xF0 <= b <= 0xF4:
            return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return 0, 0, 0

    def feed(self, chunk: bytes) -> str:
        data = self.carried + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if 0x80 <= b <= 0xBF:
                continue
            await_, low, high = self._start(b)
            for c in data[len(data) - back + 1 :]:
                if not await_ or not low <= c <= high:
                    await_ = 0
                    break
                await_, low, high = await_ - 1, 0x80, 0xBF
            if await_:
                cut = len(data) - back
            break
        self.carried = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.carried = self.carried, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes and decodes whole texts; ids travel as packed little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 150_000):
        self.machine = MergeTransducer(ranks)
        self.find = regex.compile(pattern).findall
        machine = self.machine

        def pack(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        class Pieces(dict):
            """Ids of recent pieces, in two generations: what is used again outlives a full table."""

            older: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                got = self.older.get(piece)
                if got is None:
                    got = pack(machine.encode(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(self) >= max_pieces:
                        self.older = dict(self)
                        self.clear()
                    self[piece] = got
                return got

        self.pieces = Pieces()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text))) if text else b""


class Decoder:
    """Decodes ids; holds the spellings alone."""

    def __init__(self, ranks: dict[bytes, int]):
        spelling = {i: t for t, i in ranks.items()}
        self.vocabulary = [spelling.get(i, b"") for i in range(max(spelling, default=-1) + 1)]

    def decode_chunks(self, ids: bytes, tokens: int = 8192) -> Iterator[str]:
        """Decodes a stream of ids chunk by chunk."""
        machine, spell = Utf8Decoder(), self.vocabulary.__getitem__
        for at in range(0, len(ids), 4 * tokens):
            yield machine.feed(b"".join(map(spell, np.frombuffer(ids, "<u4", min(tokens, (len(ids) - at) // 4), at).tolist())))
        yield machine.close()

    def decode(self, ids: bytes | None) -> str:
        return "".join(self.decode_chunks(ids)) if ids else ""


_codecs: dict[tuple[int, str], Codec] = {}
_decoders: dict[int, Decoder] = {}
cache("bpe", _codecs.clear)


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def _decoder(data: bytes) -> Decoder:
    key = hash(data)
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(parse_ranks(data))
    return _decoders[key]


def encode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (packed little-endian uint32) of every row's whole text.

    rank_file is read by the driver; its size is that of one vocabulary. A null or empty text has no
    tokens. Every input row gives one row, repeated and null keys too; other columns do not matter.
    """
    with open(rank_file, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(data.value, pattern)
        ids = [codec.encode(t) for t in part.column(1).to_pylist()]
        return pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return map_slices(rows, run, f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids binary", "bpe").withColumnRenamed("key", key)


def decode(df: DataFrame, rank_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """All columns of encode()'s result and the text decoded from its ids, streamed through the UTF-8 machine."""
    with open(rank_file, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        decoder = _decoder(data.value)
        texts = [decoder.decode(x) for x in part.column(2).to_pylist()]
        return pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(texts, pa.string())], ["key", "n_tokens", "ids", "decoded"])

    rows = df.select(df[key].alias("key"), df["n_tokens"], df[ids].alias("ids"))
    return map_slices(rows, run, f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids binary, decoded string", "bpe").withColumnRenamed("key", key)
