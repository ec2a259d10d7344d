"""Byte-level BPE: boundaries by a scan of transition functions, then cached pair merging.

A text becomes an array of code points, each code point a symbol (letter, digit, other,
space, ...). A small automaton walks the symbols and says where a piece starts. Its
transition functions form a finite set closed under composition, so the walk is an
associative scan over a table of compositions; no regular expression is involved. The
pieces, as byte slices, are looked up in a bounded cache; pieces not in it are merged
together, one lowest-ranked pair per piece and step, in numpy.

Edge cases: a null text is encoded as the empty text (no ids, empty bytes); nothing is
done for special tokens; a text of any length is encoded whole; repeated rows give
repeated results; an empty table gives an empty table. Only the named columns are read,
so other columns of any name do not matter.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

# Text bytes worked on at once; a longer single text is taken alone.
CHUNK_BYTES = 1_000_000
# Pieces kept in the cache of a worker; the cache starts anew when it is full.
CACHE_PIECES = 300_000
# Pieces longer than this are merged with a heap instead of step by step.
LONG_PIECE = 128

# Symbols. A "last" space is followed by something that is not white space.
LETTER, DIGIT, OTHER, SPACE_LAST, WHITE_LAST, WHITE, SHORT, LONG, RESET = range(9)
# States: inside a run, after a space that joins what follows, inside white space, with
# one or two letters of a contraction to come, or at a point where a piece must start.
IN_LETTERS, IN_DIGITS, IN_OTHER, GLUE, IN_WHITE, ONE_MORE, TWO_MORE, FRESH = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this symbol."""
    if symbol == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, GLUE)
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, GLUE)
    if symbol in (SHORT, LONG) and state not in (IN_OTHER, GLUE):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol in (OTHER, SHORT, LONG):
        return IN_OTHER, state not in (IN_OTHER, GLUE)
    if symbol == SPACE_LAST:
        return GLUE, True
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    return FRESH, True  # WHITE_LAST, RESET


@lru_cache(maxsize=1)
def _automaton():
    """Function number of each symbol, table of compositions, functions, and starts."""
    generators = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    functions = [tuple(range(8))]
    number = {functions[0]: 0}
    for f in functions:  # grows while it is walked, until closed
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions],
                       np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return (np.array([number[g] for g in generators], np.uint8), compose,
            np.array(functions, np.uint8), starts)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Symbol of every code point, white space as WHITE; one more entry for RESET."""
    import regex

    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    table = np.full(0x110001, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\p{White_Space}", WHITE)):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = symbol
    table[0x110000] = RESET
    return table


def _scan(functions: np.ndarray) -> np.ndarray:
    """Composition of all functions up to each place, blockwise: along the blocks, over
    the blocks' totals, and both together."""
    _, compose, _, _ = _automaton()
    n, width = len(functions), 64
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    padded = np.zeros(-(-n // width) * width, np.uint8)  # function 0 changes nothing
    padded[:n] = functions
    blocks = np.ascontiguousarray(padded.reshape(-1, width).T)
    for i in range(1, width):
        blocks[i] = compose[blocks[i - 1], blocks[i]]
    totals = _scan(blocks[-1])
    before = np.concatenate([np.zeros(1, np.uint8), totals[:-1]])
    return compose[before[None, :], blocks].T.reshape(-1)[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Indexes of code points at which a piece starts; 0x110000 parts two texts."""
    first, _, functions, starts = _automaton()
    symbols = _classes()[points]
    follows = np.append(symbols[1:], RESET)
    white = symbols == WHITE
    last = white & (follows != WHITE) & (follows != RESET)
    symbols[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
    quote = np.flatnonzero(points == 39)
    if len(quote):
        room = np.append(points, [0x110000, 0x110000])
        a, b = room[quote + 1], room[quote + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (a == ord(pair[0])) & (b == ord(pair[1]))
        symbols[quote[short]], symbols[quote[long]] = SHORT, LONG
    after = functions[_scan(first[symbols]), FRESH]
    before = np.append(np.uint8(FRESH), after[:-1])
    return np.flatnonzero(starts[before, symbols])


class Vocabulary:
    """A rank file: bytes of each id, and the id of each pair that may be merged."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                left, right = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = np.array(keys)[order], np.array(merged)[order]
        self.none = size  # ranks above every real one
        self.cache: dict[bytes, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, ``none`` where the pair is not in the vocabulary."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], self.none)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, all merged side by side."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        result: list[bytes] = [b""] * len(pieces)

        def ranks(ids, owner):
            out = np.full(len(ids), self.none, np.int64)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            out[inner] = self.pair(ids[inner], ids[inner + 1])
            return out

        rank = ranks(ids, owner)
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(first, len(ids)))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == self.none
            if done.any():
                ended = np.repeat(done, count)
                flat = ids[ended].astype("<u4").tobytes()
                stop = np.cumsum(count[done]) * 4
                for who, a, b in zip(owner[first[done]].tolist(), (stop - count[done] * 4).tolist(),
                                     stop.tolist()):
                    result[who] = flat[a:b]
                keep = ~ended
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                continue
            hits = np.flatnonzero(rank == np.repeat(lowest, count))
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]  # leftmost of each
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            spot = hits - np.arange(len(hits))  # one place less for every earlier merge
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for at in (spot, spot[spot > 0] - 1):  # the new pair and the one before it
                rank[at] = self.none
                at = at[at + 1 < len(ids)]
                at = at[owner[at] == owner[at + 1]]
                rank[at] = self.pair(ids[at], ids[at + 1])
        return result

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece, with a heap of pairs."""
        none = self.none
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = {}

        def rank(a, b):
            key = (a, b)
            if key not in table:
                table[key] = int(self.pair(np.array([a]), np.array([b]))[0])
            return table[key]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := rank(ids[i], ids[i + 1])) < none]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (s := rank(ids[left], ids[right])) < none:
                    heappush(heap, (s, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian bytes."""
        cache = self.cache
        found = list(map(cache.get, pieces))
        gaps = [i for i, codes in enumerate(found) if codes is None]
        if gaps:
            missing = list({pieces[i] for i in gaps})
            short = [p for p in missing if len(p) <= LONG_PIECE]
            new = dict(zip(short, self.merge_many(short)))
            if len(cache) + len(new) > CACHE_PIECES:
                cache.clear()
            cache.update(new)
            for p in missing:
                if len(p) > LONG_PIECE:
                    new[p] = self.merge_long(p)
            for i in gaps:
                found[i] = new[pieces[i]]
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        points = np.concatenate([
            np.append(np.frombuffer(t.decode().encode("utf-32-le"), np.uint32), 0x110000)
            for t in texts]).astype(np.uint32)
        joined = b"\x00".join(texts) + b"\x00"  # one byte for each parting code point
        raw = np.frombuffer(joined, np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        begin = at[piece_starts(points)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = begin.tolist()
        pieces = [joined[a:b] for a, b in zip(cut, cut[1:] + [len(joined)])]
        parting = np.searchsorted(begin, ends - 1).tolist()
        codes, out, start = self.look_up(pieces), [], 0
        for stop in parting:
            out.append(b"".join(codes[start:stop]))
            start = stop + 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: each id's slice of the flat vocabulary, by its offset."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, once per worker."""
    return Vocabulary(path)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first, last, texts) of a binary column: rows whose sizes together stay near the
    limit. Only one chunk is held as Python objects."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield start, len(sizes), column.slice(start).to_pylist()


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           decode: bool = False) -> DataFrame:
    """Ids of every text by the rank file at ``path``.

    Returns ``key``, ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32
    bits each); with ``decode`` also ``decoded``, the bytes those ids stand for.
    """
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids", T.BinaryType())]
    if decode:
        fields.append(T.StructField("decoded", T.BinaryType()))

    def work(batches):
        words = vocabulary(path)
        for batch in batches:
            for a, b, texts in chunks(batch.column(1).cast(pa.binary())):
                ids = words.encode(texts)
                columns = [batch.column(0).slice(a, b - a),
                           pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(
                        [words.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids],
                        pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(work, T.StructType(fields))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded``, the bytes of the ids in the binary column ``ids``."""
    def work(batches):
        words = vocabulary(path)
        for batch in batches:
            out = [words.decode(np.frombuffer(x, "<u4").astype(np.int64))
                   for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             names=[key, "decoded"])

    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("decoded", T.BinaryType())]
    rows = df.select(F.col(key), F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))
    return rows.mapInArrow(work, T.StructType(fields))
