"""Near copies by SimHash, found with a Gray-ordered hierarchical index.

A fingerprint has 64 bits; two texts are linked when theirs differ in at most four.
The top nodes of the index are shared masked bit patterns: the bits are cut into six
blocks, and a node is the value of two of them. Four differences leave at least two
blocks untouched, so linked fingerprints meet below at least one of the 15 masks. Below
a top node the fingerprints are sorted by Gray rank and grouped; a group keeps the bits
all its members share. Two groups whose shared bits already differ in more than four
places are left aside whole; two groups that cannot differ in more are linked whole.

A top node with very many fingerprints is dealt to several tasks as pairs of chunks.
Tasks return a spanning forest of the links they find, never all pairs.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero, and
such texts are linked like any others; equal texts have equal fingerprints and are one
point of the index; a null document id takes part, and a component without any id gets
a null component_id; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.scale import materialise
from .components import components, forest
from .places import numbered

WORDS = 4
MOST_BITS = 4
SEED = 42
# First bit and width of each of the six blocks of a fingerprint.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MASKS = tuple(combinations(range(6), 2))
# Fingerprints of a top node that one task takes; a fuller node is cut into chunks of half.
NODE_ROWS = 4096
# Fingerprints in a lower group.
GROUP = 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
# Texts of more bytes are taken in slices of so many words.
WHOLE_BYTES, SLICE = 1 << 22, 100_000


def _tokens(text: bytes):
    if len(text) <= WHOLE_BYTES:
        yield text.split()
        return
    found = map(re.Match.group, _TOKEN.finditer(text))
    while part := list(islice(found, SLICE)):
        yield part


def shingle_hashes(text: bytes, words: int = WORDS):
    """XXH64 values of the word shingles of a UTF-8 text, in slices."""
    from xxhash import xxh64_intdigest

    def hashed(tokens, size):
        line = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        begins = np.append(0, ends[:-1] + 1)
        return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in
                         zip(begins[:len(tokens) - size + 1].tolist(), ends[size - 1:].tolist())],
                        np.uint64)

    kept, some = [], False
    for tokens in _tokens(text.translate(_LOWER)):
        tokens = kept + tokens
        if len(tokens) >= words:
            some = True
            yield hashed(tokens, words)
        kept = tokens[-(words - 1):] if words > 1 else []
    if not some and kept:
        yield hashed(kept, len(kept))


def _majority(slices) -> int:
    """A bit is set where it is in over half of the hashes."""
    on, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        for i in range(0, len(hashes), SLICE):
            part = np.ascontiguousarray(hashes[i:i + SLICE])
            on += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(on * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text over the XXH64 values of its word shingles."""
    return _majority(shingle_hashes(text, words))


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "_fp", words: int = WORDS):
    """The rows with their fingerprint as a signed long in column ``name``."""
    @F.pandas_udf("long")
    def prints(texts):
        values = np.array([fingerprint(t.encode(), words) for t in texts], np.uint64)
        return type(texts)(values.view(np.int64))

    return df.withColumn(name, prints(F.coalesce(F.col(text), F.lit(""))))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the order of the reflected Gray code."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def links_of_node(points: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among the fingerprints of one top node."""
    points = points[np.argsort(gray_rank(points), kind="stable")]
    first = np.arange(0, len(points), GROUP)
    ones = np.bitwise_and.reduceat(points, first)
    zeros = np.bitwise_and.reduceat(~points, first)
    shared = ones | zeros
    left, right = [], []

    def link(a, b):
        left.append(a)
        right.append(b)

    for g, start in enumerate(first):
        # Differences both groups' shared bits already have, with this and all later groups.
        common = shared[g] & shared[g:]
        least = np.bitwise_count((ones[g] ^ ones[g:]) & common)
        most_possible = least + np.bitwise_count(~common)
        mine = points[start:start + GROUP]
        whole = g + np.flatnonzero(most_possible <= most)
        for h in whole:
            other = points[first[h]:first[h] + GROUP]
            link(np.full(len(other), mine[0]), other)
            link(mine, np.full(len(mine), other[0]))
        open_ = g + np.flatnonzero((least <= most) & (most_possible > most))
        if len(open_):
            at = (first[open_][:, None] + np.arange(GROUP)).ravel()
            at = at[at < len(points)]
            near = np.bitwise_count(mine[:, None] ^ points[at][None, :]) <= most
            a, b = np.nonzero(near)
            link(mine[a], points[at[b]])
    if not left:
        return points[:0], points[:0]
    return forest(np.concatenate(left), np.concatenate(right))


def _links_of_many(node: np.ndarray, points: np.ndarray, most: int):
    """Links below many top nodes, their fingerprints next to each other."""
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, len(points)))
    left, right = [points[:0]], [points[:0]]
    for a, n in zip(starts[sizes > GROUP], sizes[sizes > GROUP]):
        x, y = links_of_node(points[a:a + n], most)
        left.append(x)
        right.append(y)
    small = sizes <= GROUP  # one group each: no upper level to prune
    rest = np.repeat(sizes * small, sizes) - (np.arange(len(points)) - np.repeat(starts, sizes))
    for step in range(1, int((sizes * small).max(initial=1))):
        at = np.flatnonzero(rest > step)
        at = at[np.bitwise_count(points[at] ^ points[at + step]) <= most]
        left.append(points[at])
        right.append(points[at + step])
    return forest(np.concatenate(left), np.concatenate(right))


def links(points: DataFrame, column: str = "_fp", most: int = MOST_BITS) -> DataFrame:
    """``src``, ``dst``: links among distinct fingerprints that connect whatever is connected.

    ``points`` holds one row per fingerprint. Only for ``most`` up to four.
    """
    if most > 4:
        raise ValueError("the masks find up to four differences")

    def block(i):
        at, width = BLOCKS[i]
        return F.shiftrightunsigned(F.col(column), at).bitwiseAND((1 << width) - 1)

    nodes = F.array(*[
        (F.lit(m) * (1 << 24) + block(a) * (1 << 11) + block(b)) for m, (a, b) in enumerate(MASKS)])
    below = points.select(F.col(column).alias("_fp"), F.explode(nodes).alias("_node"))
    full = (below.groupBy("_node").count().filter(F.col("count") > NODE_ROWS)
            .select("_node", F.ceil(F.col("count") * 2 / NODE_ROWS).cast("int").alias("_chunks")))
    chunk = F.pmod(F.xxhash64("_fp"), F.col("_chunks")).cast("int")
    pairs = F.when(F.col("_chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("_chunks") - 1),
        lambda other: F.least(chunk, other) * F.col("_chunks") + F.greatest(chunk, other)))
    dealt = (below.join(full, "_node", "left")
             .select("_node", "_fp", F.explode(pairs).alias("_pair")))

    def work(batches):
        held = np.empty((0, 3), np.int64)

        def found(rows):
            node = rows[:, 0] * (1 << 34) + rows[:, 1]
            a, b = _links_of_many(node, rows[:, 2].view(np.uint64), most)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64)
                                    for c in batch.columns])
            held = np.concatenate([held, rows])
            if len(held) < 100_000:
                continue
            last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield found(np.ascontiguousarray(held[:cut]))
                held = held[cut:]
        if len(held):
            yield found(np.ascontiguousarray(held))

    parts = dealt.repartition("_node", "_pair").sortWithinPartitions("_node", "_pair")
    return parts.select("_node", F.col("_pair").cast("long"), "_fp").mapInArrow(
        work, "src long, dst long")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                most: int = MOST_BITS) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, one row per row.

    ``component_id`` is the smallest key reachable over links.
    """
    rows = materialise(with_fingerprint(df.select(key, text), text, "_fp", words)
                       .select(key, "_fp"), "fingerprints")
    return grouped(rows, key, most).select(
        key, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                most: int = MOST_BITS) -> DataFrame:
    """One row of each component stays, whole: that with the smallest key, null last.

    Rows are told apart by their number in the table, so repeated keys do no harm and no
    text is written; the rows that go are few and are looked up by number.
    """
    packed, _ = numbered(df)
    row = packed.select("_number", F.col("_all")[key].alias("_key"), F.col("_all")[text].alias("_text"))
    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"),
                    F.col("_number").alias("number"))
    prints = materialise(with_fingerprint(row, "_text", "_fp", words).select(
        rank.alias("_rank"), "_fp"), "fingerprints")
    gone = materialise(grouped(prints, "_rank", most).filter("_rank <> component_id").select(
        F.col("_rank.number").alias("_number")), "copies")
    return packed.join(gone, "_number", "left_anti").select("_all.*")


# --- near copies by similarity ---------------------------------------------------

# Two prints of 64 bits; eight blocks of each, and a top node is the value of two of them.
SIMILAR_WORDS = 5
LEAST_SIMILARITY = 0.8
WIDE_BLOCKS = 8
WIDE_MASKS = tuple(combinations(range(WIDE_BLOCKS), 2))
# Of 128 bits, sets just similar enough differ in 19 on average and hardly ever in more than this.
WIDE_BITS = 34
# Nodes with more points give the edges of a minimum spanning forest first, then the pairs
# whose points those edges left apart.
ALL_PAIRS = 8
PAIRS_AT_ONCE = 1_000_000
# Shingles of the sets one task compares below a node; more are cut into chunks of half.
NODE_SHINGLES = 2_000_000


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell the same apart, with other bits (the finaliser of SplitMix64)."""
    h = hashes ^ (hashes >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    parts = [np.unique(part) for part in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def spanning_pairs(prints: np.ndarray, most: int = WIDE_BITS):
    """Edges of a minimum spanning forest over the pairs that differ in ``most`` bits or less.

    ``prints`` has a row of two 64-bit words for each point. Points are put in Gray order and
    grouped; a group whose shared bits differ too much from the point looked from is left
    aside whole.
    """
    n = len(prints)
    order = np.argsort(gray_rank(prints[:, 0]), kind="stable")
    points = prints[order]
    first = np.arange(0, n, GROUP)
    ones = np.bitwise_and.reduceat(points, first, axis=0)
    zeros = np.bitwise_and.reduceat(~points, first, axis=0)
    near, best, via = np.full(n, False), np.full(n, most + 1), np.full(n, -1)
    left, right = [], []
    now = 0
    for _ in range(n):
        near[now] = True
        if via[now] >= 0:
            left.append(via[now])
            right.append(now)
        x = points[now]
        least = np.bitwise_count((ones & ~x) | (zeros & x)).sum(axis=1)
        for g in np.flatnonzero(least <= most).tolist():
            a, b = g * GROUP, min(n, (g + 1) * GROUP)
            apart = np.bitwise_count(points[a:b] ^ x).sum(axis=1)
            closer = (apart < best[a:b]) & ~near[a:b]
            best[a:b][closer], via[a:b][closer] = apart[closer], now
        open_ = np.where(near, most + 2, best)
        now = int(open_.argmin())
        if open_[now] > most:
            via[now] = -1
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def pairs_across(ids: np.ndarray, prints: np.ndarray, classes: np.ndarray, most: int = WIDE_BITS):
    """Blocks of pairs of ids of two classes whose prints differ in ``most`` bits or less."""
    for a in range(0, len(ids), GROUP):
        apart = np.bitwise_count(prints[a:a + GROUP, None] ^ prints[None, a:]).sum(axis=2)
        i, j = np.nonzero((apart <= most) & (classes[a:a + GROUP, None] != classes[None, a:]))
        later = j > i
        yield np.column_stack([ids[a + i[later]], ids[a + j[later]]])


def _below(points: DataFrame, classes: str | None = None, more: tuple = ()) -> DataFrame:
    """Points once for each top node (``_node``) they are below; with ``classes`` only those
    nodes that are large and hold two classes."""
    def block(column, i):
        return F.shiftrightunsigned(F.col(column), 8 * i).bitwiseAND(255)

    nodes = F.array(*[F.lit((r * len(WIDE_MASKS) + m) << 16) + block(column, a) * 256 + block(column, b)
                      for r, column in enumerate(("_a", "_b")) for m, (a, b) in enumerate(WIDE_MASKS)])
    below = points.select("_id", "_a", "_b", *([classes] if classes else []), *more, F.explode(nodes).alias("_node"))
    if not classes:
        return below
    split = below.groupBy("_node").agg(F.count(F.lit(1)).alias("n"), F.min(classes).alias("low"),
                                       F.max(classes).alias("high"))
    return below.join(split.filter((F.col("n") > ALL_PAIRS) & (F.col("low") < F.col("high")))
                      .select("_node"), "_node", "left_semi")


def _dealt(below: DataFrame, size, most: int) -> DataFrame:
    """The rows with ``_pair``: nodes of more than ``most`` in ``size`` are dealt out as pairs of chunks."""
    full = (below.groupBy("_node").agg(F.sum(size).alias("_size")).filter(F.col("_size") > most)
            .select("_node", F.ceil(F.col("_size") * 2 / most).cast("long").alias("_chunks")))
    chunk = F.pmod(F.xxhash64("_id"), F.col("_chunks"))
    pairs = F.when(F.col("_chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1),
        lambda other: F.least(chunk, other) * F.col("_chunks") + F.greatest(chunk, other)))
    rest = [c for c in below.columns if c != "_node"]
    return (below.join(full, "_node", "left").select("_node", F.explode(pairs).alias("_pair"), *rest)
            .repartition("_node", "_pair").sortWithinPartitions("_node", "_pair"))


def candidate_pairs(points: DataFrame, most: int = WIDE_BITS, classes: str | None = None) -> DataFrame:
    """``src``, ``dst``: pairs of points (``_id``, prints ``_a`` and ``_b``) to verify.

    Every pair with few bits apart that meets below a top node is a candidate where the node
    is small; a larger node gives the closest pairs that hold its points together. Some of
    those may fail where others would not: with ``classes``, a column of what verified pairs
    have linked, come all other pairs of the larger nodes that lie in two classes.
    """
    kept = ["_id", "_a", "_b", *([classes] if classes else [])]
    dealt = _dealt(_below(points, classes), F.lit(1), NODE_ROWS)

    def batch_of(pair):
        pair = np.unique(np.sort(pair, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["src", "dst"])

    def across(rows):
        starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        held, n = [], 0
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            prints = np.ascontiguousarray(rows[a:b, 3:5]).view(np.uint64)
            for block in pairs_across(rows[a:b, 2], prints, rows[a:b, 5], most) if b - a > ALL_PAIRS else ():
                held.append(block)
                n += len(block)
                if n >= PAIRS_AT_ONCE:
                    yield batch_of(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield batch_of(np.concatenate(held))

    def found(rows):
        if classes:
            yield from across(rows)
            return
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        ids, prints = rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        left, right = [ids[:0]], [ids[:0]]
        for a, n in zip(starts[sizes > ALL_PAIRS].tolist(), sizes[sizes > ALL_PAIRS].tolist()):
            x, y = spanning_pairs(prints[a:a + n], most)
            left.append(ids[a + x])
            right.append(ids[a + y])
        small = sizes <= ALL_PAIRS
        rest = np.repeat(sizes * small, sizes) - (np.arange(len(rows)) - np.repeat(starts, sizes))
        for step in range(1, ALL_PAIRS):
            at = np.flatnonzero(rest > step)
            at = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1) <= most]
            left.append(ids[at])
            right.append(ids[at + step])
        yield batch_of(np.column_stack([np.concatenate(left), np.concatenate(right)]))

    def work(batches):
        held = np.empty((0, 2 + len(kept)), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            if len(held) < 200_000:
                continue
            last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from found(held[:cut])
                held = held[cut:]
        if len(held):
            yield from found(held)

    return dealt.mapInArrow(work, "src long, dst long").distinct()


def _first_node(apart: np.ndarray) -> np.ndarray:
    """Number of the first mask two points meet below, from the bits in which their prints differ."""
    same = np.ascontiguousarray(apart).view(np.uint8).reshape(-1, 2, WIDE_BLOCKS) == 0
    which = (same[:, 0].sum(axis=1) < 2).astype(np.int64)
    at = np.arange(len(same))
    same = same[at, which]
    a = same.argmax(axis=1)
    same[at, a] = False
    number = np.zeros((WIDE_BLOCKS, WIDE_BLOCKS), np.int64)
    number[tuple(np.transpose(WIDE_MASKS))] = np.arange(len(WIDE_MASKS))
    return which * len(WIDE_MASKS) + number[a, same.argmax(axis=1)]


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 128 parts of the hashes whether a set has an odd number there, as two words.

    Each shingle that only one of two sets has changes one bit, so the bits in which theirs
    differ are at most the shingles they do not share.
    """
    odd = np.bincount((shingles & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def points_across(points: DataFrame, classes: str, least: float, most: int = WIDE_BITS) -> DataFrame:
    """``_node``, ``_id``: points of large nodes with a near one of another class.

    A pair counts in the first node its points share, so a point comes up in few nodes. Pairs
    whose parities (``_p``, ``_q``) or sizes (``_n``) prove that they share too little do not count.
    """
    def work(batches):
        held = np.empty((0, 9), np.int64)
        room = (1 - least) / (1 + least)

        def found(rows):
            starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                prints = np.ascontiguousarray(rows[a:b, 3:5]).view(np.uint64)
                label, seen = rows[a:b, 5], np.full(b - a, False)
                odd, n = np.ascontiguousarray(rows[a:b, 6:8]).view(np.uint64), rows[a:b, 8]
                for g in range(0, b - a, GROUP):
                    apart = prints[g:g + GROUP, None] ^ prints[None, g:]
                    i, j = np.nonzero((np.bitwise_count(apart).sum(axis=2) <= most)
                                      & (label[g:g + GROUP, None] != label[None, g:]))
                    here = _first_node(apart[i, j]) == rows[a, 0] >> 16
                    i, j = g + i[here], g + j[here]
                    unshared = np.maximum(np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1), np.abs(n[i] - n[j]))
                    here = unshared <= (n[i] + n[j]) * room + 1e-6
                    seen[i[here]] = seen[j[here]] = True
                if seen.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[a:b, 0][seen]), pa.array(rows[a:b, 2][seen])], names=["_node", "_id"])

        for batch in batches:
            held = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from found(held[:cut])
                held = held[cut:]
        if len(held):
            yield from found(held)

    facts = ("_p", "_q", "_n")
    near = _dealt(_below(points, classes, facts), F.lit(1), NODE_ROWS).select(
        "_node", "_pair", "_id", "_a", "_b", classes, *facts)
    return near.mapInArrow(work, "_node long, _id long").distinct()


def alike_across(ids: np.ndarray, prints: np.ndarray, classes: np.ndarray, sets: list[np.ndarray],
                 node: int, least: float, most: int = WIDE_BITS):
    """Ends of links that join the classes of points with similar sets: a forest, not all pairs.

    Every near pair whose first shared node has the mask numbered ``node`` is compared on the
    whole sets, unless links found before already join its points.
    """
    sizes = np.array([len(x) for x in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(codes, np.cumsum(sizes)[:-1])
    mine, label = np.full(len(values), False), classes.copy()
    left, right = [], []
    for i in range(len(ids) - 1):
        apart = prints[i + 1:] ^ prints[i]
        j = np.flatnonzero((np.bitwise_count(apart).sum(axis=1) <= most) & (label[i + 1:] != label[i]))
        j = i + 1 + j[_first_node(apart[j]) == node]
        j = j[np.minimum(sizes[j], sizes[i]) >= least * np.maximum(sizes[j], sizes[i])]
        if not len(j):
            continue
        mine[sets[i]] = True
        shared = np.array([np.count_nonzero(mine[sets[x]]) for x in j])
        mine[sets[i]] = False
        j = j[shared >= least * (sizes[i] + sizes[j] - shared)]
        _, one = np.unique(label[j], return_index=True)
        left += [ids[i]] * len(one)
        right += ids[j[one]].tolist()
        label[np.isin(label, label[j])] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def links_across(points: DataFrame, near: DataFrame, sets: DataFrame, classes: str, least: float,
                 most: int = WIDE_BITS) -> DataFrame:
    """``src``, ``dst``: links that join all similar points below each node of ``near``.

    Sets (``_id``, ``_set``) go to the tasks, which compare them there, so what comes back is
    a forest for each node.
    """
    def work(batches):
        key, held = None, []

        def found():
            ids, a, b, label, size, values = (np.concatenate(x) for x in zip(*held))
            if len(ids) > 1:
                src, dst = alike_across(ids, np.column_stack([a, b]).view(np.uint64), label,
                                        np.split(values, np.cumsum(size)[:-1]), key[0] >> 16, least, most)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            keys = np.column_stack([c.to_numpy() for c in batch.columns[:2]])
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for x, y in zip(starts, [*starts[1:], len(keys)]):
                if key is not None and key != tuple(keys[x].tolist()):
                    yield from found()
                    held = []
                key, part = tuple(keys[x].tolist()), batch.slice(x, y - x)
                column = part.column(6)
                held.append((*(c.to_numpy() for c in part.columns[2:6]),
                             np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()))
        if held:
            yield from found()

    rows = near.join(points.select("_id", "_a", "_b", classes), "_id").join(sets, "_id").select(
        "_node", "_id", "_a", "_b", classes, "_set")
    return _dealt(rows, F.size("_set"), NODE_SHINGLES).mapInArrow(work, "src long, dst long").distinct()


def _wide_prints(rows: DataFrame, words: int) -> DataFrame:
    """First column of ``rows``, and two prints, a hash, the parities and the size of the shingle set
    of the text in the second."""
    def work(batches):
        from xxhash import xxh64_intdigest
        for batch in batches:
            out = np.empty((batch.num_rows, 6), np.uint64)
            for i, text in enumerate(batch.column(1)):
                found = shingle_set(text.as_py().encode(), words)
                out[i] = (_majority([found]), _majority([_mixed(found)]), xxh64_intdigest(found.tobytes(), SEED),
                          *parities(found), len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(out[:, c]).view(np.int64)) for c in range(6))],
                names=["_rank", *"abspqn"])

    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.LongType()) for c in "abspqn")])
    return rows.mapInArrow(work, schema)


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """``_id`` and ``_set``, the distinct shingle hashes of the text in the second column."""
    def work(batches):
        for batch in batches:
            ids, held, size = [], [], 0

            def told():
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                values = pa.array(np.concatenate(held).view(np.int64))
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["_id", "_set"])

            for i, text in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                held.append(shingle_set(text.as_py().encode(), words))
                size += len(held[-1])
                if size > SLICE:
                    yield told()
                    ids, held, size = [], [], 0
            if ids:
                yield told()

    return rows.mapInArrow(work, "_id long, _set array<long>")


def deduplicate_similar(df: DataFrame, key: str = "doc_id", text: str = "text",
                        words: int = SIMILAR_WORDS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """One row of each group stays, whole: that with the smallest key, null last.

    Rows are linked when their sets of word shingles have a Jaccard similarity of ``least``
    or more, compared on the whole sets; texts without words are alike. Which pairs are
    compared comes from two fingerprints of the set: pairs below a common top node with few
    bits apart. A pair just similar enough is compared in about nine of ten cases, a closer
    one nearly always. Rows with equal sets are one point; points are numbered in the order
    of their smallest rows, so a group's root is the one to keep.
    """
    packed, _ = numbered(df)
    row = packed.select("_number", F.col("_all")[key].alias("_key"), F.col("_all")[text].alias("_text"))

    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"),
                    F.col("_number").alias("number"))
    rows = materialise(_wide_prints(row.select(rank.alias("_rank"), F.coalesce("_text", F.lit("")).alias("_text")), words), "prints")
    points = materialise(rows.groupBy("s", "a", "b").agg(
        F.min("_rank").alias("_least"), *[F.min(c).alias(c) for c in "pqn"]).orderBy("_least"), "points")
    point = numbered(points)[0].select(
        F.col("_number").alias("_id"), *[F.col(f"_all.{c}").alias(f"_{c}") for c in "abpqn"],
        F.col("_all.s").alias("s"), F.col("_all._least").alias("_least"))
    point = materialise(point, "numbered_points")

    def sets_of(asked):
        # Texts of the points asked for, once each.
        numbers = materialise(point.join(asked, "_id").select("_id", F.col("_least.number").alias("_number")), "asked")
        return materialise(_shingle_sets(packed.join(numbers, "_number").select(
            "_id", F.coalesce(F.col("_all")[text], F.lit("")).alias("_text")), words), "sets")

    pairs = materialise(candidate_pairs(point), "candidates")
    told = sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("_id")).distinct())
    both = pairs.join(told.select(F.col("_id").alias("src"), F.col("_set").alias("_x")), "src").join(
        told.select(F.col("_id").alias("dst"), F.col("_set").alias("_y")), "dst")
    shared = F.size(F.array_intersect("_x", "_y"))
    alike = shared >= F.lit(least) * (F.size("_x") + F.size("_y") - shared)
    close = materialise(both.filter(alike).select("src", "dst"), "alike")
    # A class is the smallest point of what is linked so far.
    linked = components(close).select(F.col("node").alias("_id"), "root")
    classed = materialise(point.join(linked, "_id", "left").select(
        *[f"_{c}" for c in "abpqn"], "_id", F.coalesce("root", "_id").alias("_class")), "classed")
    near = materialise(points_across(classed, "_class", least), "near")
    more = materialise(links_across(classed, near, sets_of(near.select("_id").distinct()), "_class", least), "across")
    below = components(close.unionByName(more)).select(F.col("node").alias("_id"))
    # A point below another goes whole; of the others the smallest row stays.
    gone = point.join(below.withColumn("_below", F.lit(True)), "_id", "left")
    copies = rows.join(gone.select("s", F.col("_a").alias("a"), F.col("_b").alias("b"), "_least", "_below"),
                       ["s", "a", "b"]).filter(
        F.col("_below").isNotNull() | (F.col("_rank") != F.col("_least"))).select(
        F.col("_rank.number").alias("_number"))
    return packed.join(materialise(copies, "copies"), "_number", "left_anti").select("_all.*")


def grouped(rows: DataFrame, key: str, most: int = MOST_BITS) -> DataFrame:
    """Rows of ``key`` and ``_fp`` with their component_id, the smallest key of theirs."""
    points = materialise(rows.groupBy("_fp").agg(F.min(key).alias("_least")), "points")
    label = components(links(points, "_fp", most))
    named = points.join(label, points["_fp"] == label["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    point_label = named.join(least, "_root").select("_fp", "component_id")
    return rows.join(point_label, "_fp")
