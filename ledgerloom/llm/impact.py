"""Exact top-k by integer inner product over an impact-ordered index.

Components become integers, ``floor(1024 * x)``. The candidates are dealt into blocks; in a
block every dimension has its postings in order of quantised value, so for a query, whose
sign says from which end to read, they lie in order of impact: what a posting at most adds
to a score. Postings of all dimensions are processed score at a time: each round lowers one
threshold on the impact and adds the segments above it to the accumulators. A vector's
score can be no more than its accumulator plus, for each dimension not met yet, the impact
of the next segment there.

The search of a block stops only on proof: the k-th best exact score of vectors met so far
is known, and every vector whose bound reaches it is scored exactly in integers. Stopping
early or late changes the work, never the result.

Queries are streamed past a block, so a task holds one block and one batch of queries.
A block returns at most k rows for a query.

Edge cases: vectors that are null or hold null or non-finite components take no part;
vectors are compared with those of their own length, empty ones score 0 with each other;
a row with a null id is a candidate and no query; repeated rows are candidates for one
another; with fewer candidates than asked for, all are returned; equal scores go by the
smaller id, null last, and repeated ids by their place in the table; scores beyond a long
are held at its ends; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scale import materialise

K = 10
SCALE = 1024
# Quantised values of a dimension in a block.
LEVELS = 256
BLOCK_ROWS = 4096
TASKS = 2000
# Rounds: thresholds on the impact as shares of a query's largest, then all there is.
SHARES = (0.25, 0.0, -1 / 32, -1 / 16, -1 / 8, -1 / 4, -1 / 2)
# With no more than this share of a block possible, exact scores cost less than more rounds.
SCORED = 0.6
# Bounds are sums of doubles; below this they are exact.
EXACT = 2 ** 52
LONG = np.iinfo(np.int64)


def whole(vector: Column) -> Column:
    """Not null and no null or non-finite component."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


class Block:
    """Postings of some candidates of one length in order of quantised value."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        # In id order, nulls (the last of all) and then rows deciding, so that places break ties.
        at = np.lexsort([rows, ids])
        self.x, self.ids, self.rows = x[at], ids[at], rows[at]
        n, d = x.shape
        self.reach = float(np.abs(self.x.astype(np.float64)).max(initial=0))
        self.wide = self.x.astype(np.float64)
        if not n or self.reach >= EXACT:
            return
        self.low = self.x.min(axis=0)
        self.width = (self.x.max(axis=0) - self.low) // LEVELS + 1
        level = (self.x - self.low) // self.width
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        # The least value of each posting's level, and where the levels start in the order.
        sorted_levels = np.take_along_axis(level.T, self.order, axis=1)
        self.least = (self.low[:, None] + sorted_levels * self.width[:, None]).astype(np.float64)
        counts = np.zeros((d, LEVELS + 2), np.int64)
        np.add.at(counts, (np.arange(d), level + 1), 1)
        self.starts = counts.cumsum(axis=1)

    def exact(self, q: np.ndarray) -> bool:
        """Whether all sums of a query are exact in doubles."""
        return self.reach * float(np.abs(q.astype(np.float64)).max(initial=0)) * len(q) < EXACT

    def _best(self, at: np.ndarray, q: np.ndarray, k: int):
        """The ``k`` best of some places in id order, by exact scores."""
        if self.exact(q):
            score = self.wide[at] @ q.astype(np.float64)
            if len(score) > 4 * k:
                some = np.flatnonzero(score >= np.partition(score, -k)[-k])
                at, score = at[some], score[some]
            score = score.astype(np.int64)
        else:
            sums = [sum(a * b for a, b in zip(row, q.tolist())) for row in self.x[at].tolist()]
            score = np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)
        first = np.argsort(~score, kind="stable")[:k]  # the complement falls as the score rises
        return at[first], score[first]

    def search(self, q: np.ndarray, own: int, k: int = K):
        """Places and scores of the ``k`` best vectors other than row ``own``."""
        n, d = self.x.shape
        mine = self.rows != own
        if n <= 4 * k or not d or not self.exact(q):
            return self._best(np.flatnonzero(mine), q, k)
        dims, up = np.flatnonzero(q), q > 0
        by, edge = q.astype(np.float64), np.where(up, self.width - 1, 0)
        best = by * (np.where(up, self.least[:, -1], self.least[:, 0]) + edge)
        sums, rest = np.zeros(n), best.copy()
        done = np.zeros(d, np.int64)  # postings of a dimension processed so far
        docs, sizes = [], []
        members = np.flatnonzero(mine)
        for share in (*SHARES, None):
            # From the end the sign says, the postings with an impact of at least the cut.
            if share is None:
                upto = np.full(d, n)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    level = (share * best.max() / by - self.low) / self.width
                    level = np.where(up, np.ceil(level - edge / self.width), np.floor(level) + 1)
                level = np.nan_to_num(level).clip(0, LEVELS).astype(np.int64)
                start = self.starts[np.arange(d), level]
                upto = np.maximum(np.where(up, n - start, start), done)
            gains = []
            for i in dims.tolist():
                a, b = (n - upto[i], n - done[i]) if up[i] else (done[i], upto[i])
                docs.append(self.order[i, a:b])
                gains.append((self.least[i, a:b] + edge[i]) * by[i])
            sizes.append(upto[dims] - done[dims])
            done[dims] = upto[dims]
            sums += np.bincount(np.concatenate(docs[-len(dims):] or [members[:0]]),
                                np.concatenate(gains or [sums[:0]]), n)
            # The largest impact a vector not met in a dimension can still have there.
            following = np.where(up, n - done - 1, done).clip(0, n - 1)
            rest = np.where(done < n, by * (self.least[np.arange(d), following] + edge), 0)
            bound = sums + rest.clip(0).sum()
            if share is None or share < 0:
                # Impacts still open are below zero: count them where they are open only.
                below = rest.clip(None, 0)
                met = np.bincount(np.concatenate(docs or [members[:0]]), np.concatenate(
                    [np.repeat(below[dims], size) for size in sizes]), n)
                bound += below.sum() - met
            bound[~mine] = -np.inf
            # Exact scores of the best so far prove a score that a member must reach.
            ahead = np.argpartition(-bound, 2 * k)[:2 * k]
            ahead = ahead[mine[ahead]]
            proof = np.partition(self.wide[ahead] @ by, -k)[-k]
            members = np.flatnonzero(bound >= proof)
            if len(members) <= n * SCORED:
                break
        return self._best(members[mine[members]], q, k)


def _matrix(column, d: int) -> np.ndarray:
    values = pa.array(column).flatten() if not isinstance(column, pa.Array) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def search(df: DataFrame, asked: Column, k: int = K, key: str = "vec_id",
           vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``key`` and ``score`` of the ``k`` best rows for each asked row."""
    rows = materialise(
        df.select(F.col(key).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asks"),
                  F.col(vector).alias("v")).filter(whole(F.col("v")))
        .select("id", (F.col("asks") & F.col("id").isNotNull()).alias("asks"),
                quantised(F.col("v"), scale).alias("x"))
        .select("*", F.size("x").alias("dim"), F.monotonically_increasing_id().alias("row")), "quantised")
    # One row per length of a vector.
    blocks = rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    numbered = rows.join(blocks, "dim")
    held = numbered.select(
        "dim", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"),
        F.lit(0).alias("asks"), "row", "id", "x")
    queries = numbered.filter("asks").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("asks"), "row", "id", "x")
    # Blocks are of equal size, so ranges of blocks spread them evenly.
    tasks = min(blocks.agg(F.sum("blocks").alias("n")).first()["n"] or 1, TASKS)
    dealt = held.unionByName(queries).repartitionByRange(tasks, "dim", "block").sortWithinPartitions(
        "dim", "block", "asks")

    def work(batches):
        place, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1), len(mark)]
            for a, b in zip(cuts, cuts[1:]):
                d, number, asks = mark[a].tolist()
                part = batch.slice(a, b - a)
                x, row = _matrix(part.column(5), d), part.column(3).to_numpy()
                ids = part.column(4).fill_null(LONG.max).to_numpy()
                if (d, number) != place:
                    place, parts, block = (d, number), [], None
                if not asks:
                    parts.append((x, ids, row, part.column(4).is_null().to_numpy(zero_copy_only=False)))
                    continue
                if block is None:
                    joined = [np.concatenate(p) for p in zip(*parts)]
                    # A null id sorts behind all others, also behind the largest long.
                    block = Block(joined[0], joined[1], joined[2])
                    unnamed = set(joined[2][joined[3]].tolist())
                found = [block.search(q, own, k) for q, own in zip(x, row.tolist())]
                at = np.concatenate([f[0] for f in found])
                n = [len(f[0]) for f in found]
                names = [None if r in unnamed else i
                         for r, i in zip(block.rows[at].tolist(), block.ids[at].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(row, n)), pa.array(np.repeat(ids, n)),
                    pa.array(block.rows[at]), pa.array(names, pa.int64()),
                    pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))],
                    names=["asked", "query_id", "row", "id", "score"])

    found = dealt.mapInArrow(work, "asked long, query_id long, row long, id long, score long")
    order = W.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as bigint)) as x
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_inner_product(cast(q.x as double[]), cast(c.x as double[])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 10
"""
