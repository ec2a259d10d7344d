"""Nearest neighbours by inner product: lists of a coarse index, scanned by dimensions.

Inner products become distances by one more coordinate that makes all vectors equally
long. Vectors are rotated by a fixed random rotation and cut into column blocks. Within a
probed list the distance to a query is summed up block by block; after each block a
hypothesis test compares the partial distance, scaled to all dimensions, with the query's
current k-th best, and a candidate that fails is abandoned. What remains is scored in
double precision on the original vectors.

A query's nearest lists are scanned first. Its k-th best score there is where the scan of
its other lists starts from, so those abandon most candidates after the first block and
return few rows.

The centroids come from a bounded sample of ``SAMPLE`` vectors; every vector is in a list.
How many lists a query probes is the smallest number that reached ``RECALL`` on queries
of that sample, compared with all of it.

Long lists are cut into chunks of ``CHUNK`` vectors; queries are streamed past a chunk.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take
no part; only vectors of the most common length do (others are not comparable); a row
with a null id is a candidate and no query; repeated rows are candidates for one another;
with fewer candidates than asked for, all are returned; equal scores go by the smaller id,
null last; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scale import materialise
from .blocks import chunk_counts, runs
from .vectors import rows_of, usable

K = 20
SAMPLE = 10_000
TRIALS = 200
RECALL = 0.97
# Vectors of a list on average, and bounds for the number of lists.
PER_LIST = 400
LISTS = (8, 1024)
CHUNK = 4096
# Columns of a block, and how sure a test must be (in standard deviations).
BLOCK = 16
# Lists of a query that are scanned first.
FIRST_PROBES = 4
SURE = 2.1
# Candidates between two updates of a query's k-th best distance.
STRIDE = 512
QUERY_BATCH = 64


class Index:
    """Centroids, rotation and number of probes; the same for every task."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int, k: int = K):
        random = np.random.default_rng(17)
        self.longest = longest
        self.dim = sample.shape[1] + 1
        self.rotation = np.linalg.qr(random.normal(size=(self.dim, self.dim)))[0]
        lists = int(np.clip(rows // PER_LIST, *LISTS))
        x = self.long(sample)
        lists = min(lists, len(x))
        self.centroids = x[random.permutation(len(x))[:lists]]
        for _ in range(8):
            own = self.order(x)[:, 0]
            for c in range(lists):
                mine = x[own == c]
                if len(mine):
                    self.centroids[c] = mine.mean(axis=0)
        self.probes = self.calibrate(sample, k)

    def long(self, x: np.ndarray) -> np.ndarray:
        """Rotated candidates, all of the same length."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x ** 2).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Rotated queries; their length does not change the order."""
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def order(self, rotated: np.ndarray) -> np.ndarray:
        """Lists of each row, nearest centroid first."""
        far = (self.centroids ** 2).sum(axis=1) - 2 * rotated @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")

    def calibrate(self, sample: np.ndarray, k: int) -> int:
        """Probes that reach the recall on the sample."""
        q = sample[:TRIALS]
        scores = q @ sample.T
        k = min(k, len(sample))
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        own = self.order(self.long(sample))[:, 0]
        place = np.argsort(self.order(self.asked(q)), axis=1)  # rank of each list for a query
        needed = np.sort(place[np.arange(len(q))[:, None], own[best]].ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1

    def scan(self, q: np.ndarray, x: np.ndarray, k: int, known: np.ndarray):
        """(query, candidate) places that survive, candidates among rotated rows ``x``.

        ``known`` has a score per query that ``k`` candidates are known to reach, or -inf.
        """
        blocks = [slice(a, min(a + BLOCK, self.dim)) for a in range(0, self.dim, BLOCK)]
        x_parts = [(x[:, b] ** 2).sum(axis=1) for b in blocks]
        q_parts = [(q[:, b] ** 2).sum(axis=1) for b in blocks]
        best = np.full((len(q), k), np.inf)
        start = self.longest ** 2 + (q ** 2).sum(axis=1) - 2 * known
        out_q, out_x = [], []
        for a in range(0, len(x), STRIDE):
            rows = slice(a, a + STRIDE)
            limit = np.minimum(best[:, -1], start)
            first = blocks[0]
            part = np.maximum(q_parts[0][:, None] + x_parts[0][rows] - 2 * q[:, first] @ x[rows, first].T, 0)
            qi, xi = np.nonzero(self.passes(part, limit[:, None], first.stop))
            far, xi = part[qi, xi], xi + a
            for b, xp, qp in zip(blocks[1:], x_parts[1:], q_parts[1:]):
                far = far + qp[qi] + xp[xi] - 2 * np.einsum("ij,ij->i", q[qi, b], x[xi, b])
                keep = self.passes(far, limit[qi], b.stop)
                qi, xi, far = qi[keep], xi[keep], far[keep]
            out_q.append(qi)
            out_x.append(xi)
            # The k best of what was known and what this stride adds.
            fresh = np.full((len(q), STRIDE), np.inf)
            fresh[qi, xi - a] = np.maximum(far, 0)
            best = np.partition(np.column_stack([best, fresh]), k - 1, axis=1)[:, :k]
            best.sort(axis=1)
        return np.concatenate(out_q), np.concatenate(out_x)

    def passes(self, part, limit, seen):
        """Can a partial squared distance over ``seen`` dimensions still be within limit?"""
        if seen == self.dim:
            return part <= limit * (1 + 1e-9) + 1e-12
        slack = (1 + SURE / np.sqrt(seen)) ** 2
        return part * (self.dim / seen) <= limit * slack


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
           k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest found."""
    fine = df.filter(usable(F.col(vector)))
    kind = df.schema[vector].dataType.simpleString()
    id_type = df.schema[key].dataType.simpleString()
    rows = materialise(fine.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
        F.col(vector).alias("vector"), F.size(vector).alias("dim"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
               ).alias("norm")), "ann_rows")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("m")).orderBy(
        F.desc("n"), "dim").first()
    result = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    if lengths is None:
        return df.sparkSession.createDataFrame([], result)
    rows = rows.filter(F.col("dim") == lengths["dim"])
    drawn = rows.select("vector", F.xxhash64("id", "row").alias("h")).orderBy("h").limit(SAMPLE).collect()
    index = df.sparkSession.sparkContext.broadcast(Index(
        np.array([r["vector"] for r in drawn], np.float64), lengths["m"], lengths["n"], k))

    def lists(batches):
        for batch in batches:
            x = rows_of(batch.column(2))
            own = index.value.order(index.value.long(x))[:, 0]
            asks = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            probed = [[]] * len(x)
            if asks.any():
                near = index.value.order(index.value.asked(x[asks]))[:, :index.value.probes]
                for i, lists_ in zip(np.flatnonzero(asks), near):
                    probed[i] = lists_.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.int32()),
                 pa.array(probed, pa.list_(pa.int32()))], names=["row", "id", "vector", "own", "probes"])

    placed = materialise(rows.select("row", "id", "vector", "asks").mapInArrow(
        lists, f"row long, id {id_type}, vector {kind}, own int, probes array<int>"), "ann_lists")
    full = chunk_counts(placed.withColumnRenamed("own", "list"), ["list"], CHUNK)
    chunks = materialise(full, "ann_chunks")  # at most one row per list
    stored = placed.withColumnRenamed("own", "list").join(F.broadcast(chunks), "list", "left").select(
        "list", F.pmod(F.xxhash64("row"), F.coalesce("_chunks", F.lit(1))).cast("int").alias("chunk"),
        F.lit(0).alias("asks"), "row", "id", "vector", F.lit(None).cast("double").alias("known"))
    asking = placed.filter(F.size("probes") > 0).select("row", "id", "vector", "probes")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))

    def scanned(queries, lists_):
        """Best candidates of each query in some of its lists, per cell."""
        turn = (queries.withColumn("list", F.explode(lists_)).join(F.broadcast(chunks), "list", "left")
                .select("list", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1))
                        .alias("chunk"), F.lit(1).alias("asks"), "row", "id", "vector", "known"))
        cells = stored.unionByName(turn).repartition("list", "chunk").sortWithinPartitions(
            "list", "chunk", "asks")
        return cells.mapInArrow(work, f"query long, query_id {id_type}, vec_id {id_type}, score double")

    def work(batches):
        # A chunk's vectors come first and are held; queries pass by as they arrive.
        cell, parts, held = None, [], None
        for table in runs(batches, 3):
            now = (table["list"][0].as_py(), table["chunk"][0].as_py())
            if now != cell:
                cell, parts, held = now, [], None
            if table["asks"][0].as_py() == 0:
                parts.append(table)
                continue
            if parts:
                chunk, parts = pa.Table.from_batches(parts), []
                x, ids = rows_of(chunk["vector"]), chunk["id"].combine_chunks()
                tie = np.argsort(np.argsort(ids.fill_null(2 ** 63 - 1).to_numpy(), kind="stable"))
                held = x, index.value.long(x), chunk["row"].to_numpy(), ids, tie
            if held is None:
                continue  # a list without vectors
            x, rotated, own, ids, tie = held
            for at in range(0, len(table), QUERY_BATCH):
                part = table.slice(at, QUERY_BATCH)
                q, me = rows_of(part["vector"]), part["row"].to_numpy()
                known = part["known"].fill_null(-np.inf).to_numpy()
                # One more than asked for: the query may be among them itself.
                qi, xi = index.value.scan(index.value.asked(q), rotated, min(k + 1, len(x)), known)
                score = np.einsum("ij,ij->i", q[qi], x[xi])
                keep = (me[qi] != own[xi]) & (score >= known[qi])
                qi, xi, score = qi[keep], xi[keep], score[keep]
                order = np.lexsort((tie[xi], -score, qi))
                qi, xi, score = qi[order], xi[order], score[order]
                start = np.searchsorted(qi, np.arange(len(q)))
                keep = np.arange(len(qi)) - start[qi] < k
                qi, xi, score = qi[keep], xi[keep], score[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(me[qi]), part["id"].take(pa.array(qi)),
                     ids.take(pa.array(xi)), pa.array(score)],
                    names=["query", "query_id", "vec_id", "score"])

    near = materialise(
        scanned(asking.withColumn("known", F.lit(None).cast("double")),
                F.slice("probes", 1, FIRST_PROBES))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "ann_near")
    reached = near.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("known"))
    far = scanned(asking.join(reached, "row", "left"),
                  F.slice("probes", FIRST_PROBES + 1, F.greatest(F.size("probes") - FIRST_PROBES, F.lit(0))))
    return (near.drop("rank").unionByName(far)
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
