"""Near copies among vectors by an index of pivot permutations.

A vector is described by its nearest pivots in order. Every pivot has an inverted list per
label; vectors that share enough of their nearest pivots are candidates, and candidates
are verified by their cosine in double precision.

A pair that shares ``SHARED`` of its ``NEAREST`` pivots has one in common among the first
NEAREST - SHARED + 1 of each in any fixed order of the pivots, so a vector goes on those
lists only. The shared pivots of a list's vectors are counted by a product of their
incidence rows. A pair on several lists is counted on the first one. Long lists are dealt
out as pairs of chunks; a task returns link counts and a spanning forest, never pairs.

Pivots are a bounded sample of the vectors, thinned so that no two are alike; every
vector is indexed. Equal vectors of a label are one point with a count.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without label, link with nothing and are components of their own; vectors of other
lengths are never compared; rows with a null id take part, and a component without any id
has a null component_id; repeated rows count as other vectors; a row is kept where its id
is its component's, so repeated ids are kept together; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.scale import materialise
from .blocks import groups, pairs_of_chunks
from .components import components, forest
from .vectors import rows_of, usable

LEAST_COSINE = 0.98
NEAREST = 12
SHARED = 5
# One pivot for so many points, between the two bounds, before thinning.
POINTS_PER_PIVOT = 200
PIVOTS = (64, 2048)
# Pivots with a larger cosine than this to an earlier one are left out.
ALIKE = 0.9
LIST_ROWS = 1024


def pivots(points: DataFrame, vector: str = "vector") -> dict[int, np.ndarray]:
    """Unit pivots by vector length; at most ``PIVOTS[1]`` for a length."""
    counts = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    wanted = {d: int(np.clip(n // POINTS_PER_PIVOT, *PIVOTS)) for d, n in counts.items()}
    most = max(wanted.values(), default=0)
    drawn = (points.select("dim", "key", vector)
             .withColumn("n", F.row_number().over(W.partitionBy("dim").orderBy("key")))
             .filter(F.col("n") <= most).select("dim", "n", vector).collect())
    out = {}
    for d, n in wanted.items():
        rows = sorted((r["n"], r[vector]) for r in drawn if r["dim"] == d and r["n"] <= n)
        x = np.array([v for _, v in rows], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        close = np.triu(x @ x.T > ALIKE, 1)
        out[d] = x[~close.any(axis=0)]
    return out


def permutation(x: np.ndarray, of: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return np.argsort(-(unit @ of.T), axis=1, kind="stable")[:, :nearest]


def _links(table: pa.Table, least: float, shared: int):
    """(left, right) places in ``table`` of the pairs to count in this group of a list."""
    ranks = rows_of(table["near"]).astype(np.int64)
    prefix = np.sort(ranks, axis=1)[:, :max(1, ranks.shape[1] - shared + 1)]
    x = rows_of(table["vector"])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    known, place = np.unique(ranks, return_inverse=True)
    incidence = np.zeros((len(ranks), len(known)), np.float32)
    incidence[np.arange(len(ranks))[:, None], place.reshape(ranks.shape)] = 1
    a, b = np.nonzero(np.triu(incidence @ incidence.T >= min(shared, ranks.shape[1]), 1))
    chunk, pair = table["_chunk"].to_numpy(), table["_pair"][0].as_py()
    chunks = table["_chunks"][0].as_py()
    if pair // chunks != pair % chunks:
        across = chunk[a] != chunk[b]
        a, b = a[across], b[across]
    out_a, out_b = [], []
    for i in range(0, len(a), 200_000):
        l, r = a[i:i + 200_000], b[i:i + 200_000]
        near = np.einsum("ij,ij->i", x[l], x[r]) >= least
        l, r = l[near], r[near]
        both = (prefix[l][:, :, None] == prefix[r][:, None, :]).any(axis=2)
        first = prefix[l][np.arange(len(l)), both.argmax(axis=1)]
        mine = first == table["pivot"][0].as_py()
        out_a.append(l[mine])
        out_b.append(r[mine])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (a[:0], b[:0])


def links(points: DataFrame, least: float = LEAST_COSINE, nearest: int = NEAREST,
          shared: int = SHARED) -> DataFrame:
    """``src``, ``dst``, ``n``: spanning links between points (n null), and for each point
    how many vectors it is linked with in one group (dst null)."""
    of = pivots(points)
    sizes = {d: min(nearest, len(p)) for d, p in of.items()}
    numbers = points.sparkSession.sparkContext.broadcast(of)  # bounded by PIVOTS

    def describe(batches):
        for batch in batches:
            near = []
            dims = batch.column(2).to_numpy()
            place = np.argsort(dims, kind="stable")
            for d in np.unique(dims):
                at = place[dims[place] == d]
                part = batch.take(pa.array(at))
                near = permutation(rows_of(part.column(3)), numbers.value[int(d)], sizes[int(d)])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                    names=[*part.schema.names, "near"])

    kind = points.schema["vector"].dataType.simpleString()
    label = points.schema["label"].dataType.simpleString()
    described = points.select("cid", "label", "dim", "vector", "n").mapInArrow(
        describe, f"cid long, label {label}, dim int, vector {kind}, n long, near array<int>")
    first = F.slice(F.array_sort("near"), 1, F.greatest(F.lit(1), F.size("near") - shared + 1))
    lists = materialise(described.withColumn("first", first), "pivot_places").withColumn(
        "pivot", F.explode("first")).drop("first")
    dealt = pairs_of_chunks(lists, ["label", "dim", "pivot"], F.col("cid"), LIST_ROWS)

    def work(batches):
        for table in groups(batches, 4):
            if len(table) < 2:
                continue
            a, b = _links(table, least, shared)
            if not len(a):
                continue
            cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
            src, dst = forest(cid[a], cid[b])
            degree = np.bincount(a, n[b], len(cid)) + np.bincount(b, n[a], len(cid))
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([src, cid[some]])),
                pa.array([*dst.tolist(), *[None] * len(some)], pa.int64()),
                pa.array([*[None] * len(src), *degree[some].astype(np.int64).tolist()], pa.int64()),
            ], names=["src", "dst", "n"])

    keys = ["label", "dim", "pivot", "_pair"]
    return (dealt.select(*keys, "_chunk", "_chunks", "cid", "n", "near", "vector")
            .repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(work, "src long, dst long, n long"))


def near_copies(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                least: float = LEAST_COSINE) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    fine = usable(F.col(vector)) & F.col(label).isNotNull()
    # As JSON, so that no label can run into the components.
    same = F.md5(F.to_json(F.struct(F.col(label).alias("l"), F.col(vector).alias("v"))))
    # A row that links with nothing has no class.
    rows = df.select(F.col(key).alias("_id"), F.col(label).alias("label"),
                     F.col(vector).alias("vector"), F.when(fine, same).alias("key"))
    points = materialise(
        rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.count("*").alias("n"), F.min("_id").alias("least"), F.first("label").alias("label"),
            F.first("vector").alias("vector"))
        .withColumns({"dim": F.size("vector"), "cid": F.monotonically_increasing_id()}), "vector_points")
    found = materialise(links(points, least), "vector_links")
    label_of = components(found.filter(F.col("dst").isNotNull()).select("src", "dst"))
    degree = found.filter(F.col("dst").isNull()).groupBy(F.col("src").alias("cid")).agg(
        F.sum("n").alias("degree"))
    named = (points.select("key", "cid", "n", "least").join(degree, "cid", "left")
             .join(label_of.withColumnRenamed("node", "cid"), "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = named.join(component, "root").select(
        "key", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = rows.select("_id", "key").join(told.withColumnRenamed("key", "_class"),
                                         F.col("key") == F.col("_class"), "left")
    own = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"),
                      own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept"))
