"""Groups of bounded size for tasks in Python, whatever the size of a key."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def chunk_counts(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows, and in how many ``_chunks`` they are cut."""
    return (df.groupBy(*keys).count().filter(F.col("count") > rows)
            .select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("_chunks")))


def pairs_of_chunks(df: DataFrame, keys: list[str], item: Column, rows: int) -> DataFrame:
    """Every two rows of a key meet in exactly one group of (keys, ``_pair``).

    A key of more than ``rows`` rows is cut into chunks by a hash of ``item``, and a group
    holds two of them; ``_chunk`` says which one a row is in. ``_chunks`` stays in the rows.
    """
    cut = df.join(chunk_counts(df, keys, rows), keys, "left").withColumn(
        "_chunks", F.coalesce("_chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda other: (
        F.least(F.col("_chunk"), other).cast("long") * F.col("_chunks") + F.greatest(F.col("_chunk"), other)))
    return cut.withColumn("_chunk", chunk).withColumn("_pair", F.explode(pairs))


def runs(batches, keys: int):
    """Slices of the batches with one value each of the first ``keys`` columns, as they arrive."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for i in range(keys):
            column = batch.column(i)
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            change = differs if change is None else pc.or_(change, differs)
        cuts = [0, *(x + 1 for x in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def groups(batches, keys: int):
    """Whole groups, as tables, from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for i in range(keys):
            column = batch.column(i)
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            change = differs if change is None else pc.or_(change, differs)
        cuts = [0, *(x + 1 for x in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        if held:
            same = all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys))
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if b < batch.num_rows:
                yield pa.Table.from_batches([*held, part])
                held = []
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)
