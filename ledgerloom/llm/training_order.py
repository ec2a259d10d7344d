"""Token shards in training order.

Every document's token sequence gets a slot by a keyed permutation of 0..N-1: a Feistel
network over the smallest power of two that holds N, walked again while it lands outside
(cycle-walking). It needs no table and no sort, and who has the key can recompute it.

A sequence's number before the permutation is its place in the input: the offset of its
file and its row in the file, which do not depend on how the files are split into tasks.

Shards are ranges of slots. A shard is one partition and one file: its sequences in slot
order, each closed by an end id, as unsigned 16-bit integers (little-endian) in rows of
``ROW_TOKENS`` ids; the last row is filled with end ids. Row r of a shard starts at byte
r * 2 * ROW_TOKENS, so reading is sequential and resumes anywhere. Files appear under
their name only when complete, and a task that runs again writes the same bytes.

Edge cases: a null or empty text is a sequence of its end id alone; repeated rows are
sequences of their own; texts are encoded whole whatever their length; an empty table
makes no shard and an empty index; only the named columns are read. A table not read from
Parquet files is written once first.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.scale import materialise, shared_folder
from .bpe import chunks, vocabulary
from .places import numbered

END = 50256
ROW_TOKENS = 2048
SLOTS_PER_SHARD = 8192
ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix of every value."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number; a permutation of 0..n-1."""
    bits = max(2, int(n - 1).bit_length())
    low_bits = bits // 2
    high_bits = bits - low_bits
    low_mask, high_mask = np.uint64((1 << low_bits) - 1), np.uint64((1 << high_bits) - 1)
    keys = [int(_mixed(np.array([i], np.uint64), key)[0]) for i in range(ROUNDS)]

    def once(x):
        high, low = x >> np.uint64(low_bits), x & low_mask
        for a, b in zip(keys[::2], keys[1::2]):  # each half is changed by the other
            high ^= _mixed(low, a) & high_mask
            low ^= _mixed(high, b) & low_mask
        return high << np.uint64(low_bits) | low

    out = once(numbers.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slots(df: DataFrame, key: str, text: str, secret: int) -> tuple[DataFrame, int]:
    """``_key``, ``_text`` and ``slot``, and how many slots there are."""
    rows, n = numbered(df.select(key, text))

    @F.pandas_udf("long")
    def slot(numbers):
        return type(numbers)(permuted(numbers.to_numpy(), n, secret))

    return rows.select(
        F.col("_all")[key].alias("_key"), F.coalesce(F.col("_all")[text], F.lit("")).alias("_text"),
        slot("_number").alias("slot")), n


def write_shards(df: DataFrame, vocabulary_path: str, secret: int, path: str | None = None,
                 key: str = "doc_id", text: str = "text", end: int = END,
                 row_tokens: int = ROW_TOKENS, per_shard: int = SLOTS_PER_SHARD):
    """Write the shards to ``path``; returns the index and the path.

    ``path`` is a URI all executors can write to, a new folder in the shared one if not
    given. The index has ``key``, ``slot``, ``shard``, ``first_row``, ``first_token`` (in
    the shard), ``n_tokens`` (without the end id) and ``ids_crc32`` for every sequence.
    """
    path = path or f"{shared_folder(df.sparkSession)}/ledgerloom/shards-{uuid.uuid4().hex}"
    rows, n = slots(df, key, text, secret)
    shards = max(1, -(-n // per_shard))
    names = ["_key", "slot", "shard", "first_row", "first_token", "n_tokens", "ids_crc32"]

    def write(batches):
        from pyarrow import fs

        words = vocabulary(vocabulary_path)
        if end >= 1 << 16 or len(words.lengths) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        store, folder = fs.FileSystem.from_uri(path)
        out = name = None
        shard, tokens = -1, 0
        for batch in batches:
            for a, b, texts in chunks(batch.column(1).cast(pa.binary())):
                if out is None:
                    shard = batch.column(2)[a].as_py() // per_shard
                    store.create_dir(folder, recursive=True)
                    name = f"{folder}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                starts, counts, sums = [], [], []
                for ids in words.encode(texts):
                    raw = np.append(np.frombuffer(ids, "<u4"), end).astype("<u2").tobytes()
                    out.write(raw)
                    starts.append(tokens)
                    counts.append(len(ids) // 4)
                    sums.append(zlib.crc32(raw[:-2]))
                    tokens += len(raw) // 2
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                    pa.array([shard] * (b - a), pa.int32()),
                    pa.array([s // row_tokens for s in starts], pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=names)
        if out is not None:
            out.write(np.full(-tokens % row_tokens, end, "<u2").tobytes())
            out.close()
            store.move(name, f"{folder}/shard-{shard:06d}.bin")

    schema = T.StructType([
        T.StructField("_key", df.schema[key].dataType), T.StructField("slot", T.LongType()),
        T.StructField("shard", T.IntegerType()), T.StructField("first_row", T.LongType()),
        T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])
    ranged = rows.repartitionById(shards, F.floor(F.col("slot") / per_shard).cast("int"))
    index = ranged.sortWithinPartitions("slot").mapInArrow(write, schema)
    written = materialise(index, "shard_index")
    return written.select(F.col("_key").alias(key), *names[1:]), path


def read_rows(path: str, shard: int, row: int = 0, row_tokens: int = ROW_TOKENS):
    """Rows of a shard from ``row`` on, as arrays of ids."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
        f.seek(row * row_tokens * 2)
        while raw := f.read(row_tokens * 2):
            yield np.frombuffer(raw, "<u2")
