"""Shards of nearly equal bytes by sampled splitters, all in DataFrame expressions.

Records are cut into ranges of a key. The splitters are quantiles of a sample of keys in
which a record's chance grows with its size, so ranges hold nearly equal bytes. An
overfull range is subdivided by key: each large key is a unit of its own, the others are
dealt by their hash. Only a key larger than a twentieth of a shard is cut, record by
record. The exact bytes of the units are then summed up in key order and give every unit
its shard; whole large keys go first, the small units fill the room they leave.

The rows of a range, not of a shard, are ranked together, and there are many ranges per
shard: the work of the last step spreads however few the shards are.

The sample is bounded by ``sample_per_range`` keys for each range; every other figure
covers all rows. Which rows enter the sample depends on hashes of key and tie only.

Edge cases: a null text has size 1 and the checksum of the empty text; rows equal in key
and tie are still dealt out one by one; a null tie is a value like others; with fewer
rows than shards some shards stay empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scale import materialise

SHARDS = 16
RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 32
# A key of at most this part of a shard's bytes stays whole.
WHOLE = 20


def _unit(column: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.shiftrightunsigned(column, 11) / F.lit(float(1 << 53))


def splitters(rows: DataFrame, ranges: int, sample: int) -> list[str]:
    """Keys at the size-weighted quantiles, at most ``ranges`` - 1 of them, rising."""
    total = rows.agg(F.sum("size").alias("n")).first()["n"]
    if not total:
        return []
    # A row of size s is drawn with chance s times rate; one larger than 1/rate counts as
    # often as its size says.
    rate = sample / total
    expected = F.col("size") * rate
    draws = F.floor(expected + _unit(F.xxhash64("key", "tie"))).cast("int")
    drawn = rows.select("key", draws.alias("draws")).filter("draws > 0")
    by_key = drawn.groupBy("key").agg(F.sum("draws").alias("draws"))
    # One row per sampled key: at most ``sample`` of them, about.
    before = F.coalesce(F.sum("draws").over(
        W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    all_draws = F.sum("draws").over(W.orderBy("key").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing))
    # A range starts at the first key of each stretch of draws.
    placed = by_key.select("key", before.alias("before"), all_draws.alias("all"))
    part = F.floor(F.col("before") * ranges / F.col("all"))
    starts = placed.groupBy(part.alias("part")).agg(F.min("key").alias("key"))
    return [r["key"] for r in starts.orderBy("key").collect()][1:]


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below the key: a binary search written as an expression."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    table = F.split(F.lit("\n".join(bounds)), "\n")

    def narrower(low, step):
        at = low + step
        return F.when((at <= len(bounds)) & (F.element_at(table, F.least(at, F.lit(len(bounds)))) <= key),
                      at).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), narrower)


def assign(rows: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD,
           sample_per_range: int = SAMPLE_PER_RANGE) -> DataFrame:
    """The rows with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``rows`` must be a written table with ``key`` (string without line breaks, not null),
    ``tie`` (long), ``size`` (long) and ``row`` (unique).
    """
    ranges = shards * ranges_per_shard
    bounds = splitters(rows, ranges, ranges * sample_per_range)
    ranged = rows.withColumn("range", range_of(F.col("key"), bounds))
    sums = materialise(ranged.groupBy("range").agg(F.sum("size").alias("bytes")), "range_sums")
    total = sums.agg(F.sum("bytes").alias("n")).first()["n"] or 1
    share = total / ranges
    crowded = F.col("bytes") > 2 * share
    # Large keys of overfull ranges, at most twice as many as ranges; cut if they must be.
    keys = ranged.join(F.broadcast(sums.filter(crowded).select("range")), "range", "left_semi").groupBy(
        "range", "key").agg(F.sum("size").alias("large")).filter(F.col("large") > share / 2)
    pieces = F.when(F.col("large") * shards * WHOLE <= total, 1).otherwise(F.ceil(F.col("large") / share))
    first = F.coalesce(F.sum("pieces").over(
        W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = materialise(keys.withColumn("pieces", pieces.cast("int")).withColumn("first", first), "large_keys")
    rest = F.col("bytes") - F.coalesce("large", F.lit(0))
    parts = sums.join(large.groupBy("range").agg(F.sum("large").alias("large")), "range", "left").select(
        "range", F.when(crowded, F.greatest(F.ceil(rest / share), F.lit(1))).otherwise(1).alias("parts"))
    # A unit is a range, a part of its keys, a large key or a piece of one.
    cut = (ranged.join(F.broadcast(parts), "range")  # at most ``ranges`` rows
           .join(F.broadcast(large.select("key", "pieces", "first")), "key", "left")
           .withColumn("sub", F.when(F.col("pieces").isNull(), F.floor(_unit(F.xxhash64("key")) * F.col("parts")))
                       .otherwise(ranges + 1 + F.col("first") + F.floor(
                           _unit(F.xxhash64("tie", "row")) * F.col("pieces"))).cast("int")))
    filled = materialise(cut.groupBy("range", "sub").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"),
        F.coalesce(F.max("pieces") == 1, F.lit(False)).alias("whole")), "units")
    cut = cut.drop("parts", "pieces", "first")
    # At most a few times ``ranges`` rows from here on.
    order = W.orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("bytes").over(order), F.lit(0)) + F.col("bytes") / 2
    whole = materialise(filled.withColumn("shard", F.least(
        F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int")).filter("whole"), "whole_keys")
    taken = {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    room = [max(total / shards - taken.get(i, 0), 0) for i in range(shards)]
    # Where the room of each shard but the last ends, as parts of all room.
    ends = [sum(room[:i + 1]) / (sum(room) or 1) for i in range(shards - 1)]
    small = filled.filter("not whole")
    of_small = small.agg(F.sum("bytes").alias("n")).first()["n"] or 1
    at = middle / F.lit(of_small)
    small = small.withColumn("at", at).withColumn("shard", F.size(F.filter(
        F.array(*map(F.lit, ends)) if ends else F.array().cast("array<double>"),
        lambda end: end <= F.col("at")))).drop("at")
    placed = small.unionByName(whole)
    offset = F.coalesce(F.sum("n").over(
        W.partitionBy("shard").orderBy("range", "sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select("range", "sub", "shard", offset.alias("offset"))
    inside = F.row_number().over(W.partitionBy("range", "sub").orderBy("key", "tie", "row")) - 1
    return (cut.withColumn("inside", inside).join(F.broadcast(placed), ["range", "sub"])
            .withColumn("slot", F.col("offset") + F.col("inside"))
            .drop("sub", "inside", "offset"))


def by_text(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Documents to shards by the hash of their text, so that equal texts lie together.

    Returns ``key``, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``text_md5``, ``range``,
    ``shard`` and ``slot``. A group of equal texts is parted only if it holds more than a
    twentieth of a shard's bytes.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(df.select(
        F.col(key).alias("_id"), F.md5(F.encode(whole, "UTF-8")).alias("key"),
        F.xxhash64(F.col(key).cast("string")).alias("tie"),
        (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row")), "shard_keys")
    return assign(rows, shards).select(
        F.col("_id").alias(key), "size", "text_crc32", F.col("key").alias("text_md5"), "range",
        "shard", "slot")


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
          shards: int = SHARDS) -> None:
    """``key``, ``text``, ``shard`` and ``slot`` as Parquet, a folder per shard, rows by slot.

    Tasks take ranges, not shards, so a shard is written by several tasks. Rows equal in
    key and text are numbered on both sides, so each gets a slot of its own.
    """
    places = by_text(df, key, text, shards)
    texts = df.select(F.col(key), F.col(text), F.md5(F.encode(
        F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_md5"))

    def numbered(rows):
        alike = W.partitionBy(key, "text_md5").orderBy(F.lit(0))
        return rows.withColumns({"_n": F.row_number().over(alike),
                                 "_key": F.coalesce(F.col(key).cast("string"), F.lit("null"))})

    both = numbered(texts).join(
        numbered(places).select("_key", "text_md5", "_n", "range", "shard", "slot"),
        ["_key", "text_md5", "_n"])
    (both.repartition("shard", "range").sortWithinPartitions("shard", "slot")
     .select(key, text, "shard", "slot").write.partitionBy("shard").parquet(path))
