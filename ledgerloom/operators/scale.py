"""Building blocks that keep every step spread out when one key is very large."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import constants as K

# Keys holding a larger share than this are split; at most 1/share such keys exist.
HOT_SHARE = 0.001


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


def _at(spark: SparkSession, path: str):
    """A path and its file system, whichever one the session's settings name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    at, files = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file: what it stands for is complete."""
    at, files = _at(spark, path)
    files.create(at, True).close()


def in_writing_order(file: str) -> list:
    """Order of part files as their tasks are numbered: 100000 comes after 99999.

    Files go by folder, then by the number in a part file's name, then by name.
    """
    path = F.col(file)
    number = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).try_cast("long")
    return [F.regexp_extract(path, "^(.*)/", 1), number.asc_nulls_first(), path]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back, columnar and with known size."""
    path = f"{shared_folder(df.sparkSession)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# The driver holds the plan, the generated code and the compiler's work of every job under way,
# so few run at a time; each still uses all cores.
SIDE_BY_SIDE = 3
_JOBS = ThreadPoolExecutor(max_workers=SIDE_BY_SIDE)


def start(work):
    """Run ``work``, which submits Spark jobs of its own, beside the caller; gives a future."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return _JOBS.submit(inheritable_thread_target(spark)(work))


def materialise_all(frames: dict) -> dict[str, DataFrame]:
    """Write independent intermediate tables at the same time, each by its own Spark jobs.

    A value is a DataFrame or a function that makes one.
    """
    def write(made, name):
        return materialise(made() if callable(made) else made, name)

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
        running_jobs = {name: pool.submit(inheritable_thread_target(spark)(write), made, name)
                        for name, made in frames.items()}
        return {name: job.result() for name, job in running_jobs.items()}


def skew_join(left, right, on, how="inner", spread_by="line_no", salt=False) -> DataFrame:
    """Equi join of many left rows to a right side with few rows per key.

    Spark's adaptive execution splits the partitions of a hot key by itself, so a plain
    join is asked for. ``salt`` spreads hot keys before the shuffle instead: for sessions
    without adaptive execution, or where what follows keeps Spark from splitting.
    """
    return salted_join(left, right, on, how, spread_by) if salt else left.join(right, on, how)


def salted_join(left, right, on, how="inner", spread_by="line_no") -> DataFrame:
    """A join that deals the left rows of hot keys out over several tasks.

    Keys that hold more than ``HOT_SHARE`` of the left rows are found by a frequent items
    pass, which returns at most ``1 / HOT_SHARE`` of them. That list is written, so both
    sides read the same one, and small enough to broadcast. Only hot left rows are salted
    and only their right rows copied.
    """
    salts = max(4, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    key = F.xxhash64(*on)
    hot = materialise(
        left.select(key.alias("_key")).stat.freqItems(["_key"], HOT_SHARE)
        .select(F.explode("_key_freqItems").alias("_key"))
        .withColumn("_hot", F.lit(True)), "hot-keys")
    salted = (
        left.withColumn("_key", key).join(F.broadcast(hot), "_key", "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)))
                    .otherwise(F.lit(0)).cast("int"))
        .drop("_key", "_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    copied = (
        right.withColumn("_key", key).join(F.broadcast(hot), "_key", "left")
        .withColumn("_salt", F.explode(copies)).drop("_key", "_hot")
    )
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")


def running(df: DataFrame, group, order, name, backward=(), **totals) -> DataFrame:
    """Running aggregates in a global order, without one task per group.

    ``totals`` maps an output column to ``(kind, column)``, kind one of sum, max, min
    or count; those named in ``backward`` run from the end of the group. The rows are
    range sorted over all tasks, each task's share is aggregated by itself, and what
    earlier (later) tasks hold is added; only one row per group and task travels
    between them. ``order`` must end in a unique column; with ``backward`` it is names of
    columns, all ascending.
    """
    ordered = materialise(
        df.orderBy(*[F.col(c) for c in group], *order)
        .withColumn("_part", F.spark_partition_id()), name)
    step = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    pieces = ordered.groupBy(*group, "_part").agg(
        *[step[kind](col).alias(f"_p_{out}") for out, (kind, col) in totals.items()])

    def part(out):
        return F.desc("_part") if out in backward else F.col("_part")

    def row(out):
        return [F.desc(c) for c in order] if out in backward else order

    parts = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    carried = pieces.select(*group, "_part", *[
        merge[kind](f"_p_{out}").over(parts.orderBy(part(out)).rowsBetween(
            W.unboundedPreceding, -1)).alias(f"_c_{out}")
        for out, (kind, _) in totals.items()])
    inside = W.partitionBy(*group, "_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ordered
    for out, (kind, col) in totals.items():
        local = local.withColumn(f"_l_{out}", step[kind](col).over(inside.orderBy(*row(out))))
    both = local.join(carried, [*group, "_part"], "left")
    for out, (kind, _) in totals.items():
        mine, earlier = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind in ("sum", "count"):
            value = F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            value = (F.greatest if kind == "max" else F.least)(mine, earlier)
        both = both.withColumn(out, value)
    extra = [f"_{tag}_{out}" for out in totals for tag in ("l", "c")]
    return both.drop("_part", *extra)


def amount_window_join(demand: DataFrame, supply: DataFrame, first_day: int, last_day: int,
                       target="target", until=None) -> DataFrame:
    """Pairs whose amount lies within the tolerance and whose date lies in the window.

    ``until`` names a column of the demands with a last day of their own, at most
    ``last_day``.

    Both ranges become bucket keys, so this is an equi join. ``supply`` must hold one
    row per close, date and amount and ``demand`` one per close, date and target: a
    row then meets at most 201 amounts per day of the window, whatever the volume.
    """
    span = last_day - first_day + 1
    tolerance, width = F.lit(K.TOLERANCE), F.lit(K.TOLERANCE) * 2

    def bucket(value, size):
        return F.floor(value / size).cast("long")

    day = F.unix_date("settled_on")
    end = F.lit(last_day) if until is None else F.col(until)
    wanted = (
        demand
        .withColumn("_day_bucket", F.explode(F.sequence(
            bucket(day + first_day, span), bucket(day + end, span))))
        .withColumn("_amount_bucket", F.explode(F.sequence(
            bucket(F.col(target) - tolerance, width), bucket(F.col(target) + tolerance, width))))
    )
    offered = supply.select(
        "*", bucket(F.unix_date("value_date"), F.lit(span)).alias("_day_bucket"),
        bucket(F.col("amount"), width).alias("_amount_bucket"))
    near = (F.abs(F.col("amount") - F.col(target)) <= tolerance) & F.datediff(
        "value_date", "settled_on").between(F.lit(first_day), end)
    keys = ["close_id", "_day_bucket", "_amount_bucket"]
    return wanted.join(offered, keys).filter(near).drop("_day_bucket", "_amount_bucket")
