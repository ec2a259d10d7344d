"""A number for every row of a table that lies in Parquet files."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.scale import in_writing_order, materialise


# Nodes of a plan that leaves the rows of a scan as they are.
WHOLE_SCAN = {"LogicalRelation", "Project", "SubqueryAlias"}


def whole_scan(df: DataFrame) -> bool:
    """Whether ``df`` has every row of the files it reads, each once."""
    plan = getattr(df, "_jdf", None)
    left = [plan.queryExecution().analyzed()] if plan is not None else []
    whole = bool(left)
    while whole and left:
        node = left.pop()
        below = node.children()
        if node.getClass().getSimpleName() == "LogicalRelation":
            # A path given twice is read twice, and its rows would share their numbers.
            files = list(node.relation().location().inputFiles())
            whole = len(files) == len(set(files))
        whole = whole and node.getClass().getSimpleName() in WHOLE_SCAN and below.size() <= 1
        left += [below.apply(i) for i in range(below.size())]
    return whole


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``_all`` (the whole row as a struct, so no name can clash) and ``_number``, and how
    many rows there are.

    Numbers run from 0 without gaps: the offset of the row's file, in writing order, and its row in
    the file. They do not depend on how files are split into tasks, so a row can be read
    again and found by its number. What is not the whole of a table in Parquet files, a
    filtered read among others, is written once first: its rows have gaps in the files.
    """
    def placed(df):
        found = df.metadataColumn("_metadata")
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
                         found["file_path"].alias("_file"), found["row_index"].alias("_at"))

    try:
        rows = placed(df if whole_scan(df) else materialise(df, "rows"))
        rows.schema
    except PySparkException:
        rows = placed(materialise(df, "rows"))
    # One row per file.
    counts = rows.groupBy("_file").agg(F.count("*").alias("n"))
    files = materialise(counts.select("_file", "n", F.coalesce(F.sum("n").over(
        W.orderBy(*in_writing_order("_file")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset")), "files")
    total = files.agg(F.sum("n").alias("n")).first()["n"] or 0
    return rows.join(files.select("_file", "_offset"), "_file").select(
        "_all", (F.col("_offset") + F.col("_at")).alias("_number")), total
