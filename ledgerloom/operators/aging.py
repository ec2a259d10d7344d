"""Which questions come back close after close."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.text import standing_identity


def appearances(exceptions: DataFrame) -> DataFrame:
    """Exceptions named across closes. Needs ``series_id`` and ``close_seq`` columns."""
    return exceptions.withColumn("identity", standing_identity(
        F.col("kind"), F.col("subject_id"), F.col("context")))


def aged_questions(exceptions: DataFrame, closes: DataFrame) -> DataFrame:
    """Standing questions with every close counted once, and the run they are on.

    ``closes`` names every close held, by ``series_id`` and ``close_seq``. A close in
    which nothing was asked counts: it ends a run and resolves what came before it.
    """
    in_series = W.partitionBy("series_id").orderBy("close_seq")
    held = closes.select("series_id", "close_seq").distinct().select(
        "*", F.row_number().over(in_series).alias("_place"))
    observed = held.groupBy("series_id").agg(F.max("close_seq").alias("closes"))
    asked = appearances(exceptions).filter(F.col("identity").isNotNull()).select(
        "series_id", "identity", "close_seq").distinct().join(held, ["series_id", "close_seq"])
    order = W.partitionBy("series_id", "identity").orderBy("_place")
    islands = asked.withColumn("_island", F.col("_place") - F.row_number().over(order))
    runs = islands.groupBy("series_id", "identity", "_island").agg(
        F.count(F.lit(1)).alias("run"), F.min("close_seq").alias("first"),
        F.max("close_seq").alias("last"))
    items = runs.groupBy("series_id", "identity").agg(
        F.sum("run").alias("appearances"), F.max_by("run", "last").alias("consecutive"),
        F.min("first").alias("first_seq"), F.max("last").alias("last_seq"))
    return items.join(observed, "series_id").select(
        "series_id", "identity", "appearances", "consecutive", "first_seq", "last_seq",
        (F.col("appearances") > 1).alias("recurring"),
        (F.col("consecutive") >= K.STALE_AFTER).alias("stale"),
        (F.col("last_seq") < F.col("closes")).alias("resolved"))


def episodic_counts(exceptions: DataFrame, closes: DataFrame) -> DataFrame:
    """One-off items of every close; they cannot recur, so they are counted apart."""
    counted = appearances(exceptions).groupBy("series_id", "close_seq").agg(
        F.count(F.when(F.col("identity").isNull(), 1)).alias("episodic"))
    return closes.select("series_id", "close_seq").distinct().join(
        counted, ["series_id", "close_seq"], "left").fillna(0, ["episodic"])
