"""Top lists of a close. The limit is the feature: a person reads the head of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K


def least_clean_matches(matches: DataFrame, limit: int = 25) -> DataFrame:
    """The matches furthest from closing, per close."""
    rows = matches.withColumn("delta", F.col("credited") - F.col("expected_net")).withColumn(
        "is_clean", F.abs("delta") <= F.lit(K.TOLERANCE))
    order = W.partitionBy("close_id").orderBy("is_clean", F.desc(F.abs("delta")), "batch_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def largest_findings(findings: DataFrame, limit: int = 8) -> DataFrame:
    """The findings with most money on them, per close."""
    order = W.partitionBy("close_id").orderBy(
        F.desc("money_impact"), "defect_class", "subject_id")
    return findings.filter("money_impact > 0").withColumn(
        "place", F.row_number().over(order)).filter(F.col("place") <= limit)
