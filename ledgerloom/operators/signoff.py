"""May this close be signed: three halts, two caveats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K, schemas as S
from .rows import union_all


def close_measures(counts: DataFrame, batches: DataFrame, matches: DataFrame,
                   open_credits: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The five numbers per close that the stopping rules look at."""
    def per_close(df, name, value=F.count(F.lit(1))):
        return df.groupBy("close_id").agg(value.alias(name))

    out = counts
    for part in (per_close(batches, "n_batches"), per_close(matches, "n_matches"),
                 per_close(open_credits, "unattributed",
                           F.sum("credit_amount").cast(S.TOTAL)),
                 per_close(exceptions, "n_exceptions")):
        out = out.join(part, "close_id", "left")
    zero = F.lit(0).cast(S.TOTAL)
    return out.fillna(0, ["n_batches", "n_matches", "n_exceptions"]).withColumn(
        "unattributed", F.coalesce("unattributed", zero))


def trips(measures: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Stopping rules that fired, one row each."""
    def trip(rows, rule, severity, observed):
        return rows.select("close_id", F.lit(rule).alias("rule"),
                           F.lit(severity).alias("severity"), observed.alias("observed"))

    share = F.col("n_matches") / F.col("n_batches")
    loose = F.col("unattributed").cast("double") / F.col("credited").cast("double")
    absent = F.array_join(F.array_compact(F.array(
        F.when(F.col("n_settlement") == 0, "settlement"), F.when(F.col("n_bank") == 0, "bank"))),
        ", ")
    fired = [
        trip(measures.filter("n_settlement = 0 or n_bank = 0"), "source_present", "halt",
             F.concat(absent, F.lit(" is empty"))),
        trip(measures.filter(F.when(F.col("n_batches") > 0, share < K.MIN_MATCHED_SHARE)),
             "match_rate_floor", "halt", F.format_string("%.1f%% of batches matched", share * 100)),
        trip(measures.filter(F.when(F.col("credited") > 0, loose > K.MAX_UNATTRIBUTED_SHARE)),
             "unattributed_money", "halt",
             F.concat(F.col("unattributed").cast("string"), F.lit(" tied to no batch"))),
        trip(measures.filter(F.col("n_exceptions") > K.MAX_QUEUE), "human_queue_depth",
             "degrade", F.concat(F.col("n_exceptions").cast("string"), F.lit(" exception(s)"))),
    ]
    if stops is not None:
        fired.append(stops.select("close_id", "rule", F.lit("degrade").alias("severity"),
                                  F.col("detail").alias("observed")))
    return union_all(fired)


def decisions(measures: DataFrame, fired: DataFrame) -> DataFrame:
    per_close = fired.groupBy("close_id").agg(
        F.count(F.when(F.col("severity") == "halt", 1)).alias("halts"),
        F.count(F.when(F.col("severity") == "degrade", 1)).alias("caveats"))
    rows = measures.select("close_id").join(per_close, "close_id", "left").fillna(0)
    return rows.withColumn(
        "decision", F.when(F.col("halts") > 0, "DO NOT SIGN")
        .when(F.col("caveats") > 0, "SIGN WITH CAVEATS").otherwise("SIGN"))
