"""Which findings deserve a person, and which small ones add up to a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K, schemas as S
from .scale import running, skew_join


def triage(findings: DataFrame, floor=K.MATERIALITY_FLOOR,
           aggregate_floor=K.MATERIALITY_AGGREGATE) -> DataFrame:
    """Every finding with the lane it falls in; nothing is dropped."""
    impact = F.col("money_impact")
    below = (impact > 0) & (impact < F.lit(floor))
    claims = (
        findings.filter(below).groupBy("close_id", "defect_class")
        .agg(F.sum("money_impact").alias("_total"))
        .filter(F.col("_total") >= F.lit(aggregate_floor))
        .select("close_id", "defect_class", F.lit(True).alias("_claimed"))
    )
    rows = skew_join(findings, claims, ["close_id", "defect_class"], "left")
    lane = (
        F.when(impact <= 0, "not_about_money").when(~below, "chased")
        .when(F.col("_claimed"), "aggregated").otherwise("waived")
    )
    return rows.withColumn("lane", lane).drop("_claimed")


def claims(triaged: DataFrame) -> DataFrame:
    """The small items of a class put together as one claim."""
    return triaged.filter("lane = 'aggregated'").groupBy("close_id", "defect_class").agg(
        F.count(F.lit(1)).alias("items"), F.sum("money_impact").cast(S.TOTAL).alias("total"),
        F.max("money_impact").alias("largest"))


def in_order(triaged: DataFrame) -> DataFrame:
    """``place`` of each item that is chased or waived, largest first within its lane."""
    lanes = triaged.filter(F.col("lane").isin("chased", "waived"))
    return running(lanes, ["close_id", "lane"],
                   [F.desc("money_impact"), F.col("check_rank"), F.col("line_no"),
                    F.col("subject_id")], "lane-order", place=("count", "lane"))


def _class_totals(findings: DataFrame, floors) -> DataFrame:
    """Counts and sums per close and class on both sides of each floor, in one pass."""
    impact = F.col("money_impact")
    zero = F.lit(0).cast(S.TOTAL)
    per_floor = []
    for n, floor in enumerate(floors):
        small = (impact > 0) & (impact < F.lit(floor))
        large = (impact > 0) & (impact >= F.lit(floor))
        per_floor += [
            F.count(F.when(small, 1)).alias(f"_ns{n}"),
            F.coalesce(F.sum(F.when(small, impact)), zero).cast(S.TOTAL).alias(f"_ss{n}"),
            F.count(F.when(large, 1)).alias(f"_nl{n}"),
            F.coalesce(F.sum(F.when(large, impact)), zero).cast(S.TOTAL).alias(f"_sl{n}"),
        ]
    wide = findings.groupBy("close_id", "defect_class").agg(
        F.count(F.when(impact <= 0, 1)).alias("n_free"), *per_floor)
    return wide.select("close_id", "defect_class", "n_free", F.inline(F.array(*[
        F.struct(F.lit(floor).cast(S.MONEY).alias("floor"), F.col(f"_ns{n}").alias("n_small"),
                 F.col(f"_ss{n}").alias("small"), F.col(f"_nl{n}").alias("n_large"),
                 F.col(f"_sl{n}").alias("large"))
        for n, floor in enumerate(floors)])))


def sweep(findings: DataFrame, floors=K.SWEEP_FLOORS,
          aggregate_floor=K.MATERIALITY_AGGREGATE) -> DataFrame:
    """Work saved and money left unexamined per close, for each floor."""
    claimed = (F.col("n_small") > 0) & (F.col("small") >= F.lit(aggregate_floor))
    waived = (F.col("n_small") > 0) & ~claimed
    zero = F.lit(0).cast(S.TOTAL)

    def money(condition, name):
        return F.coalesce(F.sum(F.when(condition, F.col(name))), zero).cast(S.TOTAL)

    out = _class_totals(findings, floors).groupBy("close_id", "floor").agg(
        F.sum(F.col("n_free") + F.col("n_small") + F.col("n_large")).alias("items_before"),
        (F.sum(F.col("n_free") + F.col("n_large")) + F.count(F.when(claimed, 1)))
        .alias("items_after"),
        F.count(F.when(claimed, 1)).alias("n_claims"),
        money(F.lit(True), "large").alias("chased_total"),
        money(claimed, "small").alias("aggregated_total"),
        money(waived, "small").alias("waived_total"))
    whole = F.col("chased_total") + F.col("aggregated_total") + F.col("waived_total")
    share = F.when(whole > 0, F.col("waived_total").cast("double") / whole.cast("double"))
    return out.withColumn("items_saved", F.col("items_before") - F.col("items_after")) \
        .withColumn("waived_share", F.round(F.coalesce(share, F.lit(0.0)), 6))
