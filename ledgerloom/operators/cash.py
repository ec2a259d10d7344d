"""What money is there: in the bank, not arriving yet, and owed each way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.money import lit_money
from .rows import union_all

# Finding class, column, direction (fixed values).
LINES = (
    ("chargeback_hold", "held", "not_arriving"),
    ("timing_shift", "late", "not_arriving"),
    ("unsettled_revenue", "unpaid", "claims_in"),
    ("fee_overcharge", "overcharged", "claims_in"),
    ("unrecorded_adjustment", "deducted", "claims_in"),
    ("duplicate_capture", "duplicated", "claims_out"),
)


def cash_lines(findings: DataFrame) -> DataFrame:
    """Count and amount per close and line; a late payout moves a date, not an amount."""
    names = {cls: (col, side) for cls, col, side in LINES}
    shown = findings.filter(F.col("defect_class").isin(list(names)))
    amount = F.when(F.col("defect_class") == "timing_shift", lit_money("0.00")).otherwise(
        F.col("money_impact"))

    def label(part):
        pick = F.when(F.lit(False), F.lit(""))
        for cls, parts in names.items():
            pick = pick.when(F.col("defect_class") == cls, parts[part])
        return pick

    return (
        shown.groupBy("close_id", "defect_class")
        .agg(F.count(F.lit(1)).alias("items"), F.sum(amount).cast(S.TOTAL).alias("amount"))
        .select("close_id", label(1).alias("side"), label(0).alias("line"), "items", "amount")
    )


def cash_position(matches: DataFrame, findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row per close. Withheld money is shown and never added to the net position."""
    line_sums = [part for _, col, _ in LINES for part in (col, f"n_{col}")]
    columns = ["in_bank", "matched_batches", *line_sums, "unreconciled", "unreconciled_count"]

    def tally(df, **given):
        def column(name):
            if name in given:
                return given[name].alias(name)
            count = name.startswith("n_") or name in ("matched_batches", "unreconciled_count")
            kind = "long" if count else "decimal(28,2)"
            return F.lit(0).cast(kind).alias(name)
        return df.select("close_id", *[column(c) for c in columns])

    landed = matches.groupBy("close_id").agg(
        F.sum("credited").cast(S.TOTAL).alias("a"), F.count(F.lit(1)).alias("b"))
    lines = cash_lines(findings)
    orphans = exceptions.filter("kind = 'unclaimed_credit'").groupBy("close_id").agg(
        F.sum(F.col("context")["amount"].cast(S.MONEY)).cast(S.TOTAL).alias("a"),
        F.count(F.lit(1)).alias("b"))
    by_line = {}
    for _, col, _ in LINES:
        mine = F.col("line") == col
        by_line[col] = F.when(mine, F.col("amount")).otherwise(lit_money("0.00")).cast(S.TOTAL)
        by_line[f"n_{col}"] = F.when(mine, F.col("items")).otherwise(F.lit(0)).cast("long")
    parts = union_all([
        tally(landed, in_bank=F.col("a"), matched_batches=F.col("b")),
        tally(lines, **by_line),
        tally(orphans, unreconciled=F.col("a"), unreconciled_count=F.col("b")),
    ])
    money = {"in_bank", "unreconciled", *[col for _, col, _ in LINES]}
    total = parts.groupBy("close_id").agg(*[
        (F.sum(c).cast(S.TOTAL) if c in money else F.sum(c)).alias(c) for c in columns])
    owed_in = sum((F.col(c) for _, c, side in LINES if side == "claims_in"), lit_money("0.00"))
    owed_out = sum((F.col(c) for _, c, side in LINES if side == "claims_out"), lit_money("0.00"))
    return (
        total.withColumn("owed_to_us", owed_in.cast(S.TOTAL))
        .withColumn("owed_by_us", owed_out.cast(S.TOTAL))
        .withColumn("net_position", (F.col("in_bank") + F.col("owed_to_us")
                                     - F.col("owed_by_us")).cast(S.TOTAL))
    )


def money_by_class(findings: DataFrame) -> DataFrame:
    """Count, total and share of the identified money per class of each close."""
    by_class = findings.groupBy("close_id", "defect_class").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("money_impact").cast(S.TOTAL).alias("amount"))
    with_money = F.when(F.col("amount") > 0, F.col("amount"))
    whole = by_class.groupBy("close_id").agg(F.sum(with_money).cast(S.TOTAL).alias("whole"))
    share = (with_money.cast("double") / F.col("whole").cast("double"))
    return by_class.join(whole, "close_id").select(
        "close_id", "defect_class", "items", "amount", (F.col("amount") > 0).alias("has_money"),
        F.round(share, 6).alias("share"))
