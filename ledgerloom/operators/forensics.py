"""First-digit screening of whole populations of amounts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.money import first_digit
from .rows import exception, text_map

EXPECTED = {d: math.log10(1 + 1 / d) for d in range(1, 10)}


def digit_profile(rows: DataFrame, keys, amount) -> DataFrame:
    """Digit shares per segment against Benford, judged by what chance does at its size."""
    digit = F.col("_digit")
    counted = (
        rows.filter(amount > 0).select(*keys, first_digit(amount).alias("_digit"))
        .filter(digit.isNotNull()).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"),
             *[F.count(F.when(digit == d, 1)).alias(f"d{d}") for d in EXPECTED])
    )
    # The nine shares as one array keep the generated code short.
    counts = F.array(*[F.col(f"d{d}") for d in EXPECTED])
    law = F.array(*[F.lit(e) for e in EXPECTED.values()])

    def total(term):
        return F.aggregate(F.zip_with(counts, law, term), F.lit(0.0), lambda acc, x: acc + x)

    mad = total(lambda c, e: F.abs(c / F.col("n") - e)) / 9
    chi = total(lambda c, e: F.col("n") * F.pow(c / F.col("n") - e, F.lit(2)) / e)
    few = F.col("n") < K.BENFORD_MIN_SAMPLE
    null_mad = F.when(few, 0.0).otherwise(
        K.BENFORD_NULL_MAD * F.sqrt(K.BENFORD_NULL_N / F.col("n")))
    band = F.when(few, "too few")
    for limit, name in K.NIGRINI_BANDS:
        band = band.when(F.col("mad") < limit, name)
    excess = F.when(F.col("null_mad") > 0, F.col("mad") / F.col("null_mad")).otherwise(0.0)
    verdict = (
        F.when(few, "too few").when(F.col("mad") <= F.col("null_mad"), "within chance")
        .when(F.col("excess") >= K.BENFORD_EXCESS, "nonconformity").otherwise("elevated")
    )
    return (
        counted.withColumn("mad", mad).withColumn("chi_square", chi)
        .withColumn("null_mad", null_mad).withColumn("excess", excess)
        .withColumn("band", band.otherwise("nonconformity")).withColumn("verdict", verdict)
    )


def worst_digits(profile: DataFrame, keys, top: int = 3) -> DataFrame:
    """The digits most over-represented per segment."""
    long = profile.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(d).alias("digit"), (F.col(f"d{d}") / F.col("n")).alias("observed"),
                 F.lit(e).alias("expected"))
        for d, e in EXPECTED.items()])).alias("g")).select(*keys, "g.*")
    order = W.partitionBy(*keys).orderBy(F.desc(F.col("observed") - F.col("expected")), "digit")
    return long.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def fabricated_amounts(settlement: DataFrame) -> DataFrame:
    """Payment methods whose amounts look authored. Always a question, never a finding."""
    paid = settlement.filter("txn_type = 'payment' and gross_amount > 0")
    profile = digit_profile(paid, ["close_id", "method"], F.col("gross_amount"))
    # One row per method is left by now, so a window over the close is short.
    rows = F.sum("n").over(W.partitionBy("close_id"))
    flagged = profile.withColumn("_rows", rows).filter(
        (F.col("_rows") >= K.BENFORD_MIN_SAMPLE) & (F.col("verdict") == "nonconformity"))
    context = text_map(method=F.col("method"), rows=F.col("n"),
                       mad=F.format_string("%.4f", "mad"),
                       chi_square=F.format_string("%.1f", "chi_square"))
    reason = F.format_string(
        "amounts of %s do not follow the first-digit law: deviation %.1f times chance",
        "method", "excess")
    return exception(flagged.withColumn("line_no", F.lit(0)), "fabricated_amounts",
                     F.concat(F.lit("segment::"), F.col("method")), context, reason, 30)
