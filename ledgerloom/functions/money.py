"""Row expressions over settlement amounts. All money is decimal, half-even."""

from pyspark.sql import Column, functions as F, types as T

from .. import constants as K

RATE = T.DecimalType(10, 6)


def lit_money(value) -> Column:
    return F.lit(value).cast(T.DecimalType(18, 2))


def is_payment() -> Column:
    return F.col("txn_type") == "payment"


def net_amount() -> Column:
    """What one row adds to the payout: payments net of charges, the rest taken out."""
    paid = F.col("gross_amount") - F.col("fee") - F.col("gst_on_fee")
    return F.when(is_payment(), paid).otherwise(-F.col("gross_amount")).cast(T.DecimalType(20, 2))


def fee_at(rate: Column) -> Column:
    return F.bround(F.col("gross_amount") * rate, 2).cast(T.DecimalType(20, 2))


def gst_on(fee: Column) -> Column:
    return F.bround(fee * F.lit(K.GST_RATE), 2).cast(T.DecimalType(20, 2))


def expected_fee() -> Column:
    rate = F.lit(K.CONTRACTED_RATE)
    return F.when(is_payment(), fee_at(rate)).otherwise(lit_money("0.00"))


def expected_gst() -> Column:
    return gst_on(expected_fee())


def implied_rate() -> Column:
    return F.bround(F.col("fee") / F.col("gross_amount"), 4).cast(T.DecimalType(18, 4))


def within_tolerance(difference: Column) -> Column:
    return F.abs(difference) <= F.lit(K.TOLERANCE)


def first_digit(amount: Column) -> Column:
    """First non-zero digit of a positive amount, null when there is none."""
    digit = F.substring(F.ltrim(F.abs(amount).cast("string"), F.lit("0.")), 1, 1)
    return F.when(digit != "", digit.cast("int"))


def log_money(amount: Column) -> Column:
    return F.log1p(F.abs(amount).cast("double"))
