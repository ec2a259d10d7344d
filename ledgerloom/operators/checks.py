"""Checks on single settlement and ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.money import fee_at, gst_on, implied_rate, lit_money
from ..functions.rulebook import RuleBook
from .rows import exception, finding, text_map
from .scale import materialise, skew_join


def fee_checks(settlement: DataFrame, book: RuleBook) -> tuple[DataFrame, DataFrame]:
    """Overcharged rows as findings; a rate most of a method pays as one question."""
    paid = F.col("fee").cast("double") / F.col("gross_amount").cast("double")
    # Most rows are far below the margin; only the rest needs exact decimals.
    maybe = paid > F.col("rate").cast("double") + float(K.RATE_MARGIN) * 0.8
    implied = F.when(maybe, implied_rate())
    fair = F.when(maybe, fee_at(F.col("rate")))
    rated = (
        book.with_rate(settlement.filter("txn_type = 'payment' and gross_amount > 0").select(
            "close_id", "line_no", "txn_id", "method", "gross_amount", "fee", "gst_on_fee"))
        .withColumn("implied", implied).withColumn("fair_fee", fair)
        .withColumn("over", F.coalesce(
            (F.col("implied") > F.col("rate") + F.lit(K.RATE_MARGIN))
            & (F.col("fee") - F.col("fair_fee") > F.lit(K.FEE_ROUNDING_ALLOWANCE)),
            F.lit(False)))
        .withColumn("bucket", F.when(F.col("over"), F.bround("implied", 3)))
    )
    counts = rated.groupBy("close_id", "method", "rate", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    modal = F.max(F.when(F.col("bucket").isNotNull(), F.struct(
        "n", (-F.col("first_line")).alias("earliest"), "bucket")))
    cards = materialise(
        counts.groupBy("close_id", "method", "rate")
        .agg(F.sum("n").alias("total"), modal.alias("modal"))
        .filter((F.col("modal.n") >= K.SYSTEMATIC_MIN_ROWS)
                & (F.col("modal.n") / F.col("total") >= K.SYSTEMATIC_MIN_SHARE))
        .select("close_id", "method", "rate", F.col("modal.bucket").alias("bucket"),
                F.col("modal.n").alias("n"), (-F.col("modal.earliest")).alias("line_no")),
        "rate-cards")
    context = text_map(method=F.col("method"), implied_rate=F.col("bucket"),
                       assumed_rate=F.col("rate").cast("decimal(10,4)"),
                       rows_at_this_rate=F.col("n"))
    reason = F.format_string("%s payments are billed above the assumed rate alike: "
                             "confirm the contracted rate", "method")
    questions = exception(cards, "unknown_rate_card",
                          F.concat(F.lit("ratecard::"), F.col("method")), context, reason, 40)

    lone = skew_join(rated.filter("over"), cards.select("close_id", "method", "bucket"),
                     ["close_id", "method", "bucket"], "left_anti")
    impact = F.col("fee") + F.col("gst_on_fee") - (F.col("fair_fee") + gst_on(F.col("fair_fee")))
    findings = finding(
        lone, "fee_overcharge", F.col("txn_id"),
        F.when(F.col("has_rate"), K.L2).otherwise(K.L0), 1.0, impact,
        text_map(method=F.col("method"), gross=F.col("gross_amount"),
                 fee_charged=F.col("fee"), implied_rate=F.col("implied"),
                 contracted_rate=F.col("rate")), 10)
    return findings, questions


def duplicate_captures(settlement: DataFrame) -> DataFrame:
    """Payments of one order and amount after the one with the smallest id.

    Repeated keys are counted first, as one number a row; only their payments are looked at,
    by the keys themselves, so two keys with the same number stay apart.
    """
    keys = ["close_id", "order_id", "gross_amount"]
    paid = settlement.filter("txn_type = 'payment' and order_id != ''").select(
        *keys, "txn_id", "line_no", F.xxhash64(*keys).alias("_key"))
    counted = materialise(
        paid.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    # The condition holds for every row; it tells Spark that the list is worth a filter.
    repeated = counted.filter("n > 1").select("_key")
    suspects = materialise(skew_join(paid, repeated, ["_key"], "left_semi").drop("_key"), "suspects")
    mark = F.struct("txn_id", "line_no")
    originals = suspects.groupBy(*keys).agg(F.min(mark).alias("original"))
    rows = skew_join(suspects, originals, keys).filter(mark != F.col("original"))
    return finding(rows, "duplicate_capture", F.col("txn_id"), K.L0, 1.0, F.col("gross_amount"),
                   text_map(order_id=F.col("order_id"), original_txn_id=F.col("original.txn_id"),
                            duplicate_txn_id=F.col("txn_id"), amount=F.col("gross_amount")), 20)


def one_sided(settlement: DataFrame, ledger: DataFrame) -> DataFrame:
    """Transactions only one of settlement and ledger knows, found in a single shuffle."""
    def side(df, name):
        return df.select("close_id", F.coalesce("txn_id", F.lit("")).alias("txn_id"),
                         F.lit(name).alias("side"))

    sides = side(settlement, 1).unionByName(side(ledger, 2))
    return materialise(
        sides.groupBy("close_id", "txn_id").agg(F.min("side").alias("side"),
                                                F.max("side").alias("other"))
        .filter("side = other").drop("other"), "one-sided")


def _only_in(rows: DataFrame, gaps: DataFrame, side: int) -> DataFrame:
    filled = rows.withColumn("txn_id", F.coalesce("txn_id", F.lit("")))
    lone = gaps.filter(F.col("side") == side).select("close_id", "txn_id")
    return skew_join(filled, lone, ["close_id", "txn_id"], "left_semi")


def ledger_coverage(settlement: DataFrame, gaps: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Settled payments the ledger does not know, apart from known duplicates."""
    paid = settlement.filter("txn_type = 'payment'").select(
        "close_id", "txn_id", "line_no", "order_id", "gross_amount", "settlement_batch_id")
    known = duplicates.select("close_id", F.col("subject_id").alias("txn_id")).distinct()
    rows = skew_join(_only_in(paid, gaps, 1), known, ["close_id", "txn_id"], "left_anti")
    return finding(rows, "missing_ledger_entry", F.col("txn_id"), K.L0, 1.0,
                   F.col("gross_amount"),
                   text_map(order_id=F.coalesce("order_id", F.lit("")),
                            amount=F.col("gross_amount"), batch=F.col("settlement_batch_id")), 30)


def unsettled_revenue(settlement: DataFrame, ledger: DataFrame, gaps: DataFrame) -> DataFrame:
    """Ledger entries a week or more old that no settlement row mentions."""
    latest = settlement.groupBy("close_id").agg(F.max("settled_on").alias("latest"))
    rows = skew_join(_only_in(ledger, gaps, 2), latest, ["close_id"]).filter(
        F.col("created_at") <= F.date_sub("latest", K.UNSETTLED_HORIZON_DAYS))
    return finding(rows, "unsettled_revenue", F.col("txn_id"), K.L0, 1.0, F.col("amount"),
                   text_map(order_id=F.col("order_id"), amount=F.col("amount"),
                            created_at=F.col("created_at"),
                            aged_days=F.datediff("latest", "created_at"),
                            status=F.col("status")), 50)


def cross_cycle_refunds(settlement: DataFrame) -> DataFrame:
    """Refunds settled in another batch than the payment they reverse."""
    keys = ["close_id", "order_id"]
    with_order = settlement.filter("order_id != ''").select(
        *keys, "txn_type", "txn_id", "line_no", "settlement_batch_id", "gross_amount")
    refunds = with_order.filter("txn_type = 'refund'")
    refunded = materialise(refunds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "refunded")
    refunded = refunded.filter("n > 0").select(*keys)
    origins = (
        skew_join(with_order.filter("txn_type = 'payment'").select(
            *keys, "settlement_batch_id", "line_no"), refunded, keys, "left_semi")
        .groupBy(*keys).agg(F.max_by("settlement_batch_id", "line_no").alias("payment_batch"))
    )
    rows = skew_join(refunds, origins, keys).filter(
        "payment_batch != '' and payment_batch != settlement_batch_id")
    return finding(rows, "cross_cycle_refund", F.col("txn_id"), K.L0, 1.0, F.col("gross_amount"),
                   text_map(order_id=F.col("order_id"), payment_batch=F.col("payment_batch"),
                            refund_batch=F.col("settlement_batch_id"),
                            amount=F.col("gross_amount")), 40)


def chargeback_holds(settlement: DataFrame) -> DataFrame:
    rows = settlement.filter("txn_type = 'chargeback_hold'")
    return finding(rows, "chargeback_hold", F.col("txn_id"), K.L0, 1.0, F.col("gross_amount"),
                   text_map(order_id=F.coalesce("order_id", F.lit("")),
                            amount=F.col("gross_amount"), batch=F.col("settlement_batch_id")), 60)


def source_counts(settlement: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of each source per close, plus the money the bank credited."""
    zero = lit_money("0.00")

    def tally(df, name, money=zero):
        return df.groupBy("close_id").agg(
            *[F.count(F.lit(1)).alias(f"n_{s}") if s == name
              else F.lit(0).cast("long").alias(f"n_{s}")
              for s in ("settlement", "bank", "ledger")],
            F.sum(money).alias("credited"))

    parts = (tally(settlement, "settlement").unionByName(tally(bank, "bank",
                                                               F.col("credit_amount")))
             .unionByName(tally(ledger, "ledger")))
    return parts.groupBy("close_id").agg(
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("settlement", "bank", "ledger")],
        F.sum("credited").cast("decimal(28,2)").alias("credited"))


def missing_sources(counts: DataFrame) -> DataFrame:
    """Closes that cannot be checked because a file never came."""
    rows = counts.withColumn("line_no", F.lit(0))
    no_report = rows.filter("n_settlement = 0 and (n_ledger > 0 or n_bank > 0)")
    no_bank = rows.filter("n_bank = 0 and n_settlement > 0")
    return exception(
        no_report, "missing_source", F.lit("sources::settlement"),
        text_map(have_ledger=F.col("n_ledger"), have_bank=F.col("n_bank")),
        "no settlement report: nothing was checked", 20,
    ).unionByName(exception(
        no_bank, "missing_source", F.lit("sources::bank"),
        text_map(have_settlement=F.col("n_settlement")),
        "no bank statement: no payout could be confirmed", 20))
