"""Settlement batches and prepared credits: what the matcher works on."""

from pyspark.sql import DataFrame, functions as F

from ..functions.money import net_amount
from ..functions.rulebook import RuleBook
from ..functions.text import has_any_reference, strict_utr
from .. import schemas as S


def batch_nets(settlement: DataFrame) -> DataFrame:
    """Expected payout per batch with its last date, last reference and first line.

    The reference is a key of the first pass, so that pass holds only fixed-width
    sums and dates and reduces the rows before they travel.
    """
    by_reference = settlement.groupBy(
        "close_id", F.col("settlement_batch_id").alias("batch_id"), "utr").agg(
        F.sum(net_amount()).alias("part"), F.max("line_no").alias("last_line"),
        F.min("line_no").alias("first_line"), F.max_by("settled_on", "line_no").alias("last_day"),
        F.min("settled_on").alias("low_day"), F.max("settled_on").alias("high_day"))
    named = F.col("utr") != ""
    return by_reference.groupBy("close_id", "batch_id").agg(
        F.sum("part").cast(S.TOTAL).alias("expected"),
        F.max_by("last_day", "last_line").alias("settled_on"),
        F.max_by(F.when(named, F.col("utr")), F.when(named, F.col("last_line"))).alias("utr"),
        F.min("first_line").alias("batch_seq"), F.min("low_day").alias("first_settled_on"),
        F.max("high_day").alias("max_settled_on"))


NO_HIT = "struct<rule_id:string,kind:string,amount:decimal(18,2),utr:string>"


def prepare_credits(bank: DataFrame, book: RuleBook) -> DataFrame:
    """Credits with the reference they carry and the charge a rule expects on them."""
    rows = book.keyed(bank.withColumn("narration", F.coalesce("narration", F.lit(""))))
    if book.empty:
        rows = rows.withColumn("_hit", F.lit(None).cast(NO_HIT))
    else:
        texts = rows.select("_series", "narration").distinct()
        rows = rows.join(book.first_hits(texts), ["_series", "narration"], "left")
    hit = F.col("_hit")
    alias = F.when(hit["kind"] == "narration_alias", hit["utr"])
    charge = (hit["kind"] == "adjustment_pattern") & hit["amount"].isNotNull()
    given = F.when(F.col("utr") != "", F.col("utr"))
    return (
        rows.select(
            "close_id", "line_no", "bank_txn_id", "credit_amount", "value_date", "narration",
            F.coalesce(given, strict_utr(F.col("narration")), alias).alias("utr_x"),
            F.when(charge, hit["amount"]).alias("adj"),
            F.when(charge, hit["rule_id"]).alias("adj_rule"),
            has_any_reference(F.col("narration")).alias("has_ref"),
        )
    )
