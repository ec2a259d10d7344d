"""What can be said once a batch is tied to its credits, and what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K, schemas as S
from ..functions.rulebook import RuleBook
from ..functions.text import injection_names
from .rows import exception, finding, findings_of, text_map


def match_findings(batches: DataFrame, matches: DataFrame) -> DataFrame:
    """Missing references, splits, timing shifts, unreadable labels and shortfalls.

    What a match says is read off in one pass over the matches.
    """
    batch, by_utr = F.col("batch_id"), F.col("method").startswith("utr_join")
    no_utr = batches.filter(F.col("utr").isNull()).withColumn("line_no", F.col("batch_seq"))
    missing = finding(no_utr, "missing_utr", batch, K.L0, 1.0, F.lit(0),
                      text_map(batch=batch, fallback=F.lit("amount_and_date")), 70)
    rows = matches.withColumn("line_no", F.col("batch_seq")).withColumn(
        "_gap", F.col("gross_expected") - F.col("credited"))
    explained, alone = F.col("rule_id").isNotNull(), F.col("n_credits") == 1
    split = (
        F.col("n_credits") > 1, "split_settlement", batch,
        F.when(by_utr, K.L0).otherwise(K.L1), F.when(by_utr, 1.0).otherwise(0.90), F.lit(0),
        text_map(parts=F.col("n_credits"), total=F.col("credited"),
                 found_by=F.when(by_utr, "utr_join")), 71)
    known = (
        ~by_utr & explained, "unrecorded_adjustment", batch, K.L2,
        F.when(alone, 0.97).otherwise(0.95), F.col("adjustment"),
        text_map(amount=F.col("adjustment"), explained_by=F.col("rule_id"),
                 status=F.when(alone, "charge_known").otherwise("charge_known_split")),
        72, F.col("rule_id"))
    late = (
        F.col("first_value_date") > F.col("settled_on"), "timing_shift", batch, K.L1, 0.95,
        F.lit(0),
        text_map(settled_on=F.col("settled_on"), value_date=F.col("first_value_date"),
                 offset_days=F.datediff("first_value_date", "settled_on")), 73)
    drift = (
        F.col("drift_credit").isNotNull(), "narration_drift", batch, K.L1, 0.85, F.lit(0),
        text_map(bank_txn_id=F.col("drift_credit"), narration=F.col("drift_narration")), 74)
    # Stages below the reference join only accept sums that close, so a gap is theirs alone.
    gap = (
        by_utr & (F.col("_gap") > F.lit(K.TOLERANCE)), "unrecorded_adjustment", batch,
        F.when(explained, K.L2).otherwise(K.L0), F.when(explained, 0.97).otherwise(1.0),
        F.col("_gap"),
        text_map(expected_net=F.col("gross_expected"), credited=F.col("credited"),
                 shortfall=F.col("_gap"),
                 status=F.when(explained, "charge_known").otherwise("charge_open"),
                 explained_by=F.col("rule_id")), 75, F.col("rule_id"))
    return missing.unionByName(findings_of(rows, split, known, late, drift, gap))


def stale_rules(matches: DataFrame, book: RuleBook) -> DataFrame:
    """Charge rules that still apply but no longer explain what was taken."""
    gap = F.col("expected_net") - F.col("credited")
    observed = matches.withColumn("_gap", gap).filter(
        (F.col("_gap") > F.lit(K.TOLERANCE)) & F.col("first_rule").isNotNull()
        & (F.abs(F.col("first_adjustment") - F.col("_gap")) > F.lit(K.TOLERANCE)))
    counts = observed.groupBy("close_id", F.col("first_rule").alias("rule_id"), "_gap").agg(
        F.count(F.lit(1)).alias("n"), F.min("batch_seq").alias("first_seq"))
    modal = F.max(F.struct("n", (-F.col("first_seq")).alias("earliest"), "_gap"))
    stale = counts.groupBy("close_id", "rule_id").agg(modal.alias("m")).filter(
        F.col("m.n") >= K.STALE_RULE_MIN_ROWS)
    if book.empty:
        known = stale.withColumn("params", F.lit(None).cast(S.TEXT_MAP))
    else:
        charges = book.live().filter("kind = 'adjustment_pattern'").select("_series", "rule_id", "params")
        known = book.keyed(stale).join(charges, ["_series", "rule_id"], "left")

    def of_rule(name):
        return F.coalesce(F.col("params")[name], F.lit(""))

    context = text_map(rule_id=F.col("rule_id"), stored_amount=of_rule("amount"),
                       observed_amount=F.col("m._gap"), occurrences=F.col("m.n"),
                       keyword=of_rule("keyword"))
    reason = F.concat(F.lit("rule "), F.col("rule_id"), F.lit(
        " still applies but no longer explains the amount taken: confirm and replace it"))
    return exception(known.withColumn("line_no", -F.col("m.earliest")), "stale_rule",
                     F.concat(F.lit("stale::"), F.col("rule_id")), context, reason, 50)


def open_items(open_batches: DataFrame, open_credits: DataFrame) -> DataFrame:
    batches = exception(
        open_batches.withColumn("line_no", F.col("batch_seq")), "unmatched_batch",
        F.col("batch_id"),
        text_map(expected_net=F.col("expected"), settled_on=F.col("settled_on"),
                 utr=F.col("utr")),
        "no reference join, no single exact amount, no bounded subset", 60)
    credits = exception(
        open_credits, "unclaimed_credit", F.col("bank_txn_id"),
        text_map(amount=F.col("credit_amount"), value_date=F.col("value_date"),
                 narration=F.col("narration")),
        "bank credit not claimed by any settlement batch", 61)
    return batches.unionByName(credits)


def suspicious_narrations(bank: DataFrame) -> DataFrame:
    """Credits whose text reads like instructions to a program. Always reported first."""
    rows = bank.withColumn("_hits", injection_names(F.coalesce("narration", F.lit("")))).filter(
        F.size("_hits") > 0)
    names = F.array_join("_hits", ",")
    return exception(rows, "suspicious_narration", F.col("bank_txn_id"),
                     text_map(patterns=names, narration=F.substring("narration", 1, 200)),
                     F.concat(F.lit("narration contains instruction-like text: "), names), 10)


def rule_opinions(exceptions: DataFrame, candidates: DataFrame, book: RuleBook) -> DataFrame:
    """The first rule with an opinion on each open exception.

    None of the four rule kinds names a defect class, so an opinion never turns an
    exception into a finding; the table only shows which rule looked at it.
    """
    order = W.partitionBy("close_id", "settled_on").orderBy("value_date", "line_no")
    first = (
        candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1)
        .select("close_id", "settled_on", F.col("narration").alias("_first_narration"))
    )
    dated = exceptions.withColumn("settled_on", F.when(
        F.col("kind") == "unmatched_batch", F.col("context")["settled_on"].cast("date")))
    rows = dated.join(first, ["close_id", "settled_on"], "left")
    context = text_map(narration=F.coalesce(F.col("context")["narration"], F.col("_first_narration")),
                       bank=F.col("context")["bank"], method=F.col("context")["method"])
    if book.empty:
        return rows.limit(0).select("close_id", "kind", "subject_id", F.lit("").alias("rule_id"),
                                    F.lit("").alias("rule_kind"))
    case = F.struct("close_id", F.col("kind").alias("exception"), "subject_id")
    cases = book.keyed(rows).select("_series", case.alias("_case"), context.alias("context"))
    first_rule = F.min(F.struct("rule_seq", "rule_id", "kind"))
    return book.applicable(cases).groupBy("_case").agg(first_rule.alias("_o")).select(
        "_case.close_id", F.col("_case.exception").alias("kind"), "_case.subject_id",
        "_o.rule_id", F.col("_o.kind").alias("rule_kind"))
