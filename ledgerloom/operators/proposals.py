"""Outside suggestions for open items: parsed, re-added from the amounts, bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K, schemas as S
from .rows import text_map
from .scale import running, skew_join

RAW = ("defect_class string, bank_txn_ids array<string>, reasoning string, confidence string, "
       "claimed_adjustment string, proposed_rule struct<kind:string,"
       "params:map<string,string>,confidence:double>")


def parse(answers: DataFrame) -> DataFrame:
    """Typed proposals from answers that may be fenced or chatty. Broken ones are unknown."""
    text = F.trim("text")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    body = F.when(fenced != "", fenced).when(braced != "", braced).otherwise(text)
    rows = answers.withColumn("_body", body).withColumn(
        "_valid", F.try_parse_json("_body").isNotNull()).withColumn(
        "_p", F.from_json("_body", RAW))
    broken = ~F.col("_valid")
    return rows.select(
        "close_id", "subject_id",
        F.when(broken, "unknown").otherwise(F.col("_p.defect_class")).alias("defect_class"),
        F.when(~broken, F.col("_p.bank_txn_ids")).alias("bank_txn_ids"),
        F.when(broken, "unreadable").otherwise(F.col("_p.reasoning"))
        .alias("reasoning"),
        F.when(broken, 0.0).otherwise(F.col("_p.confidence").try_cast("double"))
        .alias("confidence"),
        F.when(~broken, F.col("_p.claimed_adjustment")).alias("claimed_adjustment"),
        F.when(~broken, F.col("_p.proposed_rule")).alias("proposed_rule"))


def verify(proposals: DataFrame, batches: DataFrame, bank: DataFrame) -> DataFrame:
    """Each claim re-derived from the amounts; only sums that close are confirmed."""
    keys = ["close_id", "subject_id"]
    amounts = bank.groupBy("close_id", "bank_txn_id").agg(
        F.max_by("credit_amount", "line_no").alias("credit_amount"))
    # A proposal names a handful of credits; the list is one model answer long.
    named = proposals.select(*keys, F.explode("bank_txn_ids").alias("bank_txn_id")).join(
        amounts, ["close_id", "bank_txn_id"], "left")
    sums = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.count(F.when(F.col("credit_amount").isNull(), 1)).alias("n_unknown"),
        F.coalesce(F.sum("credit_amount"), F.lit(0).cast(S.TOTAL)).cast(S.TOTAL)
        .alias("credited"))
    nets = batches.select("close_id", F.col("batch_id").alias("subject_id"), "expected")
    rows = proposals.join(sums, keys, "left").join(nets, keys, "left")
    zero, tolerance = F.lit(0).cast(S.TOTAL), F.lit(K.TOLERANCE)
    expected = F.coalesce("expected", zero)
    rows = rows.withColumn("expected", expected).withColumn(
        "delta", (expected - F.coalesce("credited", zero)).cast(S.TOTAL)).withColumn(
        "_claim", F.lower("defect_class")).withColumn(
        "_adj", F.col("claimed_adjustment").try_cast("decimal(28,2)"))
    delta, adj = F.col("delta"), F.col("_adj")
    given = F.col("claimed_adjustment").isNotNull()
    claim = F.col("_claim")
    closes = F.abs(delta) <= tolerance
    metadata = claim.isin("narration_drift", "missing_utr", "timing_shift")
    ok, no = F.lit(True), F.lit(False)

    def chain(*cases):
        out = F.when(cases[0][0], cases[0][1])
        for condition, value in cases[1:-1]:
            out = out.when(condition, value)
        return out.otherwise(cases[-1][1])

    cases = (
        (F.coalesce("n_ids", F.lit(0)) == 0, no, "no_credits_named"),
        (F.col("n_unknown") > 0, no, "unknown_credits"),
        (given & adj.isNull(), no, "adjustment_not_a_number"),
        (given & (adj <= 0), no, "adjustment_not_positive"),
        (given & (adj > F.col("credited")), no, "adjustment_above_credit"),
        (given & (F.abs(delta - adj) <= tolerance), ok,
         "closes_with_adjustment"),
        (given, no, "adjustment_leaves_gap"),
        ((claim == "split_settlement") & closes, ok, "split_closes"),
        (claim == "split_settlement", no, "split_open"),
        ((claim == "unrecorded_adjustment") & (delta <= tolerance), no, "no_shortfall"),
        ((claim == "unrecorded_adjustment") & (expected > 0)
         & (delta > expected * F.lit(K.MAX_ADJUSTMENT_SHARE)), no,
         "charge_too_large"),
        (claim == "unrecorded_adjustment", ok, "shortfall_confirmed"),
        (metadata & closes, ok, "amounts_agree"),
        (metadata, no, "amounts_differ"),
        (None, no, "class_unknown"),
    )
    return rows.withColumn("ok", chain(*[(c, v) for c, v, _ in cases])).withColumn(
        "verdict", chain(*[(c, F.lit(t)) for c, _, t in cases])).drop("_claim", "_adj", "n_ids",
                                                                     "n_unknown")


def outcomes(queue: DataFrame, verified: DataFrame, records: DataFrame,
             per_100: float = K.PROPOSALS_PER_100) -> DataFrame:
    """What happens to each queued exception: deferred, declined, refused, accepted, abandoned.

    ``queue`` holds the open exceptions and ``records`` the row count per close. The
    budget takes the head of each queue; twelve refusals in a row stop the rest at the
    next chunk of four. All positions are running counts in queue order.
    """
    keys = ["close_id", "subject_id"]
    order = [F.col(c) for c in ("check_rank", "line_no", "kind", "subject_id")]
    budget = F.greatest(F.lit(1), F.floor(F.lit(per_100) * F.col("records") / 100)).cast("long")
    answered = verified.select(*keys, "ok", "verdict", "defect_class", F.coalesce(
        "confidence", F.lit(0.0)).alias("confidence"), "delta", "credited", "reasoning",
        "proposed_rule")
    known = F.lower("defect_class").isin(*K.DEFECT_CLASSES)
    step = (
        F.when(F.col("confidence").isNull() | (F.col("confidence") < K.CONFIDENCE_FLOOR),
               "declined").when(~F.col("ok"), "refused").when(~known, "unparseable")
        .otherwise("accepted"))
    rows = (
        queue.select("close_id", "kind", "subject_id", "check_rank", "line_no")
        .join(answered, keys, "left").withColumn("step", step)
        .withColumn("_bad", F.col("step").isin("refused", "unparseable").cast("long"))
    )
    placed = running(rows, ["close_id"], order, "queue", place=("count", "kind"),
                     refused=("sum", "_bad"))
    placed = skew_join(placed, records.select("close_id", budget.alias("budget")), ["close_id"])
    # An accept resets the streak: it starts again from the refusals counted so far.
    placed = placed.withColumn("_reset", F.when(F.col("step") == "accepted", F.col("refused")))
    tracked = running(placed, ["close_id"], order, "streak", _base=("max", "_reset"))
    streak = F.col("refused") - F.coalesce("_base", F.lit(0))
    tracked = tracked.withColumn("streak", streak)
    inside = F.col("place") <= F.col("budget")
    trigger = inside & (F.col("step") == "refused") & (
        F.col("streak") >= K.MAX_REFUSAL_STREAK)
    stop = tracked.groupBy("close_id").agg(
        F.min(F.when(trigger, F.col("place"))).alias("stop_at"))
    chunk_end = F.ceil(F.col("stop_at") / K.PROPOSAL_CHUNK) * K.PROPOSAL_CHUNK
    final = (
        F.when(~inside, "deferred").when(F.col("place") > chunk_end, "abandoned")
        .otherwise(F.col("step")))
    return skew_join(tracked, stop, ["close_id"]).withColumn("outcome", final).drop(
        "step", "_bad", "_base", "_reset", "refused")


def stops(results: DataFrame) -> DataFrame:
    """The bounds that were hit, as input for sign-off."""
    per_close = results.groupBy("close_id").agg(
        F.count(F.when(F.col("outcome") == "deferred", 1)).alias("deferred"),
        F.max("budget").alias("budget"), F.max("stop_at").alias("stop_at"))
    held = per_close.filter("deferred > 0").select(
        "close_id", F.lit("model_budget").alias("rule"),
        F.format_string("%d exception(s) held back at %d call(s)", "deferred", "budget")
        .alias("detail"))
    broken = per_close.filter(F.col("stop_at").isNotNull()).select(
        "close_id", F.lit("model_refusal_streak").alias("rule"),
        F.lit(f"{K.MAX_REFUSAL_STREAK} consecutive proposals refused").alias("detail"))
    return held.unionByName(broken)


def proposal_findings(results: DataFrame) -> DataFrame:
    """Accepted proposals as findings of the last layer."""
    rows = results.filter("outcome = 'accepted'")
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    return rows.select(
        "close_id", F.lower("defect_class").alias("defect_class"), "subject_id",
        F.lit(K.L3).alias("layer"), sure.alias("confidence"),
        F.abs("delta").cast(S.TOTAL).alias("money_impact"),
        F.lit(None).cast("string").alias("rule_id"),
        text_map(reasoning=F.substring("reasoning", 1, 200), verified=F.col("verdict"),
                 credited=F.col("credited")).alias("evidence"),
        F.lit(90).alias("check_rank"), F.col("place").alias("line_no"))
