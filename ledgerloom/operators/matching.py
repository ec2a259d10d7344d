"""Ties settlement batches to the bank credits that paid them.

Surest evidence first: the reference join for every batch, then on what is left an
exact amount inside the date window, an exact amount net of a learned charge, and a
small subset of credits. A credit is claimed once. From the amount stages on, batches
with the same date and payout are one demand and credits with the same date and
amount one supply, so no step pairs every batch of a day with every credit of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K, schemas as S
from ..functions.rulebook import RuleBook
from .rows import union_all
from .scale import amount_window_join, materialise, materialise_all, skew_join

CREDIT_FIELDS = ("value_date", "line_no", "bank_txn_id", "credit_amount", "adj", "adj_rule",
                 "utr_x", "has_ref", "narration")
DEMAND = ("close_id", "settled_on", "target")
WINDOW = ("close_id", "settled_on")


def _credit():
    return F.struct(*CREDIT_FIELDS)


def reference_credits(batches: DataFrame, credits: DataFrame) -> DataFrame:
    """Credits whose reference a batch carries; the first such batch takes them all."""
    claims = (
        batches.filter(F.col("utr").isNotNull())
        .groupBy("close_id", F.col("utr").alias("utr_x"))
        .agg(F.min_by("batch_id", "batch_seq").alias("batch_id"))
    )
    # Texts stay behind: nothing asks for them once a credit is claimed.
    lean = credits.filter(F.col("utr_x").isNotNull()).drop("narration", "has_ref")
    return skew_join(lean, claims, ["close_id", "utr_x"])


def paid_by_reference(claimed: DataFrame) -> DataFrame:
    """What the claimed credits of each batch come to, with the charges rules expect on them."""
    by_charge = claimed.groupBy("close_id", "batch_id", "adj", "adj_rule").agg(
        F.sum("credit_amount").alias("credited"), F.count(F.lit(1)).alias("n_credits"),
        F.min("value_date").alias("first_value_date"),
        F.max("value_date").alias("last_value_date"), F.min("line_no").alias("first_line"))
    charge = F.struct("first_line", "adj", "adj_rule")
    # One entry per rule that applies, so these lists are as short as the rule store.
    return by_charge.groupBy("close_id", "batch_id").agg(
        F.sum("credited").cast(S.TOTAL).alias("credited"),
        F.sum("n_credits").alias("n_credits"),
        F.min("first_value_date").alias("first_value_date"),
        F.max("last_value_date").alias("last_value_date"),
        F.min(charge).alias("_first"),
        F.array_sort(F.collect_list(F.when(F.col("adj").isNotNull(), charge))).alias("_charges"))


def meet(batches: DataFrame, claimed: DataFrame) -> DataFrame:
    """Every batch next to what was claimed for it; ``n_credits`` is null if nothing was."""
    return skew_join(batches, paid_by_reference(claimed), ["close_id", "batch_id"], "left",
                     spread_by="batch_seq")


def reference_matches(batches: DataFrame, claimed: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """One row per batch paid by reference, net of a charge that explains its gap.

    ``met`` is what ``meet`` gives for the same tables, if it is written already.
    """
    rows = (meet(batches, claimed) if met is None else met).filter("n_credits is not null")
    shortfall = F.col("expected") - F.col("credited")
    explaining = F.filter("_charges", lambda c: F.abs(c["adj"] - shortfall) <= F.lit(K.TOLERANCE))
    known = F.when(shortfall > F.lit(K.TOLERANCE), F.get(explaining, F.lit(0)))
    rows = rows.withColumn("_known", known)
    explained = F.col("_known").isNotNull()
    return rows.select(
        "close_id", "batch_id", "batch_seq", "settled_on",
        F.col("expected").alias("gross_expected"),
        (F.col("expected") - F.coalesce(F.col("_known.adj"), F.lit(0).cast(S.MONEY)))
        .cast(S.TOTAL).alias("expected_net"),
        "credited", "n_credits", "first_value_date", "last_value_date",
        F.when(explained, K.L2).otherwise(K.L0).alias("layer"),
        F.lit(1.0).alias("confidence"),
        F.when(explained, "utr_join+learned_charge").otherwise("utr_join").alias("method"),
        F.col("_known.adj_rule").alias("rule_id"), F.col("_known.adj").alias("adjustment"),
        F.col("_first.adj_rule").alias("first_rule"),
        F.col("_first.adj").alias("first_adjustment"),
        F.lit(None).cast("string").alias("drift_credit"),
        F.lit(None).cast("string").alias("drift_narration"),
    )


def demands(open_batches: DataFrame) -> DataFrame:
    """Open batches that ask for the same sum on the same date, as one row."""
    return open_batches.groupBy(
        "close_id", "settled_on", F.col("expected").alias("target")
    ).agg(F.count(F.lit(1)).alias("n_batches"), F.max("last_day").alias("last_day"),
          F.min_by("batch_id", "batch_seq").alias("batch_id"),
          F.min("batch_seq").alias("batch_seq"))


def wants_exact(demand: DataFrame, credits: DataFrame, last_day: int) -> DataFrame:
    """Demands with exactly one credit of their amount in the window."""
    supply = credits.groupBy("close_id", "value_date", F.col("credit_amount").alias("amount")).agg(
        F.count(F.lit(1)).alias("n"), F.min(_credit()).alias("credit"))
    pairs = amount_window_join(demand, supply, 0, last_day, until="last_day")
    return (
        pairs.groupBy(*DEMAND, "n_batches", "batch_id", "batch_seq")
        .agg(F.sum("n").alias("n"), F.min("credit").alias("credit"))
        .filter("n = 1")
        .select(*DEMAND, "n_batches", "batch_id", "batch_seq",
                F.array("credit").alias("credits"),
                F.lit(None).cast(S.MONEY).alias("adj"), F.lit(None).cast("string").alias("rule"))
    )


def wants_net_of_charge(demand: DataFrame, credits: DataFrame, last_day: int) -> DataFrame:
    """Demands met by the first credit in the window plus its own learned charge."""
    supply = (
        credits.filter(F.col("adj").isNotNull())
        .groupBy("close_id", "value_date", (F.col("credit_amount") + F.col("adj")).alias("amount"))
        .agg(F.min(_credit()).alias("credit"))
    )
    pairs = amount_window_join(demand, supply, 0, last_day, until="last_day")
    return (
        pairs.groupBy(*DEMAND, "n_batches", "batch_id", "batch_seq")
        .agg(F.min("credit").alias("credit"))
        .select(*DEMAND, "n_batches", "batch_id", "batch_seq",
                F.array("credit").alias("credits"),
                F.col("credit.adj").alias("adj"), F.col("credit.adj_rule").alias("rule"))
    )


def small_windows(demand: DataFrame, credits: DataFrame) -> DataFrame:
    """The credits of each settlement window that holds at most twelve, in order.

    Thirteen credits of a day are enough to know a window is too wide; the row
    number limit is applied before the shuffle, so a huge day never travels.
    """
    limit = K.SUBSET_MAX_WINDOW + 1
    order = W.partitionBy("close_id", "value_date").orderBy("line_no")
    days = (
        credits.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
        .groupBy("close_id", "value_date")
        .agg(F.array_sort(F.collect_list(_credit())).alias("day"))
    )
    offsets = F.sequence(F.lit(0), F.col("last_day"))
    wanted = demand.select("close_id", "settled_on", "last_day").distinct().select(
        "close_id", "settled_on",
        F.explode(F.transform(offsets, lambda d: F.date_add("settled_on", d))).alias("value_date"))
    return (
        wanted.join(days, ["close_id", "value_date"])
        .groupBy("close_id", "settled_on")
        .agg(F.array_sort(F.flatten(F.collect_list("day"))).alias("window"))
        .filter(F.size("window").between(2, K.SUBSET_MAX_WINDOW))
    )


def pair_sums(windows: DataFrame) -> DataFrame:
    """The index of a window: the sum of every two of its credits, at their places ``i`` < ``j``."""
    first = windows.select(*WINDOW, "window", F.posexplode("window").alias("i", "a"))
    later = F.slice("window", F.col("i") + 2, F.lit(K.SUBSET_MAX_WINDOW))
    return first.select(*WINDOW, "i", "a", F.posexplode(later).alias("d", "b")).select(
        *WINDOW, "i", (F.col("i") + F.col("d") + 1).alias("j"),
        (F.col("a.credit_amount") + F.col("b.credit_amount")).alias("pair"))


def goals(demand: DataFrame, windows: DataFrame) -> DataFrame:
    """What a subset may sum up to: the target, then the target less each charge a rule expects
    on a credit of the window, in window order (``g``)."""
    charge = F.col("c.adj")
    charges = (
        windows.select(*WINDOW, F.posexplode("window").alias("g", "c"))
        .filter(charge.isNotNull() & (charge != 0))
        .groupBy(*WINDOW, charge.alias("adj")).agg(
            (F.min("g") + 1).alias("g"), F.min_by("c.adj_rule", "g").alias("rule")))
    none = F.lit(None)
    whole = windows.select(*WINDOW, none.cast(S.MONEY).alias("adj"), F.lit(0).alias("g"),
                           none.cast("string").alias("rule"))
    rows = skew_join(demand, whole.unionByName(charges), list(WINDOW), spread_by="batch_seq")
    return rows.withColumn("goal", F.col("target") - F.coalesce("adj", F.lit(0).cast(S.MONEY)))


def wants_subset(demand: DataFrame, windows: DataFrame) -> DataFrame:
    """Demands met by two or three credits, in full or less one learned charge.

    Goals meet the pair sums of their window in an equi join on sum buckets; three credits
    are a pair that meets what one later credit leaves of the goal. So a goal costs one look
    into the index for pairs and one for each credit of its window, whatever the pairs. The
    first goal, then the smaller subset, then the earlier credits decide.
    """
    tolerance, width = F.lit(K.TOLERANCE), F.lit(K.TOLERANCE) * 2

    def bucket(value):
        return F.floor(value / width).cast("long")

    asked = goals(demand, windows)
    # k is -1 for a pair; amount is what one more credit brings.
    alone = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast(S.MONEY).alias("amount")))
    more = windows.select(*WINDOW, F.inline(F.concat(alone, F.transform("window", lambda c, k: F.struct(
        k.alias("k"), c["credit_amount"].alias("amount"))))))
    left = asked.join(more, list(WINDOW)).withColumn("rest", F.col("goal") - F.col("amount"))
    left = left.withColumn("bucket", F.explode(F.sequence(
        bucket(F.col("rest") - tolerance), bucket(F.col("rest") + tolerance))))
    sums = pair_sums(windows).withColumn("bucket", bucket(F.col("pair")))
    hits = left.join(sums, [*WINDOW, "bucket"]).filter(
        (F.abs(F.col("pair") - F.col("rest")) <= tolerance)
        & ((F.col("k") < 0) | (F.col("j") < F.col("k"))))
    pick = F.min(F.struct("g", (F.col("k") >= 0).alias("three"), "i", "j", "k", "adj", "rule"))
    best = hits.groupBy(*DEMAND, "n_batches", "batch_id", "batch_seq").agg(pick.alias("b"))
    found = best.join(windows, list(WINDOW))
    chosen = F.array_compact(F.array(*[F.get("window", F.col(f"b.{p}")) for p in ("i", "j", "k")]))
    return found.select(*DEMAND, "n_batches", "batch_id", "batch_seq", chosen.alias("credits"),
                        F.col("b.adj").alias("adj"), F.col("b.rule").alias("rule"))


def settle(wanted: DataFrame, contested: str, name: str) -> DataFrame:
    """Decide one stage: a demand is accepted when nobody else wants its credits.

    With ``contested='earliest'`` the batch that comes first in its report takes them.
    Demands for one credit differ in date or amount and must lie within the tolerance
    and the window, so the rivals looked at together are few whatever the volume.
    """
    asks = wanted.select(*DEMAND, "n_batches", "batch_id", "batch_seq", "adj", "rule",
                         F.posexplode("credits").alias("n", "c"))
    rivals = W.partitionBy("close_id", "c.bank_txn_id")
    if contested == "park":
        alone = F.sum("n_batches").over(rivals) == 1
    else:
        alone = F.min("batch_seq").over(rivals) == F.col("batch_seq")
    credits = F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"])
    return materialise(
        asks.withColumn("alone", alone)
        .groupBy(*DEMAND, "n_batches", "batch_id", "batch_seq", "adj", "rule")
        .agg(credits.alias("credits"), F.min("alone").alias("accepted")), name)


def _stage_matches(settled: DataFrame, layer, confidence, method) -> DataFrame:
    """Match rows of an amount stage. Every list here holds at most three credits."""
    zero = F.lit(0).cast(S.MONEY)
    credits = F.col("credits")
    total = F.aggregate(credits, F.lit(0).cast(S.TOTAL),
                        lambda acc, c: (acc + c["credit_amount"]).cast(S.TOTAL))
    bare = F.get(F.filter(credits, lambda c: c["utr_x"].isNull() & ~c["has_ref"]), F.lit(0))
    first = F.get(credits, F.lit(0))
    return settled.filter("accepted").select(
        "close_id", "batch_id", "batch_seq", "settled_on",
        F.col("target").cast(S.TOTAL).alias("gross_expected"),
        (F.col("target") - F.coalesce("adj", zero)).cast(S.TOTAL).alias("expected_net"),
        total.alias("credited"), F.size(credits).cast("long").alias("n_credits"),
        F.array_min(F.transform(credits, lambda c: c["value_date"])).alias("first_value_date"),
        F.array_max(F.transform(credits, lambda c: c["value_date"])).alias("last_value_date"),
        layer.alias("layer"), F.lit(confidence).alias("confidence"), method.alias("method"),
        F.col("rule").alias("rule_id"), F.col("adj").alias("adjustment"),
        first["adj_rule"].alias("first_rule"), first["adj"].alias("first_adjustment"),
        bare["bank_txn_id"].alias("drift_credit"), bare["narration"].alias("drift_narration"),
    )


def _subset(demand, credits, _):
    # Both are small; demands are asked for twice, windows looked into from four sides.
    demand = materialise(demand, "demands")
    return wants_subset(demand, materialise(small_windows(demand, credits), "windows"))


def match_batches(batches: DataFrame, credits: DataFrame, book: RuleBook,
                  contested: str = "park") -> dict[str, DataFrame]:
    """All stages. Returns matches, match_credits, open_batches and open_credits."""
    if contested not in ("park", "earliest"):
        raise ValueError("contested must be 'park' or 'earliest'")
    batches = book.with_last_day(batches)
    last_day = book.longest_window
    # Four tables follow from it, so it is written once.
    claimed = materialise(reference_credits(batches, credits), "claimed")
    taken = [claimed.select(*S.MATCH_CREDITS.names)]
    # Every batch meets what was claimed for it once: it is paid by reference or open.
    first = materialise_all({
        "met": meet(batches, claimed),
        "open-credits": credits.join(taken[0], ["close_id", "bank_txn_id"], "left_anti"),
    })
    met, open_credits = first.values()
    by_reference = reference_matches(batches, claimed, met)
    open_batches = met.filter("n_credits is null").select(*batches.columns)

    subset_rule = F.col("rule").isNotNull()
    stages = [("exact", wants_exact, F.lit(K.L1), 0.95, F.lit("amount_date_window"))]
    if not book.empty:
        stages.append(("charge", wants_net_of_charge, F.lit(K.L2), 0.97,
                       F.concat(F.lit("amount_net_of_learned_charge:"), F.col("rule"))))
    stages.append((
        "subset", _subset,
        F.when(subset_rule, K.L2).otherwise(K.L1), 0.90,
        F.when(subset_rule, F.concat(F.lit("subset_netting+learned_charge:"), F.col("rule")))
        .otherwise("subset_netting")))

    matches, parked = [], None
    rest_batches, rest_credits = open_batches, open_credits
    for name, wants, layer, confidence, method in stages:
        demand = demands(rest_batches)
        if parked is not None:
            demand = demand.join(parked, [*DEMAND], "left_anti")
        settled = settle(wants(demand, rest_credits, last_day), contested, name)
        won = _stage_matches(settled, layer, confidence, method)
        matches.append(won)
        used = settled.select("close_id", "batch_id", "accepted", F.explode("credits").alias("c"))
        taken.append(used.filter("accepted").select(
            "close_id", "batch_id", F.col("c.bank_txn_id").alias("bank_txn_id")))
        if contested == "park":
            held = settled.filter("not accepted").select(*DEMAND)
            parked = held if parked is None else parked.unionByName(held)
        else:
            used = used.filter("accepted")
        rest_batches = rest_batches.join(won, ["close_id", "batch_id"], "left_anti")
        gone = used.select("close_id", F.col("c.bank_txn_id").alias("bank_txn_id"))
        rest_credits = rest_credits.join(gone, ["close_id", "bank_txn_id"], "left_anti")

    matched = union_all(m.select(*S.MATCHES.names) for m in [by_reference, *matches])
    links = union_all(taken)
    later = union_all(taken[1:])
    return {
        "matches": matched,
        "match_credits": links,
        "open_batches": rest_batches,
        "open_credits": open_credits.join(later, ["close_id", "bank_txn_id"], "left_anti"),
    }


def candidates(unmatched: DataFrame, open_credits: DataFrame) -> DataFrame:
    """Unclaimed credits inside the window of an unmatched batch, keyed by its date.

    A window depends on the close and the settlement date only, so the list is kept
    once per date instead of once per batch.
    """
    dates = unmatched.select("close_id", "settled_on", "last_day").distinct()
    offsets = F.sequence(F.lit(0), F.col("last_day"))
    days = dates.select("close_id", "settled_on", F.explode(
        F.transform(offsets, lambda d: F.date_add("settled_on", d))).alias("value_date"))
    return skew_join(open_credits, days, ["close_id", "value_date"]).select(
        "close_id", "settled_on", "value_date", "line_no", "bank_txn_id", "credit_amount",
        "narration")
