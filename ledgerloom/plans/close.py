"""One close over many merchants and periods: three tables in, three tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.rulebook import RuleBook
from ..operators import checks, forensics, matching, nets, post_match
from ..operators.rows import union_all
from ..operators.scale import materialise, materialise_all, start


@dataclass
class Close:
    """The result tables of a close and the inputs later steps look up."""

    settlement: DataFrame
    bank: DataFrame
    ledger: DataFrame
    batches: DataFrame
    credits: DataFrame
    matches: DataFrame
    match_credits: DataFrame
    findings: DataFrame
    exceptions: DataFrame
    source_counts: DataFrame
    open_batches: DataFrame
    open_credits: DataFrame
    book: RuleBook

    def candidates(self) -> DataFrame:
        """Credits that might pay each unmatched batch, keyed by settlement date."""
        return matching.candidates(self.open_batches, self.open_credits)


def close(settlement: DataFrame, bank: DataFrame, ledger: DataFrame,
          book: RuleBook | None = None, contested: str = "park", made: dict | None = None) -> Close:
    """Run every deterministic check. Duplicates are known before ledger coverage.

    Jobs that do not need each other run side by side: the row checks go along with the
    matcher, which waits for batches and credits only; what it found is written first, then
    findings and exceptions together. ``made`` is a dict to keep between closes of the same
    three tables: checks no rule has a say in are then made by the first of them.
    """
    book = RuleBook() if book is None else book
    made = {} if made is None else made

    def captures():
        found = materialise(checks.duplicate_captures(settlement), "duplicates")
        gaps = checks.one_sided(settlement, ledger)
        return union_all([
            found, checks.ledger_coverage(settlement, gaps, found),
            checks.unsettled_revenue(settlement, ledger, gaps),
            checks.chargeback_holds(settlement),
        ])

    def charges():
        fees, questions = checks.fee_checks(settlement, book)
        rate_cards["df"] = questions
        return fees

    rate_cards: dict = {}
    asking = {"credits": lambda: materialise(nets.prepare_credits(bank, book), "credits"),
              "charges": lambda: materialise(charges(), "charges")}
    own = {}
    for name, work in {
        # What the matcher waits for comes first.
        "batches": lambda: materialise(nets.batch_nets(settlement), "batches"),
        "credits": asking["credits"],
        "captures": lambda: materialise(captures(), "captures"),
        "charges": asking["charges"],
        "refunds": lambda: materialise(checks.cross_cycle_refunds(settlement), "refunds"),
        "row-exceptions": lambda: materialise(post_match.suspicious_narrations(bank).unionByName(
            forensics.fabricated_amounts(settlement)), "row-exceptions"),
        "source-counts": lambda: materialise(
            checks.source_counts(settlement, bank, ledger), "source-counts"),
    }.items():
        if name in asking:
            own[name] = start(work)
        elif name not in made or made[name].done() and made[name].exception():
            made[name] = start(work)

    def ready(name):
        return (own if name in own else made)[name].result()

    batches, credits = ready("batches"), ready("credits")
    m = matching.match_batches(batches, credits, book, contested)
    # Which credits paid a batch is read off what the stages wrote.
    links = m.pop("match_credits")

    # Findings and exceptions read what the matcher wrote; worked out again, its stages would
    # be joined and shuffled once more for each. What the row checks wrote is not written again.
    out = materialise_all(m)
    out |= materialise_all({
        "findings": lambda: post_match.match_findings(batches, out["matches"]),
        "exceptions": lambda: post_match.stale_rules(out["matches"], book).unionByName(
            post_match.open_items(out["open_batches"], out["open_credits"])),
    })
    findings = union_all([ready("charges"), ready("captures"), ready("refunds"), out["findings"]])
    exceptions = union_all([
        ready("row-exceptions"), rate_cards["df"], checks.missing_sources(ready("source-counts")),
        out["exceptions"]])
    return Close(
        settlement, bank, ledger, batches, credits, out["matches"], links, findings, exceptions,
        ready("source-counts"), out["open_batches"], out["open_credits"], book)


def match_rate(matches: DataFrame) -> DataFrame:
    """Matched and cleanly matched batches per close."""
    clean = F.abs(F.col("credited") - F.col("expected_net")) <= F.lit(K.TOLERANCE)
    return matches.groupBy("close_id").agg(
        F.count(F.lit(1)).alias("matched"), F.count(F.when(clean, 1)).alias("clean"))
