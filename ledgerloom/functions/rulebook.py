"""Learned rules as a keyed table, looked up by joins.

A store of rules belongs to one merchant (a series of closes). All stores together are one
table keyed by ``series_id``; a close meets only the rules of its own series. Of the rules
that apply to a case, the one with the smallest ``rule_seq`` decides, whatever its kind.

Keywords and markers are substrings of a narration, not whole words, so the inverted index
is on three-character pieces: a rule is filed under the one piece of its text that fewest
rules of its store share, a narration is looked up by its distinct pieces, and a full check
follows. Rules on text shorter than a piece, an empty keyword among them, join by their
series alone; there can be few different ones. Only distinct narrations of a series are
looked up, so a label that a third of all credits carries is looked up once.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K, schemas as S
from ..operators.scale import materialise
from .money import RATE
from .text import reference_after

PIECE = 3
# Stores of up to this many rules in all are copied to every task; larger ones are shuffled.
FEW_RULES = 10_000
SPACES = " \t\n\r\x0b\x0c"
ALIAS, CHARGE, TIMING, FEE = "narration_alias", "adjustment_pattern", "bank_timing", "fee_variant"


@dataclass(frozen=True)
class Rule:
    rule_seq: int
    rule_id: str
    kind: str
    params: dict = field(default_factory=dict)
    origin_exception: str = ""
    learned_on: str = ""
    confidence: float = 0.9
    series_id: str | None = None

    def amount(self):
        try:
            value = Decimal(str(self.params.get("amount")))
        except (InvalidOperation, ValueError):
            return None
        return value if value.is_finite() else None


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules typed in by a person, as a table of live rules."""
    return spark.createDataFrame([
        (r.rule_seq, r.rule_id, r.kind, {k: str(v) for k, v in r.params.items()},
         r.origin_exception, r.learned_on, float(r.confidence), "live", None, r.series_id)
        for r in rules], S.RULES)


def _pieces(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - PIECE + 1, F.lit(1)))
    return F.when(F.length(text) >= PIECE, F.array_distinct(
        F.transform(starts, lambda at: F.substring(text, at, F.lit(PIECE))))).otherwise(
        F.array().cast("array<string>"))


class RuleBook:
    """The live rules of all series.

    ``series`` gives the series of a close from its ``close_id``; without it all rules are
    one store that speaks to every close.
    """

    def __init__(self, rules=(), series: Callable[[Column], Column] | None = None,
                 table: DataFrame | None = None):
        self._typed, self._table, self._series = tuple(rules), table, series
        self._written, self._lock = {}, threading.Lock()

    @classmethod
    def from_df(cls, rules: DataFrame, series: Callable[[Column], Column] | None = None) -> "RuleBook":
        return cls(series=series, table=rules)

    @property
    def empty(self) -> bool:
        """Known to hold no rule; a table is not looked into."""
        return self._table is None and not self._typed

    def series(self, close_id: Column) -> Column:
        return self._series(close_id) if self._series else F.lit("")

    def keyed(self, df: DataFrame) -> DataFrame:
        """``df`` with the series of its closes as ``_series``."""
        return df.withColumn("_series", self.series(F.col("close_id")))

    def _held(self) -> tuple[DataFrame, bool]:
        """All rules, a stored table written once, and whether they are few."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if self._table is None:
            return rule_table(spark, self._typed), len(self._typed) <= FEW_RULES
        with self._lock:
            app = spark.sparkContext.applicationId
            if app not in self._written:
                table = materialise(self._table, "rules")
                self._written[app] = table, table.limit(FEW_RULES + 1).count() <= FEW_RULES
            return self._written[app]

    def _beside(self, rules: DataFrame) -> DataFrame:
        """Rules as the right side of a join with cases.

        Spark does not know how large either side is: a list of rules has no size, and cases
        repeat so much that they look small on disk. So it is said here, and cases are never
        what is copied to every task.
        """
        return F.broadcast(rules) if self._held()[1] else rules.hint("merge")

    def live(self) -> DataFrame:
        """``_series``, number, id, kind and parameters of the live rules."""
        table = self._held()[0]
        key = F.coalesce("series_id", F.lit("")) if self._series else F.lit("")
        return table.filter("status = 'live'").select(
            key.alias("_series"), "rule_seq", "rule_id", "kind", "params")

    def _texts(self) -> DataFrame:
        """Alias and charge rules with the text they look for."""
        p = F.col("params")
        label = F.trim(F.upper(F.coalesce(p["marker"], F.lit(""))), F.lit(SPACES))
        keyword = F.upper(F.coalesce(p["keyword"], F.lit("")))
        rules = self.live().withColumn("text", F.when(F.col("kind") == ALIAS, label).when(
            F.col("kind") == CHARGE, keyword))
        return rules.filter((F.col("kind") == CHARGE) | ((F.col("kind") == ALIAS) & (F.col("text") != "")))

    def narration_hits(self, texts: DataFrame, unnamed: bool = True) -> DataFrame:
        """Every rule that applies to each distinct ``_series`` and ``narration``.

        With ``unnamed``, rules on a bank or method that name none count too: a bare
        narration has no bank and no method either.
        """
        rules = self._texts()
        filed = rules.filter(F.length("text") >= PIECE).withColumn("piece", F.explode(_pieces(F.col("text"))))
        shared = filed.groupBy("_series", "piece").agg(F.count(F.lit(1)).alias("n"))
        rarest = filed.join(shared, ["_series", "piece"]).groupBy("_series", "rule_seq", "rule_id").agg(
            F.min(F.struct("n", "piece"))["piece"].alias("piece"), F.first("kind").alias("kind"),
            F.first("params").alias("params"), F.first("text").alias("text"))
        looked_up = texts.withColumn("piece", F.explode(_pieces(F.upper("narration"))))
        columns = ["_series", "narration", "rule_seq", "rule_id", "kind", "params", "text"]
        found = looked_up.join(self._beside(rarest), ["_series", "piece"]).select(*columns).unionByName(
            texts.join(self._beside(rules.filter(F.length("text") < PIECE)), "_series").select(*columns))
        reference = reference_after(F.col("narration"), F.col("text"), F.col("params")["prefix"])
        found = found.withColumn("utr", F.when(F.col("kind") == ALIAS, reference)).filter(
            F.when(F.col("kind") == ALIAS, F.col("utr").isNotNull())
            .otherwise(F.contains(F.upper("narration"), F.col("text"))))
        columns = [*columns[:-1], "utr"]
        found = found.select(*columns)
        if unnamed:
            bare = self.live().filter(
                ((F.col("kind") == TIMING) & F.col("params")["bank"].isNull())
                | ((F.col("kind") == FEE) & F.col("params")["method"].isNull()))
            found = found.unionByName(texts.join(self._beside(bare), "_series").withColumn(
                "utr", F.lit(None).cast("string")).select(*columns))
        return found.withColumn("amount", F.when(
            F.col("kind") == CHARGE, F.trim(F.col("params")["amount"], F.lit(SPACES)).try_cast(S.MONEY)))

    def first_hits(self, texts: DataFrame) -> DataFrame:
        """The rule that decides for each distinct ``_series`` and ``narration``, as ``_hit``."""
        outcome = F.struct("rule_seq", "rule_id", "kind", "amount", "utr")
        return self.narration_hits(texts).groupBy("_series", "narration").agg(F.min(outcome).alias("_hit"))

    def applicable(self, cases: DataFrame) -> DataFrame:
        """Every rule of its series that applies to each case.

        ``cases`` has ``_case``, what to call a case, next to ``_series`` and a ``context`` map.
        """
        context = F.col("context")
        cases = cases.withColumns({"narration": F.coalesce(context["narration"], F.lit("")),
                                   "_bank": context["bank"], "_method": context["method"]})
        texts = cases.select("_series", "narration").distinct()
        columns = ["_case", "rule_seq", "rule_id", "kind", "params", "utr"]
        found = cases.select("_case", "_series", "narration").join(
            self.narration_hits(texts, unnamed=False), ["_series", "narration"]).select(*columns)
        for kind, name in ((TIMING, "bank"), (FEE, "method")):
            rules = self.live().filter(F.col("kind") == kind).withColumnRenamed("_series", "_of").withColumn(
                "_value", F.col("params")[name])
            found = found.unionByName(cases.join(self._beside(rules), (F.col("_series") == F.col("_of")) & F.col(
                f"_{name}").eqNullSafe(F.col("_value"))).withColumn(
                "utr", F.lit(None).cast("string")).select(*columns))
        return found

    def rates(self) -> DataFrame:
        """Contracted rate by series and method; a malformed rate is the base rate."""
        first = F.min(F.struct("rule_seq", F.col("params")["rate"].alias("rate")))["rate"]
        given = F.trim(first, F.lit(SPACES)).try_cast("decimal(38,10)").cast(RATE)
        return self.live().filter((F.col("kind") == FEE) & F.col("params")["method"].isNotNull()).groupBy(
            "_series", F.col("params")["method"].alias("method")).agg(
            F.coalesce(given, F.lit(K.CONTRACTED_RATE).cast(RATE)).alias("learned_rate"))

    def with_rate(self, df: DataFrame) -> DataFrame:
        """``rate`` of each row's method and whether a rule gave it (``has_rate``)."""
        base = F.lit(K.CONTRACTED_RATE).cast(RATE)
        if self.empty:
            return df.withColumns({"rate": base, "has_rate": F.lit(False)})
        known = self.keyed(df).join(self._beside(self.rates()), ["_series", "method"], "left")
        return known.withColumns({"rate": F.coalesce("learned_rate", base),
                                  "has_rate": F.col("learned_rate").isNotNull()}).drop(
            "_series", "learned_rate")

    def lags(self) -> DataFrame:
        """The largest extra lag taught for each series, within its bound."""
        text = F.trim(F.coalesce(F.col("params")["offset_days"], F.lit("0")), F.lit(SPACES))
        days = F.when(text.rlike(r"^[+-]?\d{1,30}$"), F.least(
            text.try_cast("decimal(38,0)"), F.lit(K.MAX_EXTRA_LAG_DAYS).cast("decimal(38,0)")))
        return self.live().filter(F.col("kind") == TIMING).groupBy("_series").agg(
            F.greatest(F.max(days).cast("int"), F.lit(0)).alias("_lag"))

    def with_last_day(self, df: DataFrame) -> DataFrame:
        """``last_day``: days after settlement on which money of a close may still arrive."""
        if self.empty:
            return df.withColumn("last_day", F.lit(K.WINDOW_DAYS))
        return self.keyed(df).join(self._beside(self.lags()), "_series", "left").withColumn(
            "last_day", (F.lit(K.WINDOW_DAYS) + F.coalesce("_lag", F.lit(0))).cast("int")).drop(
            "_series", "_lag")

    @property
    def longest_window(self) -> int:
        """No ``last_day`` is larger."""
        return K.WINDOW_DAYS if self.empty else K.WINDOW_DAYS + K.MAX_EXTRA_LAG_DAYS
