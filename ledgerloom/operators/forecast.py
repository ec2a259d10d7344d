"""When settled money lands: lags as measured, arrivals, and a test of the band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K, schemas as S
from .scale import running, skew_join

LOW, MID, HIGH = K.LAG_BAND


def observed_lags(matches: DataFrame) -> DataFrame:
    """Days from settlement to the last credit of every matched batch."""
    lag = F.datediff("last_value_date", "settled_on")
    return matches.select("close_id", "batch_id", "batch_seq", "settled_on",
                          lag.alias("lag")).filter("lag >= 0")


def lag_model(lags: DataFrame) -> DataFrame:
    """Nearest-rank percentiles per close, read off a histogram of whole days."""
    return day_percentiles(lags.groupBy("close_id", "lag").agg(F.count(F.lit(1)).alias("times")))


def day_percentiles(histogram: DataFrame) -> DataFrame:
    """Percentiles of a close from how often each lag occurred; the half rounds to even."""
    up_to = W.partitionBy("close_id").orderBy("lag").rowsBetween(W.unboundedPreceding, 0)
    ranked = histogram.withColumn("upto", F.sum("times").over(up_to)).withColumn(
        "total", F.sum("times").over(W.partitionBy("close_id")))

    def at(percent):
        rank = F.rint(F.lit(percent / 100) * F.col("total") + F.lit(0.5))
        rank = F.greatest(F.lit(1.0), F.least(F.col("total").cast("double"), rank))
        return F.min(F.when(F.col("upto") >= rank, F.col("lag")))

    return ranked.groupBy("close_id").agg(
        F.max("total").alias("n_lags"), at(LOW).alias("low"), at(MID).alias("median"),
        at(HIGH).alias("high"))


def anchors(batches: DataFrame, open_batches: DataFrame, matches: DataFrame,
            as_of=None) -> DataFrame:
    """Every close with the day its forecast starts from and the lags it has seen."""
    due = open_batches.filter(F.col("batch_id") != K.UNSETTLED_BATCH)
    anchor = F.coalesce(F.max("open_day"), F.max("any_day"))
    days = batches.select("close_id", F.col("max_settled_on").alias("any_day"),
                          F.lit(None).cast("date").alias("open_day")).unionByName(
        due.select("close_id", F.lit(None).cast("date").alias("any_day"),
                   F.col("first_settled_on").alias("open_day")))
    start = days.groupBy("close_id").agg(anchor.alias("as_of"))
    if as_of is not None:
        start = start.withColumn("as_of", F.lit(as_of).cast("date"))
    model = start.join(lag_model(observed_lags(matches)), "close_id", "left")
    return model.fillna(0, ["n_lags", "low", "median", "high"])


def arrivals(open_batches: DataFrame, model: DataFrame) -> DataFrame:
    """Settled batches not credited yet, each with its expected dates; ``model`` are anchors."""
    due = open_batches.filter(F.col("batch_id") != K.UNSETTLED_BATCH)
    start = F.col("first_settled_on")
    rows = due.filter("expected > 0").select(
        "close_id", "batch_id", F.col("expected").alias("amount"), "first_settled_on")
    dated = skew_join(rows, model, ["close_id"], spread_by="batch_id").select(
        "close_id", "batch_id", "amount", start.alias("settled_on"), "as_of", "n_lags",
        F.date_add(start, F.col("low")).alias("earliest"),
        F.date_add(start, F.col("median")).alias("expected_on"),
        F.date_add(start, F.col("high")).alias("latest"))
    overdue = F.col("latest") < F.col("as_of")
    return dated.withColumn("overdue", overdue).withColumn(
        "days_overdue", F.when(overdue, F.datediff("as_of", "latest")))


def in_order(rows: DataFrame) -> DataFrame:
    """``place`` in its list: arrivals by day and amount, overdue batches oldest first."""
    keyed = rows.withColumn("_day", F.when(F.col("overdue"), F.col("latest"))
                            .otherwise(F.col("expected_on"))).withColumn(
        "_amount", F.when(F.col("overdue"), F.lit(0)).otherwise(-F.col("amount")))
    return running(keyed, ["close_id", "overdue"],
                   [F.col("_day"), F.col("_amount"), F.col("batch_id")], "forecast-order",
                   place=("count", "batch_id")).drop("_day", "_amount")


def forecast_totals(rows: DataFrame, model: DataFrame, horizon: int = 14) -> DataFrame:
    """One row per close of ``model``, zeros where nothing is open."""
    zero = F.lit(0).cast(S.TOTAL)
    in_time = ~F.col("overdue") & (F.col("latest") <= F.date_add("as_of", horizon))

    def total(condition):
        return F.sum(F.when(condition, F.col("amount"))).cast(S.TOTAL)

    sums = rows.groupBy("close_id").agg(
        F.count(F.when(~F.col("overdue"), 1)).alias("n_arrivals"),
        total(~F.col("overdue")).alias("total_expected"),
        F.count(F.when(F.col("overdue"), 1)).alias("n_overdue"),
        total(F.col("overdue")).alias("overdue_total"),
        total(in_time).alias("worst_case"))
    money = ("total_expected", "overdue_total", "worst_case")
    return model.join(sums, "close_id", "left").select(
        "close_id", "as_of", "n_lags", F.coalesce("n_arrivals", F.lit(0)).alias("n_arrivals"),
        F.coalesce("n_overdue", F.lit(0)).alias("n_overdue"),
        *[F.coalesce(c, zero).alias(c) for c in money],
        (F.col("n_lags") >= K.MIN_LAG_OBSERVATIONS).alias("usable"))


def forecast_curve(rows: DataFrame, model: DataFrame, horizon: int = 14) -> DataFrame:
    """Expected inflow per day from the anchor on, for every close; idle days are zero."""
    by_day = rows.filter(~F.col("overdue")).groupBy("close_id", "expected_on").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("batches"))
    calendar = model.select("close_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(horizon)), lambda d: F.date_add("as_of", d))).alias(
        "expected_on"))
    return calendar.join(by_day, ["close_id", "expected_on"], "left").select(
        "close_id", "expected_on",
        F.coalesce("amount", F.lit(0).cast(S.TOTAL)).cast(S.TOTAL).alias("amount"),
        F.coalesce("batches", F.lit(0)).alias("batches"))


def unscheduled(findings: DataFrame) -> DataFrame:
    """Real money without any date: held against disputes, or never settled."""
    return findings.filter(F.col("defect_class").isin("chargeback_hold", "unsettled_revenue")) \
        .groupBy("close_id", "defect_class").agg(
            F.count(F.lit(1)).alias("items"),
            F.sum("money_impact").cast(S.TOTAL).alias("amount"))


def backtest(matches: DataFrame, fit_share: float = 0.6) -> DataFrame:
    """Fit the band on the earlier batches of a close and test it on the later ones."""
    lags = observed_lags(matches)
    placed = running(lags, ["close_id"], [F.col("settled_on"), F.col("batch_seq"),
                                          F.col("batch_id")], "lag-order",
                     place=("count", "lag"))
    sizes = lags.groupBy("close_id").agg(F.count(F.lit(1)).alias("n"))
    split = F.floor(F.lit(fit_share) * F.col("n")).cast("long")
    sides = (
        skew_join(placed, sizes, ["close_id"], spread_by="batch_id").withColumn("n_fit", split)
        .withColumn("fit", F.col("place") <= F.col("n_fit"))
        .groupBy("close_id", "n", "n_fit", "fit", "lag").agg(F.count(F.lit(1)).alias("times"))
    )
    # A histogram of days is all the percentiles need; it is as short as the lag range.
    model = day_percentiles(sides.filter("fit").select("close_id", "lag", "times"))
    tested = (
        sides.filter("not fit").join(model, "close_id")
        .filter(F.col("n_fit") >= K.MIN_LAG_OBSERVATIONS)
        .withColumn("miss", F.abs(F.col("lag") - F.col("median")))
        .withColumn("inside", F.col("lag").between(F.col("low"), F.col("high")))
    )
    misses = tested.groupBy("close_id", "miss").agg(
        F.sum("times").alias("times"),
        F.sum(F.when(F.col("inside"), F.col("times")).otherwise(0)).alias("inside"))
    up_to = W.partitionBy("close_id").orderBy("miss").rowsBetween(W.unboundedPreceding, 0)
    placed_miss = misses.withColumn("upto", F.sum("times").over(up_to)).withColumn(
        "tested", F.sum("times").over(W.partitionBy("close_id")))

    def at(rank):
        return F.min(F.when(F.col("upto") >= rank, F.col("miss")))

    low = F.floor((F.col("tested") + 1) / 2)
    high = F.floor((F.col("tested") + 2) / 2)
    result = placed_miss.groupBy("close_id").agg(
        F.max("tested").alias("n_tested"), F.sum("inside").alias("inside_band"),
        ((at(low) + at(high)) / 2).alias("median_error_days"))
    coverage = F.col("inside_band") / F.col("n_tested")
    return sizes.select("close_id", split.alias("n_fit")).join(result, "close_id", "left").select(
        "close_id", "n_fit", F.coalesce("n_tested", F.lit(0)).alias("n_tested"),
        F.coalesce("inside_band", F.lit(0)).alias("inside_band"), "median_error_days",
        F.round(coverage, 6).alias("coverage"), (coverage >= K.MIN_COVERAGE).alias("honest"))
