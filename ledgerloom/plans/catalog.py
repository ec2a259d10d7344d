"""Every registered query, over the order tables, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K, schemas as S
from ..functions import money, text
from ..functions.rulebook import RuleBook
from ..operators import (aging, cash, checks, digest, forecast, forensics, materiality, nets,
                         post_match, proposals, reports, risk, rules, scoring, signoff)
from ..operators.rows import union_all
from ..operators.scale import materialise, materialise_all, salted_join, shared_folder
from ..settings import bound_copies
from ..sources import csv_files, driver_tables as tables, gateway_recon, rule_files
from . import campaign, oracles
from .close import Close, close, match_rate

_MADE: dict = {}
QUERIES: dict = {}
SQL: dict = {}


def forget() -> None:
    """Drop what earlier queries left behind, so the next one starts from the tables."""
    _MADE.clear()


def keep_sources(spark, sf_dir, views, yearly=False) -> None:
    """Take already written views as the sources of the next queries."""
    _MADE[(spark.sparkContext.applicationId, "sources", sf_dir, yearly)] = views


def _once(spark, key, make):
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


class Views:
    """The three views as a close would find them on disk, each made when first asked for.

    Report and statement are written. The ledger is a row by row reading of a table that lies
    on disk already, so it is written only to spread a small one.
    """

    NAMES = ("settlement", "bank", "ledger")

    def __init__(self, spark, sf_dir, yearly):
        self._given, self._made = (spark, sf_dir, yearly), {}
        # One small input file is one task; a real table comes in many files. Asking a view
        # itself would run its shuffles.
        self._cores = spark.sparkContext.defaultParallelism
        self._few = tables.lines(spark, sf_dir).rdd.getNumPartitions() < self._cores

    def _make(self, *wanted):
        wanted = [name for name in wanted if name not in self._made]
        if not wanted:
            return
        views = dict(zip(self.NAMES, tables.load(*self._given, self._made.get("settlement"))))
        if self._few:
            views = {name: df.repartition(self._cores, "line_no") for name, df in views.items()}
        elif "ledger" in wanted:
            self._made["ledger"] = views["ledger"]
        self._made |= materialise_all({name: views[name] for name in wanted if name not in self._made})

    def __getitem__(self, n):
        self._make(self.NAMES[n])
        return self._made[self.NAMES[n]]

    def __iter__(self):
        # The statement is worked out from the report.
        self._make("settlement", "ledger")
        return iter([self[n] for n in range(len(self))])

    def __len__(self):
        return len(self.NAMES)


def sources(spark, sf_dir, yearly=False):
    """The three views, made once per session; a query makes those it asks for."""
    return _once(spark, ("sources", sf_dir, yearly), lambda: Views(spark, sf_dir, yearly))


def closed(spark, sf_dir, learned=True, yearly=False) -> Close:
    book = (tables.merchant_book(spark, sf_dir) if learned == oracles.STORES
            else tables.rulebook() if learned else RuleBook())
    made = _once(spark, ("rows", sf_dir, yearly), dict)
    return _once(spark, ("close", sf_dir, learned, yearly),
                 lambda: close(*sources(spark, sf_dir, yearly), book, made=made))


def labels(spark, sf_dir) -> DataFrame:
    return _once(spark, ("truth", sf_dir),
                 lambda: materialise(tables.truth(spark, sf_dir), "truth"))


def flat(df: DataFrame) -> DataFrame:
    """Dates as text and doubles at six places, so two engines print them alike."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((c.cast("string") if kind == "date" else F.round(c, 6) if kind == "double"
                    else c).alias(f.name))
    return df.select(*out)


def query(name, sql=None, learned=True, yearly=False, extra=""):
    """Register a job and the statement it must agree with, if one exists."""
    def add(job):
        def run(spark, sf_dir):
            bound_copies(spark)
            return flat(job(spark, sf_dir))

        QUERIES[name] = run
        QUERIES[name].__doc__ = job.__doc__
        if sql is not None:
            SQL[name] = sql[5:].strip() if sql.startswith("--raw") else oracles.over(
                sql, learned, yearly, extra)
        return job
    return add


# --- rows and batches --------------------------------------------------------

@query("net_amount", """SELECT close_id, txn_type, count(*) AS n_rows,
  CAST(sum(net) AS DECIMAL(28,2)) AS net FROM rownet GROUP BY ALL""")
def net_amount(spark, sf_dir):
    return sources(spark, sf_dir)[0].groupBy("close_id", "txn_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(money.net_amount()).cast(S.TOTAL).alias("net"))


@query("expected_fee", """SELECT close_id, method, CAST(sum(f) AS DECIMAL(28,2)) AS expected_fee,
  CAST(sum(round_even(f*CAST(0.18 AS DECIMAL(3,2)),2)) AS DECIMAL(28,2)) AS expected_gst FROM (
  SELECT *, CASE WHEN txn_type='payment' THEN round_even(gross_amount*CAST(0.02 AS DECIMAL(3,2)),2)
    ELSE 0 END f FROM settlement) GROUP BY ALL""")
def expected_fee(spark, sf_dir):
    return sources(spark, sf_dir)[0].groupBy("close_id", "method").agg(
        F.sum(money.expected_fee()).cast(S.TOTAL).alias("expected_fee"),
        F.sum(money.expected_gst()).cast(S.TOTAL).alias("expected_gst"))


@query("batch_nets", """SELECT close_id, batch_id, expected, CAST(settled_on AS VARCHAR) AS
  settled_on, utr, batch_seq FROM batches""")
def batch_nets(spark, sf_dir):
    return nets.batch_nets(sources(spark, sf_dir)[0]).select(
        "close_id", "batch_id", "expected", "settled_on", "utr", "batch_seq")


@query("salted_batch_totals", """SELECT r.close_id, batch_id, count(*) AS n_rows,
  CAST(sum(net) AS DECIMAL(28,2)) AS net, expected FROM rownet r JOIN batches b
  ON r.close_id=b.close_id AND r.settlement_batch_id=b.batch_id GROUP BY ALL""")
def salted_batch_totals(spark, sf_dir):
    """Rows tied to their batch by the join that spreads hot keys before the shuffle."""
    rows = sources(spark, sf_dir)[0].withColumnRenamed("settlement_batch_id", "batch_id")
    known = nets.batch_nets(sources(spark, sf_dir)[0]).select("close_id", "batch_id", "expected")
    tied = salted_join(rows, known, ["close_id", "batch_id"])
    return tied.groupBy("close_id", "batch_id", "expected").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(money.net_amount()).cast(S.TOTAL).alias("net"))


@query("prepared_credits", """SELECT close_id, bank_txn_id, credit_amount, utr_x, adj, adj_rule,
  has_ref FROM credits""")
def prepared_credits(spark, sf_dir):
    return nets.prepare_credits(sources(spark, sf_dir)[1], tables.rulebook()).select(
        "close_id", "bank_txn_id", "credit_amount", "utr_x", "adj", "adj_rule", "has_ref")


@query("bank_names", """SELECT bank, count(*) AS n_credits FROM (SELECT CASE
  WHEN contains(u,'HDFC') THEN 'HDFC' WHEN contains(u,'ICICI') THEN 'ICICI'
  WHEN contains(u,'AXIS') THEN 'AXIS' WHEN contains(u,'SBI') THEN 'SBI'
  WHEN contains(u,'KOTAK') THEN 'KOTAK' WHEN contains(u,'KKBK') THEN 'KOTAK' ELSE 'UNKNOWN' END
  AS bank FROM (SELECT upper(narration) u FROM bank)) GROUP BY ALL""")
def bank_names(spark, sf_dir):
    return sources(spark, sf_dir)[1].groupBy(
        text.bank_name(F.col("narration")).alias("bank")).agg(F.count(F.lit(1)).alias("n_credits"))


@query("close_period", """SELECT close_id, strftime(min(settled_on), '%Y-%m') AS period
  FROM settlement GROUP BY ALL""")
def close_period(spark, sf_dir):
    return csv_files.period(sources(spark, sf_dir)[0])


def _texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat_ws("_", F.lit("c"), F.col("conv_id").cast("string"),
                    F.col("turn").cast("string")).alias("id"), "text")
    credits = sources(spark, sf_dir)[1].select(
        F.concat_ws("_", F.lit("b"), "close_id", "bank_txn_id").alias("id"),
        F.col("narration").alias("text"))
    return docs.unionByName(talks).unionByName(credits)


TEXTS = """texts AS (SELECT 'd'||CAST(doc_id AS VARCHAR) id, text FROM documents
  UNION ALL SELECT 'c_'||CAST(conv_id AS VARCHAR)||'_'||CAST(turn AS VARCHAR), text
  FROM conversations
  UNION ALL SELECT 'b_'||close_id||'_'||bank_txn_id, narration FROM bank)"""


@query("injection_scan", f"""SELECT id, array_to_string(list_filter([{oracles.scan('text')}],
  lambda x: x IS NOT NULL), ',') AS patterns FROM texts
  WHERE len(list_filter([{oracles.scan('text')}], lambda x: x IS NOT NULL)) > 0""", extra=TEXTS)
def injection_scan(spark, sf_dir):
    """Instruction-like phrases in whole texts."""
    return _texts(spark, sf_dir).withColumn(
        "hits", text.injection_names(F.coalesce("text", F.lit("")))).filter(
        F.size("hits") > 0).select("id", F.array_join("hits", ",").alias("patterns"))


@query("neutralised_text", """SELECT id, CASE WHEN length(t)>160
  THEN substr(t,1,160)||'...[truncated]' ELSE t END AS neutral FROM (SELECT id,
  trim(regexp_replace(regexp_replace(replace(replace(
    regexp_replace(coalesce(text,''), '[\\r\\n\\t]+', ' ', 'g'), '```', ''), '\"\"\"', ''),
    '(?i)</?\\s*(system|instructions?|prompt)\\s*>', '', 'g'), '\\s{2,}', ' ', 'g')) t
  FROM texts)""", extra=TEXTS)
def neutralised_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", text.neutralise(F.col("text")).alias("neutral"))


# --- checks ------------------------------------------------------------------

FINDING = ["close_id", "defect_class", "subject_id", "layer", "confidence", "money_impact"]
FINDING_SQL = "close_id, defect_class, subject_id, layer, confidence, money_impact"


def _of(defect_class):
    return f"SELECT {FINDING_SQL} FROM findings WHERE defect_class='{defect_class}'"


@query("fee_overcharges", _of("fee_overcharge"), learned=False)
def fee_overcharges(spark, sf_dir):
    return checks.fee_checks(sources(spark, sf_dir)[0], RuleBook())[0].select(*FINDING)


@query("fee_overcharges_learned", _of("fee_overcharge"))
def fee_overcharges_learned(spark, sf_dir):
    return checks.fee_checks(sources(spark, sf_dir)[0], tables.rulebook())[0].select(*FINDING)


@query("rate_card_questions", """SELECT close_id, method, CAST(bucket3 AS VARCHAR) AS per_mille,
  n AS n_rows FROM cards""", learned=False)
def rate_card_questions(spark, sf_dir):
    q = checks.fee_checks(sources(spark, sf_dir)[0], RuleBook())[1]
    rate = F.col("context")["implied_rate"].cast("decimal(10,3)") * 1000
    return q.select("close_id", F.col("context")["method"].alias("method"),
                    rate.cast("long").cast("string").alias("per_mille"),
                    F.col("context")["rows_at_this_rate"].cast("long").alias("n_rows"))


@query("duplicate_captures", _of("duplicate_capture"))
def duplicate_captures(spark, sf_dir):
    return checks.duplicate_captures(sources(spark, sf_dir)[0]).select(*FINDING)


@query("ledger_coverage", _of("missing_ledger_entry"))
def ledger_coverage(spark, sf_dir):
    st, ld = (sources(spark, sf_dir)[n] for n in (0, 2))
    return checks.ledger_coverage(st, checks.one_sided(st, ld),
                                  checks.duplicate_captures(st)).select(*FINDING)


@query("cross_cycle_refunds", _of("cross_cycle_refund"))
def cross_cycle_refunds(spark, sf_dir):
    return checks.cross_cycle_refunds(sources(spark, sf_dir)[0]).select(*FINDING)


@query("unsettled_revenue", _of("unsettled_revenue"))
def unsettled_revenue(spark, sf_dir):
    st, ld = (sources(spark, sf_dir)[n] for n in (0, 2))
    return checks.unsettled_revenue(st, ld, checks.one_sided(st, ld)).select(*FINDING)


@query("chargeback_holds", _of("chargeback_hold"))
def chargeback_holds(spark, sf_dir):
    return checks.chargeback_holds(sources(spark, sf_dir)[0]).select(*FINDING)


COUNTS = ["close_id", "n_settlement", "n_bank", "n_ledger", "credited"]
COUNTS_SQL = """close_id, CAST(n_settlement AS BIGINT) AS n_settlement, CAST(n_bank AS BIGINT)
  AS n_bank, CAST(n_ledger AS BIGINT) AS n_ledger, CAST(credited AS DECIMAL(28,2)) AS credited"""


@query("source_counts", f"SELECT {COUNTS_SQL} FROM counts", yearly=True)
def source_counts(spark, sf_dir):
    return checks.source_counts(*sources(spark, sf_dir, True)).select(*COUNTS)


@query("missing_sources", """SELECT close_id, 'sources::settlement' AS subject_id FROM counts
  WHERE n_settlement=0 AND (n_bank>0 OR n_ledger>0) UNION ALL
  SELECT close_id, 'sources::bank' FROM counts WHERE n_bank=0 AND n_settlement>0""", yearly=True)
def missing_sources(spark, sf_dir):
    counts = checks.source_counts(*sources(spark, sf_dir, True))
    return checks.missing_sources(counts).select("close_id", "subject_id")


@query("suspicious_narrations", """SELECT close_id, bank_txn_id AS subject_id,
  array_to_string(hits, ',') AS patterns FROM susp WHERE len(hits)>0""")
def suspicious_narrations(spark, sf_dir):
    return post_match.suspicious_narrations(sources(spark, sf_dir)[1]).select(
        "close_id", "subject_id", F.col("context")["patterns"].alias("patterns"))


# --- matching ----------------------------------------------------------------

MATCH = ["close_id", "batch_id", "expected_net", "credited", "n_credits", "first_value_date",
         "last_value_date", "layer", "confidence", "method", "rule_id"]
MATCH_SQL = """SELECT close_id, batch_id, expected_net, credited, n_credits,
  CAST(first_value_date AS VARCHAR) AS first_value_date, CAST(last_value_date AS VARCHAR)
  AS last_value_date, layer, CAST(confidence AS DOUBLE) AS confidence, method, rule_id
  FROM matches"""


def _matches(name, like, learned=True):
    @query(name, f"{MATCH_SQL} WHERE method LIKE '{like}'", learned)
    def job(spark, sf_dir):
        return closed(spark, sf_dir, learned).matches.filter(
            F.col("method").like(like)).select(*MATCH)


_matches("reference_matches", "utr_join%")
_matches("exact_amount_matches", "amount_date_window")
_matches("net_of_charge_matches", "amount_net%")
_matches("subset_matches", "subset%")
_matches("all_matches_untaught", "%", learned=False)


@query("match_credits", "SELECT close_id, batch_id, bank_txn_id FROM match_credits")
def match_credits(spark, sf_dir):
    return closed(spark, sf_dir).match_credits


@query("match_candidates", """SELECT b.close_id, CAST(b.settled_on AS VARCHAR) AS settled_on,
  c.bank_txn_id, c.credit_amount FROM (SELECT DISTINCT close_id, settled_on FROM open_batches) b
  JOIN open_credits c ON b.close_id=c.close_id AND c.value_date-b.settled_on BETWEEN 0 AND 4""",
       learned=False)
def match_candidates(spark, sf_dir):
    """Open credits that might pay the open batches of a date."""
    return closed(spark, sf_dir, False).candidates().select(
        "close_id", "settled_on", "bank_txn_id", "credit_amount")


@query("match_findings", f"SELECT {FINDING_SQL}, rule_id FROM findings WHERE check_rank>=70")
def match_findings(spark, sf_dir):
    """Missing references, splits, late money, unreadable labels and shortfalls."""
    c = closed(spark, sf_dir)
    return post_match.match_findings(c.batches, c.matches).select(*FINDING, "rule_id")


@query("stale_rules", """SELECT close_id, rule_id, CAST(gap AS DECIMAL(28,2)) AS observed,
  n AS occurrences FROM stale""")
def stale_rules(spark, sf_dir):
    c = closed(spark, sf_dir)
    ctx = F.col("context")
    return post_match.stale_rules(c.matches, c.book).select(
        "close_id", ctx["rule_id"].alias("rule_id"),
        ctx["observed_amount"].cast(S.TOTAL).alias("observed"),
        ctx["occurrences"].cast("long").alias("occurrences"))


@query("open_items", """SELECT close_id, kind, subject_id, CAST(amount AS DECIMAL(28,2)) AS amount
  FROM exceptions WHERE check_rank>=60""", learned=False)
def open_items(spark, sf_dir):
    c = closed(spark, sf_dir, False)
    ctx = F.col("context")
    return post_match.open_items(c.open_batches, c.open_credits).select(
        "close_id", "kind", "subject_id",
        F.coalesce(ctx["expected_net"], ctx["amount"]).cast(S.TOTAL).alias("amount"))


@query("close_findings", f"SELECT {FINDING_SQL} FROM findings", learned=False)
def close_findings(spark, sf_dir):
    return closed(spark, sf_dir, False).findings.select(*FINDING)


@query("close_exceptions", "SELECT close_id, kind, subject_id, check_rank FROM exceptions")
def close_exceptions(spark, sf_dir):
    return closed(spark, sf_dir).exceptions.select("close_id", "kind", "subject_id", "check_rank")


CLEAN = "abs(credited-expected_net)<=1"


@query("close_summary", f"""SELECT c.close_id, CAST(n_settlement+n_bank+n_ledger AS BIGINT)
  AS records, matched, clean, CAST(clean AS DOUBLE)/matched AS match_rate,
  coalesce(n_exceptions,0) AS n_exceptions, l0, l1, l2 FROM counts c
  LEFT JOIN (SELECT close_id, count(*) matched, count(*) FILTER ({CLEAN}) clean FROM matches
    GROUP BY 1) m USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) n_exceptions FROM exceptions GROUP BY 1) e USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) FILTER (layer='L0_exact') l0,
    count(*) FILTER (layer='L1_fuzzy') l1, count(*) FILTER (layer='L2_learned_rule') l2
    FROM findings GROUP BY 1) f USING (close_id)""")
def close_summary(spark, sf_dir):
    c = closed(spark, sf_dir)
    sizes = c.exceptions.groupBy("close_id").agg(F.count(F.lit(1)).alias("n_exceptions"))
    layers = scoring.findings_by_layer(c.findings)
    return (
        c.source_counts.join(match_rate(c.matches), "close_id", "left")
        .join(sizes, "close_id", "left").join(layers, "close_id", "left")
        .select("close_id", (F.col("n_settlement") + F.col("n_bank") + F.col("n_ledger"))
                .alias("records"), "matched", "clean",
                F.try_divide("clean", "matched").alias("match_rate"),
                F.coalesce("n_exceptions", F.lit(0)).alias("n_exceptions"),
                F.col(K.L0).alias("l0"), F.col(K.L1).alias("l1"), F.col(K.L2).alias("l2"))
    )


# --- first digits ------------------------------------------------------------

PROFILE = ["n", "mad", "chi_square", "null_mad", "excess", "band", "verdict"]
PROFILE_SQL = ("n, round(mad,6) AS mad, round(chi_square,6) AS chi_square, round(null_mad,6) AS "
               "null_mad, round(excess,6) AS excess, band, verdict")
DIGIT = "CAST(regexp_extract(CAST(CAST(abs({0}) AS DECIMAL(18,2)) AS VARCHAR), '^[0.]*([1-9])', 1) AS INTEGER)"


@query("digits_by_method", f"SELECT close_id, segment, {PROFILE_SQL} FROM prof")
def digits_by_method(spark, sf_dir):
    paid = sources(spark, sf_dir)[0].filter("txn_type = 'payment' and gross_amount > 0")
    p = forensics.digit_profile(paid, ["close_id", "method"], F.col("gross_amount"))
    return p.select("close_id", F.col("method").alias("segment"), *PROFILE)


def _segments(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    m = lambda c: F.col(c).cast(S.MONEY).alias("amount")
    return union_all([
        read("orders").select(F.concat(F.lit("orders "), "o_orderpriority").alias("segment"),
                              m("o_totalprice")),
        read("lineitem").select(F.concat(F.lit("lineitem "), "l_returnflag").alias("segment"),
                                m("l_extendedprice")),
        read("events").select(F.concat(F.lit("events "), "event_type").alias("segment"),
                              m("value"))])


SEGMENTS = f"""seg AS (
  SELECT 'orders '||o_orderpriority segment, {DIGIT.format('o_totalprice')} dg FROM orders
    WHERE CAST(o_totalprice AS DECIMAL(18,2))>0
  UNION ALL SELECT 'lineitem '||l_returnflag, {DIGIT.format('l_extendedprice')} FROM lineitem
    WHERE CAST(l_extendedprice AS DECIMAL(18,2))>0
  UNION ALL SELECT 'events '||event_type, {DIGIT.format('value')} FROM events
    WHERE CAST(value AS DECIMAL(18,2))>0),{oracles.profile('seg', 'segment', 'segp')}"""


@query("digits_by_segment", f"SELECT segment, {PROFILE_SQL} FROM segp", extra=SEGMENTS)
def digits_by_segment(spark, sf_dir):
    p = forensics.digit_profile(_segments(spark, sf_dir), ["segment"], F.col("amount"))
    return p.select("segment", *PROFILE)


@query("worst_digits", """SELECT segment, d AS digit, round(o,6) AS observed, place FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY o-log10(1+1.0/d) DESC, d) place FROM (
    SELECT segment, d, CAST([d1,d2,d3,d4,d5,d6,d7,d8,d9][d] AS DOUBLE)/n o FROM segp,
      range(1,10) r(d))) WHERE place<=3""", extra=SEGMENTS)
def worst_digits(spark, sf_dir):
    p = forensics.digit_profile(_segments(spark, sf_dir), ["segment"], F.col("amount"))
    return forensics.worst_digits(p, ["segment"]).select("segment", "digit", "observed", "place")


@query("fabricated_amounts", """SELECT close_id, segment AS method, n AS n_rows FROM prof
  SEMI JOIN enough USING (close_id) WHERE verdict='nonconformity'""")
def fabricated_amounts(spark, sf_dir):
    f = forensics.fabricated_amounts(sources(spark, sf_dir)[0])
    return f.select("close_id", F.col("context")["method"].alias("method"),
                    F.col("context")["rows"].cast("long").alias("n_rows"))


# --- cash, triage, forecast --------------------------------------------------

def _sum_of(cls):
    return f"coalesce(sum(money_impact) FILTER (defect_class='{cls}'),0)"


@query("cash_position", f"""SELECT close_id, CAST(coalesce(in_bank,0) AS DECIMAL(28,2)) AS in_bank,
  coalesce(mb,0) AS matched_batches, CAST(coalesce(held,0) AS DECIMAL(28,2)) AS held,
  coalesce(n_late,0) AS n_late, CAST(coalesce(owed_in,0) AS DECIMAL(28,2)) AS owed_to_us,
  CAST(coalesce(dup,0) AS DECIMAL(28,2)) AS owed_by_us,
  CAST(coalesce(in_bank,0)+coalesce(owed_in,0)-coalesce(dup,0) AS DECIMAL(28,2)) AS net_position,
  CAST(coalesce(un,0) AS DECIMAL(28,2)) AS unreconciled, coalesce(nun,0) AS unreconciled_count
  FROM (SELECT close_id, sum(credited) in_bank, count(*) mb FROM matches GROUP BY 1)
  FULL JOIN (SELECT close_id, {_sum_of('chargeback_hold')} held,
    count(*) FILTER (defect_class='timing_shift') n_late,
    {_sum_of('unsettled_revenue')}+{_sum_of('fee_overcharge')}+{_sum_of('unrecorded_adjustment')}
      owed_in, {_sum_of('duplicate_capture')} dup FROM findings WHERE defect_class IN (
      'chargeback_hold','timing_shift','unsettled_revenue','fee_overcharge',
      'unrecorded_adjustment','duplicate_capture') GROUP BY 1) USING (close_id)
  FULL JOIN (SELECT close_id, sum(amount) un, count(*) nun FROM exceptions
    WHERE kind='unclaimed_credit' GROUP BY 1) USING (close_id)""")
def cash_position(spark, sf_dir):
    c = closed(spark, sf_dir)
    return cash.cash_position(c.matches, c.findings, c.exceptions).select(
        "close_id", "in_bank", "matched_batches", "held", "n_late", "owed_to_us", "owed_by_us",
        "net_position", "unreconciled", "unreconciled_count")


@query("cash_lines", """SELECT close_id, defect_class AS class, count(*) AS items,
  CAST(sum(CASE WHEN defect_class='timing_shift' THEN 0 ELSE money_impact END) AS DECIMAL(28,2))
  AS amount FROM findings WHERE defect_class IN ('chargeback_hold','timing_shift',
  'unsettled_revenue','fee_overcharge','unrecorded_adjustment','duplicate_capture') GROUP BY ALL""")
def cash_lines(spark, sf_dir):
    back = {line: cls for cls, line, _ in cash.LINES}
    rows = cash.cash_lines(closed(spark, sf_dir).findings)
    name = F.coalesce(*[F.when(F.col("line") == k, F.lit(v)) for k, v in back.items()])
    return rows.select("close_id", name.alias("class"), "items", "amount")


@query("money_by_class", """SELECT close_id, defect_class, items, amount, amount>0 AS has_money,
  round(CASE WHEN amount>0 THEN CAST(amount AS DOUBLE)/CAST(sum(CASE WHEN amount>0 THEN amount END)
    OVER (PARTITION BY close_id) AS DOUBLE) END, 6) AS share FROM (
  SELECT close_id, defect_class, count(*) items, CAST(sum(money_impact) AS DECIMAL(28,2)) amount
  FROM findings GROUP BY 1,2)""")
def money_by_class(spark, sf_dir):
    return cash.money_by_class(closed(spark, sf_dir).findings)


LANES = """lanes AS (SELECT *, CASE WHEN money_impact<=0 THEN 'not_about_money'
  WHEN money_impact>=500 THEN 'chased' WHEN sum(CASE WHEN money_impact>0 AND money_impact<500
    THEN money_impact END) OVER (PARTITION BY close_id, defect_class)>=5000 THEN 'aggregated'
  ELSE 'waived' END lane FROM findings)"""


@query("materiality_triage", """SELECT close_id, defect_class, subject_id, money_impact, lane
  FROM lanes""", extra=LANES)
def materiality_triage(spark, sf_dir):
    return materiality.triage(closed(spark, sf_dir).findings).select(
        "close_id", "defect_class", "subject_id", "money_impact", "lane")


@query("materiality_order", """SELECT close_id, lane, subject_id, money_impact, row_number() OVER (
  PARTITION BY close_id, lane ORDER BY money_impact DESC, check_rank, line_no, subject_id) AS place
  FROM lanes WHERE lane IN ('chased','waived')""", extra=LANES)
def materiality_order(spark, sf_dir):
    """Both lists of single items, largest first."""
    return materiality.in_order(materiality.triage(closed(spark, sf_dir).findings)).select(
        "close_id", "lane", "subject_id", "money_impact", "place")


@query("materiality_claims", """SELECT close_id, defect_class, count(*) AS items,
  CAST(sum(money_impact) AS DECIMAL(28,2)) AS total, max(money_impact) AS largest FROM lanes
  WHERE lane='aggregated' GROUP BY ALL""", extra=LANES)
def materiality_claims(spark, sf_dir):
    return materiality.claims(materiality.triage(closed(spark, sf_dir).findings))


@query("materiality_sweep", """SELECT close_id, floor, CAST(sum(n) AS BIGINT) AS items_before,
  CAST(sum(CASE lane WHEN 'waived' THEN 0 WHEN 'aggregated' THEN 1 ELSE n END) AS BIGINT)
    AS items_after, count(*) FILTER (lane='aggregated') AS n_claims,
  CAST(coalesce(sum(s) FILTER (lane='chased'),0) AS DECIMAL(28,2)) AS chased_total,
  CAST(coalesce(sum(s) FILTER (lane='aggregated'),0) AS DECIMAL(28,2)) AS aggregated_total,
  CAST(coalesce(sum(s) FILTER (lane='waived'),0) AS DECIMAL(28,2)) AS waived_total FROM (
    SELECT close_id, defect_class, floor, CASE WHEN side='small' THEN CASE WHEN sum(money_impact)
      >=5000 THEN 'aggregated' ELSE 'waived' END ELSE side END lane, count(*) n,
      sum(money_impact) s FROM (SELECT *, CASE WHEN money_impact<=0 THEN 'free'
        WHEN money_impact>=floor THEN 'chased' ELSE 'small' END side FROM findings,
        (SELECT unnest([50,100,250,500,1000,2500,5000,10000])::DECIMAL(18,2) floor))
    GROUP BY close_id, defect_class, floor, side) GROUP BY ALL""")
def materiality_sweep(spark, sf_dir):
    return materiality.sweep(closed(spark, sf_dir).findings).select(
        "close_id", "floor", "items_before", "items_after", "n_claims", "chased_total",
        "aggregated_total", "waived_total")


RANK = "greatest(1, least(n, CAST(round_even({p}::DOUBLE*n+0.5, 0) AS BIGINT)))"


def _percentiles(source):
    return ", ".join(
        f"(list_sort(list(lag)))[{RANK.format(p=p).replace('n+', 'count(*)+').replace('least(n', 'least(count(*)')}] AS {name}"
        for p, name in (("0.1", "low"), ("0.5", "median"), ("0.9", "high")))


LAGS = f"""lags AS (SELECT close_id, batch_id, batch_seq, settled_on, last_value_date-settled_on lag
  FROM matches WHERE last_value_date>=settled_on),
lagm AS (SELECT close_id, count(*) n_lags, {_percentiles('lags')} FROM lags GROUP BY 1),
due AS (SELECT * FROM open_batches WHERE batch_id<>'UNSETTLED'),
anchor AS (SELECT close_id, coalesce(max(o.first_settled_on), max(b.max_settled_on)) as_of
  FROM batches b LEFT JOIN due o USING (close_id) GROUP BY 1),
arr AS (SELECT d.close_id, d.batch_id, d.expected amount, d.first_settled_on settled_on, a.as_of,
  coalesce(n_lags,0) n_lags, CAST(d.first_settled_on+CAST(coalesce(low,0) AS INTEGER) AS DATE) earliest,
  CAST(d.first_settled_on+CAST(coalesce(median,0) AS INTEGER) AS DATE) expected_on,
  CAST(d.first_settled_on+CAST(coalesce(high,0) AS INTEGER) AS DATE) latest FROM due d JOIN anchor a
  USING (close_id) LEFT JOIN lagm USING (close_id) WHERE d.expected>0)"""


@query("lag_percentiles", "SELECT close_id, n_lags, low, median, high FROM lagm", extra=LAGS)
def lag_percentiles(spark, sf_dir):
    return forecast.lag_model(forecast.observed_lags(closed(spark, sf_dir).matches))


def _forecast(spark, sf_dir):
    """Arrivals and anchors of every close."""
    c = closed(spark, sf_dir, False)
    model = forecast.anchors(c.batches, c.open_batches, c.matches)
    return forecast.arrivals(c.open_batches, model), model


@query("forecast_arrivals", """SELECT close_id, batch_id, amount, CAST(earliest AS VARCHAR) AS
  earliest, CAST(expected_on AS VARCHAR) AS expected_on, CAST(latest AS VARCHAR) AS latest,
  latest<as_of AS overdue FROM arr""", extra=LAGS, learned=False)
def forecast_arrivals(spark, sf_dir):
    return _forecast(spark, sf_dir)[0].select(
        "close_id", "batch_id", "amount", "earliest", "expected_on", "latest", "overdue")


@query("forecast_order", """SELECT close_id, batch_id, overdue, days_overdue, row_number() OVER (
  PARTITION BY close_id, overdue ORDER BY CASE WHEN overdue THEN latest ELSE expected_on END,
    CASE WHEN overdue THEN 0 ELSE -amount END, batch_id) AS place FROM (
  SELECT *, latest<as_of AS overdue, CASE WHEN latest<as_of THEN as_of-latest END AS days_overdue
  FROM arr)""", extra=LAGS, learned=False)
def forecast_order(spark, sf_dir):
    """Arrivals by day and amount, overdue batches with their days by slowest date."""
    return forecast.in_order(_forecast(spark, sf_dir)[0]).select(
        "close_id", "batch_id", "overdue", F.col("days_overdue").cast("long").alias("days_overdue"),
        "place")


@query("forecast_totals", """SELECT close_id, CAST(a.as_of AS VARCHAR) AS as_of,
  coalesce(l.n_lags,0) AS n_lags, count(*) FILTER (latest>=a.as_of) AS n_arrivals,
  CAST(coalesce(sum(amount) FILTER (latest>=a.as_of),0) AS DECIMAL(28,2)) AS total_expected,
  count(*) FILTER (latest<a.as_of) AS n_overdue,
  CAST(coalesce(sum(amount) FILTER (latest<a.as_of),0) AS DECIMAL(28,2)) AS overdue_total,
  CAST(coalesce(sum(amount) FILTER (latest>=a.as_of AND latest<=a.as_of+14),0) AS DECIMAL(28,2))
    AS worst_case, coalesce(l.n_lags,0)>=8 AS usable FROM anchor a LEFT JOIN lagm l
  USING (close_id) LEFT JOIN arr USING (close_id) GROUP BY close_id, a.as_of, l.n_lags""",
       extra=LAGS, learned=False)
def forecast_totals(spark, sf_dir):
    return forecast.forecast_totals(*_forecast(spark, sf_dir))


@query("forecast_curve", """SELECT c.close_id, CAST(c.day AS VARCHAR) AS expected_on,
  CAST(coalesce(sum(amount),0) AS DECIMAL(28,2)) AS amount, count(amount) AS batches FROM (
    SELECT close_id, CAST(as_of+CAST(o AS INTEGER) AS DATE) AS day FROM anchor,
      range(0,15) r(o)) c
  LEFT JOIN arr a ON a.close_id=c.close_id AND a.expected_on=c.day AND a.latest>=a.as_of
  GROUP BY ALL""", extra=LAGS, learned=False)
def forecast_curve(spark, sf_dir):
    return forecast.forecast_curve(*_forecast(spark, sf_dir))


@query("unscheduled_money", """SELECT close_id, defect_class, count(*) AS items,
  CAST(sum(money_impact) AS DECIMAL(28,2)) AS amount FROM findings
  WHERE defect_class IN ('chargeback_hold','unsettled_revenue') GROUP BY ALL""")
def unscheduled_money(spark, sf_dir):
    return forecast.unscheduled(closed(spark, sf_dir).findings)


BACKTEST = LAGS + f""",
bt AS (SELECT *, row_number() OVER (PARTITION BY close_id ORDER BY settled_on, batch_seq) place,
  CAST(floor(count(*) OVER (PARTITION BY close_id)*0.6::DOUBLE) AS BIGINT) n_fit FROM lags),
btm AS (SELECT close_id, n_fit, {_percentiles('bt')} FROM bt WHERE place<=n_fit GROUP BY 1,2),
btt AS (SELECT close_id, count(*) n_tested, count(*) FILTER (lag BETWEEN low AND high) inside,
  median(abs(lag-median)) med FROM bt JOIN btm USING (close_id) WHERE place>bt.n_fit
  AND bt.n_fit>=8 GROUP BY 1)"""


@query("forecast_backtest", """SELECT b.close_id, b.n_fit, coalesce(n_tested,0) AS n_tested,
  coalesce(inside,0) AS inside_band, CAST(med AS DOUBLE) AS median_error_days,
  round(CAST(inside AS DOUBLE)/n_tested,6) AS coverage, CAST(inside AS DOUBLE)/n_tested>=0.65
  AS honest FROM (SELECT DISTINCT close_id, n_fit
  FROM bt) b LEFT JOIN btt USING (close_id)""", extra=BACKTEST)
def forecast_backtest(spark, sf_dir):
    return forecast.backtest(closed(spark, sf_dir).matches)


# --- sign-off, aging, digests, lists -----------------------------------------

def _measures(c):
    return signoff.close_measures(c.source_counts, c.batches, c.matches, c.open_credits,
                                  c.exceptions)


SIGN = """meas AS (SELECT c.*, coalesce(nb,0) nb, coalesce(nm,0) nm, coalesce(un,0) un,
  coalesce(ne,0) ne FROM counts c
  LEFT JOIN (SELECT close_id, count(*) nb FROM batches GROUP BY 1) USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) nm FROM matches GROUP BY 1) USING (close_id)
  LEFT JOIN (SELECT close_id, sum(credit_amount) un FROM open_credits GROUP BY 1) USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) ne FROM exceptions GROUP BY 1) USING (close_id)),
fired AS (
  SELECT close_id, 'source_present' AS rule, 'halt' severity FROM meas
    WHERE n_settlement=0 OR n_bank=0
  UNION ALL SELECT close_id, 'match_rate_floor', 'halt' FROM meas WHERE nb>0
    AND CAST(nm AS DOUBLE)/nb<0.5
  UNION ALL SELECT close_id, 'unattributed_money', 'halt' FROM meas WHERE credited>0
    AND CAST(un AS DOUBLE)/CAST(credited AS DOUBLE)>0.33::DOUBLE
  UNION ALL SELECT close_id, 'human_queue_depth', 'degrade' FROM meas WHERE ne>40)"""


@query("signoff_trips", "SELECT close_id, rule, severity FROM fired", extra=SIGN, learned=False,
       yearly=True)
def signoff_trips(spark, sf_dir):
    return signoff.trips(_measures(closed(spark, sf_dir, False, True))).select(
        "close_id", "rule", "severity")


@query("signoff_decisions", """SELECT m.close_id, CASE WHEN h>0 THEN 'DO NOT SIGN'
  WHEN d>0 THEN 'SIGN WITH CAVEATS' ELSE 'SIGN' END AS decision FROM meas m LEFT JOIN (
  SELECT close_id, count(*) FILTER (severity='halt') h, count(*) FILTER (severity='degrade') d
  FROM fired GROUP BY 1) USING (close_id)""", extra=SIGN, learned=False, yearly=True)
def signoff_decisions(spark, sf_dir):
    m = _measures(closed(spark, sf_dir, False, True))
    return signoff.decisions(m, signoff.trips(m)).select("close_id", "decision")


def _series(df):
    parts = F.split("close_id", "_")
    return df.withColumn("series_id", F.concat_ws("_", parts[0], parts[1])).withColumn(
        "close_seq", parts[2].cast("int"))


def _closes(c):
    """Every close held, whether anything was asked in it or not."""
    return _series(c.source_counts.select("close_id"))


AGING = """held AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY close_seq) place,
    max(close_seq) OVER (PARTITION BY series_id) last FROM (
    SELECT regexp_extract(close_id,'^(sup_[0-9]+)',1) series_id,
      CAST(regexp_extract(close_id,'([0-9]+)$',1) AS INTEGER) close_seq FROM counts)),
asked AS (SELECT DISTINCT regexp_extract(close_id,'^(sup_[0-9]+)',1) series_id,
    CAST(regexp_extract(close_id,'([0-9]+)$',1) AS INTEGER) close_seq,
    CASE kind WHEN 'missing_source' THEN kind||'::'||subject_id WHEN 'stale_rule'
      THEN kind||'::rule_id='||detail ELSE kind||'::method='||detail END AS identity
  FROM exceptions WHERE kind IN ('unknown_rate_card','fabricated_amounts','stale_rule',
    'missing_source')),
isl AS (SELECT a.*, place-row_number() OVER (PARTITION BY series_id, identity
  ORDER BY close_seq) g FROM asked a JOIN held USING (series_id, close_seq)),
runs AS (SELECT series_id, identity, g, count(*) run, min(close_seq) f, max(close_seq) l FROM isl
  GROUP BY 1,2,3),
seen AS (SELECT DISTINCT series_id, last FROM held)"""


@query("aged_questions", """SELECT series_id, identity, CAST(sum(run) AS BIGINT) AS appearances,
  arg_max(run, l) AS consecutive, min(f) AS first_seq, max(l) AS last_seq, sum(run)>1 AS recurring,
  arg_max(run, l)>=3 AS stale, max(l)<any_value(last) AS resolved FROM runs
  JOIN seen USING (series_id) GROUP BY series_id, identity""", extra=AGING, learned=False,
       yearly=True)
def aged_questions(spark, sf_dir):
    c = closed(spark, sf_dir, False, True)
    return aging.aged_questions(_series(c.exceptions), _closes(c))


@query("episodic_counts", """SELECT regexp_extract(close_id,'^(sup_[0-9]+)',1) AS series_id,
  CAST(regexp_extract(close_id,'([0-9]+)$',1) AS INTEGER) AS close_seq, coalesce(n,0) AS episodic
  FROM counts LEFT JOIN (SELECT close_id, count(*) n FROM exceptions WHERE kind IN
    ('unmatched_batch','unclaimed_credit','suspicious_narration') GROUP BY 1) USING (close_id)""",
       learned=False, yearly=True)
def episodic_counts(spark, sf_dir):
    c = closed(spark, sf_dir, False, True)
    return aging.episodic_counts(_series(c.exceptions), _closes(c))


LINES = """lines AS (
  SELECT close_id, 'match' tag, to_json(['match', batch_id, CAST(expected_net AS VARCHAR),
    CAST(credited AS VARCHAR)])::VARCHAR line FROM matches
  UNION ALL SELECT close_id, 'credit', to_json(['credit', batch_id, bank_txn_id])::VARCHAR
    FROM match_credits
  UNION ALL SELECT close_id, 'finding', to_json(['finding', defect_class, subject_id,
    CAST(money_impact AS VARCHAR)])::VARCHAR FROM findings
  UNION ALL SELECT close_id, 'exception', to_json(['exception', kind, subject_id])::VARCHAR
    FROM exceptions),
hashed AS (SELECT close_id, tag, sha256(line) h FROM lines)"""
WORDS = "||':'||".join(
    f"CAST(sum(CAST(('0x'||substr(h,{1 + 8 * n},8)) AS BIGINT)) AS VARCHAR)" for n in range(8))


DIGEST_SQL = f"""SELECT close_id, sha256('close-v1:'||
  CAST(count(*) FILTER (tag='match') AS VARCHAR)||':'||
  CAST(count(*) FILTER (tag='finding') AS VARCHAR)||':'||
  CAST(count(*) FILTER (tag='exception') AS VARCHAR)||':'||{WORDS}) AS digest,
  count(*) FILTER (tag='match') AS matches, count(*) FILTER (tag='finding') AS findings,
  count(*) FILTER (tag='exception') AS exceptions FROM hashed GROUP BY 1"""


@query("close_digest", DIGEST_SQL, extra=LINES)
def close_digest(spark, sf_dir):
    c = closed(spark, sf_dir)
    return digest.close_digest(c.matches, c.match_credits, c.findings, c.exceptions)


TREE = LINES + """,
leaf AS (SELECT close_id, row_number() OVER (PARTITION BY close_id ORDER BY tag, line)-1 AS n,
  sha256(line) h FROM lines)""" + "".join(f""",
tree{n} AS (SELECT close_id, n//1000 AS n, sha256(string_agg(h, ',' ORDER BY n)) h
  FROM {"leaf" if n == 1 else f"tree{n - 1}"} GROUP BY ALL)""" for n in range(1, 5))


@query("canonical_digest", "SELECT close_id, sha256('close-v1:'||h) AS canonical_sha256 FROM tree4",
       extra=TREE)
def canonical_digest(spark, sf_dir):
    c = closed(spark, sf_dir)
    return digest.canonical_digest(c.matches, c.match_credits, c.findings, c.exceptions)


@query("least_clean_matches", """SELECT close_id, batch_id, place FROM (SELECT close_id, batch_id,
  row_number() OVER (PARTITION BY close_id ORDER BY abs(credited-expected_net)<=1,
    abs(credited-expected_net) DESC, batch_id) place FROM matches) WHERE place<=25""")
def least_clean_matches(spark, sf_dir):
    return reports.least_clean_matches(closed(spark, sf_dir).matches).select(
        "close_id", "batch_id", "place")


@query("largest_findings", """SELECT close_id, subject_id, money_impact, place FROM (
  SELECT *, row_number() OVER (PARTITION BY close_id ORDER BY money_impact DESC, defect_class,
    subject_id) place FROM findings WHERE money_impact>0) WHERE place<=8""")
def largest_findings(spark, sf_dir):
    return reports.largest_findings(closed(spark, sf_dir).findings).select(
        "close_id", "subject_id", "money_impact", "place")


# --- accuracy ----------------------------------------------------------------

HITS = """pairs AS (SELECT coalesce(f.close_id,t.close_id) close_id,
  coalesce(f.defect_class,t.defect_class) defect_class, f.subject_id IS NOT NULL p,
  t.subject_id IS NOT NULL t FROM (SELECT DISTINCT close_id, defect_class, subject_id
  FROM findings) f FULL JOIN truth t ON f.close_id=t.close_id AND f.defect_class=t.defect_class
  AND f.subject_id=t.subject_id),
hit AS (SELECT f.*, CASE WHEN t.subject_id IS NULL THEN 0 ELSE 1 END hit FROM findings f
  LEFT JOIN truth t ON f.close_id=t.close_id AND f.defect_class=t.defect_class
  AND f.subject_id=t.subject_id)"""
SCORED = """count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
  count(*) FILTER (t AND NOT p) AS fn"""


@query("score_by_class", f"""SELECT defect_class, tp, fp, fn, round(CAST(tp AS DOUBLE)
  /nullif(tp+fp,0),6) AS precision, round(CAST(tp AS DOUBLE)/nullif(tp+fn,0),6) AS recall,
  round(CASE WHEN tp>0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) END,6) AS f1,
  tp+fn AS support, fp*4.0::DOUBLE AS false_positive_minutes FROM (SELECT defect_class, {SCORED}
  FROM pairs GROUP BY 1)""", extra=HITS)
def score_by_class(spark, sf_dir):
    return scoring.score(closed(spark, sf_dir).findings, labels(spark, sf_dir))


def _records(c):
    return c.source_counts.select("close_id", (
        F.col("n_settlement") + F.col("n_bank") + F.col("n_ledger")).alias("records"))


def _card(spark, sf_dir, learned):
    c = closed(spark, sf_dir, learned)
    return scoring.scorecard(c.findings, labels(spark, sf_dir), c.matches, c.exceptions,
                             _records(c))


@query("scorecard", f"""SELECT close_id, tp, fp, fn, round(mr,6) AS match_rate,
  coalesce(ne,0) AS n_exceptions, money_flagged FROM (SELECT close_id, {SCORED} FROM pairs
  GROUP BY 1) LEFT JOIN (SELECT close_id, avg(CASE WHEN {CLEAN} THEN 1 ELSE 0 END) mr
  FROM matches GROUP BY 1) USING (close_id) LEFT JOIN (SELECT close_id, count(*) ne
  FROM exceptions GROUP BY 1) USING (close_id) LEFT JOIN (SELECT close_id,
  CAST(sum(money_impact) AS DECIMAL(28,2)) money_flagged FROM findings GROUP BY 1)
  USING (close_id)""", extra=HITS)
def scorecard(spark, sf_dir):
    return _card(spark, sf_dir, True).select("close_id", "tp", "fp", "fn", "match_rate",
                                             "n_exceptions", "money_flagged")


@query("confidence_calibration", """SELECT bin, count(*) AS n, CAST(sum(hit) AS BIGINT) AS correct,
  round(avg(hit),6) AS observed, round((bin*2+1)/10.0::DOUBLE-avg(hit),6) AS gap FROM (
  SELECT *, least(CAST(floor(confidence*5) AS INTEGER),4) AS bin FROM hit) GROUP BY 1""",
       extra=HITS)
def confidence_calibration(spark, sf_dir):
    return scoring.calibration(closed(spark, sf_dir).findings, labels(spark, sf_dir))


@query("auto_clear", """SELECT close_id, count(*) AS findings, CAST(coalesce(max(place) FILTER
  (good),0) AS BIGINT) AS auto_cleared, round(coalesce(arg_max(confidence, place) FILTER (good),
  1.01),3) AS threshold FROM (SELECT *, sum(hit) OVER w*1.0/place>=0.99 good FROM (SELECT *,
    row_number() OVER (PARTITION BY close_id ORDER BY confidence DESC, check_rank//10, line_no,
      check_rank, subject_id) place FROM hit)
  WINDOW w AS (PARTITION BY close_id ORDER BY place ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
       extra=HITS)
def auto_clear(spark, sf_dir):
    return scoring.auto_clear(closed(spark, sf_dir).findings, labels(spark, sf_dir)).select(
        "close_id", "findings", "auto_cleared", "threshold")


def _scored(learned):
    return oracles.over(f"""SELECT close_id, round(CAST(tp AS DOUBLE)/nullif(tp+fp,0),6) AS p,
      round(CAST(tp AS DOUBLE)/nullif(tp+fn,0),6) AS r, coalesce(ne,0) AS ne FROM (
      SELECT close_id, {SCORED} FROM pairs GROUP BY 1) LEFT JOIN (SELECT close_id, count(*) ne
      FROM exceptions GROUP BY 1) USING (close_id)""", learned, extra=HITS)


@query("taught_against_untaught", f"""--raw
  SELECT close_id, a.p AS precision_a, b.p AS precision_b, round(b.p-a.p,4) AS precision_delta,
  a.r AS recall_a, b.r AS recall_b, round(b.r-a.r,4) AS recall_delta, a.ne AS n_exceptions_a,
  b.ne AS n_exceptions_b, b.ne-a.ne AS n_exceptions_delta
  FROM ({_scored(False)}) a FULL JOIN ({_scored(True)}) b USING (close_id)""")
def taught_against_untaught(spark, sf_dir):
    """Two scored closes side by side: without rules and with them."""
    both = scoring.compare(_card(spark, sf_dir, False), _card(spark, sf_dir, True),
                           ["close_id"], ["precision", "recall", "n_exceptions"])
    return both.withColumns({f"{m}_delta": F.round(f"{m}_delta", 4)
                             for m in ("precision", "recall")})


@query("stress_summary", f"""SELECT *, coalesce(level_no = min(level_no) FILTER (false_positives>0) OVER (),
  FALSE) AS broke_here FROM (
  SELECT level_no, count(*) AS runs, round(avg(p),6) AS precision, round(avg(r),6) AS recall,
    round(avg(coalesce(mr,0)),6) AS match_rate, round(avg(coalesce(ne,0)),6) AS n_exceptions,
    CAST(sum(coalesce(fp,0)) AS BIGINT) AS false_positives FROM (
    SELECT close_id, CAST(floor(coalesce(tp+fn,0)*100.0::DOUBLE/(n_settlement+n_bank+n_ledger)) AS BIGINT)
      AS level_no, fp, CAST(tp AS DOUBLE)/nullif(tp+fp,0) p, CAST(tp AS DOUBLE)/nullif(tp+fn,0) r
    FROM counts LEFT JOIN (SELECT close_id, {SCORED} FROM pairs GROUP BY 1) USING (close_id))
  LEFT JOIN (SELECT close_id, avg(CASE WHEN {CLEAN} THEN 1 ELSE 0 END) mr FROM matches GROUP BY 1)
    USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) ne FROM exceptions GROUP BY 1) USING (close_id) GROUP BY 1)""",
       extra=HITS)
def stress_summary(spark, sf_dir):
    """Accuracy by labelled defects per hundred records, and the level that first broke."""
    level = F.floor(F.coalesce("support", F.lit(0)) * 100 / F.col("records"))
    return scoring.stress_summary(_card(spark, sf_dir, True), level)


@query("averages_by_year", f"""SELECT close_seq, count(*) AS runs, round(avg(mr),6) AS match_rate,
  round(avg(records),6) AS records, CAST(sum(ne) AS BIGINT) AS n_exceptions FROM (
  SELECT CAST(regexp_extract(close_id,'([0-9]+)$',1) AS INTEGER) close_seq,
    coalesce(mr,0) mr, n_settlement+n_bank+n_ledger records, coalesce(ne,0) ne FROM counts
  LEFT JOIN (SELECT close_id, avg(CASE WHEN {CLEAN} THEN 1 ELSE 0 END) mr FROM matches GROUP BY 1)
    USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) ne FROM exceptions GROUP BY 1) USING (close_id))
  GROUP BY 1""", learned=False, yearly=True)
def averages_by_year(spark, sf_dir):
    """Means per position in a series, with counts of trouble summed."""
    c = closed(spark, sf_dir, False, True)
    rows = _records(c).join(match_rate(c.matches), "close_id", "left").join(
        c.exceptions.groupBy("close_id").agg(
            F.count(F.lit(1)).alias("n_exceptions")), "close_id", "left").fillna(0)
    rows = _series(rows).withColumn("match_rate", F.coalesce(
        F.try_divide("clean", "matched"), F.lit(0.0)))
    return scoring.average_by(rows, ["close_seq"], ["match_rate", "records"], ["n_exceptions"])


# --- rules -------------------------------------------------------------------

CASES = """cases AS (SELECT close_id, bank_txn_id subject_id, narration,
  regexp_extract(upper(narration),'\\bUTR\\d{6,}\\b') utr FROM bank
  WHERE regexp_matches(upper(narration),'\\bUTR\\d{6,}\\b'))"""


@query("confirmed_cases", "SELECT close_id, subject_id, narration, utr FROM cases", extra=CASES)
def confirmed_cases(spark, sf_dir):
    c = closed(spark, sf_dir)
    return rules.confirmed_cases(c.bank, c.findings).select(
        "close_id", "subject_id", F.col("context")["narration"].alias("narration"),
        F.col("correct")["utr"].alias("utr"))


def _trial_rules():
    """Candidates of every kind; the one that reads a bank's label wrongly must fail."""
    made = [rules.operator_rule(n, **given) for n, given in enumerate((
        {"charge": ("proc chg", "250")}, {"rate": ("intl_card", "0.03")},
        {"alias": ("UTR", "UTR")}, {"alias": ("UTR", "REF")}, {"alias": ("ref", "UTR")}), start=1)]
    return made


@query("rule_admission", """SELECT n AS rule_seq, CAST(applies AS BIGINT) AS applicable,
  CAST(bad AS BIGINT) AS contradictions, bad=0 AS admitted FROM (
  SELECT 1 n, count(*) FILTER (contains(upper(narration),'PROC CHG')) applies, 0 bad FROM cases
  UNION ALL SELECT 2, 0, 0
  UNION ALL SELECT 3, count(*) FILTER (x<>''), count(*) FILTER (x<>'' AND 'UTR'||x<>utr) FROM a
  UNION ALL SELECT 4, count(*) FILTER (x<>''), count(*) FILTER (x<>'' AND 'REF'||x<>utr) FROM a
  UNION ALL SELECT 5, count(*) FILTER (y<>''), count(*) FILTER (y<>'' AND 'UTR'||y<>utr) FROM a)""",
       extra=CASES + """,
a AS (SELECT *, regexp_extract(ltrim(substr(upper(narration),strpos(upper(narration),'UTR')+3),
  ' :-/#'), '^[0-9]{6,24}') x, CASE WHEN strpos(upper(narration),'REF')>0 THEN regexp_extract(
  ltrim(substr(upper(narration),strpos(upper(narration),'REF')+3),' :-/#'),'^[0-9]{6,24}')
  ELSE '' END y FROM cases)""")
def rule_admission(spark, sf_dir):
    c = closed(spark, sf_dir)
    return rules.admission(_trial_rules(), rules.confirmed_cases(c.bank, c.findings)).select(
        "rule_seq", "applicable", "contradictions", "admitted")


@query("rule_regressions", """SELECT rule_seq, close_id, subject_id, regression, place FROM (
  SELECT 4 AS rule_seq, close_id, subject_id, subject_id||': utr would become REF'||x||
    ', confirmed value is '||utr AS regression, row_number() OVER (ORDER BY close_id, subject_id)
    AS place FROM a WHERE x<>'' AND 'REF'||x<>utr) WHERE place<=5""", extra=CASES + """,
a AS (SELECT *, regexp_extract(ltrim(substr(upper(narration),strpos(upper(narration),'UTR')+3),
  ' :-/#'), '^[0-9]{6,24}') x FROM cases)""")
def rule_regressions(spark, sf_dir):
    """The first cases each refused candidate would have changed."""
    c = closed(spark, sf_dir)
    return rules.regressions(_trial_rules(), rules.confirmed_cases(c.bank, c.findings))


@query("rule_opinions", """SELECT close_id, kind, subject_id, CASE WHEN contains(t,'KKBK NEFT REF ')
  THEN 'narration_alias_001' WHEN contains(t,'PROC CHG') THEN 'adjustment_pattern_001'
  WHEN contains(t,'SVC CHG') THEN 'adjustment_pattern_002' ELSE 'fee_variant_001' END AS rule_id,
  CASE WHEN contains(t,'KKBK NEFT REF ') THEN 'narration_alias' WHEN contains(t,'PROC CHG')
  OR contains(t,'SVC CHG') THEN 'adjustment_pattern' ELSE 'fee_variant' END AS rule_kind
  FROM (SELECT close_id, kind, subject_id, detail, coalesce(narration, first) t FROM exceptions e
    LEFT JOIN (SELECT close_id, bank_txn_id subject_id, narration FROM bank) USING (close_id,
      subject_id)
    LEFT JOIN (SELECT b.close_id, b.batch_id subject_id, arg_min(narration, (value_date, line_no))
      first FROM open_batches b JOIN open_credits c ON b.close_id=c.close_id
      AND value_date-settled_on BETWEEN 0 AND 6 GROUP BY 1,2) USING (close_id, subject_id))
  WHERE contains(t,'KKBK NEFT REF ') OR contains(t,'PROC CHG') OR contains(t,'SVC CHG')
    OR (kind IN ('fabricated_amounts','unknown_rate_card') AND detail='intl_card')""")
def rule_opinions(spark, sf_dir):
    """Rules that speak to open exceptions; none of them decides one."""
    c = closed(spark, sf_dir)
    return post_match.rule_opinions(c.exceptions, c.candidates(), c.book)


# A close in which every merchant has rules of its own.

@query("merchant_credits", """SELECT close_id, bank_txn_id, credit_amount, utr_x, adj, adj_rule
  FROM credits""", oracles.STORES)
def merchant_credits(spark, sf_dir):
    return nets.prepare_credits(sources(spark, sf_dir)[1], tables.merchant_book(spark, sf_dir)).select(
        "close_id", "bank_txn_id", "credit_amount", "utr_x", "adj", "adj_rule")


_matches("merchant_matches", "%", oracles.STORES)


@query("merchant_findings", f"SELECT {FINDING_SQL}, rule_id FROM findings", oracles.STORES)
def merchant_findings(spark, sf_dir):
    return closed(spark, sf_dir, oracles.STORES).findings.select(*FINDING, "rule_id")


@query("merchant_exceptions", """SELECT close_id, kind, subject_id, check_rank,
  CASE kind WHEN 'stale_rule' THEN CAST(gap AS DECIMAL(28,2)) END AS observed,
  CASE kind WHEN 'stale_rule' THEN CAST(CASE e.rule_id WHEN 'any_charge' THEN
    CAST(1+""" + oracles.SK + """ AS DECIMAL(28,2)) ELSE CASE WHEN """ + oracles.SK + """%10=1 THEN 250
    WHEN """ + oracles.SK + """%10=6 THEN 375 ELSE 500 END END AS DECIMAL(28,2)) END AS stored
  FROM (SELECT *, detail rule_id, amount gap FROM exceptions) e""", oracles.STORES)
def merchant_exceptions(spark, sf_dir):
    """Open questions; a stale charge is compared with the amount its own store holds."""
    ctx = F.col("context")
    stale = F.col("kind") == "stale_rule"
    return closed(spark, sf_dir, oracles.STORES).exceptions.select(
        "close_id", "kind", "subject_id", "check_rank",
        F.when(stale, ctx["observed_amount"].cast(S.TOTAL)).alias("observed"),
        F.when(stale, ctx["stored_amount"].cast(S.TOTAL)).alias("stored"))


@query("alias_candidates", """SELECT DISTINCT b.close_id, b.batch_id AS subject_id, arg_min(
    regexp_extract(rtrim(split_part(upper(narration), substr(b.utr,4), 1), ' :-/#'), '(\\S+)$', 1),
    (c.value_date, c.line_no)) AS marker
  FROM open_batches b JOIN open_credits c ON b.close_id=c.close_id AND c.value_date-b.settled_on
    BETWEEN 0 AND 4 AND contains(narration, substr(b.utr,4))
  WHERE b.utr IS NOT NULL AND regexp_extract(rtrim(split_part(upper(narration), substr(b.utr,4), 1),
    ' :-/#'), '(\\S+)$', 1)<>'' GROUP BY 1,2""", learned=False)
def alias_candidates(spark, sf_dir):
    c = closed(spark, sf_dir, False)
    return rules.alias_candidates(c.exceptions, c.candidates()).select(
        "close_id", "subject_id", F.col("proposed_rule.params")["marker"].alias("marker"))


@query("timing_candidates", """SELECT close_id, subject_id, CAST(lag AS VARCHAR) AS offset_days FROM (
  SELECT b.close_id, b.batch_id subject_id, k.value_date-b.settled_on lag, row_number() OVER (
    PARTITION BY b.close_id, b.batch_id ORDER BY k.line_no) r
  FROM open_batches b JOIN bank k ON b.close_id=k.close_id AND k.value_date-b.settled_on
    BETWEEN 5 AND 9 AND k.credit_amount-b.expected BETWEEN -1 AND 1) WHERE r=1""", learned=False)
def timing_candidates(spark, sf_dir):
    c = closed(spark, sf_dir, False)
    return rules.timing_candidates(c.exceptions, c.bank, c.open_credits, c.book).select(
        "close_id", "subject_id", F.col("proposed_rule.params")["offset_days"]
        .alias("offset_days"))


@query("repricing_candidates", """SELECT close_id, 'stale::'||rule_id AS subject_id,
  rule_id AS retire_rule, CAST(gap AS VARCHAR) AS amount FROM stale""")
def repricing_candidates(spark, sf_dir):
    return rules.repricing_candidates(closed(spark, sf_dir).exceptions).select(
        "close_id", "subject_id", "retire_rule",
        F.col("proposed_rule.params")["amount"].alias("amount"))


# What the merchant agreement of these views says, whatever was billed.
CONTRACT = (("upi", "0.020"), ("card", "0.020"), ("netbanking", "0.020"), ("intl_card", "0.030"))


def _contract(spark):
    return spark.createDataFrame(list(CONTRACT), "method string, rate string").withColumn(
        "rate", F.col("rate").cast("decimal(6,3)"))


@query("rate_candidates", f"""SELECT c.close_id, c.method, k.rate FROM cards c JOIN (VALUES
  {', '.join(map(str, CONTRACT))}) k(method, rate) USING (method)""", learned=False)
def rate_candidates(spark, sf_dir):
    c = closed(spark, sf_dir, False)
    p = F.col("proposed_rule.params")
    return rules.rate_candidates(c.exceptions, _contract(spark)).select(
        "close_id", p["method"].alias("method"), p["rate"].cast("decimal(6,3)").cast("string")
        .alias("rate"))


# Two rounds of learning, each merchant for itself: what a close without rules suggests,
# then answers of a reviewer: a rate that changed, a label that misleads, a rule cut short.
LEARNED = CASES + """,
refs AS (SELECT b.close_id, b.batch_id, any_value(b.batch_seq) batch_seq, arg_min(
    regexp_extract(rtrim(split_part(upper(narration), substr(b.utr,4), 1), ' :-/#'), '(\\S+)$', 1),
    (c.value_date, c.line_no)) AS marker
  FROM open_batches b JOIN open_credits c ON b.close_id=c.close_id AND c.value_date-b.settled_on
    BETWEEN 0 AND 4 AND contains(narration, substr(b.utr,4))
  WHERE b.utr IS NOT NULL AND regexp_extract(rtrim(split_part(upper(narration), substr(b.utr,4), 1),
    ' :-/#'), '(\\S+)$', 1)<>'' GROUP BY 1,2),
lates AS (SELECT close_id, batch_id, batch_seq, lag, CASE WHEN contains(u,'HDFC') THEN 'HDFC'
    WHEN contains(u,'ICICI') THEN 'ICICI' WHEN contains(u,'AXIS') THEN 'AXIS' WHEN contains(u,'SBI')
    THEN 'SBI' WHEN contains(u,'KOTAK') OR contains(u,'KKBK') THEN 'KOTAK' ELSE 'UNKNOWN' END bank
  FROM (SELECT b.close_id, b.batch_id, b.batch_seq, k.value_date-b.settled_on lag,
      upper(k.narration) u FROM open_batches b JOIN bank k ON b.close_id=k.close_id
      AND k.value_date-b.settled_on BETWEEN 5 AND 9 AND k.credit_amount-b.expected BETWEEN -1 AND 1
    QUALIFY row_number() OVER (PARTITION BY b.close_id, b.batch_id ORDER BY k.line_no)=1)
  ANTI JOIN refs USING (close_id, batch_id)),
said AS (
  SELECT 1 round, close_id, 'fee_variant' kind, 40 check_rank, first_line line_no,
    'ratecard::'||c.method origin, c.method mark, k.rate val
  FROM cards c JOIN (VALUES {contract}) k(method, rate) USING (method)
  UNION ALL SELECT 1, close_id, 'narration_alias', 60, batch_seq, batch_id, marker, 'UTR' FROM refs
  UNION ALL SELECT 1, close_id, 'bank_timing', 60, batch_seq, batch_id, bank, CAST(lag AS VARCHAR)
  FROM lates
  UNION ALL SELECT 2, close_id, 'fee_variant', 90, 1, 'review::1', 'intl_card', '0.031' FROM counts
  WHERE {sk}%3=0
  UNION ALL SELECT 2, close_id, 'narration_alias', 90, 2, 'review::2', 'UTR', 'REF' FROM counts),
lessons AS (SELECT * FROM said s WHERE NOT (round=2 AND kind='narration_alias' AND EXISTS (
    SELECT 1 FROM refs r WHERE r.close_id=s.close_id AND r.marker='UTR'))
  QUALIFY row_number() OVER (PARTITION BY round, close_id, kind, mark
    ORDER BY check_rank, line_no, origin)=1),
read AS (SELECT round, close_id, kind, mark, count(*) n FROM (
    SELECT l.*, utr, regexp_extract(ltrim(substr(upper(narration), strpos(upper(narration), mark)
      +length(mark)), ' :-/#'), '^[0-9]+') digits
    FROM lessons l JOIN cases USING (close_id)
    WHERE kind='narration_alias' AND strpos(upper(narration), mark)>0)
  WHERE length(digits) BETWEEN 6 AND 24 AND val||digits<>utr GROUP BY ALL),
judged AS (SELECT l.*, coalesce(n, 0) bad, row_number() OVER (PARTITION BY close_id
    ORDER BY round, check_rank, line_no, origin) seq
  FROM lessons l LEFT JOIN read USING (round, close_id, kind, mark)),
named AS (SELECT *, CASE WHEN bad=0 THEN kind||'_'||lpad(CAST(count(*) FILTER (bad=0) OVER (
      PARTITION BY close_id, kind ORDER BY seq) AS VARCHAR), 3, '0') ELSE kind||'_pending' END id
  FROM judged)"""


def _learned(spark, sf_dir):
    """The rule table of every merchant after two rounds, kept as a log of events."""
    c = closed(spark, sf_dir, False)
    own = lambda close_id: close_id
    empty = spark.createDataFrame([], S.RULES)
    cases = rules.confirmed_cases(c.bank, c.findings)
    answers = materialise(rules.suggested_resolutions(c, _contract(spark)), "answers")
    first = materialise(rules.learn(answers, empty, cases, "first", own), "learned")

    def answer(line, retired, kind, *params):
        entries = F.create_map(*map(F.lit, params))
        return F.struct(
            F.lit(f"review::{line}").alias("subject_id"), F.lit(90).alias("check_rank"),
            F.lit(line).cast("long").alias("line_no"), F.lit("review").alias("source"),
            F.lit(retired).cast("string").alias("retire_rule"),
            F.struct(F.lit(kind).alias("kind"), entries.alias("params"), F.lit(1.0).alias("confidence"))
            .alias("proposed_rule"))

    given = F.array(
        answer(1, "fee_variant_001", "fee_variant", "method", "intl_card", "rate", "0.031"),
        answer(2, None, "narration_alias", "marker", "UTR", "prefix", "REF"),
        answer(3, None, "fee_variant", "rate", "0.5"))
    third = F.substring_index("close_id", "_", -1).cast("long") % 3 == 0
    reviewed = c.source_counts.select("close_id", F.inline(given)).filter(
        (F.col("line_no") > 1) | third)
    second = materialise(rules.learn(reviewed, first, cases, "second", own), "learned")
    folder = _folder(spark, "rule-log")
    rule_files.append(rule_files.changes(empty, first), folder)
    rule_files.compact(spark, folder)
    rule_files.append(rule_files.changes(first, second), folder)
    return rule_files.read_log(spark, folder)


@query("learned_rules", """SELECT close_id AS series_id, seq AS rule_seq, id AS rule_id, kind,
  CASE WHEN bad>0 THEN 'rejected' WHEN id='fee_variant_001' AND {sk}%3=0 THEN 'retired'
    ELSE 'live' END AS status,
  CASE WHEN bad>0 THEN 'contradicts '||CAST(bad AS VARCHAR)||' confirmed case(s)'
    WHEN id='fee_variant_001' AND {sk}%3=0 THEN 'superseded from review::1' END AS reason,
  origin AS origin_exception, CASE round WHEN 1 THEN 'first' ELSE 'second' END AS learned_on,
  CASE kind WHEN 'bank_timing' THEN mark||' settles T+'||val
    WHEN 'narration_alias' THEN 'reference follows '''||mark||''''
    ELSE mark||' is billed at '||printf('%.2f%%', CAST(val AS DOUBLE)*100) END AS summary
  FROM named""".replace("{sk}", oracles.SK), learned=False,
       extra=LEARNED.replace("{sk}", oracles.SK).replace("{contract}", ", ".join(map(str, CONTRACT))))
def learned_rules(spark, sf_dir):
    """Rules of every merchant after two rounds, one retired, refused or cut short among them."""
    return _learned(spark, sf_dir).select(
        "series_id", "rule_seq", "rule_id", "kind", "status", "reason", "origin_exception",
        "learned_on", rules.rule_summary().alias("summary"))


@query("rule_store_round_trip", """SELECT method, CAST(CAST(r AS DECIMAL(6,3))/1000 AS
  DECIMAL(6,3))::VARCHAR AS rate FROM (SELECT method, arg_max(b, n) r FROM (
    SELECT method, bucket3 b, count(*) n FROM rated GROUP BY 1,2) GROUP BY 1)""", learned=False)
def rule_store_round_trip(spark, sf_dir):
    """A rate rule per method, written as the store document and read back."""
    table = _contract(spark).select(
        F.row_number().over(_by("method")).cast("long").alias("rule_seq"),
        F.concat(F.lit("fee_variant_"), "method").alias("rule_id"),
        F.lit("fee_variant").alias("kind"),
        F.create_map(F.lit("method"), "method", F.lit("rate"), F.col("rate").cast("string"))
        .alias("params"), F.lit("contract").alias("origin_exception"),
        F.lit("").alias("learned_on"), F.lit(1.0).alias("confidence"), F.lit("live")
        .alias("status"), F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("series_id"))
    path = _folder(spark, "rules")
    rule_files.write_rules(table, path)
    p = F.col("params")
    return rule_files.read_rules(spark, path).select(
        p["method"].alias("method"), p["rate"].cast("decimal(6,3)").cast("string").alias("rate"))


def _by(*columns):
    from pyspark.sql import Window
    return Window.orderBy(*columns)


def _folder(spark, name):
    import uuid
    return f"{shared_folder(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


# --- proposals ---------------------------------------------------------------

def _answers(spark, sf_dir):
    """One written suggestion per batch, naming the credits its id implies."""
    batches = closed(spark, sf_dir, False).batches
    tail = F.expr("substring(batch_id, 6)")
    mi = F.year("settled_on") * 12 + F.month("settled_on")
    claim = F.element_at(F.array(*[F.lit(c) for c in (
        "split_settlement", "unrecorded_adjustment", "narration_drift", "refund_fraud")]),
        (mi % 4 + 1).cast("int"))
    second = F.when((F.substring_index("close_id", "_", -1).cast("int") + 3 * mi) % 6 == 0,
                    F.concat(F.lit('", "bank_'), tail, F.lit('_1'))).otherwise("")
    adj = F.when(mi % 5 == 0, F.lit("250")).otherwise("null")
    body = F.concat(
        F.lit('Sure:\n```json\n{"defect_class": "'), claim, F.lit('", "bank_txn_ids": ["bank_'),
        tail, F.lit("_0"), second, F.lit('"], "confidence": '),
        F.when(mi % 7 == 0, "0.4").otherwise("0.8"), F.lit(', "claimed_adjustment": '), adj,
        F.lit("}\n```"))
    return batches.select("close_id", F.col("batch_id").alias("subject_id"),
                          F.when(mi % 11 == 0, "no idea {").otherwise(body).alias("text"))


VERIFY = """asked AS (SELECT close_id, batch_id, expected, year(settled_on)*12+month(settled_on) mi,
  CAST(split_part(close_id,'_',2) AS BIGINT) sk, substr(batch_id,6) tail FROM batches),
said AS (SELECT *, CASE WHEN mi%11=0 THEN 'unknown' ELSE ['split_settlement',
    'unrecorded_adjustment','narration_drift','refund_fraud'][CAST(mi%4+1 AS BIGINT)] END AS claim,
  CASE WHEN mi%11=0 THEN 0.0 WHEN mi%7=0 THEN 0.4 ELSE 0.8 END conf,
  mi%5=0 AND mi%11<>0 adj FROM asked),
named AS (SELECT s.*, 'bank_'||tail||'_'||leg id FROM said s, (SELECT unnest([0,1]) leg)
  WHERE mi%11<>0 AND (leg=0 OR (sk+3*mi)%6=0)),
summed AS (SELECT n.close_id, n.batch_id, count(*) ids, count(*) FILTER (b.bank_txn_id IS NULL)
  gone, coalesce(sum(b.credit_amount),0) credited FROM named n LEFT JOIN bank b
  ON n.close_id=b.close_id AND n.id=b.bank_txn_id GROUP BY 1,2),
judged AS (SELECT s.*, coalesce(u.credited,0) credited, s.expected-coalesce(u.credited,0) delta,
  coalesce(u.ids,0) ids, coalesce(u.gone,0) gone FROM said s LEFT JOIN summed u
  USING (close_id, batch_id)),
verdict AS (SELECT *, CASE WHEN ids=0 THEN 'no_credits_named'
  WHEN gone>0 THEN 'unknown_credits'
  WHEN adj AND 250>credited THEN 'adjustment_above_credit'
  WHEN adj AND abs(delta-250)<=1 THEN 'closes_with_adjustment'
  WHEN adj THEN 'adjustment_leaves_gap'
  WHEN claim='split_settlement' AND abs(delta)<=1 THEN 'split_closes'
  WHEN claim='split_settlement' THEN 'split_open'
  WHEN claim='unrecorded_adjustment' AND delta<=1 THEN 'no_shortfall'
  WHEN claim='unrecorded_adjustment' AND expected>0 AND delta>expected*0.25
    THEN 'charge_too_large'
  WHEN claim='unrecorded_adjustment' THEN 'shortfall_confirmed'
  WHEN claim='narration_drift' AND abs(delta)<=1 THEN 'amounts_agree'
  WHEN claim='narration_drift' THEN 'amounts_differ'
  ELSE 'class_unknown' END AS verdict FROM judged)"""


@query("parsed_proposals", """SELECT close_id, batch_id AS subject_id, claim AS defect_class,
  CAST(conf AS DOUBLE) AS confidence, CASE WHEN adj THEN '250' END AS claimed_adjustment FROM said""",
       extra=VERIFY, learned=False)
def parsed_proposals(spark, sf_dir):
    return proposals.parse(_answers(spark, sf_dir)).select(
        "close_id", "subject_id", "defect_class", "confidence", "claimed_adjustment")


def _verified(spark, sf_dir):
    c = closed(spark, sf_dir, False)
    return _once(spark, ("verified", sf_dir), lambda: materialise(proposals.verify(
        proposals.parse(_answers(spark, sf_dir)), c.batches, c.bank), "verified"))


@query("verified_proposals", """SELECT close_id, batch_id AS subject_id, verdict,
  CAST(credited AS DECIMAL(28,2)) AS credited, CAST(delta AS DECIMAL(28,2)) AS delta FROM verdict""",
       extra=VERIFY, learned=False)
def verified_proposals(spark, sf_dir):
    return _verified(spark, sf_dir).select(
        "close_id", "subject_id", "verdict", F.coalesce("credited", F.lit(0).cast(S.TOTAL))
        .alias("credited"), "delta")


def _outcomes(spark, sf_dir):
    c = closed(spark, sf_dir, False)
    queue = c.exceptions.filter("kind != 'suspicious_narration'")
    return _once(spark, ("outcomes", sf_dir), lambda: materialise(proposals.outcomes(
        queue, _verified(spark, sf_dir), _records(c)), "outcomes"))


OUTCOMES = VERIFY + """,
que AS (SELECT e.close_id, e.subject_id, row_number() OVER (PARTITION BY e.close_id
    ORDER BY e.check_rank, e.line_no, e.kind, e.subject_id) place,
    greatest(1, CAST(floor(5.0*(n_settlement+n_bank+n_ledger)/100) AS BIGINT)) budget,
    CASE WHEN coalesce(conf,0)<0.6 THEN 'declined' WHEN v.verdict NOT IN (
      'closes_with_adjustment','split_closes',
      'shortfall_confirmed','amounts_agree') THEN 'refused'
      WHEN v.claim='refund_fraud' THEN 'unparseable' ELSE 'accepted' END step, v.verdict, v.claim,
    conf, delta
  FROM exceptions e JOIN counts USING (close_id) LEFT JOIN verdict v
    ON e.close_id=v.close_id AND e.subject_id=v.batch_id WHERE e.kind<>'suspicious_narration'),
grp AS (SELECT *, count(*) FILTER (step='accepted') OVER (PARTITION BY close_id ORDER BY place) g
  FROM que),
stk AS (SELECT *, count(*) FILTER (step IN ('refused','unparseable')) OVER (PARTITION BY close_id,
  g ORDER BY place) streak FROM grp),
halt AS (SELECT close_id, min(place) FILTER (step='refused' AND streak>=12 AND place<=budget) stop_at
  FROM stk GROUP BY 1),
res AS (SELECT s.*, CASE WHEN place>budget THEN 'deferred' WHEN place>CAST(ceil(stop_at/4.0)*4 AS
  BIGINT) THEN 'abandoned' ELSE step END outcome FROM stk s JOIN halt USING (close_id))"""


@query("proposal_outcomes", "SELECT close_id, subject_id, place, outcome FROM res",
       extra=OUTCOMES, learned=False)
def proposal_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("close_id", "subject_id", "place", "outcome")


@query("close_effort", """SELECT c.close_id, CAST(n_settlement+n_bank+n_ledger AS BIGINT) AS
  records, coalesce(calls,0) AS calls, round(coalesce(calls,0)*100.0::DOUBLE
  /(n_settlement+n_bank+n_ledger),6) AS calls_per_100,
  round(coalesce(CAST(n AS DOUBLE)/(n+coalesce(won,0)),1.0),6) AS deterministic_share
  FROM counts c LEFT JOIN (SELECT close_id, count(*) FILTER (outcome NOT IN ('deferred','abandoned'))
    calls, count(*) FILTER (outcome='accepted') won FROM res GROUP BY 1) USING (close_id)
  LEFT JOIN (SELECT close_id, count(*) n FROM findings GROUP BY 1) USING (close_id)""",
       extra=OUTCOMES, learned=False)
def close_effort(spark, sf_dir):
    """How much of a close needed outside answers."""
    c = closed(spark, sf_dir, False)
    return scoring.effort(c.findings, _outcomes(spark, sf_dir), _records(c))


@query("proposal_findings", """SELECT close_id, claim AS defect_class, subject_id,
  CAST(conf AS DOUBLE) AS confidence, CAST(abs(delta) AS DECIMAL(28,2)) AS money_impact FROM res
  WHERE outcome='accepted'""", extra=OUTCOMES, learned=False)
def proposal_findings(spark, sf_dir):
    return proposals.proposal_findings(_outcomes(spark, sf_dir)).select(
        "close_id", "defect_class", "subject_id", "confidence", "money_impact")


@query("proposal_stops", """SELECT close_id, 'model_budget' AS rule FROM res GROUP BY 1
  HAVING count(*) FILTER (outcome='deferred')>0 UNION ALL
  SELECT close_id, 'model_refusal_streak' FROM halt WHERE stop_at IS NOT NULL""", extra=OUTCOMES,
       learned=False)
def proposal_stops(spark, sf_dir):
    return proposals.stops(_outcomes(spark, sf_dir)).select("close_id", "rule")


# --- risk --------------------------------------------------------------------

def _dataset(spark, sf_dir):
    st, bk, _ = sources(spark, sf_dir)
    return _once(spark, ("dataset", sf_dir), lambda: materialise(risk.labelled_features(
        risk.batch_features(st, bk), closed(spark, sf_dir, False).exceptions), "dataset"))


FEATS = """fb AS (SELECT close_id, settlement_batch_id batch_id, count(*) n,
    count(*) FILTER (txn_type='payment') pays, count(*) FILTER (txn_type='refund') refunds,
    count(*) FILTER (txn_type='chargeback_hold') holds,
    coalesce(sum(gross_amount) FILTER (txn_type IN ('refund','chargeback_hold')),0) ded,
    sum(net) net, max(gross_amount) largest, arg_min(settled_on, line_no) s,
    max(CASE WHEN utr<>'' THEN 1 ELSE 0 END) hu FROM rownet GROUP BY 1,2),
fw AS (SELECT b.close_id, b.batch_id, count(*) nc, max(CASE WHEN coalesce(c.utr,'')<>'' OR
    regexp_matches(upper(c.narration),'\\bUTR\\d{6,}\\b') THEN 1 ELSE 0 END) au,
    max(CASE WHEN regexp_matches(c.narration,'\\d{6,}') THEN 1 ELSE 0 END) ar,
    min(abs(c.credit_amount-b.net)) gap, max(c.value_date)-min(c.value_date) spread
  FROM fb b JOIN bank c ON b.close_id=c.close_id AND c.value_date-b.s BETWEEN 0 AND 4 GROUP BY 1,2),
feats AS (SELECT b.close_id, b.batch_id, n::DOUBLE n_txns, pays::DOUBLE n_payments,
    refunds::DOUBLE n_refunds, round(refunds::DOUBLE/n,6) refund_ratio, holds::DOUBLE n_holds,
    round(holds::DOUBLE/n,6) hold_ratio, round(ln(1+ded::DOUBLE),6) log_deductions,
    round(ln(1+abs(net)::DOUBLE),6) log_net, round(ln(1+largest::DOUBLE),6) log_max_txn,
    hu::DOUBLE settlement_has_utr, coalesce(nc,0)::DOUBLE n_credits_in_window,
    coalesce(au,0)::DOUBLE any_window_utr_parseable,
    coalesce(ar,0)::DOUBLE any_window_reference_present,
    CASE WHEN coalesce(gap,999999)<=1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END exact_amount_available,
    round(ln(1+coalesce(gap,999999)::DOUBLE),6) closest_amount_gap_log,
    coalesce(spread,0)::DOUBLE window_date_spread,
    CASE WHEN o.batch_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label
  FROM fb b LEFT JOIN fw USING (close_id, batch_id) LEFT JOIN open_batches o
    ON b.close_id=o.close_id AND b.batch_id=o.batch_id)"""


@query("risk_dataset", "SELECT * FROM feats", extra=FEATS, learned=False)
def risk_dataset(spark, sf_dir):
    """Sixteen features and the label per batch, from the raw sources."""
    return _dataset(spark, sf_dir)


def _probe(spark, sf_dir):
    """A fixed score from the features, to check the measures by themselves."""
    gap = F.round("closest_amount_gap_log", 3)
    return _dataset(spark, sf_dir).withColumn("risk", F.round(gap / 20, 3))


PROBE = FEATS + """,
probe AS (SELECT *, round(round(closest_amount_gap_log,3)/20,3) risk FROM feats)"""


@query("risk_measures", """SELECT count(*)::DOUBLE AS n, sum(label) AS positives,
  round(avg(pow(risk-label,2)),6) AS brier, round(avg(pow(0.1::DOUBLE-label,2)),6) AS baseline,
  round(1-avg(pow(risk-label,2))/avg(pow(0.1::DOUBLE-label,2)),6) AS skill,
  round((SELECT sum(CASE WHEN a.risk>b.risk THEN a.k*b.k WHEN a.risk=b.risk THEN a.k*b.k*0.5
    ELSE 0 END)/sum(a.k*b.k)
    FROM (SELECT risk, count(*)::DOUBLE k FROM probe WHERE label=1 GROUP BY 1) a,
    (SELECT risk, count(*)::DOUBLE k FROM probe WHERE label=0 GROUP BY 1) b),6) AS auc FROM probe""",
       extra=PROBE, learned=False)
def risk_measures(spark, sf_dir):
    return risk.evaluate(_probe(spark, sf_dir), 0.1)


@query("risk_reliability", """SELECT least(CAST(floor(risk*5) AS INTEGER),4) AS bin, count(*) AS n,
  round(avg(risk),6) AS predicted, round(avg(label),6) AS observed FROM probe GROUP BY 1""",
       extra=PROBE, learned=False)
def risk_reliability(spark, sf_dir):
    return risk.reliability(_probe(spark, sf_dir))


@query("review_budget", """SELECT reviewed, round(reviewed::DOUBLE/n,6) AS fraction,
  round(c/p,6) AS caught FROM (SELECT row_number() OVER w reviewed, sum(label) OVER (
    ORDER BY risk DESC, close_id, batch_id ROWS UNBOUNDED PRECEDING) c, count(*) OVER () n,
    sum(label) OVER () p FROM probe WINDOW w AS (ORDER BY risk DESC, close_id, batch_id))
  WHERE reviewed%greatest(1,n//10)=0 OR reviewed=n""", extra=PROBE, learned=False)
def review_budget(spark, sf_dir):
    return risk.review_budget(_probe(spark, sf_dir))


def _risk_rows(spark, sf_dir):
    """Batches to learn from, and those of every fourth merchant to report on."""
    rows = _dataset(spark, sf_dir)
    held = F.substring_index("close_id", "_", -1).cast("long") % 4 == 0
    return rows.filter(~held), rows.filter(held)


def _risk_model(spark, sf_dir, backend):
    learn_on, report_on = _risk_rows(spark, sf_dir)
    risk.refuse_overlap(learn_on, report_on)
    model = _once(spark, ("model", sf_dir, backend), lambda: risk.train(learn_on, backend))
    return model, report_on


@query("risk_model_logistic")
def risk_model_logistic(spark, sf_dir):
    """Calibrated logistic risk, reported on closes it never saw."""
    model, rows = _risk_model(spark, sf_dir, "logistic")
    return risk.evaluate(model.predict(rows), model.base_rate)


@query("risk_model_boosted")
def risk_model_boosted(spark, sf_dir):
    """The boosted comparator on the same split."""
    model, rows = _risk_model(spark, sf_dir, "gbt")
    return risk.evaluate(model.predict(rows), model.base_rate)


@query("risk_model_audit", """SELECT backend, count(*)::DOUBLE AS n, sum(label) AS positives,
  round(avg(pow(base-label,2)),6) AS baseline, TRUE AS beats_base_rate, TRUE AS rising,
  CASE WHEN backend='logistic' THEN TRUE END AS at_minimum, TRUE AS scores_agree,
  CAST(0 AS BIGINT) AS shared_closes FROM (VALUES ('logistic'), ('gbt')) b(backend),
  (SELECT label, avg(label) FILTER (k%4<>0) OVER () base, k FROM (
    SELECT label, CAST(regexp_extract(close_id,'([0-9]+)$',1) AS BIGINT) k FROM feats))
  WHERE k%4=0 GROUP BY 1""", extra=FEATS, learned=False)
def risk_model_audit(spark, sf_dir):
    """Both models scored again from their weights, trees and steps, on unseen closes."""
    learn_on, report_on = _risk_rows(spark, sf_dir)
    return union_all(risk.audit(_risk_model(spark, sf_dir, backend)[0], learn_on, report_on)
                     for backend in ("logistic", "gbt"))


@query("risk_ranking")
def risk_ranking(spark, sf_dir):
    """Unseen batches by risk."""
    model, rows = _risk_model(spark, sf_dir, "logistic")
    return risk.rank_close(model, rows).select("close_id", "batch_id", "risk", "label")


# --- files -------------------------------------------------------------------

# Small part files, so that a table comes in many of them.
ROWS_PER_FILE = 10_000


def _round_trip(name, source, reader, columns, sql):
    @query(f"{name}_csv_round_trip", sql)
    def job(spark, sf_dir):
        path = _folder(spark, name)
        csv_files.write_csv(sources(spark, sf_dir)[source], name, path, keep_close=True,
                            rows_per_file=ROWS_PER_FILE, compression="gzip")
        good, _ = reader(spark, path, F.col("close_id"))
        return good.select("close_id", "line_no", *columns)


# Records are numbered on over the files, the header being line one.
PLACE = "row_number() OVER (ORDER BY close_id, line_no) + 1 AS line_no"
_round_trip("settlement", 0, csv_files.read_settlement,
            ["txn_id", "settlement_batch_id", "utr", "txn_type", "gross_amount", "fee",
             "gst_on_fee", "settled_on", "order_id", "method"],
            f"""SELECT close_id, {PLACE}, txn_id, settlement_batch_id, utr, txn_type, gross_amount,
            fee, gst_on_fee, CAST(settled_on AS VARCHAR) AS settled_on, order_id, method
            FROM settlement""")
_round_trip("bank", 1, csv_files.read_bank,
            ["bank_txn_id", "credit_amount", "value_date", "narration", "utr"],
            f"""SELECT close_id, {PLACE}, bank_txn_id, credit_amount, CAST(value_date AS VARCHAR)
            AS value_date, narration, utr FROM bank""")
_round_trip("ledger", 2, csv_files.read_ledger,
            ["order_id", "txn_id", "amount", "created_at", "status"],
            f"""SELECT close_id, {PLACE}, order_id, txn_id, amount, CAST(created_at AS VARCHAR)
            AS created_at, status FROM ledger""")


@query("bundle_round_trip", DIGEST_SQL, extra=LINES)
def bundle_round_trip(spark, sf_dir):
    """The digest of a close whose three tables went out to part files and came back."""
    paths = {}
    for n, name in enumerate(("settlement", "bank", "ledger")):
        paths[name] = _folder(spark, f"bundle-{name}")
        csv_files.write_csv(sources(spark, sf_dir)[n], name, paths[name], keep_close=True,
                            rows_per_file=ROWS_PER_FILE, compression="gzip")
    *loaded, _ = csv_files.load_bundle(spark, **paths, close_id=F.col("close_id"), recon=False)
    made = materialise_all(dict(zip(paths, loaded)))
    c = close(*[made[name] for name in paths], tables.rulebook())
    return digest.close_digest(c.matches, c.match_credits, c.findings, c.exceptions)


@query("recon_round_trip", """SELECT txn_id, settlement_batch_id, utr, txn_type, gross_amount,
  fee, gst_on_fee,
  CAST(settled_on AS VARCHAR) AS settled_on, order_id, method FROM settlement""")
def recon_round_trip(spark, sf_dir):
    """Out in the gateway's own format, in whole subunits and epoch seconds, and back."""
    path = _folder(spark, "recon")
    gateway_recon.write_recon(sources(spark, sf_dir)[0], path, compression="gzip")
    assert gateway_recon.is_recon(spark, path)
    good, _ = gateway_recon.read_recon(spark, path)
    return good.drop("close_id", "line_no")


def _messy(spark, sf_dir):
    """Orders as an export with drifting spellings and some unreadable rows."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, amount = F.col("o_orderkey"), F.col("o_totalprice").cast(S.MONEY)
    day = F.col("o_orderdate").cast("date")
    plain = amount.cast("string")
    shapes = [plain, F.concat(F.lit("("), plain, F.lit(")")), F.concat(F.lit("₹ "), plain),
              F.concat(F.lit("INR "), F.format_number(amount, 2)), F.lit("n/a"), F.lit("")]
    dates = [F.date_format(day, p) for p in ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d",
                                             "dd-MMM-yyyy")] + [F.lit("2024-02-30"), F.lit("")]
    kinds = ["payment", "REFUND", "", "gift"]
    pick = lambda xs, n: F.element_at(F.array(*xs), (k % n + 1).cast("int"))
    return o.select(
        F.concat(F.lit("t"), k.cast("string")).alias("Transaction ID"),
        pick([F.lit(x) for x in kinds], 4).alias("Type"), pick(shapes, 6).alias("Gross-Amount"),
        pick(dates, 7).alias("Settlement Date"), F.lit("b1").alias("Settlement.ID"))


MESSY = """messy AS (SELECT o_orderkey k, CAST(o_totalprice AS DECIMAL(18,2)) a,
  CAST(o_orderdate AS DATE) d FROM orders),
told AS (SELECT *, CASE WHEN k%4=3 THEN 'unknown txn_type' WHEN k%6=4 THEN 'not an amount'
  WHEN k%7=5 THEN 'not a recognised date' WHEN k%7=6 THEN 'is empty' END err FROM messy)"""


@query("messy_csv_rows", """SELECT 't'||CAST(k AS VARCHAR) AS txn_id, ['payment','refund','payment']
  [CAST(k%4+1 AS BIGINT)] AS txn_type, CAST(CASE k%6 WHEN 1 THEN -a WHEN 5 THEN 0 ELSE a END AS
  DECIMAL(18,2)) AS gross_amount, CAST(d AS VARCHAR) AS settled_on FROM told WHERE err IS NULL""",
       extra=MESSY)
def messy_csv_rows(spark, sf_dir):
    path = _folder(spark, "messy")
    _messy(spark, sf_dir).write.csv(path, header=True, emptyValue="")
    return csv_files.read_settlement(spark, path)[0].select(
        "txn_id", "txn_type", "gross_amount", "settled_on")


@query("messy_csv_rejects", """SELECT err AS reason, count(*) AS n_rows FROM told
  WHERE err IS NOT NULL GROUP BY ALL""", extra=MESSY)
def messy_csv_rejects(spark, sf_dir):
    path = _folder(spark, "messy")
    _messy(spark, sf_dir).write.csv(path, header=True, emptyValue="")
    bad = csv_files.read_settlement(spark, path)[1]
    reasons = ["unknown txn_type", "not an amount", "not a recognised date", "is empty"]
    reason = F.coalesce(*[F.when(F.contains("error", F.lit(r)), F.lit(r)) for r in reasons])
    return bad.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


# --- campaign ----------------------------------------------------------------

@query("campaign_drift")
def campaign_drift(spark, sf_dir):
    """Closes of three years each, in order, the lessons of one feeding the next."""
    st, bk, ld = (_series(df).withColumn("close_id", F.col("series_id")).drop("series_id")
                  .withColumn("close_seq", F.floor((F.col("close_seq") - 1995) / 3).cast("int") + 1)
                  for df in sources(spark, sf_dir, True))
    periods = [r.close_seq for r in
               st.select("close_seq").distinct().orderBy("close_seq").collect()]
    done = campaign.run_campaign(st, bk, ld, periods, _contract(spark))
    return campaign.drift_table(done)
