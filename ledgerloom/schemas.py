"""Explicit schemas of the inputs and of the three result tables."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(28, 2)
TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(spec):
    return T.StructType([T.StructField(name, kind) for name, kind in spec])


SETTLEMENT = _struct([
    ("close_id", T.StringType()), ("line_no", T.LongType()), ("txn_id", T.StringType()),
    ("settlement_batch_id", T.StringType()), ("utr", T.StringType()),
    ("txn_type", T.StringType()), ("gross_amount", MONEY), ("fee", MONEY),
    ("gst_on_fee", MONEY), ("settled_on", T.DateType()), ("order_id", T.StringType()),
    ("method", T.StringType()),
])
BANK = _struct([
    ("close_id", T.StringType()), ("line_no", T.LongType()), ("bank_txn_id", T.StringType()),
    ("credit_amount", MONEY), ("value_date", T.DateType()), ("narration", T.StringType()),
    ("utr", T.StringType()),
])
LEDGER = _struct([
    ("close_id", T.StringType()), ("line_no", T.LongType()), ("order_id", T.StringType()),
    ("txn_id", T.StringType()), ("amount", MONEY), ("created_at", T.DateType()),
    ("status", T.StringType()),
])
FINDINGS = _struct([
    ("close_id", T.StringType()), ("defect_class", T.StringType()),
    ("subject_id", T.StringType()), ("layer", T.StringType()),
    ("confidence", T.DoubleType()), ("money_impact", TOTAL), ("rule_id", T.StringType()),
    ("evidence", TEXT_MAP), ("check_rank", T.IntegerType()), ("line_no", T.LongType()),
])
EXCEPTIONS = _struct([
    ("close_id", T.StringType()), ("kind", T.StringType()), ("subject_id", T.StringType()),
    ("context", TEXT_MAP), ("reason", T.StringType()), ("check_rank", T.IntegerType()),
    ("line_no", T.LongType()),
])
MATCHES = _struct([
    ("close_id", T.StringType()), ("batch_id", T.StringType()), ("batch_seq", T.LongType()),
    ("settled_on", T.DateType()), ("gross_expected", TOTAL), ("expected_net", TOTAL),
    ("credited", TOTAL), ("n_credits", T.LongType()), ("first_value_date", T.DateType()),
    ("last_value_date", T.DateType()), ("layer", T.StringType()),
    ("confidence", T.DoubleType()), ("method", T.StringType()), ("rule_id", T.StringType()),
    ("adjustment", MONEY), ("first_rule", T.StringType()), ("first_adjustment", MONEY),
    ("drift_credit", T.StringType()), ("drift_narration", T.StringType()),
])
MATCH_CREDITS = _struct([
    ("close_id", T.StringType()), ("batch_id", T.StringType()),
    ("bank_txn_id", T.StringType()),
])
RULES = _struct([
    ("rule_seq", T.LongType()), ("rule_id", T.StringType()), ("kind", T.StringType()),
    ("params", TEXT_MAP), ("origin_exception", T.StringType()),
    ("learned_on", T.StringType()), ("confidence", T.DoubleType()),
    ("status", T.StringType()), ("reason", T.StringType()), ("series_id", T.StringType()),
])
CASES = _struct([
    ("close_id", T.StringType()), ("subject_id", T.StringType()),
    ("context", TEXT_MAP), ("correct", TEXT_MAP),
])
PROPOSALS = _struct([
    ("close_id", T.StringType()), ("subject_id", T.StringType()),
    ("defect_class", T.StringType()), ("bank_txn_ids", T.ArrayType(T.StringType())),
    ("reasoning", T.StringType()), ("confidence", T.DoubleType()),
    ("claimed_adjustment", T.StringType()),
    ("proposed_rule", T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("params", TEXT_MAP),
        T.StructField("confidence", T.DoubleType()),
    ])),
])
