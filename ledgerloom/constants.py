"""The published thresholds every close is judged by."""

from decimal import Decimal

# --- money and rates (fixed values) ---
CONTRACTED_RATE = Decimal("0.0200")
GST_RATE = Decimal("0.18")
TOLERANCE = Decimal("1.00")
FEE_ROUNDING_ALLOWANCE = Decimal("0.02")
RATE_MARGIN = Decimal("0.0005")

# --- rate cards and rules (fixed values) ---
SYSTEMATIC_MIN_ROWS = 3
SYSTEMATIC_MIN_SHARE = 0.5
STALE_RULE_MIN_ROWS = 2
ALIAS_MIN_DIGITS = 6
ALIAS_MAX_DIGITS = 24
MAX_EXTRA_LAG_DAYS = 5

# --- matching (fixed values) ---
UTR_REGEX = r"\bUTR\d{6,}\b"
ANY_REFERENCE_REGEX = r"\d{6,}"
WINDOW_DAYS = 4
SUBSET_MAX_WINDOW = 12
UNSETTLED_HORIZON_DAYS = 7
UNSETTLED_BATCH = "UNSETTLED"

# --- first-digit screen (fixed values) ---
BENFORD_MIN_SAMPLE = 150
BENFORD_EXCESS = 1.5
BENFORD_NULL_N = 500
# 99th percentile of the mean absolute deviation of 500 Benford draws.
BENFORD_NULL_MAD = 0.018154999829491723
NIGRINI_BANDS = ((0.006, "close"), (0.012, "acceptable"), (0.015, "marginal"))

# --- proposals (fixed values) ---
CONFIDENCE_FLOOR = 0.60
PROPOSALS_PER_100 = 5.0
MAX_REFUSAL_STREAK = 12
PROPOSAL_CHUNK = 4
MAX_ADJUSTMENT_SHARE = Decimal("0.25")

# --- triage, forecast, sign-off, aging, scoring (fixed values) ---
MATERIALITY_FLOOR = Decimal("500.00")
MATERIALITY_AGGREGATE = Decimal("5000.00")
SWEEP_FLOORS = tuple(
    Decimal(v)
    for v in ("50.00", "100.00", "250.00", "500.00", "1000.00", "2500.00", "5000.00", "10000.00")
)
MIN_LAG_OBSERVATIONS = 8
LAG_BAND = (10, 50, 90)
MIN_COVERAGE = 0.65
MIN_MATCHED_SHARE = 0.50
MAX_UNATTRIBUTED_SHARE = 0.33
MAX_QUEUE = 40
STALE_AFTER = 3
REVIEW_MINUTES = 4.0
AUTO_CLEAR_PRECISION = 0.99

# --- names (fixed values) ---
TXN_TYPES = ("payment", "refund", "adjustment", "chargeback_hold")
DEFECT_CLASSES = (
    "duplicate_capture",
    "cross_cycle_refund",
    "fee_overcharge",
    "missing_utr",
    "narration_drift",
    "timing_shift",
    "split_settlement",
    "unrecorded_adjustment",
    "missing_ledger_entry",
    "unsettled_revenue",
    "chargeback_hold",
    "fabricated_amounts",
)
L0, L1, L2, L3 = "L0_exact", "L1_fuzzy", "L2_learned_rule", "L3_llm"
LAYERS = (L0, L1, L2, L3)
STANDING_KINDS = ("unknown_rate_card", "fabricated_amounts", "stale_rule", "missing_source")
IDENTITY_DIMENSIONS = ("method", "rule_id", "bank", "source", "segment")
RULE_PARAMS = {
    "bank_timing": ("bank", "offset_days"),
    "narration_alias": ("marker", "prefix"),
    "fee_variant": ("method", "rate"),
    "adjustment_pattern": ("keyword", "category"),
}

# Column aliases seen in exports, first match wins (fixed values).
HEADER_ALIASES = {
    "txn_id": ("txn_id", "transaction_id", "payment_id", "id", "entity_id"),
    "settlement_batch_id": ("settlement_batch_id", "settlement_id", "batch_id", "payout_id"),
    "utr": ("utr", "bank_reference", "bank_ref_no", "reference", "rrn"),
    "txn_type": ("txn_type", "type", "entity_type", "transaction_type"),
    "gross_amount": ("gross_amount", "amount", "gross", "transaction_amount"),
    "fee": ("fee", "fees", "commission", "mdr"),
    "gst_on_fee": ("gst_on_fee", "gst", "tax", "gst_amount"),
    "settled_on": ("settled_on", "settlement_date", "settled_at", "date"),
    "order_id": ("order_id", "order", "receipt", "merchant_order_id"),
    "method": ("method", "payment_method", "instrument"),
    "bank_txn_id": ("bank_txn_id", "statement_id", "txn_ref", "id"),
    "credit_amount": ("credit_amount", "credit", "amount", "deposit"),
    "value_date": ("value_date", "date", "posting_date", "txn_date"),
    "narration": ("narration", "description", "particulars", "remarks"),
    "created_at": ("created_at", "date", "order_date", "created"),
    "status": ("status", "state"),
}
# Date spellings in the order they are tried (fixed values).
DATE_PATTERNS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
)

# Phrases that do not belong in a bank narration (fixed values).
INJECTION_PATTERNS = (
    ("instruction_override",
     r"(?id)\b(ignore|disregard|forget)\b.{0,20}\b(previous|prior|above|all)\b"),
    ("role_switch",
     r"(?i)\b(you are now|act as|system prompt|as an ai|new instructions?)\b"),
    ("directive",
     r"(?id)\b(mark|treat|classify|report)\b.{0,30}\b(as )?(reconciled|matched|clean|resolved)\b"),
    ("confidence_forcing",
     r"(?id)\b(confidence|certainty)\b.{0,15}\b(1\.0|100%|maximum|highest)\b"),
    ("delimiter_break",
     r"(?i)(```|\"\"\"|</?\s*(system|instructions?|prompt)\s*>)"),
    ("json_injection",
     r"(?i)\"\s*(defect_class|bank_txn_ids|confidence)\s*\"\s*:"),
)
MAX_NARRATION = 160
BANK_NAMES = (("HDFC", "HDFC"), ("ICICI", "ICICI"), ("AXIS", "AXIS"), ("SBI", "SBI"),
              ("KOTAK", "KOTAK"), ("KKBK", "KOTAK"))
RECON_TYPES = {"payment": "payment", "refund": "refund",
               "adjustment": "adjustment", "transfer": "adjustment"}
RECON_TRUE = ("true", "1", "yes", "y", "t")
RECON_COLUMNS = (
    "entity_id", "type", "debit", "credit", "amount", "currency", "fee", "tax", "on_hold",
    "settled", "created_at", "settled_at", "settlement_id", "posted_at", "description",
    "notes", "payment_id", "settlement_utr", "order_id", "order_receipt", "method",
    "card_network", "card_issuer", "card_type", "dispute_id",
)
RECON_SIGNATURE = ("entity_id", "settlement_utr", "on_hold")
