"""The three sources as CSV: drifting headers, rows that fail one by one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import constants as K, schemas as S
from ..operators.scale import in_writing_order, materialise


def normalise_header(name: str) -> str:
    """Lower case with every run of separators as one underscore."""
    return re.sub(r"_+", "_", re.sub(r"[ \-./]", "_", (name or "").strip().lower())).strip("_")


def read_raw(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """All columns as text, plus the file, the record's line in it and its place in all files.

    ``_line`` counts records of a file, the header being line one; ``_place`` goes on over
    the files in writing order, so it is unique and keeps the order in which part files of one
    table were written. Splits are numbered by themselves and shifted by what is before
    them.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"',
                         multiLine=multi_line, enforceSchema=False)
    seen, names = {}, []
    for name in raw.columns:
        key = normalise_header(name.lstrip("﻿"))
        seen[key] = seen.get(key, 0) + 1
        names.append(key if seen[key] == 1 else f"{key}__{seen[key]}")
    rows = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(raw.columns, names)],
                      F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_id"))
    rows = materialise(rows, "csv")
    blocks = rows.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    overall = W.orderBy(*in_writing_order("_file"), "_block").rowsBetween(W.unboundedPreceding, -1)
    # One row per file split, which the driver lists anyway; the rows stay where they are.
    shifts = materialise(blocks.withColumns({
        "_shift": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_earlier": F.coalesce(F.sum("_n").over(overall), F.lit(0))}), "splits")
    within = F.col("_id") - F.col("_first") + 2
    return rows.join(F.broadcast(shifts), ["_file", "_block"]).withColumns({
        "_line": within + F.col("_shift"), "_place": within + F.col("_earlier")}).drop(
        "_id", "_first", "_n", "_shift", "_earlier", "_block")


def pick(df: DataFrame, field: str) -> Column:
    """The first alias of a field that this row fills in; repeated headers use the last."""
    found = []
    for alias in K.HEADER_ALIASES.get(field, (field,)):
        same = [c for c in df.columns if c == alias or c.startswith(f"{alias}__")]
        if same:
            text = F.trim(F.col(same[-1]))
            found.append(F.when(text != "", text))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def money(raw: Column) -> tuple[Column, Column]:
    """An amount as exports write it, and whether it could not be read."""
    text = F.trim(F.regexp_replace(raw, r",|₹|INR", ""))
    bracketed = text.startswith("(") & text.endswith(")")
    bare = F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    value = F.bround(F.trim(bare).try_cast("decimal(38,10)"), 2).cast(S.MONEY)
    signed = F.when(bracketed, -value).otherwise(value)
    blank = raw.isNull() | (bare == "")
    return F.when(blank, F.lit("0.00").cast(S.MONEY)).otherwise(signed), ~blank & value.isNull()


def day(raw: Column) -> Column:
    """The first of five date spellings that fits, else null."""
    return F.coalesce(*[F.when(raw.rlike(shape), F.try_to_date(raw, fmt))
                        for shape, fmt in K.DATE_PATTERNS])


def _close(close_id) -> Column:
    return close_id if isinstance(close_id, Column) else F.lit(close_id)


def _first_error(*tests) -> Column:
    error = F.when(F.lit(False), F.lit(""))
    for failed, text in tests:
        error = error.when(failed, F.concat(F.lit("line "), F.col("_line").cast("string"), text))
    return error


def _not_an_amount(raw, field):
    return F.concat(F.lit(f": {field} '"), raw, F.lit("' is not an amount"))


def _not_a_date(raw, field):
    return F.when(raw.isNull(), F.lit(f": {field} is empty")).otherwise(
        F.concat(F.lit(f": {field} '"), raw, F.lit("' is not a recognised date")))


def _split(df: DataFrame, source: str, columns) -> tuple[DataFrame, DataFrame]:
    good = df.filter(F.col("_error").isNull()).select(*columns)
    bad = df.filter(F.col("_error").isNotNull()).select(
        F.lit(source).alias("source"), F.col("_file").alias("file"),
        F.col("_line").alias("line_no"), F.col("_error").alias("error"))
    return good, bad


def _or_line(value: Column, prefix: str) -> Column:
    return F.coalesce(value, F.concat(F.lit(prefix), F.col("_place").cast("string")))


def read_settlement(spark, path, close_id="close", multi_line=False):
    """Settlement rows and the rejects, each with its line and first error."""
    raw = read_raw(spark, path, multi_line)
    kind = F.lower(F.coalesce(pick(raw, "txn_type"), F.lit("payment")))
    amounts = {n: (pick(raw, n), *money(pick(raw, n)))
               for n in ("gross_amount", "fee", "gst_on_fee")}
    settled = pick(raw, "settled_on")
    error = _first_error(
        (~kind.isin(*K.TXN_TYPES),
         F.concat(F.lit(": unknown txn_type '"), kind, F.lit("'"))),
        *[(bad, _not_an_amount(text, n)) for n, (text, _, bad) in amounts.items()],
        (day(settled).isNull(), _not_a_date(settled, "settled_on")))
    typed = raw.select(
        "_file", "_line", error.alias("_error"), _close(close_id).alias("close_id"),
        F.col("_place").alias("line_no"), _or_line(pick(raw, "txn_id"), "row_").alias("txn_id"),
        F.coalesce(pick(raw, "settlement_batch_id"), F.lit("")).alias("settlement_batch_id"),
        pick(raw, "utr").alias("utr"), kind.alias("txn_type"),
        *[value.alias(n) for n, (_, value, _) in amounts.items()],
        day(settled).alias("settled_on"), pick(raw, "order_id").alias("order_id"),
        F.lower(F.coalesce(pick(raw, "method"), F.lit("card"))).alias("method"))
    return _split(typed, "settlement", S.SETTLEMENT.names)


def read_bank(spark, path, close_id="close", multi_line=False):
    raw = read_raw(spark, path, multi_line)
    text = pick(raw, "credit_amount")
    value, bad = money(text)
    when = pick(raw, "value_date")
    error = _first_error((bad, _not_an_amount(text, "credit_amount")),
                         (day(when).isNull(), _not_a_date(when, "value_date")))
    typed = raw.select(
        "_file", "_line", error.alias("_error"), _close(close_id).alias("close_id"),
        F.col("_place").alias("line_no"),
        _or_line(pick(raw, "bank_txn_id"), "bank_").alias("bank_txn_id"),
        value.alias("credit_amount"), day(when).alias("value_date"),
        F.coalesce(pick(raw, "narration"), F.lit("")).alias("narration"),
        pick(raw, "utr").alias("utr"))
    return _split(typed, "bank", S.BANK.names)


def read_ledger(spark, path, close_id="close", multi_line=False):
    """Ledger rows; the amount goes by the names the settlement report uses."""
    raw = read_raw(spark, path, multi_line)
    text = pick(raw, "gross_amount")
    value, bad = money(text)
    when = pick(raw, "created_at")
    error = _first_error((bad, _not_an_amount(text, "amount")),
                         (day(when).isNull(), _not_a_date(when, "created_at")))
    typed = raw.select(
        "_file", "_line", error.alias("_error"), _close(close_id).alias("close_id"),
        F.col("_place").alias("line_no"),
        _or_line(pick(raw, "order_id"), "order_").alias("order_id"),
        F.coalesce(pick(raw, "txn_id"), F.lit("")).alias("txn_id"), value.alias("amount"),
        day(when).alias("created_at"),
        F.coalesce(pick(raw, "status"), F.lit("captured")).alias("status"))
    return _split(typed, "ledger", S.LEDGER.names)


def load_report(loaded: dict[str, DataFrame], rejects: DataFrame) -> DataFrame:
    """Rows loaded and rejected per source."""
    spark = rejects.sparkSession
    out = spark.createDataFrame([(name,) for name in loaded], "source string")
    counts = None
    for name, df in loaded.items():
        part = df.agg(F.count(F.lit(1)).alias("loaded")).withColumn("source", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    failed = rejects.groupBy("source").agg(F.count(F.lit(1)).alias("rejected"))
    return out.join(counts, "source").join(failed, "source", "left").fillna(0)


def load_bundle(spark, settlement, bank, ledger=None, close_id="close", recon=None):
    """The three tables and all rejects; the ledger may be missing.

    ``recon`` states whether the settlement file is a gateway recon export; left out,
    its header decides.
    """
    from .gateway_recon import is_recon, read_recon

    recon = is_recon(spark, settlement) if recon is None else recon
    rows, bad = (read_recon if recon else read_settlement)(spark, settlement, close_id)
    credits, bad_bank = read_bank(spark, bank, close_id)
    rejects = bad.unionByName(bad_bank)
    if ledger is None:
        entries = spark.createDataFrame([], S.LEDGER)
    else:
        entries, bad_ledger = read_ledger(spark, ledger, close_id)
        rejects = rejects.unionByName(bad_ledger)
    return rows, credits, entries, rejects


def period(settlement: DataFrame) -> DataFrame:
    """The month a close covers: that of its earliest settlement date."""
    return settlement.groupBy("close_id").agg(
        F.date_format(F.min("settled_on"), "yyyy-MM").alias("period"))


EXPORTS = {
    "settlement": ("txn_id", "settlement_batch_id", "utr", "txn_type", "gross_amount", "fee",
                   "gst_on_fee", "settled_on", "order_id", "method"),
    "bank": ("bank_txn_id", "credit_amount", "value_date", "narration", "utr"),
    "ledger": ("order_id", "txn_id", "amount", "created_at", "status"),
}


def write_csv(df: DataFrame, source: str, path: str, keep_close: bool = False,
              rows_per_file: int = 0, compression: str = "none") -> None:
    """Canonical columns in line order over the part files, blanks for missing values.

    A compressed file is read by one task, so it should hold few rows.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(""))
               .alias("gross_amount" if source == "ledger" and c == "amount" else c)
               for c in EXPORTS[source]]
    if keep_close:
        columns.insert(0, F.col("close_id"))
    df.orderBy("close_id", "line_no").select(*columns).write.option(
        "maxRecordsPerFile", rows_per_file).csv(path, header=True, emptyValue="", quote='"', escape='"',
                                                compression=compression)
