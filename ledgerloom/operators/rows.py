"""Shaping of findings and exceptions into their common tables."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas as S


def text_map(**entries) -> Column:
    """A string map of the given columns, entries without a value left out."""
    filled = F.create_map(*[
        part for name, value in entries.items()
        for part in (F.lit(name), value.cast("string"))
    ])
    return F.map_filter(filled, lambda _, value: value.isNotNull())


def _said(defect_class, subject, layer, confidence, impact, evidence, rank, rule_id=None) -> list:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [
        F.lit(defect_class).alias("defect_class"),
        subject.alias("subject_id"), as_col(layer).alias("layer"),
        as_col(confidence).cast("double").alias("confidence"),
        as_col(impact).cast(S.TOTAL).alias("money_impact"),
        (F.lit(None) if rule_id is None else rule_id).cast("string").alias("rule_id"),
        evidence.alias("evidence"), F.lit(rank).cast("int").alias("check_rank"),
    ]


def finding(rows: DataFrame, *said) -> DataFrame:
    """One finding per row: class, subject, layer, confidence, money, evidence, rank and rule."""
    return rows.select("close_id", *_said(*said), F.col("line_no").cast("long").alias("line_no"))


def findings_of(rows: DataFrame, *kinds) -> DataFrame:
    """Findings of several kinds in one pass: each kind is a condition on a row, then what
    ``finding`` takes."""
    each = F.array(*[F.when(applies, F.struct(*_said(*said))) for applies, *said in kinds])
    return rows.select("close_id", F.inline(F.array_compact(each)),
                       F.col("line_no").cast("long").alias("line_no"))


def exception(rows: DataFrame, kind, subject, context, reason, rank) -> DataFrame:
    return rows.select(
        "close_id", F.lit(kind).alias("kind"), subject.alias("subject_id"),
        context.alias("context"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        F.lit(rank).cast("int").alias("check_rank"),
        F.col("line_no").cast("long").alias("line_no"),
    )


def union_all(frames) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


