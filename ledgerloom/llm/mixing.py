"""Mixing sources to target weights along a curriculum.

A source's weight changes over the training run. Its schedule is a straight line whose
integral over the run is the source's target, so what a source has given up to time t is
a parabola; inverting it gives the time at which a word is due. Every copy of a document
is placed at the time its middle word is due, and a range sort by time makes the order.

Targets: sources share a stated fraction of all words by weight; a target stops at a
stated multiple of the source's size and the rest is shared again by weight. This is one
water level L with target = min(cap, weight * L), found from running sums over sources.

A source takes whole passes over its documents and then documents in the order of a hash
of their id until its target is reached; the last one gives its first words only. The
running sums are taken inside buckets of the hash and the buckets are added up, so a
source with a third of all rows is no task of its own.

Edge cases: a null or blank text has size 0, takes nothing and has no position; a source
without words has target 0; the null source is a source of its own and the last; a null
id is hashed like the empty text; rows equal in id and size are interchangeable; one
source, no rows and any other columns are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.scale import materialise
from .places import numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2.0
WORD = r"[^\x20\x09-\x0D]+"
# Hexadecimal digits of the hash that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
# A source's schedule rises or falls by up to this part of its mean weight: the first
# source starts strong and fades, the last one comes late.
TILT = 0.8


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE,
            most: float = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``slope`` from one row per source.

    ``slope`` runs from -TILT for the first source to TILT for the last one.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    everything = W.partitionBy()
    ranked = sources.select(
        "*", (F.row_number().over(by_name) - 1).alias("place"),
        F.count("*").over(everything).alias("n"),
        F.sum("source_size").over(everything).alias("total"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(most)})
    # In the order in which sources reach their cap, what is capped before and the weight
    # that is left give the level if this source were the first not to reach it.
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "place")
    level = (F.lit(share) * F.col("total")
             - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
             ) / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    levels = capped.withColumn("level", level)
    # The level holds for the first source whose cap is not below it.
    holds = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(
        F.col("cap") / F.col("weight"), F.col("place"), F.col("level"))))
    found = levels.withColumn("level", F.element_at(
        F.array(holds.over(everything)["level"]), 1))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    slope = F.when(F.col("n") > 1, F.lit(TILT) * (2.0 * F.col("place") / (F.col("n") - 1) - 1.0)
                   ).otherwise(0.0)
    return found.select("source", "source_size", target.alias("target"), slope.alias("slope"))


def due(part, slope):
    """Time in the run at which ``part`` of a source's words have been given.

    The weight at time t is 1 + slope * (2t - 1) of its mean; its integral is
    t * (1 - slope) + slope * t * t, which is inverted here without cancellation.
    """
    fall = 1.0 - slope
    return 2.0 * part / (fall + F.sqrt(fall * fall + 4.0 * slope * part))


def sized(df: DataFrame, key: str, text: str, source: str, carry: tuple[str, ...]) -> DataFrame:
    """Narrow rows: id, source, words, and the hash that orders and buckets documents."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    turn = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return materialise(df.select(F.col(key).alias("_id"), F.col(source).alias("source"),
                                 words.alias("size"), turn.alias("turn"), *carry), "mix_sizes")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target``, ``taken`` and ``starts`` of every row.

    ``starts`` holds, for each copy taken, its words and the time of its middle. Columns
    named in ``carry`` are passed on.
    """
    rows = sized(df, key, text, source, carry).withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sources, weights, share, most)
    earlier = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    placed = materialise(
        buckets.select("source", "bucket", earlier.alias("earlier"))
        .join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source"), "mix_buckets")
    inside = F.sum("size").over(
        W.partitionBy("source", "bucket").orderBy("turn", "size")
        .rowsBetween(W.unboundedPreceding, -1))
    local = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    # At most 4,096 rows per source on the right; its size decides how Spark joins.
    told = local.join(
        placed.withColumnsRenamed({"source": "_source", "bucket": "_bucket"}),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    start = F.col("earlier") + F.col("inside")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long")
    counted = told.withColumn("start", start).withColumn("passes", passes.cast("long")).withColumn(
        "part", part)
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda n: F.struct(F.when(n < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"),
                           (n * F.col("source_size") + F.col("start")).alias("offset")))
    timed = F.transform(
        F.filter(copies, lambda c: c["words"] > 0),
        lambda c: F.struct(c["words"].alias("words"), due(
            (c["offset"] + c["words"] / F.lit(2.0)) / F.col("target"), F.col("slope")).alias("position")))
    return counted.select(
        F.col("_id").alias(key), "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), timed.alias("starts"), *carry)


def curriculum(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               **options) -> DataFrame:
    """Training order: a row per copy with its ``words`` and ``position``, range sorted."""
    mixed = mix(df, key, text, source, **options)
    return (mixed.select(key, F.explode("starts").alias("c")).select(key, "c.*")
            .orderBy("position", key, "words"))


def schedule(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             **options) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target``, ``taken``, ``first_position``,
    ``first_place`` and ``last_place`` of every row, read off the training order.

    Places are those of the row's first and last copy in the range-sorted curriculum, from
    0. Copies due at the same time go by key, null first, and then by words. A row that is
    not taken has no position and no place.
    """
    packed, _ = numbered(df.select(*dict.fromkeys((key, text, source))))
    mixed = materialise(mix(packed.select("_number", "_all.*"), key, text, source,
                            carry=("_number",), **options), "mixed")
    # Part files are in the order of the sort, so a copy's number is its place.
    order = materialise(
        mixed.select(F.col(key).alias("_id"), "_number", F.explode("starts").alias("c"))
        .select("_id", F.col("_number").alias("_row"), "c.*").orderBy("position", "_id", "words"), "curriculum")
    ranked, _ = numbered(order)
    found = ranked.groupBy(F.col("_all._row").alias("_number")).agg(
        F.sum("_all.words").alias("_taken"), F.min("_all.position").alias("first_position"),
        F.min("_number").alias("first_place"), F.max("_number").alias("last_place"))
    return mixed.drop("taken").join(found, "_number", "left").select(
        key, "size", "source_size", "target", F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"),
        "first_position", "first_place", "last_place")


def mixture(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            **options) -> DataFrame:
    """The mixed rows themselves in training order: whole rows, as often as they are taken.

    A copy that is taken in part keeps its first words and the white space between them.
    """
    packed, _ = numbered(df)
    narrow = packed.select("_number", *[F.col("_all")[c].alias(c) for c in dict.fromkeys((key, text, source))])
    copies = (mix(narrow, key, text, source, carry=("_number",), **options)
              .select("_number", "size", F.explode("starts").alias("c"))
              .select("_number", "size", "c.words", "c.position"))
    own = F.col("_all")[text]
    pieces = F.regexp_extract_all(own, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(
        F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")).otherwise(own)
    return (packed.join(copies, "_number").orderBy("position", "_number")
            .select(F.col("_all").withField(text, cut).alias("_all")).select("_all.*"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS turn,
  CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * {MOST_REPEATS} AS cap,
      row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place, count(*) OVER () AS n
      FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
      sum(source_size) OVER ()::DOUBLE AS total FROM s),
v AS (SELECT *, ({SHARE}::DOUBLE * total - coalesce((SELECT sum(b.cap) FROM w b
        WHERE (b.cap / b.weight, b.place) < (a.cap / a.weight, a.place)), 0))
      / (SELECT sum(b.weight) FROM w b
         WHERE (b.cap / b.weight, b.place) >= (a.cap / a.weight, a.place)) AS level FROM w a),
l AS (SELECT arg_min(level, cap / weight) AS level FROM v WHERE cap >= weight * level),
t AS (SELECT source, source_size, place, n, least(cap, weight * l.level) AS target,
      CASE WHEN source_size > 0 THEN floor(least(cap, weight * l.level) / source_size) ELSE 0 END
        ::BIGINT AS passes FROM v, l),
o AS (SELECT row_number() OVER () AS row_no, d.doc_id, d.size, t.source_size, t.target, t.passes,
      CASE WHEN t.n > 1 THEN {TILT}::DOUBLE * (2::DOUBLE * t.place / (t.n - 1) - 1::DOUBLE)
        ELSE 0::DOUBLE END AS slope,
      floor(t.target)::BIGINT - t.passes * t.source_size AS rest,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN pass < passes THEN size ELSE greatest(0, least(size, rest - start)) END AS words
      FROM (SELECT *, unnest(range(passes + 1)) AS pass FROM o)),
m AS (SELECT *, 2::DOUBLE * part / (1::DOUBLE - slope + sqrt(
        (1::DOUBLE - slope) * (1::DOUBLE - slope) + 4::DOUBLE * slope * part)) AS position
      FROM (SELECT *, (pass * source_size + start + words / 2::DOUBLE) / target AS part
            FROM c WHERE words > 0)),
r AS (SELECT *, row_number() OVER (ORDER BY position, doc_id NULLS FIRST, words) - 1 AS place FROM m),
f AS (SELECT row_no, min(position) AS first_position, min(place) AS first_place,
             max(place) AS last_place FROM r GROUP BY row_no)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, rest - start)))::BIGINT AS taken,
       first_position, first_place, last_place FROM o LEFT JOIN f USING (row_no)"""
