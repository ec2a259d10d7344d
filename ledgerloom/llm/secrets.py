"""Secrets in texts, and credentials whose parts only tell something together.

Three base kinds stand alone: an assigned secret, an access identifier, a long
hexadecimal run. Weaker parts (identifiers, secret-looking values, endpoints) are
candidates. They are reported where complementary parts start within ``SCOPE`` code
points in the same text: a secret-looking value near an identifier, an identifier near
a secret, an endpoint near both. The search for partners is an interval join on cells
of ``SCOPE`` code points: cells are reduced to their first and last part of a role
before the join, so a candidate meets at most three rows per role whatever a text holds.
Places and overlaps are running sums and maxima over a text's matches, so the work is in
proportion to their number.

Everything is DataFrame expressions. Spans are code points, the end exclusive.

Edge cases: a null text is an empty one and has no spans; the digest of no spans is that
of the empty string; repeated rows each get their result, whatever their ids; texts of
any length are searched whole; an empty table gives an empty table; only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.scale import materialise
from .places import numbered

SCOPE = 256
# Code points of a block when a text is put together again.
BLOCK = 256

BEFORE_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
# Base kinds, in the order in which they are listed at one place.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)" + BEFORE_VALUE
          + r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
# Weaker parts: kind, role, pattern.
PARTS = (
    ("weak_assign", "secret", r"(?i:pwd|passphrase|pass|auth|bearer|credential|access_key|"
     r"private_key|client_secret)" + BEFORE_VALUE + r"[A-Za-z0-9+/_.=-]{6,}"),
    ("opaque", "secret", r"[A-Za-z0-9+/_-]{32,}={0,2}"),
    ("ident", "identifier", r"(?i:access_?key_?id|client_?id|account|username|user|login)"
     + BEFORE_VALUE + r"[A-Za-z0-9_.@+-]{3,}"),
    ("short_access", "identifier", r"AKIA[A-Z0-9]{8,}"),
    ("endpoint", "endpoint", r"(?i:https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp)"
     r"""://[^\x20\x09-\x0D"'<>]+"""),
)
KINDS = (*BASE, *(kind for kind, _, _ in PARTS))
SPAN = "array<struct<start:bigint,stop:bigint,kind:string,role:string>>"
ROLES = dict(zip(BASE, ("secret", "identifier", "secret"))) | {kind: role for kind, role, _ in PARTS}
HITS = "array<struct<kind:string,place:int,gap:bigint,n:bigint,keep:boolean>>"


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches in order: length and that of the text before each.

    ``keep`` says by a match's string whether it counts; the others only move the places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.arrays_zip(found.alias("hit"), F.slice(between, 1, F.size(found)).alias("gap"))
    hits = F.transform(pieces, lambda piece, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), F.length(piece["gap"]).cast("long").alias("gap"),
        F.length(piece["hit"]).cast("long").alias("n"),
        (F.lit(True) if keep is None else keep(piece["hit"])).alias("keep")))
    return F.coalesce(F.when(text.rlike(pattern), hits), F.array()).cast(HITS)


def with_hits(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``_hits``, the matches of all kinds; one scan over the text."""
    def long_value(hit):
        return F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 6

    def mixed(hit):
        return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")

    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("_hits", F.concat(
        matches(whole, ASSIGN, "assign", long_value), matches(whole, ACCESS, "access"),
        matches(whole, HEX, "hex"),
        *[matches(whole, pattern, kind, mixed if kind == "opaque" else None)
          for kind, _, pattern in PARTS]))


def placed(rows: DataFrame, row: str = "_row") -> DataFrame:
    """``row``, ``start``, ``stop``, ``kind``, ``role``: base spans, and candidates that overlap none.

    Places are running sums over the matches of a kind. A candidate overlaps a base span when
    the furthest end of those that start before its own end lies behind its start, a running
    maximum. Both read a text's spans once, in order.
    """
    so_far = W.rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = rows.select(row, F.explode("_hits").alias("_h")).select(row, "_h.*")
    stop = F.sum(F.col("gap") + F.col("n")).over(
        so_far.partitionBy(row, "kind").orderBy("place"))
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    spans = hits.withColumn("stop", stop).filter("keep").select(
        row, (F.col("stop") - F.col("n")).alias("start"), "stop", "kind", role[F.col("kind")].alias("role"))
    base = F.col("kind").isin(*BASE)
    # At one place a candidate's end comes before a base span's start: they only touch.
    furthest = F.max(F.when(base, F.col("stop"))).over(so_far.partitionBy(row).orderBy(
        F.when(base, F.col("start")).otherwise(F.col("stop")), base))
    return spans.withColumn("_furthest", furthest).filter(
        base | F.coalesce(F.col("_furthest") <= F.col("start"), F.lit(True))).drop("_furthest")


def linked(spans: DataFrame, row: str = "_row", scope: int = SCOPE) -> DataFrame:
    """The candidates among ``spans`` that have their complementary parts in scope.

    ``row`` must be unique to a text.
    """
    spans = spans.withColumn("cell", F.floor(F.col("start") / scope))
    cells = spans.groupBy(row, "role", "cell").agg(F.min("start").alias("first"),
                                                   F.max("start").alias("last"))
    candidates = spans.filter(~F.col("kind").isin(*BASE))
    asks = candidates.select(row, "start", "stop", "kind", F.col("role").alias("own"),
                             F.col("cell").alias("home"),
                             F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"))
    near = (F.col("cell") == F.col("home")) \
        | ((F.col("cell") < F.col("home")) & (F.col("last") >= F.col("start") - scope)) \
        | ((F.col("cell") > F.col("home")) & (F.col("first") <= F.col("start") + scope))
    met = (asks.join(cells, [row, "cell"]).filter(near & (F.col("role") != F.col("own")))
           .groupBy(row, "start", "stop", "kind", "own")
           .agg(F.bool_or(F.col("role") == "secret").alias("by_secret"),
                F.bool_or(F.col("role") == "identifier").alias("by_identifier")))
    told = (F.when(F.col("own") == "secret", F.col("by_identifier"))
            .when(F.col("own") == "identifier", F.col("by_secret"))
            .otherwise(F.col("by_identifier") & F.col("by_secret")))
    return met.filter(told).select(row, "start", "stop", "kind", F.col("own").alias("role"))


def told_spans(rows: DataFrame, row: str = "_row", scope: int = SCOPE) -> DataFrame:
    """All spans to report for rows with ``_hits``: base ones and linked candidates."""
    spans = materialise(placed(rows, row), "secret_spans")
    return spans.filter(F.col("kind").isin(*BASE)).unionByName(linked(spans, row, scope))


def in_order(spans: Column) -> Column:
    """Spans by start, at one start in the order of the kinds."""
    place = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["stop"].alias("stop"),
        s["kind"].alias("kind")))
    return F.array_sort(keyed)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["stop"])), ",")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``key``, ``base`` and ``spans`` (base and linked) of every row."""
    parts = materialise(
        with_hits(df.select(F.col(key), F.col(text)), text).drop(text)
        .withColumn("_row", F.monotonically_increasing_id()), "secret_parts")
    span = F.struct("start", "stop", "kind", "role")
    lists = told_spans(parts, scope=scope).groupBy("_row").agg(
        F.collect_list(F.when(F.col("kind").isin(*BASE), span)).alias("base"),
        F.collect_list(span).alias("spans"))
    none = F.array().cast(SPAN)
    return parts.select("_row", key).join(lists, "_row", "left").select(
        key, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def stretches(spans: DataFrame, row: str) -> DataFrame:
    """``row`` and ``_cuts``: the stretches its spans cover, sorted and disjoint."""
    order = W.partitionBy(row).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("_before") > F.col("start"), 0).otherwise(1)).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (spans.withColumn("_before", before).withColumn("_part", part).groupBy(row, "_part")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cuts")))


def redacted(text: Column, cuts: Column, mark: str = "[REMOVED]") -> Column:
    """The text with every stretch of code points in ``cuts`` replaced by a mark.

    The text is cut into blocks once; what is kept between two stretches is taken from the
    blocks it lies in, so the work is in proportion to the text and the stretches.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def kept(v, i):
        start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(v["cuts"], i - 1)["stop"])
        stop = F.coalesce(F.get(v["cuts"], i)["start"], v["size"])
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(stop / BLOCK).cast("int")
        near = F.array_join(F.slice(v["blocks"], first + 1, last - first + 1), "")
        return near.substr((start % BLOCK + 1).cast("int"), (stop - start).cast("int"))

    # One element: its parts are worked out once and then named by the inner function.
    whole = F.array(F.struct(blocks.alias("blocks"), cuts.alias("cuts"),
                             F.length(text).cast("long").alias("size")))
    joined = F.transform(whole, lambda v: F.array_join(
        F.transform(F.sequence(F.lit(0), F.size(v["cuts"])), lambda i: kept(v, i)), mark))
    return F.get(joined, F.lit(0))


def redact(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The rows with their secrets replaced in ``text``; other columns stay.

    Only rows with spans are looked up again, by their number in the table.
    """
    packed, _ = numbered(df)
    row = packed.select("_number", F.col("_all")[text].alias("_text"))
    some = materialise(with_hits(row, "_text").select("_number", "_hits")
                       .filter(F.size("_hits") > 0), "secret_parts")
    cuts = materialise(stretches(told_spans(some, "_number", scope), "_number"), "secret_cuts")
    clean = F.when(F.col("_cuts").isNull(), F.col("_all")[text]).otherwise(
        redacted(F.col("_all")[text], F.col("_cuts")))
    return (packed.join(cuts, "_number", "left")
            .select(F.col("_all").withField(text, clean).alias("_all")).select("_all.*"))


def _sql_spans(pattern: str, kind: str, role: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT d.row_no, '{kind}' AS kind, '{role}' AS role,
           list_sum([length(x) FOR x IN gaps[1:i]])::BIGINT
             + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)::BIGINT AS start,
           length(hits[i]) AS n, hits[i] AS hit
    FROM (SELECT row_no, regexp_extract_all(text, '{p}') AS hits,
                 regexp_split_to_array(text, '{p}') AS gaps FROM d) d,
         LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
    WHERE {keep}"""


def oracle() -> str:
    """The query over ``documents`` in SQL, partners found by comparing parts of a text."""
    value = ASSIGN.replace("'", "''")
    base = [_sql_spans(ASSIGN, "assign", "secret",
                       f"length(regexp_extract(hits[i], '{value}', 1)) >= 6"),
            _sql_spans(ACCESS, "access", "identifier"), _sql_spans(HEX, "hex", "secret")]
    mixed = " AND ".join(f"regexp_matches(hits[i], '[{c}]')" for c in ("0-9", "A-Z", "a-z"))
    weak = [_sql_spans(p, kind, role, mixed if kind == "opaque" else "true")
            for kind, role, p in PARTS]
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    union = "\n UNION ALL ".join

    def near(role):
        return (f"EXISTS (SELECT 1 FROM parts p WHERE p.row_no = w.row_no AND p.role = '{role}' "
                f"AND abs(p.start - w.start) <= {SCOPE})")

    def digest(rows):
        return (f"SELECT row_no, string_agg(kind || ':' || start || ':' || (start + n), ',' "
                f"ORDER BY start, {order}) AS s FROM {rows} GROUP BY row_no")

    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({union(base)}),
loose AS MATERIALIZED ({union(weak)}),
weak AS MATERIALIZED (SELECT * FROM loose w WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.row_no = w.row_no AND b.start < w.start + w.n
    AND w.start < b.start + b.n)),
parts AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM weak),
told AS (SELECT * FROM base UNION ALL SELECT * FROM weak w WHERE CASE role
  WHEN 'secret' THEN {near('identifier')} WHEN 'identifier' THEN {near('secret')}
  ELSE {near('identifier')} AND {near('secret')} END),
b AS ({digest('base')}), t AS ({digest('told')}),
n AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign,
      count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
      FROM base GROUP BY row_no)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256,
       coalesce(t.s, '') AS spans
FROM d LEFT JOIN b USING (row_no) LEFT JOIN t USING (row_no) LEFT JOIN n USING (row_no)"""
