import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm import queries, secrets

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                          r"""([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKEY1"


def plain_base(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p, ok) in enumerate(BASE)
             for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def found(df):
    rows = secrets.find(df).select("doc_id", secrets.as_text(F.col("base")).alias("base"),
                                   secrets.as_text(F.col("spans")).alias("spans")).collect()
    return [(r.doc_id, r.base, r.spans) for r in rows]


TEXTS = [
    None, "", "nothing to see, tokens are fine",
    "token = 'abc' token: abcdef", "secret: token: abcdef12", "PASSWORD=hunter2hunter2 é",
    "é日 api_key=\"Zq-9_.=/+a\" AKIA" + "A1" * 8 + " " + "0f" * 12, "0f" * 11 + "F" + "0f" * 12,
    "AKIAAKIA" + "Z" * 12, "apikey : sk1234567 " * 40, "x" * 50_000 + " passwd=abcdefg",
]


def test_base_spans_against_a_plain_search(docs):
    df = docs(TEXTS).selectExpr("*", "1 AS _base", "2 AS spans", "3 AS _row")
    assert {(i, b) for i, b, _ in found(df)} == {(i, plain_base(t)) for i, t in enumerate(TEXTS)}
    assert found(df.limit(0)) == []


def test_weak_parts_only_where_they_co_occur(docs):
    far = " filler" * 60
    texts = [
        f"value {KEY} alone",
        f"access_key_id: AKIA{'Q' * 16} then {KEY}",
        f"user = bob and {KEY}",
        f"user = bob{far} and {KEY}",
        "user = bob at https://db.example.com/x",
        "user = bob pwd: s3cret99 at https://db.example.com/x",
        "see https://db.example.com/x token=abcdef9",
        "AKIASHORT123 near pass=qwerty9",
    ]
    kinds = {i: [s.split(":")[0] for s in spans.split(",") if s] for i, _, spans in found(docs(texts))}
    assert kinds == {
        0: [], 1: ["access", "opaque"], 2: ["ident", "opaque"], 3: [], 4: [],
        5: ["ident", "weak_assign", "endpoint"], 6: ["assign"], 7: ["short_access", "weak_assign"]}


def test_scope_edge_and_repeated_rows(docs):
    texts = [f"user = bob{' ' * gap}pwd=abcdef" for gap in range(240, 254)]
    rows = found(docs(texts * 2, ids=[1] * 2 * len(texts)))
    starts = [10 + gap for gap in range(240, 254)]
    assert sorted(bool(s) for _, _, s in rows) == sorted([a <= secrets.SCOPE for a in starts] * 2)


def test_many_parts_in_one_text(docs):
    text = f"user = bob pwd={'a' * 8} " * 2000
    (_, _, spans), = found(docs([text]))
    assert len(spans.split(",")) == 4000


def test_redaction_keeps_the_rest(docs):
    texts = ["a token=abcdef1234567890abcdef123456 b", f"user = bob, {KEY}!", "clean é text", None, ""]
    df = docs(texts).withColumn("extra", F.lit(1))
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        0: "a [REMOVED] b", 1: "[REMOVED], [REMOVED]!", 2: "clean é text", 3: None, 4: ""}


def test_sql_says_the_same(spark, docs, tmp_path):
    ids = list(range(len(TEXTS)))
    docs(TEXTS + [f"login: me {KEY} s3://bucket/x"], ids=[*ids, 99]).write.parquet(
        f"{tmp_path}/documents.parquet")
    for sf, part in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.01", "")):
        rows = queries.QUERIES["op2_credential_links"](spark, sf).collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet{part}'")
        columns = "doc_id, n_assign, n_access, n_hex, base_sha256, spans"
        told = con.execute(f"SELECT {columns} FROM ({queries.SQL['op2_credential_links']})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(told)
        texts = {r[0]: r[1] for r in con.execute("SELECT doc_id, text FROM documents").fetchall()}
        for r in rows:
            assert r.base_sha256 == hashlib.sha256(plain_base(texts[r.doc_id]).encode()).hexdigest()


def test_work_is_linear_in_the_secrets_of_a_text(docs):
    n = 50_000
    text = "token=abcdef é " * n
    (_, base, spans), = found(docs([text]))
    assert base == spans == ",".join(f"assign:{i * 15}:{i * 15 + 12}" for i in range(n))
    (row,) = secrets.redact(docs([text])).collect()
    assert row.text == "[REMOVED] é " * n


def test_redaction_joins_overlaps_and_keeps_long_stretches(docs):
    between = "é\n" * 3000
    text = f"token={'0f' * 20}{between}AKIA{'A1' * 10} pwd=\U0001F600 password=abcdefg"
    (row,) = secrets.redact(docs([text])).collect()
    assert row.text == f"[REMOVED]{between}[REMOVED] pwd=\U0001F600 [REMOVED]"
