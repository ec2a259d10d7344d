import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, secrets
from tests.llm.plain import smallest_reachable
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import alike, plain_shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mixture(docs):
    """(doc_id, text) of every copy; documents are (doc_id, source, text)."""
    sources = defaultdict(list)
    for d in docs:
        sources[d[1]].append(d)
    size = {d[0]: len(WORD.findall(d[2])) for d in docs}
    target = plain_targets({s: sum(size[d[0]] for d in rows) for s, rows in sources.items()})
    out = []
    for s, rows in sources.items():
        rows.sort(key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest())
        left = int(target[s])
        while left > 0:
            for i, _, text in rows:
                take = min(left, size[i])
                if take:
                    ends = [m.end() for m in WORD.finditer(text)]
                    out.append((i, text if take == size[i] else text[:ends[take - 1]]))
                left -= take
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_stage_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, rows = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
        if name != "byte-level bpe":
            assert rows.schema.names == docs.schema.names
            rows = spark.createDataFrame(rows.collect(), docs.schema)
        tables.append(rows)
    raw, good, single, clean, mix, coded = (t.collect() for t in tables)
    # Quality: the labels agree with what went, clean documents stay.
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    right = [(r.doc_id in kept) == bool(label[r.doc_id]) for r in raw if r.doc_id in label]
    assert sum(right) >= 0.95 * len(right) and set(good) <= set(raw)
    # Near copies: the smallest id of each component; hardly any is missed, no other text goes.
    good.sort(key=lambda r: r.doc_id)
    shingles = [plain_shingles(r.text) for r in good]
    root = smallest_reachable(shingles, lambda i, j: alike(shingles[i], shingles[j]))
    want = {r for i, r in enumerate(good) if root[i] == i}
    assert want <= set(single) <= set(good) and len(single) <= len(want) * 1.002
    # Secrets: spans go, the rest stays.
    spans = {r.doc_id: r.spans for r in secrets.find(tables[2]).select(
        "doc_id", secrets.as_text(F.col("spans")).alias("spans")).collect()}
    before = {r.doc_id: r for r in single}
    assert sorted(r.doc_id for r in clean) == sorted(before)
    for r in clean:
        text, out, at = before[r.doc_id].text, "", 0
        for a, b in sorted((int(a), int(b)) for _, a, b in (
                s.split(":") for s in spans[r.doc_id].split(",") if s)):
            if a >= at:
                out += text[at:a] + "[REMOVED]"
            at = max(at, b)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
    # Mixture: copies and cuts.
    assert Counter((r.doc_id, r.text) for r in mix) == Counter(
        plain_mixture([(r.doc_id, r.source, r.text) for r in clean]))
    # Tokens.
    words = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    expected = Counter((r.doc_id, tuple(reference.encode_ordinary(r.text))) for r in mix)
    got = Counter((r.doc_id, tuple(int.from_bytes(r.ids[i:i + 4], "little")
                                   for i in range(0, len(r.ids), 4))) for r in coded)
    assert got == expected and all(4 * r.n_tokens == len(r.ids) for r in coded)


def test_run_is_the_stages_one_after_another(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["place", "doc_id", "n_tokens", "ids"]
    rows = out.collect()
    assert sorted(r.place for r in rows) == list(range(len(rows))) and len(rows) > 100
    # Repeats of a document are far apart in training order.
    at = defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r.place)
    assert max(b - a for p in at.values() for a, b in zip(sorted(p), sorted(p)[1:])) > len(rows) / 4


def test_nulls_repeats_and_further_columns(spark, docs):
    df = docs([None, "", "one two three four five"] + ["one two three four five"] * 2, ids=[1, 2, 3, 3, None])
    df = df.selectExpr("*", "1 AS _fp", "2 AS _number", "3 AS _row", "4 AS _score", "5 AS size")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        rows = stage(spark, df, None)
        assert rows.columns == df.columns
        assert {(r._fp, r._number, r._row, r._score, r["size"]) for r in rows.collect()} == {(1, 2, 3, 4, 5)}
        assert stage(spark, df.limit(0), None).count() == 0
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, df, None).collect()) == [
        (1, None), (3, "one two three four five")]
    assert mixing.mixture(df).count() >= 3


def test_first_and_last_stage_with_nulls_and_clashing_names(spark, docs, tmp_path):
    good = "the river carried the boats slowly past the old stone bridge and the sleeping town. " * 3
    texts = [good, "xx 1 xx", None, ""] * 15
    df = docs(texts, ids=[None if i == 2 else i for i in range(60)]).selectExpr(
        "*", "4 AS _score", "5 AS _row", "6 AS score", "7 AS place", "8 AS ids")
    spark.createDataFrame([(i, int(t == good), 0) for i, t in enumerate(texts)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.good_quality(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    rows = kept.collect()
    assert {(r._score, r._row, r.score) for r in rows} == {(4, 5, 6)} and {r.text for r in rows} == {good}
    assert corpus_pipeline.good_quality(spark, df.limit(0), str(tmp_path)).count() == 0
    coded = corpus_pipeline.tokens(spark, df, None).collect()
    assert len(coded) == 60 and sum(r.n_tokens > 0 for r in coded) == 30
    assert corpus_pipeline.tokens(spark, df.limit(0), None).count() == 0


def test_the_last_stage_decodes_its_ids(docs, monkeypatch):
    df = docs(["", None, "one two", "\u00e9\U0001f600 \n x"], ids=[1, None, 2, 3])
    rows = corpus_pipeline.tokens(None, df, None)
    assert rows.columns == ["place", "doc_id", "n_tokens", "ids"]
    assert sorted(r.place for r in rows.collect()) == [0, 1, 2, 3]
    assert {r.doc_id: r.n_tokens > 0 for r in rows.collect()} == {1: False, None: False, 2: True, 3: True}
    encode = bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *a, **b: encode(*a, **b).withColumn(
        "decoded", F.concat("decoded", F.lit(b"x"))))
    with pytest.raises(Exception, match="decoded ids differ"):
        corpus_pipeline.tokens(None, df, None).collect()
