import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ledgerloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
CASES = ["", "a", " ", "  a  b ", "it's", "'s", "  's", "x''s", "don't we'll I'VE 'll've'd",
         "a\n\n b\n", "\t\tx 1234abc!?  ", "x'system'd", "日本語 テスト １２３", "é'sé",
         "A" * 3000, "ab" * 800, "!" * 400 + " " * 400, "<|endoftext|>", "\x1c a\x85b"]


@pytest.fixture(scope="module")
def library():
    words = bpe.Vocabulary(PATH)
    return words, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=words.ranks,
                                    special_tokens={})


def ids_of(binary):
    return [int.from_bytes(binary[i:i + 4], "little") for i in range(0, len(binary), 4)]


def test_ids_equal_the_library_on_random_texts(library):
    words, reference = library
    pick = random.Random(5)
    texts = CASES + ["".join(pick.choice("abstvremld''' \n\t 12é!? 日\x1c")
                             for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert ids_of(ids) == reference.encode_ordinary(text)


def test_every_code_point_is_classed_as_the_library_does(library):
    words, reference = library
    texts = ["".join(chr(c) for c in range(a, min(a + 500, 0x110000)) if not 0xD800 <= c < 0xE000)
             for a in range(0, 0x110000, 500)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert ids_of(ids) == reference.encode_ordinary(text)


def test_scan_equals_a_walk():
    import numpy as np
    first, _, functions, _ = bpe._automaton()
    symbols = np.random.default_rng(1).integers(0, 9, 5000)
    state, walked = bpe.FRESH, []
    for x in symbols:
        state = bpe._step(state, x)[0]
        walked.append(state)
    assert functions[bpe._scan(first[symbols]), bpe.FRESH].tolist() == walked


def test_rows_nulls_repeats_and_other_columns(spark, docs, library):
    _, reference = library
    df = docs([None, "", "it's so", "it's so", CASES[14]], ids=[1, 2, 3, 3, None])
    df = df.selectExpr("*", "1 AS ids", "2 AS _text", "3 AS n_tokens")
    rows = bpe.encode(df, PATH, decode=True).collect()
    assert [r.n_tokens for r in rows][:2] == [0, 0] and len(rows) == 5
    assert ids_of(rows[2].ids) == reference.encode_ordinary("it's so") == ids_of(rows[3].ids)
    assert rows[4].decoded == CASES[14].encode() and rows[4].doc_id is None
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_decode_is_the_way_back(docs):
    coded = bpe.encode(docs(CASES), PATH)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, PATH).collect()}
    assert back == {i: t.encode() for i, t in enumerate(CASES)}


def test_full_cache_starts_anew(monkeypatch, library):
    words, reference = library
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    texts = [f"word{i} other{i}" for i in range(50)]
    for text in texts:
        assert ids_of(words.encode([text.encode()])[0]) == reference.encode_ordinary(text)
    assert len(words.cache) <= 10


def test_query_digests(spark):
    from ledgerloom.llm import queries
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
