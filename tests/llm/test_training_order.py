import zlib

import numpy as np
import public_tokenizers as P
import pytest

from ledgerloom.llm import bpe, queries, training_order as order

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097, 100_003])
def test_permutation(n):
    slots = order.permuted(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        other = order.permuted(np.arange(n), n, 8)
        assert (slots != other).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def shards_match(index, path, texts, **options):
    """Each sequence is where the index says, shards hold nothing else."""
    words = bpe.vocabulary(PATH)
    rows = index.collect()
    assert sorted(r.slot for r in rows) == list(range(len(texts)))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    width = options.get("row_tokens", order.ROW_TOKENS)
    for shard, members in by_shard.items():
        read = list(order.read_rows(path, shard, row_tokens=width))
        assert all(len(x) == width for x in read)
        ids = np.concatenate(read)
        members.sort(key=lambda r: r.slot)
        at = 0
        for r in members:
            mine = ids[r.first_token:r.first_token + r.n_tokens]
            assert r.first_token == at and r.first_row == at // width
            assert words.decode(mine.astype(np.int64)).decode() == texts[r.doc_id]
            assert zlib.crc32(mine.tobytes()) == r.ids_crc32
            assert ids[r.first_token + r.n_tokens] == order.END
            at += r.n_tokens + 1
        assert (ids[at:] == order.END).all() and len(ids) - at < width
    return by_shard


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    index, path = order.write_shards(df, PATH, 2026, per_shard=300)
    by_shard = shards_match(index, path, texts)
    assert sorted(by_shard) == [0, 1, 2, 3]
    query = queries.QUERIES["op1_training_order"](spark, sf)
    assert query.count() == len(texts) and query.columns == index.columns
    again = {r.doc_id: r.slot for r in query.collect()}
    assert again == {r.doc_id: r.slot for rows in by_shard.values() for r in rows}


def test_reading_resumes_at_a_row(docs):
    index, path = order.write_shards(docs(["some words here " * 50] * 20), PATH, 1, row_tokens=16)
    whole = list(order.read_rows(path, 0, row_tokens=16))
    rest = list(order.read_rows(path, 0, row=7, row_tokens=16))
    assert len(whole) - 7 == len(rest) and all((a == b).all() for a, b in zip(whole[7:], rest))


def test_nulls_empty_long_and_other_columns(docs):
    texts = ["", "a b", "word " * 30_000, "é"]
    df = docs([None, *texts[1:]]).selectExpr("*", "1 AS slot", "2 AS _key", "3 AS shard")
    index, path = order.write_shards(df, PATH, 3, row_tokens=64, per_shard=2)
    shards_match(index, path, dict(enumerate(texts)), row_tokens=64)
    same, _ = order.write_shards(docs(["x"] * 5, ids=[1, 1, 1, None, None]), PATH, 3)
    assert sorted(r.slot for r in same.collect()) == [0, 1, 2, 3, 4]
    none, _ = order.write_shards(df.limit(0), PATH, 3)
    assert none.count() == 0
