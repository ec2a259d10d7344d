from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, simhash, training_order
from ledgerloom.llm.places import numbered, whole_scan


def numbers(df):
    rows, n = numbered(df)
    found = sorted((r.id, r._number) for r in rows.select("_all.id", "_number").collect())
    assert len(found) == n and sorted(k for _, k in found) == list(range(n))
    return found


def test_rows_of_filtered_tables_of_many_files_have_numbers_of_their_own(spark, tmp_path):
    spark.range(2000).repartition(4).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert whole_scan(df) and whole_scan(df.select("id", (F.col("id") + 1).alias("x")))
    assert len(numbers(df)) == 2000
    for part in (df.filter("id % 2 = 0"), df.filter("id % 2 = 0").select("id"), df.limit(1000),
                 df.filter("id < 500").select(F.explode(F.array("id", "id")).alias("id"))):
        assert not whole_scan(part) and len(numbers(part)) == 1000
    assert numbered(df.filter("id < 0"))[1] == 0


def test_operators_on_filtered_documents(spark, docs, tmp_path):
    texts = [f"document {i} " + " ".join(f"w{(i * 7 + k * k) % 9973}" for k in range(30)) for i in range(400)]
    docs(texts).repartition(4).write.parquet(f"{tmp_path}/d")
    half = spark.read.parquet(f"{tmp_path}/d").filter("doc_id % 2 = 0")
    want = [(i, texts[i]) for i in range(0, 400, 2)]

    def got(df):
        return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    assert got(corpus_pipeline.without_secrets(spark, half, None)) == want
    assert got(simhash.deduplicate(half)) == got(simhash.deduplicate(docs(
        [t for _, t in want], ids=[i for i, _ in want])))
    assert mixing.mixture(half).count() == mixing.mix(half).selectExpr("sum(size(starts)) n").first().n
    rows, n = training_order.slots(half, "doc_id", "text", 7)
    assert sorted(r.slot for r in rows.select("slot").collect()) == list(range(n)) and n == 200


def test_a_path_given_twice_is_read_twice(spark, tmp_path):
    spark.range(200).repartition(4).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t")
    assert not whole_scan(df)
    rows, n = numbered(df)
    assert n == 400 and sorted(r._number for r in rows.collect()) == list(range(400))
