import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import queries, sharding


def checked(rows, texts, tolerance, shards=16):
    """Sizes, checksums and slots are right; bytes are near equal. ``texts`` by id."""
    assert len(rows) == len(texts)
    total, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / shards
    assert set(total) == set(range(shards))
    assert max(abs(t - mean) for t in total.values()) <= tolerance * mean
    return groups


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_sampled_splitters"](spark, sf).collect()
    checked(rows, texts, 0.05)


def test_one_text_with_half_of_all_bytes_is_subdivided(spark):
    texts = {i: ("copy " * 20 if i % 2 else f"text {i} " * 11) for i in range(20_000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    groups = checked(sharding.by_text(df).collect(), texts, 0.05)
    assert len(groups[b"copy " * 20]) >= 7
    assert all(len(g) == 1 for text, g in groups.items() if text != b"copy " * 20)


def test_pairs_beside_a_hot_text_stay_whole(spark):
    """Only the hot text is cut, though its range holds others; so do groups up to a twentieth."""
    hot, n = "copy " * 80, 20_000
    texts = {i: hot for i in range(n)}
    texts |= {n + i: f"pair {i // 2} " * 11 for i in range(2 * n)}
    shard = sum(len(t) + 1 for t in texts.values()) / 16
    middling = {f"group {g} " * 20: int(shard / 25 / (len(f"group {g} ") * 20)) for g in range(12)}
    for text, copies in middling.items():
        texts |= {len(texts) + i: text for i in range(copies)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    groups = checked(sharding.by_text(df).collect(), texts, 0.05)
    assert len(groups[hot.encode()]) >= 4
    assert all(len(g) == 1 for text, g in groups.items() if text != hot.encode())


def test_repeated_ids_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "same")] * 400 + [(None, None)] * 5 + [(2, "")],
                               "doc_id long, text string").selectExpr(
        "*", "1 AS size", "2 AS shard", "3 AS row", "4 AS key")
    rows = sharding.by_text(df, shards=4).collect()
    assert len(rows) == 406
    assert {r.shard for r in rows} == {0, 1, 2, 3}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.by_text(df.limit(0)).count() == 0


def test_few_rows(docs):
    rows = sharding.by_text(docs(["a", "b", None])).collect()
    assert len(rows) == 3 and all(0 <= r.shard < 16 for r in rows)


def test_binary_search_expression(spark):
    bounds = [f"{i:03d}" for i in range(0, 300, 7)]
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(310)] + [("",)], "key string")
    for r in df.withColumn("at", sharding.range_of(F.col("key"), bounds)).collect():
        assert r["at"] == sum(b <= r["key"] for b in bounds)


def test_written_shards(spark, docs, tmp_path):
    df = docs([f"text {i % 50}" for i in range(200)] + [None])
    sharding.write(df, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(
        (r.doc_id, r.text) for r in df.collect())
    assert back.groupBy("shard").agg(F.countDistinct("slot").alias("d"), F.count("*").alias("n"),
                                     F.max("slot").alias("m")).filter("d <> n OR m + 1 <> n").count() == 0


def test_no_python_in_the_plan(docs):
    plan = sharding.by_text(docs(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
