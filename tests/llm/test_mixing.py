import re
from collections import defaultdict

import duckdb
import pytest

from ledgerloom.llm import mixing, queries


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + \
        ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def checked(rows, texts, sources):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    sizes = defaultdict(int)
    for i, s in sources.items():
        sizes[s] += size[i]
    target, taken = plain_targets(sizes), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
        assert sum(c.words for c in r.starts) == r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = df.collect()
    mixed = mixing.mix(df).collect()
    checked(mixed, {r.doc_id: r.text for r in rows}, {r.doc_id: r.source for r in rows})
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, mixed))


def test_uneven_sources_nulls_and_blank_texts(docs):
    texts = [f"w{i} x y" for i in range(60)] + [None, "", " \n", "one two"] + ["big " * 4000]
    sources = ["b"] * 30 + ["a"] * 10 + [None] * 20 + ["c", "c", "blank", "é"] + ["z"]
    ids = list(range(len(texts)))
    df = docs(texts, sources).selectExpr("*", "1 AS size", "2 AS start", "3 AS _id", "4 AS target")
    checked(mixing.mix(df).collect(), dict(zip(ids, texts)), dict(zip(ids, sources)))
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs([None, ""])).collect()} == {0}


def test_repeated_rows_share_what_their_source_takes(docs):
    rows = mixing.mix(docs(["a b c"] * 9 + ["d"], ids=[1] * 9 + [None])).collect()
    assert sum(r.taken for r in rows) == 42 and len(rows) == 10


def test_order_follows_the_schedule(spark, docs):
    texts = ["one two three"] * 900
    df = docs(texts, [("a", "b", "c")[i % 3] for i in range(900)])
    order = mixing.curriculum(df).collect()
    positions = [r.position for r in order]
    assert positions == sorted(positions) and 0 < positions[0] and positions[-1] < 1
    source = {r.doc_id: r.source for r in df.collect()}
    taken = sum(r.words for r in order)
    assert abs(taken - 1.5 * 2700) <= 3
    half = defaultdict(lambda: [0, 0])
    for r in order:
        half[source[r.doc_id]][r.position >= 0.5] += r.words
    # integral of 1 + slope * (2t - 1) over the first half is half less a quarter of the slope
    for s, slope in (("a", -0.8), ("b", 0.0), ("c", 0.8)):
        first, second = half[s]
        assert first / (first + second) == pytest.approx(0.5 - slope / 4, abs=0.02)


def test_sql_says_the_same(spark, docs, tmp_path):
    texts = [f"w{i} x y" for i in range(60)] + [None, "", "one two"] + ["big " * 4000]
    docs(texts, ["b"] * 30 + ["a"] * 10 + [None] * 20 + ["c", "c", "é", "z"]).write.parquet(
        f"{tmp_path}/documents.parquet")
    for sf, part in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.01", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet{part}'")
        told = con.execute(queries.SQL["op5_curriculum"]).fetchall()
        rows = queries.QUERIES["op5_curriculum"](spark, sf).collect()
        assert sorted(map(tuple, rows)) == sorted(told)


def test_the_query_gives_the_training_order(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op5_curriculum"](spark, sf).collect()
    df = spark.read.parquet(f"{sf}/documents.parquet")
    order = mixing.curriculum(df).collect()
    places = defaultdict(list)
    for i, r in enumerate(order):
        places[r.doc_id].append(i)
    taken = [r for r in rows if r.taken]
    assert len(rows) == df.count() and {r.doc_id for r in taken} == set(places)
    for r in taken:
        own = places[r.doc_id]
        assert (r.first_place, r.last_place) == (own[0], own[-1])
        assert r.first_position == order[own[0]].position
        assert r.taken == sum(order[i].words for i in own)
    assert all(r.first_place is None and r.first_position is None for r in rows if not r.taken)
    assert mixing.schedule(df.limit(0)).count() == 0
