import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, blocks, pivots, queries
from tests.llm.plain import smallest_reachable

SCHEMA = "vec_id long, embedding array<float>, label int"


def cosines(x):
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
    return unit @ unit.T


def check_links(df, rows, least_recall=1.0):
    """Against all pairs; ``rows`` are (vec_id, embedding, label), ids unique."""
    got = {r.vec_id: r for r in df.collect()}
    assert set(got) == {r[0] for r in rows}
    found = wanted = 0
    fine = [r for r in rows if r[2] is not None and r[1] and all(
        v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    for kind in {(r[2], len(r[1])) for r in fine}:
        group = [r for r in fine if (r[2], len(r[1])) == kind]
        near = cosines(np.array([r[1] for r in group], np.float32).astype(float)) >= 0.98
        np.fill_diagonal(near, False)
        wanted += near.sum()
        for r, n in zip(group, near.sum(axis=1)):
            assert got[r[0]].n_links <= n
            found += got[r[0]].n_links
        if least_recall == 1.0:
            root = smallest_reachable(group, lambda i, j: near[i, j])
            least = {}
            for r, c in zip(group, root):
                least[c] = min(least.get(c, r[0]), r[0])
            assert all(got[r[0]].component_id == least[c] for r, c in zip(group, root))
    assert found >= least_recall * wanted
    for r in rows:
        assert got[r[0]].kept == (got[r[0]].component_id == r[0])
        if r not in fine:
            assert got[r[0]].n_links == 0 and got[r[0]].component_id == r[0]


def clusters(n, per, dim=32, seed=1, spread=0.02):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n, dim))
    x = np.repeat(centres, per, axis=0) + spread * random.normal(size=(n * per, dim))
    return x.astype(np.float32).astype(float)


def test_whole_table_and_its_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_links(queries.QUERIES["op4_pivot_permutations"](spark, sf), rows, 0.9)


def test_clusters_copies_and_cut_lists(spark, monkeypatch):
    monkeypatch.setattr(pivots, "LIST_ROWS", 40)
    x = clusters(12, 25)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), 0) for i in range(60)] + [(2000, (3 * x[0]).tolist(), 0)]
    check_links(pivots.near_copies(spark.createDataFrame(rows, SCHEMA)), rows)


def test_one_cluster_with_a_third_of_all_vectors(spark):
    x = np.concatenate([clusters(1, 400), clusters(800, 1, seed=2)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    check_links(pivots.near_copies(spark.createDataFrame(rows, SCHEMA)), rows, 0.95)


ODD = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0),
       (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0),
       (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1), (12, [-1.0, 0.0], 0)]


def test_odd_vectors_link_with_nothing(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS key", "2 AS n", "3 AS cid", "4 AS dim")
    check_links(pivots.near_copies(df), ODD)
    assert pivots.near_copies(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0], 0)] * 3 + [(None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)]
    got = sorted(map(tuple, pivots.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 3, 5, True)] * 3 + [(None, 3, 5, False), (None, 0, None, True)], key=str)


def exact(rows, k=20):
    """Best candidates of each query, ties by id."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def recall(got, best):
    hit = sum(len({v for v, _ in best[q]} & {r.vec_id for r in got[q]}) for q in best)
    return hit / sum(map(len, best.values()))


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r)
    return out


def well_formed(got, rows, k=20):
    x = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows}
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= k
        keys = [(-r.score, r.vec_id) for r in found]
        assert keys == sorted(keys) and q not in {r.vec_id for r in found}
        assert all(r.score == pytest.approx(x[r.vec_id] @ x[q], rel=1e-12, abs=1e-12) for r in found)


def test_search_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, best = by_query(queries.QUERIES["op6_adaptive_scan"](spark, sf)), exact(rows)
    assert set(got) == set(best) and all(len(v) == 20 for v in got.values())
    well_formed(got, rows)
    assert recall(got, best) >= 0.9


def test_search_of_vectors_of_any_length_in_cut_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    random = np.random.default_rng(4)
    x = clusters(40, 25, dim=24, seed=3, spread=0.3) * random.uniform(0.2, 5, size=(1000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = by_query(ann.search(df, F.col("vec_id") % 20 == 0))
    well_formed(got, rows)
    assert recall(got, exact(rows)) >= 0.9


def test_ties_few_candidates_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.5, 1.0])]
    odd = [(60, None), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [1.0, 2.0, 3.0]), (None, [0.5, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS row", "2 AS id", "3 AS list", "4 AS rank")
    got = by_query(ann.search(df, F.col("vec_id") % 20 == 0))
    assert set(got) == {0, 20, 40}
    assert [r.vec_id for r in got[0]] == list(range(1, 21))
    assert [r.vec_id for r in got[20]] == list(range(20))
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (0, [3.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(
        few, F.col("vec_id") % 20 == 0).collect()) == [
        (0, 1, 0, 3.0), (0, 1, 1, 6.0), (0, 2, 0, 3.0), (0, 2, 1, 2.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(few.filter("false"), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]


def test_abandoned_candidates_are_few_wrong():
    random = np.random.default_rng(5)
    x = random.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ann.Index(x, 1.0, 3000)
    q = x[:50]
    qi, xi = index.scan(index.asked(q), index.long(x), 21, np.full(50, -np.inf))
    assert len(qi) < 0.5 * 50 * 3000
    known = np.sort(q @ x.T, axis=1)[:, -40]
    assert len(index.scan(index.asked(q), index.long(x), 21, known)[0]) < 50 * 60
    best = np.argsort(-(q @ x.T), axis=1)[:, :21]
    pairs = set(zip(qi.tolist(), xi.tolist()))
    assert np.mean([(i, int(j)) in pairs for i in range(50) for j in best[i]]) > 0.98


def test_groups_come_whole_from_any_batches():
    keys = np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 9, 40))
    table = pa.table({"k": keys, "two": keys // 3, "v": np.arange(len(keys))})
    for size in (1, 2, 7, 1000):
        got = list(blocks.groups(table.to_batches(max_chunksize=size), 2))
        assert [g["k"][0].as_py() for g in got] == list(range(40))
        assert sum(len(g) for g in got) == len(keys)
        assert all(len(set(g["k"].to_pylist())) == 1 for g in got)


def test_runs_pass_by_as_they_arrive():
    batch = pa.RecordBatch.from_pydict({"a": [1, 1, 1, 2], "b": [0, 0, 1, 1], "c": [5, 6, 7, 8]})
    got = [r["c"].to_pylist() for r in blocks.runs([batch, batch.slice(0, 0), batch.slice(3)], 2)]
    assert got == [[5, 6], [7], [8], [8]]


def test_queries_of_a_cell_in_many_batches(spark):
    """Arrow batches smaller than a chunk and smaller than a cell's queries change nothing."""
    df = spark.range(1, 1501).select(F.col("id").alias("vec_id"), F.transform(
        F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(F.col("id") * j * 0.37)).alias("embedding"))

    def found():
        return sorted(map(tuple, ann.search(df, F.col("vec_id") % 2 == 0).collect()))

    want = found()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        assert found() == want and len(want) == 750 * 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_labels_of_text_do_not_run_into_components(spark):
    rows = [(1, [2.0], "a,1.0"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "a"), (4, [1.0], "[1.0")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_copies(df).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (0, 4)}
