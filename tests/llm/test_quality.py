import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import quality, queries

SF = "/root/testdata/sf0.1"


def walk(trees, row, t):
    node = 0
    for _ in range(quality.DEPTH):
        node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
    return trees.value[t, node]


def test_held_out_accuracy_and_every_row(spark):
    rows = queries.QUERIES["op8_quality_trees"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    unseen = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(unseen) > 1000
    assert np.mean([r.predicted == label[r.doc_id] for r in unseen]) > 0.98
    assert np.mean([r.predicted for r in unseen if label[r.doc_id]]) > 0.99
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'z' AS source")
    assert sorted(quality.classify(docs, labels).collect()) == sorted(
        quality.classify(other, turned).collect())


def test_flat_walk_equals_a_plain_walk():
    random = np.random.default_rng(2)
    x = random.normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x, y, 12)
    score = trees.score(x)
    for i in range(0, 500, 29):
        total = trees.base + sum(walk(trees, x[i], t) for t in range(12))
        assert abs(score[i] - 1 / (1 + np.exp(-total))) < 1e-12
    assert np.mean((score >= 0.5) == y) > 0.95


def gain(grad, hess, *parts):
    return sum(grad[p].sum() ** 2 / (hess[p].sum() + quality.RIDGE) for p in parts)


def best_gain(x, rows, grad, hess, least):
    """The largest gain of a cut between two values, all cuts of all columns tried."""
    best = 0.0
    for f in range(x.shape[1]):
        for at in np.unique(x[rows, f])[:-1]:
            left, right = rows[x[rows, f] <= at], rows[x[rows, f] > at]
            if min(len(left), len(right)) >= least:
                best = max(best, gain(grad, hess, left, right) - gain(grad, hess, rows))
    return best


def follow(trees, t, x, rows, grad, hess, least, margin, node=0, depth=0):
    """Every split of tree ``t`` is the best one by exact search, every leaf its Newton step."""
    if depth == quality.DEPTH:
        if len(rows):
            step = -quality.RATE * grad[rows].sum() / (hess[rows].sum() + quality.RIDGE)
            assert abs(trees.value[t, node] - step) < 1e-9
            margin[rows] += step
        return 0
    f, at = trees.feature[t, node], trees.threshold[t, node]
    left, right = rows[x[rows, f] <= at], rows[x[rows, f] > at]
    best = best_gain(x, rows, grad, hess, least)
    if np.isinf(at):
        assert best < 1e-8
    else:
        assert min(len(left), len(right)) >= least
        assert abs(gain(grad, hess, left, right) - gain(grad, hess, rows) - best) < 1e-8
    return int(np.isfinite(at)) + sum(
        follow(trees, t, x, side, grad, hess, least, margin, 2 * node + i, depth + 1)
        for i, side in ((1, left), (2, right)))


def test_histogram_fit_equals_an_exact_split_search():
    """With fewer values than bins every cut lies on an edge, so each split is the best there is.

    Equal gains may be broken either way, so the search follows the fitted trees.
    """
    for seed in range(5):
        random = np.random.default_rng(seed)
        n = quality.BINS - 14  # an edge lies in every gap between two values
        x = random.normal(size=(n, 6))
        y = ((x[:, 0] + 0.3 * random.normal(size=n) > 0) ^ (x[:, 3] > 0.7)).astype(float)
        x[:, 5] = random.integers(0, 4, n)
        trees = quality.fit(x, y, 6)
        margin, splits = np.full(n, trees.base), 0
        for t in range(6):
            p = 1 / (1 + np.exp(-margin))
            splits += follow(trees, t, x, np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6),
                             max(2, min(quality.LEAST_ROWS, n // 50)), margin)
        assert splits > 20
        assert np.allclose(trees.score(x), 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_nulls_empty_long_repeated_and_odd_labels(spark, docs):
    texts = [None, "", "a fine text about things", "a fine text about things", "### *** " * 20_000]
    df = docs(texts, ids=[1, 2, 3, 3, None]).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS _x")
    none = spark.createDataFrame([(None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    rows = quality.classify(df, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    seen = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    one = spark.createDataFrame([(i, 1) for i in seen * 2], "doc_id long, quality int")
    rows = quality.classify(df, one).collect()
    assert {r.score > 0.5 for r in rows} == {True}
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id if r.doc_id in (1, 2) else None, r.score)
    assert by_text[1] == by_text[2]
    assert quality.classify(df.limit(0), one).count() == 0


def test_bounded_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels, rows=200)
    assert np.isfinite(trees.threshold).any()
