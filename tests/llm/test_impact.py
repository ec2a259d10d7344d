import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import impact

ROWS = "vec_id long, embedding array<float>, label int"


def found(df, k=impact.K, every=100):
    rows = impact.search(df, F.col("vec_id") % every == 0, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


def plain(rows, k=impact.K, every=100):
    """Every asked row against every other row, in integers."""
    whole = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v, _ in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j) for b, (j, v) in enumerate(whole)
                  if a != b and len(v) == len(q)]
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(i, n, j, -s) for n, (s, _, j) in enumerate(best, start=1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["cloud", "few values", "one sign", "sparse"])
def test_every_score_and_tie(spark, kind):
    random.seed(kind)
    draw = {"cloud": lambda: random.gauss(0, 0.3), "few values": lambda: random.choice([-0.5, 0.0, 0.5]),
            "one sign": lambda: random.random(), "sparse": lambda: random.choice([0.0] * 9 + [0.7])}[kind]
    rows = [(i, [draw() for _ in range(12)], 0) for i in range(1500)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    float32 = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert sorted(found(df), key=str) == plain(float32)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(impact, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    assert sorted(found(spark.createDataFrame(rows, ROWS), every=50), key=str) == plain(rows, every=50)


def test_a_stop_is_only_on_proof():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (3000, 20))
    block = impact.Block(x, np.arange(3000), np.arange(3000))
    for i in range(0, 3000, 250):
        at, score = block.search(x[i], i)
        want = np.delete(np.arange(3000), i)
        want = want[np.argsort(-(x[want] @ x[i]), kind="stable")][:10]
        assert at.tolist() == want.tolist() and score.tolist() == (x[want] @ x[i]).tolist()


def test_unusable_odd_and_repeated_rows(spark):
    big = 3.0e38
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (7, None, 1), (8, [None, 1.0], 1),
            (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (100, [], 1), (11, [], None),
            (200, [1.0], 1), (12, [-1.0], 1), (300, [big, big, -big], 1), (13, [big, big, big], 1),
            (14, [-big, -big, big], 1), (400, [0.0, 0.0], 1), (2 ** 63 - 1, [0.0, 0.0], 1)]
    got = found(spark.createDataFrame(rows, ROWS))
    held = [r for r in got if r[0] != 300]
    want = [r for r in plain(rows) if r[0] != 300]
    assert sorted(held, key=str) == want
    # Components and scores are held at the ends of a long.
    assert [r for r in got if r[0] == 300] == [(300, 1, 13, 2 ** 63 - 1), (300, 2, 14, -2 ** 63)]


def test_no_rows_and_clashing_names(spark):
    assert found(spark.createDataFrame([], ROWS)) == []
    rows = [(i, [float(i % 7), 1.0], i) for i in range(150)]
    df = spark.createDataFrame(rows, ROWS)
    extra = df.withColumns({c: F.lit("x") for c in ("row", "block", "asks", "dim", "x", "id", "score", "rank")})
    assert found(extra) == found(df)
