"""Helpers that spread hot keys must not change a result."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.books import D, day
from ledgerloom import settings
from ledgerloom.functions import rulebook
from ledgerloom.functions.rulebook import Rule, RuleBook, rule_table
from ledgerloom.operators import checks, scale
from ledgerloom.plans import catalog


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, another third are copies of one row."""
    n = F.col("id")
    return spark.range(3000).select(
        F.when(n % 3 == 0, "hot").when(n % 3 == 1, "copy").otherwise(F.concat(F.lit("k"), n % 50))
        .alias("k"), F.when(n % 3 == 1, 1).otherwise(n).alias("line_no"), n.alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, hot, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), ("gone", 4)],
                                  "k string, w int")
    plain = hot.join(right, ["k"], how)
    salted = scale.skew_join(hot, right, ["k"], how, salt=True)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_spread(spark, hot):
    right = spark.createDataFrame([("hot", 1)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = scale.salted_join(hot, right, ["k"]).groupBy(
            F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 1000


def test_running_aggregates(spark):
    rows = [("a" if n % 4 else "b", n, (n * 37) % 11, None if n % 5 else n) for n in range(200)]
    df = spark.createDataFrame(rows, "g string, n int, x int, y int")
    got = scale.running(df, ["g"], [F.col("n")], "t", s=("sum", "x"), c=("count", "x"),
                        hi=("max", "y"), lo=("min", "x")).collect()
    for r in got:
        before = [q for q in rows if q[0] == r.g and q[1] <= r.n]
        ys = [q[3] for q in before if q[3] is not None]
        assert (r.s, r.c, r.lo) == (sum(q[2] for q in before), len(before),
                                    min(q[2] for q in before))
        assert r.hi == (max(ys) if ys else None)
    assert len(got) == 200


def test_running_from_the_end(spark):
    rows = [("a" if i % 3 else "b", (i * 7) % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, n int, i int").repartition(7)
    got = scale.running(df, ["g"], ["n", "i"], "t", backward=("high", "left"), low=("max", "i"),
                        high=("min", "i"), left=("sum", "n")).collect()
    assert len(got) == len(rows)
    for r in got:
        after = [x for x in rows if x[0] == r.g and x[1:] >= (r.n, r.i)]
        upto = [x for x in rows if x[0] == r.g and x[1:] <= (r.n, r.i)]
        assert r.low == max(x[2] for x in upto) and r.high == min(x[2] for x in after)
        assert r.left == sum(x[1] for x in after)


def test_running_over_everything(spark):
    df = spark.range(100).withColumn("one", F.lit(1))
    got = scale.running(df, [], [F.desc("id")], "t", place=("count", "one")).collect()
    assert {r.id: r.place for r in got} == {n: 100 - n for n in range(100)}


def test_amount_window_pairs(spark):
    demand = spark.createDataFrame([("c", day(d), D(a)) for d in range(3) for a in (10, 11, -3)],
                                   "close_id string, settled_on date, target decimal(28,2)")
    amounts = ("9.00", "8.99", "11.00", "12.01", "-4.00", "-1.99", "0.00")
    supply = spark.createDataFrame([("c", day(d), D(a)) for d in range(9) for a in amounts],
                                   "close_id string, value_date date, amount decimal(28,2)")
    got = scale.amount_window_join(demand, supply, 1, 4)
    want = demand.crossJoin(supply.drop("close_id")).filter(
        (F.abs(F.col("amount") - F.col("target")) <= 1)
        & F.datediff("value_date", "settled_on").between(1, 4))
    key = ["settled_on", "target", "value_date", "amount"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(
        map(tuple, want.select(*key).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_written_tables_are_columnar_and_in_the_shared_folder(spark):
    df = scale.materialise(spark.range(10).withColumn("x", F.lit(1)), "t")
    folder = scale.shared_folder(spark).replace("file:", "")
    assert folder in df.inputFiles()[0]
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


# --- what is copied to every task ------------------------------------------------

def _rule_store(spark):
    return rule_table(spark, [
        Rule(1, "label", "narration_alias", {"marker": "REF", "prefix": "UTR"}, series_id="c1"),
        Rule(2, "charge", "adjustment_pattern", {"keyword": "PROC CHG", "amount": "250"}, series_id="c1"),
        Rule(3, "short", "adjustment_pattern", {"keyword": "X", "amount": "1"}, series_id="c2"),
        Rule(4, "bare", "bank_timing", {"offset_days": "3"}, series_id="c2")])


def test_rules_are_copied_and_never_the_narrations(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(500).selectExpr("'' AS _series", "concat('NEFT REF ', 100000 + id) AS narration").write.parquet(path)
    book = RuleBook([Rule(1, "label", "narration_alias", {"marker": "REF", "prefix": "UTR"}),
                     Rule(2, "short", "adjustment_pattern", {"keyword": "X", "amount": "1"})])
    hits = book.narration_hits(spark.read.parquet(path))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "CartesianProduct" not in plan
    assert hits.count() == 500


def test_large_rule_stores_are_shuffled_with_the_same_hits(spark, monkeypatch):
    rows = [(c, t) for c in ("c1", "c2", "c3") for t in ("NEFT REF 123456", "X PROC CHG", "", "none")]
    texts = spark.createDataFrame(rows, "_series string, narration string")

    def hits():
        book = RuleBook.from_df(_rule_store(spark), series=lambda close_id: close_id)
        found = book.narration_hits(texts)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return plan, sorted((r._series, r.narration, r.rule_id, r.utr) for r in found.collect())

    few, by_copy = hits()
    monkeypatch.setattr(rulebook, "FEW_RULES", 1)
    many, by_shuffle = hits()
    assert "SortMergeJoin" not in few and "SortMergeJoin" in many
    assert by_copy == by_shuffle
    assert {(r[0], r[2]) for r in by_copy} == {("c1", "label"), ("c1", "charge"), ("c2", "short"), ("c2", "bare")}


def test_a_table_that_is_small_on_disk_only_is_not_copied(spark):
    for name, size in settings.COPIED.items():  # other tests of the session may have taken them back
        spark.conf.set(name, str(size))
    n = F.col("id")
    wide = scale.materialise(spark.range(400_000).select(
        F.concat(F.lit("close of a merchant "), F.floor(n / 1000)).alias("close_id"),
        F.floor(n / 4).alias("k")), "wide")
    joined = wide.join(wide.select("k", F.lit(1).alias("seen")), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_a_session_keeps_its_own_limit_for_copies(spark):
    session = spark.newSession()
    for name in settings.COPIED:
        session.conf.unset(name)
    settings.bound_copies(session)
    assert {name: int(session.conf.get(name)) for name in settings.COPIED} == settings.COPIED
    own = spark.newSession()
    for name in settings.COPIED:
        own.conf.unset(name)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings.bound_copies(own)
    assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_counting_partitions_runs_no_view(spark, tmp_path, monkeypatch):
    """A view is asked for its rows once, when it is written."""
    spark.range(20).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id % 3 AS l_suppkey", "1 AS l_linenumber",
        "'N' AS l_returnflag", "cast(100 + id AS double) AS l_extendedprice",
        "date'1996-01-05' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    asked, lines = [], catalog.tables.lines
    monkeypatch.setattr(catalog.tables, "lines", lambda *given: asked.append("lines") or lines(*given))
    views = catalog.tables.load(spark, str(tmp_path))
    kind = type(views[0])
    taken = kind.rdd
    monkeypatch.setattr(kind, "rdd", property(
        lambda df: asked.append(df.columns[0]) or taken.__get__(df, kind)))
    catalog.sources(spark, str(tmp_path))
    assert set(asked) == {"lines", "l_orderkey"}


def test_few_jobs_run_side_by_side(spark):
    """The driver holds the plans and generated code of the jobs under way."""
    lock, now, most = threading.Lock(), [0], [0]

    def work():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.1)
        with lock:
            now[0] -= 1
        return spark.range(1)

    for job in [scale.start(work) for _ in range(8)]:
        job.result()
    assert most[0] <= 3
    most[0] = 0
    scale.materialise_all({f"side-{i}": work for i in range(6)})
    assert most[0] <= 3


# --- what a join with few keys shuffles --------------------------------------------

def _filters(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("might_contain")


def test_rows_without_an_asked_key_are_not_shuffled(spark, books, monkeypatch):
    """Repeated captures and refunds are few; the rest of the rows stops at a filter."""
    for i in range(30):
        books.pay(f"p{i}", "b1", 100 + i, order=f"o{i}")
    books.pay("p3_d", "b1", 103, order="o3").pay("p4_e", "b1", 999, order="o4")
    books.pay("r5", "b2", 50, order="o5", kind="refund")
    st, _, _ = books.frames(spark)
    st = scale.materialise(st, "st")
    session = spark.conf
    kept = {name: session.get(name, None) for name in (*settings.COPIED, *settings.FILTERED)}
    seen, write = {}, scale.materialise
    monkeypatch.setattr(checks, "materialise", lambda df, name: seen.update({name: _filters(df)}) or write(df, name))
    try:
        for name, size in settings.FILTERED.items():
            session.set(name, str(size))
        session.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")
        session.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        again, refunds = checks.duplicate_captures(st), checks.cross_cycle_refunds(st)
        assert seen["suspects"] > 0 and _filters(refunds) > 0
        assert [r.subject_id for r in again.collect()] == ["p3_d"]
        assert [r.subject_id for r in refunds.collect()] == ["r5"]
    finally:
        for name, value in kept.items():
            session.unset(name) if value is None else session.set(name, value)


def test_keys_with_the_same_number_stay_apart(spark, books, monkeypatch):
    """The number of a key only picks suspects; the keys themselves decide."""
    books.pay("a", "b1", 10, order="o1").pay("b", "b1", 10, order="o2").pay("c", "b1", 10, order="o2")
    books.pay("d", "b1", 10, order=None).pay("e", "b1", 10, order=None)
    st, _, _ = books.frames(spark)
    monkeypatch.setattr(checks.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert [r.subject_id for r in checks.duplicate_captures(st).collect()] == ["c"]


def test_queries_give_a_session_the_limits_of_filters(spark):
    session = spark.newSession()
    for name in settings.FILTERED:
        session.conf.unset(name)
    name = "spark.sql.optimizer.runtime.bloomFilter.numBits"
    session.conf.set(name, "1024")
    settings.bound_copies(session)
    assert {n: int(session.conf.get(n)) for n in settings.FILTERED} == settings.FILTERED | {name: 1024}
