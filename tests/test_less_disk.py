"""What large closes, round trips and risk models read, write and shuffle."""

from pyspark.sql import functions as F

from ledgerloom import settings
from ledgerloom.operators import checks, matching, risk, scale
from ledgerloom.plans import catalog
from ledgerloom.plans import close as closing
from ledgerloom.sources import csv_files, driver_tables, gateway_recon


def _lines(spark, path, rows=40):
    spark.range(rows).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id % 3 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber",
        "'R' AS l_returnflag", "cast(100 + id AS double) AS l_extendedprice",
        "date'1996-01-05' AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def _written(monkeypatch, *modules):
    names, write = [], scale.materialise
    for module in modules:
        monkeypatch.setattr(module, "materialise",
                            lambda df, name: names.append(name) or write(df, name))
    return names


# --- risk models ---------------------------------------------------------------

def test_every_batch_is_fitted_or_calibrated_on(spark):
    """Neither model is fitted on a part of its three quarters."""
    rows = spark.range(300_000).selectExpr("cast(id AS string) AS close_id", "cast(id AS string) AS batch_id")
    fit, rest = risk.split(rows)
    assert fit.count() > 210_000
    assert fit.count() + rest.count() == 300_000


def test_rows_to_fit_on_keep_their_order(spark):
    rows = spark.range(500).selectExpr("cast(id % 7 AS string) AS close_id", "cast(id AS string) AS batch_id")
    once, again = (risk._dealt(df, 500).rdd.glom().map(list).collect()
                   for df in (rows, rows.orderBy(F.rand(3))))
    assert once == again and sum(map(len, once)) == 500


def test_nets_are_not_copied_to_every_day(spark, books, monkeypatch):
    """Of the days of a window only those with credits count, each credit once a window."""
    for i in range(6):
        books.pay(f"p{i}", f"b{i}", 100 + i)
    books.credit("near", 103, on=1).credit("far", 500, on=4).credit("after", 100, on=5)
    st, bk, _ = books.frames(spark)
    sorted_rows, running = [], risk.running
    monkeypatch.setattr(risk, "running", lambda df, *given, **totals: sorted_rows.append(df.count()) or running(
        df, *given, **totals))
    gaps = {r.net: r.gap for r in risk._closest_gap(risk._batch_side(st), bk).collect()}
    assert sorted_rows == [8]
    assert {int(net): int(gap) for net, gap in gaps.items()} == {100 + i: abs(3 - i) for i in range(6)}


# --- files ---------------------------------------------------------------------

def test_records_are_numbered_where_they_lie(spark, books, tmp_path):
    """However many splits there are, the rows read are not shuffled to be numbered."""
    for i in range(30):
        books.pay(f"p{i}", "b1", 100 + i, order=f"o{i}")
    st, _, _ = books.frames(spark)
    path = str(tmp_path / "st")
    csv_files.write_csv(st, "settlement", path, rows_per_file=4, compression="gzip")
    assert all(".csv.gz" in name for name in scale.children(spark, path) if name.startswith("part"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        good, bad = csv_files.read_settlement(spark, path)
        plan = good._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        rows = good.select("line_no", "txn_id", "gross_amount").collect()
    finally:
        spark.conf.set(name, kept)
    assert sorted((r.line_no, r.txn_id, int(r.gross_amount)) for r in rows) == [
        (i + 2, f"p{i}", 100 + i) for i in range(30)]
    assert bad.count() == 0


def test_a_compressed_recon_export_comes_back(spark, books, tmp_path):
    books.pay("p", "b1", 100, order="o").pay("r", "b1", 40, order="o", kind="refund")
    st, _, _ = books.frames(spark)
    path = str(tmp_path / "recon")
    gateway_recon.write_recon(st, path, compression="gzip")
    assert gateway_recon.is_recon(spark, path)
    good, _ = gateway_recon.read_recon(spark, path)
    assert sorted((r.txn_id, r.txn_type, int(r.gross_amount)) for r in good.collect()) == [
        ("p", "payment", 100), ("r", "refund", 40)]


# --- views ---------------------------------------------------------------------

def test_a_query_makes_the_views_it_asks_for(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(catalog, "materialise_all",
                        lambda frames: names.extend(frames) or scale.materialise_all(frames))
    views = catalog.sources(spark, _lines(spark, tmp_path))
    assert views[0].count() > 40 and names == ["settlement"]
    st, bk, ld = views
    assert sorted({*names} - {"ledger"}) == ["bank", "settlement"]
    for made, plain in zip((st, bk, ld), driver_tables.load(spark, str(tmp_path))):
        assert made.exceptAll(plain).count() == 0 and plain.exceptAll(made).count() == 0


def test_the_keys_asked_for_reach_the_ledgers_table(spark, tmp_path):
    """The ledger is not written; a join with few keys still stops its rows at a filter."""
    ledger = driver_tables.ledger(spark, _lines(spark, tmp_path))
    gaps = scale.materialise(ledger.filter("line_no % 7 = 0").select(
        "close_id", "txn_id", F.lit(2).alias("side")), "gaps")
    kept = {name: spark.conf.get(name, None) for name in (*settings.COPIED, *settings.FILTERED)}
    try:
        for name, size in settings.FILTERED.items():
            spark.conf.set(name, str(size))
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = checks._only_in(ledger, gaps, 2)
        assert "might_contain" in rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() == gaps.count()
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# --- closes --------------------------------------------------------------------

def _close_books(books):
    return (books.pay("p1", "b1", 100, utr="UTR1234567", order="o1").pay("p2", "b2", 70, order="o2")
            .pay("p2_d", "b2", 70, order="o2").pay("p3", "b3", 55, order="o3")
            .credit("c1", 100, text="NEFT UTR1234567").credit("c2", 140, on=1).credit("c3", 9)
            .entry("p1", 100, order="o1").entry("p2", 70, order="o2"))


def test_batches_meet_their_credits_once(spark, books, monkeypatch):
    names, writes = [], scale.materialise_all
    monkeypatch.setattr(matching, "materialise_all", lambda frames: names.extend(frames) or writes(frames))
    done = closing.close(*_close_books(books).frames(spark))
    assert names == ["met", "open-credits"]
    assert {(r.batch_id, r.method) for r in done.matches.collect()} == {
        ("b1", "utr_join"), ("b2", "amount_date_window")}
    assert {(r.batch_id, r.bank_txn_id) for r in done.match_credits.collect()} == {("b1", "c1"), ("b2", "c2")}
    assert [r.batch_id for r in done.open_batches.collect()] == ["b3"]
    assert [r.bank_txn_id for r in done.open_credits.collect()] == ["c3"]


def test_what_no_rule_decides_is_checked_once(spark, books, monkeypatch):
    """A second close of the same tables reads the row checks of the first."""
    names = _written(monkeypatch, closing, checks)
    tables, made = _close_books(books).frames(spark), {}
    first = closing.close(*tables, made=made)
    seen = len(names)
    second = closing.close(*tables, made=made)
    assert sorted(names[seen:]) == ["charges", "credits", "rate-cards"]
    for table in ("findings", "exceptions", "matches"):
        a, b = (sorted(map(str, getattr(c, table).collect())) for c in (first, second))
        assert a == b and a
