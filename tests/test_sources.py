"""Files: drifting headers, rows that fail alone, round trips."""

from tests.books import Books, D, day
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.plans.close import close
from ledgerloom.operators import digest
from ledgerloom.sources import csv_files, gateway_recon


def test_headers_aliases_and_rejects(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(
        "﻿Payment ID,Batch-ID,Bank Ref No,Type,Amount,MDR,GST,Settlement Date,Receipt,Instrument,Gross\n"
        'p1,b1,UTR1,Payment,"1,000.50",20,3.6,5/1/2024,o1,UPI,7\n'
        ",b1,,,,,,2024-01-06,,,8\n"
        "p3,b1,,gift,1,,,2024-01-06,,,\n"
        "p4,b1,,refund,x,y,,never,,,\n"
        "p5,b1,,refund,(5),,,never,,,\n"
        "p6,b1,,refund,(5),,,,,,\n")
    good, bad = csv_files.read_settlement(spark, str(path))
    rows = {r.line_no: r for r in good.collect()}
    assert set(rows) == {2, 3}
    a, b = rows[2], rows[3]
    assert (a.txn_id, a.utr, a.txn_type, a.gross_amount, a.fee, str(a.settled_on), a.order_id,
            a.method) == ("p1", "UTR1", "payment", D("1000.50"), D(20), "2024-01-05", "o1", "upi")
    assert (b.txn_id, b.gross_amount, b.method, b.utr) == ("row_3", D(8), "card", None)
    errors = {r.line_no: r.error for r in bad.collect()}
    assert errors == {4: "line 4: unknown txn_type 'gift'",
                      5: "line 5: gross_amount 'x' is not an amount",
                      6: "line 6: settled_on 'never' is not a recognised date",
                      7: "line 7: settled_on is empty"}
    report = csv_files.load_report({"settlement": good}, bad).first()
    assert (report.loaded, report.rejected) == (2, 4)


def test_line_numbers_count_over_splits(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,amount,date,narration\n" + "".join(
        f"c{n},1,2024-01-01,{'x' * 60}\n" for n in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, _ = csv_files.read_bank(spark, str(path))
        rows = good.select("bank_txn_id", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.bank_txn_id: r.line_no for r in rows} == {f"c{n}": n + 2 for n in range(3000)}


def made(spark):
    b = Books()
    b.pay("p1", "B1", "1000.10", utr="UTR123456", order="o1", fee="20.00", gst="3.60")
    b.pay("r1", "B1", 40, kind="refund", order="o1").pay("h1", "B1", 10, kind="chargeback_hold")
    b.pay("u1", "UNSETTLED", 70, fee=1).pay("a1", "B1", 5, kind="adjustment", order='o,"x')
    b.credit("c1", "921.50", 1, "NEFT UTR123456, LTD").credit("c2", 3, 1, 'says "hi"')
    b.entry("p1", "1000.10", order="o1")
    return b.frames(spark)


def names(df, *drop):
    return sorted(str(r) for r in df.drop("line_no", *drop).collect())


def test_csv_round_trip_keeps_every_conclusion(spark, tmp_path):
    frames = made(spark)
    for name, df in zip(csv_files.EXPORTS, frames):
        csv_files.write_csv(df, name, str(tmp_path / name))
    st, bk, ld, bad = csv_files.load_bundle(
        spark, *[str(tmp_path / n) for n in csv_files.EXPORTS], close_id="c1")
    assert bad.isEmpty()
    for a, b in zip(frames, (st, bk, ld)):
        assert names(a) == names(b)
    one, two = (close(*f) for f in (frames, (st, bk, ld)))
    of = lambda c: digest.close_digest(
        c.matches, c.match_credits, c.findings, c.exceptions).first().digest
    assert of(one) == of(two)
    assert csv_files.period(st).first().period == "2026-06"


def test_ledger_may_be_missing(spark, tmp_path):
    st, bk, _ = made(spark)
    csv_files.write_csv(st, "settlement", str(tmp_path / "s"))
    csv_files.write_csv(bk, "bank", str(tmp_path / "b"))
    _, _, ld, _ = csv_files.load_bundle(spark, str(tmp_path / "s"), str(tmp_path / "b"))
    assert ld.isEmpty()


def test_recon_round_trip(spark, tmp_path):
    st, bk, _ = made(spark)
    gateway_recon.write_recon(st, str(tmp_path / "r"))
    csv_files.write_csv(bk, "bank", str(tmp_path / "b"))
    assert gateway_recon.is_recon(spark, str(tmp_path / "r"))
    assert not gateway_recon.is_recon(spark, str(tmp_path / "b"))
    back, _, _, bad = csv_files.load_bundle(spark, str(tmp_path / "r"), str(tmp_path / "b"),
                                            close_id="c1")
    assert bad.isEmpty() and names(back) == names(st)
    raw = spark.read.csv(str(tmp_path / "r"), header=True).filter("entity_id = 'p1'").first()
    assert (raw.amount, raw.fee, raw.on_hold, raw.settled) == ("100010", "2000", "false", "true")
    assert len(raw) == 25


def test_recon_rows_fail_alone(spark, tmp_path):
    head = "entity_id,type,amount,credit,debit,fee,tax,on_hold,settled,settled_at,created_at,settlement_id,settlement_utr,order_id,method\n"
    path = tmp_path / "r.csv"
    path.write_text(
        head + "e1,payment,150000,,,3000,540,false,true,1748563200,,s1,U1,o1,UPI\n"
        "e2,transfer,,700,,,,no,1,1748563200,,s1,,,\n"
        "e3,payment,150000.5,,,,,no,1,1748563200,,s1,,,\n"
        "e4,payment,1,,,,,no,yes,1748563200,,,,,\n"
        "e5,refund,,,900,,,YES,0,,1748563199,,,,\n"
        ",payment,1,,,,,no,yes,1748563200,,s1,,,\n"
        "e7,payout,1,,,,,no,yes,1748563200,,s1,,,\n"
        "e8,payment,abc,,,,,no,yes,1748563200,,s1,,,\n"
        "e9,payment,1,,,,,no,yes,,,s1,,,\n")
    good, bad = gateway_recon.read_recon(spark, str(path))
    rows = {r.txn_id: r for r in good.collect()}
    assert set(rows) == {"e1", "e2", "e5"}
    assert (rows["e1"].gross_amount, rows["e1"].fee, rows["e1"].method) == (D(1500), D(30), "upi")
    assert str(rows["e1"].settled_on) == "2025-05-30"
    assert (rows["e2"].txn_type, rows["e2"].gross_amount) == ("adjustment", D(7))
    assert (rows["e5"].txn_type, rows["e5"].settlement_batch_id, str(rows["e5"].settled_on)) == (
        "chargeback_hold", "UNSETTLED", "2025-05-29")
    errors = {r.line_no: r.error for r in bad.collect()}
    assert set(errors) == {4, 5, 7, 8, 9, 10}
    assert "whole number" in errors[4] and "no settlement_id" in errors[5]


def test_line_numbers_go_on_over_part_files(spark, tmp_path):
    """Part files of one table keep the order they were written in, and no number repeats."""
    rows = [("c", n, f"bank_{n}", D(n), day(n % 20), "x", None) for n in range(1, 2001)]
    df = spark.createDataFrame(rows, S.BANK).repartition(5)
    path = f"{tmp_path}/parts"
    csv_files.write_csv(df, "bank", path, keep_close=True, rows_per_file=300)
    good, bad = csv_files.read_bank(spark, path, F.col("close_id"))
    back = [(r.line_no, r.bank_txn_id) for r in good.collect()]
    assert bad.count() == 0 and len({n for n, _ in back}) == 2000
    assert [i for _, i in sorted(back)] == [f"bank_{n}" for n in range(1, 2001)]


def test_part_files_go_by_their_numbers(spark):
    from ledgerloom.operators.scale import in_writing_order
    names = [f"dfs://a/t/part-{n:05d}-x-c000.csv" for n in range(100_001)] + ["dfs://a/t/own.csv", "dfs://b/t/part-00000.csv"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "f string")
    got = [r.f for r in rows.orderBy(*in_writing_order("f")).collect()]
    assert got == ["dfs://a/t/own.csv", *names[:100_001], "dfs://b/t/part-00000.csv"]
