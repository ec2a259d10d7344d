"""Cash, triage, forecast, sign-off, aging, scoring and risk on literal tables."""

import pytest
from tests.books import D, day
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.operators import (aging, cash, forecast, forensics, materiality, reports, risk,
                                  scoring, signoff)


def findings(spark, rows):
    return spark.createDataFrame(
        [(c, cls, sub, "L0_exact", conf, D(m), None, {}, 10, n)
         for n, (c, cls, sub, conf, m) in enumerate(rows)], S.FINDINGS)


def exceptions(spark, rows):
    return spark.createDataFrame([(c, k, s, ctx, "r", 60, n)
                                  for n, (c, k, s, ctx) in enumerate(rows)], S.EXCEPTIONS)


def matches(spark, rows):
    """(close, batch, settled, last credit, credited)"""
    return spark.createDataFrame(
        [(c, b, n, day(s), D(m), D(m), D(m), 1, day(e), day(e), "L0_exact", 1.0, "utr_join", None,
          None, None, None, None, None) for n, (c, b, s, e, m) in enumerate(rows)], S.MATCHES)


def test_cash_position(spark):
    f = findings(spark, [("c", "chargeback_hold", "h", 1.0, 40), ("c", "timing_shift", "b", 1.0, 0),
                         ("c", "unsettled_revenue", "u", 1.0, 7), ("c", "fee_overcharge", "f", 1.0, 3),
                         ("c", "unrecorded_adjustment", "a", 1.0, 2),
                         ("c", "duplicate_capture", "d", 1.0, 50)])
    e = exceptions(spark, [("c", "unclaimed_credit", "x", {"amount": "9.50"})])
    r = cash.cash_position(matches(spark, [("c", "b", 0, 0, 100)]), f, e).first()
    assert (r.in_bank, r.held, r.owed_to_us, r.owed_by_us) == (D(100), D(40), D(12), D(50))
    assert r.net_position == D(62) and r.unreconciled == D("9.50") and r.n_late == 1
    shares = {x.defect_class: x.share for x in cash.money_by_class(f).collect()}
    assert shares["timing_shift"] is None and shares["duplicate_capture"] == round(50 / 102, 6)


def test_small_items_come_back_as_a_claim(spark):
    f = findings(spark, [("c", "fee_overcharge", f"f{n}", 1.0, 400) for n in range(13)]
                 + [("c", "unrecorded_adjustment", "a", 1.0, 499), ("c", "missing_utr", "m", 1.0, 0),
                    ("c", "duplicate_capture", "d", 1.0, 500)])
    lanes = {r.subject_id: r.lane for r in materiality.triage(f).collect()}
    assert lanes["f0"] == "aggregated" and lanes["a"] == "waived"
    assert lanes["m"] == "not_about_money" and lanes["d"] == "chased"
    claim = materiality.claims(materiality.triage(f)).first()
    assert (claim["items"], claim.total, claim.largest) == (13, D(5200), D(400))
    for r in materiality.sweep(f).collect():
        assert r.chased_total + r.aggregated_total + r.waived_total == D(6199)
        assert r.items_before == 16


@pytest.mark.parametrize("n,rank", [(8, 4), (10, 6), (1, 1), (3, 2)])
def test_nearest_rank_rounds_half_to_even(spark, n, rank):
    m = matches(spark, [("c", f"b{i}", 0, i + 1, 1) for i in range(n)])
    assert forecast.lag_model(forecast.observed_lags(m)).first()["median"] == rank


def test_forecast(spark):
    m = matches(spark, [("c", f"b{i}", 0, 2, 1) for i in range(9)] + [("c", "b9", 0, 5, 1)])
    batch = "close_id string, batch_id string, expected decimal(28,2), settled_on date, utr string," \
            "batch_seq long, first_settled_on date, max_settled_on date"
    rows = [("c", "late", D(10), day(0), None, 1, day(0), day(0)),
            ("c", "due", D(30), day(20), None, 2, day(20), day(20)),
            ("c", "UNSETTLED", D(5), day(20), None, 3, day(20), day(20)),
            ("c", "negative", D(-5), day(20), None, 4, day(20), day(20))]
    open_batches = spark.createDataFrame(rows, batch)
    quiet = spark.createDataFrame([("idle", "x", D(1), day(3), None, 1, day(3), day(3))], batch)
    start = forecast.anchors(open_batches.unionByName(quiet), open_batches, m)
    a = forecast.arrivals(open_batches, start)
    by = {r.batch_id: r for r in a.collect()}
    assert set(by) == {"late", "due"}
    assert by["late"].overdue and by["late"].days_overdue == 15
    assert by["due"].expected_on == day(22) and by["due"].latest == day(25)
    totals = {r.close_id: r for r in forecast.forecast_totals(a, start).collect()}
    t = totals["c"]
    assert (totals["idle"].n_arrivals, totals["idle"].worst_case, totals["idle"].as_of) == (
        0, D(0), day(3))
    assert [(r.batch_id, r.place) for r in forecast.in_order(a).orderBy("overdue").collect()] == [
        ("due", 1), ("late", 1)]
    assert (t.total_expected, t.overdue_total, t.worst_case, t.usable) == (D(30), D(10), D(30), True)
    days = forecast.forecast_curve(a, start).collect()
    assert [r.amount for r in days if r.close_id == "idle"] == [D(0)] * 15
    curve = {r.expected_on: r.amount for r in days if r.close_id == "c"}
    assert len(curve) == 15 and curve[day(22)] == D(30) and sum(curve.values()) == D(30)


def test_backtest_splits_by_date(spark):
    m = matches(spark, [("c", f"b{i:02d}", i, i + (1 if i < 12 else 3), 1) for i in range(20)]
                + [("few", "b", 0, 1, 1)])
    by = {r.close_id: r for r in forecast.backtest(m).collect()}
    assert (by["c"].n_fit, by["c"].n_tested, by["c"].inside_band) == (12, 8, 0)
    assert by["c"].median_error_days == 2.0 and not by["c"].honest
    assert by["few"].n_tested == 0


def test_signoff(spark):
    schema = ("close_id string, n_settlement long, n_bank long, credited decimal(28,2), "
              "n_batches long, n_matches long, unattributed decimal(28,2), n_exceptions long")
    m = spark.createDataFrame([
        ("ok", 9, 9, D(100), 10, 5, D(33), 40), ("half", 9, 9, D(100), 10, 4, D(0), 0),
        ("loose", 9, 9, D(100), 10, 9, D(34), 0), ("queue", 9, 9, D(100), 10, 9, D(0), 41),
        ("empty", 9, 0, D(0), 10, 0, D(0), 0)], schema)
    fired = signoff.trips(m)
    assert {(r.close_id, r.rule) for r in fired.collect()} == {
        ("half", "match_rate_floor"), ("loose", "unattributed_money"),
        ("queue", "human_queue_depth"), ("empty", "source_present"), ("empty", "match_rate_floor")}
    assert {r.close_id: r.decision for r in signoff.decisions(m, fired).collect()} == {
        "ok": "SIGN", "half": "DO NOT SIGN", "loose": "DO NOT SIGN",
        "queue": "SIGN WITH CAVEATS", "empty": "DO NOT SIGN"}


def test_aging_counts_the_latest_run(spark):
    seen = [(m, "stale_rule", {"rule_id": "r"}) for m in (1, 2, 4, 5, 6, 6)]
    seen += [(m, "unmatched_batch", {}) for m in (1, 7)]
    e = spark.createDataFrame([("c", k, "s", ctx, "", 1, 1, "s", m) for m, k, ctx in seen],
                              "close_id string, kind string, subject_id string, "
                              "context map<string,string>, reason string, check_rank int, "
                              "line_no long, series_id string, close_seq int")
    def closes(last):
        return spark.createDataFrame([("s", m) for m in range(1, last + 1)],
                                     "series_id string, close_seq int")

    r = aging.aged_questions(e, closes(7)).first()
    assert (r.appearances, r.consecutive, r.stale, r.recurring, r.resolved) == (
        5, 3, True, True, True)
    by = {x.close_seq: x.episodic for x in aging.episodic_counts(e, closes(7)).collect()}
    assert by == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}
    # A later close without any exception resolves the question; none leaves it open.
    quiet = e.filter("kind = 'stale_rule'")
    assert aging.aged_questions(quiet, closes(7)).first().resolved
    assert not aging.aged_questions(quiet, closes(6)).first().resolved


def test_score_and_auto_clear(spark):
    f = findings(spark, [("c", "missing_utr", f"s{n}", 0.9 if n < 3 else 0.5, 0) for n in range(5)])
    truth = spark.createDataFrame([("c", "missing_utr", s) for s in ("s0", "s1", "s2", "s9")],
                                  "close_id string, defect_class string, subject_id string")
    r = scoring.score(f, truth).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (3, 2, 1, 0.6, 0.75)
    a = scoring.auto_clear(f, truth).first()
    assert (a.auto_cleared, a.threshold, a.routed_to_human) == (3, 0.9, 2)
    bins = {b.bin: (b.n, b.correct) for b in scoring.calibration(f, truth).collect()}
    assert bins == {4: (3, 3), 2: (2, 0)}


def test_stress_summary(spark):
    rows = spark.createDataFrame([(1, 1.0, 0), (1, 0.5, 0), (2, 0.5, 3)],
                                 "level_no int, precision double, false_positives int")
    s = scoring.average_by(rows, ["level_no"], ["precision"], ["false_positives"])
    assert {r.level_no: (r.precision, r.false_positives) for r in s.collect()} == {
        1: (0.75, 0), 2: (0.5, 3)}
    assert scoring.broke_at(s).first().level_no == 2
    card = spark.createDataFrame([("a", 2, 1.0, 0), ("b", 2, None, None), ("c", 3, 0.5, 2), ("d", 4, 0.0, 1)],
                                 "close_id string, hard int, precision double, fp long")
    got = {r.level_no: (r.runs, r.precision, r.false_positives, r.broke_here)
           for r in scoring.stress_summary(card, F.col("hard"), ["precision"]).collect()}
    assert got == {2: (2, 1.0, 0, False), 3: (1, 0.5, 2, True), 4: (1, 0.0, 1, False)}
    calm = scoring.stress_summary(card.filter("hard = 2"), F.col("hard"), ["precision"]).collect()
    assert [r.broke_here for r in calm] == [False]
    assert scoring.stress_summary(card.limit(0), F.col("hard"), ["precision"]).count() == 0


def test_first_digit_screen(spark):
    lived = [("c", "lived", D(round(1.09 ** n, 2))) for n in range(1, 300)]
    authored = [("c", "authored", D(5000 + n)) for n in range(200)]
    few = [("c", "few", D(5000))]
    df = spark.createDataFrame(lived + authored + few,
                               "close_id string, segment string, amount decimal(18,2)")
    p = {r.segment: r for r in forensics.digit_profile(
        df, ["close_id", "segment"], F.col("amount")).collect()}
    assert p["lived"].verdict == "within chance" and p["few"].verdict == "too few"
    assert p["authored"].verdict == "nonconformity" and p["authored"].d5 == 200
    worst = forensics.worst_digits(forensics.digit_profile(
        df, ["segment"], F.col("amount")), ["segment"]).filter("segment = 'authored'")
    assert worst.orderBy("place").first().digit == 5


def test_top_lists(spark):
    f = findings(spark, [("c", "duplicate_capture", f"s{n:02d}", 1.0, n) for n in range(20)])
    got = [r.subject_id for r in reports.largest_findings(f).orderBy("place").collect()]
    assert got == [f"s{n}" for n in range(19, 11, -1)]


# --- risk ---------------------------------------------------------------------

def features(spark, rows):
    schema = "close_id string, batch_id string, label double, " + ", ".join(
        f"{n} double" for n in risk.FEATURES)
    return spark.createDataFrame(rows, schema)


def test_risk_model_learns_and_calibrates(spark):
    rows = []
    for n in range(400):
        signal = float(n % 10)
        label = 1.0 if n % 10 >= 7 else 0.0
        rows.append((f"c{n // 20 + 10}", f"b{n}", label, signal, *[float((n * k) % 5)
                                                            for k in range(2, 17)]))
    df = features(spark, rows)
    model = risk.train(df.filter("close_id < 'c22'"))
    held = df.filter("close_id >= 'c22'")
    m = risk.evaluate(model.predict(held), model.base_rate).first()
    assert m.auc > 0.95 and m.skill > 0.5
    assert model.importances()[0][0] == "n_txns"
    with pytest.raises(ValueError):
        risk.rank_close(model, df.filter("close_id = 'c12'"))


@pytest.mark.parametrize("backend", ["logistic", "gbt"])
def test_audit_holds_for_a_fitted_model_and_fails_for_a_spoiled_one(spark, backend, monkeypatch):
    rows = [(f"c{n // 20 + 10}", f"b{n}", float((n * 7) % 10 + (n % 3) >= 7), float((n * 7) % 10),
             *[float((n * k) % 5) for k in range(2, 16)], 1.0) for n in range(400)]
    df = features(spark, rows)
    learn_on, held = df.filter("close_id < 'c22'"), df.filter("close_id >= 'c22'")
    model = risk.train(learn_on, backend)
    a = risk.audit(model, learn_on, held).first()
    assert a.scores_agree and a.rising and a.beats_base_rate and a.shared_closes == 0
    assert a.at_minimum is (True if backend == "logistic" else None)
    assert (a.n, a.positives) == (160, sum(r[2] for r in rows[240:]))
    assert risk.audit(model, df, held).first().shared_closes == 8

    # The calibrator against least squares by the best means over every stretch of steps.
    pooled = model.scores(risk.split(learn_on)[1]).groupBy("score").agg(
        F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("score").collect()
    mean = lambda a, b: (sum(p.y * p.w for p in pooled[a:b + 1])
                         / sum(p.w for p in pooled[a:b + 1]))
    n = len(pooled)
    best = {p.score: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1))
            for i, p in enumerate(pooled)}
    for r in model.predict(learn_on).select("score", "risk").distinct().collect():
        if r.score in best:
            assert r.risk == pytest.approx(best[r.score])

    model.values = model.values[::-1]
    assert not risk.audit(model, learn_on, held).first().rising
    if backend == "logistic":
        monkeypatch.setattr(risk, "plain_score", lambda model: F.lit(0.5))
        spoiled = risk.audit(model, learn_on, held).first()
        assert not spoiled.scores_agree and not spoiled.at_minimum


def test_one_class_is_refused(spark):
    df = features(spark, [("c", f"b{n}", 0.0, *[1.0] * 16) for n in range(20)])
    model = risk.train(df)
    assert model.classifier is None and model.predict(df).first().risk == 0.5


def test_calibration_is_a_step(spark):
    model = risk.RiskModel(None, [0.2, 0.4, 0.6], [0.1, 0.3, 0.9], "x", 0.1, None)
    df = spark.createDataFrame([(s,) for s in (0.0, 0.2, 0.21, 0.4, 0.5, 0.9)], "score double")
    model.scores = lambda rows: rows
    assert [r.risk for r in model.predict(df).orderBy("score").collect()] == [
        0.1, 0.1, 0.3, 0.3, 0.9, 0.9]


def test_lists_by_size_and_effort(spark):
    f = findings(spark, [("c", "missing_utr", f"s{n}", 0.9, v) for n, v in
                         enumerate((600, 900, 40, 70, 600))])
    placed = materiality.in_order(materiality.triage(f)).collect()
    assert {(r.lane, r.subject_id, r.place) for r in placed} == {
        ("chased", "s1", 1), ("chased", "s0", 2), ("chased", "s4", 3),
        ("waived", "s3", 1), ("waived", "s2", 2)}
    done = spark.createDataFrame(
        [("c", "accepted"), ("c", "refused"), ("c", "deferred"), ("c", "abandoned")],
        "close_id string, outcome string")
    records = spark.createDataFrame([("c", 50), ("idle", 9)], "close_id string, records long")
    by = {r.close_id: r for r in scoring.effort(f, done, records).collect()}
    assert (by["c"].calls, by["c"].calls_per_100) == (2, 4.0)
    assert by["c"].deterministic_share == pytest.approx(5 / 6)
    assert (by["idle"].calls_per_100, by["idle"].deterministic_share) == (0.0, 1.0)
