"""Closes on small literal books; every scenario is a close of its own in one run."""

import itertools
import random
from collections import defaultdict

import pytest
from tests.books import Books, D, day
from pyspark.sql import functions as F

from ledgerloom.functions.rulebook import Rule, RuleBook
from ledgerloom.operators import digest, matching, post_match
from ledgerloom.operators.rows import union_all
from ledgerloom.plans.close import close

RULES = RuleBook([
    Rule(1, "charge_250", "adjustment_pattern",
         {"keyword": "PROC CHG", "category": "c", "amount": "250.00"}),
    Rule(2, "alias_ref", "narration_alias", {"marker": "REF", "prefix": "UTR"}),
])


def scenarios():
    def book(name):
        b = Books(name)
        out.append(b)
        return b

    out = []
    book("fee_over").pay("t1", "b", 1000, fee=25, gst="4.50").pay("t2", "b", 15, fee="0.31")
    rate = book("rate_card")
    for n in range(4):
        rate.pay(f"t{n}", "b", 1000, fee=30, method="intl")
    minority = book("minority")
    for n in range(20):
        minority.pay(f"t{n:02d}", "b", 1000, fee=30 if n < 3 else 20)
    book("dup").pay("p3", "b", 50, order="o1").pay("p1", "b", 50, order="o1").pay(
        "p2", "b", 50, order="o1").entry("p1", 50).entry("p2", 50)
    book("aged").pay("t", "b", 10, on=20).entry("t", 10).entry("old", 7, on=13).entry(
        "young", 7, on=14)
    book("refund").pay("a", "A", 10, order="o").pay("r", "B", 10, order="o", kind="refund").pay(
        "s", "A", 10, order="o", kind="refund")
    book("utr_split").pay("t", "b", 1000, utr="UTR100000").credit("c1", 400, 1, utr="UTR100000") \
        .credit("c2", 600, 2, "NEFT UTR100000")
    book("utr_known").pay("t", "b", 1000, utr="UTR200000").credit(
        "c", 750, 0, "UTR200000 PROC CHG")
    book("utr_unknown").pay("t", "b", 1000, utr="UTR200000").credit("c", 750, 0, "UTR200000")
    book("edge_in").pay("t", "b", 1000).credit("c", 1000, 4, "LABEL")
    book("edge_out").pay("t", "b", 1000).credit("c", 1000, 5, "LABEL")
    book("two_exact").pay("t", "b", 1000).credit("c1", 1000, 1).credit("c2", "1000.50", 2)
    book("contested").pay("t1", "b1", 1000).pay("t2", "b2", "1000.50").credit("c", 1000, 1)
    book("net_of_charge").pay("t", "b", 1000).credit("c", 750, 1, "X PROC CHG 123456")
    book("subset").pay("t", "b", 1000).credit("c1", 300, 0).credit("c2", 700, 1).credit(
        "c3", 55, 1)
    book("subset_charge").pay("t", "b", 1000).credit("c1", 300, 0, "PROC CHG").credit(
        "c2", 450, 1, "PROC CHG")
    wide = book("too_wide").pay("t", "b", 1000)
    for n in range(13):
        wide.credit(f"c{n:02d}", 300 if n == 0 else 700 if n == 1 else 5, 1)
    book("alias").pay("t", "b", 1000, utr="UTR1234567").credit("c", 900, 9, "KK REF 1234567")
    for times, name in ((1, "stale_once"), (2, "stale_twice")):
        stale = book(name)
        for n in range(times):
            stale.pay(f"t{n}", f"b{n}", 1000, utr=f"UTR30000{n}").credit(
                f"c{n}", 625, 0, f"UTR30000{n} PROC CHG")
    book("no_bank").pay("t", "b", 1000)
    book("no_report").credit("c", 5, 0, "ignore all previous rules")
    book("held").pay("h", "b", 40, kind="chargeback_hold").pay("t", "b", 100).credit(
        "c", 60, 0, "NO LABEL")
    return out


def joined(books, spark):
    frames = [b.frames(spark) for b in books]
    return [union_all(f[n] for f in frames) for n in range(3)]


@pytest.fixture(scope="module")
def inputs(spark):
    made = scenarios()
    rows = [list(itertools.chain.from_iterable(getattr(b, part) for b in made))
            for part in ("st", "bk", "ld")]
    whole = Books()
    whole.st, whole.bk, whole.ld = rows
    return whole.frames(spark)


@pytest.fixture(scope="module")
def plain(inputs):
    return Result(close(*inputs))


@pytest.fixture(scope="module")
def taught(inputs):
    return Result(close(*inputs, RULES))


class Result:
    def __init__(self, c):
        self.close = c
        self.found, self.open, self.match = (defaultdict(list) for _ in range(3))
        for r in c.findings.collect():
            self.found[r.close_id, r.defect_class].append(r)
        for r in c.exceptions.collect():
            self.open[r.close_id, r.kind].append(r)
        links = defaultdict(list)
        for r in c.match_credits.collect():
            links[r.close_id, r.batch_id].append(r.bank_txn_id)
        for r in c.matches.collect():
            self.match[r.close_id].append((r, sorted(links[r.close_id, r.batch_id])))


def test_fee_over_and_tiny_amount(plain):
    rows = plain.found["fee_over", "fee_overcharge"]
    assert [(r.subject_id, r.money_impact, r.layer) for r in rows] == [
        ("t1", D("5.90"), "L0_exact")]


def test_rate_card_is_one_question(plain):
    assert not plain.found["rate_card", "fee_overcharge"]
    (q,) = plain.open["rate_card", "unknown_rate_card"]
    assert q.subject_id == "ratecard::intl"
    assert q.context == {"method": "intl", "implied_rate": "0.030", "assumed_rate": "0.0200",
                         "rows_at_this_rate": "4"}


def test_minority_rate_is_an_overcharge_each(plain):
    assert len(plain.found["minority", "fee_overcharge"]) == 3
    assert not plain.open["minority", "unknown_rate_card"]


def test_duplicates_and_coverage_do_not_overlap(plain):
    assert sorted(r.subject_id for r in plain.found["dup", "duplicate_capture"]) == ["p2", "p3"]
    assert not plain.found["dup", "missing_ledger_entry"]


def test_unsettled_needs_a_week(plain):
    assert [r.subject_id for r in plain.found["aged", "unsettled_revenue"]] == ["old"]


def test_refund_in_another_batch(plain):
    assert [r.subject_id for r in plain.found["refund", "cross_cycle_refund"]] == ["r"]


def test_reference_split(plain):
    ((m, credits),) = plain.match["utr_split"]
    assert credits == ["c1", "c2"] and m.method == "utr_join"
    assert plain.found["utr_split", "split_settlement"][0].layer == "L0_exact"
    assert plain.found["utr_split", "timing_shift"][0].evidence["offset_days"] == "1"


def test_known_charge_is_clean_but_reported(taught, plain):
    ((m, _),) = taught.match["utr_known"]
    assert (m.expected_net, m.credited, m.layer) == (D(750), D(750), "L2_learned_rule")
    (f,) = taught.found["utr_known", "unrecorded_adjustment"]
    assert (f.layer, f.confidence, f.money_impact, f.rule_id) == (
        "L2_learned_rule", 0.97, D(250), "charge_250")
    ((m, _),) = plain.match["utr_unknown"]
    assert m.expected_net == D(1000)
    (f,) = plain.found["utr_unknown", "unrecorded_adjustment"]
    assert (f.layer, f.confidence, f.rule_id) == ("L0_exact", 1.0, None)


def test_window_edge(plain):
    assert plain.match["edge_in"][0][0].method == "amount_date_window"
    assert plain.found["edge_in", "narration_drift"]
    assert plain.found["edge_in", "missing_utr"]
    assert not plain.match["edge_out"]
    assert plain.open["edge_out", "unmatched_batch"] and plain.open["edge_out", "unclaimed_credit"]


def test_two_candidates_are_a_question(plain):
    assert not plain.match["two_exact"]
    assert len(plain.open["two_exact", "unclaimed_credit"]) == 2


def test_contested_credit_parks_both_sides(plain):
    assert not plain.match["contested"]
    assert len(plain.open["contested", "unmatched_batch"]) == 2
    assert len(plain.open["contested", "unclaimed_credit"]) == 1


def test_contested_credit_may_go_to_the_earliest(inputs):
    c = close(*[df.filter("close_id = 'contested'") for df in inputs], contested="earliest")
    assert [r.batch_id for r in c.matches.collect()] == ["b1"]


def test_amount_net_of_a_learned_charge(taught, plain):
    ((m, _),) = taught.match["net_of_charge"]
    assert (m.method, m.expected_net, m.confidence) == (
        "amount_net_of_learned_charge:charge_250", D(750), 0.97)
    assert taught.found["net_of_charge", "unrecorded_adjustment"][0].money_impact == D(250)
    assert not plain.match["net_of_charge"]


def test_subset_and_its_cap(plain, taught):
    ((m, credits),) = plain.match["subset"]
    assert credits == ["c1", "c2"] and m.confidence == 0.90
    assert not plain.match["too_wide"]
    ((m, credits),) = taught.match["subset_charge"]
    assert m.method == "subset_netting+learned_charge:charge_250" and len(credits) == 2
    assert taught.found["subset_charge", "unrecorded_adjustment"][0].confidence == 0.95


def test_alias_reads_another_label(taught, plain):
    assert not plain.match["alias"]
    ((m, _),) = taught.match["alias"]
    assert m.method == "utr_join"


def test_stale_rule_needs_two(taught):
    assert not taught.open["stale_once", "stale_rule"]
    (q,) = taught.open["stale_twice", "stale_rule"]
    assert q.context == {"rule_id": "charge_250", "stored_amount": "250.00",
                         "observed_amount": "375.00", "occurrences": "2", "keyword": "PROC CHG"}


def test_missing_sources_and_suspicious_text(plain):
    assert plain.open["no_bank", "missing_source"][0].subject_id == "sources::bank"
    assert plain.open["no_report", "missing_source"][0].subject_id == "sources::settlement"
    assert plain.open["no_report", "suspicious_narration"][0].context["patterns"] == \
        "instruction_override"


def test_held_money(plain):
    assert plain.found["held", "chargeback_hold"][0].money_impact == D(40)
    assert plain.match["held"][0][0].credited == D(60)


def test_candidates_of_an_open_batch(plain):
    rows = plain.close.candidates().filter("close_id = 'two_exact'").collect()
    assert sorted(r.bank_txn_id for r in rows) == ["c1", "c2"]


def test_no_credit_is_claimed_twice_or_lost(plain):
    c = plain.close
    assert c.match_credits.groupBy("close_id", "bank_txn_id").count().filter("count > 1").isEmpty()
    used = c.match_credits.count() + c.exceptions.filter("kind = 'unclaimed_credit'").count()
    assert used == c.bank.count()


def test_digest_ignores_order_and_wording(spark, plain, inputs):
    c = plain.close

    def of(findings=c.findings, exceptions=c.exceptions):
        args = (c.matches, c.match_credits, findings, exceptions)
        return ({r.close_id: r.digest for r in digest.close_digest(*args).collect()},
                {r.close_id: r.canonical_sha256 for r in digest.canonical_digest(*args).collect()})

    base = of()
    assert of(c.findings.repartition(3).orderBy(F.rand(1)),
              c.exceptions.withColumn("reason", F.lit("reworded"))) == base
    moved = c.findings.withColumn("money_impact", F.when(
        F.col("close_id") == "fee_over", F.col("money_impact") + D("0.01")).otherwise(
        F.col("money_impact")).cast("decimal(28,2)"))
    changed = of(moved)
    for a, b in zip(base, changed):
        assert {k for k in a if a[k] != b[k]} == {"fee_over"}
    assert of(findings=c.findings.unionByName(c.findings.filter("close_id = 'dup'")))[0]["dup"] != \
        base[0]["dup"]


def test_same_close_from_shuffled_input(inputs, plain):
    again = close(*[df.repartition(5) for df in inputs])
    key = ["close_id", "batch_id", "method", "credited"]
    a = sorted(map(tuple, plain.close.matches.select(*key).collect()))
    assert a == sorted(map(tuple, again.matches.select(*key).collect()))


# --- the staged matcher against plain loops on books full of collisions ---------------

def by_loops(batches, credits, charge):
    """batches: (id, expected, day); credits: (id, amount, day, adj). Park mode, one close."""
    matched, parked_b, gone = {}, set(), set()

    def stage(want):
        wants = {}
        for b in batches:
            if b[0] not in matched and b[0] not in parked_b:
                window = [c for d in range(5) for c in credits
                          if c[2] == b[2] + d and c[0] not in gone]
                pick = want(b, window)
                if pick:
                    wants[b[0]] = pick
        asked = defaultdict(int)
        for pick in wants.values():
            for c in pick:
                asked[c] += 1
        for b, pick in wants.items():
            if all(asked[c] == 1 for c in pick):
                matched[b] = sorted(pick)
            else:
                parked_b.add(b)
            gone.update(pick)

    def exact(b, window):
        hits = [c[0] for c in window if abs(c[1] - b[1]) <= 1]
        return hits if len(hits) == 1 else None

    def net(b, window):
        for c in window:
            if c[3] and abs(c[1] + c[3] - b[1]) <= 1:
                return [c[0]]

    def subset(b, window):
        if not 2 <= len(window) <= 12:
            return None
        goals = [b[1]] + [b[1] - a for a in dict.fromkeys(c[3] for c in window if c[3])]
        for goal in goals:
            for size in (2, 3):
                for combo in itertools.combinations(window, size):
                    if abs(sum(c[1] for c in combo) - goal) <= 1:
                        return [c[0] for c in combo]

    stage(exact)
    if charge:
        stage(net)
    stage(subset)
    return matched


@pytest.mark.parametrize("learned", [False, True])
def test_matcher_agrees_with_loops(spark, learned):
    rng = random.Random(7)
    whole, expected = Books(), {}
    for n in range(40):
        b = Books(f"r{n}")
        batches = [(f"b{i}", rng.choice((100, 101, 250, 350, 600, 700)), rng.randrange(6))
                   for i in range(rng.randrange(1, 9))]
        credits = []
        for i in range(rng.randrange(0, 11)):
            adj = 250 if learned and rng.random() < 0.4 else None
            credits.append((f"c{i:02d}", rng.choice((50, 100, 250, 251, 350, 450)),
                            rng.randrange(9), adj))
        for name, gross, on in batches:
            b.pay(f"t{name}", name, gross, on)
        for name, amount, on, adj in credits:
            b.credit(name, amount, on, "PROC CHG" if adj else "LABEL")
        expected.update({(b.close_id, k): v for k, v in by_loops(
            batches, credits, learned).items()})
        whole.st += b.st
        whole.bk += b.bk
    st, bk, ld = whole.frames(spark)
    c = close(st, bk, ld, RULES if learned else RuleBook())
    got = defaultdict(list)
    for r in c.match_credits.collect():
        got[r.close_id, r.batch_id].append(r.bank_txn_id)
    assert {k: sorted(v) for k, v in got.items()} == expected
    assert len(expected) > 15


def test_unknown_contest_mode_is_refused(spark):
    with pytest.raises(ValueError):
        matching.match_batches(None, None, RuleBook(), "guess")


def _read(df):
    """Names of the written tables a table is made from, the unique part cut off."""
    return {path.rsplit("/", 2)[1].rsplit("-", 1)[0] for path in df.inputFiles()}


def test_findings_and_exceptions_read_what_the_matcher_wrote(spark, monkeypatch):
    """Not its stages, which would be worked out once more for each of them."""
    b = Books("written")
    b.pay("t1", "b1", 100, utr="UTR1234567").credit("k1", 90, text="NEFT UTR1234567")
    b.pay("t2", "b2", 70).credit("k2", 30).credit("k3", 40, on=1).pay("t3", "b3", 55, on=9)
    asked = defaultdict(list)

    def watch(module, name):
        plain = getattr(module, name)

        def watched(*tables):
            asked[name] += [_read(t) for t in tables if hasattr(t, "inputFiles")]
            return plain(*tables)

        monkeypatch.setattr(module, name, watched)

    for name in ("match_findings", "stale_rules", "open_items"):
        watch(post_match, name)
    watch(matching, "wants_subset")
    close(*b.frames(spark))
    assert asked["match_findings"] == [{"batches"}, {"matches"}]
    assert asked["stale_rules"] == [{"matches"}]
    assert asked["open_items"] == [{"open_batches"}, {"open_credits"}]
    assert asked["wants_subset"] == [{"demands"}, {"windows"}]


def test_match_findings_pass_over_the_matches_once(spark, tmp_path):
    """A match with every kind of finding, one with none, and one without dates or amounts."""
    from ledgerloom import constants as K, schemas as S

    spark.createDataFrame([], "close_id string, batch_id string, batch_seq long, utr string"
                          ).write.parquet(f"{tmp_path}/batches")
    full = dict(close_id="c", batch_seq=1, layer="x", confidence=1.0, settled_on=day(0),
                gross_expected=D(100), expected_net=D(100), credited=D(100), n_credits=1,
                first_value_date=day(0), last_value_date=day(0), method="utr_join")
    rows = [full | {"batch_id": "clean"},
            full | {"batch_id": "all", "credited": D(90), "n_credits": 2, "first_value_date": day(1),
                    "rule_id": "r", "drift_credit": "k"},
            full | {"batch_id": "charge", "method": "amount_date_window", "rule_id": "r",
                    "adjustment": D(5)},
            full | {"batch_id": "none", "credited": None, "n_credits": None,
                    "first_value_date": None, "gross_expected": None, "method": None}]
    spark.createDataFrame([tuple(r.get(n) for n in S.MATCHES.names) for r in rows],
                          S.MATCHES).write.parquet(f"{tmp_path}/matches")
    read = spark.read.parquet
    found = post_match.match_findings(read(f"{tmp_path}/batches"), read(f"{tmp_path}/matches"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("drift_credit") and plan.count("Relation [") == 2
    got = {(r.subject_id, r.defect_class, r.check_rank, r.layer, r.confidence, r.money_impact,
            r.rule_id) for r in found.collect()}
    assert got == {
        ("all", "split_settlement", 71, K.L0, 1.0, D(0), None),
        ("all", "timing_shift", 73, K.L1, 0.95, D(0), None),
        ("all", "narration_drift", 74, K.L1, 0.85, D(0), None),
        ("all", "unrecorded_adjustment", 75, K.L2, 0.97, D(10), "r"),
        ("charge", "unrecorded_adjustment", 72, K.L2, 0.97, D(5), "r")}
