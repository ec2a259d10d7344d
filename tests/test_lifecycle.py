"""Rules and proposals: nothing is believed that the numbers or history contradict."""

import json
import os

import pytest
from tests.books import Books, D
from pyspark.sql import functions as F

from ledgerloom import schemas as S
from ledgerloom.functions.rulebook import Rule, RuleBook
from ledgerloom.operators import proposals, rules
from ledgerloom.plans.campaign import drift_table, run_campaign
from ledgerloom.plans.close import close
from ledgerloom.sources import rule_files


def cases(spark, *rows):
    return spark.createDataFrame([("c", f"s{n}", ctx, right) for n, (ctx, right) in
                                  enumerate(rows)], S.CASES)


def test_admission_gate(spark):
    history = cases(spark, ({"narration": "NEFT UTR123456 REF 999999"}, {"utr": "UTR123456"}),
                    ({"narration": "X PROC CHG"}, {"amount": "250.00"}),
                    ({"bank": "HDFC"}, {"expected_offset_days": "2"}))
    tested = [
        Rule(1, "a", "narration_alias", {"marker": "REF", "prefix": "UTR"}),
        Rule(2, "b", "narration_alias", {"marker": "UTR", "prefix": "UTR"}),
        Rule(3, "c", "adjustment_pattern", {"keyword": "PROC", "category": "k", "amount": "375"}),
        Rule(4, "d", "adjustment_pattern", {"keyword": "PROC", "category": "k",
                                            "amount": "250.00"}),
        Rule(5, "e", "bank_timing", {"bank": "HDFC", "offset_days": "3"}),
        Rule(6, "f", "fee_variant", {"method": "card", "rate": "0.03"}),
    ]
    got = {r.rule_seq: (r.applicable, r.admitted) for r in rules.admission(tested, history)
           .collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, False), 4: (1, True), 5: (1, False),
                   6: (0, True)}
    why = rules.regressions(tested, history).filter("rule_seq = 1").first().regression
    assert why == "s0: utr would become UTR999999, confirmed value is UTR123456"


def table(spark, *rows):
    return spark.createDataFrame([(n, rid, kind, params, "", "", 0.9, status, None, None)
                                  for n, (rid, kind, params, status) in enumerate(rows, 1)],
                                 S.RULES)


def answers(spark, *rows):
    schema = ("close_id string, subject_id string, check_rank int, line_no long, source string, "
              "retire_rule string, proposed_rule struct<kind:string,params:map<string,string>,"
              "confidence:double>")
    return spark.createDataFrame([("c", s, 60, n, "t", gone, rule)
                                  for n, (s, gone, rule) in enumerate(rows)], schema)


def charge(keyword, amount):
    return ("adjustment_pattern", {"keyword": keyword, "category": "k", "amount": amount}, 0.95)


def test_learning_retires_dedups_and_never_reissues_an_id(spark):
    have = table(spark, ("adjustment_pattern_001", "adjustment_pattern",
                         {"keyword": "PROC", "amount": "250"}, "live"),
                 ("adjustment_pattern_002", "adjustment_pattern", {"keyword": "SVC"}, "retired"),
                 ("fee_variant_001", "fee_variant", {"method": "upi", "rate": "0.01"}, "live"))
    new = answers(spark, ("stale::x", "adjustment_pattern_001", charge("PROC", "375.00")),
                  ("b1", None, charge("NEW", "9")), ("b2", None, charge("NEW", "11")),
                  ("b3", None, ("fee_variant", {"method": "upi", "rate": "0.02"}, 1.0)),
                  ("b4", None, ("narration_alias", {"marker": "REF", "prefix": "UTR"}, 0.9)))
    history = cases(spark, ({"narration": "REF 123456 UTR654321"}, {"utr": "UTR654321"}))
    got = rules.learn(new, have, history, "m1").collect()
    live = {r.rule_id: r.params.get("amount") for r in got if r.status == "live"}
    assert live == {"fee_variant_001": None, "adjustment_pattern_003": "375.00",
                    "adjustment_pattern_004": "9"}
    gone = {r.rule_id: r.reason for r in got if r.status == "retired"}
    assert gone["adjustment_pattern_001"] == "superseded from stale::x"
    assert [r.kind for r in got if r.status == "rejected"] == ["narration_alias"]


def test_proposed_rules_need_their_parameters(spark):
    df = answers(spark, ("a", None, charge("K", "1")), ("b", None, ("fee_variant", {"rate": "1"}, 1.0)),
                 ("c", None, ("made_up", {"x": "y"}, 1.0)), ("d", None, None),
                 ("e", None, ("narration_alias", {"pattern": "p", "utr": "u"}, 1.0)))
    assert [r.subject_id for r in rules.coerce(df).collect()] == ["a"]
    learnt = rules.learn(df, table(spark), cases(spark), "m1").collect()
    assert [(r.kind, r.origin_exception) for r in learnt] == [("adjustment_pattern", "a")]


def test_rules_of_accepted_proposals_are_learnt(spark):
    rule = "struct<kind:string,params:map<string,string>,confidence:double>"
    rows = [("c", "s1", 1, 1, "accepted", charge("NEW", "9")), ("c", "s2", 1, 2, "refused", charge("NO", "9")),
            ("c", "s3", 1, 3, "accepted", None)]
    df = spark.createDataFrame(rows, "close_id string, subject_id string, check_rank int, "
                               f"line_no long, outcome string, proposed_rule {rule}")
    learnt = rules.learn(rules.accepted_rules(df), table(spark), cases(spark), "m1").collect()
    assert [(r.rule_id, r.params["keyword"]) for r in learnt] == [("adjustment_pattern_001", "NEW")]


def test_operator_rules():
    assert rules.operator_rule(1, charge=("proc", "250.005")).params["amount"] == "250.00"
    assert rules.operator_rule(1, rate=("UPI", "0.01")).params == {"method": "upi", "rate": "0.01"}
    assert rules.operator_rule(1, alias=("ref", "UTR")).params["marker"] == "REF"
    assert rules.operator_rule(1) is None


def test_rule_lines(spark):
    df = table(spark, ("a", "bank_timing", {"bank": "HDFC", "offset_days": "2"}, "live"),
               ("b", "narration_alias", {"marker": "REF"}, "live"),
               ("c", "fee_variant", {"method": "upi", "rate": "0.03"}, "live"),
               ("d", "adjustment_pattern", {"keyword": "K", "category": "c"}, "live"))
    got = [r.x for r in df.orderBy("rule_seq").select(rules.rule_summary().alias("x")).collect()]
    assert got == ["HDFC settles T+2", "reference follows 'REF'", "upi is billed at 3.00%", "K -> c"]


def test_rule_file_round_trip_and_first_format(spark, tmp_path):
    have = table(spark, ("a_001", "fee_variant", {"method": "upi", "rate": "0.01"}, "live"),
                 ("b_001", "bank_timing", {"bank": "X", "offset_days": "2"}, "retired"),
                 ("b_002", "bank_timing", {"bank": "X", "offset_days": "3"}, "live"))
    rule_files.write_rules(have, str(tmp_path / "v2"))
    back = rule_files.read_rules(spark, str(tmp_path / "v2")).collect()
    assert [(r.rule_id, r.status) for r in sorted(back, key=lambda r: r.rule_seq)] == [
        ("a_001", "live"), ("b_002", "live"), ("b_001", "retired")]
    old = tmp_path / "v1.json"
    old.write_text(json.dumps([{"rule_id": "z", "kind": "fee_variant", "confidence": 0.5,
                                "params": {"method": "m", "rate": 0.03},
                                "origin_exception": "e", "learned_on": "d"}], indent=2))
    (r,) = rule_files.read_rules(spark, str(old)).collect()
    assert (r.rule_id, r.params, r.status) == ("z", {"method": "m", "rate": "0.03"}, "live")


def test_documents_of_several_series(spark, tmp_path):
    rows = [(1, "a_001", "bank_timing", {"bank": "X", "offset_days": "2"}, "", "", 0.9, "live", None, name)
            for name in ("m 1", "m+2", "50%/x", "")]
    have = spark.createDataFrame(rows, S.RULES).withColumn("series_id", F.nullif("series_id", F.lit("")))
    rule_files.write_rules(have, str(tmp_path / "all"))
    back = rule_files.read_rules(spark, str(tmp_path / "all")).collect()
    assert {(r.series_id, r.rule_id) for r in back} == {(n, "a_001") for n in ("m 1", "m+2", "50%/x", None)}


def test_rule_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    first = table(spark, ("a_001", "fee_variant", {"method": "upi", "rate": "0.01"}, "live"),
                  ("b_pending", "bank_timing", {"bank": "X", "offset_days": "2"}, "rejected"))
    gone = rules.retire(first, spark.createDataFrame([(None, "a_001", "old")], "series_id string, rule_id string, reason string"))
    later = gone.unionByName(spark.createDataFrame(
        [(3, "a_002", "fee_variant", {"method": "upi", "rate": "0.02"}, "", "", 0.9, "live", None, None)], S.RULES))

    def state():
        return sorted((r.rule_seq, r.rule_id, r.status, r.reason, r.params.get("rate"))
                      for r in rule_files.read_log(spark, folder).collect())

    assert state() == []
    empty = spark.createDataFrame([], S.RULES)
    assert rule_files.append(rule_files.changes(empty, first), folder) == 1
    events = rule_files.changes(first, later)
    assert sorted((r.event, r.rule_id) for r in events.collect()) == [("admit", "a_002"), ("retire", "a_001")]
    assert rule_files.append(events, folder) == 2
    want = [(1, "a_001", "retired", "old", "0.01"), (2, "b_pending", "rejected", None, None),
            (3, "a_002", "live", None, "0.02")]
    assert state() == want
    # A batch without its marker was interrupted: it does not count and is written over.
    rule_files.changes(empty, later).write.parquet(folder + "/log/3")
    assert state() == want
    assert rule_files.compact(spark, folder) == 2 and state() == want
    assert rule_files.append(rule_files.changes(later, rules.retire(later, spark.createDataFrame(
        [(None, "a_002", "again")], "series_id string, rule_id string, reason string"))), folder) == 3
    assert state()[2][2:4] == ("retired", "again") and len(state()) == 3


def test_series_learn_for_themselves(spark):
    schema = "close_id string, subject_id string, check_rank int, line_no long, source string, " \
             "retire_rule string, proposed_rule struct<kind:string,params:map<string,string>,confidence:double>"
    alias = ("narration_alias", {"marker": "REF", "prefix": "UTR"}, 0.9)
    rows = [("m1_1", "s1", 60, 1, "t", None, charge("CHG", "250")), ("m2_1", "s2", 60, 1, "t", None, charge("CHG", "375")),
            ("m1_1", "s3", 60, 2, "t", None, alias), ("m2_1", "s4", 60, 2, "t", None, alias)]
    # The label misleads in the history of one merchant only.
    history = spark.createDataFrame([("m1_1", "c", {"narration": "REF 123456 UTR654321"}, {"utr": "UTR654321"})], S.CASES)
    series = lambda c: F.substring_index(c, "_", 1)
    got = materialised = rules.learn(spark.createDataFrame(rows, schema), table(spark), history, "p1", series)
    have = sorted((r.series_id, r.rule_seq, r.rule_id, r.status) for r in materialised.collect())
    assert have == [("m1", 1, "adjustment_pattern_001", "live"), ("m1", 2, "narration_alias_pending", "rejected"),
                    ("m2", 1, "adjustment_pattern_001", "live"), ("m2", 2, "narration_alias_001", "live")]
    again = spark.createDataFrame([("m2_2", "stale::x", 50, 1, "t", "adjustment_pattern_001", charge("CHG", "400"))], schema)
    end = {(r.series_id, r.rule_id): r.status for r in rules.learn(again, got, cases(spark), "p2", series).collect()}
    assert end[("m1", "adjustment_pattern_001")] == "live" and end[("m2", "adjustment_pattern_001")] == "retired"
    assert end[("m2", "adjustment_pattern_002")] == "live"


# --- proposals ------------------------------------------------------------------

GATE = [
    ("no ids", "split_settlement", [], None, False),
    ("unknown id", "split_settlement", ["zz"], None, False),
    ("split off by 1.00", "split_settlement", ["c999"], None, True),
    ("split off by 1.01", "split_settlement", ["c99899"], None, False),
    ("adjustment 25%", "unrecorded_adjustment", ["c750"], None, True),
    ("adjustment 26%", "unrecorded_adjustment", ["c740"], None, False),
    ("nothing short", "unrecorded_adjustment", ["c999"], None, False),
    ("claimed closes", "whatever", ["c750"], "250", True),
    ("claimed leaves a gap", "whatever", ["c750"], "248.99", False),
    ("claimed negative", "whatever", ["c750"], "-250", False),
    ("claimed is text", "whatever", ["c750"], "lots", False),
    ("claimed above credited", "whatever", ["c10"], "990", False),
    ("metadata closes", "narration_drift", ["c999"], None, True),
    ("metadata differs", "missing_utr", ["c750"], None, False),
    ("unheard of", "gift", ["c999"], None, False),
    ("upper case", "SPLIT_SETTLEMENT", ["c999"], None, True),
]


def test_proposal_gate(spark):
    bank = Books()
    for name, amount in (("c999", 999), ("c99899", "998.99"), ("c750", 750), ("c740", 740),
                         ("c10", 10)):
        bank.credit(name, amount)
    _, bk, _ = bank.frames(spark)
    asked = spark.createDataFrame(
        [("c1", name, cls, ids, "", 0.9, adj, None) for name, cls, ids, adj, _ in GATE],
        S.PROPOSALS)
    nets = spark.createDataFrame([("c1", name, D(1000)) for name, *_ in GATE],
                                 "close_id string, batch_id string, expected decimal(28,2)")
    got = {r.subject_id: r.ok for r in proposals.verify(asked, nets, bk).collect()}
    assert got == {name: ok for name, *_, ok in GATE}


def test_parsing_tolerates_chat_and_refuses_to_guess(spark):
    good = '{"defect_class":"timing_shift","bank_txn_ids":["a"],"confidence":0.7}'
    texts = {"plain": good, "fenced": f"Sure\n```json\n{good}\n```\nok", "chatty": f"I say {good}!",
             "broken": "{oops", "typed": '{"defect_class":"x","confidence":"0.5",'
                                         '"claimed_adjustment":12.5}'}
    df = spark.createDataFrame([("c", k, v) for k, v in texts.items()],
                               "close_id string, subject_id string, text string")
    got = {r.subject_id: r for r in proposals.parse(df).collect()}
    for name in ("plain", "fenced", "chatty"):
        assert (got[name].defect_class, got[name].confidence) == ("timing_shift", 0.7)
    assert (got["broken"].defect_class, got["broken"].confidence) == ("unknown", 0.0)
    assert (got["typed"].confidence, got["typed"].claimed_adjustment) == (0.5, "12.5")


def outcomes(spark, steps, records=10_000):
    """steps: one letter per queued item: a accepted, r refused, d declined, u unknown class."""
    queue = spark.createDataFrame([("c", "unmatched_batch", f"s{n:03d}", {}, "", 60, n)
                                   for n in range(len(steps))], S.EXCEPTIONS)
    rows = [("c", f"s{n:03d}", k != "r", "v", "gift" if k == "u" else "timing_shift",
             0.1 if k == "d" else 0.9, D(0), D(0), "", None) for n, k in enumerate(steps)]
    verified = spark.createDataFrame(
        rows, "close_id string, subject_id string, ok boolean, verdict string, defect_class string,"
        "confidence double, delta decimal(28,2), credited decimal(28,2), reasoning string, "
        "proposed_rule string")
    sizes = spark.createDataFrame([("c", records)], "close_id string, records long")
    got = proposals.outcomes(queue, verified, sizes)
    return got, [r.outcome for r in got.orderBy("place").collect()]


def test_twelve_refusals_stop_at_the_next_chunk(spark):
    # Two declines move the twelfth refusal to place 14, inside the chunk that ends at 16.
    _, got = outcomes(spark, "dd" + "r" * 12 + "a" * 6)
    assert got[2:14] == ["refused"] * 12
    assert got[14:] == ["accepted"] * 2 + ["abandoned"] * 4


def test_streak_rules(spark):
    # Twelve in a row end at place 12, the end of a chunk: the rest is abandoned at once.
    _, got = outcomes(spark, "r" * 12 + "a" * 4)
    assert got[:12] == ["refused"] * 12 and got[12:] == ["abandoned"] * 4
    # A decline is neutral, an accept resets.
    df, got = outcomes(spark, "r" * 6 + "d" + "r" * 6 + "a" * 7)
    assert got[13:] == ["accepted"] * 3 + ["abandoned"] * 4
    assert [r.rule for r in proposals.stops(df).collect()] == ["model_refusal_streak"]
    _, got = outcomes(spark, "r" * 11 + "a" + "r" * 11 + "a")
    assert "abandoned" not in got
    # An unreadable class counts but does not trip by itself.
    _, got = outcomes(spark, "r" * 11 + "u" + "a" * 8)
    assert "abandoned" not in got


def test_budget_takes_the_head_of_the_queue(spark):
    df, got = outcomes(spark, "a" * 6, records=59)
    assert got == ["accepted"] * 2 + ["deferred"] * 4
    assert [r.rule for r in proposals.stops(df).collect()] == ["model_budget"]
    rows = proposals.proposal_findings(df).orderBy("subject_id").collect()
    assert [r.subject_id for r in rows] == ["s000", "s001"] and rows[0].layer == "L3_llm"


# --- what a close suggests, and a campaign ----------------------------------------

def test_suggestions_and_campaign(spark, tmp_path):
    whole = Books()
    for seq in (1, 2, 3):
        b = Books(f"m_{seq}")
        for n in range(3):
            at = 40 * n
            b.pay(f"a{n}", f"a{n}", 1000, at, utr=f"UTR77700{seq}{n}")
            b.credit(f"a{n}", 900, at + 1, f"KK NEFT REF 77700{seq}{n}")
        b.pay("late", "late", 555, 200).credit("late", 555, 206, "HDFC TRANSFER")
        whole.st += b.st
        whole.bk += b.bk
    frames = [df.withColumn("close_seq", F.substring_index("close_id", "_", -1).cast("int"))
              for df in whole.frames(spark)]
    first = [df.filter("close_seq = 1").drop("close_seq") for df in frames]
    done = close(*first)
    contract = spark.createDataFrame([("card", "0.02")], "method string, rate string")
    got = {(r.subject_id, r.source) for r in rules.suggested_resolutions(done, contract).collect()}
    assert got == {("a0", "alias"), ("a1", "alias"), ("a2", "alias"), ("late", "timing")}
    folder = str(tmp_path / "campaign")
    run = run_campaign(*frames, [1, 2, 3], contract, folder=folder)
    drift = {r.close_seq: r for r in drift_table(run).collect()}
    assert (drift[1].matched, drift[2].matched) == (0, 4)
    assert drift[1].rules_before == 0 and drift[2].rules_before == 2
    assert drift[2].exceptions < drift[1].exceptions
    live = {r.rule_id: r.params for r in run["rules"].filter("status = 'live'").collect()}
    assert live["narration_alias_001"] == {"marker": "REF", "prefix": "UTR"}
    assert live["bank_timing_001"] == {"bank": "HDFC", "offset_days": "6"}

    # Stopped after the second period, within the third, and started again.
    stopped = str(tmp_path / "stopped")
    run_campaign(*frames, [1, 2], contract, folder=stopped)
    marked = {n: os.stat(f"{stopped}/rules/close_seq={n}").st_mtime_ns for n in (1, 2)}
    frames[0].write.parquet(f"{stopped}/measures/close_seq=3")
    resumed = run_campaign(*frames, [1, 2, 3], contract, folder=stopped)
    assert marked == {n: os.stat(f"{stopped}/rules/close_seq={n}").st_mtime_ns for n in (1, 2)}
    for name in ("measures", "exceptions", "rules", "rule_history"):
        a, b = (sorted(map(str, r[name].select(sorted(r[name].columns)).collect())) for r in (run, resumed))
        assert a == b and a
