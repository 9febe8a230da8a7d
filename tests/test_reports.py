"""Scores of replays, metric lines, review states and feeds."""

import json

from pyspark.sql import functions as F

from tidewarden.functions import actions as A
from tidewarden.operators import benchmark, correlate, reports, rules, validate
from tidewarden.sources import readers


def test_replay_scores_and_artifacts(spark, tmp_path):
    decisions = spark.createDataFrame(
        [("a", 1, "pre_action", "block", 3, "L1"), ("a", 2, "post_action", "allow", 0, "l2"), ("b", 3, "post_action", "defer", 0, "L3"), ("c", 4, "pre_action", "allow", 2, None), ("d", 5, "pre_action", "allow", 1, "L1"), ("x", 6, "pre_action", "block", 3, "L1")],
        "record_id string, event_id long, etype string, verdict string, risk_rank int, tier string",
    )
    labels = spark.createDataFrame([("a", "unsafe"), ("b", "safe"), ("c", "unsafe"), ("d", "safe"), ("e", "unsafe"), ("x", "other")], "record_id string, label string")
    records = benchmark.replay_records(decisions, labels)
    one = benchmark.replay_scores(records).first()
    assert (one.tp, one.fp, one.fn, one.tn, one.records, one.events, one.blocked, one.deferred) == (2, 1, 1, 1, 5, 5, 1, 1)
    assert (one.unsafe_recall, one.safe_false_positive_rate, one.precision, one.balanced_accuracy, one.prevention_recall) == (round(2 / 3, 6), 0.5, round(2 / 3, 6), round((2 / 3 + 1 / 2) / 2, 6), round(1 / 3, 6))
    assert (one.pre_action_coverage, one.post_action_coverage, one.max_low, one.max_high, one.L1, one.L2, one.L3) == (0.6, 0.4, 2, 1, 2, 1, 1)
    none = benchmark.replay_scores(benchmark.replay_records(decisions, labels.where("label = 'safe'"))).first()
    assert none.unsafe_recall is None and none.balanced_accuracy is None
    benchmark.write_replay(decisions, records, str(tmp_path / "r"))
    assert [r.event_id for r in spark.read.json(str(tmp_path / "r/decisions/record_id=a")).orderBy("event_id").collect()] == [1, 2]
    assert {(r.record_id, r.max_risk_level, r.detected) for r in spark.read.json(str(tmp_path / "r/records")).collect()} == {("a", "critical", True), ("b", "low", True), ("c", "high", True), ("d", "medium", False), ("e", "low", False)}


def test_metric_lines_escape_labels(spark):
    rows = spark.createDataFrame([('a"b\\c\nd', None, 3), (None, 0.5, 4)], "tool string, le double, n long")
    assert {r.line for r in benchmark.exposition(rows, "m", ["tool", "le"]).collect()} == {'m{tool="a\\"b\\\\c\\nd",le="+Inf"} 3', 'm{tool="",le="0.5"} 4'}
    assert benchmark.exposition(rows, "total", []).first().line == "total 3"


def test_review_runtime_states_and_codes(spark):
    cases = [
        (("L1", "L1", "L3", True, None), (False, "completed", None, None)),
        (("L3", "L1", "L1", True, (None, None, "trigger_not_matched", False)), (True, "not_triggered", "L3 trigger not matched", "trigger_not_matched")),
        (("L1", "L3", "L2", True, (" LLM call failed: x ", None, "", True)), (True, "degraded", "LLM call failed: x", "llm_call_failed")),
        (("L1", "L3", "L2", True, ("tool call budget exhausted", None, None, True)), (True, "degraded", "tool call budget exhausted", "tool_call_budget_exhausted")),
        (("L3", "L3", "L1", False, None), (True, "skipped", None, "requested_but_not_run")), (("L3", "L3", "L1", False, ("odd", "own_code", None, True)), (True, "degraded", "odd", "own_code")),
        (("L3", "L3", "L1", False, ("odd", None, None, True)), (True, "degraded", "odd", "unknown_degraded")), (("L1", "L1", "L1", True, None), (False, "enabled", None, None)), (("L1", "L2", "L1", False, None), (False, None, None, None)),
    ]
    rows = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, r string, e string, a string, v boolean, t struct<degradation_reason: string, reason_code: string, trigger_reason: string, degraded: boolean>")
    got = [tuple(x[0]) for x in rows.orderBy("k").select(A.review_runtime(F.col("r"), F.col("e"), F.col("a"), F.col("v"), F.col("t"))).collect()]
    assert got == [want for _, want in cases]
    told = rows.limit(1).select(A.review_runtime(F.lit("L3"), F.lit("L3"), F.lit("L2"), F.lit(True), F.col("t"), F.lit("Hard cap exceeded at 9"))).first()[0]
    assert (told.state, told.code) == ("skipped", "hard_cap_exceeded")


def test_feeds_ranges_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, i, "bash", ["low", "high"][i % 2], "allow", i % 4, ["pre_action", "alert"][i % 3 == 0]) for i in range(12)], "event_id long, session_id long, micros long, tool_name string, risk_level string, verdict string, risk_rank int, etype string")
    assert [r.event_id for r in reports.replay_range(rows, 1, 3, 7).collect()] == [3, 5, 7]
    assert sorted(r.event_id for r in readers.runtime_feed(rows, 1, 1, ["alert"]).collect()) == [3, 9] and readers.runtime_feed(rows).count() == 12
    assert [r.event_id for r in readers.feed_replay(rows, 3, session=1).collect()] == [7, 9, 11]
    for kind in ("csv", "json"):
        readers.export_audit(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 12 and set(spark.read.json(str(tmp_path / "json")).columns) == {"event_id", "session_id", "micros", "tool_name", "risk_level", "verdict"}
    first = correlate.first_requests(spark.createDataFrame([("q", 1, 0), ("q", 2, 5_000_000), ("q", 3, 20_000_000), ("r", 4, 1)], "request_id string, event_id long, micros long"), 10.0)
    assert {r.event_id for r in first.collect()} == {1, 3, 4}


def test_trajectory_files(spark, tmp_path):
    records = [{"id": "1", "contents": [[{"role": "user", "content": "a"}, {"role": "agent", "content": "b", "action": "run"}], [{"role": "user", "content": "c"}]]}, {"id": "2", "contents": []}, {"id": "2", "contents": []}]
    (tmp_path / "t.json").write_text(json.dumps(records))
    (tmp_path / "m.json").write_text('{"id": "1", "label": "safe"}\n{"id": "2", "label": "odd"}\n')
    turns, problems = readers.read_trajectories(spark, str(tmp_path / "t.json"), str(tmp_path / "m.json"))
    assert [(r.block, r.turn, r.content) for r in turns.orderBy("block", "turn").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    assert {(r.id, r.problem) for r in problems.collect()} == {("2", "label"), ("2", "repeated")}


def test_dry_run_finds_invalid_events(spark):
    rows = spark.createDataFrame([(1, 1, "read_file", "/h/id_rsa", None, None), (2, 1, "bash", None, "ls", None)], "event_id long, session_id long, tool_name string, path string, command string, content string").withColumns({"etype": F.lit("pre_action"), "micros": F.lit(0)})
    got = {r.event_id: tuple(r)[1:] for r in rules.dry_run(rows, None, F.array(F.lit("SHELL_EXECUTION")), F.when(F.col("event_id") == 2, "bad")).collect()}
    assert got[2] == (None, None, "bad") and "secret-file" in got[1][0] and got[1][1:] == ("shell-review", None)


def test_review_queue_of_invalid_events(spark):
    rows = spark.createDataFrame([(1, None, "sudo ls", "x"), (2, "HIGH", None, None), (3, "odd", None, "Bash"), (4, "low", "rm -rf /", "bash"), (5, None, None, None), (3, "odd", None, "Bash")], "event_id long, risk_level string, command string, tool string")
    _, broken = validate.quarantine(rows, F.array(F.lit("schema")))
    queue = validate.review_queue(broken, F.col("risk_level"), F.col("command"), F.col("tool")).collect()
    assert sorted((r.event_id, r.inferred_risk) for r in queue) == [(1, "high"), (2, "high"), (3, "medium")]


def test_violations_of_decisions_and_effects(spark):
    rows = spark.createDataFrame(
        [("allow", True, None, False, None, ["a"], ["b"], None, "r"), ("block", False, None, True, "session", None, None, None, None), ("modify", None, None, True, "session", ["a"], ["a"], ["c"], "")],
        "decision string, final boolean, modified_payload string, rewrite boolean, scope string, enforced array<string>, degraded array<string>, unsupported array<string>, degrade_reason string",
    )
    got = rows.select(validate.decision_violations().alias("d"), validate.effect_violations().alias("e")).collect()
    assert [(r.d, r.e) for r in got] == [([], []), (["final", "rewrite"], []), (["modified_payload", "session_scope"], ["overlap", "reason"])]


def test_a_replayed_range_is_cut_out_at_the_scan(spark):
    from tidewarden.plans import catalogue
    from tests.conftest import SMALL

    shown = catalogue.replay_range(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    pushed = shown[shown.index("PushedFilters") :]
    assert "EqualTo(user_id,7)" in pushed and "GreaterThanOrEqual(event_id,100)" in pushed
