"""Session aggregates with resolutions, sketches, evidence of nested payloads and session logs."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewarden.operators import evidence, rollups
from tidewarden.sources import readers
from tidewarden.streaming import logs

RECORD = "session_id long, event_id long, micros long, seq int, record_type string, verdict string, tier string, risk_rank int, tool_name string, hints array<string>, composite double, d1 int, d2 int, d3 int, d4 int, d5 int, d6 double"


def test_session_aggregates_follow_the_sequential_version(spark):
    r = random.Random(4)
    rows = []
    for k in range(400):
        kind = r.choice(["decision", "decision", "decision_resolution"])
        rows.append((r.randrange(4), r.randrange(60), r.randrange(10**6), k, kind, r.choice(["allow", "block", None]), r.choice(["L1", "L2"]), r.randrange(4), r.choice(["bash", "", None, "read"]), r.choice([None, [], ["b", "a"], ["c"]]), r.random() * 3, 1, 2, 3, r.randrange(3), 0, r.random() * 3))
    expected = {}
    for session in range(4):
        line, agg = [], {"events": 0, "d4": 0, "tools": set(), "hints": set()}
        mine = sorted((x for x in rows if x[0] == session), key=lambda x: (x[2], x[3]))
        for x in mine:
            if x[4] == "decision_resolution":
                for k in range(len(line) - 1, -1, -1):
                    if line[k][1] == x[1]:
                        del line[k]
                        break
            else:
                agg["events"] += 1
                agg["d4"] += x[14]
            line.append(x)
            agg["tools"] |= {x[8]} - {"", None}
            agg["hints"] |= set(x[9] or [])
        count = lambda k: dict(Counter(x[k] or "unknown" for x in line))  # noqa: B023, E731
        expected[session] = (agg["events"], sum(x[7] >= 2 for x in line), agg["d4"], count(5), count(6), sorted(agg["tools"]), sorted(agg["hints"]), int(mine[-1][10]), int(mine[-1][16]))
    got = rollups.session_aggregates(spark.createDataFrame(rows, RECORD).repartition(3)).collect()
    assert {x.session_id: (x.event_count, x.high_risk_event_count, x.d4_sum, x.verdicts, x.tiers, x.tools, x.hints, x.cumulative_score, x.latest.d6) for x in got} == expected
    assert rollups.session_aggregates(spark.createDataFrame([], RECORD)).count() == 0


def test_merged_sketches_are_near_exact_ones(spark):
    r = random.Random(5)
    rows = [("ab"[k % 2], int(r.random() * 50 * 3_600_000_000), r.lognormvariate(0, 1) * (1 + k % 2), r.randrange(3000)) for k in range(20_000)] + [("c", 0, None, None), ("b", 1, None, 7)]
    table = spark.createDataFrame(rows, "label string, micros long, value double, session_id long").repartition(4)
    hours = rollups.sketch_hours(table, "label", "value", "session_id").cache()
    assert hours.count() > 90
    for by in (("label",), ()):
        for x in rollups.merge_sketches(hours, *by).collect():
            values = sorted(v for name, _, v, _ in rows if v is not None and (not by or name == x.label))
            assert x.n == len(values)
            if not values:
                assert x.p50 is None and x.distinct == 0
                continue
            for p, got in ((0.5, x.p50), (0.95, x.p95), (0.99, x.p99)):
                rank = sum(v <= got for v in values) / len(values)
                assert abs(rank - p) < 0.012
            exact = len({s for name, _, _, s in rows if s is not None and (not by or name == x.label)})
            assert abs(x.distinct - exact) < 0.04 * exact


def test_evidence_of_five_kinds(spark):
    meta = lambda kind, **more: {"_meta": {"compat": {"raw_event_type": kind, **more}}}
    cases = [
        ({"intent": " ", "arguments": {"intent": " go "}, "target": 5, "cwd": None, **meta("compat:ContextPerception", context={"session": {"workspace": "/w"}}, query="q")}, None, ("context_perception", "compat_summary", {"intent": "go", "target": "5", "workspace": "/w", "query": "q"})),
        ({"max_results": True, "arguments": {"max_results": " 12 ", "query": ""}, **meta("memory_recall", metadata={"memory_type": "long", "max_results": 3})}, None, ("memory_recall", "compat_summary", {"max_results": "12", "memory_type": "long"})),
        ({"max_results": 7, **meta(None)}, " Memory_Recall ", ("memory_recall", "compat_summary", {"max_results": "7"})),
        ({"task": "t", "strategy": [" ", {"a": ""}], "arguments": {"strategy": {"k": " v ", "n": None, "d": [1, "", {"z": " "}]}}, **meta("planning", constraints=["x"])}, None, ("planning", "planning_summary", {"task": "t", "strategy": '{"d":[1],"k":"v"}', "constraints": '["x"]'})),
        ({"hints": "  h ", **meta("Reasoning")}, None, ("reasoning", "reasoning_summary", {"hints": '"h"'})),
        ({"language_hint": "de", **meta("intent_detection")}, None, ("intent_detection", "intent_summary", {"language_hint": "de"})),
        ({"task": " ", **meta("planning")}, None, (None, None, None)), ({"query": "q", **meta("other")}, "reasoning", (None, None, None)), ({"arguments": "text", "query": "q"}, "memory_recall", ("memory_recall", "compat_summary", {"query": "q"})),
        ([1], "planning", (None, None, None)), (None, "planning", (None, None, None)), ("broken", "planning", (None, None, None)),
    ]
    payload = lambda p: None if p is None else "{broken" if p == "broken" else json.dumps(p)
    rows = spark.createDataFrame([(k, payload(p), s) for k, (p, s, _) in enumerate(cases)], "k long, payload string, event_subtype string")
    got = {r.k: (r.compat_event_type, r.summary_kind, r.summary) for r in evidence.compatibility_evidence(rows).collect()}
    assert [got[k] for k in range(len(cases))] == [want for *_, want in cases]


def test_effect_and_review_summaries(spark):
    effects = {"effect_id": "e", "effect_version": "1", "action_scope": "session", "session_effect": {"requested": True, "mode": "mark_blocked", "other": 1}, "rewrite_effect": {"target": "t", "replacement_payload": {"secret": "x"}}}
    result = {"effect_id": "e", "requested": ["a"], "enforced": [], "event_id": "7", "extra": 1}
    reviews = [
        {"retained_sources": [" a ", "", 3], "tool_calls": [1, {"x": 2}], "tool_calls_count": 9, "toolkit_budget_mode": " fixed ", "toolkit_budget_cap": 4, "toolkit_calls_remaining": 0, "compat_event_type": "planning", "planning_summary": {"task": " t ", "x": ""}},
        {"tool_calls_count": 3, "toolkit_budget_exhausted": False, "toolkit_budget_cap": 4, "toolkit_calls_remaining": 0, "compat_event_type": "memory_recall", "compat_summary": {"query": ""}}, {"toolkit_budget_cap": "4"},
    ]
    one = spark.createDataFrame([(json.dumps(effects), json.dumps(result), None)], "e string, r string, n string").select(
        evidence.effect_summary(F.col("e")).alias("s"), evidence.stored_effects(F.col("e")).alias("kept"), evidence.result_summary(F.col("r")).alias("r"), evidence.effect_summary(F.col("n")).alias("n"), evidence.stored_effects(F.col("n")).alias("m")
    ).first()
    assert (one.s.effect_id, one.s.action_scope, one.s.session_effect, one.s.rewrite_effect) == ("e", "session", {"requested": "true", "mode": "mark_blocked"}, {"target": "t"})
    assert "secret" not in one.kept and json.loads(one.kept)["rewrite_effect"] == {"target": "t"} and one.n is None and one.m is None
    assert (one.r.requested, one.r.enforced, one.r.event_id, one.r.adapter) == (["a"], [], "7", None)
    got = [r[0] for r in spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(reviews)] + [(9, None)], "k long, s string").orderBy("k").select(evidence.compact_summary(F.col("s"))).collect()]
    assert tuple(got[0]) == (["a", "3"], 2, "fixed", 4, 0, True, "planning", '{"task":"t"}')
    assert tuple(got[1]) == (None, 3, None, 4, 0, False, None, None) and set(got[2]) == set(got[3]) == {None}


def _line(kind, **payload):
    return json.dumps({"type": "session_meta" if kind == "session_meta" else "response_item", "payload": {"type": kind, **payload}})


def test_session_ids_are_carried_along_files(spark, tmp_path):
    calls = lambda *names: [_line("function_call", name=n, arguments="{}", call_id=n) for n in names]
    (tmp_path / "a.jsonl").write_text("\n".join([*calls("early"), _line("session_meta", id="s1"), "broken", *calls("x", "y"), _line("session_meta", id="s2"), *calls("z"), json.dumps({"type": "event_msg"})]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(calls("alone")) + "\n")
    got = {r.name: r.session_id for r in readers.read_session_logs(spark, str(tmp_path / "*.jsonl")).where("type = 'function_call'").collect()}
    assert got == {"early": None, "x": "s1", "y": "s1", "z": "s2", "alone": None}


def test_pieces_of_a_log_share_its_session(spark, tmp_path):
    import os
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    call = lambda n: _line("function_call", name=n, arguments="{}", call_id=n)
    pieces = {"a.0": [_line("session_meta", id="s1"), call("a0")], "b.0": [call("b0")], "a.1": [call("a1"), call("a2")], "b.1": [_line("session_meta", id="s9"), call("b1")], "a.2": [call("a3"), _line("session_meta", id="s2"), call("a4")], "b.2": [call("b2")]}
    now = time.time()
    for k, (name, lines) in enumerate(pieces.items()):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / f"{name}.jsonl", (now - 100 + k, now - 100 + k))
    source = logs.stream_session_logs(spark, str(tmp_path / "*.jsonl"), max_files=2)
    query = source.writeStream.format("memory").queryName("tail").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(180) and len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = {r.name: r.session_id for r in spark.table("tail").where("type = 'function_call'").collect()}
    assert got == {"a0": "s1", "b0": None, "a1": "s1", "a2": "s1", "b1": "s9", "a3": "s1", "a4": "s2", "b2": "s9"}


def test_events_are_scored_once_for_aggregates_and_bypasses(spark, monkeypatch):
    """The plans behind the stored rows read no table of events again."""
    from tidewarden.operators import blocks
    from tidewarden.plans import catalogue
    from tests.conftest import SMALL

    stored, real = [], blocks.durable
    monkeypatch.setattr(blocks, "durable", lambda df: stored.append(df) or real(df))
    for query in (catalogue.session_aggregates, catalogue.bypass_matches):
        stored.clear()
        out = query(spark, SMALL)
        scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
        assert scans(out) == 0 and [scans(x) for x in stored] == [1]
