"""Normalisation, validation, readers, workflow folds and streams."""

import json

from pyspark.sql import functions as F

from tidewarden.operators import normalize, rules, validate, workflow
from tidewarden.sources import readers

EVENT = "event_id long, session_id long, micros long, etype string, tool_name string, path string, command string, content string, trust string"


def test_normalisation_maps_fills_and_reclassifies(spark):
    raw = spark.createDataFrame(
        [("claude-code", "PreToolUse", "s", None, "Bash", None), ("a3s-code", "PostToolUse", None, "a", "x", "done"), ("gemini-cli", "Notification", "s", "a", None, None), ("codex", "Nope", "s", "a", None, None)],
        "source_framework string, raw_type string, session_id string, agent_id string, tool_name string, response_text string",
    )
    got = {r.raw_type: r for r in normalize.normalize_events(raw).collect()}
    assert got["PreToolUse"].event_type == "pre_action" and got["PreToolUse"].tool_name == "bash" and got["PreToolUse"].agent_id == "unknown_agent:claude-code"
    assert got["PostToolUse"].event_type == "post_response" and got["PostToolUse"].missing_fields == ["session_id"]
    assert got["Notification"].subtype == "session:notification" and got["Nope"].event_type is None


def test_quarantine_names_broken_rules(spark):
    rows = spark.createDataFrame(
        [("ahp.1.0", "e", "s", "codex", "2026-01-01T00:00:00Z", None, None, None), ("1", "", "s", "openclaw", "soon", None, "bad", None)],
        "schema_version string, event_id string, session_id string, source_framework string, occurred_at string, event_subtype string, mapping_profile string, source_protocol_version string",
    )
    good, bad = validate.quarantine(rows, validate.event_violations())
    assert good.count() == 1
    row = bad.first()
    assert set(row.violations) == {"schema_version", "event_id", "occurred_at", "event_subtype", "mapping_profile", "protocol_version"} and len(row.fingerprint) == 64


def test_jsonl_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(json.dumps({"event_id": "1", "payload": {"command": "ls"}, "risk_hints": ["a"]}) + "\n{broken\n")
    rows = readers.read_events_jsonl(spark, str(tmp_path)).cache()
    assert rows.where("_corrupt is null").first().payload["command"] == "ls" and rows.where("_corrupt is not null").count() == 1


def test_session_logs_and_decisions_round_trip(spark, tmp_path):
    lines = [{"type": "session_meta", "payload": {"id": "s"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{}"}}, {"type": "noise", "payload": {}}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [r.type for r in readers.read_session_logs(spark, str(tmp_path / "log")).collect()] == ["session_meta", "function_call"]
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 86_400_000_000)], "event_id long, session_id long, micros long")
    readers.write_decisions(rows, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 2 and back.where("date = '1970-01-02'").count() == 1
    assert readers.prune_expired(rows, 3600).count() == 1


def test_approval_states_and_merging(spark):
    log = spark.createDataFrame(
        [("a", 1, "requested", "low"), ("a", 2, "failed", "low"), ("a", 3, "allowed", "low"), ("b", 1, "requested", "critical"), ("b", 2, "failed", "critical"), ("c", 1, "requested", "high")],
        "approval_id string, micros long, event string, risk string",
    )
    assert {r.approval_id: r.state for r in workflow.approval_states(log).collect()} == {"a": "allowed", "b": "exhausted", "c": "pending"}
    results = spark.createDataFrame([(1, "high", 0.5), (1, "critical", 0.0), (2, "low", 0.9)], "event_id long, target_level string, confidence double")
    base = spark.createDataFrame([(1, "medium"), (2, "high"), (3, "low")], "event_id long, risk_level string")
    assert {r.event_id: r.risk_level for r in workflow.merge_analyses(results, base).collect()} == {1: "high", 2: "high", 3: "low"}
    ordered = spark.createDataFrame([(1, "high", 0.8, 0), (1, "critical", 0.9, 1), (2, "high", 0.7, 0), (2, "critical", 0.1, 1), (3, "medium", 0.9, 0), (3, "low", 1.0, 2)], "event_id long, target_level string, confidence double, position int")
    low = spark.createDataFrame([(k, "low") for k in (1, 2, 3)], "event_id long, risk_level string")
    assert {r.event_id: r.risk_level for r in workflow.merge_analyses(ordered, low).collect()} == {1: "high", 2: "critical", 3: "medium"}
    assert {r.event_id: r.risk_level for r in workflow.merge_analyses(ordered, low, F.col("event_id") == 1).collect()} == {1: "critical", 2: "critical", 3: "medium"}
    reply = spark.createDataFrame([(1, 'x ```json\n{"risk_level": "high", "reason": "r"}\n```'), (2, "none"), (3, '{"risk_level": "odd"}')], "event_id long, response string")
    assert [(r.risk_level, r.state) for r in workflow.review_rows(reply).orderBy("event_id").collect()] == [("high", "completed"), (None, "degraded"), (None, "degraded")]


def test_first_effects_are_idempotent(spark):
    rows = spark.createDataFrame([("k", "1", "f", "a", "e", 2), ("k", "2", "f", "a", "e", 1), (None, "3", "f", "a", "e", 1)], "idempotency_key string, effect_id string, framework string, adapter string, event_id string, micros long")
    first = workflow.first_effects(rows)
    assert {r.effect_id for r in first.collect()} == {"2", "3"} and workflow.first_effects(rows, first).count() == 0


def test_rule_triggers_globs_and_excuses(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(i, 1, 1, "pre_action", "read_file", p, None, None, None) for i, p in enumerate(("/h/id_rsa", "/h/id_dsa", "/h/.env.prod", "/h/env", "/etc/passwd", "/x/id_rsa/y"))], EVENT)
    ids = lambda hits: sorted(r.event_id for r in hits.collect())
    assert ids(rules.match_patterns(rows, [r for r in rules.RULES if r.id == "secret-file"])) == [0, 1, 2, 4]
    nested = {
        "id": "n", "category": "c", "risk_level": "high",
        "triggers": {"logic": "AND", "conditions": [{"tool_names": ["BASH", "read_file"]}, {"OR": [{"file_extensions": [".md"]}, {"file_patterns": ["READ[!0-9]*"]}, {"command_patterns": ["^cat\\b"]}]}]},
        "detection": {"regex_patterns": [{"pattern": "do.*this", "weight": 4}, {"pattern": "now", "weight": 9}]}, "false_positive_filters": [{"type": "whitelist_path", "paths": ["/tmp/*"]}],
    }
    empty = {"id": "e", "triggers": {}, "detection": {}}
    (tmp_path / "rules.json").write_text(json.dumps(nested) + "\n" + json.dumps(empty) + "\n")
    loaded = rules.load_rules(spark, str(tmp_path / "rules.json"))
    assert [r.id for r in loaded] == ["n", "e"] and [r.id for r in rules.merge_rules(loaded[:1], [(loaded[0], "stable"), (loaded[1], "stable"), (rules.RULES[0], "deprecated")])] == ["n", "e"]
    cases = [("read_file", "/a/x.md", None, "do all\nthis"), ("read_file", "/a/README", None, "NOW"), ("read_file", "/a/READ1", None, "now"), ("bash", None, "cat now", None), ("bash", None, "cat now", "other"), ("read_file", "/tmp/x.md", None, "now"), ("write", "/a/x.md", None, "now")]
    rows = spark.createDataFrame([(i, 1, 1, "pre_action", *c, None) for i, c in enumerate(cases)], EVENT)
    assert sorted((r.event_id, r.weight) for r in rules.match_patterns(rows, loaded).collect()) == [(0, 4), (1, 9), (3, 9)]


def test_learned_rules_follow_the_sequential_version(spark):
    import random

    r = random.Random(2)
    log = [(f"r{k % 60}", k, r.random() < (0.95 if k % 3 else 0.75), k * 1000, "ab"[k % 2]) for k in range(600)]

    def fold(votes):
        state, c, f = "candidate", 0, 0
        for ok in votes:
            c, f = c + ok, f + (not ok)
            sure = 0.5 * c / (c + f) + 0.2 * min((c + f) / 10, 1) + 0.1
            if c + f >= 3 and f / (c + f) > 0.3:
                state = "deprecated"
            elif ok and state == "candidate":
                state = "experimental"
            elif ok and state == "experimental" and c >= 3 and sure >= 0.7:
                state = "stable"
        return state

    expected = {}
    for name in {x[0] for x in log}:
        expected[name] = fold([x[2] for x in log if x[0] == name])
    got = rules.pattern_lifecycle(spark.createDataFrame(log, "rule_id string, event_id long, confirmed boolean, micros long, framework string")).collect()
    assert {x.rule_id: x.status for x in got} == expected and {"stable", "deprecated"} <= set(expected.values())


def test_approvals_expire_in_streams(spark, tmp_path):
    from tidewarden.streaming import events as streams

    second = 1_000_000
    batches = [
        [(1, "request", 100), (2, "request", 100), (3, "request", 101), (4, "allow", 90)], [(1, "allow", 105), (2, "deny", 130), (9, "request", 400)], [(9, "allow", 405), (8, "request", 900)],
    ]
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame([(a, kind, t * second) for a, kind, t in batch], "approval_id long, kind string, micros long").withColumn("occurred_at", F.timestamp_micros("micros"))
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "b0")).schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = streams.approval_stream(source, 20, late="0 seconds").writeStream.format("memory").queryName("approvals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(180)
    got = {r.approval_id: r.state for r in spark.table("approvals").collect()}
    assert got == {1: "allowed", 2: "expired", 3: "expired", 9: "allowed"}


def test_streams_equal_batches(spark, tmp_path):
    from tidewarden.operators import sessions
    from tidewarden.operators.score import score_events
    from tidewarden.streaming import events as streams

    kinds = [("bash", None, "rm -rf /var/x"), ("read_file", "/repo/a", None), ("bash", None, "ls")]
    rows = spark.createDataFrame([(i, i % 3, i * 1_000_000, "pre_action", *kinds[i % 7 % 3], None, "standard") for i in range(60)], EVENT).withColumn("occurred_at", F.timestamp_micros(F.col("micros") + 10**12))  # later than the first watermark
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: streams.stream_events(spark, str(tmp_path / "in"), rows.schema)

    def run(frame, name, mode="append"):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert query.awaitTermination(120)
        return spark.table(name)

    scored = run(streams.scored_stream(source()), "scored")
    assert scored.exceptAll(score_events(rows).select(scored.columns)).count() == 0 and scored.count() == 60
    windows = run(streams.high_risk_windows(score_events(source()), window="10 seconds"), "windows", "complete")
    assert windows.agg(F.sum("total")).first()[0] == 60
    once = run(streams.ingest_once(source().union(source())), "once")
    assert once.count() == 60
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    state = {r.event_id: (r.prior_high, r.d4, r.risk_rank) for r in run(streams.session_state(source()), "state").collect()}
    batch = {r.event_id: (r.prior_high, r.d4, r.risk_rank) for r in sessions.accumulation(rows).collect()}
    assert state == batch
