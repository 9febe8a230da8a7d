"""Keyed state in streams against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_sessions import EVENT, KINDS, SECOND, by_session
from tidewarden.operators import sequences, sessions
from tidewarden.streaming import events as streams
from tidewarden.streaming import guard

START = 1_000_000 * SECOND


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("occurred_at", F.timestamp_micros("micros"))


def batches(spark, path, parts, schema):
    for k, part in enumerate(parts):
        timed(spark, part, schema).coalesce(1).write.parquet(f"{path}/b{k:02}")
    return spark.readStream.schema(spark.read.parquet(f"{path}/b00").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(frame, name, tmp_path, spark):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    assert query.awaitTermination(240)
    return spark.table(name), query


def rows_of_events(seed, n=240, users=3):
    r = random.Random(seed)
    return [(i, r.randrange(users), START + r.randrange(500) * SECOND + r.randrange(3), r.choice(["pre_action", "post_action"]), *r.choice(KINDS), None, r.choice(["standard", "privileged", None])) for i in range(n)]


def test_guard_equals_batches_over_shuffled_arrivals(spark, tmp_path):
    rows = rows_of_events(1)
    marks = [(u, START + t * SECOND, state) for u in range(3) for t, state in ((100, "quarantined"), (220, "released"), (300, "quarantined"))]
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    sentinel = [(9999, 99, START + 5000 * SECOND, "pre_action", *KINDS[2], None, None)]
    source = batches(spark, tmp_path / "events", [shuffled[:90], shuffled[90:100], shuffled[100:200], shuffled[200:], sentinel], EVENT)
    state_rows = batches(spark, tmp_path / "marks", [marks[::2], marks[1::2], [(99, START + 5000 * SECOND, "x")]], "session_id long, micros long, state string")
    out, _ = run(guard.guarded_stream(source, state_rows, late="600 seconds", cooldown=20.0, frequency=True, burst=3, repetitive=12, rate=40), "guarded", tmp_path, spark)
    got = {r.event_id: r for r in out.collect()}
    batch = timed(spark, rows, EVENT)
    assert len(got) == len(rows)
    freq = sessions.frequency_d4(batch, 1.0, 3, 12, 40)
    expected = sessions.accumulation(freq, freq=F.col("freq_d4")).collect()
    assert {i: (r.prior_high, r.d4, r.risk_rank) for i, r in got.items()} == {r.event_id: (r.prior_high, r.d4, r.risk_rank) for r in expected}
    assert any(r.d4 == 2 and r.prior_high < 5 for r in expected)
    scored = spark.createDataFrame([(r.session_id, r.event_id, r.micros, r.risk_rank) for r in expected], "session_id long, event_id long, micros long, risk_rank int")
    assert {i: r.enforced for i, r in got.items()} == {r.event_id: r.enforced for r in sessions.enforcement(scored, 3, 20.0).collect()}
    rises = {(r.session_id, r.event_id) for r in sessions.risk_changes(scored.withColumn("risk_level", F.lit(""))).collect()}
    assert {(r.session_id, r.event_id) for r in got.values() if r.rises} == rises
    alerts = {(r.session_id, a.sequence_id, a.risk_level, r.event_id, ",".join(map(str, sorted(a.matched)))) for r in got.values() for a in r.alerts}
    found = {(r.session_id, r.sequence_id, r.risk_level, r.trigger_event_id, ",".join(map(str, sorted(map(int, r.matched.split(",")))))) for r in sequences.detect_trajectories(batch).collect()}
    assert alerts == found and found
    states = spark.createDataFrame(marks, "session_id long, micros long, state string")
    assert {i: r.quarantine for i, r in got.items()} == {r.event_id: r.state for r in sessions.as_of(batch.select("session_id", "event_id", "micros"), states).collect()}


def test_alerts_repeat_over_batches_as_in_one(spark, tmp_path):
    """Windows that reach back over many batches, and sets that aren't alerted twice."""
    rows = [(i, 1, START + i * SECOND, "pre_action", *KINDS[[0, 2, 3, 0, 4, 5][i % 6]], None, None) for i in range(40)]
    parts = [rows[k : k + 10] for k in range(0, 40, 10)] + [[(9999, 99, START + 5000 * SECOND, "pre_action", *KINDS[2], None, None)]]
    out, _ = run(guard.guarded_stream(batches(spark, tmp_path / "e", parts, EVENT), late="0 seconds"), "repeats", tmp_path, spark)
    alerts = [(a.sequence_id, r.event_id, tuple(a.matched)) for r in out.collect() for a in r.alerts]
    found = [(r.sequence_id, r.trigger_event_id) for r in sequences.detect_trajectories(timed(spark, rows, EVENT)).collect()]
    assert sorted(x[:2] for x in alerts) == sorted(found) and len(set(alerts)) == len(alerts) > 10


def test_idle_state_goes_and_late_rows_are_counted(spark, tmp_path):
    listener = guard.LateRows()
    spark.streams.addListener(listener)
    try:
        e = lambda i, u, t: (i, u, START + t * SECOND, "pre_action", *KINDS[1], None, None)
        parts = [[e(1, 1, 0), e(2, 2, 0), e(3, 1, 5)], [e(4, 3, 500)], [e(40, 3, 501)], [e(5, 1, 1), e(6, 2, 2), e(7, 2, 3)], [e(8, 4, 10_000)], [e(9, 5, 20_000)]]
        out, query = run(guard.guarded_stream(batches(spark, tmp_path / "e", parts, EVENT), late="10 seconds", ttl_ms=600_000), "idle", tmp_path, spark)
        assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 8, 40]
        # session 5 waits for the watermark; of session 4 some rows may be left, of 1 to 3 none
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert [(r["query"], r.dropped) for r in listener.table(spark).collect()] == [("idle", 3)]
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert left <= 8, left
    finally:
        spark.streams.removeListener(listener)


def test_orphan_answers_go(spark, tmp_path):
    rows = lambda *x: [(a, kind, START + t * SECOND) for a, kind, t in x]
    parts = [rows((7, "allow", 90), (6, "allow", 100)), rows((6, "request", 95), (5, "request", 101)), rows((1, "request", 500)), rows((2, "request", 900))]
    source = batches(spark, tmp_path / "a", parts, "approval_id long, kind string, micros long")
    out, query = run(streams.approval_stream(source, 20, late="0 seconds"), "orphans", tmp_path, spark)
    assert {r.approval_id: r.state for r in out.collect()} == {6: "allowed", 5: "expired", 1: "expired"} or {r.approval_id: r.state for r in out.collect()} == {5: "expired", 1: "expired"}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the last request and its timer


def test_sliding_and_session_windows_equal_batches(spark, tmp_path):
    from tidewarden.operators.score import score_events

    rows = sorted(rows_of_events(5, 120), key=lambda r: r[2])
    source = lambda name: batches(spark, tmp_path / name, [rows[:60], rows[60:], [(9999, 99, START + 90_000 * SECOND, "pre_action", *KINDS[2], None, None)]], EVENT)
    batch = score_events(timed(spark, rows, EVENT))
    for minutes in (15,):
        out, _ = run(streams.high_risk_windows(score_events(source(f"w{minutes}")), window=f"{minutes} minutes", slide="1 minute", late="1 minute"), f"slide{minutes}", tmp_path, spark)
        plain = batch.groupBy(F.window("occurred_at", f"{minutes} minutes", "1 minute").alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("risk_rank") >= 2).alias("high"))
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in plain.select("w.start", "total", "high").collect()}
    out, _ = run(streams.session_windows(score_events(source("s")), gap="20 seconds", late="1 minute"), "gaps", tmp_path, spark)
    expected = set()
    for session, events in by_session(batch.select("session_id", "event_id", "micros", "risk_rank").collect()).items():
        group = [events[0]]
        for e in [*events[1:], None]:
            if e is None or e.micros - group[-1].micros > 20 * SECOND:
                expected.add((session, len(group), sum(x.risk_rank >= 2 for x in group)))
                group = []
            group.append(e)
    assert {(r.session_id, r.events, r.high) for r in out.collect()} == expected


def test_thinning_in_streams_equals_batches(spark, tmp_path):
    from tidewarden.operators import correlate

    rows = rows_of_events(9, 200)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    source = batches(spark, tmp_path / "e", [shuffled[:120], shuffled[120:], [(9999, 99, START + 9000 * SECOND, "pre_action", *KINDS[2], None, None)]], EVENT)
    out, _ = run(guard.thinned_stream(source, 9.0, late="600 seconds"), "thinned", tmp_path, spark)
    expected = {(r.session_id, r.tool_name, r.event_id, r.suppressed) for r in correlate.sampled_events(timed(spark, rows, EVENT), 9.0).collect()}
    assert {tuple(r) for r in out.collect()} == expected and any(x[3] for x in expected)
