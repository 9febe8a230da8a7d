"""Range joins, vector search and the exact limiter against brute force."""

import random

import numpy as np
import pytest

from tidewarden.operators import blocks, correlate, ranges, vectors
from tests.test_sessions import SECOND


def plan(df):
    return df._jdf.queryExecution().toString()


def test_range_join_equals_between(spark):
    r = random.Random(3)
    records = [(r.randrange(4) if r.random() < 0.95 else None, r.choice([r.randrange(-500, 500), r.randrange(10**12)])) for _ in range(400)] + [(0, None), (1, -(2**62)), (1, 2**62)]
    spans = [(r.randrange(5), low, low + length) for length in (0, 1, 7, 8, 63, 64, 500, 10**11, 2**40) for low in (r.randrange(-500, 500) for _ in range(4))] + [(0, 5, 4), (1, None, 9), (1, 9, None), (2, 3, -(2**40)), (None, 0, 9)]
    left = spark.createDataFrame([(k, at, f"r{i}") for i, (k, at) in enumerate(records)], "key long, at long, name string")
    right = spark.createDataFrame([(k, a, b, i) for i, (k, a, b) in enumerate(spans)], "key long, low long, high long, nth int")
    out = ranges.range_join(left, right, "key", "at", "low", "high")
    assert out.columns == ["key", "at", "name", "low", "high", "nth"]
    expected = sorted((f"r{i}", n) for i, (k, at) in enumerate(records) for n, (j, a, b) in enumerate(spans) if None not in (k, at, j, a, b) and k == j and a <= at <= b)
    assert sorted((x.name, x.nth) for x in out.collect()) == expected and len(expected) > 300
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert ranges.range_join(left, right.where("false"), "key", "at", "low", "high").count() == 0


def test_snapshot_records_overlap(spark):
    records = spark.createDataFrame([(i % 2, i, "low") for i in range(40)], "session_id long, event_id long, risk_level string")
    snapshots = spark.createDataFrame([(0, 20, 4), (0, 24, 10), (1, 9, 11), (1, 31, 31)], "session_id long, trigger_event_id long, from_event_id long")
    got = sorted((x.trigger_event_id, x.event_id) for x in correlate.snapshot_records(records, snapshots).collect())
    assert got == sorted([(20, i) for i in range(4, 21, 2)] + [(24, i) for i in range(10, 25, 2)] + [(31, 31)])


@pytest.mark.parametrize("most", [1, 3])
def test_limiter_equals_a_fold(spark, most):
    r = random.Random(most)
    rows = [(r.choice([0, 1, 1, None]), i, r.randrange(300) * SECOND // r.choice([1, 1, 7])) for i in range(500)]
    kept, expected = {}, {}
    for client, i, t in sorted(rows, key=lambda x: (x[2], x[1])):
        near = [x for x in kept.get(client, []) if t - x < 10 * SECOND]
        expected[i] = len(near) < most
        kept[client] = [*near, t] if expected[i] else near
    table = spark.createDataFrame(rows, "session_id long, event_id long, micros long")
    for requests in (table, blocks.split_long_sessions(table, 60)):
        assert {x.event_id: x.allowed for x in ranges.limit_requests(requests, most, 10.0).collect()} == expected
    assert {True, False} == set(expected.values())


def test_vector_search_recall_and_exactness(spark):
    rng = np.random.default_rng(4)
    d, n = 32, 1500
    x = rng.normal(size=(n, d))
    x[200:700] = x[:500] + rng.normal(size=(500, d)) * rng.uniform(0.3, 0.9, (500, 1))
    x[700:1000] = x[5]  # many copies of one vector
    rows = [(i, [float(v) for v in row], "extra") for i, row in enumerate(x)] + [(5000, None, ""), (5001, [0.0] * d, ""), (5002, [float("nan")] * d, ""), (None, [1.0] * d, ""), (5003, [None] * d, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies string").repartition(3)
    asked = table.where("vec_id % 50 = 0 or vec_id >= 5000")
    got = {(r.query_id, r.vec_id): r for r in vectors.similar_vectors(asked, table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    first = {i: 5 if 700 <= i < 1000 else i for i in range(n)}
    exact = {(q, first[c]): unit[q] @ unit[c] for q in range(0, n, 50) for c in range(n) if unit[q] @ unit[c] >= 0.75}
    assert set(got) <= set(exact) and len(set(got)) >= 0.97 * len(exact) and len(exact) > 40
    assert all(abs(got[k].similarity - exact[k]) < 1e-12 for k in got)
    assert all(r.copies == (301 if r.vec_id == 5 else 1) for r in got.values()) and (700, 5) in got
    assert vectors.similar_vectors(asked.limit(0), table).count() == 0 and vectors.similar_vectors(asked, table.limit(0)).count() == 0
    bits, tables = vectors.plan_tables(10**6, 0.75, 0.98)
    assert bits == 20 and tables < 120


def test_vector_search_without_recall_finds_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 16))
    x = (base[rng.integers(0, 40, 2400)] + rng.normal(size=(2400, 16)) * rng.uniform(0.3, 0.9, (2400, 1))).astype(np.float32)
    x[900] = 2 * x[50]  # a multiple is a vector of its own
    rows = [(i, x[i].tolist()) for i in range(2400)] + [(7, x[60].tolist()), (50, [0.0] * 16), (None, x[1].tolist()), (100, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(vectors, "BLOCK", 500)
    monkeypatch.setattr(vectors, "block_counts", lambda n, m: (2, 5))
    got = sorted((r.query_id, r.vec_id, r.copies) for r in vectors.similar_vectors(table.where("vec_id % 50 = 0"), table).collect())
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit[::50] @ unit.T >= 0.75
    expected = [(50 * int(q), 7 if c == 60 else int(c), 2 if c == 60 else 1) for q, c in np.argwhere(near)]
    assert got == sorted(expected) and len(got) > 500
    some = vectors.similar_vectors(table.where("vec_id % 50 = 0 and vec_id > 50"), table.where("vec_id >= 100"), recall=0.98).count()
    assert 0 < some <= len(got)


def test_vector_scores_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 8))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(500)] + [(3, x[600].tolist()), (900, None), (901, [0.0] * 8), (902, [1.0] * 9), (None, x[0].tolist())], "vec_id long, embedding array<double>")
    corpus = spark.createDataFrame([(i, x[i].tolist()) for i in range(500, 700)] + [(990, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "block_counts", lambda n, m: (3, 4))
    out = correlate.vector_scores(queries, corpus)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = {r.vec_id: r for r in out.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = (unit[:500] @ unit[500:].T).max(axis=1)
    best[3] = 1.0
    assert all(abs(got[i].similarity - best[i]) < 6e-5 for i in range(500)) and len(got) == 504
    assert got[900].similarity is None and got[902].similarity is None and np.isnan(got[901].similarity) and abs(got[None].similarity - best[0]) < 6e-5


def test_chains_of_a_block():
    rng = np.random.default_rng(2)
    for _ in range(60):
        tick = int(rng.integers(1, 12))
        micros = np.sort(rng.integers(0, 60, int(rng.integers(1, 40)))) if rng.random() < 0.7 else np.arange(int(rng.integers(1, 30)))
        upper, due, dropped = ranges.entry_table(micros, tick)
        for begin in range(int(micros[0]) - 3, int(micros[0]) + tick + 1):
            now, count, at = begin, 0, None
            for k, t in enumerate(micros):
                if t >= now:
                    now, count, at = t + tick, 0, k
                else:
                    count += 1
            k = int(np.searchsorted(upper, begin))
            assert (k == len(upper)) == (at is None)
            if at is not None:
                assert (due[k], dropped[k]) == (now, count)


@pytest.mark.parametrize("blocks", [None, 2, 9])
def test_thinning_in_blocks_equals_one_pass(spark, blocks):
    r = random.Random(6)
    rows = [(1, "bash", i, r.randrange(400) * SECOND) for i in range(300)] + [(r.choice([2, 3, None]), r.choice(["bash", None, "x"]), 1000 + i, r.randrange(300) * SECOND) for i in range(150)]
    rows += [(9, "regular", 2000 + i, i * SECOND) for i in range(120)] + [(8, "burst", 3000 + i, 5 * SECOND) for i in range(40)]
    table = spark.createDataFrame(rows, "session_id long, tool_name string, event_id long, micros long").repartition(3)
    expected = sorted(map(str, (tuple(x) for x in correlate.sampled_events(table, 7.0).collect())))
    assert sorted(map(str, (tuple(x) for x in ranges.thin_events(table, 7.0, blocks=blocks).collect()))) == expected
    assert ranges.thin_events(table.limit(0), 7.0).count() == 0
