"""Shards of nearly equal bytes against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, corpus


def least(sizes, shards):
    """The smallest largest part over all contiguous partitions."""
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, len(sizes)])) for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1))


def test_smallest_capacity_and_cuts():
    from tidewarden.llm.sharding import cut, smallest_capacity

    r = random.Random(2)
    for _ in range(150):
        sizes = [r.choice([1, 2, 3, 8, 40]) for _ in range(r.randint(1, 9))]
        shards = r.randint(1, 4)
        ends, capacity = cut(np.array(sizes), shards)
        parts = [sum(sizes[a:b]) for a, b in itertools.pairwise([0, *ends])]
        assert capacity == least(sizes, shards) == max(parts) and ends[-1] == len(sizes) and len(ends) == shards
    assert smallest_capacity(np.array([], np.int64), 3) == 0 and cut(np.array([], np.int64), 3) == ([0, 0, 0], 0)
    ends, _ = cut(np.array([1000, *[10] * 200]), 5)
    assert ends[0] == 1 and all(45 <= b - a <= 55 for a, b in itertools.pairwise(ends))


def facts(rows, text_of):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    for members in out.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    where = {}
    for r in rows:
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in text_of)
    return out


@pytest.mark.parametrize("bits", [3, 16])
def test_assign_shards(spark, bits):
    from tidewarden.llm.sharding import assign_shards, group_of, plan_shards, write_shards
    from pyspark.sql import functions as F

    data = corpus()
    docs = spark.createDataFrame(data, DOCS).repartition(3).withColumn("shard", F.lit("mine")).withColumn("size", F.lit(None)).withColumn("g", F.lit(1)).withColumn("row", F.lit(1))
    rows = assign_shards(docs, 5, bits=bits).collect()
    parts = facts(rows, [(r[0], r[1]) for r in data])
    sizes = {s: sum(r.size for r in members) for s, members in parts.items()}
    plan = plan_shards(docs, 5, bits=bits)
    assert max(sizes.values()) <= plan.capacity
    grouped = docs.groupBy(group_of(F.col("text"), bits).alias("k")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("n")).collect()
    total = sum(r.n for r in grouped)
    order = sorted((r for r in grouped if r.n * 5 > total), key=lambda r: (-r.n, r.k)) + sorted((r for r in grouped if r.n * 5 <= total), key=lambda r: r.k)
    if bits == 3:
        assert plan.capacity == least([r.n for r in order], 5) == max(sizes.values())
    else:
        assert max(sizes.values()) - min(sizes.values()) < 0.35 * total / 5 + max(r.n for r in grouped)


def test_hot_text_empty_table_and_files(spark, tmp_path):
    from tidewarden.llm.sharding import assign_shards, plan_shards, write_shards

    r = random.Random(1)
    data = [(k % 7 if k % 3 else None, "the hot text " * 3) for k in range(300)] + [(k, "".join(r.choice("abcdef ") for _ in range(40))) for k in range(600)] + [(1, None)] * 40 + [(5, "x" * 3_000_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    parts = facts(assign_shards(docs, 6).collect(), data)
    sizes = sorted(sum(x.size for x in m) for m in parts.values())
    assert len(parts) == 6 and sizes[-1] == 3_000_008
    assert sizes[-2] == 300 * 47 or sizes[-2] < 1.1 * sum(sizes[:-1]) / 5 + 47 * 300
    assert assign_shards(docs.limit(0), 6).count() == 0
    assert plan_shards(docs.limit(0), 6).capacity == 0
    with pytest.raises(ValueError):
        write_shards(docs, str(tmp_path / "s"), plan_shards(docs, 6), shard_col="text")
    write_shards(docs, str(tmp_path / "s"), plan_shards(docs, 6), shard_col="_shard")
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("_shard").count().collect()
    assert {b._shard: b["count"] for b in back} == {s: len(m) for s, m in parts.items()}
