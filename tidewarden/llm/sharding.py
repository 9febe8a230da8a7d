"""Shards of nearly equal bytes: a minimax contiguous partition of ordered atomic groups. DataFrame operations only.

All copies of a text hash into one atomic group; the groups stand in the order of their hashes, those larger
than a mean shard before them. A binary search finds the smallest capacity at which a greedy
pass needs no more than the given number of shards, and the groups are cut under that capacity. The
driver holds the groups' sizes, at most 2 ** bits numbers at any size of the input, and the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import settle

#: Rows that are numbered together at most.
BLOCK_BITS = 20


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def group_of(text: Column, bits: int) -> Column:
    """The atomic group of a text: the first bits of its hash. A null counts as the empty text."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - bits)


def feasible(ends: np.ndarray, capacity: int, shards: int) -> bool:
    """Whether a greedy pass at this capacity needs no more than so many shards; ends: running sums of the ordered sizes."""
    at, start = 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, start + capacity, "right"))
        if at == len(ends):
            return True
        start = int(ends[at - 1]) if at else 0
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity that suffices for so many contiguous shards."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(sizes.max()) + -(-int(ends[-1]) // shards)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(ends, middle, shards) else (middle + 1, high)
    return low


def cut(sizes: np.ndarray, shards: int) -> tuple[list[int], int]:
    """Ends of the shards (as indexes into sizes) and the smallest capacity, which none of them exceeds.

    Each end is the one nearest to an equal share of what is left that keeps to the capacity and leaves
    no more than the shards after it can hold, so that a group as large as many shards leaves none of the others empty.
    """
    capacity = smallest_capacity(sizes, shards)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    earliest = [len(sizes)]
    for _ in range(shards):
        earliest.append(int(np.searchsorted(ends, ends[earliest[-1]] - capacity, "left")))
    out, at = [], 0
    for k in range(shards):
        least, most = max(at, earliest[shards - 1 - k]), int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        goal = int(ends[at]) + (int(ends[-1]) - int(ends[at])) / (shards - k)
        near = int(np.searchsorted(ends, goal))
        near = near - 1 if near > at + 1 and goal - ends[near - 1] <= ends[min(near, len(sizes))] - goal else near
        at = min(max(near, at + 1, least), most)
        out.append(at)
    return out, capacity


@dataclass(frozen=True)
class ShardPlan:
    """Groups larger than a mean shard, in order, the first group of each further cut, and the smallest capacity."""

    shards: int
    bits: int
    capacity: int
    alone: dict[int, int]
    first: int
    starts: list[int]

    def shard_of(self, text: Column) -> Column:
        """The shard of a text, as an expression: rows need no join to find it."""
        return self.shard_of_group(group_of(text, self.bits))

    def shard_of_group(self, group: Column) -> Column:
        out = F.lit(self.first)
        for start in self.starts:
            out = out + (group >= start).cast("int")
        for g, shard in self.alone.items():
            out = F.when(group == g, shard).otherwise(out)
        return out.cast("int")


def _plan(found: list[tuple[int, int]], shards: int, bits: int) -> ShardPlan:
    """found: (group, bytes)."""
    total = sum(n for _, n in found)
    large = sorted((x for x in found if x[1] * shards > total), key=lambda x: (-x[1], x[0]))
    known = {g for g, _ in large}
    order = [*large, *sorted(x for x in found if x[0] not in known)]
    ends, capacity = cut(np.array([n for _, n in order], np.int64), shards)
    of = np.searchsorted(ends, np.arange(len(order)), "right")
    alone = {g: int(of[k]) for k, (g, _) in enumerate(large)}
    rest = [(g, int(of[k])) for k, (g, _) in enumerate(order) if g not in known]
    starts, first = [], rest[0][1] if rest else 0
    last = first
    for g, shard in rest:
        starts += [g] * (shard - last)
        last = shard
    return ShardPlan(shards, bits, capacity, alone, first, starts)


def plan_shards(docs: DataFrame, shards: int, text_col: str = "text", bits: int = 16) -> ShardPlan:
    """The plan for all rows of docs: one aggregate, combined before its shuffle into at most 2 ** bits rows."""
    found = docs.select(group_of(F.col(text_col), bits).alias("g"), text_size(F.col(text_col)).alias("n")).groupBy("g").agg(F.sum("n").alias("n")).collect()
    return _plan([(r.g, r.n) for r in found], shards, bits)


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", bits: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row, under the law ``bytes``.

    The largest shard has the smallest capacity that the ordered groups allow; with groups of less than 1/100 of a
    shard, all shards are within some hundredths of the mean. Equal texts share a shard, however many they are; a null text
    counts as empty (size 8, checksum 0). Slots number the rows of a shard from 0 without gaps, in the order of
    the input's blocks of at most a million rows. Null or repeated ids, ties and repeated rows each keep their row; an
    empty table gives an empty result; other columns are not read, whatever their names. grown_shard is null under this law.

    One pass over the texts leaves narrow rows in a checkpoint, so that blocks are the same for the
    counts and the slots. The one shuffle of all (narrow) rows goes by block and shard: neither a hot text nor a hot id is a key of it.
    """
    row = F.monotonically_increasing_id()
    rows, _ = settle(
        docs.select(
            F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            group_of(F.col(text_col), bits).alias("g"), row.alias("row"),
        ).withColumn("block", F.shiftright("row", BLOCK_BITS)), each=50_000
    )
    plan = _plan([(r.g, r.n) for r in rows.groupBy("g").agg(F.sum("size").alias("n")).collect()], shards, bits)
    rows = rows.withColumn("shard", plan.shard_of_group(F.col("g"))).drop("g")
    # how many rows of a shard stand in the blocks before: one narrow row a block and shard
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.selectExpr("shard", "block", "sum(rows) OVER (PARTITION BY shard ORDER BY block) - rows AS before")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, block ORDER BY row) - 1 AS place")
    return numbered.join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, plan: ShardPlan, text_col: str = "text", shard_col: str = "shard") -> None:
    """Write all columns of docs as Parquet, a folder for each shard. A column of docs named as shard_col would be lost: name another."""
    if shard_col in docs.columns:
        raise ValueError(f"docs has a column {shard_col}; give another shard_col")
    docs.withColumn(shard_col, plan.shard_of(F.col(text_col))).write.partitionBy(shard_col).parquet(path)
