"""Exact products of tables of vectors in blocks, and search for similar vectors by them or by random hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

CODES = "vec_id {kind}, nth int, code long"
#: Vectors of a block at most: 16 MB a side as doubles of 64 dimensions.
BLOCK = 32_768


def block_counts(n: int, m: int, cells: int = 64) -> tuple[int, int]:
    """Numbers of blocks of two tables of n and m vectors: about ``cells`` pairs of blocks, more where a block would hold over BLOCK vectors."""
    each = min(max(1024, math.ceil(math.sqrt(n * m / cells))), BLOCK)
    return max(1, -(-n // each)), max(1, -(-m // each))


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, added up entry by entry in their order."""
    dot, a, b = (np.cumsum(x, axis=1)[:, -1] for x in (u * v, u * u, v * v))
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


def by_blocks(queries: DataFrame, corpus: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(columns of queries, columns of corpus, similarity) of the pairs that ``find`` picks from two blocks of vectors; both tables have ``embedding``, which is left out.

    Each row is dealt into a block by its hash, and each pair of blocks is one group, whose matrix product is taken in slices: all pairs are compared, and
    a task holds two blocks at a time. find: two matrices of unit rows -> row numbers of queries and of vectors. Vectors of different lengths don't meet.
    """
    n, m = block_counts(queries.count(), corpus.count())
    dealt = lambda rows, blocks: F.pmod(F.xxhash64(*rows.columns), F.lit(blocks).cast("long"))
    left = queries.withColumn("_cell", F.explode(F.sequence(dealt(queries, n) * m, dealt(queries, n) * m + (m - 1))))
    right = corpus.withColumn("_cell", F.explode(F.sequence(dealt(corpus, m), F.lit(n * m - 1).cast("long"), F.lit(m).cast("long"))))
    mine, theirs = ([c for c in t.columns if c != "embedding"] for t in (queries, corpus))

    def of_length(t: pa.Table, d: int, names: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.filter(pc.equal(pc.list_value_length(t["embedding"]), d))
        x = pc.list_flatten(t["embedding"]).to_numpy().astype(np.float64).reshape(len(t), d)
        return t.select(names), x, x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [pa.Table.from_batches([], arrow)]
        if not (len(a) and len(b)):
            return out[0]
        both = {d for d in pc.unique(pc.list_value_length(a["embedding"])).to_pylist() if d} & set(pc.unique(pc.list_value_length(b["embedding"])).to_pylist())
        with np.errstate(all="ignore"):
            for d in both:
                (one, x, ux), (other, y, uy) = of_length(a, d, mine), of_length(b, d, theirs)
                step = max(1, (4 << 20) // len(uy))
                for k in range(0, len(ux), step):
                    i, j = find(ux[k : k + step], uy)
                    for lo in range(0, len(i), 1 << 16):
                        p, q = i[lo : lo + (1 << 16)] + k, j[lo : lo + (1 << 16)]
                        columns = [*one.take(pa.array(p)).columns, *other.take(pa.array(q)).columns, pa.array(cosines(x[p], y[q]))]
                        out.append(pa.table(columns, names=arrow.names).cast(arrow))
        return pa.concat_tables(out)

    schema = StructType([*[queries.schema[c] for c in mine], *[corpus.schema[c] for c in theirs], StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(schema)
    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(compare, schema)


def plan_tables(n: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, tables) so that two vectors of cosine ``least`` share a probed bucket with probability ``recall``.

    About as many buckets a table as vectors; a query probes its own bucket and those one bit away.
    """
    bits = min(max(8, math.ceil(math.log2(max(n, 2)))), 30)
    same = 1 - math.acos(least) / math.pi
    hit = same**bits + bits * same ** (bits - 1) * (1 - same)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def codes(vectors: DataFrame, bits: int, tables: int, probes: bool, seed: int = 0) -> DataFrame:
    """(vec_id, nth, code) of a table (vec_id, embedding) for each of the tables: signs of projections; with probes also every code one bit away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, weights = None, 1 << np.arange(bits, dtype=np.int64)
        flips = np.concatenate([[0], weights]) if probes else np.zeros(1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(b.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            for k in range(0, len(x), 1000):
                some = x[k : k + 1000]
                own = ((some @ planes > 0).reshape(len(some), tables, bits) * weights).sum(2)
                all_ = own[:, :, None] ^ flips
                rows = np.repeat(np.arange(k, k + len(some)), tables * len(flips))
                nth = np.tile(np.repeat(np.arange(tables, dtype=np.int32), len(flips)), len(some))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(nth), pa.array(all_.ravel())], ["vec_id", "nth", "code"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, CODES.format(kind=dict(vectors.dtypes)["vec_id"]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors without nulls, of finite length above 0."""
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
    return fine.where((norm > 0) & (norm < float("inf"))).select("vec_id", "embedding")


def _unit(vectors: DataFrame) -> DataFrame:
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
    return vectors.withColumn("_norm", norm).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


def similar_vectors(queries: DataFrame, corpus: DataFrame, least: float = 0.75, recall: float | None = None, seed: int = 0) -> DataFrame:
    """(query_id, vec_id, copies, similarity): vectors of the corpus whose cosine with a query is at least ``least``, both tables (vec_id, embedding).

    Equal vectors of the corpus are one, named by their least id, with the number of copies, so that many copies of one vector meet a query once.
    Without ``recall`` every pair is found, by products of blocks. With it, random hyperplanes propose the pairs: of those at ``least`` itself that share is found, of nearer
    ones more, and a vector sends one short row a table. No pair is reported whose exact cosine is lower. Null vectors, null ids, vectors with null or
    infinite entries and zero vectors match nothing. Hyperplanes need vectors of one length and one vector an id.
    """
    listed = _usable(corpus).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    asked = _usable(queries)
    if recall is None:
        # the product may be off by some units in the last place, so the exact cosine decides
        found = by_blocks(asked.withColumnRenamed("vec_id", "query_id"), listed, lambda u, v: np.nonzero(u @ v.T >= least - 1e-9))
        return found.where(F.col("similarity") >= least).select("query_id", "vec_id", "copies", "similarity")
    one = asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    near = _by_planes(_unit(one), _unit(listed), corpus.count(), least, recall, seed)
    same = asked.join(one.withColumnRenamed("vec_id", "rep"), "embedding").select("rep", F.col("vec_id").alias("query_id"))
    return same.join(near, "rep").select("query_id", "vec_id", "copies", "similarity")


def _by_planes(one: DataFrame, listed: DataFrame, n: int, least: float, recall: float, seed: int) -> DataFrame:
    """(rep, vec_id, copies, similarity): pairs that share a probed bucket, of unit vectors."""
    bits, tables = plan_tables(n, least, recall)
    ours = codes(one, bits, tables, True, seed).withColumnRenamed("vec_id", "rep")
    pairs = ours.join(codes(listed, bits, tables, False, seed), ["nth", "code"]).select("rep", "vec_id").distinct()
    near = pairs.join(one.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("u")), "rep").join(listed, "vec_id")
    return near.withColumn("similarity", _dot(F.col("u"), F.col("embedding"))).where(F.col("similarity") >= least).select("rep", "vec_id", "copies", "similarity")
