"""Fingerprint exchange: the one shuffle pattern behind the duplicate and language-model operators.

Documents are dealt into groups of a few megabytes by a hash of their id. A group reduces its
fingerprints to a sorted set (with counts or flags) and sends one packed blob to each bucket of
the hash space. A fingerprint that a third of all documents share therefore reaches its bucket
once a group, not once a document: pre-aggregated, with no hot key and no pair of documents.
The bucket merges the sets and answers each group about its own fingerprints.

All of it is ordinary Spark: groupBy().applyInArrow() and cogroup().applyInArrow(). Memory is that
of one group or one bucket. Lost executors are made good by recomputing the lost shuffle files;
every step is a function of its rows alone.
"""

from __future__ import annotations

import contextlib
import math
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PACKED = "grp int, pack binary"
ENTRIES = "bucket int, grp int, level int, blob binary"
REPLIES = "grp int, bucket int, level int, blob binary"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where nothing names one, only a local master gets a folder of its own."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        have = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return have


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Inside, plans that are made and run drop their shuffle files as soon as they have run, and texts reach Python in small batches."""
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    if not before[_BATCH] or not 0 < int(before[_BATCH]) <= _MOST_ROWS:
        spark.conf.set(_BATCH, str(_MOST_ROWS))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, each: int = 200_000) -> tuple[DataFrame, int]:
    """df cut from its lineage by a checkpoint, in a partition for every ``each`` rows at most as many as it had, and its number of rows.

    The shuffle files behind it go at once: the checkpoint in the shared folder replaces them. So does Spark's estimate of its size,
    which a checkpoint would keep: a join's is the product of its sides', so over rounds of joins its digits double until they fill the driver.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    seen = Observation()
    with tidy(spark):
        out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    n = int(seen.get.get("n") or 0)
    stored = out._jdf.queryExecution().analyzed().rdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(stored, out._jdf.schema(), False), spark)
    return out.coalesce(max(1, -(-n // each))), n


def sized(side: tuple[DataFrame, int], most: int = 200_000) -> DataFrame:
    """A settled join side, broadcast if it has at most ``most`` (narrow) rows; else Spark joins by shuffle."""
    return F.broadcast(side[0]) if side[1] <= most else side[0]


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column; one aggregate over that column alone."""
    row = docs.select(F.sum(F.octet_length(F.col(column))).alias("n")).first()
    return int(row.n or 0)


def group_count(n_bytes: int, each: int | None = None, least: int = 4 << 20, most: int = 512 << 20) -> int:
    """Number of groups, and of buckets, for so many bytes: groups of ``each`` bytes.

    By default their size grows with the root of the input (4 MB below a gigabyte, 45 MB at 100 GB), so that the rows that groups send to
    buckets grow as the input and not as its square; ``most`` bounds a task's memory.
    """
    if each is None:
        each = int(min(max(least, math.sqrt(n_bytes * 20_000.0)), most))
    return max(1, -(-n_bytes // each))


def _squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as compressed byte planes of their differences."""
    step = np.diff(keys, prepend=np.uint64(0))
    return _squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_array(a: np.ndarray) -> bytes:
    """Any numeric array, by byte planes."""
    size = a.dtype.itemsize
    raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, size).T).tobytes()
    return a.dtype.char.encode() + _squeeze(raw)


def unpack_array(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(_expand(raw[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def join_blobs(parts: Iterable[bytes]) -> bytes:
    return b"".join(struct.pack("<q", len(p)) + p for p in parts)


def split_blobs(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = struct.unpack_from("<q", raw, at)[0]
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


# -- dealing documents into groups ---------------------------------------------------------


def _pack_docs(ids: list, texts: list[bytes | None]) -> bytes:
    sizes = np.fromiter((-1 if t is None else len(t) for t in texts), np.int64, len(texts))
    known = np.fromiter((i is not None for i in ids), np.uint8, len(ids))
    plain = np.fromiter((0 if i is None else i for i in ids), np.int64, len(ids))
    return _squeeze(struct.pack("<q", len(ids)) + known.tobytes() + plain.tobytes() + sizes.tobytes() + b"".join(t for t in texts if t), 3)


def _unpack_docs(raw: bytes) -> tuple[list, list[bytes | None]]:
    raw = _expand(raw)
    n = struct.unpack_from("<q", raw)[0]
    known = np.frombuffer(raw, np.uint8, n, 8)
    plain = np.frombuffer(raw, np.int64, n, 8 + n)
    sizes = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
    ids = [int(i) if k else None for i, k in zip(plain, known, strict=True)]
    texts, at = [], 8 + 17 * n
    for s in sizes:
        texts.append(None if s < 0 else raw[at : at + s])
        at += max(int(s), 0)
    return ids, texts


def group_of(groups: int, id_col: str = "doc_id", text_col: str | None = "text") -> Column:
    """The group of a row, by id and text: a null or repeated id alone fills no group. Without a text column, by id alone."""
    by = [F.col(id_col).cast("long"), *([F.col(text_col)] if text_col else [])]
    return F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")


def deal(docs: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text", by_id: bool = False, most: int = 24 << 20) -> DataFrame:
    """(grp, pack): compressed packs of documents, each of one group; at most about ``most`` bytes wait in a task.

    by_id: rows with the same id share a group, so that marks can reach it; null ids are still spread.
    """
    both = group_of(groups, id_col, text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
        (F.when(F.col(id_col).isNotNull(), group_of(groups, id_col, None)).otherwise(both) if by_id else both).alias("grp"),
    )

    def run(batches):
        waiting: dict[int, tuple[list, list]] = {}
        size = 0

        def flush():
            keys = sorted(waiting)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([_pack_docs(*waiting[k]) for k in keys], pa.binary())], ["grp", "pack"])
            waiting.clear()
            return out

        for batch in batches:
            for i, t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, texts = waiting.setdefault(g, ([], []))
                ids.append(i)
                texts.append(t)
                size += len(t or b"") + 64
                if size > most:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return rows.mapInArrow(run, PACKED)


def group_docs(table: pa.Table) -> tuple[list, list[bytes | None]]:
    """The documents of a group, in one order whatever the order of its packs: by id, then by text."""
    ids, texts = [], []
    for raw in table.column("pack").to_pylist():
        i, t = _unpack_docs(raw)
        ids += i
        texts += t
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] is not None, texts[k] or b""))
    return [ids[k] for k in order], [texts[k] for k in order]


def table_of(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema, columns, strict=True)})


_ENTRY = [("bucket", pa.int32()), ("grp", pa.int32()), ("level", pa.int32()), ("blob", pa.binary())]
_REPLY = [("grp", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("blob", pa.binary())]


def _edges(buckets: int) -> np.ndarray:
    return (np.arange(buckets + 1, dtype=np.float64) * (2.0**32 / buckets)).astype(np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds in the ascending keys of the buckets, which are equal ranges of the upper 32 bits."""
    return np.searchsorted(keys >> np.uint64(32), _edges(buckets))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key."""
    return (np.searchsorted(_edges(buckets), keys >> np.uint64(32), "right") - 1).astype(np.int32)


def send(group: int, level: int, buckets: int, keys: np.ndarray, make: Callable[[int, int], bytes]) -> pa.Table:
    """One entry row for each bucket that the group has keys for; make(lo, hi) packs a range of them."""
    bounds = bucket_bounds(keys, buckets)
    rows = [(b, group, level, make(lo, hi)) for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if hi > lo]
    return table_of(_ENTRY, rows)


def entries(dealt: DataFrame, make: Callable[[int, list, list], pa.Table]) -> DataFrame:
    """make(group, ids, texts) -> entries, for every group."""

    def run(key, table):
        return make(int(key[0].as_py()), *group_docs(table))

    return dealt.groupBy("grp").applyInArrow(run, ENTRIES)


def entries_after(dealt: DataFrame, replies: DataFrame, make: Callable[[int, list, list, list], pa.Table], schema: str = ENTRIES) -> DataFrame:
    """make(group, ids, texts, replies) for every group; replies as (level, bucket, blob), in order."""

    def run(key, left, right):
        got = sorted(zip(right.column("level").to_pylist(), right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True), key=lambda r: r[:2])
        return make(int(key[0].as_py()), *group_docs(left), got)

    return dealt.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(run, schema)


def answers(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """answer(blobs of one bucket) -> a reply for each blob, in order."""

    def run(table):
        order = sorted(range(table.num_rows), key=(grps := table.column("grp").to_pylist()).__getitem__)
        blobs, level, bucket = table.column("blob").to_pylist(), table.column("level").to_pylist(), table.column("bucket").to_pylist()
        got = answer([blobs[i] for i in order])
        return table_of(_REPLY, [(grps[i], bucket[i], level[i], r) for i, r in zip(order, got, strict=True)])

    return sent.groupBy("bucket").applyInArrow(run, REPLIES)


# -- which fingerprints repeat -------------------------------------------------------------


def pack_flagged(keys: np.ndarray, twice: np.ndarray) -> bytes:
    return join_blobs([pack_keys(keys), _squeeze(np.packbits(twice).tobytes())])


def unpack_flagged(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, flags = split_blobs(raw)
    got = unpack_keys(keys)
    return got, np.unpackbits(np.frombuffer(_expand(flags), np.uint8))[: len(got)].astype(bool)


def repeated_keys(blobs: list[bytes]) -> list[bytes]:
    """Answer each group's flagged keys with those that another group has too, or that are flagged anywhere."""
    parts = [unpack_flagged(b) for b in blobs]
    keys = np.concatenate([k for k, _ in parts])
    uniq, count = np.unique(np.concatenate([keys, *(k[f] for k, f in parts)]), return_counts=True)
    many = uniq[count > 1]
    from .kernels import contains

    return [pack_keys(k[contains(many, k)]) for k, _ in parts]


def reply_keys(replies: list[tuple[int, int, bytes]], level: int) -> np.ndarray:
    """The ascending keys in the replies of a level."""
    parts = [unpack_keys(b) for lv, _, b in replies if lv == level]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
