"""Best-fit packing by length-histogram planning.

Documents are tokenised once and cut into pieces. Best-fit decreasing runs over the histogram of
piece lengths: bins with the same content are one class with a count, so the plan's size depends on
the sequence length alone. Pieces then take planned slots by their rank within their length.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length int, first_rank long, bins long, each long, first_sequence long, first_offset int"


def default_tokenizer() -> str:
    """The public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, those of the vocabulary's added tokens included where a text holds one. A ``.json`` file with a rank file of
    the same name beside it is read through the latter: the same vocabulary and ids (a test compares them), at a quarter of the time."""

    def __init__(self, path: str):
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            with open(path, encoding="utf-8") as model_file:
                added = {t["content"]: t["id"] for t in json.load(model_file).get("added_tokens", [])}
            model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
            self.encode = lambda text: model.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.encode = lambda text: model.encode(text, add_special_tokens=False).ids

    def ids(self, text: str, span: int = 1 << 20) -> np.ndarray:
        """Little-endian 32-bit ids. Very long texts are encoded in spans cut before a space that follows a letter."""
        if len(text) <= span:
            return np.array(self.encode(text), "<u4")
        out, at = [], 0
        while at < len(text):
            to = at + span
            while to < len(text) and not (text[to] == " " and text[to - 1].isalpha() and text[to + 1 : to + 2].isalpha()):
                to += 1
            out.append(np.array(self.encode(text[at:to]), "<u4"))
            at = to
        return np.concatenate(out)


def pieces_of(ids: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids): full pieces after a first one that may be shorter."""
    count = -(-len(ids) // most)
    start, to = 0, len(ids) - most * (count - 1)
    for piece in range(count):
        yield piece, start, to - start, zlib.crc32(ids[start:to].tobytes())
        start, to = to, to + most


def tokenised(docs: DataFrame, most: int, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES of every row; each text ends with end_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        encoder = Encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.ids(text), end])
                out += [(doc, *p) for p in pieces_of(ids, most)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows of SLOTS.

    Rank q (from first_rank) of a length goes to bin q' // each of the row's bins at first_offset +
    (q' % each) * length, q' = q - first_rank. Bins are numbered from 0 in classes of equal content;
    a class is split when only some of its bins take a length.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first bin, number of bins)]
    rooms: list[int] = []
    out, bins = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first = most, bins
                count = -(-left // (most // length))
                bins += count
            each = room // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, full, each, first, most - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # less than a bin's worth is left
                out.append((length, rank, 1, left, first + full, most - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    return out


def pack(
    docs: DataFrame,
    most: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """Pack all rows into sequences of at most ``most`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents
    of more than ``most`` tokens are cut, into full pieces after a first one that may be shorter. Null and
    empty texts are one end token. Rows that repeat are packed each on their own. An empty table
    gives an empty result.

    The piece table (a few numbers per document) is written once, by a checkpoint in the cluster's
    shared folder, so that texts are tokenised once. The driver holds the histogram, of at most
    ``most`` lengths, and the plan, whose rows the number of lengths bounds, not the documents.
    Ranks within a length come from counts by (shard, length), so no length is one task.
    """
    spark = docs.sparkSession
    pieces, _ = settle(tokenised(docs, most, tokenizer or default_tokenizer(), end_id, id_col, text_col))
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, most)
    before = counts.select(
        "shard", F.col("length").alias("len"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "start"))
    ranked = pieces.withColumn("local", local - 1)
    ranked = ranked.join(before, (ranked["shard"] == before["shard"]) & (ranked["length"] == before["len"])).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")
    )
    table = np.array(rows or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    result = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        slots = shared.value
        start_of = np.searchsorted(slots[:, 0], np.arange(most + 2))
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine = length == one
                lo, hi = start_of[one], start_of[one + 1]
                at[mine] = lo + np.searchsorted(slots[lo:hi, 1], rank[mine], "right") - 1
            row = slots[at]
            q = rank - row[:, 1]
            sequence, offset = row[:, 4] + q // row[:, 3], row[:, 5] + q % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, result)
