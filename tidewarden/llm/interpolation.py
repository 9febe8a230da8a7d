"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of each n-gram order are mixed with weights that depend on how often
the context was seen. The weights are learned by expectation-maximisation on held-out counts: the documents are dealt
into folds, and every training token is scored with the counts of its whole fold deleted.

Counts travel by the fingerprint exchange: a group of documents (a fold) sends each distinct n-gram once, with its
training count, and gets the corpus count back, or word that no other group has it. n-grams above the first order are counted under every
context that training text has. What stands under a context that one group alone has is counted there and needn't travel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RESULT = [
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
]
_END, _START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TOTALS, _CELLS, _COUNTS = -1, -2, -3  # kinds of rows beside replies
_STEPS = 2  # histogram steps in an octave
_SPAN = 128 * _STEPS
_FOLDS = 8  # groups at least
#: Bits of a hash that tell n-grams above the first order apart, at every size of the corpus; tokens have all 64.
GRAM_BITS = 54


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 64) - 1 if order == 1 else ((1 << 64) - 1) ^ ((1 << 64 - GRAM_BITS) - 1))


def is_held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    """Whether crc32 of the id as text falls into the held-out fold; a null id is the text ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


class _Tokens:
    """All tokens of a group with their contexts: words, then one end for each document."""

    def __init__(self, ids: list, texts: list[bytes | None], split):
        """split(id): whether a document is held out."""
        token, owner = [], []
        for at, part in K.chunks([t or b"" for t in texts], 1 << 18):
            c = K.Chunk.of(part)
            start, end, doc = c.words()
            c.buf = _LOWER[c.buf]
            place = np.concatenate([doc, np.arange(len(part))])
            order = np.argsort(place, kind="stable")
            token.append(np.concatenate([c.word_hash(start, end), np.full(len(part), _END)])[order])
            owner.append((place[order] + at).astype(np.int32))
        self.token = np.concatenate(token) if token else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.train = ~np.array([split(i) for i in ids], bool)
        self.back = [self._shift(1), self._shift(2)]
        self.first = np.flatnonzero(np.diff(self.owner, prepend=-1))

    def _shift(self, n: int) -> np.ndarray:
        out = np.full(len(self.token), _START)
        if len(out) > n:
            same = self.owner[n:] == self.owner[:-n]
            out[n:][same] = self.token[:-n][same]
        return out

    def gram(self, order: int) -> np.ndarray:
        """Hash of the order-gram that ends at each token."""
        out = self.token
        for j in range(order - 1):
            out = K.mix(out + self.back[j] * np.uint64(0x9E3779B97F4A7C15 + 2 * j))
        return out & _mask(order)

    def start_key(self, order: int) -> np.uint64:
        """The context of that order at a document's start."""
        out = np.full(1, _START)
        for j in range(order - 1):
            out = K.mix(out + np.full(1, _START) * np.uint64(0x9E3779B97F4A7C15 + 2 * j))
        return out[0] & _mask(order)


class _Level:
    """Distinct n-grams of one order in a group, and the place of each token's among them."""

    def __init__(self, t: _Tokens, order: int, wanted: np.ndarray, alone: np.ndarray, most: int):
        """wanted: tokens whose context was seen; alone: those whose context no other group has."""
        self.order, self.wanted = order, wanted
        keys = t.gram(order)[wanted]
        starts = order < most  # contexts of the next order include a document's start
        self.keys, place = K.unique_inverse(np.append(keys, np.full(int(starts), t.start_key(order))))
        self.place = place[: len(keys)]
        self.start = int(place[-1]) if starts else None
        weight = t.train[t.owner[wanted]].astype(np.float64)
        self.train = np.bincount(self.place, weight, minlength=len(self.keys)).astype(np.int64)
        if starts:
            self.train[place[-1]] += int(t.train.sum())
        if len(self.keys) < 1 << 31:
            self.place = self.place.astype(np.int32)
        self.local = np.zeros(len(self.keys), bool)
        self.local[self.place[alone[wanted]]] = True
        self.asked = np.flatnonzero(~self.local)

    def resolve(self, reply: np.ndarray) -> None:
        """reply: one more than the corpus count of each n-gram that was asked for, 0 where no other group has it."""
        self.total = self.train.copy()
        known = reply > 0
        self.total[self.asked[known]] = reply[known] - 1
        self.sole = self.local.copy()
        self.sole[self.asked[~known]] = True

    def spread(self, t: _Tokens, values: np.ndarray) -> np.ndarray:
        """values of the distinct n-grams, for each token."""
        if values.dtype == np.int64 and (not len(values) or values.max() < 1 << 31):
            values = values.astype(np.int32)
        out = np.zeros(len(t.token), values.dtype)
        out[self.wanted] = values[self.place]
        return out

    def shifted(self, t: _Tokens, spread: np.ndarray, values: np.ndarray) -> np.ndarray:
        """values of the context of the next order: those at the token before, or of a document's start."""
        out = np.empty_like(spread)
        out[1:] = spread[:-1]
        out[t.first] = values[self.start] if self.start is not None else 0
        return out


class _Counts:
    """The n-grams of order upto of a group (last); of the orders whose replies are known, each token's counts in the corpus and in its own group."""

    def __init__(self, t: _Tokens, replies: list[np.ndarray], most: int, upto: int):
        self.count, self.context, self.own, self.own_context = [], [], [], []
        wanted, alone = np.ones(len(t.token), bool), np.zeros(len(t.token), bool)
        for order in range(1, upto + 1):
            self.last = level = _Level(t, order, wanted, alone, most)
            if order <= len(replies):
                level.resolve(replies[order - 1])
                self.count.append(level.spread(t, level.total))
                self.own.append(level.spread(t, level.train))
                if order < most:
                    self.context.append(level.shifted(t, self.count[-1], level.total))
                    self.own_context.append(level.shifted(t, self.own[-1], level.train))
                    wanted = self.context[-1] >= 1
                    alone = wanted & level.shifted(t, level.spread(t, level.sole), level.sole)

    def parts(self, rows: np.ndarray, held_out: bool):
        """(bucket, estimates above the first order, first-order count) of the chosen tokens, without their own group's counts if held_out.

        The bucket is that of the longest context seen: 64 * order + its frequency class.
        """
        less = lambda all_, own: all_[rows] - own[rows] if held_out else all_[rows]
        first = less(self.count[0], self.own[0])
        bucket = np.zeros(len(first), np.int64)
        estimates = []
        for j, context in enumerate(self.context):
            context = less(context, self.own_context[j])
            top = less(self.count[j + 1], self.own[j + 1])
            estimates.append(np.where(context >= 1, top / np.maximum(context, 1), 0.0))
            bucket = np.where(context >= 1, 64 * (j + 2) + _bucket(context), bucket)
        return bucket, estimates, first


def _replies(got: list, upto: int) -> list[np.ndarray]:
    out = []
    for level in range(1, upto + 1):
        parts = [X.unpack_array(raw) for lv, _, raw in got if lv == level]
        out.append(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole log2 of the count: 1 for contexts seen once."""
    return np.where(context >= 1, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def learn(cells: dict[tuple[int, ...], int], unit: float, order: int, rounds: int = 60) -> dict[int, np.ndarray]:
    """Mixture weights (longest order first, then down to the first) for each bucket, by expectation-maximisation.

    A cell is (bucket, one step a higher order, shortest order first) with its number of held-out tokens; a step is the ratio of
    an estimate to (first-order count + 1), and unit turns it into the ratio to the first-order estimate.
    """
    out = {}
    by_bucket: dict[int, list] = {}
    for cell, n in cells.items():
        by_bucket.setdefault(cell[0], []).append((cell[1:], n))
    for bucket, rows in by_bucket.items():
        steps, n = np.array([r for r, _ in rows]).reshape(len(rows), -1), np.array([c for _, c in rows], float)
        ratio = np.where(steps >= 0, np.exp2((steps - _SPAN // 2 + 0.5) / _STEPS) * unit, 0.0)
        ratio = np.concatenate([np.ones((len(rows), 1)), ratio], axis=1)
        open_ = np.arange(order) < max(bucket // 64, 1)
        weight = open_ / open_.sum()
        for _ in range(rounds):
            share = ratio * weight
            share /= share.sum(axis=1, keepdims=True)
            weight = (share * n[:, None]).sum(axis=0) + 0.5 * open_
            weight /= weight.sum()
        out[bucket] = weight
    return out


def score(
    docs: DataFrame,
    order: int = 3,
    folds: int = 7,
    fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int | None = None,
) -> DataFrame:
    """Score every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out of all counts and weights. A-Z are lower-cased;
    tokens are runs of bytes other than ASCII white space, then one end. base_score is the add-one
    unigram log10 probability; score that of the mixture of the orders up to ``order`` (2 or 3), whose lowest
    component is the add-one unigram, so that no text has probability zero. Null or empty text: the
    end alone. Repeated rows count each. An id that is null counts as the text ''. Other columns are not read. An
    empty table gives an empty result.

    Mixture weights belong to the frequency class (whole log2) of the longest context seen. They are learned on all training tokens, each with the counts
    of its group of documents deleted; rows are dealt into at least eight groups by id and text.

    Tokens are told apart by 64 bits of hash, n-grams above by ``GRAM_BITS``, whatever the size of the corpus: of V distinct tokens V**2 / 2**65 pairs are
    expected to be taken for one (three in a million runs at 10**7, three pairs at 10**10), of N distinct n-grams a share of N / 2**54.

    The driver holds totals and one histogram; its size follows the quantisation (frequency classes and ratios by half octaves),
    not the corpus. Replies (a few bits an n-gram) are checkpointed in the shared folder.
    """
    spark = docs.sparkSession
    X.ensure_checkpoint_dir(spark)
    size = X.text_bytes(docs, text_col)
    n = max(_FOLDS, X.group_count(size, group_bytes, 6 << 20))
    dealt = X.deal(docs, n, id_col, text_col)

    def held(i):
        return is_held_out(i, folds, fold)

    def totals_of(level: int):
        def answer(table):
            parts = []
            rows = sorted(zip(table.column("grp").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
            for _, _, raw in rows:
                keys, count = X.split_blobs(raw)
                parts.append((X.unpack_keys(keys), X.unpack_array(count).astype(np.int64)))
            keys = np.concatenate([k for k, _ in parts])
            uniq, place = K.unique_inverse(keys)
            total = np.bincount(place, np.concatenate([c for _, c in parts]), minlength=len(uniq)).astype(np.int64)
            reply = np.where(np.bincount(place, minlength=len(uniq)) > 1, total + 1, 0)
            out, at = [], 0
            for (grp, bucket, _), (k, _) in zip(rows, parts, strict=True):
                out.append((grp, bucket, level, X.pack_array(_small(reply[place[at : at + len(k)]]))))
                at += len(k)
            if level == 1:
                seen = (total > 0) & (uniq != _START)
                out.append((_TOTALS, rows[0][1], _TOTALS, struct.pack("<qq", int(seen.sum()), int(total[seen].sum()))))
            return X.table_of(X._REPLY, out)

        return answer

    replies = None
    for level in range(1, order + 1):

        def make(group, ids, texts, got=(), level=level):
            if not ids:
                return X.table_of(X._ENTRY, [])
            last = _Counts(_Tokens(ids, texts, held), _replies(got, level - 1), order, level).last
            keys, train = last.keys[last.asked], last.train[last.asked]
            return X.send(group, level, n, keys, lambda lo, hi: X.join_blobs([X.pack_keys(keys[lo:hi]), X.pack_array(_small(train[lo:hi]))]))

        sent = X.entries(dealt, make) if level == 1 else X.entries_after(dealt, replies, make)
        new = sent.groupBy("bucket").applyInArrow(totals_of(level), X.REPLIES)
        replies = new if replies is None else replies.unionByName(new)

    def tally(group, ids, texts, got):
        """The group's replies in one row, and the histogram of its tokens' estimates from all other groups."""
        if not ids:  # totals pass through
            return X.table_of(X._REPLY, [(group, b, lv, raw) for lv, b, raw in got])
        t = _Tokens(ids, texts, held)
        replies = _replies(got, order)
        counts = _Counts(t, replies, order, order)
        del counts.last
        bucket, estimates, first = counts.parts(t.train[t.owner], held_out=True)
        del counts
        cell = bucket
        for e in estimates:
            ratio = np.log2(np.maximum(e, 1e-300) / (first + 1.0))
            step = np.where(e > 0, np.clip(np.floor(ratio * _STEPS) + _SPAN // 2, 0, _SPAN - 1), -1).astype(np.int64)
            cell = cell * (_SPAN + 1) + step + 1
        uniq, count = K.unique_counts(cell)
        rows = [(group, 0, _CELLS, X.join_blobs([uniq.astype(np.int64).tobytes(), count.astype(np.int64).tobytes()]))]
        rows.append((group, 0, _COUNTS, X.join_blobs([X.pack_array(_small(x)) for x in replies])))
        return X.table_of(X._REPLY, rows)

    kept, _ = X.settle(X.entries_after(dealt, replies, tally, X.REPLIES), each=1)  # a row or two a group, each of them large

    def open_cells(batches):
        for batch in batches:
            parts = [[np.frombuffer(x, np.int64) for x in X.split_blobs(raw)] for raw in batch.column("blob").to_pylist()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[j] for p in parts])) for j in (0, 1)], ["cell", "n"])

    cells = kept.where(F.col("level") == _CELLS).select("blob").mapInArrow(open_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    split: dict[tuple[int, ...], int] = {}
    for r in cells:
        cell, steps = r.cell, []
        for _ in range(order - 1):
            cell, step = divmod(cell, _SPAN + 1)
            steps.append(step - 1)
        split[(cell, *reversed(steps))] = r.n

    def add(batches):
        distinct = total = 0
        for batch in batches:
            for raw in batch.column("blob").to_pylist():
                d, s = struct.unpack("<qq", raw)
                distinct, total = distinct + d, total + s
        yield pa.RecordBatch.from_arrays([pa.array([distinct]), pa.array([total])], ["v", "n"])

    sums = kept.where(F.col("level") == _TOTALS).select("blob").mapInArrow(add, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    vocabulary, train_tokens = int(sums.v or 0), int(sums.n or 0)
    below = train_tokens + vocabulary + 1.0
    weights = learn(split, train_tokens * (1 - 1 / n) + vocabulary + 1.0, order)  # a fold's tokens are deleted
    table = np.zeros((64 * (order + 1), order))
    table[:, 0] = 1.0
    for b in range(64, len(table)):  # a bucket without held-out tokens takes its nearest neighbour's weights
        near = [x for x in weights if x // 64 == b // 64]
        if near and b // 64 > 1:
            table[b] = weights[min(near, key=lambda x: abs(x - b))]

    def finish(group, ids, texts, got):
        if not ids:
            return X.table_of(_RESULT, [])
        t = _Tokens(ids, texts, held)
        packed = next(raw for lv, _, raw in got if lv == _COUNTS)
        replies = [X.unpack_array(x).astype(np.int64) for x in X.split_blobs(packed)]
        counts = _Counts(t, replies, order, order)
        del counts.last, replies, texts
        bucket, estimates, first = counts.parts(slice(None), held_out=False)
        del counts
        base = (first + 1.0) / below
        p = table[bucket, 0] * base
        for j, e in enumerate(estimates):
            p += table[bucket, j + 1] * e
        m = len(ids)
        columns = [
            np.bincount(t.owner, minlength=m), np.bincount(t.owner[first > 0], minlength=m),
            np.bincount(t.owner, np.log10(base), minlength=m), np.bincount(t.owner, np.log10(p), minlength=m),
        ]
        rows = [(ids[i], bool(not t.train[i]), int(a), int(b), train_tokens, float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(*columns, strict=True))]
        return X.table_of(_RESULT, rows)

    return X.entries_after(dealt, kept.where(F.col("level") == _COUNTS), finish, RESULT)
