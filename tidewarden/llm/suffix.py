"""Substring dedup over bytes with a run-length index (see rindex).

A string of ``window`` bytes stands under its least k-byte hash.
Windows whose k-byte string is in one document only leave at once; the others travel, as segments, to the
bucket of that hash, where all documents' segments are put in one order. There a
run-compressed Burrows-Wheeler transform with sampled run ends is built, matching statistics stream
over the segments, and every long match learns the least document that holds it. Equal windows meet in
one bucket, so no pair of blocks is compared.

A k-byte string that very many documents hold (a common passage) stands in as many different
surroundings. The windows under such a hot hash travel one by one, to the bucket of their own
hash: equal ones still meet, and no bucket gathers the surroundings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K
from .rindex import RunIndex

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_LAST = np.iinfo(np.int64).max
_BLOCK = 1 << 17  # bytes that are worked on at a time: small enough for a core's cache


class _Bytes:
    """The byte windows of a chunk, in runs: consecutive windows of one document with the same least k-byte hash."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        self.chunk = c = K.Chunk.of(texts)
        self.window, self.k = window, k
        self.pre = K.prefix(c.byte_values(), 0)
        self.least = self._least(k)
        n = len(self.least)
        head = np.ones(n, bool)
        head[1:] = self.least[1:] != self.least[:-1]
        head[c.start[c.start < n]] = True
        self.head = head
        self.start = np.flatnonzero(head)
        self.key = K.mix(self.least[self.start])  # least hashes are small ones: mixed again, they spread over the buckets
        self.count = self._valid(self.start, np.diff(np.append(self.start, n)))

    def _least(self, k: int) -> np.ndarray:
        """The least hash of the k-byte strings in each window."""
        return K.sliding(K.runs_hash(self.pre, k, 0), self.window - k + 1, np.minimum) if len(self.chunk.buf) >= self.window else np.zeros(0, np.uint64)

    def _valid(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How many of the windows from start lie in one document."""
        return np.clip(self.chunk.end[self.chunk.owner(start)] - self.window + 1 - start, 0, count)

    def _once(self, key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Ascending keys, each once for every document; owners ascend."""
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        return key[new]

    def first_level(self) -> np.ndarray:
        full = self.count > 0
        return self._once(self.key[full], self.chunk.owner(self.start[full]))

    def segments(self, known: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, number of windows): runs of candidate windows under one hash, and single windows under hot ones."""
        run = np.flatnonzero((self.count > 0) & K.contains(known, self.key))
        alone = K.contains(hot, self.key[run])
        one = _ranges(self.start[run[alone]], self.count[run[alone]])
        run = run[~alone]
        most = self.window - self.k + 1  # longer runs (periodic text) are cut
        parts = -(-self.count[run] // most)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, left, run = np.repeat(self.start[run], parts) + nth * most, np.repeat(self.count[run], parts) - nth * most, np.repeat(run, parts)
        own = K.spans_hash(self.pre, one, one + self.window, 0)
        return np.concatenate([self.key[run], own]), np.concatenate([start, one]), np.concatenate([np.minimum(left, most), np.ones(len(one), np.int64)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of the ranges from start, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _blocks(size: np.ndarray):
    """(lo, hi) of runs of pieces of about _BLOCK bytes."""
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _BLOCK)))
        yield lo, hi
        lo = hi


def _hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece buf[start : start + size], a block at a time."""
    out = np.empty(len(start), np.uint64)
    for lo, hi in _blocks(size):
        first = int(start[lo:hi].min())
        pre = K.prefix(K._BYTE[buf[first : int((start[lo:hi] + size[lo:hi]).max())]], 1)
        out[lo:hi] = K.spans_hash(pre, start[lo:hi] - first, start[lo:hi] - first + size[lo:hi], 1)
    return out


def _whole(buf: np.ndarray, size: int) -> np.ndarray:
    """Every piece of size bytes of buf as one value, by its start: pieces are copied whole."""
    return np.ndarray((max(0, len(buf) - size + 1),), f"V{size}", buf, 0, (1,))


def _alike(buf: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): the pieces buf[start : start + size] that differ, in the order of their key, and the place of each piece among them.

    Pieces are sorted by key and hash (told), and neighbours with the same ones are compared byte by byte. Should pieces that differ have the same
    hash, a piece may stand more than once among those that differ, which costs a row and changes no result.
    """
    order = K.sort_order(told)
    order = order[K.sort_order(key[order])]
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (told[a] == told[b]) & (size[a] == size[b])
    twins = np.flatnonzero(same)
    width = size[a[twins]]
    for w in np.flatnonzero(np.bincount(width)).tolist():
        at = twins[width == w]
        whole = _whole(buf, w)
        same[at] = (whole[start[a[at]]].view(np.uint8) == whole[start[b[at]]].view(np.uint8)).reshape(-1, w).all(axis=1)
    new = np.append(True, ~same)[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _copied(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces one after the other."""
    out = np.empty(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for w in np.flatnonzero(np.bincount(size)).tolist():
        mine = size == w
        _whole(out, w)[at[mine]] = _whole(buf, w)[start[mine]]
    return out


def _spread_keys(blobs: list[bytes], hot_docs: int) -> list[bytes]:
    """Answer each group's keys with those in at least two documents, and those in at least hot_docs."""
    parts = [X.split_blobs(b) for b in blobs]
    keys = [X.unpack_keys(k) for k, _ in parts]
    uniq, place = K.unique_inverse(np.concatenate(keys))
    total = np.bincount(place, np.concatenate([X.unpack_array(c) for _, c in parts]).astype(np.float64), minlength=len(uniq))[place]
    out, at = [], 0
    for mine in keys:
        n = total[at : at + len(mine)]
        at += len(mine)
        out.append(X.join_blobs([X.pack_keys(mine[n >= 2]), X.pack_keys(mine[n >= hot_docs])]))
    return out


def _known(got: list[tuple[int, int, bytes]], level: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in several documents, hot keys) of a level."""
    parts = [X.split_blobs(raw) for lv, _, raw in got if lv == level]
    none = np.zeros(0, np.uint64)
    return tuple(np.concatenate([X.unpack_keys(p[j]) for p in parts]) if parts else none for j in (0, 1))


def _gather(ids: list, texts: list, got: list, window: int, k: int, sent: bool = True):
    """Distinct segments of a group (key, size, least document, bytes), in the order of their key, all their occurrences, and the group's bytes.

    sent: without it, the least documents and the bytes, which buckets alone read, are left out.
    """
    known, hot = _known(got, 0)
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    keys, starts, counts, docs, told, parts = [], [], [], [], [], []
    offset = 0
    for at, part in K.chunks(texts, _BLOCK):
        b = _Bytes(part, window, k)
        key, start, count = b.segments(known, hot)
        owner = np.array([_LAST if ids[at + d] is None else ids[at + d] for d in range(len(part))], np.int64)
        parts.append((at, b.chunk.start, b.chunk.end, owner, start, count, offset))
        keys.append(key)
        starts.append(start + offset)
        counts.append(count)
        told.append(K.spans_hash(b.pre, start, start + count + window - 1, 0))
        docs.append(owner[b.chunk.owner(start)])
        offset += len(b.chunk.buf)
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, buf, none, parts, buf
    keys, starts, counts, docs, told = (np.concatenate(x) for x in (keys, starts, counts, docs, told))
    sizes = counts + window - 1
    first, place = _alike(buf, starts, sizes, keys, told)
    if not sent:
        return keys[first], sizes[first], docs[:0], buf[:0], place, parts, buf
    least = np.full(len(first), _LAST)
    np.minimum.at(least, place, docs)
    return keys[first], sizes[first], least, _copied(buf, starts[first], sizes[first]), place, parts, buf


def _answer(blobs: list[bytes], window: int, most: int) -> list[bytes]:
    """The least document of every window of every segment of a bucket."""
    parts = [X.split_blobs(raw) for raw in blobs]
    keys, sizes, owners = (np.concatenate([X.unpack_array(p[j]) for p in parts]) for j in range(3))
    sizes = sizes.astype(np.int64)
    buf = np.frombuffer(b"".join(X._expand(p[3]) for p in parts), np.uint8)
    start = np.cumsum(sizes) - sizes
    first, place = _alike(buf, start, sizes, keys, _hashes(buf, start, sizes))
    least = np.full(len(first), _LAST)
    np.minimum.at(least, place, owners)
    size = sizes[first]
    windows = size - window + 1
    found = np.empty(int(windows.sum()), np.int64)
    filled = 0
    # whole keys at a time: windows are shared under one key alone
    bounds = np.flatnonzero(np.diff(keys[first], prepend=np.uint64(0)) != 0)
    upto = np.cumsum(size)
    lo = 0
    while lo < len(first):
        ends = np.append(bounds[bounds > lo], len(first))
        over = np.flatnonzero(upto[ends - 1] - (upto[lo] - size[lo]) > most)
        hi = int(ends[over[0]]) if len(over) else len(first)
        text = _copied(buf, start[first[lo:hi]], size[lo:hi])
        index = RunIndex(text, size[lo:hi], least[lo:hi], window)
        at, _, owner = index.statistics(text, size[lo:hi], own=True)
        inside = _ranges(at, windows[lo:hi])
        found[filled : filled + len(inside)] = owner[inside]
        filled += len(inside)
        lo = hi
    at = np.cumsum(windows) - windows
    out, used = [], 0
    for p in parts:
        n = len(X.unpack_array(p[1]))
        mine = place[used : used + n]
        used += n
        out.append(X.pack_array(found[_ranges(at[mine], windows[mine])]))
    return out


def suffix_dedup(docs: DataFrame, window: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text", group_bytes: int | None = None, index_bytes: int = 1 << 19, hot_docs: int = 500) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts in a document of smaller id.

    Texts are UTF-8 bytes; matches don't cross documents; overlaps count; strings are judged on the
    input. A k-byte string in at least ``hot_docs`` documents is hot (see above): a matter of routing, not of the result. Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of the remaining bytes. Null or empty text: zeros and the hash of nothing. Of rows
    with the same id none is smaller. A null id counts as larger than all others. Other columns are not
    read. An empty table gives an empty result.
    """
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to window")
    n = X.group_count(X.text_bytes(docs, text_col), group_bytes)
    dealt = X.deal(docs, n, id_col, text_col)

    def send(group, level, keys):
        keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        uniq, count = keys[at], np.diff(np.append(at, len(keys)))
        return X.send(group, level, n, uniq, lambda lo, hi: X.join_blobs([X.pack_keys(uniq[lo:hi]), X.pack_array(count[lo:hi].astype(np.uint32))]))

    def first(group, ids, texts):
        return send(group, 0, [_Bytes(part, window, k).first_level() for _, part in K.chunks([t or b"" for t in texts], _BLOCK)])

    shared = X.answers(X.entries(dealt, first), lambda blobs: _spread_keys(blobs, hot_docs))

    def ask(group, ids, texts, got):
        keys, sizes, least, body, *_ = _gather(ids, texts, got, window, k)
        upto = np.append(0, np.cumsum(sizes))
        return X.send(group, 2, n, keys, lambda lo, hi: X.join_blobs([X.pack_array(keys[lo:hi]), X.pack_array(sizes[lo:hi].astype(np.int32)), X.pack_array(least[lo:hi]), X._squeeze(body[upto[lo] : upto[hi]].tobytes())]))

    found = X.answers(X.entries_after(dealt, shared, ask), lambda blobs: _answer(blobs, window, index_bytes))

    def cut(group, ids, texts, got):
        _, sizes, _, _, place, parts, buf = _gather(ids, texts, got, window, k, sent=False)
        windows = sizes - window + 1
        first_of = np.cumsum(windows) - windows
        replies = [X.unpack_array(raw) for level, _, raw in got if level == 2]
        least = np.concatenate(replies) if replies else np.zeros(0, np.int64)
        rows, used = [], 0
        for at, starts, ends, owner, start, count, offset in parts:
            mine = place[used : used + len(start)]
            used += len(start)
            position = _ranges(start, count)
            smallest = least[_ranges(first_of[mine], count)]
            doc = owner[np.searchsorted(starts, position, "right") - 1] if len(position) else np.zeros(0, np.int64)
            mine_buf = buf[offset : offset + int(ends[-1])]
            gone = K.covered(len(mine_buf), position[smallest < doc], window)
            for d, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                mine_ = gone[lo:hi]
                spans = int(mine_[:1].sum() + (mine_[1:] & ~mine_[:-1]).sum())
                rows.append((ids[at + d], hi - lo, int(mine_.sum()), spans, hashlib.sha256(mine_buf[lo:hi][~mine_].tobytes()).hexdigest()))
        return X.table_of(_RESULT, rows)

    return X.entries_after(dealt, shared.unionByName(found), cut, RESULT)
