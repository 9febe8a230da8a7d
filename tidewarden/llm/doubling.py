"""Substring dedup by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length, until the wanted length
is reached or no candidate survives. Below the wanted length a window stands for its smallest
sub-window (by hash): two equal windows have the same one, so nothing is lost and a fraction of the
positions is sent. At the wanted length each candidate window is decided on two 64-bit hashes of separately hashed words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]


def levels(window: int, first: int = 9) -> list[int]:
    """first, twice first, ... and at last window."""
    out = []
    length = min(first, window)
    while length < window:
        out.append(length)
        length *= 2
    return [*out, window]


class _Words:
    """The words of a chunk, and the windows among them."""

    def __init__(self, texts: list[bytes], window: int):
        self.chunk = K.Chunk.of(texts)
        self.start, self.end, self.owner = self.chunk.words()
        self.window = window
        self.hash = self.chunk.word_hash(self.start, self.end)
        self.valid = K.same_owner(self.owner, window)

    def least(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of length, and for each full window the least one inside it."""
        grams = K.windows_hash(self.hash, length, 1)
        return grams, K.sliding(grams, self.window - length + 1, np.minimum)

    def chosen(self, length: int, candidate: np.ndarray) -> np.ndarray:
        """Keys, with repeats, at the positions that stand for some candidate window (mixed: least hashes are small ones)."""
        grams, least = self.least(length)
        width = self.window - length + 1
        reach = np.zeros(len(grams) + width - 1, np.uint64)
        reach[width - 1 : width - 1 + len(least)] = np.where(candidate, least, np.uint64(0))
        return K.mix(grams[K.sliding(reach, width, np.maximum) == grams]) if len(least) else grams[:0]

    def repeats(self, length: int, known: np.ndarray) -> np.ndarray:
        """Full windows whose stand-in of this length is among the known repeats."""
        if not len(self.valid):
            return self.valid
        return self.valid & K.contains(known, K.mix(self.least(length)[1]))

    def final(self, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidate positions and their windows' two hashes."""
        at = np.flatnonzero(candidate)
        one = K.windows_hash(self.hash, self.window, 1)[at]
        other = K.spans_hash(K.prefix(K.mix(self.chunk.byte_values()), 3), self.start, self.end, 3)  # words are hashed anew, by other values and powers
        two = K.windows_hash(other, self.window, 2)[at]
        return at, one, two


def _flag(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, count = K.unique_counts(keys)
    return uniq, count > 1


def _pairs(texts: list[bytes], window: int, last: int, known: np.ndarray | None):
    """All candidate windows of a group: (chunk's first index, words, positions, hash, hash)."""
    for at, part in K.chunks(texts):
        w = _Words(part, window)
        yield at, w, *w.final(w.valid if known is None else w.repeats(last, known))


def _unique_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, whether each occurs twice, and the place of each input pair."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.cumsum(new) - 1
    place = np.empty(len(a), np.int64)
    place[order] = rank
    count = np.bincount(rank, minlength=int(new.sum()))
    return a[new], b[new], count > 1, place


def _answer_pairs(blobs: list[bytes]) -> list[bytes]:
    parts = []
    for raw in blobs:
        a, b, f = X.split_blobs(raw)
        one = X.unpack_keys(a)
        parts.append((one, X.unpack_array(b), np.unpackbits(np.frombuffer(f, np.uint8))[: len(one)].astype(bool)))
    _, _, twice, place = _unique_pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    flagged = np.zeros(len(twice), bool)
    flagged[place[np.concatenate([p[2] for p in parts])]] = True
    twice |= flagged
    out, at = [], 0
    for one, _, _ in parts:
        out.append(np.packbits(twice[place[at : at + len(one)]]).tobytes())
        at += len(one)
    return out


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", first: int = 9, group_bytes: int | None = None) -> DataFrame:
    """Remove every word covered by a ``window``-word run whose word sequence starts anywhere else.

    Words are maximal runs of bytes other than ASCII white space. Returns one row per input row:
    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and kept_text: those
    joined words, or the text as it was where nothing is removed.
    Null or empty text: no words, nothing removed, the hash of the empty string. Rows that repeat
    count as copies of each other, so both lose every full window. A null id stays null; other
    columns are not read. An empty table gives an empty result.
    """
    steps = levels(window, first)
    n = X.group_count(X.text_bytes(docs, text_col), group_bytes)
    dealt = X.deal(docs, n, id_col, text_col)
    replies = None
    for k, length in enumerate(steps[:-1]):

        def make(group, ids, texts, got=(), k=k, length=length):
            known = X.reply_keys(got, k - 1)
            keys = []
            for _, part in K.chunks([t or b"" for t in texts]):
                w = _Words(part, window)
                keys.append(w.chosen(length, w.repeats(steps[k - 1], known) if k else w.valid))
            uniq, twice = _flag(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
            return X.send(group, k, n, uniq, lambda lo, hi: X.pack_flagged(uniq[lo:hi], twice[lo:hi]))

        sent = X.entries(dealt, make) if k == 0 else X.entries_after(dealt, replies, make)
        replies = X.answers(sent, X.repeated_keys)
    last = steps[-2] if len(steps) > 1 else window
    top = len(steps) - 1

    def gather(texts, got):
        known = X.reply_keys(got, top - 1) if top else None
        parts = list(_pairs([t or b"" for t in texts], window, last, known))
        one = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.uint64)
        two = np.concatenate([p[4] for p in parts]) if parts else one
        return parts, *_unique_pairs(one, two)

    def ask(group, ids, texts, got=()):
        _, one, two, twice, _ = gather(texts, got)
        return X.send(group, top, n, one, lambda lo, hi: X.join_blobs([X.pack_keys(one[lo:hi]), X.pack_array(two[lo:hi]), np.packbits(twice[lo:hi]).tobytes()]))

    sent = X.entries_after(dealt, replies, ask) if top else X.entries(dealt, ask)
    verdicts = X.answers(sent, _answer_pairs)
    everything = verdicts if replies is None else replies.unionByName(verdicts)

    def cut(group, ids, texts, got):
        parts, one, _, _, place = gather(texts, got)
        bounds = X.bucket_bounds(one, n)
        many = np.zeros(len(one), bool)
        for level, bucket, raw in got:
            if level == top:
                lo, hi = bounds[bucket], bounds[bucket + 1]
                many[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8))[: hi - lo]
        rows, used = [], 0
        for at, w, positions, _, _ in parts:
            hit = positions[many[place[used : used + len(positions)]]]
            used += len(positions)
            gone = K.covered(len(w.start), hit, window)
            first_word = np.searchsorted(w.owner, np.arange(len(w.chunk.start) + 1))
            buf = w.chunk.buf.tobytes()
            for d, (lo, hi) in enumerate(zip(first_word, first_word[1:], strict=False)):
                keep = lo + np.flatnonzero(~gone[lo:hi])
                text = b" ".join([buf[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                shown = text if len(keep) < hi - lo else texts[at + d] or b""
                rows.append((ids[at + d], int(hi - lo), int(hi - lo - len(keep)), hashlib.sha256(text).hexdigest(), shown.decode("utf-8", "replace")))
        return X.table_of(_RESULT, rows)

    return X.entries_after(dealt, everything, cut, RESULT)
