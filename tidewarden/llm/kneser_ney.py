"""Quality classifier: an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

Every group of documents sends its distinct n-grams, with their counts in trusted text, to buckets of the
hash space, which merge them. Merged n-grams then meet in shards by the two bytes before their last one: a shard holds
every longer n-gram together with its contexts and its suffixes, so that adjusted counts, discounts and probabilities
are computed there, order by order. Pairs of bytes and single bytes are one table of fixed size. Log probabilities return
through the buckets to the groups that asked, and quantiles of trusted documents that the model hasn't seen
set the thresholds of each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K

_SHOWN = np.arange(256, dtype=np.uint8)
_SHOWN[0x30:0x3A] = 0x30  # digits count as one symbol
_START, _END = 2, 3
_SYMBOLS = 256.0
_TRUSTED = -5
_SHARDS = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SCORES = "doc_id long, lang string, trusted boolean, held_out boolean, n_bytes long, log10_prob double, perplexity double, worst_word double"
_SCORES = [
    ("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()),
    ("log10_prob", pa.float64()), ("perplexity", pa.float64()), ("worst_word", pa.float64()),
]


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed gram that ends at each byte or at the text's end, document), in text order."""
    pad = bytes([_START]) * (order - 1)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = _SHOWN[np.frombuffer(b"".join(pad + t + bytes([_END]) for t in texts), np.uint8)].astype(np.uint64)
    out = np.zeros(max(len(buf) - order + 1, 0), np.uint64)
    for j in range(order):
        out |= buf[j : j + len(out)] << np.uint64(8 * (order - 1 - j))
    first = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    return out[at], owner


def is_held_out(ids: list, share: int) -> np.ndarray:
    """One trusted id in ``share``, by hash, isn't learned from: it sets the thresholds."""
    return K.mix(np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(share) == 0


def _suffix(g: np.ndarray, k: int) -> np.ndarray:
    return g & np.uint64((1 << 8 * k) - 1)


def _nodes(g: np.ndarray, c: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Grams of a shard and their counts, by order down to 3; below the highest, the number of different bytes seen before them."""
    out = {order: (g, c)}
    for k in range(order - 1, 2, -1):
        g, c = out[k + 1]
        short, place = K.unique_inverse(_suffix(g, k))
        out[k] = short, np.bincount(place, c > 0, minlength=len(short)).astype(np.int64)
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of grams seen 1, 2, 3 and 4 times: Chen and Goodman's estimates, 0.5 1 1.5 where one is missing."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0.0
        out.append(d if 0 < d < i else 0.5 * i)
    return tuple(out)


def _interpolated(g: np.ndarray, c: np.ndarray, d: tuple[float, float, float], q: np.ndarray) -> np.ndarray:
    """Probability of each gram's last byte after the others, q being that after one byte less; all grams seen of a context are there."""
    _, place = K.unique_inverse(g >> np.uint64(8))
    total = np.bincount(place, c)
    back = d[0] * np.bincount(place, c == 1) + d[1] * np.bincount(place, c == 2) + d[2] * np.bincount(place, c > 2)
    cut = np.choose(np.minimum(c, 3), [0.0, *d])
    seen = total[place] > 0
    total = np.maximum(total, 1)[place]
    return np.where(seen, (np.maximum(c - cut, 0) + back[place] * q) / total, q)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def pair_table(pairs: np.ndarray) -> np.ndarray:
    """Probability of the second byte of each of the 65,536 pairs after the first, from the pairs' adjusted counts."""
    single = (pairs.reshape(256, 256) > 0).sum(axis=0)
    p = _interpolated(np.arange(256, dtype=np.uint64), single, discounts(_counts_of_counts(single)), np.full(256, 1 / _SYMBOLS))
    return _interpolated(np.arange(1 << 16, dtype=np.uint64), pairs, discounts(_counts_of_counts(pairs)), np.tile(p, 256))


def shard_statistics(g: np.ndarray, c: np.ndarray, order: int) -> list[tuple[int, int, int]]:
    """(kind, key, n) to sum over shards: kind 3 and above counts the grams of that order seen key times, kind 2 the bytes before pair key."""
    nodes = _nodes(g, c, order)
    out = [(k, i + 1, n) for k, (_, seen) in nodes.items() for i, n in enumerate(_counts_of_counts(seen))]
    short, seen = nodes[3]
    pair, count = K.unique_counts(_suffix(short[seen > 0], 2))
    return out + [(2, int(p), int(n)) for p, n in zip(pair.tolist(), count.tolist(), strict=True)]


def shard_log_probabilities(g: np.ndarray, c: np.ndarray, order: int, cut: dict[int, tuple[float, float, float]], pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each of the ascending grams of a shard."""
    nodes = _nodes(g, c, order)
    p = None
    for k in range(3, order + 1):
        gk, ck = nodes[k]
        q = pairs[_suffix(gk, 2).astype(np.int64)] if p is None else p[np.searchsorted(nodes[k - 1][0], _suffix(gk, k - 1))]
        p = _interpolated(gk, ck, cut[k], q)
    return np.log10(p)


def _shard_of(g: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix((g >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int32)


def _worst_word(surprise: np.ndarray, symbol: np.ndarray, owner: np.ndarray, n: int, least: int = 4) -> np.ndarray:
    """The largest mean surprise of a word of at least ``least`` letters, 0 without any; a word is a run of letters and digits without digits."""
    inside = _LETTER[symbol] | (symbol == 0x30)
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (owner[1:] == owner[:-1]))
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    size = np.bincount(word)
    mean = np.bincount(word, surprise[at]) / np.maximum(size, 1)
    fit = (size >= least) & (np.bincount(word, ~_LETTER[symbol[at]]) == 0)
    out = np.zeros(n)
    np.maximum.at(out, owner[np.flatnonzero(first)][fit], mean[fit])
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 4, group_bytes: int | None = None) -> DataFrame:
    """doc_id, lang, trusted, held_out, n_bytes, log10_prob, perplexity, worst_word: one row per input row (see classify), settled."""
    if order < 3:
        raise ValueError("the order is at least 3")
    n = X.group_count(X.text_bytes(docs, text_col), group_bytes, 8 << 20)
    shards = min(_SHARDS, n)
    # the language rides in front of the text, so that the rows travel once; null ids, which no mark names, are spread by their text
    lang = F.coalesce(F.concat(F.lit("="), F.hex(F.col(lang_col).cast("string"))), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(lang, F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    dealt = X.deal(rows, n, "doc_id", "text", by_id=True)
    marks = trusted.where(F.col(id_col).isNotNull()).select(X.group_of(n, id_col, None).alias("grp"), F.lit(0).alias("bucket"), F.lit(_TRUSTED).alias("level"), F.col(id_col).cast("long").cast("string").cast("binary").alias("blob")).distinct()

    def opened(texts: list[bytes]) -> tuple[list[str | None], list[bytes]]:
        parts = [t.split(b"\0", 1) for t in texts]
        return [bytes.fromhex(p[0][1:].decode()).decode() if p[0] else None for p in parts], [p[1] for p in parts]

    def marked(ids: list, got: list) -> tuple[np.ndarray, np.ndarray]:
        good = {int(raw) for level, _, raw in got if level == _TRUSTED}
        known = np.array([i in good for i in ids], bool)
        return known, known & is_held_out(ids, held_out)

    def distinct(bodies: list[bytes]) -> np.ndarray:
        """Ascending distinct grams of the texts."""
        parts = [K.unique_counts(grams(part, order)[0])[0] for _, part in K.chunks(bodies, 1 << 20)]
        return K.unique_counts(np.concatenate(parts))[0] if parts else np.zeros(0, np.uint64)

    def ask(group, ids, texts, got):
        if not ids:
            return X.table_of(X._ENTRY, [])
        known, out = marked(ids, got)
        bodies = opened(texts)[1]
        g = distinct(bodies)
        count = np.zeros(len(g), np.int64)
        for _, part in K.chunks([b for b, use in zip(bodies, known & ~out, strict=True) if use], 1 << 20):
            mine, c = K.unique_counts(grams(part, order)[0])
            count[np.searchsorted(g, mine)] += c
        mixed = K.mix(g)
        by = K.sort_order(mixed)
        keys, count = mixed[by], count[by]
        return X.send(group, 0, n, keys, lambda lo, hi: X.join_blobs([X.pack_keys(keys[lo:hi]), X.pack_array(count[lo:hi].astype(np.uint32))]))

    def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(distinct keys of a bucket, their counts, the places of each blob's keys, the places of each shard's grams in order)."""
        parts = [X.split_blobs(raw) for raw in blobs]
        keys = [X.unpack_keys(k) for k, _ in parts]
        uniq, place = K.unique_inverse(np.concatenate(keys))
        count = np.bincount(place, np.concatenate([X.unpack_array(c) for _, c in parts]).astype(np.float64)).astype(np.int64)
        g = K.unmix(uniq)
        shard = _shard_of(g, shards)
        by = np.lexsort((g, shard))
        return g, count, np.split(place, np.cumsum([len(k) for k in keys])[:-1]), np.split(by, np.searchsorted(shard[by], np.arange(1, shards)))

    def merge(table):
        g, count, _, by_shard = merged(table.column("blob").to_pylist())
        bucket = table.column("bucket")[0].as_py()
        rows = [(s, bucket, 0, X.join_blobs([X.pack_keys(g[at]), X.pack_array(count[at].astype(np.uint32))])) for s, at in enumerate(by_shard) if len(at)]
        return X.table_of(X._REPLY, rows)  # grp stands for the shard

    def shard(table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
        """(buckets, the places of each one's grams, grams in order, counts)."""
        parts = [X.split_blobs(raw) for raw in table.column("blob").to_pylist()]
        keys = [X.unpack_keys(k) for k, _ in parts]
        g, place = K.unique_inverse(np.concatenate(keys))
        c = np.empty(len(g), np.int64)
        c[place] = np.concatenate([X.unpack_array(x) for _, x in parts])
        return table.column("bucket").to_pylist(), np.split(place, np.cumsum([len(k) for k in keys])[:-1]), g, c

    def statistics(table):
        _, _, g, c = shard(table)
        return X.table_of([("kind", pa.int32()), ("key", pa.int32()), ("n", pa.int64())], shard_statistics(g, c, order))

    sent, _ = X.settle(X.entries_after(dealt, marks, ask), each=1)  # few rows, each of them large
    mid, _ = X.settle(sent.groupBy("bucket").applyInArrow(merge, X.REPLIES), each=1)
    pairs, of_order = np.zeros(1 << 16, np.int64), {k: [0] * 4 for k in range(3, order + 1)}
    with X.tidy(docs.sparkSession):
        # at most 65,536 pairs and four counts an order
        for r in mid.groupBy("grp").applyInArrow(statistics, "kind int, key int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
            if r.kind == 2:
                pairs[r.key] = r.n
            else:
                of_order[r.kind][r.key - 1] = r.n
    cut, table_of_pairs = {k: discounts(n_) for k, n_ in of_order.items()}, pair_table(pairs)

    def answer(table):
        buckets, places, g, c = shard(table)
        logp = shard_log_probabilities(g, c, order, cut, table_of_pairs).astype(np.float32)
        return X.table_of(X._REPLY, [(b, table.column("grp")[0].as_py(), 0, X.pack_array(logp[at])) for b, at in zip(buckets, places, strict=True)])  # to grp: the bucket, from bucket: the shard

    def reply(key, asked, known):
        blobs = asked.column("blob").to_pylist()
        g, _, places, by_shard = merged(blobs)
        logp = np.empty(len(g), np.float32)
        for s, raw in zip(known.column("bucket").to_pylist(), known.column("blob").to_pylist(), strict=True):
            logp[by_shard[s]] = X.unpack_array(raw)
        return X.table_of(X._REPLY, [(grp, key[0].as_py(), 0, X.pack_array(logp[at])) for grp, at in zip(asked.column("grp").to_pylist(), places, strict=True)])

    def finish(group, ids, texts, got):
        if not ids:
            return X.table_of(_SCORES, [])
        known, out = marked(ids, got)
        langs, bodies = opened(texts)
        g = distinct(bodies)
        logp = np.empty(len(g))
        logp[K.sort_order(K.mix(g))] = np.concatenate([X.unpack_array(raw) for level, _, raw in got if level == 0])
        rows = []
        for at, part in K.chunks(bodies, 1 << 20):
            mine, owner = grams(part, order)
            uniq, place = K.unique_inverse(mine)
            per = logp[np.searchsorted(g, uniq)][place]
            total, size = np.bincount(owner, per, minlength=len(part)), np.bincount(owner, minlength=len(part))
            worst = _worst_word(-per, (mine & np.uint64(255)).astype(np.uint8), owner, len(part))
            for d, (s, m, w) in enumerate(zip(total.tolist(), size.tolist(), worst.tolist(), strict=True)):
                rows.append((ids[at + d], langs[at + d], bool(known[at + d]), bool(out[at + d]), m - 1, s, 10.0 ** (-s / m), w))
        return X.table_of(_SCORES, rows)

    replies = sent.groupBy("bucket").cogroup(mid.groupBy("grp").applyInArrow(answer, X.REPLIES).groupBy("grp")).applyInArrow(reply, X.REPLIES)
    return X.settle(X.entries_after(dealt, replies.unionByName(marks), finish, SCORES))[0]


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    order: int = 5,
    quantile: float = 0.99,
    margin: float = 1.05,
    word_margin: float = 1.1,
    least_bytes: int = 100,
    **options,
) -> DataFrame:
    """doc_id, lang, trusted, held_out, n_bytes, log10_prob, perplexity, worst_word, threshold, word_threshold, kept: one row per input row.

    trusted: the ids of good documents. One in ``held_out`` (4) of them, by hash, isn't learned from; all text of the others is counted.
    perplexity is per byte, the text's end included; digits count as one symbol. worst_word is the largest mean surprise (log10, per byte) of a
    word of four letters or more: unlike the mean, it doesn't fade in a long text. A document is kept if its perplexity is at most
    ``margin`` times, and its worst word at most ``word_margin`` times, the ``quantile`` of the held-out trusted documents of its
    language; these have at least ``least_bytes`` bytes. A language without any takes the quantiles over all languages, and with none at all
    everything is kept. Texts of fewer than ``least_bytes`` bytes are judged by their words alone; null and empty texts have none and are kept.
    A language may be null or any string. Repeated rows count each. An id that is null is never trusted.
    The scores (a few numbers a document) are checkpointed in the shared folder, so texts are read once.
    """
    scored = perplexities(docs, trusted, order, **options)
    known = scored.where(F.col("held_out") & (F.col("n_bytes") >= least_bytes))
    at = [F.percentile(c, F.lit(quantile)) for c in ("perplexity", "worst_word")]
    by_lang = X.settle(known.where(F.col("lang").isNotNull()).groupBy("lang").agg(at[0].alias("own"), at[1].alias("own_word")))
    with X.tidy(docs.sparkSession):
        overall = known.agg(at[0].alias("any"), at[1].alias("any_word")).first()
    limit, word_limit = (F.coalesce(own, F.lit(None if x is None else float(x)).cast("double")) * m for own, x, m in (("own", overall["any"], margin), ("own_word", overall["any_word"], word_margin)))
    fits = ((F.col("n_bytes") < least_bytes) | (F.col("perplexity") <= limit)) & (F.col("worst_word") <= word_limit)
    return scored.join(X.sized(by_lang), "lang", "left").select(
        "doc_id", "lang", "trusted", "held_out", "n_bytes", "log10_prob", "perplexity", "worst_word",
        limit.alias("threshold"), word_limit.alias("word_threshold"), F.coalesce(fits, F.lit(True)).alias("kept"),
    )
