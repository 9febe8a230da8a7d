"""MinHash near-dedup with DartMinHash signatures.

Darts fall on the plane of (weight, rank) of every element, at places that the element's hash alone
decides. A document throws the darts below its own rank bound into the regions its elements' weights
span, and every coordinate of the signature keeps its earliest dart: a few darts an element instead of
one hash for each element and coordinate. Equal coordinates have the probability of the weighted
Jaccard similarity.

Signatures are joined by bands. In a band's bucket every document is paired with one centre, never with
all others; pairs are confirmed on whole shingle sets. Buckets that still hold several classes get further
pairs, and what then still stands apart is finished exactly: every pair across classes in small buckets, and in large
ones every pair that passes the size, prefix and position filters of the shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .exchange import ensure_checkpoint_dir, pack_array, settle, sized, tidy, unpack_array

_SEED_COUNT, _SEED_DART = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_SLOTS, _PARTS = 1 << 22, 64  # slots of the shingle frequencies that order prefixes, and the rows they travel in
_FINEST = 5  # the lowest cell of the rank axis is [0, 2**-5)


def _cell_end(bound: np.ndarray) -> np.ndarray:
    """End of the cell that holds bound: powers of two below 1 (the lowest cell is undivided), whole numbers above."""
    low = np.exp2(np.maximum(np.ceil(np.log2(np.maximum(bound, 2.0**-60))), -_FINEST))
    return np.where(bound <= 1, low, np.ceil(bound))


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion."""
    term = total = math.exp(-mean)
    out = np.zeros(len(u), np.int64)
    for k in range(1, 60):
        more = u > total
        if not more.any():
            break
        out += more
        term *= mean / k
        total += term
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, unit: np.ndarray, lo: np.ndarray, width: float, k: int):
    """(document, coordinate, rank, dart id) of the darts in the cell [lo, lo + width) of each (element, weight unit)."""
    base = K.mix(element + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + K.mix(lo.view(np.uint64)))
    count = _poisson(_unit(K.mix(base ^ _SEED_COUNT)), width)
    at = np.repeat(np.arange(len(doc)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = K.mix(base[at] ^ _SEED_DART ^ K.mix(nth.astype(np.uint64) + np.uint64(1)))
    inside = unit[at] + _unit(K.mix(dart + np.uint64(1))) <= weight[at]
    at, dart = at[inside], dart[inside]
    rank = lo[at] + width * _unit(K.mix(dart + np.uint64(2)))
    coordinate = (K.mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
    return doc[at], coordinate, rank, dart


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k matrix of the earliest darts' ids for documents given as (document, element hash, weight) rows.

    A document without elements has a row of zeros, as the only one. Rank bounds: about
    k (ln k + 2) darts over the document's whole weight, doubled while a coordinate is empty.
    """
    total = np.bincount(doc, weight, minlength=n)
    out = np.zeros((n, k), np.uint64)
    best = np.full((n, k), np.inf)
    darts = k * (math.log(k) + 2)
    bound = np.divide(darts, total, out=np.zeros(n), where=total > 0)
    units = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    doc, element, weight = doc[at], element[at], weight[at]
    done = np.zeros(n)  # cells below this rank are thrown
    need = total > 0

    def keep(rows: np.ndarray, lo: np.ndarray, width: float) -> None:
        d, c, r, dart = _throw(doc[rows], element[rows], weight[rows], unit[rows], lo, width, k)
        order = np.lexsort((dart, r, d * k + c))
        d, c, r, dart = d[order], c[order], r[order], dart[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
        d, c, r, dart = d[first], c[first], r[first], dart[first]
        better = r < best[d, c]
        best[d[better], c[better]] = r[better]
        out[d[better], c[better]] = dart[better] | np.uint64(1)

    while need.any():
        end = np.where(need, _cell_end(bound), done)
        for lo, width in [(0.0, 2.0**-_FINEST)] + [(2.0**-e, 2.0**-e) for e in range(_FINEST, 0, -1)]:
            rows = np.flatnonzero((done[doc] <= lo) & (end[doc] > lo))
            if len(rows):
                keep(rows, np.full(len(rows), lo), width)
        from_ = np.maximum(done, 1.0)
        cells = np.maximum(end - from_, 0).astype(np.int64)[doc]
        rows = np.repeat(np.arange(len(doc)), cells)
        if len(rows):
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(cells) - cells, cells)
            keep(rows, from_[doc[rows]] + nth, 1.0)
        done = end
        need = need & np.isinf(best).any(axis=1)
        bound = np.where(need, 2 * done, bound)
    return out


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash, count) of runs of size words; a shorter text with words is one shingle."""
    c = K.Chunk.of(texts)
    start, end, owner = c.words()
    h = c.word_hash(start, end)
    inside = np.flatnonzero(K.same_owner(owner, size))
    doc, key = owner[inside], K.windows_hash(h, size, 1)[inside] if len(inside) else np.zeros(0, np.uint64)
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        pre = K.prefix(h, 1)
        doc = np.concatenate([doc, short])
        key = np.concatenate([key, K.spans_hash(pre, first[short], first[short] + n_words[short], 1)])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))


def _bands(sig: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        for j in range(per_band):
            keys[:, b] = K.mix(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * per_band + j])
    return keys


def band_keys(rows: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    """(id, n, m, keys) of every row (id, text) that has words: the number of distinct shingles, of all, and a key for each band.

    Shingles weigh as often as they occur. A text that repeats some has the keys of its unweighted signature as well.
    """
    k = bands * per_band

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in K.chunks(texts, 1 << 16):
                doc, key, count = shingles(part, size)
                n, m = np.bincount(doc, minlength=len(part)), np.bincount(doc, count, minlength=len(part)).astype(np.int64)
                keys = _bands(signatures(doc, key, count.astype(np.float64), len(part), k), bands, per_band)
                full, twice = np.flatnonzero(n), np.flatnonzero(m > n)
                plain = keys[:0]
                if len(twice):
                    mine = m[doc] > n[doc]
                    plain = _bands(signatures(np.searchsorted(twice, doc[mine]), key[mine], np.ones(int(mine.sum())), len(twice), k), bands, per_band)
                flat = np.concatenate([keys[full], plain])
                who = np.concatenate([full, twice])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * bands), pa.array(flat.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + i] for i in who.tolist()], pa.int64()), pa.array(n[who]), pa.array(m[who]), listed], ["id", "n", "m", "keys"])

    return rows.mapInArrow(run, "id long, n long, m long, keys array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, m, shingles, again): packed hashes (48 bits, compared within pairs only) of the distinct shingles, and of their further occurrences."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in K.chunks(texts):
                doc, key, count = shingles(part, size)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                out: list[list] = [[], [], [], []]
                for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
                    more = np.repeat(np.arange(lo, hi), count[lo:hi] - 1)
                    nth = np.arange(len(more)) - np.repeat(np.cumsum(count[lo:hi] - 1) - (count[lo:hi] - 1), count[lo:hi] - 1)
                    again = np.sort(K.mix(key[more] + nth.astype(np.uint64) + np.uint64(1)) >> np.uint64(16))
                    for column, value in zip(out, (hi - lo, hi - lo + len(more), pack_array(key[lo:hi] >> np.uint64(16)), pack_array(again) if len(again) else None), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(part)], pa.int64()), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["id", "n", "m", "shingles", "again"])

    return rows.mapInArrow(run, "id long, n long, m long, shingles binary, again binary")


def _fits(least: float, n: Column, n2: Column, m: Column, m2: Column) -> Column:
    """Whether sets of n and n2 distinct shingles, or of m and m2 occurrences, can be as similar as ``least``."""
    return (F.least(n, n2) >= F.lit(least) * F.greatest(n, n2)) | (F.least(m, m2) >= F.lit(least) * F.greatest(m, m2))


def _confirm(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingles have a Jaccard similarity of at least ``least``, as sets or counted as often as they occur."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("again").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("again").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "ta", "tb")

    def run(batches):
        last, have = None, None
        none = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for sa, sb, ta, tb in zip(*(batch.column(j).to_pylist() for j in (2, 3, 4, 5)), strict=True):
                if sa != last:
                    last, have = sa, unpack_array(sa)
                other = unpack_array(sb)
                common = len(np.intersect1d(have, other, assume_unique=True))
                total = len(have) + len(other)
                near = common >= least * (total - common)
                if not near and (ta or tb):
                    x, y = unpack_array(ta) if ta else none, unpack_array(tb) if tb else none
                    common, total = common + len(np.intersect1d(x, y, assume_unique=True)), total + len(x) + len(y)
                    near = common >= least * (total - common)
                keep.append(near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) with the least id of every connected component; nodes (id, root) start as they are.

    Roots hook onto the least root across an edge, then jump to their root's root; edges between the new roots
    are left for the next round, until there are none. The driver sees counts alone.
    """
    at = nodes.select(F.col("id").alias("a"), F.col("root").alias("ra")), nodes.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    cross = edges.join(at[0], "a").join(at[1], "b")
    while True:
        cross = cross.where("ra <> rb").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to")).distinct()
        cross, n = settle(cross)
        if not n:
            return nodes
        hook, n_hooks = settle(cross.groupBy("root").agg(F.min("to").alias("to")))
        while True:  # chains of hooks are followed to their end
            next_ = sized((hook.select(F.col("root").alias("to"), F.col("to").alias("next")), n_hooks))
            moved, _ = settle(hook.join(next_, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hook = moved.select("root", "to")
            if moved.where("moved").isEmpty():
                break
        new = sized((hook, n_hooks))
        nodes, _ = settle(nodes.join(new, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        x, y = (sized((hook.select(F.col("root").alias(old), F.col("to").alias(r)), n_hooks)) for old, r in (("root", "ra"), ("to", "rb")))
        cross = cross.join(x, "root", "left").join(y, "to", "left").select(F.coalesce("ra", "root").alias("ra"), F.coalesce("rb", "to").alias("rb"))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often, up to 255 times, the shingles of each slot of the hash space occur in ``sets``: a table of fixed size, summed before it is collected."""
    each = _SLOTS // _PARTS

    def count(batches):
        total = np.zeros(_SLOTS, np.int32)
        for batch in batches:
            for raw in batch.column(0).to_pylist() + batch.column(1).to_pylist():
                if raw:
                    np.add.at(total, (unpack_array(raw) % np.uint64(_SLOTS)).astype(np.int64), 1)
        if total.any():
            blobs = [pack_array(np.minimum(total[k * each : (k + 1) * each], 255).astype(np.uint8)) for k in range(_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def add(table):
        total = np.zeros(each, np.int32)
        for raw in table.column("blob").to_pylist():
            total += unpack_array(raw)
        return pa.table({"part": table.column("part").slice(0, 1), "blob": pa.array([pack_array(np.minimum(total, 255).astype(np.uint8))], pa.binary())})

    out = np.zeros(_SLOTS, np.uint8)
    with tidy(sets.sparkSession):
        for r in sets.select("shingles", "again").mapInArrow(count, "part int, blob binary").groupBy("part").applyInArrow(add, "part int, blob binary").collect():
            out[r.part * each : (r.part + 1) * each] = unpack_array(bytes(r.blob))
    return out


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(token, id, root, n, pos): the rarest shingles of each set, so many that two sets of similarity ``least`` share one.

    A text that repeats shingles has a prefix of its distinct shingles and one of all their occurrences. A shingle that is alone in its slot is
    in one text only: it counts for places, but needn't meet anything.
    """
    often = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches):
        table = often.value
        for batch in batches:
            ids, roots = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(2))
            for i, (raw, more) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                plain = unpack_array(raw)
                for key in [plain, np.concatenate([plain, unpack_array(more)])] if more else [plain]:
                    n = len(key)
                    most = n - math.ceil(least * n - 1e-9) + 1
                    times = table[(key % np.uint64(_SLOTS)).astype(np.int64)]
                    order = np.lexsort((key, times))[:most]
                    pos = np.flatnonzero(times[order] > 1)
                    key, m = key[order[pos]], len(pos)
                    columns = [key.astype(np.int64), np.full(m, ids[i]), np.full(m, roots[i]), np.full(m, n), pos]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "id", "root", "n", "pos"])

    return sets.select("id", "root", "shingles", "again").mapInArrow(run, "token long, id long, root long, n long, pos long")


def _open_pairs(texts: DataFrame, sets: DataFrame, least: float, each: int = 4096) -> DataFrame:
    """All pairs (a, b) of different classes that can reach ``least`` among texts (id, root).

    Texts meet at the shingles of their prefixes. Of a shingle's texts, those outside its largest class meet all; the
    pairs inside a class that this passes over are never more than those across classes. ``each`` texts of a shingle are one key of the join.
    """
    post, _ = settle(_prefixes(settle(sets.join(texts, "id"), 20_000)[0], least))
    per_class = post.groupBy("token", "root").agg(F.count("*").alias("k"))
    several = per_class.groupBy("token").agg(F.count("*").alias("classes"), F.sum("k").alias("size"), F.max(F.struct("k", "root")).alias("most")).where("classes > 1")
    post, _ = settle(post.join(several.select("token", F.col("most.root").alias("main"), F.ceil(F.col("size") / each).cast("int").alias("salts")), "token"))
    left = post.where("root <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = left.select("token", "salt", *[F.col(c).alias(f"l_{c}") for c in ("id", "root", "n", "pos")])
    right = post.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    near = left.join(right, ["token", "salt"]).where(
        (F.col("l_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("l_id") < F.col("id")))
        & (F.least("l_n", "n") + 1e-9 >= F.lit(least) * F.greatest("l_n", "n"))
        & (F.least(F.col("l_n") - F.col("l_pos"), F.col("n") - F.col("pos")) + 1e-9 >= F.lit(least / (1 + least)) * (F.col("l_n") + F.col("n")))
    )
    return near.select(F.least("l_id", "id").alias("a"), F.greatest("l_id", "id").alias("b")).distinct()


def _open_buckets(member: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(band, key, id, n, m, root, size) of the buckets that hold several classes."""
    classes = member.join(nodes, "id")
    buckets = classes.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key", "size")
    return settle(classes.join(sized(settle(buckets)), ["band", "key"]))


def _classes_of_large(left_open: DataFrame, turn: int, small: int) -> tuple[DataFrame, int]:
    """(band, key, root, k, pick): the classes of the open buckets above ``small`` texts, their sizes, and a member that the turn picks."""
    pick = F.min_by(F.struct("id", "n", "m"), F.xxhash64("band", "id", F.lit(turn))).alias("pick")
    return settle(left_open.where(F.col("size") > small).groupBy("band", "key", "root").agg(F.count("*").alias("k"), pick))


def _draw(left_open: DataFrame, per_class: DataFrame, turn: int, least: float, draws: int = 4) -> DataFrame:
    """Pairs (a, b) that are likely to join classes: texts outside their bucket's largest class meet a picked member of it and of the second largest."""
    most = per_class.groupBy("band", "key").agg(F.max(F.struct("k", "root", "pick")).alias("most"))
    second = per_class.join(most, ["band", "key"]).where("root <> most.root").groupBy("band", "key", "most").agg(F.max(F.struct("k", "root", "pick")).alias("second"))
    outside = left_open.join(sized(settle(second)), ["band", "key"]).where("root <> most.root")
    order = Window.partitionBy("id").orderBy(F.xxhash64("band", "key", F.lit(turn)))
    outside = outside.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= draws)
    pairs = outside.select("id", "n", "m", F.explode(F.array(F.col("most.pick"), F.when(F.col("second.root") != F.col("root"), F.col("second.pick")))).alias("o"))
    pairs = pairs.where(_fits(least, F.col("n"), F.col("o.n"), F.col("m"), F.col("o.m")))
    return pairs.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    bands: int = 24,
    per_band: int = 5,
    small: int = 32,
) -> DataFrame:
    """doc_id, class_id (the least id of its class), class_size: one row per input row.

    Two texts are linked if the Jaccard similarity of their ``size``-word shingles is at least ``similarity``, weighed by how often
    each occurs or as sets of distinct ones; classes are the connected components. Words are runs of bytes other than ASCII white
    space; a text of fewer words is one shingle. Signatures weigh shingles by their counts; texts that repeat shingles have an
    unweighted signature too, so that both similarities find their pairs.
    Equal texts are one class from the start and travel as one representative. Null texts and texts without words are
    classes of their own row's id. A null id has a null class and links to nothing. Rows that share an
    id share its class, and so join the classes of all their texts. Other columns are not read; an empty table gives an empty result.

    In a bucket every text is first tested against one centre, another one in every bucket. While a turn still joins many classes of large buckets, texts
    outside a bucket's largest class meet changing members of it and of the second largest. Then the rest is finished
    exactly: all pairs across classes in buckets of up to ``small`` texts, and in larger ones all pairs across classes that the size, prefix
    and position filters of their shingle sets allow; so every link between texts that share a bucket is kept.
    With 24 bands of 5, a pair at similarity 0.8 shares a bucket with probability 0.99993.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = rows.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", F.col("text").cast("binary").alias("text"))
    # copies: the least id of each distinct text stands for all
    copies, _ = settle(full.select("id", F.sha2("text", 256).alias("digest")))
    heads, _ = settle(copies.join(copies.groupBy("digest").agg(F.min("id").alias("head")), "digest").select("id", "head").distinct())
    chosen = heads.where("id = head").select("id").distinct()
    keyed = band_keys(full, size, bands, per_band).join(chosen, "id", "left_semi")
    member, _ = settle(keyed.select("id", "n", "m", F.posexplode("keys").alias("band", "key")).distinct())
    centre = F.min_by(F.struct("id", "n", "m"), F.xxhash64("band", "id")).alias("centre")
    shared = member.groupBy("band", "key").agg(centre, F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("first", "last")
    member, _ = settle(member.join(shared, ["band", "key"]))
    involved = settle(member.select("id").distinct())
    sets, _ = settle(shingle_sets(full.join(sized(involved), "id", "left_semi"), size), 20_000)
    nodes = involved[0].select("id", F.col("id").alias("root"))
    pairs = member.where((F.col("id") != F.col("centre.id")) & _fits(similarity, F.col("n"), F.col("centre.n"), F.col("m"), F.col("centre.m")))
    pairs = pairs.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()
    member = member.drop("centre")

    def join_classes(pairs: DataFrame) -> int:
        nonlocal nodes
        links, n = settle(_confirm(settle(pairs)[0], sets, similarity))
        if n:
            nodes = components(nodes, links)
        return n

    join_classes(pairs)
    left_open, n_open = _open_buckets(member, nodes)
    turn, before = 0, None
    while n_open:
        per_class, n = _classes_of_large(left_open, turn, small)
        if not n or (before and n > 0.8 * before) or not join_classes(_draw(left_open, per_class, turn, similarity)):
            break
        turn, before = turn + 1, n
        left_open, n_open = _open_buckets(member, nodes)
    if n_open:
        few = left_open.where(F.col("size") <= small)
        other = few.select("band", "key", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "m", "root")])
        pairs = few.join(other, ["band", "key"]).where((F.col("id") < F.col("o_id")) & (F.col("root") != F.col("o_root")) & _fits(similarity, F.col("n"), F.col("o_n"), F.col("m"), F.col("o_m")))
        pairs = pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b"))
        large = settle(left_open.where(F.col("size") > small).select("id", "root").distinct())
        if large[1]:
            pairs = pairs.unionByName(_open_pairs(sized(large), sets, similarity))
        join_classes(pairs.distinct())
    by_id = heads.join(nodes.select(F.col("id").alias("head"), "root"), "head", "left").select("id", F.coalesce("root", "head").alias("class_id"))
    # an id whose rows have texts of several classes joins them
    several = by_id.groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("last")).where("a < last").select("id", "a")
    joint, n_joint = settle(by_id.join(several, "id").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct())
    if n_joint:
        classes = joint.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        merged = components(classes.select("id", F.col("id").alias("root")), joint).withColumnRenamed("id", "class_id")
        by_id = by_id.join(merged, "class_id", "left").select("id", F.coalesce("root", "class_id").alias("class_id"))
    by_id = by_id.groupBy("id").agg(F.min("class_id").alias("class_id"))
    out = rows.select("id").join(by_id, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return out.join(sizes, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
