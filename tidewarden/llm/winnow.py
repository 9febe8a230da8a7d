"""Benchmark decontamination by winnowing. DataFrame operations only.

A text is a sequence of words. Of every run of ``window`` words the least k-gram hash is kept, so a
benchmark window and its copy in a document share a kept fingerprint. Fingerprints are joined,
and hits are extended: the documents they name have all their windows compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import ensure_checkpoint_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of digits, a-z and anything beyond ASCII; null has none."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_remove(F.split(low, _GAP), ""))


def _grams(words: Column, k: int) -> Column:
    """Hash of each run of k words, in order."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _least(grams: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(grams) - width), lambda i: F.least(*[F.get(grams, i + j) for j in range(width)]))


def _fingerprinted(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Rows with their words replaced by n_words and fps, the distinct kept fingerprints (none below window words)."""
    rest = [c for c in rows.columns if c != "words"]
    rows = rows.withColumn("g", F.when(F.size("words") >= window, _grams(F.col("words"), k)))
    fps = F.when(F.col("g").isNotNull(), F.array_distinct(_least(F.col("g"), window - k + 1)))
    return rows.select(*rest, F.size("words").cast("long").alias("n_words"), fps.alias("fps"))


def _windows(rows: DataFrame, n: Column, length: int) -> DataFrame:
    """(row_key, at, gram, n): every run of n words as text."""
    at = F.sequence(F.lit(0), F.size("words") - n)
    spans = F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, length), " ").alias("gram")))
    return rows.where(F.size("words") >= n).select("row_key", F.inline(spans)).withColumn("n", n)


def _sized(side: DataFrame, most: int) -> DataFrame:
    """Broadcast a join side that a count shows to have at most ``most`` rows; else leave the join to Spark."""
    return F.broadcast(side) if side.count() <= most else side


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row per input row.

    A window is ``window`` consecutive words of an item; an item of fewer words (but some) is one
    window. A document word inside any occurrence of a window is hit. n_items counts the distinct
    item ids with an occurring window; items_sha256 is over those ids, sorted as strings and joined
    by commas. Null or empty texts have no words and no hits; null item ids are left out of the lists. Repeated rows
    each get their row. An empty benchmark or table gives no hits or no rows.

    Items of fewer than ``window`` words lie below the winnowing guarantee: for each of the lengths that
    occur (fewer than ``window``) documents' runs of that length are compared in full. Fingerprints, and the
    keys of documents that share one, are broadcast up to ``most_broadcast`` rows by count, windows up to
    a tenth of that; beyond it Spark joins by shuffle. Fingerprints and keys are checkpointed in the shared folder, so
    that texts are split into words once, and once more for the documents that share a fingerprint.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version")).alias("row_key"))
    light = _fingerprinted(rows.select("doc_id", "row_key", words_of(F.col("text")).alias("words")), window, k).checkpoint()
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    spans = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
    # checkpoints also keep filters on exploded arrays from being computed from the texts again, element by element
    items = items.checkpoint()
    grams = items.select("item", n.alias("n"), F.explode(spans).alias("gram"))
    grams = grams.groupBy("gram", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lengths = sorted(r.n for r in grams.where(F.col("n") < window).select("n").distinct().collect())

    asked = _sized(_fingerprinted(items, window, k).checkpoint().select(F.explode("fps").alias("fp")).distinct(), most_broadcast)
    found = light.select("row_key", F.explode("fps").alias("fp")).join(asked, "fp", "left_semi").select(F.col("row_key").alias("found_key")).distinct()
    found = _sized(found.checkpoint(), most_broadcast)
    named = rows.join(found, F.col("row_key") == F.col("found_key"), "left_semi").select("row_key", words_of(F.col("text")).alias("words")).checkpoint()
    hits = _windows(named, F.lit(window), window)
    if lengths:
        every = rows.select("row_key", words_of(F.col("text")).alias("words")).checkpoint()
    for short in lengths:
        hits = hits.unionByName(_windows(every, F.lit(short), short))
    hits = hits.join(_sized(grams, most_broadcast // 10), ["gram", "n"])
    by_doc = hits.groupBy("row_key").agg(F.collect_set(F.struct("at", "n")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit_words = F.size(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    by_doc = by_doc.select(F.col("row_key").alias("hit_key"), hit_words.cast("long").alias("hit"), "items")
    return light.select("doc_id", "row_key", "n_words").join(by_doc, F.col("row_key") == F.col("hit_key"), "left").select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS gram
  FROM b, unnest(range(greatest(len(w) - 10, 0) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
r AS (
  SELECT doc_id, i AS pos, n, array_to_string(w[i + 1 : i + n], ' ') AS gram
  FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) AS u(i)),
h AS (SELECT doc_id, pos, n, item_id FROM r JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(pos, pos + n)) AS u(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(coalesce(d.w, [])) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
