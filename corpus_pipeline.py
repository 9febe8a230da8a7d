"""A training-corpus pipeline over ``documents``: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. run() writes every stage's rows as Parquet in the cluster's shared folder and reads
them again, so a lost executor costs at most the stage at hand.

Ids may be null, repeated or shared by different texts: inside a stage rows go by a key of their own, a hash of all
their columns, and only rows equal in every column share one. Documents that lose all their words to substring dedup leave there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import dartminhash, doubling, exchange, fertility, packing, winnow

#: Beyond so many rows, keys are joined by shuffle instead of a broadcast.
MOST_BROADCAST = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a 64-bit key of each row's content, under a name that they don't have; nulls count, as the hash itself skips them, and maps by their JSON."""
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    value = {c: F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in docs.dtypes}
    return docs.withColumn(key, F.xxhash64(*[x for c in docs.columns for x in (value[c], F.col(c).isNull())])), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the rules and bands of op 10."""
    rows, key = _keyed(docs)
    judged = fertility.quality_rules(rows, fertility.default_model(), id_col=key)
    bad = exchange.settle(judged.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct())
    return rows.join(exchange.sized(bad, MOST_BROADCAST), key, "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class of op 6: that of least id (a null id comes last), then of least key."""
    rows, key = _keyed(docs)
    classes = dartminhash.near_duplicates(rows, key).where("class_size > 1").select(F.col("doc_id").alias(key), "class_id")
    members, _ = exchange.settle(classes.groupBy(key, "class_id").agg(F.count("*").alias("copies")))
    named = members.join(rows.select(key, "doc_id").distinct(), key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key))
    keep, _ = exchange.settle(named.groupBy("class_id").agg(first.alias("first")).select(F.col(f"first.{key}").alias(key)))
    repeated = exchange.sized(exchange.settle(members.where("copies > 1").join(keep, key, "left_semi").select(key)), MOST_BROADCAST)
    gone = exchange.sized(exchange.settle(members.join(keep, key, "left_anti").select(key)), MOST_BROADCAST)
    single = rows.join(gone, key, "left_anti").join(repeated, key, "left_anti")
    once = rows.join(repeated, key, "left_semi").dropDuplicates([key])
    return single.unionByName(once).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long passages that op 9 finds more than once."""
    rows, key = _keyed(docs)
    cut = doubling.substring_dedup(rows, id_col=key).where("n_words > n_removed").select(F.col("doc_id").alias(key), F.col("kept_text").alias("text"))
    # equal rows are cut alike: one text for each key
    out = rows.drop("text").join(cut.dropDuplicates([key]), key).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark, by op 8."""
    rows, key = _keyed(docs)
    found = winnow.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    bad = exchange.settle(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    return rows.join(exchange.sized(bad, MOST_BROADCAST), key, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences, by op 4."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Tokenised packing, dart signatures and subword bands have no SQL form; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    folder = f"{exchange.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
