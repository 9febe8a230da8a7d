"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import DEMO_RULES, filter_urls, rules_frame

    return filter_urls(_table(spark, sf_dir, "pages"), rules_frame(spark, DEMO_RULES))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .exchange import ensure_checkpoint_dir
    from .warc import lookup, wanted_keys, write_archives

    pages, path = _table(spark, sf_dir, "pages"), f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return lookup(spark, path, wanted_keys(pages, id_col="page_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"), window=50)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), 2048)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classify

    labels = _table(spark, sf_dir, "labels")
    return classify(_table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0").select("doc_id"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dartminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolation import score

    return score(_table(spark, sf_dir, "documents"), order=3)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .doubling import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import default_model, quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), default_model())


def op11_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), 24)


def op12_rank_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_warc": op2_warc,
        "op3_run_length_index": op3_run_length_index,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_dart_minhash": op6_dart_minhash,
        "op7_deleted_interpolation": op7_deleted_interpolation,
        "op8_winnowing": op8_winnowing,
        "op10_tokeniser_fertility": op10_tokeniser_fertility,
        "op9_substring_dedup": op9_substring_dedup,
        "op11_minimax_shards": op11_minimax_shards,
        "op12_rank_convergence": op12_rank_convergence,
        "op13_refined_whitening": op13_refined_whitening,
    }


def oracle_sql() -> dict[str, str]:
    from . import urlfilter, warc, winnow

    return {"op1_url_filter": urlfilter.SQL, "op2_warc": warc.SQL, "op8_winnowing": winnow.SQL}
