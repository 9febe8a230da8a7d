"""Folds over ordered logs: approvals with retries, alert thinning, verdict merging, budgets of effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import risk_rank


def approval_states(log: DataFrame, retries: dict[str, int] | None = None) -> DataFrame:
    """(approval_id, state, attempts) from a log (approval_id, micros, event, risk) of requested, failed, allowed and denied.

    A request is pending; a failure uses one of the retries its risk has and ends in ``exhausted``; the first allowed or denied is final.
    Each approval's few events are aggregated; no order of the whole log is needed.
    """
    retries = {"low": 3, "medium": 2, "high": 1, "critical": 0} if retries is None else retries
    allowance = F.lit(0)
    for name, n in retries.items():
        allowance = F.when(F.col("risk") == name, n).otherwise(allowance)
    final = F.min(F.when(F.col("event").isin("allowed", "denied"), F.struct("micros", "event"))).alias("final")
    rows = log.groupBy("approval_id").agg(final, F.max("risk").alias("risk"))
    before = log.join(rows.select("approval_id", "final"), "approval_id").where((F.col("event") == "failed") & (F.col("final").isNull() | (F.col("micros") < F.col("final.micros"))))
    failed = before.groupBy("approval_id").agg(F.count("*").alias("attempts"))
    rows = rows.join(failed, "approval_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    state = F.when(F.col("attempts") > allowance, "exhausted").when(F.col("final").isNotNull(), F.col("final.event")).otherwise("pending")
    return rows.select("approval_id", state.alias("state"), "attempts")


def merge_analyses(results: DataFrame, base: DataFrame, force: Column | None = None) -> DataFrame:
    """Best analyzer result per event by level, then confidence; confidence 0 doesn't count and a level never falls below the base level.

    results: (event_id, target_level, confidence, and position where analyzers have an order); base: (event_id, risk_level). The first analyzer (position 0) is decisive
    with at least high risk at a confidence of 0.8: later results of its event don't count then, unless ``force`` (a boolean column of results) asks for them.
    """
    rank = risk_rank(F.col("target_level"))
    rows = results.where(F.col("confidence") > 0)
    if "position" in results.columns:
        asked = F.coalesce(force, F.lit(False)) if force is not None else F.lit(False)
        first = rows.where((F.col("position") == 0) & (rank >= 2) & (F.col("confidence") >= 0.8) & ~asked).select("event_id").distinct()
        rows = rows.where(F.col("position") == 0).unionByName(rows.where(F.col("position") != 0).join(first, "event_id", "left_anti").select(rows.columns))
    best = rows.groupBy("event_id").agg(F.max(F.struct(rank.alias("rank"), "confidence", "target_level")).alias("best"))
    rows = base.join(best, "event_id", "left")
    lift = F.coalesce(F.col("best.rank"), F.lit(-1)) > risk_rank(F.col("risk_level"))
    return rows.withColumn("risk_level", F.when(lift, F.col("best.target_level")).otherwise(F.col("risk_level"))).drop("best")


def first_effects(effects: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Idempotent insert: the first row of every key that ``target`` doesn't have yet; the key is given or made of the row's ids."""
    key = F.coalesce("idempotency_key", F.concat_ws(":", "effect_id", "framework", "adapter", "event_id"))
    rows = effects.withColumn("key", key)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("micros", "effect_id"))).where("nth = 1").drop("nth")
    return rows if target is None else rows.join(target.select("key"), "key", "left_anti")


def review_rows(responses: DataFrame) -> DataFrame:
    """(event_id, risk_level, state, reason) from model answers: the first fenced or bare JSON object; anything else is degraded."""
    fenced = F.regexp_extract("response", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract("response", r"(?s)(\{.*\})", 1))
    parsed = F.from_json(body, "risk_level string, state string, reason string")
    good = parsed["risk_level"].isin("low", "medium", "high", "critical")
    return responses.select(
        "event_id", F.when(good, parsed["risk_level"]).alias("risk_level"), F.when(good, F.coalesce(parsed["state"], F.lit("completed"))).otherwise("degraded").alias("state"),
        F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 500).alias("reason"),
    )


def final_verdict(state: Column, payload: Column, on_timeout: str = "block") -> Column:
    """Approval state to verdict: an allowed request with a changed payload is a modification."""
    return F.when((state == "allowed") & payload.isNotNull(), "modify").when(state == "allowed", "allow").when(state == "denied", "block").when(state == "expired", on_timeout).otherwise("defer")
