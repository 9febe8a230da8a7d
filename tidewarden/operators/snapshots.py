"""Frozen evidence of risky records: deterministic snapshots, and the local review of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S


def snapshot_triggers(scored: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Add trigger_reason and trigger_detail: a sequence alert of at least high risk, named by its sequence (the first by rank, then by name), else ``threshold`` for a record of high risk; else null."""
    rows = scored.withColumns({"trigger_reason": F.when(F.col("risk_rank") >= 2, "threshold"), "trigger_detail": F.lit(None).cast("string")})
    if alerts is None:
        return rows
    order = F.struct((-S.risk_rank(F.col("risk_level"))).alias("rank"), "sequence_id")
    first = alerts.where(S.risk_rank(F.col("risk_level")) >= 2).groupBy(F.col("trigger_event_id").alias("event_id")).agg(F.min(order)["sequence_id"].alias("_alert"))
    rows = rows.join(first, "event_id", "left")
    return rows.withColumns({"trigger_reason": F.when(F.col("_alert").isNotNull(), "trajectory_alert").otherwise(F.col("trigger_reason")), "trigger_detail": F.col("_alert")}).drop("_alert")


def review_snapshots(scored: DataFrame, alerts: DataFrame | None = None, most: int = 50) -> DataFrame:
    """A row for each triggering record: snapshot_id, session_id, trigger_event_id, trigger_reason, trigger_detail, from_record, to_record, record_count, fingerprint,
    current_level, high_count, decisions, highest, action and summary.

    A snapshot has the last ``most`` records of the session up to the trigger, by id. Its fingerprint is a hash of what they say, and
    its id one of the trigger, the range and the fingerprint: the same records give the same id, changed ones another. The review reads the
    snapshot alone: highest risk, the action that it asks for, and the decisions it is made of. One window a session; only its triggers keep their array of records.
    """
    near = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(-(most - 1), 0)
    rows = snapshot_triggers(scored, alerts).select("session_id", "event_id", "micros", "verdict", "risk_level", "risk_rank", "trigger_reason", "trigger_detail")
    rows = rows.withColumn("near", F.collect_list(F.struct("event_id", F.coalesce("verdict", F.lit("unknown")).alias("verdict"), "risk_level", "risk_rank", "micros")).over(near)).where(F.col("trigger_reason").isNotNull())
    told = F.array_join(F.transform("near", lambda r: F.concat_ws("|", r["event_id"].cast("string"), r["verdict"], r["risk_level"], r["micros"].cast("string"))), "\n")
    kinds = F.array_sort(F.array_distinct(F.transform("near", lambda r: r["verdict"])))
    decisions = F.array_join(F.transform(kinds, lambda v: F.concat(v, F.lit("="), F.size(F.filter("near", lambda r: r["verdict"] == v)).cast("string"))), ", ")
    rows = rows.withColumns({
        "from_record": F.element_at("near", 1)["event_id"], "to_record": F.col("event_id"), "record_count": F.size("near"), "fingerprint": F.sha2(told, 256), "current_level": F.col("risk_level"),
        "high_count": F.size(F.filter("near", lambda r: r["risk_rank"] >= 2)), "decisions": decisions, "highest": S.level_of_rank(F.array_max(F.transform("near", lambda r: r["risk_rank"]))),
    })
    key = F.concat_ws("|", F.col("session_id").cast("string"), F.col("event_id").cast("string"), "trigger_reason", F.coalesce("trigger_detail", F.lit("")), F.col("from_record").cast("string"), F.col("to_record").cast("string"), "fingerprint")
    action = F.when(F.col("highest") == "critical", "escalate").when(F.col("highest").isin("high", "medium"), "inspect").otherwise("none")
    summary = F.format_string("%s risk across %d record(s) from %d to %d; decisions: %s", "highest", "record_count", "from_record", "to_record", "decisions")
    return rows.select(
        F.concat(F.lit("l3snap-"), F.substring(F.sha2(key, 256), 1, 16)).alias("snapshot_id"), "session_id", F.col("event_id").alias("trigger_event_id"), "trigger_reason", "trigger_detail", "from_record", "to_record",
        "record_count", "fingerprint", "current_level", "high_count", "decisions", "highest", action.alias("action"), summary.alias("summary"),
    )
