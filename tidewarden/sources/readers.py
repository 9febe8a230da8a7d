"""Readers and writers of event logs; schemas are explicit, broken lines are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "schema_version string, event_id string, trace_id string, event_type string, session_id string, agent_id string, source_framework string, occurred_at string, "
    "payload map<string, string>, tool_name string, risk_hints array<string>, event_subtype string, run_id string, approval_id string, source_seq int, "
    "parent_event_id string, depth int, source_protocol_version string, mapping_profile string"
)


def read_events_jsonl(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Canonical events from JSON lines (or one JSON array a file); _corrupt holds lines that don't parse."""
    reader = spark.read.schema(EVENT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE")
    return reader.option("multiLine", multi_line).json(path)


_LINE = "type string, payload struct<id: string, type: string, name: string, arguments: string, call_id: string, output: string, role: string>"
LOG = ("file", "line", "type", "name", "arguments", "call_id", "session_id", "text")


def _log_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value) of session logs parsed; session_id only where a line names it; other kinds of lines are skipped."""
    rows = lines.select("file", "line", F.from_json("value", _LINE).alias("r"))
    rows = rows.where((F.col("r.type") == "session_meta") | ((F.col("r.type") == "response_item") & F.col("r.payload.type").isin("function_call", "function_call_output", "message")))
    kind = F.when(F.col("r.type") == "session_meta", "session_meta").otherwise(F.col("r.payload.type"))
    session = F.when(kind == "session_meta", F.nullif("r.payload.id", F.lit("")))
    return rows.select("file", "line", kind.alias("type"), "r.payload.name", "r.payload.arguments", "r.payload.call_id", session.alias("session_id"), F.col("r.payload.output").alias("text"))


def read_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, type, name, arguments, call_id, session_id, text) of session log lines; a line has the last session id that its file names up to it.

    line orders the lines of a file: the start of its split, and the place of the line in it. Files may be split, as no line needs its number.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    rows = _log_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("line"), "value"))
    up_to = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session_id", F.last("session_id", ignorenulls=True).over(up_to)).select(*LOG)


def read_trajectories(spark: SparkSession, path: str, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(turns, problems): labelled records exploded to turns, and the ids that repeat or lack a safe or unsafe label."""
    turn = "struct<role:string, content:string, action:string>"
    records = spark.read.schema(f"id string, contents array<array<{turn}>>").option("multiLine", True).json(path)
    labels = spark.read.schema("id string, label string").json(manifest)
    joined = records.join(labels, "id", "left")
    turns = joined.select("id", "label", F.posexplode("contents").alias("block", "turns")).select("id", "label", "block", F.posexplode("turns").alias("turn", "t")).select("id", "label", "block", "turn", "t.*")
    counted = records.groupBy("id").agg(F.count("*").alias("n"))
    bad = joined.where(F.col("label").isNull() | ~F.col("label").isin("safe", "unsafe")).select("id", F.lit("label").alias("problem"))
    return turns, bad.unionByName(counted.where("n > 1").select("id", F.lit("repeated").alias("problem"))).distinct()


def write_decisions(scored: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the decision table, partitioned by day; one shuffle to the days keeps the files few."""
    day = F.date_format(F.timestamp_micros("micros"), "yyyy-MM-dd")
    scored.withColumn("date", day).repartition("date", F.pmod(F.xxhash64("session_id"), F.lit(16))).write.mode(mode).partitionBy("date").parquet(path)


def prune_expired(records: DataFrame, retention_s: float, as_of: int | None = None) -> DataFrame:
    """Records not older than the retention before ``as_of`` (microseconds; default the newest record)."""
    if as_of is None:
        return records.crossJoin(F.broadcast(records.agg(F.max("micros").alias("_now")))).where(F.col("micros") >= F.col("_now") - int(retention_s * 1e6)).drop("_now")  # one row
    return records.where(F.col("micros") >= as_of - int(retention_s * 1e6))


def export_audit(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """The fixed audit columns as csv or json."""
    out = rows.select("event_id", "session_id", "micros", "tool_name", "risk_level", "verdict")
    (out.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else out.write.mode("overwrite").json(path))


def runtime_feed(rows: DataFrame, session: str | None = None, least_rank: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """Feed filter by session, least risk and event kinds; works on streams too."""
    out = rows.where(F.col("risk_rank") >= least_rank)
    if session is not None:
        out = out.where(F.col("session_id") == session)
    return out if kinds is None else out.where(F.col("etype").isin(kinds))


def feed_replay(rows: DataFrame, most: int = 50, **filters) -> DataFrame:
    """The newest ``most`` rows of a feed with the filters of runtime_feed(), oldest first: what a late subscriber gets before the stream."""
    newest = runtime_feed(rows, **filters).orderBy(F.desc("micros"), F.desc("event_id")).limit(most)
    return newest.orderBy("micros", "event_id")
