"""Attack sequences inside sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.signals import archive_signals, base_signals, has_token, matches, text
from .blocks import ORDER, in_order, part, running, with_tail


@dataclass(frozen=True)
class Sequence:
    """Ordered steps within so many events of a session and so many time units: names of step flags, or ``tool:a,b`` for events of these tools (any case)."""

    id: str
    level: str
    steps: tuple[str, ...]
    within_events: int
    within_time: float
    least: int = 1  # of a single step


SEQUENCES = [
    Sequence("exfil-credential", "critical", ("sensitive_read", "network"), 5, 60.0),
    Sequence("backdoor-install", "critical", ("download", "executable"), 5, 60.0),
    Sequence("recon-then-exploit", "critical", ("recon", "privilege"), 8, 120.0),
    Sequence("secret-harvest", "high", ("sensitive_read",), 10, 30.0, 3),
    Sequence("staged-exfil", "high", ("tmp_write", "tmp_exfil"), 10, 120.0),
]


def step_flags(events: DataFrame) -> dict[str, Column]:
    tool, path, command = F.lower(text("tool_name")), F.col("path"), F.col("command")
    return {
        "sensitive_read": tool.isin(P.READ_TOOLS) & matches(path, P.CREDENTIAL_PATH),
        "network": base_signals(tool, path, F.lit(None), command)["network_activity"],
        "download": matches(command, P.DOWNLOAD),
        "executable": matches(command, P.CHMOD_EXEC) | (tool.isin("write_file", "write", "edit_file", "edit") & matches(path, P.SHELL_CONFIG)),
        "recon": matches(command, P.RECON), "privilege": matches(command, P.PRIVILEGE),
        "tmp_write": tool.isin(P.WRITE_TOOLS) & matches(path, P.TEMP_PATH),
        "tmp_exfil": matches(command, P.TEMP_PATH) & matches(command, P.NETWORK_COMMAND),
    }


def flags_of(events: DataFrame, sequences: list[Sequence]) -> dict[str, Column]:
    """The flag of every step of the sequences."""
    known, tool = step_flags(events), F.lower(text("tool_name"))
    steps = dict.fromkeys(step for s in sequences for step in s.steps)
    return {step: tool.isin([t.strip().lower() for t in step[5:].split(",")]) if step.startswith("tool:") else known[step] for step in steps}


def _matched(s: Sequence, order: Window, unit: float) -> Column:
    """Ids of the events that match a sequence in the window that ends at the row, null without a match."""
    names = list(dict.fromkeys(s.steps))
    frame = F.collect_list(F.struct("micros", "event_id", *names)).over(order.rowsBetween(-(s.within_events - 1), 0))
    near = F.filter(frame, lambda e: e["micros"] >= F.col("micros") - int(s.within_time * unit * 1e6))
    if len(s.steps) == 1:
        ids = F.transform(F.filter(near, lambda e: e[s.steps[0]]), lambda e: e["event_id"])
        return F.when(F.size(ids) >= s.least, F.slice(ids, 1, s.least))

    def walk(ids: Column, e: Column) -> Column:
        hit = F.lit(False)
        for i, step in enumerate(s.steps):
            hit = hit | ((F.size(ids) == i) & e[step])
        return F.when(hit, F.concat(ids, F.array(e["event_id"]))).otherwise(ids)

    ids = F.aggregate(near, F.array().cast("array<bigint>"), walk)
    return F.when(F.size(ids) == len(s.steps), ids)


def stepped(events: DataFrame, sequences: list[Sequence] | None = None) -> DataFrame:
    """The place of events in their sessions and the flags of all steps of the sequences."""
    sequences = SEQUENCES if sequences is None else sequences
    return events.select(*part(events), *ORDER, *[f.alias(n) for n, f in flags_of(events, sequences).items()])


def detect_trajectories(events: DataFrame, sequences: list[Sequence] | None = None, unit: float = 1.0) -> DataFrame:
    """(session_id, sequence_id, risk_level, trigger_event_id, matched): first trigger of every distinct set of matched events.

    A window is the last ``within_events`` events of the session, the row included, that are at most
    ``within_time`` units older. Steps match greedily in order; one event can't be two steps. Each window is an
    array of at most ten small structs over one sort by session; a fold walks the steps. Long sessions may be split into blocks (operators.blocks), which
    then begin with the last rows before them. Events may be stepped() already.
    """
    sequences = SEQUENCES if sequences is None else sequences
    rows = stepped(events, sequences) if "tool_name" in events.columns else events
    rows = with_tail(rows, max(s.within_events for s in sequences) - 1)
    order = in_order(rows)
    rows = rows.select("session_id", *ORDER, "_tail", *[_matched(s, order, unit).alias(f"m{i}") for i, s in enumerate(sequences)]).where("not _tail")
    found = [F.struct(F.lit(s.id).alias("sequence_id"), F.lit(s.level).alias("risk_level"), F.col(f"m{i}").alias("matched")) for i, s in enumerate(sequences)]
    hits = rows.select("session_id", *ORDER, F.inline(F.array(*found))).where(F.col("matched").isNotNull())
    hits = hits.withColumn("matched", F.array_join(F.transform(F.array_sort("matched"), lambda i: i.cast("string")), ","))
    first = Window.partitionBy("session_id", "sequence_id", "matched").orderBy(*ORDER)
    hits = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return hits.select("session_id", "sequence_id", "risk_level", F.col("event_id").alias("trigger_event_id"), "matched")


def apply_alerts(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Verdicts after trajectory alerts: an alert of at least high turns its triggering pre_action into a block; a block stays."""
    hit = alerts.where(F.col("risk_level").isin("high", "critical")).select(F.col("trigger_event_id").alias("event_id"), F.lit(True).alias("alerted")).distinct()
    out = scored.join(hit, "event_id", "left")
    return out.withColumn("verdict", F.when(F.col("alerted") & (F.col("etype") == "pre_action"), "block").otherwise(F.col("verdict"))).drop("alerted")


def history_flags(events: DataFrame) -> DataFrame:
    """The place of events in their sessions and what each does, as suspicious_history() needs it."""
    tool, path, command = F.col("tool_name"), F.col("path"), F.lower(text("command"))
    payload = F.lower(F.to_json(F.struct("command", "content", "path")))
    command = F.when(command != "", command).otherwise(payload)
    base = base_signals(tool, path, payload, command)
    network = base["network_activity"] | has_token(payload, P.NETWORK_TOKENS)
    archive = archive_signals(tool, payload, command)["archive_sensitive_material"]
    return events.select(
        *part(events), *ORDER, base["credential_access"].alias("cred"), network.alias("net"), base["read_action"].alias("read"), base["write_action"].alias("write"),
        base["exec_action"].alias("exec"), base["sudo_action"].alias("sudo"), (base["tmp_path_touched"] & (base["write_action"] | has_token(payload, P.STAGING_TOKENS))).alias("stage"),
        (base["tmp_path_touched"] & network).alias("exfil"), (base["recon_action"] | has_token(payload, P.RECON_TOKENS)).alias("recon"), archive.alias("archive"),
    )


def suspicious_history(events: DataFrame) -> DataFrame:
    """(session_id, event_id, pattern): events whose session up to them shows one of five patterns; the first in order names it.

    Running flags over one window; a stage that needs an earlier stage is a running maximum of the
    row's flag and the earlier stage's running flag. Long sessions may be split into blocks (operators.blocks), and events may have their history_flags() already.
    """
    rows = history_flags(events) if "tool_name" in events.columns else events
    ever = {f"saw_{n}": ("max", F.col(n)) for n in ("cred", "net", "read", "stage", "recon")}
    rows = running(rows, ever | {"creds": ("sum", F.col("cred").cast("long")), "n": ("sum", F.lit(1).cast("long"))}, inclusive=True)
    rows = running(rows, {"saw_write": ("max", F.col("write") & F.col("saw_read"))}, inclusive=True)
    rows = running(rows, {
        "p2": ("max", F.col("sudo") & F.col("saw_write")), "p3": ("max", F.col("exfil") & F.col("saw_stage")),
        "p4": ("max", F.col("sudo") & F.col("saw_recon")), "p5": ("max", F.col("archive") & (F.col("creds") >= 2)),
    }, inclusive=True).withColumn("p1", F.col("saw_cred") & F.col("saw_net"))
    pattern = (
        F.when(F.col("n") < 2, None).when(F.col("p1"), "secret_plus_network").when(F.col("p2"), "privilege_escalation_chain").when(F.col("p3"), "tmp_staging_exfil")
        .when(F.col("p4"), "recon_then_sudo").when(F.col("p5"), "secret_harvest_archive")
    )
    return rows.select("session_id", "event_id", pattern.alias("pattern")).where(F.col("pattern").isNotNull())
