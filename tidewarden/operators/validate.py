"""Validation: the names of the rules that a row breaks, and the split into valid rows and a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import text

_PROFILE = r"^openclaw@[A-Za-z0-9._-]+/protocol\.v\d+(?:\.\d+)*/profile\.v[1-9]\d*$"


def _named(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items()]))


def event_violations() -> Column:
    """Broken rules of an event: schema_version, occurred_at, ids, subtype and profile where a framework needs them."""
    openclaw = text("source_framework") == "openclaw"
    return _named({
        "schema_version": ~text("schema_version").rlike(r"^ahp\.\d+\.\d+$"), "occurred_at": F.try_to_timestamp(text("occurred_at")).isNull(),
        "event_id": text("event_id") == "", "session_id": text("session_id") == "",
        "event_subtype": text("source_framework").isin("a3s-code", "openclaw") & (text("event_subtype") == ""),
        "mapping_profile": openclaw & ~text("mapping_profile").rlike(_PROFILE), "protocol_version": openclaw & (text("source_protocol_version") == ""),
    })


def decision_violations() -> Column:
    """Broken rules of a decision: allow and block are final, modify has a payload, rewrites modify, session scope blocks or defers."""
    return _named({
        "final": F.col("decision").isin("allow", "block") & ~F.coalesce("final", F.lit(True)), "modified_payload": (F.col("decision") == "modify") & F.col("modified_payload").isNull(),
        "rewrite": F.coalesce("rewrite", F.lit(False)) & (F.col("decision") != "modify"), "session_scope": (text("scope") == "session") & ~F.col("decision").isin("block", "defer"),
    })


def effect_violations() -> Column:
    """Broken rules of an effect result: nothing is both enforced and degraded or unsupported; a degradation has a reason."""
    weak = F.array_union(F.coalesce("degraded", F.array()), F.coalesce("unsupported", F.array()))
    return _named({"overlap": F.arrays_overlap(F.coalesce("enforced", F.array()), weak), "reason": (F.size(weak) > 0) & (text("degrade_reason") == "")})


def quarantine(events: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows with their rules and a fingerprint): one expression, no join."""
    rows = events.withColumn("violations", violations)
    broken = rows.where(F.size("violations") > 0)
    stamp = F.sha2(F.to_json(F.struct(*[F.col(c) for c in events.columns])), 256)
    return rows.where(F.size("violations") == 0).drop("violations"), broken.withColumn("fingerprint", stamp)


def inferred_risk(level: Column, command: Column, tool: Column) -> Column:
    """The risk of an event that can't be scored: its own level, else high for ``rm -rf`` or sudo, medium for a shell, low."""
    low, own = F.lower(text(command)), F.lower(text(level))
    return (
        F.when(own.isin("low", "medium", "high", "critical"), own).when(low.contains("rm -rf") | low.contains("sudo"), "high")
        .when(F.lower(text(tool)).isin("bash", "shell", "exec", "sudo"), "medium").otherwise("low")
    )


def review_queue(broken: DataFrame, level: Column, command: Column, tool: Column) -> DataFrame:
    """Broken rows of quarantine() of at least medium inferred risk, with it, one for each fingerprint."""
    rows = broken.withColumn("inferred_risk", inferred_risk(level, command, tool))
    return rows.where(F.col("inferred_risk") != "low").dropDuplicates(["fingerprint"])
