"""Scoring of event tables: dimensions, level, verdict, taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.signals import archive_signals, base_signals, dangerous_command, dangerous_execution, invisible, lowered, normalized, text


def apart(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that read what stands in rows, as a projection compiled by itself.

    Fused with the steps around it, the code of all patterns is one method, and beyond 8000 bytes the just-in-time compiler leaves a method alone. Lambdas are not fused, so that a
    column made by one takes the projection out, and then Spark cuts its code into short methods. As that column is made of the partition's number, filters on levels stay above: pushed
    below, they would repeat every pattern for each use.
    """
    never = F.exists(F.array(F.lit(0)), lambda p: F.spark_partition_id() < p)
    return rows.select("*", *[F.when(~never, c).alias(n) for n, c in columns.items()])


def dimensions(events: DataFrame, boost: float = 0.0) -> DataFrame:
    """Add d1, d2, d3, d5 and d6. Needs tool_name, path, command, content and trust; nulls count as empty."""
    tool, path, command, content = (F.col(c) for c in ("tool_name", "path", "command", "content"))
    origin = F.when(F.lower(text(tool)).isin("http_request", "fetch", "web_fetch"), "external").otherwise("user")
    plain, low, order, danger, lines = (F.col(c) for c in ("_plain", "_low", "_order", "_danger", "_lines"))
    # texts and path lines are made once a row, in columns of their own, and so are those in lower case, which are searched for literals; steps pass on only what the next ones read
    rows = events.withColumn("_text", S.scanned(F.concat_ws(" ", command, path, content)))
    rows = apart(rows, {"_plain": normalized(F.col("_text")), "_hidden": invisible(F.col("_text")), "_lines": S.path_lines(path, command)}).drop("_text")
    rows = apart(rows, {"_low": lowered(plain), "_order": lowered(command), "_line_low": lowered(lines)})
    d6 = S.d6(None, tool, origin, boost, plain, (S.weak_hits(plain, low), S.strong_hits(plain, low)), F.col("_hidden"))
    rows = apart(rows, {"_danger": (order != "") & dangerous_command(command, order), "d2": S.d2(path, command, lines, F.col("_line_low")), "d5": S.d5(F.col("trust")), "d6": F.round(d6, 4)})
    rows = apart(rows, {"d1": S.d1(tool, command, danger, order), "d3": S.d3(tool, command, danger, order)})
    return rows.select(*[f"`{c}`" for c in events.columns], "d1", "d2", "d3", "d5", "d6")


def injection(rows: DataFrame, content: str = "output") -> DataFrame:
    """Add d6, the injection score of a text alone."""
    plain, low = F.col("_plain"), F.col("_low")
    out = apart(apart(rows, {"_plain": normalized(S.scanned(F.col(content)))}), {"_low": lowered(plain)})
    out = apart(out, {"_weak": S.weak_hits(plain, low), "_strong": S.strong_hits(plain, low)})
    return apart(out, {"d6": S.d6(F.col(content), plain=plain, hits=(F.col("_weak"), F.col("_strong")))}).drop("_plain", "_low", "_weak", "_strong")


def with_level(rows: DataFrame, d4: Column, t: S.Thresholds = S.Thresholds()) -> DataFrame:
    """Add d4, composite, sc_rule, risk_level, risk_rank and verdict."""
    a, b, c, e, f = (F.col(x) for x in ("d1", "d2", "d3", "d5", "d6"))
    rows = rows.withColumn("d4", d4).withColumn("sc_rule", S.short_circuit(a, b, c))
    rows = rows.withColumn("composite", S.composite(a, b, c, F.col("d4"), e, f, t))
    rows = rows.withColumn("risk_level", S.level(F.col("composite"), F.col("sc_rule"), f, t))
    return rows.withColumns({"risk_rank": S.risk_rank(F.col("risk_level")), "verdict": S.verdict(F.col("etype"), F.col("risk_level"))})


def score_events(events: DataFrame, t: S.Thresholds = S.Thresholds()) -> DataFrame:
    """Score every event on its own (d4 = 0): one projection, no shuffle."""
    return with_level(dimensions(events), F.lit(0), t)


def preset_comparison(events: DataFrame) -> DataFrame:
    """(preset, risk_level, n): one pass over the events for all presets, then a small aggregate."""
    rows = dimensions(events).withColumn("sc_rule", S.short_circuit(F.col("d1"), F.col("d2"), F.col("d3")))
    levels = []
    for name, t in S.PRESETS.items():
        score = S.composite(*(F.col(c) for c in ("d1", "d2", "d3")), F.lit(0), F.col("d5"), F.col("d6"), t)
        levels.append(F.struct(F.lit(name).alias("preset"), S.level(score, F.col("sc_rule"), F.col("d6"), t).alias("risk_level")))
    return rows.select(F.inline(F.array(*levels))).groupBy("preset", "risk_level").agg(F.count("*").alias("n"))


# fixed values: tier and name of each class
TAXONOMY = {
    "prompt_injection": "RT1", "jailbreak_attack": "RT1", "sensitive_info_disclosure": "RT1", "excessive_agency": "RT1", "unauthorized_code_execution": "RT1",
    "hallucination": "RT1", "memory_poisoning": "RT1", "tool_misuse": "RT1", "malicious_propagation": "RT2", "misinformation_amplification": "RT2",
    "insecure_output_handling": "RT2", "goal_drift": "RT2", "message_tampering": "RT2", "identity_spoofing": "RT2", "cascading_failure": "RT3",
    "sandbox_escape": "RT3", "insufficient_monitoring": "RT3", "group_hallucination": "RT3", "malicious_emergence": "RT3", "rogue_agent": "RT3",
}
TIER_NAMES = {"RT1": "Atomic Risks", "RT2": "Communication Risks", "RT3": "System Risks"}
INJECTION_PHRASES = ["ignore previous instructions", "disregard previous instructions", "system prompt", "developer message"]


def classify(scored: DataFrame) -> DataFrame:
    """Add subtype, tier and confidence; ordered rules, the first that fits decides, none gives ``unmapped``.

    Optional columns take part where they exist: runtime_type (kind of a runtime event), trigger_detail and trigger_reason (of a deep
    review), reason (text of a runtime event), hints (array). Nulls count as empty.
    """
    have = lambda name: F.lower(text(name)) if name in scored.columns else F.lit("")
    tool, command = F.col("tool_name"), F.col("command")
    hints = F.col("hints") if "hints" in scored.columns else None
    base = base_signals(tool, F.col("path"), F.col("content"), command, hints)
    archive = archive_signals(tool, F.col("content"), command)
    low = F.lower(F.concat_ws(" ", command, F.col("content"), have("reason")))
    phrases = F.lit(False)
    for phrase in INJECTION_PHRASES:
        phrases = phrases | low.contains(phrase)
    risky = F.col("risk_level").isin("high", "critical")
    kind, detail, why = have("runtime_type"), have("trigger_detail"), have("trigger_reason")
    # rule, class, whether its confidence is high
    rules = [
        (kind == "trajectory_alert", "cascading_failure", True),
        (kind == "post_action_finding", "insecure_output_handling", True),
        (kind == "budget_exhausted", "rogue_agent", False),
        ((kind == "decision") & detail.isin("secret_harvest_archive", "tmp_staging_exfil"), "sandbox_escape", False),
        ((F.col("d6") >= 2.0) | phrases, "prompt_injection", True),
        (detail.isin("secret_plus_network", "secret_harvest_archive"), "sensitive_info_disclosure", True),
        (base["credential_access"] & (base["network_activity"] | archive["archive_sensitive_material"]), "sensitive_info_disclosure", True),
        ((kind == "alert") & low.contains("session_risk_escalation"), "tool_misuse", False),
        (detail.isin("privilege_escalation_chain", "recon_then_sudo"), "unauthorized_code_execution", True),
        (base["exec_action"] & (base["sudo_action"] | dangerous_execution(command)), "unauthorized_code_execution", True),
        (detail == "tmp_staging_exfil", "sandbox_escape", False),
        (why == "cumulative_risk", "excessive_agency", False),
        (risky & base["exec_action"], "tool_misuse", False),
    ]
    found = F.lit(None).cast("struct<subtype:string,confidence:string>")
    for rule, name, sure in reversed(rules):
        found = F.when(rule, F.struct(F.lit(name).alias("subtype"), F.lit("high" if sure else "medium").alias("confidence"))).otherwise(found)
    rows = scored.withColumn("_class", found)
    tiers = F.create_map(*[F.lit(x) for pair in TAXONOMY.items() for x in pair])
    subtype = F.coalesce(F.col("_class.subtype"), F.lit("unmapped"))
    return rows.withColumns({"subtype": subtype, "tier": F.coalesce(F.element_at(tiers, subtype), F.lit("none")), "confidence": F.coalesce(F.col("_class.confidence"), F.lit("low"))}).drop("_class")
