"""Second-level analysis of scored events: escalation by hints, key domains, intent and rules, and the gate before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scoring as S
from ..functions.signals import matches, text
from .rules import RULES, Rule, rule_weight

# fixed values
HIGH_HINTS = ["credential_exfiltration", "privilege_escalation", "prompt_injection", "supply_chain_attack", "destructive_intent"]
CRITICAL_HINTS = ["privilege_escalation_confirmed", "credential_exfiltration_confirmed"]
KEY_DOMAIN = r"\b(prod|production|credential|credentials|secret|token|password|api_key|private_key|ssh_key)\b"
CRITICAL_INTENT = r"\b(exfiltrat|bypass|disable\s+security|privilege\s+escalat|steal)\b"

_LEAST_WEIGHT = 8


def event_text(events: DataFrame, hints: Column) -> Column:
    """The lower-cased tool, hints and payload of an event as one text of at most 65 536 characters."""
    payload = F.to_json(F.struct(*[F.col(c) for c in ("command", "path", "content")]))
    return F.substring(F.lower(F.concat_ws(" ", text("tool_name"), F.array_join(hints, " "), payload)), 1, 65_536)


def missing_dimensions(tool: Column, path: Column, command: Column, trust: Column) -> Column:
    """The dimensions that an event gives nothing for, in order."""
    shell = F.lower(text(tool)).isin([*P.SHELL_TOOLS, "exec"])
    return F.array_compact(F.array(
        F.when(text(tool) == "", "d1"), F.when(F.size(S.paths_of(path, command)) == 0, "d2"), F.when(shell & (F.trim(text(command)) == ""), "d3"), F.when(trust.isNull(), "d5"),
    ))


def combined_injection(layer: Column, canary: Column, similar: Column) -> Column:
    """The injection score of all three layers, at most 3."""
    return F.least(layer + canary + similar, F.lit(3.0))


def auto_resolved(verdict: Column, event_type: Column, level: Column, action: str = "block") -> Column:
    """Verdicts with deferred actions decided: ``block``, ``allow``, or ``allow_low_block_high``."""
    decided = {"allow": F.lit("allow"), "allow_low_block_high": F.when(S.risk_rank(level) == 0, "allow").otherwise("block")}.get(action, F.lit("block"))
    return F.when((verdict == "defer") & (event_type == "pre_action"), decided).otherwise(verdict)


def second_level(scored: DataFrame, hints: Column, manual: Column | None = None, tier: Column | None = None, rules: list[Rule] | None = None, t: S.Thresholds = S.Thresholds()) -> DataFrame:
    """Add l2_run, l2_level, l2_score and l2_reasons to scored events: one projection.

    The gate opens for a requested tier L2 or L3, a pre_action of medium risk, a key domain in the event's text, or a manual flag. Behind it the
    level rises to critical for confirmed hints or critical intent on a key domain; to high for threatening hints, a dangerous tool on a key
    domain, a rule's weight of 8 or a manual flag; and to the highest level of the rules that match. It never falls; the score is at least its level's threshold.
    """
    rules = RULES if rules is None else rules
    rows = scored.withColumn("_hints", F.transform(F.coalesce(hints, F.array().cast("array<string>")), F.lower))
    rows = rows.withColumn("_text", event_text(rows, F.col("_hints")))
    manual = F.coalesce(manual, F.lit(False)) if manual is not None else F.lit(False)
    key = matches(F.col("_text"), KEY_DOMAIN)
    intent = matches(F.col("_text"), CRITICAL_INTENT)
    dangerous = F.lower(text("tool_name")).isin(P.DANGEROUS_TOOLS)
    # rules look at the event's whole text, as their content
    hits = F.filter(F.array(*[
        F.struct(F.lit(r.id).alias("id"), F.lit(P.LEVELS.index(r.level)).alias("rank"), rule_weight(r, text("tool_name"), text("path"), text("command"), F.col("_text")).alias("weight")) for r in rules
    ]), lambda x: x["weight"].isNotNull())
    rows = rows.withColumns({"_key": key, "_intent": intent, "_hits": hits})
    confirmed, threatening = F.arrays_overlap("_hints", F.lit(CRITICAL_HINTS)), F.arrays_overlap("_hints", F.lit(HIGH_HINTS))
    by_rule = F.coalesce(F.array_max(F.transform("_hits", lambda x: x["rank"])), F.lit(0))
    heavy = F.coalesce(F.array_max(F.transform("_hits", lambda x: x["weight"])), F.lit(0))
    before = F.greatest(
        F.col("risk_rank"), F.when(confirmed, 3).when(threatening, 2).otherwise(0), F.when(F.col("_key") & F.col("_intent"), 3).when(F.col("_key") & dangerous, 2).otherwise(0), by_rule
    )
    lifted = (heavy >= _LEAST_WEIGHT) & (before < 2)
    rank = F.greatest(before, F.when(lifted | manual, 2).otherwise(0))
    asked = F.coalesce(tier.isin("L2", "L3"), F.lit(False)) if tier is not None else F.lit(False)
    run = asked | ((F.col("etype") == "pre_action") & (F.col("risk_level") == "medium")) | F.col("_key") | manual
    reasons = F.array_compact(F.array(
        F.when(confirmed, "confirmed hint").when(threatening, "threatening hint"), F.when(F.col("_key") & F.col("_intent"), "critical intent on key domain").when(F.col("_key") & dangerous, "dangerous tool on key domain"),
        F.when(lifted, "heavy rule"), F.when(F.size("_hits") > 0, F.concat(F.lit("rules "), F.array_join(F.transform("_hits", lambda x: x["id"]), ","))), F.when(manual, "manual flag"),
    ))
    floor = F.element_at(F.array(F.lit(0.0), F.lit(t.medium), F.lit(t.high), F.lit(t.critical)), rank + 1)
    level = F.when(run, S.level_of_rank(rank)).otherwise(F.col("risk_level"))
    out = rows.withColumns({
        "l2_run": run, "l2_level": level, "l2_score": F.when(run, F.greatest(F.col("composite"), floor)).otherwise(F.col("composite")),
        "l2_reasons": F.when(run, reasons).otherwise(F.array().cast("array<string>")),
    })
    return out.drop("_hints", "_text", "_key", "_intent", "_hits")
