"""Small rules that turn levels, states and hints into actions and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .signals import has_token, text

# fixed values
HIGH_RISK_TOOLS = ["bash", "shell", "exec", "sudo", "chmod", "chown", "write", "edit", "write_file", "edit_file", "create_file"]
PROVIDER_REASONS = ["provider_disabled", "provider_response_invalid", "provider_error"]


def operator_action(level: Column) -> Column:
    """escalate, inspect or none."""
    return F.when(level == "critical", "escalate").when(level.isin("high", "medium"), "inspect").otherwise("none")


def advisory_action(state: Column, level: Column, recommended: Column, reason: Column) -> Column:
    """Action from a finished or degraded review; null where none is due."""
    state, level, recommended = F.lower(text(state)), F.lower(text(level)), F.coalesce(F.lower(recommended), F.lit("none"))
    degraded = F.when(F.lower(text(reason)).isin(PROVIDER_REASONS), "inspect_provider_config").otherwise("inspect")
    plain = F.when(recommended != "none", recommended).when(level == "critical", "escalate").when(level == "high", "inspect")
    return F.when(state == "degraded", degraded).when((state == "completed") & (level.isin("high", "critical") | recommended.isin("pause", "escalate", "inspect")), plain)


def recommendation(advice: Column, over_budget: Column, level: Column) -> Column:
    """Label for a session: its review's advice, a budget warning, else by level."""
    return (
        F.when(text(advice) != "", advice).when(over_budget, "review budget evidence").when(level == "critical", "escalate immediately")
        .when(level == "high", "inspect replay").otherwise("monitor session")
    )


def hint_class(hint: Column) -> Column:
    """shell, file, network, data or default, in that order."""
    return (
        F.when(has_token(hint, ["shell", "command"]), "shell").when(has_token(hint, ["file", "path"]), "file").when(has_token(hint, ["network", "url"]), "network")
        .when(has_token(hint, ["secret", "credential", "data"]), "data").otherwise("default")
    )


def severity(value: Column) -> Column:
    """Alert severities with the old names mapped; empty is low."""
    low = F.lower(F.trim(text(value)))
    return F.when(low == "info", "low").when(low == "warning", "medium").when(low == "", "low").otherwise(low)


def complex_payload(payload: Column, keys: Column | None = None) -> Column:
    """JSON text of at least 512 characters, six keys or three levels of nesting."""
    body = text(payload)
    bare = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*"', "")
    deep = F.regexp_replace(bare, r"[^\[\]{}]", "").rlike(r"[\[{][\[{](?:[\[{]|.*[\[{][\[{][\[{])")
    many = F.size(F.json_object_keys(payload)) if keys is None else F.size(keys)
    return (F.length(body) >= 512) | (F.coalesce(many, F.lit(0)) >= 6) | deep


def review_trigger(manual: Column, eager: Column, pattern: Column, points: Column, tool: Column, payload: Column) -> Column:
    """Why a deep review starts: manual, eager profile, suspicious pattern, five risk points, complex payload of a risky tool; else null."""
    risky = F.lower(text(tool)).isin(HIGH_RISK_TOOLS)
    return (
        F.when(manual, "manual_l3_escalate").when(eager, "eager").when(pattern.isNotNull(), "suspicious_pattern").when(points >= 5, "cumulative_risk")
        .when(risky & complex_payload(payload), "high_risk_complex_payload")
    )


# fixed values: what a reason of a review says, and its code; the first that fits counts
REASON_CODES = [
    ("hard cap exceeded", "hard_cap_exceeded"), ("llm call failed", "llm_call_failed"), ("max reasoning turns exceeded", "max_turns_exceeded"), ("format retry failed", "format_retry_failed"),
    ("response parse failed", "llm_response_parse_failed"), ("unresolvable risk level", "llm_response_unresolvable_risk_level"), ("requested non-whitelisted tool", "requested_non_whitelisted_tool"),
    ("tool call budget exhausted", "tool_call_budget_exhausted"), ("budget exhausted", "budget_exhausted"), ("local l3 unavailable", "local_l3_unavailable"), ("local l3 review did not complete", "local_l3_not_completed"),
    ("analysis degraded", "analysis_exception"),
]


def review_runtime(requested_tier: Column, effective_tier: Column, actual_tier: Column, available: Column, trace: Column, reason: Column | None = None, code: Column | None = None) -> Column:
    """(requested, state, reason, code) of a deep review; trace: a struct (degradation_reason, reason_code, trigger_reason, degraded), or null."""
    given = lambda c: F.nullif(F.trim(text(c)), F.lit(""))
    reason = F.nullif(text(reason), F.lit("")) if reason is not None else F.lit(None).cast("string")
    code = F.nullif(text(code), F.lit("")) if code is not None else F.lit(None).cast("string")
    trigger, degraded, why = text(given(trace["trigger_reason"])), F.coalesce(trace["degraded"], F.lit(False)), given(trace["degradation_reason"])
    requested = F.coalesce((requested_tier == "L3") | (effective_tier == "L3"), F.lit(False))
    unmatched = (actual_tier == "L1") & (trigger == "trigger_not_matched")
    state = F.when(actual_tier == "L3", "completed").when(requested, F.when(unmatched, "not_triggered").when(degraded, "degraded").otherwise("skipped")).when(available, "enabled")
    told = F.when(state == "not_triggered", F.coalesce(reason, why, F.lit("L3 trigger not matched"))).when(state == "degraded", F.coalesce(reason, why)).otherwise(reason)
    low = F.lower(F.trim(text(told)))
    found = F.when((trigger == "trigger_not_matched") | F.coalesce(state == "not_triggered", F.lit(False)), "trigger_not_matched")
    for words, name in REASON_CODES:
        found = found.when(low.contains(words), name)
    found = found.when(F.coalesce(state == "skipped", F.lit(False)), "requested_but_not_run").when(degraded | F.coalesce(state == "degraded", F.lit(False)), "unknown_degraded")
    return F.struct(requested.alias("requested"), state.alias("state"), told.alias("reason"), F.coalesce(code, given(trace["reason_code"]), found).alias("code"))


def activity(last_micros: Column, now_micros: Column, unit: float = 1.0) -> Column:
    """hot within two minutes, warm within fifteen, else idle."""
    age = (now_micros - last_micros) / (unit * 1e6)
    return F.when(age <= 120, "hot").when(age <= 900, "warm").otherwise("idle")


def payload_preview(payload: Column, most: int = 96) -> Column:
    """(hash, preview) of a payload, a JSON object with sorted keys or any other text.

    The preview is its command, input or tool_input (the first that it has) or all of it, on one line, with the first value after each of four markers
    hidden, of at most ``most`` characters. A nested value is shown as JSON.
    """
    body = text(payload)
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    shown = body
    for key in ("tool_input", "input", "command"):
        shown = F.when(F.array_contains(keys, key), text(F.get_json_object(body, f"$.{key}"))).otherwise(shown)
    shown = F.regexp_replace(F.replace(shown, F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")
    for marker in P.PREVIEW_MARKERS:
        shown = F.regexp_replace(shown, f"(?is)^(.*?{marker})[^ ]*", "$1…")
    preview = F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 1), F.lit("…"))).otherwise(shown)
    return F.struct(F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("hash"), preview.alias("preview"))


def call_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a model call; prices per million tokens."""
    return F.round((input_tokens * price_in + output_tokens * price_out) / 1e6, 6)
