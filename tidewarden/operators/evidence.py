"""Evidence from nested payloads: ordered paths into semi-structured values, one summary for each kind of event."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: kinds of events, and the paths of each field in the order in which they are tried; @ stands for the adapter's own record
KINDS = {
    "contextperception": "context_perception", "context_perception": "context_perception", "memoryrecall": "memory_recall", "memory_recall": "memory_recall", "planning": "planning",
    "reasoning": "reasoning", "intentdetection": "intent_detection", "intent_detection": "intent_detection",
}
FIELDS: dict[str, dict[str, tuple[str, list[str]]]] = {
    "context_perception": {
        "intent": ("text", ["intent", "arguments.intent", "@.context.intent", "@.context.session.intent"]),
        "target": ("text", ["target", "arguments.target", "@.target"]),
        "workspace": ("text", [
            "cwd", "working_directory", "workspace_root", "arguments.cwd", "arguments.working_directory", "arguments.workspace_root",
            "@.context.session.workspace", "@.context.session.working_directory", "@.context.workspace", "@.context.working_directory",
        ]),
        "query": ("text", ["query", "arguments.query", "@.query"]),
    },
    "memory_recall": {
        "query": ("text", ["query", "arguments.query", "@.query"]),
        "memory_type": ("text", ["memory_type", "arguments.memory_type", "@.metadata.memory_type"]),
        "max_results": ("number", ["max_results", "arguments.max_results", "@.metadata.max_results"]),
        "working_directory": ("text", [
            "working_directory", "cwd", "workspace_root", "arguments.working_directory", "arguments.cwd", "arguments.workspace_root",
            "@.context.session.working_directory", "@.context.session.workspace", "@.context.working_directory", "@.context.workspace",
        ]),
    },
    "planning": {"task": ("text", ["task", "arguments.task", "@.task"]), "strategy": ("value", ["strategy", "arguments.strategy", "@.strategy"]), "constraints": ("value", ["constraints", "arguments.constraints", "@.constraints"])},
    "reasoning": {
        "reasoning_type": ("text", ["reasoning_type", "arguments.reasoning_type", "@.reasoning_type"]), "problem_statement": ("text", ["problem_statement", "arguments.problem_statement", "@.problem_statement"]),
        "hints": ("value", ["hints", "arguments.hints", "@.hints"]),
    },
    "intent_detection": {
        "detected_intent": ("text", ["detected_intent", "arguments.detected_intent", "@.detected_intent"]), "target_hints": ("value", ["target_hints", "arguments.target_hints", "@.target_hints"]),
        "language_hint": ("text", ["language_hint", "arguments.language_hint", "@.language_hint"]),
    },
}
SUMMARIES = {"context_perception": "compat_summary", "memory_recall": "compat_summary", "planning": "planning_summary", "reasoning": "reasoning_summary", "intent_detection": "intent_summary"}


def _trimmed(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def _text(v: Column, path: str) -> Column:
    return _trimmed(F.try_variant_get(v, path, "string"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(v: Column, path: str) -> Column:
    """A whole number, or a text of digits; no truth value."""
    digits = F.when(_text(v, path).rlike(r"^\d{1,18}$"), _text(v, path).cast("long"))
    return F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "long")).when(_kind(v, path) == "STRING", digits)


def _compacted(value):
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, dict):
        return {k: x for k, v in value.items() if (x := _compacted(v)) is not None} or None
    if isinstance(value, list):
        return [x for v in value if (x := _compacted(v)) is not None] or None
    return value


@F.pandas_udf(StringType())
def compact_json(values: pd.Series) -> pd.Series:
    """JSON values with texts trimmed and blank texts, nulls and empty containers left out, at any depth; null if nothing is left."""
    out = []
    for v in values:
        kept = None if v is None else _compacted(json.loads(v))
        out.append(None if kept is None else json.dumps(kept, ensure_ascii=False, separators=(",", ":")))
    return pd.Series(out, dtype=object)


def _json(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def event_kind(raw: Column) -> Column:
    """The kind of a raw event type; null for others."""
    low = F.regexp_replace(F.lower(_trimmed(raw)), "^compat:", "")
    out = F.lit(None).cast("string")
    for name, kind in KINDS.items():
        out = F.when(low == name, kind).otherwise(out)
    return out


def compatibility_evidence(events: DataFrame, meta: str = "_meta.compat") -> DataFrame:
    """Add compat_event_type, summary_kind and summary (field -> text, number or JSON value) to events with payload (JSON) and event_subtype.

    Each field is the first of its paths with a value: a text that isn't blank, a whole number, or a JSON value that isn't empty once blanks are taken
    out. meta: where in a payload the adapter keeps its own record of the event. Rows of other kinds, with a payload that is no object, or without any field have nulls.
    The payload is parsed once a row.
    """
    v = F.col("_v")
    root = lambda p: "$." + (f"{meta}{p[1:]}" if p.startswith("@") else p)
    rows = events.withColumn("_v", F.try_parse_json("payload"))
    rows = rows.withColumn("compat_event_type", F.when(_kind(v, "$").startswith("OBJECT"), event_kind(F.coalesce(_text(v, root("@.raw_event_type")), F.col("event_subtype")))))
    first = {"text": lambda ps: F.coalesce(*[_text(v, root(p)) for p in ps]), "number": lambda ps: F.coalesce(*[_number(v, root(p)) for p in ps]).cast("string"), "value": lambda ps: F.coalesce(*[compact_json(_json(v, root(p))) for p in ps])}
    names = {n: how for fields in FIELDS.values() for n, (how, _) in fields.items()}
    values = {}
    for name, how in names.items():
        paths = {k: fields[name][1] for k, fields in FIELDS.items() if name in fields}
        value = F.lit(None).cast("string")
        for kind, ps in paths.items():
            value = F.when(F.col("compat_event_type") == kind, first[how](ps)).otherwise(value)
        values[name] = value
    rows = rows.withColumns({f"_f_{n}": c for n, c in values.items()})
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_f_{n}").alias("value")) for n in names]), lambda x: x["value"].isNotNull())
    rows = rows.withColumn("summary", F.when(F.size(pairs) > 0, F.map_from_entries(pairs)))
    kind = F.when(F.col("summary").isNotNull(), F.col("compat_event_type"))
    rows = rows.withColumn("compat_event_type", kind)
    label = F.lit(None).cast("string")
    for k, name in SUMMARIES.items():
        label = F.when(kind == k, name).otherwise(label)
    return rows.withColumn("summary_kind", label).drop("_v", *[f"_f_{n}" for n in names])


# fixed values: fields of effects that summaries keep
SESSION_EFFECT = ["requested", "mode", "reason_code", "capability_required", "fallback_on_unsupported"]
REWRITE_EFFECT = [
    "requested", "target", "approval_id", "original_hash", "original_preview_redacted", "replacement_hash", "replacement_preview_redacted", "redaction_policy_version", "rewrite_source", "policy_id", "post_rewrite_validation_id",
]
RESULT = "effect_id string, effect_version string, framework string, adapter string, requested array<string>, enforced array<string>, degraded array<string>, unsupported array<string>, degrade_reason string, event_id string, tool_use_id string, session_id string, result_kind string"


def _effects(effects: Column, payload: bool) -> Column:
    inner = ", ".join(f"{f}: string" for f in SESSION_EFFECT)
    rewrite = ", ".join(f"{f}: string" for f in REWRITE_EFFECT + ["replacement_payload"] * payload)
    return F.from_json(effects, f"effect_id string, effect_version string, action_scope string, session_effect struct<{inner}>, rewrite_effect struct<{rewrite}>")


def effect_summary(effects: Column) -> Column:
    """Summary of requested effects (JSON): identity, scope, and the known fields of the session and rewrite effects; no replacement payload. Null for null or no object."""
    e = _effects(effects, False)
    kept = lambda s, names: F.when(e[s].isNotNull(), F.map_filter(F.map_from_arrays(F.lit(names), F.array(*[e[s][n] for n in names])), lambda _, v: v.isNotNull()))
    out = F.struct(e["effect_id"].alias("effect_id"), e["effect_version"].alias("effect_version"), e["action_scope"].alias("action_scope"), kept("session_effect", SESSION_EFFECT).alias("session_effect"), kept("rewrite_effect", REWRITE_EFFECT).alias("rewrite_effect"))
    return F.when(e["effect_id"].isNotNull(), out)


def stored_effects(effects: Column) -> Column:
    """Effects (JSON) as they are stored with a record: without what only the response may carry."""
    return F.when(effects.isNotNull(), F.to_json(_effects(effects, False)))


def result_summary(result: Column) -> Column:
    """Summary of an adapter's result (JSON) as a struct."""
    return F.from_json(result, RESULT)


def compact_summary(summary: Column) -> Column:
    """A review's evidence summary (JSON) as a struct: sources, number of tool calls, budget, and the compacted summary of its kind."""
    v = F.try_parse_json(summary)
    listed = F.try_variant_get(v, "$.retained_sources", "array<string>")
    sources = F.filter(F.transform(listed, _trimmed), lambda x: x.isNotNull())
    number = lambda name: F.when(_kind(v, f"$.{name}") == "BIGINT", F.try_variant_get(v, f"$.{name}", "long"))
    calls = F.when(_kind(v, "$.tool_calls").startswith("ARRAY"), F.size(F.try_variant_get(v, "$.tool_calls", "array<variant>")).cast("long")).otherwise(number("tool_calls_count"))
    cap, left = number("toolkit_budget_cap"), number("toolkit_calls_remaining")
    told = F.when(_kind(v, "$.toolkit_budget_exhausted") == "BOOLEAN", F.try_variant_get(v, "$.toolkit_budget_exhausted", "boolean"))
    kind = event_kind(F.try_variant_get(v, "$.compat_event_type", "string"))
    body = F.lit(None).cast("string")
    for k, name in SUMMARIES.items():
        body = F.when(kind == k, compact_json(_json(v, f"$.{name}"))).otherwise(body)
    body = F.when(body.startswith("{"), body)
    return F.struct(
        F.when(F.size(sources) > 0, sources).alias("retained_sources"), calls.alias("tool_calls_count"), _text(v, "$.toolkit_budget_mode").alias("toolkit_budget_mode"), cap.alias("toolkit_budget_cap"), left.alias("toolkit_calls_remaining"),
        F.coalesce(told, F.when(cap > 0, left <= 0)).alias("toolkit_budget_exhausted"), F.when(body.isNotNull(), kind).alias("compat_event_type"), body.alias("summary"),
    )
