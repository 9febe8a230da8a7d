"""Raw framework events to one schema, with a quarantine for what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import matches, text

# fixed values: (framework, raw type, event type, subtype)
_HOOKS = [
    ("PreToolUse", "pre_action", None), ("PostToolUse", "post_action", None), ("PrePrompt", "pre_prompt", None), ("GenerateStart", "pre_prompt", None),
    ("PostResponse", "post_response", None), ("Idle", "session", "compat:idle"), ("Heartbeat", "session", "compat:heartbeat"), ("Success", "session", "compat:success"),
    ("RateLimit", "session", "compat:rate_limit"), ("Confirmation", "session", "compat:confirmation"), ("ContextPerception", "session", "compat:context_perception"),
    ("MemoryRecall", "session", "compat:memory_recall"), ("Planning", "session", "compat:planning"), ("Reasoning", "session", "compat:reasoning"),
    ("IntentDetection", "session", "compat:intent_detection"), ("SessionStart", "session", "session:start"), ("SessionEnd", "session", "session:end"), ("OnError", "error", None),
]
_CODEX = [
    ("function_call", "pre_action", None), ("function_call_output", "post_action", None), ("agent_message", "post_response", None), ("session_meta", "session", None),
    ("session_end", "session", None), ("PreToolUse", "pre_action", None), ("PermissionRequest", "pre_action", None), ("PostToolUse", "post_action", None),
    ("UserPromptSubmit", "pre_prompt", None), ("SessionStart", "session", "session:start"), ("Stop", "session", "session:stop"),
]
_GEMINI = [
    ("SessionStart", "session", "session:start"), ("SessionEnd", "session", "session:end"), ("BeforeAgent", "pre_prompt", None), ("AfterAgent", "post_response", None),
    ("BeforeModel", "pre_prompt", None), ("AfterModel", "post_response", None), ("BeforeToolSelection", "pre_prompt", None), ("BeforeTool", "pre_action", None),
    ("AfterTool", "post_action", None), ("PreCompress", "session", "session:pre_compress"), ("Notification", "session", "session:notification"),
]
_KIMI = [
    ("PreToolUse", "pre_action", None), ("PostToolUse", "post_action", None), ("PostToolUseFailure", "post_action", None), ("UserPromptSubmit", "pre_prompt", None),
    ("Stop", "session", "session:stop"), ("StopFailure", "error", "session:stop_failure"), ("SessionStart", "session", "session:start"), ("SessionEnd", "session", "session:end"),
    ("SubagentStart", "session", "session:subagent_start"), ("SubagentStop", "session", "session:subagent_stop"), ("PreCompact", "session", "session:pre_compact"),
    ("PostCompact", "session", "session:post_compact"), ("Notification", "session", "session:notification"),
]
_OPENCLAW = [
    ("message:received", "pre_prompt", "oc-message-received"), ("message:transcribed", "pre_prompt", "oc-message-transcribed"), ("message:preprocessed", "pre_prompt", "oc-message-preprocessed"),
    ("message:sent", "post_response", "oc-message-sent"), ("exec.approval.requested", "pre_action", "oc-exec-approval-requested"), ("exec.approval.resolved", "post_action", "oc-exec-approval-resolved"),
    ("session:compact:before", "session", "oc-session-compact-before"), ("session:compact:after", "session", "oc-session-compact-after"), ("command:new", "session", "oc-command-new"),
    ("command:reset", "session", "oc-command-reset"), ("command:stop", "session", "oc-command-stop"), ("agent:bootstrap", "session", "oc-agent-bootstrap"), ("gateway:startup", "session", "oc-gateway-startup"),
    ("chat:delta", "post_response", "oc-chat-delta"), ("chat:final", "post_response", "oc-chat-final"), ("chat:aborted", "error", "oc-chat-aborted"), ("chat:error", "error", "oc-chat-error"),
]
SHELL_ALIASES = ["run_shell_command", "shell", "execute_command", "terminal", "Bash", "Shell"]


def mapping(spark: SparkSession) -> DataFrame:
    """(source_framework, raw_type, event_type, subtype): about a hundred fixed rows."""
    sets = {"claude-code": _HOOKS, "a3s-code": _HOOKS, "codex": _CODEX, "gemini-cli": _GEMINI, "kimi-cli": _KIMI, "openclaw": _OPENCLAW}
    rows = [(f, *row) for f, listed in sets.items() for row in listed]
    return spark.createDataFrame(rows, "source_framework string, raw_type string, event_type string, subtype string")


def normalize_events(raw: DataFrame) -> DataFrame:
    """Add event_type and subtype by framework and raw type, session and agent sentinels, missing_fields and shell aliases.

    raw: source_framework, raw_type, session_id, agent_id, tool_name, response_text; unmapped rows have a null event_type
    (see quarantine). A post_action that carries a response text becomes a post_response. The mapping is broadcast: fixed size.
    """
    rows = raw.join(F.broadcast(mapping(raw.sparkSession)), ["source_framework", "raw_type"], "left")
    kind = F.when((F.col("event_type") == "post_action") & (text("response_text") != ""), "post_response").otherwise(F.col("event_type"))
    missing = F.array_compact(F.array(F.when(F.col("session_id").isNull(), "session_id"), F.when(F.col("agent_id").isNull(), "agent_id")))
    return rows.withColumns({
        "event_type": kind, "missing_fields": missing,
        "session_id": F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("unknown_session:"), "source_framework")),
        "agent_id": F.coalesce(F.col("agent_id").cast("string"), F.concat(F.lit("unknown_agent:"), "source_framework")),
        "tool_name": F.when(F.col("tool_name").isin(SHELL_ALIASES), "bash").otherwise(F.col("tool_name")),
    })


def event_key(framework: Column, session: Column, subtype: Column, at: Column, payload: Column, approval: Column, run: Column, seq: Column) -> Column:
    """Stable id: the approval's, else run and sequence number, else 24 hex digits of a hash."""
    digest = F.substring(F.sha2(text(payload), 256), 1, 16)
    hashed = F.substring(F.sha2(F.concat_ws(":", text(framework), text(session), text(subtype), text(at), digest), 256), 1, 24)
    return F.coalesce(approval, F.when(run.isNotNull() & seq.isNotNull(), F.concat_ws(":", run, seq.cast("string"))), hashed)


def origin_of(tool: Column, path: Column, command: Column) -> Column:
    """external, user or unknown."""
    tool = F.lower(text(tool))
    temp = text(path).startswith("/tmp/") | text(path).startswith("/var/tmp/")
    fetches = matches(command, r"\bcurl\b|\bwget\b|https?://")
    return (
        F.when(tool.isin("http_request", "web_fetch", "fetch", "web_search", "mcp__fetch__fetch"), "external")
        .when(tool.isin("read_file", "write_file", "edit_file", "grep", "glob", "read", "write", "edit"), F.when(temp, "external").otherwise("user"))
        .when(tool.isin("bash", "shell", "terminal", "command", "exec"), F.when(fetches, "external").otherwise("user")).otherwise("unknown")
    )


def risk_hints(tool: Column, command: Column) -> Column:
    """shell_execution and destructive_pattern, where they hold."""
    shell = F.lower(text(tool)).isin("bash", "shell", "terminal", "command", "exec")
    return F.array_compact(F.array(F.when(shell, "shell_execution"), F.when(matches(command, r"rm\s+-rf|sudo|chmod\s+777|mkfs|dd\s+if="), "destructive_pattern")))


def chat_invalid(raw_type: Column, run: Column, seq: Column) -> Column:
    """Whether a chat event lacks its run id or sequence number, and so belongs into the quarantine."""
    return (F.substring_index(text(raw_type), ":", 1) == "chat") & (run.isNull() | seq.isNull())


def trace_id(run: Column, approval: Column, given: Column) -> Column:
    """The run's id, else the approval's, else the given one, else a random one."""
    filled = [F.when(text(c) != "", c) for c in (run, approval, given)]
    return F.coalesce(*filled, F.uuid())


#: Payload keys that stand for an output, first to last.
OUTPUT_KEYS = ["toolOutput", "tool_output", "commandOutput", "command_output", "exitOutput", "stdout"]


def output_of(event_type: Column, payload: Column) -> Column:
    """The output in a payload map: its own key, or for actions done without output and result the first alias that is there."""
    own = F.element_at(payload, "output")
    alias = F.coalesce(*[F.element_at(payload, k) for k in OUTPUT_KEYS])
    bare = (event_type == "post_action") & ~F.map_contains_key(payload, "output") & ~F.map_contains_key(payload, "result")
    return F.when(bare, alias).otherwise(own)


def framework_of(given: Column, adapter: Column, adapters: dict[str, str]) -> Column:
    """The given framework, or where it is empty or unknown that of the calling adapter, else unknown."""
    low = F.lower(F.trim(text(adapter)))
    found = F.lit("unknown")
    for name, framework in adapters.items():
        found = F.when(low == name, framework).otherwise(found)
    explicit = F.trim(text(given))
    return F.when((explicit != "") & (F.lower(explicit) != "unknown"), explicit).otherwise(found)
