"""Risk dimensions, composite score, level and verdict of an event as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .signals import any_found, count_found, dangerous_command, found, holds, invisible, lowered, matches, normalized, text


@dataclass(frozen=True)
class Thresholds:
    """Weights and thresholds of the composite score."""

    weight_max: float = 0.4
    weight_d4: float = 0.25
    weight_d5: float = 0.15
    injection: float = 0.5
    medium: float = 0.8
    high: float = 1.5
    critical: float = 2.2


#: Threshold sets by name.
PRESETS = {"low": Thresholds(medium=1.2, high=1.9, critical=2.6), "medium": Thresholds(), "high": Thresholds(medium=0.6, high=1.2, critical=1.8), "strict": Thresholds(medium=0.5, high=1.0, critical=1.5)}


def risk_rank(level: Column) -> Column:
    """low 0, medium 1, high 2, critical 3; anything else 0."""
    return F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def level_of_rank(rank: Column) -> Column:
    return F.get(F.lit(P.LEVELS), rank)


def d1(tool: Column, command: Column, danger: Column | None = None, low: Column | None = None) -> Column:
    """Danger of the tool, 0-3; the order of the rules matters. danger, low: columns of dangerous_command and lowered of the command."""
    tool = F.lower(text(tool))
    low = lowered(command) if low is None else low
    danger = dangerous_command(command, low) if danger is None else danger
    shell = F.when(danger | found(command, P.SYSTEM_PATH, low, ignore_case=False), 3).otherwise(2)
    return (
        F.when(tool == "", 2).when(tool.isin(P.READ_ONLY_TOOLS), 0).when(tool.isin(P.LIMITED_WRITE_TOOLS), 1).when(tool.isin(P.HIGH_DANGER_TOOLS), 3)
        .when(tool.isin(P.SHELL_TOOLS), shell).when(tool.isin(P.SYSTEM_TOOLS), 2).when(tool.isin(P.DANGEROUS_TOOLS), 3).otherwise(2)
    )


def paths_of(path: Column, command: Column) -> Column:
    """The path and the command's words that look like paths."""
    words = F.filter(F.split(text(command), r"\s+"), lambda w: w.startswith("/") | w.startswith("~") | (w.contains("/") & ~w.startswith("-")))
    return F.concat(F.filter(F.array(text(path)), lambda p: p != ""), words)


# fixed values: the keys of a payload that name paths
PATH_KEYS = ["path", "file_path", "file", "target", "destination", "source"]


def payload_paths(payload: Column) -> Column:
    """The paths of a payload (JSON): its texts under six keys, then the words of its command that look like paths."""
    v = F.try_parse_json(payload)
    named = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in PATH_KEYS]
    return F.concat(F.filter(F.array_compact(F.array(*named)), lambda p: p != ""), paths_of(F.lit(None), F.try_variant_get(v, "$.command", "string")))


def path_lines(path: Column, command: Column) -> Column:
    """The path and the command's words that look like paths (see paths_of), a line each."""
    words = F.regexp_replace(F.concat(F.regexp_replace(text(command), r"\s+", "\n"), F.lit("\n")), r"(?m)^(?![/~]|(?!-)[^\n]*/)[^\n]*\n", "")
    words = F.when(text(command).contains("/") | text(command).contains("~"), words).otherwise("")
    return F.concat(F.when(text(path) != "", F.concat(F.regexp_replace(text(path), r"\n", " "), F.lit("\n"))).otherwise(""), words)


def d2(path: Column, command: Column, lines: Column | None = None, low: Column | None = None) -> Column:
    """Sensitivity of the paths, 0-3: system 3, else configuration 1, else credentials 2; no path 1.

    The paths stand in lines, so that each level is one expression over all of them. lines, low: columns of path_lines, so that they are made once and
    not for each level, and of lowered(lines).
    """
    lines = path_lines(path, command) if lines is None else lines
    low = lowered(lines) if low is None else low
    level = lambda pattern, ignore_case=True: holds(low, P.LINE_NEEDS[pattern]) & matches(lines, pattern, ignore_case)
    return F.when(lines == "", 1).when(level(P.SYSTEM_LINE, False), 3).when(level(P.SECRET_LINE), 2).when(level(P.CONFIG_LINE), 1).otherwise(0)


def d3(tool: Column, command: Column, danger: Column | None = None, low: Column | None = None) -> Column:
    """Danger of the command, 0-3, for shell tools. danger, low: columns of dangerous_command and lowered of the command."""
    command = text(command)
    low = lowered(command) if low is None else low
    danger = dangerous_command(command, low) if danger is None else danger
    first = F.regexp_extract(command, r"^\s*(?:\S*/)?([^\s/]*)", 1)
    word = lambda words: [rf"\b{w}\b" for w in words]
    destructive = any_found(command, [*word(P.DESTRUCTIVE_WORDS), *P.DESTRUCTIVE_PHRASES], low, ignore_case=False) | any_found(command, P.DESTRUCTIVE_PATTERNS, low)
    writes = any_found(command, [*word(P.WRITE_WORDS), *P.WRITE_PHRASES], low, ignore_case=False)
    return (
        F.when(~F.lower(text(tool)).isin([*P.SHELL_TOOLS, "exec"]), 0).when(F.trim(command) == "", 2).when(danger, 3)
        .when(first.isin(P.SAFE_COMMANDS), 0).when(destructive, 2).when(writes, 1).otherwise(2)
    )


def d5(trust: Column) -> Column:
    """Distrust of the agent: privileged and elevated 0, standard 1, else 2."""
    return F.when(trust.isin("privileged", "elevated"), 0).when(trust == "standard", 1).otherwise(2)


def scanned(content: Column) -> Column:
    """The part of a text that counts: 65 536 characters."""
    return F.substring(text(content), 1, 65536)


def weak_hits(plain: Column, low: Column | None = None) -> Column:
    """low: a column of lowered(plain)."""
    return count_found(plain, P.WEAK_INJECTION, lowered(plain) if low is None else low)


def strong_hits(plain: Column, low: Column | None = None) -> Column:
    """low: a column of lowered(plain)."""
    return count_found(plain, P.STRONG_INJECTION, lowered(plain) if low is None else low, dot_all=True)


def d6(content: Column | None, tool: Column | None = None, origin: Column | None = None, boost: float = 0.0, plain: Column | None = None, hits: tuple[Column, Column] | None = None, hidden: Column | None = None) -> Column:
    """Injection score of a text, 0-3: invisible characters, weak, strong and tool-specific patterns, external boost.

    plain: a column that already holds normalized(scanned(content)), so that it is made once and not for each pattern; hits: columns of weak_hits
    and strong_hits of it; hidden: one of invisible(scanned(content)). With plain and hidden, content is not read.
    """
    plain = normalized(scanned(content)) if plain is None else plain
    hidden = invisible(scanned(content)) if hidden is None else hidden
    weak, strong = hits or (weak_hits(plain), strong_hits(plain))
    score = (
        F.least(hidden * 0.8, F.lit(2.4))
        + F.least(weak * 0.3, F.lit(1.5)) + F.least(strong * 0.8, F.lit(2.4))
    )
    if tool is not None:
        reads = (plain.contains("<!--") & matches(plain, r"<!--\s*IMPORTANT.*?-->", dot_all=True)).cast("int") + (plain.contains("](http") & matches(plain, r"!\[.*?\]\(https?://[^)]+\?[^)]+\)", ignore_case=False)).cast("int")
        fetches = (plain.contains("<") & matches(plain, r"<script>.*?fetch\(", dot_all=True)).cast("int") + (plain.contains(":") & matches(plain, r"font-size:\s*0")).cast("int")
        score = score + F.when(tool == "read_file", reads * 0.5).when(tool == "http_request", fetches * 0.5).otherwise(0.0)
    if origin is not None and boost > 0:
        score = score + F.when(origin == "external", boost).otherwise(0.0)
    return F.least(score, F.lit(3.0))


def canary_leak(content: Column, token: Column) -> Column:
    """1.5 for the full token, 1.0 for its core (the part between the first and last dash)."""
    core = F.regexp_extract(token, r"^[^-]*-(.*)-[^-]*$", 1)
    return F.when(F.contains(content, token), 1.5).when((core != "") & F.contains(content, core), 1.0).otherwise(0.0)


def vector_score(similarity: Column, least: float = 0.75) -> Column:
    return F.when(similarity <= least, 0.0).otherwise(F.least(2.0 * (similarity - least) / (1 - least), F.lit(2.0)))


def short_circuit(a: Column, b: Column, c: Column) -> Column:
    return F.when((a == 3) & (b >= 2), "SC-1").when(c == 3, "SC-2").when((a == 0) & (b == 0) & (c == 0), "SC-3")


def composite(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, t: Thresholds = Thresholds()) -> Column:
    base = t.weight_max * F.greatest(a, b, c) + t.weight_d4 * d + t.weight_d5 * e
    return F.round(base * (1.0 + t.injection * f / 3.0), 4)


def level(score: Column, rule: Column, injection: Column, t: Thresholds = Thresholds()) -> Column:
    """Short circuits decide first; a strong injection score lifts low to medium."""
    by_score = F.when(score >= t.critical, "critical").when(score >= t.high, "high").when(score >= t.medium, "medium").otherwise("low")
    found = F.when(rule.isin("SC-1", "SC-2"), "critical").when(rule == "SC-3", "low").otherwise(by_score)
    return F.when((injection >= 2.0) & (found == "low"), "medium").otherwise(found)


def verdict(event_type: Column, risk: Column) -> Column:
    """Only actions about to run are blocked, at high or critical."""
    return F.when((event_type == "pre_action") & risk.isin("high", "critical"), "block").otherwise("allow")


def fallback_verdict(event_type: Column, tool: Column, command: Column) -> Column:
    """Without a scorer: dangerous actions block, other actions defer, the rest is allowed."""
    risky = F.lower(text(tool)).isin(P.DANGEROUS_TOOLS) & dangerous_command(command)
    return F.when((event_type == "pre_action") & risky, "block").when(event_type == "pre_action", "defer").otherwise("allow")


# fixed values: what a verdict says first, by level
REASONS = {"critical": "Critical risk: action blocked", "high": "High risk: action blocked", "medium": "Medium risk: allowed with audit", "low": "Low risk: safe operation"}


def reason(etype: Column, level: Column, dims: list[Column], score: Column, rule: Column, tool: Column) -> Column:
    """Why a verdict was given: for actions the level, the six dimensions, the score, a short circuit and the tool; a fixed text for other types. dims: d1 to d6."""
    first = F.lit(REASONS["low"])
    for name, said in REASONS.items():
        first = F.when(level == name, said).otherwise(first)
    told = F.format_string("D1=%d D2=%d D3=%d D4=%d D5=%d D6=%.2f", *[d.cast("int") for d in dims[:5]], dims[5].cast("double"))
    given = lambda name, c: F.when(text(c) != "", F.concat(F.lit(name + "="), text(c)))
    built = F.concat_ws(" | ", first, told, F.format_string("score=%.4f", score.cast("double")), given("short_circuit", rule), given("tool", tool))
    watched = F.concat(F.lit("Non-blocking event type '"), etype, F.lit("': observation only"))
    return F.when(etype.isin("post_action", "post_response", "error", "session"), watched).when(etype == "pre_prompt", "Pre-prompt events are fail-open to avoid blocking user input").otherwise(built)
