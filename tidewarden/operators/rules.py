"""Attack rules over event tables, and the life of learned rules."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.signals import text


@dataclass(frozen=True)
class Trigger:
    """Which events a rule looks at: every part that is given has to fit. One without parts fits nothing."""

    tools: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()  # shell patterns over the path's last part
    commands: tuple[str, ...] = ()  # expressions over the command
    paths: tuple[str, ...] = ()  # expressions over the path


@dataclass(frozen=True)
class Rule:
    """A rule: its triggers, weighted expressions over the content (else the command), shell patterns of paths that excuse a hit.

    A trigger that is a tuple fits if any of its parts does; ``all_triggers`` tells whether all triggers or any must fit.
    """

    id: str
    category: str
    level: str
    triggers: tuple[Trigger | tuple[Trigger, ...], ...] = ()
    all_triggers: bool = False
    patterns: tuple[tuple[str, int], ...] = ()
    excused: tuple[str, ...] = ()


#: Rules of our own for the event view; a deployment reads its rules with load_rules().
RULES = [
    Rule("view-override", "goal_hijack", "high", (Trigger(tools=("http_request",)),), patterns=((r"\ball previous instructions\b", 9), (r"rules\s+above", 6))),
    Rule("view-comment", "goal_hijack", "medium", (Trigger(tools=("http_request", "read_file")),), patterns=((r"<!--[\s\S]*?\brules\b[\s\S]*?-->", 8),)),
    Rule("stage-upload", "tool_misuse", "critical", (Trigger(tools=("bash",)), Trigger(commands=(r"/stage\.tar\b",))), True, ((r"\bcurl\s+-d\b", 10), (r"https://", 3))),
    Rule("piped-script", "code_execution", "critical", (Trigger(tools=("bash", "shell")),), patterns=((r"\|\s*bash$", 9), (r"\|\s*sh$", 8))),
    Rule("open-permissions", "privilege_abuse", "critical", (Trigger(commands=(r"^sudo ",)),), patterns=((r"\b777\b", 9), (r"^sudo\b", 5))),
    Rule("secret-file", "credential_access", "high", (Trigger(tools=("read_file",)), (Trigger(globs=("id_[rd]sa", ".env*")), Trigger(paths=(r"^/etc/passwd$",)))), True, excused=("/home/*/.ssh/known_hosts",)),
    Rule("profile-write", "persistence", "high", (Trigger(tools=("write_file",), extensions=(".bashrc", ".zshrc")),), excused=("/tmp/*",)),
]

_MOST_TEXT = 102_400


def _trigger(t: dict) -> Trigger:
    names = {"tool_names": "tools", "file_extensions": "extensions", "file_patterns": "globs", "command_patterns": "commands", "path_patterns": "paths"}
    return Trigger(**{names[k]: tuple(v) for k, v in t.items() if k in names})


def parse_rule(r: dict) -> Rule:
    """A rule from its nested form: triggers (plain, or logic with conditions, which may hold an OR list), detection, false_positive_filters."""
    triggers = r.get("triggers") or {}
    if "conditions" in triggers:
        found = tuple(tuple(map(_trigger, c["OR"])) if "OR" in c else _trigger(c) for c in triggers["conditions"])
    else:
        found = (_trigger(triggers),)
    patterns = tuple((p["pattern"], int(p.get("weight", 0))) for p in (r.get("detection") or {}).get("regex_patterns", []))
    excused = tuple(x for f in r.get("false_positive_filters") or [] if f.get("type") == "whitelist_path" for x in f.get("paths", []))
    return Rule(r["id"], r.get("category", ""), r.get("risk_level", "medium"), found, triggers.get("logic", "OR") == "AND", patterns, excused)


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from JSON lines of their nested form: a small table, read through Spark so any store will do."""
    return [parse_rule(json.loads(r.value)) for r in spark.read.text(path).collect()]


def merge_rules(core: list[Rule], learned: list[tuple[Rule, str]]) -> list[Rule]:
    """Core rules and the experimental or stable learned ones; a core id wins."""
    have = {r.id for r in core}
    return core + [r for r, status in learned if status in ("experimental", "stable") and r.id not in have]


def glob_expression(glob: str) -> str:
    """A regular expression for a shell pattern of *, ? and [...] (negated by !)."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        end = glob.find("]", at + 2) if c == "[" else -1
        if end > 0:
            inside = glob[at + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else r"\^" + inside[1:] if inside[0] == "^" else inside) + "]"
            at = end + 1
            continue
        out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return out


def _glob(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike(f"(?s)^(?:{'|'.join(map(glob_expression, globs))})$")


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _fits(t: Trigger | tuple[Trigger, ...], tool: Column, path: Column, command: Column) -> Column:
    if isinstance(t, tuple):
        return _any([_fits(x, tool, path, command) for x in t])
    kinds = []
    if t.tools:
        kinds.append(F.lower(tool).isin([x.lower() for x in t.tools]))
    if t.extensions:
        kinds.append(_any([path.endswith(e) for e in t.extensions]))
    if t.globs:
        kinds.append(_glob(F.substring_index(path, "/", -1), t.globs))
    if t.commands:
        kinds.append(_any([command.rlike(P.rx(p)) for p in t.commands]))
    if t.paths:
        kinds.append(_any([path.rlike(P.rx(p)) for p in t.paths]))
    out = F.lit(bool(kinds))
    for k in kinds:
        out = out & k
    return out


def rule_weight(rule: Rule, tool: Column, path: Column, command: Column, content: Column) -> Column:
    """The heaviest matching expression's weight, 0 for a rule without any, null where the rule doesn't apply.

    Expressions look at the content or, where that is empty, at the command: up to 102 400 characters.
    """
    fits = [_fits(t, tool, path, command) for t in rule.triggers]
    if rule.all_triggers and fits:
        applies = F.lit(True)
        for f in fits:
            applies = applies & f
    else:
        applies = _any(fits)
    body = F.substring(F.when(content != "", content).otherwise(command), 1, _MOST_TEXT)
    weight = F.lit(None).cast("int") if rule.patterns else F.lit(0)
    for pattern, w in sorted(rule.patterns, key=lambda x: x[1]):
        weight = F.when(body.rlike(P.rx(pattern, dot_all=True)), w).otherwise(weight)
    if rule.excused:
        applies = applies & ~_glob(path, rule.excused)
    return F.when(applies, weight)


def match_patterns(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(event_id, session_id, rule_id, category, risk_level, weight): rules compiled to one array of structs, so one pass and no join."""
    rules = RULES if rules is None else rules
    columns = (text("tool_name"), text("path"), text("command"), text("content"))
    found = [
        F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.level).alias("risk_level"), rule_weight(r, *columns).alias("weight"))
        for r in rules
    ]
    return events.select("event_id", "session_id", F.inline(F.array(*found))).where(F.col("weight").isNotNull())


def rule_coverage(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(rule_id, hits, sessions) for every rule that fires."""
    return match_patterns(events, rules).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("session_id").alias("sessions"))


# fixed values: what stands for addresses and paths in a learned expression, and the words and codes of categories in the order in which they are tried
GENERAL = [(r"https?://[^\s\"'|&;]+", "\x01", r"https?://\S+"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "\x02", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), (r"/[\w./-]+", "\x03", r"[\w./-]+")]
CATEGORY_CODES = [("ASI01", "goal_hijack"), ("ASI02", "data_exfiltration"), ("ASI03", "privilege_abuse"), ("ASI04", "supply_chain"), ("ASI05", "code_execution")]
CATEGORY_WORDS = [("data_exfiltration", ("curl", "wget", "nc ", "ncat")), ("privilege_abuse", ("sudo", "chmod", "chown")), ("code_execution", ("eval", "exec", "python -c", "bash -c"))]


def learned_expression(command: Column) -> Column:
    """A command as a regular expression: addresses and paths stand for any of their kind, all else for itself."""
    out = command
    for pattern, mark, _ in GENERAL:
        out = F.regexp_replace(out, pattern, mark)
    out = F.regexp_replace(out, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])", r"\\$1")
    for _, mark, general in GENERAL:
        out = F.replace(out, F.lit(mark), F.lit(general))
    return out


def learned_category(command: Column, reasons: Column | None = None) -> Column:
    """The category of a learned rule: by the first reason with a code, else by words of the command, else unknown."""
    low, out = F.lower(text(command)), F.lit("unknown")
    for name, words in reversed(CATEGORY_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    if reasons is None:
        return out

    def coded(r: Column) -> Column:
        c = F.lit(None).cast("string")
        for code, name in reversed(CATEGORY_CODES):
            c = F.when(r.contains(code), name).otherwise(c)
        return c

    return F.coalesce(F.get(F.filter(F.transform(reasons, coded), lambda c: c.isNotNull()), F.lit(0)), out)


def candidate_patterns(events: DataFrame, reasons: Column | None = None) -> DataFrame:
    """(candidate, rule_id, tool_name, category, pattern, first_event_id, uses): one candidate for each tool and command, of its first event."""
    rows = events.where(F.length(text("command")) > 0)
    key = F.substring(F.sha2(F.concat_ws(":", "tool_name", "command"), 256), 1, 16)
    rows = rows.select("event_id", "tool_name", "command", key.alias("candidate"), (reasons if reasons is not None else F.lit(None).cast("array<string>")).alias("reasons"))
    first = rows.groupBy("candidate", "tool_name", "command").agg(F.min("event_id").alias("first_event_id"), F.count("*").alias("uses"), F.min_by("reasons", "event_id").alias("reasons"))
    rule_id = F.concat(F.lit("EV-"), F.upper(F.substring("candidate", 1, 8)))
    return first.select("candidate", rule_id.alias("rule_id"), "tool_name", learned_category(F.col("command"), F.col("reasons")).alias("category"), learned_expression(F.col("command")).alias("pattern"), "first_event_id", "uses")


def confidence(confirmed: Column, wrong: Column, triggers: Column, frameworks: Column, days: Column) -> Column:
    """0-1: 0.3 share of confirmations, 0.2 frequency, 0.2 spread over frameworks, 0.2 accuracy, 0.1 recency."""
    votes = confirmed + wrong
    share = confirmed / F.greatest(votes, F.lit(1))
    accuracy = 1 - wrong / F.greatest(votes, F.lit(1))
    spread = F.when(frameworks > 0, F.least((frameworks - 1) / 2.0, F.lit(1.0))).otherwise(0.0)
    recency = F.when(days <= 7, 1.0).when(days <= 30, 0.5).otherwise(0.2)
    return 0.3 * share + 0.2 * F.least(triggers / 10.0, F.lit(1.0)) + 0.2 * spread + 0.2 * accuracy + 0.1 * recency


def pattern_lifecycle(feedback: DataFrame, confirms: int = 3, least: float = 0.7, unit: float = 1.0) -> DataFrame:
    """(rule_id, confirmed, false_positives, confidence, status) from a feedback log (rule_id, event_id, confirmed, micros, framework).

    candidate; experimental from the first confirmation; stable from a later confirmation that makes ``confirms`` at a confidence of ``least``
    (of one framework, just seen); deprecated once at least 3 votes are in and more than 0.3 of them are false positives. Each is judged at every
    vote and deprecation is final, so a running window per rule decides. The confidence reported is over all votes, frameworks, and days up to the newest vote.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("rule_id").orderBy("micros", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = feedback.withColumns({"yes": F.count_if("confirmed").over(w), "votes": F.count("*").over(w)})
    no = F.col("votes") - F.col("yes")
    bad = (F.col("votes") >= 3) & (no > 0.3 * F.col("votes"))
    good = F.col("confirmed") & (F.col("yes") >= F.greatest(F.lit(confirms), F.lit(2))) & (confidence(F.col("yes"), no, F.col("votes"), F.lit(1), F.lit(0)) >= least)
    out = rows.withColumns({"bad": bad, "good": good}).groupBy("rule_id").agg(
        F.max("yes").alias("confirmed"), (F.max("votes") - F.max("yes")).alias("false_positives"), F.max("votes").alias("votes"), F.max("bad").alias("bad"), F.max("good").alias("good"),
        F.countDistinct("framework").alias("frameworks"), F.max("micros").alias("last"),
    )
    now = feedback.agg(F.max("micros").alias("now"))
    out = out.crossJoin(F.broadcast(now))  # one row
    days = (F.col("now") - F.col("last")) / (unit * 1e6 * 86_400)
    status = F.when(F.col("bad"), "deprecated").when(F.col("good"), "stable").when(F.col("confirmed") >= 1, "experimental").otherwise("candidate")
    sure = F.round(confidence(F.col("confirmed"), F.col("false_positives"), F.col("votes"), F.col("frameworks"), days), 4)
    return out.select("rule_id", "confirmed", "false_positives", sure.alias("confidence"), status.alias("status"))


#: Review skills: name, priority, hints, tools and words.
SKILLS = [
    ("credential-review", 3, ("credential_access",), ("read_file",), ("id_rsa", ".env", "passwd")),
    ("network-review", 2, ("data_exfiltration",), ("http_request", "bash"), ("curl", "http")),
    ("shell-review", 1, ("shell_execution",), ("bash",), ("sudo", "rm -rf", "chmod")),
]


def route_skills(events: DataFrame, hints: Column | None = None) -> DataFrame:
    """(event_id, skill, score): each risk hint 10, tool 5, each word 1; the best, then the higher priority; nothing fits: general."""
    body, tool = F.lower(F.concat_ws(" ", "command", "path", "content")), F.lower(text("tool_name"))
    told = F.array_distinct(F.transform(F.coalesce(hints, F.array().cast("array<string>")), F.lower)) if hints is not None else None
    scored = []
    for name, priority, known, tools, words in SKILLS:
        score = F.when(tool.isin(list(tools)), 5).otherwise(0)
        if told is not None:
            score = score + 10 * F.size(F.array_intersect(told, F.lit(list(known))))
        for word in words:
            score = score + body.contains(word).cast("int")
        scored.append(F.struct(score.alias("score"), F.lit(priority).alias("priority"), F.lit(name).alias("skill")))
    best = F.array_max(F.array(*scored))
    return events.select("event_id", F.when(best["score"] > 0, best["skill"]).otherwise("general").alias("skill"), best["score"].alias("score"))


def dry_run(events: DataFrame, rules: list[Rule] | None = None, hints: Column | None = None, problem: Column | None = None) -> DataFrame:
    """(event_id, matched, skill, finding): a rule set and the skill routing over a whole table of events, before they are put to use.

    matched: the ids of the rules that fire, sorted; finding: why an event isn't valid (problem, null for valid ones), in which case nothing is matched for
    it. Matching is one projection; only the matches are grouped.
    """
    rows = events.withColumn("_problem", problem if problem is not None else F.lit(None).cast("string"))
    good = rows.where(F.col("_problem").isNull())
    hits = match_patterns(good, rules).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("matched"))
    out = route_skills(good, hints).join(hits, "event_id", "left").select("event_id", F.coalesce("matched", F.lit("")).alias("matched"), "skill", F.lit(None).cast("string").alias("finding"))
    bad = rows.where(F.col("_problem").isNotNull()).select("event_id", F.lit(None).cast("string").alias("matched"), F.lit(None).cast("string").alias("skill"), F.col("_problem").alias("finding"))
    return out.unionByName(bad)
