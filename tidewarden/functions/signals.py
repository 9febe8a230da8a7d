"""Boolean signals of commands, paths and tools as Column expressions."""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def text(c: Column | str) -> Column:
    """A column as text, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


@functools.cache
def _folded() -> tuple[str, str, dict[str, str], str]:
    """Characters whose compatibility form without marks is one other character, these forms, the longer forms of the rest,
    and an expression for the latter.

    Marks have an empty form, so that translate() drops them; the emoji selector U+FE0F stays.
    """
    one, to, longer, dropped = [], [], {}, []
    for block in (range(0x80, 0xD800), range(0xE000, 0x110000)):
        for c in map(chr, block):
            if not unicodedata.decomposition(c) and unicodedata.category(c) != "Mn":
                continue
            plain = "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c)) if unicodedata.category(x) != "Mn" or x == "\uFE0F")
            plain = unicodedata.normalize("NFC", plain)
            if plain == "":
                dropped.append(c)
            elif len(plain) == 1 and plain != c:
                one.append(c)
                to.append(plain)
            elif plain != c:
                longer[c] = plain
    points = sorted(map(ord, longer))
    starts = [x for k, x in enumerate(points) if not k or points[k - 1] != x - 1]
    ends = [x for k, x in enumerate(points) if k + 1 == len(points) or points[k + 1] != x + 1]
    several = "[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in zip(starts, ends, strict=True)) + "]"
    return "".join(one + dropped), "".join(to), longer, several


def normalized(c: Column) -> Column:
    """Text with compatibility forms folded (full-width letters, ligatures), without accents, marks and invisible characters.

    ASCII texts pass as they are. Forms of one character are translated in one pass; texts that hold a character with a longer form are
    mapped character by character. Conjoining Hangul letters aren't composed.
    """
    one, to, longer, several = _folded()
    spelled = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")  # one constant
    wide = F.array_join(F.transform(F.split(c, ""), lambda x: F.when((x > "\x7f") & x.rlike(several), F.element_at(spelled, x)).otherwise(x)), "")
    folded = F.translate(F.when(F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(several), wide).otherwise(c), one, to)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.when(invisible(c) > 0, F.regexp_replace(folded, P.INVISIBLE, "")).otherwise(folded))


def invisible(c: Column) -> Column:
    """How many characters show nothing; the many low characters, none of them one, are left out by a short expression first."""
    return F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.regexp_count(F.regexp_replace(c, P.VISIBLE, ""), F.lit(P.INVISIBLE)))


def lowered(c: Column) -> Column:
    """Text in lower case, with the four letters that expressions without case take for ASCII ones as these."""
    return F.lower(F.when(F.octet_length(text(c)) == F.length(text(c)), text(c)).otherwise(F.translate(text(c), "\u017f\u212a\u0130\u0131", "skii")))


def matches(c: Column, pattern: str, ignore_case: bool = True, dot_all: bool = False) -> Column:
    return text(c).rlike(P.rx(pattern, ignore_case, dot_all))


def any_of(c: Column, patterns: list[str], ignore_case: bool = True, dot_all: bool = False) -> Column:
    """Whether any pattern is found; one expression, so the text is scanned once."""
    return matches(c, "|".join(f"(?:{p})" for p in patterns), ignore_case, dot_all)


def count_of(c: Column, patterns: list[str], ignore_case: bool = True, dot_all: bool = False) -> Column:
    """How many of the patterns are found."""
    total = F.lit(0)
    for p in patterns:
        total = total + matches(c, p, ignore_case, dot_all).cast("int")
    return total


def holds(low: Column, needs: list[list[str]]) -> Column:
    """Whether a text in lower case holds one literal of each list."""
    return functools.reduce(lambda a, b: a & b, [functools.reduce(lambda a, b: a | b, [low.contains(x) for x in literals]) for literals in needs])


def found(c: Column, pattern: str, low: Column, ignore_case: bool = True, dot_all: bool = False) -> Column:
    """matches(), for patterns with needed literals: only texts that hold these are searched. low: a column of lowered(c)."""
    return holds(low, P.NEEDS[pattern]) & matches(c, P.ONE_PASS.get(pattern, pattern), ignore_case, dot_all)


def any_found(c: Column, patterns: list[str], low: Column, ignore_case: bool = True, dot_all: bool = False) -> Column:
    """Whether any pattern is found."""
    return functools.reduce(lambda a, b: a | b, [found(c, p, low, ignore_case, dot_all) for p in patterns])


def count_found(c: Column, patterns: list[str], low: Column, ignore_case: bool = True, dot_all: bool = False) -> Column:
    """How many of the patterns are found; those that need other letters than ASCII are left out for ASCII texts."""
    count = lambda some: functools.reduce(lambda a, b: a + b, [found(c, p, low, ignore_case, dot_all).cast("int") for p in some], F.lit(0))
    wide = [p for p in patterns if any(not x.isascii() for literals in P.NEEDS[p] for x in literals)]
    return count([p for p in patterns if p not in wide]) + F.when(F.octet_length(low) == F.length(low), 0).otherwise(count(wide))


def has_token(c: Column, tokens: list[str]) -> Column:
    low = F.lower(text(c))
    out = F.lit(False)
    for t in tokens:
        out = out | low.contains(t)
    return out


def starts_command(c: Column, tokens: list[str]) -> Column:
    """A token that isn't the tail of a longer word."""
    literal = "|".join(t.replace(".", r"\.") for t in tokens)
    return text(c).rlike(rf"(?<![a-z0-9_-])(?:{literal})")


def dangerous_command(command: Column, low: Column | None = None) -> Column:
    """A command with a high-danger pattern. low: a column of lowered(command)."""
    low = lowered(command) if low is None else low
    return (
        any_found(command, [P.REMOTE_PIPE_EXEC, P.PROCESS_SUB_REMOTE, *P.HIGH_DANGER_ANY_CASE], low)
        | any_found(command, P.HIGH_DANGER_EXACT, low, ignore_case=False)
    )


def dangerous_execution(command: Column) -> Column:
    """Remote, decoded or assembled code that is executed."""
    return any_of(command, [P.REMOTE_PIPE_EXEC, *P.DECODE_PIPE_EXEC, P.EVAL_DECODE, P.SCRIPT_ENCODED_EXEC, P.PROCESS_SUB_REMOTE, P.HEREDOC_EXEC]) | any_of(
        command, [P.VARIABLE_EXPANSION, P.VARIABLE_EXEC_TRIGGER], ignore_case=False
    )


def base_signals(tool: Column, path: Column, payload: Column, command: Column, hints: Column | None = None) -> dict[str, Column]:
    """Eight activity flags of one event; an empty command falls back to the payload."""
    tool = F.lower(text(tool))
    command = F.when(F.length(text(command)) > 0, text(command)).otherwise(text(payload))
    combined = F.concat_ws(" ", text(path), text(payload), command)
    low = F.lower(combined)
    hints = F.transform(F.coalesce(hints, F.array().cast("array<string>")), F.lower) if hints is not None else F.array().cast("array<string>")
    read, write = tool.isin(P.READ_TOOLS), tool.isin(P.WRITE_TOOLS)
    executes = tool.isin(P.EXEC_TOOLS) | low.contains("chmod") | low.contains("install ")
    return {
        "credential_access": F.arrays_overlap(hints, F.lit(P.CREDENTIAL_HINTS)) | (read & matches(combined, P.CREDENTIAL_PATH)),
        "network_activity": tool.isin(P.NETWORK_TOOLS) | F.arrays_overlap(hints, F.lit(P.NETWORK_HINTS)) | matches(combined, P.NETWORK_COMMAND),
        "read_action": read,
        "write_action": write,
        "exec_action": executes,
        "sudo_action": (tool == "sudo") | low.contains("sudo "),
        "tmp_path_touched": matches(combined, P.TEMP_PATH),
        "recon_action": (read | executes) & matches(combined, P.RECON),
    }


def archive_signals(tool: Column, payload: Column, command: Column) -> dict[str, Column]:
    """Archive creation, of sensitive material, restoring and inspection."""
    command = F.when(F.length(text(command)) > 0, text(command)).otherwise(text(payload))
    restore, inspect = starts_command(command, P.RESTORE_TOKENS), starts_command(command, P.INSPECTION_TOKENS)
    makes = F.lower(text(tool)).isin(P.EXEC_TOOLS) & starts_command(command, P.ARCHIVE_TOKENS) & ~restore & ~inspect
    sensitive = makes & matches(F.concat_ws(" ", text(payload), command), P.CREDENTIAL_PATH)
    return {"archive_action": makes, "archive_sensitive_material": sensitive, "archive_restore_action": restore, "archive_inspection_action": inspect}


def command_head(command: Column) -> Column:
    """The command without leading assignments and wrapper words, and out of two levels of ``bash -c``."""
    out = F.trim(text(command))
    for _ in range(2):
        out = F.regexp_replace(out, r"^(?:(?:[A-Za-z_]\w*=\S*|env|command|nohup|time|nice|exec)\s+)+", "")
        out = F.regexp_replace(out, r"^(?:/\S*/)?(?:ba|z|da|k)?sh\s+-l?c\s+(['\"])(.*)\1\s*$", "$2")
    return out
