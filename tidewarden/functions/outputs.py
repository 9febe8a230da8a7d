"""Findings in tool outputs as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import patterns as P
from .signals import matches, normalized, text

TIERS = ["log_only", "monitor", "escalate", "emergency"]


#: Lower-case literals of which a text must hold one for a pattern of an output to be found in it, list by list in the order of the patterns.
_NEEDS = dict(
    zip(
        [*P.INSTRUCTIONAL, *P.EXFILTRATION, *P.SECRETS, *P.DECODE_PIPE_EXEC, *P.OBFUSCATION_EXACT, *P.OBFUSCATION_ANY_CASE],
        [
            ["must", "should", "need to"], ["do not", "don't", "never"], ["step "], ["now", "next", "instead"],
            ["curl"], ["wget"], ["nslookup"], ["aws"], ["ping"], ["ssh"], ["mail"], ["torsocks"], ["](http"], ["git"],
            ["aws_"], ["ghp_", "ghs_", "ghu_", "github_pat_"], ["-----begin"], ["passw"], ["key", "token"], ["bearer"], ["database_url"], ["openai_api_key"], ["akia"], ["xox"], ["access_token"], ["0x"],
            ["base64"], ["xxd"], ["printf"], ["$'"], ["$'"], ["[::-1]"], ["\\x"],
        ],
        strict=True,
    )
) | {
    P.EVAL_DECODE: ["eval"], P.SCRIPT_ENCODED_EXEC: ["python", "perl", "ruby"], P.PROCESS_SUB_REMOTE: ["<("], P.HEREDOC_EXEC: ["<<"], P.VARIABLE_EXPANSION: ["$"], P.VARIABLE_EXEC_TRIGGER: ["$"],
    P.REMOTE_PIPE_EXEC: ["curl", "wget"],
}


def plain(c: Column) -> Column:
    """The scanned text: at most 64 K characters, normalised."""
    return normalized(F.substring(text(c), 1, 65536))


def found(c: Column, pattern: str, low: Column | None = None, ignore_case: bool = True) -> Column:
    """Whether a pattern is found; low: the text in lower case. Few texts hold the literals that a pattern needs, and only those are searched by it."""
    low = F.lower(c) if low is None else low
    some = F.lit(False)
    for literal in _NEEDS[pattern]:
        some = some | low.contains(literal)
    return some & matches(c, pattern, ignore_case)


def _count(c: Column, patterns: list[str], low: Column | None, ignore_case: bool = True) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + found(c, p, low, ignore_case).cast("int")
    return total


def instructional(c: Column, low: Column | None = None) -> Column:
    return _count(c, P.INSTRUCTIONAL, low) / 4.0


def exfiltration(c: Column, low: Column | None = None) -> Column:
    return F.least(_count(c, P.EXFILTRATION, low) * 0.5, F.lit(1.0))


def secret_exposure(c: Column, low: Column | None = None) -> Column:
    return F.least(_count(c, P.SECRETS, low) * 0.5, F.lit(1.0))


def severe_secret(c: Column, low: Column | None = None) -> Column:
    return _count(c, P.HIGH_SECRETS, low) > 0


@F.pandas_udf(DoubleType())
def _bits(texts: pd.Series) -> pd.Series:
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        if t:
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            counts = np.bincount(points) if points.max() < 4096 else np.unique(points, return_counts=True)[1]
            counts = counts[counts > 0].astype(float)
            out[k] = np.log2(len(points)) - (counts * np.log2(counts)).sum() / len(points)
    return pd.Series(out)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters in bits, over the whole text.

    One count a text in Arrow batches: built-in functions need a pass a distinct character, or an object a character, and measured more than ten times as long.
    """
    return _bits(text(c))


def safe_pipe(c: Column) -> Column:
    """Exactly one URL, of a known installer's domain."""
    urls = F.regexp_extract_all(text(c), F.lit(r"https?://[^\s|]+"), F.lit(0))
    host = F.regexp_extract(F.get(urls, F.lit(0)), r"^https?://([^/?#:]*)", 1)
    known = F.lit(False)
    for d in P.SAFE_PIPE_DOMAINS:
        known = known | (host == d) | host.endswith("." + d)
    return (F.size(urls) == 1) & known


#: Bits a character that hidden code has.
BITS = 5.5


def obfuscation(c: Column, measured: Column | None = None, low: Column | None = None) -> Column:
    """Hidden code, 0-1: 0.3 a hit, and an entropy term where a measured entropy is given."""
    decoded = F.lit(False)
    for p in P.DECODE_PIPE_EXEC:
        decoded = decoded | found(c, p, low)
    hits = (
        decoded.cast("int") + _count(c, [P.EVAL_DECODE, P.SCRIPT_ENCODED_EXEC, P.PROCESS_SUB_REMOTE, P.HEREDOC_EXEC], low)
        + _count(c, [P.VARIABLE_EXPANSION, P.VARIABLE_EXEC_TRIGGER, *P.OBFUSCATION_EXACT], low, ignore_case=False) + _count(c, P.OBFUSCATION_ANY_CASE, low)
        + (found(c, P.REMOTE_PIPE_EXEC, low) & ~safe_pipe(c)).cast("int")
    )
    extra = F.lit(0.0)
    if measured is not None:
        extra = F.when((F.length(c) > 50) & (measured > BITS), F.least((measured - BITS) / 2.5, F.lit(0.5))).otherwise(0.0)
    return F.least(hits * 0.3 + extra, F.lit(1.0))


def redacted(c: Column) -> Column:
    """The whole text with secrets replaced."""
    return F.regexp_replace(text(c), P.rx(P.REDACT), "[REDACTED]")


def compact(c: Column, most: int = 160) -> Column:
    """A text on one line with single spaces and secrets replaced, cut with a mark beyond ``most`` characters; null for one without words."""
    one = F.regexp_replace(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")), P.rx(P.REDACT), "[REDACTED]")
    cut = F.concat(F.regexp_replace(F.substring(one, 1, most - 14), r"(?U)\s+$", ""), F.lit("...[truncated]"))
    return F.when(one != "", F.when(F.length(one) > most, cut).otherwise(one))
