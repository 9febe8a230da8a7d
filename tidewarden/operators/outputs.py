"""Analysis of tool outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outputs as O
from ..functions.signals import text


def analyze_outputs(rows: DataFrame, multiplier: float = 1.3, allowed_paths: str | None = None, emergency: float = 0.9, escalate: float = 0.6, monitor: float = 0.3, with_entropy: bool = True) -> DataFrame:
    """Add the four detector scores, their combined score, a tier and patterns_matched to rows (output, origin, file_path).

    The tier is the higher of the score's and a floor: exfiltration and secrets escalate at least, severe secrets and
    obfuscation beside either are an emergency. Paths that fit ``allowed_paths`` are logged only. One projection; texts count up
    to 64 K characters.
    """
    rows = rows.withColumn("_body", O.plain(F.col("output")))
    body = F.col("_body")
    rows = rows.withColumn("_low", F.lower(body))
    if with_entropy:
        rows = rows.withColumn("_bits", O.entropy(F.when(F.length(body) > 50, body)))
    low, measured = F.col("_low"), F.col("_bits") if with_entropy else None
    # one projection each, as the compiled code of all in one would be too long for the just-in-time compiler
    nothing = F.spark_partition_id() * 0
    steps = {"instructional": O.instructional(body, low), "exfiltration": O.exfiltration(body, low), "secret_exposure": O.secret_exposure(body, low), "obfuscation": O.obfuscation(body, measured, low)}
    for name, column in steps.items():
        rows = rows.select("*", (column + nothing).alias(name))
    rows = rows.withColumn("_severe", F.when(F.col("secret_exposure") > 0, O.severe_secret(body, low)).otherwise(False))
    some = lambda c, least: F.when(F.col(c) > least, F.col(c)).otherwise(0.0)
    total = some("instructional", 0.5) + F.col("exfiltration") + F.col("secret_exposure") + some("obfuscation", 0.1)
    combined = F.least(F.least(total, F.lit(3.0)) * F.when(F.col("origin") == "external", multiplier).otherwise(1.0), F.lit(3.0))
    allowed = text("file_path").rlike(allowed_paths) if allowed_paths else F.lit(False)
    rows = rows.withColumn("_raw", F.when(allowed, 0.0).otherwise(combined)).withColumn("score", F.round("_raw", 3))
    leaks = (F.col("exfiltration") > 0) | (F.col("secret_exposure") > 0)
    rank = F.greatest(
        F.when(F.col("_raw") >= emergency, 3).when(F.col("_raw") >= escalate, 2).when(F.col("_raw") >= monitor, 1).otherwise(0),
        F.when(F.col("exfiltration") > 0, 2).otherwise(0), F.when(F.col("secret_exposure") > 0, F.when(F.col("_severe"), 3).otherwise(2)).otherwise(0),
        F.when(F.col("obfuscation") > 0.1, F.when(leaks, 3).otherwise(1)).otherwise(0),
    )
    found = [("indirect_injection", F.col("instructional") > 0.5), ("exfiltration", F.col("exfiltration") > 0), ("secret_exposure", F.col("secret_exposure") > 0), ("obfuscation", F.col("obfuscation") > 0.1)]
    names = F.array_compact(F.array(*[F.when(hit & ~allowed, name) for name, hit in found]))
    return rows.withColumns({"tier": F.get(F.lit(O.TIERS), F.when(allowed, 0).otherwise(rank)), "patterns_matched": names}).drop("_body", "_low", "_bits", "_severe", "_raw")
