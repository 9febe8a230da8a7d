"""Scores of labelled replays: detection, prevention and coverage, and the artifacts of a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S


def replay_records(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each labelled record: events, blocked, deferred, max_rank, pre, post, tiers L1 to L3, detected, prevented, label.

    decisions: record_id, event_id, etype, verdict, risk_rank, tier; labels: record_id, label (safe or unsafe, others are left out). Detected: a
    block, a deferral or high risk; prevented: a block or a deferral. A record without decisions is one of low risk.
    """
    per = decisions.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "defer").alias("deferred"), F.max("risk_rank").alias("max_rank"),
        F.max(F.col("etype") == "pre_action").alias("pre"), F.max(F.col("etype") == "post_action").alias("post"), *[F.count_if(F.upper("tier") == t).alias(t) for t in ("L1", "L2", "L3")],
    )
    out = labels.where(F.col("label").isin("safe", "unsafe")).select("record_id", "label").join(per, "record_id", "left")
    out = out.na.fill(0, ["events", "blocked", "deferred", "max_rank", "L1", "L2", "L3"]).na.fill(False, ["pre", "post"])
    stopped = (F.col("blocked") > 0) | (F.col("deferred") > 0)
    return out.withColumns({"prevented": stopped, "detected": stopped | (F.col("max_rank") >= 2)})


def replay_scores(records: DataFrame) -> DataFrame:
    """One row of replay_records(): the confusion matrix, its rates (null without a denominator), coverage, and numbers by level and tier."""
    unsafe, hit = F.col("label") == "unsafe", F.col("detected")
    one = records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(unsafe & hit).alias("tp"), F.count_if(~unsafe & hit).alias("fp"), F.count_if(unsafe & ~hit).alias("fn"), F.count_if(~unsafe & ~hit).alias("tn"),
        F.count_if(unsafe & F.col("prevented")).alias("_stopped"), F.count_if("pre").alias("_pre"), F.count_if("post").alias("_post"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "blocked", "deferred", "L1", "L2", "L3")], *[F.count_if(F.col("max_rank") == k).alias(f"max_{n}") for k, n in enumerate(("low", "medium", "high", "critical"))],
    )
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {
        "unsafe_recall": share(tp, tp + fn), "safe_false_positive_rate": share(fp, fp + tn), "precision": share(tp, tp + fp), "balanced_accuracy": (share(tp, tp + fn) + share(tn, tn + fp)) / 2,
        "prevention_recall": share(F.col("_stopped"), tp + fn), "pre_action_coverage": share(F.col("_pre"), F.col("records")), "post_action_coverage": share(F.col("_post"), F.col("records")),
    }
    return one.withColumns({n: F.round(c, 6) for n, c in rates.items()}).drop("_stopped", "_pre", "_post")


def write_replay(decisions: DataFrame, records: DataFrame, path: str) -> None:
    """The artifacts of a replay: decisions as JSON lines in a folder for each record (decisions/record_id=...), and a summary line for each record (records)."""
    level = S.level_of_rank(F.col("max_rank")).alias("max_risk_level")
    decisions.repartition("record_id").sortWithinPartitions("record_id", "event_id").write.mode("overwrite").partitionBy("record_id").json(f"{path}/decisions")
    records.select("record_id", "label", "events", "blocked", "deferred", level, "detected").write.mode("overwrite").json(f"{path}/records")


def exposition(counts: DataFrame, name: str, labels: list[str], value: str = "n") -> DataFrame:
    """(line): metrics as lines of text, ``name{label="value",...} number``; quotes, backslashes and line ends of values are escaped.

    A histogram is one such metric: its buckets have a label ``le`` (null: +Inf) and cumulative numbers, as reports.latency_histogram gives them.
    """
    shown = []
    for label in labels:
        text = F.coalesce(F.col(label).cast("string"), F.lit("+Inf" if label == "le" else ""))
        text = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        shown.append(F.concat(F.lit(f'{label}="'), text, F.lit('"')))
    inside = F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}")) if labels else F.lit("")
    return counts.select(F.concat(F.lit(name), inside, F.lit(" "), F.col(value).cast("string")).alias("line"))
