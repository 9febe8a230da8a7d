"""Joins between events: bypass attempts, replay enrichment, snapshots, approvals, vectors, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.signals import command_head, text

_HEADS = ["rm", "dd", "mkfs", "shred", "chmod", "chown", "curl", "wget", "scp", "sudo", "kill"]
_WORDS = ["delete", "remove", "destroy", "exfiltrate", "download", "upload"]


def fingerprints(events: DataFrame) -> DataFrame:
    """Add raw, norm, tokens and intent: the exact action, its normalised text, its words and its destructive intent."""
    norm = F.when(text("command") != "", F.lower(F.trim(command_head(F.col("command"))))).otherwise(F.lower(F.concat_ws(" ", "tool_name", "path")))
    rows = events.withColumns({"raw": F.sha2(F.to_json(F.struct("tool_name", "command", "path", "content")), 256), "norm": norm})
    rows = rows.withColumn("tokens", F.filter(F.split("norm", r"(?U)[^\w]+|_"), lambda t: t != ""))
    head = F.get("tokens", F.lit(0))
    intent = F.when(head.isin(_HEADS), head).when(F.arrays_overlap("tokens", F.lit(_WORDS)), "destructive-generic").otherwise("non-destructive")
    return rows.withColumn("intent", intent)


def detect_bypass(scored: DataFrame, ttl: float = 86_400.0, most: int = 256, similar: float = 0.92, unit: float = 1.0) -> DataFrame:
    """(event_id, prior_event_id, rule): pre_actions that retry an earlier risky action of their session in another form.

    Priors are blocked pre_actions of at least high risk, at most ``ttl`` units old, the newest ``most`` of a session. The newest
    prior on which a rule fires is named; rules: same action; same text and tool; same text, other tool; same destructive intent,
    other tool; words alike (Jaccard >= ``similar``), other tool.

    No event meets all priors of its session: for each key (action, text, intent, set of words) the newest prior before an event is carried
    along one order of the session, with the newest of another tool. Sets of words are compared once a session, not once an event, and meet at
    the first words of their order by hash, as two alike sets share one. The age and the number bound only what is newest, so they are tested on it.
    Several joins read the events, so these are written once, scored and with fingerprints, to the shared checkpoint folder.
    """
    from .blocks import durable

    prior = (F.col("verdict") == "block") & (F.col("risk_rank") >= 2)
    rows = fingerprints(scored.where(F.col("etype") == "pre_action"))
    rows = durable(rows.select("event_id", "session_id", "micros", "tool_name", "raw", "norm", "tokens", "intent", prior.alias("own")))
    return _bypass(rows, F.col("own"), ttl, most, similar, unit).drop("session_id")


def detect_bypass_rounds(scored: DataFrame, ttl: float = 86_400.0, most: int = 256, similar: float = 0.92, unit: float = 1.0) -> DataFrame:
    """(event_id, prior_event_id, rule, round): detect_bypass() where an event that is matched is blocked at its prior's risk and is a prior itself from then on.

    What an event matches depends on earlier events alone, so rounds that start from the blocks of the round before reach the one fixed point, the result of a replay in
    order: after a round the first events of each chain stand. Sessions whose blocks a round left as they were are settled and leave; the end is a round that
    leaves none. ``round`` is that in which the session settled. Each round is written to the shared checkpoint folder, so that the lineage doesn't grow.
    """
    from .blocks import durable

    columns = ["event_id", "session_id", "micros", "tool_name", "command", "path", "content", "etype", "verdict", "risk_rank"]
    rows = fingerprints(scored.select(*columns)).where(F.col("etype") == "pre_action")
    own = (F.col("verdict") == "block") & (F.col("risk_rank") >= 2)
    rows = durable(rows.select("event_id", "session_id", "micros", "tool_name", "raw", "norm", "tokens", "intent", own.alias("own")).withColumn("blocked", F.col("own")))
    done, turn = None, 0
    while True:
        turn += 1
        found = _bypass(rows, F.col("blocked"), ttl, most, similar, unit)
        after = durable(rows.join(found.select("event_id", "prior_event_id", "rule"), "event_id", "left").withColumn("next", F.col("own") | F.col("rule").isNotNull()))
        moved = after.where(F.col("next") != F.col("blocked")).select(F.col("session_id").alias("_moved")).distinct()
        same = F.col("session_id").eqNullSafe(F.col("_moved"))
        settled = after.join(moved, same, "left_anti").where(F.col("rule").isNotNull()).select("event_id", "prior_event_id", "rule", F.lit(turn).alias("round"))
        done = settled if done is None else done.unionByName(settled)
        if moved.isEmpty():
            return done
        rows = after.join(moved, same, "left_semi").withColumn("blocked", F.col("next")).drop("next", "prior_event_id", "rule")


def _bypass(rows: DataFrame, is_prior: Column, ttl: float, most: int, similar: float, unit: float) -> DataFrame:
    """detect_bypass() over pre_actions with fingerprints, with the session."""
    order = Window.partitionBy("session_id").orderBy("micros", "event_id")
    rows = rows.select("event_id", "session_id", "micros", "tool_name", "raw", "norm", "intent", F.array_sort(F.array_distinct("tokens")).alias("words"), is_prior.alias("is_prior"))
    rows = rows.withColumn("upto", F.count_if("is_prior").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"set": F.xxhash64("words"), "behind": F.col("upto") - F.col("is_prior").cast("int"), "prior": F.when(F.col("is_prior"), F.struct("micros", "event_id", "upto", "tool_name", "raw", "norm", "intent"))})
    recent = lambda p: F.when((p["micros"] >= F.col("micros") - int(ttl * unit * 1e6)) & (p["upto"] > F.col("behind") - most), p)
    for key in ("raw", "norm"):
        before = Window.partitionBy("session_id", key).orderBy("micros", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"by_{key}", recent(F.last("prior", ignorenulls=True).over(before)))
    rows = _newest_of_another_tool(rows, "intent", "by_intent").withColumn("by_intent", F.when(F.col("intent") != "non-destructive", recent(F.col("by_intent"))))
    sets = _alike_sets(rows, similar)
    asked = rows.select("event_id", "session_id", "micros", "tool_name", "set", "behind").join(sets, ["session_id", "set"]).withColumn("prior", F.lit(None).cast(rows.schema["prior"].dataType)).drop("set")
    priors = rows.where("is_prior").select("event_id", "session_id", "micros", "tool_name", "behind", F.col("set").alias("other_set"), "prior")
    found = _newest_of_another_tool(asked.unionByName(priors), "other_set", "by_set", after=F.col("prior").isNotNull()).where("prior is null").withColumn("by_set", recent(F.col("by_set")))
    found = found.groupBy("event_id").agg(F.max("by_set").alias("by_set"))
    rows = rows.join(found, "event_id", "left").withColumn("best", F.greatest("by_raw", "by_norm", "by_intent", "by_set")).where(F.col("best").isNotNull())
    other = F.col("tool_name") != F.col("best.tool_name")
    rule = (
        F.when(F.col("raw") == F.col("best.raw"), "exact").when((F.col("norm") == F.col("best.norm")) & ~other, "normalized_same_tool").when(F.col("norm") == F.col("best.norm"), "normalized_cross_tool")
        .when((F.col("intent") == F.col("best.intent")) & (F.col("intent") != "non-destructive") & other, "intent_cross_tool").otherwise("similar_cross_tool")
    )
    return rows.select("session_id", "event_id", F.col("best.event_id").alias("prior_event_id"), rule.alias("rule"))


def _newest_of_another_tool(rows: DataFrame, key: str, name: str, after: Column | None = None) -> DataFrame:
    """Add the newest prior before each row with its key and another tool.

    Beside each prior stands the newest before it of another tool: the one before the last change of tool. after: where rows of an event come
    after others of the same time and id.
    """
    order = Window.partitionBy("session_id", key).orderBy("micros", "event_id", *([after] if after is not None else []))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.last("prior", ignorenulls=True).over(before))
    change = F.col("prior").isNotNull() & (F.col("_last.tool_name") != F.col("prior.tool_name"))
    carried = F.last(F.when(change, F.col("_last")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_pair", F.when(F.col("prior").isNotNull(), F.struct(F.col("prior").alias("last"), carried.alias("other"))))
    rows = rows.withColumn("_pair", F.last("_pair", ignorenulls=True).over(before))
    newest = F.when(F.col("_pair.last.tool_name") != F.col("tool_name"), F.col("_pair.last")).otherwise(F.col("_pair.other"))
    return rows.withColumn(name, newest).drop("_last", "_pair")


def _alike_sets(rows: DataFrame, similar: float) -> DataFrame:
    """(session_id, set, other_set): sets of words of events, and the sets of priors in their session that are as alike as ``similar``.

    A prefix of n - ceil(similar * n) + 1 words in order of their hash suffices for two alike sets to share a word.
    """
    distinct = rows.groupBy("session_id", "set").agg(F.first("words").alias("words"), F.max("is_prior").alias("is_prior")).where(F.size("words") > 0)
    n = F.size("words")
    by_hash = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["h"])
    keyed = distinct.withColumn("word", F.explode(F.slice(by_hash, 1, (n - F.ceil(F.lit(similar) * n - 1e-9) + 1).cast("int"))))
    other = keyed.where("is_prior").select("session_id", "word", F.col("set").alias("other_set"), F.col("words").alias("other_words"))
    both = keyed.join(other, ["session_id", "word"])
    alike = F.size(F.array_intersect("words", "other_words")) / F.size(F.array_union("words", "other_words")) >= similar
    return both.where(alike).select("session_id", "set", "other_set").distinct()


def replay_enriched(events: DataFrame, effects: DataFrame) -> DataFrame:
    """Events with the kinds of their effects and of their session's effects; effects are gathered before the join."""
    own = effects.where(F.col("event_id").isNotNull()).groupBy("session_id", "event_id").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("own_effects"))
    shared = effects.where(F.col("event_id").isNull()).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("session_effects"))
    return events.select("session_id", "event_id").join(own, ["session_id", "event_id"], "left").join(shared, "session_id", "left")


def evidence_snapshots(scored: DataFrame, most: int = 50) -> DataFrame:
    """(session_id, trigger_event_id, from_event_id, records, high, highest, blocked, action): up to ``most`` records up to each rise to critical.

    Windows over the session count a snapshot's records; snapshot_records() lists them.
    """
    order = Window.partitionBy("session_id").orderBy("micros", "event_id")
    rows = scored.select("session_id", "event_id", "micros", "risk_rank", "verdict").withColumn("seq", F.row_number().over(order)).withColumn("before", F.lag("risk_rank").over(order))
    near = order.rowsBetween(-(most - 1), 0)
    rows = rows.withColumns({
        "from_event_id": F.first("event_id").over(near), "records": F.count("*").over(near), "high": F.count_if(F.col("risk_rank") >= 2).over(near),
        "highest": F.max("risk_rank").over(near), "blocked": F.count_if(F.col("verdict") == "block").over(near),
    })
    rows = rows.where((F.col("risk_rank") == 3) & (F.coalesce("before", F.lit(0)) < 3))
    action = F.when(F.col("high") >= 3, "escalate").when(F.col("high") >= 1, "review").otherwise("monitor")
    return rows.select("session_id", F.col("event_id").alias("trigger_event_id"), "from_event_id", "records", "high", S.level_of_rank(F.col("highest")).alias("highest"), "blocked", action.alias("action"))


def snapshot_records(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The records (session_id, event_id, ...) of each snapshot's range of ids in its session, by a range join in bins (operators.ranges)."""
    from .ranges import range_join

    bounds = snapshots.select("session_id", "trigger_event_id", "from_event_id", F.col("trigger_event_id").alias("to_event_id"))
    return range_join(records, bounds, "session_id", "event_id", "from_event_id", "to_event_id").drop("from_event_id", "to_event_id")


def approval_outcomes(requests: DataFrame, resolutions: DataFrame, timeout: float, unit: float = 1.0, as_of: int | None = None, on_timeout: str = "block") -> DataFrame:
    """(approval_id, state, verdict, reason_code): resolved within the timeout, timed out, or pending at ``as_of`` (the newest time of either table)."""
    done = resolutions.groupBy("approval_id").agg(F.min(F.struct("micros", "decision")).alias("first"))
    rows = requests.select("approval_id", F.col("micros").alias("asked")).join(done, "approval_id", "left")
    if as_of is None:
        newest = requests.select("micros").unionByName(resolutions.select("micros")).agg(F.max("micros").alias("now"))
        rows = rows.crossJoin(F.broadcast(newest))  # one row
    else:
        rows = rows.withColumn("now", F.lit(as_of))
    due = F.col("asked") + int(timeout * unit * 1e6)
    in_time = F.col("first.micros").isNotNull() & (F.col("first.micros") >= F.col("asked")) & (F.col("first.micros") <= due)
    state = F.when(in_time, F.when(F.col("first.decision") == "allow", "allowed").otherwise("denied")).when(F.col("now") > due, "expired").otherwise("pending")
    rows = rows.withColumn("state", state)
    verdict = F.when(F.col("state") == "allowed", "allow").when(F.col("state") == "denied", "block").when(F.col("state") == "expired", on_timeout)
    code = F.when(F.col("state") == "allowed", "approval_allowed").when(F.col("state") == "denied", "approval_denied").when(F.col("state") == "expired", "approval_timeout")
    return rows.select("approval_id", "state", verdict.alias("verdict"), code.alias("reason_code"))


def vector_scores(queries: DataFrame, corpus: DataFrame, least: float = 0.75) -> DataFrame:
    """(vec_id, similarity, score): the largest cosine similarity of each query to the corpus of attack vectors.

    All pairs are compared by products of blocks (operators.vectors), of which each gives one candidate a query; the best of the candidates is taken. A query that can't be
    compared (null, or null entries, or with a corpus of none) has a null similarity.
    """
    from .vectors import by_blocks

    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())

    def best(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(u)), (u @ v.T).argmax(axis=1)

    asked = queries.select("vec_id", "embedding")
    found = by_blocks(asked.where(usable), corpus.select("embedding").where(usable), best).select("vec_id", "similarity")
    rows = found.unionByName(asked.select("vec_id", F.lit(None).cast("double").alias("similarity")))
    rows = rows.groupBy("vec_id").agg(F.round(F.max("similarity"), 4).alias("similarity"))
    return rows.withColumn("score", F.round(S.vector_score(F.col("similarity"), least), 4))


def detection_quality(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of a confusion matrix and its rates; detected: (id, detected), labels: (id, unsafe)."""
    one = detected.join(labels, "id").agg(
        F.count_if(F.col("unsafe") & F.col("detected")).alias("tp"), F.count_if(~F.col("unsafe") & F.col("detected")).alias("fp"),
        F.count_if(F.col("unsafe") & ~F.col("detected")).alias("fn"), F.count_if(~F.col("unsafe") & ~F.col("detected")).alias("tn"),
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select("tp", "fp", "fn", "tn", ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("false_positive_rate"), ratio(tp, tp + fp).alias("precision"))


def trajectory_events(turns: DataFrame) -> DataFrame:
    """Conversation turns as events: type by role, a running index, the previous event as parent, times one second apart."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    kind = F.when(F.col("role") == "user", "pre_prompt").when(F.col("role") == "assistant", "post_response").when(F.col("role") == "tool", "post_action").otherwise("session")
    rows = turns.select("conv_id", kind.alias("etype"), F.length("text").alias("n_chars"), (F.row_number().over(order) - 1).alias("depth"))
    event_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("depth").cast("string"))
    parent = F.when(F.col("depth") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("depth") - 1).cast("string")))
    return rows.select(event_id.alias("event_id"), parent.alias("parent_event_id"), "conv_id", "etype", "depth", "n_chars", F.col("depth").cast("long").alias("at_second"))


def sampled_events(events: DataFrame, window: float, unit: float = 1.0) -> DataFrame:
    """(session_id, tool_name, event_id, suppressed): one event per session and tool in a window that starts at the last emitted one.

    Which event is next depends on the last emitted one, so it can't be told from a row's neighbours: the events are sorted by key and time, and a
    pass over the sorted rows jumps from one emitted event to the next. It holds one key's last time and count, not the key's rows.
    """
    tick = int(window * unit * 1e6)
    key = ["session_id", "tool_name"]
    rows = events.select(*key, "event_id", "micros").repartition(*key).sortWithinPartitions(*key, "micros", "event_id")
    kinds = dict(rows.dtypes)

    def run(batches):
        last = due = None
        dropped = 0
        for batch in batches:
            micros = batch["micros"].to_numpy()
            coded = [batch[k].factorize(use_na_sentinel=False)[0] for k in key]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in coded], axis=0)) + 1 if len(batch) else []
            emitted, suppressed = [], []
            for lo, hi in zip([0, *cut], [*cut, len(batch)], strict=True):
                name = tuple(None if pd.isna(x) else x for x in batch[key].iloc[lo]) if hi > lo else last
                if name != last:
                    last, due, dropped = name, None, 0
                at = lo
                while at < hi:
                    nxt = at if due is None else at + int(np.searchsorted(micros[at:hi], due))
                    dropped += nxt - at
                    if nxt < hi:
                        emitted.append(nxt)
                        suppressed.append(dropped)
                        due, dropped, nxt = micros[nxt] + tick, 0, nxt + 1
                    at = nxt
            yield batch[[*key, "event_id"]].iloc[emitted].assign(suppressed=np.array(suppressed, np.int32))

    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*key, "event_id"]) + ", suppressed int")


def first_requests(requests: DataFrame, ttl: float, unit: float = 1.0) -> DataFrame:
    """Requests that aren't repeats: the first of a request_id, and those later than ``ttl`` after the last answered one (see sampled_events)."""
    rows = requests.select(F.col("request_id").alias("session_id"), F.lit("").alias("tool_name"), "event_id", "micros")
    return sampled_events(rows, ttl, unit).select(F.col("session_id").alias("request_id"), "event_id")
