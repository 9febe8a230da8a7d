"""Registered queries of the event operators: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outputs as O
from ..functions import patterns as P
from ..functions import scoring as S
from ..functions.signals import any_of
from ..operators import benchmark, blocks, correlate, escalate, evidence, normalize, reports, rollups, rules, score, sequences, sessions, snapshots
from ..operators.ranges import limit_requests, thin_events
from ..operators.vectors import similar_vectors
from ..sources.fixtures import agent_events, as_events, micros, table, tool_outputs
from . import oracle

#: Seconds that stand for one time unit in the event view (gaps there are hours, not seconds).
UNIT = 14_400.0

Query = Callable[[SparkSession, str], DataFrame]


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """Agent events dealt over the tasks by their id before anything is made of them: a file of few large row groups is read by as few tasks, and what is costly a row would keep these alone busy."""
    return as_events(table(spark, d, "events").repartition(3 * spark.sparkContext.defaultParallelism, "event_id"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score.score_events(_spread(spark, d))


def score_events(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("event_id", "session_id", "d1", "d2", "d3", "d4", "d5", "d6", "composite", "sc_rule", "risk_level", "verdict")


def preset_comparison(spark: SparkSession, d: str) -> DataFrame:
    return score.preset_comparison(agent_events(spark, d))


def injection_scores(spark: SparkSession, d: str) -> DataFrame:
    return score.injection(tool_outputs(spark, d)).select("output_id", F.round("d6", 4).alias("d6"))


def output_findings(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.outputs import analyze_outputs

    return analyze_outputs(tool_outputs(spark, d)).select("output_id", "instructional", "exfiltration", "secret_exposure", F.round("obfuscation", 4).alias("obfuscation"), "score", "tier", F.array_join("patterns_matched", ",").alias("patterns"))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", O.redacted(F.col("text")).alias("redacted"))


def entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(O.entropy(F.col("text")), 4).alias("entropy"))


def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_patterns(agent_events(spark, d))


def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_coverage(agent_events(spark, d))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Scored events with kinds of runtime events and review details by event number."""
    i = F.col("event_id")
    kinds = F.when(i % 17 == 0, "trajectory_alert").when(i % 17 == 1, "post_action_finding").when(i % 17 == 2, "budget_exhausted").when(i % 17 == 3, "decision").when(i % 17 == 4, "alert")
    detail = F.when(i % 19 == 0, "secret_plus_network").when(i % 19 == 1, "recon_then_sudo").when(i % 19 == 2, "tmp_staging_exfil")
    return _scored(spark, d).withColumns({"runtime_type": kinds, "trigger_detail": detail, "trigger_reason": F.when(i % 23 == 0, "cumulative_risk"), "reason": F.when(i % 2 == 0, "session_risk_escalation")})


def taxonomy_counts(spark: SparkSession, d: str) -> DataFrame:
    return score.classify(_observed(spark, d)).groupBy("tier", "subtype").agg(F.count("*").alias("n"))


def live_overview(spark: SparkSession, d: str) -> DataFrame:
    return reports.live_overview(score.classify(_observed(spark, d)))


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(_scored(spark, d))


def high_risk_trend(spark: SparkSession, d: str) -> DataFrame:
    return reports.high_risk_trend(_scored(spark, d), unit=UNIT)


def invalid_rates(spark: SparkSession, d: str) -> DataFrame:
    """Plain enumeration commands stand for invalid events."""
    return reports.invalid_rates(agent_events(spark, d), F.coalesce(F.col("command") == "uname -a", F.lit(False)), unit=60 * UNIT)


def posture(spark: SparkSession, d: str) -> DataFrame:
    """Both versions, over all records; plain enumeration commands stand for invalid events."""
    one = _scored(spark, d)
    bad = F.coalesce(F.col("command") == "uname -a", F.lit(False))
    return reports.posture(one, bad, unit=36.0).withColumn("version", F.lit(2)).unionByName(reports.posture(one, bad, unit=36.0, version=1).withColumn("version", F.lit(1)))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    return reports.session_list(_scored(spark, d), since=3600, least="medium", unit=UNIT)


def alert_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).where("risk_rank >= 1")
    alerts = rows.select(F.col("event_id").alias("alert_id"), F.col("risk_level").alias("severity"), (F.col("event_id") % 3 == 0).alias("acknowledged"), "micros")
    return reports.alert_list(alerts, "high", False)


def second_level(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event speaks of a key domain, every ninth has a hint."""
    i = F.col("event_id")
    rows = _scored(spark, d).withColumn("content", F.when(i % 10 == 0, "steal the production password").when(i % 10 == 1, "read the api_key file").otherwise(F.col("content")))
    hints = F.when(i % 9 == 0, F.array(F.lit("credential_exfiltration"))).when(i % 9 == 1, F.array(F.lit("Privilege_Escalation_Confirmed")))
    return escalate.second_level(rows, hints, i % 31 == 0, F.when(i % 29 == 0, "L2")).select("event_id", "l2_run", "l2_level", "l2_score")


def alert_thinning(spark: SparkSession, d: str) -> DataFrame:
    rows = agent_events(spark, d).select(F.col("source_framework").alias("session_id"), "tool_name", "event_id", "micros")
    return thin_events(rows, 60.0, UNIT).select(F.col("session_id").alias("metric"), F.col("tool_name").alias("severity"), "event_id", F.col("suppressed").cast("long").alias("suppressed"))


def missing_dimensions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = agent_events(spark, d).select("event_id", F.when(i % 7 != 0, F.col("tool_name")).alias("tool"), F.when(i % 3 != 0, F.col("path")).alias("path"), F.when(i % 5 != 0, F.col("command")).alias("command"), F.when(F.col("trust") != "untrusted", F.col("trust")).alias("trust"))
    return rows.select("event_id", F.array_join(escalate.missing_dimensions(F.col("tool"), F.col("path"), F.col("command"), F.col("trust")), ",").alias("missing"))


def resolved_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth verdict is deferred and then decided."""
    rows = _scored(spark, d).withColumn("v", F.when(F.col("event_id") % 4 == 0, "defer").otherwise(F.col("verdict")))
    level = F.col("risk_level")
    return rows.select("event_id", escalate.auto_resolved(F.col("v"), F.col("etype"), level).alias("block"), escalate.auto_resolved(F.col("v"), F.col("etype"), level, "allow_low_block_high").alias("by_level"))


def session_risk(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_risk(_scored(spark, d))


def session_profile(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_profile(_scored(spark, d))


def session_timeline(spark: SparkSession, d: str) -> DataFrame:
    return sessions.timeline(_scored(spark, d), 20).select("session_id", "event_id", "risk_level", "composite", "position")


def risk_changes(spark: SparkSession, d: str) -> DataFrame:
    return sessions.risk_changes(_scored(spark, d))


def cumulative_points(spark: SparkSession, d: str) -> DataFrame:
    return sessions.cumulative_points(_scored(spark, d))


def d4_accumulation(spark: SparkSession, d: str) -> DataFrame:
    return sessions.accumulation(agent_events(spark, d)).select("event_id", "session_id", "prior_high", "d4", "composite", "risk_level")


def _accounts(spark: SparkSession, d: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of the events of six accounts as six long sessions, in blocks of about 500 events; each event is judged once, before the blocks are stored.

    The table's own rows are sampled and cut into blocks, and events are made of them after that: their JSON is read once.
    """
    rows = table(spark, d, "events").withColumns({"session_id": F.col("user_id") % 6, "micros": micros()})
    return blocks.split_long_sessions(rows, 500, lambda x: then(as_events(x, "block").withColumn("session_id", F.col("session_id") % 6)))


def _levels(events: DataFrame) -> DataFrame:
    return score.score_events(events).select(*blocks.part(events), *blocks.ORDER, "composite", "risk_level", "risk_rank")


def account_accumulation(spark: SparkSession, d: str) -> DataFrame:
    narrow = lambda x: sessions.phases(x).select(*blocks.part(x), *blocks.ORDER, "etype", "d1", "d2", "d3", "d5", "d6", "freq", "h0", "h1", "h2")
    return sessions.accumulation(_accounts(spark, d, narrow)).select("event_id", "session_id", "prior_high", "d4", "composite", "risk_level")


def account_risk(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_risk(_accounts(spark, d, _levels))


def account_changes(spark: SparkSession, d: str) -> DataFrame:
    return sessions.risk_changes(_accounts(spark, d, _levels))


def account_enforcement(spark: SparkSession, d: str) -> DataFrame:
    return sessions.enforcement(_accounts(spark, d, _levels), cooldown=10, unit=UNIT / 400).select("session_id", "event_id", "high_before", "enforced", "triggers")


def account_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return sequences.detect_trajectories(_accounts(spark, d, sequences.stepped), unit=UNIT)


def account_history(spark: SparkSession, d: str) -> DataFrame:
    return sequences.suspicious_history(_accounts(spark, d, sequences.history_flags))


def d4_frequency(spark: SparkSession, d: str) -> DataFrame:
    return sessions.frequency_d4(agent_events(spark, d), UNIT, 4, 12, 30).select("event_id", "freq_d4")


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    return sequences.detect_trajectories(agent_events(spark, d), unit=UNIT)


def alerted_verdicts(spark: SparkSession, d: str) -> DataFrame:
    events = agent_events(spark, d)
    return sequences.apply_alerts(score.score_events(events), sequences.detect_trajectories(events, unit=UNIT)).groupBy("verdict").agg(F.count("*").alias("n"))


def suspicious_history(spark: SparkSession, d: str) -> DataFrame:
    return sequences.suspicious_history(agent_events(spark, d))


def bypass_matches(spark: SparkSession, d: str) -> DataFrame:
    return correlate.detect_bypass(_scored(spark, d), unit=UNIT)


def enforcement_state(spark: SparkSession, d: str) -> DataFrame:
    return sessions.enforcement(_scored(spark, d), cooldown=10, unit=UNIT).select("session_id", "event_id", "high_before", "enforced", "triggers")


def forced_enforcement(spark: SparkSession, d: str) -> DataFrame:
    """Critical events of even number stand for findings that force enforcement."""
    scored = _scored(spark, d)
    forced = scored.where("risk_rank = 3 and event_id % 2 = 0").select("session_id", "micros")
    return sessions.forced_enforcement(scored, forced, cooldown=10, unit=UNIT).select("event_id", "enforced", "forced")


def output_summary(spark: SparkSession, d: str) -> DataFrame:
    """Composite scores stand for the scores of outputs."""
    return sessions.output_summary(_scored(spark, d).select("session_id", "micros", "event_id", F.col("composite").alias("score")))


def derived_fields(spark: SparkSession, d: str) -> DataFrame:
    """Trace ids, outputs, frameworks and invalid chat events from varied raw fields."""
    i = F.col("event_id")
    rows = agent_events(spark, d).select("event_id", "etype", "source_framework", i.cast("string").alias("given"), F.when(i % 3 == 0, F.concat(F.lit("run"), i)).alias("run"), F.when(i % 2 == 0, F.concat(F.lit("ap"), i)).alias("approval"), F.when(i % 5 != 0, i).alias("seq"),
        F.create_map(F.when(i % 4 == 0, "output").when(i % 4 == 1, "result").otherwise("other"), F.lit("own"), F.when(i % 6 == 3, "stdout").otherwise("toolOutput"), F.lit("alias")).alias("payload"))
    adapters = {"adapter-one": "codex", "adapter-two": "openclaw"}
    adapter = F.when(i % 3 == 1, "Adapter-One").when(i % 3 == 2, "adapter-two")
    return rows.select(
        "event_id", normalize.trace_id(F.col("run"), F.col("approval"), F.col("given")).alias("trace_id"), normalize.output_of(F.col("etype"), F.col("payload")).alias("output"),
        normalize.framework_of(F.when(i % 4 == 0, "unknown").when(i % 4 == 1, F.col("source_framework")), adapter, adapters).alias("framework"),
        normalize.chat_invalid(F.when(i % 2 == 0, "chat:final").otherwise("agent:bootstrap"), F.col("run"), F.col("seq")).alias("invalid"),
    )


def asof_quarantine(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    states = scored.where("risk_rank = 3").select("session_id", "micros", F.when(F.col("event_id") % 2 == 0, "quarantined").otherwise("released").alias("state"))
    return sessions.as_of(scored.select("session_id", "event_id", "micros"), states).select("event_id", "state")


def replay_enriched(spark: SparkSession, d: str) -> DataFrame:
    events, i = agent_events(spark, d), F.col("event_id")
    kind = F.when(i % 3 == 0, "enforced").when(i % 3 == 1, "degraded").otherwise("unsupported")
    effects = events.where((i % 3 == 0) | (i % 5 == 0)).select("session_id", F.when(i % 5 != 0, i).alias("event_id"), kind.alias("kind"))
    return correlate.replay_enriched(events, effects)


def evidence_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return correlate.evidence_snapshots(_scored(spark, d))


def approval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    events, i = agent_events(spark, d), F.col("event_id")
    asked = events.where(i % 3 == 0).select(i.alias("approval_id"), "micros")
    done = events.where((i % 3 != 0) & (i % 7 < 4)).select((i - i % 3).alias("approval_id"), "micros", F.when(i % 2 == 0, "allow").otherwise("deny").alias("decision"))
    return correlate.approval_outcomes(asked, done, 0.01, UNIT)


def sampled_events(spark: SparkSession, d: str) -> DataFrame:
    return correlate.sampled_events(agent_events(spark, d), 5.0, UNIT)


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return reports.token_budget(agent_events(spark, d), 100_000)


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.usage_rollup(agent_events(spark, d))


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.latency_histogram(agent_events(spark, d), "value", "source_framework", (10.0, 50.0, 100.0, 250.0))


def latency_pressure(spark: SparkSession, d: str) -> DataFrame:
    return reports.latency_pressure(agent_events(spark, d).withColumn("seconds", F.col("value") / 400), "tool_name", "seconds")


def verdict_reasons(spark: SparkSession, d: str) -> DataFrame:
    dims = [F.col(c) for c in ("d1", "d2", "d3", "d4", "d5", "d6")]
    kind = F.when(F.col("event_id") % 10 == 9, "pre_prompt").otherwise(F.col("etype"))
    return _scored(spark, d).select("event_id", S.reason(kind, F.col("risk_level"), dims, F.col("composite"), F.col("sc_rule"), F.col("tool_name")).alias("reason"))


def risk_direction(spark: SparkSession, d: str) -> DataFrame:
    return reports.risk_direction(_scored(spark, d), 60 * UNIT / 100)


def session_posture(spark: SparkSession, d: str) -> DataFrame:
    return reports.session_posture(reports.current_sessions(_scored(spark, d)).withColumn("mapped", F.col("risk_rank") >= 1))


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    current = reports.current_sessions(_scored(spark, d))
    framework = reports.session_counts(current, "source_framework").withColumn("key", F.lit("framework"))
    return framework.unionByName(reports.session_counts(current, "workspace_root").withColumn("key", F.lit("workspace")))


def top_usage(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_usage(reports.usage_rollup(agent_events(spark, d)))


def replay_range(spark: SparkSession, d: str) -> DataFrame:
    """The range is cut out of the events, so that no other event is scored."""
    return score.score_events(reports.replay_range(agent_events(spark, d), 7, 100, 900)).select("event_id", "session_id", "risk_level", "verdict").orderBy("event_id")


def replay_scores(spark: SparkSession, d: str) -> DataFrame:
    """Days of a session stand for labelled records; every third is unsafe, every seventh has no label, and some have no decision."""
    i = F.col("event_id")
    day = F.floor(F.col("micros") / 86_400_000_000)
    record = F.concat_ws("-", F.col("session_id").cast("string"), day.cast("string"))
    rows = _scored(spark, d).select(record.alias("record_id"), "event_id", "etype", F.when(i % 9 == 0, "defer").otherwise(F.col("verdict")).alias("verdict"), "risk_rank", F.when(i % 5 == 0, "l3").when(i % 5 == 1, "L2").otherwise("L1").alias("tier"), "session_id", day.alias("day"))
    labels = rows.select("record_id", F.when((F.col("session_id") + F.col("day")) % 7 == 0, "odd").when((F.col("session_id") + F.col("day")) % 3 == 0, "unsafe").otherwise("safe").alias("label")).distinct()
    return benchmark.replay_scores(benchmark.replay_records(rows.where((F.col("session_id") + F.col("day")) % 10 != 0), labels))


def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    counts = scored.groupBy("verdict", "risk_level", "source_framework").agg(F.count("*").alias("n"))
    buckets = reports.latency_histogram(scored, "composite", "source_framework", (0.5, 1.5, 2.5)).withColumnRenamed("edge", "le")
    return benchmark.exposition(counts, "decisions_total", ["verdict", "risk_level", "source_framework"]).unionByName(benchmark.exposition(buckets, "risk_score_bucket", ["source_framework", "le"]))


def rule_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh event has a hint of credentials, every eleventh one of two kinds; events of number 12 modulo 13 lack a name and are findings."""
    i = F.col("event_id")
    hints = F.when(i % 7 == 0, F.array(F.lit("Credential_Access"))).when(i % 11 == 0, F.array(F.lit("shell_execution"), F.lit("data_exfiltration"), F.lit("shell_execution")))
    return rules.dry_run(agent_events(spark, d), None, hints, F.when(i % 13 == 12, "event_id missing"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.latency_histogram(_scored(spark, d), "composite", "source_framework", (0.5, 1.0, 1.5, 2.0, 2.5))


def value_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of values and numbers of sessions by framework, merged from sketches of hours."""
    return rollups.merge_sketches(rollups.sketch_hours(agent_events(spark, d), "source_framework", "value", "session_id"), "source_framework")


def session_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth decision is resolved later, every eighth of these twice, and every ninth resolution has no decision."""
    i = F.col("event_id")
    record = lambda event, seq, kind, verdict, tier, rank: F.struct(event.alias("event_id"), F.lit(seq).alias("seq"), F.lit(kind).alias("record_type"), verdict.alias("verdict"), tier.alias("tier"), rank.alias("risk_rank"))
    resolved, human = F.when(i % 3 == 0, "allow").otherwise("block"), F.lit("human")
    # an event gives its records together, so that it is scored once
    kinds = F.array(
        record(i, 0, "decision", F.when(i % 4 == 0, "defer").otherwise(F.col("verdict")), F.when(i % 3 == 0, "L1").otherwise("L2"), F.col("risk_rank")),
        F.when(i % 4 == 0, record(i, 1, "decision_resolution", resolved, human, F.lit(0))),
        F.when(i % 32 == 0, record(i, 2, "decision_resolution", F.lit("modify"), human, F.lit(3))),
        F.when(i % 36 == 0, record(-i, 1, "decision_resolution", resolved, human, F.lit(0))),
    )
    records = _scored(spark, d).select(
        "session_id", "micros", "tool_name", F.when(i % 5 == 0, F.array(F.lit("shell"), F.lit("net"))).when(i % 5 == 1, F.array(F.lit("net"))).alias("hints"),
        "composite", "d1", "d2", "d3", (i % 3).cast("int").alias("d4"), "d5", "d6", F.inline(F.array_compact(kinds)),
    )
    out = rollups.session_aggregates(records)
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("session_id", "event_count", "high_risk_event_count", "d4_sum", "first_micros", "last_micros", "cumulative_score", shown(F.col("verdicts")).alias("verdicts"), shown(F.col("tiers")).alias("tiers"), F.array_join("tools", ",").alias("tools"), F.array_join("hints", ",").alias("hints"), F.col("latest.d6").alias("last_d6"))


def compat_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Event fields as nested payloads of five kinds, at different places."""
    i = F.col("event_id")
    names = ["ContextPerception", "memory_recall", "compat:Planning", "reasoning", "intentdetection", "other"]
    kind = F.get(F.lit(names), (i % 6).cast("int"))
    inner = F.struct(
        F.when(i % 4 == 0, F.col("command")).alias("intent"), F.when(i % 4 == 1, F.lit("  ")).otherwise(F.col("tool_name")).alias("query"), F.col("path").alias("cwd"), (i % 7).alias("max_results"), F.col("tool_name").alias("task"),
        F.array(F.lit(" a "), F.lit(""), F.col("content")).alias("constraints"), F.col("content").alias("problem_statement"), F.struct(F.lit("  ").alias("x"), F.col("path").alias("y")).alias("target_hints"),
    )
    outer = F.struct(F.when(i % 3 == 0, F.lit("top")).alias("query"), F.when(i % 3 == 1, F.lit(" 12 ")).alias("max_results"), inner.alias("arguments"), F.struct(F.struct(kind.alias("raw_event_type"), F.lit("deep").alias("target")).alias("compat")).alias("_meta"))
    rows = agent_events(spark, d).select("event_id", F.lit("reasoning").alias("event_subtype"), F.when(i % 11 == 10, F.lit("[1]")).otherwise(F.to_json(outer)).alias("payload"))
    out = evidence.compatibility_evidence(rows)
    return out.select("event_id", "compat_event_type", "summary_kind", F.array_join(F.array_sort(F.transform(F.map_entries("summary"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("summary"))


def workspace_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.workspace_rollup(_scored(spark, d))


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    return reports.dashboard(_scored(spark, d))


def priority_sessions(spark: SparkSession, d: str) -> DataFrame:
    return reports.priority_sessions(_scored(spark, d))


def audit_search(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_search(_scored(spark, d), risk="critical", tool="ba")


def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_stats(_scored(spark, d))


def replay_page(spark: SparkSession, d: str) -> DataFrame:
    return reports.replay_page(_scored(spark, d), 500)


def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return correlate.vector_scores(vectors.where("label <> 0"), vectors.where("label = 0"))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector, mixed with the next one, against all vectors."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", "other", lambda a, b: 0.65 * a.cast("double") + 0.35 * b.cast("double"))
    asked = vectors.where("vec_id % 50 = 0").join(after, "vec_id").select("vec_id", mixed.alias("embedding"))
    return similar_vectors(asked, vectors).withColumn("similarity", F.round("similarity", 4))


def snapshot_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of each snapshot, and of the empty range where the id of the trigger is 4 modulo 5."""
    scored = _scored(spark, d)
    snapshots = correlate.evidence_snapshots(scored).withColumn("from_event_id", F.when(F.col("trigger_event_id") % 5 == 4, F.col("trigger_event_id") + 1).otherwise(F.col("from_event_id")))
    return correlate.snapshot_records(scored.select("session_id", "event_id", "risk_level"), snapshots)


def review_snapshots(spark: SparkSession, d: str) -> DataFrame:
    events = agent_events(spark, d)
    return snapshots.review_snapshots(score.score_events(events), sequences.detect_trajectories(events, unit=UNIT))


def _varied(spark: SparkSession, d: str) -> DataFrame:
    """Scored events of which every third goes by another tool, so that blocked commands come back as others."""
    i = F.col("event_id")
    events = agent_events(spark, d).withColumn("tool_name", F.when(i % 3 == 1, "web_fetch").when(i % 3 == 2, "fetch").otherwise(F.col("tool_name")))
    return score.score_events(events)


def bypass_rounds(spark: SparkSession, d: str) -> DataFrame:
    return correlate.detect_bypass_rounds(_varied(spark, d), ttl=200.0, unit=UNIT).drop("round")


def request_limits(spark: SparkSession, d: str) -> DataFrame:
    return limit_requests(agent_events(spark, d), 5, 20.0, UNIT)


def account_limits(spark: SparkSession, d: str) -> DataFrame:
    return limit_requests(_accounts(spark, d, lambda x: x.select(*blocks.part(x), *blocks.ORDER)), 3, 0.1, UNIT)


def trajectory_events(spark: SparkSession, d: str) -> DataFrame:
    return correlate.trajectory_events(table(spark, d, "conversations"))


def detection_quality(spark: SparkSession, d: str) -> DataFrame:
    hit = any_of(F.col("text"), P.SECRETS + [P.REDACT])
    unsafe = ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("unsafe")
    return correlate.detection_quality(table(spark, d, "documents").select(F.col("doc_id").alias("id"), hit.alias("detected")), table(spark, d, "labels").select(F.col("doc_id").alias("id"), unsafe))


def candidate_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rules.candidate_patterns(agent_events(spark, d))


def pattern_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    events = agent_events(spark, d)
    votes = events.select(F.concat_ws("-", "tool_name", (F.col("session_id") % 50).cast("string")).alias("rule_id"), "event_id", "micros", F.col("source_framework").alias("framework"), ((F.col("event_id") * 7919) % 100 < 85).alias("confirmed"))
    return rules.pattern_lifecycle(votes)


def skill_routing(spark: SparkSession, d: str) -> DataFrame:
    return rules.route_skills(agent_events(spark, d))


def normalized_events(spark: SparkSession, d: str) -> DataFrame:
    """The event view under its frameworks' own hook names, every eleventh one unknown, normalised back."""
    events, i = agent_events(spark, d), F.col("event_id")
    before = F.col("etype") == "pre_action"
    names = F.when(F.col("source_framework") == "codex", F.when(before, "function_call").otherwise("function_call_output"))
    names = names.when(F.col("source_framework") == "openclaw", F.when(before, "exec.approval.requested").otherwise("exec.approval.resolved"))
    names = names.when(F.col("source_framework") == "gemini-cli", F.when(before, "BeforeTool").otherwise("AfterTool")).otherwise(F.when(before, "PreToolUse").otherwise("PostToolUse"))
    raw = events.select(
        "event_id", "source_framework", F.when(i % 11 == 0, "GenerateEnd").otherwise(names).alias("raw_type"), F.when(i % 13 != 0, F.col("session_id")).alias("session_id"),
        F.lit("a").alias("agent_id"), F.when(F.col("tool_name") == "bash", "Bash").otherwise(F.col("tool_name")).alias("tool_name"), F.when(i % 4 == 3, F.col("content")).alias("response_text"), "path", "command",
    )
    out = normalize.normalize_events(raw)
    return out.select("event_id", "event_type", "subtype", "session_id", "tool_name", normalize.origin_of(F.col("tool_name"), F.col("path"), F.col("command")).alias("origin"), F.array_join(normalize.risk_hints(F.col("tool_name"), F.col("command")), ",").alias("hints"))


def activity_states(spark: SparkSession, d: str) -> DataFrame:
    return sessions.activity_states(agent_events(spark, d), UNIT)


def busy_clients(spark: SparkSession, d: str) -> DataFrame:
    return sessions.busy_clients(agent_events(spark, d), 20, 30.0, UNIT)


def session_recommendations(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.actions import operator_action, recommendation

    last = sessions.latest_annotations(_scored(spark, d), ["risk_level"])
    level = F.col("risk_level")
    return last.select("session_id", operator_action(level).alias("action"), recommendation(F.lit(None), F.col("session_id") % 10 == 0, level).alias("label"))


def heartbeat_deltas(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return sessions.heartbeat_deltas(scored, scored.where("risk_rank = 3 and event_id % 2 = 0").select("session_id", F.col("event_id").alias("to_event_id")))


def queries() -> dict[str, Query]:
    found = [
        score_events, preset_comparison, injection_scores, output_findings, redact_secrets, entropy, pattern_matches, rule_coverage, taxonomy_counts, live_overview,
        summary_counts, high_risk_trend, invalid_rates, posture, session_risk, session_profile, session_timeline, risk_changes, cumulative_points, d4_accumulation,
        d4_frequency, trajectories, alerted_verdicts, suspicious_history, bypass_matches, enforcement_state, asof_quarantine, replay_enriched, evidence_snapshots,
        approval_outcomes, sampled_events, token_budget, usage_rollup, latency_histogram, latency_pressure, workspace_rollup, dashboard, priority_sessions, audit_search,
        audit_stats, replay_page, vector_scores, trajectory_events, detection_quality, candidate_patterns, pattern_lifecycle, skill_routing, normalized_events, activity_states, busy_clients, session_recommendations, heartbeat_deltas,
        session_list, alert_list, second_level, alert_thinning, missing_dimensions, resolved_verdicts, forced_enforcement, output_summary, derived_fields,
        account_accumulation, account_risk, account_changes, account_enforcement, account_trajectories, account_history, account_limits, vector_search, snapshot_records, bypass_rounds, request_limits, risk_direction, session_posture, session_counts, top_usage, replay_range, replay_scores, metric_lines, rule_dry_run, review_snapshots, verdict_reasons,
        score_histogram, value_sketches, session_aggregates, compat_evidence,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
