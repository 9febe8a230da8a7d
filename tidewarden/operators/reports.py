"""Reports over scored events (the decision log). ``as_of`` defaults to the newest record; windows include their lower bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S


def _with_now(rows: DataFrame, as_of: int | None) -> DataFrame:
    """Add now (microseconds): a literal, or the newest record by a one-row broadcast."""
    if as_of is not None:
        return rows.withColumn("now", F.lit(as_of))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("micros").alias("now"))))  # one row


def summary(scored: DataFrame, dimensions: tuple[str, ...] = ("source_framework", "etype", "verdict", "risk_level")) -> DataFrame:
    """(dimension, value, n): counts by each dimension and the total, by grouping sets in one pass."""
    keys = [*dimensions]
    rows = scored.select(*keys).groupBy(*keys).agg(F.count("*").alias("n"))  # few combinations; grouping sets then run over those
    parts = [F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k), F.lit("")).alias("value")) for k in keys]
    parts.append(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    return rows.select("n", F.inline(F.array(*parts))).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def high_risk_trend(scored: DataFrame, bucket: int = 300, buckets: int = 12, unit: float = 1.0, as_of: int | None = None) -> DataFrame:
    """(bucket, total, high, ratio): the newest ``buckets`` of ``bucket`` time units, half-open at their end, empty ones included."""
    tick = int(bucket * unit * 1e6)
    rows = _with_now(scored.select("micros", "risk_rank"), as_of)
    age = F.floor((F.col("now") - F.col("micros")) / tick)
    counted = rows.where((F.col("micros") <= F.col("now")) & (F.col("micros") > F.col("now") - F.lit(buckets) * tick)).groupBy(age.cast("int").alias("bucket"))
    counted = counted.agg(F.count("*").alias("total"), F.count_if(F.col("risk_rank") >= 2).alias("high"))
    every = scored.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(F.broadcast(counted), "bucket", "left").na.fill(0, ["total", "high"])  # at most ``buckets`` rows
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.round(F.col("high") / F.col("total"), 4)).otherwise(0.0))


def risk_direction(scored: DataFrame, unit: float = 60.0, as_of: int | None = None) -> DataFrame:
    """One row: numbers, totals and ratios of high risk in the last 5, 15 and 60 units, and the direction of the last 5 against the 5 before."""
    rows = _with_now(scored.select("micros", (F.col("risk_rank") >= 2).alias("high")), as_of)
    age = lambda w: F.col("micros") >= F.col("now") - int(w * unit * 1e6)
    one = rows.where(age(60)).agg(
        *[F.count_if(age(w)).alias(f"total_{w}") for w in (5, 15, 60)], *[F.count_if(age(w) & F.col("high")).alias(f"high_{w}") for w in (5, 15, 60)], F.count_if(age(10) & ~age(5) & F.col("high")).alias("before")
    )
    ratio = {f"ratio_{w}": F.when(F.col(f"total_{w}") > 0, F.round(F.col(f"high_{w}") / F.col(f"total_{w}"), 6)).otherwise(0.0) for w in (5, 15, 60)}
    direction = F.when(F.col("high_5") > F.col("before"), "up").when(F.col("high_5") < F.col("before"), "down").otherwise("flat")
    return one.withColumns(ratio).withColumn("direction", direction).drop("before")


def session_posture(current: DataFrame) -> DataFrame:
    """One row over sessions' current levels (session_id, risk_rank, mapped: whether the latest record is classified): score 100 - min(100, 20 a critical + 10 a high session), level, drivers."""
    one = current.agg(F.count_if(F.col("risk_rank") == 3).alias("critical"), F.count_if(F.col("risk_rank") == 2).alias("high"), F.count_if("mapped").alias("mapped"))
    score = F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), 20.0 * F.col("critical") + 10.0 * F.col("high")))
    level = F.when(score < 50, "critical").when(score < 75, "elevated").when(score < 90, "watch").otherwise("healthy")
    drivers = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat_ws(":", F.lit(n), F.col(c).cast("string"))) for c, n in (("critical", "critical_sessions"), ("high", "high_sessions"), ("mapped", "mapped_active_sessions"))]))
    return one.select("critical", "high", F.round(score, 1).alias("score"), level.alias("level"), F.array_join(drivers, ",").alias("drivers"))


def session_counts(current: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(name, total_sessions, high_or_critical_count, critical_count, high_or_critical_ratio, critical_ratio) of the ``most`` keys with most high, then critical, then all sessions (then by name)."""
    rows = current.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias("name")).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_if(F.col("risk_rank") >= 2).alias("high_or_critical_count"), F.count_if(F.col("risk_rank") == 3).alias("critical_count")
    )
    share = lambda c: F.round(F.col(c) / F.col("total_sessions"), 6)
    rows = rows.withColumns({"high_or_critical_ratio": share("high_or_critical_count"), "critical_ratio": share("critical_count")})
    return rows.orderBy(F.desc("high_or_critical_count"), F.desc("critical_count"), F.desc("total_sessions"), "name").limit(most)


def current_sessions(scored: DataFrame, *more: str) -> DataFrame:
    """The latest record of each session, with further columns."""
    names = ("risk_level", "risk_rank", "source_framework", "workspace_root", *more)
    last = scored.groupBy("session_id").agg(F.max_by(F.struct(*names), F.struct("micros", "event_id")).alias("x"), F.max("micros").alias("last_micros"))
    return last.select("session_id", "last_micros", "x.*")


def top_usage(usage: DataFrame) -> DataFrame:
    """(dimension, value): the label of each dimension with most tokens, then most calls, then the first by name; usage as usage_rollup() gives it."""
    order = F.struct((-(F.col("input_tokens") + F.col("output_tokens"))).alias("tokens"), (-F.col("calls")).alias("calls"), "value")
    return usage.groupBy("dimension").agg(F.min_by("value", order).alias("value"))


def replay_range(records: DataFrame, session: int, first: int, last: int) -> DataFrame:
    """A session's records with ids from ``first`` to ``last``, both included, in order; the filters reach the scan of events, so score what this gives, not before it."""
    return records.where((F.col("session_id") == session) & F.col("event_id").between(first, last)).orderBy("event_id")


def invalid_rates(events: DataFrame, invalid: Column, windows: tuple[int, ...] = (1, 5, 15), unit: float = 60.0, as_of: int | None = None) -> DataFrame:
    """(window, total, invalid, rate, alert) for each window length in units: critical for over 20 invalid in 1 or over 1 % in 5, medium for 0.1 to 1 % in 15; rates are tested before they are rounded."""
    rows = _with_now(events.select("micros", invalid.alias("bad")), as_of)
    rows = rows.where(F.col("micros") >= F.col("now") - int(max(windows) * unit * 1e6))
    inside = {w: F.col("micros") >= F.col("now") - int(w * unit * 1e6) for w in windows}
    counts = rows.agg(*[F.count_if(c).alias(f"t{w}") for w, c in inside.items()], *[F.count_if(c & F.col("bad")).alias(f"i{w}") for w, c in inside.items()])
    parts = [F.struct(F.lit(w).alias("window"), F.col(f"t{w}").alias("total"), F.col(f"i{w}").alias("invalid")) for w in windows]
    out = counts.select(F.inline(F.array(*parts)))
    rate = F.when(F.col("total") > 0, F.col("invalid") / F.col("total")).otherwise(0.0)
    alert = F.when((F.col("window") == 1) & (F.col("invalid") > 20), "critical").when((F.col("window") == 5) & (rate > 0.01), "critical")
    alert = alert.when((F.col("window") == 15) & (F.col("total") > 0) & (rate >= 0.001) & (rate <= 0.01), "medium").otherwise("none")
    return out.select("*", F.round(rate, 6).alias("rate"), alert.alias("alert"))


#: Weight of the invalid rate and the lower bounds of the states, best first, by version.
POSTURES = {1: (30.0, (("healthy", 90), ("guarded", 70), ("degraded", 40)), "critical"), 2: (15.0, (("healthy", 90), ("watch", 75), ("elevated", 50)), "critical")}


def posture(scored: DataFrame, invalid: Column | None = None, window: int = 900, unit: float = 1.0, as_of: int | None = None, version: int = 2) -> DataFrame:
    """One row: score 100 - min(100, 20 a critical record + 10 a high one + 25 recent high ratio + 15 or 30 recent invalid rate), its state and up to three drivers.

    invalid: whether a record is an invalid event, which has no risk; ratios are over the last ``window`` units, of valid and of all records.
    """
    weight, states, worst = POSTURES[version]
    rows = _with_now(scored.select("micros", "risk_rank", (F.coalesce(invalid, F.lit(False)) if invalid is not None else F.lit(False)).alias("bad")), as_of)
    recent = F.col("micros") >= F.col("now") - int(window * unit * 1e6)
    one = rows.agg(
        F.count_if(~F.col("bad") & (F.col("risk_rank") == 3)).alias("critical"), F.count_if(~F.col("bad") & (F.col("risk_rank") == 2)).alias("high"), F.count_if(recent).alias("all"),
        F.count_if(recent & ~F.col("bad")).alias("valid"), F.count_if(recent & ~F.col("bad") & (F.col("risk_rank") >= 2)).alias("risky"), F.count_if(recent & F.col("bad")).alias("wrong"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    one = one.withColumns({"high_ratio": share("risky", "valid"), "invalid_rate": share("wrong", "all")})
    impact = [("critical", 20.0 * F.col("critical")), ("high", 10.0 * F.col("high")), ("recent_high", 25.0 * F.col("high_ratio")), ("recent_invalid", weight * F.col("invalid_rate"))]
    total = F.lit(0.0)
    for _, x in impact:
        total = total + x
    score = F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), total))
    ranked = F.sort_array(F.array(*[F.struct(x.alias("impact"), F.lit(-k).alias("nth"), F.lit(name).alias("name")) for k, (name, x) in enumerate(impact)]), asc=False)
    drivers = F.slice(F.transform(F.filter(ranked, lambda x: x["impact"] > 0), lambda x: x["name"]), 1, 3)
    state = F.lit(worst)
    for name, least in reversed(states):
        state = F.when(F.col("raw") >= least, name).otherwise(state)
    one = one.withColumn("raw", score)
    return one.select("critical", "high", F.round("high_ratio", 4).alias("high_ratio"), F.round("invalid_rate", 4).alias("invalid_rate"), F.round("raw", 1).alias("score"), state.alias("state"), F.array_join(drivers, ",").alias("drivers"))


def session_list(scored: DataFrame, since: int | None = None, least: str | None = None, sort: str = "risk_level", most: int = 50, unit: float = 1.0) -> DataFrame:
    """(session_id, risk_level, last_micros, events): sessions by their latest level, highest risk or newest first; 1 to 200 of them."""
    last = F.max(F.struct("micros", "event_id", "risk_level"))
    rows = _with_now(scored.select("session_id", "micros", "event_id", "risk_level"), None)
    rows = rows.groupBy("session_id").agg(last.alias("last"), F.count("*").alias("events"), F.max("now").alias("now"))
    rows = rows.select("session_id", F.col("last.risk_level").alias("risk_level"), F.col("last.micros").alias("last_micros"), "events", "now")
    if since:
        rows = rows.where(F.col("last_micros") >= F.col("now") - int(since * unit * 1e6))
    rank = S.risk_rank(F.col("risk_level"))
    if least:
        rows = rows.where(rank >= S.risk_rank(F.lit(least)))
    order = [F.desc("last_micros"), rank.desc()] if sort == "last_event" else [rank.desc(), F.desc("last_micros")]
    return rows.drop("now").orderBy(*order, "session_id").limit(min(max(most, 1), 200))


def alert_list(alerts: DataFrame, severity: str | None = None, acknowledged: bool | None = None, since: int | None = None, most: int = 100, unit: float = 1.0) -> DataFrame:
    """Alerts (alert_id, severity, acknowledged, micros), newest first, 1 to 1000 of them, each with how many of all alerts are open, and open of high or critical severity."""
    is_open = ~F.coalesce("acknowledged", F.lit(False))
    counts = alerts.agg(F.count_if(is_open).alias("total_open"), F.count_if(is_open & F.col("severity").isin("high", "critical")).alias("priority_open"), F.max("micros").alias("now"))
    rows = alerts.crossJoin(F.broadcast(counts))  # one row
    if since:
        rows = rows.where(F.col("micros") >= F.col("now") - int(since * unit * 1e6))
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    if acknowledged is not None:
        rows = rows.where(is_open != F.lit(acknowledged))
    return rows.drop("now").orderBy(F.desc("micros"), "alert_id").limit(min(max(most, 1), 1000))


def audit_search(scored: DataFrame, session: int | None = None, since: int | None = None, risk: str | None = None, verdict: str | None = None, tool: str | None = None, most: int = 100) -> DataFrame:
    """Newest ``most`` records that fit all given filters (the tool by substring, any case); filters come before the limit."""
    rows = scored
    for column, value in (("session_id", session), ("risk_level", risk and risk.lower()), ("verdict", verdict and verdict.lower())):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("micros") >= since)
    if tool:
        rows = rows.where(F.contains(F.lower("tool_name"), F.lit(tool.lower())))
    return rows.select("event_id", "session_id", "micros", "tool_name", "risk_level", "verdict").orderBy(F.col("micros").desc(), F.col("event_id").desc()).limit(most)


def audit_stats(scored: DataFrame, most: int = 5) -> DataFrame:
    """summary() by risk level, verdict and framework, and the ``most`` busiest sessions (smaller id first among equals)."""
    top = scored.groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "session_id").limit(most)
    return summary(scored, ("risk_level", "verdict", "source_framework")).unionByName(top.select(F.lit("session").alias("dimension"), F.col("session_id").cast("string").alias("value"), "n"))


def replay_page(scored: DataFrame, before: int, most: int = 50) -> DataFrame:
    """The newest ``most`` records with an id below the cursor, and next_cursor: the least id of the page if older ones remain."""
    page = scored.where(F.col("event_id") < before).select("event_id", "session_id", "verdict").orderBy(F.col("event_id").desc()).limit(most + 1)
    page = page.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("event_id").desc())))  # most + 1 rows
    more = page.agg((F.count("*") > most).alias("more"), F.min(F.when(F.col("nth") <= most, F.col("event_id"))).alias("least"))
    return page.where(F.col("nth") <= most).crossJoin(F.broadcast(more)).select("event_id", "session_id", "verdict", F.when(F.col("more"), F.col("least")).alias("next_cursor"))


def latency_histogram(rows: DataFrame, value: str, by: str, edges: tuple[float, ...]) -> DataFrame:
    """(by, edge, n): cumulative counts up to each edge, the last edge null for all."""
    wide = rows.groupBy(by).agg(*[F.count_if(F.col(value) <= e).alias(f"e{i}") for i, e in enumerate(edges)], F.count(value).alias("all"))
    parts = [F.struct(F.lit(e).cast("double").alias("edge"), F.col(f"e{i}").alias("n")) for i, e in enumerate(edges)]
    parts.append(F.struct(F.lit(None).cast("double").alias("edge"), F.col("all").alias("n")))
    return wide.select(by, F.inline(F.array(*parts)))


def usage_rollup(events: DataFrame, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """(dimension, value, calls, input_tokens, output_tokens, cost) in total, by framework and by tool; prices per million tokens."""
    cells = events.groupBy("source_framework", "tool_name").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    parts = [F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("total", F.lit("")), ("framework", F.col("source_framework")), ("tool", F.col("tool_name")))]
    out = cells.select("calls", "i", "o", F.inline(F.array(*parts))).groupBy("dimension", "value").agg(F.sum("calls").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
    return out.withColumn("cost", F.round((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6, 6))


def token_budget(events: DataFrame, limit: int) -> DataFrame:
    """(day, used, unknown, exhausted_by): tokens of each UTC day, rows without any, and the event that first reached the limit.

    Hour totals are summed up first, so that no task has to order a whole day: only the hour in which the
    limit is reached is walked event by event.
    """
    hour = 3_600_000_000
    rows = events.select("event_id", "micros", F.floor(F.col("micros") / hour).alias("hour"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    hours = rows.groupBy("hour").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") == 0).alias("unknown"))
    hours = hours.withColumn("day", F.floor(F.col("hour") / 24))
    w = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    hours = hours.withColumn("upto", F.sum("tokens").over(w))
    days = hours.groupBy("day").agg(F.sum("tokens").alias("used"), F.sum("unknown").alias("unknown"))
    turning = hours.where((F.col("upto") >= limit) & (F.col("upto") - F.col("tokens") < limit)).select("day", "hour", (F.col("upto") - F.col("tokens")).alias("start"))
    inside = rows.join(turning, "hour")
    w = Window.partitionBy("hour").orderBy("micros", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sofar", F.col("start") + F.sum("tokens").over(w)).where(F.col("sofar") >= limit)
    first = inside.groupBy("day").agg(F.min_by("event_id", F.struct("micros", "event_id")).alias("exhausted_by"))
    return days.join(first, "day", "left").select(F.date_format(F.timestamp_seconds(F.col("day") * 86400), "yyyy-MM-dd").alias("day"), "used", "unknown", "exhausted_by")


def workspace_rollup(scored: DataFrame) -> DataFrame:
    """(source_framework, workspace, sessions, events, high, highest): counts by framework and workspace, with framework and grand totals as null keys."""
    sessions = scored.groupBy("source_framework", F.when(F.col("workspace_root") == "", "unbound").otherwise(F.col("workspace_root")).alias("workspace"), "session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_rank") >= 2).alias("high"), F.max("risk_rank").alias("top")
    )
    return sessions.rollup("source_framework", "workspace").agg(F.countDistinct("session_id").alias("sessions"), F.sum("n").alias("events"), F.sum("high").alias("high"), F.max("top").alias("highest"))


def dashboard(scored: DataFrame) -> DataFrame:
    """One row: block rate, risk density, distinct sessions, workspaces and frameworks."""
    return scored.agg(
        F.round(100 * F.count_if(F.col("verdict") == "block") / F.count("*"), 4).alias("block_rate"), F.round(F.count_if(F.col("risk_rank") >= 2) / F.count("*"), 4).alias("risk_density"),
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("workspace_root").alias("workspaces"), F.countDistinct("source_framework").alias("frameworks"),
    )


def priority_sessions(scored: DataFrame, least: str = "high", most: int = 6) -> DataFrame:
    """Sessions whose highest level is at least ``least``: highest first, then the newest."""
    from ..functions.scoring import risk_rank

    rows = scored.groupBy("session_id").agg(F.max("risk_rank").alias("top"), F.max("micros").alias("last"), F.count("*").alias("events"))
    return rows.where(F.col("top") >= risk_rank(F.lit(least))).orderBy(F.col("top").desc(), F.col("last").desc(), "session_id").limit(most)


def live_overview(classified: DataFrame) -> DataFrame:
    """(dimension, value, n): the latest record of every session by level, tier and subtype."""
    last = classified.groupBy("session_id").agg(F.max(F.struct("micros", "event_id", "risk_level", "tier", "subtype")).alias("x")).select("x.*")
    return summary(last, ("risk_level", "tier", "subtype"))


def latency_pressure(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, calls, total, last, largest, pressure): timing of operations, with a pressure level at 0.05, 0.25 and 1 seconds."""
    out = rows.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"), F.max_by(value, F.struct("micros", "event_id")).alias("last"), F.max(value).alias("largest"))
    level = F.when(F.col("largest") >= 1.0, "high").when(F.col("largest") >= 0.25, "medium").when(F.col("largest") >= 0.05, "low").otherwise("none")
    return out.withColumn("pressure", level)
