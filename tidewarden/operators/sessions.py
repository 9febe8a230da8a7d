"""Session operators. All of them order a session by (micros, event_id) and share one partitioning by session.

accumulation, session_risk, risk_changes, enforcement and cumulative_points also take rows whose long sessions are split
into blocks (operators.blocks), and give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from .blocks import ORDER, blocked, in_order, part, running
from .score import apart, dimensions, with_level


def _session(*more: str) -> Window:
    return Window.partitionBy("session_id").orderBy(*ORDER, *more)


def frequency_d4(events: DataFrame, unit: float = 1.0, burst: int = 10, repetitive: int = 20, rate: int = 60) -> DataFrame:
    """Add freq_d4: 2 for ``burst`` calls of one tool within 5 time units, 1 for ``repetitive`` of one tool or ``rate`` of all within 60.

    The bounds are inclusive; the row itself counts, later rows of the same instant don't. ``unit`` is the
    length of a time unit in seconds. Every tool of the session counts, not the row's alone: a tool has n calls in a window if its n-th newest call
    lies in it, and the largest time of an n-th newest call, over all rows so far, is that of some tool's newest call. So running maxima decide, in one order of the session.
    """
    tick = int(unit * 1e6)
    by_tool = Window.partitionBy("session_id", "tool_name").orderBy(*ORDER)
    so_far = _session().rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({"_burst": F.lag("micros", burst - 1).over(by_tool), "_many": F.lag("micros", repetitive - 1).over(by_tool)})
    out = out.withColumns({"_burst": F.max("_burst").over(so_far), "_many": F.max("_many").over(so_far), "_all": F.lag("micros", rate - 1).over(_session())})
    within = lambda c, width: F.coalesce(F.col(c) >= F.col("micros") - width * tick, F.lit(False))
    value = F.when(within("_burst", 5), 2).when(within("_many", 60) | within("_all", 60), 1).otherwise(0)
    return out.withColumn("freq_d4", value).drop("_burst", "_many", "_all")


def phases(events: DataFrame, t: S.Thresholds = S.Thresholds(), freq: Column | None = None) -> DataFrame:
    """The dimensions of events, and whether each is of high risk at d4 of 0, 1 and 2 (h0 to h2); freq is the d4 that the frequency of calls gives."""
    freq = F.lit(0) if freq is None else freq
    rows = dimensions(events).withColumn("freq", freq).withColumn("sc_rule", S.short_circuit(F.col("d1"), F.col("d2"), F.col("d3")))
    return apart(rows, {
        f"h{k}": (S.risk_rank(S.level(
            S.composite(*(F.col(c) for c in ("d1", "d2", "d3")), F.greatest(F.lit(k), "freq"), F.col("d5"), F.col("d6"), t), F.col("sc_rule"), F.col("d6"), t
        )) >= 2).cast("int") for k in (0, 1, 2)
    })


def _phase_starts(rows: DataFrame, mid: int, more: int) -> DataFrame:
    """Per block the sums before it (_p0 to _p2) and the sums of its session where the second and the third phase begin (_base1, _base2); rows have the sums inside blocks."""
    c1, c2 = F.col("c1"), F.col("c2")
    sums = rows.where("block > 0").groupBy("session_id", "block").agg(
        *[F.coalesce(F.sum(f"h{k}"), F.lit(0)).alias(f"_n{k}") for k in (0, 1, 2)], *[F.min(f"_{x}{k}").alias(f"_{x}{k}") for x in "be" for k in range(1, mid + 1)],
        *[F.min(F.when(c1 >= k, c2)).alias(f"_s{k}") for k in range(1, more + 1)],
    )
    earlier, whole = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("session_id")
    sums = sums.withColumns({f"_p{k}": F.coalesce(F.sum(f"_n{k}").over(earlier), F.lit(0)) for k in (0, 1, 2)})
    p0, p1, p2 = F.col("_p0"), F.col("_p1"), F.col("_p2")
    # before the block the second phase has begun, or the block lacks k events for it
    start = F.when(p0 >= mid, p1)
    for k in range(1, mid + 1):
        start = start.when(p0 == mid - k, F.col(f"_b{k}") + p1)
    sums = sums.withColumn("_base1", F.min(start).over(whole))
    left = more + F.col("_base1") - p1
    begun = F.when(left <= 0, p2)
    for k in range(1, more + 1):
        begun = begun.when(left == k, F.col(f"_s{k}") + p2)
    start = F.when(p0 >= mid, begun)
    for k in range(1, mid + 1):
        start = start.when(p0 == mid - k, F.col(f"_e{k}") + p2)
    sums = sums.withColumn("_base2", F.min(start).over(whole))
    return sums.select(F.col("session_id").alias("_key"), F.col("block").alias("_block"), "_p0", "_p1", "_p2", "_base1", "_base2")


def accumulation(events: DataFrame, mid: int = 2, high: int = 5, t: S.Thresholds = S.Thresholds(), freq: Column | None = None) -> DataFrame:
    """Score events in session order, with d4 from the number of earlier high-risk events (>= ``high``: 2, >= ``mid``: 1).

    d4 feeds the level that feeds the count. The count only grows, so a session has three phases with
    a fixed d4 each, and three running sums replace the recurrence: no fold, no Python. A phase counts from the sum at its first row on. Blocks are
    summed up once, by one row each, for all phases together. Events may have their phases() already.
    """
    rows = events if "h0" in events.columns else phases(events, t, freq)
    c0, c1, c2, more = F.col("c0"), F.col("c1"), F.col("c2"), high - mid
    before, so_far = (in_order(rows).rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    # sums over earlier rows, and from where the second and third phase count: _b and _e, for each number of events of high risk that a block may lack
    lacking = range(1, mid + 1) if blocked(rows) else []
    rows = rows.withColumns({f"c{k}": F.coalesce(F.sum(f"h{k}").over(before), F.lit(0)) for k in (0, 1, 2)})
    rows = rows.withColumns({f"_b{k}": F.min(F.when(c0 >= k, c1)).over(so_far) for k in {*lacking, mid}})
    rows = rows.withColumns({f"_e{k}": F.min(F.when((c0 >= k) & (c1 - F.col(f"_b{k}") >= more), c2)).over(so_far) for k in {*lacking, mid}})
    helpers = [f"_{x}{k}" for x in "be" for k in {*lacking, mid}]
    base1, base2 = F.col(f"_b{mid}"), F.col(f"_e{mid}")
    if blocked(rows):
        rows, carried = rows.join(_phase_starts(rows, mid, more), (F.col("session_id").eqNullSafe(F.col("_key"))) & (F.col("block") == F.col("_block")), "left"), F.col("_block").isNotNull()
        base1, base2 = F.when(carried, F.col("_base1")).otherwise(base1), F.when(carried, F.col("_base2")).otherwise(base2)
        rows = rows.withColumns({"_base1": base1, "_base2": base2} | {f"c{k}": F.col(f"c{k}") + F.coalesce(f"_p{k}", F.lit(0)) for k in (0, 1, 2)})
        base1, base2, helpers = F.col("_base1"), F.col("_base2"), [*helpers, "_base1", "_base2", "_p0", "_p1", "_p2", "_key", "_block"]
    first, second = mid + c1 - base1, high + c2 - base2
    count = F.when(c0 < mid, c0).when(first < high, first).otherwise(second)
    rows = rows.withColumn("prior_high", count.cast("long"))
    d4 = F.greatest(F.when(F.col("prior_high") >= high, 2).when(F.col("prior_high") >= mid, 1).otherwise(0), "freq")
    return with_level(rows.drop(*helpers), d4, t).drop("h0", "h1", "h2", "c0", "c1", "c2", "freq")


def session_risk(scored: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Per session: events, high_events, latest, total, mean_score, ewma, points and velocity.

    One window ranks the rows from the newest, and one aggregate over the same partitioning sums them up, with the moving average (seeded with the first
    value) as a sum of decayed shares. A block's sum decays by the rows of the blocks after it: a second aggregate over one row a block.
    """
    rows = scored.select(*part(scored), *ORDER, "composite", "risk_rank")
    back = F.row_number().over(Window.partitionBy(*part(rows)).orderBy(F.col("micros").desc(), F.col("event_id").desc()))
    rows = rows.withColumn("share", alpha * F.pow(F.lit(1 - alpha), back - 1) * F.col("composite"))
    at, value = F.struct(*ORDER), F.struct(*ORDER, "composite")
    blocks = rows.groupBy(*part(rows)).agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_rank") >= 2).alias("high"), F.max(value).alias("last"), F.min(value).alias("first"),
        F.sum("composite").alias("total"), F.sum("share").alias("share"), F.sum("risk_rank").alias("points"), F.min(at).alias("start"),
    )
    if blocked(rows):
        after = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = blocks.withColumn("share", F.col("share") * F.pow(F.lit(1 - alpha), after))
    events, first = F.sum("n"), F.min("first")["composite"]
    out = blocks.groupBy("session_id").agg(
        events.alias("events"), F.sum("high").alias("high_events"), F.max("last")["composite"].alias("latest"), first.alias("first"),
        F.round(F.sum("total"), 4).alias("total"), F.round(F.sum("total") / events, 4).alias("mean_score"),
        F.round(F.sum("share") + F.pow(F.lit(1 - alpha), events) * first, 4).alias("ewma"), F.sum("points").alias("points"),
    )
    change = F.col("latest") - F.col("first")
    velocity = F.when(F.col("events") < 2, "unknown").when(change > 0.25, "up").when(change < -0.25, "down").otherwise("flat")
    return out.withColumn("velocity", velocity).drop("first")


def session_profile(scored: DataFrame) -> DataFrame:
    """Per session: counts, verdict and tool distributions as maps, tools, first and last time, latest level."""
    rows = scored.select("session_id", *ORDER, "verdict", "tool_name", "risk_level", "risk_rank", "composite", "source_framework")
    # one count per (session, verdict, tool) first: the map-side combine leaves a few rows a session
    cells = rows.groupBy("session_id", "verdict", "tool_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_rank") >= 2).alias("high"), F.min("micros").alias("first"),
        F.max(F.struct("micros", "event_id", "risk_level", "composite")).alias("last"),
    )
    return cells.groupBy("session_id").agg(
        F.sum("n").alias("events"), F.sum("high").alias("high_events"), F.coalesce(F.sum(F.when(F.col("verdict") == "block", F.col("n"))), F.lit(0)).alias("blocked"),
        F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools"), F.min("first").alias("first_micros"),
        F.max("last")["micros"].alias("last_micros"), F.max("last")["risk_level"].alias("latest_level"), F.floor(F.max("last")["composite"]).cast("long").alias("cumulative_score"),
    )


def timeline(scored: DataFrame, most: int = 1000) -> DataFrame:
    """The newest ``most`` entries of every session with their position from the newest; a top-n per group."""
    newest = Window.partitionBy("session_id").orderBy(F.col("micros").desc(), F.col("event_id").desc())
    return scored.select("session_id", *ORDER, "risk_level", "composite").withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)


def risk_changes(scored: DataFrame) -> DataFrame:
    """Session starts and rises of the risk level, with an alert flag at high or above."""
    rows = running(scored.select(*part(scored), *ORDER, "risk_level", "risk_rank"), {"previous": ("last", F.col("risk_rank"))})
    rows = rows.where(F.col("previous").isNull() | (F.col("risk_rank") > F.col("previous")))
    return rows.select("session_id", "event_id", "risk_level", F.when(F.col("previous").isNull(), "start").otherwise("rise").alias("change"), (F.col("risk_rank") >= 2).alias("alert"))


def enforcement(scored: DataFrame, threshold: int = 3, cooldown: float = 600.0, unit: float = 1.0) -> DataFrame:
    """Add high_before, enforced and triggers: a session with ``threshold`` high-risk events is enforced until ``cooldown`` units pass without any event."""
    rows = scored.select(*part(scored), *ORDER, "risk_rank")
    rows = running(rows, {"high_before": ("sum", (F.col("risk_rank") >= 2).cast("long")), "_last": ("last", F.col("micros"))})
    gap = (F.col("micros") - F.col("_last")) / (unit * 1e6)
    rows = rows.withColumn("enforced", F.coalesce((F.col("high_before") >= threshold) & (gap < cooldown), F.lit(False)))
    reached = F.col("high_before") + (F.col("risk_rank") >= 2).cast("int") >= threshold
    return rows.withColumn("triggers", reached & ~F.col("enforced")).drop("risk_rank", "_last", "block")


def forced_enforcement(scored: DataFrame, forced: DataFrame, threshold: int = 3, cooldown: float = 600.0, unit: float = 1.0) -> DataFrame:
    """enforcement() with sessions forced into it by findings (session_id, micros): a forced state holds for ``cooldown`` units from its last
    finding before the event, and isn't refreshed by events. Findings at the same time come first. A union and one window, as no range join is needed."""
    rows = enforcement(scored, threshold, cooldown, unit).select("session_id", *ORDER, "high_before", "enforced").withColumn("_side", F.lit(1))
    marks = forced.select("session_id", "micros", F.lit(None).cast(dict(rows.dtypes)["event_id"]).alias("event_id"), F.lit(None).cast("bigint").alias("high_before"), F.lit(None).cast("boolean").alias("enforced"), F.lit(0).alias("_side"))
    last = F.last(F.when(F.col("_side") == 0, F.col("micros")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("micros", "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(marks).withColumn("_last", last).where("_side = 1")
    held = F.coalesce(F.col("micros") - F.col("_last") < int(cooldown * unit * 1e6), F.lit(False))
    return both.select("session_id", *ORDER, (F.col("enforced") | held).alias("enforced"), held.alias("forced"))


def output_summary(findings: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(session_id, events, latest, total, mean_score, ewma) of output scores (session_id, micros, event_id, score) in order; the recurrence is a weighted sum."""
    newest = Window.partitionBy("session_id").orderBy(F.col("micros").desc(), F.col("event_id").desc())
    rows = findings.select("session_id", "score", (F.row_number().over(newest) - 1).alias("back"), F.count("*").over(Window.partitionBy("session_id")).alias("n"))
    weight = F.when(F.col("back") == F.col("n") - 1, F.pow(F.lit(1 - alpha), F.col("back"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("back")))
    return rows.groupBy("session_id").agg(
        F.count("*").alias("events"), F.round(F.max(F.when(F.col("back") == 0, F.col("score"))), 4).alias("latest"), F.round(F.sum("score"), 4).alias("total"),
        F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.sum(F.col("score") * weight), 4).alias("ewma"),
    )


def as_of(events: DataFrame, states: DataFrame, key: str = "session_id", state: str = "state") -> DataFrame:
    """Each event with the latest state strictly before it (by micros): a union and one window, as no range join is needed."""
    left = events.withColumn("_state", F.lit(None).cast(states.schema[state].dataType)).withColumn("_side", F.lit(0))
    right = states.select(key, "micros", F.col(state).alias("_state"), F.lit(1).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    window = Window.partitionBy(key).orderBy("micros", "_side").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_last", F.last("_state", ignorenulls=True).over(window))
    return out.where("_side = 0").withColumn(state, F.col("_last")).drop("_state", "_side", "_last")


def cumulative_points(scored: DataFrame, least: int = 5) -> DataFrame:
    """Events at which a session's running risk points reach ``least``."""
    rows = running(scored.select(*part(scored), *ORDER, "risk_rank"), {"points": ("sum", F.col("risk_rank"))}, inclusive=True)
    return rows.where((F.col("points") >= least) & (F.col("points") - F.col("risk_rank") < least)).select("session_id", "event_id", "points")


def activity_states(scored: DataFrame, unit: float = 1.0, as_of: int | None = None) -> DataFrame:
    """(session_id, last_micros, activity): hot, warm or idle at ``as_of`` (default the newest event)."""
    from ..functions.actions import activity

    last = scored.groupBy("session_id").agg(F.max("micros").alias("last_micros"))
    now = F.lit(as_of) if as_of is not None else None
    if now is None:
        last = last.crossJoin(F.broadcast(last.agg(F.max("last_micros").alias("now"))))  # one row
        now = F.col("now")
    return last.select("session_id", "last_micros", activity(F.col("last_micros"), now, unit).alias("activity"))


def busy_clients(events: DataFrame, most: int, window: float, unit: float = 1.0) -> DataFrame:
    """(session_id, peak): sessions with more than ``most`` events in some sliding window of ``window`` units, by a range frame."""
    frame = Window.partitionBy("session_id").orderBy("micros").rangeBetween(-int(window * unit * 1e6), 0)
    rows = events.select("session_id", F.count("*").over(frame).alias("n"))
    return rows.groupBy("session_id").agg(F.max("n").alias("peak")).where(F.col("peak") > most)


def latest_annotations(records: DataFrame, columns: list[str]) -> DataFrame:
    """Per session the last value of each column that isn't null: one aggregate, combined before the shuffle."""
    at = F.struct(*ORDER)
    return records.groupBy("session_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def heartbeat_deltas(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """(session_id, from_event_id, records, has_high): what each session has after the last record of its last review."""
    done = reviews.groupBy("session_id").agg(F.max("to_event_id").alias("done"))
    rows = records.join(done, "session_id", "left").where(F.col("event_id") > F.coalesce("done", F.lit(-1)))
    return rows.groupBy("session_id").agg(F.min("event_id").alias("from_event_id"), F.count("*").alias("records"), F.bool_or(F.col("risk_rank") >= 2).alias("has_high"))
