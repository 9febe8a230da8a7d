"""Structured Streaming versions: stateless scoring, windowed rates, session windows, idempotent ingest and per-session state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scoring import Thresholds
from ..operators.score import dimensions, score_events


def stream_events(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New Parquet files under a path, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def scored_stream(events: DataFrame) -> DataFrame:
    """Stateless scoring: the batch projection, unchanged."""
    return score_events(events)


def high_risk_windows(scored: DataFrame, time: str = "occurred_at", window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, total, high) by tumbling or sliding event-time windows; rows later than the watermark are dropped."""
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return scored.withWatermark(time, late).groupBy(frame.alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("risk_rank") >= 2).alias("high")).select("w.start", "total", "high")


def session_windows(scored: DataFrame, time: str = "occurred_at", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_id, start, end, events, high): activity split at gaps."""
    frame = F.session_window(time, gap)
    rows = scored.withWatermark(time, late).groupBy("session_id", frame.alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("risk_rank") >= 2).alias("high"))
    return rows.select("session_id", "w.start", "w.end", "events", "high")


def ingest_once(events: DataFrame, key: str = "event_id", time: str = "occurred_at", late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class SessionScorer(StatefulProcessor):
    """Per session: number of high-risk events, last time and last level; emits d4, level, rises and enforcement for each event.

    State is one row a session; with ``ttl_ms`` it goes after so much processing time without an event. Rows of a batch are taken in (micros, event_id) order.
    """

    def __init__(self, threshold: int = 3, cooldown_micros: int = 600_000_000, ttl_ms: int | None = None, t: Thresholds | None = None):
        self.threshold, self.cooldown, self.ttl, self.t = threshold, cooldown_micros, ttl_ms, t or Thresholds()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "high long, micros long, rank int", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        high, last, rank = self.state.get() if self.state.exists() else (0, None, -1)
        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        out, high, last, rank = score_rows(batch, high, last, rank, self.threshold, self.cooldown, self.t)
        self.state.update((high, last, rank))
        yield out

    def close(self) -> None:
        pass


def ranks(rows: pd.DataFrame, d4, t: Thresholds) -> np.ndarray:
    """The levels of rows with dimensions, 0-3; the same rules as functions.scoring, which a test compares."""
    a, b, c, e, f = (rows[x].to_numpy() for x in ("d1", "d2", "d3", "d5", "d6"))
    raw = (t.weight_max * np.maximum(np.maximum(a, b), c) + t.weight_d4 * d4 + t.weight_d5 * e) * (1.0 + t.injection * f / 3.0)
    score = np.floor(raw * 1e4 + 0.5) / 1e4
    out = (score >= t.medium).astype(int) + (score >= t.high) + (score >= t.critical)
    out = np.where(((a == 3) & (b >= 2)) | (c == 3), 3, np.where((a == 0) & (b == 0) & (c == 0), 0, out))
    return np.where((f >= 2.0) & (out == 0), 1, out)


def prior_counts(high: int, by_d4: list[np.ndarray], bounds: tuple[int, ...] = (2, 5)) -> np.ndarray:
    """Earlier high-risk events before each row and after the last; by_d4: whether a row is one under d4 of 0, 1, 2. The count only grows, so
    each phase of d4 is one running sum."""
    n = len(by_d4[0])
    out, at = np.full(n + 1, high, np.int64), 0
    for phase, hit in enumerate(by_d4):
        if phase < len(bounds) and out[at] >= bounds[phase]:
            continue
        out[at + 1 :] = out[at] + np.cumsum(hit[at:])
        if phase < len(bounds):
            at += int(np.searchsorted(out[at:], bounds[phase]))
            if at > n:
                break
    return out


def score_rows(rows: pd.DataFrame, high: int, last: int | None, rank: int, threshold: int, cooldown: int, t: Thresholds, freq: np.ndarray | int = 0) -> tuple[pd.DataFrame, int, int, int]:
    """Rows of one session in order with prior_high, d4, risk_rank, rises and enforced, and the state after them. freq: d4 by frequency."""
    levels = [ranks(rows, np.maximum(k, freq), t) for k in (0, 1, 2)]
    count = prior_counts(high, [x >= 2 for x in levels])
    d4 = (count[:-1] >= 2).astype(int) + (count[:-1] >= 5)
    level = np.choose(d4, levels)
    micros = rows["micros"].to_numpy()
    before = np.concatenate([[micros[0] if last is None else last], micros[:-1]])
    enforced = (count[:-1] >= threshold) & (micros - before < cooldown)
    if last is None:
        enforced[0] = False
    out = pd.DataFrame({
        "session_id": rows["session_id"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "prior_high": count[:-1], "d4": np.maximum(d4, freq).astype(np.int32), "risk_rank": level.astype(np.int32),
        "rises": level > np.concatenate([[rank], level[:-1]]), "enforced": enforced,
    })
    return out, int(count[-1]), int(micros[-1]), int(level[-1])


def session_state(events: DataFrame, **options) -> DataFrame:
    """(session_id, event_id, prior_high, d4, risk_rank, rises, enforced) by session state; needs the RocksDB state store.

    With ``ttl_ms`` idle state goes by processing time, for which a query must run on: with an availableNow trigger it wouldn't end. guard.guarded_stream()
    lets idle state go by event time under any trigger.
    """
    rows = dimensions(events).select("session_id", "event_id", "micros", "d1", "d2", "d3", "d5", "d6")
    schema = "session_id long, event_id long, prior_high long, d4 int, risk_rank int, rises boolean, enforced boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionScorer(**options), schema, "Append", "ProcessingTime" if options.get("ttl_ms") else "None")


class ApprovalTimer(StatefulProcessor):
    """Per approval: the request waits for its answer until an event-time timer fires; emits one row (approval_id, state, micros) when it is decided.

    An answer within the timeout is allowed or denied; none is expired. An answer that comes before its request is kept for it, for the timeout
    after its own time at most.
    """

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("approval", "asked long, answered long, decision string, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        asked, answered, decision, done = self.state.get() if self.state.exists() else (None, None, None, False)
        for r in pd.concat(list(rows)).sort_values("micros").itertuples(index=False):
            if r.kind == "request" and asked is None:
                asked = int(r.micros)
                self.handle.registerTimer(asked // 1000 + self.timeout)
            elif r.kind != "request" and answered is None:
                answered, decision = int(r.micros), r.kind
                if asked is None:
                    self.handle.registerTimer(answered // 1000 + self.timeout)
        if not done and asked is not None and answered is not None and asked <= answered <= asked + self.timeout * 1000:
            done = True
            yield pd.DataFrame([(key[0], "allowed" if decision == "allow" else "denied", answered)], columns=["approval_id", "state", "micros"])
        self.state.update((asked, answered, decision, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        asked, _, _, done = self.state.get() if self.state.exists() else (None, None, None, True)
        if asked is not None and expiredTimerInfo.getExpiryTimeInMs() < asked // 1000 + self.timeout:
            return  # of an answer from before the request
        self.state.clear()
        if not done and asked is not None:
            yield pd.DataFrame([(key[0], "expired", asked + self.timeout * 1000)], columns=["approval_id", "state", "micros"])

    def close(self) -> None:
        pass


def approval_stream(events: DataFrame, timeout: float, time: str = "occurred_at", late: str = "10 minutes") -> DataFrame:
    """(approval_id, state, micros) of approvals as they are decided; events: approval_id long, kind (request, allow, deny), micros, an event time. Needs the RocksDB state store."""
    rows = events.withWatermark(time, late).select("approval_id", "kind", "micros", time)
    return rows.groupBy("approval_id").transformWithStateInPandas(ApprovalTimer(int(timeout * 1000)), "approval_id long, state string, micros long", "Append", "EventTime")
