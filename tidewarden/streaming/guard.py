"""Sessions in streams: accumulated risk, call frequency, attack sequences, enforcement and quarantine by keyed state in event-time order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.scoring import Thresholds
from ..operators.score import dimensions
from ..operators.sequences import SEQUENCES, Sequence, flags_of
from .events import score_rows

RING = 50
_WAITING = "event_id long, micros long, mark string, tool string, d1 int, d2 int, d3 int, d5 int, d6 double, flags long"
OUT = (
    "session_id long, event_id long, prior_high long, d4 int, risk_rank int, rises boolean, enforced boolean, quarantine string, "
    "alerts array<struct<sequence_id: string, risk_level: string, matched: array<long>>>"
)


def find_sequences(micros: np.ndarray, ids: np.ndarray, flags: np.ndarray, start: int, sequences: list[Sequence], names: list[str], unit: float) -> Iterator[tuple[int, Sequence, list[int]]]:
    """(row, sequence, matched ids) of every window that ends at a row from ``start`` on; flags are bits in the order of names.

    Windows that lack a step are passed over by running counts; the few others are walked, at most ``within_events`` rows each.
    """
    for s in sequences:
        bits = [1 << names.index(step) for step in s.steps]
        some = np.ones(len(micros), bool)
        for bit, least in [(b, s.least if len(bits) == 1 else 1) for b in dict.fromkeys(bits)]:
            seen = np.concatenate([[0], np.cumsum((flags & bit) != 0)])
            ends = np.arange(1, len(micros) + 1)
            some &= seen[ends] - seen[np.maximum(ends - s.within_events, 0)] >= least
        wanted = bits * s.least if len(bits) == 1 else bits
        for i in np.flatnonzero(some[start:]) + start:
            found = []
            for k in range(max(0, i - s.within_events + 1), i + 1):
                if micros[k] >= micros[i] - int(s.within_time * unit * 1e6) and flags[k] & wanted[len(found)]:
                    found.append(int(ids[k]))
                    if len(found) == len(wanted):
                        yield int(i), s, found
                        break


class SessionGuard(StatefulProcessor):
    """Per session, in event-time order whatever the order of arrival: counts of high-risk events, frequency of calls, a ring of the last 50
    events, the sets of events already alerted, and the quarantine state.

    Rows wait in a list until the watermark has passed them, then they are taken by (micros, event_id); marks of the
    same instant come after events. Alerted sets are kept while all their events are in the ring, as no window reaches
    further back. All state of a session goes ``ttl_ms`` of event time after its last row.
    """

    def __init__(
        self, sequences: list[Sequence] | None = None, unit: float = 1.0, threshold: int = 3, cooldown: float = 600.0, ttl_ms: int = 86_400_000, t: Thresholds | None = None,
        burst: int = 10, repetitive: int = 20, rate: int = 60, frequency: bool = False,
    ):
        self.sequences, self.unit, self.threshold, self.cooldown = SEQUENCES if sequences is None else sequences, unit, threshold, int(cooldown * unit * 1e6)
        self.ttl, self.t, self.counts, self.frequency = ttl_ms, t or Thresholds(), (burst, repetitive, rate), frequency
        self.names = sorted({step for s in self.sequences for step in s.steps})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "high long, micros long, rank int, quarantine string, timer long, burst long, many long")
        self.waiting = handle.getListState("waiting", _WAITING)
        self.ring = handle.getListState("ring", "micros long, event_id long, flags long")
        self.alerted = handle.getMapState("alerted", "sequence_id string, matched string", "micros long")
        self.calls = handle.getMapState("calls", "tool string", "micros array<long>")

    def _get(self) -> list:
        return list(self.state.get()) if self.state.exists() else [0, None, -1, None, None, None, None]

    def _wake(self, state: list, at: int) -> None:
        if state[4] != at:
            if state[4] is not None:
                self.handle.deleteTimer(state[4])
            self.handle.registerTimer(at)
            state[4] = at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, due = self._get(), None
        names = [f.split()[0] for f in _WAITING.split(", ")]
        for batch in rows:
            columns = [batch[n].tolist() for n in names]
            self.waiting.appendList(list(zip(*columns, strict=True)))
            first = -(-int(batch["micros"].min()) // 1000)
            due = first if due is None else min(due, first)
        if due is not None and (state[4] is None or due < state[4]):
            self._wake(state, due)
        self.state.update(tuple(state))
        return iter([])

    def _idle(self, state: list) -> int | None:
        return None if state[1] is None else state[1] // 1000 + self.ttl

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, state = timerValues.getCurrentWatermarkInMs(), self._get()
        state[4] = None
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[1] <= now * 1000), key=lambda r: (r[1], r[2] is not None, r[0]))
        rest = [r for r in rows if r[1] > now * 1000]
        if ready:
            yield from self._take(int(key[0]), ready, state)
        if rest:
            self.waiting.put(rest)
            self._wake(state, -(-min(r[1] for r in rest) // 1000))
        else:
            self.waiting.clear()
            if self._idle(state) is None or self._idle(state) <= now:
                for x in (self.state, self.ring, self.alerted, self.calls):
                    x.clear()
                return
            self._wake(state, self._idle(state))
        self.state.update(tuple(state))

    def _take(self, session: int, ready: list[tuple], state: list) -> Iterator[pd.DataFrame]:
        held, quarantine = state[3], []
        for r in ready:
            if r[2] is None:
                quarantine.append(held)
            else:
                held = r[2]
        state[3], state[1] = held, max(ready[-1][1], state[1] or 0)
        rows = pd.DataFrame([r for r in ready if r[2] is None], columns=[f.split()[0] for f in _WAITING.split(", ")])
        if not len(rows):
            return
        rows["session_id"] = session
        last = state[1]
        ring = list(self.ring.get()) if self.ring.exists() else []
        before = ring[-1][0] if ring else None
        freq = self._frequency(rows, ring, state) if self.frequency else 0
        out, state[0], _, state[2] = score_rows(rows, state[0], before, state[2], self.threshold, self.cooldown, self.t, freq)
        state[1] = last
        out["quarantine"] = quarantine
        out["alerts"] = self._alerts(rows, ring)
        yield out

    def _alerts(self, rows: pd.DataFrame, ring: list[tuple]) -> list[list[dict]]:
        micros, ids, flags = (np.array([*(r[k] for r in ring), *rows[c]], np.int64) for k, c in ((0, "micros"), (1, "event_id"), (2, "flags")))
        seen = {k for k, _ in self.alerted.iterator()} if self.alerted.exists() else set()
        out: list[list[dict]] = [[] for _ in range(len(rows))]
        fresh: dict[tuple[str, str], int] = {}
        hits = sorted(find_sequences(micros, ids, flags, len(ring), self.sequences, self.names, self.unit), key=lambda h: h[0])
        for i, s, found in hits:
            name = (s.id, ",".join(sorted(map(str, found))))
            if name not in seen and name not in fresh:
                fresh[name] = int(micros[i])
                out[i - len(ring)].append({"sequence_id": s.id, "risk_level": s.level, "matched": found})
        keep = max([RING, *(s.within_events for s in self.sequences)])
        self.ring.put(list(zip(micros[-keep:].tolist(), ids[-keep:].tolist(), flags[-keep:].tolist(), strict=True)))
        inside = set(map(str, ids[-keep:]))
        for name in seen:
            if not inside.issuperset(name[1].split(",")):
                self.alerted.removeKey(name)
        for name, at in fresh.items():
            if inside.issuperset(name[1].split(",")):
                self.alerted.updateValue(name, (at,))
        return out

    def _frequency(self, rows: pd.DataFrame, ring: list[tuple], state: list) -> np.ndarray:
        """d4 by frequency as operators.sessions.frequency_d4 has it: running maxima of the times of n-th newest calls."""
        burst, repetitive, rate = self.counts
        low = np.iinfo(np.int64).min
        micros, tick = rows["micros"].to_numpy(), int(self.unit * 1e6)

        def nth(old: list[int], new: np.ndarray, n: int) -> np.ndarray:
            all_, at = np.array([*old, *new], np.int64), np.arange(len(old), len(old) + len(new)) - (n - 1)
            return np.where(at >= 0, all_[np.maximum(at, 0)], low)

        times = {"burst": np.full(len(rows), low), "many": np.full(len(rows), low)}
        for tool, at in rows.groupby("tool", dropna=False).indices.items():
            name = ("" if tool is None or tool != tool else tool,)
            old = list(self.calls.getValue(name)[0]) if self.calls.containsKey(name) else []
            times["burst"][at], times["many"][at] = nth(old, micros[at], burst), nth(old, micros[at], repetitive)
            self.calls.updateValue(name, ([*old, *micros[at].tolist()][-max(burst, repetitive) + 1 :],))
        name = ("\0all",)
        old = list(self.calls.getValue(name)[0]) if self.calls.containsKey(name) else []
        every = nth(old, micros, rate)
        self.calls.updateValue(name, ([*old, *micros.tolist()][-rate + 1 :],))
        running = {}
        for k, (c, at) in {"burst": (times["burst"], 5), "many": (times["many"], 6)}.items():
            running[k] = np.maximum.accumulate(np.concatenate([[low if state[at] is None else state[at]], c]))[1:]
            state[at] = int(running[k][-1])
        within = lambda c, width: (c != low) & (c >= micros - width * tick)
        return np.where(within(running["burst"], 5), 2, np.where(within(running["many"], 60) | within(every, 60), 1, 0))


def guarded_stream(events: DataFrame, marks: DataFrame | None = None, time: str = "occurred_at", late: str = "10 minutes", **options) -> DataFrame:
    """A row for each event: prior_high, d4, risk_rank, rises, enforced, quarantine (the last mark strictly before it) and the alerts that it triggers.

    marks: session_id, micros, state and the event time; quarantine and release alike. Needs the RocksDB state store. The
    result equals the batch operators over the rows that aren't late: sessions.accumulation (with sessions.frequency_d4), sessions.enforcement,
    sequences.detect_trajectories and sessions.as_of.
    """
    guard = SessionGuard(**options)
    flags = flags_of(events, guard.sequences)
    bits = F.lit(0).cast("long")
    for k, name in enumerate(guard.names):
        bits = bits + F.when(flags[name], 1 << k).otherwise(0)
    rows = dimensions(events.withColumn("_flags", bits)).select(
        "session_id", "event_id", "micros", F.lit(None).cast("string").alias("mark"), F.col("tool_name").alias("tool"), *[F.col(d).cast("int").alias(d) for d in ("d1", "d2", "d3", "d5")], F.col("d6").cast("double").alias("d6"), F.col("_flags").alias("flags"), time
    )
    if marks is not None:
        zero = [F.lit(0).cast("int").alias(d) for d in ("d1", "d2", "d3", "d5")]
        rows = rows.unionByName(marks.select("session_id", F.lit(-1).cast("long").alias("event_id"), "micros", F.col("state").alias("mark"), F.lit(None).cast("string").alias("tool"), *zero, F.lit(0.0).alias("d6"), F.lit(0).cast("long").alias("flags"), time))
    return rows.withWatermark(time, late).groupBy("session_id").transformWithStateInPandas(guard, OUT, "Append", "EventTime")


class LateRows(StreamingQueryListener):
    """Rows that the watermark dropped, summed by query and batch, as a table; add it with spark.streams.addListener()."""

    def __init__(self) -> None:
        self.dropped: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        n = sum(int(o.numRowsDroppedByWatermark) for o in p.stateOperators)
        if n:
            at = (p.name or str(p.id), int(p.batchId))
            self.dropped[at] = max(n, self.dropped.get(at, 0))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, dropped): a row for each batch that lost rows."""
        return spark.createDataFrame([(q, b, n) for (q, b), n in sorted(self.dropped.items())], "query string, batch long, dropped long")


class EventThinner(StatefulProcessor):
    """Per key: keeps one event in a window that starts at the last one kept, in event-time order, with the number dropped in between.

    Events wait until the watermark has passed them. State goes once a window has passed since the last kept event and none waits, as what was
    dropped before is reported with the next event only within ``ttl_ms``.
    """

    def __init__(self, tick: int, ttl_ms: int):
        self.tick, self.ttl = tick, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "due long, dropped long, timer long")
        self.waiting = handle.getListState("waiting", "event_id long, micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        due, dropped, timer = self.state.get() if self.state.exists() else (None, 0, None)
        for batch in rows:
            self.waiting.appendList(list(zip(batch["event_id"].tolist(), batch["micros"].tolist(), strict=True)))
            first = -(-int(batch["micros"].min()) // 1000)
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = first
                self.handle.registerTimer(timer)
        self.state.update((due, dropped, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        due, dropped, _ = self.state.get() if self.state.exists() else (None, 0, None)
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        ready = [r for r in rows if r[1] <= now * 1000]
        micros, kept, at = np.array([r[1] for r in ready], np.int64), [], 0
        while at < len(ready):
            nxt = at if due is None else at + int(np.searchsorted(micros[at:], due))
            dropped += nxt - at
            if nxt < len(ready):
                kept.append((key[0], key[1], ready[nxt][0], dropped))
                due, dropped, nxt = int(micros[nxt]) + self.tick, 0, nxt + 1
            at = nxt
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put(rest)
            timer = -(-rest[0][1] // 1000)
        else:
            self.waiting.clear()
            timer = None if due is None else due // 1000 + self.ttl
            if timer is None or timer <= now:
                self.state.clear()
                timer = None
        if timer is not None:
            self.handle.registerTimer(timer)
            self.state.update((due, dropped, timer))
        if kept:
            yield pd.DataFrame(kept, columns=["session_id", "tool_name", "event_id", "suppressed"])

    def close(self) -> None:
        pass


def thinned_stream(events: DataFrame, window: float, unit: float = 1.0, time: str = "occurred_at", late: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """(session_id, tool_name, event_id, suppressed): correlate.sampled_events() over a stream, in event-time order whatever the order of arrival. Needs the RocksDB state store."""
    rows = events.withWatermark(time, late).select("session_id", "tool_name", "event_id", "micros", time)
    processor = EventThinner(int(window * unit * 1e6), ttl_ms)
    return rows.groupBy("session_id", "tool_name").transformWithStateInPandas(processor, "session_id long, tool_name string, event_id long, suppressed long", "Append", "EventTime")
