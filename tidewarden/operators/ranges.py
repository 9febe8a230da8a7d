"""Range joins and limiters over ordered records."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import part, running


def range_join(records: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, fan: int = 8) -> DataFrame:
    """Every record with every range of its key that holds it: ``at`` BETWEEN ``low`` AND ``high``, integers.

    A range is dealt into bins as wide as a power of ``fan`` that cover it with at most fan + 1 of them; a record
    looks into one bin of each width in use (as many as the lengths of ranges have powers, some twenty at most). The equi-join on key,
    width and bin leaves records of the two end bins to be filtered. Empty and null ranges hold nothing; the columns of both sides but the ranges' key are kept.
    """
    usable = ranges.where(F.col(low) <= F.col(high))
    length = (F.col(high) - F.col(low) + 1).cast("double")
    level = F.ceil(F.log(float(fan), length) - 1e-9) - 1
    dealt = usable.withColumn("_level", F.greatest(level, F.lit(0)).cast("int"))
    used = sorted(r._level for r in dealt.select("_level").distinct().collect())  # at most one row a power
    width = F.pow(F.lit(float(fan)), F.col("_level")).cast("long")
    bin_of = lambda c: F.floor(c / F.pow(F.lit(float(fan)), F.col("_level")).cast("decimal(20,0)")).cast("long")
    dealt = dealt.withColumn("_width", width).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high))))).drop("_width")
    looks = records.withColumn("_level", F.explode(F.lit(used).cast("array<int>"))).withColumn("_bin", bin_of(F.col(at)))
    found = looks.join(dealt.withColumnRenamed(key, "_range_key"), (F.col(key) == F.col("_range_key")) & (looks["_level"] == dealt["_level"]) & (looks["_bin"] == dealt["_bin"]))
    return found.where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_bin", "_range_key")


def limit_requests(requests: DataFrame, most: int, window: float, unit: float = 1.0) -> DataFrame:
    """(session_id, event_id, allowed): whether fewer than ``most`` requests of the client were allowed in the ``window`` units before; denied ones don't count.

    Requests stand in order of (micros, event_id). A pause of a whole window forgets everything, so requests are dealt by client and
    pause; clients may be split into blocks (operators.blocks). Whether one is allowed then depends on the most-th allowed before it, so a pass over
    the sorted rows jumps from there: it holds that many times, not the requests. A client that never pauses for a window is one such pass.
    """
    tick = int(window * unit * 1e6)
    rows = running(requests.select(*part(requests), "event_id", "micros"), {"_before": ("last", F.col("micros"))})
    rows = rows.withColumn("_cut", F.coalesce(F.col("micros") - F.col("_before") >= tick, F.lit(True)).cast("long"))
    rows = running(rows, {"_run": ("sum", F.col("_cut"))}, inclusive=True)
    rows = rows.select("session_id", "_run", "event_id", "micros").repartition("session_id", "_run").sortWithinPartitions("session_id", "_run", "micros", "event_id")
    kinds = dict(rows.dtypes)

    def run(batches):
        name, kept = None, deque(maxlen=most)
        for b in batches:
            if not len(b):
                continue
            micros = b["micros"].to_numpy()
            coded = [b[k].factorize(use_na_sentinel=False)[0] for k in ("session_id", "_run")]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in coded], axis=0)) + 1
            allowed = np.zeros(len(b), bool)
            for lo, hi in zip([0, *cut], [*cut, len(b)], strict=True):
                here = tuple(None if pd.isna(x) else x for x in (b["session_id"].iloc[lo], b["_run"].iloc[lo]))
                if here != name:
                    name = here
                    kept.clear()
                at = lo
                while at < hi:
                    if len(kept) == most and micros[at] - kept[0] < tick:
                        at += int(np.searchsorted(micros[at:hi], kept[0] + tick))
                        continue
                    kept.append(int(micros[at]))
                    allowed[at] = True
                    at += 1
            yield b[["session_id", "event_id"]].assign(allowed=allowed)

    return rows.mapInPandas(run, f"session_id {kinds['session_id']}, event_id {kinds['event_id']}, allowed boolean")


# -- thinning: one event of a key in a window that starts at the last one kept -------------------------

_KEY = ["session_id", "tool_name"]


def chain_ends(micros: np.ndarray, tick: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, if it is kept: when the next one may be kept after the last kept row of the chain that it starts, and how many rows follow that.

    The row kept after another is a pointer; pointers are doubled until all chains have left the rows.
    """
    n = len(micros)
    following = np.searchsorted(micros, micros + tick)
    last = np.where(following < n, following, np.arange(n))
    while (last[last] != last).any():
        last = last[last]
    return micros[last] + tick, n - 1 - last


def entry_table(micros: np.ndarray, tick: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper, due, dropped): what a block makes of the time from which an event may be kept: up to upper[k] it leaves due[k], with dropped[k] rows after the last kept one.

    That time lies within a window of the block's first row, and chains of neighbours merge, so few entries are left.
    """
    due, after = chain_ends(micros, tick)
    some = min(int(np.searchsorted(micros, micros[0] + tick)) + 1, len(micros))
    due, after, upper = due[:some], after[:some], micros[:some]
    ends = np.append(np.flatnonzero((np.diff(due) != 0) | (np.diff(after) != 0)), some - 1)
    return upper[ends], due[ends], after[ends]


def thin_events(events: DataFrame, window: float, unit: float = 1.0, blocks: int | None = None) -> DataFrame:
    """correlate.sampled_events() for keys of any size: (session_id, tool_name, event_id, suppressed).

    The sorted rows are cut into ranges (of Spark's choice, or so many blocks), whichever key they belong to. A key that goes on over several ranges has
    one summary a range, which says what the range does with any time at which it may begin; the summaries are composed in order of the ranges, and then every range is
    thinned from its own beginning. No task holds more of a key than a range, and the summaries of a key are short rows, one a range.
    """
    from .blocks import durable

    tick = int(window * unit * 1e6)
    order = [*_KEY, "micros", "event_id"]
    rows = events.select(*_KEY, "event_id", "micros")
    rows = rows.repartitionByRange(blocks, *order) if blocks else rows.repartitionByRange(*order)
    rows = durable(rows.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    kinds = dict(rows.dtypes)
    keyed = ", ".join(f"{k} {kinds[k]}" for k in _KEY)

    def runs(batch: pd.DataFrame):
        coded = [batch[k].factorize(use_na_sentinel=False)[0] for k in _KEY]
        cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in coded], axis=0)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(batch)], strict=True):
            yield tuple(None if pd.isna(x) else x for x in batch[_KEY].iloc[lo]), lo, hi

    def summarise(batches):
        first = name = part = None
        held: list[np.ndarray] = []
        out = []

        def add():
            micros = np.concatenate(held)
            upper, due, dropped = entry_table(micros, tick)
            out.append((*name, part, upper, due, dropped, len(micros)))

        for b in batches:
            if not len(b):
                continue
            part, micros = int(b["part"].iloc[0]), b["micros"].to_numpy()
            for key, lo, hi in runs(b):
                if name is not None and key != name:
                    if first:
                        add()
                    first, held = False, []
                if name is None:
                    first = True
                name = key
                held.append(micros[lo:hi])
        if held:
            add()
        yield pd.DataFrame(out, columns=[*_KEY, "part", "upper", "due", "dropped", "n"])

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        due, dropped, out = None, 0, []
        for r in group.itertuples(index=False):
            out.append((due, dropped))
            k = 0 if due is None else int(np.searchsorted(r.upper, due))
            if k == len(r.upper):
                dropped += r.n
            else:
                due, dropped = int(r.due[k]), int(r.dropped[k])
        return group[[*_KEY, "part"]].assign(due=pd.array([d for d, _ in out], "Int64"), dropped=[n for _, n in out])

    def thin(batches):
        name = due = None
        dropped = 0
        for b in batches:
            if not len(b):
                continue
            micros, kept, counts = b["micros"].to_numpy(), [], []
            for key, lo, hi in runs(b):
                if key != name:
                    name, due, dropped = key, b["due"].iloc[lo], b["dropped"].iloc[lo]
                    due, dropped = (None if pd.isna(due) else int(due)), (0 if pd.isna(dropped) else int(dropped))
                at = lo
                while at < hi:
                    nxt = at if due is None else at + int(np.searchsorted(micros[at:hi], due))
                    dropped += nxt - at
                    if nxt < hi:
                        kept.append(nxt)
                        counts.append(dropped)
                        due, dropped, nxt = int(micros[nxt]) + tick, 0, nxt + 1
                    at = nxt
            yield b[[*_KEY, "event_id"]].iloc[kept].assign(suppressed=np.array(counts, np.int64))

    parts = rows.mapInPandas(summarise, f"{keyed}, part int, upper array<long>, due array<long>, dropped array<long>, n long")
    begun = durable(parts.groupBy(*_KEY).applyInPandas(compose, f"{keyed}, part int, due long, dropped long").where("due is not null or dropped > 0"))
    begun = begun.select(*[F.col(k).alias(f"_{k}") for k in _KEY], F.col("part").alias("_part"), "due", "dropped")
    same = F.col("part") == F.col("_part")
    for k in _KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    entered = rows.join(F.broadcast(begun), same, "left")  # two rows a range at most
    return entered.select(*order, "due", "dropped").mapInPandas(thin, f"{keyed}, event_id {kinds['event_id']}, suppressed long")
