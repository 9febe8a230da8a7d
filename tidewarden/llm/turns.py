"""Repair of conversation structure: the cheapest edits by rank-convergence parallel Viterbi.

Roles are to read ``(s?(ua)+)?``. The states of the search are what stands before: nothing, a system, a user or an assistant turn.
Costs to the end are min-plus products, one small matrix a row. Conversations are cut into chunks by an ordinary
range sort. Each chunk runs backward from a speculative cost vector; a fix-up pass gives a chunk the vector that the
next chunk found, and reruns it only until its vectors differ from the earlier ones by a constant, as nothing changes
beyond (Maleki, Musuvathi, Mytkowicz 2014). The stitched costs then drive a trace forward that takes the ASCII-least letter
among the cheapest edits. Chunks run in parallel, and a conversation of any length is many of them.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import ensure_checkpoint_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. The state after an inserted or reroled turn, and its role.
AFTER, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a kept turn, by its role's initial and the state before; others can't be kept.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Costs of ending in each state.
END = (0, 2 * INSERT, INSERT, 0)
BLANK, DUPLICATE, CUT, FORCED = 1, 2, 3, 99
_SPACE = r"\x20\x09-\x0D"

# -- one row of the search ---------------------------------------------------------------------


def symbol(initial: str, truncated: bool) -> int:
    return "sua".find(initial) + 1 + 4 * truncated if len(initial) == 1 else 4 * truncated


def _edits(sym: int, state: int, after: tuple[int, ...], here: list[int] | tuple[int, ...]) -> Iterator[tuple[int, str, int, bool]]:
    """(cost to the end, letter, next state, whether the row is used up), letters ascending; after and here: costs after the row and before it."""
    extra = TRUNCATED * (sym >= 4)
    yield DELETE + after[state], "D", state, True
    yield INSERT + here[AFTER[state]], "I", AFTER[state], False
    to = KEPT.get(" sua"[sym % 4], {}).get(state)
    if to is not None:
        yield KEEP + extra + after[to], "K", to, True
    yield REROLE + extra + after[AFTER[state]], "R", AFTER[state], True


def normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less their first: vectors that differ by a constant are the same."""
    return tuple(c - costs[0] for c in costs)


@functools.cache
def before(sym: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row from those after it."""
    out = [min(c for c, _, _, used in _edits(sym, q, after, after) if used) for q in range(4)]
    for _ in range(4):
        out = [min(out[q], INSERT + out[AFTER[q]]) for q in range(4)]
    return tuple(out)


@functools.cache
def _back(sym: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return normal(before(sym, after))


@functools.cache
def step(sym: int, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """(least letters among the cheapest edits, cost, next state) of a row."""
    if sym == FORCED:
        return "D", DELETE, state
    here, letters, cost = before(sym, after), "", 0
    while True:
        _, letter, to, used = next(e for e in _edits(sym, state, after, here) if e[0] == here[state])
        letters += letter
        cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (TRUNCATED if sym >= 4 and letter in "KR" else 0)
        state = to
        if used:
            return letters, cost, state


def backward(syms: bytes, right: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors after each row, and before the first one in front; rows that must go change nothing."""
    out = [right]
    for s in reversed(syms):
        out.append(out[-1] if s == FORCED else _back(s, out[-1]))
    return out[::-1]


def fix_up(syms: bytes, speculated: list[tuple[int, ...]], right: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Backward vectors from another right end; stops where they are the speculated ones again."""
    out, at = [right], len(syms)
    while at and out[-1] != speculated[at]:
        at -= 1
        out.append(out[-1] if syms[at] == FORCED else _back(syms[at], out[-1]))
    return speculated[:at] + out[::-1]


def trace(syms: bytes, vectors: list[tuple[int, ...]], state: int) -> tuple[list[str], int, int]:
    """(letters a row, cost, state at the end) from a state at the start."""
    letters, cost = [], 0
    for s, after in zip(syms, vectors[1:], strict=True):
        got, c, state = step(s, after, state)
        letters.append(got)
        cost += c
    return letters, cost, state


def closing(state: int) -> tuple[str, int]:
    """Turns to insert at the end of a conversation, and their cost."""
    n = {0: 0, 1: 2, 2: 1, 3: 0}[state]
    return "I" * n, n * INSERT


# -- rows: damage, faults, order --------------------------------------------------------------------


def damage(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): each row damaged by crc32 of ``conv:turn`` modulo 20; dropped rows have no copies. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    out = F.when(code == 1, "").when(code == 2, F.regexp_replace(plain(text), "[.!?]", "")).otherwise(plain(text))
    return table.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(code == 4, "user").when(code != 0, plain(role)).otherwise("").alias("role"),
        F.when(code != 0, out).otherwise("").alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn become one with their number of copies; fault: 1 blank, 2 duplicate of an earlier turn, 3 truncated, else 0.

    Copies of a row beyond its first are duplicates of it. Both groupings combine before their shuffle; the rows of the join are
    distinct, and Spark splits a role and text that very many turns of a conversation repeat.
    """
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = one.withColumn("digest", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    first = one.where((F.col("copies") > 0) & ~blank).groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"), F.lit(True).alias("again")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & (F.col("copies") > 0) & ~blank
    out = one.join(first, same, "left")
    late = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(blank, BLANK).when(late, DUPLICATE).when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), CUT).otherwise(0)
    return out.select("conv", "turn", "role", "text", "digest", "copies", fault.cast("int").alias("fault"))


# -- chunks -------------------------------------------------------------------------------------------

CHUNK = "part int, no int, whole boolean, syms binary, turns array<long>, roles array<string>, texts array<string>, faults array<int>, copies array<long>, left array<int>"


def _chunks(chunk_rows: int, chunk_bytes: int):
    """Tasks over sorted partitions: chunks of one conversation each, with the vector that the speculative end brings to their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, waiting, no, held = TaskContext.get().partitionId(), [], 0, 0
        current: list[tuple] = []
        conv, opened, size, kind = None, True, 0, None

        def close(whole: bool):
            nonlocal current, no, size, held
            live = [r for r in current if r[4]]
            syms = bytes(FORCED if r[3] in (BLANK, DUPLICATE) else symbol(r[1][:1], r[3] == CUT) for r in live)
            waiting.append((conv, part, no, whole, syms, *([r[k] for r in live] for k in range(5)), list(backward(syms, normal(END))[0])))
            current, held, size, no = [], held + size, 0, no + 1

        def flush():
            nonlocal held
            names = ["conv", "part", "no", "whole", "syms", "turns", "roles", "texts", "faults", "copies", "left"]
            ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
            kinds = [kind, pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), texts, texts, ints, pa.list_(pa.int64()), ints]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds, strict=True)], names)
            waiting.clear()
            held = 0
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, turn, role, text, copies, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if current and c != conv:
                    close(not opened)
                    opened = False
                elif size > chunk_bytes or len(current) >= chunk_rows:
                    close(False)
                    opened = True
                if held > chunk_bytes or len(waiting) >= 1000:
                    yield flush()
                conv = c
                current.append((turn, role, text, fault, copies))
                size += len(text) + len(role) + 32
        if current:
            close(False)
        if waiting:
            yield flush()

    return run


FIXED = "syms binary, right array<int>, left array<int>"
_INTS = pa.list_(pa.int32())


def _run_fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rerun chunks from the wanted right end in place of the one they had."""
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("syms", "right", "wanted")), strict=True)
        left = [list(fix_up(syms, backward(syms, tuple(old)), tuple(new))[0]) for syms, old, new in rows]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "no", "syms")), b.column("wanted").cast(_INTS), pa.array(left, _INTS)], ["conv", "part", "no", "syms", "right", "left"])


def matrix(syms: bytes) -> list[list[int]]:
    """Costs of getting through a chunk from each state to each state."""
    columns = []
    for q in range(4):
        costs = tuple(0 if k == q else 1 << 40 for k in range(4))
        for s in reversed(syms):
            if s != FORCED:
                costs = before.__wrapped__(s, costs)
        columns.append(costs)
    return [list(r) for r in zip(*columns, strict=True)]


def _run_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [matrix(s) for s in b.column("syms").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "no")), pa.array(rows, pa.list_(pa.list_(pa.int64())))], ["conv", "part", "no", "matrix"])


def _run_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each chunk for each state at its start, under the chunk's right end."""
    for b in batches:
        rows = []
        for syms, right in zip(b.column("syms").to_pylist(), b.column("right").to_pylist(), strict=True):
            vectors = backward(syms, tuple(right))
            rows.append([trace(syms, vectors, q)[2] for q in range(4)])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "part", "no")), b.column("right").cast(_INTS), pa.array(rows, _INTS)], ["conv", "part", "no", "right", "to"])


def _in_order(table: pa.Table, *columns: str) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("part", "no", *columns)), strict=True), key=lambda r: r[:2])


def _compose(table: pa.Table) -> pa.Table:
    """Right ends of a conversation's chunks from their matrices, last to first."""
    rows, right, ends = _in_order(table, "matrix"), normal(END), []
    for _, _, costs in reversed(rows):
        ends.append(list(right))
        right = normal(tuple(min(c + r for c, r in zip(line, right, strict=True)) for line in costs))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "no": pa.array([r[1] for r in rows], pa.int32()), "wanted": pa.array(ends[::-1], _INTS)})


def _walk(table: pa.Table) -> pa.Table:
    """The state at the start of each of a conversation's chunks, first to last."""
    rows, state, states = _in_order(table, "right", "to"), 0, []
    for *_, to in rows:
        states.append(state)
        state = to[state]
    return pa.table({
        "part": pa.array([r[0] for r in rows], pa.int32()), "no": pa.array([r[1] for r in rows], pa.int32()), "right": pa.array([r[2] for r in rows], _INTS),
        "state": pa.array(states, pa.int32()), "last": pa.array([k == len(rows) - 1 for k in range(len(rows))], pa.bool_()),
    })


def stitch(lanes: DataFrame, passes: int = 6) -> DataFrame:
    """(part, no, right, state, last): costs behind each chunk, the state in front of it, whether it is its conversation's last.

    lanes: conv, part, no, syms and left, the costs in front under the speculative end. A pass compares each chunk's right end with what
    the next chunk found and reruns those where they differ by more than a constant. Costs forget their end within a few
    rows, so that two or three passes do. Where some remain after ``passes`` (chunks of roles that all need a new one keep the parity of
    their end), they are composed by their matrices: one row of 16 numbers for thousands of turns.
    """
    kind = dict(lanes.dtypes)["conv"]
    ends = F.array(*[F.lit(c) for c in normal(END)]).cast("array<int>")
    order = Window.partitionBy("conv").orderBy("part", "no")
    state = lanes.select("conv", "part", "no", "syms", ends.alias("right"), "left")
    for turn in range(passes + 1):
        state = state.withColumn("wanted", F.coalesce(F.lead("left").over(order), ends)).checkpoint()
        wrong = F.col("wanted") != F.col("right")
        if state.where(wrong).isEmpty():
            break
        if turn == passes:
            found = state.mapInArrow(_run_matrix, f"conv {kind}, part int, no int, matrix array<array<bigint>>").groupBy("conv").applyInArrow(_compose, "part int, no int, wanted array<int>")
            state = state.drop("right").join(found.withColumnRenamed("wanted", "right"), ["part", "no"])
            break
        fixed = state.where(wrong).mapInArrow(_run_fix, f"conv {kind}, part int, no int, {FIXED}")
        state = state.where(~wrong).drop("wanted").unionByName(fixed)
    maps = state.select("conv", "part", "no", "syms", "right").mapInArrow(_run_maps, f"conv {kind}, part int, no int, right array<int>, to array<int>")
    return maps.groupBy("conv").applyInArrow(_walk, "part int, no int, right array<int>, state int, last boolean")


# -- repaired pieces and reports ---------------------------------------------------------------------

_LEGAL = {"su", "ua", "au"}
PIECE = (
    "part int, no int, whole boolean, first_turn bigint, last_turn bigint, turns bigint, first_role string, last_role string, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string, repaired array<struct<role string, text string>>"
)


def _piece(syms: bytes, turns: list, roles: list, texts: list, faults: list, copies: list, right: tuple, state: int, last: bool) -> tuple:
    letters, cost, end = trace(syms, backward(syms, right), state)
    out, audit = [], []
    for word, role, text, m in zip(letters, roles, texts, copies, strict=True):
        audit.append(word + "D" * (m - 1))
        cost += DELETE * (m - 1)
        for x in word:
            if x == "I":
                out.append((ROLE[state], ""))
                state = AFTER[state]
            elif x == "R":
                out.append((ROLE[state], text))
                state = AFTER[state]
            elif x == "K":
                out.append((role, text))
                state = KEPT[role[0]][state]
    if last:
        more, extra = closing(end)
        audit.append(more)
        cost += extra
        for _ in more:
            out.append((ROLE[state], ""))
            state = AFTER[state]
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(m - 1 for m in copies)
    count = lambda kind: sum(m for f, m in zip(faults, copies, strict=True) if f == kind)
    again = sum(m - 1 for f, m in zip(faults, copies, strict=True) if f in (0, CUT))
    return (
        known[0] if known else None, known[-1] if known else None, len(set(known)), initials[0] if initials else None, initials[-1] if initials else None,
        count(BLANK), count(DUPLICATE) + again, sum(f == CUT for f in faults), illegal, cost, "".join(audit), [{"role": r, "text": t} for r, t in out],
    )


def _run_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = "first_turn last_turn turns first_role last_role blank duplicate truncated illegal cost audit repaired".split()
    long, text = pa.int64(), pa.string()
    kinds = [long, long, long, text, text, long, long, long, long, long, text, pa.list_(pa.struct([("role", text), ("text", text)]))]
    asked = "syms turns roles texts faults copies right state last".split()
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            rows = [_piece(*r[:6], tuple(r[6]), *r[7:]) for r in zip(*(part.column(c).to_pylist() for c in asked), strict=True)]
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv", "part", "no", "whole")), *made], ["conv", "part", "no", "whole", *fields])


def repair(damaged: DataFrame, chunk_rows: int = 4096, chunk_bytes: int = 4 << 20, passes: int = 6) -> DataFrame:
    """Repaired pieces of conversations, from rows (conv, turn, role, text, copies) without nulls but in conv and turn.

    A piece: its place (part, no) among its conversation's, whether it is the whole conversation, its faults, the cost and letters of its edits and
    its repaired turns. Rows stand by turn (nulls first), of equal turn by role and text. A role of another initial than s, u or a (the
    empty one too) can't be kept. A row of no copies adds nothing but its conversation. Memory is that of some
    chunks; a conversation that holds a third of all rows is cut by the range sort like any other.
    """
    spark = damaged.sparkSession
    kind = dict(damaged.dtypes)["conv"]
    keys = ["conv", "turn", "role", "digest"]
    rows = with_faults(damaged)
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "copies", "fault")
    path = f"{ensure_checkpoint_dir(spark)}/turns-{uuid.uuid4().hex}"
    rows.mapInArrow(_chunks(chunk_rows, chunk_bytes), f"conv {kind}, {CHUNK}").write.parquet(path)
    chunks = spark.read.schema(f"conv {kind}, {CHUNK}").parquet(path)
    info = stitch(chunks.where("not whole").select("conv", "part", "no", "syms", "left"), passes)
    ends = F.array(*[F.lit(c) for c in normal(END)]).cast("array<int>")
    whole = chunks.where("whole").select("*", ends.alias("right"), F.lit(0).alias("state"), F.lit(True).alias("last"))
    parts = chunks.where("not whole").join(info, ["part", "no"]).select(*whole.columns)
    return whole.unionByName(parts).drop("left").mapInArrow(_run_pieces, f"conv {kind}, {PIECE}")


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv, part, no, place, role, text): the repaired conversations, a row a turn, in the order of part, no and place."""
    return pieces.select("conv", "part", "no", F.posexplode("repaired").alias("place", "turn")).select("conv", "part", "no", "place", "turn.role", "turn.text")


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _run_report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of pieces of a conversation; the hash is taken as the pieces stream by."""
    conv, run, kind = None, None, None
    fields = [f.split()[0] for f in REPORT.split(", ")]

    def start():
        return {"sums": [0] * 5, "audit": [], "sha": hashlib.sha256(), "some": False, "low": None, "high": None, "turns": 0, "role": None}

    def close():
        gaps = 0 if run["low"] is None else run["high"] - run["low"] + 1 - run["turns"]
        row = [conv, gaps, *run["sums"], "".join(run["audit"]), run["sha"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], kind), *(pa.array([v]) for v in row[1:])], ["conv", *fields])

    columns = "conv first_turn last_turn turns first_role last_role blank duplicate truncated illegal cost audit repaired".split()
    for b in batches:
        kind, done = b.schema.field("conv").type, []
        for c, low, high, turns, first, last, *sums, audit, repaired in zip(*(b.column(x).to_pylist() for x in columns), strict=True):
            if run is not None and c != conv:
                done.append(close())
                run = None
            run, conv = run or start(), c
            if low is not None:
                run["turns"] += turns - (run["high"] == low)
                run["low"], run["high"] = low if run["low"] is None else run["low"], high
            run["sums"] = [a + v for a, v in zip(run["sums"], sums, strict=True)]
            if first is not None:
                run["sums"][3] += run["role"] is not None and run["role"] + first not in _LEGAL
                run["role"] = last
            run["audit"].append(audit)
            if repaired:
                run["sha"].update(("\n" * run["some"] + "\n".join(f"{t['role']}:{t['text']}" for t in repaired)).encode("utf-8", "surrogatepass"))
                run["some"] = True
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if run is not None:
        yield close()


def report(pieces: DataFrame) -> DataFrame:
    """A row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Whole conversations are reported where they stand. Pieces of the others meet in order in one stream a conversation, as a hash
    of the whole text is one stream by its definition; the task holds a piece at a time and the letters.
    """
    schema = f"conv {dict(pieces.dtypes)['conv']}, {REPORT}"
    parts = pieces.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "no")
    return pieces.where("whole").mapInArrow(_run_report, schema).unionByName(parts.mapInArrow(_run_report, schema))


def repair_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **limits: int) -> DataFrame:
    """Damage, repair and report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row for each distinct conv_id.

    A null conv_id is a conversation of its own. Rows of equal conv_id and turn stand in the order of role and text. Null roles and texts are
    one space; a conversation that loses all its rows has zeros, an empty audit and the hash of the empty string. Repeated rows are
    duplicates. Texts of any length go whole. An empty table gives an empty result; other columns are not read, whatever their names.
    """
    pieces = repair(damage(table, conv_col, turn_col, role_col, text_col), **limits)
    return report(pieces).withColumnRenamed("conv", "conv_id")
