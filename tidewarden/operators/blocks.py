"""Long sessions in two levels: blocks of a session's rows, and one summary a block that is carried into the blocks after it.

Operators that read a session in order put it in one window partition. A session with a large part of all rows would be one
task. split_long_sessions() adds a column ``block``, by which running() and with_tail() then work: inside blocks by windows over session and
block, and between blocks by windows over one row a block. Rows without that column, and short sessions (block 0), take one level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "session_id", ("micros", "event_id")


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder that spark.checkpoint.dir names; only a local master gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def split_long_sessions(rows: DataFrame, most: int = 1_000_000, then: Callable[[DataFrame], DataFrame] | None = None, each: int = 100_000) -> DataFrame:
    """Add block: 0 in sessions of at most ``most`` rows, else the number of a range of at most ``most`` rows in order of session, time and id.

    Spark's own range partitioning, which samples all rows, deals the rows of long sessions into partitions of about ``each`` rows (or ``most``, if that is more), so that
    their number, and the sample that the driver takes for their bounds, is small however short the blocks. A partition is sorted and cut into blocks by its row numbers: blocks
    hold equal numbers of rows, however the session's rows are spread over time. Only rows of long sessions are sorted and checkpointed, so that blocks stay the same
    when a lost task is run again. then: what is made of each row (one for one) before that, so that operators, which read the rows several times, find it done.
    """
    then = then or (lambda x: x)
    sizes = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    found = sizes.agg(F.count(F.lit(1)).alias("sessions"), F.sum("_n").alias("rows")).first()
    if not found.sessions:
        return then(rows.withColumn("block", F.lit(0).cast("long")))
    small = F.broadcast if found.sessions <= 100_000 else (lambda x: x)
    marked = rows.join(small(sizes.select(F.col(KEY).alias("_key"), F.lit(True).alias("_long"))), F.col(KEY).eqNullSafe(F.col("_key")), "left").drop("_key")
    long = marked.where("_long").drop("_long").repartitionByRange(-(-found.rows // max(most, each)), KEY, *ORDER).sortWithinPartitions(KEY, *ORDER)
    # the partition's number stands above the row's number in it
    at = F.monotonically_increasing_id()
    numbered = long.withColumn("block", (F.shiftright(at, 33) + 1) * (1 << 33) + F.floor(at.bitwiseAND((1 << 33) - 1) / most).cast("long"))
    ranges = durable(then(numbered))
    return then(marked.where("_long is null").drop("_long").withColumn("block", F.lit(0).cast("long"))).unionByName(ranges)


def blocked(rows: DataFrame) -> bool:
    return "block" in rows.columns


def part(rows: DataFrame) -> tuple[str, ...]:
    """What one window partition holds: a session, or a block of one."""
    return (KEY, "block") if blocked(rows) else (KEY,)


def in_order(rows: DataFrame) -> Window:
    return Window.partitionBy(*part(rows)).orderBy(*ORDER)


_MERGED = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, values: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """Add running values of each session over the rows before each row, with inclusive the row's own as well.

    values: name -> (rule, column); rules: sum, max, and last (the newest that isn't null). A sum over nothing is 0, the others
    are null. The rules are associative, so a block is summed up by one row and what precedes it is the rule over the summaries before.
    """
    frame = in_order(rows).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inputs = {f"_in_{n}": c for n, (_, c) in values.items()}
    out = rows.withColumns(inputs)
    out = out.withColumns({n: _MERGED[rule](F.col(f"_in_{n}")).over(frame) for n, (rule, _) in values.items()})
    if blocked(rows):
        at = F.struct(*ORDER)
        last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
        whole = {n: (last if rule == "last" else _MERGED[rule])(F.col(f"_in_{n}")) for n, (rule, _) in values.items()}
        blocks = rows.withColumns(inputs).where("block > 0").groupBy(KEY, "block").agg(*[c.alias(f"_all_{n}") for n, c in whole.items()])
        earlier = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(F.col(KEY).alias("_key"), F.col("block").alias("_block"), *[_MERGED[rule](F.col(f"_all_{n}")).over(earlier).alias(f"_all_{n}") for n, (rule, _) in values.items()])
        out = out.join(carried, F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")), "left").drop("_key", "_block")
        merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
        out = out.withColumns({n: merge[rule](F.col(f"_all_{n}"), F.col(n)) for n, (rule, _) in values.items()}).drop(*[f"_all_{n}" for n in values])
    sums = {n: F.coalesce(n, F.lit(0)) for n, (rule, _) in values.items() if rule == "sum"}
    return out.withColumns(sums).drop(*inputs)


def with_tail(rows: DataFrame, n: int) -> DataFrame:
    """Rows with the last n rows before each block repeated in it, marked by _tail, so that a window of n + 1 rows inside a block sees all its rows.

    A block gets them from the one before, and from those before that where it has fewer than n rows: at most n rows and n summaries a block travel.
    """
    if not blocked(rows):
        return rows.withColumn("_tail", F.lit(False))
    blocks = rows.where("block > 0").groupBy(KEY, "block").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(KEY).orderBy("block")
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = F.collect_list(F.struct(F.col("block").alias("to"), F.col("_before").alias("start"))).over(order.rowsBetween(1, n))
    ahead = blocks.select(F.col(KEY).alias("_key"), F.col("block").alias("_block"), (F.col("_before") + F.col("_n")).alias("_end"), ahead.alias("_ahead"))
    back = F.row_number().over(Window.partitionBy(KEY, "block").orderBy(*[F.col(c).desc() for c in ORDER]))
    last = rows.where("block > 0").withColumn("_back", back).where(F.col("_back") <= n)
    last = last.join(ahead, F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).withColumn("_to", F.explode("_ahead"))
    # a row at place p is among the last n before a block that starts after s rows if p > s - n
    last = last.where(F.col("_end") - F.col("_back") + 1 > F.col("_to.start") - n).withColumn("block", F.col("_to.to")).drop("_key", "_block", "_end", "_ahead", "_back", "_to")
    return rows.withColumn("_tail", F.lit(False)).unionByName(last.withColumn("_tail", F.lit(True)))
