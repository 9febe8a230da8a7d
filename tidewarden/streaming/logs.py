"""Tailing session logs: new pieces of log files as a stream, with the session id carried from piece to piece."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.readers import LOG, _log_lines


class SessionOfFile(StatefulProcessor):
    """Per log: the session id that its lines named last; with ``ttl_ms`` it goes after so long without a line."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "session_id string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.state.get()[0] if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values(["piece", "line"])
        session = batch["session_id"].copy()
        if len(session) and pd.isna(session.iloc[0]):
            session.iloc[0] = known
        batch["session_id"] = session.ffill()
        last = batch["session_id"].iloc[-1]
        self.state.update((None if pd.isna(last) else last,))
        yield batch[list(LOG)].astype(object).where(batch[list(LOG)].notna(), None).assign(line=batch["line"])

    def close(self) -> None:
        pass


def stream_session_logs(spark: SparkSession, path: str, log_of: str = r"^(.*?)(?:\.\d+)?\.jsonl$", max_files: int = 100, max_age: str = "7d", ttl_ms: int | None = None) -> DataFrame:
    """The rows of read_session_logs() as log pieces arrive: (file, line, type, name, arguments, call_id, session_id, text), file being the log.

    A shipper writes a log as files name.0.jsonl, name.1.jsonl, ...; log_of takes the log's path out of a file's. A piece is
    read whole (a shipper's roll size bounds it), older ones than max_age are passed over. Pieces of a log in one batch are taken by number, those of later
    batches after them. Needs the RocksDB state store. ttl_ms lets the state of idle logs go by processing time, for queries that run on (not with availableNow).
    """
    files = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", max_files).option("maxFileAge", max_age).text(path)
    name = F.col("_metadata.file_path")
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"\.(\d+)\.jsonl$", 1), F.lit("")).cast("long"), F.lit(0))
    pieces = files.select(F.regexp_extract(name, log_of, 1).alias("file"), number.alias("piece"), "value")
    lines = pieces.select("file", "piece", F.posexplode(F.split("value", r"\r?\n")).alias("nth", "value"))
    rows = _log_lines(lines.withColumn("line", F.struct("piece", "nth"))).withColumns({"piece": F.col("line.piece"), "line": F.col("line.nth").cast("long")})
    schema = "file string, line long, type string, name string, arguments string, call_id string, session_id string, text string"
    return rows.groupBy("file").transformWithStateInPandas(SessionOfFile(ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")
