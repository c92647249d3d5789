"""Incremental scoring: operators that work row by row, applied to a stream of new records.

Records that were scored before are left out by a watermark on their time and their id, so state is bounded
by the watermark; each micro-batch is written under its own id, so a repeated batch replaces itself and a
restart neither loses nor doubles records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id_col: str, time_col: str | None = None, delay: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Apply ``score`` to each micro-batch of new rows and write it to out/batch=<n>.

    With ``time_col`` rows that repeat an id within ``delay`` are dropped by the stream's state.
    """
    rows = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col]) if time_col else stream

    def write(batch: DataFrame, n: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
