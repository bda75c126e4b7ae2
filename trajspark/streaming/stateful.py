"""Stateful streams [J1-J8]: the recursions of operators.recursive, kept per device between micro-batches.

Rows of a micro-batch are sorted by event time within their device. Rows older than the watermark are dropped,
which a replay of a finished recording never meets; the state of a device that is silent for longer than the
timeout is evicted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from trajspark.operators.recursive import Step, gate_step, high_pass_step, low_pass_step, throttle_step  # noqa: F401
from trajspark.operators.recursive import metres as distance
from trajspark.shipping import ship

# Trailing seconds, trailing metres and the most rows that are held for them.
WINDOW_SECONDS, WINDOW_METRES, WINDOW_ROWS = 2.0, 100.0, 1000


def replay(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """Recordings as a stream: files of a folder, in the order of their times [A31, J8]."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def track_stream(stream: DataFrame, by: list[str], order: list[str], event_time: str, new: dict[str, str], step: Step, delay: str = "10 seconds", timeout: str = "1 hour") -> DataFrame:
    """Adds the columns that ``step`` makes of a device's rows and its state (anything that JSON holds, None at first)."""
    ship(stream.sparkSession)
    fields = [(f.name, f.dataType.simpleString()) for f in stream.schema.fields]
    output = ", ".join(f"`{n}` {t}" for n, t in [*fields, *new.items()])
    names = [n for n, _ in fields]
    silent_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = json.loads(state.get[0]) if state.exists else None
        columns, after = step(rows, before)
        state.update((json.dumps(after),))
        last = int(rows[event_time].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + silent_ms)
        yield rows.assign(**columns)[[*names, *new]]

    marked = stream.withWatermark(event_time, delay)
    return marked.groupBy(*by).applyInPandasWithState(run, output, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def change_step(columns: list[str], out: str = "changed") -> Step:
    """[J7]"""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        found = []
        for values in rows[columns].astype(object).values.tolist():
            found.append(values != state)
            state = values
        return {out: found}, state

    return step


def time_window_step(seconds_column: str, column: str, out: str = "deviation", seconds: float = WINDOW_SECONDS) -> Step:
    """Population deviation over the trailing seconds [J3]."""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        held, found = list(state or []), []
        for t, x in zip(rows[seconds_column].tolist(), rows[column].tolist(), strict=True):
            held = [p for p in held if p[0] >= t - seconds] + [[t, x]]
            mean = sum(p[1] for p in held) / len(held)
            found.append((sum((p[1] - mean) ** 2 for p in held) / len(held)) ** 0.5)
        return {out: found}, held

    return step


def distance_window_step(column: str, out: str = "trailing", metres: float = WINDOW_METRES, most_rows: int = WINDOW_ROWS) -> Step:
    """Root mean square over the trailing metres [J4, F18]."""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        held, found = list(state or []), []  # (metres so far, lat, lon, value)
        for lat, lon, x in zip(rows["lat"].tolist(), rows["lon"].tolist(), rows[column].tolist(), strict=True):
            at = held[-1][0] + distance(held[-1][1], held[-1][2], lat, lon) if held else 0.0
            held = [p for p in held if p[0] >= at - metres][-(most_rows - 1) :] + [[at, lat, lon, x]]
            found.append((sum(p[3] ** 2 for p in held) / len(held)) ** 0.5)
        return {out: found}, held

    return step


def write_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs what is there to a file sink, once."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
