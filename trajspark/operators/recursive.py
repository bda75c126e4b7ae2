"""Recursions whose state depends on the rows kept before [J1, J2, J5, J6], which a window can't say.

A step function takes some rows of a track, in order, with the state that the rows before left, and returns new
columns and the state after them. Streams keep the state between micro-batches; ``over_tracks`` carries it from one
Arrow batch to the next, so no task holds more of a track than a batch, however long the track is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.geo import EARTH_RADIUS
from trajspark.operators.base import ordered
from trajspark.shipping import ship

#: Rows of a track and the state before them (None at its start) to new columns and the state after them.
Step = Callable[[pd.DataFrame, Any], tuple[dict, Any]]

# Filter factors, the greatest step from the last accepted point.
LOW_PASS, HIGH_PASS = 0.5, 0.85
MAX_STEP = 20.0


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(min(1.0, math.sqrt(a)))


def low_pass(values: Iterable[float], factor: float = LOW_PASS, state: float | None = None) -> list[float]:
    """y = factor x + (1 - factor) y before; the first value passes as it is."""
    out = []
    for x in values:
        state = x if state is None else factor * x + (1 - factor) * state
        out.append(state)
    return out


def high_pass(values: Iterable[float], factor: float = HIGH_PASS, state: tuple[float, float] | None = None) -> list[float]:
    """y = factor (y before + x - x before); the first value gives 0."""
    out = []
    for x in values:
        y = 0.0 if state is None else factor * (state[1] + x - state[0])
        state = (x, y)
        out.append(y)
    return out


def accepted(points: Iterable[tuple[float, float]], most: float = MAX_STEP, last: tuple[float, float] | None = None) -> list[bool]:
    """Whether each point is within ``most`` metres of the last accepted one; the first is."""
    out = []
    for p in points:
        ok = last is None or metres(*last, *p) <= most
        last = p if ok else last
        out.append(ok)
    return out


def throttled(times: Iterable[float], delay: float, last: float | None = None) -> list[bool]:
    """Whether more than ``delay`` has gone since the last accepted time; the first is accepted."""
    out = []
    for t in times:
        ok = last is None or t - delay > last
        last = t if ok else last
        out.append(ok)
    return out


def over_tracks(df: DataFrame, by: list[str], order: list[str], new: dict[str, str], step: Step) -> DataFrame:
    """Adds the columns that ``step`` makes of each track; new: their types.

    A row number brings each track to one task, sorted (without a shuffle where it is partitioned by ``by``), and
    marks where tracks begin. It must go on without a gap from batch to batch, which is checked. The input's columns
    pass as they are; a NaN among the new values is a null.
    """
    ship(df.sparkSession)
    columns = df.columns
    types = {c: {"double": pa.float64(), "boolean": pa.bool_()}[t] for c, t in new.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, 0
        for batch in batches:
            rows, place = batch.to_pandas(), batch.column("__place").to_numpy()
            starts = np.flatnonzero(place == 1)
            if len(place) and (np.diff(place, prepend=last)[place != 1] != 1).any():
                raise RuntimeError("rows of a track are not in order")
            found: dict[str, list] = {c: [] for c in new}
            cuts = sorted({0, *starts.tolist(), len(place)})
            for begin, end in zip(cuts, cuts[1:], strict=False):
                made, state = step(rows.iloc[begin:end], None if place[begin] == 1 else state)
                for c in new:
                    found[c].extend(made[c])
            last = place[-1] if len(place) else last
            made = [pa.array(found[c], t, from_pandas=True) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, *new])

    placed = df.withColumn("__place", F.row_number().over(ordered(by, order)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{c}` {t}" for c, t in new.items()]
    return placed.mapInArrow(run, ", ".join(fields))


def gate_step(most: float = MAX_STEP, out: str = "kept") -> Step:
    """[J5]"""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        points = list(zip(rows["lat"].tolist(), rows["lon"].tolist(), strict=True))
        kept = accepted(points, most, tuple(state) if state else None)
        return {out: kept}, next((p for p, ok in zip(reversed(points), reversed(kept), strict=True) if ok), state)

    return step


def throttle_step(time: str, delay: float, out: str = "kept") -> Step:
    """[J6]"""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        times = rows[time].tolist()
        kept = throttled(times, delay, state)
        return {out: kept}, next((t for t, ok in zip(reversed(times), reversed(kept), strict=True) if ok), state)

    return step


def low_pass_step(column: str, out: str, factor: float = LOW_PASS) -> Step:
    """[J1]"""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        values = low_pass(rows[column].tolist(), factor, state)
        return {out: values}, values[-1]

    return step


def high_pass_step(column: str, out: str, factor: float = HIGH_PASS) -> Step:
    """[J2]"""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        x = rows[column].tolist()
        values = high_pass(x, factor, tuple(state) if state else None)
        return {out: values}, (x[-1], values[-1])

    return step


def low_pass_filter(df: DataFrame, by: list[str], order: list[str], column: str, out: str, factor: float = LOW_PASS) -> DataFrame:
    return over_tracks(df, by, order, {out: "double"}, low_pass_step(column, out, factor))


def high_pass_filter(df: DataFrame, by: list[str], order: list[str], column: str, out: str, factor: float = HIGH_PASS) -> DataFrame:
    return over_tracks(df, by, order, {out: "double"}, high_pass_step(column, out, factor))


def last_accepted_gate(df: DataFrame, by: list[str], order: list[str], most: float = MAX_STEP, out: str = "kept") -> DataFrame:
    """A jump is judged from the last accepted point, not from the row before."""
    return over_tracks(df, by, order, {out: "boolean"}, gate_step(most, out))


def throttle(df: DataFrame, by: list[str], order: list[str], time: str, delay: float, out: str = "kept") -> DataFrame:
    return over_tracks(df, by, order, {out: "boolean"}, throttle_step(time, delay, out))
