"""Window operators over ordered tracks [F1-F19, C17]."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.geo import bearing, haversine, local_xy
from trajspark.operators.base import FOLLOWING, UNBOUNDED, centred, ordered, whole


def step_distance(df: DataFrame, by: list[str], order: list[str], out: str = "step", first: float | None = 0.0) -> DataFrame:
    """Metres to the previous point [F1]."""
    w = ordered(by, order)
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return df.withColumn(out, F.coalesce(step, F.lit(first)) if first is not None else step)


def kinematics(df: DataFrame, by: list[str], order: list[str], micros: str) -> DataFrame:
    """dt, velocity (0 if no time has passed) and acceleration (from the third point on) [F2, F16]. Needs step."""
    w = ordered(by, order)
    df = df.withColumn("dt", F.coalesce((F.col(micros) - F.lag(micros).over(w)) / 1e6, F.lit(0.0)))
    df = df.withColumn("velocity", F.when(F.col("dt") > 0, F.col("step") / F.col("dt")).otherwise(0.0))
    before = F.lag("velocity").over(w)
    return df.withColumn("accel", F.when((F.col("dt") > 0) & (F.row_number().over(w) > 2), F.abs(F.col("velocity") - before) / F.col("dt")))


def heading(df: DataFrame, by: list[str], order: list[str], out: str = "heading") -> DataFrame:
    """Bearing to the next point; the last point has the previous one's, a single point none [F11]."""
    w = ordered(by, order)
    dx, dy = local_xy(F.lead("lat").over(w), F.lead("lon").over(w), F.col("lat"), F.col("lon"))
    df = df.withColumn(out, bearing(dx, dy))
    return df.withColumn(out, F.coalesce(out, F.lag(out).over(w)))


def moving_average(df: DataFrame, by: list[str], order: list[str], column: str, half: int = 3, out: str | None = None) -> DataFrame:
    """Centred, over fewer points at the ends [F5]."""
    return df.withColumn(out or column, F.avg(column).over(centred(by, order, half)))


def rolling_upper_median(df: DataFrame, by: list[str], order: list[str], column: str, half: int = 2, out: str | None = None) -> DataFrame:
    """Centred; the upper one of two middle values [F4]."""
    values = F.array_sort(F.collect_list(column).over(centred(by, order, half)))
    return df.withColumn(out or column, F.element_at(values, (F.size(values) / 2).cast("int") + 1))


def gaussian_weights(half: int) -> list[float]:
    sigma = max(1.0, half / 2)
    raw = [math.exp(-(j * j) / (2 * sigma * sigma)) for j in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(df: DataFrame, by: list[str], order: list[str], column: str, half: int = 3, edge: str = "reflect", out: str | None = None, least: int | None = None) -> DataFrame:
    """Gaussian mean over 2 half + 1 points [F6, F7].

    edge: "reflect" repeats the end points in reverse order, "clamp" repeats the last one. Tracks of fewer than
    ``least`` points (3, or the window's size when clamped) stay as they are. A point beyond an end is at most
    half places away from this one, so both edges are picked from a window of 2 half - 1 neighbours and the ends.
    """
    w = ordered(by, order)
    n, i = F.count(F.lit(1)).over(whole(by)), F.row_number().over(w)
    least = least if least is not None else (3 if edge == "reflect" else 2 * half + 1)
    reach = 2 * half
    near = F.collect_list(F.coalesce(F.col(column), F.lit(float("nan")))).over(w.rowsBetween(-reach, reach))
    work = df.withColumn("__n", n).withColumn("__i", i).withColumn("__near", near)
    first = F.greatest(F.lit(1), F.col("__i") - reach)  # place of the window's first point
    total = F.lit(0.0)
    for j, weight in zip(range(-half, half + 1), gaussian_weights(half), strict=True):
        at = F.col("__i") + j
        if edge == "reflect":
            at = F.when(at < 1, 1 - at).when(at > F.col("__n"), 2 * F.col("__n") + 1 - at).otherwise(at)
        at = F.greatest(F.lit(1), F.least(F.col("__n"), at))
        total = total + F.lit(weight) * F.get("__near", (at - first).cast("int"))
    return work.withColumn(out or column, F.when(F.col("__n") < least, F.col(column)).otherwise(total)).drop("__n", "__i", "__near")


def trailing_time(df: DataFrame, by: list[str], micros: str, column: str, seconds: float = 2.0, out: str = "deviation") -> DataFrame:
    """Population deviation over the trailing seconds, this row included [F12]."""
    w = Window.partitionBy(*by).orderBy(micros).rangeBetween(-int(seconds * 1e6), 0)
    return df.withColumn(out, F.stddev_pop(column).over(w))


def trailing_distance(df: DataFrame, by: list[str], order: list[str], aggregate: Column, metres: float = 100.0, out: str = "trailing", step: str = "step", decimals: int | None = None) -> DataFrame:
    """An aggregate over the trailing metres of the track [F13, F18], run distances rounded if asked for. Needs step.

    A point is in the window if its run is at least this one's less ``metres``, in doubles, as SQL compares them. Frames take whole
    numbers, so other lengths are compared in thousandths.
    """
    run = F.sum(step).over(ordered(by, order).rowsBetween(UNBOUNDED, 0))
    run = run if decimals is None else F.round(run, decimals)
    scale = 1 if float(metres).is_integer() else 1000
    w = Window.partitionBy(*by).orderBy("__run").rangeBetween(-round(metres * scale), 0)
    return df.withColumn("__run", run * scale).withColumn(out, aggregate.over(w)).drop("__run")


def carry_forward(df: DataFrame, by: list[str], order: list[str], columns: list[str], initial: float | None = 0.0) -> DataFrame:
    """Last observation of each column, the initial value before any [F3]."""
    w = ordered(by, order).rowsBetween(UNBOUNDED, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return df.withColumns({c: last(c) if initial is None else F.coalesce(last(c), F.lit(initial)) for c in columns})


def epoch_index(df: DataFrame, by: list[str], order: list[str], out: str = "epoch") -> DataFrame:
    """[F14]"""
    return df.withColumn(out, (F.row_number().over(ordered(by, order)) - 1).cast("long"))


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """Running number of rows that start an island [F15]."""
    return df.withColumn("__starts", starts).withColumn(out, F.sum(F.col("__starts").cast("long")).over(ordered(by, order).rowsBetween(UNBOUNDED, 0))).drop("__starts")


def changed(df: DataFrame, by: list[str], order: list[str], columns: list[str], out: str = "changed") -> DataFrame:
    """Whether any of the columns differs from the row before, true for the first [C17, J7]."""
    w = ordered(by, order)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn(out, differs | (F.row_number().over(w) == 1))


def ends(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """First and last point of each track, by aggregates alone [F17]."""
    key = F.struct(*order)
    picks = [f(c, key).alias(f"{name}_{c}") for name, f in (("first", F.min_by), ("last", F.max_by)) for c in columns]
    return df.groupBy(*by).agg(*picks)


def neighbours_kept(df: DataFrame, by: list[str], order: list[str], keep: Column, columns: list[str]) -> DataFrame:
    """Adds __seq and, for the kept rows before and after this one, __p_<c> and __n_<c> with their places."""
    w = ordered(by, order)
    df = df.withColumn("__keep", keep).withColumn("__seq", F.row_number().over(w))
    before, after = w.rowsBetween(UNBOUNDED, 0), w.rowsBetween(0, FOLLOWING)
    for c in ["__seq", *columns]:
        kept = F.when(F.col("__keep"), F.col(c))
        df = df.withColumn(f"__p_{c}", F.last(kept, ignorenulls=True).over(before)).withColumn(f"__n_{c}", F.first(kept, ignorenulls=True).over(after))
    return df
