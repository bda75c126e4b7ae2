"""Interpolation and cleaning chains [F8-F10, K9-K11, K13]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.geo import lerp, local_latlon, local_xy
from trajspark.operators.base import exact_percentile, ordered
from trajspark.operators.robust import MAD_SIGMA, apply_bias, bias_estimate, iqr_spikes, step_outlier
from trajspark.operators.windows import gaussian_smooth, moving_average, neighbours_kept, rolling_upper_median, step_distance
from trajspark.shipping import ship


def gap_interpolate(df: DataFrame, by: list[str], order: list[str], columns: list[str], keep: str = "keep", edges: bool = True) -> DataFrame:
    """Rows that aren't kept lie on the line, by place, between the kept neighbours [F8]; adds interpolated.

    edges: rows before the first or after the last kept row take its value; otherwise they stay [F9].
    """
    out = neighbours_kept(df, by, order, F.col(keep), columns)
    alpha = (F.col("__seq") - F.col("__p___seq")) / (F.col("__n___seq") - F.col("__p___seq"))
    inner = F.col("__p___seq").isNotNull() & F.col("__n___seq").isNotNull()
    for c in columns:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        beyond = F.coalesce(p, n, F.col(c)) if edges else F.col(c)
        out = out.withColumn(c, F.when(F.col("__keep"), F.col(c)).when(inner, lerp(p, n, alpha)).otherwise(beyond))
    out = out.withColumn("interpolated", ~F.col("__keep") & (inner | (F.lit(edges) & (F.col("__p___seq").isNotNull() | F.col("__n___seq").isNotNull()))))
    return out.drop("__keep", "__seq", *[f"__{s}_{c}" for s in "pn" for c in ["__seq", *columns]])


def spike_interpolate(df: DataFrame, by: list[str], order: list[str], multiple: float = 2.5) -> DataFrame:
    """Spikes by interquartile range, replaced on the line between the good points around them [K16]. Needs step."""
    flagged = iqr_spikes(df, by, order, multiple=multiple).withColumn("keep", ~F.col("spike"))
    return gap_interpolate(flagged, by, order, ["lat", "lon"], edges=False).drop("keep", "interpolated")


def on_first_plane(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds lat0, lon0 (the first point's) and x, y on the plane there."""
    w = ordered(by, order)
    df = df.withColumn("lat0", F.first("lat").over(w)).withColumn("lon0", F.first("lon").over(w))
    x, y = local_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return df.withColumn("x", x).withColumn("y", y)


def smooth_plane(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Median of 5, mean of 7, and back to degrees as lat_s, lon_s [K10]."""
    for c in ("x", "y"):
        df = rolling_upper_median(df, by, order, c, 2)
    for c in ("x", "y"):
        df = moving_average(df, by, order, c, 3)
    lat, lon = local_latlon(F.col("x"), F.col("y"), F.col("lat0"), F.col("lon0"))
    return df.withColumn("lat_s", lat).withColumn("lon_s", lon)


def clean_track(df: DataFrame, by: list[str], order: list[str], max_step: float = 3.0) -> DataFrame:
    """Project, flag long steps, interpolate, smooth, project back [K9]."""
    flat = step_outlier(on_first_plane(df, by, order), by, order, most=max_step)
    return smooth_plane(gap_interpolate(flat, by, order, ["x", "y"]), by, order).drop("keep", "lat0", "lon0")


def smooth_track(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return smooth_plane(on_first_plane(df, by, order), by, order).drop("lat0", "lon0")


def correct_track(df: DataFrame, by: list[str], order: list[str], pairs: DataFrame) -> DataFrame:
    """Bias, then spikes, then Gaussian smoothing [K11]. pairs(by, dlat, dlon): differences from the reference track."""
    moved = step_distance(apply_bias(df, by, bias_estimate(pairs, by)), by, order)
    good = spike_interpolate(moved, by, order).drop("step", "spike", "spike_limit")
    for c in ("lat", "lon"):
        good = gaussian_smooth(good, by, order, c, 3)
    return good


def replace_outliers(values: np.ndarray, outlier: np.ndarray, half: int = 2) -> np.ndarray:
    """Outliers, last first, become the mean of their neighbours; then, first first, the median of five around them."""
    out = values.astype(float).copy()
    n = len(out)
    inner = [i for i in np.flatnonzero(outlier) if 0 < i < n - 1]
    for i in reversed(inner):
        out[i] = (out[i - 1] + out[i + 1]) / 2
    for i in inner:
        out[i] = np.median(out[max(0, i - half) : i + half + 1], axis=0)
    return out


def adaptive_median(df: DataFrame, by: list[str], order: list[str], columns: tuple[str, ...] = ("lat", "lon", "height")) -> DataFrame:
    """Steps over the MAD limit are replaced [K13, F10]. Needs step. Adds is_outlier.

    A replaced point is read by the next one, which no window can say, so each track is one group in Python.
    """
    ship(df.sparkSession)
    limits = df.groupBy(*by).agg(exact_percentile(F.col("step"), 0.5).alias("__m"))
    off = df.join(limits, by)
    limits = off.groupBy(*by, "__m").agg(exact_percentile(F.abs(F.col("step") - F.col("__m")), 0.5).alias("__d"))
    flagged = df.join(limits.select(*by, (F.col("__m") + 3 * MAD_SIGMA * F.col("__d")).alias("__limit")), by).withColumn("is_outlier", F.col("step") > F.col("__limit")).drop("__limit")

    def run(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values(order, kind="stable")
        new = replace_outliers(track[list(columns)].to_numpy(), track["is_outlier"].to_numpy())
        return track.assign(**{c: new[:, i] for i, c in enumerate(columns)})

    return flagged.groupBy(*by).applyInPandas(run, flagged.schema)
