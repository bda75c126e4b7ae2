"""Robust statistics, gates and outlier flags [C20-C25, E7, E15, E16, K12, K16]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.base import exact_percentile, ordered, with_group_values

# MAD to sigma, sigmas, walking limits, interquartile multiple.
MAD_SIGMA = 1.4826
SIGMAS = 3.0
MAX_WALK_SPEED, MAX_ACCELERATION = 1.4, 2.0
SPIKE_IQR = 2.5
MIN_PAIRS = 10


def mad_limits(df: DataFrame, by: list[str], columns: list[str], sigmas: float = SIGMAS) -> DataFrame:
    """<c>_median, <c>_mad and <c>_limit of each group: median + sigmas * 1.4826 * MAD [C21].

    Two aggregations; the deviations come from a join with the medians, never from a collected group.
    """
    medians = df.groupBy(*by).agg(*[exact_percentile(F.col(c), 0.5).alias(f"{c}_median") for c in columns])
    off = with_group_values(df.select(*by, *columns), by, medians)
    mads = off.groupBy(*by, *[f"{c}_median" for c in columns]).agg(*[exact_percentile(F.abs(F.col(c) - F.col(f"{c}_median")), 0.5).alias(f"{c}_mad") for c in columns])
    return mads.withColumns({f"{c}_limit": F.col(f"{c}_median") + sigmas * MAD_SIGMA * F.col(f"{c}_mad") for c in columns})


def mad_outliers(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Adds <column>_limit and outlier."""
    out = with_group_values(df, by, mad_limits(df, by, [column]).select(*by, f"{column}_limit"))
    return out.withColumn("outlier", F.col(column) > F.col(f"{column}_limit"))


def integrity_gate(df: DataFrame, by: list[str], rms: str = "rms", step: str = "step") -> DataFrame:
    """Adds excluded: root-mean-square or step over its limit [C22]. Both limits come from one pair of aggregations."""
    limits = mad_limits(df, by, [rms, step]).select(*by, f"{rms}_limit", f"{step}_limit")
    out = with_group_values(df, by, limits)
    return out.withColumn("excluded", (F.col(rms) > F.col(f"{rms}_limit")) | (F.col(step) > F.col(f"{step}_limit")))


def iqr_spikes(df: DataFrame, by: list[str], order: list[str], step: str = "step", multiple: float = SPIKE_IQR, least: int = 4) -> DataFrame:
    """Adds spike: step over Q75 + multiple * IQR, the first row and groups under ``least`` rows excepted [C23].

    The rule that also looks at the way past a point marks nothing that this one doesn't, so it is left out.
    """
    w = ordered(by, order)
    numbered = df.withColumn("__i", F.row_number().over(w))
    q = numbered.filter("__i > 1").groupBy(*by).agg(F.percentile(step, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"), (F.count("*") + 1).alias("__n"))
    limit = F.get("__q", 1) + multiple * (F.get("__q", 1) - F.get("__q", 0))
    out = with_group_values(numbered, by, q).withColumn("spike_limit", limit)
    return out.withColumn("spike", F.coalesce((F.col("__i") > 1) & (F.col("__n") >= least) & (F.col(step) > F.col("spike_limit")), F.lit(False))).drop("__i", "__q", "__n")


def kinematic_reason(velocity: Column, accel: Column, max_speed: float = MAX_WALK_SPEED, max_accel: float = MAX_ACCELERATION) -> Column:
    """Why a point is excluded, null if it isn't [C20]."""
    return F.when(velocity > max_speed, "velocity").when(accel > max_accel, "accel")


def sigma_clip(df: DataFrame, by: list[str], column: str, sigmas: float = SIGMAS) -> DataFrame:
    """Rows strictly within the limit around the median; a MAD of 0 keeps nothing [C25]."""
    limits = mad_limits(df, by, [column], sigmas).select(*by, f"{column}_median", f"{column}_mad")
    near = F.abs(F.col(column) - F.col(f"{column}_median")) < sigmas * MAD_SIGMA * F.col(f"{column}_mad")
    return with_group_values(df, by, limits).filter(near).drop(f"{column}_median", f"{column}_mad")


def trimmed_median(column: Column) -> Column:
    """Median after a quarter is cut from both ends: a symmetric cut leaves it unchanged [E15]."""
    return exact_percentile(column, 0.5)


def bias_estimate(pairs: DataFrame, by: list[str], dlat: str = "dlat", dlon: str = "dlon", least: int = MIN_PAIRS) -> DataFrame:
    """(by, n, bias_lat, bias_lon): trimmed medians of clipped differences; 0 under ``least`` pairs or if all are clipped [E16]."""
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    out = counts
    for column, name in ((dlat, "bias_lat"), (dlon, "bias_lon")):
        middle = sigma_clip(pairs, by, column).groupBy(*by).agg(trimmed_median(F.col(column)).alias(name))
        out = out.join(middle, by, "left")
    value = lambda c: F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    return out.select(*by, "n", value("bias_lat"), value("bias_lon"))


def apply_bias(df: DataFrame, by: list[str], bias: DataFrame) -> DataFrame:
    """[K12]"""
    moved = with_group_values(df, by, bias.select(*by, "bias_lat", "bias_lon"))
    add = lambda c, b: F.col(c) + F.coalesce(b, F.lit(0.0))
    return moved.withColumn("lat", add("lat", "bias_lat")).withColumn("lon", add("lon", "bias_lon")).drop("bias_lat", "bias_lon")


def step_outlier(df: DataFrame, by: list[str], order: list[str], x: str = "x", y: str = "y", most: float = 3.0) -> DataFrame:
    """Adds keep: the planar step from the row before, kept or not, is at most ``most`` [C24]."""
    w = ordered(by, order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("keep", F.coalesce(step <= most, F.lit(True)))
