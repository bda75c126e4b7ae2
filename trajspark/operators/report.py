"""Statistics and reports of tracks [E6-E14, E17-E25, G2, G3, K14, C30, C31, K15]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.text import coordinate_json
from trajspark.operators.base import exact_percentile, with_group_values

# Step limits in metres and weights of the exclusion score.
LIMITS = (3, 5, 10)
SCORE = {"gt5": 100.0, "gt3": 10.0, "p95_step": 5.0, "mean_step": 1.0}
UI_FIELDS = ("x", "y", "z", "v", "lat", "lon", "time", "milli", "Surface", "Condition")


def step_stats(steps: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Count, mean, median, linear P95, greatest, and counts over the limits [E7, E7e]."""
    s = F.col(step)
    return steps.groupBy(*by).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean_step"), exact_percentile(s, 0.5).alias("median_step"), exact_percentile(s, 0.95).alias("p95_step"), F.max(s).alias("max_step"),
        *[F.count_if(s > m).alias(f"gt{m}") for m in LIMITS],
    )


def sorted_places(df: DataFrame, by: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy(column)) - 1)


def place_stats(df: DataFrame, by: list[str], column: str, places: dict[str, Column]) -> DataFrame:
    """Order statistics at places (from 0) that may use __n [E7b-E7d]."""
    rows = sorted_places(df, by, column)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("__k") == p, F.col(column))).alias(name) for name, p in places.items()])


def floor_p95() -> Column:
    return F.floor(0.95 * (F.col("__n") - 1))


def clamped_p95() -> Column:
    return F.greatest(F.lit(0), (0.95 * F.col("__n")).cast("int") - 1)


def upper_median() -> Column:
    return F.floor(F.col("__n") / 2)


def upper_p90() -> Column:
    return (0.9 * F.col("__n")).cast("int")


def histogram(df: DataFrame, by: list[str], column: str, width: float, most: float) -> DataFrame:
    """Counts of bins of a width over 0 to most; the last bin holds its right edge [E8]."""
    last = round(most / width) - 1
    at = F.least(F.floor(F.col(column) / width).cast("int"), F.lit(last))
    inside = df.filter((F.col(column) >= 0) & (F.col(column) <= most))
    return inside.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


RANK_BUCKETS = 256


def ranked(df: DataFrame, by: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Rank from 1 and size of each group, as <out> and <out>_of; the first order column is a number.

    A group may be most of the table, so rows are ranked within 256 slices of its range; the slices' counts give
    the ranks before them.
    """
    v = F.col(order[0])
    ends = df.groupBy(*by).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    share = F.coalesce(F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    sliced = with_group_values(df, by, ends).withColumn("__b", F.least(F.lit(RANK_BUCKETS - 1), F.floor(share * RANK_BUCKETS).cast("int"))).drop("__lo", "__hi")
    counts = sliced.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__c").over(w)).drop("__c")
    own = sliced.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)))
    joined = own.join(counts, [*by, "__b"])
    return joined.withColumn(out, F.col("__before") + F.col("__r")).withColumn(f"{out}_of", F.col("__all")).drop("__b", "__r", "__before", "__all")


def ecdf(df: DataFrame, by: list[str], order: list[str], first: int = 1, out: str = "percent") -> DataFrame:
    """Percent of rows up to this one, counted from ``first`` (1 or 0) [E9]."""
    rows = ranked(df, by, order, "__rank")
    return rows.withColumn(out, 100.0 * (F.col("__rank") - 1 + first) / F.col("__rank_of")).drop("__rank", "__rank_of")


def box_summary(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of points beyond [E10]."""
    q = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, F.get("q", 0).alias("q1"), F.get("q", 1).alias("q2"), F.get("q", 2).alias("q3"))
    rows = df.select(*by, F.col(column).alias("__v")).join(q, by) if by else df.select(F.col(column).alias("__v")).crossJoin(q)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("__v").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col("__v"))).alias("low"), F.max(F.when(inside, F.col("__v"))).alias("high"), F.count_if(~inside).alias("beyond"))


def transposed(stats: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A row for each metric of each key [E11]."""
    return stats.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "value")


def improvement(before: DataFrame, after: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Absolute and relative gain of each metric [E12]."""
    b = before.select(*by, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    a = after.select(*by, *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics])
    rows = b.join(a, by).select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after")) for m in metrics])).alias("x")).select(*by, "x.*")
    gain = F.col("before") - F.col("after")
    return rows.withColumn("gain", gain).withColumn("gain_percent", F.try_divide(100 * gain, F.col("before")))


def path_length(steps: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """[E13]"""
    return steps.groupBy(*by).agg(F.sum(step).alias("length"), F.count("*").alias("points"))


def bounds(df: DataFrame, by: list[str], pad: float = 0.001) -> DataFrame:
    """Centre and padded box [E14]."""
    return df.groupBy(*by).agg(
        F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"), (F.min("lat") - pad).alias("south"), (F.min("lon") - pad).alias("west"), (F.max("lat") + pad).alias("north"), (F.max("lon") + pad).alias("east")
    )


def layers(df: DataFrame, layer: list[str], order: list[str], step: str = "step", decimals: int = 7) -> DataFrame:
    """Data of map layers [B11, H6, H7]: ordered coordinates as JSON, box, points and length; empty layers have no row.

    A layer is one recording, drawn as a whole, so its points are gathered in one row.
    """
    point = F.struct(*order, coordinate_json(F.col("lat"), F.col("lon"), decimals).alias("c"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["c"]), ","), F.lit("]"))
    box = [f(c).alias(n) for n, f, c in (("south", F.min, "lat"), ("west", F.min, "lon"), ("north", F.max, "lat"), ("east", F.max, "lon"))]
    return df.groupBy(*layer).agg(text.alias("coords"), *box, F.count("*").alias("points"), F.sum(step).alias("length"))


def range_summary(df: DataFrame, by: list[str], micros: str, accuracy: str) -> DataFrame:
    """[E17]"""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(micros).alias("first_us"), F.max(micros).alias("last_us"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.avg(accuracy).alias("mean_accuracy"))


def top_frequent(counts: DataFrame, n: int = 40) -> DataFrame:
    """Most frequent rows, ties by first appearance [G2]: a report, so the limit is the feature."""
    return counts.orderBy(F.desc("n"), "first_line").limit(n)


def exclusion_scores(stats: DataFrame, key: str, base: str) -> DataFrame:
    """Gain of each candidate over the baseline, weighted [E24, K14]."""
    b = stats.filter(F.col(key) == base).select(*[F.col(m).cast("double").alias(f"b_{m}") for m in SCORE])
    total = F.lit(0.0)
    for m, weight in SCORE.items():
        total = total + (F.col(f"b_{m}") - F.col(m)) * weight
    return stats.filter(F.col(key) != base).join(F.broadcast(b), F.lit(True)).withColumn("score", total).drop(*[f"b_{m}" for m in SCORE])


def top_scores(scores: DataFrame, key: str, n: int = 8) -> DataFrame:
    """[G3]"""
    return scores.orderBy(F.desc("score"), F.desc(key)).limit(n)


def amalgamate(df: DataFrame, x: str, y: str, value: str, size: float = 2.0) -> DataFrame:
    """One row for each cell of size x size metres [E25]: points and mean value."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    return df.groupBy(cell(x).alias("cell_x"), cell(y).alias("cell_y")).agg(F.count("*").alias("points"), F.avg(value).alias("mean_value"))


def colour_histogram(pixels: DataFrame, by: list[str], hue: str, bins: int = 30, top: float = 180.0) -> DataFrame:
    """[E22]"""
    at = F.floor(F.col(hue) * bins / top).cast("int")
    return pixels.filter((F.col(hue) >= 0) & (F.col(hue) < top)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def audit(points: DataFrame, required: tuple[str, ...] = UI_FIELDS) -> DataFrame:
    """A row for each check of UI points [K15, C30, C31]: name, ok, detail."""
    missing = sorted(set(required) - set(points.columns))
    fields = points.sparkSession.range(1).select(F.lit("fields").alias("name"), F.lit(not missing).alias("ok"), F.lit(",".join(missing)).alias("detail"))
    checks = {
        "rows": (F.count("*") > 0, F.count("*")),
        "latitude": ((F.min("lat") >= -90) & (F.max("lat") <= 90), F.count("lat")),
        "longitude": ((F.min("lon") >= -180) & (F.max("lon") <= 180), F.count("lon")),
        "time": (F.min("milli") <= F.max("milli"), F.countDistinct("milli")),
    }
    rows = [F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), d.cast("string").alias("detail")) for n, (ok, d) in checks.items()]
    ranges = points.agg(F.array(*rows).alias("x"))
    return fields.unionByName(ranges.select(F.inline("x")))
