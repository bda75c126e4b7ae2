"""GNSS logger text: ``Fix,`` and ``Status,`` rows [A6-A8]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions import text as T
from trajspark.functions.timeconv import rounded_second
from trajspark.sources.textlog import fields_of


def fixes(lines: DataFrame, least: int = 9) -> DataFrame:
    """(file, line_no, provider, lat, lon, h, acc, ts_ms); no height is 0, no accuracy is NaN."""
    p = F.col("p")
    rows = fields_of(lines, "Fix,", least).select(
        "file", "line_no", T.field(p, 1).alias("provider"), T.number(p, 2).alias("lat"), T.number(p, 3).alias("lon"),
        F.coalesce(T.number(p, 4), F.lit(0.0)).alias("h"), F.coalesce(T.number(p, 6), F.lit(float("nan"))).alias("acc"), T.number(p, 8, "long").alias("ts_ms"),
    )
    rows = rows.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.filter(F.col("ts_ms").isNotNull()) if least >= 9 else rows


def statuses(lines: DataFrame) -> DataFrame:
    """(file, line_no, sec, cn0, elev, used): a row for each satellite."""
    p = F.col("p")
    return (
        fields_of(lines, "Status,", 11)
        .select("file", "line_no", rounded_second(T.number(p, 1)).alias("sec"), T.number(p, 7).alias("cn0"), T.number(p, 9).alias("elev"), F.lower(F.trim(F.get(p, 10))).isin("1", "true", "t", "yes").alias("used"))
        .filter("sec IS NOT NULL")
    )


def best_last_location(locations: DataFrame, by: str = "provider") -> DataFrame:
    """Of each provider's last location the most accurate [A32]."""
    last = locations.groupBy(by).agg(F.max_by(F.struct(*locations.columns), F.struct("ts_ms", "line_no")).alias("x")).select("x.*")
    return last.agg(F.min_by(F.struct(*locations.columns), F.struct("acc", by)).alias("x")).select("x.*")
