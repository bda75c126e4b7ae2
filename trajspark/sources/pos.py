"""Solution files: white-space columns, calendar or GPS-week times [A9-A15]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark import schemas
from trajspark.functions import text as T
from trajspark.functions.timeconv import gps_to_unix

# The deviation that stands for an absent one; the bounding box of the study area.
NO_DEVIATION = 999.0
BOX = (17.0, 19.0, 77.0, 82.0)


def solutions(lines: DataFrame, *, least: int = 7) -> DataFrame:
    """POS rows of lines(file, line_no, line). Either time format; comments, short and malformed rows go."""
    rows = lines.filter(~F.col("line").rlike(r"^\s*([%#]|$)")).withColumn("p", F.split(F.trim("line"), r"\s+")).filter(F.size("p") >= least)
    p = F.col("p")
    calendar = F.get(p, 0).contains("/") & F.get(p, 1).contains(":")
    when = F.when(calendar, F.try_to_timestamp(F.concat_ws(" ", F.get(p, 0), F.get(p, 1)), F.lit("yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSS]")))
    when = when.otherwise(F.timestamp_micros(F.round(gps_to_unix(T.number(p, 0), T.number(p, 1)) * 1e6).cast("long")))
    deviation = lambda i: F.coalesce(T.number(p, i), F.lit(NO_DEVIATION))
    parsed = rows.select(
        F.col("file").alias("track_id"), "line_no", when.alias("ts"), T.number(p, 2).alias("lat"), T.number(p, 3).alias("lon"),
        T.number(p, 4).alias("height"), T.number(p, 5, "int").alias("q"), T.number(p, 6, "int").alias("ns"), deviation(7).alias("sdn"), deviation(8).alias("sde"),
        *[T.number(p, 9 + i).alias(c) for i, c in enumerate(("sdu", "sdne", "sdeu", "sdun", "age", "ratio"))],
    ).filter("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    epoch = F.row_number().over(Window.partitionBy("track_id").orderBy("line_no")) - 1
    return parsed.withColumn("epoch", epoch.cast("long")).select(*schemas.POS.names)


def fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """The 15 typed columns of a file with single spaces; header lines go by their ``%`` [A15]."""
    return spark.read.schema(schemas.POS_FIXED).options(sep=" ", comment="%", ignoreLeadingWhiteSpace=True, mode="DROPMALFORMED").csv(path)


def in_box(lat: str = "lat", lon: str = "lon", box: tuple[float, float, float, float] = BOX):
    """[C4]"""
    return F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])


def quality_counts(rows: DataFrame) -> DataFrame:
    """[A12, E6]"""
    return rows.groupBy("q").count().withColumn("label", T.label_of(F.col("q"), T.SOLUTION_LABELS, "?"))
