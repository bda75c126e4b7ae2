"""Text logs with exact line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line). Recordings are bounded files: each is read whole, so that line numbers are exact."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def fields_of(lines: DataFrame, prefix: str, least: int, separator: str = ",") -> DataFrame:
    """Lines with a prefix [C1] and enough fields [C2], split."""
    split = lines.filter(F.col("line").startswith(prefix)).withColumn("p", F.split("line", separator))
    return split.filter(F.size("p") >= least)
