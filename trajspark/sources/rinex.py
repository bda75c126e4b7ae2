"""RINEX 3 observation files: header lines and epoch blocks [A16, A17, B9]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.timeconv import rinex_epoch

SATELLITE = "^[GRECJ]"


def blocks(lines: DataFrame) -> DataFrame:
    """(file, line_no, is_header, block_id, epoch, line). A block with a malformed epoch has none; files without a header's end are all header."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.coalesce(F.max(F.when(F.col("line").contains("END OF HEADER"), F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    starts = ~F.col("is_header") & F.col("line").startswith(">")
    rows = lines.withColumn("is_header", ~ended).withColumn("starts", starts)
    rows = rows.withColumn("block_id", F.sum(F.col("starts").cast("int")).over(w))
    p = F.split(F.trim(F.expr("substring(line, 2)")), r"\s+")
    part = lambda i, t="int": F.get(p, i).try_cast(t)
    own = F.when(F.col("starts"), rinex_epoch(part(0), part(1), part(2), part(3), part(4), part(5, "double")))
    block = Window.partitionBy("file", "block_id")
    rows = rows.withColumn("epoch", F.when(F.col("is_header"), None).otherwise(F.max(own).over(block)))
    return rows.filter(F.col("is_header") | ((F.col("block_id") > 0) & (F.trim("line") != ""))).select("file", "line_no", "is_header", "block_id", "epoch", "line")


def kept_lines(rows: DataFrame, dropped: DataFrame, gps_utc_offset: int = 0) -> DataFrame:
    """Header and blocks whose second is not in dropped(sec): the filtered file, in order [B9, D6]."""
    sec = (F.unix_micros("epoch") / 1_000_000).cast("long") - gps_utc_offset
    whole = rows.filter(F.col("is_header") | F.col("epoch").isNotNull()).withColumn("sec", sec)
    return whole.join(dropped.select("sec").distinct(), "sec", "left_anti").select("file", "line_no", "line")


def satellite_counts(rows: DataFrame) -> DataFrame:
    """(sat, n, first_line): lines of each satellite in block bodies [A17]."""
    body = rows.filter(~F.col("is_header") & F.col("line").rlike(SATELLITE) & (F.length("line") >= 3))
    return body.groupBy(F.substring("line", 1, 3).alias("sat")).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
