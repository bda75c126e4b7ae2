"""Sinks [B1-B19]: each makes the rows or lines of a file with column expressions and writes them with Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.timeconv import clock_label

# Categories of road conditions in the map overlay.
OVERLAY = {0: "place_of_worship", 1: "bank", 2: "fast_food", 3: "none"}


def fixed(column: str, decimals: int, name: str | None = None) -> Column:
    return F.format_string(f"%.{decimals}f", F.col(column)).alias(name or column)


def gated_rows(points: DataFrame) -> DataFrame:
    """[B1]"""
    return points.select("lat", "lon", F.col("ts_ms").alias("timestamp"), "hdop", "sats")


def ui_rows(points: DataFrame, surface: str, condition: str, file: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """[B2] by: columns that name a session, for ``json_array``."""
    constants = [F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("z", 1.0), ("v", 10.0))]
    return points.select(*by, *constants, "lat", "lon", clock_label(F.col("ts_ms")).alias("time"), F.col("ts_ms").alias("milli"), F.lit(file).alias("file"), F.lit(surface).alias("Surface"), F.lit(condition).alias("Condition"))


def json_array(rows: DataFrame, order: list[str], by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """One row, a JSON array, for each session (``by``); a session's points are one row.

    most: a longer session has several arrays, each of at most so many points, one after the other in order.
    """
    columns = [c for c in rows.columns if c not in by]
    key = list(by)
    if most is not None:
        rows = rows.withColumn("__part", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / most))
        key.append("__part")
    kept = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.to_json(F.struct(*columns)).alias("j")))), lambda x: x["j"])
    return rows.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")).alias("json")).drop("__part")


def legacy_lines(points: DataFrame, column: str) -> DataFrame:
    """``1.0,<ms>,<value>`` [B3]"""
    return points.select("ts_ms", F.concat_ws(",", F.lit("1.0"), F.col("ts_ms"), F.col(column)).alias("value"))


def legacy_names(points: DataFrame) -> DataFrame:
    first = clock_label(F.min("ts_ms"))
    return points.agg(F.concat(F.lit("ANDGPSLA"), first, F.lit(".csv")).alias("lat_file"), F.concat(F.lit("ANDGPSLO"), first, F.lit(".csv")).alias("lon_file"))


def fix_rows(fixes: DataFrame) -> DataFrame:
    """[B4]"""
    utc = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return fixes.select(utc.alias("utc"), fixed("lat", 10), fixed("lon", 10), fixed("h", 3, "height"))


def cleaned_rows(rows: DataFrame) -> DataFrame:
    """[B5]"""
    return rows.select("epoch", fixed("lat", 8), fixed("lon", 8), fixed("height", 3), F.col("q").alias("Q"))


def smoothed_rows(rows: DataFrame) -> DataFrame:
    """[B6]"""
    return rows.select(
        F.date_format("ts", "yyyy/MM/dd").alias("date"), F.date_format("ts", "HH:mm:ss.SSS").alias("time"), fixed("lat", 8, "lat_raw"), fixed("lon", 8, "lon_raw"),
        fixed("lat_s", 8, "lat_smoothed"), fixed("lon_s", 8, "lon_smoothed"), fixed("height", 3, "height_m"), fixed("sdn", 3, "sdn_m"), fixed("sde", 3, "sde_m"), F.col("interpolated").cast("int").alias("interpolated"),
    )


def particle_rows(rows: DataFrame) -> DataFrame:
    """[B7]"""
    return rows.select("lat", "lon", F.col("confidence").alias("particle_confidence"), "epoch")


def exported_rows(rows: DataFrame) -> DataFrame:
    """[B8]"""
    from trajspark.functions.text import REPORT_LABELS, label_of

    return rows.select(
        F.col("ts").alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("height").alias("elevation_m"), F.col("q").alias("quality_code"),
        label_of(F.col("q"), REPORT_LABELS, "Other").alias("quality_type"), F.col("sdn").alias("horiz_acc_n"), F.col("sde").alias("horiz_acc_e"),
    )


def metrics_text(stats: DataFrame) -> DataFrame:
    """A line for each method [B10]."""
    line = F.format_string("%s: n=%d mean=%.3f median=%.3f p95=%.3f max=%.3f", "method", "n", "mean_step", "median_step", "p95_step", "max_step")
    return stats.select("method", line.alias("value"))


def overlay_nodes(points: DataFrame, number: Column, first_id: int = 1) -> DataFrame:
    """Map nodes with a category by class; ids rise with ``number`` (from 0) [B13]."""
    from trajspark.functions.text import label_of

    kind = label_of(F.col("class"), OVERLAY, "none")
    line = F.format_string('<node id="%d" lat="%.6f" lon="%.6f"><tag k="amenity" v="%s"/></node>', number + first_id, F.col("lat"), F.col("lon"), kind)
    return points.select((number + first_id).alias("id"), line.alias("value"))


def result_rows(rows: DataFrame) -> DataFrame:
    """[B14]"""
    return rows.select("lat", "lon", "label", "rmsd_x")


def merged_lines(rows: DataFrame) -> DataFrame:
    """[B19]"""
    columns = ("t", "x", "y", "z", "lat", "lon", "speed", "azimuth", "pitch", "roll", "image_no")
    return rows.select(*columns[:1], F.concat_ws(" ", *columns).alias("value"))


def write_csv(rows: DataFrame, folder: str, header: bool = True, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", header).csv(folder)


def write_lines(rows: DataFrame, folder: str, order: list[str], mode: str = "overwrite") -> None:
    """Lines in order: range partitions, each sorted, so that the part files follow each other."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(folder)


def append_rows(rows: DataFrame, folder: str) -> None:
    """[B15, B16, B17, K8]"""
    rows.write.mode("append").parquet(folder)


def without_file(rows: DataFrame, file: str) -> DataFrame:
    """What a delete by file leaves [B17, K18]; rows without a file stay."""
    return rows.filter(~F.col("file").eqNullSafe(F.lit(file)))


def files_to_delete(rows: DataFrame, file: str) -> DataFrame:
    return rows.filter(F.col("file") == file).select("location").distinct()
