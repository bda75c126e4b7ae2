"""Tabular, JSON, binary and sensor sources [A18-A21, A25-A30, A33, A34]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import schemas


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, cast by the reader's user [A20]."""
    return spark.read.option("header", True).csv(path)


def positional_points(lines: DataFrame) -> DataFrame:
    """Latitude and longitude by place (fields 1 and 2), header and short rows dropped [A19]."""
    p = F.split("line", ",")
    rows = lines.filter(F.size(p) >= 3).select("file", "line_no", F.get(p, 1).try_cast("double").alias("lat"), F.get(p, 2).try_cast("double").alias("lon"))
    return rows.filter("line_no > 0 AND lat IS NOT NULL AND lon IS NOT NULL")


def ui_points(spark: SparkSession, path: str, one_array_a_file: bool = True) -> DataFrame:
    """[A21] Files of one array each, or of an array a line, which Spark can split."""
    return spark.read.schema(schemas.UI_POINT).option("multiLine", one_array_a_file).json(path)


def merged_sensor_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MERGED_TEXT).option("sep", " ").csv(path)


def channels(spark: SparkSession, path: str) -> DataFrame:
    """(channel, session, seq, key0, time, value) of files named by channel, such as ``ANDACCX<session>.csv``."""
    from trajspark.sources.textlog import numbered_lines

    return channel_rows(numbered_lines(spark, path))


def channel_rows(lines: DataFrame) -> DataFrame:
    """[A26] of lines(file, line_no, line)."""
    p = F.split("line", ",")
    name = F.regexp_extract("file", r"AND(ACC[XYZ]|ORI(?:AZ|PI|RO)|GPS(?:LA|LO|SP))([^/]*)\.[^/.]*$", 1)
    session = F.regexp_extract("file", r"AND(ACC[XYZ]|ORI(?:AZ|PI|RO)|GPS(?:LA|LO|SP))([^/]*)\.[^/.]*$", 2)
    rows = lines.select(name.alias("channel"), session.alias("session"), F.col("line_no").alias("seq"), F.get(p, 0).alias("key0"), F.get(p, 1).alias("time"), F.get(p, 2).try_cast("double").alias("value"))
    return rows.filter("channel <> '' AND value IS NOT NULL")


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAINING_TEXT).option("sep", " ").option("mode", "DROPMALFORMED").csv(path)


def yaml_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(key, rows, cols, data) of each matrix in OpenCV YAML text [A28]."""
    return matrices(spark.read.text(path, wholetext=True))


def matrices(files: DataFrame) -> DataFrame:
    """[A28] of whole texts, ``value``, with the other columns of files."""
    pattern = r"(?s)(\w+): !!opencv-matrix\s+rows: (\d+)\s+cols: (\d+)\s+dt: \S+\s+data: \[(.*?)\]"
    others = [c for c in files.columns if c != "value"]
    found = files.select(*others, F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("m"))
    part = lambda i: F.regexp_extract("m", pattern, i)
    data = F.filter(F.transform(F.split(part(4), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return found.select(*others, part(1).alias("key"), part(2).cast("int").alias("rows"), part(3).cast("int").alias("cols"), data.alias("data"))


def sensor_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the capture app, all text, as numbers [A30]."""
    rows = spark.read.schema(schemas.SENSOR_ROWS).parquet(path)
    return rows.select("_id", *[F.col(c).try_cast("double").alias(c) for c in ("x", "y", "z", "speed", "latitude", "longitude")], "time", "location", "file")


def sensor_database(spark: SparkSession, url: str, driver: str = "org.sqlite.JDBC", dbtable: str = "sensor") -> DataFrame:
    """The same by JDBC, where the driver is there."""
    return spark.read.format("jdbc").options(url=url, driver=driver, dbtable=dbtable).load()


def rows_of_file(rows: DataFrame, file: str, columns: list[str] | None = None) -> DataFrame:
    """[D16]"""
    return rows.filter(F.col("file") == file).select(*(columns or rows.columns))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, md5, head): for byte comparison of solver outputs [A33, I29]."""
    files = spark.read.format("binaryFile").load(path)
    head = F.slice(F.split(F.decode("content", "UTF-8"), "\n"), 1, 14)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.array_join(head, "\n").alias("head"))


def listing(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """Files of a folder by prefix and suffix [A34]; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(folder)
    return files.select(F.col("path").alias("file"), "length", "modificationTime")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_no, content) by the number in the file name [A29]."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.[^/.]+$", 1).try_cast("int").alias("image_no"), "content").filter("image_no IS NOT NULL")


def renumbered(files: DataFrame, step: int = 129) -> DataFrame:
    """New numbers of files in name order, 1, 1 + step, ... [B20]"""
    from pyspark.sql import Window

    number = 1 + step * (F.row_number().over(Window.orderBy("file")) - 1)
    return files.withColumn("number", number)
