"""Adapters of the driver's tables onto trajectories, epochs, roads and features.

Each is a DataFrame here and a common table expression in SQL, with the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BY, ORDER = ["user_id"], ["us", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(column: str = "ts") -> Column:
    """The driver's times have no zone: they are read as UTC whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trajectory a user. Steps are large: the points are spread over a degree."""
    e = table(spark, sf_dir, "events")
    event, value = F.col("event_id"), F.col("value")
    return e.select(
        "user_id", "event_id", micros().alias("us"), "event_type", "value",
        (F.lit(17.0) + (event % 997) / F.lit(1000.0) + value * F.lit(1e-5)).alias("lat"),
        (F.lit(78.0) + (event % 773) / F.lit(1000.0) + value * F.lit(2e-5)).alias("lon"),
        value.alias("height"),
        (F.lit(1) + event % 6).cast("int").alias("q"), (F.lit(2) + event % 9).cast("int").alias("ns"),
        (F.lit(0.5) + (event % 7) / F.lit(10.0)).alias("sdn"), (F.lit(0.4) + (event % 5) / F.lit(10.0)).alias("sde"), (F.lit(0.8) + (event % 11) / F.lit(10.0)).alias("sdu"),
    )


TRACK_SQL = """track AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value,
         17.0e0 + (event_id % 997) / 1000.0e0 + value * 1e-5 AS lat, 78.0e0 + (event_id % 773) / 1000.0e0 + value * 2e-5 AS lon,
         value AS height, (1 + event_id % 6)::INT AS q, (2 + event_id % 9)::INT AS ns,
         0.5e0 + (event_id % 7) / 10.0e0 AS sdn, 0.4e0 + (event_id % 5) / 10.0e0 AS sde, 0.8e0 + (event_id % 11) / 10.0e0 AS sdu
  FROM events)"""


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track of small steps: points within some 10 metres, for gates and recursions."""
    t = track(spark, sf_dir)
    return t.withColumn("lat", F.lit(17.0) + (F.col("event_id") % 97) * F.lit(1e-6) + F.col("value") * F.lit(1e-6)).withColumn("lon", F.lit(78.0) + (F.col("event_id") % 89) * F.lit(1e-6))


WALK_SQL = TRACK_SQL + """, walk AS (
  SELECT * REPLACE (17.0e0 + (event_id % 97) * 1e-6 + value * 1e-6 AS lat, 78.0e0 + (event_id % 89) * 1e-6 AS lon) FROM track)"""


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE WHEN {a} IS NULL OR {c} IS NULL THEN NULL ELSE 2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END)"


def steps_sql(source: str = "track") -> str:
    """CTE ``steps``: the source with step and i, the place in the track."""
    w = "OVER (PARTITION BY user_id ORDER BY us, event_id)"
    return f"""steps AS (
  SELECT *, coalesce({hav_sql('lag(lat) ' + w, 'lag(lon) ' + w, 'lat', 'lon')}, 0.0e0) AS step, row_number() {w} AS i FROM {source})"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite observations: minutes as seconds, values as signal strengths."""
    t = track(spark, sf_dir)
    return t.select(
        F.col("user_id"), (F.floor(F.col("us") / 60_000_000)).cast("long").alias("sec"), "event_id", F.col("event_id").alias("line_no"), F.lit(0).alias("slot"),
        F.col("value").alias("snr"), ((F.col("event_id") * 7) % 90).cast("double").alias("elev"), F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("event_id") % 3 == 1).alias("used"),
        "q", "lat", "lon", "us", (F.col("value") / 50.0).alias("hdop"), (F.col("value") / 20.0).alias("pdop"),
    )


EPOCHS_SQL = TRACK_SQL + """, epochs AS (
  SELECT user_id, floor(us / 60000000.0e0)::BIGINT AS sec, event_id, value AS snr, ((event_id * 7) % 90)::DOUBLE AS elev,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS used, q, lat, lon, us, value / 50.0e0 AS hdop, value / 20.0e0 AS pdop
  FROM track)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar road segments of some hundred metres, one a supplier."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        k.alias("seg_id"), k.alias("u"), (k + 1).alias("v"), F.lit(0).cast("long").alias("key"),
        ((k * 37) % 1000).cast("double").alias("x1"), ((k * 91) % 1000).cast("double").alias("y1"),
        ((k * 37) % 1000 + (k * 13) % 120 - 60).cast("double").alias("x2"), ((k * 91) % 1000 + (k * 29) % 120 - 60).cast("double").alias("y2"),
    )


def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar points over the segments' square, one an event."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", ((F.col("event_id") * 17) % 1000 + F.col("value") * 0.01).alias("x"), ((F.col("event_id") * 53) % 1000 + F.col("value") * 0.02).alias("y")
    )


SPACE_SQL = """segments AS (
  SELECT s_suppkey AS seg_id, ((s_suppkey * 37) % 1000)::DOUBLE AS x1, ((s_suppkey * 91) % 1000)::DOUBLE AS y1,
         ((s_suppkey * 37) % 1000 + (s_suppkey * 13) % 120 - 60)::DOUBLE AS x2, ((s_suppkey * 91) % 1000 + (s_suppkey * 29) % 120 - 60)::DOUBLE AS y2
  FROM supplier), planar AS (
  SELECT event_id, user_id, (event_id * 17) % 1000 + value * 0.01e0 AS x, (event_id * 53) % 1000 + value * 0.02e0 AS y FROM events)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and training vectors: every tenth vector is known."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("f"), (F.col("label") % 4).cast("int").alias("class"), F.transform(F.slice("embedding", 1, 30), lambda x: F.abs(x.cast("double"))).alias("hist"))
