"""Streams over the driver's events, run to the end of what is there; the same rows as the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.plans.driver_views import TRACK_SQL, WALK_SQL, hav_sql, micros
from trajspark.plans.registry import query
from trajspark.plans.track_queries import _recursive_sql
from trajspark.plans.work import work_folder
from trajspark.streaming import stateful as S

WALK = ["user_id", "event_id", "ts", "value", "event_type"]


#: Parts of the recording, each read as micro-batches of its own.
PARTS = 4


def walk_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(the events as a recording in a folder, the time that a part of it lasts).

    The recording is written in PARTS spans of time, one after the other, as file sources go by the files' times. A user
    has one file in each part; a batch takes some files, so state is carried from batch to batch and the watermark moves.
    """
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(*WALK)
    first, last = events.agg(F.min(micros()), F.max(micros())).first()
    folder = f"{work_folder(spark, 'stream')}/in"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = ((last or 0) - (first or 0)) // PARTS + 1
    for i in range(PARTS):
        part = events.filter(F.floor((micros() - F.lit(first or 0)) / length) == i)
        part.repartition(files, "user_id").write.mode("append").parquet(folder)
    e = S.replay(spark, folder, events.schema, files_a_batch=files)
    lat = F.lit(17.0) + (F.col("event_id") % 97) * F.lit(1e-6) + F.col("value") * F.lit(1e-6)
    lon = F.lit(78.0) + (F.col("event_id") % 89) * F.lit(1e-6)
    rows = e.select("user_id", "event_id", micros().alias("us"), F.col("ts").cast("timestamp").alias("ts"), lat.alias("lat"), lon.alias("lon"), "value", "event_type")
    return rows, f"{length // 1_000_000 + 10} seconds"


def streamed(spark: SparkSession, sf_dir: str, new: dict[str, str], step: S.Step) -> DataFrame:
    """Rows with the columns that the step makes; a batch may hold files of two parts, so rows are late by a part at most."""
    rows, part = walk_stream(spark, sf_dir)
    return run_to_end(spark, S.track_stream(rows, ["user_id"], ["us", "event_id"], "ts", new, step, delay=part, timeout="3650 days"))


def run_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = work_folder(spark, "stream")
    S.write_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(_recursive_sql("lat AS la, lon AS lo, true AS kept", f"CASE WHEN {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8 THEN n.lat ELSE r.la END, CASE WHEN {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8 THEN n.lon ELSE r.lo END, {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8", "walk", WALK_SQL) + " SELECT event_id, kept FROM r")
def stream_last_accepted(spark, sf_dir):
    """Source, watermark, state and sink."""
    return streamed(spark, sf_dir, {"kept": "boolean"}, S.gate_step(8.0)).select("event_id", "kept")


@query(_recursive_sql("value AS y", "0.5e0 * n.value + (1 - 0.5e0) * r.y") + " SELECT event_id, y AS low FROM r")
def stream_lowpass(spark, sf_dir):
    """J1, J8."""
    return streamed(spark, sf_dir, {"low": "double"}, S.low_pass_step("value", "low")).select("event_id", "low")


@query(_recursive_sql("0.0e0 AS y", "0.85e0 * (r.y + n.value - r.value)") + " SELECT event_id, y AS high FROM r")
def stream_highpass(spark, sf_dir):
    """J2, J8."""
    return streamed(spark, sf_dir, {"high": "double"}, S.high_pass_step("value", "high")).select("event_id", "high")


@query(_recursive_sql("us AS last, true AS kept", "CASE WHEN n.us - 43200000000 > r.last THEN n.us ELSE r.last END, n.us - 43200000000 > r.last") + " SELECT event_id, kept FROM r")
def stream_throttle(spark, sf_dir):
    """J6, C27."""
    return streamed(spark, sf_dir, {"kept": "boolean"}, S.throttle_step("us", 43_200_000_000)).select("event_id", "kept")


@query(f"WITH {TRACK_SQL} SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS changed FROM track")
def stream_changes(spark, sf_dir):
    """J7, C17."""
    return streamed(spark, sf_dir, {"changed": "boolean"}, S.change_step(["event_type"])).select("event_id", "changed")


@query(f"WITH {TRACK_SQL} SELECT event_id, round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 6) AS deviation FROM track")
def stream_time_window(spark, sf_dir):
    """The deviation over the trailing day."""
    return streamed(spark, sf_dir, {"deviation": "double"}, S.time_window_step("us", "value", seconds=86_400_000_000)).select("event_id", F.round("deviation", 6).alias("deviation"))


@query(_recursive_sql("lat AS la, 0.0e0 AS far", f"n.lat, r.far + {hav_sql('r.lat', 'r.lon', 'n.lat', 'n.lon')}", "walk", WALK_SQL) + """, m AS (SELECT user_id, i, event_id, value, far FROM r)
SELECT a.event_id, round(sqrt(avg(b.value * b.value)), 4) AS trailing FROM m a JOIN m b ON b.user_id = a.user_id AND b.i <= a.i AND b.far >= a.far - 40 GROUP BY a.event_id""")
def stream_distance_window(spark, sf_dir):
    """The root mean square over the trailing 40 metres."""
    return streamed(spark, sf_dir, {"trailing": "double"}, S.distance_window_step("value", metres=40.0)).select("event_id", F.round("trailing", 4).alias("trailing"))
