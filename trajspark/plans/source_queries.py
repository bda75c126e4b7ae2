"""Queries of file formats and sinks: texts made of the driver's rows, written where a source reads files, and parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import schemas
from trajspark.functions.timeconv import micros_of, nmea_time
from trajspark.operators.quality import classify_now, prefer
from trajspark.plans.driver_views import BY, ORDER, TRACK_SQL, table, track
from trajspark.plans.registry import query, r6
from trajspark.plans.work import work_folder
from trajspark.sources import gnsslog, pos, rinex, roads, sinks, tables

DEGREES = "('{}.' || lpad((event_id * {} % 1000)::VARCHAR, 3, '0'))::DOUBLE"
LAT, LON = DEGREES.format(17, 1), DEGREES.format(78, 7)
#: Points of a JSON array, which is a line.
POINTS_A_LINE = 1000
DAY, CLOCK = 1_773_532_800, "%02d:%02d:%02d"  # 2026-03-15


def event() -> Column:
    return F.col("event_id")


def degrees(whole: int, factor: int) -> Column:
    return F.format_string(f"{whole}.%03d", event() * factor % 1000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def as_lines(rows: DataFrame, line: Column, file: Column | None = None) -> DataFrame:
    """(file, line_no, line): a log for each user, made once, as if read."""
    named = F.col("user_id").cast("string") if file is None else file
    return rows.select(named.alias("file"), event().alias("line_no"), F.explode(F.array(line)).alias("line"))


def clock(seconds: Column) -> Column:
    return F.format_string(CLOCK, F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


def written(rows: DataFrame, name: str, **options) -> str:
    folder = work_folder(rows.sparkSession, name)
    sinks.write_csv(rows, folder, **options)
    return folder


# --- logger text ---------------------------------------------------------------------------------------------


def _fix_lines(spark, sf_dir):
    height = F.when(event() % 7 == 0, "").otherwise(F.format_string("%d.5", event() % 600))
    accuracy = F.when(event() % 5 == 0, "").otherwise(F.format_string("%d.25", event() % 9))
    whole = F.concat_ws(",", F.when(event() % 2 == 0, "Fix,GPS").otherwise("Fix,FLP"), degrees(17, 1), degrees(78, 7), height, F.lit("1.0"), accuracy, F.lit("0.0"), (F.lit(1773553223000) + event() * 400).cast("string"))
    line = F.when(event() % 13 == 0, "Fix,GPS,17.1").when(event() % 17 == 0, F.concat(F.lit("# "), whole)).otherwise(whole)
    return as_lines(events(spark, sf_dir), line)


FIX_SQL = f"""fixes AS (SELECT user_id, event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN 'GPS' ELSE 'FLP' END AS provider, {LAT} AS lat, {LON} AS lon,
  CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 600 + 0.5e0 END AS h, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 9 + 0.25e0 END AS acc, 1773553223000 + event_id * 400 AS ts_ms
  FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)"""


@query(f"WITH {FIX_SQL} SELECT * EXCLUDE user_id FROM fixes")
def logger_fixes(spark, sf_dir):
    """No height is 0; no accuracy is NaN, here -1."""
    rows = gnsslog.fixes(_fix_lines(spark, sf_dir))
    return rows.select("line_no", "provider", "lat", "lon", "h", F.when(F.isnan("acc"), -1.0).otherwise(F.col("acc")).alias("acc"), "ts_ms")


@query(f"WITH {FIX_SQL}, l AS (SELECT provider, max_by(struct_pack(line_no, acc), line_no) AS x FROM fixes WHERE acc >= 0 GROUP BY 1) SELECT min_by(provider, x.acc) AS provider, min_by(x.line_no, x.acc) AS line_no FROM l")
def best_last_fix(spark, sf_dir):
    """Of each provider's last fix the most accurate."""
    rows = gnsslog.fixes(_fix_lines(spark, sf_dir)).filter(~F.isnan("acc"))
    return gnsslog.best_last_location(rows).select("provider", "line_no")


@query("""SELECT event_id AS line_no, (ms // 1000 + CASE WHEN ms % 1000 > 500 OR (ms % 1000 = 500 AND (ms // 1000) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS sec, cn0, elev, event_id % 4 < 2 AS used
FROM (SELECT event_id, 1773553223000 + event_id * 250 AS ms, event_id % 50 + 0.5e0 AS cn0, (event_id % 90)::DOUBLE AS elev FROM events)""")
def logger_statuses(spark, sf_dir):
    """Half a second goes to the even one; four spellings of used."""
    used = F.element_at(F.array(*map(F.lit, ("1", " TRUE ", "0", "no"))), (event() % 4 + 1).cast("int"))
    line = F.concat_ws(",", F.lit("Status"), (F.lit(1773553223000) + event() * 250).cast("string"), F.lit("10,0,1,5,1575420000"), F.format_string("%d.5", event() % 50), F.lit("120.0"), F.format_string("%d", event() % 90), used)
    rows = gnsslog.statuses(as_lines(events(spark, sf_dir), line))
    return rows.select("line_no", "sec", "cn0", "elev", "used")


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_id % 50 ELSE event_id % 7 END::INT AS first_snr, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 2 END::INT AS n FROM events")
def source_priority(spark, sf_dir):
    """Satellites of one source, those of the other where it has none or an empty list."""
    status = F.when(event() % 3 == 0, F.array().cast("array<int>")).when(event() % 3 == 2, F.array((event() % 50).cast("int")))
    found = prefer(status, F.array((event() % 7).cast("int"), F.lit(9)))
    return events(spark, sf_dir).select("event_id", found.alias("s")).select("event_id", F.get("s", 0).alias("first_snr"), F.size("s").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE epoch_us(make_timestamp(2000 + event_id % 30, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, event_id % 50 + 0.25e0)) END AS us FROM events""")
def nmea_times(spark, sf_dir):
    """I4: time and date of sentences, -1 where either is malformed."""
    time = F.when(event() % 9 == 0, "99xx").otherwise(F.format_string("%02d%02d%02d.25", event() % 24, event() % 60, event() % 50))
    when = nmea_time(time, F.format_string("%02d%02d%02d", 1 + event() % 28, 1 + event() % 12, event() % 30))
    return events(spark, sf_dir).select("event_id", F.coalesce(micros_of(when), F.lit(-1)).alias("us"))


# --- solution files ------------------------------------------------------------------------------------------


@query(f"""SELECT *, (row_number() OVER (PARTITION BY track_id ORDER BY line_no) - 1)::BIGINT AS epoch FROM (
  SELECT user_id::VARCHAR AS track_id, event_id AS line_no, (315964800 + 2400 * 604800 + event_id * 3 % 604800 - 18) * 1000000 + 500000 AS us, {LAT} AS lat, {LON} AS lon, event_id % 600 + 0.5e0 AS height, (1 + event_id % 6)::INT AS q, (event_id % 12)::INT AS ns,
         CASE WHEN event_id % 4 = 0 THEN 999 ELSE event_id % 5 + 0.5e0 END AS sdn, CASE WHEN event_id % 4 = 0 THEN 999 ELSE event_id % 7 + 0.25e0 END AS sde
  FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0)""".replace("SELECT *, (", "SELECT * EXCLUDE line_no, (", 1))
def solutions_by_week(spark, sf_dir):
    """GPS week and second of week, comments and short rows, absent deviations."""
    head = F.concat_ws("  ", F.lit("2400"), F.format_string("%d.500", event() * 3 % 604800), degrees(17, 1), degrees(78, 7), F.format_string("%d.5", event() % 600), F.format_string("%d", 1 + event() % 6), F.format_string("%d", event() % 12))
    whole = F.when(event() % 4 == 0, head).otherwise(F.concat_ws(" ", head, F.format_string("%d.5", event() % 5), F.format_string("%d.25", event() % 7)))
    line = F.when(event() % 10 == 0, F.concat(F.lit("% "), whole)).when(event() % 11 == 0, "2400 1.0 17.0").otherwise(whole)
    rows = pos.solutions(as_lines(events(spark, sf_dir), line))
    return rows.select("track_id", "epoch", micros_of(F.col("ts")).alias("us"), "lat", "lon", "height", "q", "ns", "sdn", "sde")


def _calendar_lines(spark, sf_dir):
    parts = [F.lit("2026/03/15"), F.concat(clock(event() % 86400), F.lit(".500")), degrees(17, 1), degrees(78, 7), F.format_string("%d.5", event() % 600), F.format_string("%d", 1 + event() % 6), F.format_string("%d", event() % 12)]
    parts += [F.format_string("%d.25", event() % (3 + i)) for i in range(6)] + [F.lit("0.00"), F.format_string("%d.5", event() % 30)]
    return F.concat_ws(" ", *parts)


CALENDAR = [("sdn", 3), ("sde", 4), ("sdu", 5), ("sdne", 6), ("sdeu", 7), ("sdun", 8)]
CALENDAR_SQL = f"""calendar AS (SELECT event_id, {LAT} AS lat, {LON} AS lon, event_id % 600 + 0.5e0 AS height, (1 + event_id % 6)::INT AS q, (event_id % 12)::INT AS ns, {', '.join(f'event_id % {m} + 0.25e0 AS {c}' for c, m in CALENDAR)}, event_id % 30 + 0.5e0 AS ratio, event_id % 86400 AS s FROM events)"""


@query(f"WITH {CALENDAR_SQL} SELECT ({DAY} + s) * 1000000 + 500000 AS us, * EXCLUDE s, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS epoch FROM calendar JOIN (SELECT event_id, user_id FROM events) USING (event_id)".replace("EXCLUDE s", "EXCLUDE (s, event_id, user_id)"))
def solutions_by_calendar(spark, sf_dir):
    """Calendar times, all deviations and the ratio."""
    rows = pos.solutions(as_lines(events(spark, sf_dir), _calendar_lines(spark, sf_dir)))
    return rows.select("epoch", micros_of(F.col("ts")).alias("us"), "lat", "lon", "height", "q", "ns", *[c for c, _ in CALENDAR], "ratio")


@query(f"WITH {CALENDAR_SQL} SELECT q, count(*) AS count, CASE q WHEN 1 THEN 'FIX' WHEN 2 THEN 'FLOAT' WHEN 3 THEN 'SBAS' WHEN 4 THEN 'DGPS' WHEN 5 THEN 'SINGLE' WHEN 6 THEN 'PPP' ELSE '?' END AS label FROM calendar WHERE q <= 5 AND lat BETWEEN 17 AND 19 AND lon BETWEEN 77 AND 82 GROUP BY q")
def solution_file_quality(spark, sf_dir):
    """Codes of parsed solutions under the greatest code and inside the box."""
    rows = pos.solutions(as_lines(events(spark, sf_dir), _calendar_lines(spark, sf_dir)))
    return pos.quality_counts(rows.filter(pos.in_box() & (F.col("q") <= 5)))


@query(f"WITH {CALENDAR_SQL} SELECT strftime(make_timestamp(({DAY} + s) * 1000000), '%H:%M:%S') || '.500' AS time, lat, lon, height, q, ns, sdn, sdun, ratio FROM calendar")
def solutions_fixed_columns(spark, sf_dir):
    """Typed columns of written files with single spaces."""
    folder = work_folder(spark, "pos")
    lines = events(spark, sf_dir).select("event_id", _calendar_lines(spark, sf_dir).alias("value"))
    sinks.write_lines(lines, folder, ["event_id"])
    return pos.fixed_width(spark, folder).select("time", "lat", "lon", "height", "q", "ns", "sdn", "sdun", "ratio")


# --- observation files ---------------------------------------------------------------------------------------


def _rinex_lines(spark, sf_dir):
    """For each user a header of two lines and a block of three lines an event."""
    e = events(spark, sf_dir)
    head = F.array(F.lit("     3.03           OBSERVATION DATA    M                   RINEX VERSION / TYPE"), F.lit("                                                            END OF HEADER"))
    heads = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("file"), F.posexplode(head).alias("at", "line")).select("file", (F.col("at") - 9).cast("long").alias("line_no"), "line")
    s = event() % 86400
    epoch = F.format_string("> 2026 03 15 %02d %02d %02d.2500000  0  2", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))
    body = F.array(epoch, F.format_string("G%02d  20000000.000", 1 + event() % 32), F.format_string("%s%02d  21000000.000", F.when(event() % 2 == 0, "R").otherwise("S"), 1 + event() % 24))
    blocks = e.select(F.col("user_id").cast("string").alias("file"), "event_id", F.posexplode(body).alias("at", "line")).select("file", (event() * 3 + F.col("at")).alias("line_no"), "line")
    return heads.unionByName(blocks)


@query(f"""SELECT user_id::VARCHAR AS file, event_id * 3 + j AS line_no, false AS is_header, row_number() OVER (PARTITION BY user_id, j ORDER BY event_id)::BIGINT AS block_id, ({DAY} + event_id % 86400) * 1000000 + 250000 AS us FROM events, (SELECT range AS j FROM range(3))
UNION ALL SELECT user_id::VARCHAR, j - 9, true, 0, -1 FROM (SELECT DISTINCT user_id FROM events), (SELECT range AS j FROM range(2))""")
def rinex_blocks(spark, sf_dir):
    """Header lines, epochs and their blocks."""
    rows = rinex.blocks(_rinex_lines(spark, sf_dir))
    return rows.select("file", "line_no", "is_header", F.coalesce(F.when(F.col("is_header"), F.lit(0)).otherwise(F.col("block_id")), F.lit(0)).cast("long").alias("block_id"), F.coalesce(micros_of(F.col("epoch")), F.lit(-1)).alias("us"))


@query(f"""SELECT user_id::VARCHAR AS file, (2 + 3 * count(*) FILTER (WHERE event_id % 86400 % 5 <> 0))::BIGINT AS n, coalesce(max(event_id * 3 + 2) FILTER (WHERE event_id % 86400 % 5 <> 0), -8) AS last_line FROM events GROUP BY user_id""")
def rinex_kept_blocks(spark, sf_dir):
    """The header and the blocks whose second is not dropped."""
    e = events(spark, sf_dir)
    dropped = e.filter(event() % 86400 % 5 == 0).select((F.lit(DAY) + event() % 86400).alias("sec"))
    kept = rinex.kept_lines(rinex.blocks(_rinex_lines(spark, sf_dir)), dropped)
    # header lines have no second: an anti-join keeps them
    return kept.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("last_line"))


@query("""SELECT sat, count(*) AS n, min(line_no) AS first_line FROM (
  SELECT 'G' || lpad((1 + event_id % 32)::VARCHAR, 2, '0') AS sat, event_id * 3 + 1 AS line_no FROM events UNION ALL SELECT 'R' || lpad((1 + event_id % 24)::VARCHAR, 2, '0'), event_id * 3 + 2 FROM events WHERE event_id % 2 = 0) GROUP BY sat""")
def rinex_satellites(spark, sf_dir):
    """Lines of each satellite of the known systems."""
    return rinex.satellite_counts(rinex.blocks(_rinex_lines(spark, sf_dir)))


# --- tables --------------------------------------------------------------------------------------------------


def _cleaned(spark, sf_dir):
    return track(spark, sf_dir).select(event().alias("epoch"), "lat", "lon", "height", "q")


CLEANED_SQL = f"WITH {TRACK_SQL} SELECT event_id AS epoch, printf('%.8f', lat) AS lat, printf('%.8f', lon) AS lon, printf('%.3f', height) AS height, q AS \"Q\" FROM track"


@query(f"SELECT epoch, lat::DOUBLE AS lat, lon::DOUBLE AS lon, height::DOUBLE AS height, \"Q\" FROM ({CLEANED_SQL})")
def csv_typed(spark, sf_dir):
    """Cleaned rows written and read by their schema."""
    return tables.csv_table(spark, written(sinks.cleaned_rows(_cleaned(spark, sf_dir)), "cleaned"), schemas.CLEANED_CSV)


@query(f"SELECT epoch::VARCHAR AS epoch, lat, lon, height, \"Q\"::VARCHAR AS \"Q\" FROM ({CLEANED_SQL})")
def csv_as_strings(spark, sf_dir):
    """Every column as text."""
    return tables.csv_strings(spark, written(sinks.cleaned_rows(_cleaned(spark, sf_dir)), "cleaned"))


@query(f"SELECT event_id AS line_no, {LAT} AS lat, {LON} AS lon FROM events WHERE event_id > 0 AND event_id % 6 <> 0")
def csv_by_place(spark, sf_dir):
    """The header and rows under three fields go."""
    line = F.when(event() % 6 == 0, "1,17.0").otherwise(F.concat_ws(",", F.lit("p"), degrees(17, 1), degrees(78, 7), F.lit("x")))
    return tables.positional_points(as_lines(events(spark, sf_dir), line)).select("line_no", "lat", "lon")


@query(f"SELECT {LAT} AS lat, {LON} AS lon, strftime(make_timestamp((1773553223 + event_id) * 1000000), '%H-%M-%S') AS time, (1773553223 + event_id) * 1000 AS milli, 0.0e0 AS x, 10.0e0 AS v, 'log' AS file, 'tar' AS \"Surface\", 'good' AS \"Condition\" FROM events")
def json_points(spark, sf_dir):
    """An array of point objects for each user, long ones in several, written and read back."""
    e = events(spark, sf_dir).select("user_id", degrees(17, 1).cast("double").alias("lat"), degrees(78, 7).cast("double").alias("lon"), ((F.lit(1773553223) + event()) * 1000).alias("ts_ms"))
    arrays = sinks.json_array(sinks.ui_rows(e, "tar", "good", "log", ("user_id",)), ["milli", "lat", "lon"], ("user_id",), POINTS_A_LINE)
    folder = work_folder(spark, "ui")
    arrays.select(F.col("json").alias("value")).write.text(folder)
    return tables.ui_points(spark, folder, one_array_a_file=False).select("lat", "lon", "time", "milli", "x", "v", "file", "Surface", "Condition")


@query("SELECT 'ACCX' AS channel, user_id::VARCHAR AS session, event_id AS seq, '1.0' AS key0, (1773553223000 + event_id * 400)::VARCHAR AS time, value FROM events WHERE event_id % 8 <> 0")
def channel_files(spark, sf_dir):
    """``1.0,<ms>,<value>`` lines of files named by channel and session; rows without a number go."""
    e = events(spark, sf_dir).withColumn("ts_ms", F.lit(1773553223000) + event() * 400).withColumn("reading", F.when(event() % 8 == 0, "x").otherwise(F.col("value").cast("string")))
    lines = sinks.legacy_lines(e.select("ts_ms", "reading", "event_id", "user_id"), "reading").select(((F.col("ts_ms") - 1773553223000) / 400).cast("long").alias("event_id"), "value")
    named = lines.join(e.select("event_id", "user_id"), "event_id")
    rows = tables.channel_rows(as_lines(named, F.col("value"), F.concat(F.lit("file:/log/ANDACCX"), F.col("user_id").cast("string"), F.lit(".csv"))))
    return rows.select("channel", "session", "seq", "key0", "time", "value")


@query("SELECT event_id::DOUBLE AS t, value AS x, -value AS y, (event_id % 9)::DOUBLE AS z, (event_id % 360)::DOUBLE AS azimuth, (event_id % 5)::INT AS image_no FROM events")
def merged_sensor_text(spark, sf_dir):
    """Eleven numbers a line, in order of time."""
    value = F.col("value")
    e = events(spark, sf_dir).select(event().cast("double").alias("t"), value.alias("x"), (-value).alias("y"), (event() % 9).cast("double").alias("z"), F.lit(17.5).alias("lat"), F.lit(78.5).alias("lon"), F.lit(3.0).alias("speed"), (event() % 360).cast("double").alias("azimuth"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("roll"), (event() % 5).cast("int").alias("image_no"))
    folder = work_folder(spark, "merged")
    sinks.write_lines(sinks.merged_lines(e), folder, ["t"])
    return tables.merged_sensor_rows(spark, folder).select("t", "x", "y", "z", "azimuth", "image_no")


@query("SELECT ((event_id % 40) / 4.0e0)::FLOAT::DOUBLE AS rmsd_y, (event_id % 7)::DOUBLE AS speed, (event_id % 4)::INT AS class, count(*) AS n FROM events GROUP BY ALL")
def training_text(spark, sf_dir):
    """Samples appended in two sessions, read as one training set."""
    rows = events(spark, sf_dir).select("event_id", F.concat_ws(" ", F.format_string("%.2f", (event() % 40) / 4.0), F.lit("0.5"), F.lit("0.25"), F.format_string("%d.0", event() % 7), F.format_string("%d", event() % 4)).alias("value"))
    folder = work_folder(spark, "training")
    for half in (0, 1):
        sinks.write_lines(rows.filter(event() % 2 == half), folder, ["event_id"], mode="append")
    found = tables.training_rows(spark, folder)
    return found.groupBy(F.col("rmsd_y").cast("double").alias("rmsd_y"), F.col("speed").cast("double").alias("speed"), "class").agg(F.count("*").alias("n"))


@query("SELECT user_id, 'hist' || user_id AS key, 1::INT AS rows, 10::INT AS cols, sum(event_id % 10)::DOUBLE AS total FROM events, (SELECT 1) GROUP BY user_id")
def yaml_matrices(spark, sf_dir):
    """A histogram matrix for each user as YAML text."""
    bins = events(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(event() % 10 == i).alias(f"b{i}") for i in range(10)])
    data = F.concat_ws(", ", *[F.format_string("%d.", F.col(f"b{i}")) for i in range(10)])
    text = F.concat(F.lit("%YAML:1.0\nhist"), F.col("user_id").cast("string"), F.lit(": !!opencv-matrix\n   rows: 1\n   cols: 10\n   dt: f\n   data: [ "), data, F.lit(" ]\n"))
    found = tables.matrices(bins.select("user_id", text.alias("value")))
    total = F.aggregate(F.transform("data", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return found.select("user_id", "key", "rows", "cols", total.alias("total"))


@query("SELECT length(t)::BIGINT AS size, md5(t) AS md5, array_to_string(string_split(t, chr(10))[1:14], chr(10)) AS head, length(t)::BIGINT AS listed, length(t)::BIGINT AS image_bytes, 0::INT AS image_no, 1::INT AS number FROM (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS t FROM nation)")
def file_sources(spark, sf_dir):
    """Digest, size and first lines of a written file, its listing, its number."""
    folder = work_folder(spark, "files")
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition(1)  # 25 rows at every scale
    names.sortWithinPartitions("n_nationkey").select("value").write.text(folder)
    digests, listed, images = tables.file_digests(spark, folder), tables.listing(spark, folder, "part-", ".txt"), tables.images(spark, folder)
    out = digests.join(tables.renumbered(listed).select("file", F.col("length").alias("listed"), "number"), "file")
    return out.crossJoin(F.broadcast(images.select("image_no", F.octet_length("content").cast("long").alias("image_bytes")).limit(1))).select("size", "md5", "head", "listed", "image_bytes", "image_no", "number")


@query("SELECT event_id::INT AS _id, value AS x, CASE WHEN event_id % 6 = 0 THEN -1 ELSE (event_id % 90)::DOUBLE END AS speed, 'f' || event_id % 3 AS file FROM events")
def sensor_rows(spark, sf_dir):
    """The capture app's rows are texts; what is no number is null, here -1."""
    text = lambda c: c.cast("string")
    e = events(spark, sf_dir).select(event().cast("int").alias("_id"), text(F.col("value")).alias("x"), F.lit("0").alias("y"), F.lit("0").alias("z"), F.when(event() % 6 == 0, "n/a").otherwise(text(event() % 90)).alias("speed"), F.lit("17.5").alias("latitude"), F.lit("78.5").alias("longitude"), F.lit("t").alias("time"), F.lit("u").alias("location"), F.format_string("f%d", event() % 3).alias("file"))
    folder = work_folder(spark, "sensor")
    sinks.append_rows(e, folder)
    return tables.sensor_table(spark, folder).select("_id", "x", F.coalesce("speed", F.lit(-1.0)).alias("speed"), "file")


@query(f"""WITH p AS (SELECT *, coalesce(sum((event_id % 10 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS way_id, sum((event_id % 10 = 0)::INT) OVER (PARTITION BY user_id) AS ways, {LAT} AS lat, {LON} AS lon FROM events)
SELECT * FROM (SELECT user_id::VARCHAR AS file, way_id, (row_number() OVER w - 1)::INT AS seg_no, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WHERE event_id % 10 <> 0 AND way_id < ways WINDOW w AS (PARTITION BY user_id, way_id ORDER BY event_id)) WHERE lat2 IS NOT NULL""")
def way_segments(spark, sf_dir):
    """Ways that a number ends; one that isn't ended is lost."""
    line = F.when(event() % 10 == 0, "999.99 999.99").otherwise(F.concat_ws(" ", degrees(17, 1), degrees(78, 7)))
    return roads.way_segments(as_lines(events(spark, sf_dir), line))


@query("SELECT a.s_suppkey AS u, a.s_suppkey + 1 AS v, CASE WHEN a.s_suppkey % 2 = 0 THEN 'primary' ELSE 'residential' END AS highway, a.s_suppkey % 3 = 0 AS oneway, 17 + (a.s_suppkey % 100) / 100.0e0 AS lat1 FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def road_edges(spark, sf_dir):
    """Edges of a written map file, with their road class and direction."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    tag = lambda name, value: F.struct(F.lit(name).alias("_k"), value.alias("_v"))
    nodes = s.select(k.alias("_id"), (F.lit(17.0) + (k % 100) / 100.0).alias("_lat"), F.lit(78.5).alias("_lon"))
    ends = F.array(F.struct(k.alias("_ref")), F.struct((k + 1).alias("_ref")))
    ways = s.select(k.alias("_id"), ends.alias("nd"), F.array(tag("highway", F.when(k % 2 == 0, "primary").otherwise("residential")), tag("oneway", F.when(k % 3 == 0, "yes").otherwise("no"))).alias("tag"))
    folder = work_folder(spark, "map")
    for name, rows in (("node", nodes), ("way", ways)):
        rows.write.mode("append").format("xml").options(rootTag="osm", rowTag=name).save(folder)
    found = roads.edges_of_osm(spark, folder)
    return found.select("u", "v", "highway", "oneway", F.get("coords", 0)["y"].alias("lat1"))


# --- sinks, read back ----------------------------------------------------------------------------------------


@query(f"WITH {TRACK_SQL} SELECT lat, lon, us // 1000 AS timestamp, round(value / 50.0e0, 6) AS hdop, ns AS sats FROM track")
def sink_gated(spark, sf_dir):
    """B1."""
    t = track(spark, sf_dir).select("lat", "lon", F.floor(F.col("us") / 1000).cast("long").alias("ts_ms"), (F.col("value") / 50.0).alias("hdop"), F.col("ns").alias("sats"))
    back = tables.csv_table(spark, written(sinks.gated_rows(t), "gated"), schemas.GATED_CSV)
    return back.select("lat", "lon", "timestamp", r6("hdop"), "sats")


@query(f"WITH {TRACK_SQL} SELECT strftime(make_timestamp((1773553223000 + event_id * 400) * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS utc, printf('%.10f', lat)::DOUBLE AS lat, printf('%.10f', lon)::DOUBLE AS lon, printf('%.3f', height)::DOUBLE AS height FROM track")
def sink_fixes(spark, sf_dir):
    """B4."""
    t = track(spark, sf_dir).select((F.lit(1773553223000) + event() * 400).alias("ts_ms"), "lat", "lon", F.col("height").alias("h"))
    return tables.csv_table(spark, written(sinks.fix_rows(t), "fixes"), schemas.FIXES_CSV)


@query(f"WITH {TRACK_SQL} SELECT strftime(make_timestamp(us), '%Y/%m/%d') AS date, strftime(make_timestamp(us), '%H:%M:%S.%g') AS time, printf('%.8f', lat)::DOUBLE AS lat_raw, printf('%.8f', lon)::DOUBLE AS lon_raw, printf('%.8f', lat + 0.5e0)::DOUBLE AS lat_smoothed, printf('%.8f', lon)::DOUBLE AS lon_smoothed, printf('%.3f', height)::DOUBLE AS height_m, printf('%.3f', sdn)::DOUBLE AS sdn_m, printf('%.3f', sde)::DOUBLE AS sde_m, (event_id % 2)::INT AS interpolated FROM track")
def sink_smoothed(spark, sf_dir):
    """B6."""
    t = track(spark, sf_dir).select(F.timestamp_micros("us").alias("ts"), "lat", "lon", (F.col("lat") + 0.5).alias("lat_s"), F.col("lon").alias("lon_s"), "height", "sdn", "sde", (event() % 2 == 1).alias("interpolated"))
    return tables.csv_table(spark, written(sinks.smoothed_rows(t), "smoothed"), schemas.SMOOTHED_CSV)


@query(f"WITH {TRACK_SQL} SELECT lat, lon, value AS particle_confidence, event_id AS epoch FROM track")
def sink_particles(spark, sf_dir):
    """B7."""
    t = track(spark, sf_dir).select("lat", "lon", F.col("value").alias("confidence"), event().alias("epoch"))
    return tables.csv_table(spark, written(sinks.particle_rows(t), "particles"), schemas.PARTICLE_CSV)


@query(f"WITH {TRACK_SQL} SELECT lat AS latitude, lon AS longitude, height AS elevation_m, q AS quality_code, sdn AS horiz_acc_n, sde AS horiz_acc_e FROM track")
def sink_exported(spark, sf_dir):
    """Renamed columns."""
    t = track(spark, sf_dir).select(F.timestamp_micros("us").alias("ts"), "lat", "lon", "height", "q", "sdn", "sde")
    schema = "timestamp STRING, latitude DOUBLE, longitude DOUBLE, elevation_m DOUBLE, quality_code INT, quality_type STRING, horiz_acc_n DOUBLE, horiz_acc_e DOUBLE"
    return tables.csv_table(spark, written(sinks.exported_rows(t), "exported"), schema).drop("timestamp", "quality_type")


@query("SELECT event_type || ': n=' || count(*) || ' mean=' || printf('%.3f', avg(event_id % 8)) || ' median=1.000 p95=2.000 max=' || printf('%.3f', max(event_id % 8)::DOUBLE) AS line FROM events GROUP BY event_type")
def sink_metrics(spark, sf_dir):
    """A line of text for each method."""
    stats = events(spark, sf_dir).groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.avg(event() % 8).alias("mean_step"), F.max(event() % 8).cast("double").alias("max_step"))
    folder = work_folder(spark, "metrics")
    sinks.write_lines(sinks.metrics_text(stats.withColumn("median_step", F.lit(1.0)).withColumn("p95_step", F.lit(2.0))), folder, ["method"])
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(f"""SELECT '<node id="' || (event_id + 1) || '" lat="' || printf('%.6f', {LAT}) || '" lon="' || printf('%.6f', {LON}) || '"><tag k="amenity" v="' || CASE event_id % 5 WHEN 0 THEN 'place_of_worship' WHEN 1 THEN 'bank' WHEN 2 THEN 'fast_food' ELSE 'none' END || '"/></node>' AS line FROM events""")
def sink_overlay(spark, sf_dir):
    """Map nodes, appended in two sessions."""
    points = events(spark, sf_dir).select("event_id", degrees(17, 1).cast("double").alias("lat"), degrees(78, 7).cast("double").alias("lon"), (event() % 5).alias("class"))
    folder = work_folder(spark, "overlay")
    for half in (0, 1):
        sinks.write_lines(sinks.overlay_nodes(points.filter(event() % 2 == half), event()), folder, ["id"], mode="append")
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(f"SELECT {LAT} AS lat, {LON} AS lon, 'c' || event_id % 4 AS label, value AS rmsd_x FROM events")
def sink_results(spark, sf_dir):
    """Results without a header, appended."""
    rows = events(spark, sf_dir).select("event_id", degrees(17, 1).cast("double").alias("lat"), degrees(78, 7).cast("double").alias("lon"), F.format_string("c%d", event() % 4).alias("label"), F.col("value").alias("rmsd_x"))
    folder = work_folder(spark, "results")
    for half in (0, 1):
        sinks.write_csv(sinks.result_rows(rows.filter(event() % 2 == half)), folder, header=False, mode="append")
    return spark.read.schema("lat DOUBLE, lon DOUBLE, label STRING, rmsd_x DOUBLE").csv(folder)


# --- live predicate ------------------------------------------------------------------------------------------


@query(f"""WITH {TRACK_SQL}, s AS (SELECT user_id, us, event_id, event_type, value / 4.0e0 AS speed, event_id % 3 AS lat, event_id % 2 AS lon FROM track),
n AS (SELECT *, lag(lat) OVER w IS NOT DISTINCT FROM lat AND lag(lon) OVER w IS NOT DISTINCT FROM lon AS same FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, speed FROM n WHERE NOT same AND speed > 5 AND event_type <> 'view'""")
def classify_predicate(spark, sf_dir):
    """A new position, at speed, while classification is on."""
    t = track(spark, sf_dir).select("user_id", "us", "event_id", "event_type", (F.col("value") / 4.0).alias("speed"), (event() % 3).alias("lat"), (event() % 2).alias("lon"))
    return classify_now(t, BY, ORDER, F.col("event_type") != "view").select("event_id", "speed")
