"""Queries of parsers, epochs and gates on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions import text as T
from trajspark.functions.geo import haversine, haversine_atan, local_latlon, local_xy, plane_latlon, plane_xy, rotate
from trajspark.functions.timeconv import day_fraction, gps_to_unix, rounded_second
from trajspark.operators import quality as Q
from trajspark.plans.driver_views import EPOCHS_SQL, TRACK_SQL, epochs, hav_sql, table, track
from trajspark.plans.registry import query, r6
from trajspark.sources import nmea
from trajspark.sources.pos import in_box, quality_counts


def _nmea_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fix sentence for each event, as a log would hold it."""
    e = table(spark, sf_dir, "events")
    lat = F.format_string("17%02d.%04d", F.col("event_id") % 60, (F.col("event_id") * 37) % 10000)
    lon = F.format_string("078%02d.%04d", F.col("event_id") % 59, (F.col("event_id") * 53) % 10000)
    sentence = F.format_string("NMEA,$GPGGA,054023.00,%s,N,%s,%s,%d,08,%.1f,550.0,M,-70.0,M,,*5A,%d", lat, lon, F.when(F.col("event_id") % 5 == 0, "W").otherwise("E"), F.col("event_id") % 6, (F.col("event_id") % 30) / 10.0, 1773553223000 + F.col("event_id") * 400)
    bad = F.when(F.col("event_id") % 11 == 0, F.concat(sentence, F.lit("x"))).otherwise(sentence)
    return e.select(F.lit("log").alias("file"), F.col("event_id").alias("line_no"), F.explode(F.array(bad)).alias("line"))  # made once, as if read


NMEA_SQL = """nmea AS (
  SELECT event_id AS line_no, 1773553223000 + event_id * 400 AS ts_ms, (1773553223000 + event_id * 400) // 1000 AS sec,
         17 + (event_id % 60 + ((event_id * 37) % 10000) / 10000.0e0) / 60 AS lat,
         (CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END) * (78 + (event_id % 59 + ((event_id * 53) % 10000) / 10000.0e0) / 60) AS lon,
         (event_id % 6)::INT AS q, round((event_id % 30) / 10.0e0, 1) AS hdop
  FROM events WHERE event_id % 11 <> 0)"""


@query(f"WITH {NMEA_SQL} SELECT line_no, ts_ms, sec, round(lat, 6) AS lat, round(lon, 6) AS lon, q, hdop FROM nmea")
def nmea_parse(spark, sf_dir):
    """A1, A2, A4, I3, I21, I22."""
    fixes = nmea.gga(nmea.sentences(_nmea_lines(spark, sf_dir)))
    return fixes.select("line_no", "ts_ms", "sec", r6("lat"), r6("lon"), "q", "hdop")


@query(f"WITH {NMEA_SQL} SELECT sec, line_no, q, round(lat, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY q DESC, line_no) AS k FROM nmea WHERE q >= 1 AND lat BETWEEN 17 AND 19 AND lon BETWEEN 77 AND 82) WHERE k = 1")
def nmea_best_fix_pipeline(spark, sf_dir):
    """Scan, box, quality and best fix of each second in one plan."""
    fixes = nmea.gga(nmea.sentences(_nmea_lines(spark, sf_dir))).filter(in_box() & (F.col("q") >= 1))
    return Q.best_fix(fixes, ["sec"], ["line_no"]).select("sec", "line_no", "q", r6("lat"))


@query(f"WITH {NMEA_SQL} SELECT ts_ms, max_by(line_no, line_no) AS line_no, max_by(q, line_no) AS q FROM nmea GROUP BY ts_ms")
def nmea_exact_ms_last(spark, sf_dir):
    """A3."""
    fixes = nmea.gga(nmea.sentences(_nmea_lines(spark, sf_dir)))
    return fixes.groupBy("ts_ms").agg(F.max("line_no").alias("line_no"), F.max_by("q", "line_no").alias("q"))


@query("""SELECT event_id, prn, elev, snr, 'G' || prn AS svid FROM (
  SELECT event_id, unnest([printf('%02d', event_id % 32 + 1), printf('%02d', event_id % 31 + 33)]) AS prn,
         unnest([(event_id % 90)::DOUBLE, (event_id % 45)::DOUBLE]) AS elev, unnest([(event_id % 50)::DOUBLE, NULL]) AS snr FROM events)""")
def nmea_satellites(spark, sf_dir):
    """Groups of four, an empty strength, a trailing signal id."""
    e = table(spark, sf_dir, "events")
    line = F.format_string("$GPGSV,1,1,02,%02d,%d,120,%d,%02d,%d,200,,1*7F", F.col("event_id") % 32 + 1, F.col("event_id") % 90, F.col("event_id") % 50, F.col("event_id") % 31 + 33, F.col("event_id") % 45)
    lines = e.select(F.lit("log").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return nmea.gsv(nmea.sentences(lines)).select(F.col("line_no").alias("event_id"), "prn", "elev", "snr", "svid")


@query("SELECT event_id, (event_id % 40) / 10.0e0 AS pdop, (event_id % 20) / 10.0e0 AS hdop, (event_id % 30) / 10.0e0 AS vdop, 2::INT AS n_used FROM events")
def nmea_dilutions(spark, sf_dir):
    """Dilutions by place, with a system id after them."""
    e = table(spark, sf_dir, "events")
    line = F.format_string("$GNGSA,A,3,05,07,,,,,,,,,,,%.1f,%.1f,%.1f,1*2E", (F.col("event_id") % 40) / 10.0, (F.col("event_id") % 20) / 10.0, (F.col("event_id") % 30) / 10.0)
    lines = e.select(F.lit("log").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return nmea.gsa(nmea.sentences(lines)).select(F.col("line_no").alias("event_id"), "pdop", "hdop", "vdop", F.size("used").alias("n_used"))


@query("""SELECT event_id, round(floor(x / 100) + (x - 100 * floor(x / 100)) / 60, 6) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS degrees
FROM (SELECT event_id, 1700 + (event_id % 6000) / 100.0e0 AS x FROM events)""")
def nmea_coord_to_degrees(spark, sf_dir):
    """I3."""
    e = table(spark, sf_dir, "events")
    x = F.format_string("%.2f", 1700 + (F.col("event_id") % 6000) / 100.0)
    return e.select("event_id", r6(T.nmea_degrees(x, F.when(F.col("event_id") % 2 == 0, "s").otherwise("N")), "degrees"))


@query(f"WITH {TRACK_SQL} SELECT event_id, user_id FROM track WHERE lat BETWEEN 17.2 AND 17.8 AND lon BETWEEN 78.1 AND 78.5")
def bbox_filter(spark, sf_dir):
    """C4."""
    return track(spark, sf_dir).filter(in_box(box=(17.2, 17.8, 78.1, 78.5))).select("event_id", "user_id")


@query(f"WITH {EPOCHS_SQL} SELECT user_id, sec, event_id, q FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sec // 60 ORDER BY q DESC, event_id) AS k FROM epochs) WHERE k = 1")
def epoch_best_fix(spark, sf_dir):
    """E1."""
    e = epochs(spark, sf_dir).withColumn("hour", F.expr("sec div 60"))
    return Q.best_fix(e, ["user_id", "hour"], ["event_id"]).select("user_id", "sec", "event_id", "q")


@query(f"WITH {EPOCHS_SQL} SELECT user_id, sec // 1440 AS day, max_by(hdop, event_id) AS hdop, min_by(pdop, event_id) AS pdop FROM epochs GROUP BY ALL")
def epoch_first_last(spark, sf_dir):
    """E2."""
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    return Q.last_and_first(e, ["user_id", "day"], "event_id", ["hdop"], ["pdop"])


@query(f"WITH {EPOCHS_SQL} SELECT user_id, sec // 1440 AS day, string_agg(printf('%.2f', snr), ',' ORDER BY event_id) AS snrs FROM epochs WHERE snr > 0 GROUP BY ALL")
def epoch_snr_lists(spark, sf_dir):
    """E3."""
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    return Q.snr_lists(e, ["user_id", "day"]).select("user_id", "day", F.array_join(F.transform("snrs", lambda x: F.format_string("%.2f", x)), ",").alias("snrs"))


@query(f"WITH {EPOCHS_SQL} SELECT user_id, sec // 1440 AS day, count(*) FILTER (WHERE snr >= 25) AS good_simple, count(*) FILTER (WHERE snr >= 30 AND elev >= 15) AS good_strict, count(*) FILTER (WHERE snr >= 28 AND elev >= 10 AND used IS DISTINCT FROM false) AS good_lenient FROM epochs GROUP BY ALL")
def epoch_snr_counts(spark, sf_dir):
    """E4."""
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    good = lambda g: F.count_if(Q.good_satellite(g, F.col("snr"), F.col("elev"), F.col("used"))).cast("long")
    return e.groupBy("user_id", "day").agg(good(Q.SIMPLE).alias("good_simple"), good(Q.STRICT).alias("good_strict"), good(Q.LENIENT).alias("good_lenient"))


def _gated(spark, sf_dir, gate):
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    good = F.count_if(Q.good_satellite(gate, F.col("snr"), F.col("elev"), F.col("used")))
    days = e.groupBy("user_id", "day").agg(good.alias("good_sats"), F.min("hdop").alias("hdop"), F.max(F.when(F.col("event_id") % 4 != 0, F.col("pdop"))).alias("pdop"))
    return days.withColumn("ok", Q.passes(gate, F.col("good_sats"), F.col("hdop"), F.col("pdop"))).select("user_id", "day", "ok")


def _gate_sql(good: str, ok: str) -> str:
    return f"""WITH {EPOCHS_SQL}, days AS (SELECT user_id, sec // 1440 AS day, count(*) FILTER (WHERE {good}) AS good_sats, min(hdop) AS hdop,
      max(pdop) FILTER (WHERE event_id % 4 <> 0) AS pdop FROM epochs GROUP BY ALL) SELECT user_id, day, ({ok}) AS ok FROM days"""


@query(_gate_sql("snr >= 25", "good_sats >= 4 AND hdop <= 2"))
def epoch_gate_simple(spark, sf_dir):
    """C6."""
    return _gated(spark, sf_dir, Q.SIMPLE)


@query(_gate_sql("snr >= 25", "good_sats >= 6 AND hdop <= 1.5"))
def epoch_gate_tight(spark, sf_dir):
    """C6."""
    return _gated(spark, sf_dir, Q.SIMPLE_TIGHT)


@query(_gate_sql("snr >= 30 AND elev >= 15", "good_sats >= 5 AND (hdop IS NULL OR hdop <= 2) AND (pdop IS NULL OR pdop <= 4)"))
def epoch_gate_strict(spark, sf_dir):
    """C7."""
    return _gated(spark, sf_dir, Q.STRICT)


@query(_gate_sql("snr >= 28 AND elev >= 10 AND used IS DISTINCT FROM false", "good_sats >= 6 AND (hdop IS NULL OR hdop <= 5) AND (pdop IS NULL OR pdop <= 10)"))
def epoch_gate_lenient(spark, sf_dir):
    """C8."""
    return _gated(spark, sf_dir, Q.LENIENT)


@query(f"""WITH {EPOCHS_SQL}, l AS (SELECT DISTINCT user_id, sec // 60 AS s FROM epochs WHERE event_id % 2 = 0),
r AS (SELECT user_id, sec // 60 AS s, max(snr) AS snr FROM epochs WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT l.user_id, l.s, coalesce(a.snr, b.snr, c.snr) AS snr FROM l LEFT JOIN r a ON a.user_id = l.user_id AND a.s = l.s
LEFT JOIN r b ON b.user_id = l.user_id AND b.s = l.s - 1 LEFT JOIN r c ON c.user_id = l.user_id AND c.s = l.s + 1""")
def snr_fallback_join(spark, sf_dir):
    """D3."""
    e = epochs(spark, sf_dir).withColumn("s", F.expr("sec div 60"))
    left = e.filter("event_id % 2 = 0").select("user_id", "s").distinct()
    right = e.filter("event_id % 2 = 1").groupBy("user_id", "s").agg(F.max("snr").alias("snr"))
    return Q.fallback_join(left, right, ["user_id"], "s", "snr").select("user_id", "s", "snr")


@query(f"""WITH {EPOCHS_SQL}, a AS (SELECT user_id, sec // 1440 AS day, count(*) AS sats FROM epochs WHERE event_id % 3 = 0 GROUP BY ALL),
b AS (SELECT user_id, sec // 1440 AS day, min(hdop) AS hdop FROM epochs WHERE event_id % 3 = 1 GROUP BY ALL), c AS (SELECT user_id, sec // 1440 AS day, max(q) AS q FROM epochs WHERE event_id % 3 = 2 GROUP BY ALL)
SELECT user_id, day, coalesce(sats, -1) AS sats, coalesce(hdop, -1) AS hdop, coalesce(q, -1) AS q, (sats IS NOT NULL) AS has_gsv, (hdop IS NOT NULL) AS has_dop, (q IS NOT NULL) AS has_gga FROM a FULL JOIN b USING (user_id, day) FULL JOIN c USING (user_id, day)""")
def full_outer_epoch_merge(spark, sf_dir):
    """D2, H1, C28."""
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    part = lambda i, agg: e.filter(F.col("event_id") % 3 == i).groupBy("user_id", "day").agg(agg)
    merged = Q.merge_epochs({"gsv": part(0, F.count("*").alias("sats")), "dop": part(1, F.min("hdop").alias("hdop")), "gga": part(2, F.max("q").alias("q"))}, ["user_id", "day"])
    return merged.fillna(-1, subset=["sats", "hdop", "q"])


@query(f"""WITH {EPOCHS_SQL}, quality AS (SELECT user_id, sec // 1440 AS day, min(hdop) <= 0.3 AS ok FROM epochs WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT e.event_id FROM epochs e LEFT JOIN quality t ON t.user_id = e.user_id AND t.day = e.sec // 1440 WHERE t.ok IS NULL OR t.ok""")
def quality_left_lookup(spark, sf_dir):
    """D1."""
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    quality = e.filter("event_id % 3 = 0").groupBy("user_id", "day").agg((F.min("hdop") <= 0.3).alias("ok"))
    return Q.lookup_keep(e, quality, ["user_id", "day"]).select("event_id")


@query(f"""WITH {EPOCHS_SQL} SELECT event_id, user_id FROM epochs e WHERE NOT EXISTS (SELECT 1 FROM epochs b WHERE b.user_id = e.user_id AND b.sec // 1440 = e.sec // 1440 AND b.hdop > 4)""")
def drop_epoch_anti_join(spark, sf_dir):
    """D6, H3."""
    e = epochs(spark, sf_dir).withColumn("day", F.expr("sec div 1440"))
    return Q.without_seconds(e, e.filter("hdop > 4"), ["user_id", "day"]).select("event_id", "user_id")


@query(f"""WITH {EPOCHS_SQL}, u AS (SELECT user_id, sec // 1440 AS day, list(DISTINCT event_id % 8) AS s FROM epochs WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT e.event_id, coalesce(list_contains(u.s, e.event_id % 8)::VARCHAR, 'unknown') AS used FROM epochs e LEFT JOIN u ON u.user_id = e.user_id AND u.day = e.sec // 1440""")
def used_prn_semi_mark(spark, sf_dir):
    """D7, E5, H4."""
    e = epochs(spark, sf_dir).drop("used").withColumn("day", F.expr("sec div 1440")).withColumn("prn", F.col("event_id") % 8)
    used = Q.used_sets(e.filter("event_id % 3 = 0").select("user_id", "day", F.array("prn").alias("used")), ["user_id", "day"])
    return Q.mark_used(e, used, ["user_id", "day"]).select("event_id", F.coalesce(F.col("used").cast("string"), F.lit("unknown")).alias("used"))


@query(f"WITH {EPOCHS_SQL} SELECT user_id, round(100.0e0 * count(*) FILTER (WHERE hdop <= 1) / greatest(1, count(*)), 6) AS pass_ratio FROM epochs GROUP BY user_id")
def pass_ratio(spark, sf_dir):
    """E18."""
    return epochs(spark, sf_dir).groupBy("user_id").agg(r6(Q.pass_ratio(F.col("hdop") <= 1), "pass_ratio"))


@query(f"""WITH {TRACK_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT (lat BETWEEN 17.0 AND 17.9 AND lon BETWEEN 78.0 AND 78.7) THEN 'box' WHEN q > 5 THEN 'q' WHEN ns < 4 THEN 'ns' WHEN sdn > 0.9 OR sde > 0.75 THEN 'sd' END AS reason FROM track) GROUP BY reason""")
def ordered_reject_reasons(spark, sf_dir):
    """C9, E20."""
    t = track(spark, sf_dir)
    reason = Q.reject_reason(F.col("q"), F.col("ns"), F.col("sdn"), F.col("sde") + 0.15, max_q=5, min_ns=4, max_deviation=0.9, inside=in_box(box=(17.0, 17.9, 78.0, 78.7)))
    return t.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {TRACK_SQL} SELECT q, count(*) AS n, CASE q WHEN 1 THEN 'FIX' WHEN 2 THEN 'FLOAT' WHEN 3 THEN 'SBAS' WHEN 4 THEN 'DGPS' WHEN 5 THEN 'SINGLE' WHEN 6 THEN 'PPP' ELSE '?' END AS label FROM track GROUP BY q")
def solution_quality_counts(spark, sf_dir):
    """A12, C11, E6."""
    return quality_counts(track(spark, sf_dir)).select("q", F.col("count").alias("n"), "label")


@query(f"WITH {TRACK_SQL} SELECT event_id, CASE q WHEN 1 THEN 'Fix' WHEN 2 THEN 'Float' WHEN 4 THEN 'DGPS' WHEN 5 THEN 'Single' ELSE 'Other' END AS quality_type, CASE WHEN sdn < 1 THEN 'green' ELSE 'orange' END AS colour FROM track WHERE lat IS NOT NULL AND lon IS NOT NULL")
def quality_label_case(spark, sf_dir):
    """C10, C12, C15."""
    t = track(spark, sf_dir).dropna(subset=["lat", "lon"])
    return t.select("event_id", T.label_of(F.col("q"), T.REPORT_LABELS, "Other").alias("quality_type"), T.accuracy_colour(F.col("sdn")).alias("colour"))


@query(f"WITH {TRACK_SQL} SELECT event_id, round({hav_sql('lat', 'lon', '17.4e0', '78.3e0')}, 5) AS metres, round({hav_sql('lat', 'lon', '17.4e0', '78.3e0')}, 5) AS metres_atan FROM track")
def haversine_forms(spark, sf_dir):
    """I1, I2."""
    t, lat, lon = track(spark, sf_dir), F.lit(17.4), F.lit(78.3)
    return t.select("event_id", F.round(haversine(F.col("lat"), F.col("lon"), lat, lon), 5).alias("metres"), F.round(haversine_atan(F.col("lat"), F.col("lon"), lat, lon), 5).alias("metres_atan"))


@query(f"WITH {TRACK_SQL} SELECT event_id, round(radians(lon - 78.3e0) * 6378137.0e0 * cos(radians(17.4e0)), 4) AS x, round(radians(lat - 17.4e0) * 6378137.0e0, 4) AS y, round(lat, 9) AS lat, round(lon, 9) AS lon FROM track")
def local_xy_roundtrip(spark, sf_dir):
    """I9."""
    t, lat0, lon0 = track(spark, sf_dir), F.lit(17.4), F.lit(78.3)
    x, y = local_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    lat, lon = local_latlon(x, y, lat0, lon0)
    return t.select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query(f"WITH {TRACK_SQL} SELECT event_id, round((lon - 78.3e0) * 51500, 6) AS x, round((lat - 17.4e0) * 51500, 6) AS y, round(lat, 9) AS lat, round(lon, 9) AS lon FROM track")
def plane_xy_roundtrip(spark, sf_dir):
    """I10."""
    t, lat0, lon0 = track(spark, sf_dir), F.lit(17.4), F.lit(78.3)
    x, y = plane_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    lat, lon = plane_latlon(x, y, lat0, lon0)
    return t.select("event_id", r6(x, "x"), r6(y, "y"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("SELECT event_id, 315964800 + (2200 + event_id % 200) * 604800 + (event_id * 61) % 604800 - 18 AS unix_s FROM events")
def gps_week_to_utc(spark, sf_dir):
    """I6."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", gps_to_unix(2200 + F.col("event_id") % 200, (F.col("event_id") * 61) % 604800).cast("long").alias("unix_s"))


@query("SELECT event_id, round(((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 59)) / 86400.0e0, 9) AS fraction FROM events")
def day_fraction_of_clock(spark, sf_dir):
    """I8."""
    e = table(spark, sf_dir, "events")
    clock = F.format_string("%02d:%02d:%02d", F.col("event_id") % 24, F.col("event_id") % 60, F.col("event_id") % 59)
    return e.select("event_id", F.round(day_fraction(clock), 9).alias("fraction"))


@query("SELECT event_id, round_even((event_id * 250) / 1000.0, 0)::BIGINT AS rounded, (event_id * 250) // 1000 AS floored FROM events")
def second_buckets(spark, sf_dir):
    """I5."""
    from trajspark.functions.timeconv import floor_second

    e = table(spark, sf_dir, "events")
    return e.select("event_id", rounded_second(F.col("event_id") * 250).alias("rounded"), floor_second(F.col("event_id") * 250).alias("floored"))


@query("""SELECT event_id, round(cy * cp * x + (cy * sp * sr - sy * cr) * y + (cy * sp * cr + sy * sr) * z, 6) + 0.0e0 AS rx, round(sy * cp * x + (sy * sp * sr + cy * cr) * y + (sy * sp * cr - cy * sr) * z, 6) + 0.0e0 AS ry, round(-sp * x + cp * sr * y + cp * cr * z, 6) + 0.0e0 AS rz
FROM (SELECT event_id, value AS x, event_id % 10 AS y, 9.81e0 AS z, cos(a) AS cr, sin(a) AS sr, cos(b) AS cp, sin(b) AS sp, cos(c) AS cy, sin(c) AS sy FROM (SELECT event_id, value, radians(event_id % 30) AS a, radians(event_id % 50) AS b, radians(event_id % 360) AS c FROM events))""")
def rotation_apply(spark, sf_dir):
    """I20."""
    e = table(spark, sf_dir, "events")
    angle = lambda m: F.radians((F.col("event_id") % m).cast("double"))
    rx, ry, rz = rotate(angle(30), angle(50), angle(360), F.col("value"), F.col("event_id") % 10, F.lit(9.81))
    return e.select("event_id", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in (("rx", rx), ("ry", ry), ("rz", rz))])


@query("SELECT event_id, strftime(ts, '%H-%M-%S') AS label, md5(props) AS digest, json_extract(props, '$.k')::INT AS k FROM events")
def json_point(spark, sf_dir):
    """I27-I29."""
    e = table(spark, sf_dir, "events")
    label = F.date_format("ts", "HH-mm-ss")
    return e.select("event_id", label.alias("label"), F.md5("props").alias("digest"), F.from_json("props", "k INT")["k"].alias("k"))


@query("SELECT user_id, string_agg(event_type, '*' ORDER BY ts, event_id) AS joined, count(*) AS n FROM events GROUP BY user_id")
def string_agg_split(spark, sf_dir):
    """Joined in order and split again."""
    e = table(spark, sf_dir, "events")
    kept = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(F.array_join(kept, "*").alias("joined")).select("user_id", "joined", F.size(F.split("joined", r"\*")).cast("long").alias("n"))


@query("SELECT count(*) AS files FROM (SELECT DISTINCT event_type, user_id % 10 FROM events)")
def distinct_files(spark, sf_dir):
    """E19, H5."""
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("u")).distinct().agg(F.count("*").alias("files"))


@query("SELECT event_id, regexp_matches(event_type, 'view|click') AS wide, NOT regexp_matches(event_type, 'view|click') AS narrow, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END, false) AS oneway FROM events")
def road_class_split(spark, sf_dir):
    """C13, C14."""
    e = table(spark, sf_dir, "events")
    oneway = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 1), F.lit(False))
    return e.select("event_id", F.col("event_type").rlike("view|click").alias("wide"), (~F.col("event_type").rlike("view|click")).alias("narrow"), oneway.alias("oneway"))


@query("SELECT p_partkey, regexp_matches(p_type, '^[0-9.]*$') AS ok, CASE WHEN p_size > 0 THEN 1000.0e0 / p_size END AS delay_ms FROM part")
def settings_check(spark, sf_dir):
    """C29, I24."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.is_number_input(F.col("p_type")).alias("ok"), T.rate_to_delay_ms(F.col("p_size")).alias("delay_ms"))
