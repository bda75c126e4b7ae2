"""Parsers on small hand-made logs, and sinks."""

import pytest
from pyspark.sql import functions as F

from trajspark import schemas
from trajspark.sources import gnsslog, nmea, pos, rinex, roads, sinks, tables, textlog

LOG = """
NMEA,$GPGGA,054023.00,1726.7180,N,07820.9340,E,1,12,0.8,550.0,M,-70.0,M,,*5A,1773553223000
NMEA,$GPGGA,054023.50,1726.7181,S,07820.9341,W,4,12,,550.0,M,-70.0,M,,*5A,1773553223500*2B
NMEA,$GPGSV,1,1,02,05,45,120,33,07,10,200,,1*7F,1773553223000
NMEA,$GNGSA,A,3,05,07,,,,,,,,,,,1.9,0.8,1.7,4*2E,1773553223000
NMEA,$GNRMC,054023.00,A,1726.7180,N,07820.9340,E,0.5,90.0,150326,,,A*6C,1773553223000
NMEA,$GPGGA,054024.00,bad,N,07820.9340,E,1,12,0.8,550.0,M,-70.0,M,,*5A,1773553224000
NMEA,$GPGGA,054024.00,1726.7180,N,07820.9340,E,1,12,0.8,550.0,M,-70.0,M,,*5A,xyz
$GPGGA,054025.00,1726.7180,N,07820.9340,E,2,12,0.8,550.0,M,-70.0,M,,*5A
noise
"""


def test_nmea(lines):
    s = nmea.sentences(lines(LOG))
    fixes = nmea.gga(s).orderBy("line_no").collect()
    assert [f.line_no for f in fixes] == [0, 1, 7]
    assert fixes[0].lat == pytest.approx(17 + 26.718 / 60) and fixes[1].lat < 0 and fixes[1].lon < 0
    assert fixes[1].hdop is None and fixes[1].q == 4 and fixes[1].ts_ms == 1773553223500 and fixes[2].ts_ms is None
    assert nmea.gga(nmea.sentences(lines(LOG), bare=False)).count() == 2
    sats = nmea.gsv(s).orderBy("slot").collect()
    assert [(x.svid, x.elev, x.snr) for x in sats] == [("G05", 45.0, 33.0), ("G07", 10.0, None)]
    d = nmea.gsa(s).first()
    assert (d.pdop, d.hdop, d.vdop, d.used) == (1.9, 0.8, 1.7, ["05", "07"])
    assert nmea.rmc(s).select(F.unix_seconds("utc").alias("t")).first().t == 1773553223


def test_text_lines_have_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\r\ny\n\nz")
    rows = textlog.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(0, "x"), (1, "y"), (2, ""), (3, "z")]


def test_gnss_log(lines):
    log = lines("Fix,GPS,17.1,78.1,,0.1,,90,1500\nFix,GPS,bad,78.1,1,0,3,0,1500\nFix,FLP,17.2,78.2,5,0,3.5,0,2500\nFix,GPS,1\nStatus,1500,0,0,0,0,0,33.5,0,45,TRUE\nStatus,2500,0,0,0,0,0,,0,10,\nStatus,x,0,0,0,0,0,1,0,1,1")
    fixes = gnsslog.fixes(log).orderBy("line_no").collect()
    assert [(f.provider, f.h, f.ts_ms) for f in fixes] == [("GPS", 0.0, 1500), ("FLP", 5.0, 2500)] and fixes[0].acc != fixes[0].acc
    sats = gnsslog.statuses(log).orderBy("line_no").collect()
    assert [(s.sec, s.cn0, s.elev, s.used) for s in sats] == [(2, 33.5, 45.0, True), (2, None, 10.0, False)]
    assert gnsslog.best_last_location(gnsslog.fixes(log)).first().provider == "FLP"


POS = """
% comment
2026/03/15 05:40:23.428 17.4453 78.3489 550.10 4 12 0.80 0.70 1.50 0.1 0.1 0.1 0.0 0.0
  2409 20441.428 17.445301 78.348905 550.12 1 9
2409 x 17.4 78.3 550 1 9
2409 20442
"""


def test_solutions(lines):
    rows = pos.solutions(lines(POS)).withColumn("us", F.unix_micros("ts")).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [0, 1] and rows[0].us == 1773553223428000 and rows[1].us == (315964800 + 2409 * 604800 - 18) * 10**6 + 20441428000
    assert (rows[1].sdn, rows[1].sde, rows[1].sdu) == (999.0, 999.0, None)
    assert pos.solutions(lines(POS)).drop("us").columns == schemas.POS.names
    assert {r.q: r.label for r in pos.quality_counts(pos.solutions(lines(POS))).collect()} == {4: "DGPS", 1: "FIX"}


RINEX = """
     3.03           OBSERVATION DATA
                                                            END OF HEADER
> 2026 03 15 05 40 23.0000000  0  2
G05  1.0
R11  2.0
> 2026 xx 15 05 40 24.0000000  0  1
G05  1.0
> 2026 03 15 05 40 25.0000000  0  1
G05  1.0
"""


def test_rinex(spark, lines):
    found = rinex.blocks(lines(RINEX))
    assert found.filter("is_header").count() == 2
    counts = {r.sat: (r.n, r.first_line) for r in rinex.satellite_counts(found).collect()}
    assert counts == {"G05": (3, 3), "R11": (1, 4)}
    kept = rinex.kept_lines(found, spark.createDataFrame([(1773553225,)], "sec long")).orderBy("line_no").collect()
    assert [r.line_no for r in kept] == [0, 1, 2, 3, 4]
    assert rinex.blocks(lines("no header end\n> 2026 03 15 05 40 23.0 0 1")).filter("is_header").count() == 2


def test_ways_and_grid(spark, lines):
    ways = roads.way_segments(lines("17.0 78.0\n17.1 78.1\n17.2 78.2\n999.99 999.99\n18.0 79.0\n18.1 79.1\n1000 1000\n19 80\n19.1 80.1")).orderBy("way_id", "seg_no").collect()
    assert [(w.way_id, w.seg_no, w.lat1, w.lat2) for w in ways] == [(0, 0, 17.0, 17.1), (0, 1, 17.1, 17.2), (1, 0, 18.0, 18.1)]
    grid = roads.road_grid(spark, 17.4, 78.3)
    assert grid.count() == 800 and grid.select("road_id").distinct().count() == 20


def test_osm_edges(spark, tmp_path):
    (tmp_path / "m.osm").write_text("""<osm><node id="1" lat="17.0" lon="78.0"/><node id="2" lat="17.1" lon="78.1"/><node id="3" lat="17.2" lon="78.2"/>
<way id="9"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="oneway" v="yes"/></way></osm>""")
    rows = roads.edges_of_osm(spark, str(tmp_path / "m.osm")).orderBy("key").collect()
    assert [(r.u, r.v, r.highway, r.oneway) for r in rows] == [(1, 2, "primary", True), (2, 3, "primary", True)]
    assert rows[0].coords[0].x == 78.0


def test_tabular_sources(spark, lines, tmp_path):
    (tmp_path / "ANDACCX01.csv").write_text("k,00:00:01.0,0.5\nk,00:00:02.0,x\nk,00:00:03.0,1.5\n")
    rows = tables.channels(spark, str(tmp_path / "ANDACCX01.csv")).orderBy("seq").collect()
    assert [(r.channel, r.session, r.seq, r.value) for r in rows] == [("ACCX", "01", 0, 0.5), ("ACCX", "01", 2, 1.5)]
    (tmp_path / "h.yml").write_text("%YAML:1.0\nhist_tar_1: !!opencv-matrix\n   rows: 1\n   cols: 3\n   dt: f\n   data: [ 1., 2.5,\n       0. ]\n")
    m = tables.yaml_matrices(spark, str(tmp_path / "h.yml")).first()
    assert (m["key"], m["rows"], m["cols"], m["data"]) == ("hist_tar_1", 1, 3, [1.0, 2.5, 0.0])
    (tmp_path / "t.txt").write_text("0.1 0.2 0.3 6 1\nbad\n0.4 0.5 0.6 7 0\n")
    assert [r["class"] for r in tables.training_rows(spark, str(tmp_path / "t.txt")).collect()] == [1, 0]
    assert tables.positional_points(lines("t,lat,lon\n1,17.1,78.1\n2,x,78\n3")).count() == 1
    d = tables.file_digests(spark, str(tmp_path / "t.txt")).first()
    assert d["size"] == (tmp_path / "t.txt").stat().st_size and len(d["md5"]) == 32
    assert tables.listing(spark, str(tmp_path), "AND", ".csv").count() == 1
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "130.jpg").write_bytes(b"x")
    assert tables.images(spark, str(tmp_path / "img")).first().image_no == 130
    (tmp_path / "p.csv").write_text("lat,lon,timestamp,hdop,sats\n17.1,78.1,1,0.8,5\n")
    assert tables.csv_table(spark, str(tmp_path / "p.csv"), schemas.GATED_CSV).first().sats == 5


def test_sinks_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(17.123456789012, 78.5, 1773553223000, 0.8, 5), (17.2, 78.6, 1773553224000, 1.0, 4)], "lat double, lon double, ts_ms long, hdop double, sats int")
    sinks.write_csv(sinks.gated_rows(points), str(tmp_path / "gated"))
    assert tables.csv_table(spark, str(tmp_path / "gated"), schemas.GATED_CSV).count() == 2
    ui = sinks.ui_rows(points, "lane", "snapped")
    assert ui.first().time == "05-40-23" and ui.columns == schemas.UI_POINT.names
    ui.coalesce(1).write.json(str(tmp_path / "ui"))
    assert tables.ui_points(spark, str(tmp_path / "ui")).count() >= 1
    text = sinks.json_array(ui.select("lat", "milli"), ["milli"]).first().json
    assert text.startswith('[{"lat":17.12') and text.endswith('1773553224000}]')
    assert sinks.legacy_lines(points, "lat").orderBy("ts_ms").first().value == "1.0,1773553223000,17.123456789012"
    assert sinks.legacy_names(points).first().lat_file == "ANDGPSLA05-40-23.csv"
    fix = sinks.fix_rows(points.withColumn("h", F.lit(1.0))).first()
    assert (fix.utc, fix.lat, fix.height) == ("2026-03-15T05:40:23.000", "17.1234567890", "1.000")
    nodes = sinks.overlay_nodes(points.withColumn("class", F.lit(2)), F.lit(0)).first()
    assert nodes.id == 1 and "fast_food" in nodes.value
    sinks.write_lines(sinks.legacy_lines(points, "lon"), str(tmp_path / "legacy"), ["ts_ms"])
    assert spark.read.text(str(tmp_path / "legacy")).count() == 2
    files = points.withColumn("file", F.when(F.col("sats") == 5, "a"))
    assert sinks.without_file(files, "a").count() == 1
    assert tables.renumbered(spark.createDataFrame([("b",), ("a",)], "file string")).orderBy("file").first().number == 1


def test_json_arrays_of_long_sessions_are_cut(spark, tmp_path, monkeypatch):
    import json

    from trajspark.plans import source_queries

    events = spark.range(300).select(F.col("id").alias("event_id"), F.when(F.col("id") < 250, 1).otherwise(F.col("id")).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(source_queries, "POINTS_A_LINE", 100, raising=False)
    monkeypatch.setattr(source_queries, "work_folder", lambda *a: str(tmp_path / "ui"))
    got = source_queries.json_points(spark, str(tmp_path))
    lines = [[p["milli"] // 1000 - 1773553223 for p in json.loads(r.value)] for r in spark.read.text(str(tmp_path / "ui")).collect()]
    long = sorted(a for a in lines if a[0] < 250)
    assert [len(a) for a in long] == [100, 100, 50] and sum(long, []) == list(range(250))
    assert sorted(a for a in lines if a[0] >= 250) == [[i] for i in range(250, 300)]
    assert sorted(r.milli // 1000 - 1773553223 for r in got.collect()) == list(range(300))
