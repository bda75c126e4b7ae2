"""Column functions against plain arithmetic, and their properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.functions import geo, text, timeconv
from trajspark.operators.recursive import metres


def one(spark, *columns, rows=1):
    return spark.range(rows).select(*columns).first()


def test_haversine(spark):
    points = [(17.0, 78.0, 17.5, 78.25), (0.0, 0.0, 0.0, 180.0), (17.3, 78.1, 17.3, 78.1), (90.0, 0.0, -90.0, 0.0)]
    df = spark.createDataFrame([*points, (None, 78.0, 17.0, 78.0)], "a double, b double, c double, d double")
    rows = df.select("a", "b", "c", "d", geo.haversine(*map(F.col, "abcd")).alias("m"), geo.haversine_atan(*map(F.col, "abcd")).alias("n"), geo.haversine(*map(F.col, "cdab")).alias("back")).collect()
    for r in rows[:-1]:
        assert r.m == pytest.approx(metres(r.a, r.b, r.c, r.d), abs=1e-6) == pytest.approx(r.n, abs=0.1)
        assert r.m == pytest.approx(r.back)
    assert rows[2].m == 0 and rows[-1].m is None


def test_planes_and_round_trips(spark):
    lat, lon, lat0, lon0 = F.lit(17.41), F.lit(78.33), F.lit(17.4), F.lit(78.3)
    x, y = geo.local_xy(lat, lon, lat0, lon0)
    back = geo.local_latlon(x, y, lat0, lon0)
    px, py = geo.plane_xy(lat, lon, lat0, lon0)
    pback = geo.plane_latlon(px, py, lat0, lon0)
    r = one(spark, back[0].alias("a"), back[1].alias("b"), pback[0].alias("c"), pback[1].alias("d"), px.alias("px"))
    assert (r.a, r.b, r.c, r.d) == pytest.approx((17.41, 78.33, 17.41, 78.33)) and r.px == pytest.approx(0.03 * 51500)


def test_utm(spark):
    e, n = geo.utm_xy(F.lit(17.4453), F.lit(78.3489))
    r = one(spark, e.alias("e"), n.alias("n"), geo.utm_zone(F.lit(78.3489)).alias("z"))
    assert r.z == 44
    # near the tangent plane: a step of 100 m stays one, up to the scale factor
    e2, n2 = geo.utm_xy(F.lit(17.4453 + 100 / 110_700), F.lit(78.3489))
    s = one(spark, e2.alias("e"), n2.alias("n"))
    assert math.hypot(s.e - r.e, s.n - r.n) == pytest.approx(100, abs=0.2)


def test_bearings_and_slopes(spark):
    r = one(
        spark, geo.bearing(F.lit(1.0), F.lit(0.0)).alias("east"), geo.bearing(F.lit(-1.0), F.lit(0.0)).alias("west"), geo.angle_between(F.lit(350.0), F.lit(10.0)).alias("d"),
        geo.slope_degrees(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("up"), geo.slope_degrees(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(1.0)).alias("left"), geo.slope_difference(F.lit(175.0), F.lit(5.0)).alias("wrap"),
    )
    assert (r.east, r.west, r.d, r.up, r.left, r.wrap) == pytest.approx((90, 270, 20, 90, 135, 10))


def test_segments(spark):
    d = lambda *v: geo.segment_distance(*[F.lit(float(x)) for x in v])
    t, x, y = geo.foot_of_perpendicular(*[F.lit(float(v)) for v in (1, 1, 3, 3, 3, 3)])
    r = one(spark, d(0, 1, -1, 0, 1, 0).alias("above"), d(5, 0, -1, 0, 1, 0).alias("past"), d(4, 3, 0, 0, 0, 0).alias("point"), t.alias("t"))
    assert (r.above, r.past, r.point) == pytest.approx((1, 4, 5)) and r.t is None


def test_histogram_distance_and_rotation(spark):
    a, b, zero = F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))
    x, y, z = geo.rotate(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(1.0), F.lit(0.0), F.lit(2.0))
    r = one(spark, geo.bhattacharyya(a, a).alias("same"), geo.bhattacharyya(a, b).alias("other"), geo.bhattacharyya(a, zero).alias("none"), x.alias("x"), y.alias("y"), z.alias("z"), geo.euclidean(a, b).alias("e"))
    assert r.same == pytest.approx(0, abs=1e-7) and r.other == pytest.approx(math.sqrt(1 - 2 * math.sqrt(3) / 4)) and r.none == 0
    assert (r.x, r.y, r.z) == pytest.approx((0, 1, 2), abs=1e-12) and r.e == pytest.approx(math.sqrt(8))


def test_times(spark):
    r = one(
        spark, timeconv.rounded_second(F.lit(1500)).alias("even"), timeconv.rounded_second(F.lit(2500)).alias("even2"), timeconv.floor_second(F.lit(1999)).alias("floor"), timeconv.gps_to_unix(F.lit(2409), F.lit(20441.428)).alias("gps"),
        timeconv.day_fraction(F.lit("12:30")).alias("noon"), timeconv.day_fraction(F.lit("x:00:30")).alias("bad"), F.unix_seconds(timeconv.nmea_time(F.lit("054023.00"), F.lit("150326"))).alias("nmea"), timeconv.nmea_time(F.lit("99"), F.lit("150326")).alias("none"),
        F.unix_micros(timeconv.rinex_epoch(*[F.lit(v) for v in (2026, 3, 15, 5, 40)], F.lit(23.4280001))).alias("rinex"), timeconv.clock_label(F.lit(1773553223000)).alias("label"),
    )
    assert (r.even, r.even2, r.floor) == (2, 2, 1)
    assert r.gps == pytest.approx(315964800 + 2409 * 604800 + 20441.428 - 18)
    assert r.noon == pytest.approx(12.5 / 24) and r.bad == pytest.approx(30 / 86400)
    assert r.nmea == 1773553223 and r.none is None and r.rinex == 1773553223428000 and r.label == "05-40-23"


def test_text_fields(spark):
    items = F.array(*[F.lit(x) for x in ("A", "1.5", "", "2", "3*7F", "4")])
    r = one(
        spark, text.nmea_degrees(F.lit("1726.7180"), F.lit("N")).alias("n"), text.nmea_degrees(F.lit("07820.9340"), F.lit("w")).alias("w"), text.nmea_degrees(F.lit("x"), F.lit("N")).alias("bad"), text.without_checksum(F.lit("$A,1*2*5A")).alias("star"),
        text.constellation(F.lit("GL")).alias("r"), text.constellation(F.lit("QX")).alias("x"), text.last_numbers(items).alias("last"), F.size(text.groups_of(F.array(*[F.lit("a")] * 9))).alias("groups"), F.size(text.groups_of(F.array(F.lit("a")))).alias("no"),
        text.is_digits(F.lit("05")).alias("digits"), text.is_digits(F.lit(None).cast("string")).alias("null"), text.is_number_input(F.lit("1.x")).alias("input"), text.coordinate_json(F.lit(1.5), F.lit(2.0)).alias("json"),
    )
    assert r.n == pytest.approx(17 + 26.718 / 60) and r.w == pytest.approx(-(78 + 20.934 / 60)) and r.bad is None and r.star == "$A,1*2"
    assert (r.r, r.x, r.last, r.groups, r.no) == ("R", "X", [1.5, 2.0, 4.0], 2, 0)
    assert r.digits and not r.null and not r.input and r.json == "[1.5000000,2.0000000]"


@settings(max_examples=50, deadline=None)
@given(st.floats(-89, 89), st.floats(-179, 179), st.floats(-89, 89), st.floats(-179, 179))
def test_metres_is_a_distance(a, b, c, d):
    assert metres(a, b, a, b) == 0
    assert metres(a, b, c, d) == pytest.approx(metres(c, d, a, b)) and metres(a, b, c, d) <= math.pi * geo.EARTH_RADIUS + 1e-6
