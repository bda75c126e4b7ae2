"""Operators against plain Python, the quirks they must keep, and properties."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.operators import joins, models, quality, recursive, report, robust, smooth, windows

BY, ORDER = ["k"], ["t"]


def track(spark, points, k="a"):
    rows = [(k, i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "k string, t long, lat double, lon double")


def column(df, name):
    return [r[name] for r in df.orderBy("k", "t").collect()]


def series(spark, values, name="v"):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], f"k string, t long, {name} double")


# ---- gates and epochs


def test_best_fix_takes_quality_then_order(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, 4), (1, 2, 4), (2, 3, 0)], "sec int, line_no int, q int")
    assert sorted((r.sec, r.line_no) for r in quality.best_fix(rows, ["sec"], ["line_no"]).collect()) == [(1, 1), (2, 3)]


def test_gate_edges(spark):
    row = lambda g, n, h, p=None, d=None: spark.range(1).select(quality.passes(g, F.lit(n), F.lit(h).cast("double"), F.lit(p).cast("double"), None if d is None else F.lit(d)).alias("ok")).first().ok
    assert row(quality.SIMPLE, 4, 2.0) and not row(quality.SIMPLE, 3, 1.0) and not row(quality.SIMPLE, 4, None)
    assert row(quality.STRICT, 5, None, None) and not row(quality.STRICT, 5, 2.0, 4.1)
    assert row(quality.LENIENT, 0, None, None, False) and not row(quality.LENIENT, 0, None, None, True)
    assert not row(quality.SIMPLE_TIGHT, 6, 1.6)


def test_used_is_three_valued(spark):
    used = spark.createDataFrame([(30.0, 20.0, None), (30.0, 20.0, True), (30.0, 20.0, False), (None, 20.0, True)], "snr double, elev double, used boolean")
    good = used.select(quality.good_satellite(quality.LENIENT, F.col("snr"), F.col("elev"), F.col("used")).alias("g")).collect()
    assert [r.g for r in good] == [True, True, False, False]


def test_fallback_prefers_same_then_before_then_after(spark):
    left = spark.createDataFrame([("a", s) for s in (1, 5, 9, 20)], "k string, s long")
    right = spark.createDataFrame([("a", 1, "same"), ("a", 0, "before"), ("a", 4, "b"), ("a", 6, "c"), ("a", 10, "after"), ("a", 21, None)], "k string, s long, v string")
    got = {r.s: r.v for r in quality.fallback_join(left, right, ["k"], "s", "v").collect()}
    assert got == {1: "same", 5: "b", 9: "after", 20: None}


@pytest.mark.parametrize("gate", [quality.SIMPLE, quality.STRICT, quality.LENIENT])
def test_gates_are_monotone(spark, gate):
    from dataclasses import replace

    rows = spark.createDataFrame([(n, h / 4, p / 4) for n in range(8) for h in range(0, 30, 3) for p in range(0, 50, 7)], "n int, h double, p double")
    wide = replace(gate, min_sats=gate.min_sats - 1, max_hdop=gate.max_hdop + 1)
    both = rows.select(quality.passes(gate, F.col("n"), F.col("h"), F.col("p")).alias("a"), quality.passes(wide, F.col("n"), F.col("h"), F.col("p")).alias("b"))
    assert both.filter("a AND NOT b").count() == 0 and both.filter("a").count() > 0


# ---- windows and smoothers


def test_first_step_is_zero_or_absent(spark):
    t = track(spark, [(17, 78), (17, 78.001), (17, 78.001)])
    steps = column(windows.step_distance(t, BY, ORDER), "step")
    assert steps[0] == 0 and steps[1] == pytest.approx(recursive.metres(17, 78, 17, 78.001)) and steps[2] == 0
    assert column(windows.step_distance(t, BY, ORDER, first=None), "step")[0] is None


def test_heading_of_last_and_single_points(spark):
    t = track(spark, [(17, 78), (17.001, 78), (17.001, 78.001)]).union(track(spark, [(17, 78)], "b"))
    h = column(windows.heading(t, BY, ORDER), "heading")
    assert h[0] == pytest.approx(0) and h[1] == pytest.approx(90) and h[2] == h[1] and h[3] is None


def test_upper_median_and_mean(spark):
    v = [5, 1, 9, 3, 7, 2]
    got = column(windows.rolling_upper_median(series(spark, v), BY, ORDER, "v"), "v")
    assert got == [sorted(v[max(0, i - 2) : i + 3])[len(v[max(0, i - 2) : i + 3]) // 2] for i in range(len(v))]
    got = column(windows.moving_average(series(spark, v), BY, ORDER, "v"), "v")
    assert got == pytest.approx([np.mean(v[max(0, i - 3) : i + 4]) for i in range(len(v))])


@pytest.mark.parametrize("edge,half", [("reflect", 3), ("clamp", 5)])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 11, 25])
def test_gaussian(spark, edge, half, n):
    r = random.Random(n)
    v = [r.uniform(0, 9) for _ in range(n)]
    got = column(windows.gaussian_smooth(series(spark, v), BY, ORDER, "v", half, edge), "v")
    w = windows.gaussian_weights(half)
    if n < (3 if edge == "reflect" else 2 * half + 1):
        want = v
    elif edge == "clamp":
        want = [sum(w[j] * v[max(0, min(n - 1, i - half + j))] for j in range(2 * half + 1)) for i in range(n)]
    else:
        padded = [*v[:half][::-1], *v, *v[-half:][::-1]]
        if n < half:
            return  # shorter tracks than the padding have no counterpart
        want = np.convolve(padded, w, "valid")[:n]
    assert got == pytest.approx(list(want))
    constant = column(windows.gaussian_smooth(series(spark, [4.0] * n), BY, ORDER, "v", half, edge), "v")
    assert constant == pytest.approx([4.0] * n)


@pytest.mark.parametrize("keep", list(itertools.product([True, False], repeat=4)))
def test_gap_interpolation(spark, keep):
    v = [1.0, 5.0, 2.0, 8.0]
    df = series(spark, v).join(spark.createDataFrame(list(enumerate(keep)), "t long, keep boolean"), "t")
    got = column(smooth.gap_interpolate(df, BY, ORDER, ["v"]), "v")
    kept = [i for i, k in enumerate(keep) if k]
    for i in range(4):
        p, n = [j for j in kept if j <= i], [j for j in kept if j >= i]
        if keep[i] or not kept:
            want = v[i]
        elif p and n:
            want = v[p[-1]] + (i - p[-1]) / (n[0] - p[-1]) * (v[n[0]] - v[p[-1]])
        else:
            want = v[p[-1]] if p else v[n[0]]
        assert got[i] == pytest.approx(want)


def test_carry_forward_and_change(spark):
    df = series(spark, [None, 2, None, 3, 3])
    assert column(windows.carry_forward(df, BY, ORDER, ["v"]), "v") == [0, 2, 2, 3, 3]
    assert column(windows.changed(df, BY, ORDER, ["v"]), "changed") == [True, True, True, True, False]


def test_trailing_windows(spark):
    df = series(spark, [1, 2, 6, 10]).withColumn("us", F.col("t") * 1_000_000)
    got = column(windows.trailing_time(df, BY, "us", "v"), "deviation")
    assert got == pytest.approx([np.std([1]), np.std([1, 2]), np.std([1, 2, 6]), np.std([2, 6, 10])])
    df = series(spark, [1, 2, 3, 4]).withColumn("step", F.lit(60.0))
    assert column(windows.trailing_distance(df, BY, ORDER, F.count("*"), 100.0), "trailing") == [1, 2, 2, 2]


def test_trailing_distance_compares_runs_in_doubles(spark):
    rng = random.Random(0)
    steps = [rng.choice((12.505, 24.995, 25.005, 37.495, 50.005)) for _ in range(400)]
    runs = [round(x, 3) for x in itertools.accumulate(steps)]
    expected = [sum(a - 100.0 <= b <= a for b in runs) for a in runs]
    assert column(windows.trailing_distance(series(spark, steps, "step"), BY, ORDER, F.count("*"), 100.0, decimals=3), "trailing") == expected


# ---- robust statistics


def test_mad_zero_clip_and_limits(spark):
    flat = series(spark, [3, 3, 3, 3, 50])
    assert robust.sigma_clip(flat, BY, "v").count() == 0
    limits = robust.mad_limits(series(spark, [1, 2, 3, 4, 100]), BY, ["v"]).first()
    assert (limits.v_median, limits.v_mad) == (3, 1) and limits.v_limit == pytest.approx(3 + 3 * 1.4826)


def test_spikes(spark):
    steps = [0, 1, 1, 1, 1, 1, 30, 30, 1]
    df = series(spark, steps, "step")
    assert column(robust.iqr_spikes(df, BY, ORDER), "spike") == [s > 2 for s in steps]
    assert not any(column(robust.iqr_spikes(series(spark, [0, 1, 50], "step"), BY, ORDER), "spike"))
    assert column(robust.iqr_spikes(series(spark, [0], "step"), BY, ORDER), "spike") == [False]


def test_bias_needs_pairs(spark):
    pairs = spark.createDataFrame([("a", 1.0, 2.0)] * 9 + [("b", float(i), 2.0 * i) for i in range(11)], "k string, dlat double, dlon double")
    got = {r.k: (r.n, r.bias_lat, r.bias_lon) for r in robust.bias_estimate(pairs, BY).collect()}
    assert got == {"a": (9, 0.0, 0.0), "b": (11, 5.0, 10.0)}


def brute_adaptive(values, outlier):
    rows = [list(v) for v in values]
    n = len(rows)
    marked = [False] * n
    for i in range(n - 1, -1, -1):
        if outlier[i] and 0 < i < n - 1:
            rows[i] = [(a + b) / 2 for a, b in zip(rows[i - 1], rows[i + 1])]
            marked[i] = True
    for i in range(1, n - 1):
        if marked[i]:
            near = rows[max(0, i - 2) : i + 3]
            rows[i] = [float(np.median([x[c] for x in near])) for c in range(len(rows[i]))]
    return rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100), st.booleans()), min_size=1, max_size=12))
def test_adaptive_replacement(rows):
    values, outlier = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    assert smooth.replace_outliers(values, outlier) == pytest.approx(np.array(brute_adaptive(values.tolist(), outlier)))


def test_adaptive_median_keeps_columns(spark):
    t = track(spark, [(17 + i * 1e-5, 78) for i in range(8)] + [(17.01, 78)] + [(17 + i * 1e-5, 78) for i in range(9, 14)]).withColumn("height", F.lit(1.0))
    out = smooth.adaptive_median(windows.step_distance(t, BY, ORDER), BY, ORDER)
    assert out.columns == [*t.columns, "step", "is_outlier"] and max(column(out, "lat")) < 17.001


# ---- joins


def test_nearest_time_is_brute_force(spark):
    r = random.Random(0)
    left = [("a", i, r.randint(0, 400)) for i in range(60)]
    right = [("a", i, r.randint(0, 400), float(i)) for i in range(40)]
    got = joins.asof_nearest(spark.createDataFrame(left, "k string, id long, t long"), spark.createDataFrame(right, "k string, rid long, t long, v double"), BY, "t", ["id"], ["v"], 5, "rid")
    want = {}
    for _, i, t in left:
        near = sorted((abs(t - u), j, v) for _, j, u, v in right if abs(t - u) < 5)
        want[i] = near[0][2] if near else None
    assert {x.id: x.v for x in got.collect()} == want


def test_grid_join_is_nested_loop(spark):
    r = random.Random(1)
    points = [(i, r.uniform(-200, 200), r.uniform(-200, 200)) for i in range(150)]
    boxes = [(i, *[r.uniform(-200, 200) for _ in range(2)]) for i in range(60)]
    boxes = [(i, x, y, x + r.uniform(-150, 150), y + r.uniform(-150, 150)) for i, x, y in boxes]
    p, b = spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame(boxes, "bid long, x1 double, y1 double, x2 double, y2 double")
    got = {(a.pid, a.bid) for a in joins.grid_range_join(p, b, 15.0).collect()}
    want = {(i, j) for i, x, y in points for j, x1, y1, x2, y2 in boxes if min(x1, x2) - 15 <= x <= max(x1, x2) + 15 and min(y1, y2) - 15 <= y <= max(y1, y2) + 15}
    assert got == want
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 500.0)], "pid long, x double, y double")
    box = spark.createDataFrame([(1, 100.0, 0.0, 120.0, 0.0)], "bid long, x1 double, y1 double, x2 double, y2 double")
    assert [(a.pid, a.bid) for a in joins.grid_join_with_fallback(far, box, ["pid"]).collect()] == [(1, 1)]


def test_segments_past_their_ends_do_not_match(spark):
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 80.0, 5.0), (3, 0.0, 0.0)], "pid long, x double, y double")
    segments = spark.createDataFrame([(1, -10.0, 0.0, 10.0, 0.0), (2, 5.0, 5.0, 5.0, 5.0)], "sid long, x1 double, y1 double, x2 double, y2 double")
    got = {r.pid: (r.sid, r.distance) for r in joins.nearest_segment(points, segments, 100.0, ["pid"], ["sid"]).collect()}
    assert got == {1: (1, 5.0), 2: (None, None), 3: (1, 0.0)}


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_nearest_segment_is_brute_force_and_makes_no_pairs_of_copies(spark, monkeypatch, held):
    monkeypatch.setattr(joins, "HELD_SEGMENTS", held, raising=False)
    r = random.Random(8)
    points = [(i, r.uniform(-50, 350), r.uniform(-50, 350)) for i in range(200)] + [(200, None, 1.0)]
    ends = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(30)]
    ends = [(float(x), float(y), float(x + r.randint(-90, 90)), float(y + r.randint(-90, 90))) for x, y in ends] + [(7.0, 7.0, 7.0, 7.0)]
    segments = [(i, *ends[i % len(ends)]) for i in range(20 * len(ends))] + [(-1, None, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "pid long, x double, y double")
    found = joins.nearest_segment(p, spark.createDataFrame(segments, "sid long, x1 double, y1 double, x2 double, y2 double"), 40.0, ["pid"], ["sid"])
    got = {a.pid: (a.sid, a.distance) for a in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert held == 5 or "Join" not in plan

    def nearest(x, y):
        best = (math.inf, None)
        for i, (x1, y1, x2, y2) in enumerate(ends):
            dx, dy = x2 - x1, y2 - y1
            length, along = dx * dx + dy * dy, (x - x1) * dx + (y - y1) * dy
            near = min(x1, x2) - 40 <= x <= max(x1, x2) + 40 and min(y1, y2) - 40 <= y <= max(y1, y2) + 40
            if near and length and 0 <= along <= length:
                best = min(best, (abs((x - x1) * dy - (y - y1) * dx) / math.sqrt(length), i))
        return best

    assert len(got) == 201 and got[200] == (None, None)
    for i, x, y in points[:200]:
        distance, sid = nearest(x, y)
        assert got[i] == ((None, None) if sid is None else (sid, pytest.approx(distance, abs=1e-12)))
    assert sum(v[0] is None for v in got.values()) > 5
    none = joins.nearest_segment(p, spark.createDataFrame([], "sid long, x1 double, y1 double, x2 double, y2 double"), 40.0, ["pid"], ["sid"])
    assert {a.sid for a in none.collect()} == {None}


def test_votes_tie_to_the_lowest_class(spark):
    train = spark.createDataFrame([(i, [float(i)], c) for i, c in enumerate([2, 1, 1, 2, 0])], "train_id long, train_features array<double>, class int")
    q = spark.createDataFrame([(1, [0.0])], "query_id long, features array<double>")
    assert joins.knn_condition(q, train).first()["class"] == 1
    assert joins.knn_condition(q, train.limit(2)).first().votes == 1


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    r = random.Random(4)
    train = spark.createDataFrame([(i, [float(r.randint(0, 9)), float(r.randint(0, 9))], r.randint(0, 3)) for i in range(50)], "train_id long, train_features array<double>, class int")
    q = spark.createDataFrame([(i, [float(r.randint(0, 9)), float(r.randint(0, 9))]) for i in range(20)], "query_id long, features array<double>")
    one = sorted(joins.knn_condition(q, train).collect())
    monkeypatch.setattr(joins, "TRAIN_VALUES", 2 * 7)
    assert sorted(joins.knn_condition(q, train).collect()) == one


def test_neighbours_are_brute_force(spark):
    r = random.Random(6)
    vector = lambda: [float(r.randint(0, 3)) for _ in range(3)]
    known = [(i, vector()) for i in r.sample(range(90), 40)] + [(90, None), (91, [0.0, 0.0]), (92, [0.0, None, 0.0])]
    asked = [(i, vector()) for i in range(30)] + [(30, None), (31, [1.0, 1.0]), (32, [5.0] * 4), (33, [1.0, None, 1.0]), (None, [0.0] * 3)]
    q, t = spark.createDataFrame(asked, "query_id long, v array<double>"), spark.createDataFrame(known, "train_id long, w array<double>")
    histogram = lambda a, b: 0.0 if not sum(a) * sum(b) else math.sqrt(max(0.0, 1 - sum(math.sqrt(x * y) for x, y in zip(a, b)) / math.sqrt(sum(a) * sum(b))))
    for matrix, plain in ((joins.euclidean_matrix, math.dist), (joins.bhattacharyya_matrix, histogram)):
        found = joins.nearest_neighbours(q, t, matrix, "v", "w", ["query_id"], ["train_id"], 5)
        want = {}
        for i, v in asked:
            if v is not None and None not in v:
                near = sorted((plain(v, w), j) for j, w in known if w is not None and None not in w and len(w) == len(v))[:5]
                want |= {(i, rank + 1): (j, pytest.approx(d, abs=1e-12)) for rank, (d, j) in enumerate(near)}
        assert {(x.query_id, x["rank"]): (x.train_id, x.distance) for x in found.collect()} == want
        assert joins.nearest_neighbours(q, t.limit(0), matrix, "v", "w", ["query_id"], ["train_id"]).count() == 0


def test_zip_keeps_the_first_channel(spark):
    a, b = series(spark, [1, 2, 3], "value"), series(spark, [7], "value")
    rows = joins.zip_join({"x": a, "y": b}, BY, ORDER).orderBy("pos").collect()
    assert [(r.x, r.y) for r in rows] == [(1, 7), (2, None), (3, None)]


# ---- recursions and models


def test_gate_compares_with_the_last_accepted():
    p = [(17.0, 78.0), (17.001, 78.0), (17.00001, 78.0), (17.0012, 78.0)]
    assert recursive.accepted(p) == [True, False, True, False]
    assert recursive.throttled([0, 5, 10, 11, 30], 10) == [True, False, False, True, True]
    assert recursive.low_pass([2, 4]) == [2, 3] and recursive.high_pass([2, 4, 4]) == pytest.approx([0, 1.7, 1.445])


def test_state_crosses_batches_but_not_tracks(spark):
    r = random.Random(2)
    rows = [(k, t, r.uniform(0, 9)) for k in ["a", None, "c", "d"] for t in range(37)] + [("e", 0, 1.0)]
    df = spark.createDataFrame([(*x, None if x[1] % 3 else 2**62 + 1) for x in r.sample(rows, len(rows))], "k string, t long, v double, big long")
    want = {}
    for k in ["a", None, "c", "d", "e"]:
        own = sorted((t, v) for g, t, v in rows if g == k)
        want |= {(k, t): y for (t, _), y in zip(own, recursive.low_pass([v for _, v in own]))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 10, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out = recursive.low_pass_filter(df, BY, ORDER, "v", "low")
            assert out.columns == ["k", "t", "v", "big", "low"] and {(x.k, x.t): x.low for x in out.collect()} == want
            assert {x.big for x in out.collect()} == {None, 2**62 + 1}
            assert recursive.low_pass_filter(df.limit(0), BY, ORDER, "v", "low").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def kalman_matrices(z, sd):
    f = np.eye(6)
    f[:3, 3:] = np.eye(3)
    h = np.eye(3, 6)
    x, p, out = np.array([*z[0], 0, 0, 0]), np.eye(6) * 0.1, []
    for i in range(len(z)):
        if i:
            x, p = f @ x, f @ p @ f.T + np.eye(6) * 0.01
        y = z[i] - h @ x
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(sd[i] ** 2))
        norm = np.linalg.norm(y)
        k = k / norm if norm > 1 else k
        x, p = x + k @ y, (np.eye(6) - k @ h) @ p
        out.append(x)
    return np.array(out)


def test_kalman_is_the_matrix_filter():
    r = np.random.default_rng(0)
    z = np.cumsum(r.normal(0, [1e-4, 1e-4, 2.0], (60, 3)), axis=0) + [17, 78, 500]
    sd = r.uniform(0.3, 2, (60, 3))
    whole, _ = models.kalman_steps(z.tolist(), sd.tolist())
    assert np.array(whole) == pytest.approx(kalman_matrices(z, sd), rel=1e-9, abs=1e-9)
    first, state = models.kalman_steps(z[:23].tolist(), sd[:23].tolist())
    assert first + models.kalman_steps(z[23:].tolist(), sd[23:].tolist(), state)[0] == whole


def test_particles_follow_the_fixes():
    fixes = np.column_stack([17 + np.arange(40) * 1e-5, np.full(40, 78.0)])
    sigma = np.full(40, 0.75)
    a, ca, _ = models.particle_steps(fixes, sigma, 7)
    b, cb, state = models.particle_steps(fixes[:11], sigma[:11], 7)
    rest, more, _ = models.particle_steps(fixes[11:], sigma[11:], 7, state=state)
    b, cb = np.concatenate([b, rest]), np.concatenate([cb, more])
    assert (a == b).all() and (ca == cb).all() and np.abs(a - fixes).max() * 111_000 < 6 and (ca > 0).all()


def test_particles_are_weighed_as_plain_python():
    """The same draws, weighed and moved one particle at a time."""
    n, sigma = 30, 0.75
    fixes = [(17 + i * 1e-5, 78 + (i % 3) * 2e-5) for i in range(12)] + [(17.5, 78.0)]
    draws = np.random.default_rng(5)
    cloud = [(fixes[0][0] + a * sigma / 111_000, fixes[0][1] + b * sigma / 111_000) for a, b in draws.standard_normal((n, 2))]
    want, last = [], None
    for fix in fixes:
        cloud = [(a + x * 1.5 / 111_000 * 0.5, b + y * 1.5 / 111_000 * 0.5) for (a, b), (x, y) in zip(cloud, draws.standard_normal((n, 2)))]
        weight = [math.exp(-(recursive.metres(*c, *fix) ** 2) / (2 * sigma**2)) for c in cloud]
        if last:
            weight = [w * math.exp(-(max(0.0, recursive.metres(*c, *last) - 1.5) ** 2)) for w, c in zip(weight, cloud)]
        weight = [w / sum(weight) for w in weight] if sum(weight) > 0 else [1 / n] * n
        confidence = max(weight)
        if confidence > 0.01:
            edges = np.cumsum(np.array(weight) / sum(weight))
            cloud = [cloud[min(n - 1, int(np.searchsorted(edges / edges[-1], u, side="right")))] for u in draws.random(n)]
        else:
            cloud = [(fix[0] + a * sigma / 111_000, fix[1] + b * sigma / 111_000) for a, b in draws.standard_normal((n, 2))]
        last = tuple(np.mean(cloud, axis=0))
        want.append((*last, confidence))
    found, confidence, _ = models.particle_steps(np.array(fixes), np.full(len(fixes), sigma), 5, n)
    assert np.column_stack([found, confidence]) == pytest.approx(np.array(want), rel=1e-9, abs=1e-12)


def best_path(candidates, epochs):
    score = lambda path: sum(e for _, e in path) + sum(0.0 if a[0] == b[0] or a[0][1] == b[0][0] else math.log(0.01) for a, b in zip(path, path[1:]))
    return max(score(p) for p in itertools.product(*[candidates[t] for t in range(epochs)]))


@pytest.mark.parametrize("seed", range(15))
def test_viterbi_is_the_best_path(seed):
    r = random.Random(seed)
    states = [(u, v, 0) for u in range(3) for v in range(3)]
    candidates = {t: [(s, r.uniform(-8, 0)) for s in r.sample(states, r.randint(1, 4))] for t in range(5)}
    path = models.decode(candidates, 5)
    own = [(s, dict(candidates[t])[s]) for t, s in enumerate(path)]
    score = sum(e for _, e in own) + sum(0.0 if a[0] == b[0] or a[0][1] == b[0][0] else math.log(0.01) for a, b in zip(own, own[1:]))
    assert score == pytest.approx(best_path(candidates, 5))


def test_viterbi_without_candidates():
    assert models.decode({}, 3) == [None, None, None]
    assert models.decode({1: [((1, 2, 0), -1.0)]}, 3) == [None, (1, 2, 0), (1, 2, 0)]
    assert models.decode({}, 0) == []


def test_lane_match_prefers_the_heading(spark):
    points = spark.createDataFrame([("a", i, 10.0 * i, 1.0, 90.0) for i in range(5)], "k string, epoch long, x double, y double, heading double")
    edges = spark.createDataFrame([(1, 2, 0, -5.0, 0.0, 60.0, 0.0), (2, 1, 0, 60.0, 0.0, -5.0, 0.0)], "u long, v long, key long, x1 double, y1 double, x2 double, y2 double")
    got = models.lane_match(points, edges, BY).orderBy("epoch").collect()
    assert [(r.u, r.v, r.snap_y) for r in got] == [(1, 2, 0.0)] * 5 and got[3].snap_x == pytest.approx(30.0)


def test_viterbi_keeps_ties_and_gaps_as_the_plain_recursion():
    def plain(candidates, epochs):
        scores = []
        for t in range(epochs):
            before, row = scores[-1] if scores else {}, {}
            for s, e in candidates.get(t, []):
                ways = [(-(p + (0.0 if s == b or b[1] == s[0] else math.log(0.01))), b) for b, (p, _) in before.items()]
                best, prev = min(ways, default=(0.0, None))
                row[s] = (e - best, prev)
            scores.append(row or {s: (p, s) for s, (p, _) in before.items()})
        state, path = min(((-p, s) for s, (p, _) in (scores[-1] if scores else {}).items()), default=(0, None))[1], [None] * epochs
        for t in range(epochs - 1, -1, -1):
            if state is None:
                break
            path[t], state = state, scores[t][state][1]
        return path

    r = random.Random(1)
    for _ in range(300):
        states = sorted({(r.randrange(4), r.randrange(4), r.randrange(2)) for _ in range(12)})
        candidates = {t: [(s, float(r.randint(-6, 0))) for s in r.sample(states, r.randint(1, len(states)))] for t in range(8) if r.random() < 0.8}
        assert models.decode(candidates, 8) == plain(candidates, 8)


def test_lane_match_by_held_edges_and_by_join(spark, monkeypatch):
    r = random.Random(3)
    points = [(f"k{i % 3}", i // 3, r.uniform(0, 900), r.uniform(0, 900), r.choice([None, r.uniform(0, 360)])) for i in range(90)]
    points[4] = ("k1", 1, None, 5.0, 0.0)
    ends = [(float(x), float(y), float(x + r.randint(-80, 80)), float(y + r.randint(-80, 80))) for x, y in ((r.randint(0, 900), r.randint(0, 900)) for _ in range(60))]
    edges = [(u, u + 1, 0, *ends[u % 60]) for u in range(300)] + [(7, 9, 1, *ends[5]), (999, 1, 0, None, 1.0, 2.0, 3.0)]
    p = spark.createDataFrame(points, "k string, epoch long, x double, y double, heading double")
    e = spark.createDataFrame(edges, "u long, v long, key long, x1 double, y1 double, x2 double, y2 double")
    flat = lambda df: sorted([tuple(x)[:5] + (round(x.snap_x, 9), round(x.snap_y, 9)) for x in df.collect()])
    held = models.lane_match(p, e, BY)
    got = flat(held)
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(models, "HELD_EDGES", 10, raising=False)
    assert got == flat(models.lane_match(p, e, BY)) and len(got) > 80


def test_roads_are_sampled_by_distance():
    step = 1 / 111_194.93
    assert models.sampled([(i * 3 * step, 0.0) for i in range(6)], 5.0)[0] == [False, False, True, False, True, False]


# ---- reports


def test_order_statistics(spark):
    v = [9.0, 1.0, 5.0, 7.0, 3.0, 8.0]
    got = report.place_stats(series(spark, v), BY, "v", {"a": report.floor_p95(), "b": report.clamped_p95(), "c": report.upper_median(), "d": report.upper_p90()}).first()
    s, n = sorted(v), len(v)
    assert (got.a, got.b, got.c, got.d) == (s[math.floor(0.95 * (n - 1))], s[max(0, int(0.95 * n) - 1)], s[n // 2], s[int(0.9 * n)])


def test_histogram_edges(spark):
    v = [0, 0.49, 0.5, 14.99, 15, 15.01, -1]
    got = {r.bin: r.n for r in report.histogram(series(spark, v), BY, "v", 0.5, 15.0).collect()}
    assert got == {0: 2, 1: 1, 29: 2}


def test_ranks_are_a_sort(spark):
    r = random.Random(0)
    rows = [(k, i, r.choice([0.0, 1.0, 5.0, r.uniform(0, 1e6)])) for k in "ab" for i in range(300)] + [("c", 0, 3.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(x.k, x.t): (x.rank, x.rank_of) for x in report.ranked(df, ["k"], ["v", "t"]).collect()}
    for k in "abc":
        own = sorted((v, t) for g, t, v in rows if g == k)
        assert all(got[k, t] == (i + 1, len(own)) for i, (_, t) in enumerate(own))


def test_audit(spark):
    bad = spark.createDataFrame([(1.0, 200.0, 5)], "lat double, lon double, milli long")
    got = {r.name: r.ok for r in report.audit(bad).collect()}
    assert got == {"fields": False, "rows": True, "latitude": True, "longitude": False, "time": True}
    assert not {r.name: r.ok for r in report.audit(bad.limit(0)).collect()}["rows"]


def test_result_does_not_depend_on_partitions(spark):
    r = random.Random(3)
    t = track(spark, [(17 + r.uniform(0, 1e-4), 78 + r.uniform(0, 1e-4)) for _ in range(60)])
    a, b = (column(smooth.clean_track(x, BY, ORDER), "lat_s") for x in (t.repartition(1), t.repartition(7)))
    assert a == b
