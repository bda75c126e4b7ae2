"""Queries of windows, gates, smoothers, recursions and reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.functions.geo import local_xy, rms3
from trajspark.functions.text import spike_colour
from trajspark.operators import models as M
from trajspark.operators import recursive as V
from trajspark.operators import report as P
from trajspark.operators import robust as R
from trajspark.operators import smooth as S
from trajspark.operators import windows as W
from trajspark.plans.driver_views import BY, ORDER, TRACK_SQL, WALK_SQL, hav_sql, steps_sql, track, walk
from trajspark.plans.registry import query, r6

W_SQL = "OVER (PARTITION BY user_id ORDER BY us, event_id)"


def steps(spark, sf_dir, source=track):
    return W.step_distance(source(spark, sf_dir), BY, ORDER)


@query(f"WITH {TRACK_SQL}, {steps_sql()} SELECT event_id, round(step, 4) AS step, CASE WHEN step > 5 THEN 'red' WHEN step > 3 THEN 'black' ELSE 'gray' END AS colour FROM steps")
def step_distance(spark, sf_dir):
    """F1, D15, C12."""
    return steps(spark, sf_dir).select("event_id", F.round("step", 4).alias("step"), spike_colour(F.col("step")).alias("colour"))


VELOCITY_SQL = f"""{TRACK_SQL}, {steps_sql()}, k AS (
  SELECT *, coalesce((us - lag(us) {W_SQL}) / 1000000.0e0, 0) AS dt FROM steps), kin AS (
  SELECT *, CASE WHEN dt > 0 THEN step / dt ELSE 0 END AS velocity FROM k), accel AS (
  SELECT *, CASE WHEN dt > 0 AND i > 2 THEN abs(velocity - lag(velocity) {W_SQL}) / dt END AS accel FROM kin)"""


@query(f"WITH {VELOCITY_SQL} SELECT event_id, dt, round(velocity, 6) AS velocity, round(coalesce(accel, -1), 6) AS accel FROM accel")
def velocity_accel(spark, sf_dir):
    """F2, F16."""
    k = W.kinematics(steps(spark, sf_dir), BY, ORDER, "us")
    return k.select("event_id", "dt", r6("velocity"), r6(F.coalesce("accel", F.lit(-1.0)), "accel"))


@query(f"WITH {VELOCITY_SQL} SELECT coalesce(CASE WHEN velocity > 40 THEN 'velocity' WHEN accel > 0.05 THEN 'accel' END, 'kept') AS reason, count(*) AS n FROM accel GROUP BY ALL")
def kinematic_filter(spark, sf_dir):
    """C20."""
    k = W.kinematics(steps(spark, sf_dir), BY, ORDER, "us")
    reason = R.kinematic_reason(F.col("velocity"), F.col("accel"), 40.0, 0.05)
    return k.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


HEADING_SQL = f"""{TRACK_SQL}, h AS (SELECT *, radians(lead(lon) {W_SQL} - lon) * 6378137.0e0 * cos(radians(lat)) AS dx, radians(lead(lat) {W_SQL} - lat) * 6378137.0e0 AS dy FROM track),
g AS (SELECT *, fmod(degrees(atan2(dx, dy)) + 360, 360) AS ahead FROM h), headed AS (SELECT *, coalesce(ahead, lag(ahead) {W_SQL}) AS heading, row_number() {W_SQL} - 1 AS epoch FROM g)"""


@query(f"WITH {HEADING_SQL} SELECT event_id, round(coalesce(heading, -1), 5) AS heading FROM headed")
def heading(spark, sf_dir):
    """F11, I13."""
    return W.heading(track(spark, sf_dir), BY, ORDER).select("event_id", F.round(F.coalesce("heading", F.lit(-1.0)), 5).alias("heading"))


@query(f"""WITH {TRACK_SQL}, {steps_sql()} SELECT user_id, count(*) AS n, round(avg(step), 4) AS mean_step, round(quantile_cont(step, 0.5), 4) AS median_step, round(quantile_cont(step, 0.95), 4) AS p95_step, round(max(step), 4) AS max_step,
count(*) FILTER (WHERE step > 3) AS gt3, count(*) FILTER (WHERE step > 5) AS gt5, count(*) FILTER (WHERE step > 10) AS gt10 FROM steps WHERE i > 1 GROUP BY user_id""")
def step_stats_linear(spark, sf_dir):
    """E7, E7e."""
    s = W.step_distance(track(spark, sf_dir), BY, ORDER, first=None).filter("step IS NOT NULL")
    rounded = [F.round(c, 4).alias(c) for c in ("mean_step", "median_step", "p95_step", "max_step")]
    return P.step_stats(s, BY).select("user_id", "n", *rounded, *[f"gt{m}" for m in P.LIMITS])


def _places(sql_place: str, name: str) -> str:
    return f"""WITH {TRACK_SQL}, {steps_sql()}, r AS (SELECT user_id, step, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS k FROM steps WHERE i > 1)
SELECT user_id, max(n) AS n, {name} FROM r GROUP BY user_id""".replace("PLACE", sql_place)


@query(_places("floor(0.95e0 * (n - 1))", "round(max(step) FILTER (WHERE k = PLACE), 4) AS p95"))
def step_stats_floor(spark, sf_dir):
    """E7b."""
    s = W.step_distance(track(spark, sf_dir), BY, ORDER, first=None).filter("step IS NOT NULL")
    return P.place_stats(s, BY, "step", {"p95": P.floor_p95()}).select("user_id", "n", F.round("p95", 4).alias("p95"))


@query(_places("greatest(0, floor(0.95e0 * n)::BIGINT - 1)", "round(max(step) FILTER (WHERE k = PLACE), 4) AS p95"))
def step_stats_clamped(spark, sf_dir):
    """E7c."""
    s = W.step_distance(track(spark, sf_dir), BY, ORDER, first=None).filter("step IS NOT NULL")
    return P.place_stats(s, BY, "step", {"p95": P.clamped_p95()}).select("user_id", "n", F.round("p95", 4).alias("p95"))


@query(_places("", "round(max(step) FILTER (WHERE k = n // 2), 4) AS median, round(max(step) FILTER (WHERE k = floor(0.9e0 * n)::BIGINT), 4) AS p90"))
def step_stats_upper(spark, sf_dir):
    """E7d, G7."""
    s = W.step_distance(track(spark, sf_dir), BY, ORDER, first=None).filter("step IS NOT NULL")
    found = P.place_stats(s, BY, "step", {"median": P.upper_median(), "p90": P.upper_p90()})
    return found.select("user_id", "n", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query("SELECT event_type, least(floor(value / 0.5e0)::INT, 29) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 15 GROUP BY ALL")
def step_histogram(spark, sf_dir):
    """E8, C26."""
    return P.histogram(track(spark, sf_dir), ["event_type"], "value", 0.5, 15.0)


@query("SELECT event_id, 100.0e0 * row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type) AS percent, 100.0e0 * (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) / count(*) OVER (PARTITION BY event_type) AS percent0 FROM events")
def step_ecdf(spark, sf_dir):
    """E9."""
    one = P.ecdf(track(spark, sf_dir), ["event_type"], ["value", "event_id"])
    return P.ecdf(one, ["event_type"], ["value", "event_id"], 0, "percent0").select("event_id", "percent", "percent0")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS beyond FROM events JOIN q USING (event_type) GROUP BY ALL""")
def boxplot_summary(spark, sf_dir):
    """E10."""
    return P.box_summary(track(spark, sf_dir), ["event_type"], "value").select("event_type", r6("q1"), r6("q2"), r6("q3"), "low", "high", "beyond")


@query(f"WITH {TRACK_SQL}, {steps_sql()} SELECT user_id, round(sum(step), 3) AS length, count(*) AS points FROM steps GROUP BY user_id")
def path_length(spark, sf_dir):
    """E13."""
    return P.path_length(steps(spark, sf_dir), BY).select("user_id", F.round("length", 3).alias("length"), "points")


@query(f"WITH {TRACK_SQL} SELECT user_id, round(avg(lat), 7) AS centre_lat, round(avg(lon), 7) AS centre_lon, round(min(lat) - 0.001, 7) AS south, round(min(lon) - 0.001, 7) AS west, round(max(lat) + 0.001, 7) AS north, round(max(lon) + 0.001, 7) AS east FROM track GROUP BY user_id")
def track_bounds(spark, sf_dir):
    """E14, H6."""
    b = P.bounds(track(spark, sf_dir), BY)
    return b.select("user_id", *[F.round(c, 7).alias(c) for c in b.columns if c != "user_id"])


@query(f"WITH {TRACK_SQL} SELECT user_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, round(min(lat), 7) AS min_lat, round(max(lat), 7) AS max_lat, round(avg(sdn), 7) AS mean_accuracy FROM track GROUP BY user_id")
def range_summary(spark, sf_dir):
    """E17."""
    r = P.range_summary(track(spark, sf_dir), BY, "us", "sdn")
    return r.select("user_id", "n", "first_us", "last_us", *[F.round(c, 7).alias(c) for c in ("min_lat", "max_lat", "mean_accuracy")])


MAD_SQL = f"""{TRACK_SQL}, {steps_sql()}, med AS (SELECT user_id, quantile_cont(step, 0.5) AS m, quantile_cont(sqrt(sdn * sdn + sde * sde + sdu * sdu), 0.5) AS rm FROM steps GROUP BY 1),
lim AS (SELECT s.user_id, m + 3.0e0 * 1.4826e0 * quantile_cont(abs(step - m), 0.5) AS step_limit, rm + 3.0e0 * 1.4826e0 * quantile_cont(abs(sqrt(sdn * sdn + sde * sde + sdu * sdu) - rm), 0.5) AS rms_limit FROM steps s JOIN med USING (user_id) GROUP BY s.user_id, m, rm)"""


@query(f"WITH {MAD_SQL} SELECT user_id, round(step_limit, 4) AS step_limit, count(*) FILTER (WHERE step > step_limit) AS outliers FROM steps JOIN lim USING (user_id) GROUP BY ALL")
def mad_outliers(spark, sf_dir):
    """C21."""
    o = R.mad_outliers(steps(spark, sf_dir), BY, "step")
    return o.groupBy("user_id", F.round("step_limit", 4).alias("step_limit")).agg(F.count_if("outlier").alias("outliers"))


@query(f"WITH {MAD_SQL} SELECT event_id FROM steps JOIN lim USING (user_id) WHERE NOT (sqrt(sdn * sdn + sde * sde + sdu * sdu) > rms_limit OR step > step_limit)")
def raim_gate(spark, sf_dir):
    """C22, I19."""
    s = steps(spark, sf_dir).withColumn("rms", rms3(F.col("sdn"), F.col("sde"), F.col("sdu")))
    return R.integrity_gate(s, BY).filter(~F.col("excluded")).select("event_id")


SPIKE_SQL = f"""{WALK_SQL}, {steps_sql('walk')}, q AS (SELECT user_id, quantile_cont(step, 0.25) AS q1, quantile_cont(step, 0.75) AS q3, count(*) + 1 AS n FROM steps WHERE i > 1 GROUP BY 1),
sp AS (SELECT steps.*, coalesce(i > 1 AND n >= 4 AND step > q3 + 0.5e0 * (q3 - q1), false) AS spike FROM steps LEFT JOIN q USING (user_id))"""


@query(f"WITH {SPIKE_SQL} SELECT user_id, count(*) FILTER (WHERE spike) AS spikes FROM sp GROUP BY user_id")
def iqr_spikes(spark, sf_dir):
    """C23."""
    return R.iqr_spikes(steps(spark, sf_dir, walk), BY, ORDER, multiple=0.5).groupBy("user_id").agg(F.count_if("spike").alias("spikes"))


def filled_sql(keep: str, source: str, columns: str, edges: bool) -> str:
    """CTEs pk and nk: the kept rows before and after, by place."""
    w = "PARTITION BY user_id ORDER BY us, event_id"
    cols = columns.split(",")
    picks = ", ".join(f"last_value(CASE WHEN {keep} THEN {c} END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS p_{c}, first_value(CASE WHEN {keep} THEN {c} END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{c}" for c in ["seq", *cols])
    beyond = "coalesce(p_{0}, n_{0}, {0})" if edges else "{0}"
    value = ", ".join(f"CASE WHEN {keep} THEN {c} WHEN p_seq IS NOT NULL AND n_seq IS NOT NULL THEN p_{c} + (seq - p_seq) / (n_seq - p_seq)::DOUBLE * (n_{c} - p_{c}) ELSE {beyond.format(c)} END AS f_{c}" for c in cols)
    return f"numbered AS (SELECT *, row_number() OVER ({w}) AS seq FROM {source}), around AS (SELECT *, {picks} FROM numbered), filled AS (SELECT *, {value} FROM around)"


@query(f"WITH {SPIKE_SQL}, {filled_sql('NOT spike', 'sp', 'lat,lon', False)} SELECT event_id, round(f_lat, 12) AS lat, round(f_lon, 12) AS lon FROM filled")
def spike_interpolate(spark, sf_dir):
    """K16, F9, C23."""
    s = S.spike_interpolate(steps(spark, sf_dir, walk), BY, ORDER, 0.5)
    return s.select("event_id", F.round("lat", 12).alias("lat"), F.round("lon", 12).alias("lon"))


@query(f"WITH {TRACK_SQL}, {filled_sql('event_id % 3 <> 0', 'track', 'height', True)} SELECT event_id, round(f_height, 8) AS height, event_id % 3 = 0 AS interpolated FROM filled")
def gap_interpolate(spark, sf_dir):
    """F8, I30."""
    t = track(spark, sf_dir).withColumn("keep", F.col("event_id") % 3 != 0)
    return S.gap_interpolate(t, BY, ORDER, ["height"]).select("event_id", F.round("height", 8).alias("height"), "interpolated")


CLIP_SQL = f"""{TRACK_SQL}, m AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM track GROUP BY 1), d AS (SELECT t.user_id, med, quantile_cont(abs(value - med), 0.5) AS mad FROM track t JOIN m USING (user_id) GROUP BY t.user_id, med),
clipped AS (SELECT t.* FROM track t JOIN d USING (user_id) WHERE abs(value - med) < 3.0e0 * 1.4826e0 * mad)"""


@query(f"WITH {CLIP_SQL} SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS middle FROM clipped GROUP BY user_id")
def sigma_clip_median(spark, sf_dir):
    """C25, E15."""
    return R.sigma_clip(track(spark, sf_dir), BY, "value").groupBy("user_id").agg(F.count("*").alias("n"), r6(R.trimmed_median(F.col("value")), "middle"))


@query(f"""WITH {TRACK_SQL} SELECT event_id, round(list_sort(list(value) OVER w)[len(list(value) OVER w) // 2 + 1], 6) AS middle FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_upper_median(spark, sf_dir):
    """F4."""
    return W.rolling_upper_median(track(spark, sf_dir), BY, ORDER, "value", 2, "middle").select("event_id", "middle")


@query(f"WITH {TRACK_SQL} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS mean FROM track")
def moving_average(spark, sf_dir):
    """F5."""
    return W.moving_average(track(spark, sf_dir), BY, ORDER, "value", 3, "mean").select("event_id", F.round("mean", 5).alias("mean"))


def gaussian_value_sql(half: int, edge: str, values: str = "a", alone: str = "value") -> str:
    """The smoothed value at place seq of n, from the list of a track's values."""
    terms = []
    for j, w in zip(range(-half, half + 1), W.gaussian_weights(half), strict=True):
        at = f"(seq + {j})"
        if edge == "reflect":
            at = f"CASE WHEN seq + {j} < 1 THEN 1 - (seq + {j}) WHEN seq + {j} > n THEN 2 * n + 1 - (seq + {j}) ELSE seq + {j} END"
        terms.append(f"{w!r} * {values}[greatest(1, least(n, {at}))]")
    least = 3 if edge == "reflect" else 2 * half + 1
    return f"CASE WHEN n < {least} THEN {alone} ELSE {' + '.join(terms)} END"


def _gaussian_sql(half: int, edge: str) -> str:
    return f"""WITH {TRACK_SQL}, l AS (SELECT user_id, list(value ORDER BY us, event_id) AS a, count(*) AS n FROM track GROUP BY 1), s AS (SELECT user_id, event_id, value, row_number() {W_SQL} AS seq FROM track)
SELECT event_id, round({gaussian_value_sql(half, edge)}, 6) AS smooth FROM s JOIN l USING (user_id)"""


@query(_gaussian_sql(3, "reflect"))
def gaussian_smooth_reflect(spark, sf_dir):
    """F6."""
    return W.gaussian_smooth(track(spark, sf_dir), BY, ORDER, "value", 3, "reflect", "smooth").select("event_id", r6("smooth"))


@query(_gaussian_sql(5, "clamp"))
def gaussian_smooth_clamp(spark, sf_dir):
    """F7."""
    return W.gaussian_smooth(track(spark, sf_dir), BY, ORDER, "value", 5, "clamp", "smooth").select("event_id", r6("smooth"))


CLEAN_SQL = f"""{WALK_SQL}, first AS (SELECT *, first_value(lat) {W_SQL} AS lat0, first_value(lon) {W_SQL} AS lon0 FROM walk),
xy AS (SELECT *, radians(lon - lon0) * 6378137.0e0 * cos(radians(lat0)) AS x, radians(lat - lat0) * 6378137.0e0 AS y FROM first),
flag AS (SELECT *, coalesce(sqrt(pow(x - lag(x) {W_SQL}, 2) + pow(y - lag(y) {W_SQL}, 2)) <= 9.0e0, true) AS keep FROM xy), {filled_sql('keep', 'flag', 'x,y', True)},
med AS (SELECT user_id, event_id, us, keep, lat0, lon0, list_sort(list(f_x) OVER w)[len(list(f_x) OVER w) // 2 + 1] AS mx, list_sort(list(f_y) OVER w)[len(list(f_y) OVER w) // 2 + 1] AS my FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
smooth AS (SELECT event_id, keep, lat0, lon0, avg(mx) OVER v AS sx, avg(my) OVER v AS sy FROM med WINDOW v AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


@query(f"WITH {CLEAN_SQL} SELECT event_id, NOT keep AS interpolated, round(lat0 + degrees(sy / 6378137.0e0) + 3.3e-11, 9) AS lat_s, round(lon0 + degrees(sx / (6378137.0e0 * cos(radians(lat0)))) + 3.3e-11, 9) AS lon_s FROM smooth")
def clean_trajectory(spark, sf_dir):
    """K9, K10, C24, F8, F4, F5, I9. The small shift keeps interpolated values off the rounding's ties."""
    c = S.clean_track(walk(spark, sf_dir), BY, ORDER, 9.0)
    return c.select("event_id", "interpolated", F.round(F.col("lat_s") + 3.3e-11, 9).alias("lat_s"), F.round(F.col("lon_s") + 3.3e-11, 9).alias("lon_s"))


@query(f"WITH {TRACK_SQL} SELECT event_id, round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 5) AS deviation FROM track")
def trailing_time_stddev(spark, sf_dir):
    """F12, J3."""
    return W.trailing_time(track(spark, sf_dir), BY, "us", "value", 86_400.0).select("event_id", F.round("deviation", 5).alias("deviation"))


@query(f"""WITH {WALK_SQL}, {steps_sql('walk')}, run AS (SELECT *, round(sum(step) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 3) AS run FROM steps)
SELECT event_id, round(sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY run RANGE BETWEEN 100 PRECEDING AND CURRENT ROW)), 5) AS rms FROM run""")
def trailing_distance_window(spark, sf_dir):
    """F13, F18, J4. Distances are rounded to millimetres so that both engines see the same window."""
    s = steps(spark, sf_dir, walk)
    found = W.trailing_distance(s, BY, ORDER, F.avg(F.col("value") * F.col("value")), 100.0, decimals=3)
    return found.select("event_id", F.round(F.sqrt("trailing"), 5).alias("rms"))


@query(f"WITH {TRACK_SQL} SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island, row_number() {W_SQL} - 1 AS epoch FROM track")
def gaps_islands(spark, sf_dir):
    """F14, F15."""
    t = W.islands(track(spark, sf_dir), BY, ORDER, F.col("event_type") == "signup")
    return W.epoch_index(t, BY, ORDER).select("event_id", "island", "epoch")


@query(f"WITH {TRACK_SQL} SELECT event_id, (event_type IS DISTINCT FROM lag(event_type) {W_SQL}) AS changed FROM track")
def change_detection(spark, sf_dir):
    """C17, J7."""
    return W.changed(track(spark, sf_dir), BY, ORDER, ["event_type"]).select("event_id", "changed")


@query(f"WITH {TRACK_SQL} SELECT user_id, arg_min(event_id, (us, event_id)) AS first_event_id, arg_max(event_id, (us, event_id)) AS last_event_id FROM track GROUP BY user_id")
def track_ends(spark, sf_dir):
    """F17."""
    return W.ends(track(spark, sf_dir), BY, ORDER, ["event_id"])


def _recursive_sql(first: str, step: str, source: str = "track", cte: str = TRACK_SQL) -> str:
    return f"""WITH RECURSIVE {cte}, n AS (SELECT *, row_number() {W_SQL} AS i FROM {source}), r AS (
  SELECT user_id, event_id, i, value, us, lat, lon, {first} FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.event_id, n.i, n.value, n.us, n.lat, n.lon, {step} FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)"""


@query(_recursive_sql("value AS y", "0.5e0 * n.value + (1 - 0.5e0) * r.y") + " SELECT event_id, y AS low FROM r")
def lowpass_ema(spark, sf_dir):
    """Unrounded values agree."""
    return V.low_pass_filter(track(spark, sf_dir).select("user_id", "us", "event_id", "value"), BY, ORDER, "value", "low").select("event_id", "low")


@query(_recursive_sql("0.0e0 AS y", "0.85e0 * (r.y + n.value - r.value)") + " SELECT event_id, y AS high FROM r")
def highpass(spark, sf_dir):
    """Unrounded values agree."""
    return V.high_pass_filter(track(spark, sf_dir).select("user_id", "us", "event_id", "value"), BY, ORDER, "value", "high").select("event_id", "high")


@query(_recursive_sql("lat AS la, lon AS lo, true AS kept", f"CASE WHEN {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8 THEN n.lat ELSE r.la END, CASE WHEN {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8 THEN n.lon ELSE r.lo END, {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8", "walk", WALK_SQL) + " SELECT event_id, kept FROM r")
def last_accepted_gate(spark, sf_dir):
    """J5."""
    w = walk(spark, sf_dir).select("user_id", "us", "event_id", "lat", "lon")
    return V.last_accepted_gate(w, BY, ORDER, 8.0).select("event_id", "kept")


@query(_recursive_sql("us AS last, true AS kept", "CASE WHEN n.us - 43200000000 > r.last THEN n.us ELSE r.last END, n.us - 43200000000 > r.last") + " SELECT event_id, kept FROM r")
def throttle(spark, sf_dir):
    """C27, J6."""
    return V.throttle(track(spark, sf_dir).select("user_id", "us", "event_id"), BY, ORDER, "us", 43_200_000_000).select("event_id", "kept")


METRICS = ["mean_step", "median_step", "p95_step", "max_step"]
STATS_SQL = "SELECT user_id, round(avg(step), 4) AS mean_step, round(quantile_cont(step, 0.5), 4) AS median_step, round(quantile_cont(step, 0.95), 4) AS p95_step, round(max(step), 4) AS max_step"


@query(f"WITH {TRACK_SQL}, {steps_sql()}, s AS ({STATS_SQL} FROM steps GROUP BY 1) UNPIVOT s ON mean_step, median_step, p95_step, max_step INTO NAME metric VALUE value".replace("WITH", "SELECT * FROM (WITH", 1) + ")")
def metrics_table(spark, sf_dir):
    """E11."""
    stats = P.step_stats(steps(spark, sf_dir), BY)
    return P.transposed(stats.select("user_id", *[F.round(m, 4).alias(m) for m in METRICS]), "user_id", METRICS)


@query(f"""WITH {TRACK_SQL}, {steps_sql()}, b AS (SELECT user_id, avg(step) AS v FROM steps GROUP BY 1), a AS (SELECT user_id, avg(step) AS v FROM steps WHERE event_id % 5 <> 0 GROUP BY 1)
SELECT user_id, 'mean_step' AS metric, round(b.v, 4) AS before, round(a.v, 4) AS after, round(b.v - a.v, 4) AS gain, round(100 * (b.v - a.v) / b.v, 4) AS gain_percent FROM b JOIN a USING (user_id)""")
def improvement_table(spark, sf_dir):
    """E12."""
    s = steps(spark, sf_dir)
    stats = lambda df: df.groupBy("user_id").agg(F.avg("step").alias("mean_step"))
    found = P.improvement(stats(s), stats(s.filter("event_id % 5 <> 0")), BY, ["mean_step"])
    return found.select("user_id", "metric", *[F.round(c, 4).alias(c) for c in ("before", "after", "gain", "gain_percent")])


@query("SELECT event_type, n, first_line FROM (SELECT event_type || user_id % 20 AS event_type, count(*) AS n, min(event_id) AS first_line FROM events GROUP BY 1) ORDER BY n DESC, first_line LIMIT 40")
def topn_frequency(spark, sf_dir):
    """G2, A17, E6."""
    t = track(spark, sf_dir)
    counts = t.groupBy(F.concat("event_type", F.col("user_id") % 20).alias("event_type")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_line"))
    return P.top_frequent(counts)


@query(f"""WITH {TRACK_SQL}, {steps_sql()}, s AS (SELECT event_type, count(*) FILTER (WHERE step > 60000) AS gt5, count(*) FILTER (WHERE step > 30000) AS gt3, quantile_cont(step, 0.95) AS p95_step, avg(step) AS mean_step FROM steps GROUP BY 1), b AS (SELECT * FROM s WHERE event_type = 'view')
SELECT s.event_type, round((b.gt5 - s.gt5) * 100.0e0 + (b.gt3 - s.gt3) * 10.0e0 + (b.p95_step - s.p95_step) * 5.0e0 + (b.mean_step - s.mean_step), 2) AS score FROM s, b WHERE s.event_type <> 'view' ORDER BY score DESC LIMIT 8""")
def exclusion_score_rank(spark, sf_dir):
    """E24, G3, K14."""
    stats = steps(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("step") > 60000).alias("gt5"), F.count_if(F.col("step") > 30000).alias("gt3"), F.percentile("step", F.lit(0.95)).alias("p95_step"), F.avg("step").alias("mean_step"))
    return P.top_scores(P.exclusion_scores(stats, "event_type", "view"), "event_type").select("event_type", F.round("score", 2).alias("score"))


@query(f"WITH {WALK_SQL} SELECT floor(round(radians(lon - 78.0e0) * 6378137.0e0 * cos(radians(17.0e0)), 6) / 2)::BIGINT AS cell_x, floor(round(radians(lat - 17.0e0) * 6378137.0e0, 6) / 2)::BIGINT AS cell_y, count(*) AS points, round(avg(value), 5) AS mean_value FROM walk GROUP BY ALL")
def grid_amalgamate(spark, sf_dir):
    """E25."""
    x, y = local_xy(F.col("lat"), F.col("lon"), F.lit(17.0), F.lit(78.0))
    flat = walk(spark, sf_dir).select(r6(x, "x"), r6(y, "y"), "value")
    return P.amalgamate(flat, "x", "y", "value").select("cell_x", "cell_y", "points", F.round("mean_value", 5).alias("mean_value"))


@query("SELECT event_type, floor(value % 180 * 30 / 180.0e0)::INT AS bin, count(*) AS n FROM events GROUP BY ALL")
def colour_histogram(spark, sf_dir):
    """E22."""
    return P.colour_histogram(track(spark, sf_dir).withColumn("hue", F.col("value") % 180), ["event_type"], "hue")


@query(f"""WITH {TRACK_SQL} SELECT unnest(['fields', 'rows', 'latitude', 'longitude', 'time']) AS name, unnest([true, count(*) > 0, min(lat) >= -90 AND max(lat) <= 90, min(lon) >= -180 AND max(lon) <= 180, min(us // 1000) <= max(us // 1000)]) AS ok,
unnest(['', count(*)::VARCHAR, count(lat)::VARCHAR, count(lon)::VARCHAR, count(DISTINCT us // 1000)::VARCHAR]) AS detail FROM track""")
def audit_checks(spark, sf_dir):
    """K15, C30, C31."""
    from trajspark.sources.sinks import ui_rows

    return P.audit(ui_rows(track(spark, sf_dir).withColumn("ts_ms", F.expr("us div 1000")), "lane", "snapped"))


def _kalman_sql() -> str:
    """CTE r: the filter's states x, v and covariances p, q, w of the axes a, b, c after each row."""
    axes = {"a": ("lat", "sdn"), "b": ("lon", "sde"), "c": ("height", "sdu")}
    each = lambda text: ", ".join(text.format(k=k, z=z, sd=sd) for k, (z, sd) in axes.items())
    first = each("{z} AS x_{k}, 0.0e0 AS v_{k}, (1 - 0.1e0 / (0.1e0 + {sd} * {sd})) * 0.1e0 AS p_{k}, 0.0e0 AS q_{k}, 0.1e0 AS w_{k}")
    ahead = each("r.x_{k} + r.v_{k} AS x_{k}, r.v_{k} AS v_{k}, r.p_{k} + 2 * r.q_{k} + r.w_{k} + 0.01e0 AS p_{k}, r.q_{k} + r.w_{k} AS q_{k}, r.w_{k} + 0.01e0 AS w_{k}")
    gain = each("g * p_{k} / s_{k} AS f_{k}, g * q_{k} / s_{k} AS h_{k}")
    after = each("x_{k} + f_{k} * y_{k}, v_{k} + h_{k} * y_{k}, (1 - f_{k}) * p_{k}, (1 - f_{k}) * q_{k}, w_{k} - h_{k} * q_{k}")
    return f"""WITH RECURSIVE {TRACK_SQL}, n AS (SELECT *, row_number() {W_SQL} AS i FROM track), r AS (
  SELECT user_id, event_id, i, lat, lon, height, {first} FROM n WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, lat, lon, height, {after} FROM (
    SELECT *, {gain} FROM (SELECT *, CASE WHEN norm > 1 THEN 1 / norm ELSE 1 END AS g FROM (SELECT *, sqrt(y_a * y_a + y_b * y_b + y_c * y_c) AS norm FROM (
      SELECT *, {each("{z} - x_{k} AS y_{k}, p_{k} + {sd} * {sd} AS s_{k}")} FROM (SELECT n.*, {ahead} FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))))))"""


def _filtered(spark, sf_dir):
    t = track(spark, sf_dir).select(*BY, *ORDER, "lat", "lon", "height", "sdn", "sde", "sdu")
    return M.robust_kalman(t, BY, ORDER)


STATES = {"f_lat": "x_a", "f_lon": "x_b", "f_height": "x_c", "v_lat": "v_a", "v_lon": "v_b", "v_height": "v_c"}


@query(_kalman_sql() + " SELECT event_id, " + ", ".join(f"round({x} + 3.3e-11, 6) + 0 AS {c}" for c, x in STATES.items()) + " FROM r")
def kalman_robust(spark, sf_dir):
    """K1, E23. The small shift keeps first rows off the rounding's ties."""
    return _filtered(spark, sf_dir).select("event_id", *[r6(F.col(c) + 3.3e-11, c) for c in STATES])


@query()
def particle_filter(spark, sf_dir):
    """K2."""
    w = walk(spark, sf_dir).select(*BY, *ORDER, "lat", "lon")
    return M.particle_filter(w, BY, ORDER).select("event_id", "p_lat", "p_lon", "confidence")


def _adaptive_sql() -> str:
    """CTE f: outliers, last first, become the mean of their neighbours (b), then, first first, the median of five."""
    axes = ("lat", "lon", "height")
    each = lambda text: ", ".join(text.format(k=k) for k in axes)
    w = "OVER (PARTITION BY user_id ORDER BY i)"
    return f"""WITH RECURSIVE {WALK_SQL}, {steps_sql('walk')}, m AS (SELECT user_id, quantile_cont(step, 0.5) AS med FROM steps GROUP BY 1),
d AS (SELECT s.user_id, med + 3.0e0 * 1.4826e0 * quantile_cont(abs(step - med), 0.5) AS most FROM steps s JOIN m USING (user_id) GROUP BY s.user_id, med),
n AS (SELECT user_id, event_id, i, lat, lon, height, step > most AS off, count(*) OVER (PARTITION BY user_id) AS n, {each(f"lag({{k}}) {w} AS before_{{k}}")} FROM steps JOIN d USING (user_id)),
b AS (SELECT user_id, event_id, i, off, n, {each("{k}")} FROM n WHERE i = n
  UNION ALL SELECT n.user_id, n.event_id, n.i, n.off, n.n, {each("CASE WHEN n.off AND n.i > 1 THEN (before_{k} + b.{k}) / 2 ELSE n.{k} END")} FROM b JOIN n ON n.user_id = b.user_id AND n.i = b.i - 1),
v AS (SELECT *, {each(f"lead({{k}}, 1) {w} AS one_{{k}}, lead({{k}}, 2) {w} AS two_{{k}}")} FROM b),
f AS (SELECT user_id, event_id, i, off, {each("{k}, NULL::DOUBLE AS last_{k}")} FROM v WHERE i = 1
  UNION ALL SELECT v.user_id, v.event_id, v.i, v.off, {each("CASE WHEN v.off AND v.i < v.n THEN list_median([f.last_{k}, f.{k}, v.{k}, one_{k}, two_{k}]) ELSE v.{k} END, f.{k}")} FROM f JOIN v ON v.user_id = f.user_id AND v.i = f.i + 1)"""


@query(_adaptive_sql() + " SELECT event_id, round(lat, 12) AS lat, round(lon, 12) AS lon, round(height, 9) AS height, off AS is_outlier FROM f")
def adaptive_median(spark, sf_dir):
    """K13, F10."""
    s = steps(spark, sf_dir, walk).select(*BY, *ORDER, "lat", "lon", "height", "step")
    found = S.adaptive_median(s, BY, ORDER)
    return found.select("event_id", F.round("lat", 12).alias("lat"), F.round("lon", 12).alias("lon"), F.round("height", 9).alias("height"), "is_outlier")


@query(f"WITH {WALK_SQL}, {steps_sql('walk')} SELECT user_id, '[' || string_agg(printf('[%.8f,%.8f]', lat, lon), ',' ORDER BY us, event_id) || ']' AS coords, round(min(lat), 8) AS south, round(max(lon), 8) AS east, count(*) AS points, round(sum(step), 3) AS length FROM steps GROUP BY user_id")
def map_layers(spark, sf_dir):
    """Eight decimals, at which the points have no rounding ties."""
    found = P.layers(steps(spark, sf_dir, walk), BY, ORDER, decimals=8)
    return found.select("user_id", "coords", F.round("south", 8).alias("south"), F.round("east", 8).alias("east"), "points", F.round("length", 3).alias("length"))


GATED_SQL = WALK_SQL + ", gated AS (SELECT * FROM walk WHERE q <= 5 AND ns >= 4 AND sdn <= 0.95 AND sde <= 0.75)"


@query(_recursive_sql("lat AS la, lon AS lo, true AS kept", f"CASE WHEN {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8 THEN n.lat ELSE r.la END, CASE WHEN {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8 THEN n.lon ELSE r.lo END, {hav_sql('r.la', 'r.lo', 'n.lat', 'n.lon')} <= 8", "gated", GATED_SQL) + " SELECT user_id, count(*) AS passed, count(*) FILTER (WHERE kept) AS kept FROM r GROUP BY user_id")
def solution_gates(spark, sf_dir):
    """Ordered gates [C9], then the velocity gate from the last accepted point [J5]."""
    from trajspark.operators.quality import reject_reason

    w = walk(spark, sf_dir).withColumn("reason", reject_reason(F.col("q"), F.col("ns"), F.col("sdn"), F.col("sde") + 0.2, max_deviation=0.95))
    kept = V.last_accepted_gate(w.filter("reason IS NULL").select("user_id", "us", "event_id", "lat", "lon"), BY, ORDER, 8.0)
    return kept.groupBy("user_id").agg(F.count("*").alias("passed"), F.count_if("kept").alias("kept"))


RESIDUAL_SQL = "greatest(abs(x_a - lat), abs(x_b - lon), abs(x_c - height))"


@query(_kalman_sql() + f" SELECT user_id, round(avg({RESIDUAL_SQL}), 6) AS mean_residual, round(quantile_cont({RESIDUAL_SQL}, 0.95), 6) AS p95_residual, round(max({RESIDUAL_SQL}), 6) AS max_residual FROM r GROUP BY user_id")
def kalman_residuals(spark, sf_dir):
    """E23."""
    found = M.filter_residuals(_filtered(spark, sf_dir), BY)
    return found.select("user_id", *[r6(c) for c in ("mean_residual", "p95_residual", "max_residual")])


UTM_SQL = f"""WITH {TRACK_SQL}, f AS (SELECT event_id, lat, lon, radians(lat) AS p, (floor((lon + 180) / 6) * 6 - 177) AS lon0, 1 / 298.257223563e0 * (2 - 1 / 298.257223563e0) AS e2 FROM track),
g AS (SELECT *, e2 / (1 - e2) AS ep2, 6378137.0e0 / sqrt(1 - e2 * pow(sin(p), 2)) AS n, pow(tan(p), 2) AS t, radians(lon - lon0) * cos(p) AS a,
  6378137.0e0 * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * p) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * p) - 35 * pow(e2, 3) / 3072 * sin(6 * p)) AS m FROM f),
h AS (SELECT *, ep2 * pow(cos(p), 2) AS c FROM g)"""


@query(UTM_SQL + """ SELECT event_id, round(0.9996e0 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(a, 5) / 120) + 500000, 3) AS easting,
round(0.9996e0 * (m + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pow(a, 6) / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing FROM h""")
def utm_projection(spark, sf_dir):
    """I12."""
    from trajspark.functions.geo import utm_xy

    x, y = utm_xy(F.col("lat"), F.col("lon"))
    return track(spark, sf_dir).select("event_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query(f"""WITH {TRACK_SQL} SELECT event_id, rank() OVER w AS place, dense_rank() OVER w AS dense_place, round(percent_rank() OVER w, 8) AS share,
ntile(4) OVER (PARTITION BY user_id ORDER BY height DESC, event_id) AS quarter FROM track WINDOW w AS (PARTITION BY user_id ORDER BY height DESC)""")
def height_ranks(spark, sf_dir):
    """each fix by height within its track; equal heights share a place, quarters go by event."""
    highest = Window.partitionBy(BY).orderBy(F.col("height").desc_nulls_last())
    return track(spark, sf_dir).select(
        "event_id", F.rank().over(highest).alias("place"), F.dense_rank().over(highest).alias("dense_place"),
        F.round(F.percent_rank().over(highest), 8).alias("share"), F.ntile(4).over(highest.orderBy(F.col("height").desc_nulls_last(), "event_id")).alias("quarter"),
    )


@query(f"WITH {TRACK_SQL} SELECT event_id, us, round(lat, 6) AS lat, round(lon, 6) AS lon, height FROM track ORDER BY us, event_id LIMIT 5")
def first_rows(spark, sf_dir):
    """A preview of the first 5 fixes by time; the limit is the feature, and a task sends 5 rows at most."""
    return track(spark, sf_dir).orderBy("us", "event_id").limit(5).select("event_id", "us", r6("lat"), r6("lon"), "height")
