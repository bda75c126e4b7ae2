"""Queries of joins, matchers and classifiers on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions.geo import segment_distance
from trajspark.functions.text import CONDITION_LABELS, label_of
from trajspark.operators import joins as J
from trajspark.operators import models as M
from trajspark.operators import robust as R
from trajspark.operators import smooth as S
from trajspark.operators.windows import carry_forward, heading
from trajspark.plans.driver_views import BY, ORDER, SPACE_SQL, TRACK_SQL, WALK_SQL, features, hav_sql, planar, segments, steps_sql, table, track, walk
from trajspark.plans.registry import query, r6
from trajspark.plans.track_queries import HEADING_SQL, filled_sql, gaussian_value_sql
from trajspark.sources.roads import road_grid


@query(f"""WITH {TRACK_SQL}, l AS (SELECT * FROM track WHERE event_type = 'view'), r AS (SELECT * FROM track WHERE event_type = 'click')
SELECT l.event_id, coalesce(r.event_id, -1) AS ref_event, coalesce(r.value, -1) AS ref_value FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.us <= l.us""")
def asof_backward(spark, sf_dir):
    """The latest earlier row of another stream."""
    t = track(spark, sf_dir)
    left = t.filter("event_type = 'view'").select("user_id", "us", "event_id")
    right = t.filter("event_type = 'click'").select("user_id", "us", F.col("event_id").alias("ref_event"), F.col("value").alias("ref_value"))
    return J.asof_backward(left, right, BY, "us", ["ref_event", "ref_value"], "ref_event").select("event_id", F.coalesce("ref_event", F.lit(-1)).alias("ref_event"), F.coalesce("ref_value", F.lit(-1.0)).alias("ref_value"))


NEAREST_SQL = f"""{TRACK_SQL}, l AS (SELECT * FROM track WHERE event_id % 2 = 0), r AS (SELECT * FROM track WHERE event_id % 2 = 1), n AS (
  SELECT l.event_id, l.user_id, l.lat, l.lon, r.event_id AS ref_event, r.lat AS ref_lat, r.lon AS ref_lon, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.us - r.us), r.event_id) AS k
  FROM l JOIN r ON r.user_id = l.user_id AND abs(l.us - r.us) < 7200000000)"""


def _nearest(spark, sf_dir):
    t = track(spark, sf_dir)
    left = t.filter("event_id % 2 = 0").select("user_id", "us", "event_id", "lat", "lon")
    right = t.filter("event_id % 2 = 1").select("user_id", "us", F.col("event_id").alias("ref_event"), F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    return J.asof_nearest(left, right, BY, "us", ["event_id"], ["ref_event", "ref_lat", "ref_lon"], 7_200_000_000, "ref_event")


@query(f"WITH {NEAREST_SQL} SELECT event_id, coalesce(ref_event, -1) AS ref_event FROM (SELECT l.event_id, n.ref_event FROM l LEFT JOIN (SELECT * FROM n WHERE k = 1) n USING (event_id))")
def asof_nearest_tolerance(spark, sf_dir):
    """D5, G5."""
    return _nearest(spark, sf_dir).select("event_id", F.coalesce("ref_event", F.lit(-1)).alias("ref_event"))


BIAS_SQL = f"""{NEAREST_SQL}, p AS (SELECT user_id, ref_lat - lat AS dlat, ref_lon - lon AS dlon FROM n WHERE k = 1), m AS (SELECT user_id, count(*) AS n, quantile_cont(dlat, 0.5) AS ma, quantile_cont(dlon, 0.5) AS mo FROM p GROUP BY 1),
d AS (SELECT p.user_id, n, ma, mo, quantile_cont(abs(dlat - ma), 0.5) AS da, quantile_cont(abs(dlon - mo), 0.5) AS d_o FROM p JOIN m USING (user_id) GROUP BY ALL),
bias AS (SELECT p.user_id, max(n) AS n, CASE WHEN max(n) < 10 THEN 0 ELSE coalesce(quantile_cont(dlat, 0.5) FILTER (WHERE abs(dlat - ma) < 3.0e0 * 1.4826e0 * da), 0) END AS bias_lat,
  CASE WHEN max(n) < 10 THEN 0 ELSE coalesce(quantile_cont(dlon, 0.5) FILTER (WHERE abs(dlon - mo) < 3.0e0 * 1.4826e0 * d_o), 0) END AS bias_lon FROM p JOIN d USING (user_id) GROUP BY p.user_id)"""


def _bias(spark, sf_dir):
    pairs = _nearest(spark, sf_dir).filter("ref_event IS NOT NULL").select("user_id", (F.col("ref_lat") - F.col("lat")).alias("dlat"), (F.col("ref_lon") - F.col("lon")).alias("dlon"))
    return R.bias_estimate(pairs, BY)


@query(f"WITH {BIAS_SQL} SELECT user_id, n, round(bias_lat, 8) AS bias_lat, round(bias_lon, 8) AS bias_lon FROM bias")
def bias_estimate(spark, sf_dir):
    """E16, E15, C25."""
    return _bias(spark, sf_dir).select("user_id", "n", F.round("bias_lat", 8).alias("bias_lat"), F.round("bias_lon", 8).alias("bias_lon"))


@query(f"WITH {BIAS_SQL} SELECT event_id, round(lat + coalesce(bias_lat, 0), 8) AS lat, round(lon + coalesce(bias_lon, 0), 8) AS lon FROM track LEFT JOIN bias USING (user_id)")
def apply_bias(spark, sf_dir):
    """K12, I11."""
    moved = R.apply_bias(track(spark, sf_dir), BY, _bias(spark, sf_dir))
    return moved.select("event_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


CORRECT_SQL = f"""{BIAS_SQL}, moved AS (SELECT user_id, us, event_id, lat + coalesce(bias_lat, 0) AS lat, lon + coalesce(bias_lon, 0) AS lon FROM track LEFT JOIN bias USING (user_id)), {steps_sql('moved')},
q AS (SELECT user_id, quantile_cont(step, 0.25) AS q1, quantile_cont(step, 0.75) AS q3, count(*) + 1 AS rows FROM steps WHERE i > 1 GROUP BY 1),
sp AS (SELECT steps.*, coalesce(i > 1 AND rows >= 4 AND step > q3 + 2.5e0 * (q3 - q1), false) AS spike FROM steps LEFT JOIN q USING (user_id)), {filled_sql('NOT spike', 'sp', 'lat,lon', False)},
run AS (SELECT user_id, list(f_lat ORDER BY us, event_id) AS lats, list(f_lon ORDER BY us, event_id) AS lons, count(*) AS n FROM filled GROUP BY 1)"""


@query(f"WITH {CORRECT_SQL} SELECT event_id, round({gaussian_value_sql(3, 'reflect', 'lats', 'f_lat')}, 6) AS lat, round({gaussian_value_sql(3, 'reflect', 'lons', 'f_lon')}, 6) AS lon FROM filled JOIN run USING (user_id)")
def correct_track(spark, sf_dir):
    """Bias, spikes, Gaussian smoothing in one chain."""
    pairs = _nearest(spark, sf_dir).filter("ref_event IS NOT NULL").select("user_id", (F.col("ref_lat") - F.col("lat")).alias("dlat"), (F.col("ref_lon") - F.col("lon")).alias("dlon"))
    return S.correct_track(track(spark, sf_dir).select("user_id", "us", "event_id", "lat", "lon"), BY, ORDER, pairs).select("event_id", r6("lat"), r6("lon"))


def _boxes(spark, sf_dir):
    return segments(spark, sf_dir).select("seg_id", "x1", "y1", "x2", "y2")


@query(f"""WITH {SPACE_SQL} SELECT event_id, seg_id FROM planar, segments WHERE x BETWEEN least(x1, x2) - 20 AND greatest(x1, x2) + 20 AND y BETWEEN least(y1, y2) - 20 AND greatest(y1, y2) + 20""")
def grid_range_join(spark, sf_dir):
    """D8, C18."""
    return J.grid_range_join(planar(spark, sf_dir), _boxes(spark, sf_dir), 20.0).select("event_id", "seg_id")


@query(f"""WITH {SPACE_SQL}, n AS (SELECT event_id, seg_id FROM planar, segments WHERE x BETWEEN least(x1, x2) - 10 AND greatest(x1, x2) + 10 AND y BETWEEN least(y1, y2) - 10 AND greatest(y1, y2) + 10)
SELECT * FROM n UNION ALL SELECT event_id, seg_id FROM planar p, segments WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.event_id = p.event_id) AND x BETWEEN least(x1, x2) - 40 AND greatest(x1, x2) + 40 AND y BETWEEN least(y1, y2) - 40 AND greatest(y1, y2) + 40""")
def grid_join_fallback(spark, sf_dir):
    """The wider box only for points without a candidate."""
    found = J.grid_join_with_fallback(planar(spark, sf_dir), _boxes(spark, sf_dir), ["event_id"], (10.0, 40.0))
    return found.select("event_id", "seg_id")


@query(f"""WITH {SPACE_SQL}, t AS (SELECT *, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0) AS t FROM planar, segments
  WHERE x BETWEEN least(x1, x2) - 60 AND greatest(x1, x2) + 60 AND y BETWEEN least(y1, y2) - 60 AND greatest(y1, y2) + 60),
d AS (SELECT *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS distance FROM t WHERE t BETWEEN 0 AND 1),
b AS (SELECT event_id, seg_id, distance, row_number() OVER (PARTITION BY event_id ORDER BY distance, seg_id) AS k FROM d)
SELECT p.event_id, coalesce(seg_id, -1) AS seg_id, round(coalesce(distance, -1), 6) AS distance FROM planar p LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (event_id)""")
def nearest_segment(spark, sf_dir):
    """D9, K5, I14, I15, C18."""
    found = J.nearest_segment(planar(spark, sf_dir), _boxes(spark, sf_dir), 60.0, ["event_id"], ["seg_id"])
    return found.select("event_id", F.coalesce("seg_id", F.lit(-1)).alias("seg_id"), r6(F.coalesce("distance", F.lit(-1.0)), "distance"))


@query(f"""WITH {SPACE_SQL} SELECT event_id, seg_id, round(sqrt(pow(x - (x1 + c * (x2 - x1)), 2) + pow(y - (y1 + c * (y2 - y1)), 2)), 6) AS distance FROM (SELECT *, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS c FROM planar, segments
WHERE x BETWEEN least(x1, x2) - 20 AND greatest(x1, x2) + 20 AND y BETWEEN least(y1, y2) - 20 AND greatest(y1, y2) + 20)""")
def segment_distances(spark, sf_dir):
    """I17, I16."""
    near = J.grid_range_join(planar(spark, sf_dir), _boxes(spark, sf_dir), 20.0)
    return near.select("event_id", "seg_id", r6(segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), "distance"))


@query(f"""WITH {TRACK_SQL}, c AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) - 1 AS pos FROM track)
SELECT a.user_id, a.pos, a.value AS view, coalesce(b.value, -1) AS click, coalesce(e.value, -1) AS error FROM c a LEFT JOIN c b ON b.user_id = a.user_id AND b.pos = a.pos AND b.event_type = 'click' LEFT JOIN c e ON e.user_id = a.user_id AND e.pos = a.pos AND e.event_type = 'error' WHERE a.event_type = 'view'""")
def zip_join(spark, sf_dir):
    """D13."""
    t = track(spark, sf_dir)
    found = J.zip_join({n: t.filter(F.col("event_type") == n) for n in ("view", "click", "error")}, BY, ORDER)
    return found.select("user_id", F.col("pos").cast("long").alias("pos"), "view", F.coalesce("click", F.lit(-1.0)).alias("click"), F.coalesce("error", F.lit(-1.0)).alias("error"))


@query(f"""WITH {TRACK_SQL} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 0) AS acc, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w, 0) AS ori, coalesce(last_value(CASE WHEN event_type NOT IN ('view', 'click') THEN value END IGNORE NULLS) OVER w, 0) AS gps
FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def locf_merge(spark, sf_dir):
    """D14, F3, H2, G6."""
    t = track(spark, sf_dir)
    part = lambda cond, name: t.filter(cond).select("user_id", "us", "event_id", F.col("value").alias(name))
    streams = {"acc": part("event_type = 'view'", "acc"), "ori": part("event_type = 'click'", "ori"), "gps": part("event_type NOT IN ('view', 'click')", "gps")}
    return J.locf_merge(streams, BY, ORDER, {n: [n] for n in streams}).select("event_id", "acc", "ori", "gps")


@query("SELECT event_id, source FROM (SELECT event_id, 'a' AS source FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b' AS source FROM events WHERE event_id % 3 = 0)")
def union_tagged_sort(spark, sf_dir):
    """H2, G1."""
    e = table(spark, sf_dir, "events").select("event_id")
    tagged = e.filter("event_id % 2 = 0").withColumn("source", F.lit("a")).unionByName(e.filter("event_id % 3 = 0").withColumn("source", F.lit("b")))
    return tagged.orderBy("event_id", "source")


KNN_SQL = """q AS (SELECT vec_id AS query_id, embedding[1:4]::DOUBLE[] AS f, embedding[1:30]::DOUBLE[] AS h FROM embeddings WHERE vec_id % 10 <> 0), t AS (SELECT vec_id AS train_id, embedding[1:4]::DOUBLE[] AS tf, embedding[1:30]::DOUBLE[] AS th, (label % 4)::INT AS class FROM embeddings WHERE vec_id % 10 = 0)"""
EUCLID_SQL = "sqrt((((0.0e0 + pow(f[1] - tf[1], 2)) + pow(f[2] - tf[2], 2)) + pow(f[3] - tf[3], 2)) + pow(f[4] - tf[4], 2))"


def _knn_sides(spark, sf_dir):
    f = features(spark, sf_dir)
    queries = f.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("query_id"), F.col("f").alias("features"), F.col("hist"))
    train = f.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("train_id"), F.col("f").alias("train_features"), F.col("hist").alias("train_hist"), "class")
    return queries, train


@query(f"WITH {KNN_SQL}, d AS (SELECT query_id, train_id, class, {EUCLID_SQL} AS distance FROM q, t) SELECT query_id, rank::INT AS rank, train_id, class, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d) WHERE rank <= 5")
def knn_topk(spark, sf_dir):
    """D10, G4, I16."""
    queries, train = _knn_sides(spark, sf_dir)
    found = J.nearest_neighbours(queries, train, J.euclidean_matrix, "features", "train_features", ["query_id"], ["train_id", "class"])
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "train_id", "class", r6("distance"))


@query(f"WITH {KNN_SQL}, d AS (SELECT query_id, train_id, class, {EUCLID_SQL} AS distance FROM q, t), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d) WHERE rank <= 5), v AS (SELECT query_id, class, count(*) AS votes FROM k GROUP BY ALL) SELECT query_id, class, votes, CASE class WHEN 0 THEN 'good' WHEN 1 THEN 'satisfactory' WHEN 2 THEN 'unsatisfactory' ELSE 'poor' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, class) AS r FROM v) WHERE r = 1")
def knn_vote(spark, sf_dir):
    """K6, E21, I33."""
    queries, train = _knn_sides(spark, sf_dir)
    return J.knn_condition(queries, train).select("query_id", "class", "votes", label_of(F.col("class"), CONDITION_LABELS, "none").alias("label"))


BHATT_SQL = "sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 31), lambda i: sqrt(abs(h[i]) * abs(th[i])))) / sqrt(list_sum(list_transform(h, lambda x: abs(x))) * list_sum(list_transform(th, lambda x: abs(x))))))"


@query(f"WITH {KNN_SQL}, d AS (SELECT query_id, train_id, class, {BHATT_SQL} AS distance FROM q, t), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d) WHERE rank <= 5), v AS (SELECT query_id, class, count(*) AS votes FROM k GROUP BY ALL) SELECT query_id, class, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, class) AS r FROM v) WHERE r = 1")
def bhattacharyya_knn(spark, sf_dir):
    """K7, D11, I32."""
    queries, train = _knn_sides(spark, sf_dir)
    found = J.nearest_neighbours(queries, train, J.bhattacharyya_matrix, "hist", "train_hist", ["query_id"], ["train_id", "class"])
    return J.vote(found, ["query_id"], "class").select("query_id", "class", "votes")


@query(f"WITH {TRACK_SQL} SELECT user_id, min_by(event_id, (sdn, event_id)) AS best FROM track GROUP BY user_id".replace("min_by(event_id, (sdn, event_id))", "arg_min(event_id, (sdn, event_id))"))
def best_location(spark, sf_dir):
    """A32, G5."""
    return track(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct("sdn", "event_id")).alias("best"))


@query(f"WITH {TRACK_SQL} SELECT user_id, count(*) AS kept FROM track WHERE event_type <> 'error' GROUP BY user_id")
def session_delete(spark, sf_dir):
    """What a delete by file leaves."""
    from trajspark.sources.sinks import without_file

    t = track(spark, sf_dir).withColumn("file", F.col("event_type"))
    return without_file(t, "error").groupBy("user_id").agg(F.count("*").alias("kept"))


@query("""WITH g AS (SELECT r AS road, v AS seq FROM range(10) t(r), range(40) u(v)) SELECT road::BIGINT AS road_id, seq::INT AS seq, round(17.4e0 + (seq * 0.0005e0 - 0.01e0), 9) AS lat, round(78.3e0 + (road * 0.002e0 - 0.01e0), 9) AS lon FROM g
UNION ALL SELECT road + 10, seq::INT, round(17.4e0 + (road * 0.002e0 - 0.01e0), 9), round(78.3e0 + (seq * 0.0005e0 - 0.01e0), 9) FROM g""")
def road_grid_points(spark, sf_dir):
    """A23."""
    return road_grid(spark, 17.4, 78.3).select("road_id", "seq", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


NODES_SQL = f"""WITH RECURSIVE c AS (SELECT road, seq FROM range(10) t(road), range(40) u(seq)), g AS (
  SELECT road AS road_id, seq::INT AS seq, 17.4e0 + (seq * 0.0005e0 - 0.01e0) AS lat, 78.3e0 + (road * 0.002e0 - 0.01e0) AS lon FROM c
  UNION ALL SELECT road + 10, seq::INT, 17.4e0 + (road * 0.002e0 - 0.01e0), 78.3e0 + (seq * 0.0005e0 - 0.01e0) FROM c),
r AS (SELECT *, 0.0e0 AS total, false AS emitted FROM g WHERE seq = 0
  UNION ALL SELECT road_id, seq, lat, lon, CASE WHEN run > 60 THEN 0 ELSE run END, run > 60 FROM (
    SELECT g.*, r.total + {hav_sql('r.lat', 'r.lon', 'g.lat', 'g.lon')} AS run FROM r JOIN g ON g.road_id = r.road_id AND g.seq = r.seq + 1))"""


@query(f"{NODES_SQL} SELECT road_id, seq FROM r WHERE emitted")
def road_nodes(spark, sf_dir):
    """K3."""
    return M.discretize_roads(road_grid(spark, 17.4, 78.3), ["road_id"], ["seq"], 60.0).select("road_id", "seq")


def _box_sql(reach: int) -> str:
    return f"x BETWEEN least(x1, x2) - {reach} AND greatest(x1, x2) + {reach} AND y BETWEEN least(y1, y2) - {reach} AND greatest(y1, y2) + {reach}"


# A segment u runs from node u to node u + 1, so u names the state and the one after it is u itself or u + 1.
VITERBI_SQL = f"""WITH RECURSIVE {HEADING_SQL}, {SPACE_SQL}, pts AS (SELECT p.user_id, epoch, heading, x, y FROM headed JOIN planar p USING (event_id)),
narrow AS (SELECT * FROM pts, segments WHERE {_box_sql(50)}),
near AS (SELECT * FROM narrow UNION ALL SELECT * FROM pts p, segments WHERE NOT EXISTS (SELECT 1 FROM narrow n WHERE n.user_id = p.user_id AND n.epoch = p.epoch) AND {_box_sql(200)}),
foot AS (SELECT *, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS t,
  fmod(heading - fmod(degrees(atan2(x2 - x1, y2 - y1)) + 360, 360) + 360, 360) AS turn FROM near),
fit AS (SELECT *, coalesce(least(turn, 360 - turn), 0) AS diff, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS distance FROM foot),
c AS (SELECT user_id, epoch, seg_id AS u,
  ln(greatest(1e-300, exp(-0.5e0 * pow(distance / 15, 2)) / (sqrt(2 * pi()) * 15) * CASE WHEN diff > 100 THEN 1e-4 WHEN diff > 45 THEN 0.1e0 ELSE cos(radians(diff)) END)) AS emission FROM fit),
ends AS (SELECT user_id, max(epoch) AS final, (SELECT min(epoch) FROM c WHERE c.user_id = pts.user_id) AS start FROM pts GROUP BY user_id),
r AS MATERIALIZED (SELECT user_id, epoch, u, emission AS score, NULL::BIGINT AS prev FROM c JOIN ends USING (user_id) WHERE epoch = start
  UNION ALL SELECT user_id, epoch, u, score + emission, prev FROM (SELECT *, row_number() OVER (PARTITION BY user_id, u ORDER BY score DESC, prev) AS k FROM (
    SELECT r.user_id, r.epoch + 1 AS epoch, coalesce(c.u, r.u) AS u, r.u AS prev, coalesce(emission, 0) AS emission, r.score + CASE WHEN c.u IS NULL OR c.u IN (r.u, r.u + 1) THEN 0 ELSE ln(0.01e0) END AS score
    FROM r JOIN ends e ON e.user_id = r.user_id AND r.epoch < final LEFT JOIN c ON c.user_id = r.user_id AND c.epoch = r.epoch + 1)) WHERE k = 1),
path AS (SELECT user_id, epoch, u, prev FROM (SELECT r.*, row_number() OVER (PARTITION BY r.user_id ORDER BY score DESC, u) AS k FROM r JOIN ends e ON e.user_id = r.user_id AND epoch = final) WHERE k = 1
  UNION ALL SELECT r.user_id, r.epoch, r.u, r.prev FROM path JOIN r ON r.user_id = path.user_id AND r.epoch = path.epoch - 1 AND r.u = path.prev),
snap AS (SELECT p.user_id, p.epoch, u, x, y, x1, y1, x2, y2, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0))) AS t
  FROM path p JOIN pts USING (user_id, epoch) JOIN segments ON seg_id = u)"""


@query(f"{VITERBI_SQL} SELECT user_id, epoch, u, u + 1 AS v, round(x1 + t * (x2 - x1), 6) AS snap_x, round(y1 + t * (y2 - y1), 6) AS snap_y FROM snap")
def viterbi_match(spark, sf_dir):
    """K4, D8, D12, I17, I18, I35, G9."""
    from trajspark.operators.windows import epoch_index

    p = planar(spark, sf_dir).join(track(spark, sf_dir).select("event_id", "us", "lat", "lon"), "event_id")
    p = epoch_index(heading(p, BY, ORDER), BY, ORDER)
    roads = segments(spark, sf_dir).select("u", "v", "key", "x1", "y1", "x2", "y2")
    return M.lane_match(p.select("user_id", "epoch", "x", "y", "heading"), roads, BY).select("user_id", "epoch", "u", "v", r6("snap_x"), r6("snap_y"))


@query(f"""WITH {WALK_SQL} SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) > 20 AS training FROM walk""".replace("> 20 AS", "> 20 IS TRUE AS"))
def labelled_stream(spark, sf_dir):
    """Labels as a stream, carried forward onto sensor rows."""
    w = walk(spark, sf_dir).withColumn("label", F.when(F.col("event_type") == "view", F.col("value")))
    return carry_forward(w, BY, ORDER, ["label"], None).select("event_id", F.coalesce(F.col("label") > 20, F.lit(False)).alias("training"))


SURFACE_SQL = f"""{KNN_SQL}, l1 AS (SELECT query_id, CASE WHEN class = 0 THEN 'tar' ELSE 'mudcon' END AS class, train_id, {BHATT_SQL} AS distance FROM q, t WHERE class IN (0, 1)),
v1 AS (SELECT query_id, class, count(*) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM l1) WHERE rank <= 5 GROUP BY ALL),
c1 AS (SELECT query_id, class, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, class) AS r FROM v1) WHERE r = 1),
l2 AS (SELECT q.query_id, CASE WHEN t.class = 2 THEN 'mud' ELSE 'con' END AS class, train_id, {BHATT_SQL} AS distance FROM q JOIN c1 ON c1.query_id = q.query_id AND c1.class = 'mudcon', t WHERE t.class IN (2, 3)),
v2 AS (SELECT query_id, class, count(*) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM l2) WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, class, votes FROM c1 WHERE class = 'tar' UNION ALL SELECT query_id, class, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, class) AS r FROM v2) WHERE r = 1"""


@query(f"WITH {SURFACE_SQL}")
def surface_two_level(spark, sf_dir):
    """K7, D11, I32, I33."""
    queries, train = _knn_sides(spark, sf_dir)
    names = label_of(F.col("class"), {0: "tar", 1: "mudcon", 2: "mud"}, "con")
    train = train.withColumn("class", names)
    return J.knn_surface(queries.select("query_id", F.col("hist").alias("value_hist"), F.col("hist").alias("sat_hist")), train).select("query_id", "class", "votes")


@query(f"WITH {TRACK_SQL} SELECT event_id, 2 * 6371000.0e0 * asin(sqrt(pow(sin(radians(17.4e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(17.4e0)) * pow(sin(radians(78.3e0 - lon) / 2), 2))) <= 20000 AS near, (lat > 17.5 AND lag_lat > 17.5) OR (lat < 17.3 AND lag_lat < 17.3) OR (lon > 78.4 AND lag_lon > 78.4) OR (lon < 78.2 AND lag_lon < 78.2) AS beyond FROM (SELECT *, coalesce(lag(lat) OVER w, lat) AS lag_lat, coalesce(lag(lon) OVER w, lon) AS lag_lon FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))")
def radius_and_view(spark, sf_dir):
    """C18, C19."""
    from trajspark.functions.geo import beyond_view, within_radius
    from trajspark.operators.base import ordered

    w = ordered(BY, ORDER)
    t = track(spark, sf_dir).withColumn("a", F.coalesce(F.lag("lat").over(w), "lat")).withColumn("b", F.coalesce(F.lag("lon").over(w), "lon"))
    lat0, lon0 = F.lit(17.4), F.lit(78.3)
    return t.select("event_id", within_radius(F.col("lat"), F.col("lon"), lat0, lon0, 20_000.0).alias("near"), beyond_view(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"), lat0, lon0, 0.1).alias("beyond"))
