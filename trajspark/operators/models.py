"""Track models: robust Kalman, particle filter, HMM lane matcher, road sampling [K1-K4].

All but the lane matcher, whose path is traced back from the last epoch, carry their state from batch to batch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.geo import EARTH_RADIUS, angle_between, bearing, gaussian_emission, heading_factor, segment_distance
from trajspark.operators.joins import grid_join_with_fallback
from trajspark.operators.recursive import metres, over_tracks
from trajspark.operators.segments import SegmentGrid, ranges
from trajspark.shipping import ship

# Kalman noises and Huber limit; particle count, deviation, speed and degrees to metres; transition of disjoint edges.
START_NOISE, PROCESS_NOISE, HUBER = 0.1, 0.01, 1.0
PARTICLES, PARTICLE_SIGMA, PARTICLE_SPEED, DEGREE = 200, 0.75, 1.5, 111_000.0
DISJOINT = 0.01
#: Metres within which candidates lie, the wider only where the narrower has none.
REACHES = (50.0, 200.0)
#: Edges that are broadcast (56 MB), epochs whose candidates a task finds at a time.
HELD_EDGES, EPOCHS = 1 << 20, 4096
ROAD_STEP = 5.0


def kalman_steps(z: list[list[float]], deviations: list[list[float]], state: list | None = None) -> tuple[list[list[float]], list]:
    """States (position, velocity for three axes) of a constant-velocity filter whose gain shrinks for large innovations.

    Units are mixed as published: degrees for latitude and longitude, metres for height and deviations. The
    covariance of an axis never mixes with another's; only the innovation's norm couples them, so each axis has
    a 2 x 2 covariance. state: of each axis its position, velocity and covariance after the row before.
    """
    out = []
    for fix, deviation in zip(z, deviations, strict=True):
        if state is None:
            state = [(x, 0.0, START_NOISE, 0.0, START_NOISE) for x in fix]
        else:
            state = [(x + v, v, pp + 2 * pv + vv + PROCESS_NOISE, pv + vv, vv + PROCESS_NOISE) for x, v, pp, pv, vv in state]
        y = [m - axis[0] for m, axis in zip(fix, state, strict=True)]
        norm = math.sqrt(sum(d * d for d in y))
        scale = HUBER / norm if norm > HUBER else 1.0
        after = []
        for d, sd, (x, v, pp, pv, vv) in zip(y, deviation, state, strict=True):
            s = pp + sd * sd
            kp, kv = scale * pp / s, scale * pv / s
            after.append((x + kp * d, v + kv * d, (1 - kp) * pp, (1 - kp) * pv, vv - kv * pv))
        state = after
        out.append([*(axis[0] for axis in state), *(axis[1] for axis in state)])
    return out, state


def robust_kalman(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds f_lat, f_lon, f_height, v_lat, v_lon, v_height to rows with lat, lon, height, sdn, sde, sdu [K1]."""
    new = ["f_lat", "f_lon", "f_height", "v_lat", "v_lon", "v_height"]

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        out, state = kalman_steps(rows[["lat", "lon", "height"]].to_numpy().tolist(), rows[["sdn", "sde", "sdu"]].to_numpy().tolist(), state)
        return dict(zip(new, zip(*out, strict=True), strict=True)), state

    return over_tracks(df, by, order, dict.fromkeys(new, "double"), step)


def filter_residuals(df: DataFrame, by: list[str]) -> DataFrame:
    """Largest difference of each row; mean, P95 and greatest of each track [E23]."""
    worst = F.greatest(*[F.abs(F.col(f"f_{c}") - F.col(c)) for c in ("lat", "lon", "height")])
    return df.groupBy(*by).agg(F.avg(worst).alias("mean_residual"), F.percentile(worst, F.lit(0.95)).alias("p95_residual"), F.max(worst).alias("max_residual"))


def distances(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    p, p0 = np.radians(lat), math.radians(lat0)
    a = np.sin((p - p0) / 2) ** 2 + np.cos(p) * math.cos(p0) * np.sin(np.radians(lon - lon0) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def particle_steps(fixes: np.ndarray, sigma: np.ndarray, seed: int, particles: int = PARTICLES, max_speed: float = PARTICLE_SPEED, state: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(positions, confidences, state) of a particle filter with steps of one second. state: generator, cloud, last position."""
    out, confidence = np.empty_like(fixes, dtype=float), np.empty(len(fixes))
    if state is None:
        rng = np.random.default_rng(seed)
        cloud, last = fixes[0] + rng.standard_normal((particles, 2)) * sigma[0] / DEGREE, None
    else:
        rng, cloud, last = state
    for t, fix in enumerate(fixes):
        cloud = cloud + rng.standard_normal((particles, 2)) * (max_speed / DEGREE * 0.5)
        weight = np.exp(-(distances(cloud[:, 0], cloud[:, 1], *fix) ** 2) / (2 * sigma[t] ** 2))
        if last is not None:
            speed = distances(cloud[:, 0], cloud[:, 1], *last)
            weight = weight * np.exp(-(np.maximum(0.0, speed - max_speed) ** 2))
        total = weight.sum()
        weight = weight / total if total > 0 else np.full(particles, 1 / particles)
        confidence[t] = weight.max()
        if confidence[t] > 0.01:
            cloud = cloud[rng.choice(particles, particles, p=weight / weight.sum())]
        else:
            cloud = fix + rng.standard_normal((particles, 2)) * sigma[t] / DEGREE
        out[t] = last = cloud.mean(axis=0)
    return out, confidence, (rng, cloud, last)


def particle_filter(df: DataFrame, by: list[str], order: list[str], sigma: float = PARTICLE_SIGMA, particles: int = PARTICLES) -> DataFrame:
    """Adds p_lat, p_lon, confidence [K2]. The seed is a checksum of the track's key, so results are repeatable."""

    def step(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        seed = zlib.crc32("/".join(str(rows[c].iloc[0]) for c in by).encode())
        found, confidence, state = particle_steps(rows[["lat", "lon"]].to_numpy(), np.full(len(rows), sigma), seed, particles, state=state)
        return {"p_lat": found[:, 0], "p_lon": found[:, 1], "confidence": confidence}, state

    return over_tracks(df, by, order, {"p_lat": "double", "p_lon": "double", "confidence": "double"}, step)


def sampled(points: list[tuple[float, float]], step: float = ROAD_STEP, state: tuple | None = None) -> tuple[list[bool], tuple | None]:
    """Whether a vertex is emitted: more than ``step`` metres of road since the last one that was. state: last point, metres."""
    out = []
    for point in points:
        total = 0.0 if state is None else state[1] + metres(*state[0], *point)
        out.append(total > step)
        state = (point, 0.0 if total > step else total)
    return out, state


def discretize_roads(roads: DataFrame, by: list[str], order: list[str], step: float = ROAD_STEP) -> DataFrame:
    """[K3]"""

    def one(rows: pd.DataFrame, state: Any) -> tuple[dict, Any]:
        emitted, state = sampled(list(zip(rows["lat"].tolist(), rows["lon"].tolist(), strict=True)), step, state)
        return {"__emitted": emitted}, state

    return over_tracks(roads, by, order, {"__emitted": "boolean"}, one).filter("__emitted").drop("__emitted")


class Lanes:
    """Edges in the order of their states: class (its segment's ends) of each, members of each class, edges that begin where one ends."""

    def __init__(self, start: np.ndarray, end: np.ndarray, kind: np.ndarray, kinds: int) -> None:
        self.kind, self.kinds = kind, kinds
        self.members = np.argsort(kind, kind="stable")
        self.member_count = np.bincount(kind, minlength=kinds)
        self.member_first = np.cumsum(self.member_count) - self.member_count
        self.next_first = np.searchsorted(start, end, "left")
        self.next_count = np.searchsorted(start, end, "right") - self.next_first


def best_states(epochs: Iterable[tuple[np.ndarray, np.ndarray]], lanes: Lanes) -> np.ndarray:
    """Most likely state (its number, or -1) of each epoch, given by its candidates' classes and log emissions.

    All states can come from the best one at the price of a disjoint edge, so a state whose score is lower than the best one's by more
    than that price comes before none: only the others are kept. Members of a class differ only where a kept state leads to them
    without that price. Ties go to the least state.
    """
    price = math.log(DISJOINT)
    emission = np.full(lanes.kinds, -np.inf)
    kept, score = np.zeros(0, np.int64), np.zeros(0)
    trace: list[tuple[np.ndarray, np.ndarray] | None] = []
    for kinds, own in epochs:
        if not len(kinds):
            trace.append(None)
            continue
        emission[kinds] = own
        if len(kept):
            best = int(score.argmax())  # the first one: the least state
            far, base = int(kept[best]), float(score[best]) + price
            rows, target = ranges(lanes.next_first[kept], lanes.next_count[kept])
            target, source = np.concatenate([kept, target]), np.concatenate([np.arange(len(kept)), rows])
            here = np.flatnonzero(emission[lanes.kind[target]] > -np.inf)
            target, source = target[here], source[here]
            way, prev = score[source], kept[source]
            tied = way == base
            prev = np.where(tied, np.minimum(prev, far), prev)
            order = np.lexsort((prev, -way, target))
            target = target[order]
            first = np.diff(target, prepend=-1) != 0
            target, way, prev = target[first], way[order[first]], prev[order[first]]
            linked = way + emission[lanes.kind[target]]
        else:
            far, base = -1, 0.0
            target, prev, linked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        plain = base + own
        least = max(plain.max(), linked.max() if len(linked) else -np.inf) + price
        at = kinds[plain >= least]
        rows, place = ranges(lanes.member_first[at], lanes.member_count[at])
        others = lanes.members[place]
        values = plain[plain >= least][rows]
        if len(target) and len(others):
            apart = target[np.minimum(np.searchsorted(target, others), len(target) - 1)] != others
            others, values = others[apart], values[apart]
        good = linked >= least
        kept = np.concatenate([target[good], others])
        score = np.concatenate([linked[good], values])
        before = np.concatenate([prev[good], np.full(len(others), far)])
        order = np.argsort(kept, kind="stable")
        kept, score = kept[order], score[order]
        trace.append((kept.astype(np.int32), before[order].astype(np.int32)))
        emission[kinds] = -np.inf
    path = np.full(len(trace), -1, np.int64)
    state = int(kept[score.argmax()]) if len(kept) else -1
    for t in range(len(trace) - 1, -1, -1):
        if state < 0:
            break
        path[t] = state
        if trace[t] is not None:
            found, before = trace[t]
            state = int(before[np.searchsorted(found, state)])
    return path


def decode(candidates: dict[int, list[tuple[tuple, float]]], epochs: int) -> list[tuple | None]:
    """Most likely states of a track. candidates[t]: (state, log emission), states are (u, v, key); ties go to the least.

    An epoch without candidates has those of the epoch before, as they were. Before any candidates states are None.
    """
    states = sorted({s for own in candidates.values() for s, _ in own})
    place = {s: i for i, s in enumerate(states)}
    lanes = Lanes(np.array([s[0] for s in states], np.int64), np.array([s[1] for s in states], np.int64), np.arange(len(states)), len(states))
    rows = (dict(candidates.get(t, [])) for t in range(epochs))
    path = best_states(((np.array([place[s] for s in own], np.int64), np.array(list(own.values()), float)) for own in rows), lanes)
    return [states[i] if i >= 0 else None for i in path]


def lane_match(points: DataFrame, edges: DataFrame, by: list[str], epoch: str = "epoch", sigma: float = 15.0) -> DataFrame:
    """(by, epoch, u, v, key, snap_x, snap_y) of points(by, epoch, x, y, heading) on edges(u, v, key, x1, y1, x2, y2) [K4].

    Candidates lie within 50 m, else 200 m. Up to ``HELD_EDGES`` edges are broadcast and a track finds its candidates in a grid,
    a slice of epochs at a time, once for edges with the same ends; with more, candidates come from a grid join as rows.
    """
    edges = edges.filter("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    held = edges.limit(HELD_EDGES + 1).count() <= HELD_EDGES
    return (_match_held if held else _match_joined)(points, edges, by, epoch, sigma)


class RoadMap:
    """Edges in the order of their states, with a grid of their distinct ends."""

    def __init__(self, edges: pa.Table) -> None:
        self.u, self.v, self.key = (edges.column(c).to_numpy() for c in ("u", "v", "key"))
        ends, kind = np.unique(np.stack([edges.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1), axis=0, return_inverse=True)
        self.grid, self.lanes = SegmentGrid(ends), Lanes(self.u, self.v, kind.reshape(-1), len(ends))
        self.bearing = np.mod(np.degrees(np.arctan2(self.grid.x2 - self.grid.x1, self.grid.y2 - self.grid.y1)) + 360, 360.0)

    def foot(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points of segments."""
        x1, y1 = self.grid.x1[kinds], self.grid.y1[kinds]
        dx, dy = self.grid.x2[kinds] - x1, self.grid.y2[kinds] - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)
        t = np.clip(np.where(np.isfinite(t), t, 0.0), 0.0, 1.0)
        return x1 + t * dx, y1 + t * dy

    def emissions(self, x: np.ndarray, y: np.ndarray, heading: np.ndarray, kinds: np.ndarray, sigma: float) -> np.ndarray:
        fx, fy = self.foot(x, y, kinds)
        turn = np.mod(heading - self.bearing[kinds], 360.0)
        turn = np.where(np.isnan(turn), 0.0, np.minimum(turn, np.mod(self.bearing[kinds] - heading, 360.0)))
        fit = np.where(turn > 100, 1e-4, np.where(turn > 45, 0.1, np.cos(np.radians(turn))))
        return np.log(np.maximum(1e-300, np.exp(-0.5 * (np.hypot(x - fx, y - fy) / sigma) ** 2) / (math.sqrt(2 * math.pi) * sigma) * fit))

    def candidates(self, x: np.ndarray, y: np.ndarray, heading: np.ndarray, sigma: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each point the classes near it and their log emissions; the wider reach only where the narrower one has none."""
        for a in range(0, len(x), EPOCHS):
            px, py, ahead = x[a : a + EPOCHS], y[a : a + EPOCHS], heading[a : a + EPOCHS]
            left, found = np.arange(len(px)), []
            for reach in REACHES:
                pairs = [(left[p], kinds) for p, kinds in self.grid.pairs(px[left], py[left], reach)]
                found += pairs
                left = np.setdiff1d(left, np.concatenate([p for p, _ in pairs])) if pairs else left
            p, kinds = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (left[:0], left[:0])
            order = np.argsort(p, kind="stable")
            p, kinds = p[order], kinds[order]
            own = self.emissions(px[p], py[p], ahead[p], kinds, sigma)
            bounds = np.searchsorted(p, np.arange(len(px) + 1)).tolist()
            for i, j in zip(bounds, bounds[1:], strict=False):
                yield kinds[i:j], own[i:j]


def _match_held(points: DataFrame, edges: DataFrame, by: list[str], epoch: str, sigma: float) -> DataFrame:
    spark = points.sparkSession
    ship(spark)
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    roads = edges.select(*[F.col(c).cast("long").alias(c) for c in ("u", "v", "key")], *ends).orderBy("u", "v", "key")
    sent = spark.sparkContext.broadcast(RoadMap(roads.toArrow()))

    def run(track: pa.Table) -> pa.Table:
        road = sent.value
        track = track.sort_by(epoch)
        x, y, heading = (track.column(c).cast(pa.float64()).to_numpy() for c in ("x", "y", "heading"))
        path = best_states(road.candidates(x, y, heading, sigma), road.lanes)
        at = np.flatnonzero(path >= 0)
        state = path[at]
        sx, sy = road.foot(x[at], y[at], road.lanes.kind[state])
        kept = track.select([*by, epoch]).take(pa.array(at))
        made = [road.u[state], road.v[state], road.key[state], sx, sy]
        return pa.table([*kept.columns, *map(pa.array, made)], names=[*by, epoch, "u", "v", "key", "snap_x", "snap_y"])

    kinds = [f"`{c}` {points.schema[c].dataType.simpleString()}" for c in [*by, epoch]]
    rows = points.select(*by, epoch, "x", "y", "heading").groupBy(*by)
    return rows.applyInArrow(run, ", ".join([*kinds, "u long", "v long", "key long", "snap_x double", "snap_y double"]))


def _match_joined(points: DataFrame, edges: DataFrame, by: list[str], epoch: str, sigma: float) -> DataFrame:
    """The same with candidates as rows, whatever the number of edges."""
    ship(points.sparkSession)
    near = grid_join_with_fallback(points.select(*by, epoch, "x", "y", "heading"), edges, [*by, epoch], REACHES)
    edge_bearing = bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    fit = heading_factor(F.coalesce(angle_between(F.col("heading"), edge_bearing), F.lit(0.0)))
    distance = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    emission = F.log(F.greatest(F.lit(1e-300), gaussian_emission(distance, sigma) * fit))
    found = near.select(*by, epoch, "u", "v", "key", emission.alias("emission"))
    # every epoch has a row, so that those without candidates are seen
    rows = points.select(*by, epoch).join(found, [*by, epoch], "left")

    def run(track: pd.DataFrame) -> pd.DataFrame:
        names = sorted(track[epoch].unique())
        place = {e: i for i, e in enumerate(names)}
        candidates: dict[int, list] = {}
        for r in track.dropna(subset=["emission"]).itertuples(index=False):
            candidates.setdefault(place[getattr(r, epoch)], []).append(((int(r.u), int(r.v), int(r.key)), r.emission))
        path = decode(candidates, len(names))
        first = {c: track[c].iloc[0] for c in by}
        return pd.DataFrame([{**first, epoch: e, "u": s[0], "v": s[1], "key": s[2]} for e, s in zip(names, path, strict=True) if s is not None], columns=[*by, epoch, "u", "v", "key"])

    kinds = [f"`{c}` {points.schema[c].dataType.simpleString()}" for c in [*by, epoch]]
    matched = rows.groupBy(*by).applyInPandas(run, ", ".join([*kinds, "u long", "v long", "key long"]))
    joined = matched.join(points.select(*by, epoch, "x", "y"), [*by, epoch]).join(edges.select("u", "v", "key", "x1", "y1", "x2", "y2"), ["u", "v", "key"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return joined.select(*by, epoch, "u", "v", "key", (F.col("x1") + t * dx).alias("snap_x"), (F.col("y1") + t * dy).alias("snap_y"))
