"""Joins by time, place and position [D3, D5, D8-D11, D13, D14].

Range conditions become equi-joins on buckets or grid cells, so that they are hashed and shuffled, never nested
loops over both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.geo import foot_of_perpendicular
from trajspark.operators.base import UNBOUNDED
from trajspark.operators.segments import SegmentGrid
from trajspark.shipping import ship

#: Numbers of the training vectors that one broadcast holds (32 MB), and of the distances that a worker holds at a time.
TRAIN_VALUES, PAIR_VALUES = 1 << 22, 1 << 20
#: Segments of different ends that are broadcast, 32 MB; a worker's grid of them takes some 200 bytes for each.
HELD_SEGMENTS = 1 << 20
#: Largest estimated size, in bytes, of a side that is broadcast.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the plan's own size estimate is under BROADCAST_BYTES; otherwise Spark chooses."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before its time: one union, one window."""
    cols = [*left.columns, *[c for c in values if c not in left.columns]]
    l = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(_struct(right, values)))  # noqa: E741
    r = right.select(*by, time, F.struct(*values).alias("__v"), *([F.col(tie)] if tie and tie not in by else []))
    r = r.withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    order = [time, "__side", *([tie] if tie else [])]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(UNBOUNDED, 0)
    found = both.withColumn("__found", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return found.withColumns({c: F.col(f"__found.{c}") for c in values}).select(*cols)


def _struct(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("x")).schema["x"].dataType


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, key: list[str], values: list[str], tolerance: float, tie: str) -> DataFrame:
    """Each left row with its nearest right row less than ``tolerance`` away, the first by ``tie`` of equal ones [D5].

    One union, sorted by time: the last right row at or before a left row, and the first one at or after it. No pairs
    are made, however dense the streams are. Of right rows at one time only the first by ``tie`` can match. Left rows
    without a match, or without a time, keep nulls. key: not needed, kept for callers that name it.
    """
    names = [f.name for f in left.schema.fields]
    value = F.struct(F.col(time).alias("t"), F.col(tie).alias("tie"), F.struct(*values).alias("v"))
    r = right.filter(F.col(time).isNotNull()).groupBy(*by, time).agg(F.min_by(value, tie).alias("__v"))
    r = r.withColumn("__left", F.lit(False))
    l = left.withColumn("__left", F.lit(True))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time)
    # peers of one time are in both frames, so a right row of the same time is seen from either side
    before = F.last("__v", ignorenulls=True).over(w.rangeBetween(UNBOUNDED, 0))
    after = F.last("__v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col(time).desc()).rangeBetween(UNBOUNDED, 0))
    found = both.withColumns({"__a": before, "__z": after}).filter("__left")
    away = lambda c: F.abs(F.col(f"{c}.t") - F.col(time))
    rank = lambda c: F.when(away(c) < tolerance, F.struct(away(c).alias("away"), F.col(f"{c}.tie").alias("tie"), F.col(f"{c}.v").alias("v")))
    first = F.when(rank("__z").isNull(), rank("__a")).when(rank("__a").isNull(), rank("__z"))
    nearer = F.when(F.struct(away("__z"), F.col("__z.tie")) < F.struct(away("__a"), F.col("__a.tie")), rank("__z")).otherwise(rank("__a"))
    best = found.withColumn("__best", F.coalesce(first, nearer))
    return best.select(*names, *[F.col(f"__best.v.{c}").alias(c) for c in values])


def cell(column: Column, size: float) -> Column:
    return F.floor(column / size).cast("long")


def cells_of_box(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Array of the grid cells that a box touches."""
    xs = F.sequence(cell(F.least(x1, x2), size), cell(F.greatest(x1, x2), size))
    ys = F.sequence(cell(F.least(y1, y2), size), cell(F.greatest(y1, y2), size))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def grid_range_join(points: DataFrame, boxes: DataFrame, reach: float) -> DataFrame:
    """points(x, y) and boxes(x1, y1, x2, y2): pairs whose box, grown by ``reach``, holds the point [D8].

    Boxes are exploded to the cells, as wide as the reach, that they touch; points have one cell, so a pair meets once. Box columns
    keep their names and must differ from the points'.
    """
    grown = cells_of_box(F.least("x1", "x2") - reach, F.least("y1", "y2") - reach, F.greatest("x1", "x2") + reach, F.greatest("y1", "y2") + reach, reach)
    dealt = boxes.withColumn("__c", F.explode(grown)).select("*", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy")).drop("__c")
    placed = points.withColumn("__cx", cell(F.col("x"), reach)).withColumn("__cy", cell(F.col("y"), reach))
    inside = F.col("x").between(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach) & F.col("y").between(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach)
    return placed.join(dealt, ["__cx", "__cy"]).filter(inside).drop("__cx", "__cy")


def grid_join_with_fallback(points: DataFrame, boxes: DataFrame, point_key: list[str], reaches: tuple[float, ...] = (50.0, 200.0)) -> DataFrame:
    """The wider reach only for points that the narrower one leaves without a pair."""
    out, left = None, points
    for reach in reaches:
        found = grid_range_join(left, boxes, reach)
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(*point_key).distinct(), point_key, "left_anti")
    return out


def nearest_segment(points: DataFrame, segments: DataFrame, reach: float, point_key: list[str], segment_key: list[str]) -> DataFrame:
    """Each point with the nearest segment (x1, y1, x2, y2) that holds its foot [D9, K5]; nulls if there is none.

    The direction from one end to the foot and the one from the foot to the other end agree exactly if the foot
    lies between the ends, so that is the test. Only segments whose box lies within ``reach`` are looked at, by
    grid cells; the foot is worked out for the nearest one alone. Of segments with the same ends only the one of least key
    can be it. Up to ``HELD_SEGMENTS`` are broadcast, and points pass over them as Arrow batches; more are joined.
    """
    ends = ["x1", "y1", "x2", "y2"]
    whole = segments.filter(" AND ".join(f"{c} IS NOT NULL" for c in ends))
    distinct = whole.groupBy(*ends).agg(F.min(F.struct(*segment_key)).alias("__k")).select("__k.*", *ends)
    held = distinct.limit(HELD_SEGMENTS + 1).count()
    found = (_nearest_of_held if held <= HELD_SEGMENTS else _nearest_by_join)(points, distinct, reach, point_key, segment_key)
    _, fx, fy = foot_of_perpendicular(F.col("x"), F.col("y"), *[F.col(f"__s.{c}") for c in ends])
    return found.select(*points.columns, *[F.col(f"__s.{c}").alias(c) for c in [*segment_key, "distance"]], fx.alias("fx"), fy.alias("fy"))


def _nearest_of_held(points: DataFrame, segments: DataFrame, reach: float, point_key: list[str], segment_key: list[str]) -> DataFrame:
    """points with __s(segment_key, distance, x1, y1, x2, y2)."""
    spark = points.sparkSession
    ship(spark)
    ends = ["x1", "y1", "x2", "y2"]
    rows = segments.select(*segment_key, *[F.col(c).cast("double").alias(c) for c in ends]).orderBy(*segment_key, *ends).toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast((rows, SegmentGrid(np.stack([rows.column(c).to_numpy() for c in ends], axis=1))))
    columns, names = points.columns, [*segment_key, "distance", *ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grid = sent.value
        for batch in batches:
            x, y = (pc.cast(batch.column(c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            best, distance = grid.nearest(x, y, reach)
            near = known.take(pa.array(best, mask=best < 0))
            arrays = [near.column(c).combine_chunks() for c in [*segment_key, *ends]]
            arrays.insert(len(segment_key), pa.array(distance, mask=best < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, names, mask=pa.array(best < 0))], names=[*columns, "__s"])

    kinds = [f"`{c}` {segments.schema[c].dataType.simpleString()}" if c in segment_key else f"`{c}` double" for c in names]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields]
    return points.mapInArrow(run, ", ".join([*fields, f"`__s` struct<{', '.join(k.replace(' ', ': ', 1) for k in kinds)}>"]))


def _nearest_by_join(points: DataFrame, segments: DataFrame, reach: float, point_key: list[str], segment_key: list[str]) -> DataFrame:
    """The same with pairs as rows, whatever the number of segments."""
    near = grid_range_join(points, segments, reach)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = (F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy
    across = F.abs((F.col("x") - F.col("x1")) * dy - (F.col("y") - F.col("y1")) * dx)
    length = dx * dx + dy * dy
    found = near.filter((length > 0) & (along >= 0) & (along <= length)).withColumn("distance", across / F.sqrt(length))
    best = found.groupBy(*point_key).agg(F.min_by(F.struct(*segment_key, "distance", "x1", "y1", "x2", "y2"), F.struct("distance", *segment_key)).alias("__s"))
    return points.join(best, point_key, "left")


def zip_join(channels: dict[str, DataFrame], by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Rows of channels joined by position; the first channel drives [D13]. Rows without a partner keep nulls."""
    tagged = None
    for i, (name, df) in enumerate(channels.items()):
        own = df.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).alias("pos"), F.lit(name).alias("__ch"), F.col(value).cast("double").alias("__v"), F.lit(i == 0).alias("__first"))
        tagged = own if tagged is None else tagged.unionByName(own)
    out = tagged.groupBy(*by, "pos").agg(*[F.max(F.when(F.col("__ch") == n, F.col("__v"))).alias(n) for n in channels], F.max("__first").alias("__first"))
    return out.filter("__first").drop("__first")


def locf_merge(streams: dict[str, DataFrame], by: list[str], order: list[str], values: dict[str, list[str]], initial: float = 0.0) -> DataFrame:
    """Streams interleaved in time, each row with the last values of all of them [D14, H2, G6]."""
    from trajspark.operators.windows import carry_forward

    merged = None
    for rank, (name, df) in enumerate(streams.items()):
        own = df.select(*by, *order, *values[name], F.lit(name).alias("source"), F.lit(rank).alias("__rank"))
        merged = own if merged is None else merged.unionByName(own, allowMissingColumns=True)
    columns = [c for cs in values.values() for c in cs]
    return carry_forward(merged, by, [*order, "__rank"], columns, initial).drop("__rank")


def euclidean_matrix(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of the rows of two matrices [I16], summed dimension by dimension as the column function does."""
    total = np.zeros((len(q), len(t)))
    for a, b in zip(q.T, t.T, strict=True):
        d = a[:, None] - b[None, :]
        total += d * d
    return np.sqrt(total)


def bhattacharyya_matrix(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of histograms, 0 if either is empty [I32]."""
    shared, sum_q, sum_t = np.zeros((len(q), len(t))), np.zeros(len(q)), np.zeros(len(t))
    for a, b in zip(q.T, t.T, strict=True):
        shared += np.sqrt(a[:, None] * b[None, :])
        sum_q, sum_t = sum_q + a, sum_t + b
    norm = np.sqrt(sum_q[:, None] * sum_t[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm == 0, 0.0, np.sqrt(np.maximum(0.0, 1 - shared / norm)))


def k_least(distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 1) of the k least of each row, those of equal distance by column. NaN is never one."""
    distances = np.where(np.isnan(distances), np.inf, distances)
    k = min(k, distances.shape[1])
    limit = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero((distances <= limit) & (distances < np.inf))
    order = np.lexsort((column, distances[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    return row[rank <= k], column[rank <= k], rank[rank <= k]


def by_length(rows: pa.RecordBatch | pa.Table, vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows with vectors of each length, as one batch, and their vectors as a matrix."""
    lengths = np.asarray(pc.list_value_length(rows.column(vector)))
    for d in np.unique(lengths):
        same = rows.take(pa.array(np.flatnonzero(lengths == d)))
        if isinstance(same, pa.Table):
            same = same.combine_chunks().to_batches()[0]
        yield same, same.column(vector).flatten().to_numpy().reshape(len(same), d)


def nearest_neighbours(queries: DataFrame, train: DataFrame, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], query_vector: str, train_vector: str, query_key: list[str], train_key: list[str], k: int = 5) -> DataFrame:
    """The k nearest training rows of each query, ranked; ties by training key [D10, D11, G4].

    Training rows are broadcast in blocks of at most about ``TRAIN_VALUES`` numbers, in turn: queries pass over each
    in Arrow batches as matrices, so pairs are never rows and queries aren't shuffled. A model's training set is
    one block; with more, the k candidates of each block are merged by query. Vectors of another length, or null,
    or with a null in them have no neighbours and are none.
    """
    spark = queries.sparkSession
    ship(spark)
    size = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(train_vector)), F.lit(1)).alias("d")).first()
    blocks = max(1, -(-size["n"] * max(1, size["d"]) // TRAIN_VALUES))
    types = {**{c: queries.schema[c].dataType for c in query_key}, **{c: train.schema[c].dataType for c in train_key}}
    schema = ", ".join([*[f"`{c}` {types[c].simpleString()}" for c in query_key], "rank int", "distance double", *[f"`{c}` {types[c].simpleString()}" for c in train_key]])
    whole = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    asked = queries.filter(whole(query_vector)).select(*query_key, F.col(query_vector).cast("array<double>").alias("__q"))
    known = train.filter(whole(train_vector)).select(*train_key, F.col(train_vector).cast("array<double>").alias("__t"))

    def against(block: int) -> DataFrame:
        own = known.filter(F.pmod(F.xxhash64(*train_key), F.lit(blocks)) == block) if blocks > 1 else known
        sent = spark.sparkContext.broadcast(list(by_length(own.orderBy(*train_key).toArrow(), "__t")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {vectors.shape[1]: (rows, vectors) for rows, vectors in sent.value}
            for batch in batches:
                for rows, asked in by_length(batch, "__q"):
                    trained, vectors = known.get(asked.shape[1], (None, None))
                    step = max(1, PAIR_VALUES // len(vectors)) if trained else len(asked)
                    for i in range(0, len(asked) if trained else 0, step):
                        found = distance(asked[i : i + step], vectors)
                        row, column, rank = k_least(found, k)
                        left, right = rows.take(pa.array(row + i)), trained.take(pa.array(column))
                        arrays = [*(left.column(c) for c in query_key), pa.array(rank, pa.int32()), pa.array(found[row, column]), *(right.column(c) for c in train_key)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*query_key, "rank", "distance", *train_key])

        return asked.mapInArrow(run, schema)

    best = against(0)
    if blocks == 1:
        return best
    for block in range(1, blocks):
        best = best.unionByName(against(block))
    near = F.struct("distance", *train_key)
    merged = best.groupBy(*query_key).agg(F.slice(F.array_sort(F.collect_list(near)), 1, k).alias("__b"))
    return merged.select(*query_key, F.posexplode("__b").alias("__i", "__n")).select(*query_key, (F.col("__i") + 1).alias("rank"), "__n.*")


def vote(neighbours: DataFrame, query_key: list[str], label: str) -> DataFrame:
    """The most frequent label, the lowest of equal ones [E21]."""
    counts = neighbours.groupBy(*query_key, label).agg(F.count("*").alias("__c"))
    return counts.groupBy(*query_key).agg(F.min_by(label, F.struct(-F.col("__c"), F.col(label))).alias(label), F.max("__c").alias("votes"))


def knn_condition(queries: DataFrame, train: DataFrame, features: str = "features", query_key: tuple[str, ...] = ("query_id",), k: int = 5) -> DataFrame:
    """Road condition by votes of the nearest feature vectors [K6]. train(train_id, train_features, class)."""
    found = nearest_neighbours(queries, train, euclidean_matrix, features, "train_features", list(query_key), ["train_id", "class"], k)
    return vote(found, list(query_key), "class")


def knn_surface(queries: DataFrame, train: DataFrame, query_key: tuple[str, ...] = ("query_id",), k: int = 5) -> DataFrame:
    """Road surface in two levels [K7]: tar or mixed by value histograms, then mud or concrete by saturation histograms.

    queries(value_hist, sat_hist); train(train_id, train_hist, class) with classes tar and mudcon for the first
    level, mud and con for the second. Only mixed queries go to the second level.
    """
    key = list(query_key)

    def level(rows: DataFrame, hist: str, classes: tuple[str, str]) -> DataFrame:
        own = train.filter(F.col("class").isin(*classes))
        return vote(nearest_neighbours(rows, own, bhattacharyya_matrix, hist, "train_hist", key, ["train_id", "class"], k), key, "class")

    first = level(queries, "value_hist", ("tar", "mudcon"))
    mixed = queries.join(first.filter("class = 'mudcon'").select(*key), key, "left_semi")
    return first.filter("class = 'tar'").unionByName(level(mixed, "sat_hist", ("mud", "con")))
