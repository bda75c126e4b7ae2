"""Road geometry: edges, ways as text, a synthetic grid [A22-A24]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark import schemas

# The number that ends a way; spacing of roads and of their vertices, in degrees.
WAY_END = 999.99
GRID_STEP, VERTEX_STEP = 0.002, 0.0005


def edges(spark: SparkSession, path: str) -> DataFrame:
    """A stored edge table; downloads are out of scope."""
    return spark.read.schema(schemas.EDGES).parquet(path)


def edges_of_osm(spark: SparkSession, path: str) -> DataFrame:
    """Edges (way, node to node) of an OSM XML file."""
    node = "_id BIGINT, _lat DOUBLE, _lon DOUBLE"
    way = "_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(way).load(path)
    tag = lambda k: F.get(F.filter("tag", lambda t: t["_k"] == k), 0)["_v"]
    pairs = ways.select(F.col("_id").alias("way"), tag("highway").alias("highway"), F.coalesce(tag("oneway") == "yes", F.lit(False)).alias("oneway"), F.posexplode(F.arrays_zip(F.expr("nd._ref").alias("a"), F.expr("slice(nd._ref, 2, size(nd))").alias("b"))).alias("key", "x"))
    pairs = pairs.select("way", "highway", "oneway", "key", F.col("x.a").alias("u"), F.col("x.b").alias("v")).filter("v IS NOT NULL")
    end = lambda n: nodes.select(F.col("_id").alias(n), F.struct(F.col("_lon").alias("x"), F.col("_lat").alias("y")).alias(f"{n}_at"))
    return pairs.join(end("u"), "u").join(end("v"), "v").select("u", "v", "key", "highway", "oneway", F.array("u_at", "v_at").alias("coords"))


def way_segments(lines: DataFrame) -> DataFrame:
    """(way_id, seg_no, lat1, lon1, lat2, lon2) of ``lat lon`` lines; a way that isn't ended is lost."""
    p = F.split(F.trim("line"), r"\s+")
    points = lines.select("file", "line_no", F.get(p, 0).try_cast("double").alias("lat"), F.get(p, 1).try_cast("double").alias("lon")).filter("lat IS NOT NULL")
    w = Window.partitionBy("file").orderBy("line_no")
    ended = F.coalesce(F.sum((F.col("lat") >= WAY_END).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = F.sum((F.col("lat") >= WAY_END).cast("int")).over(Window.partitionBy("file"))
    points = points.withColumn("way_id", ended.cast("long")).withColumn("ways", ends).filter((F.col("lat") < WAY_END) & (F.col("way_id") < F.col("ways")))
    own = Window.partitionBy("file", "way_id").orderBy("line_no")
    return points.select(
        "file", "way_id", (F.row_number().over(own) - 1).alias("seg_no"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
        F.lead("lat").over(own).alias("lat2"), F.lead("lon").over(own).alias("lon2"),
    ).filter("lat2 IS NOT NULL AND lon2 IS NOT NULL")


def road_grid(spark: SparkSession, lat: float, lon: float, radius: float = 0.01) -> DataFrame:
    """(road_id, seq, lat, lon): north-south and east-west roads around a point."""
    roads, vertices = round(2 * radius / GRID_STEP), round(2 * radius / VERTEX_STEP)
    cells = spark.range(roads).withColumnRenamed("id", "road").select("road", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1))).alias("seq"))
    across, along = F.col("road") * GRID_STEP - radius, F.col("seq") * VERTEX_STEP - radius
    south_north = cells.select(F.col("road").alias("road_id"), "seq", (lat + along).alias("lat"), (lon + across).alias("lon"))
    west_east = cells.select((F.col("road") + roads).alias("road_id"), "seq", (lat + across).alias("lat"), (lon + along).alias("lon"))
    return south_north.unionByName(west_east)
