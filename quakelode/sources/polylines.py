"""Polylines as segments, and attributes of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelode.functions.geo import albers_xy
from quakelode.operators.selection import percentiles

GEOJSON = "features array<struct<geometry:struct<type:string,coordinates:string>>>"


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, seq, latitude, longitude) of the LineStrings and MultiLineStrings of a GeoJSON file."""
    shapes = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.posexplode("features").alias("f", "x")).select("f", "x.geometry.*")
    single = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    lines = shapes.withColumn("l", F.when(F.col("type") == "LineString", single).when(F.col("type") == "MultiLineString", many)).select("f", F.posexplode("l").alias("part", "line"))
    lines = lines.select(F.concat_ws("/", "f", "part").alias("line_id"), F.posexplode("line").alias("seq", "p"))
    return lines.select("line_id", "seq", F.col("p")[1].alias("latitude"), F.col("p")[0].alias("longitude"))


def segments(vertices: DataFrame) -> DataFrame:
    """(line_id, seq, ends in degrees and projected metres): each vertex with the next of its line; a lone vertex is a segment of its own."""
    w = Window.partitionBy("line_id").orderBy("seq")
    both = vertices.withColumn("lat2", F.lead("latitude").over(w)).withColumn("lon2", F.lead("longitude").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("line_id")))
    both = both.where("lat2 is not null or n = 1").select("line_id", "seq", F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"), F.coalesce("lat2", "latitude").alias("lat2"), F.coalesce("lon2", "longitude").alias("lon2"))
    x1, y1 = albers_xy(F.col("lat1"), F.col("lon1"))
    x2, y2 = albers_xy(F.col("lat2"), F.col("lon2"))
    return both.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def with_elevation(cells: DataFrame, elevations: DataFrame, key: str) -> DataFrame:
    """Adds elevation; cells without one get the median of those that have one, and null if none has."""
    joined = cells.join(elevations.select(key, "elevation"), key, "left")
    middle = percentiles(joined, [], {"middle": F.col("elevation")}, [0.5]).select(F.col("middle")[0].alias("middle"))
    return joined.crossJoin(F.broadcast(middle)).withColumn("elevation", F.coalesce("elevation", "middle")).drop("middle")
