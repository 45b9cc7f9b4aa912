"""Naming positions by the place book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.geo import haversine_m

#: The smallest grid cells' size in degrees, about 1.1 km north to south. A cell of level n is 2^n times as wide.
CELL = 0.01
#: The level whose one cell is wider than the globe.
TOP_LEVEL = 16
_METRES_A_DEGREE = 111_000


def _size(level: Column) -> Column:
    return F.lit(CELL) * F.pow(F.lit(2.0), level)


def covering_cells(places: DataFrame) -> DataFrame:
    """places (p_lat, p_lon, p_radius in metres) with the cells (_level, _y, _x) that their circles touch, a row each.

    A place goes to the level whose cells are as wide as its circle, so it has two rows of cells and at most six cells a row,
    whatever its radius. Circles go on beyond the date line; one that holds a pole has all longitudes."""
    reach = F.least(F.col("p_radius") / _METRES_A_DEGREE, F.lit(180.0))
    held = F.abs("p_lat") + reach >= 89.999
    across = F.degrees(F.asin(F.least(F.sin(F.radians(reach)) / F.cos(F.radians("p_lat")), F.lit(1.0))))
    p = places.withColumns({"_reach": reach, "_wide": F.when(held, 180.0).otherwise(across + 1e-6)})
    p = p.withColumn("_level", F.ceil(F.log2(F.greatest(2 * F.col("_reach"), 2 * F.col("_wide"), F.lit(CELL)) / CELL)).cast("int"))
    size, lon = _size(F.col("_level")), F.pmod(F.col("p_lon") + 180, F.lit(360.0)) - 180

    def cells(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(F.floor(low / size), F.floor(high / size))).otherwise(F.array().cast("array<bigint>"))

    turns = [cells(F.greatest(lon - F.col("_wide") + t, F.lit(-180.0)), F.least(lon + F.col("_wide") + t, F.lit(180.0))) for t in (-360, 0, 360)]
    p = p.withColumn("_y", F.explode(cells(F.col("p_lat") - F.col("_reach"), F.col("p_lat") + F.col("_reach"))))
    return p.withColumn("_x", F.explode(F.array_distinct(F.concat(*turns)))).drop("_reach", "_wide")


def match_places(points: DataFrame, places: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with label, distance_m, everyday and categories of the nearest place that contains them (nulls without one).

    Places are spread over the grid cells that their circles touch, each on the level of its size; points are looked up once on
    each level that places have (at most TOP_LEVEL + 1). So points meet only the places around them: an equality join on cells
    that Spark broadcasts or shuffles by the sizes it sees. key: a unique column of points."""
    p = places.select(
        F.col("name").alias("p_label"), F.col("lat").cast("double").alias("p_lat"), F.col("lon").cast("double").alias("p_lon"), F.col("radius_m").cast("double").alias("p_radius"), "everyday", "categories"
    ).dropna(subset=["p_label", "p_lat", "p_lon", "p_radius"]).filter("p_radius >= 0")
    p = covering_cells(p)
    levels = [F.lit(r[0]) for r in p.select("_level").distinct().collect()]  # at most TOP_LEVEL + 1
    at = points.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).filter("_lat is not null and _lon is not null")
    at = at.withColumn("_level", F.explode(F.array(*levels).cast("array<int>")))
    size = _size(F.col("_level"))
    at = at.withColumn("_y", F.floor(F.col("_lat") / size)).withColumn("_x", F.floor((F.pmod(F.col("_lon") + 180, F.lit(360.0)) - 180) / size))
    distance = haversine_m(F.col("_lat"), F.col("_lon"), F.col("p_lat"), F.col("p_lon"))
    hits = at.join(p, ["_level", "_y", "_x"]).withColumn("_d", distance).filter(F.col("_d") <= F.col("p_radius"))
    nearest = hits.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_d", "p_label"))).filter("_k = 1")
    found = nearest.select(
        key,
        F.col("p_label").alias("label"),
        F.round("_d", 1).alias("distance_m"),
        F.coalesce("everyday", F.lit(False)).alias("everyday"),
        F.when(F.size("categories") > 0, F.col("categories")).alias("categories"),
    )
    return points.join(found, key, "left")


def unlabelled(stays: DataFrame, grid: float = 0.001) -> DataFrame:
    """Stays without a name by grid cell, as raw material for naming places. stays: id, lat, lon, label, duration_seconds."""
    cell = lambda c: (F.floor(F.col(c) / grid) * grid)
    free = stays.filter("label is null and lat is not null and lon is not null")
    return (
        free.groupBy(F.round(cell("lat"), 6).alias("cell_lat"), F.round(cell("lon"), 6).alias("cell_lon"))
        .agg(F.count(F.lit(1)).alias("stays"), F.sum("duration_seconds").alias("seconds"))
    )
