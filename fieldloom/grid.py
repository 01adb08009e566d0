"""A north-up raster grid, cell ids, and what maps between cells and coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Powers of two degrees of the finest and the coarsest grid by which boxes are cut.
LEVELS = (-20, 9)


@dataclass(frozen=True)
class GridSpec:
    """Cell sizes a and e (e negative), top left corner (c, f), and shape."""

    a: float
    c: float
    e: float
    f: float
    height: int
    width: int


def cell_id(row: Column, col: Column, grid: GridSpec) -> Column:
    return (row.cast("long") * grid.width + col).cast("long")


def snap_points(points: DataFrame, grid: GridSpec, how: str = "round") -> DataFrame:
    """points with row, col, cell_id and in_bounds. how="round" takes the nearest whole number, half to even; "floor" the cell that holds the point."""
    to = F.rint if how == "round" else F.floor
    out = points.withColumns({"row": to((F.col("latitude") - grid.f) / grid.e).cast("int"), "col": to((F.col("longitude") - grid.c) / grid.a).cast("int")})
    inside = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)
    return out.withColumn("in_bounds", F.coalesce(inside, F.lit(False))).withColumn("cell_id", F.when(F.col("in_bounds"), cell_id(F.col("row"), F.col("col"), grid)))


def cell_centres(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """cells (row, col, ...) with lon and lat of their centres."""
    return cells.withColumns({"lon": F.lit(grid.c) + grid.a * (F.col("col") + 0.5), "lat": F.lit(grid.f) + grid.e * (F.col("row") + 0.5)})


def decimate(cells: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and column, numbered anew; nothing is averaged."""
    return cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).withColumns({"row": F.floor(F.col("row") / stride).cast("int"), "col": F.floor(F.col("col") / stride).cast("int")})


def all_cells(spark, grid: GridSpec) -> DataFrame:
    """(cell_id, row, col) of the whole grid."""
    ids = spark.range(grid.height * grid.width).withColumnRenamed("id", "cell_id")
    return ids.withColumns({"row": F.floor(F.col("cell_id") / grid.width).cast("int"), "col": (F.col("cell_id") % grid.width).cast("int")})


def upscale(coarse: DataFrame, cells: DataFrame, grid: GridSpec, stride: int, how: str = "zoom") -> DataFrame:
    """cells (row, col, ...) with the columns of coarse (row, col, ...) at the nearest coarse cell. how="zoom" stretches index ranges onto each other, "block" divides by the stride."""
    def near(at: Column, n: int) -> Column:
        small = -(-n // stride)
        if how == "block":
            return F.floor(at / stride).cast("int")
        return F.lit(0) if small * stride <= 1 else F.rint(at * ((small - 1) / (small * stride - 1))).cast("int")

    keyed = cells.withColumns({"_row": near(F.col("row"), grid.height), "_col": near(F.col("col"), grid.width)})
    return keyed.join(coarse.withColumnsRenamed({"row": "_row", "col": "_col"}), ["_row", "_col"], "left").drop("_row", "_col")


def assign_zones(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """A row for each cell (lon, lat) and zone box that holds its centre, all edges inclusive; boxes may overlap and there may be many.

    Boxes are cut by grids of powers of two degrees: each by the one whose squares are as wide as it is, so it touches four of them at most. Cells look up their square in each grid
    that some box uses, which is a join by equal squares that Spark broadcasts or deals out by the sizes it finds; then the edges are tested.
    """
    level = F.greatest(F.least(F.ceil(F.log2(F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"), F.lit(2.0**LEVELS[0])))), F.lit(LEVELS[1])), F.lit(LEVELS[0])).cast("int")
    square = lambda x, at: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col(at)))
    boxes = zones.where("lon_min <= lon_max AND lat_min <= lat_max").withColumn("_level", level)
    used = boxes.select("_level").distinct().agg(F.collect_list("_level").alias("_levels"))  # one row, a number for each grid
    for name, x in (("_x", "lon"), ("_y", "lat")):
        boxes = boxes.withColumn(name, F.explode(F.sequence(square(f"{x}_min", "_level"), square(f"{x}_max", "_level"))))
    at = cells.crossJoin(F.broadcast(used)).withColumn("_level", F.explode("_levels")).drop("_levels")
    at = at.withColumns({"_x": square("lon", "_level"), "_y": square("lat", "_level")})
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    return at.join(boxes, ["_level", "_x", "_y"]).where(inside).drop("_level", "_x", "_y", "lon_min", "lon_max", "lat_min", "lat_max")
