"""Scale, range and quality masks of raw cells, and profiles of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_LOW, RAW_HIGH, SCALE, SWITCH, NODATA = -2000, 10000, 1e-4, 2.0, -3000.0
LOW, HIGH, GOOD = -0.2, 1.0, (0, 1)


def rescale(cells: DataFrame, by: list[str], nodata: float | None = NODATA, stats: DataFrame | None = None) -> DataFrame:
    """cells (raw, ...) with v. A granule whose largest value is over 2 holds scaled integers: those in range times 1e-4 stay. In others only nodata goes.

    stats (by, largest) come from ingest, a row for each granule, and leave one scan of the cells; without them they are made by an aggregate that reads the cells first.
    """
    present = F.col("raw") if nodata is None else F.when(F.col("raw") != nodata, F.col("raw"))
    largest = cells.groupBy(*by).agg(F.max(present).alias("_max")) if stats is None else stats.select(*by, F.col("largest").alias("_max"))
    scaled = F.when(F.col("raw").between(RAW_LOW, RAW_HIGH), F.col("raw") * SCALE)
    return cells.join(largest, by, "left").withColumn("v", F.when(F.col("_max") > SWITCH, scaled).otherwise(present)).drop("_max")


def mask_range(cells: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """v outside [low, high] becomes null."""
    return cells.withColumn("v", F.when(F.col("v").between(low, high), F.col("v")))


def mask_quality(values: DataFrame, quality: DataFrame, month: list[str], cell: list[str], good: tuple[int, ...] = GOOD) -> DataFrame:
    """v where the quality code is good. Months without a quality layer stay as they are; a cell that its month's layer lacks goes to null."""
    layers = quality.select(*month).distinct().withColumn("_has", F.lit(True))
    joined = values.join(layers, month, "left").join(quality.select(*month, *cell, "qa"), [*month, *cell], "left")
    keep = F.col("_has").isNull() | F.coalesce(F.col("qa").isin(*good), F.lit(False))
    return joined.withColumn("v", F.when(keep, F.col("v"))).drop("_has", "qa")


def mask_quality_inline(cells: DataFrame, has_layer, good: tuple[int, ...] = GOOD) -> DataFrame:
    """The same where both bands are in one row (v, qa): no join."""
    return cells.withColumn("v", F.when(~has_layer | F.coalesce(F.col("qa").isin(*good), F.lit(False)), F.col("v")))


def profile(cells: DataFrame, n_cells: int, n_months: int, stats: DataFrame | None = None) -> DataFrame:
    """Shape, range and missing share of a cube (cell_id, t, v); with the granules' statistics also how many there are, how many of them failed, and how many hold nothing but nodata."""
    shape = cells.agg(F.count("v").alias("n_valid"), F.count_distinct("cell_id").alias("n_cells"), F.count_distinct("t").alias("n_months"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), (1 - F.count("v") / F.lit(float(n_cells * n_months))).alias("missing"))
    if stats is None:
        return shape
    granules = stats.agg(F.count(F.lit(1)).alias("n_granules"), F.count_if(~F.col("readable")).alias("n_failed"), F.count_if(F.col("readable") & (F.col("n_present") == 0)).alias("n_blank"))
    return shape.crossJoin(F.broadcast(granules))  # one row each


def months_with_layer(cells: DataFrame, has_layer: str = "has_qa", month: str = "t") -> DataFrame:
    """(months, with_layer): months that are there, and those of them with a quality layer."""
    return cells.agg(F.count_distinct(month).alias("months"), F.count_distinct(F.when(F.col(has_layer), F.col(month))).alias("with_layer"))


def qa_stats(quality: DataFrame, month: str = "t") -> DataFrame:
    """Cells by month and quality code."""
    return quality.groupBy(month, "qa").agg(F.count(F.lit(1)).alias("n"))
