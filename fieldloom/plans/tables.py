"""The library's input tables made from the star schema that tests and benchmarks use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.grid import GridSpec
from fieldloom.operators import quality
from fieldloom.sources import granules
from fieldloom.sources.scratch import new_path

START, END, BASE, MONTHS = (1995, 1), (2001, 11), (1996, 1999), 83
ZONES = (("west", 0, 4), ("middle", 3, 7), ("east", 5, 9))
DIGITS = 9


def grid(spark: SparkSession, sf_dir: str) -> GridSpec:
    return GridSpec(a=0.5, c=68.0, e=-0.5, f=36.0, height=spark.read.parquet(f"{sf_dir}/supplier.parquet").count() // 10, width=10)


def spine(spark: SparkSession) -> DataFrame:
    return granules.month_spine(spark, START, END)


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order line: cell, month, granule, raw value, quality code and whether its month has a quality layer."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_linestatus", "l_quantity", "l_tax")
    n = F.col("l_quantity").cast("int") * 260 - 3000
    t = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    return line.select(
        F.col("l_suppkey").alias("cell_id"), F.floor(F.col("l_suppkey") / 10).cast("int").alias("row"), (F.col("l_suppkey") % 10).cast("int").alias("col"), t.alias("t"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        F.col("l_linestatus").alias("granule"), F.when(F.col("l_linestatus") == "F", n.cast("double")).otherwise(n * 1e-4).alias("raw"), (F.round(F.col("l_tax") * 100).cast("int") % 5 - 1).alias("qa"), (t % 41 != 7).alias("has_qa"),
    )


def expected(spark: SparkSession) -> DataFrame:
    """(t, granule): both granules of every month, as a manifest would list them."""
    return spine(spark).select("t", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("granule"))


def ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw cells by month in the shared folder, and the statistics of every expected granule."""
    return granules.ingest(raw_cells(spark, sf_dir), ["t", "granule"], new_path(spark, "granules"), expected(spark))


def rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rescale(raw_cells(spark, sf_dir), ["t", "granule"])


def mean_by_month(rescaled: DataFrame) -> DataFrame:
    """The cube of rescaled cells: masked, with a mean by cell and month."""
    masked = quality.mask_quality_inline(quality.mask_range(rescaled), F.col("has_qa"))
    return masked.where("v IS NOT NULL").groupBy("cell_id", "row", "col", "t", "year", "month").agg(F.avg("v").alias("v"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mask_quality_inline(quality.mask_range(rescaled(spark, sf_dir)), F.col("has_qa"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean by cell and month."""
    return mean_by_month(rescaled(spark, sf_dir))


def cube_of(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """The same from ingested cells and statistics: one scan of the cells."""
    return mean_by_month(quality.rescale(cells, ["t", "granule"], stats=stats))


def point_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    high = grid(spark, sf_dir).height + 1
    lon = 68.0 + 0.5 * (3 * (F.col("o_custkey") % 5) + (F.col("o_orderkey") % 100 - 50) / F.lit(128.0))
    lat = 36.0 - 0.5 * (F.floor(F.col("o_orderkey") / 7) % high + (F.col("o_orderkey") % 90 - 45) / F.lit(128.0))
    return orders.select(lat.alias("latitude"), lon.alias("longitude"), F.to_date("o_orderdate").alias("acq_date"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = grid(spark, sf_dir).height
    rows = [(name, 68.0 + 0.5 * (a + 0.5), 68.0 + 0.5 * (b + 0.5), 36.0 - 0.5 * high, 36.0) for name, a, b in ZONES]
    return spark.createDataFrame(rows, "zone string, lon_min double, lon_max double, lat_min double, lat_max double")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits and without negative zeros: sums come in another order in another engine. Rounded to more digits first, so that values just beside a half fall to one side."""
    return reduce(lambda d, c: d.withColumn(c, F.round(F.round(c, digits + 3), digits) + F.lit(0.0)), [c for c, kind in df.dtypes if kind == "double"], df)
