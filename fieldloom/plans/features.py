"""The table of ten features per cell, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.grid import GridSpec, all_cells, decimate, upscale
from fieldloom.operators import breakpoint, kendall, points, spatial, temporal
from fieldloom.operators.ranks import draw, smallest
from fieldloom.sources import layout
from fieldloom.sources.scratch import stored

FEATURES = ("f1_mean", "f2_clim_june", "f3_anomaly_mean", "f4_trend_mean", "f5_residual_mean", "f6_mk_tau", "f7_cvsi_mean", "f8_lisa", "f9_below", "f10_points")


def dense_frame(cube: DataFrame, spine: DataFrame, base: tuple[int, int], last_t: int) -> DataFrame:
    """Every month of each observed cell with delta, trend, seasonal and resid: one exchange by cell, all windows on it."""
    dense = temporal.densify(cube.select("cell_id", "t", "year", "month", "v"), spine)
    return temporal.decompose(temporal.anomaly(dense, base), last_t)


def temporal_features(frame: DataFrame, k: int) -> DataFrame:
    """F1 to F7, in one aggregation over the frame's partitioning; the trend's values go to the trend test as one list for each cell."""
    stress = temporal.cvsi_columns(range(k, k + 1))[f"cvsi_{k}"]
    out = frame.withColumn("_s", stress).groupBy("cell_id").agg(
        F.avg("v").alias("f1_mean"), F.max(F.when(F.col("month") == 6, F.col("clim"))).alias("f2_clim_june"), F.avg("delta").alias("f3_anomaly_mean"),
        F.avg("trend").alias("f4_trend_mean"), F.avg("resid").alias("f5_residual_mean"), kendall.in_order("trend").alias("_x"), F.avg("_s").alias("f7_cvsi_mean"),
    )
    tested = out.withColumn("_c", kendall.counted("_x")).withColumn("f6_mk_tau", kendall.statistics(F.col("_c"))["tau"])
    return tested.select("cell_id", *FEATURES[:7])


def coarse_classes(means: DataFrame, grid: GridSpec, stride: int, **how) -> DataFrame:
    """(row, col, cls, ...) of the local clusters of the decimated, filled mean map."""
    dense = all_cells(means.sparkSession, grid).join(means.select("cell_id", "f1_mean"), "cell_id", "left")
    filled = spatial.fill_row_mean(decimate(dense, stride), "f1_mean")
    return spatial.lisa(filled.select("row", "col", "f1_mean", "filled"), had_data="f1_mean", **how)


def features(cube: DataFrame, snapped: DataFrame, spine: DataFrame, grid: GridSpec, base: tuple[int, int], k: int, theta: float, stride: int = 8, **how) -> DataFrame:
    """cell_id, row, col and the ten features of every cell of the grid. The cube moves once, into blocks of cells; F1 to F7 come from one pass over these."""
    last_t = spine.agg(F.max("t")).first()[0]  # one number, from one row for each month
    laid = layout.by_cell(cube, layout.blocks(cube.sparkSession, grid.height * grid.width, last_t + 1))
    timed = stored(temporal_features(dense_frame(laid, spine, base, last_t), k), "timed")
    cells = all_cells(cube.sparkSession, grid)
    wide = cells.join(timed, "cell_id", "left").join(points.rasterize_count(snapped).select("cell_id", F.col("n_points").alias("f10_points")), "cell_id", "left")
    coarse = coarse_classes(timed, grid, stride, **how).select("row", "col", F.col("cls").alias("f8_lisa"))
    out = breakpoint.below_threshold(upscale(coarse, wide, grid, stride), theta).withColumn("f10_points", F.coalesce("f10_points", F.lit(0)))
    return out.select("cell_id", "row", "col", *FEATURES)


def feature_summary(table: DataFrame) -> DataFrame:
    """(feature, n, mean, min, max) of each feature."""
    stats = [F.struct(F.lit(f).alias("feature"), F.count(f).alias("n"), F.avg(F.col(f).cast("double")).alias("mean"), F.min(F.col(f).cast("double")).alias("min"), F.max(F.col(f).cast("double")).alias("max")) for f in FEATURES]
    return table.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))


def lag_scores(index: DataFrame, dated: DataFrame, burned: DataFrame, ks: range = range(1, 7), bins: int = 10, seed: int = 42, least: int = 50) -> DataFrame:
    """(k, mi, n_pos, n_neg): mutual information of each lag's index with having points, against an equal number of cell-months without.

    Cell-months are marked and hashed once for all lags. The sample of a lag is what has the smallest hashes, found by counts of hashes; no task has a class or a lag as a whole.
    """
    n = dated.groupBy("cell_id", "t").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    hit = burned.select("cell_id").distinct().withColumn("_hit", F.lit(True))
    marked = index.join(n, ["cell_id", "t"], "left").join(hit, "cell_id", "left").where("_n IS NOT NULL OR _hit IS NULL")
    marked = stored(marked.select("cell_id", "t", "_n", *[F.when(F.col("t") >= k, F.col(f"cvsi_{k}")).alias(f"cvsi_{k}") for k in ks], draw(["cell_id", "t"], seed).alias("_h")), "marked")
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cvsi_{k}").alias("x")) for k in ks])
    long = marked.select("cell_id", "t", "_n", "_h", F.inline(lags)).where("x IS NOT NULL")
    positives, negatives = long.where("_n IS NOT NULL"), long.where("_n IS NULL")
    drawn = smallest(negatives, ["k"], "_h", ["cell_id", "t"], positives.groupBy("k").agg(F.sum("_n").alias("n")))
    repeated = positives.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    balanced = repeated.select("k", F.lit(1).alias("y"), "x").unionByName(drawn.select("k", F.lit(0).alias("y"), "x"))
    return points.mutual_information(points.quantile_bins(stored(balanced, "balanced"), ["k"], "x", bins), ["k"], least)
