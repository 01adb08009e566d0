"""Per-cell statistics over time. A cube has (cell_id, t, year, month, v), valid rows only; t counts months.

All windows are over cell_id, or cell_id and more, so after one repartition by cell_id none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 12


def by_cell() -> Window:
    return Window.partitionBy("cell_id").orderBy("t")


def in_years(years: tuple[int, int]) -> Column:
    return F.col("year").between(*years)


def mean_map(cube: DataFrame) -> DataFrame:
    return cube.groupBy("cell_id").agg(F.avg("v").alias("f1_mean"))


def coverage_map(cube: DataFrame, months: int) -> DataFrame:
    """Share of months without a value."""
    return cube.groupBy("cell_id").agg((1 - F.count("v") / F.lit(float(months))).alias("missing"))


def national_series(cube: DataFrame) -> DataFrame:
    return cube.groupBy("t").agg(F.avg("v").alias("mean_v"), F.count("v").alias("n"))


def wet_season(cube: DataFrame, months: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    return cube.withColumn("wet", F.col("month").isin(*months))


def climatology(cube: DataFrame, base: tuple[int, int]) -> DataFrame:
    """Mean by cell and calendar month over the baseline years; cells and months without baseline values have none."""
    return cube.where(in_years(base)).groupBy("cell_id", "month").agg(F.avg("v").alias("clim"))


def anomaly(cube: DataFrame, base: tuple[int, int]) -> DataFrame:
    """cube with clim and delta = v - clim, by a window over the cell's partition."""
    clim = F.avg(F.when(in_years(base), F.col("v"))).over(Window.partitionBy("cell_id", "month"))
    return cube.withColumn("clim", clim).withColumn("delta", F.col("v") - F.col("clim"))


def anomaly_mean(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("cell_id").agg(F.avg("delta").alias("f3_anomaly_mean"))


def anomaly_range(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.avg("delta").alias("mean_delta"))


def slice_month(cube: DataFrame, spine: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of a month, or of the spine's middle month if the spine lacks it. The month is a scalar subquery on year and month: of a cube stored by month, only the month's folder is read."""
    asked = (F.col("year") == year) & (F.col("month") == month)
    there = F.max(asked).over(Window.partitionBy(F.lit(1)))  # a row for each month
    wanted = spine.withColumns({"_there": there, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))}).where(F.when(F.col("_there"), asked).otherwise(F.col("t") == F.floor(F.col("_n") / 2)))
    only = lambda c: wanted.agg(F.max(c)).scalar()
    return cube.where((F.col("year") == only("year")) & (F.col("month") == only("month")))


def densify(cube: DataFrame, spine: DataFrame) -> DataFrame:
    """Every month of the spine for every observed cell; v is null in gaps. spine: one row for each month, broadcast.

    A cell's months meet once, as a list no longer than the spine, and the missing ones are added there: one shuffle, by cell, which all windows then use.
    """
    others = [c for c in cube.columns if c not in ("cell_id", "year", "month")]
    kinds = {f.name: f.dataType for f in cube.schema.fields}
    months = spine.agg(F.collect_list(F.col("t").cast(kinds["t"])).alias("_ts"))  # one row
    cells = cube.groupBy("cell_id").agg(F.collect_list(F.struct(*others)).alias("_o")).crossJoin(F.broadcast(months))
    gap = lambda t: F.struct(*[(t if c == "t" else F.lit(None).cast(kinds[c])).alias(c) for c in others])
    missing = F.transform(F.array_except("_ts", F.transform("_o", lambda x: x["t"])), gap)
    return cells.select("cell_id", F.inline(F.concat("_o", missing))).join(F.broadcast(spine.select("t", "year", "month")), "t")


def trend(v: Column, last_t: int, period: int = PERIOD) -> Column:
    """Centred moving average of period + 1 months with half weights at the ends, over the months present; defined half a period from both ends."""
    half = period // 2
    a, b = by_cell().rangeBetween(-half, half - 1), by_cell().rangeBetween(1 - half, half)
    mean = (F.coalesce(F.sum(v).over(a), F.lit(0.0)) + F.coalesce(F.sum(v).over(b), F.lit(0.0))) / F.nullif(F.count(v).over(a) + F.count(v).over(b), F.lit(0))
    return F.when(F.col("t").between(half, last_t - half), mean)


def ma_trend(dense: DataFrame, last_t: int, period: int = PERIOD) -> DataFrame:
    """dense (every month of a cell, v null in gaps) with trend. last_t: the last month's t."""
    return dense.withColumn("trend", trend(F.col("v"), last_t, period))


def decompose(dense: DataFrame, last_t: int, period: int = PERIOD) -> DataFrame:
    """dense with trend, seasonal (mean of v - trend by calendar month) and resid."""
    detrended = F.col("v") - F.col("trend")
    out = ma_trend(dense, last_t, period).withColumn("seasonal", F.avg(detrended).over(Window.partitionBy("cell_id", "month")))
    return out.withColumn("resid", detrended - F.col("seasonal"))


def decompose_summary(parts: DataFrame) -> DataFrame:
    return parts.groupBy("cell_id").agg(F.avg("trend").alias("f4_trend_mean"), F.avg("resid").alias("f5_residual_mean"), F.stddev_pop("resid").alias("residual_std"))


def cvsi_columns(ks: range = range(1, 7)) -> dict[str, Column]:
    """cvsi_k: falls below the climatology summed over the k months before t, if max(1, k // 2) of them are present."""
    def one(k: int) -> Column:
        frame = by_cell().rangeBetween(-k, -1)
        enough = (F.count("delta").over(frame) >= max(1, k // 2)) & (F.col("t") >= k)
        return F.when(enough, F.sum(F.greatest(-F.col("delta"), F.lit(0.0))).over(frame))

    return {f"cvsi_{k}": one(k) for k in ks}


def cvsi(dense_deltas: DataFrame, ks: range = range(1, 7)) -> DataFrame:
    """Every month of a cell (delta null in gaps) with all indices, in one window pass."""
    return dense_deltas.select("*", *[c.alias(k) for k, c in cvsi_columns(ks).items()])


def cvsi_mean(index: DataFrame, k: int) -> DataFrame:
    return index.groupBy("cell_id").agg(F.avg(f"cvsi_{k}").alias("f7_cvsi_mean"))


def lag_score_std(index: DataFrame, ks: range = range(1, 7)) -> DataFrame:
    """(k, score): the population deviation of each index over all cells and months."""
    wide = index.agg(*[F.stddev_pop(f"cvsi_{k}").alias(str(k)) for k in ks])
    return wide.unpivot([], [str(k) for k in ks], "k", "score").withColumn("k", F.col("k").cast("int"))


def fill_linear(dense: DataFrame, months: int, least: int | None = None) -> DataFrame:
    """dense with filled: straight lines over gaps, ends held. Cells with fewer than max(24, months // 2) values have none."""
    past, future = by_cell().rowsBetween(Window.unboundedPreceding, 0), by_cell().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.col("t"))
    v0, t0 = F.last("v", True).over(past), F.last(at, True).over(past)
    v1, t1 = F.first("v", True).over(future), F.first(at, True).over(future)
    line = v0 + (v1 - v0) * (F.col("t") - t0) / F.nullif(t1 - t0, F.lit(0))
    n = F.count("v").over(Window.partitionBy("cell_id"))
    need = max(24, months // 2) if least is None else least
    return dense.withColumn("filled", F.when(n >= need, F.coalesce("v", line, v0, v1)))
