"""Points on the grid, joins with months and cells, samples, quantile bins and mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.ranks import draw, exact_quantiles, same, smallest
from fieldloom.sources.scratch import few, stored


def rasterize_count(snapped: DataFrame) -> DataFrame:
    """(cell_id, n_points, log_points) of the cells with points; every point in bounds counts."""
    counts = snapped.where("in_bounds").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_points"))
    return counts.withColumn("log_points", F.log10(F.col("n_points") + 1))


def hit_share(counts: DataFrame, n_cells: int) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("cells_hit"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("points"), (F.count(F.lit(1)) / F.lit(float(n_cells))).alias("share"))


def points_by_month(snapped: DataFrame, spine: DataFrame) -> DataFrame:
    """Points in bounds whose month is in the spine, with its t. spine: one row for each month, broadcast."""
    return snapped.where("in_bounds").join(F.broadcast(spine.select("t", "year", "month")), ["year", "month"])


def match_counts(snapped: DataFrame, spine: DataFrame) -> DataFrame:
    """How many points there are, in bounds, out of bounds, and in a month of the spine."""
    marked = snapped.join(F.broadcast(spine.select("t", "year", "month")), ["year", "month"], "left")
    return marked.agg(F.count(F.lit(1)).alias("points"), F.count_if("in_bounds").alias("in_bounds"), F.count_if(~F.col("in_bounds")).alias("dropped"), F.count_if(F.col("in_bounds") & F.col("t").isNotNull()).alias("dated"))


def by_lag(index: DataFrame, ks: range | list[int]) -> DataFrame:
    """(cell_id, t, k, x): the indices of several lags as rows, t >= k, missing ones left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cvsi_{k}").alias("x")) for k in ks])
    return index.select("cell_id", "t", F.inline(pairs)).where("x IS NOT NULL AND t >= k")


def at_points(index: DataFrame, dated: DataFrame, ks: range | list[int]) -> DataFrame:
    """(cell_id, t, k, x): the index at every point, one row for each point and lag, points without an index left out. Points are pre-counted by cell and month, so no hot cell is joined point by point."""
    n = dated.groupBy("cell_id", "t").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return by_lag(index, ks).join(n, ["cell_id", "t"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i")


def background(index: DataFrame, burned: DataFrame, ks: range | list[int]) -> DataFrame:
    """(cell_id, t, k, x): the index of cells without any point."""
    return by_lag(index.join(burned.select("cell_id").distinct(), "cell_id", "left_anti"), ks)


def label_cells(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """cells with y: 1 where points are, else 0."""
    return cells.join(counts.select("cell_id", "n_points"), "cell_id", "left").withColumn("y", F.when(F.col("n_points") > 0, 1).otherwise(0)).drop("n_points")


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42, **how) -> DataFrame:
    """n rows (all if there are fewer), without replacement: those whose key has the smallest hash, so reruns agree. No sort of all rows, no task with n of them."""
    return smallest(df.withColumn("_h", draw(key, seed)), [], "_h", key, n, **how).drop("_h")


def case_control_sample(df: DataFrame, by: list[str], key: list[str], per_class: int, seed: int = 42, y: str = "y", **how) -> DataFrame:
    """Up to per_class rows of each class of each group, by smallest hash."""
    return smallest(df.withColumn("_h", draw([*by, *key], seed)), [*by, y], "_h", key, per_class, **how).drop("_h")


def labelled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))


def quantile_bins(df: DataFrame, by: list[str], x: str = "x", n: int = 10, **how) -> DataFrame:
    """df with bin: the number of inner edges at or below x. Edges are exact quantiles of the group, linear between values, equal ones taken once. Groups without values go."""
    edges = exact_quantiles(df, by, x, [k / n for k in range(n + 1)], "_q", **how).withColumn("_e", F.array_sort(F.array_distinct("_q"))).drop("_q")
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    joined = df.alias("d").join(few(stored(edges, "edges")).alias("e"), same("d", "e", by)).select("d.*", "e._e")
    return joined.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(x)))).drop("_e")


def mutual_information(binned: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """(by, mi, n_pos, n_neg) between y and bin, in nats; null unless both classes have `least` rows."""
    cells = binned.groupBy(*by, "y", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *keys: F.sum("n").over(Window.partitionBy(*by, *keys))
    p = cells.select(*by, "y", "n", total().alias("all"), total("y").alias("ny"), total("bin").alias("nb"))
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("ny") * F.col("nb")))
    out = p.groupBy(*by).agg(F.sum(term).alias("mi"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n_neg"))
    return out.withColumn("mi", F.when((F.col("n_pos") >= least) & (F.col("n_neg") >= least), F.col("mi")))


def lag_select(scores: DataFrame, score: str = "mi") -> DataFrame:
    """The k with the highest score, the smallest on ties; no row if all are missing."""
    return scores.where(F.col(score).isNotNull()).orderBy(F.desc(score), "k").limit(1)
