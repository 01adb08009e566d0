"""Mann-Kendall trend tests of many series at once.

S is the number of rising pairs of a series less that of falling ones. Pairs are counted by merging: blocks of a series, each in order, are merged two and two, and where a value of the
right block comes to stand tells how many of the left one are not over it. That takes months times the log of months for a series, in arrays of many series at once. Statistics
follow from S, the number of values and the ties as column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.normal import two_sided_p

LEAST, DIGITS = 10, 9
#: Values of the series that are merged together, about; values of a block that are compared one by one.
TOGETHER = 1 << 21
BLOCK = 16


def pair_counts(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S, the number of equal pairs, and the sum of t (t - 1) (2 t + 5) over groups of t equal values, of each row of x; a row has n values, in its first columns."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    held = np.arange(x.shape[1]) < n[:, None]
    order = np.argsort(np.where(held, x, np.inf), axis=1, kind="stable")
    ascending = np.take_along_axis(np.where(held, x, np.inf), order, 1)
    dense = np.zeros(x.shape, "i4")
    np.cumsum(ascending[:, 1:] != ascending[:, :-1], axis=1, out=dense[:, 1:])
    ranks = np.full((len(x), width), width, "i4")  # what fills a row up is over all values
    np.put_along_axis(ranks, order, dense, 1)
    ranks[:, : x.shape[1]][~held] = width
    rows = np.nonzero(held)[0]
    t = np.bincount(rows * width + ranks[:, : x.shape[1]][held], minlength=len(x) * width).reshape(len(x), width)
    same, spread = (t * (t - 1) // 2).sum(1), (t * (t - 1) * (2 * t + 5)).sum(1)

    w = min(width, BLOCK)  # within a small block, comparing is faster than merging
    blocks = ranks.reshape(len(x), -1, w)
    not_over = np.zeros(len(x), "i8")
    for k in range(1, w):
        not_over += np.count_nonzero(blocks[:, :, k:] >= blocks[:, :, :-k], axis=(1, 2))
    ranks = np.sort(blocks, axis=2)
    while w < width:
        merged = (ranks.reshape(len(x), -1, 2, w) << 1) | np.arange(2, dtype="i4")[:, None]  # of equal values the left one comes first
        merged = np.sort(merged.reshape(len(x), -1, 2 * w), axis=2)
        right = merged & 1
        # a right value at place p has p, less the right ones before it, left values that are not over it
        at = np.flatnonzero(right.reshape(len(x), -1))
        per_row = width // 2
        not_over += (at.reshape(len(x), per_row) % (2 * w)).sum(1) - (width // (2 * w)) * (w * (w - 1) // 2)
        ranks, w = merged >> 1, 2 * w
    filled = width - n
    return 2 * not_over - same - filled * (filled - 1) // 2 - width * (width - 1) // 2 - n * filled, same, spread


@F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.LongType()), T.StructField("same", T.DoubleType()), T.StructField("spread", T.DoubleType())]))
def counted(series: pa.Array) -> pa.Array:
    """What the statistics need of each series, an array of (t, v) in order."""
    n = np.diff(offsets := np.append(0, np.cumsum(series.value_lengths().to_numpy(zero_copy_only=False))))
    flat = series.flatten().field("v").to_numpy(zero_copy_only=False)
    step, parts = max(1, TOGETHER // max(int(n.max(initial=1)), 1)), [np.zeros((3, 0), "i8")]
    for k in range(0, len(n), step):
        own = n[k : k + step]
        x = np.zeros((len(own), max(int(own.max()), 1)))
        x[np.arange(x.shape[1]) < own[:, None]] = flat[offsets[k] : offsets[k + len(own)]]
        parts.append(np.stack(pair_counts(x, own)))
    s, same, spread = np.concatenate(parts, 1)
    return pa.StructArray.from_arrays([pa.array(n.astype("i4")), pa.array(s), pa.array(same.astype("f8")), pa.array(spread.astype("f8"))], names=["n", "s", "same", "spread"])


def in_order(value: str) -> Column:
    """An aggregate: the values of a cell as (t, v) in order of t, without gaps. Values are rounded before signs are taken, so results don't hang on the order of sums."""
    v = F.col(value)
    return F.sort_array(F.collect_list(F.when(v.isNotNull() & ~F.isnan(v), F.struct("t", F.round(v, DIGITS).alias("v")))))


def statistics(counts: Column, ties: bool = False) -> dict[str, Column]:
    """n, s, tau, z and two-sided p from a column of counted(); tau, z and p are null for fewer than LEAST values. ties=True gives tau-b with the tie-corrected variance."""
    n, s = counts["n"].cast("double"), counts["s"].cast("double")
    pairs, variance = n * (n - 1) / 2, n * (n - 1) * (2 * n + 5) / 18
    root = lambda x: F.sqrt(F.when(x > 0, x))
    if ties:
        tau, z = s / root(pairs * (pairs - counts["same"])), F.coalesce(s / root(variance - counts["spread"] / 18), F.lit(0.0))
    else:
        tau, z = s / F.nullif(pairs, F.lit(0.0)), F.coalesce((s - F.signum(s)) / root(variance), F.lit(0.0))
    enough = (n >= LEAST) & tau.isNotNull()
    return {"n": counts["n"], "s": counts["s"], "tau": F.when(enough, tau), "z": F.when(enough, z), "p": F.when(enough, two_sided_p(z))}


def mann_kendall(values: DataFrame, value: str = "trend", ties: bool = False) -> DataFrame:
    """cell_id, n, S, tau, z and two-sided p of each cell's values (cell_id, t, value); gaps are skipped, cells without values left out."""
    series = values.where(F.col(value).isNotNull()).groupBy("cell_id").agg(in_order(value).alias("_x"))
    counts = series.select("cell_id", counted("_x").alias("_c"))
    return counts.select("cell_id", *[c.alias(k) for k, c in statistics(F.col("_c"), ties).items()])


def trend_class(tests: DataFrame, alpha_z: float = 1.959963984540054) -> DataFrame:
    """tests with class: browning or greening where |z| is over the bound of alpha, else none."""
    sure = F.abs("z") > alpha_z
    return tests.withColumn("class", F.when(sure & (F.col("tau") < 0), "browning").when(sure & (F.col("tau") > 0), "greening").otherwise("none"))
