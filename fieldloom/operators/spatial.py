"""Spatial autocorrelation on a lattice with queen neighbours: gap fill by rows, spatial lag, Moran's I, local clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.normal import two_sided_p
from fieldloom.sources.scratch import stored

OFFSETS = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))

#: Rows and columns of a tile.
TILE = 64
#: Hashes for each permutation, of which the first different ones count; digits to which simulated and actual statistics are compared.
TRIES, DIGITS = 64, 9


def fill_row_mean(cells: DataFrame, v: str = "v") -> DataFrame:
    """A dense lattice (row, col, v) with filled: v, else the mean of its row, else 0."""
    return cells.withColumn("filled", F.coalesce(F.col(v), F.avg(v).over(Window.partitionBy("row")), F.lit(0.0)))


def tiles(cells: DataFrame, halo: int = 1, side: int = TILE) -> DataFrame:
    """cells dealt by square tiles (_tr, _tc): each to its own, and where it lies within `halo` of the edge to the tiles beyond. The one exchange of what looks at neighbours; inner cells move once."""
    reach = (-halo, 0, halo)
    near = F.array_distinct(F.array(*[F.struct(F.floor((F.col("row") + r) / side).alias("_tr"), F.floor((F.col("col") + c) / side).alias("_tc")) for r in reach for c in reach]))
    return cells.select("*", F.inline(near)).repartition("_tr", "_tc")


def inner(rows: DataFrame, side: int = TILE) -> DataFrame:
    """Rows in their own tile, each cell once."""
    return rows.where((F.col("_tr") == F.floor(F.col("row") / side)) & (F.col("_tc") == F.floor(F.col("col") / side))).drop("_tr", "_tc")


def around(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows of tiles() with sums of values over the eight cells around each, as far as the tile has them: columns are summed by rows above and below, then rows by columns on both sides."""
    values = {f"_v{k}": v for k, v in enumerate(values.values())} | {"_names": list(values)}
    names = values.pop("_names")
    sent = rows.withColumns(values).withColumn("_d", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_to", F.col("row") + F.col("_d"))
    own = F.first(F.when(F.col("_d") == 0, F.struct(*rows.columns)), ignorenulls=True)
    sums = [f for v in values for f in (F.sum(v).alias(f"{v}_all"), F.sum(F.when(F.col("_d") != 0, F.col(v))).alias(f"{v}_near"))]
    column = sent.groupBy("_tr", "_tc", "_to", "col").agg(own.alias("_own"), *sums)
    order = Window.partitionBy("_tr", "_tc", "_to").orderBy("col")  # a row of a tile
    side = lambda v, k: F.coalesce(F.sum(f"{v}_all").over(order.rangeBetween(k, k)), F.lit(0))
    totals = [(side(v, -1) + side(v, 1) + F.coalesce(f"{v}_near", F.lit(0))).alias(name) for v, name in zip(values, names, strict=True)]
    return column.select("_own", *totals).where("_own IS NOT NULL").select("_own.*", *names)


def with_lag(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    out = around(rows, {"_s": v, "n_neighbours": v.isNotNull().cast("long")})
    return out.withColumn("lag", F.coalesce(F.col("_s") / F.nullif("n_neighbours", F.lit(0)), F.lit(0.0))).drop("_s")


def neighbour_lag(cells: DataFrame, value: str) -> DataFrame:
    """cells (row, col, value) with lag, the mean of the neighbours' values, and n_neighbours; cells without neighbours have lag 0. Only cells at the edge of a tile move more than once."""
    return inner(with_lag(tiles(cells), value))


def standardised(cells: DataFrame, value: str) -> DataFrame:
    """cells with z = (value - mean) / population deviation; null if there is no spread. The two moments are one row."""
    moments = cells.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    out = cells.crossJoin(F.broadcast(moments))
    return out.withColumn("z", F.when(F.col("_sd") > 0, (F.col(value) - F.col("_m")) / F.col("_sd"))).drop("_m", "_sd")


def morans_i(cells: DataFrame, value: str = "filled") -> DataFrame:
    """n, I, E[I], variance under normality, z and two-sided p, with row-standardised queen weights; I is null without spread."""
    # S1 and S2 of row-standardised weights: w_ij = 1 / n_i, and sums of columns come from the neighbours' 1 / n; a halo of two gives neighbours all of theirs
    inverse = with_lag(tiles(standardised(cells, value), 2), "z").withColumn("inv", F.coalesce(1 / F.nullif(F.col("n_neighbours"), F.lit(0)), F.lit(0.0)))
    both = inner(around(inverse, {"_col": F.col("inv")}))
    has = (F.col("n_neighbours") > 0).cast("double")
    # sum over neighbours j of (w_ij + w_ji)^2 = 1/n_i + 2/n_i * sum_j 1/n_j + sum_j 1/n_j^2; halved by symmetry it is sum of 1/n_i + sum_i inv_i * colsum_i
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("z") * F.col("lag")).alias("zl"), F.sum(has).alias("s0"), F.sum("inv").alias("si"), F.sum(F.col("inv") * F.col("_col")).alias("sc"), F.sum((has + F.col("_col")) * (has + F.col("_col"))).alias("s2"))
    n, s0, s1, s2 = F.col("n").cast("double"), F.nullif("s0", F.lit(0.0)), F.col("si") + F.col("sc"), F.col("s2")
    out = sums.withColumn("i", n / s0 * F.col("zl") / F.nullif(F.col("zz"), F.lit(0.0))).withColumn("expected", -1 / F.nullif(n - 1, F.lit(0.0)))
    out = out.withColumn("variance", (n * n * s1 - n * s2 + 3 * s0 * s0) / F.nullif((n - 1) * (n + 1) * s0 * s0, F.lit(0.0)) - F.col("expected") * F.col("expected"))
    out = out.withColumn("z", (F.col("i") - F.col("expected")) / F.sqrt(F.when(F.col("variance") > 0, F.col("variance"))))
    return out.select("n", "i", "expected", "variance", "z", two_sided_p(F.col("z")).alias("p"))


def local_moran(cells: DataFrame, value: str = "filled") -> DataFrame:
    """cells with z, lag, local I = z * lag, quadrant (1 HH, 2 LH, 3 LL, 4 HL; over 0 is high) and the analytic z_i of the lag as a mean of neighbours drawn from the other cells."""
    lagged = neighbour_lag(standardised(cells, value), "z")
    n = F.col("_n").cast("double")
    out = lagged.crossJoin(F.broadcast(lagged.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    high, near = F.col("z") > 0, F.col("lag") > 0
    quadrant = F.when(high & near, 1).when(~high & near, 2).when(~high & ~near, 3).when(high & ~near, 4)
    rest, few = F.nullif(n - 1, F.lit(0.0)), F.nullif(F.col("n_neighbours") * (n - 2), F.lit(0.0))
    others_mean = -F.col("z") / rest
    others_var = (n - F.col("z") * F.col("z")) / rest - others_mean * others_mean
    spread = others_var * (n - 1 - F.col("n_neighbours")) / few
    z_i = F.when((F.col("n_neighbours") > 0) & (spread > 0), (F.col("lag") - others_mean) / F.sqrt(spread))
    return out.withColumns({"local_i": F.col("z") * F.col("lag"), "quadrant": quadrant, "z_i": z_i}).drop("_n")


def lisa(cells: DataFrame, value: str = "filled", permutations: int = 199, seed: int = 42, p: str = "permutation", alpha: float = 0.05, had_data: str | None = None) -> DataFrame:
    """local_moran with p_sim and cls: the quadrant where p < alpha, else 0, and -1 where had_data is null.

    p="permutation": (larger + 1) / (permutations + 1) with the smaller tail. The draws are one table of places among "all cells but
    me", named by hashes of a counter and the same for every cell; only z at those places is sent, so no task holds the lattice and the result doesn't hang on partitions.
    p="analytic" uses z_i.
    """
    out = local_moran(cells, value)
    if p == "analytic":
        out = out.withColumn("p_sim", two_sided_p(F.col("z_i")) / 2)
    else:
        out = permuted(stored(out, "local"), permutations, seed)
    cls = F.when(F.col("p_sim") < alpha, F.col("quadrant")).otherwise(0)
    return out.withColumn("cls", F.when(F.col(had_data).isNull(), -1).otherwise(cls) if had_data else cls)


def draws(n: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(p, j, place): for each permutation the first places, of n - 1, that a counter's hashes name, without repeats. n: one row."""
    counter = n.sparkSession.range(permutations * TRIES).select(F.floor(F.col("id") / TRIES).cast("int").alias("p"), (F.col("id") % TRIES).cast("int").alias("c"))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "p", "c").cast("binary")), 1, 15), 16, 10).cast("long")
    named = counter.crossJoin(F.broadcast(n)).where("_n > 1").select("p", "c", (number % (F.col("_n") - 1)).alias("place"))
    order = F.row_number().over(Window.partitionBy("p").orderBy("c"))  # TRIES rows at most
    return named.groupBy("p", "place").agg(F.min("c").alias("c")).withColumn("j", order).where(F.col("j") <= len(OFFSETS)).select("p", "j", "place")


def permuted(cells: DataFrame, permutations: int, seed: int) -> DataFrame:
    """cells (row, col, z, lag, n_neighbours) with p_sim; null where there are no neighbours, no spread or too few cells. Places stand for ranks in order of row and column, without the cell's own."""
    at = ranks(cells)
    named = draws(cells.agg(F.count(F.lit(1)).alias("_n")), permutations, seed)
    sides = named.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_rank", F.col("place") + F.col("k"))
    found = at.select("_rank", "z").join(F.broadcast(sides), "_rank")  # 16 rows for each permutation
    pairs = found.groupBy("p", "j", "place").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("z"))), F.lit(0.0)).alias(name) for k, name in ((0, "low"), (1, "high"))])
    each = pairs.groupBy("p").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "place", "low", "high"))), lambda x: x.dropFields("j")).alias("at"))
    table = each.agg(F.collect_list("at").alias("_draws"), F.count(F.lit(1)).alias("_count"))  # one row

    def mean(at):
        own = F.slice(at, F.lit(1), F.greatest(F.col("n_neighbours"), F.lit(1)).cast("int"))
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + F.when(x["place"] < F.col("_rank"), x["low"]).otherwise(x["high"]))
        return total / F.size(own)

    actual = F.round(F.col("z") * F.col("lag"), DIGITS)  # rounded, so that equal values tie whatever the order of sums
    larger = F.aggregate("_draws", F.lit(0), lambda n, at: n + (F.round(mean(at) * F.col("z"), DIGITS) >= actual).cast("int"))
    out = at.crossJoin(F.broadcast(table)).withColumn("_larger", larger)
    n = F.lit(permutations)
    p = (F.least("_larger", n - F.col("_larger")) + 1) / (n + 1)
    usable = (F.col("n_neighbours") > 0) & F.col("z").isNotNull() & (F.col("_count") == permutations) & (F.col("_cells") >= len(OFFSETS) + 2)
    return out.withColumn("p_sim", F.when(usable, p)).drop("_draws", "_count", "_larger", "_rank", "_cells")


def ranks(cells: DataFrame) -> DataFrame:
    """cells with _rank in order of row and column, from 0, and _cells, their number: cells before the row, plus those before it in the row, so no task orders them all."""
    rows = cells.groupBy("row").agg(F.count(F.lit(1)).alias("_c"))
    before = rows.select("row", (F.sum("_c").over(Window.orderBy("row")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_cells"))  # one row for each lattice row
    inside = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return cells.withColumn("_in", inside).join(before, "row").withColumn("_rank", F.col("_before") + F.col("_in")).drop("_before", "_in")


def class_counts(cells: DataFrame, cls: str = "cls") -> DataFrame:
    counts = cells.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
