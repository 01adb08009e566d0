"""Exact order statistics and samples of groups of any size: no task ever holds a group, only what lies between two neighbouring bounds of a histogram."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import few, stored

#: Rows between two bounds that one task puts in order, at most (but for equal ones, which need no order); parts into which a span of values is cut; leading hex digits of a hash that are counted.
MOST, PARTS, DIGITS = 1 << 20, 1 << 10, 4


def same(a: str, b: str, by: list[str]) -> Column:
    """Rows of a and b of one group; null is a group like others."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))


def binade(x: Column) -> Column:
    """A whole number that never falls as x grows: the sign and the power of two below |x|."""
    power = F.greatest(F.least(F.floor(F.log2(F.abs(x))), F.lit(1025)), F.lit(-1080)) + 1090  # infinities are at 1025
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * power)


def in_span(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, x) with the span (lo, hi) of their group that holds x; spans: a few rows for each group, which don't overlap."""
    joined = rows.alias("r").join(few(spans).alias("s"), same("r", "s", by) & F.col("r._x").between(F.col("s._lo"), F.col("s._hi")))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in by], F.col("r._x").alias("_x"), *[F.col(f"s.{c}").alias(c) for c in spans.columns if c not in by])


def refined(counts: DataFrame, by: list[str], parent: list[str]) -> DataFrame:
    """Of counts (by, parent, _before, _ranks, _lo, _hi, _n), a row for each part of a span, the parts that hold wanted ranks, with the rows before them."""
    earlier = Window.partitionBy(*by, *parent).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    placed = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    held = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    return placed.withColumn("_ranks", held).where(F.size("_ranks") > 0).select(*by, "_lo", "_hi", "_n", "_before", "_ranks", "_total")


def at_ranks(df: DataFrame, by: list[str], x: str, qs: list[float], most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(by, _total, _at): the number of values of each group, and a map from ranks (of 0) to values that has the ranks on both sides of each share in qs.

    A histogram of powers of two is refined: of the parts of a group only those with wanted ranks are kept, and cut into equal parts
    by value, until they have `most` rows or equal ones. The first cut reads the rows twice, later ones what lies in the kept parts.
    """
    rows = stored(df.select(*by, F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)"), "values")
    spans = rows.groupBy(*by, binade(F.col("_x")).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    total = F.sum("_n").over(Window.partitionBy(*by))  # a few thousand rows at most
    place = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    spans = spans.withColumn("_total", total).withColumn("_ranks", ranks).withColumn("_before", F.lit(0).cast("long"))
    spans = stored(refined(spans, by, []), "spans")
    ready, left = [], rows
    wide = (F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))
    while not spans.where(wide).isEmpty():
        ready.append(spans.where(~wide))
        parents = spans.where(wide).withColumnsRenamed({"_lo": "_a", "_hi": "_b"}).drop("_n")
        left_in = in_span(left, parents.withColumns({"_lo": F.col("_a"), "_hi": F.col("_b")}), by).select(*by, "_x", "_a", "_b")
        left = stored(left_in, "left")
        part = F.least(F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * parts), F.lit(parts - 1))
        counts = left.groupBy(*by, "_a", "_b", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        known = counts.alias("c").join(few(parents).alias("p"), same("c", "p", [*by, "_a"])).select("c.*", "p._before", "p._ranks", "p._total")
        spans = stored(refined(known, by, ["_a"]), "spans")
    ready = reduce(DataFrame.unionByName, [*ready, spans])
    equal = ready.where("_lo = _hi").select(*by, "_total", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    unequal = in_span(rows, ready.where("_lo < _hi"), by)
    order = Window.partitionBy(*by, "_lo").orderBy("_x")  # `most` rows at most
    placed = unequal.withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1).where(F.array_contains("_ranks", F.col("_rank")))
    values = equal.unionByName(placed.select(*by, "_total", "_rank", F.col("_x").alias("_v")))
    return values.groupBy(*by).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")).where("_total > 0")  # two entries for each share


def exact_quantiles(df: DataFrame, by: list[str], x: str, qs: list[float], out: str = "quantiles", most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(by, out): an array of the quantiles of x at shares qs for each group, linear between values. Null and NaN count as missing; groups without values have no row."""
    at = at_ranks(df, by, x, qs, most, parts)

    def one(q: float) -> Column:
        place = (F.col("_total") - 1) * F.lit(float(q))
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (place - F.floor(place)) * (high - low))

    return at.select(*by, F.array(*map(one, qs)).alias(out))


def draw(key: list[str], seed: int) -> Column:
    """A repeatable random order: md5 of the key and the seed."""
    return F.md5(F.concat_ws("-", *key, F.lit(seed)).cast("binary"))


def smallest(df: DataFrame, by: list[str], order: str, ties: list[str], n: int | DataFrame, most: int = MOST, digits: int = DIGITS) -> DataFrame:
    """The n rows of each group with the smallest hash (column `order`, hex digits), ties by the columns `ties`; n may be a table (by, n), and groups that it lacks give none.

    One pass counts rows by the hash's first digits: counts add up in any order. The part that holds the n-th row tells what comes before it. A second pass keeps
    n rows and that part's, and only the part's rows are put in order. Parts with more than `most` rows are counted again by further digits.
    """
    lead = lambda width: F.substring(order, 1, width)
    counts = df.groupBy(*by, lead(digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.lit(0).cast("long"))
    if isinstance(n, int):
        counts = counts.withColumn("_want", F.lit(n).cast("long"))
    else:
        counts = counts.alias("c").join(n.alias("w"), same("c", "w", by)).select("c.*", F.col("w.n").cast("long").alias("_want"))

    def edges(counts: DataFrame) -> DataFrame:
        """The part with the n-th row of each group; one after all others where there are fewer."""
        group = Window.partitionBy(*by)  # as many rows as parts, at most
        earlier = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.where("_want > 0").withColumns({"_before": F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.col("_before") + F.sum("_n").over(group), "_nth": F.row_number().over(group.orderBy("_p"))})
        short = F.col("_all") < F.col("_want")
        edge = placed.where((short & (F.col("_nth") == 1)) | (~short & (F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want"))))
        either = lambda x, y: F.when(short, x).otherwise(F.col(y)).alias(y)
        return edge.select(*by, either(F.lit("~"), "_p"), either(F.lit(0), "_n"), F.when(short, F.col("_all")).otherwise(F.col("_before")).alias("_before"), "_want")

    cut, width = stored(edges(counts), "cut"), digits
    while width < 32 and not cut.where(F.col("_n") > most).isEmpty():
        wide = cut.where(F.col("_n") > most)
        inside = df.select(*by, order).alias("r").join(few(wide).alias("w"), same("r", "w", by) & (lead(width) == F.col("w._p"))).select("r.*", "w._before", "w._want")
        width += digits
        counts = inside.groupBy(*by, "_before", "_want", lead(width).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        cut = stored(cut.where(F.col("_n") <= most).unionByName(edges(counts)), "cut")
    head = F.expr(f"substring(`{order}`, 1, length(_p))")
    rows = df.alias("r").join(few(cut).alias("w"), same("r", "w", by)).select("r.*", "w._p", "w._before", "w._want").where(head <= F.col("_p"))
    rows = stored(rows.withColumn("_edge", head == F.col("_p")), "sample")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties))
    last = rows.where("_edge").withColumn("_nth", nth).where("_before + _nth <= _want").drop("_nth")
    return rows.where("NOT _edge").unionByName(last).drop("_p", "_before", "_want", "_edge")
