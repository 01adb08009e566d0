"""Piecewise logistic breakpoints of an event's probability along x, by group, and what follows from them.

For a fixed theta both branches are plain logistic fits of two parameters. All thetas of all zones are fitted at once: a row for each, with the zone's sums by rounded x, whose
Newton steps are column expressions. x is measured from the middle of its 10 to 90 percent range in halves of it, a small ridge keeps separated branches finite, and a
fixed number of steps makes the fit something that SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.ranks import exact_quantiles
from fieldloom.sources.scratch import stored

MIN_N, MIN_EVENTS, N_THETA, CLIP = 200, 30, 25, 1e-7
#: Newton steps of a branch, weight of the squared parameters, bound of a step, digits to which likelihoods are compared (thetas between two values of x are equally good; the smallest counts).
STEPS, RIDGE, STRIDE, DIGITS = 16, 1e-3, 5.0, 6


def with_national(zoned: DataFrame, cells: DataFrame, name: str = "national") -> DataFrame:
    """Rows of every zone, and of all cells as a zone of their own: subsets overlap, so no grouping set gives them."""
    return zoned.unionByName(cells.withColumn("zone", F.lit(name)), allowMissingColumns=True)


def zone_guard(rows: DataFrame, min_n: int = MIN_N, min_events: int = MIN_EVENTS) -> DataFrame:
    """(zone, n, events, enough)."""
    sums = rows.where("x IS NOT NULL").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("events"))
    return sums.withColumn("enough", (F.col("n") >= min_n) & (F.col("events") >= min_events))


def theta_range(rows: DataFrame, **how) -> DataFrame:
    """(zone, p10, p90) of x, exact; no task holds a zone."""
    return exact_quantiles(rows, ["zone"], "x", [0.1, 0.9], "_p", **how).select("zone", F.col("_p")[0].alias("p10"), F.col("_p")[1].alias("p90"))


def chance(a: Column, b: Column, u: Column) -> Column:
    return 1 / (1 + F.exp(-(a + b * u)))


def logistic(bins: Column, steps: int = STEPS) -> Column:
    """(a, b) of P(event) = chance(a, b, u) over an array of (u, m, k): k events of m at u."""

    def sums(at: Column) -> Column:
        def add(s: Column, r: Column) -> Column:
            p = chance(at["a"], at["b"], r["u"])
            g, w = r["k"] - r["m"] * p, r["m"] * p * (1 - p)
            return F.struct((s["g0"] + g).alias("g0"), (s["g1"] + g * r["u"]).alias("g1"), (s["h0"] + w).alias("h0"), (s["h1"] + w * r["u"]).alias("h1"), (s["h2"] + w * r["u"] * r["u"]).alias("h2"))

        ridge = lambda c: F.lit(-RIDGE) * at[c]
        return F.aggregate(bins, F.struct(ridge("a").alias("g0"), ridge("b").alias("g1"), F.lit(RIDGE).alias("h0"), F.lit(0.0).alias("h1"), F.lit(RIDGE).alias("h2")), add)

    def step(at: Column, _: Column) -> Column:
        # the sums are made once: a lambda over an array of one binds them
        def move(s: Column) -> Column:
            det = s["h0"] * s["h2"] - s["h1"] * s["h1"]
            da, db = (s["h2"] * s["g0"] - s["h1"] * s["g1"]) / det, (s["h0"] * s["g1"] - s["h1"] * s["g0"]) / det
            short = F.lit(STRIDE) / F.greatest(F.abs(da), F.abs(db), F.lit(STRIDE))
            return F.struct((at["a"] + da * short).alias("a"), (at["b"] + db * short).alias("b"))

        return F.transform(F.array(sums(at)), move)[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), step)


def loss(bins: Column, at: Column) -> Column:
    """Negative log-likelihood, chances held CLIP away from 0 and 1."""
    def add(s: Column, r: Column) -> Column:
        p = F.greatest(F.least(chance(at["a"], at["b"], r["u"]), F.lit(1 - CLIP)), F.lit(CLIP))
        return s - (r["k"] * F.log(p) + (r["m"] - r["k"]) * F.log(1 - p))

    return F.aggregate(bins, F.lit(0.0), add)


def fitted(thetas: DataFrame) -> DataFrame:
    """thetas (theta, bins, ...) with one, two (parameters of the branches) and nll."""
    sides = {"_left": lambda r: r["x"] <= F.col("theta"), "_right": lambda r: r["x"] > F.col("theta")}
    cut = thetas.withColumns({name: F.filter("bins", f) for name, f in sides.items()})
    fits = cut.withColumns({"one": logistic(F.col("_left")), "two": logistic(F.col("_right"))})
    return fits.withColumn("nll", loss(F.col("_left"), F.col("one")) + loss(F.col("_right"), F.col("two"))).drop("bins", *sides)


def best(fits: DataFrame) -> DataFrame:
    """The row of each zone with the smallest nll, of equal ones that with the smallest theta."""
    order = Window.partitionBy("zone").orderBy(F.round("nll", DIGITS), "theta")  # 2 n_theta rows at most
    return fits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def fit_breakpoint(rows: DataFrame, min_n: int = MIN_N, min_events: int = MIN_EVENTS, n_theta: int = N_THETA, digits: int = 4) -> DataFrame:
    """zone, theta, a1, b1, a2, b2, nll, n and events of rows (zone, x, y): P(event) is logistic in a1 + b1 x up to theta and in a2 + b2 x above it. Zones with too few rows or events are left out.

    Theta runs over n_theta places of the 10 to 90 percent range of x, then over as many around the best. Rows are summed by (zone, x rounded) first: a zone's list has at most the
    distinct rounded values of x, whatever the number of rows.
    """
    seen = rows.where("x IS NOT NULL")
    ends = theta_range(seen).join(zone_guard(seen, min_n, min_events).where("enough"), "zone")
    sums = seen.groupBy("zone", F.round(F.round("x", digits + 5), digits).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("y").cast("double").alias("k"))
    lists = sums.groupBy("zone").agg(F.sort_array(F.collect_list(F.struct("x", "m", "k"))).alias("_b")).join(ends, "zone")
    mid, half = (F.col("p10") + F.col("p90")) / 2, F.when(F.col("p90") > F.col("p10"), (F.col("p90") - F.col("p10")) / 2).otherwise(F.lit(1.0))
    lists = lists.withColumns({"mid": mid, "half": half})
    bins = F.transform("_b", lambda r: F.struct(r["x"].alias("x"), ((r["x"] - F.col("mid")) / F.col("half")).alias("u"), r["m"].alias("m"), r["k"].alias("k")))
    lists = stored(lists.withColumn("bins", bins).select("zone", "bins", "mid", "half", "p10", "p90", "n", "events"), "lists")
    step = (F.col("p90") - F.col("p10")) / max(n_theta - 1, 1)

    def at(places: DataFrame, first: Column) -> DataFrame:
        theta = F.greatest(F.least(first + F.col("_i") * F.col("_step"), F.col("p90")), F.col("p10"))
        rows = places.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1)))).withColumn("theta", theta)
        return stored(fitted(rows.repartition("zone", "_i")).drop("_i", "_step"), "fits")

    coarse = at(lists.withColumn("_step", step), F.col("p10"))
    top = best(coarse).select("zone", F.col("theta").alias("_top"))
    fine = at(lists.join(top, "zone").withColumn("_step", 2 * step / max(n_theta - 1, 1)), F.col("_top") - step).drop("_top")
    out = best(coarse.unionByName(fine))
    a, b = (lambda f: F.col(f)["a"] - F.col(f)["b"] * F.col("mid") / F.col("half")), (lambda f: F.col(f)["b"] / F.col("half"))
    return out.select("zone", "theta", a("one").alias("a1"), b("one").alias("b1"), a("two").alias("a2"), b("two").alias("b2"), "nll", "n", "events")


def zone_thresholds(fits: DataFrame) -> DataFrame:
    return fits.select("zone", F.round(F.round("theta", 9), 3).alias("theta"))


def predict_breakpoint(fits: DataFrame, n: int = 200) -> DataFrame:
    """(zone, x, p) on n points from 0 to 1."""
    x = F.col("_i") / F.lit(float(n - 1))
    grid = fits.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", x)
    u = F.when(F.col("x") <= F.col("theta"), F.col("a1") + F.col("b1") * F.col("x")).otherwise(F.col("a2") + F.col("b2") * F.col("x"))
    return grid.select("zone", "x", (1 / (1 + F.exp(-u))).alias("p"))


def below_threshold(cells: DataFrame, theta: float, v: str = "f1_mean", missing: float | None = 0.0) -> DataFrame:
    """cells with f9_below: 1 if v < theta, else 0; `missing` where v is null."""
    return cells.withColumn("f9_below", F.coalesce((F.col(v) < theta).cast("double"), F.lit(missing).cast("double")))
