"""A registered query for each operator over the whole tables, and the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.normal import two_sided_sql
from fieldloom.grid import all_cells, assign_zones, cell_centres, decimate, snap_points, upscale
from fieldloom.operators import breakpoint, kendall, points, quality, spatial, temporal
from fieldloom.plans import features as plan
from fieldloom.plans import tables as T
from fieldloom.plans.tables import rounded
from fieldloom.sources import granules
from fieldloom.sources.scratch import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STRIDE = 2

RAW = """raw AS (SELECT l_suppkey AS cell_id, CAST(l_suppkey // 10 AS INTEGER) AS "row", CAST(l_suppkey % 10 AS INTEGER) AS col,
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, l_linestatus AS granule,
  CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS INTEGER) * 260 - 3000 AS DOUBLE) ELSE (CAST(l_quantity AS INTEGER) * 260 - 3000) * 1e-4 END AS raw,
  CAST(CAST(round(l_tax * 100) AS INTEGER) % 5 - 1 AS INTEGER) AS qa FROM lineitem),
biggest AS (SELECT *, max(CASE WHEN raw <> -3000 THEN raw END) OVER (PARTITION BY t, granule) AS mx FROM raw),
rescaled AS (SELECT * EXCLUDE (mx), CASE WHEN mx > 2 THEN CASE WHEN raw BETWEEN -2000 AND 10000 THEN raw * 1e-4 END WHEN raw <> -3000 THEN raw END AS v FROM biggest),
ranged AS (SELECT * REPLACE (CASE WHEN v BETWEEN -0.2 AND 1.0 THEN v END AS v) FROM rescaled),
masked AS (SELECT * REPLACE (CASE WHEN t % 41 = 7 OR qa IN (0, 1) THEN v END AS v) FROM ranged),
cube AS (SELECT cell_id, "row", col, t, year, month, avg(v) AS v FROM masked WHERE v IS NOT NULL GROUP BY ALL)"""
SPINE = "spine AS (SELECT CAST(i AS INTEGER) AS t, CAST(1995 + i // 12 AS INTEGER) AS year, CAST(i % 12 + 1 AS INTEGER) AS month FROM range(83) r(i))"
DELTAS = RAW + """, climatology AS (SELECT cell_id, month, avg(v) AS clim FROM cube WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL),
deltas AS (SELECT cube.*, clim, v - clim AS delta FROM cube LEFT JOIN climatology USING (cell_id, month))"""
FRAME = DELTAS + ", " + SPINE + """, dense AS (SELECT c.cell_id, s.t, s.year, s.month, d.v, k.clim, d.delta FROM (SELECT DISTINCT cell_id FROM cube) c CROSS JOIN spine s
  LEFT JOIN deltas d ON d.cell_id = c.cell_id AND d.t = s.t LEFT JOIN climatology k ON k.cell_id = c.cell_id AND k.month = s.month),
trended AS (SELECT *, CASE WHEN t BETWEEN 6 AND 76 THEN (coalesce(sum(v) OVER a, 0) + coalesce(sum(v) OVER b, 0)) / nullif(count(v) OVER a + count(v) OVER b, 0) END AS trend FROM dense
  WINDOW a AS (PARTITION BY cell_id ORDER BY t RANGE BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (PARTITION BY cell_id ORDER BY t RANGE BETWEEN 5 PRECEDING AND 6 FOLLOWING)),
seasoned AS (SELECT *, avg(v - trend) OVER (PARTITION BY cell_id, month) AS seasonal FROM trended),
frame AS (SELECT *, v - trend - seasonal AS resid FROM seasoned),
stress AS (SELECT cell_id, t, """ + ", ".join(f"CASE WHEN t >= {k} AND count(delta) OVER w{k} >= {max(1, k // 2)} THEN round(sum(greatest(-delta, 0)) OVER w{k}, 9) + 0.0 END AS cvsi_{k}" for k in range(1, 7)) + " FROM dense WINDOW " + ", ".join(f"w{k} AS (PARTITION BY cell_id ORDER BY t RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in range(1, 7)) + ")"
POINTS = """size AS (SELECT count(*) // 10 AS high FROM supplier),
events_ AS (SELECT 36.0 - 0.5 * CAST((o_orderkey // 7) % (high + 1) + (o_orderkey % 90 - 45) / 128.0 AS DOUBLE) AS latitude, CAST(68.0 + 0.5 * (3 * (o_custkey % 5) + (o_orderkey % 100 - 50) / 128.0) AS DOUBLE) AS longitude,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders, size WHERE o_orderpriority = '1-URGENT'),
placed AS (SELECT *, CAST(round_even((latitude - 36.0) / -0.5, 0) AS INTEGER) AS "row", CAST(round_even((longitude - 68.0) / 0.5, 0) AS INTEGER) AS col FROM events_),
snapped AS (SELECT placed.*, "row" BETWEEN 0 AND high - 1 AND col BETWEEN 0 AND 9 AS in_bounds, CASE WHEN "row" BETWEEN 0 AND high - 1 AND col BETWEEN 0 AND 9 THEN CAST("row" * 10 + col AS BIGINT) END AS cell_id FROM placed, size),
counts AS (SELECT cell_id, count(*) AS n_points FROM snapped WHERE in_bounds GROUP BY 1)"""
CELLS = """cells AS (SELECT i AS cell_id, CAST(i // 10 AS INTEGER) AS "row", CAST(i % 10 AS INTEGER) AS col FROM size, range(0, size.high * 10) r(i))"""
LATTICE = RAW + ", " + POINTS + ", " + CELLS + """, means AS (SELECT cell_id, avg(v) AS f1_mean FROM cube GROUP BY 1),
coarse AS (SELECT CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, cell_id, f1_mean FROM cells LEFT JOIN means USING (cell_id) WHERE "row" % 2 = 0 AND col % 2 = 0),
filled AS (SELECT *, coalesce(f1_mean, avg(f1_mean) OVER (PARTITION BY "row"), 0.0) AS filled FROM coarse),
scored AS (SELECT *, (filled - avg(filled) OVER ()) / nullif(stddev_pop(filled) OVER (), 0) AS z FROM filled),
near AS (SELECT a."row", a.col, count(*) AS n_neighbours, avg(b.z) AS lag FROM scored a JOIN scored b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) GROUP BY ALL),
lagged AS (SELECT scored.*, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(lag, 0.0) AS lag FROM scored LEFT JOIN near USING ("row", col))"""
ZONED = LATTICE + """, zones(zone, lo, hi) AS (VALUES ('west', 0, 4), ('middle', 3, 7), ('east', 5, 9)),
labelled AS (SELECT cells.*, f1_mean AS x, CASE WHEN n_points > 0 THEN 1 ELSE 0 END AS y FROM cells LEFT JOIN means USING (cell_id) LEFT JOIN counts USING (cell_id)),
zoned AS (SELECT labelled.*, zone FROM labelled JOIN zones ON col BETWEEN lo AND hi),
everything AS (SELECT * FROM zoned UNION ALL SELECT *, 'national' FROM labelled)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(columns: str, source: str, with_: str = RAW) -> str:
    return f"WITH {with_} SELECT {columns} FROM {source}"


def r(*names: str) -> str:
    return ", ".join(f"round(round({n.rpartition(' AS ')[0] or n}, 12), 9) + 0.0 AS {n.rpartition(' AS ')[2]}" for n in names)


# sources


@query("""SELECT DISTINCT concat('/data/PRODUCT.061__1_km_monthly_', b.name, '_doy', y, lpad(CAST(d AS VARCHAR), 3, '0'), '000000_aid0001.tif') AS path, b.layer AS layer, CAST(y AS INTEGER) AS year, CAST(month(make_date(y, 1, 1) + CAST(d - 1 AS INTEGER)) AS INTEGER) AS month
FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(dayofyear(l_shipdate) AS INTEGER) AS d FROM lineitem) g, (VALUES ('NDVI', 'value'), ('pixel_reliability', 'quality'), ('VI_Quality', NULL)) b(name, layer)""")
def granule_names(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.year("l_shipdate").alias("y"), F.dayofyear("l_shipdate").alias("d")).distinct()
    names = line.withColumn("b", F.explode(F.array(*map(F.lit, ("NDVI", "pixel_reliability", "VI_Quality")))))
    path = F.concat(F.lit("/data/PRODUCT.061__1_km_monthly_"), "b", F.lit("_doy"), "y", F.lpad(F.col("d").cast("string"), 3, "0"), F.lit("000000_aid0001.tif"))
    return granules.parse_granule_name(granules.classify_layers(names.select(path.alias("path")), value_mark="_NDVI_")).select("path", "layer", "year", "month")


@query("WITH strips AS (SELECT l_suppkey // 10 AS r, l_linenumber AS g, list(l_quantity ORDER BY l_suppkey, l_orderkey, l_quantity) AS vals FROM lineitem GROUP BY ALL) SELECT g, count(*) AS n, round(sum(v), 6) + 0.0 AS total, max(i) AS last_col FROM (SELECT g, unnest(vals) AS v, unnest(range(len(vals))) AS i FROM strips) GROUP BY g")
def explode_strips(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    strips = line.groupBy(F.floor(F.col("l_suppkey") / 10).cast("int").alias("row"), F.col("l_linenumber").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_orderkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("values"))
    return granules.explode_strips(strips, T.grid(spark, d)).groupBy("g").agg(F.count("raw").alias("n"), (F.round(F.sum("raw"), 6) + 0.0).alias("total"), F.max("col").cast("long").alias("last_col"))


@query(q("t, count(*) AS n", "cube WHERE year * 12 + month BETWEEN 1997 * 12 + 3 AND 1999 * 12 + 10 GROUP BY t"))
def filter_period(spark, d):
    return granules.filter_period(T.cube(spark, d), (1997, 3), (1999, 10)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPINE}, seen AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem), long AS (SELECT CAST(1990 + i // 12 AS INTEGER) AS year, CAST(i % 12 + 1 AS INTEGER) AS month FROM range(180) r(i)) SELECT year, month FROM long ANTI JOIN seen USING (year, month)")
def missing_months(spark, d):
    """Months of a period that begins before the data and ends after it."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return granules.missing_months(line, (1990, 1), (2004, 12))


# masks


@query(q("cell_id, t, granule, " + r("raw", "v"), "rescaled"))
def rescale(spark, d):
    return rounded(T.rescaled(spark, d).select("cell_id", "t", "granule", "raw", "v"))


@query(q("cell_id, t, " + r("v"), "ranged"))
def mask_range(spark, d):
    return rounded(quality.mask_range(T.rescaled(spark, d)).select("cell_id", "t", "v"))


@query(q("cell_id, t, " + r("v"), "masked"))
def mask_quality(spark, d):
    return rounded(T.masked(spark, d).select("cell_id", "t", "v"))


@query(f"WITH {RAW}, vals AS (SELECT cell_id, t, avg(v) AS v FROM ranged GROUP BY ALL), codes AS (SELECT cell_id, t, min(qa) AS qa FROM raw WHERE t % 41 <> 7 GROUP BY ALL) SELECT cell_id, t, round(CASE WHEN t NOT IN (SELECT t FROM codes) OR qa IN (0, 1) THEN v END, 9) + 0.0 AS v FROM vals LEFT JOIN codes USING (cell_id, t)")
def mask_quality_joined(spark, d):
    values = quality.mask_range(T.rescaled(spark, d)).groupBy("cell_id", "t").agg(F.avg("v").alias("v"))
    codes = T.raw_cells(spark, d).where("has_qa").groupBy("cell_id", "t").agg(F.min("qa").alias("qa"))
    return rounded(quality.mask_quality(values, codes, ["t"], ["cell_id"]).select("cell_id", "t", "v"))


@query(q('cell_id, "row", col, t, year, month, ' + r("v"), "cube"))
def cube(spark, d):
    return rounded(T.cube(spark, d))


@query(q('cell_id, "row", col, t, year, month, ' + r("v"), "cube"))
def ingested_cube(spark, d):
    """The cube from cells stored by month with their granules' statistics beside them."""
    return rounded(T.cube_of(*T.ingested(spark, d)))


@query(f"WITH {RAW} SELECT DISTINCT year, month, granule FROM raw")
def granule_manifest(spark, d):
    """Granules written as files of their own, told from the files' real paths."""
    path = new_path(spark, "files")
    granules.write_months(T.raw_cells(spark, d), path, ("granule",))
    found = granules.table_manifest(spark, path, ("year", "month", "granule")).where("length > 0")
    return found.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), "granule").distinct()


@query(f"WITH {RAW}, {SPINE}, listed AS (SELECT t, granule FROM spine, (VALUES ('F'), ('O')) g(granule)) SELECT t, granule, count(raw.t) AS n, count(CASE WHEN raw <> -3000 THEN raw END) AS n_present, round(round(max(CASE WHEN raw <> -3000 THEN raw END), 12), 9) + 0.0 AS largest, count(raw.t) > 0 AS readable FROM listed LEFT JOIN raw USING (t, granule) GROUP BY ALL")
def granule_stats(spark, d):
    """Every granule that a month should have; those without a cell have failed."""
    return rounded(T.ingested(spark, d)[1])


@query(f"""WITH {RAW}, {SPINE}, expected AS (SELECT t, granule FROM spine, (VALUES ('F'), ('O')) g(granule)), listed AS (SELECT t, granule, count(raw.t) AS n, count(CASE WHEN raw <> -3000 THEN raw END) AS present FROM expected LEFT JOIN raw USING (t, granule) GROUP BY ALL)
SELECT (SELECT count(*) FROM listed) AS n_granules, (SELECT count(*) FROM listed WHERE n = 0) AS n_failed, (SELECT count(*) FROM listed WHERE n > 0 AND present = 0) AS n_blank, count(v) AS n_valid, count(DISTINCT cell_id) AS n_cells, count(DISTINCT t) AS n_months, {r("min(v) AS v_min", "max(v) AS v_max", "1 - count(v) / (SELECT CAST(count(*) // 10 * 10 * 83 AS DOUBLE) FROM supplier) AS missing")} FROM cube""")
def profile(spark, d):
    """Shape and range of the cube, and how many of its granules failed."""
    g, (cells, stats) = T.grid(spark, d), T.ingested(spark, d)
    return rounded(quality.profile(T.cube_of(cells, stats), g.height * g.width, T.MONTHS, stats))


@query(q("cell_id, t, granule, " + r("raw"), "raw WHERE year = 1998 AND month = 6"))
def slice_stored_month(spark, d):
    """A month's raw cells from a table stored by month."""
    return rounded(temporal.slice_month(T.ingested(spark, d)[0], T.spine(spark), 1998, 6).select("cell_id", "t", "granule", "raw"))


@query(q("t, qa, count(*) AS n", "raw GROUP BY t, qa"))
def qa_stats(spark, d):
    return quality.qa_stats(T.raw_cells(spark, d))


# per-cell statistics


@query(q("cell_id, " + r("avg(v) AS f1_mean"), "cube GROUP BY cell_id"))
def mean_map(spark, d):
    return rounded(temporal.mean_map(T.cube(spark, d)))


@query(q("cell_id, " + r("1 - count(v) / 83.0 AS missing"), "cube GROUP BY cell_id"))
def coverage_map(spark, d):
    return rounded(temporal.coverage_map(T.cube(spark, d), T.MONTHS))


@query(q("t, " + r("avg(v) AS mean_v") + ", count(v) AS n", "cube GROUP BY t"))
def national_series(spark, d):
    return rounded(temporal.national_series(T.cube(spark, d)))


@query(q("month IN (7, 8, 9) AS wet, count(*) AS n, " + r("avg(v) AS mean_v"), "cube GROUP BY 1"))
def wet_season(spark, d):
    return rounded(temporal.wet_season(T.cube(spark, d)).groupBy("wet").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v")))


@query(q("cell_id, month, " + r("clim"), "climatology", DELTAS))
def climatology(spark, d):
    return rounded(temporal.climatology(T.cube(spark, d), T.BASE))


def deltas(spark, d):
    return temporal.anomaly(T.cube(spark, d), T.BASE)


@query(q("cell_id, t, " + r("clim", "delta"), "deltas", DELTAS))
def anomaly(spark, d):
    return rounded(deltas(spark, d).select("cell_id", "t", "clim", "delta"))


@query(q("cell_id, " + r("avg(delta) AS f3_anomaly_mean"), "deltas GROUP BY cell_id", DELTAS))
def anomaly_mean(spark, d):
    return rounded(temporal.anomaly_mean(deltas(spark, d)))


@query(q(r("min(delta) AS min_delta", "max(delta) AS max_delta", "avg(delta) AS mean_delta"), "deltas", DELTAS))
def anomaly_range(spark, d):
    return rounded(temporal.anomaly_range(deltas(spark, d)))


@query(q("cell_id, t, " + r("v", "delta"), "deltas WHERE t = 41", DELTAS))
def slice_month(spark, d):
    """The spine's middle month, as it lacks the one asked for."""
    return rounded(temporal.slice_month(deltas(spark, d), T.spine(spark), 2016, 3).select("cell_id", "t", "v", "delta"))


@query(q("cell_id, t, " + r("v", "delta"), "deltas WHERE year = 1998 AND month = 6", DELTAS))
def slice_present_month(spark, d):
    return rounded(temporal.slice_month(deltas(spark, d), T.spine(spark), 1998, 6).select("cell_id", "t", "v", "delta"))


def frame(spark, d):
    return plan.dense_frame(T.cube(spark, d), T.spine(spark), T.BASE, T.MONTHS - 1)


@query(q("cell_id, t, " + r("v", "trend"), "frame", FRAME))
def ma_trend(spark, d):
    return rounded(temporal.ma_trend(temporal.densify(T.cube(spark, d).drop("row", "col"), T.spine(spark)), T.MONTHS - 1).select("cell_id", "t", "v", "trend"))


@query(q("cell_id, t, " + r("trend", "seasonal", "resid"), "frame", FRAME))
def decompose(spark, d):
    return rounded(frame(spark, d).select("cell_id", "t", "trend", "seasonal", "resid"))


@query(q("cell_id, " + r("avg(trend) AS f4_trend_mean", "avg(resid) AS f5_residual_mean", "stddev_pop(resid) AS residual_std"), "frame GROUP BY cell_id", FRAME))
def decompose_summary(spark, d):
    return rounded(temporal.decompose_summary(frame(spark, d)))


def index(spark, d):
    return rounded(temporal.cvsi(frame(spark, d).select("cell_id", "t", "delta")).drop("delta"))


@query(q("*", "stress", FRAME))
def cvsi(spark, d):
    return index(spark, d)


@query(q("cell_id, " + r("avg(cvsi_6) AS f7_cvsi_mean"), "stress GROUP BY cell_id", FRAME))
def cvsi_mean(spark, d):
    return rounded(temporal.cvsi_mean(index(spark, d), 6))


@query(f"WITH {FRAME} " + " UNION ALL ".join(f"SELECT {k} AS k, round(stddev_pop(cvsi_{k}), 9) + 0.0 AS score FROM stress" for k in range(1, 7)))
def lag_score_std(spark, d):
    return rounded(temporal.lag_score_std(index(spark, d)))


@query(f"""WITH {FRAME}, ends AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1, count(v) OVER (PARTITION BY cell_id) AS n FROM dense
WINDOW p AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT cell_id, t, round(CASE WHEN n >= 41 THEN coalesce(v, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1) END, 9) + 0.0 AS filled FROM ends""")
def fill_linear(spark, d):
    return rounded(temporal.fill_linear(temporal.densify(T.cube(spark, d).drop("row", "col"), T.spine(spark)), T.MONTHS).select("cell_id", "t", "filled"))


KENDALL = FRAME + """, smooth AS (SELECT cell_id, t, round(trend, 9) AS x FROM frame WHERE trend IS NOT NULL),
pairs AS (SELECT a.cell_id, CAST(sum(sign(b.x - a.x)) AS BIGINT) AS s FROM smooth a JOIN smooth b ON a.cell_id = b.cell_id AND a.t < b.t GROUP BY 1),
sizes AS (SELECT cell_id, CAST(count(*) AS INTEGER) AS n FROM smooth GROUP BY 1),
tests AS (SELECT cell_id, n, coalesce(s, 0) AS s, CASE WHEN n >= 10 THEN s / (n * (n - 1) / 2.0) END AS tau, CASE WHEN n >= 10 THEN (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) END AS z FROM sizes LEFT JOIN pairs USING (cell_id))"""


@query(q("cell_id, n, s, " + r("tau", "z", f"{two_sided_sql('z')} AS p"), "tests", KENDALL))
def mann_kendall(spark, d):
    return rounded(kendall.mann_kendall(frame(spark, d).select("cell_id", "t", "trend")))


@query(f"""WITH {RAW}, x AS (SELECT cell_id, t, round(v, 9) AS x FROM cube), pairs AS (SELECT a.cell_id, CAST(sum(sign(b.x - a.x)) AS BIGINT) AS s FROM x a JOIN x b ON a.cell_id = b.cell_id AND a.t < b.t GROUP BY 1),
ties AS (SELECT cell_id, CAST(sum(c) AS DOUBLE) AS n, sum(c * (c - 1) / 2.0) AS same, sum(c * (c - 1) * (2.0 * c + 5)) AS v FROM (SELECT cell_id, x, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY ALL) GROUP BY 1),
tested AS (SELECT cell_id, CAST(n AS INTEGER) AS n, coalesce(s, 0) AS s, CASE WHEN n >= 10 AND n * (n - 1) / 2 > same THEN s / sqrt(n * (n - 1) / 2 * (n * (n - 1) / 2 - same)) END AS tau,
  CASE WHEN n >= 10 AND n * (n - 1) / 2 > same THEN s / sqrt((n * (n - 1) * (2 * n + 5) - v) / 18) END AS z FROM ties LEFT JOIN pairs USING (cell_id))
SELECT cell_id, n, s, {r("tau", "z", f"{two_sided_sql('z')} AS p")} FROM tested""")
def kendall_tau_b(spark, d):
    return rounded(kendall.mann_kendall(T.cube(spark, d), "v", ties=True))


@query(q("CASE WHEN abs(z) > 1.959963984540054 AND tau < 0 THEN 'browning' WHEN abs(z) > 1.959963984540054 AND tau > 0 THEN 'greening' ELSE 'none' END AS class, count(*) AS n", "tests GROUP BY 1", KENDALL))
def trend_class(spark, d):
    return kendall.trend_class(kendall.mann_kendall(frame(spark, d).select("cell_id", "t", "trend"))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# points


def snapped(spark, d):
    return snap_points(T.point_events(spark, d), T.grid(spark, d))


@query(q('latitude, longitude, "row", col, in_bounds, cell_id', "snapped", POINTS))
def snap(spark, d):
    return snapped(spark, d).select("latitude", "longitude", "row", "col", "in_bounds", "cell_id")


@query(q('cell_id, 68.0 + 0.5 * (col + 0.5) AS lon, 36.0 - 0.5 * ("row" + 0.5) AS lat'.replace("68.0", "68e0").replace("36.0", "36e0").replace("0.5", "5e-1"), "cells", POINTS + ", " + CELLS))
def cell_centre_map(spark, d):
    g = T.grid(spark, d)
    return cell_centres(all_cells(spark, g), g).select("cell_id", "lon", "lat")


@query(q("cell_id, n_points, " + r("log10(n_points + 1) AS log_points"), "counts", POINTS))
def rasterize_count(spark, d):
    return rounded(points.rasterize_count(snapped(spark, d)))


@query(q("count(*) AS cells_hit, CAST(sum(n_points) AS BIGINT) AS points, " + r("count(*) / CAST((SELECT high * 10 FROM size) AS DOUBLE) AS share"), "counts", POINTS))
def hit_share(spark, d):
    g = T.grid(spark, d)
    return rounded(points.hit_share(points.rasterize_count(snapped(spark, d)), g.height * g.width))


@query(q("count(*) AS points, count(*) FILTER (in_bounds) AS in_bounds, count(*) FILTER (NOT in_bounds) AS dropped, count(*) FILTER (in_bounds AND spine.t IS NOT NULL) AS dated", "snapped LEFT JOIN spine USING (year, month)", POINTS + ", " + SPINE))
def match_counts(spark, d):
    return points.match_counts(snapped(spark, d), T.spine(spark))


@query(q("latitude, longitude, acq_date, year, month", "events_", POINTS.replace("CAST(year(o_orderdate)", "CAST(o_orderdate AS DATE) AS acq_date, CAST(year(o_orderdate)", 1)))
def point_file(spark, d):
    """Points written as CSV to the shared folder and read back by the reader of point files."""
    path = new_path(spark, "points")
    T.point_events(spark, d).write.option("header", True).csv(path)
    return granules.read_points(spark, path)


@query(q("t, count(*) AS n", "snapped JOIN spine USING (year, month) WHERE in_bounds GROUP BY t", POINTS + ", " + SPINE))
def points_by_month(spark, d):
    return points.points_by_month(snapped(spark, d), T.spine(spark)).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


POS = """SELECT s.cell_id, s.t, cvsi_{k} AS x FROM stress s JOIN (SELECT cell_id, spine.t FROM snapped JOIN spine USING (year, month) WHERE in_bounds) p ON p.cell_id = s.cell_id AND p.t = s.t WHERE s.t >= {k} AND cvsi_{k} IS NOT NULL"""
NEG = """SELECT cell_id, t, cvsi_{k} AS x FROM stress WHERE t >= {k} AND cvsi_{k} IS NOT NULL AND cell_id NOT IN (SELECT cell_id FROM counts)"""


@query(f"WITH {FRAME}, {POINTS} {POS.format(k=3)}")
def cvsi_at_points(spark, d):
    return points.at_points(index(spark, d), points.points_by_month(snapped(spark, d), T.spine(spark)), [3]).drop("k")


@query(f"WITH {FRAME}, {POINTS}, neg AS ({NEG.format(k=3)}) SELECT cell_id, t, x FROM neg ORDER BY md5(concat_ws('-', cell_id, t, 42)), cell_id, t LIMIT 500")
def background_sample(spark, d):
    s = snapped(spark, d)
    return points.hash_sample(points.background(index(spark, d), points.rasterize_count(s), [3]).drop("k"), ["cell_id", "t"], 500)


LAGS = f"{FRAME}, {POINTS}, both_ AS (" + " UNION ALL ".join(f"SELECT {k} AS k, 1 AS y, * FROM ({POS.format(k=k)}) UNION ALL SELECT {k}, 0, * FROM ({NEG.format(k=k)})" for k in range(1, 7)) + """),
drawn AS (SELECT *, count(*) FILTER (y = 1) OVER (PARTITION BY k) AS n_pos, row_number() OVER (PARTITION BY k, y ORDER BY md5(concat_ws('-', cell_id, t, 42)), cell_id, t) AS nth FROM both_),
sample_ AS (SELECT k, y, x FROM drawn WHERE y = 1 OR nth <= n_pos),
edges_ AS (SELECT k, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM sample_ GROUP BY k),
binned AS (SELECT sample_.k, y, x, len(list_filter(e[2:len(e) - 1], lambda z: z <= x)) AS bin FROM sample_ JOIN edges_ USING (k)),
cells_ AS (SELECT k, y, bin, count(*) AS n FROM binned GROUP BY ALL),
shares AS (SELECT k, y, n, sum(n) OVER (PARTITION BY k) AS nall, sum(n) OVER (PARTITION BY k, y) AS ny, sum(n) OVER (PARTITION BY k, bin) AS nb FROM cells_),
scores AS (SELECT k, sum(n / nall * ln(n * nall / (ny * nb))) AS mi, CAST(sum(n) FILTER (y = 1) AS BIGINT) AS n_pos, CAST(sum(n) FILTER (y = 0) AS BIGINT) AS n_neg FROM shares GROUP BY k)"""


def scores(spark, d):
    s = snapped(spark, d)
    return plan.lag_scores(index(spark, d), points.points_by_month(s, T.spine(spark)), points.rasterize_count(s))


@query(q("k, " + r("mi") + ", n_pos, n_neg", "scores", LAGS))
def mutual_information(spark, d):
    return rounded(scores(spark, d))


@query(q("k, " + r("mi") + ", n_pos, n_neg", "scores ORDER BY scores.mi DESC, k LIMIT 1", LAGS))
def lag_select(spark, d):
    return rounded(points.lag_select(scores(spark, d)))


@query(f"WITH {RAW}, e AS (SELECT year, list_sort(list_distinct(quantile_cont(round(v, 9), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM cube GROUP BY 1) SELECT cell_id, t, CAST(len(list_filter(e[2:len(e) - 1], lambda z: z <= round(v, 9))) AS INTEGER) AS bin FROM cube JOIN e USING (year)")
def quantile_bins(spark, d):
    return points.quantile_bins(T.cube(spark, d).withColumn("x", F.round("v", 9)), ["year"]).select("cell_id", "t", "bin")


# lattice


def coarse(spark, d):
    g = T.grid(spark, d)
    dense = all_cells(spark, g).join(temporal.mean_map(T.cube(spark, d)), "cell_id", "left")
    return spatial.fill_row_mean(decimate(dense, STRIDE), "f1_mean")


@query(q('"row", col, cell_id, ' + r("f1_mean", "filled"), "filled", LATTICE))
def decimate_and_fill(spark, d):
    return rounded(coarse(spark, d).select("row", "col", "cell_id", "f1_mean", "filled"))


@query(q('"row", col, ' + r("z", "lag") + ", n_neighbours", "lagged", LATTICE))
def neighbour_lag(spark, d):
    return rounded(spatial.neighbour_lag(spatial.standardised(coarse(spark, d), "filled"), "z").select("row", "col", "z", "lag", "n_neighbours"))


MORAN = LATTICE + """, w AS (SELECT a.n_neighbours AS na, b.n_neighbours AS nb, a."row", a.col FROM lagged a JOIN lagged b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col)),
s AS (SELECT (SELECT count(*) FROM lagged) AS n, (SELECT sum(z * lag) / sum(z * z) FROM lagged) AS ratio, (SELECT CAST(count(*) FILTER (n_neighbours > 0) AS DOUBLE) FROM lagged) AS s0,
  (SELECT sum((1.0 / na + 1.0 / nb) * (1.0 / na + 1.0 / nb)) / 2 FROM w) AS s1, (SELECT sum(p * p) FROM (SELECT sum(1.0 / na) + sum(1.0 / nb) AS p FROM w GROUP BY "row", col)) AS s2),
m AS (SELECT n, n / s0 * ratio AS i, -1.0 / (n - 1) AS expected, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1.0) * (n + 1) * s0 * s0) - 1.0 / (n - 1) / (n - 1) AS variance FROM s)"""


@query(q("n, " + r("i", "expected", "variance", "(i - expected) / sqrt(variance) AS z", f"{two_sided_sql('((i - expected) / sqrt(variance))')} AS p"), "m", MORAN))
def morans_i(spark, d):
    return rounded(spatial.morans_i(coarse(spark, d)))


@query(q('"row", col, ' + r("z * lag AS local_i") + ", CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN NOT z > 0 AND lag > 0 THEN 2 WHEN NOT z > 0 AND NOT lag > 0 THEN 3 WHEN z > 0 AND NOT lag > 0 THEN 4 END AS quadrant, " + r("CASE WHEN n_neighbours > 0 THEN (lag + z / (cnt - 1)) / sqrt(((cnt - z * z) / (cnt - 1) - z * z / ((cnt - 1) * (cnt - 1))) / n_neighbours * (cnt - 1 - n_neighbours) / (cnt - 2)) END AS z_i"), "lagged, (SELECT CAST(count(*) AS DOUBLE) AS cnt FROM lagged)", LATTICE))
def local_moran(spark, d):
    return rounded(spatial.local_moran(coarse(spark, d)).select("row", "col", "local_i", "quadrant", "z_i"))


#: Classes by the analytic p: half the two-sided tail below 0.05, so |z_i| over this bound.
CLASSED = LATTICE + """, zi AS (SELECT lagged.*, CASE WHEN n_neighbours > 0 THEN (lag + z / (cnt - 1)) / sqrt(((cnt - z * z) / (cnt - 1) - z * z / ((cnt - 1) * (cnt - 1))) / n_neighbours * (cnt - 1 - n_neighbours) / (cnt - 2)) END AS z_i
  FROM lagged, (SELECT CAST(count(*) AS DOUBLE) AS cnt FROM lagged)),
classed AS (SELECT "row", col, CASE WHEN f1_mean IS NULL THEN -1 WHEN abs(z_i) > 1.6448536269514722 THEN CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN NOT z > 0 AND lag > 0 THEN 2 WHEN NOT z > 0 AND NOT lag > 0 THEN 3 ELSE 4 END ELSE 0 END AS cls FROM zi)"""


@query(q('"row", col, cls', "classed", CLASSED))
def lisa_analytic(spark, d):
    return spatial.lisa(coarse(spark, d), p="analytic", had_data="f1_mean").select("row", "col", "cls")


@query(q("cls, count(*) AS n, " + r("100.0 * count(*) / sum(count(*)) OVER () AS percent"), "classed GROUP BY cls", CLASSED))
def lisa_class_counts(spark, d):
    return rounded(spatial.class_counts(spatial.lisa(coarse(spark, d), p="analytic", had_data="f1_mean")))


@query(q("count(DISTINCT t) AS months, count(DISTINCT CASE WHEN t % 41 <> 7 THEN t END) AS with_layer", "raw"))
def quality_months(spark, d):
    return quality.months_with_layer(T.raw_cells(spark, d))


PERMUTED = LATTICE + """, many AS (SELECT count(*) AS cnt FROM lagged), ranked AS (SELECT *, row_number() OVER (ORDER BY "row", col) - 1 AS rank FROM lagged),
tries AS (SELECT p, c, CAST('0x' || substr(md5(concat_ws('-', 42, p, c)), 1, 15) AS BIGINT) % (cnt - 1) AS place FROM range(199) a(p), range(64) b(c), many WHERE cnt > 1),
draws AS (SELECT p, place, row_number() OVER (PARTITION BY p ORDER BY c) AS j FROM (SELECT p, place, min(c) AS c FROM tries GROUP BY ALL) QUALIFY j <= 8),
sims AS (SELECT a."row", a.col, p, any_value(a.z) * avg(b.z) AS own, any_value(a.z * a.lag) AS actual FROM ranked a JOIN draws ON j <= a.n_neighbours JOIN ranked b ON b.rank = place + CASE WHEN place < a.rank THEN 0 ELSE 1 END GROUP BY ALL),
tails AS (SELECT "row", col, count(*) FILTER (round(own, 9) >= round(actual, 9)) AS larger FROM sims GROUP BY ALL),
tested AS (SELECT "row", col, f1_mean, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN NOT z > 0 AND lag > 0 THEN 2 WHEN NOT z > 0 AND NOT lag > 0 THEN 3 WHEN z > 0 AND NOT lag > 0 THEN 4 END AS quadrant,
  CASE WHEN cnt >= 10 AND z IS NOT NULL THEN (least(larger, 199 - larger) + 1) / 200.0 END AS p_sim FROM lagged LEFT JOIN tails USING ("row", col), many)"""


@query(q('"row", col, quadrant, ' + r("CAST(p_sim AS DOUBLE) AS p_sim") + ", CASE WHEN f1_mean IS NULL THEN -1 WHEN p_sim < 0.05 THEN quadrant ELSE 0 END AS cls", "tested", PERMUTED))
def lisa(spark, d):
    return rounded(spatial.lisa(coarse(spark, d), had_data="f1_mean").select("row", "col", "quadrant", "p_sim", "cls"))


@query(q("quadrant, count(*) AS n, " + r("100.0 * count(*) / sum(count(*)) OVER () AS percent"), "(SELECT CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN NOT z > 0 AND lag > 0 THEN 2 WHEN NOT z > 0 AND NOT lag > 0 THEN 3 WHEN z > 0 AND NOT lag > 0 THEN 4 END AS quadrant FROM lagged) GROUP BY quadrant", LATTICE))
def class_counts(spark, d):
    return rounded(spatial.class_counts(spatial.local_moran(coarse(spark, d)), "quadrant"))


@query(f"""WITH {LATTICE}, n AS (SELECT (high + 1) // 2 AS hc, 5 AS wc FROM size) SELECT cells.cell_id, round(filled, 9) + 0.0 AS filled FROM cells, n
LEFT JOIN filled ON filled."row" = round_even(cells."row" * CAST(hc - 1 AS DOUBLE) / greatest(hc * 2 - 1, 1), 0) AND filled.col = round_even(cells.col * CAST(wc - 1 AS DOUBLE) / (wc * 2 - 1), 0)""")
def upscale_map(spark, d):
    g = T.grid(spark, d)
    return rounded(upscale(coarse(spark, d).select("row", "col", "filled"), all_cells(spark, g), g, STRIDE).select("cell_id", "filled"))


# zones and breakpoints


def zoned(spark, d):
    g = T.grid(spark, d)
    cells = all_cells(spark, g).join(temporal.mean_map(T.cube(spark, d)).withColumnRenamed("f1_mean", "x"), "cell_id", "left")
    cells = cell_centres(points.label_cells(cells, points.rasterize_count(snapped(spark, d))), g)
    return breakpoint.with_national(assign_zones(cells, T.zones(spark, d)), cells)


@query(q("zone, cell_id, y, " + r("x"), "everything", ZONED))
def zone_rows(spark, d):
    return rounded(zoned(spark, d).select("zone", "cell_id", "y", "x"))


@query(q("zone, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, count(*) >= 20 AND sum(y) >= 5 AS enough", "everything WHERE x IS NOT NULL GROUP BY zone", ZONED))
def zone_guard(spark, d):
    return breakpoint.zone_guard(zoned(spark, d), 20, 5)


@query(q("zone, " + r("quantile_cont(x, 0.1) AS p10", "quantile_cont(x, 0.9) AS p90"), "everything WHERE x IS NOT NULL GROUP BY zone", ZONED))
def theta_range(spark, d):
    return rounded(breakpoint.theta_range(zoned(spark, d).where("x IS NOT NULL")))


@query(f"WITH {ZONED} SELECT zone, cell_id, y FROM (SELECT *, row_number() OVER (PARTITION BY zone, y ORDER BY md5(concat_ws('-', zone, cell_id, 42)), zone, cell_id) AS nth FROM everything) WHERE nth <= 15")
def case_control_sample(spark, d):
    return points.case_control_sample(zoned(spark, d), ["zone"], ["cell_id"], 15).select("zone", "cell_id", "y")


def newton_sql(name: str, start: str) -> str:
    """CTEs: `name`_n takes the breakpoint's Newton steps from the table `start` (zone, theta), and `name` has parameters and likelihood of each theta."""
    p, n = "1 / (1 + exp(-(a + b * u)))", breakpoint
    held = f"greatest(least({p}, {1 - n.CLIP!r}), {n.CLIP!r})"
    return f"""{name}_n AS (SELECT 0 AS step, zone, theta, side, 0e0 AS a, 0e0 AS b FROM {start}, (VALUES (0), (1)) s(side)
UNION ALL SELECT step, zone, theta, side, a + da * {n.STRIDE!r} / greatest(abs(da), abs(db), {n.STRIDE!r}), b + db * {n.STRIDE!r} / greatest(abs(da), abs(db), {n.STRIDE!r})
  FROM (SELECT *, (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS da, (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS db
    FROM (SELECT f.step + 1 AS step, f.zone, f.theta, f.side, any_value(a) AS a, any_value(b) AS b, coalesce(sum(k - m * {p}), 0) - {n.RIDGE!r} * any_value(a) AS g0, coalesce(sum((k - m * {p}) * u), 0) - {n.RIDGE!r} * any_value(b) AS g1,
      coalesce(sum(m * {p} * (1 - {p})), 0) + {n.RIDGE!r} AS h0, coalesce(sum(m * {p} * (1 - {p}) * u), 0) AS h1, coalesce(sum(m * {p} * (1 - {p}) * u * u), 0) + {n.RIDGE!r} AS h2
      FROM {name}_n f LEFT JOIN bins ON bins.zone = f.zone AND (bins.x > f.theta) = (f.side = 1) WHERE f.step < {n.STEPS} GROUP BY ALL))),
{name} AS (SELECT zone, theta, max(CASE WHEN side = 0 THEN a END) AS a1, max(CASE WHEN side = 0 THEN b END) AS b1, max(CASE WHEN side = 1 THEN a END) AS a2, max(CASE WHEN side = 1 THEN b END) AS b2, sum(nll) AS nll
  FROM (SELECT f.zone, f.theta, f.side, any_value(a) AS a, any_value(b) AS b, -coalesce(sum(k * ln({held}) + (m - k) * ln(1 - {held})), 0) AS nll FROM {name}_n f LEFT JOIN bins ON bins.zone = f.zone AND (bins.x > f.theta) = (f.side = 1) WHERE f.step = {n.STEPS} GROUP BY ALL) GROUP BY ALL)"""


FITS = ZONED + f""", guards AS (SELECT zone, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90 FROM everything WHERE x IS NOT NULL GROUP BY zone HAVING count(*) >= 20 AND sum(y) >= 5),
scaled AS (SELECT *, (p10 + p90) / 2 AS mid, CASE WHEN p90 > p10 THEN (p90 - p10) / 2 ELSE 1e0 END AS half, (p90 - p10) / 24 AS step FROM guards),
bins AS (SELECT zone, x, (x - mid) / half AS u, m, k FROM (SELECT zone, round(round(x, 9), 4) AS x, CAST(count(*) AS DOUBLE) AS m, CAST(sum(y) AS DOUBLE) AS k FROM everything WHERE x IS NOT NULL GROUP BY ALL) JOIN scaled USING (zone)),
wide_ AS (SELECT DISTINCT zone, greatest(least(p10 + i * step, p90), p10) AS theta FROM scaled, range(25) r(i)), {newton_sql("rough", "wide_")},
top_ AS (SELECT zone, theta FROM rough QUALIFY row_number() OVER (PARTITION BY zone ORDER BY round(nll, {breakpoint.DIGITS}), theta) = 1),
close_ AS (SELECT DISTINCT zone, greatest(least(theta - step + i * (2 * step / 24), p90), p10) AS theta FROM top_ JOIN scaled USING (zone), range(25) r(i)), {newton_sql("near_", "close_")},
chosen AS (SELECT * FROM (SELECT * FROM rough UNION ALL SELECT * FROM near_) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY round(nll, {breakpoint.DIGITS}), theta) = 1),
fits AS (SELECT zone, theta, a1 - b1 * mid / half AS a1, b1 / half AS b1, a2 - b2 * mid / half AS a2, b2 / half AS b2, nll, n, events FROM chosen JOIN scaled USING (zone))"""
FITTED = "WITH RECURSIVE " + FITS


def fits(spark, d):
    return breakpoint.fit_breakpoint(zoned(spark, d).select("zone", "x", "y"), 20, 5)


@query(f"{FITTED} SELECT zone, {', '.join(f'round(round({c}, 9), 6) + 0.0 AS {c}' for c in ('theta', 'a1', 'b1', 'a2', 'b2', 'nll'))}, n, events FROM fits")
def fit_breakpoint(spark, d):
    return rounded(fits(spark, d), 6)


@query(f"{FITTED} SELECT zone, round(round(theta, 9), 3) AS theta FROM fits")
def zone_thresholds(spark, d):
    return breakpoint.zone_thresholds(fits(spark, d))


@query(f"""WITH {ZONED}, fits AS (SELECT zone, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90 FROM everything WHERE x IS NOT NULL GROUP BY zone),
grid_ AS (SELECT zone, i / 199.0 AS x, CASE WHEN i / 199.0 <= (p10 + p90) / 2 THEN p10 + 2.0 * (i / 199.0) ELSE p90 - 3.0 * (i / 199.0) END AS u FROM fits, range(200) r(i))
SELECT zone, round(x, 9) + 0.0 AS x, round(1 / (1 + exp(-u)), 9) + 0.0 AS p FROM grid_""")
def predict_curve(spark, d):
    """Curves of given parameters, taken from each zone's quantiles; predict_breakpoint has those of the fit."""
    ends = breakpoint.theta_range(zoned(spark, d).where("x IS NOT NULL"))
    fits_ = ends.select("zone", ((F.col("p10") + F.col("p90")) / 2).alias("theta"), F.col("p10").alias("a1"), F.lit(2.0).alias("b1"), F.col("p90").alias("a2"), F.lit(-3.0).alias("b2"))
    return rounded(breakpoint.predict_breakpoint(fits_))


@query(f"{FITTED} SELECT zone, {r('i / 199.0 AS x').replace('i / 199.0', 'CAST(i AS DOUBLE) / 199')}, round(round(1 / (1 + exp(-CASE WHEN CAST(i AS DOUBLE) / 199 <= theta THEN a1 + b1 * i / 199 ELSE a2 + b2 * i / 199 END)), 9), 6) + 0.0 AS p FROM fits, range(200) r(i)")
def predict_breakpoint(spark, d):
    out = rounded(breakpoint.predict_breakpoint(fits(spark, d)).withColumn("p", F.round("p", 9)))
    return out.withColumn("p", F.round("p", 6) + F.lit(0.0))


@query(q("cell_id, coalesce(CAST(f1_mean < 0.4 AS DOUBLE), 0.0) AS f9_below", "cells LEFT JOIN means USING (cell_id)", LATTICE))
def below_threshold(spark, d):
    g = T.grid(spark, d)
    return breakpoint.below_threshold(all_cells(spark, g).join(temporal.mean_map(T.cube(spark, d)), "cell_id", "left"), 0.4).select("cell_id", "f9_below")


# the feature table


def feature_table(spark, d, **how):
    return plan.features(T.cube(spark, d), snapped(spark, d), T.spine(spark), T.grid(spark, d), T.BASE, 6, 0.4, STRIDE, **how)


def checked_features(spark, d):
    """All ten features, the classes by the analytic p, which SQL can follow; doubles rounded."""
    return rounded(feature_table(spark, d, p="analytic").withColumn("f7_cvsi_mean", F.round("f7_cvsi_mean", 6)))


WIDE = f"""{KENDALL}, {CLASSED.removeprefix(RAW + ", ")}, timed AS (SELECT cell_id, avg(v) AS f1_mean, max(CASE WHEN month = 6 THEN clim END) AS f2_clim_june, avg(delta) AS f3_anomaly_mean, avg(trend) AS f4_trend_mean, avg(resid) AS f5_residual_mean FROM frame GROUP BY 1),
s7 AS (SELECT cell_id, avg(cvsi_6) AS f7_cvsi_mean FROM stress GROUP BY 1),
wide AS (SELECT cells.cell_id, cells."row", cells.col, {r("f1_mean", "f2_clim_june", "f3_anomaly_mean", "f4_trend_mean", "f5_residual_mean", "tau AS f6_mk_tau")}, round(f7_cvsi_mean, 6) + 0.0 AS f7_cvsi_mean, cls AS f8_lisa, coalesce(CAST(f1_mean < 0.4 AS DOUBLE), 0.0) AS f9_below, coalesce(n_points, 0) AS f10_points
FROM (SELECT cells.*, (high + 1) // 2 AS hc FROM cells, size) cells LEFT JOIN timed USING (cell_id) LEFT JOIN tests USING (cell_id) LEFT JOIN s7 USING (cell_id) LEFT JOIN counts USING (cell_id)
LEFT JOIN classed ON classed."row" = round_even(cells."row" * CAST(hc - 1 AS DOUBLE) / greatest(hc * 2 - 1, 1), 0) AND classed.col = round_even(cells.col * CAST(4 AS DOUBLE) / 9, 0))"""
TALL = WIDE + ", tall AS (" + " UNION ALL ".join(f"""SELECT cell_id, "row", col, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM wide""" for f in plan.FEATURES) + ")"


@query(f"WITH {WIDE} SELECT * FROM wide")
def features(spark, d):
    return checked_features(spark, d)


@query(f"WITH {TALL} SELECT * FROM tall")
def features_long(spark, d):
    return granules.long_features(checked_features(spark, d))


@query(f"""WITH {TALL} SELECT *, 'tables' AS source FROM tall""")
def feature_sink(spark, d):
    """Features written a folder for each to the shared folder, with a tag, and read back."""
    path = new_path(spark, "sink")
    granules.write_features(checked_features(spark, d), path, {"source": "tables"})
    return spark.read.parquet(path)


@query(f"WITH {TALL} SELECT feature, count(value) AS n, {r('avg(value) AS mean')}, min(value) AS min, max(value) AS max FROM tall GROUP BY feature")
def feature_summary(spark, d):
    return rounded(plan.feature_summary(checked_features(spark, d)))
