"""Manifests of granule files, months, cell tables from strips, point files, and the feature sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.grid import GridSpec, cell_id

#: Cell ids of a file of a month; columns of strips.
FILE_CELLS, STRIPS = 1 << 22, "path string, row int, values array<double>"
POINTS = "latitude double, longitude double, acq_date date, year int, month int"


def classify_layers(paths: DataFrame, path: str = "path", value_mark: str = "_NDVI_") -> DataFrame:
    """paths with layer: "quality" if the name holds "reliability" in any case, "value" if it holds the mark, else null (another layer)."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return paths.withColumn("layer", F.when(F.lower(name).contains("reliability"), "quality").when(name.contains(value_mark), "value"))


def parse_granule_name(df: DataFrame, path: str = "path", fallback_yyyymm: bool = False) -> DataFrame:
    """df with year and month from doyYYYYDDD in the name; null without it. The fallback takes the first six digits that make a month."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    year, day = (F.regexp_extract(name, r"doy(\d{4})(\d{3})", k).try_cast("int") for k in (1, 2))
    date = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    y, m = F.year(date), F.month(date)
    if fallback_yyyymm:
        y2, m2 = (F.regexp_extract(name, r"(\d{4})(0[1-9]|1[0-2])", k).try_cast("int") for k in (1, 2))
        y, m = F.coalesce(y, y2), F.coalesce(m, F.when(date.isNull(), m2))
    return df.withColumns({"year": y, "month": m, "ym": y * 12 + m - 1})


def granule_name_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """df with product, version, layer name, year, day of year, time, feature id and extension of a provider's file name."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    pattern = r"^([A-Za-z0-9]+)\.(\d+)_(.+)_doy(\d{4})(\d{3})(\d{6})?[._](aid\d+)\.(\w+)$"
    parts = ("product", "version", "layer_name", "doy_year", "doy", "hhmmss", "feature_id", "extension")
    return df.withColumns({p: F.nullif(F.regexp_extract(name, pattern, k + 1), F.lit("")) for k, p in enumerate(parts)})


def granule_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, layer, year, month and ym of the files of a folder; contents aren't read. Of files of one layer and month the last path counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select("path", "length")
    known = parse_granule_name(classify_layers(files)).where("layer IS NOT NULL")
    dated = known.where("ym IS NOT NULL").groupBy("layer", "year", "month", "ym").agg(F.max(F.struct("path", "length")).alias("f")).select("f.path", "f.length", "layer", "year", "month", "ym")
    return dated.unionByName(known.where("ym IS NULL"), allowMissingColumns=True)


def write_months(cells: DataFrame, path: str, more: tuple[str, ...] = ()) -> DataFrame:
    """cells (cell_id, year, month, ...) as Parquet in a folder for each month (and value of `more`), read back; a file holds a block of FILE_CELLS cell ids at most, so files are bounded and slices of months read their own folders only."""
    block = F.floor(F.col("cell_id") / FILE_CELLS)
    cells.repartition("year", "month", *more, block).write.partitionBy("year", "month", *more).parquet(path)
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    return cells.sparkSession.read.parquet(path).select(*[F.col(c).cast(kinds[c]).alias(c) if c in more else F.col(c) for c in cells.columns])


def table_manifest(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """path, length and the keys of the folders it lies in, for the data files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select("path", "length", *[F.nullif(F.regexp_extract("path", f"/{k}=([^/]*)/", 1), F.lit("")).alias(k) for k in keys])


def read_strips(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(path, row, values) of the strip files (Parquet: row int, values array<double>) that a manifest (path, ...) lists. Files that can't be read are skipped; `granule_stats` tells which."""
    paths = [r["path"] for r in manifest.select("path").collect()]  # one row for each file, which Spark's reader needs as a list
    if not paths:
        return spark.createDataFrame([], STRIPS)
    rows = spark.read.schema("row int, values array<double>").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*paths)
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")  # as listings write it
    return rows.select(path.alias("path"), "row", "values")


def granule_stats(cells: DataFrame, by: list[str], manifest: DataFrame | None = None, nodata: float | None = -3000.0) -> DataFrame:
    """(by, n, n_present, largest, readable) of each granule, of every one that the manifest (by, ...) lists: cells, cells with a value, the largest value, and whether there is any cell. What is not readable has failed.

    Made once when cells come in, and kept beside them: masks then need no second scan to tell scaled granules from others.
    """
    present = F.col("raw") if nodata is None else F.when(F.col("raw") != nodata, F.col("raw"))
    stats = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(present).alias("n_present"), F.max(present).alias("largest"))
    if manifest is not None:
        stats = manifest.select(*by).distinct().join(stats, by, "left")
    return stats.withColumns({"n": F.coalesce("n", F.lit(0)), "n_present": F.coalesce("n_present", F.lit(0))}).withColumn("readable", F.col("n") > 0)


def ingest(cells: DataFrame, by: list[str], path: str, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """cells (cell_id, year, month, by, raw, ...) and their granules' statistics, written under path and read back: cells by month, statistics beside them."""
    stored = write_months(cells, f"{path}/cells")
    granule_stats(stored, by, manifest).write.parquet(f"{path}/stats")
    return stored, cells.sparkSession.read.parquet(f"{path}/stats")


def filter_period(df: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Rows whose (year, month) lies from start to end, both inclusive."""
    ym = F.col("year") * 12 + F.col("month")
    return df.where(ym.between(start[0] * 12 + start[1], end[0] * 12 + end[1]))


def month_spine(spark: SparkSession, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(t, year, month) from start to end; t counts months from start."""
    first, last = start[0] * 12 + start[1] - 1, end[0] * 12 + end[1] - 1
    ym = F.col("id") + first
    return spark.range(last - first + 1).select(F.col("id").cast("int").alias("t"), F.floor(ym / 12).cast("int").alias("year"), (ym % 12 + 1).cast("int").alias("month"))


def missing_months(present: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(year, month) from start to end that present (year, month) lacks."""
    return month_spine(present.sparkSession, start, end).select("year", "month").join(present.select("year", "month").distinct(), ["year", "month"], "left_anti")


def explode_strips(strips: DataFrame, grid: GridSpec) -> DataFrame:
    """(granule columns, row, values array) to a row for each cell with a value; NaN becomes null and goes. Order lives in the month, not in the rows."""
    others = [c for c in strips.columns if c != "values"]
    cells = strips.select(*others, F.posexplode("values").alias("col", "raw")).withColumn("raw", F.nanvl(F.col("raw").cast("double"), F.lit(None)))
    return cells.where("raw IS NOT NULL").withColumn("cell_id", cell_id(F.col("row"), F.col("col"), grid))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).option("header", True).csv(path).select("latitude", "longitude", "acq_date", "year", "month")


def long_features(features: DataFrame, keys: tuple[str, ...] = ("cell_id", "row", "col")) -> DataFrame:
    """One row for each cell and feature column; missing values stay null."""
    names = [c for c in features.columns if c not in keys]
    doubles = features.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(list(keys), names, "feature", "value")


def write_features(features: DataFrame, path: str, tags: dict[str, str] | None = None, long: bool = True) -> None:
    """Write features as Parquet, a folder for each feature, tags (source, period, reference) as constant columns."""
    out = long_features(features) if long else features
    out = out.withColumns({k: F.lit(v) for k, v in (tags or {}).items()}) if tags else out
    writer = out.repartition("feature", F.pmod(F.xxhash64("cell_id"), F.lit(16))).write.partitionBy("feature") if long else out.write
    writer.mode("overwrite").parquet(path)


def nan_to_null(column: str) -> Column:
    return F.nanvl(F.col(column), F.lit(None))
