"""Cubes stored by cell, so that per-cell jobs read them without moving them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.scratch import new_path

#: Values of a block of cells, about: one task reads a block.
BLOCK_ROWS = 1 << 22


def blocks(spark, cells: int, months: int) -> int:
    """How many blocks a cube is stored in: as many as hold BLOCK_ROWS values each, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-cells * months // BLOCK_ROWS))


def by_cell(cube: DataFrame, n_blocks: int, name: str = "cube") -> DataFrame:
    """cube written bucketed by cell_id and sorted by cell and month, and read back: the one exchange of the cube. What groups or orders the result by cell reads its blocks as they are."""
    spark = cube.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    placed = cube.repartition(n_blocks, "cell_id")
    placed.write.bucketBy(n_blocks, "cell_id").sortBy("cell_id", "t").option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table).select(*[F.col(c) for c in cube.columns])
