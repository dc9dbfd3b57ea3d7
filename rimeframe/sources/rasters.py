"""Rasters on disk: a header table and a cell table, in Parquet.

Cells are partitioned by raster and, inside, sorted by tile, so a window's limits on rows and columns reach the scan as
pushed filters and skip row groups; a header is read without touching a cell.  Missing cells are NULL.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; only a local master, whose executors are the driver's
    threads, may go without one and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(cells: DataFrame, headers: DataFrame, path: str, tile: int = 256) -> None:
    """Cells (raster_id, row, col, z) and headers (raster_id, nx, ny, x0, x1, y0, y1, crs) of any number of rasters."""
    tiled = cells.withColumn("tile", F.floor(F.col("row") / tile) * 1_000_000 + F.floor(F.col("col") / tile))
    tiled.repartition("raster_id", "tile").sortWithinPartitions("raster_id", "tile", "row", "col").write.mode("errorifexists").partitionBy("raster_id").parquet(f"{path}/cells")
    headers.write.mode("errorifexists").parquet(f"{path}/headers")


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def window(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, raster_id: int | None = None, nodata: float | None = None, every: int = 1) -> DataFrame:
    """Cells of a window (ends exclusive), thinned to every n-th row and column; ``nodata`` becomes NULL."""
    out = spark.read.parquet(f"{path}/cells").drop("tile")
    if raster_id is not None:
        out = out.where(F.col("raster_id") == raster_id)
    for name, limits in (("row", rows), ("col", cols)):
        if limits is not None:
            out = out.where((F.col(name) >= limits[0]) & (F.col(name) < limits[1]))
    if every > 1:
        out = out.where((F.pmod(F.col("row"), F.lit(every)) == 0) & (F.pmod(F.col("col"), F.lit(every)) == 0))
        out = out.withColumns({"row": F.floor(F.col("row") / every), "col": F.floor(F.col("col") / every)})
    return out if nodata is None else out.withColumn("z", F.when(F.col("z") != nodata, F.col("z")))


def checkpoint(df: DataFrame, name: str) -> DataFrame:
    """A table written and read again: what later steps reuse, and what a lost executor does not take away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
