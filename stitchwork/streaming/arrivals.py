"""Tables that arrive over time: the same cells and profiles as in a batch, kept up as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.sources import files


def arriving_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells (path, row_id, ord, v) of JSON tables as their files arrive."""
    schema = "url string, title string, heading string, header array<string>, rows array<array<string>>"
    tables = spark.readStream.schema(schema).option("multiLine", True).json(folder).withColumn("path", F.col("_metadata.file_path"))
    return files.cells(tables)


def running_density(cells: DataFrame) -> DataFrame:
    """E04 as a stream: (path, ord, n, filled) so far."""
    return cells.groupBy("path", "ord").agg(F.count("*").alias("n"), F.count("v").alias("filled"))


def appended(cells: DataFrame, out: str, checkpoint: str):
    """Writes a stream of cells to Parquet, all that is there now, each file once even after a restart."""
    return cells.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
