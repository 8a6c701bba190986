"""Keep the mass spectrum of a growing table of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import mass_bin


def stream_points(spark: SparkSession, folder: str, schema: str = "point_index long, x float, y float, z float, mass float") -> DataFrame:
    """Points of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def running_spectrum(points: DataFrame) -> DataFrame:
    """The spectrum so far (complete or update mode). Its state is a row for each of at most 6,000 bins."""
    return points.groupBy(mass_bin(F.col("mass")).alias("bin")).agg(F.count("*").alias("true_count"))


def preview_each(points: DataFrame, folder: str, max_points: int, checkpoint: str):
    """Write one preview for each micro-batch, numbered by batch; a batch that is run again writes the same file."""
    from .. import api
    from ..sources import files

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            target = f"{folder}/batch-{number:08d}.preview"
            files.remove([target])
            api.encode(batch, target, max_points)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
