"""How faithful a preview is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import AXES


def total_variation(spectrum: DataFrame) -> DataFrame:
    """Half the summed difference of the two normalized spectra (bin, true_count, stored_count)."""
    totals = spectrum.agg(F.sum("true_count").alias("__t"), F.sum("stored_count").alias("__s"))
    rows = spectrum.crossJoin(F.broadcast(totals))
    gap = F.abs(F.col("true_count") / F.col("__t") - F.col("stored_count") / F.col("__s"))
    return rows.agg((F.sum(gap) * 0.5).alias("total_variation"))


def integrity(spectrum: DataFrame) -> DataFrame:
    """Totals of both spectra and whether some bin keeps more than it has."""
    return spectrum.agg(F.sum("true_count").alias("original_point_count"), F.sum("stored_count").alias("stored_point_count"), F.coalesce(F.bool_or(F.col("stored_count") > F.col("true_count")), F.lit(False)).alias("exceeds"))


def roundtrip_error(decoded: DataFrame) -> DataFrame:
    """The largest difference of each field between x, y, z, mass and dx, dy, dz, dmass; of masses in range only."""
    gap = lambda a: F.abs(F.col(a).cast("double") - F.col(f"d{a}").cast("double"))
    within = (F.col("mass") >= 0) & (F.col("mass") <= 300)
    return decoded.agg(F.count("*").alias("n"), *[F.max(gap(a)).alias(f"{a}_error") for a in AXES], F.max(F.when(within, gap("mass"))).alias("mass_error"))
