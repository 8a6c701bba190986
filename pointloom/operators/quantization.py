"""Quantized records and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SPECTRUM_MAX_DA, SPECTRUM_MIN_DA
from ..functions.expressions import dequantize, quantize, quantize_mass
from .spectrum import AXES

QUANTIZED = ("qx", "qy", "qz", "qm")


def quantize_points(points: DataFrame, limits: DataFrame) -> DataFrame:
    """points with qx, qy, qz over the bounds of the whole cloud (one row, broadcast) and qm over the fixed mass range."""
    names = [f"{a}_{n}" for a in AXES for n in ("min", "max")]
    rows = points.crossJoin(F.broadcast(limits.select(*[F.col(n).alias(f"__{n}") for n in names])))
    values = [quantize(F.col(a), F.col(f"__{a}_min"), F.col(f"__{a}_max")).alias(f"q{a}") for a in AXES]
    return rows.select(*points.columns, *values, quantize_mass(F.col("mass")).alias("qm"))


def dequantize_records(records: DataFrame, limits: DataFrame) -> DataFrame:
    """records with dx, dy, dz, dmass as FLOAT."""
    names = [f"{a}_{n}" for a in AXES for n in ("min", "max")]
    rows = records.crossJoin(F.broadcast(limits.select(*[F.col(n).alias(f"__{n}") for n in names])))
    values = [dequantize(F.col(f"q{a}"), F.col(f"__{a}_min"), F.col(f"__{a}_max")).alias(f"d{a}") for a in AXES]
    mass = dequantize(F.col("qm"), F.lit(SPECTRUM_MIN_DA), F.lit(SPECTRUM_MAX_DA)).alias("dmass")
    return rows.select(*records.columns, *values, mass)

