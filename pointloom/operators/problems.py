"""What is wrong with a cloud, a limit or a spectrum, as columns: for tables of many, where one that is bad shouldn't stop the
others. A null column says that nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RECORD_SIZE, RECORDS_OFFSET, UINT32_MAX
from ..functions.expressions import not_finite
from .spectrum import FIELDS, histogram


def limit_problem(limit: Column) -> Column:
    """Of a limit of points, which a preview holds in 32 bits."""
    return F.when(limit.isNull() | (limit <= 0), "max_points must be a positive integer").when(limit > UINT32_MAX, "max_points is above the format's 32-bit limit")


def size_problem(stored: Column) -> Column:
    """Of a number of stored points, whose file must be below 4 GB."""
    return F.when(F.lit(RECORDS_OFFSET) + stored * RECORD_SIZE > UINT32_MAX, "the preview would be above the format's 32-bit size limit")


def cloud_problem(n: Column, first_bad: Column) -> Column:
    """Of a cloud of n points, the first of which that isn't finite is first_bad (or null)."""
    found = F.when(n == 0, "an empty point cloud cannot be encoded").when(n > UINT32_MAX, "a preview holds at most 2^32 - 1 input points")
    return found.when(first_bad.isNotNull(), F.concat(F.lit("points contain non-finite values, first at point "), first_bad.cast("string")))


def file_problem(size: Column) -> Column:
    """Of a point file's size in bytes."""
    return F.when(size.isNull() | (size == 0) | (size % 16 != 0), "not a non-empty file of four 32-bit floats a point")


def check_clouds(points: DataFrame, keys: list[str], limits: DataFrame | None = None) -> DataFrame:
    """keys, n, max_points and problem of each cloud, as the keys tell them apart: what encoding it to max_points would say
    first. limits has max_points by keys; clouds that only it has are empty ones. Keys aren't null."""
    bad = F.lit(False)
    for c in FIELDS:
        bad = bad | not_finite(F.col(c).cast("float"))
    found = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.when(bad, F.col("point_index"))).alias("__bad"))
    if limits is not None:
        found = found.join(limits.select(*keys, F.col("max_points").cast("long").alias("max_points")), keys, "full")
    else:
        found = found.withColumn("max_points", F.lit(UINT32_MAX).cast("long"))
    found = found.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    stored = F.least("n", "max_points")
    problem = F.coalesce(limit_problem(F.col("max_points")), cloud_problem(F.col("n"), F.col("__bad")), size_problem(stored))
    return found.select(*keys, "n", "max_points", problem.alias("problem"))


def spectrum_problem(cloud: DataFrame, spectrum: DataFrame) -> DataFrame:
    """(bin, problem) of each bin of a stored spectrum (bin, true_count, stored_count) or of the cloud: what hinders picking the
    points behind it."""
    own = histogram(cloud).withColumnRenamed("true_count", "__own")
    rows = spectrum.join(own, "bin", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    problem = F.when(zero("stored_count") > zero("true_count"), "the retained spectrum exceeds the original one").when(zero("true_count") != zero("__own"), "the spectrum's counts do not match the cloud's")
    return rows.select("bin", problem.alias("problem"))
