"""One-pass statistics of a cloud: validation, bounds and the mass spectrum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SPECTRUM_BINS, UINT32_MAX
from ..functions.expressions import mass_bin, not_finite

FIELDS = ("x", "y", "z", "mass")
AXES = ("x", "y", "z")


def as_cloud(df: DataFrame) -> DataFrame:
    """df's point_index and its four fields as FLOAT; other columns are left out."""
    missing = {"point_index", *FIELDS} - set(df.columns)
    if missing:
        raise ValueError(f"a point cloud needs the columns {sorted(missing)}")
    return df.select(F.col("point_index").cast("long").alias("point_index"), *[F.col(c).cast("float").alias(c) for c in FIELDS])


def binned(cloud: DataFrame) -> DataFrame:
    return cloud.withColumn("bin", mass_bin(F.col("mass")))


def bad_points(cloud: DataFrame) -> DataFrame:
    """One row: how many points have a null, NaN or infinite field, and the first of them."""
    bad = F.lit(False)
    for c in FIELDS:
        bad = bad | not_finite(F.col(c))
    return cloud.agg(F.count(F.when(bad, 1)).alias("bad_points"), F.min(F.when(bad, F.col("point_index"))).alias("first_bad"))


def bounds(cloud: DataFrame) -> DataFrame:
    """One row: n, and min and max of each axis over all points, as DOUBLE."""
    return cloud.agg(F.count("*").alias("n"), *[f(F.col(a)).cast("double").alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def histogram(cloud: DataFrame) -> DataFrame:
    """(bin, true_count) of the bins that have points."""
    return binned(cloud).groupBy("bin").agg(F.count("*").alias("true_count"))


def densify(spectrum: DataFrame) -> DataFrame:
    """All bins, with zeros where the spectrum has none."""
    every = spectrum.sparkSession.range(SPECTRUM_BINS).select(F.col("id").cast("int").alias("bin"))
    names = [c for c in spectrum.columns if c != "bin"]
    return every.join(F.broadcast(spectrum), "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


@dataclass(frozen=True)
class Summary:
    """What one pass over a cloud gives: at most 6,000 bins and the bounds."""

    n: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    counts: dict[int, int]

    def box(self, spark: SparkSession) -> DataFrame:
        """One row of the bounds, as bounds gives them."""
        values = {f"{a}_{n}": float(v[i]) for i, a in enumerate(AXES) for n, v in (("min", self.low), ("max", self.high))}
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def summarize(cloud: DataFrame) -> Summary:
    """Validate a cloud and gather its bounds and spectrum in one scan; only a row for each occupied bin reaches the
    driver. Raises ValueError for an empty cloud, too many points, or a field that isn't finite."""
    bad = F.lit(False)
    for c in FIELDS:
        bad = bad | not_finite(F.col(c))
    extremes = [f(F.col(a)).cast("double").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    rows = binned(cloud).groupBy("bin").agg(F.count("*").alias("n"), F.min(F.when(bad, F.col("point_index"))).alias("bad"), *extremes).collect()
    if not rows:
        raise ValueError("an empty point cloud cannot be encoded")
    n = sum(r["n"] for r in rows)
    if n > UINT32_MAX:
        raise ValueError("a preview holds at most 2^32 - 1 input points")
    first = [r["bad"] for r in rows if r["bad"] is not None]
    if first:
        raise ValueError(f"points contain non-finite values, first at point {min(first)}")
    low, high = (tuple(f(r[f"{name}_{a}"] for r in rows) for a in AXES) for name, f in (("min", min), ("max", max)))
    return Summary(n, low, high, {r["bin"]: r["n"] for r in rows})
