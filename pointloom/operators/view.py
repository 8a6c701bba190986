"""Series and transforms that a viewer of clouds and spectra draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPECTRUM_BIN_DA, SPECTRUM_BINS
from .spectrum import AXES, bounds

# The camera at rest and the end of the drawn masses.
YAW, PITCH, ZOOM = -0.72, 0.34, 0.72
VIEW_MASS = 120.0


def normalization(cloud: DataFrame) -> DataFrame:
    """One row: the centre of the cloud's box, and the scale that makes its longest edge 1."""
    box = bounds(cloud)
    edges = [F.col(f"{a}_max") - F.col(f"{a}_min") for a in AXES]
    return box.select("n", *[((F.col(f"{a}_min") + F.col(f"{a}_max")) * 0.5).alias(f"center_{a}") for a in AXES], (F.lit(1.0) / F.greatest(*edges, F.lit(1e-9))).alias("scale"))


def project(cloud: DataFrame, yaw: float = YAW, pitch: float = PITCH, zoom: float = ZOOM, aspect: float = 1.0) -> DataFrame:
    """cloud with screen_x and screen_y: centred, scaled, turned about z by yaw, tilted by pitch."""
    view = normalization(cloud).select(*[F.col(f"center_{a}").alias(f"__{a}") for a in AXES], F.col("scale").alias("__scale"))
    rows = cloud.crossJoin(F.broadcast(view))
    at = {a: (F.col(a).cast("double") - F.col(f"__{a}")) * F.col("__scale") for a in AXES}
    turn = lambda f, angle: f(F.lit(float(angle)))
    right = turn(F.cos, yaw) * at["x"] - turn(F.sin, yaw) * at["y"]
    deep = turn(F.sin, yaw) * at["x"] + turn(F.cos, yaw) * at["y"]
    up = turn(F.cos, pitch) * at["z"] - turn(F.sin, pitch) * deep
    return rows.select(*cloud.columns, (right * zoom / aspect).alias("screen_x"), (up * zoom).alias("screen_y"))


def point_style(n: Column, ratio: float = 1.0) -> list[Column]:
    """opacity and point_size for n drawn points on a screen of this pixel ratio."""
    opacity = F.greatest(F.lit(0.035), F.least(F.lit(0.18), F.lit(18000.0) / n))
    return [opacity.alias("opacity"), F.lit(max(1.2, min(ratio, 2.0) * 0.9)).alias("point_size")]


def spectrum_view(spectrum: DataFrame, width: int, max_mass: float = VIEW_MASS) -> DataFrame:
    """(pixel, true_peak, stored_peak, true_height, stored_height) of a plot width pixels wide.

    A pixel shows the largest count of the bins that it overlaps, on a scale of log1p up to the highest; stored counts
    are first scaled to the visible total. Each bin is put under the one or more pixels that it overlaps, so the
    interval join is an explode and a group-by."""
    visible = min(SPECTRUM_BINS, math.ceil(max_mass / SPECTRUM_BIN_DA))
    rows = spectrum.where(F.col("bin") < visible)
    totals = rows.agg(F.sum("true_count").alias("t"), F.sum("stored_count").alias("s"), F.max("true_count").alias("tm"), F.max("stored_count").alias("sm"))
    scale = F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(F.lit(1.0))
    totals = totals.select(scale.alias("scale"), F.greatest(F.lit(1.0), F.col("tm"), F.col("sm") * scale).alias("peak"))
    per = visible / width
    # pixels p with floor(p * per) <= bin < ceil((p + 1) * per)
    near = F.sequence(F.floor(F.col("bin") / F.lit(per)).cast("int") - 1, F.ceil((F.col("bin") + 1) / F.lit(per)).cast("int") + 1)
    pixels = F.filter(near, lambda p: (p >= 0) & (p < width) & (F.floor(p * F.lit(per)) <= F.col("bin")) & (F.col("bin") < F.ceil((p + 1) * F.lit(per))))
    pooled = rows.withColumn("pixel", F.explode(pixels)).groupBy("pixel").agg(F.max("true_count").alias("true_peak"), F.max("stored_count").alias("stored_peak"))
    every = spectrum.sparkSession.range(width).select(F.col("id").cast("int").alias("pixel"))
    out = every.join(F.broadcast(pooled), "pixel", "left").crossJoin(F.broadcast(totals))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("true_peak", "stored_peak")})
    height = lambda v: F.log1p(v) / F.log1p("peak")
    return out.select("pixel", "true_peak", "stored_peak", height(F.col("true_peak").cast("double")).alias("true_height"), height(F.col("stored_peak") * F.col("scale")).alias("stored_height"))


def moved_camera(pitch: float, zoom: float, tilt: float = 0.0, wheel: float = 0.0) -> tuple[float, float]:
    """Pitch and zoom after a tilt and a turn of the wheel, within what the viewer allows."""
    return max(-1.45, min(1.45, pitch + tilt)), max(0.15, min(8.0, zoom * math.exp(-wheel * 0.001)))


def camera_moves(moves: DataFrame, pitch: float = PITCH, zoom: float = ZOOM) -> DataFrame:
    """moves (tilt, wheel) with the pitch and zoom that each leads to from the camera at rest, within the same limits."""
    tilted = F.greatest(F.lit(-1.45), F.least(F.lit(1.45), F.lit(pitch) + F.col("tilt")))
    zoomed = F.greatest(F.lit(0.15), F.least(F.lit(8.0), F.lit(zoom) * F.exp(-F.col("wheel") * F.lit(0.001))))
    return moves.withColumns({"pitch": tilted, "zoom": zoomed})


def ticks_of(spectrum: DataFrame, max_mass: float = VIEW_MASS, step: int = 20) -> DataFrame:
    """axis_ticks with the number of points whose bin lies from each tick to the next."""
    tick = F.floor(F.col("bin") / F.lit(round(step / SPECTRUM_BIN_DA))).cast("int") * step
    counts = spectrum.groupBy(tick.alias("mass")).agg(F.sum("true_count").alias("points"))
    return axis_ticks(spectrum.sparkSession, max_mass, step).join(counts, "mass", "left").withColumn("points", F.coalesce("points", F.lit(0)))


def axis_ticks(spark, max_mass: float = VIEW_MASS, step: int = 20) -> DataFrame:
    """Where the labels of the mass axis stand, as shares of its length."""
    return spark.range(0, int(max_mass) + 1, step).select(F.col("id").cast("int").alias("mass"), (F.col("id") / F.lit(max_mass)).alias("place"))
