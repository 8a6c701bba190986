"""Binning, quantization and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SPECTRUM_BIN_DA, SPECTRUM_BINS, SPECTRUM_MAX_DA, SPECTRUM_MIN_DA, STEPS


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def mass_bin(mass: Column) -> Column:
    """The spectrum bin of a mass: arithmetic in double by the double 0.05; out-of-range masses go to the end bins."""
    bins = F.floor((mass.cast("double") - F.lit(SPECTRUM_MIN_DA)) / F.lit(SPECTRUM_BIN_DA))
    return clip(bins, 0, SPECTRUM_BINS - 1).cast("int")


def not_finite(value: Column) -> Column:
    """Null, NaN or infinite."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def quantize(value: Column, low: Column, high: Column) -> Column:
    """0..65535 over low..high, halves rounded up; all 0 where the range is empty."""
    extent = F.when(high > low, high - low).otherwise(F.lit(1.0))
    share = (value.cast("double") - low) / extent
    return clip(F.floor(share * F.lit(STEPS) + F.lit(0.5)), 0, int(STEPS)).cast("int")


def quantize_mass(mass: Column) -> Column:
    return quantize(mass, F.lit(SPECTRUM_MIN_DA), F.lit(SPECTRUM_MAX_DA))


def dequantize(value: Column, low: Column, high: Column) -> Column:
    return (low + value.cast("double") / F.lit(STEPS) * (high - low)).cast("float")


def midpoint(k: Column, count: Column, take: Column) -> Column:
    """The rank that the k-th of take evenly spaced picks out of count has."""
    return F.floor((k.cast("double") + F.lit(0.5)) * count / take).cast("long")


def pick_number(rank: Column, count: Column, take: Column) -> Column:
    """Which pick (k) a rank is, or null. Picks are count / take apart, so only the three k around rank * take / count
    can have this rank; the outer two also absorb rounding."""
    near = F.floor(rank.cast("double") * take / count).cast("long")
    hit = F.lit(None).cast("long")
    for step in (1, 0, -1):
        k = near + step
        hit = F.when((k >= 0) & (k < take) & (midpoint(k, count, take) == rank), k).otherwise(hit)
    return F.when(take > 0, hit)


def format_bytes(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """A size for people: B as it is, then KB, MB, GB with two decimals below ten and one from there. The last of units goes on without end."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        value = size.cast("double") / F.lit(float(1024**power))
        text = F.when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
        out = F.when(size >= 1024**power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


# The colours at 0, 1/4, 1/2, 3/4 and 1 of the palette, as red, green, blue.
PALETTE = (
    (0.37, 0.34, 0.95),
    (0.00, 0.82, 0.91),
    (0.35, 0.91, 0.35),
    (1.00, 0.72, 0.08),
    (0.94, 0.18, 0.10),
)
#: The mass at the palette's end.
PALETTE_MASS = 120.0


def palette(mass: Column) -> list[Column]:
    """red, green, blue of a mass, between neighbouring colours in proportion."""
    t = clip(mass.cast("double") / F.lit(PALETTE_MASS), 0.0, 1.0)
    part = F.least(F.floor(t * 4), F.lit(3)).cast("int")
    out = []
    for channel, name in enumerate(("red", "green", "blue")):
        stops = F.array(*[F.lit(float(colour[channel])) for colour in PALETTE])
        a, b, w = F.get(stops, part), F.get(stops, part + 1), t * 4 - part
        out.append((a * (1 - w) + b * w).alias(name))
    return out
