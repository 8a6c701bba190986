"""Proportional mass-stratified sampling: allocation of a budget over bins, ranks in bins, and midpoint picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import RECORD_SIZE, RECORDS_OFFSET, UINT32_MAX
from ..functions.expressions import midpoint, pick_number
from .spectrum import binned

#: The most points that a preview can store.
MOST_STORED = (UINT32_MAX - RECORDS_OFFSET) // RECORD_SIZE
#: Points whose ranks are counted in one part.
RANK_PART = 1 << 16


def check_limit(max_points: int) -> int:
    """max_points, if it is a positive whole number that the format can hold."""
    if isinstance(max_points, bool) or not hasattr(max_points, "__index__") or max_points <= 0:
        raise ValueError("max_points must be a positive integer")
    if max_points > UINT32_MAX:
        raise ValueError("max_points is above the format's 32-bit limit")
    return int(max_points)


def check_size(stored: int) -> None:
    """A preview's size must fit 32 bits, which also keeps the allocation's products within 63."""
    if RECORDS_OFFSET + RECORD_SIZE * stored > UINT32_MAX:
        raise ValueError("the preview would be above the format's 32-bit size limit")


def allocate(spectrum: DataFrame, max_points: int) -> DataFrame:
    """(bin, true_count, quotient, remainder, take): max_points shared out in proportion, what is left going to the
    largest remainders, then the lowest bins. Everything is taken if it fits, with quotient and remainder 0.

    The spectrum has at most 6,000 rows, so its total and ranking fit one task whatever the cloud's size. Whole
    numbers throughout: a limit that check_size passes keeps the products below 2**63."""
    limit = check_limit(max_points)
    spectrum = spectrum.select("bin", F.col("true_count").cast("long").alias("true_count"))
    total = spectrum.agg(F.sum("true_count").alias("total"))
    rows = spectrum.crossJoin(F.broadcast(total))  # one row
    cut = F.col("total") > F.lit(limit)
    too_large = F.raise_error(F.lit("the preview would be above the format's 32-bit size limit")).cast("long")
    share = too_large if limit > MOST_STORED else F.lit(limit).cast("long")
    product = F.col("true_count") * share
    remainder = product % F.col("total")
    rows = rows.withColumn("remainder", F.when(cut, remainder).otherwise(F.lit(0)).cast("long"))
    quotient = F.call_function("div", product, F.col("total"))
    rows = rows.withColumn("quotient", F.when(cut, quotient).otherwise(F.lit(0)).cast("long"))
    whole = Window.partitionBy("total")
    left = F.lit(limit) - F.sum("quotient").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("remainder"), F.asc("bin")))
    take = F.when(cut, F.col("quotient") + (rank <= left).cast("long")).otherwise(F.col("true_count"))
    return rows.select("bin", "true_count", "quotient", "remainder", take.cast("long").alias("take"))


def allocate_counts(counts: dict[int, int], max_points: int) -> dict[int, int]:
    """The same for a spectrum that is on the driver already: takes by bin."""
    total = sum(counts.values())
    if total <= max_points:
        return dict(counts)
    shares = {b: divmod(c * max_points, total) for b, c in counts.items()}
    left = max_points - sum(q for q, _ in shares.values())
    favoured = set(sorted(shares, key=lambda b: (-shares[b][1], b))[:left])
    return {b: q + (b in favoured) for b, (q, _) in shares.items()}


def rank_in_bin(cloud: DataFrame, part: int = RANK_PART) -> DataFrame:
    """cloud with bin and rank, the number of points of its bin that come before it.

    A bin may hold most points, so it isn't ranked in one task: ranks are counted within parts of consecutive
    point_index and shifted by the bin's counts in the parts before."""
    parts = binned(cloud).withColumn("__part", F.floor(F.col("point_index") / part))
    before = Window.partitionBy("bin").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("bin", "__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("bin", "__part").orderBy("point_index")) - 1
    out = parts.withColumn("__own", own).join(shift, ["bin", "__part"])
    return out.select(*cloud.columns, "bin", (F.col("__own") + F.col("__before")).cast("long").alias("rank"))


def with_offsets(allocation: DataFrame) -> DataFrame:
    """allocation with start, the bin's first place in the order of the input by bin, and offset, that in the output."""
    before = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(n) for c, n in (("true_count", "start"), ("take", "offset"))]
    return allocation.select("*", *sums)


def pick(cloud: DataFrame, allocation: DataFrame) -> DataFrame:
    """The points that an allocation (bin, true_count, take) picks: cloud's columns with bin, rank, k and record_index.

    Take points of each bin, at the midpoints of take equal stretches of its ranks. A point's rank tells on its own
    whether it is picked; the allocation, at most 6,000 rows, is broadcast, and no points are joined."""
    table = with_offsets(allocation).where("take > 0").select("bin", "true_count", "take", "offset")
    rows = rank_in_bin(cloud).join(F.broadcast(table), "bin")
    rows = rows.withColumn("k", pick_number(F.col("rank"), F.col("true_count"), F.col("take"))).where("k IS NOT NULL")
    return rows.select(*cloud.columns, "bin", "rank", "k", (F.col("offset") + F.col("k")).alias("record_index"))


def midpoints(allocation: DataFrame) -> DataFrame:
    """(bin, k, rank) that an allocation asks for, without a cloud."""
    rows = allocation.where("take > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
    return rows.select("bin", "k", midpoint(F.col("k"), F.col("true_count"), F.col("take")).alias("rank"))


def pick_by_spectrum(cloud: DataFrame, spectrum: DataFrame) -> DataFrame:
    """The unquantized points behind a stored spectrum (bin, true_count, stored_count), in record order by
    record_index. Raises ValueError if it keeps more than there is, or isn't this cloud's spectrum, bin by bin."""
    from .spectrum import histogram

    kept = spectrum.select("bin", "true_count", F.col("stored_count").alias("take"))
    if kept.where("take > true_count").limit(1).count():
        raise ValueError("the retained spectrum exceeds the original one")
    own = histogram(cloud).withColumnRenamed("true_count", "own")
    if kept.where("true_count > 0").join(own, "bin", "full").where("coalesce(own, 0) != coalesce(true_count, 0)").limit(1).count():
        raise ValueError("the spectrum's counts do not match the cloud's")
    return pick(cloud, kept)


def uniform_sample(cloud: DataFrame, max_points: int, n: int | None = None) -> DataFrame:
    """max_points points (or all) evenly spaced over point_index 0..n-1, with sample_index. No shuffle: each point
    tells from its index whether it is picked."""
    check_limit(max_points)
    n = cloud.count() if n is None else n
    take = F.lit(min(n, max_points)).cast("long")
    k = pick_number(F.col("point_index"), F.lit(n).cast("long"), take)
    return cloud.withColumn("sample_index", k).where("sample_index IS NOT NULL")
