"""A global row number without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize

#: Bits of monotonically_increasing_id below the partition's number.
_ROW_BITS = 33
#: Bits of a byte's place in a part, of which there are 2**22 at most.
_BLOCK_BITS = 40


def global_index(df: DataFrame, order: Sequence[str], keep: Sequence[str] | None = None, name: str = "point_index", piece: str | None = None) -> DataFrame:
    """df with its rows numbered from 0 in the given order, nulls first. Rows equal in all of order get numbers in any
    order among them. Where keep is given, only those columns stay, and no others are written.

    Where piece is given, a column of that name tells which block of which part a row is read from: rows of a piece stand
    together in one task in their order, and pieces are numbered in that order (see in_order.pick_pieces).

    Rows are dealt by range, sorted and numbered where they are, and written; read again, they are shifted by the sizes
    of the parts before: one shuffle, and a window over one row for each part."""
    keep = list(df.columns if keep is None else keep)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(dealt.withColumn("__id", F.monotonically_increasing_id()).select(*keep, "__id"), "ranges")
    part = F.shiftright("__id", _ROW_BITS)
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(part.alias("__part")).count()
    shift = materialize(sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("__before")), "shift")
    pieces = [(F.shiftleft(part, _BLOCK_BITS) + F.col("_metadata.file_block_start")).alias(piece)] if piece else []
    out = parts.select("*", *pieces).join(F.broadcast(shift), part == F.col("__part"))  # a row for each part
    return out.select(*keep, *([piece] if piece else []), (F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("__before")).alias(name))
