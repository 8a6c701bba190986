"""A preview beside the points behind it: two files in the same order, merged where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..sources import files
from ..sources.pos import BATCH, POINT_BYTES, SPLIT, decode_points
from ..sources.preview import box_of, inspect_file, read_records, read_spectra
from ..sources.ranges import Range, Ranges, blocks


def paired(spark: SparkSession, points: str, preview: str, split: int = SPLIT) -> DataFrame:
    """record_index, bin, x, y, z, mass and dx, dy, dz, dmass: the points of a point file or a folder of them, in record order,
    each beside what the preview restores of it.

    Both are cut at the same numbers of records, so a task reads one range of each, and nothing is shuffled, whatever their
    size. Raises ValueError if they don't hold equally many. The preview's CRC isn't taken; listing.check_payloads does."""
    header = inspect_file(preview, False)
    read_spectra(preview, header)
    ranges = Ranges(files.listed(points, ".pos"), POINT_BYTES, split)
    if any(s % POINT_BYTES for s in ranges.sizes) or ranges.records != header.stored_point_count:
        raise ValueError(f"{points} doesn't hold the {header.stored_point_count} points behind {preview}")
    box = box_of(header)
    ends = np.cumsum(np.frombuffer(files.read_range(preview, C.STORED_COUNTS_OFFSET, 4 * C.SPECTRUM_BINS), "<u4").astype(np.int64))

    def task(r: Range) -> Iterator[pa.RecordBatch]:
        for at, data in blocks(r, BATCH):
            own = decode_points(data, r.first + at // POINT_BYTES)
            restored = pa.Table.from_batches(read_records(preview, r.first + at // POINT_BYTES, len(own), ends, box)).combine_chunks().to_batches()[0]
            columns = [restored.column("record_index"), restored.column("bin"), *own.columns[1:], *[restored.column(c) for c in ("x", "y", "z", "mass")]]
            yield pa.RecordBatch.from_arrays(columns, names=["record_index", "bin", "x", "y", "z", "mass", "dx", "dy", "dz", "dmass"])

    fields = ", ".join(f"{c} float" for c in ("x", "y", "z", "mass", "dx", "dy", "dz", "dmass"))
    return ranges.read(spark, task, f"record_index long, bin int, {fields}")
