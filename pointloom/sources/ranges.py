"""Byte ranges of many files as the partitions of a DataFrame: what to read is told by a range's number, so nothing but
file names and sizes is planned on the driver, and no range is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import files

#: Partitions at most; beyond, a task reads several ranges that follow each other.
MOST_PARTITIONS = 20_000


@dataclass(frozen=True)
class Range:
    path: str
    offset: int
    size: int
    first: int  # number of the first record in all files
    number: int


class Ranges:
    """Files of fixed-size records, cut into ranges of at most split bytes of whole records. Files follow each other."""

    def __init__(self, listed: list[tuple[str, int]], unit: int, split: int):
        self.paths, self.unit, self.split = [p for p, _ in listed], unit, split // unit * unit
        self.sizes = np.array([s for _, s in listed], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(-(-self.sizes // self.split))])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes // unit)])

    @property
    def records(self) -> int:
        return int(self.starts[-1])

    def __len__(self) -> int:
        return int(self.cuts[-1])

    def __getitem__(self, number: int) -> Range:
        i = int(np.searchsorted(self.cuts, number, "right")) - 1
        offset = (number - int(self.cuts[i])) * self.split
        return Range(self.paths[i], offset, min(self.split, int(self.sizes[i]) - offset), int(self.starts[i]) + offset // self.unit, number)

    def place(self, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """File and byte offset of records."""
        file = np.searchsorted(self.starts, record, "right") - 1
        return file, (record - self.starts[file]) * self.unit

    def read(self, spark: SparkSession, task: Callable[[Range], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What task makes of each range, in order of ranges."""
        shared = spark.sparkContext.broadcast(self)  # names and sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    yield from task(shared.value[number])

        return spark.range(0, len(self), 1, max(1, min(len(self), MOST_PARTITIONS))).mapInArrow(run, schema)


def blocks(r: Range, step: int) -> Iterator[tuple[int, bytes]]:
    """A range's bytes by at most step of them, with the number of the first record of each; step is in whole records."""
    for at in range(0, r.size, step):
        yield at, files.read_range(r.path, r.offset + at, min(step, r.size - at))
