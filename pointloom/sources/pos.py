"""Headerless point files: records of four big-endian 32-bit floats, x, y, z, mass."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import files

POINT_BYTES = 16
SCHEMA = "point_index long, x float, y float, z float, mass float"
ARROW = pa.schema([("point_index", pa.int64()), *((c, pa.float32()) for c in ("x", "y", "z", "mass"))])
#: Bytes of a read partition, and of one Arrow batch.
SPLIT, BATCH = 32 << 20, 4 << 20


def decode_points(data: bytes, first: int = 0) -> pa.RecordBatch:
    """The points of whole records, numbered from first."""
    fields = np.frombuffer(data, ">f4").reshape(-1, 4).astype(np.float32)
    index = np.arange(first, first + len(fields), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(fields[:, i]) for i in range(4)]], schema=ARROW)


def encode_points(batch: pa.RecordBatch) -> bytes:
    """Records of a batch's x, y, z, mass."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "mass")]).astype(">f4").tobytes()


@dataclass
class Range(InputPartition):
    path: str
    offset: int
    size: int
    first: int


class PosReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.check = options["path"], options.get("validate", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        out, first = [], 0
        for path, size in files.listed(self.path, ".pos"):
            if size == 0 or size % POINT_BYTES:
                raise ValueError(f"{path} is not a non-empty file of four 32-bit floats a point")
            out += [Range(path, at, min(SPLIT, size - at), first + at // POINT_BYTES) for at in range(0, size, SPLIT)]
            first += size // POINT_BYTES
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.size, BATCH):
            batch = decode_points(files.read_range(part.path, part.offset + at, min(BATCH, part.size - at)), part.first + at // POINT_BYTES)
            if self.check and not all(np.isfinite(batch.column(c).to_numpy()).all() for c in ("x", "y", "z", "mass")):
                raise ValueError(f"{part.path} contains non-finite values")
            yield batch


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class PosWriter(DataSourceArrowWriter):
    """One part file for each task, in the order of partitions, so sort by range before.

    A path that ends in .pos becomes one file, which the driver puts together from the parts by the megabyte. Any other
    is a folder, where the parts stay and are only renamed: the form for clouds of any size. Readers number them through."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.one_file = self.path.lower().endswith(".pos")
        if self.one_file:
            files.make_parent(self.path)
        elif files.make_folder(self.path):
            raise ValueError(f"{self.path} has files already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        # attempts of a task write to names of their own
        start = f"{self.path}." if self.one_file else f"{self.path}/_"  # readers leave out what starts so
        part = Part(context.partitionId(), f"{start}{self.job}.{context.partitionId()}.{context.taskAttemptId()}")
        store, inner = files.opened(part.path)
        with store.open_output_stream(inner) as out:
            for batch in batches:
                out.write(encode_points(batch))
        return part

    def commit(self, parts: list[Part | None]) -> None:
        paths = [p.path for p in sorted((p for p in parts if p), key=lambda p: p.number)]
        if self.one_file:
            files.join_parts(paths, self.path)
        else:
            files.name_parts(paths, self.path, ".pos")

    def abort(self, parts: list[Part | None]) -> None:
        files.remove([p.path for p in parts if p])


class PosDataSource(DataSource):
    """spark.read.format("pos").load(path) of a file or folder; points are numbered through in the order of names.

    df.write.format("pos").mode("append").save(path) writes one file if path ends in .pos, else a new folder of ordered
    parts. Options: validate (true) rejects values that
    aren't finite."""

    @classmethod
    def name(cls) -> str:
        return "pos"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PosReader:
        return PosReader(self.options)

    def writer(self, schema, overwrite: bool) -> PosWriter:
        return PosWriter(self.options)
