"""Previews of whole listings: headers are read by tasks over a table of files, the ranges of records that are wanted come
out as rows, and a second stage reads those. The driver opens no file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..scratch import materialize
from . import checksum, files
from .preview import SPLIT, box_of, parse_header, parse_spectra, read_records, stored_ends

#: Tasks of a stage at most; beyond, a task reads several ranges.
MOST_TASKS = 20_000
_COUNTS = ("original_point_count", "stored_point_count", "max_points", "payload_crc32", "file_size")
_HEADS = "path string, length long, problem string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", low array<double>, high array<double>, first_record long, end_record long"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("problem", pa.string()), *[(c, pa.int64()) for c in _COUNTS], ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("first_record", pa.int64()), ("end_record", pa.int64())])


def list_files(spark: SparkSession, path: str, pattern: str = "*.preview") -> DataFrame:
    """(path, length) of the files below a folder, as Spark lists them; none is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length")


def _dealt(rows: DataFrame, tasks: int, *by: str) -> DataFrame:
    return rows.repartition(max(1, min(tasks, MOST_TASKS)), *by)


def read_headers(listed: DataFrame, bins: tuple[int, int] | None = None, files_each: int = 64) -> DataFrame:
    """A row for each file of (path, length): path, length, problem (what reading it would say first, in the format's order,
    spectra included; null for a sound one), the header's counts, the corners of its points, and first_record, end_record:
    the range of records of the wanted bins (first and last), all without bins. 48 KB of a file are read."""

    def head(path: str, length: int) -> dict:
        row = {"path": path, "length": length}
        try:
            data = files.read_range(path, 0, min(C.RECORDS_OFFSET, length))
            header = parse_header(data, length)
            _, stored = parse_spectra(data[C.TRUE_COUNTS_OFFSET :], header)
        except ValueError as e:
            return row | {"problem": str(e)}
        ends = np.concatenate([[0], np.cumsum(stored)])
        first, last = (ends[0], ends[-1]) if bins is None else (ends[bins[0]], ends[bins[1] + 1])
        low, high = box_of(header)
        return row | {c: getattr(header, c) for c in _COUNTS} | {"low": low, "high": high, "first_record": int(first), "end_record": int(last)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([head(*x) for x in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)], _ARROW)

    return _dealt(listed.select("path", "length"), listed.count() // files_each + 1, "path").mapInArrow(task, _HEADS)


def _ranges(rows: DataFrame, first: Column, end: Column, step: int) -> DataFrame:
    """A row for each step of first..end, with at and count, each in a task of its own as far as MOST_TASKS go."""
    cut = rows.where(end > first).select("*", end.alias("__end"), F.explode(F.sequence(first, end - 1, F.lit(step))).alias("at"))
    cut = cut.withColumn("count", F.least(F.lit(step), F.col("__end") - F.col("at"))).drop("__end")
    total = rows.agg(F.sum(F.when(end > first, F.ceil((end - first) / step)).otherwise(0))).first()[0] or 0
    return _dealt(cut, int(total), "path", "at")


def read_listed(heads: DataFrame, section: str = "points", step: int = SPLIT // C.RECORD_SIZE) -> DataFrame:
    """The wanted records of all sound files of read_headers' table, which must be materialized: path, record_index, then
    x, y, z, mass (points) or qx, qy, qz, qm (records), and bin. Files with a problem give nothing here."""
    values = ("x", "y", "z", "mass") if section == "points" else ("qx", "qy", "qz", "qm")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                box = (r["low"], r["high"]) if section == "points" else None
                for found in read_records(r["path"], r["at"], r["count"], stored_ends(r["path"]), box):
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found)), *found.columns], names=["path", *found.schema.names])

    asked = heads.where("problem is null").select("path", "low", "high", "first_record", "end_record")
    kind = "float" if section == "points" else "int"
    schema = f"path string, record_index long, {', '.join(f'{v} {kind}' for v in values)}, bin int"
    return _ranges(asked, F.col("first_record"), F.col("end_record"), step).mapInArrow(task, schema)


def check_payloads(heads: DataFrame, step: int = SPLIT) -> DataFrame:
    """read_headers' table, which must be materialized, with computed_crc32, the CRC-32 of what stands behind each sound
    header, and problem saying so where it isn't the header's. Files are read in splits by many tasks: a split tells what it
    makes of the whole's CRC, and those are joined by exclusive or, in any order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            own = [checksum.moved(checksum.crc_of_range(r["path"], r["at"], r["count"]), r["length"] - r["at"] - r["count"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(own, pa.int64())], names=["path", "crc"])

    splits = _ranges(heads.where("problem is null").select("path", "length"), F.lit(C.HEADER_SIZE).cast("long"), F.col("length"), step)
    crcs = splits.mapInArrow(task, "path string, crc long").groupBy(F.col("path").alias("__of")).agg(F.bit_xor("crc").alias("computed_crc32"))
    rows = heads.join(crcs, F.col("path") == F.col("__of"), "left").drop("__of")
    shown = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    wrong = F.concat(F.lit("checksum mismatch: expected "), shown("payload_crc32"), F.lit(", got "), shown("computed_crc32"))
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("payload_crc32") != F.col("computed_crc32"), wrong)))


def digest_files(listed: DataFrame) -> DataFrame:
    """(path, length) with sha256 and md5 of each file, which a task reads by the megabyte."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [files.digests(p) for p in batch.column("path").to_pylist()]
            size, sha, md5 = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(md5, pa.string())], names=["path", "length", "sha256", "md5"])

    return _dealt(listed.select("path"), listed.count(), "path").mapInArrow(task, "path string, length long, sha256 string, md5 string")


def checked(spark: SparkSession, path: str, pattern: str = "*.preview", bins: tuple[int, int] | None = None) -> DataFrame:
    """read_headers' table of all previews below a folder, CRCs included."""
    return check_payloads(materialize(read_headers(list_files(spark, path, pattern), bins), "heads"))


def raise_first(heads: DataFrame) -> None:
    """Raise ValueError with the first file by path that has a problem."""
    if found := heads.where("problem is not null").orderBy("path").select("path", "problem").first():
        raise ValueError(f"{found['path']}: {found['problem']}")


def scan(spark: SparkSession, path: str, bins: tuple[int, int] | None = None, verify: bool = True, section: str = "points", pattern: str = "*.preview") -> DataFrame:
    """The points, or records, of all previews below a folder. Raises ValueError, before any record is read, with the first
    file by path that has a problem."""
    heads = checked(spark, path, pattern, bins) if verify else read_headers(list_files(spark, path, pattern), bins)
    heads = materialize(heads, "heads")
    raise_first(heads)
    return read_listed(heads, section)
