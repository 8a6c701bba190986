"""Encode clouds as previews and read them back."""

from __future__ import annotations

import datetime
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from . import constants as C
from .functions.arrays import mass_bins
from .operators.in_order import Plan, PointFiles, pick_ordered, plan, summary_of
from .operators.many import encode_each, records_each
from .operators.ordering import global_index
from .operators.pairs import paired
from .operators.quantization import quantize_points
from .operators.sample import check_limit, pick
from .operators.spectrum import Summary, as_cloud, summarize
from .scratch import materialize
from .sources import files, listing, register
from .sources.pos import POINT_BYTES, SCHEMA, decode_points, encode_points
from .sources.preview import Header, inspect_file, parse_header


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    """The cloud of a point file or a folder of them."""
    register(spark)
    return spark.read.format("pos").load(path)


def write_pos(points: DataFrame, path: str, order: str = "point_index") -> None:
    """Points of x, y, z, mass in the given order: one file where path ends in .pos, put together on the driver, else a new
    folder of ordered parts for clouds of any size. Folders above are made."""
    register(points.sparkSession)
    rows = points.select(F.col(order).cast("long").alias("point_index"), *[F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "mass")])
    rows.orderBy("point_index").write.format("pos").mode("append").save(path)


def sample_pos(spark: SparkSession, path: str, max_points: int = C.DEFAULT_MAX_POINTS) -> DataFrame:
    """sample_index, point_index, x, y, z, mass of max_points points, or all, evenly spaced over a point file or a folder of
    them. Only those points are read, and nothing is counted."""
    return PointFiles(spark, path).sample(max_points)


def pick_pos(spark: SparkSession, path: str, max_points: int = C.DEFAULT_MAX_POINTS) -> DataFrame:
    """The points of a point file, or a folder of them, that a preview of max_points holds: point_index, x, y, z, mass, bin,
    rank, k, record_index. The files are read twice by ranges, and only picked points leave the tasks that read them."""
    points = PointFiles(spark, path)
    spectra = materialize(points.spectra(), "spectra")
    return points.pick(spectra, plan(summary_of(spectra), max_points))


def rank_pos(spark: SparkSession, path: str) -> DataFrame:
    """All points of a point file, or a folder of them, with bin and rank, the number of points of the bin before, counted
    where the files are read."""
    points = PointFiles(spark, path)
    return points.rank(materialize(points.spectra(), "spectra"))


def encode(cloud: DataFrame, path: str, max_points: int = C.DEFAULT_MAX_POINTS) -> None:
    """Write a cloud's preview: two jobs, one that gathers bounds and spectrum, and one that picks, quantizes and
    writes the records in order.

    The cloud is read twice; persist it or write it as Parquet first where reading is dear. For point files encode_pos does
    without a shuffle of points."""
    cloud = as_cloud(cloud)
    limit, found = check_limit(max_points), summarize(cloud)
    by = plan(found, limit)
    allocation = cloud.sparkSession.createDataFrame([(b, c, int(by.take[b])) for b, c in sorted(found.counts.items())], "bin int, true_count long, take long")
    _write_preview(pick(cloud, allocation), found, by, path, limit)


def encode_pos(spark: SparkSession, source: str, path: str, max_points: int = C.DEFAULT_MAX_POINTS) -> None:
    """Write the preview of a point file or a folder of them. Of the points only the picked ones are shuffled, into record
    order."""
    points = PointFiles(spark, source)
    spectra = materialize(points.spectra(), "spectra")
    found = summary_of(spectra)
    by = plan(found, max_points)
    _write_preview(points.pick(spectra, by), found, by, path, check_limit(max_points))


def encode_ordered(points: DataFrame, order: list[str], path: str, max_points: int = C.DEFAULT_MAX_POINTS) -> None:
    """Write the preview of a table of x, y, z, mass whose order is that of other columns, which must tell rows apart for the
    same bytes each time. Rows are sorted once by ranges and written; they are ranked and picked where that is read."""
    fields = ["x", "y", "z", "mass"]
    rows = points.select(*[c for c in order if c not in fields], *[F.col(c).cast("float").alias(c) for c in fields])
    picked, found, by = pick_ordered(global_index(rows, order, fields, piece="piece"), max_points)
    _write_preview(picked, found, by, path, check_limit(max_points))


def _write_preview(picked: DataFrame, found: Summary, by: Plan, path: str, limit: int) -> None:
    spark = picked.sparkSession
    register(spark)
    records = quantize_points(picked, found.box(spark)).select("record_index", "qx", "qy", "qz", "qm")
    spectra = np.array([by.true, by.take], "<u4")
    hexed = lambda v: ",".join(float(x).hex() for x in v)
    options = {"spectra": zlib.compress(spectra.tobytes()).hex(), "n": found.n, "low": hexed(found.low), "high": hexed(found.high), "max_points": limit}
    records.orderBy("record_index").write.format("preview").options(**options).mode("append").save(path)


def decode(spark: SparkSession, path: str, verify_checksum: bool | str = True, bins: tuple[int, int] | None = None, records: tuple[int, int] | None = None) -> DataFrame:
    """(record_index, x, y, z, mass, bin) of a preview's points, or of those of all previews in a folder. With bins or
    records, the first and the last wanted, only those are read, beside the CRC, which asks for whole files.

    The CRC of each file is taken by one task beside those that read, so a query that stops early may end before it. With
    verify_checksum="first" it is taken here, in splits by many tasks, before any row is read."""
    return _section(spark, path, "points", verify_checksum, bins, records)


def records(spark: SparkSession, path: str, verify_checksum: bool | str = True, bins: tuple[int, int] | None = None, records: tuple[int, int] | None = None) -> DataFrame:
    """The same with qx, qy, qz, qm as stored."""
    return _section(spark, path, "records", verify_checksum, bins, records)


def bins_of(first: float, last: float) -> tuple[int, int]:
    """The bins that points with restored masses from first to last may lie in: a restored mass may be in the bin beside its
    own."""
    low, high = (int(mass_bins(np.array([m]))[0]) for m in (first, last))
    return max(0, low - 1), min(C.SPECTRUM_BINS - 1, high + 1)


def preview_catalog(spark: SparkSession, path: str) -> DataFrame:
    """What to publish beside each preview below a folder: path, problem, original_size_bytes (as a point file), preview_size_bytes,
    original_point_count, stored_point_count, compression_ratio, sha256, md5. Headers and digests are read by tasks."""
    listed = materialize(listing.list_files(spark, path), "listed")
    heads = listing.read_headers(listed)
    digests_of = listing.digest_files(listed).select(F.col("path").alias("__of"), "sha256", "md5")
    rows = heads.join(digests_of, F.col("path") == F.col("__of"))
    original = F.col("original_point_count") * POINT_BYTES
    ratio = F.round(original / F.col("length"), 3).alias("compression_ratio")
    return rows.select("path", "problem", original.alias("original_size_bytes"), F.col("length").alias("preview_size_bytes"), "original_point_count", "stored_point_count", ratio, "sha256", "md5")


def spectrum_counts(spark: SparkSession, path: str) -> DataFrame:
    """(bin, true_count, stored_count) of all bins."""
    return _section(spark, path, "spectrum", True)


def headers(spark: SparkSession, path: str, verify_checksum: bool = True) -> DataFrame:
    """A row for each preview in a folder."""
    return _section(spark, path, "header", verify_checksum)


def scan_previews(spark: SparkSession, path: str, bins: tuple[int, int] | None = None, verify_checksum: bool = True, section: str = "points") -> DataFrame:
    """path, record_index, x, y, z, mass (or qx, qy, qz, qm), bin of all previews below a folder, of the bins from the first
    to the last wanted: for very many or very large files. Tasks read headers and check CRCs by splits before any record
    is read."""
    return listing.scan(spark, path, bins, verify_checksum, section)


def checked_previews(spark: SparkSession, path: str) -> DataFrame:
    """path, length, problem, counts, corners and CRC-32 of all previews below a folder, each wholly checked by many tasks."""
    return listing.checked(spark, path)


def inspect(path: str, verify_checksum: bool = True) -> Header:
    return inspect_file(path, verify_checksum)


def inspect_json(path: str) -> str:
    return json.dumps(inspect(path).to_dict(), indent=2)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256, md5) of each file, read by tasks of their own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "length", "sha256", "md5"), (p, *files.digests(p)), strict=True)) for p in names]) if names else pa.RecordBatch.from_pydict({"path": pa.array([], pa.string()), "length": pa.array([], pa.int64()), "sha256": pa.array([], pa.string()), "md5": pa.array([], pa.string())})

    rows = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    return rows.repartition(len(paths), "path").mapInArrow(task, "path string, length long, sha256 string, md5 string")


def points_of(clouds: DataFrame, data: str = "data") -> DataFrame:
    """The points of small clouds that stand as bytes in a column: all other columns, then point_index, x, y, z, mass.

    Null and empty bytes are no points; bytes that aren't whole points are an error."""
    keys = [c for c in clouds.columns if c != data]
    schema = StructType([*[clouds.schema[c] for c in keys], *StructType.fromDDL(SCHEMA).fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(batch.column(data).to_pylist()):
                if len(own or b"") % POINT_BYTES:
                    raise ValueError("bytes that aren't four 32-bit floats a point")
                points = decode_points(own or b"")
                at = pa.array([i] * len(points), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *points.columns], names=[*keys, *points.schema.names])

    return clouds.select(*keys, data).mapInArrow(task, schema)


def bytes_of(points: DataFrame, keys: list[str], order: str = "point_index") -> DataFrame:
    """One row for each small cloud, as the keys tell them apart, with its points as bytes in column data, in the given
    order. A cloud is one value, so it must be far below 2 GB; write_pos is for larger ones."""
    rows = points.select(*keys, F.col(order).cast("long").alias("__order"), *[F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "mass")])
    schema = StructType([*[rows.schema[k] for k in keys], StructField("data", BinaryType())])

    def pack(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("__order").combine_chunks()
        return pa.table([*[ordered.column(k).slice(0, 1) for k in keys], pa.array([encode_points(ordered)], pa.binary())], names=[*keys, "data"])

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def check_headers(previews: DataFrame, head: str = "head", length: str = "length") -> DataFrame:
    """All columns of a table of previews, and problem: what reading one would say of its header, null for a sound one.

    Column head holds a preview's first 128 bytes or more, column length its whole size in bytes. Null is a file without
    bytes. For many files at once, as a listing has them, where one bad file shouldn't fail the query; a column named
    problem is replaced."""
    rows = previews.drop("problem")
    schema = StructType([*rows.schema.fields, StructField("problem", StringType())])

    def said(data: bytes | None, size: int | None) -> str | None:
        try:
            parse_header(data or b"", size or 0)
        except ValueError as e:
            return str(e)
        return None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems = [said(*v) for v in zip(batch.column(head).to_pylist(), batch.column(length).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(problems, pa.string())], names=[*batch.schema.names, "problem"])

    return rows.mapInArrow(task, schema)


def sidecar(spark: SparkSession, source: str, preview: str, **more: str) -> dict:
    """What to publish beside a preview: sizes, counts, ratio, versions and SHA-256, and whatever more says. Each file is
    read by a task, by the megabyte."""
    header = inspect(preview, False)
    found = {r["path"]: r for r in digests(spark, [source, preview]).collect()}
    original, packed = found[source], found[preview]
    return more | {
        "source_file": source.rsplit("/", 1)[-1],
        "generated_at": datetime.datetime.now(datetime.UTC).isoformat(),
        "original_size_bytes": original["length"],
        "preview_size_bytes": packed["length"],
        "original_point_count": header.original_point_count,
        "stored_point_count": header.stored_point_count,
        "compression_ratio": round(original["length"] / packed["length"], 3),
        "container_version": header.to_dict()["container_version"],
        "algorithm_version": header.to_dict()["algorithm_version"],
        "sha256": packed["sha256"],
    }


def _section(spark: SparkSession, path: str, section: str, verify: bool | str, bins: tuple[int, int] | None = None, records: tuple[int, int] | None = None) -> DataFrame:
    register(spark)
    if verify == "first":
        listing.raise_first(listing.checked(spark, path, "*"))
        verify = False
    spans = {k: f"{v[0]}:{v[1]}" for k, v in (("bins", bins), ("records", records)) if v}
    return spark.read.format("preview").options(section=section, verify_checksum=str(verify).lower(), **spans).load(path)


__all__ = [n for n, v in globals().items() if callable(v) and getattr(v, "__module__", None) == __name__ and not n.startswith("_")] + ["encode_each", "paired", "records_each"]
