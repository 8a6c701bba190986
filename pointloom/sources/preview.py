"""Preview files: a 128-byte header, two spectra of 6,000 32-bit counts, and records of four 16-bit numbers."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import constants as C
from . import checksum, files

# Fixed value: magic, 2 + 3 version numbers and header size, endian marker, flags, both point counts and bins, spectrum
# minimum, bin width and maximum, both corners of the bounds, three offsets, file size, CRC-32, point limit.
_LAYOUT = struct.Struct("<4s6H5I3f6f6I")

SPLIT, BATCH = 16 << 20, 1 << 19  # bytes of records, both multiples of a record

SCHEMAS = {
    "header": "container_version array<int>, algorithm_version array<int>, header_size int, flags long, original_point_count long, stored_point_count long, spectrum_bin_count int, spectrum_min_da float, spectrum_bin_da float, spectrum_max_da float, bounds array<array<float>>, true_counts_offset long, stored_counts_offset long, records_offset long, file_size long, payload_crc32 long, max_points long",
    "spectrum": "bin int, true_count long, stored_count long",
    "records": "record_index long, qx int, qy int, qz int, qm int, bin int",
    "points": "record_index long, x float, y float, z float, mass float, bin int",
}


# The names of the fields, which are the keys of the format's JSON.
@dataclass(frozen=True)
class Header:
    container_version: tuple[int, int]
    algorithm_version: tuple[int, int, int]
    header_size: int
    flags: int
    original_point_count: int
    stored_point_count: int
    spectrum_bin_count: int
    spectrum_min_da: float
    spectrum_bin_da: float
    spectrum_max_da: float
    bounds: tuple[tuple[float, float, float], tuple[float, float, float]]
    true_counts_offset: int
    stored_counts_offset: int
    records_offset: int
    file_size: int
    payload_crc32: int
    max_points: int

    def to_dict(self) -> dict:
        """As JSON shows it: versions with dots, the CRC as eight hexadecimal digits."""
        dotted = {k: ".".join(map(str, getattr(self, k))) for k in ("container_version", "algorithm_version")}
        return asdict(self) | dotted | {"payload_crc32": f"{self.payload_crc32:08x}"}


def pack_header(n: int, stored: int, low: tuple, high: tuple, crc: int, max_points: int) -> bytes:
    size = C.RECORDS_OFFSET + C.RECORD_SIZE * stored
    fields = [C.MAGIC, *C.CONTAINER_VERSION, *C.ALGORITHM_VERSION, C.HEADER_SIZE, C.ENDIAN_MARKER, C.FLAGS, n, stored, C.SPECTRUM_BINS]
    fields += [C.SPECTRUM_MIN_DA, C.SPECTRUM_BIN_DA, C.SPECTRUM_MAX_DA, *low, *high, C.TRUE_COUNTS_OFFSET, C.STORED_COUNTS_OFFSET, C.RECORDS_OFFSET, size, crc, max_points]
    return _LAYOUT.pack(*fields).ljust(C.HEADER_SIZE, b"\0")


def parse_header(data: bytes, size: int) -> Header:
    """Read a header and check all but the CRC, in the format's order. size is the file's."""
    if len(data) < C.HEADER_SIZE:
        raise ValueError("truncated preview header")
    f = _LAYOUT.unpack_from(data)
    container, algorithm, (header_size, endian, flags, original, stored, bins) = f[1:3], f[3:6], f[6:12]
    spectrum, low, high, offsets, (file_size, crc, most) = f[12:15], f[15:18], f[18:21], f[21:24], f[24:27]
    if f[0] != C.MAGIC:
        raise ValueError("not a preview file")
    if container != C.CONTAINER_VERSION:
        raise C.FormatVersionError("unsupported container version {}.{}".format(*container))
    if algorithm != C.ALGORITHM_VERSION:
        raise C.FormatVersionError("unsupported codec version {}.{}.{}".format(*algorithm))
    expected = (C.TRUE_COUNTS_OFFSET, C.STORED_COUNTS_OFFSET, C.RECORDS_OFFSET)
    for wrong, message in (
        (header_size != C.HEADER_SIZE, f"unsupported header size {header_size}"),
        (endian != C.ENDIAN_MARKER, "invalid endian marker"),
        (flags != C.FLAGS, f"unsupported flags 0x{flags:08x}"),
        (original == 0 or stored == 0, "point counts must be non-zero"),
        (stored > min(original, most), "invalid retained point count"),
        (bins != C.SPECTRUM_BINS, f"unsupported spectrum size {bins}"),
        (offsets != expected or file_size != size or size != C.RECORDS_OFFSET + C.RECORD_SIZE * stored, "invalid section offsets or file size"),
    ):
        if wrong:
            raise ValueError(message)
    return Header(container, algorithm, header_size, flags, original, stored, bins, *spectrum, (low, high), *offsets, file_size, crc, most)


def inspect_file(path: str, verify: bool = True) -> Header:
    """A file's checked header. The CRC is taken over the rest of the file by the megabyte."""
    store, inner = files.opened(path)
    size = store.get_file_info(inner).size or 0
    with store.open_input_file(inner) as f:
        header = parse_header(f.read(C.HEADER_SIZE), size)
        crc = 0
        while verify and (block := f.read(1 << 20)):
            crc = zlib.crc32(block, crc)
    if verify and crc != header.payload_crc32:
        raise ValueError(f"checksum mismatch: expected {header.payload_crc32:08x}, got {crc:08x}")
    return header


def parse_spectra(data: bytes, header: Header) -> tuple[np.ndarray, np.ndarray]:
    """Both spectra of their bytes, checked against the header and each other."""
    true, stored = np.frombuffer(data, "<u4", 2 * C.SPECTRUM_BINS).astype(np.int64).reshape(2, -1)
    if true.sum() != header.original_point_count:
        raise ValueError("original spectrum counts do not match the header")
    if stored.sum() != header.stored_point_count:
        raise ValueError("retained spectrum counts do not match the header")
    if (stored > true).any():
        raise ValueError("the retained spectrum exceeds the original one")
    return true, stored


def read_spectra(path: str, header: Header) -> tuple[np.ndarray, np.ndarray]:
    return parse_spectra(files.read_range(path, C.TRUE_COUNTS_OFFSET, 8 * C.SPECTRUM_BINS), header)


def decode_records(data: bytes, first: int, ends: np.ndarray, box: tuple | None) -> pa.RecordBatch:
    """Whole records, numbered from first, with the bin of each, of which records end at ends. With box, the low and high
    corners of x, y, z, mass, restored points; else the stored numbers."""
    values = np.frombuffer(data, "<u2").reshape(-1, 4)
    index = np.arange(first, first + len(values), dtype=np.int64)
    bins = pa.array(np.searchsorted(ends, index, "right").astype(np.int32))
    if box is None:
        return pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(values[:, i].astype(np.int32)) for i in range(4)], bins], names=["record_index", "qx", "qy", "qz", "qm", "bin"])
    low, high = (np.array(x, np.float64) for x in box)
    points = (low + values / C.STEPS * (high - low)).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(points[:, i]) for i in range(4)], bins], names=["record_index", "x", "y", "z", "mass", "bin"])


def box_of(header: Header) -> tuple[tuple, tuple]:
    """The corners between which a header's records were quantized."""
    return (*header.bounds[0], header.spectrum_min_da), (*header.bounds[1], header.spectrum_max_da)


def stored_ends(path: str) -> np.ndarray:
    """Where the records of each bin end."""
    return np.cumsum(np.frombuffer(files.read_range(path, C.STORED_COUNTS_OFFSET, 4 * C.SPECTRUM_BINS), "<u4").astype(np.int64))


def read_records(path: str, first: int, count: int, ends: np.ndarray, box: tuple | None) -> Iterator[pa.RecordBatch]:
    step = BATCH // C.RECORD_SIZE
    for at in range(first, first + count, step):
        n = min(step, first + count - at)
        yield decode_records(files.read_range(path, C.RECORDS_OFFSET + C.RECORD_SIZE * at, C.RECORD_SIZE * n), at, ends, box)


@dataclass
class Range(InputPartition):
    path: str
    header: Header
    first: int
    count: int


@dataclass
class Check(InputPartition):
    """A partition without rows, whose task fails, and so the job, if a file's CRC isn't its header's."""

    path: str


class PreviewReader(DataSourceReader):
    """Headers and spectra, 48 KB of a file, are checked where partitions are planned, some files at once; the first by name that
    is wrong is told. Tasks read ranges of records, and
    one task for each file takes its CRC; a query fails with it.

    Records lie by bin, so the sums of the stored spectrum turn the options bins and records, each the first and the last
    wanted as in 0:2399, into one range of records; nothing else is read. (Options, not pushed filters: Spark 4.1 keeps what
    a filter did to a reader for later queries of the same DataFrame, which then lack rows.)"""

    def __init__(self, section: str, options: dict):
        self.section, self.path = section, options["path"]
        self.verify = options.get("verify_checksum", "true").lower() == "true"
        self.bins, self.records = (_pair(options.get(k), most) for k, most in (("bins", C.SPECTRUM_BINS - 1), ("records", C.UINT32_MAX)))

    def _span(self, stored: np.ndarray) -> tuple[int, int]:
        """The first of the wanted records, and the one after the last."""
        ends = np.concatenate([[0], np.cumsum(stored)])
        if self.bins[0] > self.bins[1]:
            return 0, 0
        low, high = max(int(ends[self.bins[0]]), self.records[0]), min(int(ends[self.bins[1] + 1]), self.records[1] + 1)
        return low, max(low, high)

    def _plan(self, path: str) -> list[Range]:
        header = inspect_file(path, False)
        first, last, step = 0, header.stored_point_count, header.stored_point_count
        if self.section != "header":
            _, stored = read_spectra(path, header)
        if self.section in ("records", "points"):
            (first, last), step = self._span(stored), SPLIT // C.RECORD_SIZE
        ranges = [Range(path, header, at, min(step, last - at)) for at in range(first, last, step)]
        return ranges + ([Check(path)] if self.verify else [])

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(16) as pool:  # results come, and errors are raised, in the order of names
            out = [r for ranges in pool.map(self._plan, [path for path, _ in files.listed(self.path)]) for r in ranges]
        return out or [Range("", None, 0, 0)]

    def read(self, part: Range | Check) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Check):
            inspect_file(part.path)
            return
        h = part.header
        if h is None:
            return
        if self.section == "header":
            yield tuple(list(map(list, v)) if k == "bounds" else list(v) if isinstance(v, tuple) else v for k, v in vars(h).items())
        elif self.section == "spectrum":
            true, stored = read_spectra(part.path, h)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(true), dtype=np.int32)), pa.array(true), pa.array(stored)], names=["bin", "true_count", "stored_count"])
        else:
            yield from read_records(part.path, part.first, part.count, stored_ends(part.path), box_of(h) if self.section == "points" else None)


def _pair(text: str | None, most: int) -> tuple[int, int]:
    """First and last of an option, within 0..most; all without it."""
    first, last = (int(x) for x in text.split(":")) if text else (0, most)
    return max(0, first), min(most, last)


@dataclass
class Written(WriterCommitMessage):
    first: int
    count: int
    crc: int
    path: str
    ends: tuple[bytes, bytes] = (b"", b"")  # some of its first and last bytes


class PreviewWriter(DataSourceArrowWriter):
    """Each record's place in the file follows from its record_index, so on a file system that writes at an offset tasks write
    their records where they belong, in a file beside the target; commit writes the 48 KB before them, looks whether each
    task's first and last bytes are there, as they aren't on machines with disks of their own, and renames it. On other
    stores tasks write part files, which commit puts together. Either way the CRC is joined from those of the tasks, and no
    record is read again. A task's records follow each other, as after a sort by record_index.

    What the file needs besides records comes as options: spectra (hexadecimal, both tables), n, low, high, max_points."""

    def __init__(self, options: dict):
        self.path, self.job, self.options = options["path"], uuid.uuid4().hex, dict(options)
        files.make_parent(self.path)
        store, inner = files.opened(self.path)
        self.target = f"{os.path.dirname(inner)}/.{os.path.basename(inner)}.{self.job}" if isinstance(store, fs.LocalFileSystem) else None

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        part, out = Written(-1, 0, 0, ""), None
        try:
            for batch in batches:
                if not len(batch):
                    continue
                index = batch.column("record_index").to_numpy()
                part.first = int(index[0]) if part.first < 0 else part.first
                if int(index[0]) != part.first + part.count or (np.diff(index) != 1).any():
                    raise ValueError("the records of a task don't follow each other")
                data = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("qx", "qy", "qz", "qm")]).astype("<u2").tobytes()
                if self.target and out is None:
                    out = os.fdopen(os.open(self.target, os.O_CREAT | os.O_WRONLY, 0o644), "wb")
                    out.seek(C.RECORDS_OFFSET + C.RECORD_SIZE * part.first)
                elif out is None:
                    part.path = f"{self.path}.{self.job}.{context.partitionId()}.{context.taskAttemptId()}"
                    store, inner = files.opened(part.path)
                    out = store.open_output_stream(inner)
                out.write(data)
                part.ends = (part.ends[0] or data[:64], data[-64:])
                part.crc, part.count = zlib.crc32(data, part.crc), part.count + len(index)
        finally:
            if out:
                out.close()
        return part

    def commit(self, parts: list[Written | None]) -> None:
        parts = sorted((p for p in parts if p and p.count), key=lambda p: p.first)
        stored = sum(p.count for p in parts)
        if any(p.first != before for p, before in zip(parts, np.cumsum([0, *(p.count for p in parts)]).tolist(), strict=False)):
            raise ValueError("records are missing or come twice")
        spectra = zlib.decompress(bytes.fromhex(self.options["spectra"]))
        crc, _ = checksum.joined([(zlib.crc32(spectra), len(spectra)), *((p.crc, C.RECORD_SIZE * p.count) for p in parts)])
        low, high = (tuple(float.fromhex(x) for x in self.options[k].split(",")) for k in ("low", "high"))
        head = pack_header(int(self.options["n"]), stored, low, high, crc, int(self.options["max_points"])) + spectra
        if not self.target:
            files.join_parts([p.path for p in parts], self.path, head)
            return
        with os.fdopen(os.open(self.target, os.O_CREAT | os.O_RDWR, 0o644), "r+b") as out:
            out.write(head)
            for part in parts:
                begin = C.RECORDS_OFFSET + C.RECORD_SIZE * part.first
                for own, at in ((part.ends[0], begin), (part.ends[1], begin + C.RECORD_SIZE * part.count - len(part.ends[1]))):
                    out.seek(at)
                    if out.read(len(own)) != own:
                        raise ValueError(f"{self.path} must be in a folder that driver and executors share")
        os.replace(self.target, files.opened(self.path)[1])

    def abort(self, parts: list[Written | None]) -> None:
        files.remove([self.target] if self.target else [p.path for p in parts if p and p.path])


class PreviewDataSource(DataSource):
    """spark.read.format("preview").option("section", ...).load(path) of a file or a folder of files.

    Sections: header (a row for each file), spectrum, records, and points (the default), which are restored values.
    Options verify_checksum (true), bins and records (first:last wanted; all)."""

    @classmethod
    def name(cls) -> str:
        return "preview"

    @property
    def section(self) -> str:
        section = self.options.get("section", "points")
        if section not in SCHEMAS:
            raise ValueError(f"section must be one of {sorted(SCHEMAS)}")
        return section

    def schema(self) -> str:
        return SCHEMAS[self.section]

    def reader(self, schema) -> PreviewReader:
        return PreviewReader(self.section, self.options)

    def writer(self, schema, overwrite: bool) -> PreviewWriter:
        return PreviewWriter(self.options)
