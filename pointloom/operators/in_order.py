"""Ranks and picks of clouds that are read in order, without a shuffle of points.

A cloud comes in pieces of consecutive points: byte ranges of point files, or parts of a table that was written in order.
A first pass gives each piece's spectrum. Prefix sums over pieces tell how many points of each bin come before a piece, so
in a second pass every piece ranks its own points while it is read, and only picked points leave the task. What is shuffled
is at most 6,000 rows for each piece."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import SPECTRUM_BINS, UINT32_MAX
from ..functions.arrays import mass_bins, pick_numbers, ranks_in
from ..scratch import materialize
from ..sources import files
from ..sources.pos import BATCH, POINT_BYTES, SPLIT, decode_points
from ..sources.ranges import Range, Ranges, blocks
from .sample import MOST_STORED, allocate_counts, check_limit, check_size, rank_in_bin
from .sample import pick as pick_by_shuffle
from .spectrum import AXES, FIELDS, Summary, binned

_SPECTRA = "piece long, bin int, n long, bad long, " + ", ".join(f"{a}_{k} float" for a in AXES for k in ("min", "max"))
_RANKED = "point_index long, x float, y float, z float, mass float, bin int, rank long"
_PICKED = _RANKED + ", k long, record_index long"
_POINT = ("point_index", *FIELDS)
#: Counts (of a bin before a piece) that are broadcast, 12 bytes each; with more, points are ranked by a shuffle.
MOST_COUNTS = 4_000_000


@dataclass(frozen=True)
class Plan:
    """What every task needs to pick, by bin: how many points there are, how many are taken, where records begin."""

    true: np.ndarray
    take: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, true: dict[int, int], take: dict[int, int]) -> Plan:
        counts = np.zeros((2, SPECTRUM_BINS), np.int64)
        for row, by_bin in zip(counts, (true, take), strict=True):
            row[list(by_bin)] = list(by_bin.values())
        return cls(counts[0], counts[1], np.cumsum(counts[1]) - counts[1])

    def __call__(self, batch: pa.RecordBatch, seen: np.ndarray) -> pa.RecordBatch:
        """The picked points of a batch that follows the points that are counted in seen, which is moved on."""
        bins = mass_bins(batch.column("mass").to_numpy())
        rank = ranks_in(bins, seen)
        k = pick_numbers(rank, self.true[bins], self.take[bins])
        at = np.flatnonzero(k >= 0)
        own = [pa.array(bins[at].astype(np.int32)), pa.array(rank[at]), pa.array(k[at]), pa.array(self.offset[bins[at]] + k[at])]
        kept = pa.array(at)
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(kept) for c in _POINT], *own], names=[*_POINT, "bin", "rank", "k", "record_index"])


def ranked(batch: pa.RecordBatch, seen: np.ndarray) -> pa.RecordBatch:
    """All points of such a batch with bin and rank."""
    bins = mass_bins(batch.column("mass").to_numpy())
    own = [pa.array(bins.astype(np.int32)), pa.array(ranks_in(bins, seen))]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in _POINT], *own], names=[*_POINT, "bin", "rank"])


def plan(found: Summary, max_points: int) -> Plan:
    limit = check_limit(max_points)
    check_size(min(found.n, limit, MOST_STORED + 1))
    return Plan.of(found.counts, allocate_counts(found.counts, limit))


def summary_of(spectra: DataFrame) -> Summary:
    """Count, bounds and spectrum of all pieces; at most 6,000 rows reach the driver. Raises as summarize does."""
    extremes = [f(f"{a}_{k}").alias(f"{a}_{k}") for a in AXES for k, f in (("min", F.min), ("max", F.max))]
    rows = spectra.groupBy("bin").agg(F.sum("n").alias("n"), F.min("bad").alias("bad"), *extremes).collect()
    if not rows:
        raise ValueError("an empty point cloud cannot be encoded")
    if (bad := [r["bad"] for r in rows if r["bad"] is not None]):
        raise ValueError(f"points contain non-finite values, first at point {min(bad)}")
    if (n := sum(r["n"] for r in rows)) > UINT32_MAX:
        raise ValueError("a preview holds at most 2^32 - 1 input points")
    low, high = (tuple(float(f(r[f"{a}_{k}"] for r in rows)) for a in AXES) for k, f in (("min", min), ("max", max)))
    return Summary(n, low, high, {r["bin"]: r["n"] for r in rows})


def counts_before(spectra: DataFrame) -> DataFrame:
    """(piece, bin, before): how many of a bin's points are in the pieces before, where there are any in the piece."""
    before = Window.partitionBy("bin").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return spectra.select("piece", F.col("bin").cast("int").alias("bin"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))


class PointFiles:
    """A point file, or a folder of them, read in ranges by tasks. Only names and sizes are looked at to plan."""

    def __init__(self, spark: SparkSession, path: str, split: int = SPLIT):
        found = files.listed(path, ".pos")
        for name, size in found:
            if size == 0 or size % POINT_BYTES:
                raise ValueError(f"{name} is not a non-empty file of four 32-bit floats a point")
        self.spark, self.ranges = spark, Ranges(found, POINT_BYTES, split)

    def spectra(self) -> DataFrame:
        """(piece, bin, n, bad, bounds) of each range: its spectrum, the first point that isn't finite, and bounds by bin."""

        def task(r: Range) -> Iterator[pa.RecordBatch]:
            counts, first_bad = np.zeros(SPECTRUM_BINS, np.int64), None
            low, high = np.full((3, SPECTRUM_BINS), np.inf, np.float32), np.full((3, SPECTRUM_BINS), -np.inf, np.float32)
            for at, data in blocks(r, BATCH):
                fields = np.frombuffer(data, ">f4").reshape(-1, 4).astype(np.float32)
                bad = ~np.isfinite(fields).all(axis=1)
                if bad.any() and first_bad is None:
                    first_bad = r.first + at // POINT_BYTES + int(np.argmax(bad))
                fields = fields[~bad]
                bins = mass_bins(fields[:, 3])
                counts += np.bincount(bins, minlength=SPECTRUM_BINS)
                order = np.argsort(bins, kind="stable")
                runs = np.flatnonzero(np.diff(bins[order], prepend=-1))
                for axis in range(3 if len(order) else 0):
                    values, own = fields[order, axis], bins[order][runs]
                    low[axis, own] = np.minimum(low[axis, own], np.minimum.reduceat(values, runs))
                    high[axis, own] = np.maximum(high[axis, own], np.maximum.reduceat(values, runs))
            some = np.flatnonzero(counts)
            if first_bad is not None and not len(some):
                some = np.zeros(1, np.int64)
            told = [None] * len(some)
            told[:1] = [first_bad] if len(some) else []
            sides = [pa.array(side[axis, some]) for axis in range(3) for side in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r.number)), pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(told, pa.int64()), *sides], names=[c.split()[0] for c in _SPECTRA.split(", ")])

        return self.ranges.read(self.spark, task, _SPECTRA)

    def pick(self, spectra: DataFrame, by: Plan) -> DataFrame:
        """The picked points of all ranges: point_index, x, y, z, mass, bin, rank, k, record_index."""
        return self._after_counts(spectra, by, _PICKED)

    def rank(self, spectra: DataFrame) -> DataFrame:
        """All points with bin and rank, the number of points of the bin that come before."""
        return self._after_counts(spectra, ranked, _RANKED)

    def _after_counts(self, spectra: DataFrame, each, schema: str) -> DataFrame:
        """What each makes of the batches of all ranges and the counts before them. A range comes with those, one row, and is
        read where that row is; points aren't moved."""
        vectors = counts_before(spectra).groupBy("piece").agg(F.collect_list(F.struct("bin", "before")).alias("before"))
        shared = self.spark.sparkContext.broadcast((self.ranges, each))  # names, sizes and 6,000 bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges, each = shared.value
            for batch in batches:
                for piece, before in zip(batch.column("piece").to_pylist(), batch.column("before"), strict=True):
                    seen, r = np.zeros(SPECTRUM_BINS, np.int64), ranges[piece]
                    seen[before.values.field("bin").to_numpy()] = before.values.field("before").to_numpy()
                    for at, data in blocks(r, BATCH):
                        yield each(decode_points(data, r.first + at // POINT_BYTES), seen)

        return vectors.mapInArrow(run, schema)

    def sample(self, max_points: int, step: int = 1 << 16, gap: int = 4096) -> DataFrame:
        """max_points points, or all, evenly spaced over the files: sample_index, point_index, x, y, z, mass. Tasks work out
        the places of step picks each and read those alone; only places less than gap bytes apart are read in one go."""
        n = self.ranges.records
        take = min(n, check_limit(max_points))
        shared = self.spark.sparkContext.broadcast(self.ranges)
        names = ["sample_index", *_POINT]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = shared.value
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    i = np.arange(number * step, min(take, (number + 1) * step))
                    points = np.floor((i + 0.5) * n / take).astype(np.int64)
                    fields = np.frombuffer(strided(ranges, points, gap), ">f4").reshape(-1, 4).astype(np.float32)
                    if not np.isfinite(fields).all():
                        raise ValueError("sampled points contain non-finite values")
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(points), *[pa.array(fields[:, c]) for c in range(4)]], names=names)

        parts = -(-take // step)
        return self.spark.range(0, parts, 1, max(1, min(parts, 20_000))).mapInArrow(run, "sample_index long, point_index long, x float, y float, z float, mass float")


def strided(ranges: Ranges, points: np.ndarray, gap: int) -> bytes:
    """The records of ascending points, read in spans that end where the next place is gap bytes away or in another file."""
    file, offset = ranges.place(points)
    apart = (np.diff(file) != 0) | (np.diff(offset) > gap)
    cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(points)] if len(points) else [0]
    out, opened, at = [], None, -1
    for a, b in zip(cuts, cuts[1:], strict=False):
        if file[a] != at:
            if opened:
                opened.close()
            at = int(file[a])
            store, inner = files.opened(ranges.paths[at])
            opened = store.open_input_file(inner)
        begin = int(offset[a])
        data = np.frombuffer(opened.read_at(int(offset[b - 1]) + ranges.unit - begin, begin), np.uint8)
        rows = (offset[a:b] - begin)[:, None] + np.arange(ranges.unit)
        out.append(data[rows].tobytes())
    if opened:
        opened.close()
    return b"".join(out)


def spectra_of(points: DataFrame) -> DataFrame:
    """The same of a table of points with a column piece, by one aggregation."""
    bad = F.lit(False)
    for c in FIELDS:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    extremes = [f(a).alias(f"{a}_{k}") for a in AXES for k, f in (("min", F.min), ("max", F.max))]
    return binned(points).groupBy("piece", "bin").agg(F.count("*").alias("n"), F.min(F.when(bad, F.col("point_index"))).alias("bad"), *extremes)


def pick_pieces(points: DataFrame, spectra: DataFrame, by: Plan) -> DataFrame:
    """The picked points of a table whose rows of one piece stand together in one task, in order of point_index, and whose
    pieces are numbered in that order, as of ordered_parts. Raises where points don't come so.

    The counts before the pieces are broadcast if there are MOST_COUNTS at most; beyond, points are ranked by a shuffle."""
    if spectra.count() > MOST_COUNTS:
        allocation = points.sparkSession.createDataFrame([(int(b), int(by.true[b]), int(by.take[b])) for b in np.flatnonzero(by.true)], "bin int, true_count long, take long")
        return pick_by_shuffle(points.select(*_POINT), allocation)
    return _in_pieces(points, spectra, by, _PICKED)


def rank_pieces(points: DataFrame, spectra: DataFrame) -> DataFrame:
    """All points of such a table with bin and rank, likewise."""
    if spectra.count() > MOST_COUNTS:
        return rank_in_bin(points.select(*_POINT)).select(*_POINT, "bin", "rank")
    return _in_pieces(points, spectra, ranked, _RANKED)


def pick_ordered(points: DataFrame, max_points: int) -> tuple[DataFrame, Summary, Plan]:
    """The picked points of such a table for a preview of max_points, with its summary and the plan."""
    spectra = materialize(spectra_of(points), "spectra")
    found = summary_of(spectra)
    by = plan(found, max_points)
    return pick_pieces(points, spectra, by), found, by


def _in_pieces(points: DataFrame, spectra: DataFrame, each, schema: str) -> DataFrame:
    table = spectra.select("piece", "bin", F.col("n").cast("long").alias("n")).toArrow().sort_by([("bin", "ascending"), ("piece", "ascending")])
    piece, bins, n = (table.column(c).to_numpy() for c in ("piece", "bin", "n"))
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(bins, bins)]  # where the bin begins
    order = np.lexsort((bins, piece))
    cuts = np.flatnonzero(np.diff(piece[order], prepend=-1))
    sizes = np.add.reduceat(n[order], cuts) if len(cuts) else n
    found = piece[order][cuts], np.append(cuts, len(piece)), bins[order], before[order], sizes
    shared = points.sparkSession.sparkContext.broadcast((each, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, (pieces, cuts, bins, counts, sizes) = shared.value
        now, left, last, seen = None, 0, -1, None
        for batch in batches:
            column = batch.column("piece").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)] if len(column) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                index = part.column("point_index").to_numpy()
                if column[a] != now:
                    at = int(np.searchsorted(pieces, column[a]))
                    whole, now, left, last = left == 0, column[a], int(sizes[at]), -1
                    seen = np.zeros(SPECTRUM_BINS, np.int64)
                    seen[bins[cuts[at] : cuts[at + 1]]] = counts[cuts[at] : cuts[at + 1]]
                else:
                    whole = True
                left -= len(part)
                if not whole or left < 0 or index[0] <= last or (np.diff(index) <= 0).any():
                    raise ValueError("the points of a piece don't come in order in one task")
                last = index[-1]
                yield each(part, seen)
        if left:
            raise ValueError("the points of a piece don't come in order in one task")

    return points.select(*_POINT, "piece").mapInArrow(run, schema)


__all__ = ["Plan", "PointFiles", "counts_before", "pick_ordered", "pick_pieces", "plan", "rank_pieces", "spectra_of", "strided", "summary_of"]
