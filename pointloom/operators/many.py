"""Many clouds of one table at once: strata are the bins of each cloud, and every cloud becomes a preview of its own."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.expressions import pick_number, quantize, quantize_mass
from ..scratch import materialize
from ..sources import files
from ..sources.preview import pack_header
from .problems import check_clouds
from .sample import RANK_PART, check_limit
from .spectrum import AXES, FIELDS, binned

#: Records of one cloud that a task puts together, 64 MB; larger previews are written one by one.
MOST_TOGETHER = 8 << 20


def file_name(cloud: str) -> str:
    """Of a cloud's keys as JSON: what may stand in a name anywhere, and a hash that tells them apart."""
    return f"{re.sub('[^0-9A-Za-z]+', '-', cloud).strip('-')[:80]}-{hashlib.sha256(cloud.encode()).hexdigest()[:16]}.preview"


def keyed(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their keys as __key0 and so on, and __cloud, one column that is never null and tells clouds apart, null keys
    included."""
    fields = [F.col(c).cast("float").alias(c) for c in FIELDS]
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    return points.select(*named, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__cloud"), F.col("point_index").cast("long").alias("point_index"), *fields)


def allocate_each(points: DataFrame, max_points: int) -> DataFrame:
    """(__cloud, bin, true_count, take, offset, n and bounds of the cloud) of keyed points: each cloud's largest-remainder
    shares of max_points, and where a bin's records begin among its cloud's. A cloud has at most 6,000 rows, so each is
    ranked in one window group whatever its size."""
    limit = check_limit(max_points)
    extremes = [f(F.col(a)).cast("double").alias(f"{a}_{k}") for a in AXES for k, f in (("min", F.min), ("max", F.max))]
    bins = binned(points).groupBy("__cloud", "bin").agg(F.count("*").alias("true_count"), *extremes)
    whole = Window.partitionBy("__cloud")
    whole_box = [f(f"{a}_{k}").over(whole).alias(f"{a}_{k}") for a in AXES for k, f in (("min", F.min), ("max", F.max))]
    bins = bins.select("__cloud", "bin", "true_count", F.sum("true_count").over(whole).alias("n"), *whole_box)
    cut, product = F.col("n") > limit, F.col("true_count") * F.lit(limit).cast("long")
    bins = bins.withColumn("__q", F.when(cut, F.call_function("div", product, F.col("n")))).withColumn("__r", F.when(cut, product % F.col("n")))
    left = F.lit(limit) - F.sum("__q").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("__r"), F.asc("bin")))
    take = F.when(cut, F.col("__q") + (rank <= left).cast("long")).otherwise(F.col("true_count"))
    bins = bins.withColumn("take", take.cast("long")).drop("__q", "__r")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("offset", F.coalesce(F.sum("take").over(before), F.lit(0)).cast("long"))


def pick_each(points: DataFrame, allocation: DataFrame) -> DataFrame:
    """The picked points of keyed points: their columns with bin, k and record_index (in their cloud), and the allocation's
    bounds. Ranks are counted in parts of consecutive points, as a cloud, or a bin of it, may hold most points. Points are
    shuffled once: the counts before a part and the shares of its bin come by the same keys."""
    strata = ["__cloud", "bin", "__part"]
    parts = binned(points).withColumn("__part", F.floor(F.col("point_index") / RANK_PART))
    before = Window.partitionBy("__cloud", "bin").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy(*strata).count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    table = shift.join(allocation.where("take > 0"), ["__cloud", "bin"])
    own = F.row_number().over(Window.partitionBy(*strata).orderBy("point_index")) - 1
    rows = parts.withColumn("__own", own).join(table, strata)
    rows = rows.withColumn("k", pick_number(F.col("__own") + F.col("__before"), F.col("true_count"), F.col("take"))).where("k is not null")
    box = [f"{a}_{k}" for a in AXES for k in ("min", "max")]
    return rows.select(*points.columns, "bin", "k", (F.col("offset") + F.col("k")).alias("record_index"), *box)


def quantize_each(picked: DataFrame) -> DataFrame:
    """Picked points with qx, qy, qz over the bounds of their own cloud and qm."""
    values = [quantize(F.col(a), F.col(f"{a}_min"), F.col(f"{a}_max")).alias(f"q{a}") for a in AXES]
    return picked.select("*", *values, quantize_mass(F.col("mass")).alias("qm"))


def _free(keys: list[str], others: tuple[str, ...]) -> list[str]:
    if taken := {k.lower() for k in keys} & set(others):
        raise ValueError(f"keys {sorted(taken)} must have other names")
    return [f"__key{i}" for i in range(len(keys))]


def records_each(points: DataFrame, keys: list[str], max_points: int) -> DataFrame:
    """keys, record_index, bin, k, point_index, qx, qy, qz, qm: the preview records of every cloud, in one job. Keys may be
    null, which is a value like others. Points must be finite, and point_index tell a cloud's points apart."""
    rows, names = keyed(points, keys), ("record_index", "bin", "k", "point_index", "qx", "qy", "qz", "qm")
    own = [F.col(c).alias(k) for c, k in zip(_free(keys, names), keys, strict=True)]
    return quantize_each(pick_each(rows, allocate_each(rows, max_points))).select(*own, *names)


def encode_each(points: DataFrame, keys: list[str], folder: str, max_points: int) -> DataFrame:
    """Write a preview for each cloud, as the keys tell them apart: keys, path, original_point_count, stored_point_count,
    file_size, payload_crc32. See file_name for how files are called.

    Raises ValueError, before anything is written, for the first cloud with a problem. A cloud's picked records, at most
    max_points, are put together in one task, so max_points is at most MOST_TOGETHER; its points never are. Tasks that run
    again write the same bytes. The result is written already; reading it again doesn't encode again."""
    if check_limit(max_points) > MOST_TOGETHER:
        raise ValueError(f"clouds of more than {MOST_TOGETHER} records are encoded one by one")
    names = ("path", "original_point_count", "stored_point_count", "file_size", "payload_crc32")
    rows, own = keyed(points, keys), _free(keys, names)
    wrong = check_clouds(rows, ["__cloud"]).where("problem is not null").orderBy("__cloud").first()
    if wrong:
        raise ValueError(f"{wrong['__cloud']}: {wrong['problem']}")
    files.make_folder(folder)
    allocation = materialize(allocate_each(rows, max_points), "shares")
    records = quantize_each(pick_each(rows, allocation)).select(F.col("__cloud").alias("__of"), *own, "record_index", "qx", "qy", "qz", "qm")
    schema = StructType([*[StructField(k, rows.schema[c].dataType) for k, c in zip(keys, own, strict=True)], StructField("path", StringType()), *[StructField(n, LongType()) for n in names[1:]]])

    def write(spectrum: pa.Table, found: pa.Table) -> pa.Table:
        column = lambda table, c: table.column(c).to_numpy()
        counts = np.zeros((2, C.SPECTRUM_BINS), "<u4")
        counts[:, column(spectrum, "bin")] = column(spectrum, "true_count"), column(spectrum, "take")
        found = found.sort_by("record_index")
        if not np.array_equal(column(found, "record_index"), np.arange(counts[1].sum())):
            raise ValueError("records are missing or come twice")
        data = counts.tobytes() + np.column_stack([column(found, c) for c in ("qx", "qy", "qz", "qm")]).astype("<u2").tobytes()
        n, crc = int(counts[0].sum()), zlib.crc32(data)
        low, high = (tuple(spectrum.column(f"{a}_{k}")[0].as_py() for a in AXES) for k in ("min", "max"))
        path = f"{folder.rstrip('/')}/{file_name(spectrum.column('__cloud')[0].as_py())}"
        store, inner = files.opened(path)
        with store.open_output_stream(inner) as out:
            out.write(pack_header(n, len(found), low, high, crc, max_points) + data)
        told = [[path], [n], [len(found)], [C.HEADER_SIZE + len(data)], [crc]]
        return pa.table([*[found.column(c).slice(0, 1) for c in own], *[pa.array(v) for v in told]], names=[*keys, *names])

    written = allocation.groupBy("__cloud").cogroup(records.groupBy("__of")).applyInArrow(write, schema)
    return materialize(written, "written")
