"""Operator 3: exact dedup. A two-pass Bloom filter finds the possibly repeated hashes; only those rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_counted, materialize, small
from .words import mix

#: Cells of the filter for each row, and the most there can be (2**30 cells, one bit each: 128 MB to each executor).
#: Beyond that more unrepeated rows are taken for possible repeats and shuffled; the result stays exact.
CELLS_PER_ROW, MOST_CELLS, PROBES = 16, 1 << 30, 3
#: Cells of one segment, which one task merges.
SEGMENT = 1 << 20


def normalized(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09-0x0D; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """PROBES cell numbers of each 64-bit key; cells is a power of two."""
    keys = keys.view(np.uint64)
    return np.stack([mix(keys + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(cells - 1) for i in range(PROBES)])


def repeat_filter(keys: DataFrame, rows: int) -> np.ndarray:
    """First pass: the bits of the cells that at least two of the keys, a one-column table of 64-bit numbers, hit.

    Each task counts its own hits and sends them by segment; one task per segment adds them up. Only these bits, of
    bounded size, come to the driver."""
    cells = 1 << max(SEGMENT.bit_length() - 1, min(MOST_CELLS.bit_length() - 1, (rows * CELLS_PER_ROW - 1).bit_length()))
    name = keys.columns[0]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64), cells).ravel()
            cell, n = np.unique(cell, return_counts=True)
            part = (cell // np.uint64(SEGMENT)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if len(part) else []
            out = [(int(part[a]), (cell[a:b] % np.uint64(SEGMENT)).astype("<u4").tobytes(), np.minimum(n[a:b], 2).astype(np.uint8).tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["segment", "cells", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(SEGMENT, np.uint8)
        for row in table.to_pylist():
            at = np.frombuffer(row["cells"], "<u4")
            seen[at] = np.minimum(seen[at] + np.frombuffer(row["counts"], np.uint8), 2)
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(seen == 2, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(cells // 8, np.uint8)
    for row in keys.mapInArrow(hits, "segment int, cells binary, counts binary").groupBy("segment").applyInArrow(merge, "segment int, bits binary").toLocalIterator():
        out[row["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_repeat(spark, bits: np.ndarray, key: Column) -> Column:
    """Second pass: whether the key may have come up twice; never false for one that has."""
    shared, cells = spark.sparkContext.broadcast(bits), len(bits) * 8

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        at = cells_of(keys.to_numpy().astype(np.int64), cells)
        return pd.Series(((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))

    return probe(key)


def _digests(docs: DataFrame) -> DataFrame:
    text = F.sha2(normalized(F.col("text")), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).alias("__length"), F.monotonically_increasing_id().alias("__row"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without white space; null is empty, so all blank and null texts are one group. The
    longest text in code points stays, then the smallest doc_id (null last), then, of rows repeated with the same
    doc_id, any one. Other columns are ignored; an empty table gives an empty one.

    The digests, some 80 bytes a row, are written once. Rows that the filter clears pass straight through; the others
    are grouped with partial aggregation, and groups too large for one task are joined by broadcast."""
    spark = docs.sparkSession
    digests = materialize(_digests(docs), "digests")
    key = F.xxhash64("text_sha256")
    flagged = may_repeat(spark, repeat_filter(digests.select(key.alias("key")), digests.count()), key)
    marked = materialize(digests.withColumn("__flag", flagged), "flagged")
    rows = marked.where("__flag").drop("__flag")
    first = F.min(F.struct((-F.col("__length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row")))
    groups = materialize(rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), first.alias("__first")), "groups")
    repeated = join_counted(rows, groups, ["text_sha256"], "group_size", rows.count()).select("doc_id", F.col("__first.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__first.row")).alias("kept"), "text_sha256")
    alone = marked.where("NOT __flag").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(repeated)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept; the choice is that of exact_groups.

    Texts that don't repeat are passed on where they are read. Only the possible repeats, and only while they are
    checked against the rows that stay, move with their texts."""
    spark = docs.sparkSession
    text, key = F.sha2(normalized(F.col("text")), 256), F.xxhash64(F.sha2(normalized(F.col("text")), 256))
    digests = materialize(_digests(docs), "digests")
    bits = repeat_filter(digests.select(F.xxhash64("text_sha256").alias("key")), digests.count())
    rows = digests.where(may_repeat(spark, bits, F.xxhash64("text_sha256")))
    first = F.min(F.struct((-F.col("__length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id")))
    stay = rows.groupBy("text_sha256").agg(first.alias("f")).select(F.col("text_sha256").alias("__s"), (-F.col("f.l")).alias("__l"), F.col("f.doc_id").alias("__d"))
    stay = small(materialize(stay, "stay"))
    sha, flag = free_name(docs, "__sha"), free_name(docs, "__flag")
    own = docs.withColumns({sha: text, flag: may_repeat(spark, bits, key)})
    again = own.where(F.col(flag))
    again = again.join(stay, (again[sha] == stay["__s"]) & (F.coalesce(F.length(again["text"]), F.lit(0)) == stay["__l"]) & again["doc_id"].cast("long").eqNullSafe(stay["__d"]), "left_semi")
    return own.where(~F.col(flag)).drop(sha, flag).unionByName(again.dropDuplicates([sha]).drop(sha, flag))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
