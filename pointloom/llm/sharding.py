"""Operator 1: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_index
from .common import materialize, small


def rendezvous_costs(key: Column, weights: Sequence[float]) -> Column:
    """Array of one cost per shard, -ln(u) / weight, where u in (0, 1) is a hash of the key and the shard's number.

    The least cost wins; a shard wins in proportion to its weight, and its cost doesn't depend on the other shards,
    so a further shard only takes keys for itself."""
    digest = lambda i: F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"))), 1, 13), 16, 10).cast("double")
    share = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(share, lambda w, i: -F.log((digest(i) + F.lit(1.0)) / F.lit(2.0**52 + 1)) / w)


def assign_shards(df: DataFrame, key: Column, weights: Sequence[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with the shard of each row, and with the shard that it has once one more shard of grown_weight is there.

    No shuffle: each row is decided on its own. A null key counts as the string "null". Equal keys always share a
    shard. Columns of df named like the outputs are replaced."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key, n = F.coalesce(key.cast("string"), F.lit("null")), len(weights)
    out = df.withColumn("__costs", rendezvous_costs(key, [*weights, *([grown_weight] if grown_weight else [])]))
    out = out.withColumn("__least", F.array_min(F.slice("__costs", 1, n)))
    out = out.withColumn(shard, (F.array_position("__costs", F.col("__least")) - 1).cast("int"))
    if grown_weight:
        out = out.withColumn(grown, F.when(F.col("__costs")[n] < F.col("__least"), F.lit(n)).otherwise(F.col(shard)).cast("int"))
    return out.drop("__costs", "__least")


def number_slots(df: DataFrame, group: str, key: Column, tie: Sequence[str], slot: str = "slot", digits: int = 3) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order of a hash of the key (16**digits values) and then of the tie
    columns, nulls first; groups must be few, as shards or lengths are.

    All rows are numbered through by one shuffle into ranges, less each group's first number. Rows equal in key and tie are
    told apart by where they are read, so neither a group, nor a key, nor copies of one row are brought to one task. df is
    read twice, so pass a materialized table."""
    rows = df.withColumn("__part", F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, digits)).withColumn("__row", F.monotonically_increasing_id())
    numbered = global_index(rows, [group, "__part", *tie, "__row"], df.columns, "__number")
    first = small(materialize(numbered.groupBy(F.col(group).alias("__group")).agg(F.min("__number").alias("__first")), "groups"))
    out = numbered.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return out.select(*df.columns, (F.col("__number") - F.col("__first")).cast("long").alias(slot))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents into equally weighted shards by doc_id; law "key".

    size is the text's UTF-8 bytes plus 16, and 16 for a null text, whose CRC is that of no bytes. A null doc_id is
    the key "null". Repeated rows share a shard and take slots of their own. An empty table gives an empty table, and
    further columns are ignored."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = materialize(assign_shards(rows, F.col("doc_id"), [1.0] * shards, 1.0), "shards")
    out = number_slots(rows, "shard", F.col("doc_id"), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_shard(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 in SQL: 256 table values by the polynomial's rule, then one fold over the text's bytes.
ORACLE = """
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc(t) AS (SELECT list(c ORDER BY n) FROM bits WHERE k = 8
), rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 16 AS size, coalesce(doc_id::VARCHAR, 'null') AS key,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc
), costs AS (
  SELECT doc_id, key, i, -ln((('0x' || substr(md5(key || ':' || i), 1, 13))::BIGINT + 1.0::DOUBLE) / 4503599627370497::DOUBLE) AS cost
  FROM (SELECT DISTINCT doc_id, key FROM rows), range(41) r(i)
), own AS (
  SELECT key, arg_min(i, cost) FILTER (i < 40)::INTEGER AS shard, arg_min(i, cost)::INTEGER AS grown_shard FROM costs GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM rows JOIN own USING (key)
"""
