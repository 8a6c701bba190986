"""Helpers that the corpus operators share: scratch tables, skew-proof joins, checked broadcasts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_dir

#: A side of a join is broadcast only when it has been counted and is no larger than this many narrow rows.
BROADCAST_ROWS = 200_000
#: A key filter has this many bits for each key, tested this many times, in blocks of 32,768 bits (Spark's bitmaps), of
#: which there are so many at most: 32 MB to each executor at any size of the input. Past that more rows that aren't meant
#: pass for hits, and users of the filter check all hits.
KEY_BITS, KEY_PROBES, BLOCK_BITS, MOST_BLOCKS = 16, 4, 1 << 15, 1 << 13
#: Groups above 1/HOT_GROUPS of all rows are split off as hot; there are fewer than HOT_GROUPS of them by counting.
HOT_GROUPS = 10_000


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Two columns that name a document: its id and a 64-bit hash of its text. Rows with equal id and text are one
    document in two places, and get equal results."""
    return [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")]


KEY = ["doc_id", "text_key"]


def on_key(left: DataFrame, right: DataFrame, names: list[str] = KEY) -> Column:
    """Null-safe equality on names, still an equi-join for Spark."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def small(df: DataFrame) -> DataFrame:
    """A materialized narrow table, marked for broadcast if it has been counted to be within BROADCAST_ROWS; else as it
    is, so that Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with so many underscores that df has no such column in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class KeyFilter:
    """A blocked Bloom filter of 64-bit keys as a table (block, bits), made and probed by Spark's bitmap functions."""

    table: DataFrame
    blocks: int

    def probe(self, rows: DataFrame, block_key: Column, hits: dict[str, Column]) -> DataFrame:
        """rows with a column for each name in hits: whether its key may be in the filter; never false for one that is.
        block_key tells the block and each of hits the places in it, as in key_filter. The table is within its bound, so it is broadcast."""
        block, bits = free_name(rows, "__block"), free_name(rows, "__bits")
        table = F.broadcast(self.table.select(F.col("block").alias(block), F.col("bits").alias(bits)))
        out = rows.join(table, F.pmod(block_key, F.lit(self.blocks)) == F.col(block), "left")
        # of an absent block all tests are null
        tests = {name: F.coalesce(reduce(and_, [_bit(F.col(bits), at) for at in _places(key)]), F.lit(False)) for name, key in hits.items()}
        return out.select(*rows.columns, *[test.alias(name) for name, test in tests.items()])


def _places(key: Column) -> list[Column]:
    mixed = F.xxhash64(key)
    return [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(KEY_PROBES)]


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1


def key_filter(keys: DataFrame, block_key: Column, key: Column) -> KeyFilter:
    """The filter of a table of keys, which is read twice. Rows with one block_key share a block."""
    blocks = max(1, min(MOST_BLOCKS, -(-keys.count() * KEY_BITS // BLOCK_BITS)))
    # dealt by block first, so no task holds many blocks half full
    dealt = keys.select(F.pmod(block_key, F.lit(blocks)).alias("block"), F.explode(F.array(*_places(key))).alias("at")).repartition("block")
    return KeyFilter(materialize(dealt.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "key_filter"), blocks)


def join_few(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with a materialized narrow table by a 64-bit key that few of the rows have. The table is
    broadcast within BROADCAST_ROWS; beyond, only the rows that pass a filter of its keys shuffle, and of those, keys
    that very many rows have are counted first and met by broadcast."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    hit = free_name(rows, "__hit")
    hits = materialize(key_filter(table.select(key).distinct(), F.col(key), F.col(key)).probe(rows, F.col(key), {hit: F.col(key)}).where(hit).drop(hit), "hits")
    total = hits.count()
    counts = hits.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(1, total // HOT_GROUPS))
    hot = materialize(table.join(F.broadcast(counts.select(key)), key), "hot")  # of HOT_GROUPS keys at most
    if hot.count() > BROADCAST_ROWS:  # so many rows to a hot key that they are dealt over tasks as well
        return hits.join(table, key)
    cold = hits.join(F.broadcast(hot.select(key).distinct()), key, "left_anti")
    return hits.join(F.broadcast(hot), key).unionByName(cold.join(table, key))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are in bad (doc_id, text_key), all columns as they were.

    A filter of bad's keys, of bounded size, is broadcast. Rows that it clears pass straight through where they are read;
    only the hits, which are bad but for a few, move with their texts to be checked."""
    named = F.xxhash64("__bad_id", "__bad_key")
    bad = materialize(bad.select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct(), "without")
    found = key_filter(bad, named, named)
    key, hit = free_name(docs, "__key"), free_name(docs, "__hit")
    keyed = docs.withColumn(key, row_key()[1])
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col(key))
    keyed = found.probe(keyed, own, {hit: own})
    again = keyed.where(F.col(hit))
    again = again.join(bad, again["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (again[key] == bad["__bad_key"]), "left_anti")
    return keyed.where(~F.col(hit)).unionByName(again).drop(key, hit)


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with one row per group, where groups has each group's row count in column count.

    Groups above total / HOT_GROUPS rows, of which there can't be more than HOT_GROUPS, are broadcast, so a key that
    holds a third of all rows isn't shuffled to one task; the others meet in a shuffle join."""
    hot = F.col(count) > F.lit(max(1, total // HOT_GROUPS))
    big, rest = groups.where(hot), groups.where(~hot)
    cold_rows = rows.join(F.broadcast(big.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(big), keys).unionByName(cold_rows.join(rest, keys, how))


__all__ = ["BROADCAST_ROWS", "HOT_GROUPS", "KEY", "KeyFilter", "free_name", "join_counted", "join_few", "key_filter", "materialize", "on_key", "row_key", "scratch_dir", "small", "without"]
