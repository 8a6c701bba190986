"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, join_few, key_filter, materialize, on_key, row_key, small, without

#: Words of a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, THRESHOLD = 5, 0.8
_SPACES = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters other than 0x20 and 0x09-0x0D. Null and blank texts have none. Cut at single
    spaces, which is cheaper than at a pattern, and without the empty pieces."""
    plain = F.coalesce(text, F.lit(""))
    for space in _SPACES:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " ", -1), "")


def shingles_of(words: Column, lengths: list[int]) -> Column:
    """Array of the shingles of each of the lengths, as structs of SHINGLE word hashes, null behind a shorter one's end.
    Word hashes are zipped with themselves some places on, which is cheaper than a look at each place."""
    fields = [f"w{k}" for k in range(SHINGLE)]

    def zipped(own: Column, n: int) -> Column:
        shifted = [F.slice(own, k + 1, F.greatest(F.size(own) - (n - 1), F.lit(0))) if k < n else F.array().cast("array<bigint>") for k in range(SHINGLE)]
        return F.arrays_zip(*[c.alias(f) for c, f in zip(shifted, fields, strict=True)])

    # the hashes are bound once, as the only element of an array
    hashes = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    return F.flatten(F.transform(hashes, lambda own: F.concat(*[zipped(own, n) for n in lengths])))


def shingle_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, n, hash): a row for each shingle of shingles_of, with the xxhash64 of its struct, and the document's
    number of them. Places are exploded and word hashes fetched at each, so that the words' array stays in one stage of
    generated code and no struct is built."""
    eight = F.lit(8).cast("long")  # a place and a length are one number, 8 * place + length
    words = F.size("own").cast("long")
    places = [F.when(words >= n, F.sequence(F.lit(n).cast("long"), (words - n) * eight + n, eight)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    own = rows.select(*KEY, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("own")).select(*KEY, "own", F.concat(*places).alias("places"))
    own = own.select(*KEY, "own", F.size("places").alias("n"), F.explode("places").alias("place"))
    at, length = F.shiftright("place", 3).cast("int"), F.col("place").bitwiseAND(F.lit(7))
    return own.select(*KEY, "n", F.xxhash64(*[F.when(length > k, F.get("own", at + k)) for k in range(SHINGLE)]).alias("hash"))


def shingle_texts(words: Column, lengths: list[int]) -> Column:
    """The same shingles as text, the words joined by one space."""

    def joined(own: Column, n: int) -> Column:
        at = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", F.slice(own, i, n)))

    return F.flatten(F.transform(F.array(words), lambda own: F.concat(*[joined(own, n) for n in lengths])))


def of_item(words: Column, make) -> Column:
    """An item's shingles by make: those of SHINGLE words, or of a shorter item itself as one."""
    out = make(words, [SHINGLE])
    for n in range(1, SHINGLE):
        out = F.when(F.size(words) == n, make(words, [n])).otherwise(out)
    return out


def containment_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size, partition, hash): the smallest hashes of each item's set of shingles.

    Items are partitioned by size, in powers of two. In a partition of sizes below 2u, floor((1 - threshold) * 2u) + 1
    hashes, or all of a smaller set, are kept: a document that holds the threshold's share of an item lacks too few
    shingles to lack all of these. So the search misses nothing, and a larger item is looked up by few of its hashes."""
    hashes = F.transform(of_item(words_of(F.col("text")), shingles_of), lambda x: F.xxhash64(x))
    sets = items.select("item_id", F.array_sort(F.array_distinct(hashes)).alias("all"))
    sets = sets.withColumn("size", F.size("all")).where("size > 0").withColumn("partition", F.floor(F.log2("size")).cast("int"))
    keep = F.floor(F.lit(round(1 - threshold, 9)) * F.pow(F.lit(2.0), F.col("partition") + 1)).cast("int") + 1
    return sets.select("item_id", "size", "partition", F.explode(F.slice("all", 1, keep)).alias("hash"))


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_shingles): documents that hold at least threshold of the different
    5-word shingles of an item. An item of one to four words is one shingle, of its own length, so it is found wherever
    its words stand side by side.

    The items' sketches meet each document's shingles in one join, where a partition of items too large for the
    document is left out. The few pairs that meet are verified on the words themselves. Blank and null items have no
    shingle and never match, nor do blank and null documents. Repeated items with one item_id count as their union of
    shingles if their texts differ; a null item_id is one id. Repeated documents each match (join on doc_id and text_key).
    Texts of any length are read whole. Empty tables give none. Other columns are ignored."""
    item_rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = F.least(F.size(words_of(F.col("text"))), F.lit(SHINGLE))
    # at most SHINGLE different numbers
    lengths = sorted(r["n"] for r in item_rows.select(size.alias("n")).distinct().collect() if r["n"])
    if not lengths:
        return docs.select(*row_key(), F.lit(None).cast("long").alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_shared", "n_shingles")]).limit(0)
    sketches = materialize(containment_sketches(item_rows, threshold).select("item_id", "hash", F.pow(F.lit(2.0), "partition").alias("least")), "item_sketches")
    rows = docs.select(*row_key(), "text")
    pairs = materialize(join_few(shingle_hashes(rows, lengths), sketches, "hash").where(F.col("n") >= F.lit(threshold) * F.col("least") - 1e-9).select(*KEY, "item_id").distinct(), "pairs")
    # exact: the candidates' shingles as text against the items'
    named = F.xxhash64(*KEY)
    again = key_filter(pairs.select(*KEY).distinct(), named, named).probe(rows, named, {"__hit": named}).where("__hit")
    mine = again.select(*KEY, F.explode(F.array_distinct(shingle_texts(words_of(F.col("text")), lengths))).alias("shingle"))
    theirs = item_rows.select("item_id", F.explode(F.array_distinct(of_item(words_of(F.col("text")), shingle_texts))).alias("shingle")).distinct()
    sizes = theirs.groupBy(F.col("item_id").alias("sized_id")).agg(F.count("*").alias("n_shingles"))
    theirs = small(materialize(theirs.join(sizes, F.col("item_id").eqNullSafe(F.col("sized_id"))).drop("sized_id"), "item_shingles"))
    shared = mine.join(theirs, "shingle").distinct().groupBy(*KEY, "item_id", "n_shingles").agg(F.count("*").alias("n_shared"))
    shared = shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)
    seen = shared.join(pairs, on_key(shared, pairs, [*KEY, "item_id"]), "left_semi")
    return seen.select(*KEY, "item_id", "n_shared", "n_shingles")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold an item, all columns kept."""
    return without(docs, find_contained(docs, items, threshold))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and the benchmark item that it holds; clean documents have none."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contained(docs, items)
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 5) AS n FROM (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)),
lengths AS (SELECT DISTINCT n FROM b WHERE n > 0),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b WHERE n > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM m JOIN n ON m.item_id IS NOT DISTINCT FROM n.item_id WHERE n_shared >= 0.8 * n_shingles
"""
