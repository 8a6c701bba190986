"""Operator 6: n-gram Jaccard join. MinHash bands offer pairs, Bayesian pruning drops those that can hardly reach the
threshold, and exact shingle sets decide the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import BROADCAST_ROWS, KEY, join_counted, key_filter, materialize, row_key, small, without
from .components import connected_components

#: Words of a shingle, and the least similarity.
SHINGLE, THRESHOLD = 5, 0.8
#: 40 bands of 5 MinHash values: a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: MinHash values are compared this many at a time.
STEP = 40
#: A pair is dropped when the posterior probability that it reaches the threshold is below this.
TOLERANCE = 1e-9
#: Members of a group that meet in one task; larger groups are cut into blocks that meet two by two. A member that takes
#: more than UNIT bytes counts as so many, so a task holds two blocks of 64 MB at most, or two members.
BLOCK, UNIT = 1024, 1 << 16
#: Members, and bytes of them, of the small groups that share a task.
SHARED, SHARED_BYTES = 20_000, 1 << 26

_rng = np.random.default_rng(20240607)
_SEEDS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_ODDS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_BAND = words.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number n of compared values, the fewest matches m at which a pair stays.

    With a uniform prior, similarity given m matches of n has the density Beta(m + 1, n - m + 1), and its chance of
    being at least t is P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                out[n] = m
                break
    return out


def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, names): the 64-bit hashes of the texts' shingles one after another, the number of each text's
    first, and a 64-bit name of each text's sequence of words. A text of fewer than n words is one shingle; a text
    without words has none and is named 0."""
    found = words.split(texts)
    own = found.hashes()
    count = np.diff(found.first)
    at = words.window_starts(found.first, n)
    value = words.window_hashes(own, n)[at]
    # names, and the only shingles of short texts: a sum over the words, each mixed with its place
    place = (np.arange(len(own)) - np.repeat(found.first[:-1], count)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(own + words.mix(place)), dtype=np.uint64)])
    names = np.where(count > 0, words.mix(sums[found.first[1:]] - sums[found.first[:-1]] + np.uint64(1)), np.uint64(0))
    short = np.flatnonzero((count > 0) & (count < n))
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(int))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    mask = np.ones(len(out), bool)
    mask[first[:-1][short]] = False
    out[mask], out[first[:-1][short]] = value, names[short]
    return out, first, names


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, sketch, bands) of each document: node names its sequence of words and is null without any,
    sketch has the low byte of each MinHash value, bands the hashes of the bands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=1 << 20):
            value, first, names = shingles(texts)
            has = np.flatnonzero(np.diff(first))
            value, starts = (value >> np.uint64(32)).astype(np.uint32), first[:-1][has]
            least = np.empty((len(has), BANDS * ROWS), np.uint32)
            for i in range(BANDS * ROWS if len(has) else 0):
                least[:, i] = np.minimum.reduceat((value ^ _SEEDS[i]) * _ODDS[i], starts)
            bands = words.mix((words.mix(least.astype(np.uint64) + _BAND) * _BAND).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + _BAND[:BANDS])
            low = least.astype(np.uint8)
            rows = dict(zip(has.tolist(), range(len(has)), strict=True))
            pick = [rows.get(i) for i in range(len(texts))]
            node = pa.array(names.view(np.int64), pa.int64(), mask=np.array([p is None for p in pick], bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), node, pa.array([None if p is None else low[p].tobytes() for p in pick], pa.binary()), pa.array([None if p is None else bands[p].view(np.int64) for p in pick], pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "sketch", "bands"]
            )

    return docs.select(*row_key(), "text").mapInArrow(task, "doc_id long, text_key long, node long, sketch binary, bands array<bigint>")


def deal(rows: DataFrame, key: str, node: str, bytes_of: Column | None = None) -> DataFrame:
    """rows with columns group, i, j, own, so that any two rows of a key meet in some group, and no group is large.

    Keys of up to BLOCK rows share a group by their hash (i = -1). A larger key's rows are dealt over blocks by node,
    and each two blocks make a group; own is the row's block. Where rows take bytes_of, that counts as well."""
    spark = rows.sparkSession
    size = F.lit(0) if bytes_of is None else bytes_of
    weight = F.greatest(F.lit(1), F.ceil(size / UNIT)).cast("long")
    counts = rows.groupBy(key).agg(F.sum(weight).alias("count"))
    big = materialize(counts.where(F.col("count") > BLOCK), "large")
    n, total, taken = rows.agg(F.count("*"), F.sum(weight), F.sum(size)).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SHARED, (taken or 0) // SHARED_BYTES)
    joined = rows.join(F.broadcast(big), key, "left") if big.count() <= BROADCAST_ROWS else join_counted(rows, big, [key], "count", total, "left")
    out = joined.withColumn("__k", F.ceil(F.col("count") / BLOCK).cast("int"))
    out = out.withColumn("own", F.coalesce(F.pmod(F.xxhash64(node), F.col("__k")).cast("int"), F.lit(-1)))
    pair = lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))
    pairs = F.when(F.col("__k").isNull(), F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("__k") - 1), pair))
    out = out.withColumn("__p", F.explode(pairs)).withColumns({"i": F.col("__p.i"), "j": F.col("__p.j")})
    group = F.when(F.col("i") < 0, F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(F.xxhash64(key, "i", "j"))
    return out.withColumn("group", group).drop("__p", "__k", "count")


def meetings(table: pa.Table, key: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """From a group's rows, for each key: row numbers on the left and on the right, and whether these are the same."""
    keys, i, j, own = (table.column(c).to_numpy() for c in (key, "i", "j", "own"))
    order = np.argsort(keys, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1, [len(keys)]])
    for a, b in zip(edges, edges[1:], strict=False):
        rows = order[a:b]
        if i[rows[0]] == j[rows[0]]:
            yield rows, rows, True
        else:
            yield rows[own[rows] == i[rows]], rows[own[rows] == j[rows]], False


def plausible(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of sketches stay when their values are compared STEP at a time."""
    live = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for n, m in least.items():
        part = slice(n - STEP, n)
        matches = matches[: len(live)] + (left[live, part] == right[live, part]).sum(axis=1, dtype=np.int32)
        live, matches = live[matches >= m], matches[matches >= m]
    return live


def hang(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes is linked with by a chain of pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def survivors(values: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in left and in right of the pairs of rows whose sketches stay, some at a time."""
    found, step = [], max(1, 200_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        a, b = np.repeat(np.arange(at, at + len(part)), len(right)), np.tile(np.arange(len(right)), len(part))
        if same:
            a, b = a[a < b], b[a < b]
        stay = plausible(values[left[a]], values[right[b]], least)
        found.append((a[stay], b[stay]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def sketches_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)


def candidate_edges(table: pa.Table, least: dict[int, int]) -> pa.Table:
    """Pairs of each band's bucket that stay after pruning, thinned to edges that keep them connected."""
    node, values = table.column("node").to_numpy(), sketches_of(table)
    out_a, out_b = [], []
    for left, right, same in meetings(table, "band"):
        a, b = survivors(values, left, right, same, least)
        if len(a):
            every, code = np.unique(np.concatenate([left[a], right[b]]), return_inverse=True)
            root = hang(len(every), code[: len(a)], code[len(a) :])
            moved = np.flatnonzero(root != np.arange(len(every)))
            out_a.append(node[every[moved]])
            out_b.append(node[every[root[moved]]])
    words.give_back()
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"a": join(out_a), "b": join(out_b)})


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets left x right."""
    used = np.unique(np.concatenate([left, right]))
    items = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, [len(sets[i]) for i in used])
    _, code, count = np.unique(items, return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    order = order[count[code[order]] > 1]
    code, owner = code[order], owner[order]
    if not len(code):
        return np.zeros((len(left), len(right)), np.int64)
    code = np.cumsum(np.diff(code, prepend=code[0]) != 0)
    width = int(code[-1]) + 1
    row_of = np.full(max(used) + 1, -1)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, 4096):
        a, b = np.searchsorted(code, [at, at + 4096])
        sides = []
        for side in (left, right):
            row_of[:] = -1
            row_of[side] = np.arange(len(side))
            x = np.zeros((len(side), min(4096, width - at)), np.float32)
            row = row_of[owner[a:b]]
            x[row[row >= 0], code[a:b][row >= 0] - at] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def exact_links(table: pa.Table, threshold: float, least: dict[int, int]) -> pa.Table:
    """Exact similarities of the pairs of a component that stay after pruning: for each node its links to other texts, the
    documents behind them, and the smallest node (by row) that links connect it with here."""
    node, copies, values = table.column("node").to_numpy(), table.column("copies").to_numpy(), sketches_of(table)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    out = []
    for left, right, same in meetings(table, "component"):
        a, b = survivors(values, left, right, same, least)
        if not len(a):
            continue
        # only rows with a pair that stays are looked at
        (some, a), (others, b) = (np.unique(x, return_inverse=True) for x in (a, b))
        left, right = left[some], right[others]
        stays = np.zeros((len(left), len(right)), bool)
        stays[a, b] = True
        both = overlaps(sets, left, right)
        linked = stays & (both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9)
        a, b = np.nonzero(linked)
        every = np.unique(np.concatenate([left, right]))
        code = np.full(len(node), -1)
        code[every] = np.arange(len(every))
        root = every[hang(len(every), code[left[a]], code[right[b]])]
        texts, docs = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for mine, links, theirs in ((left, linked, right), (right, linked.T, left)):
            texts[mine] += links.sum(axis=1)
            docs[mine] += links @ copies[theirs]
        out.append((node[every], texts[every], docs[every], node[root]))
    words.give_back()
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("node", "n_texts", "n_docs", "root"), columns, strict=True)))


def sets_of(rows: DataFrame) -> DataFrame:
    """(node, component, copies, sketch, shingles) from (text, node, component, copies, sketch), the sorted set of each
    text's shingles; rows whose text isn't the node's are left out."""
    names = ["node", "component", "copies", "sketch"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=1 << 20):
            value, first, own = shingles(texts)
            ok = np.flatnonzero(own.view(np.int64) == batch.column("node").to_numpy())
            sets = [np.unique(value[first[i] : first[i + 1]]).tobytes() for i in ok]
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(ok)).columns, pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return rows.select("text", *names).mapInArrow(task, "node long, component long, copies long, sketch binary, shingles binary")


def ngram_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, class_key, n_links, n_texts, n_copies.

    Documents are linked when the Jaccard similarity of their sets of 5-word shingles is at least threshold (0.8 or
    more: the bands are made for that). class_id is the smallest doc_id that links lead to, n_links the number of other
    documents linked directly, n_texts how many different texts among them, n_copies the documents with the same words.

    Documents of the same words are one node, so copies make no pairs. A text of one to four words is a single
    shingle. Null texts and texts without words are alone, with no links. Repeated rows are copies of each other. A null doc_id
    is a document like others, behind all ids: class_id is null where a class has no other, and class_key, the hash of the
    text of the class's first document, tells such classes apart. Texts of any length are read whole. An empty table
    gives an empty one. Other columns are ignored."""
    sketches = materialize(sketch(docs), "sketches")
    rows = sketches.where("node IS NOT NULL").select(*KEY, "node")
    # one row for each different text, so that copies go no further
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    texts = sketches.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), first, F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    texts = materialize(texts, "texts")

    # 1. buckets of bands with at least two nodes
    bands = texts.select("node", F.explode("bands").alias("band"))
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialize(join_counted(bands, shared, ["band"], "n", BANDS * texts.count()).select("node", "band"), "members")
    meant = small(materialize(members.select("node").distinct(), "meant"))
    values = texts.select("node", "sketch").join(meant, "node", "left_semi")
    # 2. pairs of a bucket, pruned by the posterior
    least = least_matches(threshold)
    dealt = deal(members, "band", "node").join(values, "node").select("group", "band", "node", "sketch", "i", "j", "own")
    edges = dealt.groupBy("group").applyInArrow(lambda _, t: candidate_edges(t, least), "a long, b long")
    parts = connected_components(edges).withColumnRenamed("root", "component").join(texts.select("node", "copies", "sketch", F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key")), "node")
    parts = materialize(parts, "components")
    # 3. exact sets of what is left: the other texts stay where they are
    own = docs.select(*row_key(), "text")
    found = key_filter(parts, F.xxhash64("__id", "__key"), F.xxhash64("__id", "__key")).probe(own, F.xxhash64(*KEY), {"__hit": F.xxhash64(*KEY)}).where("__hit")
    found = found.join(parts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    sets = materialize(sets_of(found).dropDuplicates(["node"]), "sets")
    dealt = deal(sets, "component", "node", F.octet_length("shingles"))
    links = materialize(dealt.groupBy("group").applyInArrow(lambda _, t: exact_links(t, threshold, least), "node long, n_texts long, n_docs long, root long"), "links")
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # 4. back to documents
    own = texts.select("node", "copies", "first").join(links.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs")), "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = materialize(own, "own")
    classes = own.groupBy("root").agg(F.min("first").alias("class"), F.count("*").alias("n"))
    own = join_counted(own, classes, ["root"], "n", own.count())
    own = materialize(own.select("node", "copies", F.col("class.doc_id").alias("class_id"), F.col("class.text_key").alias("class_key"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs")), "own")
    linked = join_counted(rows, own, ["node"], "copies", rows.count()).select(*KEY, "class_id", "class_key", (F.col("n_docs") + F.col("copies") - 1).alias("n_links"), "n_texts", F.col("copies").alias("n_copies"))
    zero = F.lit(0).cast("long")
    blank = sketches.where("node IS NULL").select(*KEY, F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"), zero.alias("n_links"), zero.alias("n_texts"), F.lit(1).cast("long").alias("n_copies"))
    return linked.unionByName(blank)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with only the first document of each class, that of the smallest doc_id, all columns kept. Rows repeated with
    its id and text all stay, and so do all blank rows. A null doc_id comes last."""
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    return without(docs, ngram_classes(docs, threshold).where(~first))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
