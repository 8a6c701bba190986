"""Operator 4: repeated token windows by Rabin-Karp hashes, and the removal intervals that they make."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import HOT_GROUPS, materialize
from .words import planes, runs, unplanes

#: Bytes of text of one chunk; larger ones send less, as a chunk sends a window's hash once.
CHUNK = 6 << 20
#: Bytes of text whose windows a bucket holds.
BUCKET = 24 << 20
#: Buckets that one chunk, or one bucket, is dealt over at most. More are reached by dealing a second time, so what a
#: row holds doesn't shrink as the input grows.
FANOUT = 2048
#: Bytes of places that are broadcast at most, of ids that very many rows share.
BROADCAST_BYTES = 32 << 20
#: What stands for a null doc_id: before all others.
NULL_ID = -(2**63)


BUCKET_ROWS = "bucket int, ids binary, counts binary, places binary, hashes binary"


def packed(bucket: int, doc: np.ndarray, place: np.ndarray, hashes: bytes | None) -> tuple:
    """A row of windows of ordered documents."""
    new = runs(doc)
    step = np.diff(place, prepend=0)
    step[new[:-1]] = place[new[:-1]]
    return bucket, np.diff(doc[new[:-1]], prepend=0).tobytes(), planes(np.diff(new)), planes(step), hashes


def deal(doc: np.ndarray, place: np.ndarray, value: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Windows, ordered by document and place, dealt over buckets: the first window of each hash. The later ones are
    known to be repeats already; they go in a row without hashes to a bucket that the first window picks. So one passage
    in all texts adds one window to its bucket."""
    sort = np.argsort(value, kind="stable")
    edges = runs(value[sort])
    first = np.repeat(sort[edges[:-1]], np.diff(edges))
    again = np.zeros(len(value), bool)  # but the same place of a repeated row isn't a repeat
    again[sort] = (doc[sort] != doc[first]) | (place[sort] != place[first])
    rows = []
    if again.any():
        rows.append(packed(int(bucket[0]), doc[again], place[again], None))
    sort = np.flatnonzero(~again)
    sort = sort[np.argsort(bucket[sort], kind="stable")]
    doc, place, value, bucket = doc[sort], place[sort], value[sort], bucket[sort]
    edges = runs(bucket)
    rows += [packed(int(bucket[a]), doc[a:b], place[a:b], value[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "places", "hashes"))])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def bucket_windows(window: int, buckets: int):
    """The windows of a chunk of texts, dealt over buckets by a second hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=CHUNK):
            ids = np.array([NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            order = np.argsort(ids, kind="stable")
            found = words.split([texts[i] for i in order])
            at = words.window_starts(found.first, window)
            if not len(at):
                continue
            doc = found.texts()[at]
            value = words.window_hashes(found.hashes(0), window, 0)[at]
            bucket = (words.window_hashes(found.hashes(1), window, 1)[at] % np.uint64(buckets)).astype(np.uint16)
            yield deal(ids[order][doc], at - found.first[doc], value, bucket)

    return task


def deal_again(table: pa.Table, parts: int) -> pa.Table:
    """The windows of a share of one bucket, dealt over the parts of the bucket by their own hash. What is known to repeat
    passes through."""
    every = table.to_pylist()
    rows = [r for r in every if r["hashes"] is not None]
    out = [pa.table({"bucket": pa.array([r["bucket"] * parts + len(r["ids"]) % parts], pa.int32()), **{c: pa.array([r[c]], pa.binary()) for c in ("ids", "counts", "places", "hashes")}}) for r in every if r["hashes"] is None]
    if rows:
        doc, place = (np.concatenate(c) for c in zip(*map(unpack, rows), strict=True))
        value = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        order = np.lexsort((place, doc))
        doc, place, value = doc[order], place[order].astype(np.int64), value[order]
        out.append(pa.Table.from_batches([deal(doc, place, value, rows[0]["bucket"] * parts + (words.mix(value) % np.uint64(parts)).astype(np.int64))]))
    words.give_back()
    return pa.concat_tables(out)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.cumsum(np.frombuffer(row["ids"], np.int64))
    counts, step = unplanes(row["counts"]), unplanes(row["places"])
    sums, first = np.cumsum(step), np.cumsum(counts) - counts
    place = sums - np.repeat(sums[first] - step[first], counts)
    return np.repeat(ids, counts), place.astype(np.uint32)


def repeats(table: pa.Table, parts: int) -> pa.Table:
    """All windows of one bucket: those that repeat an earlier one, dealt over parts of the documents."""
    rows = table.to_pylist()
    none = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
    doc, place = (np.concatenate(c) for c in zip(*none, *[unpack(r) for r in rows if r["hashes"] is None], strict=True))
    one_doc, one_place = (np.concatenate(c) for c in zip(*none, *[unpack(r) for r in rows if r["hashes"] is not None], strict=True))
    value = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["hashes"], np.uint64) for r in rows if r["hashes"] is not None]])
    sort = np.argsort(value)
    value = value[sort]
    same = np.zeros(len(value) + 1, bool)
    same[1:-1] = value[1:] == value[:-1]
    sort, value = sort[same[1:] | same[:-1]], value[same[1:] | same[:-1]]
    sort, value = sort[o := np.lexsort((one_place[sort], one_doc[sort], value))], value[o]
    # the first of each hash stays, and so does the very same window of a repeated row
    start = np.maximum.accumulate(np.where(np.diff(value, prepend=value[:1] - np.uint64(1)) != 0, np.arange(len(value)), 0)) if len(value) else sort
    later = sort[(one_doc[sort] != one_doc[sort[start]]) | (one_place[sort] != one_place[sort[start]])]
    doc, place = np.concatenate([doc, one_doc[later]]), np.concatenate([place, one_place[later]])
    sort = np.lexsort((place, doc))
    words.give_back()
    return by_document(doc[sort], place[sort], parts)


def by_document(doc: np.ndarray, place: np.ndarray, parts: int, above: int = 1, part_above: int = 0) -> pa.Table:
    """Sorted (doc, place) as one row for each part of the documents: part, ids, counts, places. Documents that have been
    dealt over parts above are told apart by what that left of their hash."""
    part = part_above * parts + (words.mix(doc.view(np.uint64)) // np.uint64(above) % np.uint64(parts)).astype(np.int64)
    sort = np.argsort(part, kind="stable")
    doc, place, part = doc[sort], place[sort], part[sort]
    out = []
    edges = runs(part)
    for a, b in zip(edges, edges[1:], strict=False):
        new = runs(doc[a:b])
        out.append((int(part[a]), doc[a:b][new[:-1]].tobytes(), planes(np.diff(new)), place[a:b].astype("<u4").tobytes()))
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "ids", "counts", "places"])


def places_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All (doc, place) of rows by document, sorted."""
    rows = table.to_pylist()
    doc = np.concatenate([np.repeat(np.frombuffer(r["ids"], np.int64), unplanes(r["counts"])) for r in rows])
    place = np.concatenate([np.frombuffer(r["places"], "<u4") for r in rows])
    sort = np.lexsort((place, doc))
    return doc[sort], place[sort]


def gather(table: pa.Table) -> pa.Table:
    """What all buckets say of one part of the documents: one row per document."""
    doc, place = places_in(table)
    new = runs(doc)
    places = pa.Array.from_buffers(pa.large_binary(), len(new) - 1, [None, pa.py_buffer((4 * new).astype(np.int64).tobytes()), pa.py_buffer(place.tobytes())])
    return pa.table({"doc_id": pa.array(doc[new[:-1]], pa.int64(), mask=doc[new[:-1]] == NULL_ID), "places": places.cast(pa.binary())})


def intervals(places: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """The maximal intervals [begin, end) that windows at these places cover."""
    depth = np.zeros(n_words + 1, np.int32)
    places = places[places + window <= n_words]
    np.add.at(depth, places, 1)
    np.add.at(depth, places + window, -1)
    covered = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def find_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, places): the word numbers, as little-endian 32-bit numbers, at which a window begins
    that also begins earlier, in a smaller doc_id or before in the same document. Documents without any are left out.

    Each bucket is one group of about 24 MB of text, some four million windows; their number grows with the texts. A
    chunk is dealt over FANOUT buckets at most. Beyond, each is dealt again over as many as are missing, some 24 MB at
    a time, and so is what goes back to the documents."""
    buckets = words.bucket_count(docs, each=BUCKET)
    first, more = min(buckets, FANOUT), -(-buckets // FANOUT)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bucket_windows(window, first), BUCKET_ROWS)
    share = lambda *c: F.pmod(F.xxhash64(*c), F.lit(more))
    if more > 1:
        dealt = dealt.groupBy("bucket", share("ids", "places")).applyInArrow(lambda _, t: deal_again(t, more), BUCKET_ROWS)
    document_rows = "part int, ids binary, counts binary, places binary"
    found = dealt.groupBy("bucket").applyInArrow(lambda _, t: repeats(t, first), document_rows)
    if more > 1:
        found = found.groupBy("part", share("ids", "places")).applyInArrow(lambda k, t: by_document(*places_in(t), more, first, k[0].as_py()), document_rows)
    return found.groupBy("part").applyInArrow(lambda _, t: gather(t), "doc_id long, places binary")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Each document with its removal: doc_id, text (null where it was), places (little-endian 32-bit numbers of the
    words at which a repeated window begins, null without any). intervals() merges them into maximal removal intervals.

    A null text has no words. Texts of fewer words than a window lose nothing; texts of any length are read whole. Rows
    that share a doc_id count as one document: a word goes if a repeated window covers it in any of them, and a row
    doesn't repeat its own copy. A null doc_id comes before all others. An empty table gives an empty one. Other columns
    are ignored.

    Ids that very many rows share, as a null one may be, are met by broadcast if what is found of them is within
    BROADCAST_BYTES; their texts don't move then. Other texts move once, to meet their places."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(find_repeats(rows, window).withColumnRenamed("doc_id", "__id"), "repeats")
    same = lambda table: rows["doc_id"].eqNullSafe(table["__id"])
    counts = rows.groupBy("doc_id").count()
    total = rows.count()
    shared = materialize(counts.where(F.col("count") > max(1, total // HOT_GROUPS)).select(F.col("doc_id").alias("__hot")), "shared")  # below HOT_GROUPS rows
    hot = found.join(F.broadcast(shared), found["__id"].eqNullSafe(shared["__hot"]), "right").select(F.col("__hot").alias("__id"), "places")
    hot = materialize(hot, "hot")
    if (hot.agg(F.sum(F.octet_length("places"))).first()[0] or 0) > BROADCAST_BYTES or not hot.count():
        return rows.join(found, same(found), "left").drop("__id")
    met = rows.join(F.broadcast(hot), same(hot)).drop("__id")
    others = rows.join(F.broadcast(hot.select("__id")), same(hot), "left_anti")
    return met.unionByName(others.join(found, others["doc_id"].eqNullSafe(found["__id"]), "left").drop("__id"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Counts and the digest of what is left of each document."""
    return digest_cuts(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")), 20)


def digest_cuts(found: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches):
            n, cut, digest = [], [], []
            for text, places in zip(texts, batch.column("places").to_pylist(), strict=True):
                parts = text.split()
                n.append(len(parts))
                if places:
                    keep = np.ones(len(parts), bool)
                    for a, b in intervals(np.frombuffer(places, "<u4").astype(np.int64), window, len(parts)):
                        keep[a:b] = False
                    parts = list(itertools.compress(parts, keep.tolist()))
                cut.append(n[-1] - len(parts))
                digest.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: Every window is written out as text here and counted exactly.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
