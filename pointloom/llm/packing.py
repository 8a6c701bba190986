"""Operator 10: best-fit decreasing packing of token sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize
from .sharding import number_slots

#: Words of one generation that a Python worker remembers the ids of; two generations are kept, some 90 MB.
MOST_WORDS = 300_000

# The signs after an ASCII letter or digit and before another, or the end, that the tokenizer cuts off.
# Signs beside an apostrophe stay, as "'s" is one piece.
_SIGNS = re.compile(rb"(?<=[0-9A-Za-z])[!-&(-/:-@\[-`{-~]+(?=[0-9A-Za-z]|$)")

# Byte-level models read bytes as letters: printable ones stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = dict(zip(_PRINTED, map(chr, _PRINTED), strict=True)) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_loaded: dict = {}


class WordIds(dict):
    """The ids of lower-case words as little-endian unsigned 32-bit numbers, worked out when first asked for.

    Words that come up again outlive those that don't: when a generation is full it becomes the old one, which is
    looked at once more before a word is worked out."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.work_out(word)
        if len(self) >= MOST_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def work_out(self, word: bytes) -> bytes:
        if b"<|" not in word:  # else it may hold a special token
            parts = _SIGNS.sub(rb" \g<0> ", word).lower().split()
            if parts != [word]:
                return b"".join([self[p] for p in parts])
            text = word.decode(errors="replace").lower()
            if text.isalpha() and max(text) < "\u0250":  # one run of letters that normalization leaves alone
                letters = text if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS)
                return array.array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return array.array("I", self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids).tobytes()


# What a tokenizer must do to a text so that its words can be looked up one by one.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(tokenizer) -> bool:
    """Whether texts are lower-cased and cut at white space, and the pieces' ids don't look across: what WordIds relies on."""
    told = json.loads(tokenizer.to_str())
    normalizers = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
    splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split, letters = splits if len(splits) == 2 else ({}, {})
    removed = split.get("pattern") == {"Regex": _SPLIT} and split.get("invert") and split.get("behavior") == "Removed"
    alone = letters.get("type") == "ByteLevel" and not letters.get("add_prefix_space") and not letters.get("use_regex")
    return normalizers == _NORMALIZERS and bool(removed) and alone and told["model"]["type"] == "BPE" and not told["truncation"] and not told["padding"]


def _bytes(ids: Iterable[int]) -> bytes:
    return array.array("I", ids).tobytes()


def _load(name: str, folder: str | None) -> Callable[[bytes], bytes]:
    """From a UTF-8 text to its ids as little-endian unsigned 32-bit numbers, by the library that reads the file."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = f"{folder}/{name}"
    plain = lambda text: text.decode(errors="replace")
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=str(path))
        return lambda text: _bytes(pieces.encode(plain(text)))
    if name.endswith(".tiktoken"):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        ranked = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: _bytes(ranked.encode_ordinary(plain(text)))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(path))
    if not _by_words(tokenizer):
        return lambda text: _bytes(tokenizer.encode(plain(text), add_special_tokens=False).ids)
    ids = WordIds(tokenizer)
    # this tokenizer never looks across a space
    return lambda text: b"".join(map(ids.__getitem__, (text if b"<|" in text else text.lower()).split()))


def token_ids(texts: list[bytes], name: str, folder: str | None) -> Iterator[bytes]:
    """The ids of each text. The tokenizer is loaded once in each Python worker. Where it cuts texts at white space, they
    are put together from those of the words; else the library does whole texts."""
    if (name, folder) not in _loaded:
        _loaded[name, folder] = _load(name, folder)
    yield from map(_loaded[name, folder], texts)


def tokenize_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str, folder: str | None, with_ids: bool) -> DataFrame:
    """The pieces of each document's ids and its end id: cut only where a document is longer than capacity."""
    end, full = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=2 << 20):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_ids(texts, tokenizer, folder), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), full)):
                    part = ids[a : a + full]
                    out.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


class Capacities:
    """A segment tree over remaining capacities 0..n: which of them some open bin has."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        at = self.leaves + capacity
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least least."""
        at = self.leaves + least
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts of each length, as runs: the pieces of a length with ranks from rank on, one to
    each of size bins from bin on, at the same offset.

    Pieces of one length are alike, and so are bins that were filled alike, so whole runs are placed with one search
    of the tree. The bins get the same fill as if each piece were placed on its own, longest first. The work and the
    plan depend on the number of different lengths, at most capacity, and not on the number of pieces."""
    tree, open_bins, runs, bins = Capacities(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            room = tree.tightest(length)
            if room is None:
                room, first, size = capacity, bins, -(-(n - rank) // (capacity // length))
                bins += size
            else:
                first, size = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            whole = min(size, (n - rank) // each)
            for filled, first_bin, m in ((each, first, whole), ((n - rank - whole * each) if whole < size else 0, first + whole, 1)):
                for k in range(filled if m else 0):
                    runs.append((length, rank, m, first_bin, capacity - room + k * length))
                    rank += m
                if filled and m:
                    put(room - filled * length, first_bin, m)
                    first, size = first + m, size - m
            put(room, first, size)
    return dict(zip(("length", "rank", "size", "bin", "offset"), np.array(runs, np.int64).reshape(-1, 5).T.copy(), strict=True))


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids, the tokens themselves). tokenizer is a file in folder, by default that of the installed public tokenizers: .json
    of tokenizers, .tiktoken of tiktoken or .model of sentencepiece.

    A null or empty text is the end id alone. Repeated rows are packed each. A null doc_id stays null. Other columns
    are ignored; an empty table gives no sequences.

    Best-fit decreasing looks only at lengths, so the driver plans over the counts of the at most capacity lengths,
    for all documents together. Each piece then finds its place by its rank among the pieces of its length; pieces are
    numbered through in ranges, so a length, or an id, that a third of the pieces have isn't sorted in one task."""
    pieces = materialize(tokenize_pieces(docs, capacity, end_id, tokenizer, folder, with_ids), "pieces")
    plan = best_fit_plan({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}, capacity)
    keys = plan["length"] << 44 | plan["rank"]
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (keys, plan["rank"], plan["bin"], plan["offset"])))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, bins, offset = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, length << 44 | rank, "right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + rank - first[at], "offset": offset[at]})

    key = F.concat_ws(":", F.col("doc_id"), F.col("piece"))
    ranked = number_slots(pieces, "length", key, ["doc_id", "piece", "ids_crc32"], "__rank", digits=2)
    out = ranked.withColumn("__place", place("length", "__rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("__place.sequence_id"), F.col("__place.offset"), *(["ids"] if with_ids else []))


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
