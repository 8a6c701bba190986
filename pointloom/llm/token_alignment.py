"""Operator 12: alignment of two tokenizers' tokens over the same bytes, window by window between shared ends."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize

#: Bytes of text that are aligned at once and whose pair counts travel together; a longer text is a chunk of its own.
CHUNK_BYTES = 3 << 20
#: Windows of one generation that a Python worker remembers, of those that a chunk has more than once; two generations are kept, some 20 MB.
MOST_WINDOWS = 25_000
#: Ids of the largest window that is remembered. A text without spaces is one window; many of them would fill a worker.
MOST_IDS = 64
#: Windows that are worked out at once, some 10 MB.
BLOCK_WINDOWS = 1 << 14
#: Bytes of a chunk's packed numbers in one row. Parquet's writer looks at its page only after 100 rows and its reader takes 4,096 at once, so rows of megabytes
#: would take the JVM many times as much.
PART_BYTES = 1 << 14
#: While texts are read: rows that the reader holds, and bytes that go to a Python worker, at once. Spark's own sizes, some 16 MB and 64 MB, take the JVM several times as
#: much beside its heap, and the worker keeps such a batch while it aligns its chunks.
READING = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * CHUNK_BYTES)}

# A run of white space that the ranks' library can't cut, as its regular expression goes too deep.
_LONG_SPACE = re.compile(r"\s{20000}")
# Byte-level entries write bytes as letters: printable ones as themselves, the others from U+0100 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_MARK = "▁"

_loaded: dict = {}


class Side:
    """One tokenizer: from a text to its ids, and each id's bytes."""

    def __init__(self, encode: Callable[[str], list[int]], entries: list[bytes | None]):
        self.encode, self.entries = encode, np.array([*entries, None], object)[:-1]
        self.sizes = np.array([len(e or b"") for e in entries], np.int64)
        self.marked = np.array([bool(e) and e[:1] == b" " for e in entries])
        # decimal digits of each id, and how many they are
        shown = np.arange(len(entries)).astype(bytes)
        self.digits, self.widths = shown.view(np.uint8).reshape(len(entries), -1), np.char.str_len(shown)
        width = int(self.widths.max(initial=1))
        self.digits = self.digits[:, :width].copy()

    def ids(self, text: str, whole: bytes) -> np.ndarray | None:
        """None where the tokens' bytes aren't whole, or a token has none."""
        found = np.array(self.encode(text), np.int32)
        try:
            joined = b"".join(self.entries[found].tolist())
        except TypeError:
            return None
        return found if joined == whole else None


def byte_level(path: str, before: str) -> Side:
    """A byte-level BPE of the tokenizers library, over what stands before each text and the text. Where the same vocabulary lies beside it as ranks, those do the work,
    four times as fast; the tests hold the two against each other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    @functools.cache
    def slow():
        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        return found

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    entries: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        entries[i] = bytes(map(_BYTES.get, piece)) if all(c in _BYTES for c in piece) else None
    by_library = lambda text: slow().encode(before + text, add_special_tokens=False).ids
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return Side(by_library, entries)
    import tiktoken
    from public_tokenizers import PATTERN

    with open(beside, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if any(entries[i] != token for token, i in ranks.items()):
        return Side(by_library, entries)
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda text: by_library(text) if _LONG_SPACE.search(text) else fast.encode_ordinary(before + text), entries)


def pieces(path: str) -> Side:
    """A sentencepiece model, which puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def entry(i: int) -> bytes | None:
        if model.is_control(i) or model.is_unknown(i):
            return None
        piece = model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace(_MARK, " ").encode()

    return Side(lambda text: model.encode(text, num_threads=1), [entry(i) for i in range(model.get_piece_size())])


def load(name: str, folder: str | None, before: str = " ") -> Side:
    """The tokenizer of a file, once in each Python worker: .json of tokenizers or .model of sentencepiece."""
    if (name, folder, before) not in _loaded:
        if folder is None:
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        else:
            path = f"{folder}/{name}"
        _loaded[name, folder, before] = pieces(path) if name.endswith(".model") else byte_level(path, before)
    return _loaded[name, folder, before]


class Memo:
    """Alignments of windows by their id tuples, in two generations."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def look(self, keys: list[tuple[bytes, bytes]], work_out: Callable[[list], Iterable]) -> list:
        """The alignments of windows, of which work_out gives those that aren't there."""
        values = list(map(self.new.get, keys))
        lacking = [i for i, v in enumerate(values) if v is None]
        for i in lacking:
            values[i] = self.old.get(keys[i])
        unknown = [i for i in lacking if values[i] is None]
        for i, value in zip(unknown, work_out([keys[i] for i in unknown]) if unknown else (), strict=True):
            values[i] = value
        if len(self.new) + len(lacking) > MOST_WINDOWS:
            self.new, self.old = {}, self.new
        self.new.update((keys[i], values[i]) for i in lacking[:MOST_WINDOWS] if len(keys[i][0]) + len(keys[i][1]) <= 4 * MOST_IDS)
        return values


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1 of all i in order."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def align_windows(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of each window, ids of A and of B over the same bytes: its groups as text, how many they are, how many links it has,
    and of all windows the linked pairs of ids, A's shifted by 32 bits, in the order of A's tokens, as 64-bit numbers. The
    windows come laid end to end, with the places behind each one's last ids, and are done at once."""
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    # groups end where tokens of both end
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], np.cumsum(in_b)])[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    # each token is a row of its digits and the sign behind them
    shown = np.zeros((len(ids_a) + len(ids_b), max(a.digits.shape[1], b.digits.shape[1]) + 1), np.uint8)
    widths = np.empty(len(shown), np.int64)
    for place, ids, side in ((place_a, ids_a, a), (place_b, ids_b, b)):
        shown[place, : side.digits.shape[1]], widths[place] = side.digits[ids], side.widths[ids]
    signs = np.full(len(shown), ord(","), np.uint8)
    signs[place_a[np.cumsum(in_a) - 1]], signs[place_b[np.cumsum(in_b) - 1]] = ord("|"), ord(";")
    signs[place_b[last_b - 1]] = ord("\n")
    shown[np.arange(len(shown)), widths] = signs
    texts = shown[np.arange(shown.shape[1]) <= widths[:, None]].tobytes().split(b"\n")[:-1]
    groups = np.diff(np.concatenate([[0], group_b[last_b - 1] + 1]))
    # a token of A is linked with B's from the one that holds its first byte to the one that holds its last
    low = np.searchsorted(ends_b, ends_a - a.sizes[ids_a], "right")
    links = np.searchsorted(ends_b, ends_a, "left") - low + 1
    pairs = np.repeat(ids_a << 32, links) | ids_b[_spread(low, links)]
    return texts, groups, np.diff(np.concatenate([[0], np.cumsum(links)[last_a - 1]])), pairs


def align_keys(a: Side, b: Side, keys: list[tuple[bytes, bytes]]) -> list[tuple[bytes, int, bytes]]:
    """Of each window, by its ids as bytes: its groups as text, how many they are, and its linked pairs as bytes."""
    out = []
    for block in (keys[i : i + BLOCK_WINDOWS] for i in range(0, len(keys), BLOCK_WINDOWS)):
        ids = [np.frombuffer(b"".join([key[k] for key in block]), np.int32) for k in (0, 1)]
        last = [np.cumsum([len(key[k]) // 4 for key in block]) for k in (0, 1)]
        texts, groups, n_links, pairs = align_windows(a, b, *ids, *last)
        cuts, pairs = [0, *(8 * np.cumsum(n_links)).tolist()], pairs.tobytes()
        out += [(text, n, pairs[i:j]) for text, n, i, j in zip(texts, groups.tolist(), cuts, cuts[1:], strict=False)]
    return out


def _same(ids: np.ndarray, first: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
    """Whether each window's ids are those of the window it is like."""
    if (size != size[like]).any():
        return False
    blocks = (slice(i, i + 4 * BLOCK_WINDOWS) for i in range(0, len(first), 4 * BLOCK_WINDOWS))
    return all((ids[_spread(first[like[x]], size[x])] == ids[first[x][0] : first[x][-1] + size[x][-1]]).all() for x in blocks)


def distinct_windows(ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different window, and each window's number among the different ones. Windows are told apart by a
    hash, which is then held against all their ids; should two ever share one, Python's own tuples decide."""
    size_a, size_b = np.diff(np.append(first_a, len(ids_a))), np.diff(np.append(first_b, len(ids_b)))
    key = np.zeros(len(first_a), np.uint64)
    for ids, first, size, odd in ((ids_a, first_a, size_a, 0x9E3779B97F4A7C15), (ids_b, first_b, size_b, 0xC2B2AE3D27D4EB4F)):
        sums = []
        for i in range(0, len(first), 4 * BLOCK_WINDOWS):
            some = size[i : i + 4 * BLOCK_WINDOWS]
            own, begin = ids[first[i] : first[i] + some.sum()], np.cumsum(some) - some
            at = np.arange(len(own)) - np.repeat(begin, some)
            sums.append(np.add.reduceat(words.mix((own | at << 20).astype(np.uint64)), begin))
        key = words.mix((key ^ np.concatenate(sums)) * np.uint64(odd))
    _, place, number = np.unique(key, return_index=True, return_inverse=True)
    if _same(ids_a, first_a, size_a, place[number]) and _same(ids_b, first_b, size_b, place[number]):
        return place, number
    seen: dict = {}
    number = np.array([seen.setdefault((ids_a[i : i + m].tobytes(), ids_b[j : j + n].tobytes()), len(seen)) for i, m, j, n in zip(first_a, size_a, first_b, size_b, strict=True)])
    return np.unique(number, return_index=True)[1], number


def window_firsts(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each window's first ids."""
    begin_a, begin_b = (np.cumsum(s.sizes[ids]) - s.sizes[ids] for s, ids in ((a, ids_a), (b, ids_b)))
    # anchors: both start a token with a space, so both end one before it; texts start with one
    anchors = np.intersect1d(begin_a[a.marked[ids_a]], begin_b[b.marked[ids_b]], assume_unique=True)
    return np.searchsorted(begin_a, anchors), np.searchsorted(begin_b, anchors)


def align_places(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, place: np.ndarray, again: int, memo: Memo) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """What align_windows gives of the windows at the given places. The first of them, so many as come again in the chunk,
    are looked for in the memo; the rest, of which most come nowhere else, are worked out as they lie, block by block."""
    ends_a, ends_b = np.append(first_a, len(ids_a)), np.append(first_b, len(ids_b))
    known, cuts = place[:again], lambda ends, ids: [ids[i:j].tobytes() for i, j in zip(ends[known].tolist(), ends[known + 1].tolist(), strict=True)]
    values = memo.look(list(zip(cuts(ends_a, ids_a), cuts(ends_b, ids_b), strict=True)), lambda unknown: align_keys(a, b, unknown))
    shown = [v[0] for v in values]
    groups, n_links = [np.array([v[1] for v in values], np.int64)], [np.array([len(v[2]) // 8 for v in values], np.int64)]
    links = [np.frombuffer(b"".join([v[2] for v in values]), np.int64)]
    for i in range(again, len(place), BLOCK_WINDOWS):
        some = place[i : i + BLOCK_WINDOWS]
        size_a, size_b = ends_a[some + 1] - ends_a[some], ends_b[some + 1] - ends_b[some]
        own = align_windows(a, b, ids_a[_spread(ends_a[some], size_a)], ids_b[_spread(ends_b[some], size_b)], np.cumsum(size_a), np.cumsum(size_b))
        shown += own[0]
        for all_, x in zip((groups, n_links, links), own[1:], strict=True):
            all_.append(x)
    return shown, *map(np.concatenate, (groups, n_links, links))


def align_chunk(texts: list[bytes], a: Side, b: Side, memo: Memo) -> dict:
    """The alignment of a chunk of texts; see _COLUMNS."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    none, no_ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for text in texts:
        plain = text.decode(errors="replace")
        ids_a = a.ids(plain, b" " + text) if text else None
        ids_b = b.ids(plain, b" " + text) if ids_a is not None else None
        found.append((no_ids, no_ids) if ids_b is None else (ids_a, ids_b))
    n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([no_ids, *[x[k] for x in found]]) for k in (0, 1))
    del found
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(texts), np.int64), "n_links": np.zeros(len(texts), np.int64), "groups_sha256": [""] * len(texts)}
    out |= {"n_windows": out["n_links"], "windows": b"", "window_links": b"", "links": b"", "pairs": none, "counts": none}
    if not len(ids_a):
        return out
    first_a, first_b = window_firsts(a, b, ids_a, ids_b)
    place, number = distinct_windows(ids_a, ids_b, first_a, first_b)
    # frequent windows get low numbers, whose high bytes are zero and compress away
    times = np.bincount(number, minlength=len(place))
    order = np.argsort(-times, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place, number, times = place[order], rank[number], times[order]
    shown, groups, n_links, links = align_places(a, b, ids_a, ids_b, first_a, first_b, place, int((times > 1).sum()), memo)
    pairs, which = np.unique(links, return_inverse=True)
    out["pairs"], out["counts"] = pairs, np.bincount(which, weights=np.repeat(times, n_links)).astype(np.int64)
    # windows of each text: those that begin before its last token
    last = np.searchsorted(first_a, np.cumsum(n_a), "left")
    first = np.concatenate([[0], last[:-1]])
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], last])])
    out["n_windows"], out["n_groups"], out["n_links"] = last - first, sums(groups[number]), sums(n_links[number])
    joined = lambda i, j: b";".join([shown[k] for k in number[i:j].tolist()])
    out["groups_sha256"] = [hashlib.sha256(joined(i, j)).hexdigest() if j > i else "" for i, j in zip(first.tolist(), last.tolist(), strict=True)]
    out["windows"], out["window_links"], out["links"] = words.planes(number), words.planes(n_links), words.planes(which)
    return out


_COLUMNS = """chunk long, part int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
n_windows array<long>, pairs array<long>, counts array<long>, packed binary"""
_PACKED = ["windows", "window_links", "links"]
_PER_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(texts: list[bytes]) -> bytes:
    """Their sizes, and all of them compressed."""
    return np.array([len(t) for t in texts], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(b"".join(texts), asbytes=True)


def unpack(data: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(data, "<i8", n)).tolist()
    whole = pa.Codec("zstd").decompress(memoryview(data)[8 * n :], ends[-1], asbytes=True)
    return [whole[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def chunk_rows(row: dict) -> pa.RecordBatch:
    """A chunk's rows: the first has all columns, those below it only what is packed beyond PART_BYTES."""
    data = pack([row[c] for c in _PACKED])
    parts = [data[i : i + PART_BYTES] for i in range(0, len(data), PART_BYTES)]
    columns = {"chunk": [row["chunk"]] * len(parts), "part": range(len(parts)), "packed": parts}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [row.get(f.name)] + [None] * (len(parts) - 1)), f.type) for f in _ARROW], schema=_ARROW)


def align_chunks(docs: DataFrame, a: str, b: str, folder: str | None) -> DataFrame:
    """A chunk of documents, in rows of bounded size: their figures, the linked pairs of ids, each once with its count in the
    chunk, and, packed, the windows that each document has by number and the links of each of the chunk's windows by number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right, memo, part = load(a, folder), load(b, folder), Memo(), TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(words.chunks(batches, limit=CHUNK_BYTES)):
            row = {"chunk": part << 32 | number, "doc_id": batch.column("doc_id")} | align_chunk(texts, left, right, memo)
            yield chunk_rows(row)
            del batch, texts, row
            words.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _COLUMNS)


_ARROW = pa.schema(
    [("chunk", pa.int64()), ("part", pa.int32()), ("doc_id", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.int64())) for c in ("n_windows", "pairs", "counts")]
    + [("packed", pa.binary())]
)


def count_pairs(chunks: DataFrame) -> DataFrame:
    """(pair, n, best) over all chunks: how many links hold an A id (pair >> 32) linked with a B id (its low 32 bits), and
    whether no other A id is linked with that B id more often."""
    rows = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    pairs = materialize(rows.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # a row for each entry of B's vocabulary at most
    return pairs.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one chunk with the corpus's counts of its pairs. Its rows and these come in any order."""
    order = np.argsort(chunk.column("part").to_numpy()).tolist()
    row = {c: chunk.column(c)[order[0]] for c in chunk.column_names}
    packed = b"".join([chunk.column("packed")[i].as_py() for i in order])
    listed = {c: np.array(row[c].values) for c in ("doc_id", "n_windows", "pairs")}
    n, best = np.zeros(len(listed["pairs"]), np.int64), np.zeros(len(listed["pairs"]), np.int64)
    at = np.searchsorted(listed["pairs"], found.column("pair").to_numpy())
    n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy()
    windows, window_links, links = map(words.unplanes, unpack(packed, len(_PACKED)))
    ends, last = np.cumsum(window_links), np.cumsum(listed["n_windows"])
    sums = lambda x, ends: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))
    out = {c: row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    out |= {k: pa.array(sums(sums(v[links], ends)[windows], last)) for k, v in (("n_best", best), ("count_sum", n))}
    words.give_back()
    return pa.table(out).select([c.split()[0] for c in _PER_DOCUMENT.split(", ")])


def align_documents(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """Each document's alignment of tokenizer a's tokens with b's, both over a space and the text: doc_id, n_a and n_b
    tokens, n_groups between shared ends, n_links (pairs of tokens with a byte in common), n_best (links whose pair of ids
    is their B id's most frequent over all documents, ties included), count_sum (over links, how often their pair is linked
    in all documents), groups_sha256. a and b are files in folder, by default that of the installed public tokenizers.

    A null or empty text, and one whose tokens don't give its bytes back (a sign that b writes as a space), has no tokens:
    zeros and an empty groups_sha256. Repeated rows are rows of their own, and each counts. A null doc_id stays null. Other
    columns are ignored; an empty table gives an empty table.

    Texts are tokenized whole, once. A chunk of about CHUNK_BYTES of them sends each different pair once with its count, so
    what is shuffled for counts doesn't grow with how frequent a pair is, and the chunks' tasks read no texts again: windows
    are kept as numbers. The highest count of each B id is a row for each entry of b's vocabulary at most; it alone is broadcast."""
    chunks = materialize(align_chunks(docs, a, b, folder), "alignment", READING)
    pairs = count_pairs(chunks)
    asked = chunks.select(F.col("chunk").alias("asking"), F.explode("pairs").alias("pair"))
    found = asked.join(pairs, "pair")
    rows = chunks.groupBy("chunk").cogroup(found.groupBy("asking"))
    return rows.applyInArrow(_finish, _PER_DOCUMENT)


def op12_align(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
