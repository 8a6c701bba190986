"""Words of whole chunks of texts at once, as numpy arrays: places, 64-bit hashes, and hashes of n-word windows.

A word is a run of bytes other than space and 0x09-0x0D in the UTF-8 text."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd multipliers, by seed

#: Bytes of text that are worked on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 3 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    begin: np.ndarray  # of each word, in bytes of data
    end: np.ndarray
    first: np.ndarray  # number of each text's first word; one more entry for the end
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.begin)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(len(self.data) + 1, 8), strides=(1, 1))
        size = self.end - self.begin
        out, live, done = size.astype(np.uint64) * _ODD[seed], np.arange(len(size)), 0
        while len(live):
            part = eight[self.begin[live] + done].view("<u8").ravel() & _MASK[np.minimum(size[live] - done, 8)]
            out[live] = mix((out[live] ^ part) * _ODD[seed])
            done += 8
            live = live[size[live] > done]
        return out


def split(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    space = np.concatenate([[True], SPACE[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edges[0::2], edges[1::2]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    return Words(begin, end, np.searchsorted(begin, starts), data)


def window_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every n consecutive words, by differences of one prefix sum modulo 2**64."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = np.full(len(hashes), _ODD[seed] | np.uint64(1), np.uint64)
    base[0] = 1
    back = np.full(len(hashes), pow(int(_ODD[seed] | np.uint64(1)), -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(base), dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * np.cumprod(back)[: len(hashes) - n + 1])


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the words at which a window of n words fits into the word's text."""
    ok = np.zeros(int(first[-1]) + 1, np.int32)
    long = np.diff(first) >= n
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def give_back() -> None:
    """Return freed memory to the system: a Python worker may long serve, or idle beside, other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about limit bytes of text each, and their texts; null is empty."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)) if len(column) else np.zeros(0, np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(column)] if len(column) else []
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a), [t or b"" for t in column.slice(a, b - a).to_pylist()]
    give_back()


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of width bytes with their lowest bytes first and then the higher ones, which are mostly zero and
    compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int = 4) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.int64)


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, int)


def bucket_count(docs, each: int, text: str = "text") -> int:
    """Buckets for what is gathered from the texts: one for each so many bytes, and the shuffle partitions at least."""
    from pyspark.sql import functions as F

    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
