"""CRC-32 of a whole from the CRC-32s of its parts, so that parts are read by tasks of their own, in any order."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

from . import files

# Fixed value: the polynomial of CRC-32, with the bit of the lowest power on the left.
POLYNOMIAL = 0xEDB88320
ONE = 1 << 31


def times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo the CRC's."""
    out = 0
    while a:
        if a & ONE:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@functools.cache
def _doubled(n: int) -> int:
    """x to the power 8 * 2**n, which is what 2**n bytes more do to a CRC: each is the square of the one before."""
    return ONE >> 8 if n == 0 else times(_doubled(n - 1), _doubled(n - 1))


def moved(crc: int, after: int) -> int:
    """The part of a whole's CRC-32 that bytes with this CRC-32 make if so many bytes come after them. The CRC of a whole is
    the exclusive or of its parts' ones."""
    n = 0
    while after and crc:
        if after & 1:
            crc = times(_doubled(n), crc)
        after >>= 1
        n += 1
    return crc


def joined(parts: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """CRC-32 and size of parts (CRC-32, size) one after another."""
    crc = size = 0
    for own, n in parts:
        crc, size = moved(crc, n) ^ own, size + n
    return crc, size


def crc_of_range(path: str, offset: int, size: int, block: int = 1 << 20) -> int:
    store, inner = files.opened(path)
    crc = 0
    with store.open_input_file(inner) as f:
        f.seek(offset)
        while size and (data := f.read(min(block, size))):
            crc, size = zlib.crc32(data, crc), size - len(data)
    if size:
        raise ValueError(f"{path} ends before byte {offset + size}")
    return crc
