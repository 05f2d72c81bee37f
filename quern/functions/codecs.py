"""Integer codes, for reading and writing index files; analytics on Parquet tables never need them.

Each code is a pair of functions on lists of integers, and `coded` and `decoded` turn a pair into Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Bits:
    """A row of bits, first bit lowest, written and read from the front."""

    def __init__(self, data: bytes = b""):
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def put(self, x: int, width: int) -> None:
        self.value |= x << self.size
        self.size += width

    def take(self, width: int) -> int:
        out = self.value >> self.at & ((1 << width) - 1)
        self.at += width
        return out

    def zeros(self) -> int:
        """Skips zeros and the one after them, and counts the zeros."""
        rest = self.value >> self.at
        n = (rest & -rest).bit_length() - 1
        self.at += n + 1
        return n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def _put_gamma(bits: Bits, x: int) -> None:
    low = (x + 1).bit_length() - 1
    bits.put(1 << low, low + 1)
    bits.put(x + 1 - (1 << low), low)


def _take_gamma(bits: Bits) -> int:
    low = bits.zeros()
    return bits.take(low) + (1 << low) - 1


def _put_delta(bits: Bits, x: int) -> None:
    low = (x + 1).bit_length() - 1
    _put_gamma(bits, low)
    bits.put(x + 1 - (1 << low), low)


def _take_delta(bits: Bits) -> int:
    low = _take_gamma(bits)
    return bits.take(low) + (1 << low) - 1


def _bitwise(put: Callable[[Bits, int], None], take: Callable[[Bits], int]):
    def encode(values: list[int]) -> bytes:
        bits = Bits()
        for x in values:
            put(bits, x)
        return bits.bytes()

    def decode(data: bytes, n: int) -> list[int]:
        bits = Bits(data)
        return [take(bits) for _ in range(n)]

    return encode, decode


def vbyte(values: list[int]) -> bytes:
    """Groups of seven bits, lowest first; the last byte of a value has its high bit set."""
    out = bytearray()
    for x in values:
        while x > 127:
            out.append(x & 127)
            x >>= 7
        out.append(x | 128)
    return bytes(out)


def from_vbyte(data: bytes, n: int) -> list[int]:
    out, x, shift = [], 0, 0
    for b in data:
        x |= (b & 127) << shift
        shift += 7
        if b & 128:
            out.append(x)
            x = shift = 0
            if len(out) == n:
                break
    return out


def interpolative(values: list[int]) -> bytes:
    """Binary interpolative code of the prefix sums: the total, then middles within the range their neighbours leave."""
    sums, total = [], 0
    for x in values:
        total += x
        sums.append(total + len(sums))
    bits = Bits()
    _put_delta(bits, total)
    todo = [(0, len(sums) - 2, 0, total + len(sums) - 2)]
    while todo:
        lo, hi, least, most = todo.pop()
        if lo > hi:
            continue
        mid = (lo + hi) // 2
        first, last = least + mid - lo, most - (hi - mid)
        bits.put(sums[mid] - first, (last - first).bit_length())
        todo += [(mid + 1, hi, sums[mid] + 1, most), (lo, mid - 1, least, sums[mid] - 1)]
    return bits.bytes()


def from_interpolative(data: bytes, n: int) -> list[int]:
    bits = Bits(data)
    total = _take_delta(bits)
    sums = [0] * n
    if n:
        sums[-1] = total + n - 1
    todo = [(0, n - 2, 0, total + n - 2)]
    while todo:
        lo, hi, least, most = todo.pop()
        if lo > hi:
            continue
        mid = (lo + hi) // 2
        first, last = least + mid - lo, most - (hi - mid)
        sums[mid] = first + bits.take((last - first).bit_length())
        todo += [(mid + 1, hi, sums[mid] + 1, most), (lo, mid - 1, least, sums[mid] - 1)]
    return [x - (sums[i - 1] + 1 if i else 0) for i, x in enumerate(sums)]


def raw(values: list[int]) -> bytes:
    return b"".join(x.to_bytes(4, "little") for x in values)


def from_raw(data: bytes, n: int) -> list[int]:
    return [int.from_bytes(data[4 * i : 4 * i + 4], "little") for i in range(n)]


#: Widths and numbers of the values that share a word of 28 data bits.
SIMPLE = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))


def simple9(values: list[int]) -> bytes:
    """As many equally wide values to a 32-bit word as fit; wider ones than 28 bits escape to a word of their own."""
    out, at = bytearray(), 0
    while at < len(values):
        for kind in range(len(SIMPLE) - 1, -1, -1):
            width, count = SIMPLE[kind]
            part = values[at : at + count]
            if len(part) == count and all(x < 1 << width for x in part):
                word = kind
                for i, x in enumerate(part):
                    word |= x << 4 + i * width
                out += word.to_bytes(4, "little")
                break
        else:
            part = values[at : at + 1]
            out += (15).to_bytes(4, "little") + part[0].to_bytes(4, "little")
        at += len(part)
    return bytes(out)


def from_simple9(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    while len(out) < n:
        word = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if word & 15 == 15:
            out.append(int.from_bytes(data[at : at + 4], "little"))
            at += 4
        else:
            width, count = SIMPLE[word & 15]
            out += [word >> 4 + i * width & (1 << width) - 1 for i in range(count)]
    return out


def group_of_eight(values: list[int]) -> bytes:
    """A descriptor byte for up to eight data bytes: a zero bit continues a value, a one ends it."""
    out, group, marks = bytearray(), bytearray(), 0

    def flush() -> None:
        nonlocal group, marks
        if group:
            out.append(marks)
            out.extend(group.ljust(8, b"\0"))
        group, marks = bytearray(), 0

    for x in values:
        own = x.to_bytes(max(1, -(-x.bit_length() // 8)), "little")
        if len(group) + len(own) > 8:
            flush()
        group += own
        marks |= 1 << len(group) - 1
    flush()
    return bytes(out)


def from_group_of_eight(data: bytes, n: int) -> list[int]:
    out: list[int] = []
    for at in range(0, len(data), 9):
        marks, start = data[at], at + 1
        for i in range(8):
            if marks >> i & 1:
                out.append(int.from_bytes(data[start : at + 2 + i], "little"))
                start = at + 2 + i
    return out[:n]


def patched(values: list[int]) -> bytes:
    """Frame of reference with exceptions: the width that costs least; wider values add their high part at the end."""
    if not values:
        return b""
    widths = sorted(x.bit_length() for x in values)
    cost = lambda w: len(values) * w + sum(x.bit_length() - w + 12 for x in values if x.bit_length() > w)
    width = min(set(widths), key=lambda w: (cost(w), w))
    wide = [(i, x >> width) for i, x in enumerate(values) if x.bit_length() > width]
    bits = Bits()
    bits.put(width, 6)
    bits.put(len(wide), 16)
    for x in values:
        bits.put(x & (1 << width) - 1, width)
    last = -1
    for i, high in wide:
        _put_gamma(bits, i - last - 1)
        _put_gamma(bits, high - 1)
        last = i
    return bits.bytes()


def from_patched(data: bytes, n: int) -> list[int]:
    if not n:
        return []
    bits = Bits(data)
    width, wide = bits.take(6), bits.take(16)
    out = [bits.take(width) for _ in range(n)]
    last = -1
    for _ in range(wide):
        last += _take_gamma(bits) + 1
        out[last] |= _take_gamma(bits) + 1 << width
    return out


@dataclass(frozen=True)
class Codec:
    encode: Callable[[list[int]], bytes]
    decode: Callable[[bytes, int], list[int]]


CODECS = {
    "vbyte": Codec(vbyte, from_vbyte),
    "interpolative": Codec(interpolative, from_interpolative),
    "gamma": Codec(*_bitwise(_put_gamma, _take_gamma)),
    "delta": Codec(*_bitwise(_put_delta, _take_delta)),
    "raw": Codec(raw, from_raw),
    "simple9": Codec(simple9, from_simple9),
    "group_of_eight": Codec(group_of_eight, from_group_of_eight),
    "patched": Codec(patched, from_patched),
}


def coded(values: Column, codec: str) -> Column:
    """array<bigint> -> binary."""
    encode = CODECS[codec].encode

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else encode([int(x) for x in r]))

    return run(values)


def decoded(data: Column, n: Column, codec: str) -> Column:
    """binary and the number of values -> array<bigint>."""
    decode = CODECS[codec].decode

    @F.pandas_udf("array<bigint>")
    def run(rows: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else decode(bytes(r), int(k)) for r, k in zip(rows, counts, strict=True)])

    return run(data, n)
