"""Variable-byte codec: 7 bits a byte, most significant group first, the high bit set on all bytes but the last.

varbyte_length and varbyte_hex of one number are built-in expressions; lists are
encoded and decoded by whole Arrow batches, as built-in expressions take some
hundred steps a number. encode and decode do a few numbers in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


def varbyte_length(n: Column) -> Column:
    """Bytes that a number of 0 to 2**35 - 1 takes."""
    size = F.lit(5)
    for k in (4, 3, 2, 1):
        size = F.when(n < F.lit(1 << (7 * k)), F.lit(k)).otherwise(size)
    return F.when(n.isNotNull(), size).cast("bigint")


def varbyte_hex(n: Column) -> Column:
    """The bytes of one number in hex."""
    groups = F.filter(F.array(*[F.lit(k) for k in (4, 3, 2, 1, 0)]), lambda k: (k == 0) | (F.shiftright(n, 7 * 4) > 0) & (k <= 4) | (k <= 3) & (n >= (1 << 21)) | (k <= 2) & (n >= (1 << 14)) | (k <= 1) & (n >= (1 << 7)))
    power = lambda k: F.element_at(F.array(*[F.lit(1 << (7 * i)).cast("bigint") for i in range(5)]), k + 1)
    byte = lambda k: F.floor(n / power(k)).cast("bigint").bitwiseAND(F.lit(127)).bitwiseOR(F.when(k == 0, F.lit(0)).otherwise(F.lit(128)))
    return F.lower(F.array_join(F.transform(groups, lambda k: F.lpad(F.hex(byte(k)), 2, "0")), ""))


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists) if pa.types.is_list(lists.type) else pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _valid(of: pa.Array) -> pa.Buffer | None:
    return pa.py_buffer(np.packbits(pc.is_valid(of).to_numpy(zero_copy_only=False), bitorder="little")) if of.null_count else None


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of an array of lists, and how many each list has; nulls among them are left out."""
    flat, counts = lists.flatten(), _counts(lists)
    if flat.null_count:
        there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        counts, flat = np.diff(_offsets(there)[_offsets(counts)]), flat.drop_null()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64), counts


def raw_bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binaries or strings, and the places at which each begins, with the end."""
    at, size = data.offset, len(data)
    offsets = np.frombuffer(data.buffers()[1], np.int32, size + 1, at * 4).astype(np.int64) if size else np.zeros(1, np.int64)
    whole = data.buffers()[2]
    return (np.frombuffer(whole, np.uint8) if whole else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [_valid(like), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def lists(numbers: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    flat = pa.array(numbers, pa.int64())
    return pa.Array.from_buffers(pa.list_(pa.int64()), len(offsets) - 1, [_valid(like), pa.py_buffer(offsets.astype(np.int32))], children=[flat])


def lengths(numbers: np.ndarray) -> np.ndarray:
    """varbyte_length() of an array."""
    return 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3, 4))


def put(data: np.ndarray, ends: np.ndarray, numbers: np.ndarray, size: np.ndarray) -> None:
    """Write the codes of ``numbers``, ``size`` bytes each, before ``ends``."""
    data[ends - 1] = numbers & 127
    for k in range(1, int(size.max(initial=1))):
        more = size > k
        data[ends[more] - 1 - k] = numbers[more] >> 7 * k & 127 | 128


def taken(data: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers whose codes of ``size`` bytes end before ``ends``."""
    out = data[ends - 1].astype(np.int64) & 127
    for k in range(1, int(size.max(initial=1))):
        more = size > k
        out[more] |= (data[ends[more] - 1 - k].astype(np.int64) & 127) << 7 * k
    return out


@F.arrow_udf(BinaryType())
def _varbyte_encode(numbers: pa.Array) -> pa.Array:
    flat, counts = _numbers(numbers)
    size = lengths(flat)
    ends = _offsets(size)
    data = np.zeros(ends[-1], np.uint8)
    put(data, ends[1:], flat, size)
    return binaries(data, ends[_offsets(counts)], numbers)


@F.arrow_udf(ArrayType(LongType()))
def _varbyte_decode(data: pa.Array) -> pa.Array:
    raw, offsets = raw_bytes(data)
    last = raw < 128
    if not last[offsets[1:][np.diff(offsets) > 0] - 1].all():
        raise ValueError("varbyte data ends within a number")
    ends = np.flatnonzero(last) + 1
    return lists(taken(raw, ends, np.diff(ends, prepend=0)), np.searchsorted(ends, offsets, "right"), data)


def varbyte_encode(numbers: Column) -> Column:
    """Bytes of an array of numbers, one after the other."""
    return _varbyte_encode(numbers)


def varbyte_decode(data: Column) -> Column:
    """The array of numbers that ``data`` holds; fails if the last one isn't ended. Time is linear in the length."""
    return _varbyte_decode(data)


@F.arrow_udf(ArrayType(LongType()))
def running(numbers: pa.Array) -> pa.Array:
    """The sums of each list up to and with each number."""
    flat, counts = _numbers(numbers)
    sums, offsets = _offsets(flat), _offsets(counts)
    return lists(sums[1:] - np.repeat(sums[offsets[:-1]], counts), offsets, numbers)


@dataclass(frozen=True)
class Codec:
    """How a list of numbers becomes bytes: expressions for its length of one number, and for both ways."""

    name: str
    length: Callable[[Column], Column]
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


@F.arrow_udf(BinaryType())
def _fixed_encode(numbers: pa.Array) -> pa.Array:
    flat, counts = _numbers(numbers)
    return binaries(np.ascontiguousarray(flat.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:]).reshape(-1), 5 * _offsets(counts), numbers)


@F.arrow_udf(ArrayType(LongType()))
def _fixed_decode(data: pa.Array) -> pa.Array:
    raw, offsets = raw_bytes(data)
    sizes = np.diff(offsets)
    if (sizes % 5).any():  # what is over at an end is no number
        raw = raw[np.arange(len(raw)) - np.repeat(offsets[:-1], sizes) < np.repeat(sizes // 5 * 5, sizes)]
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, 3:] = raw.reshape(-1, 5)
    return lists(wide.view(">i8").reshape(-1).astype(np.int64), _offsets(sizes // 5), data)


VARBYTE = Codec("varbyte", varbyte_length, varbyte_encode, varbyte_decode)
#: Five bytes a number, for lists that are read at random places.
FIXED = Codec("fixed", lambda n: F.when(n.isNotNull(), F.lit(5)).cast("bigint"), _fixed_encode, _fixed_decode)
CODECS = {c.name: c for c in (VARBYTE, FIXED)}


def encode(numbers: Iterable[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        if not 0 <= n < 1 << 35:
            raise ValueError(f"{n} can't be encoded")
        groups = [n & 127]
        while n := n >> 7:
            groups.append(n & 127 | 128)
        out += bytes(reversed(groups))
    return bytes(out)


def decode(data: bytes, at: int = 0, count: int | None = None) -> tuple[list[int], int]:
    """(numbers, place after them); all of ``data`` without ``count``. A number that isn't ended raises."""
    out: list[int] = []
    while len(out) < count if count is not None else at < len(data):
        n = 0
        while True:
            if at >= len(data):
                raise ValueError("varbyte data ends within a number")
            b = data[at]
            at += 1
            n = n << 7 | b & 127
            if b < 128:
                break
        out.append(n)
    return out, at
