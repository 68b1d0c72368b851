"""Internal keys: ``user_key`` followed by eight little-endian bytes of ``sequence << 8 | value_type``.

Python functions serve the file formats, Column functions the DataFrames. Internal keys sort by user key
ascending, then sequence and type descending; DataFrames sort on the three columns, since the packed
trailer doesn't fit a signed long.
"""

from functools import cmp_to_key

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CorruptionError
from ..schema import FOR_SEEK, MAX_SEQUENCE, ValueType
from .coding import fixed64, read_fixed64

TRAILER_BYTES = 8


def pack_trailer(sequence: int, value_type: int) -> int:
    if not 0 <= sequence <= MAX_SEQUENCE:
        raise ValueError(f"sequence out of range: {sequence}")
    return sequence << 8 | int(value_type)


def encode(user_key: bytes, sequence: int, value_type: int) -> bytes:
    return bytes(user_key) + fixed64(pack_trailer(sequence, value_type))


def decode(internal: bytes) -> tuple[bytes, int, ValueType]:
    if len(internal) < TRAILER_BYTES:
        raise CorruptionError("internal key is too short", 0, TRAILER_BYTES, len(internal))
    trailer = read_fixed64(internal, len(internal) - TRAILER_BYTES)
    return internal[:-TRAILER_BYTES], trailer >> 8, ValueType.from_code(trailer & 0xFF)


def seek_key(user_key: bytes) -> bytes:
    """The internal key that sorts before every stored version of ``user_key``."""
    return encode(user_key, MAX_SEQUENCE, FOR_SEEK)


def compare(a: bytes, b: bytes) -> int:
    """Unsigned bytewise order, a shorter prefix first."""
    return (a > b) - (a < b)


def compare_internal(a: bytes, b: bytes) -> int:
    for key in (a, b):
        if len(key) < TRAILER_BYTES:
            raise ValueError("internal key is too short")
    return compare(a[:-8], b[:-8]) or (read_fixed64(b, len(b) - 8) > read_fixed64(a, len(a) - 8)) - (read_fixed64(b, len(b) - 8) < read_fixed64(a, len(a) - 8))


#: Sort key for internal keys held in Python.
internal_order = cmp_to_key(compare_internal)


def _byte(value: Column, k: int) -> Column:
    return F.lpad(F.hex(F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0")


def fixed64_hex(value: Column) -> Column:
    return F.concat(*[_byte(value, k) for k in range(8)])


def fixed32_hex(value: Column) -> Column:
    return F.concat(*[_byte(value, k) for k in range(4)])


def read_fixed(data: Column, width: int, at=1) -> Column:
    """A little-endian integer of ``width`` bytes at the 1-based position ``at`` of a binary column."""
    out = F.lit(0).cast("long")
    for k in range(width):
        byte = F.conv(F.hex(F.substring(data, F.lit(at) + k if isinstance(at, Column) else F.lit(at + k), F.lit(1))), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * k))
    return out


def trailer_column(sequence: Column, value_type: Column) -> Column:
    return F.shiftleft(sequence, 8).bitwiseOR(value_type.cast("long"))


def encode_column(user_key: Column, sequence: Column, value_type: Column) -> Column:
    return F.concat(user_key, F.unhex(fixed64_hex(trailer_column(sequence, value_type))))


def decode_columns(internal: Column) -> tuple[Column, Column, Column]:
    """User key, sequence and type of an encoded column; too short or unknown types raise."""
    size = F.length(internal)
    short = F.raise_error(F.lit("internal key is too short"))
    trailer = read_fixed(internal, 8, size - 7)
    kind = trailer.bitwiseAND(F.lit(255).cast("long"))
    return (
        F.when(size < 8, short.cast("binary")).otherwise(F.substring(internal, F.lit(1), size - 8)),
        F.shiftrightunsigned(trailer, 8),
        F.when(kind.isin(0, 1), kind.cast("byte")).otherwise(F.raise_error(F.lit("unknown value type")).cast("byte")),
    )


def varint_size_column(value: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes that two binary columns share."""
    ha, hb = F.hex(a), F.hex(b)
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(ha, i * 2 - 1, F.lit(2)) != F.substring(hb, i * 2 - 1, F.lit(2)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n)).cast("int")
