"""Byte codecs shared by the file formats: fixed-width and variable-length integers, CRC-32C."""

import struct

from ..errors import CorruptionError

_F32, _F64 = struct.Struct("<I"), struct.Struct("<Q")
MAX_VARINT_BYTES = 10


def fixed32(value: int) -> bytes:
    return _F32.pack(value & 0xFFFFFFFF)


def fixed64(value: int) -> bytes:
    return _F64.pack(value & 0xFFFFFFFFFFFFFFFF)


def read_fixed32(data: bytes, at: int = 0) -> int:
    if at < 0 or at + 4 > len(data):
        raise CorruptionError("fixed32 runs past the end", at, 4, len(data) - at)
    return _F32.unpack_from(data, at)[0]


def read_fixed64(data: bytes, at: int = 0) -> int:
    if at < 0 or at + 8 > len(data):
        raise CorruptionError("fixed64 runs past the end", at, 8, len(data) - at)
    return _F64.unpack_from(data, at)[0]


def varint_size(value: int) -> int:
    return max(1, -(-(value & 0xFFFFFFFFFFFFFFFF).bit_length() // 7))


def varint(value: int) -> bytes:
    value &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value and the offset behind it."""
    value = 0
    for k in range(MAX_VARINT_BYTES):
        if at + k >= len(data):
            raise CorruptionError("varint is cut off", at, "a last byte", "end of data")
        byte = data[at + k]
        value |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            if value >> 64:
                raise CorruptionError("varint exceeds 64 bits", at, "64 bits", value.bit_length())
            return value, at + k + 1
    raise CorruptionError("varint is too long", at, MAX_VARINT_BYTES, "more bytes")


def _table(polynomial: int = 0x82F63B78) -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (polynomial if n & 1 else 0)
        out.append(n)
    return out


#: Generated from the reflected Castagnoli polynomial.
CRC_TABLE = _table()


def crc32c(data: bytes, start: int = 0) -> int:
    crc, table = start ^ 0xFFFFFFFF, CRC_TABLE
    for byte in data:
        crc = crc >> 8 ^ table[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF
