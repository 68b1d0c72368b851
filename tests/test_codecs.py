import io
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.errors import CorruptionError
from tidemark.functions import coding, keys
from tidemark.functions.crc32c import crc32c_batch
from tidemark.schema import MAX_SEQUENCE, ValueType
from tidemark.sources import sst, wal

GOLDEN_WAL = bytes.fromhex("4c4157656c61685301000000" "00000000" "f327f3cc0e00010b6b657901010000000000000176")
GOLDEN_SST = bytes.fromhex(
    "00090161010100000000000031000902620102000000000000323200000000010000000049a62da2"
    "0000000001000000000f07f483000902620102000000000000002300000000010000000002e84f44"
    "28083516000000000000000000000000000000000000000000000000000000000000000000000000"
    "01000000545353656c616853"
)


def test_fixed_vectors():
    assert keys.compare(b"\x80", b"\x7f") > 0 > keys.compare(b"\1\2", b"\1\2\3")
    assert keys.encode(b"key", 5, ValueType.PUT) == bytes.fromhex("6B65790105000000000000")
    assert keys.decode(keys.encode(b"\1\2\3", 42, ValueType.DELETE)) == (b"\1\2\3", 42, ValueType.DELETE)
    assert coding.varint(300) == b"\xac\x02"
    assert [coding.varint_size(n) for n in (0, 127, 128, 300, 2**64 - 1)] == [1, 1, 2, 2, 10]
    assert coding.crc32c(b"123456789") == 0xE3069283
    assert list(crc32c_batch([b"", b"123456789", b"a"])) == [coding.crc32c(x) for x in (b"", b"123456789", b"a")]


def test_bad_codes():
    with pytest.raises(ValueError):
        keys.encode(b"k", MAX_SEQUENCE + 1, 1)
    for bad in (lambda: keys.decode(b"abc"), lambda: keys.decode(b"k" + bytes([7]) * 8), lambda: coding.read_varint(b"\x80"), lambda: coding.read_varint(b"\x80" * 11), lambda: coding.read_fixed64(b"1234567")):
        with pytest.raises(CorruptionError):
            bad()


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(n):
    assert coding.read_varint(coding.varint(n)) == (n, coding.varint_size(n))


@given(st.lists(st.tuples(st.binary(max_size=4), st.integers(0, 50), st.integers(0, 1))))
def test_internal_order(items):
    got = sorted((keys.encode(*x) for x in items), key=keys.internal_order)
    assert [keys.decode(x) for x in got] == sorted(((k, s, ValueType(t)) for k, s, t in items), key=lambda x: (x[0], -x[1], -x[2]))


def test_golden_files():
    assert wal.encode_segment([(b"key", 1, 1, b"v")]) == GOLDEN_WAL
    assert wal.decode_segment(GOLDEN_WAL, wal.RecoveryPolicy.STRICT) == [(b"key", 1, ValueType.PUT, b"v")]
    entries = [(keys.encode(b"a", 1, 1), b"1"), (keys.encode(b"b", 2, 1), b"22")]
    assert sst.build(entries) == GOLDEN_SST
    assert list(sst.Table(GOLDEN_SST).entries()) == entries


def test_wal_records_of_all_sizes():
    big = bytes((i * 31 + 7) & 255 for i in range(2 * 32768 + 100))
    for payloads in ([b"a", b"bb", b"ccc"], [b"head", big, b"tail"], [b"x" * (32768 - 7 - 7), b"y"], [b""], [b"x" * n for n in range(32750, 32775)]):
        assert list(wal.records(wal.build(payloads), wal.RecoveryPolicy.STRICT)) == payloads


def test_wal_is_read_by_pieces(monkeypatch):
    """Neither the end of a segment nor damage is missed at the edge of a piece."""
    monkeypatch.setattr(wal, "crc32c_batch", lambda values: np.array([zlib.crc32(v) for v in values], np.int64))  # for speed
    block = wal.BLOCK_BYTES
    payloads = [b"a" * 20_000, b"b" * 100_000, b"", b"c" * (2 * block), b"d" * 12_000]
    data = wal.build(payloads)
    for n in {*range(0, len(data), 9_973), *(wal.HEADER_BYTES + k * block + d for k in range(8) for d in (-8, -7, -1, 0, 1, 7, 8))}:
        some = data[: max(0, n)]
        for policy in wal.RecoveryPolicy:
            got = []
            for piece in (block, 3 * block, wal.PIECE_BYTES):
                short = io.BytesIO(some)
                try:
                    got.append(list(wal.streamed(lambda k, f=short: f.read(min(k, 5000)), policy, piece)))
                except CorruptionError as e:
                    got.append(str(e))
            assert got[0] == got[1] == got[2]
    bad = bytearray(data)
    bad[wal.HEADER_BYTES + 5 * block + 99] ^= 1
    seen = []
    with pytest.raises(CorruptionError, match="checksum"):
        seen.extend(wal.streamed(io.BytesIO(bytes(bad)).read, piece_bytes=block))
    with pytest.raises(ValueError):
        list(wal.streamed(io.BytesIO(data).read, piece_bytes=100))


def test_wal_source_never_reads_a_whole_segment(tmp_path, monkeypatch):
    from tidemark.sources import datasource

    (tmp_path / "1.wal").write_bytes(wal.encode_segment((b"k%d" % k, k, 1, b"v" * 50) for k in range(120_000)))
    sizes, crc = [], wal.crc32c_batch
    monkeypatch.setattr(wal, "crc32c_batch", lambda values: sizes.append(sum(map(len, values))) or crc(values))
    reader = datasource.WalReader({"path": str(tmp_path)})
    (partition,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(partition)) == 120_000
    assert len(sizes) > 1 and max(sizes) <= 4 << 20


def test_wal_cut_anywhere_leaves_a_prefix():
    payloads = [b"one", b"two" * 9, b"three"]
    data = wal.build(payloads)
    for n in range(len(data) + 1):
        got = list(wal.records(data[:n]))
        assert got == payloads[: len(got)]
        whole = n in (0, *(len(wal.build(payloads[:k])) for k in range(4)))
        if not whole:
            with pytest.raises(CorruptionError):
                list(wal.records(data[:n], wal.RecoveryPolicy.STRICT))


def test_wal_every_bit_flip_is_found_or_only_shortens():
    payloads = [b"one", b"two", b"three"]
    data = wal.build(payloads)
    for at in range(len(data)):
        for bit in range(8):
            bad = bytearray(data)
            bad[at] ^= 1 << bit
            try:
                got = list(wal.records(bytes(bad)))
            except CorruptionError:
                continue
            assert got == payloads[: len(got)]
    zero_type = bytearray(data)
    zero_type[wal.HEADER_BYTES + 6] = 0
    with pytest.raises(CorruptionError):
        list(wal.records(bytes(zero_type)))


def test_block_vectors():
    b = sst.BlockBuilder()
    b.add(b"apple", b"1"), b.add(b"apply", b"2")
    assert b.finish() == b"\0\5\1apple1" + b"\4\1\1y2" + bytes(4) + b"\1\0\0\0"
    b = sst.BlockBuilder()
    for k in range(17):
        b.add(b"k%03d" % k, b"")
    assert b.finish()[-4:] == b"\2\0\0\0"
    assert sst.BlockBuilder().finish() == bytes.fromhex("0000000001000000")
    for bad in (b"\0\0", bytes.fromhex("00000000E8030000")):
        with pytest.raises(CorruptionError):
            sst.Block(bad)
    assert sst.read_handle(sst.handle(300, 42)) == ((300, 42), 3)


def _table(n):
    return [(keys.encode(b"key%05d" % i, i + 1, 1), bytes((i + j) & 255 for j in range(64))) for i in range(n)]


def test_table_seek():
    entries = _table(300)
    table = sst.Table(sst.build(entries))
    assert len(table.index) > 1 and list(table.entries()) == entries
    for i in (0, 1, 17, 150, 299):
        assert table.ceiling(keys.seek_key(b"key%05d" % i)) == entries[i]
        assert list(table.seek(keys.seek_key(b"key%05d" % i))) == entries[i:]
    assert table.ceiling(keys.seek_key(b"key00005x")) == entries[6]
    assert table.ceiling(keys.seek_key(b"z")) is None
    with pytest.raises(ValueError):
        sst.build(entries[::-1])


def test_table_inverted_bytes_are_found_or_harmless():
    entries = _table(5)
    data = sst.build(entries)
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 255
        try:
            got = list(sst.Table(bytes(bad)).entries())
        except CorruptionError:
            continue
        assert got == entries
    for n in range(0, len(data), 7):
        with pytest.raises(CorruptionError):
            list(sst.Table(data[:n]).entries())
