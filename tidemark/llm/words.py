"""Words of texts by arrays: splitting and hashing without a loop over words."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE_BYTES, mix

_SPACE = bytes(x in SPACE_BYTES for x in range(256))
_FIND_SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 16
#: Bytes of text that are split at once, unless one text is longer.
TEXT_BYTES = 1 << 20
#: Which of eight bytes count, by how many are left of a word; the first byte is the lowest.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def split(data: bytes, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where each begins and ends; words are parted by ASCII white space.

    Words are taken in eight bytes at a time, all words at once; only those that are longer go on. Long texts go by
    pieces that end at white space.
    """
    hashes, begins, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        space = _FIND_SPACE.search(data, at + piece)
        to = space.start() if space else len(data)
        part = data[at:to]
        edges = np.flatnonzero(np.diff(np.frombuffer(part.translate(_SPACE), bool), prepend=True, append=True))
        first, last = edges[::2], edges[1::2]
        begins.append(first + at)
        ends.append(last + at)
        # Eight bytes from any place on.
        eight = np.ndarray(len(part) + 1, "<u8", part + bytes(8), strides=(1,))
        left = last - first
        h, own = left.astype(np.uint64) * _ODD, np.arange(len(left))
        while len(left):
            more = (h[own] ^ (eight[first] & _MASKS[np.minimum(left, 8)])) * _ODD
            h[own] = more ^ (more >> _32)
            on = np.flatnonzero(left > 8)
            own, first, left = own[on], first[on] + 8, left[on] - 8
        hashes.append(mix(h))
        at = to
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def parts(column: pa.Array):
    """(first row, texts in UTF-8, null being empty) for runs of a column's rows of a bounded size."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT_BYTES, "right")) - 1)
        yield at, [t or b"" for t in column.slice(at, to - at).cast(pa.binary()).to_pylist()]
        at = to
