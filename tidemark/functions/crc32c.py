"""CRC-32C as a column function; Spark only has the IEEE polynomial built in."""

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .coding import CRC_TABLE

_TABLE = np.array(CRC_TABLE, dtype=np.uint32)


def crc32c_batch(values: list[bytes]) -> np.ndarray:
    """Checksums of many values at once: one table lookup per byte position over all values still that long."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    alive = len(values)
    for k in range(int(left[0]) if alive else 0):
        alive = int(np.searchsorted(-left[:alive], -k, side="left"))
        crc[:alive] = crc[:alive] >> 8 ^ _TABLE[(crc[:alive] ^ data[starts[:alive] + k]) & 0xFF]
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@pandas_udf(LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C of a binary column as an unsigned value in a long; null for null."""
    known = values.notna()
    out = pd.Series([None] * len(values), dtype="Int64")
    out[known.to_numpy()] = crc32c_batch([bytes(v) for v in values[known]])
    return out
