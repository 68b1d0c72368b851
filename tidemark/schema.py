"""The data model: an append-only log of mutations and the live view derived from it."""

from enum import Enum, IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
MAX_SEQUENCE = (1 << 56) - 1
DEFAULT_WRITE_BUFFER_BYTES = 4 * 1024 * 1024
COMPARATOR_NAME = "bytewise"


class ValueType(IntEnum):
    """Kind of a mutation. Codes 2 to 254 are reserved and 255 is illegal."""

    DELETE = 0
    PUT = 1

    @classmethod
    def from_code(cls, code: int) -> "ValueType":
        from .errors import CorruptionError

        try:
            return cls(code)
        except ValueError:
            raise CorruptionError("unknown value type", 0, "0 or 1", code) from None


#: A seek looks for the newest version, and of equal sequences PUT sorts first.
FOR_SEEK = ValueType.PUT


class Durability(Enum):
    """When a write is acknowledged. A caller always has to choose."""

    NONE = "none"
    SYNC = "sync"
    GROUP = "group"


MUTATIONS = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("sequence", T.LongType(), False),
        T.StructField("value_type", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)
LIVE = T.StructType([T.StructField("user_key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])


def is_put() -> Column:
    return F.col("value_type") == int(ValueType.PUT)


def checked(df: DataFrame) -> DataFrame:
    """``df`` with every mutation validated as it is read: nulls, sequence range, value type."""
    bad = (
        F.col("user_key").isNull()
        | F.col("value").isNull()
        | F.col("sequence").isNull()
        | ~F.col("sequence").between(0, MAX_SEQUENCE)
        | F.col("value_type").isNull()
        | ~F.col("value_type").isin(0, 1)
    )
    fail = F.raise_error(F.concat(F.lit("invalid mutation at sequence "), F.coalesce(F.col("sequence").cast("string"), F.lit("null"))))
    return df.withColumn("user_key", F.when(bad, fail.cast("binary")).otherwise(F.col("user_key")))


def from_events(events: DataFrame) -> DataFrame:
    """The mutation log that the ``events`` table stands for."""
    deleted = F.col("event_type") == "error"
    return events.select(
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("user_key"),
        (F.col("event_id") + 1).alias("sequence"),
        F.when(deleted, 0).otherwise(1).cast("byte").alias("value_type"),
        F.when(deleted, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode("props", "UTF-8")).alias("value"),
    )
