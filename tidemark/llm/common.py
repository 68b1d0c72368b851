"""What the operators share: written intermediate tables, word hashing, batch helpers."""

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import new_path

# The white space of all contracts, as a class for Java and DuckDB patterns and as bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Has Spark remove a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the batches that tasks hand to Python, which stand in the JVM and in Python; a batch ends with the row that reaches it.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


@contextmanager
def setting(spark: SparkSession, key: str, value: str, default: str | None = None):
    """Has ``key`` set while the block runs, then as it was; ``default`` is for keys that may not be set."""
    before = spark.conf.get(key, default) if default is not None else spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a table that runs all its steps before it returns, with batches of ``BATCH_BYTES``."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with setting(docs.sparkSession, BATCH, f"{BATCH_BYTES}b"):
            return operator(docs, *args, **kwargs)

    return run


class Scratch:
    """Tables that an operator writes to the shared folder, so that lost executors cost no more than a stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with setting(self.spark, CLEANUP, "true", "false"):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def drop(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        files, folder = self._folder(f"{self.root}/{name}")
        files.delete(folder, True)

    def last(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes what the operator returns and removes all its other tables."""
        out = self.keep(df, name)
        files, folder = self._folder(self.root)
        for other in files.listStatus(folder):
            if other.getPath().getName() != name:
                files.delete(other.getPath(), True)
        return out


def mapped(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict | Iterator[dict] | None]]) -> DataFrame:
    """``df`` through a function of batches that is made anew in each task, and gives none, one or several. A dict of columns takes its types from the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = f(b)
            for part in (out,) if isinstance(out, dict | pa.RecordBatch) else out or ():
                yield record(part, arrow)
        end = getattr(f, "end", None)
        if end is not None:
            for out in end():
                yield record(out, arrow)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that a task has freed back to the system; Spark keeps the process for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` written once with a row id, and that column's name.

    Spark plans each scan for the cores present, so ids given by two jobs need not agree; all jobs have to read this table.
    """
    own = unused(docs, "own_row")
    return scratch.keep(docs.withColumn(own, F.monotonically_increasing_id()), "numbered"), own


def without_rows(docs: DataFrame, own: str, dropped: DataFrame) -> DataFrame:
    """``docs``, numbered in column ``own``, without the rows that ``dropped`` (column row) holds and without the numbers."""
    other = own + "_dropped"
    return docs.join(dropped.select(F.col("row").alias(other)), F.col(own) == F.col(other), "left_anti").drop(own)


# Odd multipliers of the splitmix64 finaliser (fixed values).
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = x + _M1
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; of fewer words, one hash of the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        acc = (acc + hashes[j : n - width + 1 + j]) * _M2
        acc ^= acc >> _S31
    return np.unique(mix(acc))
