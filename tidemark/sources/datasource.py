"""Both file formats as Spark data sources, one partition a file, with key ranges pushed into sorted tables.

``register(spark)`` makes ``tidemark_wal`` and ``tidemark_sst`` known. Paths are directories or files that
pyarrow's file systems reach. A writer's files appear when the job commits: tasks write under unique names
and the commit renames them, so lost executors and retried tasks leave nothing visible.
"""

import os
import posixpath
import uuid
from dataclasses import dataclass
from itertools import batched, chain

from pyarrow.fs import LocalFileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import keys
from . import sst, wal

BATCH_ROWS = 8192
SCHEMA = "user_key binary, sequence bigint, value_type tinyint, value binary"


def file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def listing(path: str, suffix: str) -> list[str]:
    from pyarrow import fs

    files, root = file_system(path)
    if files.get_file_info(root).type == fs.FileType.File:
        return [root]
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(suffix))


@dataclass
class FilePartition(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options):
        self.root = options["path"]
        self.policy = wal.RecoveryPolicy(options.get("recovery", "truncate"))
        self.low, self.high = None, None  # inclusive bounds on the user key

    def partitions(self):
        return [FilePartition(p) for p in listing(self.root, self.suffix)] or [FilePartition("")]


def batches(mutations):
    """Mutations as Arrow batches of a bounded number of rows."""
    import pyarrow as pa

    schema = pa.schema([("user_key", pa.binary()), ("sequence", pa.int64()), ("value_type", pa.int8()), ("value", pa.binary())])
    for rows in batched(mutations, BATCH_ROWS):
        key, sequence, kind, value = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(sequence, pa.int64()), pa.array(map(int, kind), pa.int8()), pa.array(value, pa.binary())], schema=schema)


class WalReader(_Reader):
    suffix = ".wal"

    def read(self, partition):
        if not partition.path:
            return
        files, _ = file_system(self.root)
        with files.open_input_file(partition.path) as f:
            yield from batches(map(wal.decode_mutation, wal.streamed(f.read, self.policy)))


class SstReader(_Reader):
    suffix = ".sst"

    def pushFilters(self, filters):
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("user_key",) and isinstance(value, bytes | bytearray):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low or b"", bytes(value))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = bytes(value) if self.high is None else min(self.high, bytes(value))
            yield f  # bounds here are inclusive; Spark filters exactly

    def read(self, partition):
        if not partition.path:
            return
        files, _ = file_system(self.root)
        with files.open_input_file(partition.path) as f:
            table = sst.Table(read=lambda offset, n: f.read_at(n, offset), size=f.size())
            yield from batches(self.inside(table))

    def inside(self, table):
        for internal, value in table.entries() if self.low is None else table.seek(keys.seek_key(self.low)):
            key, sequence, kind = keys.decode(internal)
            if self.high is not None and key > self.high:
                return
            yield key, sequence, kind, value


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite, self.kind = options["path"], overwrite, options["kind"]

    def write(self, rows):
        from pyspark import TaskContext

        mutations = ((bytes(r[0]), int(r[1]), int(r[2]), bytes(r[3])) for r in rows)
        first = next(mutations, None)
        if first is None and self.kind == "wal":
            return Written([])
        mutations = chain([first] if first else [], mutations)
        if self.kind == "wal":
            pieces = wal.pieces(wal.encode_mutation(*m) for m in mutations)
        else:
            pieces = sst.pieces((keys.encode(k, s, t), v) for k, s, t, v in mutations)

        files, root = file_system(self.root)
        files.create_dir(root, recursive=True)
        place = TaskContext.get().partitionId()
        temporary = f"{root}/{place:010d}-{uuid.uuid4().hex}.{self.kind}.tmp"
        with files.open_output_stream(temporary) as out:
            for piece in pieces:
                out.write(piece)
        if isinstance(files, LocalFileSystem):  # other file systems make a closed file durable
            fd = os.open(temporary, os.O_RDONLY)
            try:
                os.fsync(fd)
            finally:
                os.close(fd)
        return Written([temporary])

    def commit(self, messages):
        files, _ = file_system(self.root)
        before = listing(self.root, f".{self.kind}") if self.overwrite else []
        for message in messages:
            for path in message.paths if message else ():
                files.move(path, path.removesuffix(".tmp"))
        # What is overwritten goes last, so that a commit cut short loses nothing.
        for old in before:
            files.delete_file(old)

    def abort(self, messages):
        files, _ = file_system(self.root)
        for message in messages:
            for path in message.paths if message else ():
                files.delete_file(path)


class _Source(DataSource):
    kind, reader_class = "", None

    @classmethod
    def name(cls):
        return f"tidemark_{cls.kind}"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return self.reader_class(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer({**dict(self.options), "kind": self.kind}, overwrite)


class WalSource(_Source):
    kind, reader_class = "wal", WalReader


class SstSource(_Source):
    """Rows have to come sorted by internal key within each partition, as ``write_sst`` sorts them."""

    kind, reader_class = "sst", SstReader


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalSource)
    spark.dataSource.register(SstSource)


def write_wal(mutations, path: str) -> None:
    """Segments in sequence order: range-partitioned, so that a segment's sequences precede the next one's."""
    register(mutations.sparkSession)
    columns = ["user_key", "sequence", "value_type", "value"]
    mutations.select(*columns).repartitionByRange("sequence").sortWithinPartitions("sequence").write.format("tidemark_wal").mode("append").save(path)


def write_sst(mutations, path: str) -> None:
    """Tables with disjoint user-key ranges, each in internal order."""
    from pyspark.sql import functions as F

    register(mutations.sparkSession)
    columns = ["user_key", "sequence", "value_type", "value"]
    placed = mutations.select(*columns).repartitionByRange("user_key")
    placed.sortWithinPartitions("user_key", F.desc("sequence"), F.desc("value_type")).write.format("tidemark_sst").mode("append").save(path)
