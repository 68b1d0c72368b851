"""A durable store: sorted Parquet runs, a small log for single writes, and a manifest naming what is current.

Batches become runs by one distributed job. Single writes go to a log segment and to a buffer on the driver
that never exceeds ``write_buffer_bytes``; reaching it turns the buffer into a run. A run is installed by
replacing the manifest, so readers see all of it or nothing, and a log segment goes only after that.
"""

import json
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineStateError, StorageError
from ..schema import COMPARATOR_NAME, DEFAULT_WRITE_BUFFER_BYTES, MUTATIONS, Durability, ValueType, checked
from ..sources import wal
from ..sources.datasource import file_system, listing
from . import reconcile
from .sequence import stamp


class SystemClock:
    """Time as the store sees it; tests pass their own."""

    def nano_time(self) -> int:
        return time.monotonic_ns()

    def epoch_millis(self) -> int:
        return time.time_ns() // 1_000_000


class Metrics:
    """A sink for counters, gauges and histograms; this one drops them."""

    def increment(self, name: str, by: int = 1) -> None: ...

    def gauge(self, name: str, value: float) -> None: ...

    def record(self, name: str, value: float) -> None: ...


class MemoryMetrics(Metrics):
    def __init__(self):
        self.counters, self.gauges, self.histograms = {}, {}, {}

    def increment(self, name, by=1):
        self.counters[name] = self.counters.get(name, 0) + by

    def gauge(self, name, value):
        self.gauges[name] = value

    def record(self, name, value):
        self.histograms.setdefault(name, []).append(value)


class Cursor:
    """Forward-only iteration over a scan, fetched partition by partition."""

    def __init__(self, rows: DataFrame):
        self._rows = rows.toLocalIterator(prefetchPartitions=True)
        self._row = next(self._rows, None)

    def is_valid(self) -> bool:
        return self._row is not None

    def next(self) -> None:
        if self._row is not None:
            self._row = next(self._rows, None)

    def key(self) -> bytes:
        return bytes(self._current().user_key)

    def value(self) -> bytes:
        return bytes(self._current().value)

    def _current(self):
        if self._row is None:
            raise IndexError("the cursor is past its end")
        return self._row

    def close(self) -> None:
        self._row, self._rows = None, iter(())

    def __iter__(self):
        while self.is_valid():
            yield self.key(), self.value()
            self.next()


def synced(path: str) -> None:
    """Makes a local file or folder durable; other file systems do so when a file is closed."""
    if os.path.exists(path):
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)


#: Seconds for which runs that a compaction replaced stay, for the DataFrames that read them.
RETIRED_SECONDS = 86_400


class Store:
    """Opened by ``Store.open``. DataFrames handed out keep the view they were made from.

    One writer at a time: writes of one store object take turns, and opening a store anew fences the writer before,
    whose next commit, sync or log segment raises. ``read_only`` opens without recovery's writes and fences nobody.
    Runs that a compaction replaced are deleted by an open that finds them older than ``retired_seconds``.
    """

    def __init__(self):
        raise TypeError("use Store.open")

    @classmethod
    def open(cls, spark: SparkSession, path: str, write_buffer_bytes: int = DEFAULT_WRITE_BUFFER_BYTES, clock: SystemClock | None = None, metrics: Metrics | None = None, read_only: bool = False, retired_seconds: float = RETIRED_SECONDS) -> "Store":
        if write_buffer_bytes <= 0:
            raise ValueError("write_buffer_bytes must be positive")
        self = object.__new__(cls)
        self.spark, self.path, self.buffer_bytes = spark, path.rstrip("/"), write_buffer_bytes
        self.clock, self.metrics, self.closed = clock or SystemClock(), metrics or Metrics(), False
        self.read_only, self.retired_seconds, self._turn, self._id = read_only, retired_seconds, threading.RLock(), uuid.uuid4().hex
        self._files, self._root = file_system(self.path)
        if not read_only:
            self._files.create_dir(self._root, recursive=True)
        self._recover()
        return self

    # -- recovery and the manifest

    def _read_manifest(self) -> dict | None:
        from pyarrow import fs

        if self._files.get_file_info(f"{self._root}/MANIFEST").type != fs.FileType.File:
            return None
        with self._files.open_input_file(f"{self._root}/MANIFEST") as f:
            return json.loads(f.read())

    def _recover(self) -> None:
        self.manifest = {"comparator": COMPARATOR_NAME, "runs": [], "retired": [], "last_sequence": 0, "batches": [], "next_file": 1, "writer": None}
        self.manifest |= self._read_manifest() or {}
        if self.manifest["comparator"] != COMPARATOR_NAME:
            raise EngineStateError(f"the store is ordered by {self.manifest['comparator']}")
        if not self.read_only:
            self._take_over()
        self._buffer, self._held, self._log = [], 0, None
        # What the data says counts, whatever the manifest says of it.
        last = self.manifest["last_sequence"]
        if self.manifest["runs"]:
            last = max(last, self.spark.read.parquet(*self.manifest["runs"]).agg(F.max("sequence")).first()[0] or 0)
        segments = listing(self._root, ".wal")
        for k, segment in enumerate(segments):
            with self._files.open_input_file(segment) as f:
                policy = wal.RecoveryPolicy.TRUNCATE_TAIL if k == len(segments) - 1 else wal.RecoveryPolicy.STRICT
                replayed = wal.decode_segment(f.read(), policy)
            # What a run already holds was flushed just before its segment should have gone.
            self._buffer += [m for m in replayed if m[1] > last]
        self._next = max([last, *(m[1] for m in self._buffer)]) + 1
        if self.read_only:
            return
        if self._buffer:
            self.flush()
        for segment in segments:
            self._files.delete_file(segment)

    def _take_over(self) -> None:
        """Becomes the writer, and removes what unfinished writes and old compactions left."""
        from pyarrow import fs

        now = self.clock.epoch_millis() / 1000
        old = [r for r in self.manifest["retired"] if r["at"] + self.retired_seconds <= now]
        self.manifest["retired"] = [r for r in self.manifest["retired"] if r not in old]
        self._commit(writer=self._id)
        for info in self._files.get_file_info(fs.FileSelector(self._root)):
            if info.path.endswith(".tmp"):
                (self._files.delete_dir if info.type == fs.FileType.Directory else self._files.delete_file)(info.path)
        for run in old:
            files, path = file_system(run["run"])
            if files.get_file_info(path).type == fs.FileType.Directory:
                files.delete_dir(path)

    def _still_writer(self) -> None:
        now = self._read_manifest()
        if now is not None and now.get("writer") != self._id:
            raise EngineStateError("another writer has opened the store")

    def _commit(self, **changes) -> None:
        if "writer" not in changes:
            self._still_writer()
        manifest = {**self.manifest, **changes}
        temporary = f"{self._root}/MANIFEST-{uuid.uuid4().hex}.tmp"
        try:
            with self._files.open_output_stream(temporary) as out:
                out.write(json.dumps(manifest).encode())
            synced(temporary)
            self._files.move(temporary, f"{self._root}/MANIFEST")
            synced(self._root)
        except OSError as e:
            raise StorageError(str(e)) from e
        self.manifest = manifest

    def _install(self, mutations: DataFrame, **changes) -> None:
        """Writes a run and makes it current by one commit, which also names the largest sequence."""
        number = self.manifest["next_file"]
        run = f"{self.path}/run-{number}-{uuid.uuid4().hex[:8]}"
        (
            mutations.repartitionByRange("user_key")
            .sortWithinPartitions("user_key", F.desc("sequence"), F.desc("value_type"))
            .write.option("parquet.bloom.filter.enabled#user_key", "true")
            .parquet(run)
        )
        newest = self.spark.read.schema(MUTATIONS).parquet(run).agg(F.max("sequence")).first()[0] or 0
        last = max(self.manifest["last_sequence"], newest)
        self._commit(runs=[run, *changes.pop("runs", self.manifest["runs"])], last_sequence=last, next_file=number + 1, **changes)

    # -- writes

    def _alive(self) -> None:
        if self.closed:
            raise EngineStateError("the store is closed")

    def _writable(self) -> None:
        self._alive()
        if self.read_only:
            raise EngineStateError("the store is open for reading only")

    def put(self, user_key: bytes, value: bytes, durability: Durability) -> None:
        if user_key is None or value is None:
            raise ValueError("key and value must not be null")
        with self._turn:
            self._append(bytes(user_key), ValueType.PUT, bytes(value), durability)

    def delete(self, user_key: bytes, durability: Durability) -> None:
        if user_key is None:
            raise ValueError("key must not be null")
        with self._turn:
            self._append(bytes(user_key), ValueType.DELETE, b"", durability)

    def _append(self, key: bytes, kind: ValueType, value: bytes, durability: Durability) -> None:
        self._writable()
        if not isinstance(durability, Durability):
            raise ValueError("a durability must be given")
        if self._log is None or durability is not Durability.NONE:
            self._still_writer()
        if self._log is None:
            name = f"{self._root}/{self.manifest['next_file']:020d}-{uuid.uuid4().hex[:8]}.wal"
            self._log, self._log_path, self._log_size = self._files.open_output_stream(name, compression=None, buffer_size=0), name, 0
            self._log.write(wal.header())
        mutation = (key, self._next, kind, value)
        data = wal.fragments(wal.encode_mutation(*mutation), self._log_size)
        self._log.write(data)
        self._log_size += len(data)
        self.metrics.increment("wal.append.count")
        if durability is not Durability.NONE:
            began = self.clock.nano_time()
            self._log.flush()
            synced(self._log_path)
            self.metrics.increment("wal.sync.count")
            self.metrics.record("wal.sync.duration", self.clock.nano_time() - began)
        self._next += 1
        self._buffer.append(mutation)
        self._held += len(key) + 8 + len(value)
        self.metrics.gauge("memtable.size.bytes", self._held)
        if self._held >= self.buffer_bytes:
            self.metrics.increment("memtable.switch.count")
            self.flush()

    def write_batch(self, batch: DataFrame, order: list, batch_id: str | None = None) -> None:
        """Appends (user_key, value_type, value) rows atomically, sequenced by ``order``: one job, one run.

        A batch whose id the store has seen is skipped, which makes retried streaming micro-batches safe.
        """
        with self._turn:
            self._writable()
            if batch_id is not None and batch_id in self.manifest["batches"]:
                return
            self.flush()
            stamped = checked(stamp(batch, order, self._next - 1))
            seen = [*self.manifest["batches"], batch_id][-1000:] if batch_id is not None else self.manifest["batches"]
            self._install(stamped, batches=seen)
            self._next = max(self._next - 1, self.manifest["last_sequence"]) + 1

    def flush(self) -> None:
        """Turns the buffer into a run; then its log segment goes."""
        with self._turn:
            self._writable()
            if self._buffer:
                self._install(self._buffered())
                self.metrics.increment("flush.count")
                self.metrics.increment("flush.bytes", self._held)
                self._buffer, self._held = [], 0
            if self._log is not None:
                self._log.close()
                self._files.delete_file(self._log_path)
                self._log = None

    def compact(self, drop_before: int | None = None) -> None:
        """Rewrites all runs as one. Versions that no snapshot at or after ``drop_before`` sees go. Beyond parity.

        The runs before stay for ``retired_seconds``, since DataFrames handed out earlier read them.
        """
        with self._turn:
            self.flush()
            if drop_before is None:
                drop_before = self._next - 1
            old = self.manifest["runs"]
            if not old:
                return
            log = self.mutations()
            kept = reconcile.newest_per_key(log.where(F.col("sequence") <= drop_before)).where(F.col("value_type") == 1)
            now = self.clock.epoch_millis() / 1000
            retired = [*self.manifest["retired"], *({"run": run, "at": now} for run in old)]
            self._install(kept.unionByName(log.where(F.col("sequence") > drop_before)), runs=[], retired=retired)

    # -- reads

    def _buffered(self) -> DataFrame:
        rows = [(bytearray(k), s, int(t), bytearray(v)) for k, s, t, v in self._buffer]
        return self.spark.createDataFrame(rows, MUTATIONS)

    def mutations(self) -> DataFrame:
        """Every version the store holds, of this moment."""
        self._alive()
        sources = [self.spark.read.parquet(*self.manifest["runs"])] if self.manifest["runs"] else []
        if self._buffer or not sources:
            sources.insert(0, self._buffered())
        return sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])

    def get(self, user_key: bytes) -> bytes | None:
        if user_key is None:
            raise ValueError("key must not be null")
        self._alive()
        for key, _, kind, value in reversed(self._buffer):
            if key == user_key:
                return value if kind == ValueType.PUT else None
        row = reconcile.get(self.mutations(), user_key).first()
        return None if row is None else bytes(row.value)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reconcile.multi_get(self.mutations(), keys)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return reconcile.scan(self.mutations(), start, end)

    def cursor(self, start: bytes | None = None, end: bytes | None = None) -> Cursor:
        return Cursor(self.scan(start, end))

    def snapshot(self, sequence: int) -> DataFrame:
        return reconcile.live_view(reconcile.as_of(self.mutations(), sequence))

    def comparator(self) -> str:
        return self.manifest["comparator"]

    @property
    def last_sequence(self) -> int:
        return self._next - 1

    def close(self) -> None:
        """Ends writing. The buffer isn't flushed; its log segment is replayed by the next open."""
        if self._log is not None:
            self._log.close()
            self._log = None
        self.closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
