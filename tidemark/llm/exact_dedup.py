"""Exact duplicates by Patricia tries (operator 6).

Texts are compared byte by byte after white space is removed. Every task first inserts its own texts into a
compressed radix trie, whose terminal nodes count the copies and hold the one to stay; so a text that is
copied a billion times leaves each task once. Length and content hash then deal the distinct texts to
partitions, where tries of full byte strings merge them. A trie over its memory budget spills its largest
subtree to a temporary file, and later texts of that subtree follow; spilled subtrees are merged one by one.
"""

import hashlib
import pickle
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Scratch, mapped, numbered, without_rows

TASK_BYTES = 48 << 20
PARTITION_BYTES = 96 << 20
NODE_BYTES = 300


class Node:
    __slots__ = ("children", "label", "spilled", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.children, self.spilled = label, value, None, None


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A radix trie from byte strings to values that ``merge(old, new)`` combines."""

    def __init__(self, merge, budget: int | None = None):
        self.root, self.merge, self.budget, self.bytes, self.files = Node(b""), merge, budget, 0, 0

    def insert(self, key: bytes, value) -> None:
        node, at, n = self.root, 0, len(key)
        while True:
            if node.spilled is not None:
                pickle.dump((key, value), node.spilled)
                return
            if at == n:
                node.value = value if node.value is None else self.merge(node.value, value)
                break
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = Node(key[at:], value)
                self.bytes += n - at + NODE_BYTES
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = common(child.label, key[at : at + len(child.label)])
            fork = Node(child.label[:shared])
            fork.children = {child.label[shared]: child}
            child.label = child.label[shared:]
            node.children[key[at]] = fork
            self.bytes += NODE_BYTES
            node, at = fork, at + shared
        while self.budget is not None and self.bytes > self.budget and self._spill():
            pass

    @staticmethod
    def _walk(node: Node, path: bytes):
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            yield node, path
            if node.children:
                stack += [(c, path + c.label) for c in node.children.values()]

    def _size(self, node: Node) -> int:
        return sum(len(x.label) + NODE_BYTES for x, _ in self._walk(node, b""))

    def _spill(self) -> bool:
        """Moves the largest subtree below the first fork to a file; False if no subtree is left to move."""
        node, path = self.root, b""
        while node.value is None and node.children and len(node.children) == 1:
            (child,) = node.children.values()
            if child.spilled is not None:
                return False
            node, path = child, path + child.label
        inside = [c for c in (node.children or {}).values() if c.spilled is None]
        if not inside:
            return False
        top = max(inside, key=self._size)
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for x, key in self._walk(top, path + top.label):
            if x.spilled is not None:  # a smaller subtree that went before
                x.spilled.seek(0)
                shutil.copyfileobj(x.spilled, file)
                x.spilled.close()
            elif x.value is not None:
                pickle.dump((key, x.value), file)
        self.bytes -= self._size(top) - NODE_BYTES
        top.children, top.value, top.spilled = None, None, file
        self.files += 1
        return True

    def items(self):
        """Every key with its value; spilled subtrees are loaded one at a time, into tries that may spill again."""
        files = []
        for node, key in self._walk(self.root, b""):
            if node.spilled is not None:
                files.append(node.spilled)
            elif node.value is not None:
                yield key, node.value
        self.root = Node(b"")
        for file in files:
            file.seek(0)
            inner = Trie(self.merge, self.budget)
            while True:
                try:
                    inner.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from inner.items()


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE_BYTES)


def _rank(v: tuple) -> tuple:
    """Order in which copies are preferred: most code points, smallest identifier (nulls last), first row."""
    chars, doc_id, row = v[0], v[1], v[2]
    return (-chars, doc_id is None, doc_id or 0, row)


def merge(a: tuple, b: tuple) -> tuple:
    best = a if _rank(a) <= _rank(b) else b
    return (*best[:3], a[3] + b[3])


DIGESTS = "row long, doc_id long, text_sha256 string, n_bytes long, n_chars long"
CLASSES = "text_sha256 string, n_bytes long, body binary, n_chars long, doc_id long, row long, copies long"


def _digests():
    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        bodies = [normalise(t) for t in texts]
        return {
            "row": batch.column("row"),
            "doc_id": batch.column("doc_id"),
            "text_sha256": [hashlib.sha256(b).hexdigest() for b in bodies],
            "n_bytes": [len(b) for b in bodies],
            "n_chars": [len(t or "") for t in texts],
        }

    return run


def _columns(items) -> dict:
    items = list(items)
    return {
        "text_sha256": [hashlib.sha256(k).hexdigest() for k, _ in items],
        "n_bytes": [len(k) for k, _ in items],
        "body": [k for k, _ in items],
        "n_chars": [v[0] for _, v in items],
        "doc_id": [v[1] for _, v in items],
        "row": [v[2] for _, v in items],
        "copies": [v[3] for _, v in items],
    }


def _chunks(items, most: int = 16 << 20):
    out, size = [], 0
    for k, v in items:
        out.append((k, v))
        size += len(k) + 200
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


class _Combine:
    """A task's own texts; the trie is handed on and begun anew when it reaches its budget."""

    def __init__(self, budget: int):
        self.budget, self.trie = budget, Trie(merge)

    def __call__(self, batch: pa.RecordBatch):
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            self.trie.insert(normalise(text), (len(text or ""), doc_id, row, 1))
        if self.trie.bytes > self.budget:
            full, self.trie = self.trie, Trie(merge)
            return _columns(full.items())
        return None

    def end(self):
        for part in _chunks(self.trie.items()):
            yield _columns(part)


class _Own:
    """A partition's distinct texts, from all tasks."""

    def __init__(self, budget: int):
        self.trie = Trie(merge, budget)

    def __call__(self, batch: pa.RecordBatch):
        names = ("body", "n_chars", "doc_id", "row", "copies")
        for body, *value in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            self.trie.insert(body, tuple(value))

    def end(self):
        for part in _chunks(self.trie.items()):
            yield _columns(part) | {"body": [None] * len(part)}


def exact_dedup(docs: DataFrame, task_bytes: int = TASK_BYTES, partition_bytes: int = PARTITION_BYTES, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns row, doc_id, keep_id, group_size, kept, text_sha256. ``row`` is the value of
    the column ``row`` names, which has to be written; without one the input is written once with a row id.
    Of equal texts that with the most code points stays, then the smallest doc_id (null last), then the first
    row, so that of repeated rows exactly one stays. Null texts are empty texts; all empty or blank texts are
    one group. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text"), scratch)
    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = scratch.keep(mapped(rows, DIGESTS, _digests), "members")
    local = mapped(rows, CLASSES, lambda: _Combine(task_bytes))
    owners = mapped(local.repartition("n_bytes", "text_sha256"), CLASSES, lambda: _Own(partition_bytes)).drop("body", "n_chars")
    owners = scratch.keep(owners.select("n_bytes", "text_sha256", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size")), "owners")
    joined = members.join(owners, ["n_bytes", "text_sha256"])
    return scratch.last(joined.select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts, columns unchanged."""
    docs, own = numbered(docs, Scratch(docs.sparkSession, "exact"))
    return without_rows(docs, own, exact_dedup(docs, row=own).where(~F.col("kept")))
