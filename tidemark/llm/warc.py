"""WARC archives with a two-level capture index (operator 5).

Records are gzip members of archive files in the shared folder. The capture index holds a line a record, sorted by
reversed-host URL key, in compressed blocks; the block directory keeps each block's first key and place. A look-up
binary-searches the directory, reads one range of an index file and one range of an archive.

Tasks write files under names of their own and return what they wrote; only the rows that Spark commits count, so
files of lost or repeated tasks are never looked at.
"""

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_left
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.datasource import file_system
from .common import Scratch, mapped

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: Payloads shorter than this are always written as responses.
LEAST_REVISIT_BYTES = 0


def url_key(url: str | None) -> str:
    """The URL with its host reversed, as in ``org,example)/path?query``; port 80 and 443, scheme and a leading www. are dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, kind: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {json.dumps(url, ensure_ascii=False)[1:-1]}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a damaged record raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    body = rest[:n]
    if len(body) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != sha1):
        raise ValueError("payload")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": None if url is None else json.loads(f'"{url}"'),
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": length,
        "payload_digest": sha1,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


ENTRIES = "key string, page_id long, file string, offset long, length long"
#: Level 0 is a block of the index, level 1 the sorted directory of all blocks of one index file.
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, n int, level int"


class _Files:
    """Output files in the shared folder, begun anew at a size bound."""

    def __init__(self, root: str, kind: str, bound: int):
        self.root, self.kind, self.bound, self.out, self.at, self.name = root, kind, bound, None, 0, ""

    def write(self, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at >= self.bound:
            self.close()
        if self.out is None:
            files, path = file_system(self.root)
            files.create_dir(path, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}.{self.kind}", 0
            self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return self.name, at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Archive:
    def __init__(self, root: str, bound: int):
        self.files = _Files(root, "warc.gz", bound)

    def __call__(self, batch: pa.RecordBatch) -> dict:
        out = {c.split(" ")[0]: [] for c in ENTRIES.split(", ")}
        for page_id, url, html, sha1, refers_to, kind in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to", "kind")), strict=True):
            data = gzip.compress(record(page_id, url, (html or "").encode(), sha1, refers_to, kind), 6, mtime=0)
            for c, v in zip(out.values(), (url_key(url), page_id, *self.files.write(data)), strict=True):
                c.append(v)
        return out

    def end(self):
        self.files.close()
        return ()


class _Index:
    """Sorted entries into compressed blocks, and a directory of them at the file's end; returns the places of both."""

    def __init__(self, root: str, lines: int):
        self.files, self.lines, self.block, self.cuts = _Files(root, "idx", 1 << 40), lines, [], []

    def _put(self, rows: list, first: str, last: str, n: int, level: int) -> dict:
        name, at, size = self.files.write(gzip.compress("\n".join(json.dumps(x) for x in rows).encode(), 6, mtime=0))
        if level == 0:
            self.cuts.append((first, last, at, size))
        return {"first_key": [first], "last_key": [last], "file": [name], "offset": [at], "length": [size], "n": [n], "level": [level]}

    def _cut(self) -> dict:
        block, self.block = self.block[: self.lines], self.block[self.lines :]
        return self._put(block, block[0][0], block[-1][0], len(block), 0)

    def __call__(self, batch: pa.RecordBatch):
        self.block += [list(r.values()) for r in batch.to_pylist()]
        cuts = []
        while len(self.block) >= self.lines:
            cuts.append(self._cut())
        return {k: [v for c in cuts for v in c[k]] for k in cuts[0]} if cuts else None

    def end(self):
        while self.block:
            yield self._cut()
        if self.cuts:
            yield self._put(self.cuts, self.cuts[0][0], self.cuts[-1][1], len(self.cuts), 1)
        self.files.close()


def _range(root: str, name: str, offset: int, length: int, opened: dict | None = None) -> bytes:
    if opened is None or name not in opened:
        files, path = file_system(root)
        handle = files.open_input_file(f"{path}/{name}")
        if opened is not None:
            for old in list(opened):
                opened.pop(old).close()
            opened[name] = handle
    else:
        handle = opened[name]
    data = handle.read_at(length, offset)
    if opened is None:
        handle.close()
    return gzip.decompress(data)


class Archive:
    """Archives, index and directory under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._roots = spark, root, None

    def directory(self) -> DataFrame:
        """The blocks of the index."""
        return self.spark.read.parquet(f"{self.root}/directory").where("level = 0").drop("level")

    def roots(self) -> list:
        """The index files' directories in the order of their keys, read once: a row a file, each from its own range of keys."""
        if self._roots is None:
            rows = self.spark.read.parquet(f"{self.root}/directory").where("level = 1").collect()
            self._roots = sorted(rows, key=lambda r: (r.first_key, r.last_key))
        return self._roots

    def lookup(self, url: str) -> list[dict]:
        """The captures of a URL: binary searches in the files' directories, the directory and the block, each but the first one range read."""
        key, found = url_key(url), []
        roots = self.roots()
        for root in roots[bisect_left(roots, key, key=lambda r: r.last_key) :]:
            if root.first_key > key:
                break
            blocks = [json.loads(x) for x in _range(self.root, root.file, root.offset, root.length).split(b"\n")]
            for first, _, offset, length in blocks[bisect_left(blocks, key, key=lambda b: b[1]) :]:
                if first > key:
                    break
                lines = [json.loads(x) for x in _range(self.root, root.file, offset, length).split(b"\n")]
                for own, _, name, at, size in lines[bisect_left(lines, key, key=lambda x: x[0]) :]:
                    if own != key:
                        break
                    found.append(parse(_range(self.root, name, at, size)))
        return sorted(found, key=lambda r: (r["page_id"] is None, r["page_id"] or 0))

    def entries(self) -> DataFrame:
        """The whole index, block by block."""
        root = self.root

        def make():
            opened: dict = {}

            def run(batch: pa.RecordBatch) -> dict:
                lines = [json.loads(x) for d in batch.to_pylist() for x in _range(root, d["file"], d["offset"], d["length"], opened).split(b"\n")]
                return {c.split(" ")[0]: [x[k] for x in lines] for k, c in enumerate(ENTRIES.split(", "))}

            return run

        return mapped(self.directory().repartition("file", "offset"), ENTRIES, make)

    def records(self) -> DataFrame:
        """Every record, by range reads in the order of the archives."""
        root = self.root
        schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"

        def make():
            opened: dict = {}

            def run(batch: pa.RecordBatch) -> dict:
                rows = [parse(_range(root, e["file"], e["offset"], e["length"], opened)) for e in batch.to_pylist()]
                for r in rows:
                    r["payload"] = None if r["payload"] is None else r["payload"].decode()
                return {c.split(" ")[0]: [r[c.split(" ")[0]] for r in rows] for c in schema.split(", ")}

            return run

        # A part of an archive, 8 MB long, is one task's, in order.
        parts = self.entries().repartition("file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
        return mapped(parts, schema, make)


def write_archive(pages: DataFrame, least_revisit: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Archives for ``pages`` (page_id, url, html; others are ignored), one record a row.

    The payload is the html in UTF-8, null being empty. Of records with equal payloads of at least ``least_revisit``
    bytes those with the largest page_id are responses and the others revisits of it; rows that share that page_id are
    all responses, and null page_ids are smaller than any. Null urls have an empty key. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("hex"), F.octet_length(payload).alias("size"))
    newest = rows.groupBy("hex").agg(F.max("page_id").alias("newest"))
    joined = rows.join(newest, "hex")
    first = (F.col("size") < least_revisit) | F.col("newest").isNull() | F.coalesce(F.col("page_id") == F.col("newest"), F.lit(False))
    marked = joined.select("page_id", "url", "html", "hex", F.when(first, F.lit("response")).otherwise(F.lit("revisit")).alias("kind"), F.when(~first, F.col("newest")).alias("refers_to"))
    marked = marked.withColumn("sha1", base32("hex")).drop("hex")
    root = f"{scratch.root}/archive"
    entries = scratch.keep(mapped(marked, ENTRIES, lambda: _Archive(root, archive_bytes)), "entries")
    placed = entries.repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id")
    mapped(placed, DIRECTORY, lambda: _Index(root, block_lines)).write.parquet(f"{root}/directory")
    scratch.drop("entries")
    return Archive(spark, root)


def base32(column: str):
    """Upper-case base32 of the 40 hex digits of a SHA-1: eight groups of five digits are four characters each."""
    out = []
    for k in range(8):
        n = F.conv(F.substring(column, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


SQL = """
with p as (select page_id, encode(coalesce(html, '')) body from pages),
h as (select page_id, octet_length(body) n, sha1(body) x, max(page_id) over (partition by body) newest from p),
d as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + ((('0x' || substr(x, cast(5 * (i // 4) as integer) + 1, 5))::integer >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') b32 from h)
select page_id, cast(n as bigint) payload_bytes, b32 payload_digest, case when page_id = newest then 'response' else 'revisit' end record_type,
 case when page_id <> newest then newest end refers_to from d
"""
