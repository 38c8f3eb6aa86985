"""WARC archives with a two-level capture index.

Writing: every page becomes one record, gzipped on its own, in archive files of
bounded size under a shared folder.  Of the pages with equal payloads of at
least ``min_bytes`` bytes, the one with the largest id is the response and the
others are revisits of it; smaller payloads are all responses.

Index: keys are the URL with its host reversed, sorted over the whole capture
and cut into zlib blocks of bounded entries; each index file ends in a sparse
directory of its blocks (first key, offset, length).  A look-up bisects the
directory, range-reads one or a few blocks, bisects in them and range-reads the
records.

Reading back: the index entries are grouped by archive file and every record is
range-read, inflated and parsed; a revisit's payload is that of its response.

A null html is an empty payload; a null URL is written as an empty one; equal
URLs are all kept, in id order; repeated rows of one id are one record each (a
payload's response is its least row there); rows without an id are written and
come back with a null id.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import _bytes as B

MIN_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK_ENTRIES = 1000
DATE = "2000-01-01T00:00:00Z"

_ENTRY = "skey string, page_id long, file string, offset long, length long, digest string, kind string, refers_to long"


def surt(url: str | None) -> str:
    """``http://www.a.com:80/x?q#f`` -> ``com,a,www)/x?q``."""
    try:
        p = urlsplit((url or "").strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return (url or "").strip().lower()
    port = f":{port}" if port and (p.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{','.join(reversed(host.split('.')))}{port}){p.path or '/'}{'?' + p.query if p.query else ''}"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record with an HTTP response block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = http + (b"\r\n" if kind == "revisit" else f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_line(refers_url or '')}", f"X-Refers-To-Page-Id: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzipped record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = B.text_buffer(batch.column("html"))
        body = memoryview(buf)
        digests = [hashlib.sha1(body[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
        sizes = pa.array(off[1:] - off[:-1])
        keys = [surt(u) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("html"), pa.array(keys, pa.string()), pa.array(digests, pa.string()), sizes], names=["page_id", "url", "html", "skey", "digest", "size"])


def _write_batches(root: str, file_bytes: int):
    """Each task writes archives of its own rows; a retried task writes other
    files, and only those whose rows reach the index count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = {c: [] for c in ("file", "offset", "length")}
                cols = [batch.column(c).to_pylist() for c in ("kind", "page_id", "url", "html", "digest", "refers_to", "refers_url")]
                for kind, page, url, html, digest, refers, refers_url in zip(*cols, strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    raw = record_bytes(kind, page, url or "", (html or "").encode(), digest, refers, refers_url)
                    out.write(raw)
                    rows["file"].append(name)
                    rows["offset"].append(at)
                    rows["length"].append(len(raw))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("skey"), batch.column("page_id"), pa.array(rows["file"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64()), batch.column("digest"), batch.column("kind"), batch.column("refers_to")],
                    names=["skey", "page_id", "file", "offset", "length", "digest", "kind", "refers_to"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per page; returns the index entries (``_ENTRY``)."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    facts = source.mapInArrow(_digest_batches, "page_id long, url string, html string, skey string, digest string, size long")
    # only digests are shuffled to find equal payloads, and only those that
    # several pages share come back
    shared = facts.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("last"), F.min("page_id").alias("first"))
    shared = B.stage(shared.filter("n > 1 and first < last.page_id").select("digest", "size", F.col("last.page_id").alias("to"), F.col("last.url").alias("to_url")), "warc-shared")
    revisit = F.col("to").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("to"))
    rows = facts.join(shared, ["digest", "size"], "left").select(
        "skey", "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("to")).alias("refers_to"), F.when(revisit, F.col("to_url")).alias("refers_url"),
    )
    return B.stage(rows.mapInArrow(_write_batches(root, file_bytes), _ENTRY), "warc-entries")


def _index_batches(root: str, block: int):
    """Sorted entries to index files: zlib blocks, then the sparse directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, out, at, sparse, held = f"{uuid.uuid4().hex}.cdx", None, 0, [], []
        total = 0

        def flush() -> None:
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode())
            out.write(raw)
            sparse.append([held[0][0], at, len(raw)])
            at += len(raw)
            held.clear()

        first = last = None
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("skey", "page_id", "file", "offset", "length", "digest", "kind", "refers_to")), strict=True):
                first, last = x[0] if first is None else first, x[0]
                held.append(x)
                total += 1
                if len(held) >= block:
                    flush()
        if held:
            flush()
        if out is not None:
            tail = zlib.compress(json.dumps(sparse, ensure_ascii=False).encode())
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (first, pa.string()), (last, pa.string()), (at, pa.int64()), (len(tail), pa.int64()), (total, pa.int64()))], names=["file", "first_key", "last_key", "dir_offset", "dir_length", "entries"])

    return run


def write_index(entries: DataFrame, root: str, block: int = BLOCK_ENTRIES) -> DataFrame:
    """One row per index file: its key range and where its directory stands.
    The sort is by key and id, so a crowded host spreads over many files."""
    ordered = entries.repartitionByRange("skey", "page_id").sortWithinPartitions("skey", "page_id")
    return B.stage(ordered.mapInArrow(_index_batches(root, block), "file string, first_key string, last_key string, dir_offset long, dir_length long, entries long"), "warc-index")


class IndexFile:
    """An open index file; reads its directory once and blocks on demand."""

    def __init__(self, root: str, name: str, dir_offset: int, dir_length: int):
        fs, base = _open(root)
        self.file = fs.open_input_file(f"{base}/{name}")
        self.sparse = json.loads(zlib.decompress(self.file.read_at(dir_length, dir_offset)))
        self.keys = [x[0] for x in self.sparse]

    def block(self, i: int) -> list[list]:
        _, at, size = self.sparse[i]
        return [json.loads(x) for x in zlib.decompress(self.file.read_at(size, at)).split(b"\n")]

    def find(self, key: str) -> list[list]:
        """Entries of ``key``: from the block before the first that starts with
        a key not below it."""
        i, out = max(0, bisect.bisect_left(self.keys, key) - 1), []
        while i < len(self.keys) and self.keys[i] <= key:
            rows = self.block(i)
            keys = [x[0] for x in rows]
            out += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            i += 1
        return out


def lookup(index: DataFrame, urls: DataFrame, root: str, url: str = "url") -> DataFrame:
    """The captures of the asked URLs: page_id, url, kind, refers_to, payload
    (a revisit's own record has none)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("url")
            yield pa.RecordBatch.from_arrays([asked, pa.array([surt(x) for x in asked.to_pylist()], pa.string())], names=["url", "skey"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        have: tuple[str, IndexFile | None] = ("", None)
        for batch in batches:
            out = {c: [] for c in ("page_id", "url", "kind", "refers_to", "payload")}
            for name, at, size, key, asked in zip(*(batch.column(c).to_pylist() for c in ("file", "dir_offset", "dir_length", "skey", "url")), strict=True):
                if have[0] != name:
                    have = (name, IndexFile(root, name, at, size))
                for _, page, file, offset, length, _, kind, refers in have[1].find(key):
                    with fs.open_input_file(f"{base}/{file}") as f:
                        _, payload = parse_record(f.read_at(length, offset))
                    for c, v in zip(out, (page, asked, kind, refers, payload.decode()), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=list(out))

    asked = urls.select(F.col(url).alias("url")).distinct().mapInArrow(keys, "url string, skey string")
    near = asked.join(index, (F.col("skey") >= F.col("first_key")) & (F.col("skey") <= F.col("last_key")))
    return near.repartition("file").sortWithinPartitions("file").mapInArrow(read, "page_id long, url string, kind string, refers_to long, payload string")


def _entries_batches(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "dir_offset", "dir_length")), strict=True):
                index = IndexFile(root, name, at, size)
                for i in range(len(index.keys)):
                    cols = list(zip(*index.block(i), strict=True))
                    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["skey", "page_id", "file", "offset", "length", "digest", "kind", "refers_to"])

    return run


_PAYLOAD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _read_batches(root: str, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, f = "", None
        for batch in batches:
            out = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                head, payload = parse_record(f.read_at(length, offset))
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                out["page_id"].append(int(head["X-Page-Id"]) if head.get("X-Page-Id") else None)
                out["payload_bytes"].append(int(head["X-Payload-Length"]))
                out["payload_digest"].append(digest)
                out["record_type"].append(kind)
                out["refers_to"].append(int(head["X-Refers-To-Page-Id"]) if kind == "revisit" else None)
                out["payload"].append(payload.decode() if keep_payload and kind == "response" else None)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def read_archives(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Every record the index knows, read from the archives (``_PAYLOAD``); a
    revisit's payload is left null here, see ``resolved``."""
    # a stated count: entries are small, but the records behind them are not, so
    # Spark must not put many archives into one task
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = index.repartition(parts, "file").mapInArrow(_entries_batches(root), _ENTRY)
    # neighbours in an archive are read together; files are of bounded size
    ordered = entries.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read_batches(root, payloads), _PAYLOAD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with each revisit's payload taken from its response."""
    body = records.filter("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("body")).dropDuplicates(["refers_to"])
    return records.join(body, "refers_to", "left").withColumn("payload", F.coalesce("payload", "body")).drop("body")


def capture(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, block: int = BLOCK_ENTRIES) -> DataFrame:
    """Write ``pages`` and their index under ``root``; returns the index files."""
    fs, base = _open(root)
    fs.create_dir(base, recursive=True)
    return write_index(write_archives(pages, root, min_bytes, file_bytes), root, block)


def new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark, 'warc')}-{uuid.uuid4().hex[:12]}"


def warc_report(pages: DataFrame) -> DataFrame:
    """Write and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to."""
    root = new_root(pages.sparkSession)
    return read_archives(capture(pages, root), root, payloads=False).drop("payload")
